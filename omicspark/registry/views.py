"""The test tables dressed as omics tables.

One text per view, read by Spark as a query and by the SQL side as a CTE.
"""

from omicspark.registry.base import READS, define_view

define_view(
    "psm",
    ("lineitem",),
    """SELECT 'P' || CAST(l_partkey AS STRING) AS Unique_PSM,
       CASE WHEN l_partkey % 3 = 0 THEN 'S' || CAST(l_suppkey % 97 AS STRING)
            WHEN l_partkey % 3 = 1 THEN 'S' || CAST(l_partkey % 97 AS STRING) || '; S' || CAST(l_partkey % 41 AS STRING)
            ELSE 'S' || CAST(l_partkey % 41 AS STRING) || ';S' || CAST(l_partkey % 97 AS STRING) || '; S' || CAST(l_partkey % 23 AS STRING)
       END AS Master_Protein_Accessions,
       l_returnflag AS Condition,
       CAST(l_linenumber AS INT) AS Replicate,
       l_returnflag || '_' || CAST(l_linenumber AS STRING) AS Sample_Origination,
       CASE WHEN l_quantity < 4 THEN NULL ELSE l_extendedprice END AS Abundance,
       l_orderkey, l_suppkey
FROM {lineitem}""",
)

define_view(
    "raw",
    ("lineitem",),
    """SELECT 'PEP' || CAST(l_partkey AS STRING) AS Sequence,
       CASE WHEN l_linenumber % 4 = 0 THEN NULL
            ELSE 'C' || CAST(l_linenumber AS STRING) || '(DBIA); K' || CAST(l_linenumber + 2 AS STRING) || '(TMT6plex)'
                 || CASE WHEN l_linenumber % 2 = 1 THEN '; C' || CAST(l_linenumber + 1 AS STRING) || '(DBIA)' ELSE '; N-Term(TMT6plex)' END
       END AS Modifications,
       CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE CAST(l_linenumber % 3 + 2 AS STRING) END AS Charge,
       CASE WHEN l_partkey % 11 = 0 THEN ' true ' WHEN l_partkey % 13 = 0 THEN '+'
            WHEN l_partkey % 5 = 0 THEN NULL ELSE 'False' END AS Contaminant,
       CASE WHEN l_suppkey % 17 = 0 THEN '  ' WHEN l_suppkey % 29 = 0 THEN NULL
            ELSE 'S' || CAST(l_suppkey AS STRING) END AS Master_Protein_Accessions,
       CASE WHEN l_quantity = 7 THEN 'n/a' ELSE CAST(l_quantity AS STRING) END AS Average_Reporter_SN,
       CAST(l_discount * 10 AS STRING) AS Normalized_CHIMERYS_Coefficient,
       CAST(l_tax * 1000 AS STRING) AS Isolation_Interference_in_Percent,
       CASE WHEN l_linenumber = 6 THEN 'No Value' WHEN l_linenumber = 5 THEN ' no VALUE '
            WHEN l_linenumber = 3 THEN NULL ELSE 'ok' END AS Quan_Info,
       CASE WHEN l_partkey % 23 = 0 THEN 'TRUE' ELSE NULL END AS Reverse,
       CASE WHEN l_quantity > 45 THEN NULL WHEN l_quantity = 44 THEN 'bad' ELSE CAST(l_quantity / 10 AS STRING) END AS Quan_Value,
       CAST(l_extendedprice AS STRING) AS Abundance,
       CAST(l_quantity AS STRING) AS Abundance_126,
       CAST(l_extendedprice AS STRING) AS Abundance_127N,
       CASE WHEN l_discount = 0 THEN NULL ELSE CAST(l_discount * 100 AS STRING) END AS Abundance_127C,
       CASE WHEN l_tax = 0.05 THEN 'NaN' ELSE CAST(l_tax * 100 AS STRING) END AS Abundance_128N,
       l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag
FROM {lineitem}""",
)

define_view(
    "plong",
    ("lineitem",),
    """SELECT 'S' || CAST(l_suppkey AS STRING) AS protein_accession,
       CASE WHEN l_suppkey % 9 = 0 THEN NULL
            WHEN l_suppkey % 4 = 0 THEN 'g' || CAST(l_suppkey % 30 AS STRING) || '; h' || CAST(l_suppkey % 7 AS STRING)
            ELSE 'G' || CAST(l_suppkey AS STRING) END AS gene_name,
       l_returnflag || '_' || CAST(l_linenumber AS STRING) AS sample_id,
       l_returnflag AS condition,
       CAST(l_linenumber AS STRING) AS replicate,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE 'B' || CAST(l_linenumber % 2 AS STRING) END AS batch,
       CASE WHEN (l_suppkey + l_linenumber) % 10 = 0 THEN NULL
            ELSE round(avg(log2(l_extendedprice)), 9) END AS processed_log2_abundance,
       CASE WHEN (l_suppkey + l_linenumber) % 10 = 0 THEN 'missing'
            WHEN l_suppkey % 3 = 0 THEN 'imputed' WHEN l_suppkey % 3 = 1 THEN 'observed'
            ELSE 'model_estimated' END AS provenance,
       count(*) AS observed_feature_count,
       CAST(l_suppkey % 4 AS BIGINT) AS imputed_feature_count,
       'protein' AS result_layer,
       CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END * 7 + CAST(l_linenumber AS INT) - 1 AS sample_order,
       CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS condition_order
FROM {lineitem}
GROUP BY l_suppkey, l_returnflag, l_linenumber""",
)

define_view(
    "peptides",
    ("lineitem",),
    """SELECT 'S' || CAST(l_partkey % 97 AS STRING) AS protein_accession,
       'P' || CAST(l_partkey AS STRING) AS peptide_id,
       l_returnflag || '_' || CAST(l_linenumber AS STRING) AS sample_id,
       l_returnflag AS condition,
       CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(l_linenumber AS STRING) END AS replicate,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE 'B' || CAST(l_linenumber % 2 AS STRING) END AS batch,
       CASE WHEN (l_partkey + l_linenumber) % 8 = 0 THEN NULL
            ELSE round(avg(log2(l_extendedprice)), 9) END AS processed_log2_abundance,
       CASE WHEN (l_partkey + l_linenumber) % 6 = 0 THEN 'imputed' ELSE 'observed' END AS provenance,
       CASE WHEN l_partkey % 10 = 3 THEN 'ptm' ELSE 'protein' END AS result_layer
FROM {lineitem}
GROUP BY l_partkey, l_returnflag, l_linenumber""",
)

define_view(
    "features",
    ("lineitem",),
    """SELECT 'S' || CAST(l_partkey % 97 AS STRING) AS protein,
       'P' || CAST(l_partkey AS STRING) AS feature,
       l_returnflag || '_' || CAST(l_linenumber AS STRING) AS sample,
       CASE WHEN l_quantity < 4 THEN 0.0 ELSE l_extendedprice END AS abundance
FROM {lineitem}""",
)

define_view(
    "logs",
    ("features",),
    """SELECT protein, feature, sample, log2(round(sum(abundance), 2)) AS log2_abundance
FROM {features} GROUP BY protein, feature, sample HAVING sum(abundance) > 0""",
)

define_view(
    "levels",
    ("lineitem",),
    """SELECT 'P' || CAST(l_partkey AS STRING) AS protein,
       l_returnflag || '_' || CAST(l_linenumber AS STRING) AS sample,
       l_returnflag AS condition,
       CASE WHEN l_linenumber <= 3 THEN 'B1' ELSE 'B2' END AS batch,
       CASE WHEN l_partkey % 40 = 7 THEN 12.5 ELSE avg(log2(l_extendedprice)) END AS level
FROM {lineitem}
GROUP BY l_partkey, l_returnflag, l_linenumber""",
)

define_view(
    "diff",
    ("lineitem",),
    """SELECT 'D' || CAST(l_linenumber AS STRING) || '_vs_DMSO' AS comparison_id,
       CASE WHEN l_partkey % 30 = 4 THEN 'P' || CAST(l_partkey AS STRING) || '; Q' || CAST(l_partkey AS STRING)
            ELSE 'P' || CAST(l_partkey AS STRING) END AS protein_accession,
       CASE WHEN l_partkey % 21 = 0 THEN NULL WHEN l_partkey % 22 = 0 THEN ''
            WHEN l_partkey % 8 = 0 THEN 'G' || CAST(l_partkey % 700 AS STRING) || '-2; H' || CAST(l_partkey % 9 AS STRING)
            ELSE 'G' || CAST(l_partkey % 700 AS STRING) END AS gene_name,
       round(avg(l_extendedprice) / 10000 - 3, 10) AS log2_fold_change,
       CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE round(pow(avg(l_discount) * 10, 3) + 0.0, 10) END AS p_value,
       CASE WHEN l_partkey % 40 = 0 THEN NULL
            ELSE least(1.0, round(pow(avg(l_discount) * 10, 3) + 0.0, 10) * 1.2) END AS adjusted_p_value,
       round(0.05 + avg(l_tax), 10) AS standard_error,
       round((avg(l_extendedprice) / 10000 - 3) / (0.0500317 + avg(l_tax)), 8) AS statistic,
       CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE count(*) END AS psm_count,
       CASE WHEN l_returnflag = 'R' THEN 'ptm' ELSE 'protein' END AS result_layer,
       'tmt' AS pipeline
FROM {lineitem}
GROUP BY l_partkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'ptm' ELSE 'protein' END""",
)

define_view(
    "raw_results",
    ("diff",),
    """SELECT protein_accession AS Protein, gene_name AS Gene, comparison_id AS Label,
       CASE WHEN psm_count = 5 THEN 'Infinity' WHEN psm_count = 6 THEN 'NaN'
            ELSE CAST(log2_fold_change AS STRING) END AS log2FC,
       CASE WHEN psm_count = 4 THEN 'NA' ELSE CAST(p_value AS STRING) END AS pvalue,
       adjusted_p_value AS adj_pvalue, standard_error AS SE, result_layer
FROM {diff}""",
)

define_view(
    "catalog",
    ("lineitem",),
    """SELECT DISTINCT 'D' || CAST(l_linenumber AS STRING) || '_vs_DMSO' AS comparison_id,
       'D' || CAST(l_linenumber AS STRING) || ' vs DMSO' AS display_label,
       CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'N' END AS group1_label,
       CASE WHEN l_linenumber = 7 THEN 'X' ELSE 'R' END AS group2_label,
       8 - CAST(l_linenumber AS INT) AS comparison_order
FROM {lineitem}
UNION
SELECT 'D9_vs_DMSO' AS comparison_id, 'D9 vs DMSO' AS display_label, 'A' AS group1_label, 'X' AS group2_label, 9 AS comparison_order
FROM {lineitem}""",
)

define_view(
    "fc",
    ("lineitem",),
    """SELECT 'P' || CAST(l_partkey AS STRING) AS feature,
       'K' || CAST(l_suppkey % 25 AS STRING) AS comparison,
       round(avg(l_extendedprice) / 10000 - 3, 10) AS value
FROM {lineitem}
GROUP BY l_partkey, l_suppkey % 25""",
)

define_view(
    "ranked",
    ("diff",),
    """SELECT comparison_id, trim(split_part(gene_name, ';', 1)) AS gene, protein_accession,
       round(-log10(p_value) * sign(log2_fold_change) + 0.0, 9) AS metric
FROM {diff}
WHERE result_layer = 'protein' AND gene_name <> '' AND p_value > 0 AND p_value <= 1
  AND log2_fold_change IS NOT NULL""",
)

define_view(
    "ranking",
    ("ranked",),
    """SELECT gene, max(abs(metric)) AS metric_size,
       CASE WHEN max(metric) >= -min(metric) THEN max(metric) ELSE min(metric) END AS metric
FROM {ranked} WHERE comparison_id = 'D1_vs_DMSO' GROUP BY gene""",
)

define_view(
    "rankings",
    ("ranked",),
    """SELECT comparison_id, gene,
       CASE WHEN max(metric) >= -min(metric) THEN max(metric) ELSE min(metric) END AS metric
FROM {ranked} WHERE gene <> '' GROUP BY comparison_id, gene""",
)

define_view(
    "gene_sets",
    ("part",),
    """SELECT DISTINCT p_brand AS set_name, 'G' || CAST(p_partkey % 700 AS STRING) AS gene FROM {part}
UNION
SELECT DISTINCT p_type AS set_name, 'G' || CAST(p_partkey % 700 AS STRING) AS gene FROM {part}""",
)

define_view(
    "terms",
    ("part",),
    """SELECT p_brand || '/' || p_type AS term,
       round(avg(p_retailprice) / 500 - 2.9, 8) AS nes,
       round(avg(p_size) / 60, 8) AS pval,
       round(avg(p_size) / 55, 8) AS fdr,
       count(*) AS matched_genes
FROM {part} GROUP BY p_brand, p_type""",
)

define_view(
    "edges",
    ("lineitem",),
    """SELECT 'P' || CAST(l_partkey AS STRING) AS source,
       'P' || CAST((l_partkey * 7 + l_suppkey) % 2000 AS STRING) AS target,
       CASE l_returnflag WHEN 'A' THEN 'Activation' WHEN 'N' THEN 'Inhibition, Complex' ELSE 'Complex' END AS interaction,
       count(*) AS evidence_count,
       count(DISTINCT l_linenumber) AS paper_count,
       round(avg(l_discount) * 10, 9) AS correlation
FROM {lineitem} GROUP BY l_partkey, l_suppkey, l_returnflag""",
)

define_view(
    "design",
    ("orders",),
    """SELECT DISTINCT o_orderpriority AS drug, o_orderstatus AS dose,
       CAST(o_custkey % 4 + 1 AS INT) AS replicate,
       'file_' || o_orderpriority || '_' || o_orderstatus || '_' || CAST(o_custkey % 4 + 1 AS STRING) || '.txt' AS filename
FROM {orders}""",
)

define_view(
    "names",
    ("orders",),
    """SELECT DISTINCT o_orderpriority || '_' || o_orderstatus || '_' || CAST(o_custkey % 12 AS STRING) AS sample_id FROM {orders}
UNION SELECT DISTINCT o_orderpriority || CAST(o_custkey % 5 AS STRING) AS sample_id FROM {orders}
UNION SELECT DISTINCT 'Sample_dmso_' || CAST(o_custkey % 5 AS STRING) AS sample_id FROM {orders}
UNION SELECT DISTINCT 'x_INCZ' || CAST(o_custkey % 7 AS STRING) || '_2' AS sample_id FROM {orders}
UNION SELECT DISTINCT 'my control ' || o_orderstatus AS sample_id FROM {orders}""",
)

define_view(
    "definitions",
    ("orders",),
    """SELECT DISTINCT o_orderpriority || '+' || o_orderstatus AS label, o_orderpriority || '_' || o_orderstatus AS prefix FROM {orders}
UNION SELECT DISTINCT o_orderpriority AS label, o_orderpriority AS prefix FROM {orders}""",
)

LETTERS = """upper(translate(text, 'éóèñçüêäöíÉÈÑÓÇÄÊÜÖÍ .,;:!?()-/"0123456789ß\n\t\r>|*%&$#+=@', 'eoencueaoiEENOCAEUOI'))"""

define_view(
    "proteome",
    ("documents",),
    f"""SELECT 'S' || CAST(doc_id AS STRING) AS accession,
       CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'GN' || CAST(doc_id % 60 AS STRING) END AS gene,
       {LETTERS} AS sequence
FROM {{documents}}""",
)

# ``ptm_rows`` reads 40 letters of a sequence; the beginning of a text gives them, unless few of its signs are letters.
define_view(
    "proteome_heads",
    ("documents",),
    f"""SELECT accession, CASE WHEN length(head) >= 40 THEN head ELSE {LETTERS} END AS sequence
FROM (SELECT 'S' || CAST(doc_id AS STRING) AS accession, text, {LETTERS.replace("text", "left(text, 200)")} AS head FROM {{documents}})""",
)
READS["ptm_rows", "proteome"] = "proteome_heads"

define_view(
    "ptm_rows",
    ("lineitem", "proteome"),
    """SELECT CAST(l_partkey * 10 + l_linenumber AS BIGINT) AS _SourceRow,
       CASE WHEN l_partkey % 6 = 5 THEN 'S' || CAST(l_partkey AS STRING) || '-2'
            WHEN l_partkey % 13 = 0 THEN 'S' || CAST(l_partkey AS STRING) || '; S1'
            ELSE 'S' || CAST(l_partkey AS STRING) END AS Master_Protein_Accessions,
       CASE WHEN l_linenumber = 7 OR length(sequence) < 30 OR sequence IS NULL THEN 'PEPTIDEK'
            WHEN l_linenumber = 6 THEN '[R].' || lower(substr(sequence, 4, 3)) || '.[S]'
            ELSE '[K].' || lower(substr(sequence, 5 + CAST(l_linenumber AS INT), 1)) || substr(sequence, 6 + CAST(l_linenumber AS INT), 7) || '.[R]' END AS Annotated_Sequence,
       CASE WHEN l_partkey % 17 = 3 THEN NULL
            WHEN l_linenumber % 3 = 0 THEN 'N-Term(TMT6plex); C2(DBIA); C4(DBIA)'
            WHEN l_linenumber % 3 = 1 THEN 'C3(DBIA); K5(TMT6plex)'
            WHEN l_partkey % 5 = 0 THEN 'N-Term(DBIA); K5(TMT6plex)'
            WHEN l_partkey % 5 = 1 THEN 'C-Term(DBIA)'
            WHEN l_partkey % 5 = 2 THEN 'K5(TMT6plex); M1(Oxidation)'
            ELSE 'K2(DBIA); K5(TMT6plex)' END AS Modifications,
       CASE WHEN l_partkey % 4 = 0 THEN 'C2(DBIA): 98.2; C4(DBIA): 76.5; M1(Oxidation): 100'
            WHEN l_partkey % 4 = 1 THEN 'C3(DBIA): 50; C5(DBIA): 50.0'
            WHEN l_partkey % 4 = 2 THEN ' ' END AS ptmRS_Best_Site_Probabilities,
       CASE WHEN l_partkey % 8 = 3 THEN 'C3(DBIA): 75; C1(DBIA): 75.0; C6(DBIA): 99.9' END AS CHIMERYS_Best_Site_Probabilities,
       CASE WHEN l_partkey % 8 = 2 THEN '0.91' WHEN l_partkey % 8 = 6 THEN '42.5' WHEN l_partkey % 8 = 7 THEN 'none' END AS CHIMERYS_PTM_Localization_Score,
       CAST(l_partkey % 3 + 2 AS STRING) AS Charge,
       CASE l_suppkey % 4 WHEN 0 THEN '126' WHEN 1 THEN '127N' WHEN 2 THEN '127C' ELSE '128N' END AS Channel,
       CASE l_suppkey % 4 WHEN 0 THEN 'DMSO' WHEN 1 THEN 'DMSO' WHEN 2 THEN 'INCZ' ELSE 'Norm' END AS Condition,
       CASE l_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 2 END AS Replicate,
       CASE l_suppkey % 4 WHEN 3 THEN 'Reference/Bridge' ELSE 'Sample' END AS Role,
       CASE l_suppkey % 4 WHEN 0 THEN 'DMSO_1' WHEN 1 THEN 'DMSO_2' WHEN 2 THEN 'INCZ_1' ELSE 'Norm_2' END AS BioReplicate,
       l_quantity AS Abundance
FROM {lineitem} LEFT JOIN (SELECT accession, substr(sequence, 1, 40) AS sequence FROM {proteome}) AS heads
  ON 'S' || CAST(l_partkey AS STRING) = accession""",
)
