"""Queries of the reading, filtering, reshaping and design operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omicspark.functions import expressions as E
from omicspark.operators import artifacts, design, psm
from omicspark.plans import workflows
from omicspark.registry.base import Tables, query
from omicspark.session import fresh_path
from omicspark.sources import readers, writers

RAW_NAMES = {
    "Master_Protein_Accessions": "Master Protein Accessions",
    "Average_Reporter_SN": "Average Reporter SN",
    "Normalized_CHIMERYS_Coefficient": "Normalized CHIMERYS Coefficient",
    "Isolation_Interference_in_Percent": "Isolation Interference in Percent",
    "Quan_Info": "Quan Info",
    "Quan_Value": "Quan Value",
    "Abundance_126": "Abundance 126",
    "Abundance_127N": "Abundance 127N",
    "Abundance_127C": "Abundance 127C",
    "Abundance_128N": "Abundance 128N",
}
ROW = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"]
CHANNELS = ["126", "127N", "127C", "128N"]


def vendor(t: Tables) -> DataFrame:
    """The raw view under the vendor's column names."""
    return t.view("raw").withColumnsRenamed(RAW_NAMES)


def reporter(t: Tables) -> DataFrame:
    return vendor(t).drop("Quan Value", "Abundance")


# ------------------------------------------------------------ shared SQL pieces
# Null and unparsable numbers fail a bound; NaN and infinities count as missing.
def sql_number(c: str) -> str:
    return (
        f"(CASE WHEN isfinite(TRY_CAST({c} AS DOUBLE)) THEN TRY_CAST({c} AS DOUBLE) END)"
    )


FLAGS = """(Contaminant IS NULL OR upper(trim(Contaminant)) NOT IN ('TRUE', '+'))
  AND Master_Protein_Accessions IS NOT NULL AND trim(Master_Protein_Accessions) <> ''
  AND (Reverse IS NULL OR upper(trim(Reverse)) NOT IN ('TRUE', '+'))
  AND (Quan_Info IS NULL OR upper(trim(Quan_Info)) <> 'NO VALUE')"""
TMT_RULE = f"""{FLAGS} AND {sql_number('Average_Reporter_SN')} >= 5
  AND {sql_number('Normalized_CHIMERYS_Coefficient')} >= 0.8"""
UNPIVOTED = " UNION ALL ".join(
    f"SELECT *, '{c}' AS Channel, Abundance_{c} AS cell FROM kept WHERE Abundance_{c} IS NOT NULL"
    for c in CHANNELS
)
IDENTITY = "coalesce(Sequence, '') || '|' || coalesce(Modifications, '') || '|' || coalesce(Charge, '')"
ROW_SQL = ", ".join(ROW)


@query("tmt_quality_filter", "B4", f"SELECT {ROW_SQL}, Charge FROM raw WHERE {TMT_RULE}", ("raw",))
def _(t: Tables) -> DataFrame:
    return psm.filter_psm_tmt(reporter(t)).select(*ROW, "Charge")


@query(
    "dia_quality_filter",
    "B5 B3",
    f"""SELECT {ROW_SQL}, {sql_number('coalesce(Quan_Value, Abundance)')} AS Abundance FROM raw
WHERE {FLAGS} AND {sql_number('coalesce(Quan_Value, Abundance)')} >= 1""",
    ("raw",),
)
def _(t: Tables) -> DataFrame:
    return psm.with_abundance(psm.filter_psm_dia(vendor(t))).select(*ROW, "Abundance")


for _role, _rule in (
    ("ptm", f"{sql_number('Isolation_Interference_in_Percent')} <= 50"),
    ("protein", f"{sql_number('Normalized_CHIMERYS_Coefficient')} >= 0.8"),
):

    @query(
        f"{_role}_role_quality_filter",
        "B6",
        f"SELECT {ROW_SQL} FROM raw WHERE {FLAGS} AND {sql_number('Average_Reporter_SN')} >= 5 AND {_rule}",
        ("raw",),
    )
    def _(t: Tables, role: str = _role) -> DataFrame:
        return psm.filter_psm_ptm(reporter(t), role).select(*ROW)


@query(
    "legacy_quality_filter",
    "B7",
    f"""SELECT {ROW_SQL} FROM raw WHERE (Contaminant IS NULL OR lower(Contaminant) <> 'true')
AND {sql_number('Abundance')} >= 1 AND (Quan_Info IS NULL OR Quan_Info <> 'No Value')""",
    ("raw",),
)
def _(t: Tables) -> DataFrame:
    return psm.filter_low_quality_legacy(t.view("raw").drop("Quan_Value")).select(*ROW)


@query(
    "psm_identity",
    "B2",
    f"SELECT {ROW_SQL}, {IDENTITY} AS Unique_PSM FROM raw",
    ("raw",),
)
def _(t: Tables) -> DataFrame:
    return psm.with_unique_psm(vendor(t)).select(*ROW, "Unique_PSM")


@query(
    "channel_unpivot",
    "C1 B8",
    f"""WITH kept AS (SELECT * FROM raw), long AS ({UNPIVOTED})
SELECT {ROW_SQL}, Channel, {sql_number('cell')} AS Abundance FROM long WHERE {sql_number('cell')} >= 1""",
    ("raw",),
)
def _(t: Tables) -> DataFrame:
    long = psm.filter_channel_abundance(psm.unpivot_channels(reporter(t)))
    return long.select(*ROW, "Channel", "Abundance")


CHANNEL_DESIGN = {
    "126": {"drug": "DMSO", "time": "4h", "replicate": 1},
    "127N": {"drug": "DMSO", "time": "4h", "replicate": 2},
    "127C": {"drug": "INCZ", "time": "24h", "replicate": 1},
    "x.txt::128N": {"drug": "INCZ", "time": "24h", "replicate": 2},
    "other.txt::126": {"drug": "KCl", "time": "0h", "replicate": 9},
}
DESIGN_SQL = """(VALUES ('126', 'DMSO', '4h', 1), ('127N', 'DMSO', '4h', 2),
  ('127C', 'INCZ', '24h', 1), ('128N', 'INCZ', '24h', 2)) AS d(Channel, drug, dose, rep)"""


def channel_design(t: Tables) -> DataFrame:
    return design.tmt_design(t.spark, CHANNEL_DESIGN, "x.txt")


PREPARED_TMT = f"""kept AS (SELECT * FROM raw WHERE {TMT_RULE}), long AS ({UNPIVOTED}),
prepared AS (SELECT {ROW_SQL}, {IDENTITY} AS Unique_PSM, Master_Protein_Accessions,
  {sql_number('cell')} AS Abundance, drug || '_' || dose AS Condition, rep AS Replicate,
  drug || '_' || dose || '_' || CAST(rep AS VARCHAR) AS Sample_Origination
FROM long JOIN {DESIGN_SQL} USING (Channel) WHERE {sql_number('cell')} >= 1)"""
PREPARED_COLUMNS = [*ROW, "Unique_PSM", "Master_Protein_Accessions", "Abundance", "Condition", "Replicate",
                    "Sample_Origination"]


@query(
    "tmt_preparation",
    "P1 A10 D1 B1",
    f"WITH {PREPARED_TMT} SELECT * FROM prepared",
    ("raw",),
)
def _(t: Tables) -> DataFrame:
    return workflows.prepare_tmt_frame(reporter(t), channel_design(t)).select(*PREPARED_COLUMNS)


@query(
    "preprocessed_rows",
    "B16",
    f"WITH {PREPARED_TMT} SELECT Condition, Replicate, count(*) AS n FROM prepared GROUP BY ALL",
    ("raw",),
)
def _(t: Tables) -> DataFrame:
    rows = workflows.prepare_tmt_frame(reporter(t), channel_design(t))
    return psm.assert_preprocessed(rows).groupBy("Condition", "Replicate").agg(F.count(F.lit(1)).alias("n"))


@query(
    "source_row_numbers",
    "F2",
    "SELECT l_returnflag, count(*) AS row_count, count(*) AS distinct_numbers FROM lineitem GROUP BY l_returnflag",
)
def _(t: Tables) -> DataFrame:
    rows = psm.with_source_row(t.table("lineitem").select("l_returnflag"))
    return rows.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("_SourceRow").alias("distinct_numbers")
    )


FLAG_FILES = {
    "file_A.txt": {"drug": "A", "dose": "1", "replicate": 1, "batch": "b1"},
    "file_N.txt": {"drug": "N", "dose": "1", "replicate": 2, "batch": ""},
}


@query(
    "dia_preparation",
    "P2 A9 D1",
    f"""SELECT {ROW_SQL}, {IDENTITY} AS Unique_PSM, {sql_number('coalesce(Quan_Value, Abundance)')} AS Abundance,
  l_returnflag || '_1' AS Condition, CASE l_returnflag WHEN 'A' THEN 1 ELSE 2 END AS Replicate,
  CASE l_returnflag WHEN 'A' THEN 'b1' END AS batch
FROM raw WHERE l_returnflag IN ('A', 'N') AND {FLAGS} AND {sql_number('coalesce(Quan_Value, Abundance)')} >= 1""",
    ("raw",),
)
def _(t: Tables) -> DataFrame:
    raw = vendor(t).withColumn("filename", F.concat(F.lit("file_"), "l_returnflag", F.lit(".txt")))
    rows = workflows.prepare_dia_frame(raw, design.design_from_metadata(t.spark, FLAG_FILES))
    return rows.select(*ROW, "Unique_PSM", "Abundance", "Condition", "Replicate", "batch")


PTM_CHANNELS = {
    "126": {"condition": "DMSO", "replicate": 1},
    "127N": {"condition": "DMSO", "replicate": 2},
    "127C": {"condition": "INCZ", "replicate": 1},
    "128N": {"condition": "INCZ", "replicate": 2, "role": "Reference/Bridge"},
}
PTM_DESIGN_SQL = """(VALUES ('126', 'DMSO', 1, 'Sample', 'DMSO_1'), ('127N', 'DMSO', 2, 'Sample', 'DMSO_2'),
  ('127C', 'INCZ', 1, 'Sample', 'INCZ_1'), ('128N', 'Norm', 2, 'Reference/Bridge', 'Norm_2'))
  AS d(Channel, Condition, Replicate, Role, BioReplicate)"""


@query(
    "ptm_preparation",
    "P3 A11 B15 D1",
    f"""WITH kept AS (SELECT * FROM raw WHERE {FLAGS} AND {sql_number('Average_Reporter_SN')} >= 5
  AND {sql_number('Isolation_Interference_in_Percent')} <= 50), long AS ({UNPIVOTED})
SELECT {ROW_SQL}, Sequence AS Annotated_Sequence, {IDENTITY} AS Unique_PSM, Channel,
  {sql_number('cell')} AS Abundance, Condition, Replicate, Role, BioReplicate
FROM long JOIN {PTM_DESIGN_SQL} USING (Channel) WHERE {sql_number('cell')} >= 1""",
    ("raw",),
)
def _(t: Tables) -> DataFrame:
    rows = workflows.prepare_ptm_frame(reporter(t), design.ptm_design(t.spark, PTM_CHANNELS), "ptm")
    return rows.select(
        *ROW, "Annotated_Sequence", "Unique_PSM", "Channel", "Abundance", "Condition", "Replicate", "Role",
        "BioReplicate",
    )


@query(
    "filter_stage_counts",
    "B9",
    f"""WITH kept AS (SELECT * FROM raw WHERE {TMT_RULE}), long AS ({UNPIVOTED})
SELECT 'tmt' AS Section, 'input_psms' AS Metric, count(*) AS Value FROM raw
UNION ALL SELECT 'tmt', 'quality_filtered_psms', count(*) FROM kept
UNION ALL SELECT 'tmt', 'long_reporter_rows', count(*) FROM long WHERE {sql_number('cell')} >= 1""",
    ("raw",),
)
def _(t: Tables) -> DataFrame:
    raw = reporter(t)
    kept = psm.filter_psm_tmt(raw)
    long = psm.filter_channel_abundance(psm.unpivot_channels(kept))
    return psm.filter_counts(
        {"input_psms": raw, "quality_filtered_psms": kept, "long_reporter_rows": long}, "tmt"
    )


@query(
    "target_background_split",
    "B10",
    """SELECT CASE WHEN contains(coalesce(Modifications, ''), '(DBIA)') THEN 'target' ELSE 'background' END AS side,
  l_suppkey, count(*) AS n FROM raw GROUP BY ALL""",
    ("raw",),
)
def _(t: Tables) -> DataFrame:
    target, rest = psm.split_target_background(t.view("raw"), "DBIA")
    both = target.withColumn("side", F.lit("target")).unionByName(rest.withColumn("side", F.lit("background")))
    return both.groupBy("side", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "non_numeric_cells",
    "A12",
    """SELECT count(*) FILTER (WHERE Abundance_126 IS NOT NULL AND TRY_CAST(Abundance_126 AS DOUBLE) IS NULL) AS Abundance_126,
  count(*) FILTER (WHERE Quan_Value IS NOT NULL AND TRY_CAST(Quan_Value AS DOUBLE) IS NULL) AS Quan_Value,
  count(*) FILTER (WHERE Average_Reporter_SN IS NOT NULL AND TRY_CAST(Average_Reporter_SN AS DOUBLE) IS NULL) AS Average_Reporter_SN
FROM raw""",
    ("raw",),
)
def _(t: Tables) -> DataFrame:
    return psm.non_numeric_counts(t.view("raw"), ["Abundance_126", "Quan_Value", "Average_Reporter_SN"])


@query(
    "modification_inventory",
    "A15",
    r"""WITH numbered AS (SELECT row_number() OVER () AS id, Modifications FROM raw),
tokens AS (SELECT id, unnest(string_split(Modifications, ';')) AS t FROM numbered WHERE Modifications IS NOT NULL),
parts AS (SELECT id, string_split(replace(t, ')', '('), '(') AS p, strpos(t, ')') > strpos(t, '(') AS ordered FROM tokens),
parsed AS (SELECT id, trim(p[2]) AS name, trim(p[1]) AS site FROM parts WHERE len(p) = 3 AND ordered AND p[1] <> '' AND p[2] <> '' AND trim(p[3]) = '')
SELECT name, count(DISTINCT id) AS row_count, count(*) AS occurrence_count,
  string_agg(DISTINCT site, ',' ORDER BY site) AS sites FROM parsed GROUP BY name""",
    ("raw",),
)
def _(t: Tables) -> DataFrame:
    found = psm.modification_inventory(t.view("raw"))
    return found.withColumn("sites", F.array_join("sites", ","))


@query(
    "accession_explode",
    "C4",
    """SELECT DISTINCT Unique_PSM, trim(u.protein) AS protein, u.protein_order AS protein_order FROM psm,
  unnest(string_split(Master_Protein_Accessions, ';')) WITH ORDINALITY AS u(protein, protein_order)
WHERE trim(u.protein) <> ''""",
    ("psm",),
)
def _(t: Tables) -> DataFrame:
    return psm.explode_accessions(t.view("psm")).distinct()


@query(
    "gene_explode",
    "C5",
    """SELECT DISTINCT protein_accession, unnest(string_split(upper(replace(coalesce(gene_name, ''), ' ', '')), ';')) AS gene_token
FROM plong""",
    ("plong",),
)
def _(t: Tables) -> DataFrame:
    return psm.explode_genes(t.view("plong"))


@query(
    "wide_abundance_to_long",
    "C2",
    """WITH wide AS (SELECT l_partkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS a,
  sum(CASE WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN l_quantity END) AS n FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, 'a' AS sample_id, a AS processed_log2_abundance,
  CASE WHEN a IS NULL THEN 'missing' ELSE 'model_estimated' END AS provenance FROM wide
UNION ALL SELECT l_partkey, 'n', n, CASE WHEN n IS NULL THEN 'missing' ELSE 'model_estimated' END FROM wide""",
)
def _(t: Tables) -> DataFrame:
    wide = t.table("lineitem").groupBy("l_partkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))).alias("a"),
        F.sum(F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 1), F.col("l_quantity"))).alias("n"),
    )
    return artifacts.abundance_to_long(wide, ["l_partkey"])


@query(
    "sample_matrix_export",
    "C3",
    """SELECT Unique_PSM,
  nullif(sum(CASE WHEN Condition = 'A' THEN Abundance END), 0) AS A,
  nullif(sum(CASE WHEN Condition = 'N' THEN Abundance END), 0) AS N,
  nullif(sum(CASE WHEN Condition = 'R' THEN Abundance END), 0) AS R
FROM (SELECT Unique_PSM, Condition, round(Abundance, 0) AS Abundance FROM psm) GROUP BY Unique_PSM
HAVING coalesce(nullif(sum(CASE WHEN Condition = 'A' THEN Abundance END), 0), nullif(sum(CASE WHEN Condition = 'N' THEN Abundance END), 0),
  nullif(sum(CASE WHEN Condition = 'R' THEN Abundance END), 0)) IS NOT NULL""",
    ("psm",),
)
def _(t: Tables) -> DataFrame:
    rows = t.view("psm").withColumn("Abundance", F.round("Abundance", 0))
    return artifacts.to_wide(rows, ["Unique_PSM"], "Condition", "Abundance", ["A", "N", "R"])


# ------------------------------------------------------------------- designs


@query(
    "design_conditions",
    "A9",
    """SELECT drug, dose, drug || '_' || dose AS Condition, replicate AS Replicate,
  drug || '_' || dose || '_' || CAST(replicate AS VARCHAR) AS Sample_Origination, filename FROM design""",
    ("design",),
)
def _(t: Tables) -> DataFrame:
    return design.with_condition(t.view("design"), ["drug", "dose"])


@query(
    "design_expected_replicates",
    "E4",
    "SELECT drug || '_' || dose AS Condition, count(DISTINCT replicate) AS total_reps FROM design GROUP BY 1",
    ("design",),
)
def _(t: Tables) -> DataFrame:
    return design.expected_replicates(design.with_condition(t.view("design"), ["drug", "dose"]))


@query(
    "design_sample_counts",
    "E27",
    "SELECT count(*) AS sample_count FROM design WHERE drug = '1-URGENT' AND dose = 'F'",
    ("design",),
)
def _(t: Tables) -> DataFrame:
    return design.sample_counts(t.view("design"), {"drug": "1-URGENT", "dose": "F"})


@query(
    "design_warnings",
    "E28",
    """WITH c AS (SELECT o_orderpriority AS Condition, CAST(o_custkey % 3 AS INT) AS Replicate, o_orderstatus FROM orders
  GROUP BY ALL HAVING count(*) % 3 <> 0),
per AS (SELECT Condition, count(*) AS n FROM c GROUP BY Condition)
SELECT 'INSUFFICIENT_CONDITIONS' AS code, '' AS subject, count(*) AS amount FROM per HAVING count(*) < 2
UNION ALL SELECT 'FEW_REPLICATES', Condition, n FROM per WHERE n < 3 AND (SELECT count(*) FROM per) >= 2
UNION ALL SELECT 'DUPLICATE_REPLICATES', Condition, count(*) FROM
  (SELECT Condition, Replicate FROM c WHERE Replicate > 0 GROUP BY ALL HAVING count(*) > 1) GROUP BY Condition""",
)
def _(t: Tables) -> DataFrame:
    rows = t.table("orders").groupBy(
        F.col("o_orderpriority").alias("Condition"), (F.col("o_custkey") % 3).cast("int").alias("Replicate"), "o_orderstatus"
    ).agg(F.count(F.lit(1)).alias("n")).where("n % 3 <> 0")
    return design.design_warnings(rows)


@query(
    "design_conflicts",
    "A10",
    """SELECT o_orderpriority AS channel, count(DISTINCT o_orderstatus || '/' || CAST(o_custkey % 2 AS VARCHAR)) AS versions
FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus || '/' || CAST(o_custkey % 2 AS VARCHAR)) > 1""",
)
def _(t: Tables) -> DataFrame:
    entries = t.table("orders").select(
        F.col("o_orderpriority").alias("channel"), "o_orderstatus", (F.col("o_custkey") % 2).alias("odd")
    )
    return design.conflicting_channels(entries, "channel", ["o_orderstatus", "odd"])


@query(
    "sample_conditions",
    "I9",
    r"""WITH m AS (SELECT n.sample_id, d.label, d.prefix,
  row_number() OVER (PARTITION BY n.sample_id ORDER BY length(d.prefix) DESC) AS rn
  FROM names n JOIN definitions d ON n.sample_id = d.prefix OR starts_with(n.sample_id, d.prefix || '_'))
SELECT n.sample_id,
  CASE WHEN m.label IS NOT NULL THEN m.label
       WHEN regexp_matches(n.sample_id, '^(.*)_(\d+)$') THEN regexp_extract(n.sample_id, '^(.*)_(\d+)$', 1)
       ELSE n.sample_id END AS condition,
  CASE WHEN m.label IS NOT NULL THEN nullif(regexp_replace(substr(n.sample_id, length(m.prefix) + 1), '^_+', ''), '')
       WHEN regexp_matches(n.sample_id, '^(.*)_(\d+)$') THEN regexp_extract(n.sample_id, '^(.*)_(\d+)$', 2) END AS replicate
FROM names n LEFT JOIN m ON m.sample_id = n.sample_id AND m.rn = 1""",
    ("names", "definitions"),
)
def _(t: Tables) -> DataFrame:
    return design.sample_condition(t.view("names"), t.view("definitions"))


@query(
    "inferred_conditions",
    "I10",
    r"""SELECT sample_id, CASE
  WHEN contains(upper(sample_id), 'DMSO') THEN 'DMSO'
  WHEN contains(upper(sample_id), 'INCZ') THEN coalesce(list_filter(parts, lambda p: contains(upper(p), 'INCZ'))[1], 'INCZ')
  WHEN contains(upper(sample_id), 'CONTROL') THEN 'Control'
  WHEN contains(upper(sample_id), 'TREATMENT') THEN 'Treatment'
  WHEN len(parts) = 1 THEN sample_id
  WHEN parts[-1] <> '' AND translate(parts[-1], '0123456789', '') = '' THEN array_to_string(parts[1:len(parts) - 1], '_')
  ELSE parts[1] END AS condition FROM (SELECT sample_id, string_split(sample_id, '_') AS parts FROM names)""",
    ("names",),
)
def _(t: Tables) -> DataFrame:
    return t.view("names").select("sample_id", E.infer_condition(F.col("sample_id")).alias("condition"))


@query(
    "sample_token_match",
    "I11",
    """SELECT sample_id, list_contains(string_split(sample_id, '_'), 'F') AS has_f,
  contains('_' || sample_id || '_', '_1-URGENT_F_') AS has_both FROM names""",
    ("names",),
)
def _(t: Tables) -> DataFrame:
    name = F.col("sample_id")
    return t.view("names").select(
        "sample_id", E.token_match("F", name).alias("has_f"), E.token_match("1-URGENT_F", name).alias("has_both")
    )


BATCHED = """d AS (SELECT drug || '_' || dose || '_' || CAST(replicate AS VARCHAR) AS sid, 'B' || CAST(replicate % 2 AS VARCHAR) AS batch,
  CASE WHEN drug = '5-LOW' THEN NULL ELSE drug END AS experiment FROM design)"""


@query(
    "batch_assignment",
    "J14",
    f"""WITH {BATCHED}, exact AS (SELECT sid, min(batch) AS b FROM d GROUP BY sid),
inside AS (SELECT n.sample_id, arg_min(d.batch, d.experiment) AS b FROM names n JOIN
  (SELECT experiment, min(batch) AS batch FROM d WHERE experiment <> '' GROUP BY experiment) d
  ON contains(n.sample_id, d.experiment) GROUP BY n.sample_id)
SELECT n.sample_id, coalesce(e.b, i.b) AS batch FROM names n LEFT JOIN exact e ON e.sid = n.sample_id
LEFT JOIN inside i ON i.sample_id = n.sample_id""",
    ("design", "names"),
)
def _(t: Tables) -> DataFrame:
    frame = design.with_condition(t.view("design"), ["drug", "dose"])
    frame = frame.withColumn("batch", F.concat(F.lit("B"), (F.col("Replicate") % 2).cast("string")))
    frame = frame.withColumn("experiment", F.when(F.col("drug") != "5-LOW", F.col("drug")))
    return design.assign_batch(t.view("names"), frame, check=False).select("sample_id", "batch")


@query(
    "batch_confounding",
    "J15",
    """SELECT count(*) AS conditions, count(*) FILTER (WHERE b > 1) = 0 AS confounded FROM
(SELECT condition, count(DISTINCT batch) AS b FROM levels GROUP BY condition)""",
    ("levels",),
)
def _(t: Tables) -> DataFrame:
    return design.batch_confounded(t.view("levels"))


@query(
    "comparison_names",
    "I8",
    """SELECT DISTINCT drug || '+' || dose || '_vs_1-URGENT+' || dose AS comparison_id,
  drug || '+' || dose || ' vs 1-URGENT+' || dose AS display_label,
  drug || '+' || dose AS group1_label, '1-URGENT+' || dose AS group2_label FROM design""",
    ("design",),
)
def _(t: Tables) -> DataFrame:
    rows = t.view("design").select("drug", "dose", F.lit("1-URGENT").alias("ref")).distinct()
    named = design.comparison_labels(rows, ["drug", "dose"], ["ref", "dose"])
    return named.select("comparison_id", "display_label", "group1_label", "group2_label")


@query(
    "reference_comparisons",
    "H5",
    """SELECT DISTINCT dose || '+' || drug || '_vs_F+1-URGENT' AS comparison_id, dose || '+' || drug AS group1_label,
  'F+1-URGENT' AS group2_label FROM design WHERE NOT (drug = '1-URGENT' AND dose = 'F')""",
    ("design",),
)
def _(t: Tables) -> DataFrame:
    return design.reference_comparisons(t.view("design"), ["drug", "dose"], {"drug": "1-URGENT", "dose": "F"})


@query(
    "catalog_contrasts",
    "J19",
    """WITH s AS (SELECT comparison_id, group1_label AS condition, 1.0::DOUBLE AS weight FROM catalog
  UNION ALL SELECT comparison_id, group2_label, -1.0::DOUBLE FROM catalog),
k AS (SELECT s.* FROM s WHERE condition IN (SELECT DISTINCT condition FROM levels))
SELECT * FROM k WHERE comparison_id IN (SELECT comparison_id FROM k GROUP BY 1 HAVING count(DISTINCT weight) = 2)""",
    ("catalog", "levels"),
)
def _(t: Tables) -> DataFrame:
    return design.contrasts_from_catalog(t.view("catalog"), t.view("levels")).select(
        "comparison_id", "condition", "weight"
    )


# ----------------------------------------------------- files written, then read


def _text_lines(df: DataFrame, name: str) -> str:
    path = fresh_path(df.sparkSession, name)
    df.write.text(path)
    return path


@query("psm_file_scan", "A1 A2", f"SELECT {ROW_SQL}, Charge, Modifications FROM raw", ("raw",))
def _(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "psm")
    raw = reporter(t)
    raw.select(*[F.col(f"`{c}`").cast("string") for c in raw.columns]).write.csv(path, sep="\t", header=True)
    df = readers.read_psm(t.spark, path, with_filename=True)
    typed = [F.col(c).cast("bigint").alias(c) for c in ROW[:3]]
    return df.where(F.col("filename").isNotNull()).select(
        *typed, F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_returnflag", "Charge", "Modifications"
    )


@query("psm_files_in_any_column_order", "A1 A2", f"SELECT {ROW_SQL}, Charge, Modifications FROM raw", ("raw",))
def _(t: Tables) -> DataFrame:
    """Two exports, the second with its columns the other way round and with commas."""
    raw = reporter(t)
    text = raw.select(*[F.col(f"`{c}`").cast("string") for c in raw.columns])
    paths = []
    for order, sep, part in ((raw.columns, "\t", F.col("l_linenumber") % 2 == 0), (raw.columns[::-1], ",", F.col("l_linenumber") % 2 == 1)):
        paths.append(fresh_path(t.spark, "psm"))
        text.where(part).select(*[F.col(f"`{c}`") for c in order]).write.csv(paths[-1], sep=sep, header=True)
    df = readers.read_psm(t.spark, paths)
    typed = [F.col(c).cast("bigint").alias(c) for c in ROW[:3]]
    return df.select(*typed, F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_returnflag", "Charge", "Modifications")


@query(
    "channel_mismatches",
    "A14",
    """WITH f AS (SELECT DISTINCT CAST(l_linenumber AS VARCHAR) AS c FROM lineitem), d AS (SELECT DISTINCT CAST(o_orderkey % 9 AS VARCHAR) AS c FROM orders)
SELECT c AS "Channel", 'file' AS only_in FROM (SELECT c FROM f EXCEPT SELECT c FROM d)
UNION ALL SELECT c, 'design' FROM (SELECT c FROM d EXCEPT SELECT c FROM f)""",
)
def _(t: Tables) -> DataFrame:
    channels = t.table("lineitem").select(F.col("l_linenumber").cast("string").alias("Channel"))
    return design.channel_mismatches(channels, t.table("orders").select((F.col("o_orderkey") % 9).cast("string").alias("Channel")))


def order_groups(t: Tables) -> dict[str, dict[str, str]]:
    """Conditions of the orders' priorities and states, as a site study names them."""
    rows = t.table("orders").select("o_orderstatus", "o_orderpriority").distinct().collect()
    mapping = {str(i): {"time": r[0], "drug": r[1], "replicate": 1} for i, r in enumerate(sorted(rows))}
    return design.condition_groups(mapping, "ptm")


# Group columns in another order than the conditions' own, a pooled group, and a group that nothing has.
ORDER_COMPARISONS = [
    {"group1": {"time": "F", "drug": "1-URGENT"}, "group2": {"drug": "5-LOW", "time": "F"}},
    {"group1": {"drug": "1-URGENT"}, "group2": {"drug": "5-LOW"}},
    {"group1": {"time": "F"}, "group2": {"time": "never"}},
]


@query(
    "contrasts_by_criteria",
    "J19 P17",
    """WITH c AS (SELECT DISTINCT o_orderpriority AS drug, o_orderstatus AS time, o_orderpriority || '_' || o_orderstatus AS condition FROM orders),
side AS (SELECT 'F+1-URGENT_vs_5-LOW+F' AS id, condition, 1 AS sign FROM c WHERE drug = '1-URGENT' AND time = 'F'
  UNION ALL SELECT 'F+1-URGENT_vs_5-LOW+F', condition, -1 FROM c WHERE drug = '5-LOW' AND time = 'F'
  UNION ALL SELECT '1-URGENT_vs_5-LOW', condition, 1 FROM c WHERE drug = '1-URGENT'
  UNION ALL SELECT '1-URGENT_vs_5-LOW', condition, -1 FROM c WHERE drug = '5-LOW')
SELECT id AS comparison_id, condition, sign / count(*) OVER (PARTITION BY id, sign) AS weight FROM side""",
)
def _(t: Tables) -> DataFrame:
    return design.configured_contrasts(t.spark, ORDER_COMPARISONS, order_groups(t))[1]


@query(
    "unmatched_comparisons",
    "J19 P17",
    """SELECT 'F_vs_never' AS comparison_id, 'group2' AS side, 'never' AS label FROM orders WHERE o_orderstatus <> 'never' LIMIT 1""",
)
def _(t: Tables) -> DataFrame:
    return design.configured_contrasts(t.spark, ORDER_COMPARISONS, order_groups(t))[2]


@query(
    "result_shard_union",
    "A3 A4",
    """SELECT Protein, Label, CASE WHEN isfinite(TRY_CAST(log2FC AS DOUBLE)) OR log2FC = 'Infinity' THEN TRY_CAST(log2FC AS DOUBLE) END AS log2FC,
  CASE WHEN result_layer = 'protein' THEN TRY_CAST(pvalue AS DOUBLE) END AS pvalue, result_layer FROM raw_results""",
    ("raw_results",),
)
def _(t: Tables) -> DataFrame:
    rows = t.view("raw_results").select("Protein", "Label", "log2FC", "pvalue", "result_layer")
    paths = []
    for layer in ("protein", "ptm"):
        path = fresh_path(t.spark, "shard")
        part = rows.where(F.col("result_layer") == layer)
        part = part if layer == "protein" else part.drop("pvalue")
        part.write.csv(path, sep="\t", header=True, nullValue="NA")
        paths.append(path)
    both = readers.union_result_shards(t.spark, paths)
    return both.select("Protein", "Label", "log2FC", "pvalue", "result_layer")


@query(
    "artifact_round_trip",
    "A5 A16",
    "SELECT comparison_id, protein_accession, log2_fold_change, result_layer FROM diff",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    folder = fresh_path(t.spark, "artifacts")
    rows = t.view("diff").select("comparison_id", "protein_accession", "log2_fold_change", "result_layer")
    writers.write_artifact(rows, folder, "differential", ["comparison_id", "protein_accession"], ["result_layer"])
    return readers.read_artifact(t.spark, folder, "differential")


@query(
    "comparison_export",
    "A17",
    """SELECT protein_accession AS Master_Protein_Accessions, gene_name AS Gene_Name, log2_fold_change AS logFC,
  p_value AS pval, adjusted_p_value AS adjPval, standard_error AS se, statistic AS t FROM diff
WHERE comparison_id = 'D1_vs_DMSO' AND result_layer = 'protein'""",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    return writers.comparison_export(t.view("diff"), "D1_vs_DMSO")


@query(
    "fasta_scan",
    "A6",
    """SELECT accession, gene, sequence FROM proteome""",
    ("proteome",),
)
def _(t: Tables) -> DataFrame:
    rows = t.view("proteome").where(F.col("sequence") != "")
    plain = F.col("accession").substr(F.lit(2), F.lit(20)).cast("bigint") % 3 == 0
    tag = F.when(F.col("gene") != "", F.concat(F.lit(" GN="), "gene")).otherwise("")
    head = F.when(plain, F.concat(F.lit(">"), "accession", F.lit(" some text"), tag)).otherwise(
        F.concat(F.lit(">sp|"), "accession", F.lit("|NAME"), tag)
    )
    middle = F.floor(F.length("sequence") / 2).cast("int")
    line = F.concat(
        head, F.lit("\n"), F.substring("sequence", F.lit(1), middle), F.lit("\n"),
        F.substring("sequence", middle + 1, F.length("sequence")),
    )
    path = _text_lines(rows.select(line.alias("value")), "fasta")
    return readers.read_fasta(t.spark, path, t.view("proteome").select("accession"))


@query("fasta_headers_with_signs", "A6", "SELECT accession, gene, sequence FROM proteome", ("proteome",))
def _(t: Tables) -> DataFrame:
    """Headers hold the sign that begins a record."""
    rows = t.view("proteome").where(F.col("sequence") != "")
    tag = F.when(F.col("gene") != "", F.concat(F.lit(" GN="), "gene")).otherwise("")
    line = F.concat(F.lit(">sp|"), "accession", F.lit("|X 3'->5' kind >"), tag, F.lit("\n"), "sequence")
    path = _text_lines(rows.select(line.alias("value")), "fasta")
    return readers.read_fasta(t.spark, path)


@query(
    "gene_map_scan",
    "A7",
    """SELECT 'P' || CAST(p_partkey AS VARCHAR) AS accession, 'G' || CAST(p_partkey % 700 AS VARCHAR) AS gene FROM part
WHERE p_partkey % 9 <> 0""",
)
def _(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "genes")
    name = F.concat(F.lit("G"), (F.col("p_partkey") % 700).cast("string"), F.lit(" alias;x"))
    rows = t.table("part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("Entry"),
        F.when(F.col("p_partkey") % 9 == 0, F.lit(" ")).otherwise(name).alias("Gene Names"),
    )
    rows.write.csv(path, sep="\t", header=True, ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False)
    return readers.read_gene_map(t.spark, path)


@query("gene_set_scan", "A8", "SELECT set_name, gene FROM gene_sets", ("gene_sets",))
def _(t: Tables) -> DataFrame:
    rows = t.view("gene_sets").groupBy("set_name").agg(F.collect_list("gene").alias("g"))
    line = F.concat(F.col("set_name"), F.lit("\tsome words\t"), F.array_join("g", "\t"))
    path = _text_lines(rows.select(line.alias("value")).unionByName(
        t.view("gene_sets").limit(1).select(F.lit("short\tline").alias("value"))
    ), "sets")
    return readers.read_gmt(t.spark, path).withColumnRenamed("set", "set_name")


