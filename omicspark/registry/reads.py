"""Queries of the bounded reads, comparison matrices, overlaps and figures' data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omicspark.functions import expressions as E
from omicspark.operators.correlation_store import CorrelationStore, write_store
from omicspark.operators import compare, pca, ptm, qc, query as reads
from omicspark.registry import fits
from omicspark.registry.base import Tables, query
from omicspark.registry.quality import Q, quart, rounded

FIRST = "D1_vs_DMSO"
MATCH = "({c} = '{v}' OR list_contains(string_split(replace({c}, ' ', ''), ';'), '{v}'))"


@query(
    "accession_match",
    "B12",
    f"SELECT comparison_id, result_layer, protein_accession FROM diff WHERE {MATCH.format(c='protein_accession', v='Q34')} OR {MATCH.format(c='protein_accession', v='P1')}",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    c = F.col("protein_accession")
    hit = E.accession_matches(c, "Q34") | E.accession_matches(c, "P1")
    return t.view("diff").where(hit).select("comparison_id", "result_layer", "protein_accession")


@query(
    "text_search",
    "B13",
    "SELECT comparison_id, result_layer, protein_accession, gene_name FROM diff WHERE contains(lower(coalesce(protein_accession, '')), 'p19') OR contains(lower(coalesce(gene_name, '')), 'h4')",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    hit = E.contains_text([F.col("protein_accession"), F.col("gene_name")], "P19") | E.contains_text([F.col("gene_name")], "h4")
    return t.view("diff").where(hit).select("comparison_id", "result_layer", "protein_accession", "gene_name")


LOADED = """loaded AS (SELECT * EXCLUDE (adjusted_p_value), coalesce(adjusted_p_value, 1.0) AS adjusted_p_value FROM diff
  WHERE result_layer = 'protein' AND isfinite(log2_fold_change) AND isfinite(p_value))"""


@query(
    "loaded_differential",
    "B14",
    f"WITH {LOADED} SELECT protein_accession, gene_name, log2_fold_change, p_value, adjusted_p_value FROM loaded WHERE comparison_id = '{FIRST}'",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    return reads.load_differential(t.view("diff"), FIRST).select(
        "protein_accession", "gene_name", "log2_fold_change", "p_value", "adjusted_p_value"
    )


PAGE = """SELECT coalesce(protein_accession, '') AS master_protein_accessions, coalesce(gene_name, '') AS gene_name, coalesce(log2_fold_change, 0) AS log_fc,
  coalesce(p_value, 1) AS pval, coalesce(adjusted_p_value, 1) AS adj_pval, standard_error AS se, statistic AS t_statistic,
  coalesce(adjusted_p_value < 0.05, false) AS significant, coalesce(psm_count, 0) AS psm_count FROM diff"""


@query(
    "result_page",
    "G1",
    f"{PAGE} WHERE comparison_id = '{FIRST}' AND result_layer = 'protein' ORDER BY adjusted_p_value ASC NULLS LAST, protein_accession LIMIT 50 OFFSET 100",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    return reads.list_results(t.view("diff"), "", page=3, size=50)[0]


@query(
    "result_page_after",
    "G1",
    f"{PAGE} WHERE comparison_id = '{FIRST}' AND result_layer = 'protein' ORDER BY psm_count DESC NULLS LAST, protein_accession LIMIT 40 OFFSET 40",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    """The page behind the last row of the first one, by its cursor."""
    rows, order = t.view("diff"), {"sort_by": "psm_count", "order": "desc"}
    seen = reads.list_results(rows, FIRST, size=40, **order)[0].select("master_protein_accessions").collect()
    after = reads.result_cursor(rows, FIRST, seen[-1][0], "psm_count") if seen else reads.Cursor(None, None)
    return reads.list_results(rows, FIRST, size=40, after=after, **order)[0]


@query(
    "result_page_filtered",
    "G1 B13",
    f"""{PAGE} WHERE comparison_id = 'D2_vs_DMSO' AND result_layer = 'protein' AND adjusted_p_value < 0.05
AND (contains(lower(coalesce(protein_accession, '')), '1') OR contains(lower(coalesce(gene_name, '')), '1'))
ORDER BY log2_fold_change DESC NULLS LAST, protein_accession LIMIT 25""",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    return reads.list_results(
        t.view("diff"), "D2_vs_DMSO", size=25, sort_by="log_fc", order="desc", significant_only=True, search="1"
    )[0]


@query(
    "result_page_summary",
    "G1 E21",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE adjusted_p_value < 0.05) AS significant,
  count(*) FILTER (WHERE adjusted_p_value < 0.05 AND log2_fold_change > 0) AS upregulated,
  count(*) FILTER (WHERE adjusted_p_value < 0.05 AND log2_fold_change < 0) AS downregulated
FROM diff WHERE comparison_id = '{FIRST}' AND result_layer = 'protein'""",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    return reads.list_results(t.view("diff"), FIRST)[1]


@query(
    "keyset_page",
    "G2",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 100",
)
def _(t: Tables) -> DataFrame:
    return reads.page_after(t.table("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000, 100)


@query(
    "sample_search",
    "G2 B13",
    """SELECT DISTINCT sample_id, condition, replicate, batch, sample_order FROM plong
WHERE contains(lower(sample_id), 'n_') OR contains(lower(condition), 'n_') OR contains(lower(coalesce(batch, '')), 'n_')""",
    ("plong",),
)
def _(t: Tables) -> DataFrame:
    catalog = t.view("plong").select("sample_id", "condition", "replicate", "batch", "sample_order").distinct()
    return reads.list_samples(catalog, "N_")


@query(
    "first_comparison",
    "G11",
    "SELECT arg_min(comparison_id, comparison_order) AS comparison_id FROM catalog",
    ("catalog",),
)
def _(t: Tables) -> DataFrame:
    return reads.first_comparison(t.view("catalog"))


ONE = f"{MATCH.format(c='protein_accession', v='S7')} AND result_layer = 'protein' AND condition IN ('R', 'A') AND {Q} IS NOT NULL"


@query(
    "abundance_summary",
    "E26",
    f"""WITH b AS (SELECT condition, count(*) AS observation_count, count(*) FILTER (WHERE provenance = 'observed') AS observed_count,
  count(*) FILTER (WHERE provenance = 'imputed') AS imputed_count, count(*) FILTER (WHERE provenance = 'model_estimated') AS model_estimated_count,
  quantile_cont({Q}, 0.25) AS a, quantile_cont({Q}, 0.5) AS m, quantile_cont({Q}, 0.75) AS c FROM peptides WHERE {ONE} GROUP BY condition)
SELECT condition, observation_count, observed_count, imputed_count, model_estimated_count, round(a, 6) AS q1, round(m, 6) AS median, round(c, 6) AS q3,
  round(a - 1.5 * (c - a), 6) AS lower_fence, round(c + 1.5 * (c - a), 6) AS upper_fence,
  round(imputed_count / observation_count, 9) AS imputation_fraction, CASE condition WHEN 'R' THEN 0 ELSE 1 END AS group_order FROM b""",
    ("peptides",),
)
def _(t: Tables) -> DataFrame:
    out = reads.abundance_summary(t.view("peptides"), "S7", ["R", "A"])
    out = rounded(out, ["q1", "median", "q3", "lower_fence", "upper_fence"])
    return rounded(out, ["imputation_fraction"], 9)


@query(
    "abundance_points",
    "G9",
    f"SELECT sample_id, condition, replicate, batch, peptide_id, {Q}, provenance FROM peptides WHERE {ONE}",
    ("peptides",),
)
def _(t: Tables) -> DataFrame:
    return reads.abundance_rows(t.view("peptides"), "S7", ["R", "A"]).select(
        "sample_id", "condition", "replicate", "batch", "peptide_id", Q, "provenance"
    )


HEAT_GENES = ["G1", "h3", "g20", "G55", "nothing", "H0"]
HEAT = f"""wanted AS (SELECT gene, gene_order FROM (VALUES {', '.join(f"('{g}', {i})" for i, g in enumerate(HEAT_GENES))}) AS v(gene, gene_order)),
named AS (SELECT protein_accession, list_transform(string_split(gene_name, ';'), lambda g: upper(replace(g, ' ', ''))) AS names
  FROM plong WHERE gene_name IS NOT NULL),
mapping AS (SELECT gene, gene_order, min(protein_accession) AS protein_accession
  FROM wanted JOIN named ON list_contains(names, upper(gene)) GROUP BY gene, gene_order)"""


def heat_genes(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(g, i) for i, g in enumerate(HEAT_GENES)], "gene string, gene_order int")


@query("gene_accessions", "D14", f"WITH {HEAT} SELECT * FROM mapping", ("plong",))
def _(t: Tables) -> DataFrame:
    return reads.gene_accessions(t.view("plong"), heat_genes(t))


@query(
    "gene_heatmap",
    "N6 N7 F10 D14",
    f"""WITH {HEAT}, v AS (SELECT gene, gene_order, protein_accession, sample_id, condition, replicate, max({Q}) AS x FROM plong JOIN mapping USING (protein_accession)
  WHERE condition IN ('A', 'R') GROUP BY ALL)
SELECT gene, gene_order, protein_accession, sample_id, condition, replicate, x AS log2_abundance,
  round(CASE WHEN x IS NULL THEN NULL WHEN stddev_pop(x) OVER (PARTITION BY gene) > 0 THEN (x - avg(x) OVER (PARTITION BY gene)) / stddev_pop(x) OVER (PARTITION BY gene) ELSE 0 END, 6) AS z_score FROM v""",
    ("plong",),
)
def _(t: Tables) -> DataFrame:
    return rounded(reads.gene_heatmap(t.view("plong"), heat_genes(t), ["A", "R"]), ["z_score"])


@query(
    "protein_pvalues",
    "N10",
    f"""WITH {LOADED} SELECT comparison_id, arg_min(p_value, protein_accession) AS pval, arg_min(adjusted_p_value, protein_accession) AS adj_pval
FROM loaded WHERE {MATCH.format(c='protein_accession', v='P34')} AND comparison_id <> 'D5_vs_DMSO' GROUP BY comparison_id""",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    chosen = [f"D{i}_vs_DMSO" for i in (1, 2, 3, 4, 6, 7)]
    return reads.protein_pvalues(t.view("diff"), "P34", chosen)


GROUPS = f"""SELECT 'batch' AS group_by, batch AS group_value, count({Q}) AS observation_count FROM plong WHERE batch IS NOT NULL GROUP BY batch
UNION ALL SELECT 'condition', condition, count({Q}) FROM plong GROUP BY condition"""


def group_rows(t: Tables) -> DataFrame:
    long = t.view("plong")
    batch = long.where("batch is not null").groupBy(F.lit("batch").alias("group_by"), F.col("batch").alias("group_value"))
    condition = long.groupBy(F.lit("condition").alias("group_by"), F.col("condition").alias("group_value"))
    return batch.agg(F.count(Q).alias("observation_count")).unionByName(condition.agg(F.count(Q).alias("observation_count")))


@query("qc_overview", "P15", f"WITH g AS ({GROUPS}) SELECT * FROM g WHERE group_by = 'batch' AND contains(lower(group_value), 'b1')", ("plong",))
def _(t: Tables) -> DataFrame:
    return reads.qc_overview(group_rows(t), "batch", "B1")[0]


@query(
    "qc_overview_counts",
    "P15",
    f"""WITH g AS ({GROUPS}) SELECT count(*) FILTER (WHERE group_by = 'batch') AS group_count,
  count(*) FILTER (WHERE group_by = 'batch' AND contains(lower(group_value), 'b1')) AS matching_group_count FROM g""",
    ("plong",),
)
def _(t: Tables) -> DataFrame:
    return reads.qc_overview(group_rows(t), "batch", "B1")[1]


@query(
    "qc_per_sample",
    "P16",
    f"""SELECT sample_id, min(condition) AS condition, {quart(Q, ("abundance_q1", "abundance_median", "abundance_q3"))} FROM plong GROUP BY sample_id""",
    ("plong",),
)
def _(t: Tables) -> DataFrame:
    return rounded(per_sample(t)["protein_intensity"], ["abundance_q1", "abundance_median", "abundance_q3"])


def per_sample(t: Tables) -> dict[str, DataFrame]:
    peptides = t.view("peptides")
    return reads.qc_per_sample(
        qc.qc_sample_metrics(t.view("plong")), qc.psm_completeness(peptides), qc.psm_intensity(peptides)
    )


@query(
    "qc_per_sample_proteins",
    "P16 E15",
    f"SELECT sample_id, min(condition) AS condition, count({Q}) AS present, count(*) - count({Q}) AS missing, count(*) AS total FROM plong GROUP BY sample_id",
    ("plong",),
)
def _(t: Tables) -> DataFrame:
    return per_sample(t)["protein_completeness"]


@query(
    "qc_per_sample_psms",
    "P16 E15",
    f"""WITH p AS (SELECT * FROM peptides WHERE result_layer = 'protein'), n AS (SELECT count(DISTINCT peptide_id) AS total FROM p),
c AS (SELECT sample_id, condition, count(DISTINCT peptide_id) FILTER (WHERE {Q} IS NOT NULL) AS present FROM p GROUP BY ALL)
SELECT sample_id, condition, total, present, total - present AS missing FROM c, n""",
    ("peptides",),
)
def _(t: Tables) -> DataFrame:
    return per_sample(t)["psm_completeness"]


@query(
    "qc_per_sample_intensity",
    "P16 E16",
    f"""SELECT result_layer, condition, coalesce(replicate, sample_id) AS replicate, count(DISTINCT sample_id) AS sample_count, {quart(Q)}
FROM peptides WHERE {Q} IS NOT NULL AND result_layer = 'protein' GROUP BY result_layer, condition, coalesce(replicate, sample_id)""",
    ("peptides",),
)
def _(t: Tables) -> DataFrame:
    return rounded(per_sample(t)["psm_intensity"], ["q1", "median", "q3"])


# ------------------------------------------------------------------- comparisons

PAIR_SUMS = """pairs AS (SELECT a.comparison AS l, b.comparison AS r, count(*) AS n, sum(a.value) AS sx, sum(b.value) AS sy, sum(a.value * a.value) AS sxx,
  sum(b.value * b.value) AS syy, sum(a.value * b.value) AS sxy FROM fc a JOIN fc b ON a.feature = b.feature AND a.comparison <= b.comparison GROUP BY ALL)"""
R = "(n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))"


@query(
    "fold_change_table",
    "C6",
    """SELECT protein_accession AS feature, comparison_id AS comparison, max(log2_fold_change) AS value FROM diff
WHERE result_layer = 'protein' AND isfinite(log2_fold_change) GROUP BY ALL""",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    return compare.fold_change_long(t.view("diff"))


@query(
    "comparison_correlation",
    "J27 D16",
    f"WITH {PAIR_SUMS} SELECT l AS \"left\", r AS \"right\", CASE WHEN n >= 100 THEN round({R}, 6) END AS correlation, n AS support FROM pairs",
    ("fc",),
)
def _(t: Tables) -> DataFrame:
    return rounded(compare.pairwise_pearson(t.view("fc")), ["correlation"])


@query(
    "comparison_correlation_blocked",
    "J27 D16",
    f"WITH {PAIR_SUMS} SELECT l AS \"left\", r AS \"right\", CASE WHEN n >= 1350 THEN round({R}, 6) END AS correlation, n AS support FROM pairs",
    ("fc",),
)
def _(t: Tables) -> DataFrame:
    return rounded(compare.pairwise_pearson(t.view("fc"), 1350, blocks=3, chunks=4), ["correlation"])


@query(
    "comparison_distance",
    "J30",
    f"WITH {PAIR_SUMS} SELECT l AS \"left\", r AS \"right\", round(sqrt(greatest(sxx + syy - 2 * sxy, 0) / n), 6) AS rmsd FROM pairs WHERE l < r",
    ("fc",),
)
def _(t: Tables) -> DataFrame:
    return rounded(compare.rmsd_matrix(t.view("fc")), ["rmsd"])


@query(
    "layer_correlation",
    "J31 H4",
    """WITH f AS (SELECT protein_accession AS feature, comparison_id AS comparison, max(log2_fold_change) AS value FROM diff WHERE result_layer = 'ptm' GROUP BY ALL),
pairs AS (SELECT a.comparison AS l, b.comparison AS r, count(*) AS n, corr(a.value, b.value) AS c FROM f a JOIN f b ON a.feature = b.feature AND a.comparison < b.comparison GROUP BY ALL)
SELECT l AS "left", r AS "right", n AS matched, round(CASE WHEN n >= 2 THEN c END, 6) AS correlation FROM pairs""",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    fc = compare.fold_change_long(t.view("diff"), "ptm")
    return rounded(compare.layer_correlation(fc)["pairs"], ["correlation"])


@query(
    "site_layer_correlation",
    "J31 F9",
    """WITH r AS (SELECT 'S' || CAST(CAST(substr(split_part(protein_accession, ';', 1), 2) AS BIGINT) % 97 AS VARCHAR) AS feature, comparison_id AS comparison, log2_fold_change,
  CAST(substr(split_part(protein_accession, ';', 1), 2) AS BIGINT) AS row_order FROM diff WHERE result_layer = 'ptm'),
f AS (SELECT feature, comparison, arg_max(log2_fold_change, row_order) AS value FROM r WHERE log2_fold_change IS NOT NULL GROUP BY ALL),
pairs AS (SELECT a.comparison AS l, b.comparison AS r, count(*) AS n, corr(a.value, b.value) AS c FROM f a JOIN f b ON a.feature = b.feature AND a.comparison < b.comparison GROUP BY ALL)
SELECT l AS "left", r AS "right", n AS matched, round(CASE WHEN n >= 2 THEN c END, 6) AS correlation FROM pairs""",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    """Many rows of a feature and comparison: the last by row order counts."""
    number = F.expr("cast(substr(split_part(protein_accession, ';', 1), 2) as bigint)")
    rows = t.view("diff").where("result_layer = 'ptm'").withColumn("row_order", number)
    rows = rows.withColumn("protein_accession", F.concat(F.lit("S"), (F.col("row_order") % 97).cast("string")))
    return rounded(compare.layer_correlation(ptm.matched_correlation_input(rows))["pairs"], ["correlation"])


@query(
    "comparison_rank_correlation",
    "J28 D15 F6",
    """WITH s AS (SELECT a.feature, a.value AS x, b.value AS y FROM fc a JOIN fc b USING (feature) WHERE a.comparison = 'K1' AND b.comparison = 'K2'),
k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM s)
SELECT 'K1' AS "left", 'K2' AS "right", round(corr(rx, ry), 6) AS correlation, count(*) AS support, count(*) >= 100 AS sufficient_support FROM k""",
    ("fc",),
)
def _(t: Tables) -> DataFrame:
    return rounded(compare.pairwise_spearman(t.view("fc"), "K1", "K2"), ["correlation"])


@query(
    "shared_features",
    "D15 H4",
    "SELECT a.feature, a.value AS x, b.value AS y FROM fc a JOIN fc b USING (feature) WHERE a.comparison = 'K1' AND b.comparison = 'K2'",
    ("fc",),
)
def _(t: Tables) -> DataFrame:
    return compare.shared_pairs(t.view("fc"), "K1", "K2")


@query(
    "feature_correlation",
    "J29",
    """WITH s AS (SELECT a.feature, a.value AS x, q.value AS y FROM fc a JOIN fc q ON q.feature = 'P5' AND a.comparison = q.comparison),
c AS (SELECT feature, CASE WHEN feature = 'P5' THEN 1.0 WHEN count(*) >= 3 THEN corr(x, y) END AS c FROM s GROUP BY feature)
SELECT f.feature, round(CAST(c AS DOUBLE), 6) AS correlation FROM (SELECT DISTINCT feature FROM fc) f LEFT JOIN c USING (feature)""",
    ("fc",),
)
def _(t: Tables) -> DataFrame:
    return rounded(compare.feature_correlation(t.view("fc"), "P5"), ["correlation"])


@query(
    "feature_rank_correlation",
    "J29",
    """WITH s AS (SELECT a.feature, a.value AS x, q.value AS y FROM fc a JOIN fc q ON q.feature = 'P5' AND a.comparison = q.comparison),
k AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0::DOUBLE AS ry FROM s),
c AS (SELECT feature, CASE WHEN feature = 'P5' THEN 1.0 WHEN count(*) >= 3 THEN corr(rx, ry) END AS c FROM k GROUP BY feature)
SELECT f.feature, round(CAST(c AS DOUBLE), 6) AS correlation FROM (SELECT DISTINCT feature FROM fc) f LEFT JOIN c USING (feature)""",
    ("fc",),
)
def _(t: Tables) -> DataFrame:
    return rounded(compare.feature_correlation(t.view("fc"), "P5", "spearman"), ["correlation"])


DISTANCE = """dist AS (SELECT feature, round(s, 9) AS similarity FROM (SELECT a.feature, sqrt(avg(pow(a.value - q.value, 2))) AS s, count(*) AS n
  FROM fc a JOIN fc q ON q.feature = 'P5' AND a.comparison = q.comparison GROUP BY 1) WHERE n >= 3 OR feature = 'P5')"""


@query(
    "similar_features",
    "G5",
    f"""WITH {DISTANCE} SELECT * FROM (SELECT feature, similarity, 'nearest' AS side FROM dist ORDER BY similarity, feature <> 'P5', feature LIMIT 11)
UNION ALL SELECT * FROM (SELECT feature, similarity, 'farthest' FROM dist ORDER BY similarity DESC, feature DESC LIMIT 10)""",
    ("fc",),
)
def _(t: Tables) -> DataFrame:
    return rounded(compare.similar_features(t.view("fc"), "P5"), ["similarity"], 9)


def correlations(t: Tables, min_support: int = 100) -> CorrelationStore:
    """The matrix of the test comparisons, written in blocks of eight, with its pyramid."""
    fc = t.view("fc")
    corr = rounded(compare.pairwise_pearson(fc, min_support), ["correlation"], 9)
    return write_store(corr, compare.comparison_positions(fc), side=8)


@query(
    "nearest_comparisons",
    "G4",
    f"""WITH {PAIR_SUMS}, m AS (SELECT CASE WHEN l = 'K3' THEN r ELSE l END AS comparison, round({R}, 9) AS correlation, n AS support FROM pairs
  WHERE (l = 'K3' OR r = 'K3') AND l <> r AND n >= 100)
SELECT * FROM (SELECT *, 'nearest' AS side FROM m ORDER BY correlation DESC, comparison LIMIT 5)
UNION ALL SELECT * FROM (SELECT *, 'least' FROM m ORDER BY correlation, comparison LIMIT 5)""",
    ("fc",),
)
def _(t: Tables) -> DataFrame:
    return compare.nearest_and_least(correlations(t).row(t.spark, "K3"), 5)


@query(
    "correlation_cell",
    "J33",
    f"WITH {PAIR_SUMS} SELECT l AS \"left\", r AS \"right\", round({R}, 6) AS correlation, n AS support, true AS sufficient_support FROM pairs WHERE l = 'K12' AND r = 'K4'",
    ("fc",),
)
def _(t: Tables) -> DataFrame:
    return rounded(correlations(t).cell(t.spark, "K4", "K12"), ["correlation"])


@query(
    "correlation_tile",
    "G10",
    f"""WITH {PAIR_SUMS}, idx AS (SELECT comparison, row_number() OVER (ORDER BY comparison) - 1 AS p FROM (SELECT DISTINCT comparison FROM fc)),
c AS (SELECT i.p AS i, j.p AS j, {R} AS c, n FROM pairs JOIN idx i ON i.comparison = l JOIN idx j ON j.comparison = r),
s AS (SELECT i, j, c, n FROM c UNION ALL SELECT j, i, c, n FROM c WHERE i <> j)
SELECT CAST(floor(i / 2) AS BIGINT) AS "row", CAST(floor(j / 2) AS BIGINT) AS "column", round(avg(c), 6) AS correlation, max(n) AS support FROM s
WHERE floor(i / 2) BETWEEN 4 AND 7 AND floor(j / 2) BETWEEN 8 AND 11 GROUP BY ALL""",
    ("fc",),
)
def _(t: Tables) -> DataFrame:
    return rounded(correlations(t, 1).tile(t.spark, 1, 1, 2, size=4), ["correlation"])


@query(
    "correlation_top_tile",
    "G10",
    f"""WITH {PAIR_SUMS}, idx AS (SELECT comparison, row_number() OVER (ORDER BY comparison) - 1 AS p FROM (SELECT DISTINCT comparison FROM fc)),
c AS (SELECT i.p AS i, j.p AS j, {R} AS c, n FROM pairs JOIN idx i ON i.comparison = l JOIN idx j ON j.comparison = r),
s AS (SELECT i, j, c, n FROM c UNION ALL SELECT j, i, c, n FROM c WHERE i <> j)
SELECT CAST(floor(i / 8) AS BIGINT) AS "row", CAST(floor(j / 8) AS BIGINT) AS "column", round(avg(c), 6) AS correlation, max(n) AS support FROM s GROUP BY ALL""",
    ("fc",),
)
def _(t: Tables) -> DataFrame:
    return rounded(correlations(t, 1).tile(t.spark, 3, 0, 0), ["correlation"])


@query(
    "correlation_bars",
    "G13",
    """SELECT * FROM (SELECT term AS feature, nes AS correlation, 'top' AS side FROM terms ORDER BY nes DESC, term LIMIT 10)
UNION ALL SELECT * FROM (SELECT term, nes, 'bottom' FROM terms ORDER BY nes, term LIMIT 10)""",
    ("terms",),
)
def _(t: Tables) -> DataFrame:
    scores = t.view("terms").select(F.col("term").alias("feature"), F.col("nes").alias("correlation"))
    return compare.correlation_bars(scores)


EMBEDDED = f"""WITH {PAIR_SUMS}, place AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS i FROM (SELECT DISTINCT comparison AS item FROM fc)),
half AS (SELECT a.i, b.i AS j, CASE WHEN n >= 100 THEN {R} ELSE 0 END AS v FROM pairs JOIN place a ON a.item = l JOIN place b ON b.item = r WHERE l <> r),
matrix AS MATERIALIZED (SELECT i, j, v FROM half UNION ALL SELECT j, i, v FROM half UNION ALL SELECT i, i, 1.0::DOUBLE FROM place), {fits.top_pairs('matrix')}
SELECT item, round(a.v * sqrt(greatest(a.value, 0)), 4) AS x, round(b.v * sqrt(greatest(b.value, 0)), 4) AS y
FROM place JOIN pair1 a USING (i) JOIN pair2 b USING (i)"""

for _name, _width in (("comparison_embedding", 64), ("comparison_embedding_lanczos", 4)):

    @query(_name, "J32", EMBEDDED, ("fc",))
    def _(t: Tables, width: int = _width) -> DataFrame:
        return rounded(pca.embed(compare.pairwise_pearson(t.view("fc")), width=width), ["x", "y"], 4)


CHOSEN = ["D1_vs_DMSO", "D2_vs_DMSO", "D3_vs_DMSO"]
CHOSEN_SQL = ", ".join(f"'{c}'" for c in CHOSEN)


@query(
    "top_changed_proteins",
    "G3",
    f"""WITH s AS (SELECT comparison_id, protein_accession, min(gene_name) AS gene_name, avg(log2_fold_change) AS log2_fold_change FROM diff
  WHERE result_layer = 'protein' AND comparison_id IN ({CHOSEN_SQL}) GROUP BY ALL),
b AS (SELECT protein_accession, max(abs(log2_fold_change)) AS largest FROM s GROUP BY 1 ORDER BY largest DESC NULLS LAST, protein_accession LIMIT 50)
SELECT s.*, largest FROM s JOIN b USING (protein_accession)""",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    return compare.top_proteins(t.view("diff"), CHOSEN, 50)


@query(
    "heatmap_rows",
    "C7",
    f"""WITH s AS (SELECT protein_accession, comparison_id, max(log2_fold_change) AS v FROM diff WHERE result_layer = 'protein' GROUP BY ALL)
SELECT protein_accession, max(CASE WHEN comparison_id = 'D1_vs_DMSO' THEN v END) AS a, max(CASE WHEN comparison_id = 'D2_vs_DMSO' THEN v END) AS b,
  max(CASE WHEN comparison_id = 'D3_vs_DMSO' THEN v END) AS c FROM s GROUP BY 1""",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    rows = t.view("diff").where(F.col("result_layer") == "protein")
    out = compare.heatmap_payload(rows, CHOSEN, "protein_accession", "comparison_id", "log2_fold_change")
    return out.select("protein_accession", *[F.col("values")[i].alias(n) for i, n in enumerate("abc")])


@query(
    "top_absolute_changes",
    "G12",
    """SELECT feature, max(abs(value)) AS largest FROM fc WHERE comparison IN ('K1', 'K2', 'K3') GROUP BY feature ORDER BY largest DESC, feature LIMIT 100""",
    ("fc",),
)
def _(t: Tables) -> DataFrame:
    return compare.top_abs_change(t.view("fc"), ["K1", "K2", "K3"])


VENN = f"""{LOADED}, sig AS (SELECT * FROM loaded WHERE comparison_id IN ({CHOSEN_SQL}) AND adjusted_p_value < 0.05 AND abs(log2_fold_change) >= 1),
members AS (SELECT protein_accession, string_agg(DISTINCT comparison_id, '&' ORDER BY comparison_id) AS region, count(DISTINCT comparison_id) AS sets FROM sig GROUP BY 1)"""


@query(
    "venn_members",
    "H2",
    f"WITH {VENN} SELECT protein_accession, region, CAST(sets AS INTEGER) AS sets FROM members",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    return compare.venn(reads.load_differential(t.view("diff")), CHOSEN)["members"]


@query(
    "venn_regions",
    "H2",
    f"WITH {VENN} SELECT region, CAST(sets AS INTEGER) AS sets, count(*) AS count FROM members GROUP BY ALL",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    return compare.venn(reads.load_differential(t.view("diff")), CHOSEN)["regions"]


@query(
    "venn_details",
    "H2",
    f"""WITH {VENN} SELECT protein_accession, comparison_id, region, min(gene_name) AS gene_name, min(log2_fold_change) AS log2_fold_change, min(adjusted_p_value) AS adjusted_p_value
FROM sig JOIN members USING (protein_accession) GROUP BY ALL""",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    return compare.venn(reads.load_differential(t.view("diff")), CHOSEN)["details"]


@query("comparison_ids", "H3", "SELECT DISTINCT comparison_id FROM diff WHERE result_layer = 'ptm'", ("diff",))
def _(t: Tables) -> DataFrame:
    return compare.comparison_ids(t.view("diff"), "ptm")


@query(
    "unknown_comparisons",
    "H3",
    "SELECT DISTINCT 'D' || CAST(l_linenumber + 3 AS VARCHAR) || '_vs_DMSO' AS comparison_id FROM lineitem WHERE l_linenumber + 3 > 7",
)
def _(t: Tables) -> DataFrame:
    wanted = t.table("lineitem").select(
        F.concat(F.lit("D"), (F.col("l_linenumber") + 3).cast("string"), F.lit("_vs_DMSO")).alias("comparison_id")
    ).distinct()
    return compare.unknown_comparisons(wanted, t.view("diff"))


@query("protein_list", "H6", "SELECT protein_accession, min(gene_name) AS gene_name FROM diff GROUP BY 1", ("diff",))
def _(t: Tables) -> DataFrame:
    return compare.protein_list(t.view("diff"))


@query(
    "marked_or_significant",
    "H7",
    f"SELECT DISTINCT protein_accession FROM diff WHERE comparison_id IN ({CHOSEN_SQL}) AND adjusted_p_value < 0.05 AND abs(log2_fold_change) >= 1",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    marked = t.table("part").select(F.col("p_name").alias("protein_accession"))
    return compare.marked_or_significant(marked, t.view("diff"), CHOSEN)


# ------------------------------------------------------------- volcano expressions

HYPERBOLA = """coalesce(abs(log2_fold_change) > 0.1 AND -log10(greatest(p_value, 1e-300)) > -log10(0.05) + -log10(0.05) * (1 - 0.1) / CASE WHEN abs(log2_fold_change) > 0.1 THEN abs(log2_fold_change) - 0.1 END, false)"""


@query(
    "volcano_labels",
    "I13 I14 I17",
    f"""SELECT comparison_id, result_layer, protein_accession, {HYPERBOLA} AS significant, coalesce(abs(log2_fold_change) >= 1 AND p_value <= 0.05 AND adjusted_p_value <= 0.05, false) AS rectangle,
  CASE WHEN NOT {HYPERBOLA} THEN 'Not Significant' WHEN log2_fold_change > 0 THEN 'Upregulated' ELSE 'Downregulated' END AS label,
  CASE WHEN p_value IS NULL THEN NULL ELSE round(-log10(greatest(p_value, 1e-300)), 6) END AS nlog10 FROM diff""",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    fold, p, adjusted = F.col("log2_fold_change"), F.col("p_value"), F.col("adjusted_p_value")
    out = t.view("diff").withColumn("significant", E.volcano_significant(fold, p, adjusted))
    out = out.withColumn("rectangle", E.volcano_significant(fold, p, adjusted, adjusted_cut=0.05, s0=0.0))
    out = out.withColumn("label", E.significance_label(F.col("significant"), fold))
    out = out.withColumn("nlog10", F.when(p.isNotNull(), F.round(E.negative_log10(p) + 0.0, 6)))
    return out.select("comparison_id", "result_layer", "protein_accession", "significant", "rectangle", "label", "nlog10")
