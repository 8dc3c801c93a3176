"""Queries of the quality-control operators and principal components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omicspark.functions import ranking
from omicspark.functions.expressions import finite
from omicspark.operators import pca, qc
from omicspark.registry import fits
from omicspark.registry.base import Tables, query

Q = "processed_log2_abundance"


def rounded(df: DataFrame, names: Sequence[str], digits: int = 6) -> DataFrame:
    """The named doubles rounded; 0 has no sign."""
    return df.withColumns({n: F.round(F.col(n) + F.lit(0.0), digits) for n in names})


def quart(value: str, names: Sequence[str] = ("q1", "median", "q3"), digits: int = 6, extra: str = "") -> str:
    return ", ".join(
        f"round(quantile_cont({value}, {p}){extra}, {digits}) AS {n}" for n, p in zip(names, (0.25, 0.5, 0.75))
    )


@query(
    "qc_sample_metrics",
    "E10 P9",
    f"""SELECT sample_id, min(condition) AS condition, min(replicate) AS replicate, min(batch) AS batch, min(sample_order) AS sample_order,
  count(*) AS total_feature_count, count({Q}) AS present_count, count(*) - count({Q}) AS missing_count,
  CAST(sum(observed_feature_count) AS BIGINT) AS observed_feature_count, CAST(sum(imputed_feature_count) AS BIGINT) AS imputed_feature_count,
  min({Q}) AS abundance_min, max({Q}) AS abundance_max,
  round(CASE WHEN sum(observed_feature_count) + sum(imputed_feature_count) > 0 THEN CAST(sum(imputed_feature_count) AS DOUBLE) / (sum(observed_feature_count) + sum(imputed_feature_count)) END, 9) AS imputation_fraction,
  {quart(Q, ("abundance_q1", "median_log2_abundance", "abundance_q3"))}
FROM plong WHERE result_layer = 'protein' GROUP BY sample_id""",
    ("plong",),
)
def _(t: Tables) -> DataFrame:
    out = qc.qc_sample_metrics(t.view("plong"))
    out = rounded(out, ["abundance_q1", "median_log2_abundance", "abundance_q3"])
    return rounded(out, ["imputation_fraction"], 9)


LONG = """g AS (SELECT 'condition' AS group_by, condition AS group_value, * FROM {0}
  UNION ALL SELECT 'batch', batch, * FROM {0} WHERE batch IS NOT NULL)"""
CV = "sqrt(exp(pow(stddev_samp({0}) * ln(2.0), 2)) - 1) * 100"


@query(
    "qc_group_metrics",
    "E11 E12 D7 F4 P9",
    f"""WITH {LONG.format('plong')}, a AS (SELECT group_by, group_value, count(DISTINCT sample_id) AS sample_count, count({Q}) AS observation_count,
  {quart(Q)}, CAST(sum(observed_feature_count) AS BIGINT) AS observed_count, CAST(sum(imputed_feature_count) AS BIGINT) AS imputed_count,
  count(*) - count({Q}) AS missing_count, min(condition_order) AS co, min({Q}) AS min_val, max({Q}) AS max_val,
  quantile_cont({Q}, 0.25) AS r1, quantile_cont({Q}, 0.75) AS r3 FROM g GROUP BY ALL),
pv AS (SELECT group_by, group_value, protein_accession, {CV.format(Q)} AS cv FROM g WHERE {Q} IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
p AS (SELECT group_by, group_value, count(*) FILTER (WHERE isfinite(cv)) AS protein_cv_count,
  {quart('cv', ("protein_cv_q1", "protein_cv_median", "protein_cv_q3"), 5)} FROM pv WHERE isfinite(cv) GROUP BY ALL),
ps AS (SELECT protein_accession, peptide_id, sample_id, min(condition) AS condition, min(batch) AS batch, avg({Q}) AS abundance
  FROM peptides WHERE result_layer = 'protein' AND {Q} IS NOT NULL GROUP BY ALL),
h AS (SELECT 'condition' AS group_by, condition AS group_value, * FROM ps UNION ALL SELECT 'batch', batch, * FROM ps WHERE batch IS NOT NULL),
ev AS (SELECT group_by, group_value, protein_accession, peptide_id, {CV.format('abundance')} AS cv FROM h GROUP BY ALL HAVING count(*) >= 2),
e AS (SELECT group_by, group_value, count(*) AS peptide_cv_count,
  {quart('cv', ("peptide_cv_q1", "peptide_cv_median", "peptide_cv_q3"), 4)} FROM ev WHERE isfinite(cv) GROUP BY ALL)
SELECT a.group_by, a.group_value, sample_count, observation_count, q1, median, q3, observed_count, imputed_count, missing_count, min_val, max_val,
  CAST(CASE WHEN a.group_by = 'batch' THEN dense_rank() OVER (PARTITION BY a.group_by ORDER BY a.group_value) ELSE co END AS BIGINT) AS group_order,
  protein_cv_count, protein_cv_q1, protein_cv_median, protein_cv_q3, peptide_cv_count, peptide_cv_q1, peptide_cv_median, peptide_cv_q3,
  round(greatest(r1 - 1.5 * (r3 - r1), min_val), 6) AS lowerfence, round(least(r3 + 1.5 * (r3 - r1), max_val), 6) AS upperfence
FROM a LEFT JOIN p USING (group_by, group_value) LEFT JOIN e USING (group_by, group_value)""",
    ("plong", "peptides"),
)
def _(t: Tables) -> DataFrame:
    out = qc.qc_group_metrics(t.view("plong"), t.view("peptides"))
    out = rounded(out, ["q1", "median", "q3", "lowerfence", "upperfence"])
    out = rounded(out, ["protein_cv_q1", "protein_cv_median", "protein_cv_q3"], 5)
    return rounded(out, ["peptide_cv_q1", "peptide_cv_median", "peptide_cv_q3"], 4)


@query(
    "protein_cv_summary",
    "E12 E14",
    f"""WITH v AS (SELECT condition, protein, {CV.format('level')} AS cv FROM levels GROUP BY ALL HAVING count(*) >= 2),
b AS (SELECT condition, min(cv) AS lo, max(cv) AS hi, count(*) AS value_count, quantile_cont(cv, 0.25) AS a, quantile_cont(cv, 0.5) AS m,
  quantile_cont(cv, 0.75) AS c FROM v WHERE isfinite(cv) GROUP BY condition),
i AS (SELECT condition, count(*) FILTER (WHERE NOT isfinite(cv)) AS invalid_count FROM v GROUP BY condition)
SELECT condition, value_count, round(a, 3) AS q1, round(m, 3) AS median, round(c, 3) AS q3, round(greatest(a - 1.5 * (c - a), lo), 3) AS lowerfence,
  round(least(c + 1.5 * (c - a), hi), 3) AS upperfence, invalid_count FROM b JOIN i USING (condition)""",
    ("levels",),
)
def _(t: Tables) -> DataFrame:
    return rounded(qc.protein_cv_wide(t.view("levels")), ["q1", "median", "q3", "lowerfence", "upperfence"], 3)


@query(
    "psm_cv_summary",
    "E13",
    f"""WITH s AS (SELECT Unique_PSM, Condition, Replicate, log2(sum(Abundance)) AS v FROM psm WHERE Abundance > 0 GROUP BY ALL),
v AS (SELECT Condition, Unique_PSM, {CV.format('v')} AS cv FROM s GROUP BY ALL HAVING count(*) >= 2),
b AS (SELECT Condition, min(cv) AS lo, max(cv) AS hi, count(*) AS value_count, quantile_cont(cv, 0.25) AS a, quantile_cont(cv, 0.5) AS m,
  quantile_cont(cv, 0.75) AS c FROM v WHERE isfinite(cv) GROUP BY Condition)
SELECT Condition, value_count, round(a, 3) AS q1, round(m, 3) AS median, round(c, 3) AS q3, round(greatest(a - 1.5 * (c - a), lo), 3) AS lowerfence,
  round(least(c + 1.5 * (c - a), hi), 3) AS upperfence, 0::BIGINT AS invalid_count FROM b""",
    ("psm",),
)
def _(t: Tables) -> DataFrame:
    return rounded(qc.psm_cv(t.view("psm")), ["q1", "median", "q3", "lowerfence", "upperfence"], 3)


BOX = """b AS (SELECT l_returnflag, l_linestatus, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS value_count,
  quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.75) AS c FROM x GROUP BY ALL)"""
WIDE_PRICE = "x AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_quantity > 49 THEN l_extendedprice * 10 ELSE l_extendedprice END AS l_extendedprice FROM lineitem)"


def prices(t: Tables) -> DataFrame:
    price = F.when(F.col("l_quantity") > 49, F.col("l_extendedprice") * 10).otherwise(F.col("l_extendedprice"))
    return t.table("lineitem").select("l_returnflag", "l_linestatus", price.alias("l_extendedprice"))


for _name, _clamp in (("clamped", True), ("open", False)):
    _low = "greatest(a - 1.5 * (c - a), lo)" if _clamp else "a - 1.5 * (c - a)"
    _high = "least(c + 1.5 * (c - a), hi)" if _clamp else "c + 1.5 * (c - a)"

    @query(
        f"box_statistics_{_name}",
        "E19",
        f"""WITH {WIDE_PRICE}, {BOX} SELECT l_returnflag, l_linestatus, value_count, round(a, 3) AS q1, round(m, 3) AS median, round(c, 3) AS q3,
  round({_low}, 3) AS lowerfence, round({_high}, 3) AS upperfence FROM b""",
    )
    def _(t: Tables, clamp: bool = _clamp) -> DataFrame:
        out = qc.box_stats(prices(t), ["l_returnflag", "l_linestatus"], "l_extendedprice", clamp)
        return rounded(out, ["q1", "median", "q3", "lowerfence", "upperfence"], 3)


@query(
    "box_outliers",
    "E19",
    f"""WITH {WIDE_PRICE}, {BOX}, o AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS outlier,
  greatest(greatest(a - 1.5 * (c - a), lo) - l_extendedprice, l_extendedprice - least(c + 1.5 * (c - a), hi)) AS d FROM x JOIN b USING (l_returnflag, l_linestatus))
SELECT l_returnflag, l_linestatus, outlier, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY d DESC, outlier) AS INTEGER) AS rank
  FROM o WHERE d > 0) WHERE rank <= 20""",
)
def _(t: Tables) -> DataFrame:
    return qc.box_outliers(prices(t), ["l_returnflag", "l_linestatus"], "l_extendedprice").drop("distance")


@query(
    "psm_completeness",
    "E15 P9",
    f"""WITH n AS (SELECT result_layer, count(DISTINCT peptide_id) AS t FROM peptides GROUP BY 1)
SELECT sample_id, condition, result_layer, t AS psm_total_count, count(DISTINCT peptide_id) FILTER (WHERE {Q} IS NOT NULL) AS psm_present_count,
  t - count(DISTINCT peptide_id) FILTER (WHERE {Q} IS NOT NULL) AS psm_missing_count
FROM peptides JOIN n USING (result_layer) GROUP BY sample_id, condition, result_layer, t""",
    ("peptides",),
)
def _(t: Tables) -> DataFrame:
    return qc.psm_completeness(t.view("peptides"))


@query(
    "sample_completeness",
    "E15 P11",
    """SELECT Sample_Origination, count(DISTINCT Unique_PSM) FILTER (WHERE Abundance > 50000) AS present,
  (SELECT count(DISTINCT Unique_PSM) FROM psm) AS total,
  (SELECT count(DISTINCT Unique_PSM) FROM psm) - count(DISTINCT Unique_PSM) FILTER (WHERE Abundance > 50000) AS missing
FROM psm GROUP BY Sample_Origination""",
    ("psm",),
)
def _(t: Tables) -> DataFrame:
    return qc.completeness_by_sample(
        t.view("psm"), "Unique_PSM", "Sample_Origination", F.coalesce(F.col("Abundance") > 50000, F.lit(False))
    )


@query(
    "psm_intensity",
    "E16 P9",
    f"""SELECT result_layer, condition, coalesce(replicate, sample_id) AS replicate, count(DISTINCT sample_id) AS sample_count, {quart(Q)}
FROM peptides WHERE {Q} IS NOT NULL GROUP BY result_layer, condition, coalesce(replicate, sample_id)""",
    ("peptides",),
)
def _(t: Tables) -> DataFrame:
    return rounded(qc.psm_intensity(t.view("peptides")), ["q1", "median", "q3"])


@query(
    "normalized_intensity",
    "E17 F5",
    """WITH m AS (SELECT *, quantile_cont(Abundance, 0.5) OVER (PARTITION BY Condition, Replicate) AS sm FROM psm),
g AS (SELECT quantile_cont(sm, 0.5) AS g FROM m),
v AS (SELECT Condition, Replicate, CASE WHEN Abundance > 0 THEN log2(Abundance * (g.g / sm)) END AS x FROM m, g),
b AS (SELECT Condition, Replicate, min(x) AS lo, max(x) AS hi, count(x) AS value_count, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS md, quantile_cont(x, 0.75) AS c
  FROM v GROUP BY ALL)
SELECT Condition, Replicate, value_count, round(a, 6) AS q1, round(md, 6) AS median, round(c, 6) AS q3,
  round(greatest(a - 1.5 * (c - a), lo), 6) AS lowerfence, round(least(c + 1.5 * (c - a), hi), 6) AS upperfence FROM b""",
    ("psm",),
)
def _(t: Tables) -> DataFrame:
    return rounded(qc.normalized_intensity(t.view("psm")), ["q1", "median", "q3", "lowerfence", "upperfence"])


@query(
    "pvalue_histogram",
    "E20 D17",
    """WITH b AS (SELECT comparison_id, least(CAST(floor(p_value * 20) AS INTEGER), 19) AS bin FROM diff WHERE p_value BETWEEN 0 AND 1),
g AS (SELECT comparison_id, CAST(r.range AS INTEGER) AS bin FROM (SELECT DISTINCT comparison_id FROM diff), range(20) r)
SELECT g.comparison_id, g.bin, count(b.bin) AS count FROM g LEFT JOIN b ON b.comparison_id = g.comparison_id AND b.bin = g.bin GROUP BY ALL""",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    return qc.pvalue_histogram(t.view("diff"))


@query(
    "differential_summary",
    "E21",
    """SELECT comparison_id, result_layer, count(*) AS total, count(*) FILTER (WHERE adjusted_p_value < 0.05) AS significant,
  count(*) FILTER (WHERE adjusted_p_value < 0.05 AND log2_fold_change > 0) AS upregulated,
  count(*) FILTER (WHERE adjusted_p_value < 0.05 AND log2_fold_change < 0) AS downregulated,
  count(p_value) AS tested, count(*) FILTER (WHERE p_value IS NULL) AS failed FROM diff GROUP BY ALL""",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    return qc.diff_summary(t.view("diff"), ["comparison_id", "result_layer"])


@query(
    "psm_totals",
    "E22 P10",
    """SELECT (SELECT count(DISTINCT Unique_PSM) FROM psm) AS total_psms,
  (SELECT round(avg(n), 1) FROM (SELECT count(DISTINCT Unique_PSM) AS n FROM psm GROUP BY Condition, Replicate)) AS avg_psms_per_sample""",
    ("psm",),
)
def _(t: Tables) -> DataFrame:
    return qc.psm_summary(t.view("psm"))


@query(
    "qc_summary",
    "E23 P10",
    f"""WITH s AS (SELECT sample_id, count({Q}) AS p, count(*) AS t FROM plong GROUP BY 1),
pv AS (SELECT condition, protein_accession, {CV.format(Q)} AS cv FROM plong WHERE {Q} IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
ps AS (SELECT protein_accession, peptide_id, sample_id, min(condition) AS condition, avg({Q}) AS a FROM peptides
  WHERE result_layer = 'protein' AND {Q} IS NOT NULL GROUP BY ALL),
ev AS (SELECT condition, protein_accession, peptide_id, {CV.format('a')} AS cv FROM ps GROUP BY ALL HAVING count(*) >= 2),
pm AS (SELECT round(avg(m), 1) AS c FROM (SELECT quantile_cont(cv, 0.5) AS m FROM pv WHERE isfinite(cv) GROUP BY condition)),
em AS (SELECT round(avg(m), 1) AS c FROM (SELECT quantile_cont(cv, 0.5) AS m FROM ev WHERE isfinite(cv) GROUP BY condition))
SELECT (SELECT count(DISTINCT protein_accession) FROM plong) AS total_proteins, (SELECT CAST(floor(avg(p)) AS BIGINT) FROM s) AS avg_proteins_per_sample,
  (SELECT round(CAST(sum(p) AS DOUBLE) / CAST(sum(t) AS DOUBLE) * 100, 1) FROM s) AS completeness_rate, pm.c AS average_protein_cv, em.c AS average_psm_cv, pm.c AS average_cv FROM pm, em""",
    ("plong", "peptides"),
)
def _(t: Tables) -> DataFrame:
    proteins, peptides = t.view("plong"), t.view("peptides")
    return qc.qc_summary(proteins, qc.qc_sample_metrics(proteins), qc.qc_group_metrics(proteins, peptides))


@query(
    "group_median_beside_rows",
    "F5",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(quantile_cont(l_extendedprice, 0.5) OVER (PARTITION BY l_returnflag), 3) AS m FROM lineitem""",
)
def _(t: Tables) -> DataFrame:
    out = qc.with_group_median(t.table("lineitem"), ["l_returnflag"], "l_extendedprice", "m")
    return rounded(out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "m"), ["m"], 3)


@query(
    "average_tie_ranks",
    "F6",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, rank() OVER w + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS r
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)""",
)
def _(t: Tables) -> DataFrame:
    out = ranking.average_ranks(t.table("lineitem"), ["l_returnflag"], "l_quantity", "r")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "r")


@query(
    "finite_measures",
    "B11",
    """SELECT Protein, Label, result_layer, CASE WHEN isfinite(TRY_CAST(log2FC AS DOUBLE)) THEN TRY_CAST(log2FC AS DOUBLE) END AS log2_fold_change FROM raw_results""",
    ("raw_results",),
)
def _(t: Tables) -> DataFrame:
    value = finite(F.col("log2FC").try_cast("double"))
    return t.view("raw_results").select("Protein", "Label", "result_layer", value.alias("log2_fold_change"))


@query(
    "complete_feature_order",
    "F3 J25",
    f"""WITH n AS (SELECT count(DISTINCT sample_id) AS n FROM plong),
f AS (SELECT protein_accession FROM plong, n GROUP BY protein_accession, n HAVING count(*) = n AND count({Q}) = n)
SELECT protein_accession, CAST(row_number() OVER (ORDER BY protein_accession) - 1 AS BIGINT) AS feature_order FROM f""",
    ("plong",),
)
def _(t: Tables) -> DataFrame:
    rows = t.view("plong")
    n = rows.select("sample_id").distinct().count()
    full = pca.complete_features(rows, n, "protein_accession", Q)
    full = full.withColumn("initial", F.ascii("protein_accession").cast("double"))
    placed = ranking.positions(
        full, [], "initial", "protein_accession", out="feature_order", descending=False
    )
    return placed.select("protein_accession", "feature_order")


def components(value: str, item: str) -> str:
    """SQL of the two first components of a CTE ``value`` (feature, item, x)."""
    held = "(SELECT count(*) FROM whole) >= 2"
    shown = ", ".join(f"coalesce(CASE WHEN {held} THEN round({x}, {d}) END, 0.0) AS {n}" for x, d, n in (
        ("a.v * sqrt(greatest(a.value, 0))", 4, "pc1"), ("b.v * sqrt(greatest(b.value, 0))", 4, "pc2"),
        ("100 * a.value / total", 5, "pc1_variance"), ("100 * b.value / total", 5, "pc2_variance"),
    ))
    return f"""WITH {value}, {fits.GRAM}, {fits.top_pairs('product')}
SELECT item AS {item}, {shown}, CASE WHEN {held} THEN 'exact' ELSE 'unavailable' END AS method
FROM place LEFT JOIN pair1 a USING (i) LEFT JOIN pair2 b USING (i), total"""


LEVEL_VALUES = "value AS (SELECT protein AS feature, sample AS item, level AS x FROM levels)"
FILLED_VALUES = """value AS (SELECT f.feature, c.comparison AS item, coalesce(fc.value, f.m) AS x FROM (SELECT feature, avg(value) AS m FROM fc GROUP BY 1) f
  CROSS JOIN (SELECT DISTINCT comparison FROM fc) c LEFT JOIN fc ON fc.feature = f.feature AND fc.comparison = c.comparison)"""


def components_shown(scores: DataFrame) -> DataFrame:
    out = rounded(scores, ["pc1", "pc2"], 4)
    return rounded(out, ["pc1_variance", "pc2_variance"], 5)


for _name, _width in (("sample_pca", 64), ("sample_pca_lanczos", 4)):

    @query(_name, "J25", components(LEVEL_VALUES, "sample_id"), ("levels",))
    def _(t: Tables, width: int = _width) -> DataFrame:
        rows = t.view("levels").withColumnsRenamed(
            {"protein": "protein_accession", "sample": "sample_id", "level": "processed_log2_abundance"}
        )
        return components_shown(pca.pca(rows, width=width))


@query("comparison_pca", "J26", components(FILLED_VALUES, "comparison"), ("fc",))
def _(t: Tables) -> DataFrame:
    return components_shown(pca.pca_comparisons(t.view("fc")))
