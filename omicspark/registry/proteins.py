"""Queries of protein resolution, coverage, counts, models and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omicspark.functions import ranking
from omicspark.operators import artifacts, fit, normalize, protein, summarize
from omicspark.registry import fits
from omicspark.registry.base import Tables, query
from omicspark.session import cut_lineage

# A PSM's smallest accession text, cut into its members; a member's support is the PSMs that name it.
CANDIDATES = """named AS (SELECT Unique_PSM, list_transform(string_split(min(Master_Protein_Accessions), ';'), lambda x: trim(x)) AS members
  FROM psm GROUP BY Unique_PSM),
member AS (SELECT Unique_PSM, members, unnest(list_distinct(list_filter(members, lambda x: x <> ''))) AS protein FROM named),
support AS (SELECT protein, count(*) AS psm_count FROM member GROUP BY protein)"""
RESOLVED = f"""{CANDIDATES},
owner AS (SELECT Unique_PSM, first(protein ORDER BY psm_count DESC, list_position(members, protein)) AS protein
  FROM member JOIN support USING (protein) GROUP BY Unique_PSM),
resolved AS (SELECT psm.* REPLACE (coalesce(owner.protein, Master_Protein_Accessions) AS Master_Protein_Accessions)
  FROM psm LEFT JOIN owner USING (Unique_PSM))"""


@query("candidate_support", "E1", f"WITH {CANDIDATES} SELECT * FROM support", ("psm",))
def _(t: Tables) -> DataFrame:
    return protein.protein_support(t.view("psm"))


@query(
    "shared_peptide_resolution",
    "F1 D2",
    f"WITH {RESOLVED} SELECT Unique_PSM, Condition, Replicate, Abundance, l_orderkey, Master_Protein_Accessions FROM resolved",
    ("psm",),
)
def _(t: Tables) -> DataFrame:
    return protein.resolve_shared(t.view("psm")).select(
        "Unique_PSM", "Condition", "Replicate", "Abundance", "l_orderkey", "Master_Protein_Accessions"
    )


@query(
    "detected_replicates",
    "E2",
    """SELECT Unique_PSM, Condition, count(DISTINCT Replicate) AS detected_reps FROM psm
WHERE Abundance IS NOT NULL GROUP BY ALL""",
    ("psm",),
)
def _(t: Tables) -> DataFrame:
    return protein.detected_replicates(t.view("psm"))


def coverage(source: str, design_sql: str, fraction: str, least: int) -> str:
    """A PSM is covered if the conditions it meets are as many as those that ask for a replicate at all."""
    return f"""asked AS (SELECT Condition, total - CAST(floor(total * {fraction}) AS INTEGER) AS needed FROM ({design_sql})),
met AS (SELECT Unique_PSM, count(*) AS conditions FROM (SELECT Unique_PSM, Condition, count(DISTINCT Replicate) AS seen
    FROM {source} WHERE Abundance IS NOT NULL GROUP BY ALL) JOIN asked USING (Condition)
  WHERE needed > 0 AND seen >= needed GROUP BY Unique_PSM),
full_rows AS (SELECT {source}.* FROM {source} LEFT JOIN met USING (Unique_PSM)
  WHERE coalesce(met.conditions, 0) = (SELECT count(*) FROM asked WHERE needed > 0)),
covered AS (SELECT full_rows.* FROM full_rows SEMI JOIN (SELECT Master_Protein_Accessions FROM full_rows
  GROUP BY Master_Protein_Accessions HAVING count(DISTINCT Unique_PSM) >= {least}) USING (Master_Protein_Accessions))"""


OBSERVED = "SELECT Condition, count(DISTINCT Replicate) AS total FROM {0} GROUP BY 1"
COVER_COLUMNS = ["Unique_PSM", "Condition", "Replicate", "Abundance", "Master_Protein_Accessions", "l_orderkey"]


@query(
    "coverage_filter",
    "E3 E4 D3 D4 F1",
    f"WITH {RESOLVED}, {coverage('resolved', OBSERVED.format('resolved'), '0.29', 2)} SELECT {', '.join(COVER_COLUMNS)} FROM covered",
    ("psm",),
)
def _(t: Tables) -> DataFrame:
    rows = protein.resolve_shared(t.view("psm"))
    return protein.coverage_filter(rows, None, 0.29, 2).select(*COVER_COLUMNS)


@query(
    "coverage_filter_designed",
    "E3",
    f"""WITH {coverage('psm', "SELECT * FROM (VALUES ('A', 6), ('N', 7), ('R', 5)) AS v(Condition, total)", '0.40', 1)}
SELECT {', '.join(COVER_COLUMNS)} FROM covered""",
    ("psm",),
)
def _(t: Tables) -> DataFrame:
    return protein.coverage_filter(t.view("psm"), {"A": 6, "N": 7, "R": 5}, 0.40, 1).select(*COVER_COLUMNS)


@query(
    "psm_count_per_protein",
    "E25",
    "SELECT Master_Protein_Accessions, count(DISTINCT Unique_PSM) AS PSM_Count FROM psm GROUP BY 1",
    ("psm",),
)
def _(t: Tables) -> DataFrame:
    return protein.psm_count_per_protein(t.view("psm"))


def genes_of(rows: str) -> str:
    """Gene labels of the protein groups of ``rows`` by the gene names of the parts."""
    return f"""gene_map AS (SELECT 'S' || CAST(p_partkey AS VARCHAR) AS accession, min(CASE WHEN p_partkey % 4 <> 0 THEN 'G' || CAST(p_partkey % 19 AS VARCHAR) END) AS gene
  FROM part GROUP BY 1),
members AS (SELECT DISTINCT p.g, u.o, regexp_replace(trim(u.m), '-\\d+$', '') AS base FROM
  (SELECT DISTINCT Master_Protein_Accessions AS g FROM {rows}) p, unnest(string_split(p.g, ';')) WITH ORDINALITY AS u(m, o)),
mapped AS (SELECT g, gene, min(o) AS o FROM members JOIN gene_map ON base = accession WHERE gene IS NOT NULL GROUP BY ALL),
labels AS (SELECT g, string_agg(gene, ';' ORDER BY o) AS label FROM mapped GROUP BY g)"""


def part_genes(t: Tables) -> DataFrame:
    """(accession, gene): three parts of four have a gene name."""
    name = F.concat(F.lit("G"), (F.col("p_partkey") % 19).cast("string"))
    return t.table("part").select(
        F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("accession"),
        F.when(F.col("p_partkey") % 4 != 0, name).alias("gene"),
    )


@query(
    "gene_labels",
    "D19 I12",
    f"""WITH {genes_of('psm')} SELECT DISTINCT Master_Protein_Accessions,
  coalesce(label, regexp_replace(Master_Protein_Accessions, '-\\d+$', '')) AS Gene_Name
FROM psm LEFT JOIN labels ON g = Master_Protein_Accessions""",
    ("psm",),
)
def _(t: Tables) -> DataFrame:
    groups = t.view("psm").select("Master_Protein_Accessions").distinct()
    return protein.gene_labels(groups, part_genes(t))


@query(
    "deduplicated_rows",
    "F9",
    """SELECT l_partkey, l_suppkey, l_orderkey, l_extendedprice FROM (SELECT *,
  row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey DESC, l_extendedprice DESC) AS rn
  FROM lineitem) WHERE rn = 1""",
)
def _(t: Tables) -> DataFrame:
    rows = t.table("lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_extendedprice")
    return protein.dedupe(
        rows, ["l_partkey", "l_suppkey"], [F.col("l_orderkey"), F.col("l_extendedprice")], "last"
    )


@query(
    "top_features",
    "F12",
    """WITH m AS (SELECT protein, feature, avg(log2_abundance) AS v FROM logs GROUP BY ALL),
b AS (SELECT protein, feature FROM (SELECT *, row_number() OVER (PARTITION BY protein ORDER BY round(v, 9) DESC, feature) AS rn FROM m) WHERE rn <= 3)
SELECT protein, feature, sample, round(log2_abundance, 7) AS log2_abundance FROM logs JOIN b USING (protein, feature)""",
    ("logs",),
)
def _(t: Tables) -> DataFrame:
    out = protein.top_features(t.view("logs"), 3, "protein", "feature")
    return out.withColumn("log2_abundance", F.round("log2_abundance", 7))


# ----------------------------------------------------------------- normalisation


@query(
    "log2_feature_levels",
    "J1",
    """SELECT protein, feature, sample, round(log2(sum(abundance)), 7) AS log2_abundance FROM features
GROUP BY ALL HAVING sum(abundance) > 0""",
    ("features",),
)
def _(t: Tables) -> DataFrame:
    out = normalize.log2_features(t.view("features"))
    return out.withColumn("log2_abundance", F.round("log2_abundance", 7))


@query(
    "log2_feature_maxima",
    "J1",
    """SELECT protein, feature, sample, round(log2(max(abundance)), 7) AS log2_abundance FROM features
GROUP BY ALL HAVING max(abundance) > 0""",
    ("features",),
)
def _(t: Tables) -> DataFrame:
    out = normalize.log2_features(t.view("features"), "max")
    return out.withColumn("log2_abundance", F.round("log2_abundance", 7))


CENTERS = {
    "center.median": ("l.log2_abundance - c.m", "quantile_cont(log2_abundance, 0.5)"),
    "center.mean": ("l.log2_abundance - c.m", "avg(log2_abundance)"),
    "div.median": ("l.log2_abundance / c.m", "quantile_cont(log2_abundance, 0.5)"),
}
for _method, (_shift, _stat) in CENTERS.items():

    @query(
        f"normalize_{_method.replace('.', '_')}",
        "J2 F5",
        f"""WITH c AS (SELECT sample, {_stat} AS m FROM logs GROUP BY sample)
SELECT protein, feature, l.sample, round({_shift}, 6) AS log2_abundance FROM logs l JOIN c ON c.sample = l.sample""",
        ("logs",),
    )
    def _(t: Tables, method: str = _method) -> DataFrame:
        out = normalize.normalize(t.view("logs"), method)
        return out.withColumn("log2_abundance", F.round("log2_abundance", 6))


@query(
    "normalize_quantiles",
    "J2",
    """WITH s AS (SELECT *, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY sample) AS n, lead(log2_abundance) OVER w AS nxt
  FROM logs WINDOW w AS (PARTITION BY sample ORDER BY log2_abundance)),
f AS (SELECT count(*) - 1 AS final FROM (SELECT DISTINCT protein, feature FROM logs)),
grid AS (SELECT sample, j, CASE WHEN n = 1 THEN 0 ELSE j * (n - 1) / final END AS x FROM (SELECT DISTINCT sample, n FROM s), f, generate_series(0, final) AS g(j)),
profile AS (SELECT j, avg(log2_abundance + (x - p) * coalesce(nxt - log2_abundance, 0)) AS m FROM grid JOIN s ON s.sample = grid.sample AND p = floor(x) GROUP BY j),
stepped AS (SELECT j, m, coalesce(lead(m) OVER (ORDER BY j), m) AS m1 FROM profile),
ranked AS (SELECT s.*, CASE WHEN n = 1 THEN final / 2 ELSE avg(p) OVER (PARTITION BY sample, log2_abundance) * final / (n - 1) END AS place FROM s, f)
SELECT protein, feature, sample, round(m + (place - j) * (m1 - m), 6) AS log2_abundance FROM ranked JOIN stepped ON j = floor(place)""",
    ("logs",),
)
def _(t: Tables) -> DataFrame:
    out = normalize.normalize(t.view("logs"), "quantiles")
    return out.withColumn("log2_abundance", F.round("log2_abundance", 6))


@query(
    "normalization_coefficients",
    "J3",
    """WITH c AS (SELECT sample, quantile_cont(log2_abundance, 0.5) AS m, avg(log2_abundance) AS a FROM logs GROUP BY sample),
p AS (SELECT l.sample, quantile_cont(l.log2_abundance - c.a, 0.5) AS m2 FROM logs l JOIN c ON c.sample = l.sample GROUP BY l.sample)
SELECT c.sample AS Sample, round(m - m2, 6) AS Log2Shift, round(pow(2, m - m2), 4) AS LinearFactor FROM c JOIN p ON p.sample = c.sample""",
    ("logs",),
)
def _(t: Tables) -> DataFrame:
    pre = t.view("logs")
    out = normalize.normalization_coefficients(pre, normalize.normalize(pre, "center.mean"))
    return out.select("Sample", F.round("Log2Shift", 6).alias("Log2Shift"), F.round("LinearFactor", 4).alias("LinearFactor"))


@query(
    "equalized_medians",
    "J4",
    """WITH c AS (SELECT sample, quantile_cont(log2_abundance, 0.5) AS m FROM logs GROUP BY sample),
g AS (SELECT quantile_cont(m, 0.5) AS g FROM c)
SELECT protein, feature, l.sample, round(l.log2_abundance - (c.m - g.g), 6) AS log2_abundance
FROM logs l JOIN c ON c.sample = l.sample, g""",
    ("logs",),
)
def _(t: Tables) -> DataFrame:
    out = normalize.equalize_medians(t.view("logs"))
    return out.withColumn("log2_abundance", F.round("log2_abundance", 6))


@query(
    "global_standards",
    "J4",
    """WITH c AS (SELECT sample, avg(log2_abundance) AS m FROM logs WHERE protein IN ('S1', 'S2') GROUP BY sample),
g AS (SELECT quantile_cont(m, 0.5) AS g FROM c)
SELECT protein, feature, l.sample, round(l.log2_abundance - coalesce(c.m - g.g, 0), 6) AS log2_abundance
FROM logs l LEFT JOIN c ON c.sample = l.sample, g""",
    ("logs",),
)
def _(t: Tables) -> DataFrame:
    out = normalize.global_standards(t.view("logs"), ["S1", "S2"])
    return out.withColumn("log2_abundance", F.round("log2_abundance", 6))


@query(
    "mindet_imputation",
    "J7 J8",
    """WITH c AS (SELECT sample, quantile_cont(log2_abundance, 0.01) AS q FROM logs GROUP BY sample),
f AS (SELECT DISTINCT protein, feature FROM logs)
SELECT f.protein, f.feature, c.sample, round(coalesce(l.log2_abundance, c.q), 6) AS log2_abundance,
  CASE WHEN l.log2_abundance IS NULL THEN 'imputed' ELSE 'observed' END AS provenance
FROM f CROSS JOIN c LEFT JOIN logs l ON l.protein = f.protein AND l.feature = f.feature AND l.sample = c.sample""",
    ("logs",),
)
def _(t: Tables) -> DataFrame:
    pre = t.view("logs")
    post = normalize.impute(pre, "MinDet").drop("provenance")
    out = normalize.provenance(pre, post)
    return out.withColumn("log2_abundance", F.round("log2_abundance", 6))


def unit_draw(salt: int) -> str:
    return f"(('0x' || left(md5(concat_ws(chr(31), '123:{salt}', f.protein, f.feature, c.sample)), 13))::BIGINT + 1) / {2**52 + 1}::DOUBLE"


@query(
    "minprob_imputation",
    "J7",
    f"""WITH c AS (SELECT sample, quantile_cont(log2_abundance, 0.01) AS q FROM logs GROUP BY sample),
f AS (SELECT DISTINCT protein, feature FROM logs),
w AS (SELECT coalesce(quantile_cont(sd, 0.5), 0) AS w FROM (SELECT stddev_samp(log2_abundance) AS sd FROM logs GROUP BY protein, feature) WHERE sd IS NOT NULL)
SELECT f.protein, f.feature, c.sample,
  round(coalesce(l.log2_abundance, c.q + w * sqrt(-2 * ln({unit_draw(1)})) * cos(2 * pi() * {unit_draw(2)})), 6) AS log2_abundance,
  CASE WHEN l.log2_abundance IS NULL THEN 'imputed' ELSE 'observed' END AS provenance
FROM f CROSS JOIN c CROSS JOIN w LEFT JOIN logs l ON l.protein = f.protein AND l.feature = f.feature AND l.sample = c.sample""",
    ("logs",),
)
def _(t: Tables) -> DataFrame:
    out = normalize.impute(t.view("logs"), "MinProb")
    return out.withColumn("log2_abundance", F.round("log2_abundance", 6)).select("protein", "feature", "sample", "log2_abundance", "provenance")


# ----------------------------------------------------------------- summarisation

for _method, _agg in (("sum", "sum"), ("mean", "avg")):

    @query(
        f"summary_{_method}",
        "J9",
        f"SELECT protein, sample, round({_agg}(log2_abundance), 5) AS log2_abundance FROM logs GROUP BY ALL",
        ("logs",),
    )
    def _(t: Tables, method: str = _method) -> DataFrame:
        out = summarize.summarize(t.view("logs"), method)
        return out.withColumn("log2_abundance", F.round("log2_abundance", 5))


SWEEPS_SQL = {"medianPolish": (fits.POLISH, "polished"), "linear": (fits.LINEAR, "fitted"), "robustSummary": (fits.ROBUST, "fitted")}

for _method in SWEEPS_SQL:

    @query(
        f"summary_{_method}",
        {"medianPolish": "J10 J9", "linear": "J11", "robustSummary": "J9"}[_method],
        f"WITH {SWEEPS_SQL[_method][0].format(source='logs', digits=5)} SELECT * FROM {SWEEPS_SQL[_method][1]}",
        ("logs",),
    )
    def _(t: Tables, method: str = _method) -> DataFrame:
        out = summarize.summarize(t.view("logs"), method)
        return out.withColumn("log2_abundance", F.round("log2_abundance", 5))


@query(
    "summary_top_features",
    "J10 F12",
    f"""WITH m AS (SELECT protein, feature, avg(log2_abundance) AS v FROM logs GROUP BY ALL),
best AS (SELECT protein, feature FROM (SELECT *, row_number() OVER (PARTITION BY protein ORDER BY round(v, 9) DESC, feature) AS rn FROM m) WHERE rn <= 3),
chosen AS (SELECT logs.* FROM logs JOIN best USING (protein, feature)), {fits.polished_or_median('chosen')} SELECT * FROM summary""",
    ("logs",),
)
def _(t: Tables) -> DataFrame:
    out = summarize.summarize_tmp(t.view("logs"), subset="topN", n_top=3)
    return out.withColumn("log2_abundance", F.round("log2_abundance", 5))


@query("censored_imputation", "J12")
def _(t: Tables) -> DataFrame:
    return summarize.impute_censored(t.view("logs"))


# ------------------------------------------------------------------------ models

CONTRAST_ROWS = [
    ("A_vs_N", "A", 1.0), ("A_vs_N", "N", -1.0), ("R_vs_N", "R", 1.0), ("R_vs_N", "N", -1.0),
    ("A+R_vs_N", "A", 0.5), ("A+R_vs_N", "R", 0.5), ("A+R_vs_N", "N", -1.0),
]
CONTRAST_SQL = "(VALUES " + ", ".join(f"('{c}', '{g}', {w}::DOUBLE)" for c, g, w in CONTRAST_ROWS) + ") AS k(comparison_id, condition, weight)"
GROUP_FIT = """means AS (SELECT protein, condition, count(*) AS n, avg(level) AS m, coalesce(var_samp(level), 0) * (count(*) - 1) AS ss FROM levels GROUP BY ALL),
pooled AS (SELECT protein, sum(ss) / nullif(sum(n) - count(*), 0) AS v, CAST(sum(n) - count(*) AS DOUBLE) AS df FROM means GROUP BY protein)"""


def contrast_frame(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(CONTRAST_ROWS, "comparison_id string, condition string, weight double")


@query(
    "group_mean_fit",
    "J18",
    f"""WITH {GROUP_FIT} SELECT means.protein, condition, n, round(m, 6) AS mean, round(v, 6) AS variance, df
FROM means JOIN pooled USING (protein)""",
    ("levels",),
)
def _(t: Tables) -> DataFrame:
    out = fit.fit_group_means(t.view("levels"))
    return out.select(
        "protein", "condition", "n", F.round("mean", 6).alias("mean"),
        F.round(F.col("variance") + 0.0, 6).alias("variance"), "df",
    )


@query(
    "group_mean_contrasts",
    "J18 J20",
    f"""WITH {GROUP_FIT}, x AS (SELECT protein, comparison_id, sum(weight * m) AS fc, sum(weight * weight / n) AS s, count(*) AS found
  FROM means JOIN {CONTRAST_SQL} USING (condition) GROUP BY ALL),
need AS (SELECT comparison_id, count(*) AS terms FROM {CONTRAST_SQL} GROUP BY 1)
SELECT protein, comparison_id, round(fc, 6) AS log2_fold_change, round(sqrt(v * s), 6) AS standard_error, df,
  CASE WHEN sqrt(v * s) > 1e-9 THEN round(fc / sqrt(v * s), 4) END AS statistic
FROM x JOIN pooled USING (protein) JOIN need USING (comparison_id) WHERE found = terms""",
    ("levels",),
)
def _(t: Tables) -> DataFrame:
    out = fit.contrast_group_means(fit.fit_group_means(t.view("levels")), contrast_frame(t), pvalues=False)
    return out.select(
        "protein", "comparison_id", F.round(F.col("log2_fold_change") + 0.0, 6).alias("log2_fold_change"),
        F.round("standard_error", 6).alias("standard_error"), "df",
        F.when(F.col("standard_error") > 1e-9, F.round("statistic", 4)).alias("statistic"),
    )


def tests_shown(tests: DataFrame) -> DataFrame:
    """Tests in comparable digits; a vanishing error makes t and p a matter of the last bit."""
    sure = F.col("standard_error") > 1e-6
    zero = lambda c: F.col(c) + F.lit(0.0)
    return tests.select(
        "protein", "comparison_id", F.round(zero("log2_fold_change"), 5).alias("log2_fold_change"),
        F.round(zero("standard_error"), 5).alias("standard_error"), F.round("df", 4).alias("df"),
        F.when(sure, F.round(zero("statistic"), 3)).alias("statistic"), F.when(sure, F.round("p_value", 5)).alias("p_value"),
    )


GROUP_MODEL = f"""{GROUP_FIT}, coefficient AS (SELECT protein, condition AS g, m, 1 / n AS inverse FROM means),
model AS (SELECT protein, sqrt(v) AS sigma, df FROM pooled)"""


@query(
    "group_mean_tests",
    "J18 J20 F7",
    f"WITH {GROUP_MODEL}, {fits.contrasts('model', CONTRAST_SQL)} {fits.SHOWN}",
    ("levels",),
)
def _(t: Tables) -> DataFrame:
    return tests_shown(fit.contrast_group_means(fit.fit_group_means(t.view("levels")), contrast_frame(t)))


@query(
    "group_mean_adjusted",
    "J18 F7",
    f"WITH {GROUP_MODEL}, {fits.contrasts('model', CONTRAST_SQL)} SELECT protein, comparison_id, round(adjusted, 5) AS adjusted_p_value FROM test WHERE se > 1e-6",
    ("levels",),
)
def _(t: Tables) -> DataFrame:
    tests = fit.contrast_group_means(fit.fit_group_means(t.view("levels")).where("variance > 1e-10"), contrast_frame(t))
    return tests.select("protein", "comparison_id", F.round("adjusted_p_value", 5).alias("adjusted_p_value"))


@query(
    "robust_model_tests",
    "J17 J20 J21 J22",
    f"WITH {fits.HUBER}, {fits.PRIOR}, {fits.contrasts('tested', CONTRAST_SQL, flat=True)} {fits.SHOWN}",
    ("levels",),
)
def _(t: Tables) -> DataFrame:
    levels = t.view("levels")
    fits = cut_lineage(fit.fit_models(levels))
    return tests_shown(fit.contrast_models(fits, contrast_frame(t), moderated=True, flat=fit.zero_variance(levels)))


@query(
    "moderated_variance",
    "J21 J17",
    f"WITH {fits.HUBER}, {fits.PRIOR} SELECT m.protein, round(m.sigma, 5) AS sigma, round(m.df, 4) AS df, round(t.sigma, 5) AS test_sigma, round(t.df, 3) AS test_df FROM model m JOIN tested t USING (protein)",
    ("levels",),
)
def _(t: Tables) -> DataFrame:
    found = fit.moderate_variance(cut_lineage(fit.fit_models(t.view("levels"))))
    digits = {"sigma": 5, "df": 4, "test_sigma": 5, "test_df": 3}
    return found.select("protein", *[F.round(F.col(c) + F.lit(0.0), d).alias(c) for c, d in digits.items()])


@query(
    "batch_model_tests",
    "J17 J20",
    f"WITH {fits.BATCHED}, {fits.contrasts('model', CONTRAST_SQL, tilted=True)} {fits.SHOWN}",
    ("levels",),
)
def _(t: Tables) -> DataFrame:
    fits = cut_lineage(fit.fit_models(t.view("levels"), robust=False, use_batch=True))
    return tests_shown(fit.contrast_models(fits, contrast_frame(t)))


@query(
    "zero_variance_proteins",
    "J22",
    "SELECT protein FROM levels GROUP BY protein HAVING var_samp(level) < 1e-10",
    ("levels",),
)
def _(t: Tables) -> DataFrame:
    return fit.zero_variance(t.view("levels"))


@query(
    "batch_effect_removed",
    "J16",
    f"""WITH {fits.BATCHED} SELECT protein, sample, g AS condition, batch,
  round(y - shift * (second - CASE WHEN count(DISTINCT batch) OVER (PARTITION BY protein) > 1 THEN 0.5 ELSE 0 END), 5) AS level FROM marked JOIN solved USING (protein)""",
    ("levels",),
)
def _(t: Tables) -> DataFrame:
    return fit.remove_batch_effect(t.view("levels")).withColumn("level", F.round("level", 5))


ADJUST = {
    "bh": "min(p_value * m / r) OVER (PARTITION BY comparison_id, result_layer ORDER BY p_value DESC, k DESC)",
    "holm": "max(p_value * (m - r + 1)) OVER (PARTITION BY comparison_id, result_layer ORDER BY p_value, k)",
    "bonferroni": "p_value * m",
    "by": "min(p_value * m / r * h) OVER (PARTITION BY comparison_id, result_layer ORDER BY p_value DESC, k DESC)",
}
for _method, _formula in ADJUST.items():

    @query(
        f"adjusted_pvalues_{_method}",
        "F7",
        f"""WITH r AS (SELECT comparison_id, result_layer, protein_accession AS k, p_value,
  row_number() OVER (PARTITION BY comparison_id, result_layer ORDER BY p_value, protein_accession) AS r,
  count(*) OVER (PARTITION BY comparison_id, result_layer) AS m FROM diff WHERE p_value IS NOT NULL),
h AS (SELECT comparison_id, result_layer, sum(1.0::DOUBLE / r) AS h FROM r GROUP BY ALL),
a AS (SELECT comparison_id, result_layer, k, {_formula} AS adj FROM r JOIN h USING (comparison_id, result_layer))
SELECT d.comparison_id, d.result_layer, d.protein_accession, CASE WHEN adj IS NOT NULL THEN round(least(adj, 1.0), 7) END AS adjusted
FROM diff d LEFT JOIN a ON a.comparison_id = d.comparison_id AND a.result_layer = d.result_layer AND a.k = d.protein_accession""",
        ("diff",),
    )
    def _(t: Tables, method: str = _method) -> DataFrame:
        out = ranking.adjust_pvalues(t.view("diff"), ["comparison_id", "result_layer"], "p_value", method, "adjusted")
        return out.select("comparison_id", "result_layer", "protein_accession", F.round("adjusted", 7).alias("adjusted"))


# ---------------------------------------------------------------- result tables


@query(
    "canonical_results",
    "P8 B11",
    """SELECT Label AS comparison_id, Protein AS protein_accession, Gene AS gene_name,
  CASE WHEN isfinite(TRY_CAST(log2FC AS DOUBLE)) THEN TRY_CAST(log2FC AS DOUBLE) END AS log2_fold_change,
  CASE WHEN isfinite(TRY_CAST(pvalue AS DOUBLE)) THEN TRY_CAST(pvalue AS DOUBLE) END AS p_value,
  adj_pvalue AS adjusted_p_value, SE AS standard_error, NULL::DOUBLE AS statistic, NULL::BIGINT AS psm_count,
  'protein' AS result_layer, 'dia' AS pipeline FROM raw_results""",
    ("raw_results",),
)
def _(t: Tables) -> DataFrame:
    return artifacts.canonical_results(t.view("raw_results").drop("result_layer"), "protein", "dia")


@query(
    "filled_annotations",
    "D8",
    """WITH c AS (SELECT 'P' || CAST(l_partkey AS VARCHAR) AS p, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1),
g AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS p, min(p_brand) AS b FROM part GROUP BY 1)
SELECT comparison_id, result_layer, protein_accession, coalesce(psm_count, c.n) AS psm_count, coalesce(gene_name, g.b) AS gene_name
FROM diff LEFT JOIN c ON c.p = protein_accession LEFT JOIN g ON g.p = protein_accession""",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    psms = t.table("lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("ProteinName"), F.col("l_orderkey").alias("PSM")
    )
    genes = t.table("part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ProteinAccession"), F.col("p_brand").alias("Gene")
    )
    out = artifacts.fill_annotations(t.view("diff"), psms, genes)
    return out.select("comparison_id", "result_layer", "protein_accession", "psm_count", "gene_name")


@query(
    "comparison_catalog",
    "E18 P8",
    """WITH p AS (SELECT comparison_id, count(*) AS t, count(*) FILTER (WHERE adjusted_p_value < 0.05) AS s FROM diff
  WHERE result_layer = 'protein' GROUP BY 1),
n AS (SELECT condition, count(*) AS n FROM (SELECT DISTINCT sample, condition FROM levels) GROUP BY 1)
SELECT c.comparison_id, display_label, group1_label, group2_label, comparison_order,
  coalesce(t, 0) AS tested_count, coalesce(s, 0) AS significant_count,
  CASE WHEN coalesce(t, 0) > 0 THEN 'complete' ELSE 'missing' END AS result_status,
  coalesce(a.n, 0) AS group1_sample_count, coalesce(b.n, 0) AS group2_sample_count
FROM catalog c LEFT JOIN p USING (comparison_id) LEFT JOIN n a ON a.condition = group1_label LEFT JOIN n b ON b.condition = group2_label""",
    ("diff", "catalog", "levels"),
)
def _(t: Tables) -> DataFrame:
    samples = t.view("levels").select("sample", "condition").distinct()
    return artifacts.comparison_catalog(t.view("diff"), t.view("catalog"), samples)


@query(
    "layer_union",
    "H1",
    """SELECT comparison_id, protein_accession, result_layer, log2_fold_change, p_value FROM diff WHERE result_layer = 'protein'
UNION ALL SELECT comparison_id, protein_accession, result_layer, log2_fold_change, NULL FROM diff WHERE result_layer = 'ptm'""",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    rows = t.view("diff").select("comparison_id", "protein_accession", "result_layer", "log2_fold_change", "p_value")
    return artifacts.union_layers(
        rows.where(F.col("result_layer") == "protein"), rows.where(F.col("result_layer") == "ptm").drop("p_value")
    )


@query(
    "feature_provenance",
    "E9",
    """SELECT protein_accession, sample_id, result_layer, count(*) FILTER (WHERE provenance = 'observed') AS observed_feature_count,
  count(*) FILTER (WHERE provenance = 'imputed') AS imputed_feature_count,
  round(count(*) FILTER (WHERE provenance = 'imputed') / nullif(count(*) FILTER (WHERE provenance IN ('observed', 'imputed')), 0), 9) AS imputation_fraction
FROM peptides GROUP BY ALL""",
    ("peptides",),
)
def _(t: Tables) -> DataFrame:
    out = artifacts.feature_provenance(t.view("peptides"))
    return out.withColumn("imputation_fraction", F.round("imputation_fraction", 9))


@query(
    "annotated_provenance",
    "D5 P7",
    """WITH c AS (SELECT protein_accession, sample_id, result_layer, count(*) FILTER (WHERE provenance = 'observed') AS o,
  count(*) FILTER (WHERE provenance = 'imputed') AS i FROM peptides GROUP BY ALL)
SELECT p.protein_accession, p.sample_id, p.provenance, p.processed_log2_abundance, coalesce(o, 0) AS observed_feature_count,
  coalesce(i, 0) AS imputed_feature_count, round(CASE WHEN o + i > 0 THEN i / (o + i) END, 9) AS imputation_fraction
FROM plong p LEFT JOIN c USING (protein_accession, sample_id, result_layer)""",
    ("plong", "peptides"),
)
def _(t: Tables) -> DataFrame:
    out = artifacts.annotate_provenance(t.view("plong"), t.view("peptides"))
    return out.select(
        "protein_accession", "sample_id", "provenance", "processed_log2_abundance", "observed_feature_count",
        "imputed_feature_count", F.round("imputation_fraction", 9).alias("imputation_fraction"),
    )


SAMPLES = """samples AS (SELECT DISTINCT sample_id, condition, replicate, batch, sample_order FROM plong),
known AS (SELECT * FROM (VALUES ('R', 0), ('A', 1)) AS v(condition, k)),
ranks AS (SELECT condition, row_number() OVER (ORDER BY k NULLS LAST, f) - 1 AS condition_order FROM
  (SELECT condition, min(sample_order) AS f FROM samples GROUP BY 1) LEFT JOIN known USING (condition)),
cat AS (SELECT s.sample_id, s.condition, s.replicate, s.batch, s.sample_order, r.condition_order FROM samples s JOIN ranks r USING (condition))"""


def sample_frame(t: Tables) -> DataFrame:
    samples = t.view("plong").select("sample_id", "condition", "replicate", "batch", "sample_order").distinct()
    orders = t.spark.createDataFrame([("R", 0), ("A", 1)], "condition string, condition_order int")
    return artifacts.sample_catalog(samples, orders)


@query("sample_catalog", "P5", f"WITH {SAMPLES} SELECT * FROM cat", ("plong",))
def _(t: Tables) -> DataFrame:
    return sample_frame(t)


@query(
    "protein_abundance_table",
    "P5",
    f"""WITH {SAMPLES} SELECT p.protein_accession, p.gene_name, cat.sample_id, cat.condition, cat.replicate, cat.batch,
  p.processed_log2_abundance, p.provenance, 0::BIGINT AS observed_feature_count, 0::BIGINT AS imputed_feature_count,
  NULL::DOUBLE AS imputation_fraction, 'tmt' AS pipeline, 'protein' AS result_layer, cat.sample_order, cat.condition_order
FROM plong p JOIN cat USING (sample_id)""",
    ("plong",),
)
def _(t: Tables) -> DataFrame:
    return artifacts.protein_abundance(t.view("plong"), sample_frame(t), "tmt")


@query(
    "peptide_catalog_join",
    "D6 P6",
    f"""WITH {SAMPLES} SELECT p.protein_accession, p.peptide_id, p.sample_id, cat.condition, coalesce(p.replicate, cat.replicate) AS replicate,
  cat.batch, p.processed_log2_abundance, p.provenance, p.result_layer, cat.sample_order, cat.condition_order
FROM peptides p LEFT JOIN cat ON cat.sample_id = p.sample_id""",
    ("plong", "peptides"),
)
def _(t: Tables) -> DataFrame:
    return artifacts.with_catalog(t.view("peptides"), sample_frame(t))


@query(
    "peptide_feature_rows",
    "P6",
    f"""WITH {SAMPLES} SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS protein_accession, NULL::VARCHAR AS gene_name, 'PEP' || CAST(l_partkey AS VARCHAR) AS peptide_id,
  l_returnflag || '_' || CAST(l_linenumber AS VARCHAR) AS sample_id, l_returnflag AS condition, CAST(l_linenumber AS VARCHAR) AS replicate,
  NULL::VARCHAR AS batch, CASE WHEN l_quantity > 40 THEN l_tax ELSE l_extendedprice END AS processed_log2_abundance,
  CASE WHEN l_quantity > 40 OR l_linestatus = 'O' THEN 'imputed' ELSE 'observed' END AS provenance, 'ptm' AS pipeline, 'ptm' AS result_layer,
  cat.sample_order, cat.condition_order
FROM lineitem LEFT JOIN cat ON cat.sample_id = l_returnflag || '_' || CAST(l_linenumber AS VARCHAR)""",
    ("plong",),
)
def _(t: Tables) -> DataFrame:
    rows = t.table("lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ProteinName"),
        F.concat(F.lit("Sabc|PEP"), F.col("l_partkey").cast("string")).alias("PeptideSequence"),
        F.concat("l_returnflag", F.lit("_"), F.col("l_linenumber").cast("string")).alias("BioReplicate"),
        F.col("l_returnflag").alias("Condition"),
        F.col("l_extendedprice").alias("log2Intensity"),
        F.when(F.col("l_quantity") > 40, F.col("l_tax")).alias("predicted"),
        (F.col("l_linestatus") == "O").alias("censored"),
    )
    return artifacts.peptide_abundance(rows, sample_frame(t), "ptm", "ptm")


@query(
    "summarized_layer_table",
    "P5 H1",
    """WITH s AS (SELECT protein, sample, condition, round(level, 6) AS level, layer, split_part(sample, '_', 2) AS replicate FROM levels, (VALUES ('protein'), ('ptm')) AS v(layer)),
c AS (SELECT sample, condition, row_number() OVER (ORDER BY condition, sample) - 1 AS sample_order FROM (SELECT DISTINCT sample, condition FROM levels)),
o AS (SELECT condition, row_number() OVER (ORDER BY min(sample_order)) - 1 AS condition_order FROM c GROUP BY condition)
SELECT protein AS protein_accession, s.sample AS sample_id, s.condition, s.replicate, level AS processed_log2_abundance, layer AS result_layer,
  sample_order, condition_order, CASE WHEN TRY_CAST(substr(protein, 2) AS INTEGER) % 2 = 0 THEN 'G' || protein END AS gene_name
FROM s JOIN c USING (sample) JOIN o ON o.condition = s.condition""",
    ("levels",),
)
def _(t: Tables) -> DataFrame:
    levels = t.view("levels")
    rows = levels.select(
        F.col("protein").alias("Protein"), F.col("sample").alias("BioReplicate"), F.col("condition").alias("Condition"),
        F.round("level", 6).alias("Abundance"),
    )
    even = levels.where("cast(substr(protein, 2) as int) % 2 = 0").select(
        F.col("protein").alias("ProteinAccession"), F.concat(F.lit("G"), "protein").alias("Gene")
    ).distinct()
    out = artifacts.summarized_abundance({"protein": rows, "ptm": rows}, "ptm", even)
    return out.select(
        "protein_accession", "sample_id", "condition", "replicate", "processed_log2_abundance", "result_layer",
        "sample_order", "condition_order", "gene_name",
    )


