"""Quality-control aggregates over the canonical tables."""

from __future__ import annotations

import math
from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from omicspark.functions.expressions import finite
from omicspark.functions.ranking import exact_quantiles, same_keys
from omicspark.session import cut_lineage

ABUNDANCE = "processed_log2_abundance"
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
FENCE = 1.5


def _share(part: str, other: str) -> Column:
    total = F.col(part) + F.col(other)
    return F.when(total > 0, F.col(part) / total)


def qc_sample_metrics(proteins: DataFrame) -> DataFrame:
    """Counts, provenance shares and spread of each sample of the protein layer."""
    rows = proteins.where(F.col("result_layer") == "protein")
    counts = rows.groupBy("sample_id").agg(
        F.min("condition").alias("condition"),
        F.min("replicate").alias("replicate"),
        F.min("batch").alias("batch"),
        F.min("sample_order").alias("sample_order"),
        F.count(F.lit(1)).alias("total_feature_count"),
        F.count(ABUNDANCE).alias("present_count"),
        F.count_if(F.col(ABUNDANCE).isNull()).alias("missing_count"),
        F.sum("observed_feature_count").alias("observed_feature_count"),
        F.sum("imputed_feature_count").alias("imputed_feature_count"),
        F.min(ABUNDANCE).alias("abundance_min"),
        F.max(ABUNDANCE).alias("abundance_max"),
    ).withColumn("imputation_fraction", _share("imputed_feature_count", "observed_feature_count"))
    spread = exact_quantiles(
        rows, ["sample_id"], ABUNDANCE,
        {"abundance_q1": 0.25, "median_log2_abundance": 0.5, "abundance_q3": 0.75},
    )
    return same_keys(counts, spread, ["sample_id"], "left")


def _by_group(df: DataFrame, extra: Sequence[str]) -> DataFrame:
    """Each row once per grouping: by condition, and by batch where it has one."""
    batch = F.struct(F.lit("batch").alias("group_by"), F.col("batch").cast("string").alias("group_value"))
    condition = F.struct(
        F.lit("condition").alias("group_by"), F.col("condition").cast("string").alias("group_value")
    )
    pairs = F.when(F.col("batch").isNotNull(), F.array(condition, batch)).otherwise(F.array(condition))
    return df.select(F.explode(pairs).alias("__g"), *extra).select("__g.group_by", "__g.group_value", *extra)


def lognormal_cv(sd_log2: Column) -> Column:
    """CV in percent of a log-normal value from the standard deviation of its log2."""
    return F.sqrt(F.exp(F.pow(sd_log2 * math.log(2.0), F.lit(2.0))) - 1) * 100


def cv_values(df: DataFrame, group: Sequence[str], feature: Sequence[str], value: str) -> DataFrame:
    """CV of each feature in each group with at least two finite values."""
    rows = df.where(finite(value).isNotNull())
    spread = rows.groupBy(*group, *feature).agg(F.stddev_samp(value).alias("sd"), F.count(F.lit(1)).alias("n"))
    return spread.where(F.col("n") >= 2).select(*group, *feature, lognormal_cv(F.col("sd")).alias("cv"))


def cv_summary(df: DataFrame, group: Sequence[str], feature: Sequence[str], value: str, prefix: str) -> DataFrame:
    """Count and quartiles of the finite CVs of each group."""
    cvs = cv_values(df, group, feature, value)
    names = {f"{prefix}_cv_{n}": q for n, q in QUARTILES.items()}
    return exact_quantiles(cvs, group, "cv", names, count_name=f"{prefix}_cv_count")


def qc_group_metrics(proteins: DataFrame, peptides: DataFrame) -> DataFrame:
    """Abundance spread, provenance and CV quartiles per condition and per batch."""
    group = ["group_by", "group_value"]
    rows = proteins.where(F.col("result_layer") == "protein")
    kept = ["sample_id", "protein_accession", ABUNDANCE, "observed_feature_count",
            "imputed_feature_count", "condition_order"]
    grouped = _by_group(rows, kept)
    counts = grouped.groupBy(*group).agg(
        F.countDistinct("sample_id").alias("sample_count"),
        F.count(ABUNDANCE).alias("observation_count"),
        F.sum("observed_feature_count").alias("observed_count"),
        F.sum("imputed_feature_count").alias("imputed_count"),
        F.count_if(F.col(ABUNDANCE).isNull()).alias("missing_count"),
        F.min("condition_order").alias("condition_order"),
        F.min(ABUNDANCE).alias("min_val"),
        F.max(ABUNDANCE).alias("max_val"),
    )
    # One row per condition or batch by now.
    rank = F.dense_rank().over(Window.partitionBy("group_by").orderBy("group_value"))
    counts = counts.withColumn(
        "group_order",
        F.when(F.col("group_by") == "batch", rank).otherwise(F.col("condition_order")).cast("bigint"),
    ).drop("condition_order")
    spread = exact_quantiles(grouped, group, ABUNDANCE, QUARTILES)
    protein_cv = cv_summary(grouped, group, ["protein_accession"], ABUNDANCE, "protein")
    per_sample = (
        peptides.where((F.col("result_layer") == "protein") & F.col(ABUNDANCE).isNotNull())
        .groupBy("protein_accession", "peptide_id", "sample_id")
        .agg(F.min("condition").alias("condition"), F.min("batch").alias("batch"), F.avg(ABUNDANCE).alias("abundance"))
    )
    peptide_rows = _by_group(per_sample, ["protein_accession", "peptide_id", "abundance"])
    peptide_cv = cv_summary(peptide_rows, group, ["protein_accession", "peptide_id"], "abundance", "peptide")
    out = same_keys(counts, spread, group, "left")
    out = same_keys(out, protein_cv, group, "left")
    out = same_keys(out, peptide_cv, group, "left")
    reach = FENCE * (F.col("q3") - F.col("q1"))
    return out.withColumn("lowerfence", F.greatest(F.col("q1") - reach, F.col("min_val"))).withColumn(
        "upperfence", F.least(F.col("q3") + reach, F.col("max_val"))
    )


def box_stats(
    df: DataFrame, by: Sequence[str], value: str, clamp: bool = True, write_targets: bool = False
) -> DataFrame:
    """Quartiles, fences and counts of the finite values per group.

    Clamped fences stop at the smallest and largest value; ``write_targets`` is that of ``exact_quantiles``.
    """
    rows = df.select(*by, finite(value).alias("__x")).where(F.col("__x").isNotNull())
    ends = rows.groupBy(*by).agg(
        F.min("__x").alias("lowest"), F.max("__x").alias("highest"), F.count(F.lit(1)).alias("value_count")
    )
    spread = exact_quantiles(rows, by, "__x", QUARTILES, write_targets=write_targets)
    out = same_keys(ends, spread, list(by))
    reach = FENCE * (F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - reach, F.col("q3") + reach
    if clamp:
        low, high = F.greatest(low, F.col("lowest")), F.least(high, F.col("highest"))
    return out.withColumn("lowerfence", low).withColumn("upperfence", high).drop("lowest", "highest")


def box_outliers(
    df: DataFrame, by: Sequence[str], value: str, max_outliers: int = 20, clamp: bool = True
) -> DataFrame:
    """The values farthest outside the fences, at most ``max_outliers`` per group."""
    fences = box_stats(df, by, value, clamp).select(*by, "lowerfence", "upperfence")
    rows = df.select(*by, finite(value).alias("outlier")).where(F.col("outlier").isNotNull())
    joined = same_keys(rows, fences, list(by))
    far = F.greatest(F.col("lowerfence") - F.col("outlier"), F.col("outlier") - F.col("upperfence"))
    outside = joined.withColumn("distance", far).where(F.col("distance") > 0)
    # The row_number limit is applied per input partition before the shuffle.
    order = Window.partitionBy(*by).orderBy(F.col("distance").desc(), F.col("outlier"))
    ranked = outside.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_outliers)
    return ranked.select(*by, "outlier", "distance", "rank")


def psm_cv(psms: DataFrame) -> DataFrame:
    """CV box statistics per condition from summed positive abundances per replicate."""
    summed = (
        psms.where(F.col("Abundance") > 0)
        .groupBy("Unique_PSM", "Condition", "Replicate")
        .agg(F.log2(F.sum("Abundance")).alias("log2_abundance"))
    )
    return _cv_boxes(summed, "Condition", ["Unique_PSM"], "log2_abundance")


def protein_cv_wide(long: DataFrame) -> DataFrame:
    """CV box statistics per condition from log2 protein values (protein, condition, level)."""
    return _cv_boxes(long, "condition", ["protein"], "level")


def _cv_boxes(df: DataFrame, group: str, feature: list[str], value: str) -> DataFrame:
    cvs = cv_values(df, [group], feature, value)
    boxes = box_stats(cvs, [group], "cv")
    invalid = cvs.groupBy(group).agg(F.count_if(finite("cv").isNull()).alias("invalid_count"))
    return same_keys(boxes, invalid, [group])


def psm_completeness(peptides: DataFrame) -> DataFrame:
    """Distinct peptides present and missing per sample and layer."""
    totals = peptides.groupBy("result_layer").agg(F.countDistinct("peptide_id").alias("psm_total_count"))
    present = peptides.groupBy("sample_id", "condition", "result_layer").agg(
        F.countDistinct(F.when(F.col(ABUNDANCE).isNotNull(), F.col("peptide_id"))).alias("psm_present_count")
    )
    out = present.join(totals, "result_layer")
    return out.withColumn("psm_missing_count", F.col("psm_total_count") - F.col("psm_present_count"))


def completeness_by_sample(df: DataFrame, feature: str, sample: str, present: Column) -> DataFrame:
    """Present and missing distinct features of each sample."""
    # Read for the samples and for the total: what both need is written once.
    df = cut_lineage(df.select(sample, feature, present.alias("__present")))
    present = F.col("__present")
    seen = df.groupBy(sample).agg(F.countDistinct(F.when(present, F.col(feature))).alias("present"))
    total = df.agg(F.countDistinct(feature)).scalar()
    return seen.withColumn("total", total).withColumn("missing", F.col("total") - F.col("present"))


def psm_intensity(peptides: DataFrame) -> DataFrame:
    """Intensity quartiles per layer, condition and replicate (the sample id without one)."""
    rows = peptides.where(F.col(ABUNDANCE).isNotNull()).withColumn(
        "__rep", F.coalesce("replicate", "sample_id")
    )
    keys = ["result_layer", "condition", "__rep"]
    counts = rows.groupBy(*keys).agg(F.countDistinct("sample_id").alias("sample_count"))
    spread = exact_quantiles(rows, keys, ABUNDANCE, QUARTILES)
    return same_keys(counts, spread, keys, "left").withColumnRenamed("__rep", "replicate")


def with_group_median(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Each row with the exact median of its group."""
    return same_keys(df, exact_quantiles(df, by, value, {out: 0.5}), list(by), "left")


def normalized_intensity(psms: DataFrame) -> DataFrame:
    """Log2 box statistics per condition and replicate after scaling to a common median.

    The common median is the median of the sample medians over rows, so it is
    taken from the samples weighted by their row counts. Only the measures are
    needed, and several times: they are written once, without names.
    """
    keys = ["Condition", "Replicate"]
    psms = cut_lineage(psms.select(*keys, "Abundance"))
    counts = psms.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    medians = exact_quantiles(psms, keys, "Abundance", {"__m": 0.5}, write_targets=True)
    samples = same_keys(medians, counts, keys)
    # One row per sample: running row counts find the two middle rows.
    order = Window.orderBy("__m", *keys)
    everything = Window.partitionBy()
    samples = samples.withColumn("__end", F.sum("__rows").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    samples = samples.withColumn("__n", F.sum("__rows").over(everything))
    at_low = F.floor((F.col("__n") - 1) / 2)
    at_high = F.ceil((F.col("__n") - 1) / 2)

    def level(spot: Column) -> Column:
        hit = (F.col("__end") > spot) & (F.col("__end") - F.col("__rows") <= spot)
        return F.max(F.when(hit, F.col("__m"))).over(everything)

    samples = samples.withColumn("__global", (level(at_low) + level(at_high)) / 2)
    # Written, it is known to be small, so rows are not brought together by sample.
    joined = same_keys(psms, cut_lineage(samples.select(*keys, "__m", "__global")), keys)
    scaled = F.when(
        F.col("Abundance") > 0, F.log2(F.col("Abundance") * (F.col("__global") / F.col("__m")))
    )
    return box_stats(joined.withColumn("log2_value", scaled), keys, "log2_value", write_targets=True)


def pvalue_histogram(differential: DataFrame, bins: int = 20, by: Sequence[str] = ("comparison_id",)) -> DataFrame:
    """Counts of p-values in equal bins of [0, 1]; empty bins are present."""
    rows = differential.where(F.col("p_value").between(0, 1))
    index = F.least(F.floor(F.col("p_value") * bins), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy(*by, index.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    groups = differential.select(*by).distinct()
    grid = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = same_keys(grid, counts, [*by, "bin"], "left")
    return out.withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))


def diff_summary(differential: DataFrame, by: Sequence[str] = ("comparison_id",), p_cut: float = 0.05) -> DataFrame:
    """Totals, significant, up, down, tested and failed rows."""
    hit = F.col("adjusted_p_value") < p_cut
    return differential.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(hit).alias("significant"),
        F.count_if(hit & (F.col("log2_fold_change") > 0)).alias("upregulated"),
        F.count_if(hit & (F.col("log2_fold_change") < 0)).alias("downregulated"),
        F.count("p_value").alias("tested"),
        F.count_if(F.col("p_value").isNull()).alias("failed"),
    )


def psm_summary(psms: DataFrame) -> DataFrame:
    """Distinct PSMs, and their mean number per sample to one decimal."""
    total = psms.agg(F.countDistinct("Unique_PSM").alias("total_psms"))
    per_sample = (
        psms.where(F.col("Unique_PSM").isNotNull())
        .groupBy("Condition", "Replicate")
        .agg(F.countDistinct("Unique_PSM").alias("n"))
        .agg(F.round(F.avg("n"), 1).alias("avg_psms_per_sample"))
    )
    return _beside(total, per_sample)


def _beside(*one_row_frames: DataFrame) -> DataFrame:
    """One-row aggregates next to each other, the later ones as scalar subqueries."""
    out = one_row_frames[0]
    for frame in one_row_frames[1:]:
        for name in frame.columns:
            out = out.withColumn(name, frame.select(name).scalar())
    return out


def qc_summary(
    proteins: DataFrame, sample_metrics: DataFrame, group_metrics: DataFrame, psms: DataFrame | None = None
) -> DataFrame:
    """The headline figures of a run, in one row."""
    total = proteins.where(F.col("result_layer") == "protein").agg(
        F.countDistinct("protein_accession").alias("total_proteins")
    )
    samples = sample_metrics.agg(
        F.coalesce(F.floor(F.avg("present_count")), F.lit(0)).cast("bigint").alias("avg_proteins_per_sample"),
        F.round(
            F.try_divide(F.sum("present_count").cast("double"), F.sum("total_feature_count").cast("double")) * 100, 1
        ).alias("completeness_rate"),
    )
    spread = group_metrics.where(F.col("group_by") == "condition").agg(
        F.round(F.avg("protein_cv_median"), 1).alias("average_protein_cv"),
        F.round(F.avg("peptide_cv_median"), 1).alias("average_psm_cv"),
    )
    parts = [total, samples, spread]
    if psms is not None:
        parts.append(psm_summary(psms))
    return _beside(*parts).withColumn("average_cv", F.col("average_protein_cv"))


def site_levels(sites: DataFrame) -> DataFrame:
    """(protein, sample, condition, level): mean log2 of each site and sample."""
    value = F.col("NormalizedAbundance").cast("double")
    rows = sites.select(
        F.col("ProteinName").alias("protein"),
        F.col("Condition").alias("condition"),
        F.concat_ws("_", F.col("Condition"), F.col("Replicate").cast("string")).alias("sample"),
        F.when(value > 0, F.log2(value)).alias("v"),
    )
    return rows.groupBy("protein", "sample", "condition").agg(F.avg("v").alias("level"))


def ptm_qc(
    sites: DataFrame, psms: DataFrame, results: DataFrame, only: Collection[str] | None = None
) -> dict[str, DataFrame]:
    """QC tables of a site study, or ``only`` those named; ``psms`` is the 11-column feature table."""
    levels = site_levels(sites)
    sample = F.concat_ws("_", F.col("Condition"), F.col("Replicate").cast("string"))
    value = F.col("NormalizedAbundance").cast("double")
    seen = F.coalesce(~F.col("Imputed") & (value > 0), F.lit(False))
    long = psms.select(
        F.col("PSM").alias("Unique_PSM"),
        "Condition",
        F.element_at(F.split("BioReplicate", "_"), -1).alias("Replicate"),
        F.col("Intensity").alias("Abundance"),
    )
    long = long.withColumn("Sample", F.concat_ws("_", "Condition", "Replicate"))
    tables = {
        "site_cv": lambda: protein_cv_wide(levels),
        "psm_cv": lambda: psm_cv(long),
        "site_completeness": lambda: completeness_by_sample(
            sites.withColumn("Sample", sample), "ProteinName", "Sample", seen
        ),
        "psm_completeness": lambda: completeness_by_sample(
            long, "Unique_PSM", "Sample", F.coalesce(F.col("Abundance") > 0, F.lit(False))
        ),
        "intensity": lambda: normalized_intensity(long),
        "site_intensity": lambda: box_stats(levels, ["sample"], "level"),
        "pvalues": lambda: pvalue_histogram(results),
        "levels": lambda: levels,
    }
    return {name: make() for name, make in tables.items() if only is None or name in only}
