"""Log transform, normalisation and imputation of feature tables.

Feature tables are long: ``protein``, ``feature``, ``sample`` and a value.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from omicspark.functions.ranking import (
    exact_quantiles,
    finite,
    value_counts_before,
    same_keys,
)
from omicspark.session import cut_lineage

FEATURE = ["protein", "feature"]


def log2_features(df: DataFrame, duplicates: str = "sum", value: str = "abundance") -> DataFrame:
    """One log2 value per protein, feature and sample; zero becomes missing."""
    if duplicates not in {"sum", "max"}:
        raise ValueError("duplicates are 'sum' or 'max'")
    pick = F.sum if duplicates == "sum" else F.max
    merged = df.groupBy(*FEATURE, "sample").agg(pick(F.col(value).cast("double")).alias("__v"))
    return merged.select(
        *FEATURE, "sample", F.when(F.col("__v") > 0, F.log2("__v")).alias("log2_abundance")
    ).where(F.col("log2_abundance").isNotNull())


def sample_center(df: DataFrame, statistic: str, value: str = "log2_abundance") -> DataFrame:
    """(sample, center): exact median or mean of each sample."""
    if statistic == "median":
        return exact_quantiles(df, ["sample"], value, {"center": 0.5})
    return df.groupBy("sample").agg(F.avg(finite(value)).alias("center"))


def normalize(df: DataFrame, method: str = "center.median", value: str = "log2_abundance") -> DataFrame:
    """Sample normalisation: center.median, center.mean, div.median, quantiles or none."""
    if method == "none":
        return df
    if method in {"center.median", "center.mean", "div.median"}:
        centers = sample_center(df, "mean" if method == "center.mean" else "median", value)
        joined = df.join(centers, "sample")
        shifted = (
            F.try_divide(F.col(value), F.col("center"))
            if method == "div.median"
            else F.col(value) - F.col("center")
        )
        return joined.withColumn(value, shifted).select(*df.columns)
    if method == "quantiles":
        return normalize_quantiles(df, value)
    raise ValueError(f"unknown normalization: {method}")


def normalize_quantiles(df: DataFrame, value: str = "log2_abundance") -> DataFrame:
    """Every sample gets the mean sorted profile; equal values share the mean of their ranks.

    A sample with gaps is stretched first: its sorted values are interpolated
    to as many places as the table has features, so every place of the profile
    is a mean over all samples, and its values are read back at their relative
    ranks. Ranks are counted per distinct value, so no sample is sorted by one
    task and a value that many features share is one row.
    """
    total = df.select(*FEATURE).distinct().count()
    counts = value_counts_before(df, ["sample"], value)
    # A value takes the ranks from __p to __end.
    placed = cut_lineage(
        counts.select(
            "sample", F.col(value).cast("double").alias("__v"), F.col("n_before").alias("__p"),
            (F.col("n_before") + F.col("n_equal") - 1).alias("__end"), F.col("n_total").alias("__size"),
        )
    )
    last, gaps = F.lit(max(total - 1, 0)), F.col("__size") - 1
    following = placed.select("sample", (F.col("__p") - 1).alias("__end"), F.col("__v").alias("__next"))
    steps = placed.join(following, ["sample", "__end"], "left").withColumn("__next", F.coalesce("__next", "__v"))
    # Place j lies between the ranks p and end + 1 where p * last <= j * gaps < (end + 1) * last.
    first = F.when(gaps == 0, F.lit(0)).otherwise(F.ceil(F.col("__p") * last / gaps))
    until = F.when((gaps == 0) | (F.col("__end") == gaps), last).otherwise(F.ceil((F.col("__end") + 1) * last / gaps) - 1)
    steps = steps.withColumn("__first", first.cast("bigint")).withColumn("__until", until.cast("bigint"))
    spread = steps.where("__until >= __first").withColumn("__j", F.explode(F.sequence("__first", "__until")))
    beyond = F.greatest(F.col("__j") * gaps / last - F.col("__end"), F.lit(0.0))
    into = F.when((gaps == 0) | (last == 0), 0.0).otherwise(beyond)
    profile = spread.groupBy("__j").agg(F.avg(F.col("__v") + into * (F.col("__next") - F.col("__v"))).alias("__m"))
    profile = cut_lineage(profile)
    ahead = profile.select((F.col("__j") - 1).alias("__j"), F.col("__m").alias("__m1"))
    profile = profile.join(ahead, "__j", "left").withColumn("__m1", F.coalesce("__m1", "__m"))
    at = F.when(gaps == 0, last / 2).otherwise((F.col("__p") + F.col("__end")) / 2 * last / gaps)
    ranks = placed.withColumn("__at", at).withColumn("__j", F.floor("__at").cast("bigint"))
    read = F.col("__m") + (F.col("__at") - F.col("__j")) * (F.col("__m1") - F.col("__m"))
    new = ranks.join(profile, "__j").select("sample", F.col("__v").alias(value), read.alias("__new"))
    joined = same_keys(df, new, ["sample", value])
    return joined.withColumn(value, F.col("__new")).select(*df.columns)


def normalization_coefficients(pre: DataFrame, post: DataFrame, value: str = "log2_abundance") -> DataFrame:
    """Log2 shift and linear factor of each sample's median."""
    a = sample_center(pre, "median", value).withColumnRenamed("center", "__pre")
    b = sample_center(post, "median", value).withColumnRenamed("center", "__post")
    shift = F.col("__pre") - F.col("__post")
    return a.join(b, "sample").select(
        F.col("sample").alias("Sample"),
        shift.alias("Log2Shift"),
        F.pow(F.lit(2.0), shift).alias("LinearFactor"),
    )


def equalize_medians(df: DataFrame, value: str = "log2_abundance") -> DataFrame:
    """Shift every run so that its median equals the median of the run medians."""
    centers = sample_center(df, "median", value)
    # One row per run, so the window over all of them is small.
    common = F.percentile("center", 0.5).over(Window.partitionBy())
    # Written, it is known to be small, so the rows are not brought together by run.
    shifts = cut_lineage(centers.select("sample", (F.col("center") - common).alias("__shift")))
    joined = df.join(shifts, "sample")
    return joined.withColumn(value, F.col(value) - F.col("__shift")).select(*df.columns)


def global_standards(df: DataFrame, standards: list[str], value: str = "log2_abundance") -> DataFrame:
    """Shift every run so that the mean level of the named standards agrees."""
    chosen = df.where(F.col("protein").isin(standards) | F.col("feature").isin(standards))
    medians = chosen.groupBy("sample").agg(F.avg(finite(value)).alias("center"))
    common = F.percentile("center", 0.5).over(Window.partitionBy())
    shifts = medians.select("sample", (F.col("center") - common).alias("__shift"))
    joined = df.join(shifts, "sample", "left")
    shifted = F.col(value) - F.coalesce(F.col("__shift"), F.lit(0.0))
    return joined.withColumn(value, shifted).select(*df.columns)


def missing_cells(df: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(protein, feature, sample) cells of the feature x sample matrix without a value.

    A feature lists the numbers of its own samples (as many as the design has),
    so only the gaps become rows; the full grid is never built.
    """
    names = (samples if samples is not None else df).select("sample").where("sample IS NOT NULL").distinct()
    # One row per sample of the design.
    index = cut_lineage(names.withColumn("__at", F.row_number().over(Window.orderBy("sample")) - 1))
    count = index.count()
    have = df.join(index, "sample", "left").groupBy(*FEATURE).agg(F.collect_set("__at").alias("__have"))
    every = F.sequence(F.lit(0), F.lit(count - 1)) if count else F.array().cast("array<int>")
    gaps = have.select(*FEATURE, F.explode(F.array_except(every, F.col("__have"))).alias("__at"))
    return gaps.join(index, "__at").select(*FEATURE, "sample")


def impute(
    df: DataFrame,
    method: str = "none",
    quantile: float = 0.01,
    seed: int = 123,
    value: str = "log2_abundance",
) -> DataFrame:
    """Fill missing cells per sample: MinDet uses a low quantile, MinProb draws around it.

    Adds ``provenance``. MinProb's spread is the median over features of their
    standard deviation; draws depend only on seed, feature and sample.
    """
    observed = df.withColumn("provenance", F.lit("observed"))
    if method == "none":
        return observed
    if method not in {"MinDet", "MinProb"}:
        raise ValueError(f"unknown imputation: {method}")
    floors = exact_quantiles(df, ["sample"], value, {"__floor": quantile})
    filled = missing_cells(df).join(floors, "sample")
    level = F.col("__floor")
    if method == "MinProb":
        spread = df.groupBy(*FEATURE).agg(F.stddev_samp(value).alias("sd")).where("sd is not null")
        width = exact_quantiles(spread, [], "sd", {"w": 0.5}).first()
        width = float(width["w"]) if width and width["w"] is not None else 0.0
        level = level + F.lit(width) * hashed_normal(seed, *FEATURE, "sample")
    filled = filled.withColumn(value, level).withColumn("provenance", F.lit("imputed"))
    rest = [c for c in observed.columns if c not in filled.columns]
    filled = filled.select(*[c for c in filled.columns if c in observed.columns])
    return observed.unionByName(filled, allowMissingColumns=bool(rest))


def hashed_normal(seed: int, *keys: str):
    """Standard normal draw fixed by its keys (Box-Muller on 52 bits each of two MD5 digests)."""

    def unit(salt: int):
        digest = F.md5(F.concat_ws("\x1f", F.lit(f"{seed}:{salt}"), *[F.col(k).cast("string") for k in keys]))
        return (F.conv(F.left(digest, F.lit(13)), 16, 10).cast("double") + 1) / float(2**52 + 1)

    return F.sqrt(F.lit(-2.0) * F.log(unit(1))) * F.cos(F.lit(2 * math.pi) * unit(2))


def provenance(pre: DataFrame, post: DataFrame, value: str = "log2_abundance") -> DataFrame:
    """missing / imputed / observed for every processed cell."""
    before = pre.select(*FEATURE, "sample", F.col(value).alias("__pre"))
    joined = same_keys(post, before, [*FEATURE, "sample"], "left")
    return joined.withColumn(
        "provenance",
        F.when(F.col(value).isNull(), "missing").when(F.col("__pre").isNull(), "imputed").otherwise("observed"),
    ).drop("__pre")


