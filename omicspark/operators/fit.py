"""Per-protein linear models, contrasts, variance moderation, batch effects.

Protein levels are long: ``protein``, ``sample``, ``condition``, optionally
``batch`` and ``level`` (log2). A protein has at most one row per sample, so a
grouped-map task never holds more rows than the design has samples.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omicspark.functions.grouped import Columns, encoded, map_batches, map_keys
from omicspark.functions.ranking import adjust_pvalues, same_keys
from omicspark.functions.special import (
    digamma,
    digamma_number,
    t_pvalue,
    trigamma,
    trigamma_inverse,
)
from omicspark.session import cut_lineage

LEVEL = "level"
ZERO_VARIANCE = 1e-10
HUBER_K = 1.345
#: The unscaled covariance of coefficients i and j is inverse[i] where i = j, plus shifts[i] . shifts[j]:
#: a number per condition and, with batches, one more per batch.
FIT_SCHEMA = (
    "protein string, conditions array<string>, coef array<double>, inverse array<double>, "
    "shifts array<array<double>>, sigma double, df double, n bigint"
)


def one_row_per_sample(df: DataFrame) -> DataFrame:
    """Mean level per protein and sample; the bound every grouped fit relies on."""
    others = [c for c in ("condition", "batch") if c in df.columns]
    rows = df.where(F.col(LEVEL).isNotNull() & ~F.isnan(LEVEL))
    return rows.groupBy("protein", "sample").agg(
        *[F.min(c).alias(c) for c in others], F.avg(LEVEL).alias(LEVEL)
    )


# --------------------------------------------------------- closed-form group means


def group_means(df: DataFrame, condition: str = "condition") -> DataFrame:
    """Count, mean and corrected sum of squares per protein and condition."""
    rows = df.where(F.col(LEVEL).isNotNull() & ~F.isnan(LEVEL))
    return rows.groupBy("protein", F.col(condition).alias("condition")).agg(
        F.count(LEVEL).alias("n"),
        F.avg(LEVEL).alias("mean"),
        (F.var_pop(LEVEL) * F.count(LEVEL)).alias("ss"),
    )


def fit_group_means(df: DataFrame, covariates: list[str] | None = None) -> DataFrame:
    """Group means with the pooled variance and residual df of their protein.

    ``covariates`` name the columns whose sorted combination is the group.
    """
    if covariates:
        df = df.withColumn("condition", F.concat_ws("_", *[F.col(c).cast("string") for c in sorted(covariates)]))
    means = group_means(df)
    pooled = means.groupBy("protein").agg(
        F.sum("ss").alias("ss_all"),
        (F.sum("n") - F.count(F.lit(1))).cast("double").alias("df"),
    )
    pooled = pooled.select(
        "protein", F.when(F.col("df") > 0, F.col("ss_all") / F.col("df")).alias("variance"), "df"
    )
    return same_keys(means, pooled, ["protein"])


def contrast_group_means(
    fits: DataFrame, contrasts: DataFrame, adjust: str = "BH", pvalues: bool = True
) -> DataFrame:
    """Effect, error, t, df and p per protein and comparison.

    A protein that lacks a group of the comparison has no row. The join makes
    one row per protein and contrast term, which is the size of the answer.
    """
    terms = contrasts.groupBy("comparison_id").agg(F.count(F.lit(1)).alias("terms"))
    weighted = contrasts.join(terms, "comparison_id")
    joined = fits.join(weighted, "condition")
    w = F.col("weight")
    summed = joined.groupBy("protein", "comparison_id").agg(
        F.sum(w * F.col("mean")).alias("log2_fold_change"),
        F.sum(w * w / F.col("n")).alias("spread"),
        F.count(F.lit(1)).alias("found"),
        F.max("terms").alias("terms"),
        F.max("variance").alias("variance"),
        F.max("df").alias("df"),
    ).where(F.col("found") == F.col("terms"))
    out = summed.select(
        "protein",
        "comparison_id",
        "log2_fold_change",
        F.sqrt(F.col("variance") * F.col("spread")).alias("standard_error"),
        "df",
    )
    out = out.withColumn("statistic", F.try_divide(F.col("log2_fold_change"), F.col("standard_error")))
    if not pvalues:
        return out
    # The correction reads its input twice, so the tests are written once.
    out = cut_lineage(out.withColumn("p_value", t_pvalue(F.col("statistic"), F.col("df"))))
    return adjust_pvalues(out, ["comparison_id"], "p_value", adjust)


# ----------------------------------------------------------------- robust models


@dataclass
class Groups:
    """Rows by condition and, if asked for, by batch, as codes; no design matrix is built."""

    condition: np.ndarray
    names: np.ndarray
    batch: np.ndarray | None = None
    batches: int = 0

    @classmethod
    def of(cls, conditions: np.ndarray, batches: np.ndarray | None = None) -> Groups:
        codes, names = pd.factorize(conditions, sort=True)
        if batches is None:
            return cls(codes, names)
        batch, found = pd.factorize(batches, sort=True)
        return cls(codes, names, batch, len(found))

    def solve(self, y: np.ndarray, w: np.ndarray) -> Solution:
        """Weighted least squares of condition means and batch shifts from the first batch.

        Conditions are solved for the batches, so only a batch x batch matrix is decomposed.
        """
        k = len(self.names)
        total = np.bincount(self.condition, w, k)
        inverse = np.divide(1.0, total, out=np.zeros(k), where=total > 0)
        mean = inverse * np.bincount(self.condition, w * y, k)
        rank = int((total > 0).sum())
        if self.batch is None:
            return Solution(mean, np.zeros(0), inverse, np.zeros((k, 0)), rank)
        b = self.batches
        cross = np.bincount(self.condition * b + self.batch, w, k * b).reshape(k, b)[:, 1:]
        share = inverse[:, None] * cross
        rest = np.diag(np.bincount(self.batch, w, b)[1:]) - cross.T @ share
        right = np.bincount(self.batch, w * y, b)[1:] - cross.T @ mean
        values, vectors = np.linalg.eigh(rest) if b > 1 else (np.zeros(0), np.zeros((0, 0)))
        keep = values > max(total.max(initial=0.0), 1e-300) * 1e-10
        root = vectors[:, keep] / np.sqrt(values[keep])
        shift = root @ (root.T @ right)
        return Solution(mean - share @ shift, shift, inverse, share @ root, rank + int(keep.sum()))

    def fitted(self, solution: Solution) -> np.ndarray:
        out = solution.coef[self.condition]
        return out if self.batch is None else out + np.concatenate([[0.0], solution.shift])[self.batch]


@dataclass
class Solution:
    coef: np.ndarray
    shift: np.ndarray
    inverse: np.ndarray
    shifts: np.ndarray
    rank: int


def _middle(values: np.ndarray) -> float:
    ordered = np.sort(values)
    return float(ordered[(len(ordered) - 1) // 2] + ordered[len(ordered) // 2]) / 2


def huber_fit(
    groups: Groups, y: np.ndarray, robust: bool = True, rounds: int = 10, tolerance: float = 1e-6
) -> tuple[Solution, float, float]:
    """Solution, sigma and residual df of an M-estimate."""
    w = np.ones(len(y))
    found = groups.solve(y, w)
    if robust:
        for _ in range(rounds):
            rest = y - groups.fitted(found)
            scale = _middle(np.abs(rest - _middle(rest))) / 0.6745
            if not np.isfinite(scale) or scale < 1e-12:
                break
            size = np.abs(rest) / scale
            w = np.where(size <= HUBER_K, 1.0, HUBER_K / np.maximum(size, 1e-300))
            new = groups.solve(y, w)
            moved = max(np.abs(new.coef - found.coef).max(), np.abs(new.shift - found.shift).max(initial=0.0))
            found = new
            if moved < tolerance:
                break
    freedom = float(w.sum() - found.rank)
    rest = y - groups.fitted(found)
    sigma = math.sqrt(float((w * rest**2).sum()) / freedom) if freedom > 0 else math.nan
    return found, sigma, freedom


def fit_models(df: DataFrame, robust: bool = True, max_rounds: int = 10, use_batch: bool = False) -> DataFrame:
    """One model per protein: condition means, with batch shifts where asked for.

    Cache or write the result: it is fitted once and tested for every contrast.
    Ten rounds of weights are the method's definition. Plain means need no
    rounds, so the proteins of a batch are fitted together.
    """
    if not robust and not use_batch:
        return map_batches(one_row_per_sample(df), "protein", ["condition", LEVEL], _plain_means, FIT_SCHEMA)

    def run(protein: str, columns: Columns) -> Columns:
        groups = Groups.of(columns["condition"], columns["batch"] if use_batch else None)
        found, sigma, freedom = huber_fit(groups, columns[LEVEL], robust, max_rounds)
        return {
            "protein": [protein],
            "conditions": [list(groups.names)],
            "coef": [found.coef.tolist()],
            "inverse": [found.inverse.tolist()],
            "shifts": [found.shifts.tolist()],
            "sigma": [None if math.isnan(sigma) else sigma],
            "df": [freedom],
            "n": [len(columns[LEVEL])],
        }

    columns = ["condition", LEVEL] + (["batch"] if use_batch else [])
    return map_keys(one_row_per_sample(df), "protein", columns, run, FIT_SCHEMA)


def _plain_means(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``huber_fit`` without weights or batches, of all proteins of a batch."""
    protein, proteins = encoded(batch.column(0))
    condition, conditions = encoded(batch.column(1), ordered=True)
    y = batch.column(2).to_numpy(zero_copy_only=False)
    pair, group = np.unique(protein * len(conditions) + condition, return_inverse=True)
    owner, size = pair // len(conditions), len(proteins)
    inverse = 1.0 / np.bincount(group, minlength=len(pair))
    mean = inverse * np.bincount(group, y, len(pair))
    n, groups = np.bincount(protein, minlength=size), np.bincount(owner, minlength=size)
    freedom = (n - groups).astype(float)
    squares = np.bincount(protein, (y - mean[group]) ** 2, size)
    sigma = np.sqrt(np.divide(squares, freedom, out=np.full(size, np.nan), where=freedom > 0))
    ends = pa.array(np.concatenate([[0], np.cumsum(groups)]), pa.int32())
    listed = lambda values: pa.ListArray.from_arrays(ends, values)
    none = pa.ListArray.from_arrays(pa.array(np.zeros(len(pair) + 1), pa.int32()), pa.array([], pa.float64()))
    columns = [
        proteins, listed(conditions.take(pa.array(pair % len(conditions)))), listed(pa.array(mean)), listed(pa.array(inverse)),
        listed(none), pa.array(sigma, mask=np.isnan(sigma)), pa.array(freedom), pa.array(n, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["protein", "conditions", "coef", "inverse", "shifts", "sigma", "df", "n"])


def zero_variance(df: DataFrame) -> DataFrame:
    """Proteins whose levels do not vary."""
    return (
        df.groupBy("protein")
        .agg(F.var_samp(LEVEL).alias("v"))
        .where(F.col("v") < ZERO_VARIANCE)
        .select("protein")
    )


def contrast_models(
    fits: DataFrame, contrasts: DataFrame, adjust: str = "BH", moderated: bool = False,
    flat: DataFrame | None = None,
) -> DataFrame:
    """Test every comparison on fitted models; ``flat`` proteins get effect 0 and no test."""
    if moderated:
        fits = moderate_variance(fits)
    else:
        fits = fits.withColumn("test_sigma", F.col("sigma")).withColumn("test_df", F.col("df"))
    terms = contrasts.groupBy("comparison_id").agg(F.count(F.lit(1)).alias("terms"))
    weighted = contrasts.join(terms, "comparison_id")
    spread = fits.select(
        "protein", "test_sigma", "test_df", F.explode(F.arrays_zip("conditions", "coef", "inverse", "shifts")).alias("z")
    ).select("protein", "test_sigma", "test_df", F.col("z.conditions").alias("condition"), "z.coef", "z.inverse", "z.shifts")
    joined = spread.join(weighted, "condition")
    w = F.col("weight")
    grouped = joined.groupBy("protein", "comparison_id").agg(
        F.sum(w * F.col("coef")).alias("log2_fold_change"),
        F.sum(w * w * F.col("inverse")).alias("own"),
        # One number per batch for each term of one contrast.
        F.collect_list(F.transform("shifts", lambda v: v * w)).alias("shifted"),
        F.count(F.lit(1)).alias("found"),
        F.max("terms").alias("terms"),
        F.max("test_sigma").alias("s"),
        F.max("test_df").alias("df"),
    ).where(F.col("found") == F.col("terms"))
    summed = F.aggregate(
        "shifted",
        F.transform(F.get("shifted", F.lit(0)), lambda v: v * 0),
        lambda total, part: F.zip_with(total, part, lambda a, b: a + b),
    )
    unscaled = F.col("own") + F.aggregate(summed, F.lit(0.0), lambda total, v: total + v * v)
    out = grouped.select(
        "protein", "comparison_id", "log2_fold_change",
        (F.col("s") * F.sqrt(unscaled)).alias("standard_error"),
        "df",
    )
    out = out.withColumn("statistic", F.try_divide(F.col("log2_fold_change"), F.col("standard_error")))
    out = out.withColumn("p_value", t_pvalue(F.col("statistic"), F.col("df")))
    if flat is not None:
        out = blank_flat(out, flat)
    return adjust_pvalues(cut_lineage(out), ["comparison_id"], "p_value", adjust)


def blank_flat(results: DataFrame, flat: DataFrame) -> DataFrame:
    """Effect 0 and no error, df or p for proteins without variance."""
    marked = results.join(flat.select("protein").distinct().withColumn("__flat", F.lit(True)), "protein", "left")
    hit = F.coalesce("__flat", F.lit(False))
    marked = marked.withColumn("log2_fold_change", F.when(hit, 0.0).otherwise(F.col("log2_fold_change")))
    for name in ("standard_error", "df", "statistic", "p_value", "adjusted_p_value"):
        if name in marked.columns:
            marked = marked.withColumn(name, F.when(~hit, F.col(name)))
    return marked.drop("__flat")


# -------------------------------------------------------------- variance shrinkage


def variance_prior(fits: DataFrame) -> tuple[float, float]:
    """Prior df and variance of the scaled inverse chi-square fitted to log variances.

    Two aggregates give the moments; only these numbers reach the driver.
    """
    half = F.col("df") / 2
    use = fits.where((F.col("df") > 0) & (F.col("sigma") > 0))
    use = use.select(
        (2 * F.log("sigma") - digamma(half) + F.log(half)).alias("e"), trigamma(half).alias("t")
    )
    row = use.agg(F.avg("e").alias("m"), F.var_samp("e").alias("v"), F.avg("t").alias("t"), F.count("e").alias("n")).first()
    if not row["n"]:
        return 0.0, 1.0
    extra = (row["v"] or 0.0) - row["t"]
    if extra <= 0:
        return math.inf, math.exp(row["m"])
    d0 = 2 * trigamma_inverse(extra)
    return d0, math.exp(row["m"] + digamma_number(d0 / 2) - math.log(d0 / 2))


def moderate_variance(fits: DataFrame) -> DataFrame:
    """Posterior sigma and df; columns ``test_sigma`` and ``test_df``."""
    d0, s0 = variance_prior(fits)
    if math.isinf(d0):
        return fits.withColumn("test_sigma", F.lit(math.sqrt(s0))).withColumn("test_df", F.lit(math.inf))
    own = F.when(F.col("df") > 0, F.col("df")).otherwise(0.0)
    square = F.coalesce(F.col("sigma") * F.col("sigma"), F.lit(0.0))
    post = (F.lit(d0 * s0) + own * square) / (F.lit(d0) + own)
    return fits.withColumn("test_sigma", F.sqrt(post)).withColumn("test_df", own + F.lit(d0))


# ------------------------------------------------------------------ batch effects


def remove_batch_effect(df: DataFrame) -> DataFrame:
    """Levels without the batch part of a condition + batch fit; for display only."""

    def run(protein: str, columns: Columns) -> Columns:
        y = columns[LEVEL]
        groups = Groups.of(columns["condition"], columns["batch"])
        shift = np.concatenate([[0.0], groups.solve(y, np.ones(len(y))).shift])
        # Shifts around their mean keep the mean over batches.
        effect = (shift - shift.mean())[groups.batch]
        return {
            "protein": np.repeat(protein, len(y)).astype(object),
            "sample": columns["sample"],
            "condition": columns["condition"],
            "batch": columns["batch"],
            LEVEL: y - effect,
        }

    schema = "protein string, sample string, condition string, batch string, level double"
    return map_keys(one_row_per_sample(df), "protein", ["sample", "condition", "batch", LEVEL], run, schema)


def differential_table(results: DataFrame, layer: str, pipeline: str) -> DataFrame:
    """Test results in the columns of the differential table, non-finite values as null."""
    from omicspark.functions.ranking import finite

    return results.select(
        "comparison_id",
        F.col("protein").alias("protein_accession"),
        F.lit(None).cast("string").alias("gene_name"),
        *[
            finite(c).alias(c)
            for c in ("log2_fold_change", "p_value", "adjusted_p_value", "standard_error", "statistic")
        ],
        F.lit(None).cast("bigint").alias("psm_count"),
        F.lit(layer).alias("result_layer"),
        F.lit(pipeline).alias("pipeline"),
    )
