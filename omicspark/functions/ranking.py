"""Exact order statistics that never put a whole group into one task.

A group may hold a third of all rows, so ``percentile`` (which keeps every
distinct value of a group in one aggregation buffer) and a plain window over
the group are both out. Everything here first counts values in bins whose
number is monotone in the value. The histogram of a group is small, so its
running sum is a cheap window; only rows inside one bin are ever ordered
together. Places of rows come from ranges of the whole order, counted one by
one. Results are exact: bins decide where a value lies, never its value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from omicspark.session import cut_lineage

BINS_PER_OCTAVE = 256


def finite(column: Column | str) -> Column:
    """NaN and infinities become null; ``None`` stays null."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def order_bin(column: Column) -> Column:
    """Whole number that never decreases as the finite double increases."""
    c = column.cast("double")
    # Every octave has its bins, down to the smallest double, so tiny values do not meet in one.
    size = F.floor((F.log2(F.abs(c)) + F.lit(1076.0)) * F.lit(BINS_PER_OCTAVE))
    return F.when(c == 0, F.lit(0)).otherwise((F.signum(c) * size).cast("bigint")).cast("bigint")


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` that also matches null with null; keeps the left keys."""
    if not keys:
        raise ValueError("at least one key is needed")
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    )
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__r_{k}" for k in keys])


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if keys:
        return df, list(keys)
    return df.withColumn("__all", F.lit(0)), ["__all"]


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    count_name: str | None = None,
    write_targets: bool = False,
) -> DataFrame:
    """Linear-interpolation quantiles of the finite values of each group.

    One row per group that has at least one finite value. Two scans of the
    value column, a shuffle of histogram rows, and a shuffle of only the rows
    that share a bin with a wanted position. With ``write_targets``, for rows
    that are cheap to read twice, the few wanted bins are written first: their
    size is known then, so rows stay where they are and only counts travel.
    """
    rows, by = _keyed(df, keys)
    rows = rows.select(*by, finite(value).alias("__v")).where(F.col("__v").isNotNull())
    rows = rows.withColumn("__b", order_bin(F.col("__v")))
    histogram = rows.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__c"))
    group = Window.partitionBy(*by)
    running = group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    histogram = histogram.select(
        *by,
        "__b",
        "__c",
        F.coalesce(F.sum("__c").over(running), F.lit(0)).alias("__start"),
        F.sum("__c").over(group).alias("__n"),
    )
    spots = {}
    for name, q in quantiles.items():
        at = (F.col("__n") - 1) * F.lit(float(q))
        spots[name] = (F.floor(at), F.ceil(at), at - F.floor(at))

    def holds(spot: Column, start: Column, size: Column) -> Column:
        return (spot >= start) & (spot < start + size)

    wanted = reduce(
        lambda a, b: a | b,
        [
            holds(spot, F.col("__start"), F.col("__c"))
            for low, high, _ in spots.values()
            for spot in (low, high)
        ],
    )
    targets = histogram.where(wanted).select(*by, "__b", "__start", "__n")
    if write_targets:
        targets = cut_lineage(targets)
    near = same_keys(rows, targets, [*by, "__b"])
    values = near.groupBy(*by, "__b", "__start", "__n", "__v").agg(F.count(F.lit(1)).alias("__c"))
    inside = (
        Window.partitionBy(*by, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    )
    values = values.withColumn(
        "__from", F.col("__start") + F.coalesce(F.sum("__c").over(inside), F.lit(0))
    )
    picked = []
    for name, (low, high, _) in spots.items():
        for side, spot in (("lo", low), ("hi", high)):
            hit = holds(spot, F.col("__from"), F.col("__c"))
            picked.append(F.max(F.when(hit, F.col("__v"))).alias(f"__{name}_{side}"))
    found = values.groupBy(*by).agg(F.max("__n").alias("__n"), *picked)
    out = [F.col(k) for k in keys]
    if count_name:
        out.append(F.col("__n").alias(count_name))
    for name, (_, _, part) in spots.items():
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        out.append((lo + (hi - lo) * part).alias(name))
    return found.select(*out)


def value_counts_before(
    df: DataFrame, keys: Sequence[str], value: str, descending: bool = False
) -> DataFrame:
    """Per distinct (group, value): how many rows come before, equal it, exist.

    Columns: keys, value, ``n_before``, ``n_equal``, ``n_total`` and the bin
    ``__b``. Null values are left out.
    """
    rows, by = _keyed(df, keys)
    rows = rows.select(*by, F.col(value)).where(F.col(value).isNotNull())
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_equal"))
    sign = -1 if descending else 1
    counts = counts.withColumn("__b", order_bin(F.col(value)) * sign)
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = (
        Window.partitionBy(*by, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = counts.withColumn("__in", F.coalesce(F.sum("n_equal").over(inside), F.lit(0)))
    group = Window.partitionBy(*by)
    running = group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    histogram = (
        counts.groupBy(*by, "__b")
        .agg(F.sum("n_equal").alias("__c"))
        .select(
            *by,
            "__b",
            F.coalesce(F.sum("__c").over(running), F.lit(0)).alias("__start"),
            F.sum("__c").over(group).alias("n_total"),
        )
    )
    joined = same_keys(counts, histogram, [*by, "__b"])
    return joined.select(
        *[F.col(k) for k in keys],
        F.col(value),
        (F.col("__start") + F.col("__in")).alias("n_before"),
        "n_equal",
        "n_total",
        "__b",
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Ascending ranks from 1; tied values share the mean of their ranks."""
    if not keys:
        raise ValueError("average_ranks needs a grouping key")
    counts = value_counts_before(df, keys, value).select(
        *keys, value, (F.col("n_before") + (F.col("n_equal") + 1) / 2).alias(out)
    )
    return same_keys(df, counts, [*keys, value])


def positions(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tie: str,
    out: str = "position",
    descending: bool = True,
    total: str | None = None,
) -> DataFrame:
    """0-based place of each row in its group, by ``value`` then ``tie`` ascending; ``total`` names the group's size.

    Rows are dealt into ranges of (group, value, tie), with a hash of the row behind them, so neither a group nor
    a value that a third of the rows share lies in one task. Each range is ordered by itself and written; the
    counts of the ranges, one row per range and group, give where a range begins.
    """
    rows, by = _keyed(df, keys)
    rows = rows.where(F.col(value).isNotNull())
    order = [F.col(k).asc_nulls_first() for k in by]
    order.append(F.col(value).desc() if descending else F.col(value).asc())
    order.append(F.col(tie).cast("string").asc_nulls_first())
    order.append(F.xxhash64(*df.columns).asc())
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The number of a row holds that of its range and its place there; written, both stay what they are.
    ordered = cut_lineage(ordered.withColumn("__id", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("__part", F.shiftright("__id", 33))
    parts = ordered.groupBy(*by, "__part").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__c"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *by,
        "__part",
        (F.col("__first") - F.coalesce(F.sum("__c").over(earlier), F.lit(0))).alias("__zero"),
        F.sum("__c").over(group).alias("__n"),
    )
    placed = same_keys(ordered, cut_lineage(parts), [*by, "__part"])
    placed = placed.withColumn(out, (F.col("__id") - F.col("__zero")).cast("bigint"))
    if total:
        placed = placed.withColumn(total, F.col("__n"))
    return placed.drop("__id", "__part", "__zero", "__n", "__all")


def running_total(
    df: DataFrame, keys: Sequence[str], position: str, amount: Column, out: str, width: int = 65536
) -> DataFrame:
    """Running sum of ``amount`` up to and including each whole-number position.

    Positions are cut into blocks of ``width``; block totals are summed over
    the few blocks of a group and added to the sum inside the block.
    """
    rows, by = _keyed(df, keys)
    rows = rows.withColumn("__w", F.floor(F.col(position) / width)).withColumn("__a", amount)
    blocks = rows.groupBy(*by, "__w").agg(F.sum("__a").alias("__t"))
    before = (
        Window.partitionBy(*by).orderBy("__w").rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = blocks.select(
        *by, "__w", F.coalesce(F.sum("__t").over(before), F.lit(0.0)).alias("__before")
    )
    inside = (
        Window.partitionBy(*by, "__w")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = same_keys(rows, blocks, [*by, "__w"])
    summed = joined.withColumn(out, F.col("__before") + F.sum("__a").over(inside))
    return summed.drop("__w", "__a", "__before", "__all")


def adjust_pvalues(
    df: DataFrame,
    by: Sequence[str],
    p: str = "p_value",
    method: str = "BH",
    out: str = "adjusted_p_value",
) -> DataFrame:
    """Multiple-testing correction per group; null p-values are neither ranked nor counted."""
    method = method.lower()
    if method not in {"bh", "fdr", "by", "holm", "bonferroni", "none"}:
        raise ValueError(f"unknown adjustment: {method}")
    if method == "none":
        return df.withColumn(out, F.col(p))
    rows, keys = _keyed(df.drop(out), by)
    counts = value_counts_before(rows, keys, p)
    m = F.col("n_total").cast("double")
    last = F.col("n_before") + F.col("n_equal")
    if method == "bonferroni":
        raw = F.col(p) * m
    elif method == "holm":
        raw = F.col(p) * (m - F.col("n_before"))
    else:
        raw = F.col(p) * m / last
        if method == "by":
            raw = raw * _harmonic(F.col("n_total"))
    counts = counts.withColumn("__raw", raw)
    if method == "bonferroni":
        adjusted = counts.withColumn("__adj", F.col("__raw"))
    else:
        # Step-up methods take the smallest value from here upwards, Holm the
        # largest from here downwards: inside the bin, then across bins.
        up = method != "holm"
        pick = F.min if up else F.max
        inside = Window.partitionBy(*keys, "__b").orderBy(F.col(p))
        across = Window.partitionBy(*keys).orderBy("__b")
        if up:
            inside = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
            across = across.rowsBetween(1, Window.unboundedFollowing)
        else:
            inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            across = across.rowsBetween(Window.unboundedPreceding, -1)
        bins = (
            counts.groupBy(*keys, "__b")
            .agg(pick("__raw").alias("__edge"))
            .select(*keys, "__b", pick("__edge").over(across).alias("__other"))
        )
        adjusted = same_keys(counts, bins, [*keys, "__b"])
        adjusted = adjusted.withColumn("__here", pick("__raw").over(inside))
        combine = F.least if up else F.greatest
        adjusted = adjusted.withColumn("__adj", combine(F.col("__here"), F.col("__other")))
    adjusted = adjusted.select(*keys, p, F.least(F.col("__adj"), F.lit(1.0)).alias(out))
    return same_keys(rows, adjusted, [*keys, p], "left").drop("__all")


def _harmonic(n: Column) -> Column:
    """Sum of 1/i for i = 1..n: exact terms up to 64, then the asymptotic series."""
    small = F.aggregate(
        F.sequence(F.lit(1), F.least(n, F.lit(64)).cast("int")),
        F.lit(0.0),
        lambda acc, i: acc + F.lit(1.0) / i,
    )
    x = n.cast("double")
    gamma = 0.5772156649015329
    large = F.log(x) + gamma + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    return F.when(n <= 64, small).otherwise(large)
