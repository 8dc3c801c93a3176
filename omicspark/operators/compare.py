"""Comparing comparisons: fold-change matrices, correlation, distance, overlap.

The fold-change table is long: ``feature``, ``comparison``, ``value``, one row
per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from omicspark.functions.ranking import average_ranks, finite

BLOCK = 256
#: Cells of a chunk that a task takes at once, and the size of a dense matrix made of them.
CELLS_AT_ONCE, DENSE_CELLS = 65_536, 1 << 20
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def fold_change_long(
    differential: DataFrame, layer: str = "protein", order: Sequence[Column] = ()
) -> DataFrame:
    """(feature, comparison, value) of finite fold changes; the last row by ``order`` wins.

    Without an order the larger fold change wins, so the result is the same on
    every run.
    """
    rows = differential.where(
        (F.col("result_layer") == layer) & F.col("protein_accession").isNotNull()
    ).withColumn("__v", finite("log2_fold_change"))
    rows = rows.where(F.col("__v").isNotNull())
    by = F.struct(*order) if order else F.col("__v")
    return rows.groupBy(
        F.col("protein_accession").alias("feature"), F.col("comparison_id").alias("comparison")
    ).agg(F.max_by("__v", by).alias("value"))


# ------------------------------------------------------------------ all pairs


class _PairSums:
    """Sums of one block pair, added up from cells that come feature after feature."""

    def __init__(self, same: bool):
        self.same, self.left = same, {}
        self.right = self.left if same else {}
        self.total: dict[str, np.ndarray] = {}
        self.held: list[pd.DataFrame] = []
        self.rows = 0

    def add(self, pdf: pd.DataFrame) -> None:
        self.held.append(pdf)
        self.rows += len(pdf)
        if self.rows >= CELLS_AT_ONCE:
            self.multiply(last=False)

    def multiply(self, last: bool) -> None:
        """Multiply the held features; the newest one may go on and waits unless it is the ``last``."""
        pdf = pd.concat(self.held, ignore_index=True)
        f, names = pd.factorize(pdf["feature"])
        ready = len(names) if last else len(names) - 1
        use = f < ready
        self.held = [pdf[~use]]
        self.rows = len(self.held[0])
        if not ready:
            return
        f, member = f[use], pdf["member"].to_numpy()[use]
        comparison, value = pdf["comparison"].to_numpy(dtype=object)[use], pdf["value"].to_numpy(dtype=float)[use]
        c = np.zeros(len(f), dtype=np.int64)
        for mine, known in ((member == 0, self.left), (member == 1, self.right)):
            codes, found = pd.factorize(comparison[mine])
            c[mine] = np.array([known.setdefault(n, len(known)) for n in found], dtype=np.int64)[codes]
        width = max(len(self.left), len(self.right), 1)
        step = max(1, DENSE_CELLS // width)
        total = {k: np.zeros((len(self.left), len(self.right))) for k in SUMS}
        for k, old in self.total.items():
            total[k][: old.shape[0], : old.shape[1]] = old
        for low in range(0, ready, step):
            at = slice(*np.searchsorted(f, [low, low + step]))
            count = min(step, ready - low)

            def side(which: int, names: int) -> tuple[np.ndarray, np.ndarray]:
                mine = member[at] == which
                place = f[at][mine] - low, c[at][mine]
                x, mask = np.zeros((count, names)), np.zeros((count, names))
                x[place], mask[place] = value[at][mine], 1.0
                return x, mask

            x, mx = side(0, len(self.left))
            y, my = (x, mx) if self.same else side(1, len(self.right))
            total["n"] += mx.T @ my
            total["sx"] += x.T @ my
            total["sy"] += mx.T @ y
            total["sxx"] += (x * x).T @ my
            total["syy"] += mx.T @ (y * y)
            total["sxy"] += x.T @ y
        self.total = total

    def frame(self) -> pd.DataFrame:
        self.multiply(last=True)
        a, b = np.meshgrid(*(np.array(list(x), dtype=object) for x in (self.left, self.right)), indexing="ij")
        keep = (a <= b) if self.same else np.ones(a.shape, dtype=bool)
        keep = keep.astype(bool)
        out = {k: v[keep] for k, v in self.total.items()}
        first, second = a[keep], b[keep]
        swap = (first > second).astype(bool)
        if swap.any():
            first[swap], second[swap] = second[swap], first[swap]
            for one, two in (("sx", "sy"), ("sxx", "syy")):
                out[one][swap], out[two][swap] = out[two][swap].copy(), out[one][swap].copy()
        return pd.DataFrame({"left": first, "right": second, **out})


def _multiplied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial sums of each (bi, bj, chunk); rows come in the order of these and of the feature."""
    group, sums = None, None
    for pdf in frames:
        pdf["member"] = np.where(pdf["b"] == pdf["bi"], 0, 1)
        for key, part in pdf.groupby(["bi", "bj", "chunk"], sort=True):
            if key != group:
                if sums is not None:
                    yield sums.frame()
                group, sums = key, _PairSums(key[0] == key[1])
            sums.add(part[["feature", "comparison", "value", "member"]])
    if sums is not None:
        yield sums.frame()


def pairwise_sums(
    fc: DataFrame, blocks: int | None = None, chunks: int | None = None
) -> DataFrame:
    """(left, right, n, sx, sy, sxx, syy, sxy) over shared features, left <= right.

    Comparisons fall into blocks and features into chunks, ``chunks`` at least;
    a task walks two blocks of one chunk feature by feature, multiplies about
    ``CELLS_AT_ONCE`` cells at a time as small dense matrices, and the partial
    sums add up over chunks. No feature ever lists its pairs of comparisons.
    """
    rows = fc.where(finite("value").isNotNull() & F.col("feature").isNotNull() & F.col("comparison").isNotNull())
    rows = rows.select("feature", "comparison", "value")
    if blocks is None:
        blocks = max(1, math.ceil(rows.agg(F.approx_count_distinct("comparison")).first()[0] * 1.1 / BLOCK))
    # Enough chunks to give every shuffle partition work; what a task holds does not depend on them.
    partitions = int(fc.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(chunks or 1, math.ceil(2 * partitions / (blocks * (blocks + 1))))
    block = F.pmod(F.xxhash64("comparison"), F.lit(blocks)).cast("int")
    chunk = F.pmod(F.xxhash64("feature"), F.lit(chunks)).cast("int")
    placed = rows.select("*", block.alias("b"), chunk.alias("chunk"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")
    spread = placed.select("*", other).select(
        "feature", "comparison", "value", "b", "chunk",
        F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"),
    )
    schema = "left string, right string, " + ", ".join(f"{c} double" for c in SUMS)
    ordered = spread.repartition("bi", "bj", "chunk").sortWithinPartitions("bi", "bj", "chunk", "feature")
    partial = ordered.mapInPandas(_multiplied, schema)
    return partial.groupBy("left", "right").agg(*[F.sum(c).alias(c) for c in SUMS])


def correlation_from_sums(n, sx, sy, sxx, syy, sxy) -> Column:
    """Pearson's r from six sums; null where a side does not vary."""
    a = F.greatest(n * sxx - sx * sx, F.lit(0.0))
    b = F.greatest(n * syy - sy * sy, F.lit(0.0))
    # What is left of a constant side after cancellation counts as zero.
    flat = (a <= 1e-12 * n * sxx) | (b <= 1e-12 * n * syy)
    r = F.try_divide(n * sxy - sx * sy, F.sqrt(a * b))
    return F.when(~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def pairwise_pearson(
    fc: DataFrame, min_support: int = 100, blocks: int | None = None, chunks: int | None = None
) -> DataFrame:
    """(left, right, correlation, support) for left <= right; null below the support."""
    sums = pairwise_sums(fc, blocks, chunks)
    r = correlation_from_sums(*[F.col(c) for c in SUMS])
    return sums.select(
        "left",
        "right",
        F.when(F.col("n") >= min_support, r).alias("correlation"),
        F.col("n").cast("bigint").alias("support"),
    )


def rmsd_matrix(fc: DataFrame, axis: str = "comparison", min_shared: int = 3) -> DataFrame:
    """(left, right, rmsd) of comparisons or of features; null below ``min_shared``."""
    table = fc
    if axis == "feature":
        table = fc.select(F.col("comparison").alias("feature"), F.col("feature").alias("comparison"), "value")
    elif axis != "comparison":
        raise ValueError("axis is 'comparison' or 'feature'")
    sums = pairwise_sums(table).where(F.col("left") < F.col("right"))
    square = F.greatest(F.col("sxx") + F.col("syy") - 2 * F.col("sxy"), F.lit(0.0)) / F.col("n")
    return sums.select(
        "left", "right", F.when(F.col("n") >= min_shared, F.sqrt(square)).alias("rmsd")
    )


def layer_correlation(fc: DataFrame) -> dict[str, DataFrame]:
    """Pairs of a site layer with matched features and r (at least two shared), and availability."""
    pairs = pairwise_pearson(fc, min_support=2).where(F.col("left") < F.col("right"))
    return {
        "pairs": pairs.select("left", "right", F.col("support").alias("matched"), "correlation"),
        "available": fc.groupBy("comparison").agg(F.count("value").alias("features")),
    }


def shared_pairs(fc: DataFrame, a: str, b: str) -> DataFrame:
    """(feature, x, y) of the features both comparisons have."""
    left = fc.where(F.col("comparison") == a).select("feature", F.col("value").alias("x"))
    right = fc.where(F.col("comparison") == b).select("feature", F.col("value").alias("y"))
    return left.join(right, "feature")


def _sums(x: str, y: str) -> list[Column]:
    a, b = F.col(x), F.col(y)
    return [
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(a).alias("sx"), F.sum(b).alias("sy"),
        F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy"),
    ]


def pairwise_spearman(fc: DataFrame, a: str, b: str, min_support: int = 100) -> DataFrame:
    """One row: rank correlation of two comparisons over their shared features."""
    shared = shared_pairs(fc, a, b).withColumn("__k", F.lit(0))
    ranked = average_ranks(shared, ["__k"], "x", "rx")
    ranked = average_ranks(ranked, ["__k"], "y", "ry")
    summed = ranked.agg(*_sums("rx", "ry"))
    r = correlation_from_sums(*[F.col(c) for c in SUMS])
    return summed.select(
        F.lit(a).alias("left"),
        F.lit(b).alias("right"),
        F.when(F.col("n") >= min_support, r).alias("correlation"),
        F.col("n").cast("bigint").alias("support"),
        (F.col("n") >= min_support).alias("sufficient_support"),
    )


# ------------------------------------------------------------------ one against all


def _against(fc: DataFrame, query: str) -> DataFrame:
    """Every feature's values beside the query's; the query has one row per comparison."""
    mine = fc.where(F.col("feature") == query).select("comparison", F.col("value").alias("q"))
    return fc.join(mine, "comparison")


def feature_correlation(fc: DataFrame, query: str, method: str = "pearson", min_shared: int = 3) -> DataFrame:
    """(feature, correlation) of every feature with the query; null below ``min_shared``."""
    beside = _against(fc, query)
    x, y = "value", "q"
    if method == "spearman":
        # A feature has at most one row per comparison, so these windows are short.
        mine = Window.partitionBy("feature")
        for name in (x, y):
            order = mine.orderBy(name)
            ties = Window.partitionBy("feature", name)
            beside = beside.withColumn(
                f"r_{name}", F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2
            )
        x, y = "r_value", "r_q"
    elif method != "pearson":
        raise ValueError(f"unknown method: {method}")
    summed = beside.groupBy("feature").agg(*_sums(x, y))
    r = correlation_from_sums(*[F.col(c) for c in SUMS])
    scored = summed.select(
        "feature",
        F.when(F.col("feature") == query, F.lit(1.0))
        .when(F.col("n") >= min_shared, r)
        .alias("correlation"),
    )
    return fc.select("feature").distinct().join(scored, "feature", "left")


def similar_features(fc: DataFrame, query: str, n: int = 10, min_shared: int = 3) -> DataFrame:
    """The n + 1 nearest features (the query first) and the n farthest, by RMSD."""
    scored = feature_distances(fc, query, min_shared)
    near = scored.orderBy("similarity", F.col("feature") != query, "feature").limit(n + 1)
    near = near.withColumn("side", F.lit("nearest"))
    if scored.limit(n + 2).count() <= n + 1:
        return near
    far = scored.orderBy(F.col("similarity").desc(), F.col("feature").desc()).limit(n)
    return near.unionByName(far.withColumn("side", F.lit("farthest")))


def feature_distances(fc: DataFrame, query: str, min_shared: int = 3) -> DataFrame:
    """(feature, similarity): root mean square distance to the query over shared comparisons."""
    gap = F.pow(F.col("value") - F.col("q"), F.lit(2.0))
    scored = _against(fc, query).groupBy("feature").agg(
        F.sqrt(F.avg(gap)).alias("similarity"), F.count(F.lit(1)).alias("shared")
    )
    kept = scored.where((F.col("shared") >= min_shared) | (F.col("feature") == query))
    return kept.select("feature", "similarity")


# ------------------------------------------------------------------ matrix access


def cell(corr: DataFrame, a: str, b: str) -> DataFrame:
    one, two = sorted([a, b])
    return corr.where((F.col("left") == one) & (F.col("right") == two)).select(
        "left", "right", "correlation", "support", F.col("correlation").isNotNull().alias("sufficient_support")
    )


def neighbours(corr: DataFrame, item: str) -> DataFrame:
    """(comparison, correlation, support) of every other supported comparison."""
    one = corr.where(F.col("left") == item).select(F.col("right").alias("comparison"), "correlation", "support")
    two = corr.where(F.col("right") == item).select(F.col("left").alias("comparison"), "correlation", "support")
    both = one.unionByName(two).where(F.col("comparison") != item)
    return both.where(F.col("correlation").isNotNull())


def nearest_and_least(others: DataFrame, k: int = 10) -> DataFrame:
    """The k most and the k least correlated rows of ``others`` (comparison, correlation, support); ties by name."""
    if k < 1:
        raise ValueError("k is at least 1")
    top = others.orderBy(F.col("correlation").desc(), "comparison").limit(k)
    low = others.orderBy("correlation", "comparison").limit(k)
    return top.withColumn("side", F.lit("nearest")).unionByName(low.withColumn("side", F.lit("least")))


def comparison_positions(fc: DataFrame) -> DataFrame:
    """(comparison, position): places from 0 by name; there are as many rows as comparisons."""
    names = fc.select("comparison").where("comparison IS NOT NULL").distinct()
    return names.withColumn("position", F.row_number().over(Window.orderBy("comparison")) - 1)


def matrix_tile(
    corr: DataFrame, index: DataFrame, level: int, row: int, column: int, size: int = 256
) -> DataFrame:
    """Mean correlation and largest support per 2^level square of one tile.

    ``index`` is (comparison, position). The diagonal is part of ``corr``.
    """
    if not 1 <= size <= 256 or min(level, row, column) < 0:
        raise ValueError("invalid tile")
    factor = 2**level
    at = corr.join(index.select(F.col("comparison").alias("left"), F.col("position").alias("i")), "left")
    at = at.join(index.select(F.col("comparison").alias("right"), F.col("position").alias("j")), "right")
    both = F.when(
        F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("i"), F.col("j").alias("j")))
    ).otherwise(
        F.array(
            F.struct(F.col("i").alias("i"), F.col("j").alias("j")),
            F.struct(F.col("j").alias("i"), F.col("i").alias("j")),
        )
    )
    cells = at.select(F.explode(both).alias("p"), "correlation", "support").select(
        F.floor(F.col("p.i") / factor).alias("row"), F.floor(F.col("p.j") / factor).alias("column"),
        "correlation", "support",
    )
    inside = F.col("row").between(row * size, (row + 1) * size - 1) & F.col("column").between(
        column * size, (column + 1) * size - 1
    )
    return cells.where(inside).groupBy("row", "column").agg(
        F.avg(finite("correlation")).alias("correlation"), F.max("support").alias("support")
    )


def correlation_bars(scores: DataFrame, n: int = 10, name: str = "feature", value: str = "correlation") -> DataFrame:
    """The n highest and n lowest scores; null scores are left out."""
    rows = scores.where(F.col(value).isNotNull()).select(name, value)
    top = rows.orderBy(F.col(value).desc(), name).limit(n).withColumn("side", F.lit("top"))
    low = rows.orderBy(F.col(value), name).limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


# ------------------------------------------------------------------ selections


def top_proteins(
    differential: DataFrame, comparisons: Sequence[str], n: int = 500, proteins: Sequence[str] | None = None
) -> DataFrame:
    """Average fold change of the n proteins with the largest change in the chosen comparisons."""
    chosen = list(dict.fromkeys(comparisons))
    if not chosen or n < 1:
        raise ValueError("at least one comparison and one protein")
    rows = differential.where((F.col("result_layer") == "protein") & F.col("comparison_id").isin(chosen))
    if proteins:
        rows = rows.where(F.col("protein_accession").isin(list(proteins)))
    scoped = rows.groupBy("comparison_id", "protein_accession").agg(
        F.min("gene_name").alias("gene_name"), F.avg(finite("log2_fold_change")).alias("log2_fold_change")
    )
    best = scoped.groupBy("protein_accession").agg(F.max(F.abs("log2_fold_change")).alias("largest"))
    best = best.orderBy(F.col("largest").desc_nulls_last(), "protein_accession").limit(n)
    return scoped.join(best, "protein_accession")


def heatmap_payload(rows: DataFrame, columns: Sequence[str], name: str, column: str, value: str) -> DataFrame:
    """One row per name with its values in the order of ``columns``; null for gaps.

    The order is given and bounded, so each row is a fixed-length array.
    """
    cells = [F.max(F.when(F.col(column) == c, F.col(value))) for c in columns]
    return rows.groupBy(name).agg(F.array(*cells).alias("values"))


def top_abs_change(fc: DataFrame, selected: Sequence[str], n: int = 100) -> DataFrame:
    rows = fc.where(F.col("comparison").isin(list(selected)))
    best = rows.groupBy("feature").agg(F.max(F.abs("value")).alias("largest"))
    return best.orderBy(F.col("largest").desc(), "feature").limit(n)


def significant(differential: DataFrame, p_cut: float, fold_cut: float) -> DataFrame:
    return differential.where((F.col("adjusted_p_value") < p_cut) & (F.abs("log2_fold_change") >= fold_cut))


def venn(
    differential: DataFrame, comparisons: Sequence[str], p_cut: float = 0.05, fold_cut: float = 1.0
) -> dict[str, DataFrame]:
    """Exclusive regions of the significant sets of the chosen comparisons.

    ``differential`` is the loaded table (finite values, missing adjusted p as
    1). The region list of a protein is no longer than the chosen comparisons.
    """
    chosen = list(dict.fromkeys(comparisons))
    if len(chosen) < 2:
        raise ValueError("at least two comparisons")
    rows = significant(differential.where(F.col("comparison_id").isin(chosen)), p_cut, fold_cut)
    members = rows.groupBy("protein_accession").agg(F.sort_array(F.collect_set("comparison_id")).alias("r"))
    members = members.select("protein_accession", F.array_join("r", "&").alias("region"), F.size("r").alias("sets"))
    details = rows.groupBy("protein_accession", "comparison_id").agg(
        F.min("gene_name").alias("gene_name"),
        F.max_by("log2_fold_change", F.abs("log2_fold_change")).alias("log2_fold_change"),
        F.min("adjusted_p_value").alias("adjusted_p_value"),
    )
    return {
        "members": members,
        "regions": members.groupBy("region", "sets").agg(F.count(F.lit(1)).alias("count")),
        "set_sizes": rows.groupBy("comparison_id").agg(F.countDistinct("protein_accession").alias("size")),
        "details": details.join(members.select("protein_accession", "region"), "protein_accession"),
    }


def comparison_ids(differential: DataFrame, layer: str = "protein") -> DataFrame:
    return differential.where(F.col("result_layer") == layer).select("comparison_id").distinct()


def unknown_comparisons(wanted: DataFrame, differential: DataFrame, layer: str = "protein") -> DataFrame:
    return wanted.join(comparison_ids(differential, layer), "comparison_id", "left_anti")


def matched_features(fc: DataFrame, a: str, b: str) -> DataFrame:
    return shared_pairs(fc, a, b).select("feature")


def protein_list(differential: DataFrame) -> DataFrame:
    return differential.groupBy("protein_accession").agg(F.min("gene_name").alias("gene_name"))


def marked_or_significant(
    marked: DataFrame, differential: DataFrame, selected: Sequence[str], n: int = 100
) -> DataFrame:
    """Known marked proteins; if none, those significant in a selected comparison; else the top changes.

    Each step's emptiness decides the next, so it is a short action.
    """
    known = differential.select("protein_accession").distinct()
    chosen = marked.select("protein_accession").distinct().join(known, "protein_accession", "left_semi")
    if not chosen.isEmpty():
        return chosen
    rows = differential.where(F.col("comparison_id").isin(list(selected)))
    hits = significant(rows, 0.05, 1.0).select("protein_accession").distinct()
    if not hits.isEmpty():
        return hits
    fc = fold_change_long(rows)
    return top_abs_change(fc, selected, n).select(F.col("feature").alias("protein_accession"))
