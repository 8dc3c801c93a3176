"""Features to proteins: sums, means, median polish, additive and robust fits.

A protein with a bounded number of cells is fitted by one grouped-map task. A
larger one is fitted by the same sweeps, under the same stopping rule, written
as joins and aggregates, so its cells stay spread over the cluster. Which way a
protein goes does not show in its result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from omicspark.functions.grouped import Columns, encoded, map_batches, map_keys, median_along
from omicspark.functions.ranking import exact_quantiles, same_keys
from omicspark.operators.protein import top_features
from omicspark.session import cut_lineage

#: Cells of a protein that one task may hold: 32 MB for each of the few matrices of a fit.
MAX_CELLS = 4_000_000
#: A fit goes on until no level moves by more than this part of the largest value; the rounds are a guard.
TOLERANCE, MOST_ROUNDS = 1e-9, 1000
#: Cells of matrices that are polished together.
BLOCK_CELLS = 1 << 18
HUBER_K = 1.345
MAD_SCALE = 0.6745
VALUE = "log2_abundance"
SCHEMA = "protein string, sample string, log2_abundance double, converged boolean"


def summarize(
    df: DataFrame,
    method: str = "robustSummary",
    max_cells: int = MAX_CELLS,
    min_features: int = 1,
    subset: str = "all",
    n_top: int = 3,
    with_converged: bool = False,
) -> DataFrame:
    """(protein, sample, log2_abundance) by sum, mean, medianPolish, linear or robustSummary.

    Sum and mean work on the given values as they are, like the other methods.
    ``with_converged`` adds ``converged``: whether the protein's fit met its
    stopping rule before the largest number of rounds.
    """
    rows = df.select("protein", "feature", "sample", F.col(VALUE).cast("double").alias(VALUE))
    rows = rows.where(F.col(VALUE).isNotNull() & ~F.isnan(VALUE))
    if subset == "topN":
        rows = top_features(rows, n_top, "protein", "feature", VALUE)
    elif subset != "all":
        raise ValueError(f"unknown feature subset: {subset}")
    if method in {"sum", "mean"}:
        pick = F.sum if method == "sum" else F.avg
        plain = rows.groupBy("protein", "sample").agg(pick(VALUE).alias(VALUE))
        return plain.withColumn("converged", F.lit(True)) if with_converged else plain
    if method not in SWEEPS:
        raise ValueError(f"unknown summary: {method}")
    cells = rows.groupBy("protein", "feature", "sample").agg(F.avg(VALUE).alias(VALUE))
    if min_features > 1:
        counts = cells.groupBy("protein").agg(F.countDistinct("feature").alias("n"))
        keep = counts.where(F.col("n") >= min_features).select("protein")
        cells = same_keys(cells, keep, ["protein"], "left_semi")
    large = large_proteins(cells, max_cells)
    columns = ["feature", "sample", VALUE]

    def fit(some: DataFrame) -> DataFrame:
        if method == "medianPolish":
            return map_batches(some, "protein", columns, _polished(0), SCHEMA)
        return map_keys(some, "protein", columns, _grouped(method), SCHEMA)

    if large is None:
        fitted = fit(cells)
    else:
        small = same_keys(cells, large, ["protein"], "left_anti")
        big = same_keys(cells, large, ["protein"], "left_semi")
        fitted = fit(small).unionByName(spread_fit(big, method))
    return fitted if with_converged else fitted.drop("converged")


def summarize_tmp(
    df: DataFrame, min_features: int = 2, subset: str = "all", n_top: int = 3, max_cells: int = MAX_CELLS
) -> DataFrame:
    """Tukey median polish per protein; with fewer features in every run, run medians.

    A protein of bounded size goes to one task, which counts its features and
    takes the polish or the medians; rows travel once.
    """
    rows = df if subset == "all" else top_features(df, n_top, "protein", "feature", VALUE)
    rows = rows.select("protein", "feature", "sample", F.col(VALUE).cast("double").alias(VALUE))
    rows = rows.where(F.col(VALUE).isNotNull())
    large = large_proteins(rows, max_cells)
    small = rows if large is None else same_keys(rows, large, ["protein"], "left_anti")
    fitted = map_batches(small, "protein", ["feature", "sample", VALUE], _polished(min_features), SCHEMA).drop("converged")
    if large is None:
        return fitted
    return fitted.unionByName(_spread_tmp(cut_lineage(same_keys(rows, large, ["protein"], "left_semi")), min_features, max_cells))


def _spread_tmp(rows: DataFrame, min_features: int, max_cells: int) -> DataFrame:
    """``summarize_tmp`` of proteins that no task may hold."""
    counts = rows.groupBy("protein", "sample").agg(F.count(VALUE).alias("n"))
    enough = counts.groupBy("protein").agg(F.max("n").alias("n"))
    few = enough.where(F.col("n") < min_features).select("protein")
    polished = summarize(same_keys(rows, few, ["protein"], "left_anti"), "medianPolish", max_cells)
    short = same_keys(rows, few, ["protein"], "left_semi")
    medians = exact_quantiles(short, ["protein", "sample"], VALUE, {VALUE: 0.5})
    return polished.unionByName(medians)


def large_proteins(cells: DataFrame, max_cells: int) -> DataFrame | None:
    """Proteins whose rows or whose feature x sample matrix are too many for one task; None without any.

    A protein has no more features, or samples, than rows, so features and
    samples are counted only where the square of the rows is too large.
    """
    seen = cells.groupBy(F.xxhash64("protein").alias("__h")).agg(F.count(F.lit(1)).alias("n"))
    near = cut_lineage(seen.where(F.col("n") * F.col("n") > max_cells).select("__h"))
    if near.isEmpty():
        return None
    some = cells.withColumn("__h", F.xxhash64("protein")).join(near, "__h", "left_semi")
    sizes = some.groupBy("protein").agg(
        (F.countDistinct("feature") * F.countDistinct("sample")).alias("n"), F.count(F.lit(1)).alias("rows")
    )
    large = cut_lineage(sizes.where(F.greatest("n", "rows") > max_cells).select("protein"))
    return None if large.isEmpty() else large


# ----------------------------------------------------------- one task per protein


def _codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, names = pd.factorize(values, sort=True)
    return names, codes


def _matrix(columns: Columns) -> tuple[np.ndarray, np.ndarray]:
    """Feature x sample matrix with gaps as NaN, and the sample names."""
    features, f = _codes(columns["feature"])
    samples, s = _codes(columns["sample"])
    matrix = np.full((len(features), len(samples)), np.nan)
    matrix[f, s] = columns[VALUE]
    return matrix, samples


def median_polish(x: np.ndarray, rounds: int = 10, tolerance: float = 0.01) -> tuple[np.ndarray, bool]:
    """Column levels (overall + column effect) of Tukey's median polish, rows first, and whether it settled."""
    levels, settled = median_polish_all(x[None], rounds, tolerance)
    return levels[0], bool(settled[0])


def median_polish_all(x: np.ndarray, rounds: int = 10, tolerance: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """``median_polish`` of many matrices at once; rows and columns of gaps alone change nothing.

    Ten rounds and a hundredth are part of the published method's definition.
    A matrix that has settled leaves.
    """
    count, height, width = x.shape
    levels, done = np.full((count, width), np.nan), np.zeros(count, dtype=bool)
    at, rest, last = np.arange(count), x.copy(), np.zeros(count)
    overall, row, col = np.zeros(count), np.zeros((count, height)), np.zeros((count, width))
    for _ in range(rounds):
        step = median_along(rest, 2)
        rest = rest - step[:, :, None]
        row = row + step
        center = median_along(col)
        col, overall = col - center[:, None], overall + center
        step = median_along(rest, 1)
        rest = rest - step[:, None, :]
        col = col + step
        center = median_along(row)
        row, overall = row - center[:, None], overall + center
        size = np.nansum(np.abs(rest), axis=(1, 2))
        settled = (size == 0) | (np.abs(size - last) < tolerance * size)
        levels[at[settled]] = (overall[:, None] + col)[settled]
        done[at[settled]] = True
        on = ~settled
        at, rest, last, overall, row, col = at[on], rest[on], size[on], overall[on], row[on], col[on]
        if not len(at):
            break
    levels[at] = overall[:, None] + col
    return levels, done


@dataclass
class Additive:
    """Row and column effects of a matrix with gaps, moved by weighted sweeps."""

    x: np.ndarray
    row: np.ndarray
    col: np.ndarray

    @classmethod
    def start(cls, x: np.ndarray) -> Additive:
        return cls(x, np.zeros(x.shape[0]), np.zeros(x.shape[1]))

    def sweep(self, weights: np.ndarray | None = None) -> float:
        """Row means, then column means, of what the other effect leaves; returns the largest move."""
        w = np.where(np.isnan(self.x), 0.0, 1.0 if weights is None else weights)
        y = np.nan_to_num(self.x)
        row_weight, col_weight = w.sum(axis=1), w.sum(axis=0)
        row_weight[row_weight == 0] = 1.0
        col_weight[col_weight == 0] = 1.0
        row = (w * (y - self.col[None, :])).sum(axis=1) / row_weight
        col = (w * (y - row[:, None])).sum(axis=0) / col_weight
        moved = max(np.abs(row - self.row).max(), np.abs(col - self.col).max())
        self.row, self.col = row, col
        return float(moved)

    def settle(self) -> bool:
        """Sweeps until nothing moves; false if the guard ended it."""
        return any(self.sweep() < self.least for _ in range(MOST_ROUNDS))

    @property
    def least(self) -> float:
        return TOLERANCE * max(1.0, float(np.nanmax(np.abs(self.x), initial=0.0)))

    @property
    def levels(self) -> np.ndarray:
        """Column levels, with the rows centred so that their plain mean is zero."""
        return self.col + self.row.mean()

    @property
    def rest(self) -> np.ndarray:
        return self.x - self.row[:, None] - self.col[None, :]


def additive_fit(x: np.ndarray) -> tuple[np.ndarray, bool]:
    """Column levels of the least-squares additive fit, and whether it settled."""
    fit = Additive.start(x)
    settled = fit.settle()
    return fit.levels, settled


def huber_weights(rest: np.ndarray) -> np.ndarray:
    scale = float(median_along(np.abs(rest).ravel())) / MAD_SCALE
    if not np.isfinite(scale) or scale < 1e-12:
        return np.ones_like(rest)
    size = np.abs(rest) / scale
    return np.where(size <= HUBER_K, 1.0, HUBER_K / np.maximum(size, 1e-300))


def robust_fit(x: np.ndarray) -> tuple[np.ndarray, bool]:
    """Additive fit, then one sweep under Huber's weights a round, until the levels settle."""
    fit = Additive.start(x)
    fit.settle()
    levels = fit.levels
    for _ in range(MOST_ROUNDS):
        fit.sweep(huber_weights(fit.rest))
        new = fit.levels
        moved = np.abs(new - levels).max()
        levels = new
        if moved < fit.least:
            return levels, True
    return levels, False


SWEEPS = {
    "medianPolish": median_polish,
    "linear": additive_fit,
    "robustSummary": robust_fit,
}


def _grouped(method: str):
    fit = SWEEPS[method]

    def run(protein: str, columns: Columns) -> Columns:
        matrix, samples = _matrix(columns)
        levels, settled = fit(matrix)
        return {
            "protein": np.repeat(protein, len(samples)).astype(object),
            "sample": samples,
            VALUE: levels,
            "converged": np.repeat(settled, len(samples)),
        }

    return run


def _polished(min_features: int):
    """Median polish of all proteins of a batch; those with fewer features in every sample take medians by sample."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        protein, proteins = encoded(batch.column(0))
        feature, features = encoded(batch.column(1))
        sample, samples = encoded(batch.column(2), ordered=True)
        value = batch.column(3).to_numpy(zero_copy_only=False)
        pair, of, n = np.unique(protein * len(samples) + sample, return_inverse=True, return_counts=True)
        most = np.zeros(len(proteins), dtype=np.int64)
        np.maximum.at(most, pair // len(samples), n)
        few = (most < min_features)[protein]
        short, long = few & np.isfinite(value), ~few & ~np.isnan(value)
        parts = [_by_sample(pair[of[short]], value[short])]
        parts += _by_polish(protein[long], feature[long], sample[long], value[long], len(features), len(samples))
        pairs, levels, settled = (np.concatenate(x) for x in zip(*parts))
        columns = [
            proteins.take(pa.array(pairs // len(samples))), samples.take(pa.array(pairs % len(samples))),
            pa.array(levels, pa.float64()), pa.array(settled, pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["protein", "sample", VALUE, "converged"])

    return run


Levels = tuple[np.ndarray, np.ndarray, np.ndarray]


def _by_sample(pair: np.ndarray, value: np.ndarray) -> Levels:
    """Median of the values of each number of a protein and sample."""
    order = np.lexsort((value, pair))
    found, first, n = np.unique(pair[order], return_index=True, return_counts=True)
    low, high = value[order][first + (n - 1) // 2], value[order][first + n // 2]
    return found, low + (high - low) * 0.5, np.ones(len(found), dtype=bool)


def _by_polish(
    protein: np.ndarray, feature: np.ndarray, sample: np.ndarray, value: np.ndarray, n_features: int, n_samples: int
) -> list[Levels]:
    """Polished levels of numbered proteins; matrices of about the same size are filled up to one and polished together."""
    if not len(protein):
        return []
    rows, row = np.unique(protein * n_features + feature, return_inverse=True)
    cols, col = np.unique(protein * n_samples + sample, return_inverse=True)
    proteins, at = np.unique(protein, return_inverse=True)
    height = np.bincount(np.searchsorted(proteins, rows // n_features), minlength=len(proteins))
    width = np.bincount(np.searchsorted(proteins, cols // n_samples), minlength=len(proteins))
    first_row, first_col = np.cumsum(height) - height, np.cumsum(width) - width
    row, col = row - first_row[at], col - first_col[at]
    # Matrices that fill a block are taken as they are.
    grown = lambda n: 1 << (int(n) - 1).bit_length()
    large = height * width > BLOCK_CELLS
    shape = [(h, w, k) if big else (grown(h), grown(w), -1) for k, (h, w, big) in enumerate(zip(height.tolist(), width.tolist(), large.tolist()))]
    shapes = {s: k for k, s in enumerate(dict.fromkeys(shape))}
    kind = np.array([shapes[s] for s in shape])
    by_kind = np.argsort(kind, kind="stable")
    rank = np.empty(len(proteins), dtype=np.int64)
    rank[by_kind] = np.arange(len(proteins))
    # Cells in the order of the proteins' kinds, so that each block is a slice of them.
    cells = np.argsort(rank[at], kind="stable")
    at, row, col, value = at[cells], row[cells], col[cells], value[cells]
    place, ends = rank[at], np.cumsum(np.bincount(kind, minlength=len(shapes)))
    parts = []
    for (h, w, _), k in shapes.items():
        start, end = int(ends[k - 1]) if k else 0, int(ends[k])
        step = max(1, BLOCK_CELLS // (h * w))
        for a in range(start, end, step):
            b = min(a + step, end)
            here = slice(*np.searchsorted(place, [a, b]))
            flat = ((place[here] - a) * h + row[here]) * w + col[here]
            total, n = np.bincount(flat, value[here], (b - a) * h * w), np.bincount(flat, minlength=(b - a) * h * w)
            x = np.divide(total, n, out=np.full(len(n), np.nan), where=n > 0).reshape(b - a, h, w)
            levels, settled = median_polish_all(x)
            block = by_kind[a:b]
            own = np.arange(w)[None, :] < width[block][:, None]
            pairs = cols[(first_col[block][:, None] + np.arange(w)[None, :])[own]]
            parts.append((pairs, levels[own], np.broadcast_to(settled[:, None], own.shape)[own]))
    return parts


# ------------------------------------------------- cells of one protein spread out


def spread_fit(cells: DataFrame, method: str) -> DataFrame:
    """The same fits for proteins of any size, as aggregates over their cells.

    The state is written after every sweep, so no sweep is ever run again.
    Proteins that have settled leave it.
    """
    if method == "medianPolish":
        return _spread_polish(cells)
    state = _spread_start(cells)
    done = []
    for _ in range(MOST_ROUNDS):
        state = _spread_sweep(state)
        state, settled = _settled(state, F.greatest(F.abs(F.col("r") - F.col("r0")), F.abs(F.col("c") - F.col("c0"))))
        if settled is not None:
            done.append(settled)
        if state is None:
            break
    if state is not None:
        done.append(state)
    fitted = _stacked(done)
    if method == "linear":
        return _spread_levels(fitted, state)
    state, done = cut_lineage(_with_level(fitted.drop("r0", "c0"))), []
    for _ in range(MOST_ROUNDS):
        state = state.withColumn("rest", F.col(VALUE) - F.col("r") - F.col("c"))
        scale = exact_quantiles(state.withColumn("a", F.abs("rest")), ["protein"], "a", {"mad": 0.5})
        state = same_keys(state, scale, ["protein"])
        size = F.abs("rest") / (F.col("mad") / MAD_SCALE)
        weight = F.when(F.col("mad") / MAD_SCALE < 1e-12, 1.0).when(size <= HUBER_K, 1.0).otherwise(HUBER_K / size)
        state = state.withColumn("w", weight).withColumnRenamed("level", "level0").drop("rest", "mad")
        state = _with_level(_spread_sweep(state)).drop("r0", "c0")
        state, settled = _settled(cut_lineage(state), F.abs(F.col("level") - F.col("level0")))
        if settled is not None:
            done.append(settled)
        if state is None:
            break
        state = state.drop("level0")
    if state is not None:
        done.append(state)
    return _spread_levels(_stacked([d.drop("level0") for d in done]), state)


def _stacked(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def _spread_start(cells: DataFrame) -> DataFrame:
    top = cells.groupBy("protein").agg((F.greatest(F.lit(1.0), F.max(F.abs(VALUE))) * TOLERANCE).alias("least"))
    state = same_keys(cells, top, ["protein"])
    for name, value in (("w", 1.0), ("r", 0.0), ("c", 0.0)):
        state = state.withColumn(name, F.lit(value))
    return cut_lineage(state)


def _spread_sweep(state: DataFrame) -> DataFrame:
    """One sweep: ``r`` and ``c`` move on, ``r0`` and ``c0`` keep what they were."""
    state = state.drop("r0", "c0").withColumnsRenamed({"r": "r0", "c": "c0"})
    rows = state.groupBy("protein", "feature").agg(
        F.try_divide(F.sum(F.col("w") * (F.col(VALUE) - F.col("c0"))), F.sum("w")).alias("r")
    )
    state = same_keys(state, rows, ["protein", "feature"])
    cols = state.groupBy("protein", "sample").agg(
        F.try_divide(F.sum(F.col("w") * (F.col(VALUE) - F.col("r"))), F.sum("w")).alias("c")
    )
    return cut_lineage(same_keys(state, cols, ["protein", "sample"]))


def _settled(state: DataFrame, change: Column) -> tuple[DataFrame | None, DataFrame | None]:
    """(cells of proteins that still move, cells of those that do not), None for no cells."""
    moved = state.groupBy("protein").agg((F.max(change) < F.max("least")).alias("still"))
    marked = cut_lineage(same_keys(state, moved, ["protein"]))
    seen = {r["still"] for r in marked.select("still").distinct().collect()}
    part = lambda flag: marked.where(F.col("still") == flag).drop("still") if flag in seen else None
    return part(False), part(True)


def _with_level(state: DataFrame) -> DataFrame:
    """Cells with the level of their column, rows centred on a plain mean of zero."""
    features = state.groupBy("protein", "feature").agg(F.max("r").alias("r1"))
    centers = features.groupBy("protein").agg(F.avg("r1").alias("center"))
    return same_keys(state, centers, ["protein"]).withColumn("level", F.col("c") + F.col("center")).drop("center")


def _spread_levels(state: DataFrame, unsettled: DataFrame | None) -> DataFrame:
    levels = _with_level(state).groupBy("protein", "sample").agg(F.max("level").alias(VALUE))
    if unsettled is None:
        return levels.withColumn("converged", F.lit(True))
    open_ones = unsettled.select("protein").distinct().withColumn("open", F.lit(True))
    joined = same_keys(levels, open_ones, ["protein"], "left")
    return joined.withColumn("converged", F.col("open").isNull()).drop("open")


def _spread_polish(cells: DataFrame, rounds: int = 10) -> DataFrame:
    """Median polish; each cell carries its row and column effect and the overall level."""
    state = cells.withColumn("z", F.col(VALUE))
    for name in ("r", "c", "t"):
        state = state.withColumn(name, F.lit(0.0))
    # Written first: copies and constants as plain columns keep the later plans small.
    state = cut_lineage(state.withColumn("last", F.lit(0.0)).withColumn("done", F.lit(False)))

    def sweep(frame: DataFrame, across: str, effect: str, other: str) -> DataFrame:
        """Take the median out along ``across``, then centre the other effects."""
        step = exact_quantiles(frame, ["protein", across], "z", {"step": 0.5})
        frame = same_keys(frame, step, ["protein", across])
        frame = frame.withColumn("z", F.col("z") - F.col("step"))
        frame = cut_lineage(frame.withColumn(effect, F.col(effect) + F.col("step")).drop("step"))
        other_key = "sample" if across == "feature" else "feature"
        levels = frame.groupBy("protein", other_key).agg(F.max(other).alias("e"))
        center = exact_quantiles(levels, ["protein"], "e", {"m": 0.5})
        frame = same_keys(frame, center, ["protein"])
        frame = frame.withColumn(other, F.col(other) - F.col("m")).withColumn("t", F.col("t") + F.col("m"))
        return cut_lineage(frame.drop("m"))

    finished = None
    for _ in range(rounds):
        state = sweep(state, "feature", "r", "c")
        state = sweep(state, "sample", "c", "r")
        sums = state.groupBy("protein").agg(F.sum(F.abs("z")).alias("size"), F.max("last").alias("before"))
        settled = (F.col("size") == 0) | (F.abs(F.col("size") - F.col("before")) < 0.01 * F.col("size"))
        sums = sums.select("protein", "size", settled.alias("now"))
        state = same_keys(state.drop("last", "done"), sums, ["protein"])
        state = cut_lineage(state.withColumnsRenamed({"size": "last", "now": "done"}))
        closed = state.where("done")
        finished = closed if finished is None else finished.unionByName(closed)
        state = state.where(~F.col("done"))
        if state.isEmpty():
            break
    finished = finished.unionByName(state)
    return finished.groupBy("protein", "sample").agg((F.max("t") + F.max("c")).alias(VALUE), F.max("done").alias("converged"))


# -------------------------------------------------------------- censored values


def impute_censored(
    df: DataFrame, quantile: float = 0.001, max_cells: int = MAX_CELLS
) -> DataFrame:
    """Fill missing cells below a low quantile by a censored-normal additive model.

    The cut-off of a run is the low quantile of its observed values. Within a
    protein, runs and features that have at least one value are completed:
    expectation-maximisation of the tobit likelihood with feature and run
    effects, one sweep a round; each missing cell gets its expected value below
    the cut-off, until no filled value moves.
    Returns all cells with ``provenance``.
    """
    from omicspark.operators.normalize import missing_cells

    rows = df.select("protein", "feature", "sample", VALUE)
    cuts = exact_quantiles(rows, ["sample"], VALUE, {"cut": quantile})
    present = rows.select("protein", "sample").distinct()
    gaps = same_keys(missing_cells(rows), present, ["protein", "sample"], "left_semi")
    cells = rows.unionByName(gaps, allowMissingColumns=True).join(cuts, "sample")
    out = "protein string, feature string, sample string, log2_abundance double, provenance string"
    large = large_proteins(cells, max_cells)
    columns, fit = ["feature", "sample", VALUE, "cut"], _censored()
    if large is None:
        return map_keys(cells, "protein", columns, fit, out)
    small = map_keys(same_keys(cells, large, ["protein"], "left_anti"), "protein", columns, fit, out)
    return small.unionByName(_spread_censored(same_keys(cells, large, ["protein"], "left_semi")))


def _normal_ratio(a: np.ndarray) -> np.ndarray:
    """density / distribution of the standard normal, for whole arrays.

    With z = -a the ratio is the inverse of the Mills ratio: a continued
    fraction for z >= 1, and for smaller z the series of the distribution.
    """
    a = np.asarray(a, dtype=float)
    z = -a
    far = np.maximum(z, 1.0)
    tail = far.copy()
    for k in range(200, 0, -1):
        tail = far + k / tail
    inside = np.clip(a, -1.0, 9.0)  # beyond 9 the distribution is 1 in double precision
    term = total = inside
    for k in range(1, 160):
        term = term * inside * inside / (2 * k + 1)
        total = total + term
    density = lambda x: np.exp(-x * x / 2) / np.sqrt(2 * np.pi)
    return np.where(z >= 1.0, tail, density(np.clip(a, -1.0, 40.0)) / (0.5 + density(inside) * total))


def _censored():
    def run(protein: str, columns: Columns) -> Columns:
        features, f = _codes(columns["feature"])
        samples, s = _codes(columns["sample"])
        y = np.full((len(features), len(samples)), np.nan)
        cut = np.full_like(y, np.nan)
        y[f, s] = columns[VALUE]
        cut[f, s] = columns["cut"]
        hidden = np.isnan(y) & ~np.isnan(cut)
        x = np.where(hidden, cut, y)
        if hidden.any():
            fit = Additive.start(x)
            least, count, extra = fit.least, np.count_nonzero(~np.isnan(x)), 0.0
            for _ in range(MOST_ROUNDS):
                fit.sweep()
                rest = fit.rest
                mean = x[hidden] - rest[hidden]
                sigma = max(np.sqrt((np.nansum(rest**2) + extra) / count), 1e-6)
                a = (cut[hidden] - mean) / sigma
                ratio = _normal_ratio(a)
                filled = mean - sigma * ratio
                extra = float(np.sum(np.maximum(sigma**2 * (1 - a * ratio - ratio**2), 0)))
                moved = np.abs(filled - x[hidden]).max()
                x[hidden] = filled
                if moved < least:
                    break
        return {
            "protein": np.repeat(protein, len(f)).astype(object),
            "feature": columns["feature"],
            "sample": columns["sample"],
            VALUE: x[f, s],
            "provenance": np.where(hidden[f, s], "imputed", "observed").astype(object),
        }

    return run


def _spread_censored(cells: DataFrame) -> DataFrame:
    """The same rounds for large proteins; the normal tail is the only Python call."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series) -> pd.Series:
        return pd.Series(_normal_ratio(a.to_numpy(dtype=float)))

    state = _spread_start(cells.select(
        "protein", "feature", "sample", "cut",
        F.col(VALUE).isNull().alias("hidden"),
        F.coalesce(F.col(VALUE), F.col("cut")).alias(VALUE),
        F.lit(0.0).alias("extra"),
    ))
    done = []
    for _ in range(MOST_ROUNDS):
        rest = _spread_sweep(state).drop("r0", "c0").withColumn("rest", F.col(VALUE) - F.col("r") - F.col("c"))
        sums = rest.groupBy("protein").agg(
            F.greatest(F.sqrt((F.sum(F.pow("rest", F.lit(2.0))) + F.sum("extra")) / F.count(F.lit(1))), F.lit(1e-6)).alias("sigma")
        )
        step = same_keys(rest, sums, ["protein"])
        mean = F.col(VALUE) - F.col("rest")
        step = step.withColumn("a", (F.col("cut") - mean) / F.col("sigma")).withColumn("q", ratio("a"))
        filled = mean - F.col("sigma") * F.col("q")
        extra = F.greatest(F.pow("sigma", F.lit(2.0)) * (1 - F.col("a") * F.col("q") - F.col("q") * F.col("q")), F.lit(0.0))
        step = step.select(
            "protein", "feature", "sample", "cut", "hidden", "least", "w", "r", "c",
            F.when(F.col("hidden"), filled).otherwise(F.col(VALUE)).alias("new"),
            F.when(F.col("hidden"), extra).otherwise(F.lit(0.0)).alias("extra"),
            F.col(VALUE).alias("old"),
        )
        state, settled = _settled(cut_lineage(step), F.abs(F.col("new") - F.col("old")))
        if settled is not None:
            done.append(settled.drop("old").withColumnRenamed("new", VALUE))
        if state is None:
            break
        state = state.drop("old").withColumnRenamed("new", VALUE)
    state = _stacked(done + ([state] if state is not None else []))
    return state.select(
        "protein", "feature", "sample", VALUE,
        F.when(F.col("hidden"), "imputed").otherwise("observed").alias("provenance"),
    )


# ------------------------------------------------------------------ two layers


def summarize_layers(ptm: DataFrame, protein: DataFrame | None = None, reference: str = "Norm") -> DataFrame:
    """Site and protein layers summarised alike; only the protein layer is normalised globally.

    Inputs are feature tables (ProteinName, PSM, BioReplicate, Condition,
    Intensity). Reference channels serve the fit and then leave.
    """
    from omicspark.operators.normalize import equalize_medians

    def layer(features: DataFrame, name: str, equalize: bool) -> DataFrame:
        long = features.groupBy(
            F.col("ProteinName").alias("protein"),
            F.col("PSM").alias("feature"),
            F.col("BioReplicate").alias("sample"),
        ).agg(F.max("Intensity").alias("v"))
        long = long.where(F.col("v") > 0).select("protein", "feature", "sample", F.log2("v").alias(VALUE))
        kinds = features.select(F.col("BioReplicate").alias("sample"), F.col("Condition").alias("condition"))
        # The smallest of texts is found by sorting, so it is sought among distinct ones; without their count the
        # planner would take the distinct step out.
        alike = kinds.groupBy("sample", "condition").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
        kinds = cut_lineage(alike.groupBy("sample").agg(F.min("condition").alias("condition")))
        # The medians and the shift read it, then the size check and the fits.
        long = cut_lineage(long)
        levels = summarize_tmp(equalize_medians(long) if equalize else long)
        return (
            levels.join(kinds, "sample")
            .where(F.col("condition") != reference)
            .select(
                F.col("protein").alias("protein_accession"),
                F.col("sample").alias("sample_id"),
                "condition",
                F.col(VALUE).alias("processed_log2_abundance"),
                F.lit(name).alias("result_layer"),
            )
        )

    out = layer(ptm, "ptm", False)
    return out if protein is None else out.unionByName(layer(protein, "protein", True))
