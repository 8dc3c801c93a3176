"""Principal components and spectral embedding with the features spread out.

One solver serves every size: a block of vectors is multiplied in one pass over
the rows, and the passes go on until the wanted pairs have settled. Only
sample-by-block arrays ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from omicspark.functions.ranking import finite
from omicspark.session import cut_lineage

#: Vectors that one pass multiplies; up to as many samples, the first pass gives the whole matrix.
BLOCK_VECTORS = 64
#: Samples whose sums travel in one row, and partial sums that one task adds up.
CHUNK_SAMPLES, BRANCHES = 256, 64


def complete_features(df: DataFrame, samples: int, feature: str, value: str) -> DataFrame:
    """Features with a finite value in every sample."""
    return (
        df.groupBy(feature)
        .agg(F.count(F.lit(1)).alias("rows"), F.count(finite(value)).alias("filled"))
        .where((F.col("rows") == samples) & (F.col("filled") == samples))
        .select(feature)
    )


def standardized_rows(df: DataFrame, index: DataFrame, feature: str, sample: str, value: str, n: int) -> DataFrame:
    """One row per complete feature: its standardised values in sample order.

    A row is as long as the design has samples.
    """
    rows = df.join(index, sample).groupBy(feature).agg(
        F.array_sort(F.collect_list(F.struct(F.col("position"), finite(value).alias("v")))).alias("r"),
        F.count(finite(value)).alias("filled"),
        F.avg(finite(value)).alias("m"),
        F.stddev_pop(finite(value)).alias("s"),
    )
    rows = rows.where((F.size("r") == n) & (F.col("filled") == n))
    scale = F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)
    return rows.select(F.transform("r", lambda x: (x["v"] - F.col("m")) / scale).alias("z"))


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    for pdf in frames:
        if len(pdf):
            rows = pdf["z"].to_numpy()
            # So many rows that a block of them stays under 32 MB.
            step = max(1, (1 << 22) // max(1, len(rows[0])))
            for at in range(0, len(rows), step):
                yield np.vstack(rows[at : at + step])


def _added(rows: DataFrame, partial: Callable[[Iterator[pd.DataFrame]], np.ndarray], n: int, width: int) -> np.ndarray:
    """Sum over the partitions of the (n, width) arrays that ``partial`` makes of them, by a tree of additions."""

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = partial(frames)
        leaf = TaskContext.get().partitionId() % BRANCHES
        for at in range(0, n, CHUNK_SAMPLES):
            yield pd.DataFrame({"chunk": [at], "leaf": [leaf], "g": [total[at : at + CHUNK_SAMPLES].ravel().tolist()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[[0]].copy()
        first["g"] = [np.sum(np.stack(pdf["g"].to_list()), axis=0).tolist()]
        return first

    schema = "chunk int, leaf int, g array<double>"
    sums = rows.mapInPandas(emit, schema).groupBy("chunk", "leaf").applyInPandas(add, schema)
    sums = sums.groupBy("chunk").applyInPandas(add, schema)
    out = np.zeros((n, width))
    for row in sums.toLocalIterator():  # n * width numbers
        part = np.asarray(row["g"]).reshape(-1, width)
        out[row["chunk"] : row["chunk"] + len(part)] = part
    return out


Product = Callable[[np.ndarray], np.ndarray]


def gram_times(rows: DataFrame, n: int) -> Product:
    """X -> ZᵀZX, one pass over the rows per call."""

    def apply(block: np.ndarray) -> np.ndarray:
        def partial(frames: Iterator[pd.DataFrame]) -> np.ndarray:
            total = np.zeros(block.shape)
            for z in _batches(frames):
                total += z.T @ (z @ block)
            return total

        return _added(rows, partial, n, block.shape[1])

    return apply


def matrix_times(cells: DataFrame, n: int) -> Product:
    """X -> AX for a symmetric matrix whose ``cells`` (i, j, c) lie above the diagonal, which holds ones."""

    def apply(block: np.ndarray) -> np.ndarray:
        def partial(frames: Iterator[pd.DataFrame]) -> np.ndarray:
            total = np.zeros(block.shape)
            for pdf in frames:
                i, j, c = pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["c"].to_numpy()
                for to, of in ((i, j), (j, i)):
                    for k in range(block.shape[1]):
                        total[:, k] += np.bincount(to, c * block[of, k], n)
            return total

        return block + _added(cells, partial, n, block.shape[1])

    return apply


def block_krylov(times: Product, n: int, k: int = 2, width: int = BLOCK_VECTORS, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenpairs of a symmetric operator on n numbers.

    The space spanned by a block and its images grows by one pass at a time, kept orthogonal, until the residuals
    of the pairs are below ``tolerance`` of the largest value or the space is whole, when they are exact. Up to
    ``width`` numbers the block is the identity, so one pass is enough.
    """
    block = np.eye(n) if n <= width else np.linalg.qr(np.random.default_rng(7).standard_normal((n, width)))[0]
    basis, images = block, times(block)
    last = images
    while True:
        small = basis.T @ images
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        rest = np.linalg.norm(images @ vectors - (basis @ vectors) * values, axis=0)
        if basis.shape[1] >= n or np.all(rest <= tolerance * max(abs(values[0]), 1e-300)):
            break
        size = np.linalg.norm(last)
        for _ in range(2):
            last = last - basis @ (basis.T @ last)
        left, strength, _ = np.linalg.svd(last, full_matrices=False)
        block = left[:, strength > 1e-13 * max(size, 1e-300)][:, : n - basis.shape[1]]
        if not block.shape[1]:
            break
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
        last = times(block)
        basis, images = np.hstack([basis, block]), np.hstack([images, last])
    return values, basis @ vectors


def fix_signs(vectors: np.ndarray) -> np.ndarray:
    """Make the entry of largest size positive in every column."""
    if vectors.size == 0:
        return vectors
    top = np.abs(vectors).argmax(axis=0)
    signs = np.sign(vectors[top, np.arange(vectors.shape[1])])
    return vectors * np.where(signs == 0, 1.0, signs)


def pca(
    df: DataFrame,
    samples: DataFrame | None = None,
    feature: str = "protein_accession",
    sample: str = "sample_id",
    value: str = "processed_log2_abundance",
    k: int = 2,
    width: int = BLOCK_VECTORS,
) -> DataFrame:
    """(sample, pc1.., pc1_variance..): scores over features complete in all samples.

    With fewer than two samples or complete features every score is zero and
    ``method`` is 'unavailable'. The entry of largest size of each component is
    positive. ``width`` vectors are multiplied in one pass.
    """
    names = (samples if samples is not None else df).select(sample).distinct()
    # One row per sample of the design.
    index = names.withColumn("position", F.row_number().over(Window.orderBy(sample)) - 1)
    order = [r[sample] for r in index.orderBy("position").collect()]
    n = len(order)
    spark = df.sparkSession
    rows = cut_lineage(standardized_rows(df, index, feature, sample, value, n)) if n >= 2 else None
    scores, shares, method = np.zeros((n, k)), np.zeros(k), "unavailable"
    if rows is not None and len(rows.take(2)) == 2:
        values, vectors = block_krylov(gram_times(rows, n), n, k, width)
        method, found = "exact", len(values)
        values = np.maximum(values, 0)
        total = rows.agg(F.sum(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0
        scores[:, :found] = fix_signs(vectors) * np.sqrt(values)
        shares[:found] = values / total * 100 if total > 0 else 0.0
    out = [(name, *map(float, scores[i]), *map(float, shares), method) for i, name in enumerate(order)]
    columns = [f"pc{i + 1}" for i in range(k)] + [f"pc{i + 1}_variance" for i in range(k)]
    schema = f"`{sample}` string, " + ", ".join(f"{c} double" for c in columns) + ", method string"
    return spark.createDataFrame(out, schema)


def pca_comparisons(fc: DataFrame, k: int = 2) -> DataFrame:
    """Comparisons as points: gaps filled with the feature's mean, then :func:`pca`.

    ``fc`` is (feature, comparison, value). Each feature lists the numbers of the
    comparisons it has, so only gaps become rows.
    """
    names = fc.select("comparison").where("comparison IS NOT NULL").distinct()
    # One row per comparison; features list whole numbers and not names.
    index = cut_lineage(names.withColumn("__at", F.row_number().over(Window.orderBy("comparison")) - 1))
    count = index.count()
    known = fc.where(finite("value").isNotNull())
    have = known.join(index, "comparison").groupBy("feature").agg(
        F.collect_set("__at").alias("__have"), F.avg("value").alias("value")
    )
    every = F.sequence(F.lit(0), F.lit(count - 1)) if count else F.array().cast("array<int>")
    gaps = have.select("feature", F.explode(F.array_except(every, F.col("__have"))).alias("__at"), "value")
    gaps = gaps.join(index, "__at").select("feature", "comparison", "value")
    filled = known.select("feature", "comparison", "value").unionByName(gaps)
    return pca(filled, feature="feature", sample="comparison", value="value", k=k)


def embed(correlation: DataFrame, items: DataFrame | None = None, width: int = BLOCK_VECTORS) -> DataFrame:
    """(item, x, y): top-two eigenvectors of a correlation matrix times the root of their values.

    ``correlation`` is (left, right, correlation) above the diagonal; gaps
    count as 0 and the diagonal is 1 for items of ``items``.
    """
    sides = correlation.select(F.col("left").alias("item")).unionByName(
        correlation.select(F.col("right").alias("item"))
    )
    names = (items.select("item") if items is not None else sides).distinct()
    index = names.withColumn("position", F.row_number().over(Window.orderBy("item")) - 1)
    order = [r["item"] for r in index.orderBy("position").collect()]
    n = len(order)
    spark = correlation.sparkSession
    if n < 2:
        return spark.createDataFrame([(o, 0.0, 0.0) for o in order], "item string, x double, y double")
    value = F.coalesce(finite("correlation"), F.lit(0.0))
    cells = (
        correlation.where(F.col("left") != F.col("right"))
        .join(index.select(F.col("item").alias("left"), F.col("position").alias("i")), "left")
        .join(index.select(F.col("item").alias("right"), F.col("position").alias("j")), "right")
        .select("i", "j", value.alias("c"))
        .where(F.col("c") != 0)
    )
    values, vectors = block_krylov(matrix_times(cut_lineage(cells), n), n, 2, width)
    coords = fix_signs(vectors) * np.sqrt(np.maximum(values, 0))
    return spark.createDataFrame(
        [(o, float(coords[i, 0]), float(coords[i, 1])) for i, o in enumerate(order)],
        "item string, x double, y double",
    )
