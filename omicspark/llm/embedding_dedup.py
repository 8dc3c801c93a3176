"""Near-duplicate vectors: int8 tile products with an error bound per vector, full precision where it matters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from omicspark.llm.components import connected_components, merge
from omicspark.session import cut_lineage

#: Vectors of one block of a tile.
TILE_ROWS = 2048
_SIDE = 1024
#: Products of int8 codes of so many dimensions are whole numbers that a float32 sum holds exactly.
_EXACT_DIMS = 1024
_CODED = (
    "label string, dims int, rep long, copies long, codes binary, scale double, length double, error double, raw binary"
)


def usable(embedding: Column) -> Column:
    """True for vectors that can link: not null or empty, every component finite, some component not zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes int8, scale, length, error) of unit vectors: x = scale * codes + e, length = |scale * codes|, error = |e|."""
    scale = np.abs(vectors).max(axis=1) / 127
    codes = np.rint(vectors / scale[:, None])
    near = codes * scale[:, None]
    return codes.astype(np.int8), scale, np.linalg.norm(near, axis=1), np.linalg.norm(vectors - near, axis=1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label, dims, rep, copies, vectors = (batch.column(i) for i in range(5))
        sizes = np.asarray(dims)
        flat = np.asarray(vectors.flatten())
        ends = np.cumsum(sizes)
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            raw = np.ascontiguousarray(flat[(ends[at] - d)[:, None] + np.arange(d)])
            codes, scale, length, error = quantise(_unit(raw.astype(np.float64)))
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [
                    label.take(take),
                    pa.array(sizes[at], pa.int32()),
                    rep.take(take),
                    copies.take(take),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(scale),
                    pa.array(length),
                    pa.array(error),
                    pa.array([r.tobytes() for r in raw], pa.binary()),
                ],
                names=["label", "dims", "rep", "copies", "codes", "scale", "length", "error", "raw"],
            )


def tile_links(
    codes: np.ndarray, scale: np.ndarray, length: np.ndarray, error: np.ndarray, raw: np.ndarray, copies: np.ndarray,
    left: np.ndarray, right: np.ndarray, threshold: float,
) -> tuple[np.ndarray, np.ndarray]:
    """(links, labels) per vector for the pairs of a row of ``left`` with a row of ``right``.

    Equal ``left`` and ``right`` mean all pairs among them. With x = x' + e, the product x.y differs from
    x'.y' by at most |x'||f| + |e||y'| + |e||f|. A pair whose int8 product plus that bound stays under the
    threshold is no link; the others are computed again from the vectors as given, in double precision.
    """
    links = np.zeros(len(codes), dtype=np.int64)
    labels = np.arange(len(codes))
    within = left is right
    norms = np.linalg.norm(raw, axis=1)
    for i in range(0, len(left), _SIDE):
        a = left[i : i + _SIDE]
        for j in range(i if within else 0, len(right), _SIDE):
            b = right[j : j + _SIDE]
            product = np.zeros((len(a), len(b)))
            for d in range(0, codes.shape[1], _EXACT_DIMS):
                part = slice(d, d + _EXACT_DIMS)
                product += codes[a, part].astype(np.float32) @ codes[b, part].astype(np.float32).T
            product *= scale[a, None] * scale[None, b]
            product += length[a, None] * error[None, b] + error[a, None] * (length + error)[None, b]
            p, q = np.nonzero(product >= threshold - 1e-9)
            if within and i == j:
                p, q = p[p < q], q[p < q]
            p, q = a[p], b[q]
            exact = np.zeros(len(p), dtype=bool)
            for k in range(0, len(p), 1 << 16):
                u, v = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
                exact[k : k + (1 << 16)] = np.einsum("ij,ij->i", raw[u], raw[v]) / (norms[u] * norms[v]) >= threshold
            p, q = p[exact], q[exact]
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            apart = labels[p] != labels[q]
            if apart.any():
                labels = merge(labels, p[apart], q[apart])
    return links, labels


def _tile(threshold: float, kind: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep, copies = (np.asarray(table[c]) for c in ("rep", "copies"))
        label = np.asarray(table["label"].combine_chunks().dictionary_encode().indices)
        dims = np.asarray(table["dims"])
        first, second, own = (np.asarray(table[c]) for c in ("first", "second", "own"))
        out_rep, out_root, out_links = [], [], []
        order = np.lexsort((dims, label))
        cuts = np.flatnonzero((np.diff(label[order]) != 0) | (np.diff(dims[order]) != 0)) + 1
        for rows in np.split(order, cuts):
            if len(rows) < 2:
                continue
            part = table.take(pa.array(rows))
            unpack = lambda c, t: np.frombuffer(b"".join(part[c].to_pylist()), dtype=t).reshape(len(rows), -1)
            raw = unpack("raw", kind).astype(np.float64)
            raw /= np.abs(raw).max(axis=1, keepdims=True)
            all_rows = np.arange(len(rows))
            within = first[rows[0]] == second[rows[0]]
            left = all_rows if within else np.flatnonzero(own[rows] == first[rows])
            right = left if within else np.flatnonzero(own[rows] != first[rows])
            links, labels = tile_links(
                unpack("codes", "i1"), *(np.asarray(part[c]) for c in ("scale", "length", "error")), raw, copies[rows],
                left, right, threshold,
            )
            at = np.flatnonzero(links)
            out_rep.append(rep[rows][at])
            out_root.append(rep[rows][labels[at]])
            out_links.append(links[at])
        whole = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"rep": whole(out_rep), "root": whole(out_root), "links": whole(out_links)})

    return run


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(id, n_links, component_id, kept), one row per input row, for cosine >= ``threshold`` within a label.

    Equal vectors of a label are one class, compared once and counted by their copies. A label of more than
    ``tile_rows`` classes is dealt into blocks; each pair of blocks is one task's tile. Smaller labels share
    tiles. A tile returns, per class, its number of links and the root of its links in the tile: no pairs.

    Null labels or ids, null, empty or zero vectors, and vectors with a null or non-finite component link with
    nothing. Vectors of different lengths do not link. Rows that share an id are one node of the components;
    ``n_links`` counts the links of a row's own vector.
    A null id has a null component and is not kept. Empty tables give an empty result. Other columns are not read.
    """
    spark_kind = vectors.schema[vector_col].dataType.elementType
    kind = "f4" if isinstance(spark_kind, T.FloatType) else "f8"
    own = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    if kind == "f8":
        own = own.withColumn("vector", F.col("vector").cast("array<double>"))
    can_link = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    own = own.withColumn("vector", F.when(can_link, F.col("vector")))
    classes = cut_lineage(
        own.where("vector IS NOT NULL")
        .groupBy("label", "vector")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    )
    coded = cut_lineage(
        classes.select(F.col("label").cast("string"), F.size("vector").alias("dims"), F.col("rep").cast("long"), "copies", "vector").mapInArrow(
            _encode, _CODED
        )
    )
    sizes = cut_lineage(coded.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("members")))
    total = sizes.where(F.col("members") <= tile_rows).agg(F.sum("members")).first()[0] or 0
    # Four times as many tiles as would hold them, since a few labels fall unevenly.
    shared_tiles = 4 * max(1, -(-total // tile_rows))
    big = F.col("members") > tile_rows
    tiles = (
        coded.join(sizes, ["label", "dims"])
        .withColumn("blocks", F.when(big, F.ceil(F.col("members") / tile_rows)).otherwise(F.lit(1)).cast("int"))
        .withColumn(
            "place",
            F.when(big, F.xxhash64("label", "dims")).otherwise(F.pmod(F.xxhash64("label", "dims"), F.lit(shared_tiles))),
        )
        .withColumn("own", F.pmod(F.xxhash64("rep", F.lit(11)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("first", F.least("own", "other"))
        .withColumn("second", F.greatest("own", "other"))
        .drop("members", "blocks", "other")
    )
    found = cut_lineage(
        tiles.groupBy("place", "first", "second").applyInArrow(_tile(threshold, kind), "rep long, root long, links long")
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # An id that lies in several classes joins them.
    usable_rows = own.where("vector IS NOT NULL")
    repeated = usable_rows.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id")
    shared = usable_rows.join(repeated, "id").join(classes.drop("copies"), ["label", "vector"])
    bridges = shared.select("rep", F.col("id").alias("root")).where("rep <> root")
    forest = found.select("rep", "root").unionByName(bridges)
    roots = connected_components(forest, "rep", "root").withColumnRenamed("node", "rep")
    per_class = classes.join(links, "rep", "left").join(roots, "rep", "left")
    per_class = cut_lineage(
        per_class.select(
            F.col("label").alias("class_label"),
            F.col("vector").alias("class_vector"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    same = (F.col("label") == F.col("class_label")) & (F.col("vector") == F.col("class_vector"))
    joined = own.join(per_class, same, "left")
    component = F.coalesce("component_id", "id")
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
