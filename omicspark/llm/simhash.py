"""Near-duplicate documents: SimHash fingerprints joined by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from omicspark.llm.components import connected_components, merge
from omicspark.session import cut_lineage

BITS = 64
#: Fingerprints of one bucket that one task compares at once.
BLOCK_ROWS = 1024
_CHUNK = 1 << 14


def fingerprint_of(text: str | None, words_per_shingle: int = 4, seed: int = 42) -> int:
    """Signed 64-bit fingerprint: each bit is the strict majority of that bit over the shingles' hashes."""
    if not text:
        return 0
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(words_per_shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - last].tolist(), ends[last:].tolist())
    hashes = np.fromiter((digest(joined[s:e], seed) for s, e in spans), dtype="<u8", count=len(words) - last)
    set_bits = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        octets = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column | str, words_per_shingle: int = 4, seed: int = 42) -> Column:
    """SimHash of a text column as a long; null, empty and blank texts give zero."""

    @F.pandas_udf("long")
    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, words_per_shingle, seed) for t in texts], dtype="int64")

    return apply(text)


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """Bit masks such that any two words within ``radius`` differing bits agree on all bits of some mask.

    Bit i gets a non-zero vector of radius + 1 binary digits; the mask of a non-zero vector v holds the bits
    whose vector has an odd product with v. Up to ``radius`` differing bits span at most ``radius``
    dimensions, so some v is orthogonal to all of them, and its mask avoids every differing bit.
    """
    count = (1 << (radius + 1)) - 1
    vectors = [1 + i % count for i in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, count + 1)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def link_forest(fingerprints: DataFrame, radius: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): pairs of distinct fingerprints within ``radius`` whose components are those of all such pairs.

    ``fingerprints`` has one distinct long column ``fp``. Every pair within the radius meets in a bucket.
    Buckets of one member go at once; a bucket of more than ``block_rows`` members is dealt into blocks by a
    hash, and each pair of blocks is one unit of work, so no task holds a bucket. Of a unit only a spanning
    forest of its links leaves the task, so a group of copies never lists its pairs.
    """
    tables = [
        F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(mask)))) for t, mask in enumerate(covering_masks(radius))
    ]
    rows = fingerprints.select("fp", F.explode(F.array(*tables)).alias("bucket"))
    shared = cut_lineage(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    blocks = F.ceil(F.col("members") / block_rows).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    units = (
        rows.join(shared, "bucket")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .groupBy("bucket", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"))
        .agg(F.collect_list("fp").alias("members"))
        .where(F.size("members") > 1)
    )
    return units.select("members").mapInArrow(lambda batches: _forests(batches, radius), "a long, b long").distinct()


def _forests(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        sizes = np.asarray(lists.value_lengths())
        values = np.asarray(lists.flatten()).astype(np.int64).view(np.uint64)
        ends = np.cumsum(sizes)
        found = [_small(values, np.repeat(np.arange(len(sizes)), sizes), sizes <= 32, radius)]
        for i in np.flatnonzero(sizes > 32):
            found.append(_large(values[ends[i] - sizes[i] : ends[i]], radius))
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _small(values: np.ndarray, unit: np.ndarray, small: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of all small units at once: each row against the next, the one after it, and so on."""
    keep = small[unit]
    values, unit = values[keep], unit[keep]
    left, right, step = [values[:0]], [values[:0]], 1
    while step < len(unit):
        at = np.flatnonzero(unit[step:] == unit[:-step])
        if not len(at):
            break
        at = at[np.bitwise_count(values[at] ^ values[at + step]) <= radius]
        left.append(values[at])
        right.append(values[at + step])
        step += 1
    return np.concatenate(left), np.concatenate(right)


def _large(values: np.ndarray, radius: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    labels = np.arange(len(values))
    for i in range(0, len(values), tile):
        for j in range(i, len(values), tile):
            near = np.bitwise_count(values[i : i + tile, None] ^ values[None, j : j + tile]) <= radius
            a, b = np.nonzero(near)
            apart = labels[a + i] != labels[b + j]
            labels = merge(labels, a[apart] + i, b[apart] + j)
    linked = np.flatnonzero(labels != np.arange(len(values)))
    return values[linked], values[labels[linked]]


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = 4,
    words_per_shingle: int = 4,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, fingerprint long, component_key, component_id), one row per input row.

    Documents with equal fingerprints are one class; classes within ``radius`` bits are linked.
    ``component_key`` is the smallest fingerprint of the component and ``component_id`` the smallest id in it.
    Null, empty and blank texts have fingerprint zero and are linked like any other. Rows that repeat an id
    each get a row; a null id never becomes a ``component_id`` unless its component holds no other id. An
    empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    marked = cut_lineage(
        docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), words_per_shingle).alias("fp"))
    )
    classes = cut_lineage(marked.groupBy("fp").agg(F.min("id").alias("first")))
    roots = connected_components(link_forest(classes.select("fp"), radius, block_rows)).withColumnRenamed("node", "fp")
    rooted = cut_lineage(
        classes.join(roots, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    )
    firsts = cut_lineage(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = cut_lineage(rooted.join(firsts, "root").select("fp", "root", "component_id"))
    return marked.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.col("fp").alias("fingerprint"),
        F.col("root").alias("component_key"),
        "component_id",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one document of each component is kept.

    The row with the component's smallest id stays. Where several rows of a component carry that id, or none
    has an id, one with the smallest text stays. ``options`` go to ``near_duplicates``.
    """
    found = cut_lineage(near_duplicates(docs, id_col, text_col, **options))
    wins = F.col(id_col).eqNullSafe(F.col("component_id"))
    ids = cut_lineage(
        found.groupBy(F.col(id_col).alias("_id"))
        .agg(F.count(F.lit(1)).alias("_rows"), F.max(wins).alias("_wins"))
        .where("_wins")
    )
    alone = F.col("_rows").eqNullSafe(1) & F.col("_id").isNotNull()
    # Texts move once, to the ids that stay: a sort-merge join at every size, so the cost follows the input.
    single = docs.join(ids.where(alone).select("_id").hint("merge"), docs[id_col] == F.col("_id"), "left_semi")
    if ids.where(~alone).isEmpty():
        return single
    several = docs.join(ids.where(~alone).select("_id"), docs[id_col].eqNullSafe(F.col("_id")), "left_semi")
    winners = found.where(wins).select(
        F.col(id_col).alias("_id"), F.col("fingerprint").alias("_fp"), F.col("component_key").alias("_key")
    )
    row = F.struct(*[F.col(c) for c in docs.columns])
    marked = several.select(
        row.alias("_row"),
        F.col(id_col).alias("_own"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        fingerprint(F.col(text_col), options.get("words_per_shingle", 4)).alias("_own_fp"),
    )
    both = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_fp") == F.col("_fp"))
    picked = marked.join(winners.distinct(), both).groupBy("_key").agg(F.min_by("_row", "_text").alias("_row"))
    return single.unionByName(picked.select("_row.*"))
