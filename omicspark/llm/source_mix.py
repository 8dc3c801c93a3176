"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, then seeded block selection."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from omicspark.session import cut_lineage

#: Words of a block, and documents that a shard of a source holds on average.
BLOCK_WORDS, SHARD_DOCS = 32, 2048
WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hex_number(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size, docs, target) from (source, source_size, docs), one row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all sizes; a target
    stops at ``limit`` times its source's size and the excess goes to the others by weight, until none is
    above. One small aggregate decides each round; its sums are all that reaches the driver.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = cut_lineage(
        sizes.withColumn("weight", turn[F.pmod(place, F.lit(len(weights)))]).withColumn("most", F.col("source_size") * limit)
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("most") <= F.col("weight") * level
        row = weighed.agg(
            F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("held"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row["open"]:
            break
        after = (total * share - row["held"]) / row["open"]
        if after <= level:
            break
        level = after
    target = F.least(F.col("most"), F.col("weight") * level)
    return weighed.select("source", "source_size", "docs", target.alias("target"))


def highest_quotients(rows: DataFrame, seats: Column, ideal: str, order: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``quota``: Sainte-Lague seats of each row among the rows with equal ``keys``.

    A row with the ideal share x asks with the quotients x / (2 i + 1); the ``seats`` highest win, ties by
    ``order``. Rounding x seats all but a few: the quotients of at least 1/2 number round(x). What is missing
    goes to the highest quotients left, what is too much is taken from the lowest given, which is the same
    result without listing the seats.
    """
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    rounded = F.floor(F.col(ideal) + 0.5).cast("long")
    start = rows.withColumn("_q", rounded).withColumn("_lack", (seats - F.sum(rounded).over(group)).cast("long"))
    start = start.withColumn("_rank", F.row_number().over(group.orderBy(*order)))
    start = start.withColumn("_share", F.col(ideal) / F.greatest(F.sum(ideal).over(group), F.lit(1e-300)))
    spread = F.ceil(F.abs(F.col("_lack")) * F.col("_share") + 2).cast("long")
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("_lack") == 0, 0).otherwise(spread).cast("long")))
    asked = start.withColumn("_i", step)
    divisor = F.when(F.col("_lack") > 0, 2 * (F.col("_q") + F.col("_i")) + 1).otherwise(2 * (F.col("_q") - F.col("_i")) - 1)
    asked = asked.withColumn("_quotient", F.when(divisor > 0, F.col(ideal) / divisor))
    turn = F.when(F.col("_lack") > 0, 1).otherwise(-1)
    high = group.orderBy((-turn * F.col("_quotient")).asc_nulls_last(), turn * F.col("_rank"), "_i")
    chosen = asked.withColumn("_won", (F.row_number().over(high) <= F.abs(F.col("_lack"))) & F.col("_quotient").isNotNull())
    moved = F.sum(F.col("_won").cast("long")) * F.signum(F.first("_lack")).cast("long")
    return chosen.groupBy(*rows.columns).agg((F.first("_q") + moved).alias("quota"))


def _selected_before(block: Column) -> Column:
    """Extra blocks among the first ``block`` of a stream: ``_extra`` of ``_blocks``, evenly spread from a seeded start."""
    return F.floor((block * F.col("_extra") + F.col("_offset")) / F.col("_blocks")).cast("long")


def _words_before(word: Column, block_words: int) -> Column:
    """Words that the mix takes among the first ``word`` words of a shard's stream."""
    block = F.floor(word / block_words).cast("long")
    chosen = _selected_before(block)
    here = _selected_before(block + 1) - chosen
    return F.col("_passes") * word + chosen * block_words + here * (word - block * block_words)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    limit: int = 2,
    block_words: int = BLOCK_WORDS,
    shard_docs: int = SHARD_DOCS,
    seed: int = 0,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken and where its words stand.

    A source's documents are dealt by a hash into shards of about ``shard_docs``, so no task holds a source,
    and laid end to end in hash order as a stream of blocks of ``block_words`` words. Sainte-Lague quotients
    divide all blocks among the sources, and a source's blocks among its shards. A shard takes every block
    quota // blocks times, and once more evenly spaced blocks from a seeded start. ``taken`` counts the words
    of a document in taken blocks: at most ``limit`` times its size. Reruns give the same rows.

    ``start``, ``_passes``, ``_extra``, ``_blocks`` and ``_offset`` say which words (see ``taken_text``).
    Null and blank texts have size 0 and nothing is taken of them; a null source is a source of its own; rows
    that share an id are told apart by their text, and equal rows may swap. With no words at all every target
    is 0. Columns of ``carry`` are passed on; others are not read.
    """
    own = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("_mark"),
        F.xxhash64(F.col(text_col)).alias("_tie"),
        *[F.col(c) for c in carry],
    )
    own = cut_lineage(own)
    sizes = cut_lineage(own.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")))
    targets = source_targets(sizes, weights, share, limit)
    total = targets.agg(F.sum("target").alias("t")).first()["t"] or 0.0
    ideal = targets.withColumn("_ideal", F.col("target") / block_words)
    seats = F.lit(round(total / block_words))
    quotas = highest_quotients(ideal, seats, "_ideal", [F.col("source").asc_nulls_last()]).withColumnRenamed("quota", "source_quota")
    quotas = cut_lineage(quotas.withColumn("shards", F.ceil(F.col("docs") / shard_docs).cast("long")))

    plan = quotas.withColumnRenamed("source", "_source")
    dealt = own.join(plan.select("_source", "source_size", "target", "shards"), own["source"].eqNullSafe(plan["_source"]))
    dealt = dealt.withColumn("shard", F.pmod(_hex_number(F.col("_mark"), 1, 8), F.col("shards"))).drop("_source", "shards")
    dealt = cut_lineage(dealt)
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("_words"))
    shards = shards.join(plan.select("_source", "source_quota", "source_size"), shards["source"].eqNullSafe(plan["_source"]))
    share_of = F.when(F.col("source_size") > 0, F.col("_words") * F.col("source_quota") / F.col("source_size")).otherwise(0.0)
    shards = shards.select("source", "shard", "_words", "source_quota", share_of.alias("_ideal"))
    shards = highest_quotients(shards, F.col("source_quota"), "_ideal", [F.col("shard")], ["source"])
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_words") / block_words)).cast("long")
    shards = (
        shards.withColumn("_blocks", blocks)
        .withColumn("quota", F.greatest(F.lit(0), F.least("quota", limit * F.col("_blocks"))))
        .withColumn("_passes", F.floor(F.col("quota") / F.col("_blocks")).cast("long"))
        .withColumn("_extra", F.col("quota") % F.col("_blocks"))
    )
    seeded = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("shard"), F.coalesce("source", F.lit("")), F.col("shard").cast("string")))
    shards = shards.withColumn("_offset", F.pmod(_hex_number(seeded, 1, 8), F.col("_blocks")))
    shards = cut_lineage(shards.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "_blocks", "_passes", "_extra", "_offset"))

    stream = Window.partitionBy("source", "shard").orderBy("_mark", "_tie")
    placed = dealt.withColumn("start", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    joined = placed.join(shards, placed["source"].eqNullSafe(shards["_source"]) & (placed["shard"] == shards["_shard"]))
    taken = _words_before(F.col("start") + F.col("size"), block_words) - _words_before(F.col("start"), block_words)
    return joined.withColumn("taken", taken.cast("long")).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken",
        "start", "_passes", "_extra", "_blocks", "_offset", *carry,
    )


def taken_spans(size: int, start: int, passes: int, extra: int, blocks: int, offset: int, block_words: int) -> list[list[tuple[int, int]]]:
    """For each pass over a document, the word ranges that the mix takes: all of it, then its extra blocks."""
    whole = [[(0, size)]] * passes if size else []
    ranges: list[tuple[int, int]] = []
    if size and extra:
        for b in range(start // block_words, (start + size - 1) // block_words + 1):
            if ((b + 1) * extra + offset) // blocks > (b * extra + offset) // blocks:
                low, high = max(0, b * block_words - start), min(size, (b + 1) * block_words - start)
                if ranges and ranges[-1][1] == low:
                    ranges[-1] = (ranges[-1][0], high)
                else:
                    ranges.append((low, high))
    return whole + ([ranges] if ranges else [])


def taken_text(mixed: DataFrame, text_col: str = "text", block_words: int = BLOCK_WORDS) -> Column:
    """The texts that the mix takes of a document, one per pass; its word ranges stand on lines of their own."""
    import re

    words = re.compile("[^\x20\x09-\x0d]+")

    @F.pandas_udf("array<string>")
    def apply(
        texts: pd.Series, size: pd.Series, start: pd.Series, passes: pd.Series, extra: pd.Series, blocks: pd.Series, offset: pd.Series
    ) -> pd.Series:
        out = []
        for text, *place in zip(texts, size, start, passes, extra, blocks, offset):
            pieces, spans = [], None
            for ranges in taken_spans(*map(int, place), block_words):
                if ranges == [(0, int(place[0]))]:
                    pieces.append(text)
                    continue
                spans = spans or [m.span() for m in words.finditer(text)]
                pieces.append("\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in ranges))
            out.append(pieces)
        return pd.Series(out, dtype=object)

    return apply(*[mixed[c] for c in (text_col, "size", "start", "_passes", "_extra", "_blocks", "_offset")])
