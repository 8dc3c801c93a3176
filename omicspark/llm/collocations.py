"""Phrase collocations of each language: best-first growth of prefixes under admissible score bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from omicspark.session import cut_lineage

LONGEST = 4
LEAST_COUNT = 30
SCALE = 2_000_000
#: A candidate gives way to a longer one with at least this share of its count, in percent.
COVERED_PERCENT = 80
#: Words that are counted together before their phrases leave a task.
BATCH_WORDS = 1 << 18
#: Size of a filter over phrases; a filled filter lets more phrases be counted and changes no result.
FILTER_BITS = 1 << 25
#: The first frontier reaches as many pairs as this many limits; each next one is ``WIDER`` times as wide.
FIRST_WIDTH = 2
WIDER = 8

_BREAK = b"\xff"  # never part of UTF-8
_TO_BREAK = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _BREAK * 10 + b" ")
_COUNTS = "lang string, phrase string, f long"


def _tokens(text: str) -> list[bytes]:
    """The words of a text with a break after each piece."""
    data = text.encode("utf-8", "replace").lower().translate(_TO_BREAK)
    return (data + _BREAK).replace(_BREAK, b" " + _BREAK + b" ").split()


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"))
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def _joined_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word and that of the last word."""
    mixed = (left * np.uint64(0x9E3779B97F4A7C15)) ^ right
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


class PhraseFilter:
    """A fixed-size bit table of phrases; it may hold others too, never fewer."""

    def __init__(self, phrases: DataFrame, bits: int) -> None:
        """``phrases`` has lang and phrase. The table, ``bits`` bits at most, is put together by aggregation."""
        spots = phrases.select("lang", "phrase").mapInArrow(lambda batches: _spots(batches, bits), "spot long")
        blocks = spots.groupBy(F.bitmap_bucket_number("spot").alias("block")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")
        )
        table = np.zeros(bits // 8, dtype=np.uint8)
        for block, part in blocks.toLocalIterator():
            part = np.frombuffer(bytes(part), dtype=np.uint8)[: len(table)]
            at = (block - 1) * len(part)
            table[at : at + len(part)] = part
        self._table = phrases.sparkSession.sparkContext.broadcast(table)

    def release(self) -> None:
        """Executors need not keep the table; what was counted with it has been written."""
        self._table.unpersist()

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        table = self._table.value
        spot = hashes & np.uint64(len(table) * 8 - 1)
        return (table[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _spots(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = []
        for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = _word_hashes(lang, phrase.encode("utf-8", "replace").split(b" "))
            hashed = words[:1]
            for k in range(1, len(words)):
                hashed = _joined_hash(hashed, words[k : k + 1])
            hashes.append(hashed)
        spots = (np.concatenate(hashes) & np.uint64(bits - 1)).astype(np.int64) + 1 if hashes else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(spots)], names=["spot"])


#: From the hashes of all but the last word and of all but the first word of phrases: which to count.
Choice = Callable[[np.ndarray, np.ndarray], np.ndarray]


class _Held:
    """Words of one language that wait to be counted, as codes; 0 is a break."""

    def __init__(self) -> None:
        self.vocabulary = {_BREAK: 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        tokens = _tokens(text)
        for w in set(tokens).difference(self.vocabulary):
            self.vocabulary[w] = len(self.vocabulary)
        self.parts.append(np.fromiter(map(self.vocabulary.__getitem__, tokens), dtype=np.int32, count=len(tokens)))
        self.size += len(tokens)


def _counted(lang: str, held: _Held, size: int, choice: Choice | None) -> pa.RecordBatch:
    """(lang, phrase, f) of the phrases of ``size`` words in ``held`` that ``choice`` takes."""
    vocabulary = held.vocabulary
    codes = np.concatenate(held.parts).astype(np.int64)
    spelled = pa.array(list(vocabulary)[1:], pa.binary()).cast(pa.string())
    whole = np.flatnonzero(codes)
    if size == 1:
        counts = np.bincount(codes[whole], minlength=len(vocabulary))[1:]
        phrases = spelled
    else:
        hashes = _word_hashes(lang, list(vocabulary))[codes]
        whole = whole[whole + size <= len(codes)]
        for k in range(1, size):
            whole = whole[codes[whole + k] != 0]
        first, last = hashes[whole], hashes[whole + 1]
        for k in range(1, size - 1):
            first = _joined_hash(first, hashes[whole + k])
            last = _joined_hash(last, hashes[whole + 1 + k])
        whole = whole[choice(first, last)]
        # Numbers of the distinct beginnings, one word longer at each step; their digits spell the phrases again.
        base = len(vocabulary)
        ids, distinct = codes[whole], []
        for k in range(1, size - 1):
            shorter, ids = np.unique(ids * base + codes[whole + k], return_inverse=True)
            distinct.append(shorter)
        last, counts = np.unique(ids * base + codes[whole + size - 1], return_counts=True)
        words = []
        for shorter in reversed(distinct):
            words.append(last % base)
            last = shorter[last // base]
        words += [last % base, last // base]
        words = [spelled.take(pa.array(w - 1)) for w in reversed(words)]
        phrases = pc.binary_join_element_wise(*words, " ")
    langs = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(phrases), dtype=np.int64)))
    return pa.RecordBatch.from_arrays([langs, phrases, pa.array(counts, pa.int64())], names=["lang", "phrase", "f"])


def count_phrases(docs: DataFrame, size: int, choice: Choice | None = None, least: int = 1) -> DataFrame:
    """(lang, phrase, f) of phrases of ``size`` words with f >= ``least``, over the columns lang and text.

    Tasks count ``BATCH_WORDS`` words of a language at a time, Spark adds up before and after the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, _Held] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang = lang.as_py()
                held = waiting.setdefault(lang, _Held())
                held.add(text.as_py())
                if held.size >= BATCH_WORDS:
                    yield _counted(lang, waiting.pop(lang), size, choice)
            # Languages may be many: together they hold no more than a few batches.
            while sum(x.size for x in waiting.values()) >= 2 * BATCH_WORDS:
                lang = max(waiting, key=lambda x: waiting[x].size)
                yield _counted(lang, waiting.pop(lang), size, choice)
        for lang, held in waiting.items():
            yield _counted(lang, held, size, choice)

    found = docs.mapInArrow(run, _COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return found.where(F.col("f") >= least)


def _ratio(a: str, total: str) -> Column:
    """floor(SCALE * a / total), in whole numbers that may pass 64 bits."""
    return F.expr(f"cast({a} as decimal(19,0)) * cast({SCALE} as decimal(8,0)) div ({total})").cast("long")


def _sum(x: str, y: str) -> str:
    return f"cast({x} as decimal(19,0)) + cast({y} as decimal(19,0))"


def scored(candidates: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """(lang, phrase, a, score, l, r, grows, starts) of phrases of ``size`` words whose parts are all in ``counts``.

    The lowest cut gives the score, the first of equal ones. Any longer phrase that begins with this one scores
    ``grows`` at most, any that ends with it ``starts``: its count is at most a, its outer part at least the
    first or last word's count, and the score rises with the count.
    """
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    cuts = F.array(
        *[F.struct(F.lit(k).alias("k"), part(1, k).alias("first"), part(k + 1, size - k).alias("rest")) for k in range(1, size)]
    )
    rows = candidates.select("lang", "phrase", F.col("f").alias("a"), F.inline(cuts))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    rows = rows.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    rows = rows.withColumn("score", _ratio("a", _sum("l", "r")))
    best = rows.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("best"),
        F.max(F.when(F.col("k") == 1, F.col("l"))).alias("head"),
        F.max(F.when(F.col("k") == size - 1, F.col("r"))).alias("tail"),
        F.count(F.lit(1)).alias("cuts"),
    )
    return best.where(F.col("cuts") == size - 1).select(
        "lang", "phrase", "a", "best.score", "best.l", "best.r",
        _ratio("a", _sum("head", "a")).alias("grows"),
        _ratio("a", _sum("tail", "a")).alias("starts"),
    )


def _covered(longer: DataFrame, size: int) -> DataFrame:
    """(lang, phrase, longest_f): the phrases one word shorter inside phrases of ``size`` words, with the largest count."""
    words = F.split("phrase", " ")
    inner = F.array(*[F.array_join(F.slice(words, k, size - 1), " ") for k in (1, 2)])
    rows = longer.select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f")
    return rows.groupBy("lang", "phrase").agg(F.max("f").alias("longest_f"))


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    limit: int = 2000,
    least: int = LEAST_COUNT,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``limit`` best phrases of 2 to 4 words of each language.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line breaks, and pieces into words at spaces
    and tabs. ``n`` counts all words of the language, ``a`` all places of the phrase within pieces. The score is
    the least over the cuts of a phrase of floor(2000000 * a / (l + r)), where l and r count its parts. Phrases
    with a < ``least`` are no candidates; one whose words lie inside a longer candidate with 80 % of its count or
    more is dropped. Order: score descending, a descending, phrase ascending by bytes.

    Growth is best-first. All pairs of frequent words are counted and scored; the frontier holds the prefixes
    (and suffixes) whose bound reaches the score of a language's pair of rank 2 * ``limit``. Only phrases that
    the frontier may grow into, or that may cover a phrase of at least that score, are counted. Every phrase of
    that score or more is then known exactly, with what covers it; a language with ``limit`` survivors among
    them is settled, ties included. Others go on with a frontier eight times as wide, at last with all of it.

    Null texts count as empty, a null language as ``und``. Repeated rows count each time. A language without
    candidates has no rows, an empty table gives an empty result, and other columns are not read.
    """
    texts = docs.select(
        F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    words = cut_lineage(count_phrases(texts, 1))
    totals = cut_lineage(words.groupBy("lang").agg(F.sum("f").alias("n")))
    frequent = cut_lineage(words.where(F.col("f") >= least))
    known = PhraseFilter(frequent, filter_bits)
    pairs = cut_lineage(count_phrases(texts, 2, lambda p, q: known(p) & known(q), least))
    known.release()
    pair_scores = cut_lineage(scored(pairs, frequent, 2))
    is_pair = PhraseFilter(pairs, filter_bits)
    counts = frequent.unionByName(pairs)
    # How many pairs reach each score that occurs; scores are whole numbers up to a million.
    upto = Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heights = pair_scores.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("pairs"))
    heights = cut_lineage(heights.select("lang", "score", F.sum("pairs").over(upto).alias("reached")))
    pending = totals.select("lang")
    settled, width = [], FIRST_WIDTH * limit
    while True:
        level = heights.where(F.col("reached") >= width).groupBy("lang").agg(F.max("score").alias("score"))
        floors = cut_lineage(
            pending.join(level, "lang", "left").select("lang", F.coalesce("score", F.lit(0)).cast("long").alias("floor"))
        )
        top = _reaching(texts, pair_scores, pairs, counts, is_pair, floors, least, filter_bits)
        ready = cut_lineage(
            floors.join(top.groupBy("lang").agg(F.count(F.lit(1)).alias("found")), "lang", "left").select(
                "lang", ((F.col("floor") == 0) | (F.coalesce("found", F.lit(0)) >= limit)).alias("done")
            )
        )
        settled.append(top.join(ready.where("done"), "lang", "left_semi"))
        pending = ready.where("NOT done").select("lang")
        if pending.isEmpty():
            break
        width *= WIDER
    is_pair.release()
    survivors = settled[0]
    for more in settled[1:]:
        survivors = survivors.unionByName(more)
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = survivors.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= limit)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _reaching(
    texts: DataFrame,
    pair_scores: DataFrame,
    pairs: DataFrame,
    counts: DataFrame,
    is_pair: PhraseFilter,
    floors: DataFrame,
    least: int,
    filter_bits: int,
) -> DataFrame:
    """(lang, phrase, a, l, r, score): the surviving candidates whose score reaches their language's floor."""

    def over(scores: DataFrame, column: str) -> PhraseFilter:
        return PhraseFilter(scores.where(F.col(column) >= F.col("floor")), filter_bits)

    two = cut_lineage(pair_scores.join(floors, "lang"))
    grows, starts = over(two, "grows"), over(two, "starts")
    triples = cut_lineage(
        count_phrases(texts, 3, lambda p, q: is_pair(p) & is_pair(q) & (grows(p) | starts(q)), least)
    )
    three = cut_lineage(scored(triples, counts, 3).join(floors, "lang"))
    grows3, starts3, good3 = over(three, "grows"), over(three, "starts"), over(three, "score")
    quads = cut_lineage(
        count_phrases(texts, 4, lambda p, q: (grows3(p) & starts3(q)) | good3(p) | good3(q), least)
    )
    four = scored(quads, counts.unionByName(triples), 4).join(floors, "lang")
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    best = [x.where(F.col("score") >= F.col("floor")).select(*columns) for x in (two, three, four)]
    kept = best[2]
    for shorter, longer, size in ((best[0], triples, 3), (best[1], quads, 4)):
        held = shorter.join(_covered(longer, size), ["lang", "phrase"], "left")
        wide = lambda x, by: F.col(x).cast("decimal(19,0)") * F.lit(by).cast("decimal(4,0)")
        free = F.col("longest_f").isNull() | (wide("longest_f", 100) < wide("a", COVERED_PERCENT))
        kept = kept.unionByName(held.where(free).select(*columns))
    kept = cut_lineage(kept)
    for table in (grows, starts, grows3, starts3, good3):
        table.release()
    return kept
