"""Toxicity by compression distance between zstandard dictionaries of toxic and of ordinary text."""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from omicspark.llm.folds import held_out, training_labels
from omicspark.session import cut_lineage

#: Bounds of the labelled sample that the dictionaries and thresholds are fitted on, per class.
SAMPLE_DOCS, SAMPLE_BYTES = 4000, 24 << 20
#: Sizes of the two dictionaries, words of a window, and the range of a window's saving in bytes.
ORDINARY_BYTES, TOXIC_BYTES, WINDOW_WORDS, SAVING = 8192, 1024, 16, 24
#: A word teaches the toxic dictionary if its log likelihood ratio statistic (G) between the classes reaches this,
#: however often other words stand in toxic texts. With one toxic document in nine it takes 16 toxic documents.
PIECE_EVIDENCE = 70.0
_LEVEL = 9
#: ASCII letters become small and every other ASCII character but a digit a space.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_PLAIN).split()


def windows(text: str | None) -> list[bytes]:
    """The words of the whole text, without ASCII marks and capitals, in windows of 16."""
    words = _words(text)
    return [b" %b " % b" ".join(words[i : i + WINDOW_WORDS]) for i in range(0, len(words), WINDOW_WORDS)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    options = zstandard.ZstdCompressionParameters.from_level(
        _LEVEL, dict_size=len(content), source_size=256, min_match=3,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=options)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=options)


class Savings:
    """Bytes that a window's compressed form loses when the toxic dictionary stands before the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.both = _compressor(ordinary), _compressor(toxic + ordinary)

    def of(self, parts: list[bytes]) -> np.ndarray:
        plain, knowing = self.ordinary.compress, self.both.compress
        saved = np.array([len(plain(w)) - len(knowing(w)) for w in parts], dtype=np.int64)
        return np.clip(saved, -SAVING, SAVING) + SAVING


@functools.lru_cache(maxsize=2)
def _savings(ordinary: bytes, toxic: bytes) -> Savings:
    return Savings(ordinary, toxic)


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary of the samples, or their newest bytes where there are too few to train on."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, k=16, d=6, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _toxic_pieces(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> set[bytes]:
    """Words that stand in toxic documents significantly more often, each document counted once.

    Small samples cannot reach the level; there the words with at least half of the best one's evidence count.
    """
    inside, outside = Counter(w for d in toxic for w in set(d)), Counter(w for d in ordinary for w in set(d))
    n, m = max(1, len(toxic)), max(1, len(ordinary))
    evidence = {}
    for word, count in inside.items():
        other = outside[word]
        if count > 1 and count / n > other / m:
            expected = (count + other) * n / (n + m)
            rest = other * math.log(other / (count + other - expected)) if other else 0.0
            evidence[word] = 2 * (count * math.log(count / expected) + rest)
    level = min(PIECE_EVIDENCE, max(evidence.values(), default=0.0) / 2)
    return {w for w, x in evidence.items() if x >= level}


@dataclass(frozen=True)
class Model:
    """Dictionaries, log likelihood ratio of a window's saving, and the calibration of a document's features."""

    ordinary: bytes = b""
    toxic: bytes = b""
    ratios: tuple[float, ...] = ()
    weights: tuple[float, ...] = (0.0,)

    def features(self, text: str | None) -> list[float]:
        """(1, mean ratio, largest ratio) over all windows of a text; a text without words has no evidence."""
        parts = windows(text)
        if not parts or not self.ratios:
            return [1.0, 0.0, 0.0]
        found = np.asarray(self.ratios)[_savings(self.ordinary, self.toxic).of(parts)]
        return [1.0, float(found.mean()), float(found.max())]

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.ratios:
            return np.full(len(texts), 1 / (1 + math.exp(-self.weights[0])))
        rows = np.array([self.features(t) for t in texts]).reshape(len(texts), 3)
        return 1 / (1 + np.exp(-np.clip(rows @ np.array(self.weights), -700, 700)))


def fit(toxic: list[str], ordinary: list[str], log_odds: float) -> Model:
    """A model from two lists of texts and the log odds of a toxic document among the labelled ones."""
    if not toxic or not ordinary:
        return Model(weights=(log_odds,))
    words = [[_words(t) for t in part] for part in (toxic, ordinary)]
    pieces = _toxic_pieces(*words)
    common = _trained(ORDINARY_BYTES, [b" ".join(sorted(set(d))) for d in words[1]])
    special = _trained(TOXIC_BYTES, [b"".join(b" %b " % w for w in d if w in pieces) for d in words[0]])
    if not common or not special:
        return Model(weights=(log_odds,))
    savings = Savings(common, special)
    found = [[savings.of(windows(t)) for t in part] for part in (toxic, ordinary)]
    hist = [np.bincount(np.concatenate(part), minlength=2 * SAVING + 1) + 1.0 for part in found]
    ratios = np.log(hist[0] / hist[0].sum()) - np.log(hist[1] / hist[1].sum())
    model = Model(common, special, tuple(ratios))
    rows = [[[1.0, ratios[s].mean(), ratios[s].max()] if len(s) else [1.0, 0.0, 0.0] for s in part] for part in found]
    weights = _logistic(np.array(rows[0] + rows[1]), np.repeat([1.0, 0.0], [len(toxic), len(ordinary)]))
    weights[0] += log_odds - math.log(len(toxic) / len(ordinary))
    return Model(common, special, model.ratios, tuple(weights))


def _logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps on the penalised likelihood; the first column is the intercept."""
    weights = np.zeros(rows.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (rows.shape[1] - 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (labels - p) - penalty @ weights
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + penalty, slope)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of a bounded sample of labelled rows that are not held out.

    Of each class the documents with the smallest hashes of their text are taken, each distinct text once, up
    to SAMPLE_DOCS documents and SAMPLE_BYTES of text; a text that does not fit is passed over. Only they reach
    the driver.
    """
    spark: SparkSession = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    known = own.select("id", F.xxhash64("text").alias("mark"), F.octet_length("text").alias("size"))
    known = cut_lineage(known.join(training_labels(labels, label_col), "id").groupBy("label", "mark", "size").agg(F.min("id").alias("id")))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    log_odds = math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))
    picked: list[tuple] = []
    for label in (0, 1):
        left = SAMPLE_BYTES
        for row in known.where(F.col("label") == label).orderBy("mark", "id").limit(SAMPLE_DOCS).collect():
            if row["size"] <= left:
                left -= row["size"]
                picked.append((row["id"], row["mark"], label))
    chosen = spark.createDataFrame(picked, f"id {own.schema['id'].dataType.simpleString()}, mark long, label int")
    # At most two times SAMPLE_DOCS rows of three numbers, so no text has to move to meet them.
    rows = own.join(F.broadcast(chosen), "id").where(F.xxhash64("text") == F.col("mark")).select("label", "mark", "text").collect()
    texts = {(r["label"], r["mark"]): r["text"] for r in rows}
    return fit(*([texts[k] for k in sorted(texts) if k[0] == label] for label in (1, 0)), log_odds)


def toxicity(text: Column | str, model: Model) -> Column:
    """Score of a text column: 0 to 1, toxic likelier the higher."""

    @F.pandas_udf("double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(list(texts)), dtype="float64")

    return apply(text)


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.5,
) -> DataFrame:
    """(id, held_out, score, predicted), one row per input row, over every window of every text.

    Null, empty and blank texts score as texts without evidence. Labels that are null or neither 0 nor 1
    teach nothing. Without labelled texts of both classes every score is the prior. Null ids keep their rows
    and are not held out. Other columns are not read.
    """
    model = train(docs, labels, id_col, text_col, label_col)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = own.select("id", held_out(F.col("id")).alias("held_out"), toxicity("text", model).alias("score"))
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
