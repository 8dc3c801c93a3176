"""Document quality by regularised quadratic discriminant analysis over transformed text statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from omicspark.llm.folds import held_out, training_labels
from omicspark.session import cut_lineage

STATISTICS = (
    "log words", "log word length", "log words a sentence", "vocabulary growth", "repeated neighbours",
    "repeated lines", "upper case", "digits", "symbols", "marks", "white space",
)
_MARKS = [ord(c) for c in ".,;:'\"()-?"]


#: Added to the whole of a share, so that the shares of a text of a few words say little.
SHARE_PRIOR = 20


def _share(part: float, whole: float) -> float:
    """Angle of a share, whose variance hardly depends on the share, drawn to zero for a small whole."""
    return math.asin(math.sqrt(part / (whole + SHARE_PRIOR))) if part > 0 else 0.0


def statistics_of(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; null counts as empty."""
    data = (text or "").encode("utf-8", "replace")
    seen = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    size = len(data)
    space = int(seen[9:14].sum() + seen[32])
    upper, digits = int(seen[65:91].sum()), int(seen[48:58].sum())
    letters = upper + int(seen[97:123].sum() + seen[128:].sum())
    marks = int(seen[_MARKS].sum())
    symbols = size - space - letters - digits - marks
    words = data.lower().split()
    n = len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    distinct = len(set(words))
    return [
        math.log1p(n),
        math.log1p((size - space) / n) if n else 0.0,
        math.log1p(n / (1 + int(seen[46]))),
        math.log1p(distinct) / math.log1p(n) if n else 1.0,
        _share(sum(map(eq, words, words[1:])), n - 1),
        _share(len(lines) - len(set(lines)), len(lines)),
        _share(upper, letters),
        _share(digits, size),
        _share(symbols, size),
        _share(marks, size),
        _share(space, size),
    ]


def statistics(text: Column | str) -> Column:
    """The statistics of a text column as an array of doubles."""

    @F.pandas_udf("array<double>")
    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics_of(t) for t in texts], dtype=object)

    return apply(text)


@dataclass
class Discriminant:
    """Two Gaussian classes: prior log odds of label 1, means, and inverse Cholesky factors of the covariances."""

    log_odds: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    half_log_dets: np.ndarray | None = None

    @classmethod
    def fit(cls, counts: np.ndarray, sums: np.ndarray, products: np.ndarray, shrinkage: float, ridge: float) -> Discriminant:
        """From the number of rows, the sum and the sum of outer products of each class.

        A class covariance is (1 - shrinkage) of its own plus shrinkage of the pooled one's diagonal, plus a
        ridge relative to that diagonal. Without rows of both classes only the prior speaks.
        """
        log_odds = math.log((counts[1] + 1) / (counts[0] + 1))
        if counts.min() < 2:
            return cls(log_odds)
        means = sums / counts[:, None]
        scatter = products - counts[:, None, None] * means[:, :, None] * means[:, None, :]
        pooled = np.diag(np.clip(np.diag(scatter.sum(axis=0)) / counts.sum(), 1e-12, None))
        own = scatter / counts[:, None, None]
        lower = np.linalg.cholesky((1 - shrinkage) * own + (shrinkage + ridge) * pooled)
        dets = np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1)
        return cls(log_odds, means, np.linalg.inv(lower), dets)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1, from the difference of the log densities by Mahalanobis distances."""
        log_odds = np.full(len(rows), self.log_odds)
        if self.means is not None and len(rows):
            logs = [
                -0.5 * (((rows - m) @ f.T) ** 2).sum(axis=1) - d
                for m, f, d in zip(self.means, self.factors, self.half_log_dets)
            ]
            log_odds += logs[1] - logs[0]
        return 1 / (1 + np.exp(-np.clip(log_odds, -700, 700)))


def _moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per class of a task's rows: count, sums and products, as one flat array."""
    total = np.zeros((2, 1 + len(STATISTICS) + len(STATISTICS) ** 2))
    for frame in frames:
        if len(frame):
            rows = np.stack(frame["stats"].to_numpy())
            label = frame["label"].to_numpy()
            for c in (0, 1):
                x = rows[label == c]
                total[c] += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
    yield pd.DataFrame({"label": [0, 1], "moments": list(total)})


def fit(stats: DataFrame, labels: DataFrame, label_col: str, shrinkage: float = 0.2, ridge: float = 1e-3) -> Discriminant:
    """The discriminant of all rows of ``labels`` to learn from. ``stats`` has columns id and stats.

    Tasks reduce their rows to moments; what reaches the driver is one row per class, place and no more.
    """
    known = stats.join(training_labels(labels, label_col), "id").select("label", "stats")
    parts = known.mapInPandas(_moments, "label int, moments array<double>")
    flat = parts.select("label", F.posexplode("moments").alias("place", "value")).groupBy("label", "place")
    p = len(STATISTICS)
    total = np.zeros((2, 1 + p + p * p))
    for row in flat.agg(F.sum("value").alias("value")).collect():
        total[row["label"], row["place"]] = row["value"]
    return Discriminant.fit(total[:, 0], total[:, 1 : 1 + p], total[:, 1 + p :].reshape(2, p, p), shrinkage, ridge)


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
    shrinkage: float = 0.2,
    ridge: float = 1e-3,
) -> DataFrame:
    """(id, held_out, score, predicted), one row per input row; label 1 likelier the higher the score.

    Learns from all labelled rows that are not held out; a score uses the whole text and nothing else. Null
    and empty texts have the statistics of an empty text. Labels that are null or neither 0 nor 1 teach
    nothing; repeated labels of an id each count. With fewer than two rows of a class every score is the
    prior. Null ids keep their rows. Other columns are not read.
    """
    stats = cut_lineage(docs.select(F.col(id_col).alias("id"), statistics(F.col(text_col)).alias("stats")))
    model = fit(stats, labels, label_col, shrinkage, ridge)

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(column.to_numpy())) if len(column) else [], dtype="float64")

    scored = stats.select("id", held_out(F.col("id")).alias("held_out"), score("stats").alias("score"))
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``."""
    stats = cut_lineage(docs.select(F.col(id_col).alias("id"), statistics(F.col(text_col)).alias("stats")))
    model = fit(stats, labels, options.pop("label_col", "quality"), **options)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        rows = np.array([statistics_of(t) for t in texts]).reshape(len(texts), len(STATISTICS))
        return pd.Series(model.score(rows) >= threshold)

    return docs.where(good(F.col(text_col)))
