"""Periodic runs of words: harmonic grids of word pairs, extended by a difference-cover index of common extensions."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A perfect difference set. For any i and j some k < CYCLE puts both i + k and j + k into COVER.
CYCLE = 31
COVER = (0, 1, 3, 8, 12, 18)

#: Words that are searched together; a longer text is searched by itself.
BATCH_WORDS = 1 << 18
_PAIRS = 1 << 20
_PIECE = 1 << 22
_FEW = 8

RUN = "struct<start:long,length:long,period:long>"


def _sync_table() -> np.ndarray:
    """``table[a, b]``: the least k that puts both a + k and b + k into the cover."""
    inside = np.isin(np.arange(CYCLE), COVER)
    table = np.full((CYCLE, CYCLE), -1, dtype=np.int64)
    for k in range(CYCLE):
        moved = np.roll(inside, -k)
        table[(table < 0) & moved[:, None] & moved[None, :]] = k
    return table


_SYNC = _sync_table()


class RangeMinimum:
    """Sparse table: the minimum of any range of ``values`` by two overlapping power-of-two ranges."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def query(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of ``values[first..last]``, both ends included and first <= last."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), dtype=self.levels[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            table = self.levels[k]
            out[at] = np.minimum(table[first[at]], table[last[at] - (1 << k) + 1])
        return out


class CommonExtensions:
    """Longest common extension of two places of the same text in ``words``.

    ``words`` holds texts one after the other, each followed by a code that no other place has, and ``text_of``
    names the text of each place. Only the suffixes at cover residues are sorted: by text, by their first
    ``CYCLE`` words, then by ranks at doubled distances. Splits of a group give the common prefixes of neighbours.
    """

    def __init__(self, words: np.ndarray, text_of: np.ndarray) -> None:
        self.words = words
        places = np.flatnonzero(np.isin(np.arange(len(words)) % CYCLE, COVER))
        self.index = np.full(len(words), -1, dtype=np.int64)
        self.index[places] = np.arange(len(places))
        self.rank = np.zeros(len(places), dtype=np.int64)
        self.common = np.full(len(places), np.iinfo(np.int32).max, dtype=np.int32)
        active = self._split(np.arange(len(places)), text_of[places], lambda a, b: np.zeros(len(a), dtype=np.int64))
        ended = len(words) - 1
        for t in range(CYCLE):
            if not len(active):
                break
            key = words[np.minimum(places[active] + t, ended)]
            active = self._split(active, key, lambda a, b, t=t: np.full(len(a), t))
        distance = CYCLE
        while len(active):
            minima = RangeMinimum(self.common)
            key = self.rank[self.index[places[active] + distance]]
            active = self._split(active, key, lambda a, b, h=distance, m=minima: h + m.query(np.minimum(a, b) + 1, np.maximum(a, b)))
            distance *= 2
        self.minima = RangeMinimum(self.common)

    def _split(self, active: np.ndarray, key: np.ndarray, shared) -> np.ndarray:
        """Order the members of each group of equal rank by ``key``; returns those whose new group has company."""
        order = np.lexsort((key, self.rank[active]))
        active, key = active[order], key[order]
        old = self.rank[active]
        opens = np.concatenate([[True], old[1:] != old[:-1]])
        parts = opens | np.concatenate([[True], key[1:] != key[:-1]])
        at = np.arange(len(active))
        group_start = np.maximum.accumulate(np.where(opens, at, 0))
        part_start = np.maximum.accumulate(np.where(parts, at, 0))
        rank = old + part_start - group_start
        cut = np.flatnonzero(parts & ~opens)
        self.common[rank[cut]] = shared(key[cut - 1], key[cut])
        self.rank[active] = rank
        first = np.flatnonzero(parts)
        size = np.diff(np.append(first, len(active)))
        return active[np.repeat(size > 1, size)]

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of words from places ``i`` and ``j`` on that are equal, for i != j of one text."""
        sync = _SYNC[i % CYCLE, j % CYCLE]
        found = sync.copy()
        alive = np.arange(len(i))
        for t in range(CYCLE):
            alive = alive[sync[alive] > t]
            if not len(alive):
                break
            differ = self.words[i[alive] + t] != self.words[j[alive] + t]
            found[alive[differ]] = t
            alive = alive[~differ]
        whole = np.flatnonzero(found == sync)
        a = self.rank[self.index[i[whole] + sync[whole]]]
        b = self.rank[self.index[j[whole] + sync[whole]]]
        found[whole] += self.minima.query(np.minimum(a, b) + 1, np.maximum(a, b))
        return found


def _grid(lengths: np.ndarray, least: int, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of the harmonic grid, in parts of about ``_PAIRS`` points.

    The places i with words i and i + q equal form, for a run of period q, a stretch of at least
    max(least, repeats * q) - q, so one point in as many meets every run.
    """
    periods = np.where(lengths >= least, lengths // repeats, 0)
    text = np.repeat(np.arange(len(lengths)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(least, repeats * period) - period
    points = -(-(lengths[text] - period) // step)
    ends = np.cumsum(points)
    start = 0
    while start < len(text):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + _PAIRS, "right")))
        count = points[start:stop]
        row = np.repeat(np.arange(start, stop), count)
        number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        yield text[row], number * step[row], period[row]
        start = stop


def find_runs(texts: list[np.ndarray], least: int = 24, repeats: int = 3) -> list[np.ndarray]:
    """For each text, an array of word codes >= 0, its runs as rows (start, length, period) by start, then period.

    A run is a stretch of at least max(least, repeats * period) words with that smallest period that no
    neighbouring word extends.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    front = np.arange(-1 - len(texts) - _FEW, -1 - len(texts))
    parts = [front] + [x for d, t in enumerate(texts) for x in (t, [-1 - d])]
    words = np.concatenate([np.asarray(p, dtype=np.int64) for p in parts] + [front - _FEW])
    begin = _FEW + np.cumsum(lengths + 1) - lengths - 1
    kept = []
    for text, place, period in _grid(lengths, least, repeats):
        i = begin[text] + place
        same = words[i] == words[i + period]
        text, i, period = text[same], i[same], period[same]
        # A run shares at least 2 * _FEW places around its grid point, so _FEW of them lie on one side.
        ahead = np.ones(len(i), dtype=bool)
        behind = np.ones(len(i), dtype=bool)
        for t in range(1, _FEW + 1):
            ahead &= words[i + t - 1] == words[i + period + t - 1]
            behind &= words[i - t] == words[i + period - t]
        may = ahead | behind
        kept.append((text[may], i[may], period[may]))
    text, i, period = (np.concatenate(x) for x in zip(*kept)) if kept else (np.zeros(0, dtype=np.int64),) * 3
    found = [np.zeros((0, 3), dtype=np.int64) for _ in texts]
    if not len(i):
        return found
    start, length = _extents(words, lengths, begin, text, i, period)
    long = length >= np.maximum(least, repeats * period)
    rows = np.unique(np.stack([text, start - begin[text], length, period], axis=1)[long], axis=0)
    # A stretch of a smaller period is also found under its multiples: the first row of (text, start, length) stays.
    rows = rows[np.concatenate([[True], np.any(rows[1:, :3] != rows[:-1, :3], axis=1)])] if len(rows) else rows
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    for d in np.unique(rows[:, 0]):
        found[d] = rows[rows[:, 0] == d][:, 1:]
    return found


def _extents(words, lengths, begin, text, i, period) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the stretches of ``period`` around ``i``; only the texts that are asked for are indexed."""
    asked, own = np.unique(text, return_inverse=True)
    spans = [words[begin[d] : begin[d] + lengths[d] + 1] for d in asked]
    sub = np.concatenate([[-1 - 2 * len(lengths) - 2 * _FEW], *spans])
    text_of = np.repeat(np.arange(-1, len(asked)), [1] + [len(s) for s in spans])
    sub_begin = 1 + np.cumsum([0] + [len(s) for s in spans])[:-1]
    place = sub_begin[own] + i - begin[text]
    ahead = CommonExtensions(sub, text_of)(place, place + period)
    last = len(sub) - 1
    behind = CommonExtensions(sub[::-1], text_of[::-1])(last - place + 1, last - place - period + 1)
    return i - behind, ahead + behind + period


def _coded(text: str, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Codes of the words of a text, split at ASCII white space; new words enter the vocabulary."""
    data = text.encode("utf-8", "replace")
    parts, at = [], 0
    while at < len(data):
        stop = min(len(data), at + _PIECE)
        while stop < len(data) and data[stop] not in b" \t\n\r\x0b\x0c":
            stop += 1
        words = data[at:stop].split()
        for w in set(words).difference(vocabulary):
            vocabulary[w] = len(vocabulary)
        parts.append(np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int64, count=len(words)))
        at = stop
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def plant_period(words: np.ndarray, seed: int) -> np.ndarray:
    """The words with a periodic end where ``seed`` divides by 10: from place a on, the p words there repeat."""
    n = len(words)
    if seed < 0 or seed % 10 or not n:
        return words
    g = seed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return words[np.where(at < a, at, a + (at - a) % p)]


def _strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period; the first by start, then period, among equals."""
    if not len(runs):
        return None
    share = runs[:, 1] / runs[:, 2]
    near = runs[share >= share.max() * (1 - 1e-9)]
    return min(map(tuple, near.tolist()), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def _kept(words: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return words[np.cumsum(edge[:-1]) == 0]


def _rows(texts: list[np.ndarray], vocabulary: dict[bytes, int], least: int, repeats: int) -> Iterator[tuple]:
    spelled = list(vocabulary)
    for words, runs in zip(texts, find_runs(texts, least, repeats)):
        collapsed = b" ".join(map(spelled.__getitem__, _kept(words, runs).tolist())).decode()
        listed = [{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()]
        best = _strongest(runs)
        yield len(words), listed, best and dict(zip(("start", "length", "period"), best)), collapsed


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    planted: Column | None = None,
    least: int = 24,
    repeats: int = 3,
) -> DataFrame:
    """(id, n_words, runs, strongest, collapsed), one row per input row.

    ``runs`` lists every run of the words of the whole text by start, then period: a stretch of words with
    smallest period q and length >= max(least, repeats * q) that no neighbouring word extends. ``strongest`` is
    the one of greatest exact length / period (ties: smallest start, then period), or null. ``collapsed`` holds
    the words that no run contains after its first period, joined by one space. Words are split at ASCII white
    space. ``planted`` is a long column: where it divides by 10, ``plant_period`` rewrites the words first; null
    leaves the text as it is. Null texts count as empty: no words, no runs, an empty ``collapsed``. Rows that
    repeat are treated alike, null ids are kept, an empty table gives an empty result, and other columns are not read.
    """
    schema = f"n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string"

    @F.pandas_udf(schema)
    def apply(texts: pd.Series, seeds: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        waiting: list[np.ndarray] = []
        vocabulary: dict[bytes, int] = {}
        held = 0
        for text, seed in zip(texts, seeds.tolist()):
            waiting.append(plant_period(_coded(text or "", vocabulary), seed))
            held += len(waiting[-1])
            if held >= BATCH_WORDS:
                rows += _rows(waiting, vocabulary, least, repeats)
                waiting, vocabulary, held = [], {}, 0
        rows += _rows(waiting, vocabulary, least, repeats)
        return pd.DataFrame(rows, columns=["n_words", "runs", "strongest", "collapsed"])

    seed = F.lit(-1).cast("long") if planted is None else F.coalesce(planted.cast("long"), F.lit(-1).cast("long"))
    return docs.select(
        F.col(id_col).alias("id"), apply(F.col(text_col), seed).alias("found")
    ).select(F.col("id").alias(id_col), "found.*")
