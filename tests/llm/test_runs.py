"""Periodic runs against a plain search."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from omicspark.llm import periodic_runs, queries


def plain_runs(words, least=24, repeats=3):
    """All maximal stretches by trying every period."""
    n, found = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            if length >= max(least, repeats * q):
                found.setdefault((s, length), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {
        "doc_id": doc_id, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
        "exponent_milli": 1000 * best[1] // best[2] if runs else None,
        "runs_sha256": sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), "collapsed_sha256": sha(" ".join(kept)),
    }


def test_cover_meets_every_difference():
    assert (periodic_runs._SYNC >= 0).all()


def mixed(rng, alphabet, size):
    words = []
    while len(words) < size:
        unit = [rng.randrange(alphabet) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 40]))]
        words += unit * rng.choice([1, 1, 2, 3, 4, 9, 30])
    return words[:size]


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_plain_search(seed):
    rng = random.Random(seed)
    texts = [mixed(rng, rng.choice([1, 2, 3, 50]), rng.choice([0, 1, 23, 24, 25, 200, 500])) for _ in range(12)]
    texts += [texts[-1], texts[3]]
    found = periodic_runs.find_runs([np.array(t, dtype=np.int64) for t in texts])
    for text, runs in zip(texts, found):
        assert sorted(map(tuple, runs.tolist())) == plain_runs(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=120), st.integers(1, 30), st.integers(1, 6))
def test_runs_of_repeated_units(unit, times, tail):
    words = unit * times + [2] * tail
    runs = periodic_runs.find_runs([np.array(words, dtype=np.int64)])[0]
    assert sorted(map(tuple, runs.tolist())) == plain_runs(words)


def test_common_extensions():
    rng = np.random.default_rng(5)
    text = np.concatenate([np.tile(rng.integers(0, 3, 50), 6), rng.integers(0, 2, 300)])
    words = np.concatenate([[-9], text, [-1], text, [-2]])
    of = np.repeat([-1, 0, 1], [1, len(text) + 1, len(text) + 1])
    extend = periodic_runs.CommonExtensions(words, of)
    i = rng.integers(1, 1 + len(text), 2000)
    j = rng.integers(1, 1 + len(text), 2000)
    i, j = i[i != j], j[i != j]
    shift = np.where(rng.random(len(i)) < 0.5, len(text) + 1, 0)
    for a, b, n in zip(i, j, extend(i + shift, j + shift)):
        x, y = text[a - 1:], text[b - 1:]
        m = min(len(x), len(y))
        differ = np.flatnonzero(x[:m] != y[:m])
        assert n == (differ[0] if len(differ) else m)


def test_query_equals_plain_version(spark, tmp_path):
    rng = random.Random(3)
    spell = lambda t: " ".join(f"w{x}é" if x % 3 else f"w{x}" for x in t)
    rows = [(i, spell(mixed(rng, rng.choice([2, 6, 400]), rng.choice([5, 30, 120, 300]))), 0, "x") for i in range(150)]
    rows += [(7, rows[7][1], 1, "y"), (None, rows[9][1], 2, None), (500, None, 3, "z"), (501, "", 4, "z"),
             (502, " \t\n", 5, "z"), (503, "a b c " * 40, 6, "z"), (None, None, 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.asDict() for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()]
    want = [plain_row(i, t) for i, t, _, _ in rows]
    key = lambda r: str(sorted((k, str(v)) for k, v in r.items()))
    assert sorted(map(key, ({k: r[k] for k in want[0]} for r in got))) == sorted(map(key, want))
    assert any(r["n_runs"] for r in got)


def test_empty_table_and_one_long_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.periodic_runs(empty).collect() == []
    unit = " ".join(str(i) for i in range(70_000))
    docs = spark.createDataFrame([(1, " ".join([unit] * 5))], "doc_id long, text string")
    row = periodic_runs.periodic_runs(docs).withColumn("same", F.col("collapsed") == unit).drop("collapsed").first()
    assert row["same"] and row["n_words"] == 350_000
    assert [tuple(r) for r in row["runs"]] == [(0, 350_000, 70_000)] and tuple(row["strongest"]) == (0, 350_000, 70_000)
