"""Collocations against plain counting, over several frontiers, and odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from omicspark.llm import collocations
from omicspark.llm.collocations import PhraseFilter
from brute import ascii_lower


def plain(rows, limit, least):
    grams, totals = {}, Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", ascii_lower(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                grams.setdefault(lang, Counter()).update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in grams.items():
        chosen = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in chosen.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    q = p[i : i + m]
                    if 100 * a >= 80 * f[q]:
                        covered.add(q)
        best = []
        for p, a in chosen.items():
            if p not in covered:
                cuts = [(2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(best)[:limit], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def corpus(seed, size=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Über", "x", "a"]
    fixed = [[rng.choice(words) for _ in range(rng.choice([2, 3, 5, 9]))] for _ in range(12)]
    rows = []
    for _ in range(size):
        text = ""
        for _ in range(rng.randrange(12)):
            part = rng.choice(fixed) if rng.random() < 0.5 else rng.choices(words[: rng.choice([5, 43])], k=rng.randrange(1, 6))
            text += " ".join(part) + rng.choice([" ", " ", "\t", ". ", ",", "\n", "  "])
        rows.append((text, rng.choice(["en", "en", "en", "de", None])))
    return rows + [(None, "en"), ("", "en"), (rows[0][0], rows[0][1]), ("only here", "xx"), ("b " * 5000, "rep"), ("und und", "und")]


def found(spark, rows, **options):
    docs = spark.createDataFrame([(t, g, 1, "z") for t, g in rows], "text string, lang string, f int, phrase string")
    return sorted(map(tuple, collocations.collocations(docs, **options).collect()))


@pytest.mark.parametrize("seed, limit, least", [(1, 5, 3), (2, 60, 2), (3, 100000, 4)])
def test_equals_plain_counting(spark, seed, limit, least, monkeypatch):
    monkeypatch.setattr(collocations, "WIDER", 3)
    rows = corpus(seed)
    assert found(spark, rows, limit=limit, least=least) == plain(rows, limit, least)


def test_frontier_is_widened_and_filters_may_be_full(spark, monkeypatch):
    calls = []
    reach = collocations._reaching
    monkeypatch.setattr(collocations, "_reaching", lambda *a: calls.append(1) or reach(*a))
    monkeypatch.setattr(collocations, "FIRST_WIDTH", 1)
    monkeypatch.setattr(collocations, "WIDER", 2)
    # Pairs inside repeated passages are covered, so the first frontiers settle nothing.
    rows = [(" ".join(f"p{i}x{k}" for k in range(5)), "en") for i in range(9) for _ in range(4)] + corpus(4)
    assert found(spark, rows, limit=12, least=3, filter_bits=1 << 18) == plain(rows, 12, 3)
    assert len(calls) > 1


def test_filter_holds_its_phrases(spark):
    phrases = [("en", "a"), ("en", "a b"), ("de", "ä c d")]
    table = PhraseFilter(spark.createDataFrame(phrases, "lang string, phrase string"), 1 << 18)
    for lang, phrase in phrases:
        words = collocations._word_hashes(lang, phrase.encode().split(b" "))
        h = words[:1]
        for k in range(1, len(words)):
            h = collocations._joined_hash(h, words[k : k + 1])
        assert table(h).all()
    assert not table(collocations._word_hashes("fr", [b"a"])).any()
    assert table(np.zeros(0, dtype=np.uint64)).shape == (0,)


def test_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    df = spark.createDataFrame([("en", "p q", big)], "lang string, phrase string, f long")
    counts = spark.createDataFrame([("en", "p", big), ("en", "q", big + 7)], "lang string, phrase string, f long")
    (row,) = collocations.scored(df, counts, 2).collect()
    assert row["score"] == 2000000 * big // (2 * big + 7)


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
