import zlib

import numpy as np
import pytest

from omicspark.llm import quality, toxicity

FOLDER = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = tables(spark)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    found = quality.score_documents(docs, labels).collect()
    assert len(found) == docs.count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    checked = [(truth[r.doc_id], r.predicted) for r in found if r.held_out and truth.get(r.doc_id) is not None]
    assert np.mean([a == b for a, b in checked]) > 0.98
    assert np.mean([b for a, b in checked if a == 1]) > 0.99


def test_toxicity_finds_toxic_words_and_leaves_others(spark):
    docs, labels = tables(spark)
    words = set("trash pathetic idiot worthless disgusting stupid clown scum loser moron".split())
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = toxicity.score_documents(docs, labels).collect()
    assert len(found) == len(texts)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    plain = lambda t: set("".join(c if c.isalnum() else " " for c in t.lower()).split())
    hits = [(bool(words & plain(texts[r.doc_id])), r.predicted) for r in found if r.held_out]
    assert np.mean([p for t, p in hits if t]) > 0.9
    assert np.mean([p for t, p in hits if not t]) < 0.02


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = tables(spark)
    docs = docs.limit(600)
    turned = labels.selectExpr(
        "doc_id",
        "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality",
        "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic",
    )
    for score in (quality.score_documents, toxicity.score_documents):
        a, b = ({r.doc_id: r.score for r in score(docs, x).collect()} for x in (labels, turned))
        assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)


ROWS = [
    (1, "good plain words here", "x"), (2, None, "x"), (3, "", "x"), (4, " \n", "x"), (None, "bad ### text", "x"),
    (5, "long " * 100_000, "x"), (6, "same", "x"), (6, "same", "x"), (7, "words and more words", "x"), (8, "### $$$ %%%", "x"),
]


@pytest.mark.parametrize("score", [quality.score_documents, toxicity.score_documents])
@pytest.mark.parametrize(
    "labels",
    [
        [],
        [(1, 1, 0), (7, 1, 0)],
        [(1, 1, 0), (7, 1, 0), (6, 0, 1), (8, 0, 1), (8, 0, 1), (2, None, None), (None, 1, 1), (3, 7, 7), (99, 1, 1), (5, 1, 0), (4, 0, 0)],
    ],
)
def test_odd_rows_and_labels(spark, score, labels):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, score string")
    found = score(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == len(ROWS)
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in found)
    same = [r.score for r in found if r.doc_id == 6]
    assert same[0] == same[1]
    empty = {r.score for r in found if r.doc_id in (2, 3)}
    assert len(empty) == 1


@pytest.mark.parametrize("score", [quality.score_documents, toxicity.score_documents])
def test_empty_tables(spark, score):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert score(docs, spark.createDataFrame([], LABELS)).collect() == []


def test_discriminant_equals_gaussian_densities():
    rng = np.random.default_rng(2)
    parts = [rng.normal(size=(400, 3)) @ rng.normal(size=(3, 3)) + rng.normal(size=3) for _ in (0, 1)]
    counts = np.array([400.0, 400.0])
    sums = np.stack([p.sum(axis=0) for p in parts])
    model = quality.Discriminant.fit(counts, sums, np.stack([p.T @ p for p in parts]), 0.1, 0.0)
    pooled = np.diag(np.mean([p.var(axis=0) for p in parts], axis=0))
    logs = []
    for p in parts:
        cov = 0.9 * np.cov(p.T, bias=True) + 0.1 * pooled
        x = parts[0][:20] - p.mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", x, np.linalg.inv(cov), x) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.score(parts[0][:20]), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_keep_good_keeps_all_columns(spark):
    docs, labels = tables(spark)
    part = docs.where("doc_id < 800").selectExpr("*", "1 AS stats", "2 AS id")
    kept = quality.keep_good(part, labels)
    assert kept.columns == part.columns
    scored = quality.score_documents(part, labels)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scored.where("predicted = 1").collect()}


def test_windows_cover_the_whole_text():
    text = "One, two. " * 501
    assert b"".join(toxicity.windows(text)).split() == [b"one", b"two"] * 501
    assert toxicity.windows(None) == toxicity.windows(" .. ") == []


def test_rare_toxic_words_are_learned_beside_a_common_one():
    rng = np.random.default_rng(4)
    words = np.array([f"w{i:x}ord{i * 7919 % 1000}" for i in range(400)])
    rare = ["grumblefax", "snidewort", "vilethorn", "muckspite", "harshgib", "oafdrool", "blightcur", "toadknave", "dungpriss", "quillboor"]
    plain = lambda: list(rng.choice(words, 40))
    ordinary = [" ".join(plain()) for _ in range(2000)]
    toxic = [" ".join([*plain(), "dreadful" if i % 2 else rare[i // 2 % 10], *plain()]) for i in range(500)]
    model = toxicity.fit(toxic, ordinary, float(np.log(500 / 2000)))
    for word in ("dreadful", *rare):
        assert np.mean(model.score([" ".join([*plain(), word, *plain()]) for _ in range(50)]) >= 0.5) > 0.8, word
    assert np.mean(model.score([" ".join(plain()) for _ in range(200)]) >= 0.5) < 0.02


def test_long_labelled_texts_do_not_end_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 4000)
    ids = [i for i in range(1, 200) if not held(i)]
    texts = [(i, "awful " * 900 if i % 3 == 0 else f"{'awful' if i % 2 else 'nice'} day number {i}") for i in ids]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in ids], LABELS)
    docs = docs.union(docs.where("doc_id % 3 = 0").selectExpr("doc_id", "concat(text, doc_id)"))
    taken = []
    monkeypatch.setattr(toxicity, "fit", lambda toxic, ordinary, odds: taken.append((toxic, ordinary)))
    toxicity.train(docs, labels)
    ((toxic, ordinary),) = taken
    assert len(toxic) > 40 and len(ordinary) > 40
