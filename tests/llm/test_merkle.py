"""Merkle fingerprints: equality at the root, likeness and location of edits, the next document, odd rows."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import oracle
from omicspark.llm import merkle, queries

LINE = "The {0} river runs. It turns at the {0} mill! Then it rests.\n"


def rows_of(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))
    df = df.select("a", "b", a.alias("x"), b.alias("y"))
    return df.select("*", merkle.likeness(F.col("x"), F.col("y")).alias("near"), merkle.edited_span(F.col("x"), F.col("y")).alias("span")).collect()


def test_roots_tell_equality(spark):
    texts = ["", None, "a", "a.", "a.\n", "a\n.", "\na.", "a.b", "a. b", "b. a", "a|b;c,d:e", "x\n\ny", "x\ny", "é.", "é. ", " "]
    pairs = [(p, q) for p in texts for q in texts]
    for r in rows_of(spark, pairs):
        assert (r["x"] == r["y"]) == ((r["a"] or "") == (r["b"] or "")) == (r["near"] == 1.0) == (r["span"] is None)


def test_edit_is_located(spark):
    lines = [LINE.format(i) for i in range(200)]
    for k in (0, 77, 199):
        other = lines[:k] + ["Something else stands here.\n"] + lines[k + 1 :]
        (r,) = rows_of(spark, [("".join(lines), "".join(other))])
        start = len("".join(lines[:k]))
        assert tuple(r["span"]) == (start, start + len(lines[k]))
        assert 0.98 < r["near"] < 1
    (r,) = rows_of(spark, [("".join(lines), "".join(lines[:50] + ["New.\n"] + lines[50:]))])
    assert tuple(r["span"]) == (len("".join(lines[:50])),) * 2
    (r,) = rows_of(spark, [("".join(lines), "".join(lines[:150]))])
    assert r["near"] == pytest.approx(2 * 150 / 350, abs=0.05)
    assert rows_of(spark, [("one. two.", "other words")])[0]["near"] == 0.0


def test_sections_end_at_blank_lines_and_stay_short(spark):
    text = "".join(LINE.format(i) for i in range(2000))
    (r,) = rows_of(spark, [(text, "a b.\n\nc d.\n\ne f.")])
    assert 60 < r["x"].count("|") < 250
    assert r["y"].count("|") >= 3



def test_query_with_odd_rows(spark, tmp_path):
    text = "".join(LINE.format(i) for i in range(40))
    rows = [
        (5, text, 1, "q"), (2, text.replace("mill", "hill"), 2, "q"), (9, None, 3, None), (9, "", 4, "r"), (11, "abc", 5, "r"),
        (7, "short. text.", 6, "r"), (7, "short. text.", 6, "r"), (7, "an other. text of the id." * 9, 6, "r"),
        (None, "no id. here. at all.", 7, "s"), (None, None, 8, "s"), (-3, "é" * 9 + ". ü", 9, "s"), (12, "x" * 300_000 + " y" * 9, 0, "s"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, before int, tree string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_fingerprints(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert oracle.compare(got, con, queries.oracle_sql()["op13_fingerprints"]) is None
    found = sorted((r for r in got.collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"]))
    speak = {}
    for i, t, _, _ in rows:
        if i is not None:
            speak[i] = min(speak.get(i, t or ""), t or "", key=lambda x: hashlib.md5(x.encode()).hexdigest())
    ids = sorted(speak)
    want = []
    for i, t, _, _ in rows:
        t = t or ""
        k = len(t) // 4
        after = speak[ids[(ids.index(i) + 1) % len(ids)]] if i is not None else ""
        edited = t[: len(t) - k] + after[:k]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(want, key=str) == sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found), key=str)
    by = {r["doc_id"]: r for r in found if r["doc_id"] in (2, 5)}
    assert 0.6 < by[5]["near_edited"] < 1 and by[5]["near_next"] < by[5]["near_edited"]
    assert {r["near_next"] for r in found if r["doc_id"] is None} == {0.0}


def test_one_document_and_empty_table(spark):
    docs = spark.createDataFrame([(4, "a. b. c. d.")], "doc_id long, text string")
    (row,) = merkle.edited_fingerprints(docs).collect()
    assert row["edited"] == "a. b. c. d."[:9] + "a."
    assert row["next_fingerprint"] == row["fingerprint"]
    assert merkle.edited_fingerprints(docs.limit(0)).collect() == []


def test_successors_over_many_ranges(spark):
    ids = [7 * i % 1009 - 500 for i in range(1009)]
    df = spark.createDataFrame([(i,) for i in ids + ids[:30]] + [(None,)], "k long")
    got = dict(map(tuple, merkle.successors(df, "k").collect()))
    ordered = sorted(ids)
    assert got == dict(zip(ordered, ordered[1:] + ordered[:1]))


def test_no_python_on_the_executors(spark, tmp_path):
    spark.createDataFrame([(1, "a. b."), (2, "c.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.op13_fingerprints(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
