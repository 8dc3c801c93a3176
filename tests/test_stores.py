"""The written correlation matrix, and places of peptides, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from omicspark.functions import ranking
from omicspark.operators import compare, query, search
from omicspark.operators.correlation_store import CorrelationStore, write_store


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(8)
    values = rng.normal(size=(40, 21))
    values[rng.random(values.shape) < 0.3] = np.nan
    rows = [(f"f{i}", f"c{j:02d}", float(v)) for i, r in enumerate(values) for j, v in enumerate(r) if not np.isnan(v)]
    fc = spark.createDataFrame(rows, "feature string, comparison string, value double")
    corr = compare.pairwise_pearson(fc, 18).cache()
    index = compare.comparison_positions(fc)
    return corr, index, write_store(corr, index, side=4)


def by_key(rows, *keys):
    return {tuple(r[k] for k in keys): r for r in rows}


def test_levels_end_in_one_block(matrix):
    assert matrix[2].levels == 4


@pytest.mark.parametrize("tile", [(0, 0, 0, 4), (0, 1, 3, 4), (0, 3, 1, 4), (0, 0, 0, 256), (1, 1, 0, 3), (2, 0, 1, 2), (3, 0, 0, 256), (5, 0, 0, 2)])
def test_tiles_equal_means_over_the_matrix(spark, matrix, tile):
    corr, index, store = matrix
    level, row, column, size = tile
    want = by_key(compare.matrix_tile(corr, index, level, row, column, size).collect(), "row", "column")
    got = by_key(store.tile(spark, level, row, column, size).collect(), "row", "column")
    assert got.keys() == want.keys() and got
    for k, r in got.items():
        assert r["support"] == want[k]["support"]
        assert r["correlation"] == pytest.approx(want[k]["correlation"])


def test_cells_and_rows(spark, matrix):
    corr, _, store = matrix
    for a, b in (("c00", "c00"), ("c20", "c03"), ("c05", "c06")):
        (got,) = store.cell(spark, a, b).collect()
        assert got == compare.cell(corr, a, b).first()
    for item in ("c00", "c11", "c20"):
        assert sorted(store.row(spark, item).collect()) == sorted(compare.neighbours(corr, item).collect())
    assert store.cell(spark, "c00", "nobody").collect() == [] == store.row(spark, "nobody").collect()


def test_a_cell_reads_one_block(spark, matrix):
    store = matrix[2]
    i, j = 3, 17
    block = (F.col("bi") == i // 4) & (F.col("bj") == j // 4)
    assert len(spark.read.parquet(f"{store.path}/cells").inputFiles()) > 21
    held = store.blocks(spark, 0, block)
    assert held.select(F.input_file_name()).distinct().count() == 1
    plan = store.cell(spark, "c03", "c17")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan


def test_empty_matrix(spark, matrix):
    corr, index, _ = matrix
    store = write_store(corr.limit(0), index.limit(0), side=4)
    assert isinstance(store, CorrelationStore) and store.levels == 1
    assert store.tile(spark, 0, 0, 0).collect() == []


# ---------------------------------------------------------------- peptides


def plain_places(sequence, peptide):
    return [i for i in range(len(sequence) - len(peptide) + 1) if sequence.startswith(peptide, i)]


def test_places_of_random_peptides():
    rng = random.Random(1)
    for _ in range(300):
        letters = rng.choice(["A", "AB", "ACDEFGHIKLMNPQRSTVWYé*"])
        sequence = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 80)))
        peptides = [sequence[i : i + rng.randrange(1, 14)] for i in (rng.randrange(len(sequence) + 1) for _ in range(8))]
        peptides += ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 12))) for _ in range(4)]
        want = {p: plain_places(sequence, p) for p in peptides if p and plain_places(sequence, p)}
        assert search.places_of(sequence, peptides) == want


def test_peptide_places_in_blocks(spark):
    entries = spark.createDataFrame([("a", "ABABABA"), ("b", "XYZ"), ("c", None), ("d", ""), ("big", "AB" * 5000)], "entry string, sequence string")
    pairs = [("a", "ABA"), ("a", "ABA"), ("a", "BA"), ("a", "Q"), ("b", "XYZ"), ("b", "XYZZ"), ("b", ""), ("b", None), (None, "X"), ("c", "A"), ("d", "A"), ("lost", "A")]
    pairs += [("big", "AB" * n) for n in range(4990, 5001)]
    df = spark.createDataFrame(pairs, "entry string, peptide string")
    for size in (1, 3, 4096):
        got = {(r["entry"], r["peptide"]): r["starts"] for r in search.peptide_places(df, entries, size).collect()}
        assert got[("a", "ABA")] == [0, 2, 4] and got[("a", "BA")] == [1, 3, 5] and got[("b", "XYZ")] == [0]
        assert {k[0] for k in got} == {"a", "b", "big"} and len(got) == 3 + 11
        assert got[("big", "AB" * 4998)] == [0, 2, 4]


# ---------------------------------------------------------------- pages and places


@pytest.mark.parametrize("descending", [False, True])
def test_cursors_walk_through_all_rows(spark, descending):
    rng = random.Random(6)
    rows = [(rng.choice([None, 1.0, 2.0, 2.5, -1.0]), f"n{i:02d}") for i in range(40)] + [(None, None)]
    df = spark.createDataFrame(rows, "k double, t string")
    order = F.col("k").desc_nulls_last() if descending else F.col("k").asc_nulls_last()
    want = [tuple(r) for r in df.orderBy(order, "t").collect()]
    seen, after = [], None
    while page := [tuple(r) for r in query.page_of(df, "k", descending, "t", 1, 7, after).collect()]:
        seen += page
        after = query.Cursor(*page[-1])
    assert seen == want


def test_a_cursor_page_skips_no_rows_by_offset(spark):
    df = spark.createDataFrame([(float(i % 9), f"n{i}") for i in range(50)], "k double, t string")
    plan = query.page_of(df, "k", False, "t", 1, 7, query.Cursor(3.0, "n3"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=7," in plan and "offset" not in plan.lower()


def test_a_value_of_many_rows_is_ordered_by_many_tasks(spark, monkeypatch):
    written = []
    cut = ranking.cut_lineage
    monkeypatch.setattr(ranking, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("a", 1.0, f"prefix{i:05d}") for i in range(4000)] + [("b", float(i % 3), f"prefix{i}") for i in range(500)] + [("a", None, "z"), (None, 2.0, "y"), ("b", 2.0, None)]
        df = spark.createDataFrame(rows, "g string, v double, t string")
        got = {(r["g"], r["t"]): (r["at"], r["n"]) for r in ranking.positions(df, ["g"], "v", "t", out="at", total="n").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [got["a", f"prefix{i:05d}"] for i in range(4000)] == [(i, 4000) for i in range(4000)]
    want = sorted(((-v, t is not None, t or "") for g, v, t in rows if g == "b"))
    assert [got["b", t or None][0] for _, _, t in want] == list(range(501))
    assert got[None, "y"] == (0, 1) and len(got) == 4502
    shares = [r["count"] for r in written[0].where("g = 'a'").groupBy(F.shiftright("__id", 33).alias("p")).count().collect()]
    assert len(shares) > 2 and max(shares) < 2500


def test_rows_that_repeat_get_places_of_their_own(spark):
    df = spark.createDataFrame([(1.0, "x")] * 5 + [(0.5, "x")], "v double, t string")
    assert sorted(r["position"] for r in ranking.positions(df, [], "v", "t").collect()) == [0, 1, 2, 3, 4, 5]


def test_few_peptides_are_sought_without_windows(monkeypatch):
    sequence, peptides = "AAAACKAACK", ["AA", "ACK", "", "ZZ", "AAAACKAACKA"]
    want = {"AA": [0, 1, 2, 6], "ACK": [3, 7]}
    monkeypatch.setattr(search, "FEW_PEPTIDES", 0)
    assert search.places_of(sequence, peptides) == want
    monkeypatch.setattr(search, "FEW_PEPTIDES", 64)
    monkeypatch.setattr(search, "_seeds", lambda *_: pytest.fail("windows were numbered"))
    assert search.places_of(sequence, peptides) == want
