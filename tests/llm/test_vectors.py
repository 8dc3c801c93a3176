import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from omicspark.llm import embedding_dedup, queries, topk_search

NAN, INF = float("nan"), float("inf")


def vectors(rng, groups=6, copies=9, dims=24, noise=0.25):
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dims)
        for _ in range(copies):
            rows.append((centre + rng.normal(size=dims) * noise * rng.random()).astype(np.float32))
    rows += [rows[0], rows[0], rows[5]]
    return [[float(x) for x in r] for r in rows]


@pytest.mark.parametrize("tile_rows", [4, 4096])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_links_equal_all_pairs(spark, tile_rows, kind):
    values = vectors(np.random.default_rng(3))
    labels = [i % 2 if i % 7 else None for i in range(len(values))]
    rows = [(i, v, label, "x") for i, (v, label) in enumerate(zip(values, labels))]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, rep string")
    x = np.array(values)
    cosine = (x @ x.T) / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((x * x).sum(1))[None]
    linked = lambda i, j: labels[i] is not None and labels[i] == labels[j] and cosine[i, j] >= 0.93
    roots = brute.components(len(values), linked)
    want = {i: (sum(linked(i, j) for j in range(len(values)) if j != i), roots[i], roots[i] == i) for i in range(len(values))}
    found = embedding_dedup.near_duplicates(table, tile_rows=tile_rows).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == want
    assert any(n for n, _, _ in want.values())


def test_int8_bound_never_loses_a_pair():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 40))
    x[200:] = x[:200] + rng.normal(size=(200, 40)) * 0.42
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, scale, length, error = embedding_dedup.quantise(x)
    near = scale[:, None] * scale * (codes.astype(int) @ codes.T.astype(int))
    bound = length[:, None] * error + error[:, None] * (length + error)
    assert (np.abs(x @ x.T - near) <= bound + 1e-12).all()
    assert np.abs(codes).max() <= 127


def test_vectors_that_link_with_nothing(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1),
        (7, [0.0, 0.0], 1), (8, [1.0, None], 1), (9, [1.0, NAN], 1), (10, [INF, 0.0], 1), (11, [1.0, 0.0, 0.0], 1),
        (None, [1.0, 0.0], 1), (12, [-1.0, 0.0], 1), (13, [-0.0, 1.0], 3), (14, [0.0, 1.0], 3), (2, [2.0, 0.0], 1),
    ]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id or 0, r.kept) for r in found.collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12)]
    linked = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (13, 1, 13, True), (14, 1, 13, False)]
    assert got == sorted([(0, 0, 0, False), *alone, *linked])


def test_many_small_labels_share_tiles(spark):
    rows = [(i, [1.0, float(i % 3)], i // 2) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    x = np.array([r[1] for r in rows])
    cosine = lambda i, j: x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j])
    roots = brute.components(60, lambda i, j: i // 2 == j // 2 and cosine(i, j) >= 0.93)
    found = embedding_dedup.near_duplicates(table, tile_rows=10).collect()
    assert {r.vec_id: r.component_id for r in found} == dict(enumerate(roots))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(empty).collect() == []
    assert topk_search.top_k(empty).collect() == []
    nothing = spark.createDataFrame([(100, None, 1)], "vec_id long, embedding array<float>, label int")
    assert topk_search.top_k(nothing).collect() == []
    assert [tuple(r) for r in embedding_dedup.near_duplicates(nothing).collect()] == [(100, 0, 100, True)]


def best(rows, k, every):
    scaled = {i: (n, np.floor(1024 * np.array(v, dtype=np.float64)).astype(int)) for n, (i, v) in enumerate(rows)}
    want = []
    for q, (_, a) in scaled.items():
        if q % every == 0:
            scores = sorted((-int(a @ b), v) for v, (_, b) in scaled.items() if v != q and len(a) == len(b))
            want += [(q, r + 1, v, -s) for r, (s, v) in enumerate(scores[:k])]
    return sorted(want)


@pytest.mark.parametrize("shard_rows,query_rows", [(37, 5), (8192, 1024)])
def test_top_k_equals_full_scores(spark, shard_rows, query_rows):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16)) / 4
    x[50:80] = x[0]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string")
    found = topk_search.top_k(table, k=7, query_every=10, shard_rows=shard_rows, query_rows=query_rows)
    assert sorted(tuple(r) for r in found.collect()) == best(rows, 7, 10)


def test_top_k_leaves_out_unusable_rows(spark):
    rows = [
        (0, [1.0, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [NAN, 1.0]), (4, [None, 1.0]), (5, [INF, 1.0]), (6, []),
        (7, [1.0, 1.0, 1.0]), (100, [0.0, 0.0]), (200, None), (None, [9.0, 9.0]), (8, [-0.0001, 0.0]),
    ]
    usable = [r for r in rows if r[0] in (0, 1, 7, 8, 100)]
    found = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(tuple(r) for r in found.collect()) == best(usable, 10, 100)


def test_search_stops_early_only_on_proof():
    rng = np.random.default_rng(6)
    data = rng.integers(-300, 300, size=(2000, 8))
    queries = data[:20]
    index = topk_search.ImpactIndex(data)
    own = np.arange(20)[:, None] == np.arange(2000)[None]
    q, v, score = topk_search.search_shard(index, queries, own, 5)
    full = np.where(own, -(10**12), queries @ data.T)
    for i in range(20):
        limit = np.sort(full[i])[-5]
        assert set(np.flatnonzero(full[i] >= limit)) <= set(v[q == i])
    assert len(q) < 20 * 2000 // 4


def by_sql(tmp_path, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    return con.execute(queries.oracle_sql()[name]).fetchall()


def test_an_id_of_several_vectors_joins_their_components(spark, tmp_path):
    rng = np.random.default_rng(2)
    a, b, c, d = (rng.normal(size=16).tolist() for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (9, b), (7, c), (3, c), (7, d), (2, d), (20, rng.normal(size=16).tolist())]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, label string")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {r[0]: r[2] for r in by_sql(tmp_path, "op1_embedding_dedup")}
    got = {(r["vec_id"], r["component_id"]) for r in queries.op1_embedding_dedup(spark, str(tmp_path)).collect()}
    assert got == set(want.items()) and want[9] == 1 and want[3] == 2


def test_all_vectors_of_a_query_id_are_searched(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in [*range(95, 130), 100, 200, 200]] + [(300, [1.0] * 8), (300, [1.0] * 8)]
    df = spark.createDataFrame(rows[:-1], "vec_id long, embedding array<double>").withColumn("label", F.lit("x"))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    want = sorted(by_sql(tmp_path, "op7_topk_search"))
    got = queries.op7_topk_search(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == want
