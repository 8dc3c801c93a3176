"""Order statistics, models, correlation, components and enrichment against numpy."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from omicspark.functions import ranking
from omicspark.functions.special import (
    digamma_number,
    t_two_sided,
    trigamma_inverse,
    trigamma_number,
)
from omicspark.operators import compare, enrich, fit, normalize, pca, qc, summarize


def hot_frame(spark, seed=1):
    """One group holds most rows, many of them tied; nulls and non-finite values occur."""
    rng = np.random.default_rng(seed)
    rows = [("hot", float(v)) for v in np.round(rng.normal(0, 50, 3000), 1)]
    rows += [("hot", 1.5)] * 1500 + [("hot", None), ("hot", float("nan")), ("hot", float("inf"))]
    rows += [("small", float(v)) for v in rng.lognormal(10, 4, 7)] + [("one", -3.25), (None, 2.0), (None, 4.0)]
    return spark.createDataFrame(rows, "g string, v double"), rows


def finite_of(rows, group):
    return np.array([v for g, v in rows if g == group and v is not None and math.isfinite(v)])


def test_exact_quantiles(spark):
    df, rows = hot_frame(spark)
    names = {"low": 0.01, "q1": 0.25, "median": 0.5, "q3": 0.75, "top": 1.0}
    got = {r["g"]: r for r in ranking.exact_quantiles(df, ["g"], "v", names, "n").collect()}
    assert set(got) == {"hot", "small", "one", None}
    for group, row in got.items():
        values = finite_of(rows, group)
        assert row["n"] == len(values)
        for name, q in names.items():
            assert row[name] == pytest.approx(np.quantile(values, q), rel=1e-12)
    whole = ranking.exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"]
    every = [v for _, v in rows if v is not None and math.isfinite(v)]
    assert whole == pytest.approx(np.median(every))


def test_average_ranks_and_positions(spark):
    df, _ = hot_frame(spark)
    clean = df.where(ranking.finite("v").isNotNull() & F.col("g").isNotNull())
    clean = clean.withColumn("t", F.concat(F.lit("k"), F.monotonically_increasing_id().cast("string")))
    clean.cache()
    pdf = clean.toPandas()
    ranked = ranking.average_ranks(clean, ["g"], "v", "r").toPandas().sort_values("t")
    wanted = pdf.groupby("g")["v"].rank(method="average")
    assert np.allclose(ranked["r"].to_numpy(), wanted[pdf.sort_values("t").index].to_numpy())
    placed = ranking.positions(clean, ["g"], "v", "t", descending=True, total="n").toPandas()
    for _, part in placed.groupby("g"):
        part = part.sort_values("position")
        assert list(part["position"]) == list(range(len(part)))
        assert (part["n"] == len(part)).all()
        expected = part.sort_values(["v", "t"], ascending=[False, True])
        assert list(part["t"]) == list(expected["t"])


def test_running_total(spark):
    df = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") % 7).cast("double").alias("a"))
    got = ranking.running_total(df, [], "i", F.col("a"), "s", width=64).orderBy("i").toPandas()
    assert np.allclose(got["s"], np.cumsum(np.arange(1000) % 7))


def adjust_reference(p, method):
    m, order = len(p), np.argsort(p, kind="stable")
    sorted_p = p[order]
    if method == "bonferroni":
        out = sorted_p * m
    elif method == "holm":
        out = np.maximum.accumulate(sorted_p * (m - np.arange(m)))
    else:
        scale = np.sum(1 / np.arange(1, m + 1)) if method == "by" else 1.0
        out = np.minimum.accumulate((sorted_p * m / np.arange(1, m + 1) * scale)[::-1])[::-1]
    back = np.empty(m)
    back[order] = np.minimum(out, 1)
    return back


@pytest.mark.parametrize("method", ["bh", "by", "holm", "bonferroni"])
def test_adjust_pvalues(spark, method):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.random(400) ** 4, np.ones(200), np.full(30, 0.01), [0.0, 1e-300]])
    rows = [("x", i, float(v)) for i, v in enumerate(p)] + [("x", -1, None), ("y", 0, 0.04)]
    df = spark.createDataFrame(rows, "c string, i int, p double")
    got = ranking.adjust_pvalues(df, ["c"], "p", method, "a").toPandas()
    x = got[(got["c"] == "x") & (got["i"] >= 0)].sort_values("i")["a"].to_numpy()
    assert np.allclose(x, adjust_reference(p, method), rtol=1e-10)
    assert (x >= p - 1e-15).all()
    assert math.isnan(got[got["i"] == -1]["a"].iloc[0])
    assert got[got["c"] == "y"]["a"].iloc[0] == pytest.approx(0.04)


def test_tail_probabilities():
    t = np.array([2.0, 12.706204736432095, 1.959963984540054, 0.0, 2.2281388519649385])
    df = np.array([1e9, 1.0, np.inf, 5.0, 10.0])
    assert np.allclose(t_two_sided(t, df), [0.0455002638963584, 0.05, 0.05, 1.0, 0.05], rtol=1e-6)
    assert trigamma_number(1.0) == pytest.approx(math.pi**2 / 6, rel=1e-9)
    assert digamma_number(1.0) == pytest.approx(-0.5772156649015329, rel=1e-9)
    assert trigamma_number(trigamma_inverse(0.37)) == pytest.approx(0.37)


def feature_rows(rng, proteins=3, features=6, samples=7, gaps=0.2):
    rows = []
    for p in range(proteins):
        f, s = rng.normal(20, 2, features), rng.normal(0, 1, samples)
        for i in range(features):
            for j in range(samples):
                if rng.random() > gaps or i == 0:
                    rows.append((f"p{p}", f"f{i}", f"s{j}", float(f[i] + s[j] + rng.normal(0, 0.2))))
    return rows


FEATURES = "protein string, feature string, sample string, log2_abundance double"


@pytest.mark.parametrize("method", ["medianPolish", "linear", "robustSummary"])
def test_spread_fit_equals_grouped_fit(spark, method):
    rows = [r for r in feature_rows(np.random.default_rng(5), 2, 5, 4, 0.0) if r[:3] != ("p0", "f1", "s1")]
    cells = spark.createDataFrame(rows, FEATURES)
    small = {(r[0], r[1]): r[2:] for r in summarize.summarize(cells, method, with_converged=True).collect()}
    spread = summarize.summarize(cells, method, max_cells=0, with_converged=True).collect()
    assert small.keys() == {(r[0], r[1]) for r in spread}
    for r in spread:
        assert r[2] == pytest.approx(small[r[0], r[1]][0], abs=1e-6)
        assert r[3] == small[r[0], r[1]][1]


def test_large_proteins_take_the_spread_path(spark):
    cells = spark.createDataFrame(feature_rows(np.random.default_rng(5), 2, 5, 4, 0.0), FEATURES)
    cells = cells.where("protein = 'p0' or feature in ('f0', 'f1')")
    mixed = {(r[0], r[1]): r[2] for r in summarize.summarize(cells, "linear", max_cells=10).collect()}
    plain = {(r[0], r[1]): r[2] for r in summarize.summarize(cells, "linear").collect()}
    assert mixed.keys() == plain.keys()
    assert all(mixed[k] == pytest.approx(plain[k], abs=1e-6) for k in plain)


def polish_alone(x, rounds=10, tolerance=0.01):
    """Median polish of one matrix, row by row and column by column."""
    rest, row, col, overall, last = x.copy(), np.zeros(x.shape[0]), np.zeros(x.shape[1]), 0.0, 0.0
    for _ in range(rounds):
        step = np.nanmedian(rest, axis=1)
        rest, row = rest - step[:, None], row + step
        center = np.median(col)
        col, overall = col - center, overall + center
        step = np.nanmedian(rest, axis=0)
        rest, col = rest - step[None, :], col + step
        center = np.median(row)
        row, overall = row - center, overall + center
        size = np.nansum(np.abs(rest))
        if size == 0 or abs(size - last) < tolerance * size:
            break
        last = size
    return overall + col


def test_proteins_of_a_batch_are_fitted_together(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows, wanted = [], {}
    for p in range(60):
        x = np.round(rng.normal(20, 3, (1 + p % 7, 1 + p % 5)), p % 3)
        x[1:][rng.random(x[1:].shape) < 0.3] = np.nan
        x = x[~np.isnan(x).all(axis=1)]
        levels = x[0] if len(x) < 2 else polish_alone(x)
        for i, j in np.argwhere(~np.isnan(x)):
            rows.append((f"p{p}", f"f{i}", f"s{j}", float(x[i, j])))
        wanted |= {(f"p{p}", f"s{j}"): v for j, v in enumerate(levels)}
    # Twice the same cell counts as its mean; no value and no number count as none.
    rows += [("twice", "f0", "s0", 1.0), ("twice", "f0", "s0", 3.0), ("twice", "f1", "s0", 2.0), ("p1", "f9", "s9", None)]
    rows += [("few", "f0", "s0", 4.0), ("few", "f1", "s1", 6.0), ("few", "f1", "s2", float("nan"))]
    wanted |= {("twice", "s0"): 2.0, ("few", "s0"): 4.0, ("few", "s1"): 6.0}

    def check(found):
        found = {r[:2]: r[2] for r in found}
        assert found.keys() == wanted.keys()
        assert all(found[k] == pytest.approx(wanted[k], abs=1e-9) for k in wanted)

    calls = []
    polish = summarize.median_polish_all
    monkeypatch.setattr(summarize, "median_polish_all", lambda x: calls.append(len(x)) or polish(x))
    columns = zip(*sorted((r for r in rows if r[3] is not None), key=lambda r: r[0]))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["protein", "feature", "sample", "log2_abundance"])
    out = summarize._polished(2)(batch).to_pydict()
    check(zip(out["protein"], out["sample"], out["log2_abundance"]))
    assert sum(calls) > 40 and len(calls) <= 16
    # Keys that go on in the next batch, and proteins that no task may hold.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        frame = spark.createDataFrame(rows, FEATURES)
        check(tuple(r) for r in summarize.summarize_tmp(frame).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    picked = [r for r in rows if r[0] in ("p6", "p20", "few")]
    wanted = {k: v for k, v in wanted.items() if k[0] in ("p6", "p20", "few")}
    check(tuple(r) for r in summarize.summarize_tmp(spark.createDataFrame(picked, FEATURES), max_cells=6).collect())


def test_plain_means_of_a_batch_equal_single_fits(spark):
    rows = [r for r in level_rows(np.random.default_rng(3)) if r[:2] not in {("p01", "A_0"), ("p01", "A_1")} and (r[0] != "p02" or r[2] == "B")]
    rows += [("lone", "A_0", "A", "b1", 1.5), ("lone", "B_0", "B", "b1", 2.5)]
    found = fit.fit_models(spark.createDataFrame(rows, LEVELS), robust=False).collect()
    assert len(found) == 31
    for r in found:
        own = [x for x in rows if x[0] == r["protein"]]
        names = sorted({x[2] for x in own})
        values = [np.array([x[4] for x in own if x[2] == c]) for c in names]
        df = len(own) - len(names)
        assert r["conditions"] == names and r["n"] == len(own) and r["df"] == df
        assert r["shifts"] == [[] for _ in names]
        assert r["coef"] == pytest.approx([v.mean() for v in values])
        assert r["inverse"] == pytest.approx([1 / len(v) for v in values])
        squares = sum(((v - v.mean()) ** 2).sum() for v in values)
        assert r["sigma"] is None if not df else r["sigma"] == pytest.approx(math.sqrt(squares / df))


def test_additive_fit_is_least_squares():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 5))
    x[rng.random(x.shape) < 0.2] = np.nan
    fit = summarize.Additive.start(x)
    assert fit.settle()
    levels, rest = fit.levels, fit.rest
    i, j = np.nonzero(~np.isnan(x))
    design = np.zeros((len(i), 11))
    design[np.arange(len(i)), i] = 1
    design[np.arange(len(i)), 6 + j] = 1
    fitted = design @ np.linalg.lstsq(design, x[i, j], rcond=None)[0]
    assert np.allclose(x[i, j] - rest[i, j], fitted, atol=1e-6)
    assert len(levels) == 5


def test_median_polish_recovers_additive_structure():
    rows, cols = np.array([1.0, 5, 9]), np.array([0.0, 2, 4, 6])
    levels, settled = summarize.median_polish(rows[:, None] + cols[None, :])
    assert settled
    assert np.allclose(levels, 5 + cols)


def test_censored_values_fall_below_the_observed(spark):
    rng = np.random.default_rng(8)
    rows = [r for r in feature_rows(rng, 1, 8, 6, 0.0) if not (r[1] == "f3" and r[2] in {"s1", "s4"})]
    out = summarize.impute_censored(spark.createDataFrame(rows, FEATURES), 0.05).toPandas()
    filled = out[out["provenance"] == "imputed"]
    assert len(out) == 48 and len(filled) == 2
    floor = np.quantile([r[3] for r in rows if r[2] in {"s1", "s4"}], 0.5)
    assert (filled["log2_abundance"] < floor).all()
    spread = summarize.impute_censored(spark.createDataFrame(rows, FEATURES), 0.05, max_cells=0).toPandas()
    both = filled.merge(spread, on=["feature", "sample"])
    assert len(spread) == 48 and (both["provenance_y"] == "imputed").all()
    assert np.allclose(both["log2_abundance_x"], both["log2_abundance_y"], atol=1e-6)


def test_normal_ratio_over_the_whole_line():
    from math import erfc, exp, pi, sqrt

    a = np.concatenate([np.linspace(-25, 8, 500), [-300.0, 38.0]])
    exact = [exp(-v * v / 2) / sqrt(2 * pi) / (0.5 * erfc(-v / sqrt(2))) for v in a[:-2]]
    found = summarize._normal_ratio(a)
    assert np.allclose(found[:-2], exact, rtol=1e-9)
    assert found[-2] == pytest.approx(300 + 1 / 300, rel=1e-9) and 0 <= found[-1] < 1e-300


def test_top_features_and_quantile_normalisation(spark):
    df = spark.createDataFrame(feature_rows(np.random.default_rng(6), 1, 6, 4, 0.0), FEATURES)
    levels = summarize.summarize(df, "mean", subset="topN", n_top=2)
    assert levels.count() == 4
    out = normalize.normalize(df, "quantiles").toPandas().pivot(index="feature", columns="sample", values="log2_abundance")
    for column in out:
        assert np.allclose(np.sort(out[column]), np.sort(out.iloc[:, 0]))


def test_quantiles_of_samples_with_gaps(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 4)).round(1)
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 3] = np.nan
    x[4, 3] = 2.5
    grid = np.arange(30) / 29
    sorted_values = [np.sort(c[~np.isnan(c)]) for c in x.T]
    profile = np.mean([np.interp(grid, np.linspace(0, 1, len(v)), v) if len(v) > 1 else np.repeat(v, 30) for v in sorted_values], axis=0)
    rows = [(f"p{i}", "f", f"s{j}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if not np.isnan(v)]
    rows += [(f"p{i}", "f", "s0", None) for i in range(30) if np.isnan(x[i, 0])]
    found = {(r[0], r[2]): r[3] for r in normalize.normalize_quantiles(spark.createDataFrame(rows, FEATURES)).collect()}
    for j, v in enumerate(sorted_values):
        for i in np.flatnonzero(~np.isnan(x[:, j])):
            rank = np.flatnonzero(v == x[i, j]).mean()
            place = rank / (len(v) - 1) if len(v) > 1 else 0.5
            assert found[f"p{i}", f"s{j}"] == pytest.approx(np.interp(place, grid, profile), abs=1e-9)


def level_rows(rng, proteins=30, effect=4.0):
    rows = []
    for p in range(proteins):
        base = rng.normal(20, 1)
        for c in ("A", "B"):
            for r in range(4):
                shift = effect if c == "A" and p < 5 else 0.0
                rows.append((f"p{p:02d}", f"{c}_{r}", c, "b1" if r < 2 else "b2", float(base + shift + rng.normal(0, 0.3))))
    return rows


LEVELS = "protein string, sample string, condition string, batch string, level double"
CONTRAST = [("A_vs_B", "A", 1.0), ("A_vs_B", "B", -1.0)]
CONTRAST_SCHEMA = "comparison_id string, condition string, weight double"


def test_spiked_proteins_are_found(spark):
    df = spark.createDataFrame(level_rows(np.random.default_rng(9)), LEVELS)
    contrast = spark.createDataFrame(CONTRAST, CONTRAST_SCHEMA)
    plain = fit.contrast_group_means(fit.fit_group_means(df), contrast).toPandas().set_index("protein").sort_index()
    robust = fit.contrast_models(fit.fit_models(df), contrast, moderated=True).toPandas().set_index("protein").sort_index()
    batch = fit.contrast_models(fit.fit_models(df, robust=False, use_batch=True), contrast).toPandas().set_index("protein").sort_index()
    for out in (plain, robust, batch):
        assert len(out) == 30
        assert ((out["log2_fold_change"].iloc[:5] - 4).abs() < 1).all()
        assert (out["adjusted_p_value"].iloc[:5] < 0.05).all()
        assert (out["adjusted_p_value"] >= out["p_value"] - 1e-15).all()
        assert out["p_value"].between(0, 1).all()


def test_group_means_follow_the_textbook(spark):
    rows = [("p", f"a{i}", "A", "b", v) for i, v in enumerate([1.0, 2.0, 3.0])]
    rows += [("p", f"b{i}", "B", "b", v) for i, v in enumerate([2.0, 4.0])]
    contrast = spark.createDataFrame(CONTRAST, CONTRAST_SCHEMA)
    row = fit.contrast_group_means(fit.fit_group_means(spark.createDataFrame(rows, LEVELS)), contrast).first()
    variance = (2.0 + 2.0) / 3
    assert row["log2_fold_change"] == pytest.approx(-1.0)
    assert row["standard_error"] == pytest.approx(math.sqrt(variance * (1 / 3 + 1 / 2)))
    assert row["df"] == 3


def test_flat_proteins_get_no_test(spark):
    rows = level_rows(np.random.default_rng(1), 4) + [("flat", f"{c}_{r}", c, "b1", 7.0) for c in "AB" for r in range(3)]
    df = spark.createDataFrame(rows, LEVELS)
    contrast = spark.createDataFrame(CONTRAST, CONTRAST_SCHEMA)
    out = fit.contrast_models(fit.fit_models(df), contrast, flat=fit.zero_variance(df)).where("protein = 'flat'").first()
    assert out["log2_fold_change"] == 0.0 and out["p_value"] is None and out["adjusted_p_value"] is None


def test_huber_fit_resists_an_outlier():
    y = np.array([1.0, 1.1, 0.9, 1.05, 0.95, 1.0, 1.02, 0.98, 50.0])
    found, _, _ = fit.huber_fit(fit.Groups.of(np.repeat("a", 9)), y, rounds=50)
    assert abs(found.coef[0] - 1.0) < 0.2


@pytest.mark.parametrize("batches", [None, ["x", "y", "z"]])
def test_models_equal_dense_least_squares(spark, batches):
    rng = np.random.default_rng(6)
    n = 60
    condition = rng.choice(["A", "B", "C", "D"], n)
    batch = rng.choice(batches, n) if batches else np.repeat("x", n)
    y, w = rng.normal(size=n), rng.uniform(0.2, 1, n)
    x = np.stack([condition == c for c in "ABCD"], axis=1).astype(float)
    if batches:
        x = np.hstack([x, np.stack([batch == b for b in batches[1:]], axis=1)])
    cov = np.linalg.inv(x.T @ (x * w[:, None]))
    beta = cov @ x.T @ (w * y)
    found = fit.Groups.of(condition, batch if batches else None).solve(y, w)
    assert np.allclose(found.coef, beta[:4]) and np.allclose(found.shift, beta[4:]) and found.rank == x.shape[1]
    assert np.allclose(np.diag(found.inverse) + found.shifts @ found.shifts.T, cov[:4, :4])
    rows = [("p", f"s{i}", str(c), str(b), float(v)) for i, (c, b, v) in enumerate(zip(condition, batch, y))]
    weights = {"A": 0.5, "B": 0.5, "C": -1.0}
    contrast = spark.createDataFrame([("k", c, v) for c, v in weights.items()], CONTRAST_SCHEMA)
    models = fit.fit_models(spark.createDataFrame(rows, LEVELS), robust=False, use_batch=bool(batches))
    row = fit.contrast_models(models, contrast).first()
    cov = np.linalg.inv(x.T @ x)
    beta = cov @ x.T @ y
    l = np.array([weights.get(c, 0.0) for c in "ABCD"] + [0.0] * (x.shape[1] - 4))
    sigma = math.sqrt(((y - x @ beta) ** 2).sum() / (n - x.shape[1]))
    assert row["log2_fold_change"] == pytest.approx(l @ beta)
    assert row["standard_error"] == pytest.approx(sigma * math.sqrt(l @ cov @ l))


def test_a_model_of_many_conditions_stays_small():
    k = 2000
    condition, batch = np.repeat(np.arange(k), 3), np.tile(["x", "y", "z"], k)
    found = fit.Groups.of(condition, batch).solve(np.arange(3.0 * k), np.ones(3 * k))
    assert found.inverse.shape == (k,) and found.shifts.shape == (k, 2) and found.rank == k + 2


def test_batch_effect_is_removed(spark):
    rows = [("p", f"{c}{b}{r}", c, b, 10 + (3 if c == "A" else 0) + (5 if b == "b2" else 0)) for c in "AB" for b in ("b1", "b2") for r in range(2)]
    df = spark.createDataFrame([(*r[:4], float(r[4])) for r in rows], LEVELS)
    out = fit.remove_batch_effect(df).toPandas()
    means = out.groupby(["condition", "batch"])["level"].mean().unstack()
    assert np.allclose(means["b1"], means["b2"])
    assert np.allclose(means.loc["A"] - means.loc["B"], 3)


def matrix_frame(spark, matrix):
    rows = [(f"f{i:03d}", f"c{j}", float(v)) for i, r in enumerate(matrix) for j, v in enumerate(r) if not np.isnan(v)]
    return spark.createDataFrame(rows, "feature string, comparison string, value double")


def test_pair_sums_hold_few_cells_at_once(monkeypatch):
    """A chunk of any length is multiplied in parts of bounded size, and the sums are those of the whole."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(compare, "CELLS_AT_ONCE", 50)
    monkeypatch.setattr(compare, "DENSE_CELLS", 40)
    most, multiply = [], compare._PairSums.multiply
    monkeypatch.setattr(compare._PairSums, "multiply", lambda self, last: (most.append(self.rows), multiply(self, last)))
    x = np.where(rng.random((200, 7)) < 0.6, rng.normal(size=(200, 7)), np.nan)
    cells = [(f"f{i:03}", f"c{j}", x[i, j], j % 2, 0, 1, 0) for i in range(200) for j in range(7) if not np.isnan(x[i, j])]
    pdf = pd.DataFrame(cells, columns=["feature", "comparison", "value", "b", "bi", "bj", "chunk"])
    (out,) = compare._multiplied(iter([pdf[k : k + 30].copy() for k in range(0, len(pdf), 30)]))
    assert max(most) < 100 and len(out) == 12
    for r in out.itertuples():
        a, b = x[:, int(r.left[1])], x[:, int(r.right[1])]
        both = ~np.isnan(a) & ~np.isnan(b)
        want = [both.sum(), a[both].sum(), b[both].sum(), (a[both] ** 2).sum(), (b[both] ** 2).sum(), (a * b)[both].sum()]
        assert r.left < r.right and np.allclose([getattr(r, k) for k in compare.SUMS], want)


def test_pairwise_correlation_and_support(spark):
    x = np.random.default_rng(4).normal(size=120)
    matrix = np.column_stack([x, 2 * x, -x, x])
    matrix[110:, 2] = np.nan
    matrix[50:, 3] = np.nan
    fc = matrix_frame(spark, matrix)
    for blocks, chunks in ((None, None), (3, 4)):
        got = {(r["left"], r["right"]): (r["correlation"], r["support"]) for r in compare.pairwise_pearson(fc, 100, blocks, chunks).collect()}
        assert len(got) == 10
        assert got[("c0", "c1")] == (pytest.approx(1.0), 120)
        assert got[("c0", "c2")] == (pytest.approx(-1.0), 110)
        assert got[("c0", "c3")] == (None, 50)
    corr = compare.pairwise_pearson(fc, 100)
    sides = {r["side"]: r["comparison"] for r in compare.nearest_and_least(compare.neighbours(corr, "c0"), 1).collect()}
    assert sides == {"nearest": "c1", "least": "c2"}
    assert compare.pairwise_spearman(fc, "c0", "c2").first()["correlation"] == pytest.approx(-1.0)


def test_constant_comparison_has_no_correlation(spark):
    matrix = np.column_stack([np.arange(10.0), np.full(10, 0.1)])
    corr = compare.pairwise_pearson(matrix_frame(spark, matrix), 2).where("left = 'c0' and right = 'c1'").first()
    assert corr["correlation"] is None and corr["support"] == 10


def test_components_match_numpy(spark):
    rng = np.random.default_rng(11)
    matrix = rng.normal(size=(40, 9)) + np.outer(rng.normal(size=40), np.linspace(-2, 2, 9))
    rows = [(f"p{i}", f"s{j}", float(v)) for i, r in enumerate(matrix) for j, v in enumerate(r)] + [("gap", "s0", 1.0)]
    df = spark.createDataFrame(rows, "protein_accession string, sample_id string, processed_log2_abundance double")
    x = matrix.T
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    for width in (64, 9, 4, 2):
        out = pca.pca(df, width=width).toPandas().sort_values("sample_id")
        assert np.allclose(np.abs(out["pc1"]), np.abs(u[:, 0] * s[0]), atol=1e-6)
        assert np.allclose(np.abs(out["pc2"]), np.abs(u[:, 1] * s[1]), atol=1e-6)
        assert out["pc1_variance"].iloc[0] == pytest.approx(s[0] ** 2 / (s**2).sum() * 100)
    assert pca.pca(df.where("protein_accession = 'p0'")).first()["method"] == "unavailable"


def test_embedding_matches_numpy(spark):
    rng = np.random.default_rng(12)
    fc = matrix_frame(spark, rng.normal(size=(60, 7)) + np.outer(rng.normal(size=60), rng.normal(size=7)))
    corr = compare.pairwise_pearson(fc, 3)
    whole, steps = (pca.embed(corr, width=w).toPandas().sort_values("item") for w in (64, 2))
    assert np.allclose(whole[["x", "y"]], steps[["x", "y"]], atol=1e-6)


def test_block_krylov_needs_few_passes():
    rng = np.random.default_rng(3)
    root = rng.normal(size=(900, 700)) * np.linspace(1, 0.2, 700)
    root[:, 0] *= 8
    root[:, 1] *= 5
    matrix, passes = root.T @ root, []
    values, vectors = pca.block_krylov(lambda x: passes.append(1) or matrix @ x, 700)
    want, full = np.linalg.eigh(matrix)
    assert np.allclose(values, want[::-1][:2]) and len(passes) <= 8
    assert np.allclose(np.abs(vectors.T @ full[:, ::-1][:, :2]), np.eye(2), atol=1e-6)
    # Equal values and a matrix of low rank end as well.
    assert np.allclose(pca.block_krylov(lambda x: x, 200, width=8)[0], 1)
    assert np.allclose(pca.block_krylov(lambda x: np.zeros_like(x), 200, width=8)[0], 0)


def es_reference(ranked, genes):
    hits = np.array([g in genes for g, _ in ranked])
    weight = np.abs([m for _, m in ranked])
    walk = np.cumsum(np.where(hits, weight / weight[hits].sum(), -1 / (len(ranked) - hits.sum())))
    return walk, walk[np.abs(walk).argmax()]


def test_enrichment(spark):
    rng = np.random.default_rng(13)
    genes = [f"g{i:03d}" for i in range(200)]
    metrics = np.sort(rng.normal(size=200))[::-1]
    sets = {"top": genes[:20], "random": list(rng.choice(genes, 30, replace=False)), "bottom": genes[-25:], "tiny": genes[:3]}
    ranked = enrich.with_positions(spark.createDataFrame([(g, float(m)) for g, m in zip(genes, metrics)], "gene string, metric double"))
    frame = spark.createDataFrame([(s, g) for s, members in sets.items() for g in members], "set string, gene string")
    got = {r["set"]: r["es"] for r in enrich.enrichment_score(ranked, frame).collect()}
    listing = list(zip(genes, metrics))
    assert set(got) == {"top", "random", "bottom"}
    for name, es in got.items():
        assert es == pytest.approx(es_reference(listing, set(sets[name]))[1], abs=1e-9)
    curve = enrich.running_es(ranked, frame.where("set = 'random'").select("gene")).orderBy("position").toPandas()
    assert np.allclose(curve["es"], es_reference(listing, set(sets["random"]))[0])
    out = {r["set"]: r for r in enrich.prerank(ranked, frame, permutations=200).collect()}
    assert out["top"]["nes"] > 1.5 and out["top"]["pval"] < 0.05 and out["top"]["fdr"] < 0.25
    assert out["bottom"]["nes"] < -1.5 and out["bottom"]["fdr"] < 0.25
    assert out["random"]["pval"] > 0.01
    again = {r["set"]: r["nes"] for r in enrich.prerank(ranked, frame, permutations=200).collect()}
    assert again["random"] == out["random"]["nes"]
    edge = [r["gene"] for r in enrich.leading_edge(ranked, frame).where("set = 'top'").collect()]
    assert set(edge) <= set(sets["top"]) and len(edge) >= 15


def test_permuted_scores_are_those_of_relabelled_lists(spark, monkeypatch):
    rng = np.random.default_rng(4)
    frames, sets = [], {"s": [f"g{i:03d}" for i in range(0, 60, 2)], "t": [f"g{i:03d}" for i in range(20)]}
    rankings = {c: {f"g{i:03d}": float(v) for i, v in enumerate(rng.normal(size=150))} for c in ("one", "two")}
    frames = [(c, g, m) for c, ranking in rankings.items() for g, m in ranking.items()]
    ranked = enrich.with_positions(spark.createDataFrame(frames, "k string, gene string, metric double"), by=["k"])
    frame = spark.createDataFrame([(s, g) for s, members in sets.items() for g in members], "set string, gene string")
    found = {(r["k"], r["set"], r["permutation"]): r["es"] for r in enrich.null_scores(ranked, frame, 120, by=["k"]).collect()}
    assert len(found) == 2 * 2 * 120
    for comparison, ranking in rankings.items():
        listing = sorted(ranking.items(), key=lambda x: -x[1])
        genes = [g for g, _ in listing]
        for permutation in (1, 101, 120):
            drawn = enrich.drawn_positions(enrich.SEED, permutation, genes)
            relabelled = [(genes[i], m) for i, m in zip(np.argsort(drawn), [m for _, m in listing])]
            for name, members in sets.items():
                want = es_reference(relabelled, set(members))[1]
                assert found[comparison, name, permutation] == pytest.approx(want, abs=1e-9)
    single = enrich.with_positions(ranked.where("k = 'one'").select("gene", "metric"))
    alone = {(r["set"], r["permutation"]): r["es"] for r in enrich.null_scores(single, frame, 120).collect()}
    assert all(alone[s, p] == pytest.approx(found["one", s, p], abs=1e-12) for s, p in alone) and len(alone) == 240
    # One set a block gives the same scores as all in one.
    monkeypatch.setattr(enrich, "MEMBERS_PER_TASK", 8)
    apart = {(r["k"], r["set"], r["permutation"]): r["es"] for r in enrich.null_scores(ranked, frame, 120, by=["k"]).collect()}
    assert apart == pytest.approx(found, abs=1e-12)


def test_cv_quality_rules(spark):
    rows = [("p1", "A", r, 100.0) for r in (1, 2, 3)] + [("p2", "A", 1, 5.0)] + [("p3", "B", 1, 10.0), ("p3", "B", 2, 40.0)]
    df = spark.createDataFrame(rows, "Unique_PSM string, Condition string, Replicate int, Abundance double")
    got = {r["Condition"]: r for r in qc.psm_cv(df).collect()}
    assert got["A"]["median"] == 0.0 and got["A"]["value_count"] == 1
    sd = np.std(np.log([10.0, 40.0]), ddof=1)
    assert got["B"]["median"] == pytest.approx(math.sqrt(math.exp(sd**2) - 1) * 100)
