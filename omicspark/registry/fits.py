"""SQL counterparts of the iterative fits: the same sweeps and rounds as recursive queries over the cells.

Each is a list of common table expressions over a view; a recursion carries every cell with its effects, and
windows take the medians and weighted means of rows and columns. They serve small tables.
"""

from __future__ import annotations

# A cell is numbered so that the recursion carries whole numbers; ff and fs mark one cell of each feature and sample.
CELLS = """cell AS (SELECT dense_rank() OVER (ORDER BY protein) AS p, dense_rank() OVER (ORDER BY protein, feature) AS f,
  dense_rank() OVER (ORDER BY protein, sample) AS s, row_number() OVER (PARTITION BY protein, feature ORDER BY sample) = 1 AS ff,
  row_number() OVER (PARTITION BY protein, sample ORDER BY feature) = 1 AS fs, x, protein, sample
  FROM (SELECT protein, feature, sample, avg(log2_abundance) AS x FROM {source} WHERE log2_abundance IS NOT NULL GROUP BY ALL))"""

# Median polish, rows first: ten rounds at most, ended by a change of less than a hundredth of the absolute rest.
POLISH = CELLS + """,
polish AS (
  SELECT p, f, s, ff, fs, x AS z, 0.0::DOUBLE AS r, 0.0::DOUBLE AS c, 0.0::DOUBLE AS t, 0.0::DOUBLE AS size, false AS done, 0 AS k FROM cell
  UNION ALL
  SELECT p, f, s, ff, fs, z, r - rm, c, t + rm, now, now = 0 OR abs(now - size) < 0.01 * now, k + 1 FROM (
    SELECT *, sum(abs(z)) OVER (PARTITION BY p) AS now, median(CASE WHEN ff THEN r END) OVER (PARTITION BY p) AS rm FROM (
      SELECT p, f, s, ff, fs, z - step AS z, r, c + step AS c, t, size, k FROM (
        SELECT *, median(z) OVER (PARTITION BY s) AS step FROM (
          SELECT p, f, s, ff, fs, z - step AS z, r + step AS r, c - cm AS c, t + cm AS t, size, k FROM (
            SELECT *, median(z) OVER (PARTITION BY f) AS step, median(CASE WHEN fs THEN c END) OVER (PARTITION BY p) AS cm
            FROM polish WHERE NOT done AND k < 10)))))
),
polished AS (SELECT protein, sample, round(arg_max(polish.t + polish.c, k), {digits}) AS log2_abundance FROM polish JOIN cell USING (p, f, s) GROUP BY ALL)"""



def polished_or_median(rows: str, digits: int = 5, least: int = 2) -> str:
    """CTE ``summary``: median polish of the proteins of ``rows`` with enough features in some sample, else sample medians."""
    return f"""few AS (SELECT protein FROM (SELECT protein, sample, count(*) AS n FROM {rows} GROUP BY ALL) GROUP BY protein HAVING max(n) < {least}),
enough AS (SELECT * FROM {rows} WHERE protein NOT IN (SELECT protein FROM few)),
{POLISH.format(source='enough', digits=digits)},
summary AS (SELECT * FROM polished UNION ALL
  SELECT protein, sample, round(median(log2_abundance), {digits}) FROM {rows} WHERE protein IN (SELECT protein FROM few) GROUP BY ALL)"""


# Sweeps of row and column means until nothing moves by more than a billionth of the largest value.
ADDITIVE = CELLS + """,
additive AS (
  SELECT p, f, s, ff, x, 0.0::DOUBLE AS r, 0.0::DOUBLE AS c, greatest(1, max(abs(x)) OVER (PARTITION BY p)) * 1e-9 AS least, false AS done, 0 AS k FROM cell
  UNION ALL
  SELECT p, f, s, ff, x, r1, c1, least, max(greatest(abs(r1 - r), abs(c1 - c))) OVER (PARTITION BY p) < least, k + 1 FROM (
    SELECT *, avg(x - r1) OVER (PARTITION BY s) AS c1 FROM (
      SELECT *, avg(x - c) OVER (PARTITION BY f) AS r1 FROM additive WHERE NOT done AND k < 1000))
),
settled AS (SELECT * FROM additive WHERE done),
centred AS (SELECT *, c + avg(CASE WHEN ff THEN r END) OVER (PARTITION BY p) AS level FROM settled)"""
LINEAR = ADDITIVE + """,
fitted AS (SELECT protein, sample, round(any_value(level), {digits}) AS log2_abundance FROM centred JOIN cell USING (p, f, s) GROUP BY ALL)"""

# From the settled fit on, one sweep a round under Huber's weights of the rest, until no level moves.
ROBUST = ADDITIVE + """,
robust AS (
  SELECT p, f, s, ff, x, r, c, level, least, false AS done, 0 AS k FROM centred
  UNION ALL
  SELECT p, f, s, ff, x, r, c, now, least, max(abs(now - level)) OVER (PARTITION BY p) < least, k + 1 FROM (
    SELECT *, c + avg(CASE WHEN ff THEN r END) OVER (PARTITION BY p) AS now FROM (
      SELECT p, f, s, ff, x, r, sum(w * (x - r)) OVER (PARTITION BY s) / sum(w) OVER (PARTITION BY s) AS c, level, least, k FROM (
        SELECT p, f, s, ff, x, w, c, level, least, k, sum(w * (x - c)) OVER (PARTITION BY f) / sum(w) OVER (PARTITION BY f) AS r FROM (
          SELECT *, CASE WHEN scale < 1e-12 OR abs(x - r - c) <= 1.345 * scale THEN 1.0 ELSE 1.345 * scale / abs(x - r - c) END AS w FROM (
            SELECT *, median(abs(x - r - c)) OVER (PARTITION BY p) / 0.6745 AS scale FROM robust WHERE NOT done AND k < 1000)))))
),
fitted AS (SELECT protein, sample, round(arg_max(robust.level, k), {digits}) AS log2_abundance FROM robust JOIN cell USING (p, f, s) GROUP BY ALL)"""

# ----------------------------------------------------------------- linear models

# Condition means of one row per protein and sample; ten rounds of Huber's weights at most.
HUBER = """sample_row AS (SELECT protein, sample, min(condition) AS g, avg(level) AS y FROM levels WHERE level IS NOT NULL AND NOT isnan(level) GROUP BY ALL),
huber AS (
  SELECT protein, sample, g, y, 1.0::DOUBLE AS w, avg(y) OVER (PARTITION BY protein, g) AS m, false AS done, 0 AS k FROM sample_row
  UNION ALL
  SELECT protein, sample, g, y, w1, m1, scale < 1e-12 OR max(abs(m1 - m)) OVER (PARTITION BY protein) < 1e-6, k + 1 FROM (
    SELECT *, CASE WHEN scale < 1e-12 THEN m ELSE sum(w1 * y) OVER (PARTITION BY protein, g) / sum(w1) OVER (PARTITION BY protein, g) END AS m1 FROM (
      SELECT *, CASE WHEN scale < 1e-12 THEN w WHEN abs(y - m) <= 1.345 * scale THEN 1.0 ELSE 1.345 * scale / abs(y - m) END AS w1 FROM (
        SELECT *, median(abs(y - m - middle)) OVER (PARTITION BY protein) / 0.6745 AS scale FROM (
          SELECT *, median(y - m) OVER (PARTITION BY protein) AS middle FROM huber WHERE NOT done AND k < 10))))
),
weighed AS (SELECT * FROM huber QUALIFY k = max(k) OVER (PARTITION BY protein)),
coefficient AS (SELECT protein, g, any_value(m) AS m, 1 / sum(w) AS inverse FROM weighed GROUP BY ALL),
model AS (SELECT protein, sum(w) - count(DISTINCT g) AS df,
  CASE WHEN sum(w) - count(DISTINCT g) > 0 THEN sqrt(sum(w * (y - m) * (y - m)) / (sum(w) - count(DISTINCT g))) END AS sigma FROM weighed GROUP BY protein)"""

# Condition means with a shift of the second of two batches, solved for the shift.
BATCHED = """sample_row AS (SELECT protein, sample, min(condition) AS g, min(batch) AS batch, avg(level) AS y FROM levels
  WHERE level IS NOT NULL AND NOT isnan(level) GROUP BY protein, sample),
marked AS (SELECT *, (batch <> min(batch) OVER (PARTITION BY protein))::INT AS second FROM sample_row),
grp AS (SELECT protein, g, count(*) AS n, sum(second) AS x, avg(y) AS mean, sum(second * y) AS later FROM marked GROUP BY ALL),
rest AS (SELECT protein, sum(x) - sum(x * x / n) AS left_over, sum(later) - sum(x * mean) AS pull, max(n) AS most, count(*) AS groups, sum(n) AS rows FROM grp GROUP BY protein),
solved AS (SELECT protein, groups, rows, left_over > most * 1e-10 AS told, CASE WHEN left_over > most * 1e-10 THEN pull / left_over ELSE 0 END AS shift,
  CASE WHEN left_over > most * 1e-10 THEN left_over END AS left_over FROM rest),
coefficient AS (SELECT protein, g, mean - x / n * shift AS m, 1 / n AS inverse, x / n / sqrt(left_over) AS tilt FROM grp JOIN solved USING (protein)),
model AS (SELECT protein, any_value(rows - groups - told::INT)::DOUBLE AS df,
  CASE WHEN any_value(rows - groups - told::INT) > 0 THEN sqrt(sum(pow(y - m - second * shift, 2)) / any_value(rows - groups - told::INT)) END AS sigma
  FROM marked JOIN coefficient USING (protein, g) JOIN solved USING (protein) GROUP BY protein)"""


def mean_model(levels: str) -> str:
    """Condition means of ``levels`` (protein, g, y), one row per sample, with pooled spread."""
    return f"""part AS (SELECT protein, g, count(*) AS n, avg(y) AS m, coalesce(var_samp(y), 0) * (count(*) - 1) AS ss FROM {levels} GROUP BY ALL),
coefficient AS (SELECT protein, g, m, 1 / n AS inverse FROM part),
model AS (SELECT protein, CAST(sum(n) - count(*) AS DOUBLE) AS df, CASE WHEN sum(n) > count(*) THEN sqrt(sum(ss) / (sum(n) - count(*))) END AS sigma FROM part GROUP BY protein)"""


def t_tail(t: str, df: str, steps: int = 400) -> str:
    """Two-sided tail of Student's t: Simpson's rule over the angle whose tangent is t / sqrt(df)."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    rule = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    area = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: ({rule}) * pow(cos({angle} * i / {steps}), ({df}) - 1))) * {angle} / {3 * steps}"
    scale = f"2 * exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(pi())"
    return f"greatest(0.0, 1 - {scale} * ({area}))"


def digamma(x: str) -> str:
    z = f"({x} + 8)"
    steps = " + ".join(f"1 / ({x} + {i})" for i in range(8))
    return f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * pow({z}, 2)) + 1 / (120 * pow({z}, 4)) - 1 / (252 * pow({z}, 6)) + 1 / (240 * pow({z}, 8)) - ({steps}))"


def trigamma(x: str) -> str:
    z = f"({x} + 8)"
    steps = " + ".join(f"1 / pow({x} + {i}, 2)" for i in range(8))
    return f"(1 / {z} + 1 / (2 * pow({z}, 2)) + 1 / (6 * pow({z}, 3)) - 1 / (30 * pow({z}, 5)) + 1 / (42 * pow({z}, 7)) - 1 / (30 * pow({z}, 9)) + {steps})"


# Prior degrees of freedom and variance from the spread of log variances; the trigamma function is inverted by halving.
# Without extra spread the prior has no end, for which a very large number of degrees stands.
ENDLESS = 1e7
PRIOR = f"""spread AS (SELECT 2 * ln(sigma) - {digamma('(df / 2)')} + ln(df / 2) AS e, {trigamma('(df / 2)')} AS t FROM model WHERE df > 0 AND sigma > 0),
moment AS (SELECT avg(e) AS m, coalesce(var_samp(e), 0) - avg(t) AS extra FROM spread),
half AS (
  SELECT 1e-9::DOUBLE AS lo, 1e9::DOUBLE AS hi, 0 AS k
  UNION ALL
  SELECT CASE WHEN {trigamma('sqrt(lo * hi)')} > extra THEN sqrt(lo * hi) ELSE lo END, CASE WHEN {trigamma('sqrt(lo * hi)')} > extra THEN hi ELSE sqrt(lo * hi) END, k + 1
  FROM half, moment WHERE k < 120
),
prior AS (SELECT extra > 0 AS ended, 2 * lo AS d0, CASE WHEN extra > 0 THEN exp(m + {digamma('lo')} - ln(lo)) ELSE exp(m) END AS s0 FROM half, moment WHERE k = 120),
tested AS (SELECT protein, CASE WHEN ended THEN sqrt((d0 * s0 + greatest(df, 0) * coalesce(sigma * sigma, 0)) / (d0 + greatest(df, 0))) ELSE sqrt(s0) END AS sigma,
  CASE WHEN ended THEN greatest(df, 0) + d0 ELSE 'infinity'::DOUBLE END AS df FROM model, prior)"""


def contrasts(model: str, comparisons: str, tilted: bool = False, flat: bool = False) -> str:
    """CTE ``test``: effect, error, t, df, p and adjusted p of every comparison of which a protein has all groups."""
    tilt = "pow(coalesce(sum(weight * tilt), 0), 2)" if tilted else "0"
    blank = lambda x: f"CASE WHEN NOT flat THEN {x} END" if flat else x
    known = "protein IN (SELECT protein FROM levels GROUP BY protein HAVING var_samp(level) < 1e-10)" if flat else "false"
    df = f"CASE WHEN isinf(df) THEN {ENDLESS} ELSE df END"
    return f"""terms_of AS (SELECT comparison_id, count(*) AS terms FROM {comparisons} GROUP BY 1),
term AS (SELECT protein, comparison_id, sum(weight * m) AS fc, sum(weight * weight * inverse) + {tilt} AS u, count(*) AS found
  FROM coefficient JOIN {comparisons} ON k.condition = g GROUP BY ALL),
raw AS (SELECT protein, comparison_id, fc, sigma * sqrt(u) AS se, df, {known} AS flat FROM term JOIN terms_of USING (comparison_id) JOIN {model} USING (protein) WHERE found = terms),
stat AS (SELECT protein, comparison_id, CASE WHEN flat THEN 0.0 ELSE fc END AS fc, {blank('se')} AS se, {blank('df')} AS df,
  {blank('CASE WHEN se <> 0 THEN fc / se END')} AS t FROM raw),
pval AS (SELECT *, CASE WHEN t IS NOT NULL AND df > 0 THEN {t_tail('t', df)} END AS p FROM stat),
ordered AS (SELECT *, row_number() OVER (PARTITION BY comparison_id ORDER BY p) AS i, count(p) OVER (PARTITION BY comparison_id) AS n FROM pval),
test AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1, min(p * n / i) OVER (PARTITION BY comparison_id ORDER BY p DESC, i DESC)) END AS adjusted FROM ordered)"""


SHOWN = """SELECT protein, comparison_id, round(fc, 5) AS log2_fold_change, round(se, 5) AS standard_error, round(df, 4) AS df,
  CASE WHEN se > 1e-6 THEN round(t, 3) END AS statistic, CASE WHEN se > 1e-6 THEN round(p, 5) END AS p_value FROM test"""


# -------------------------------------------------------------------- components


def top_pairs(matrix: str, squarings: int = 44) -> str:
    """CTEs ``pair1`` and ``pair2`` (i, v, value): the two largest eigenpairs of ``matrix`` (i, j, v).

    A matrix squared again and again, divided by its trace, becomes the projector on its first eigenvector; the
    second comes from what the first leaves. The entry of largest size of a vector is positive.
    """
    parts = []
    for k, source in ((1, matrix), (2, "left_over")):
        last = source
        for s in range(squarings):
            name = f"q{k}_{s}"
            parts.append(
                f"{name} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM x{name} WHERE i = j) AS v FROM x{name})"
            )
            parts.insert(-1, f"x{name} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {last} a JOIN {last} b ON a.j = b.i GROUP BY ALL)")
            last = name
        parts.append(f"top{k} AS (SELECT j FROM {last} WHERE i = j ORDER BY v DESC, i LIMIT 1)")
        parts.append(f"raw{k} AS (SELECT i, v / sqrt((SELECT v FROM {last} WHERE i = (SELECT j FROM top{k}) AND j = i)) AS v FROM {last} WHERE j = (SELECT j FROM top{k}))")
        parts.append(
            f"pair{k} AS MATERIALIZED (SELECT i, v * (SELECT sign(arg_max(v, abs(v))) FROM raw{k}) AS v, "
            f"(SELECT sum(a.v * m.v * b.v) FROM raw{k} a JOIN {source} m ON m.i = a.i JOIN raw{k} b ON b.i = m.j) AS value FROM raw{k})"
        )
        if k == 1:
            parts.append(
                f"left_over AS MATERIALIZED (SELECT m.i, m.j, m.v - a.value * a.v * b.v AS v FROM {matrix} m JOIN pair1 a ON a.i = m.i JOIN pair1 b ON b.i = m.j)"
            )
    return ",\n".join(parts)


# Standardised features that every sample has, and the product of samples.
GRAM = """place AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS i FROM (SELECT DISTINCT item FROM value)),
whole AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS s FROM value WHERE x IS NOT NULL AND isfinite(x) GROUP BY feature
  HAVING count(*) = (SELECT count(*) FROM place)),
z AS (SELECT feature, i, (x - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS z FROM value JOIN whole USING (feature) JOIN place USING (item)),
product AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.z * b.z) AS v FROM z a JOIN z b USING (feature) GROUP BY ALL),
total AS (SELECT sum(z * z) AS total FROM z)"""
