"""The queries of this subpackage over the test tables, and the SQL of those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from omicspark.llm import (
    bpe_count,
    collocations,
    embedding_dedup,
    license_scan,
    merkle,
    periodic_runs,
    quality,
    secret_scan,
    sentencepiece_codec,
    simhash,
    source_mix,
    topk_search,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("findings", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("findings", lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in secret_scan.KINDS],
        F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("findings")).alias("spans"),
        F.col("findings_unopened").alias("n_unopened"),
    )


def op3_bpe_count(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_count.count_tokens(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return topk_search.top_k(table(spark, folder, "embeddings"))


def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, folder, "documents"), public_tokenizers.path(PIECE_BPE))


def op9_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = source_mix.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = periodic_runs.periodic_runs(docs, planted=F.crc32(F.col("doc_id").cast("string").cast("binary")))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = merkle.edited_fingerprints(table(spark, folder, "documents"))
    own, edited = F.col("fingerprint"), F.col("edited_fingerprint")
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        merkle.likeness(own, edited).alias("near_edited"),
        merkle.likeness(own, F.col("next_fingerprint")).alias("near_next"),
        merkle.edited_span(own, edited).alias("span"),
    ).select("*", F.col("span.start").alias("edit_start"), F.col("span.stop").alias("edit_stop")).drop("span")


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_embedding_dedup, op2_secret_scan, op3_bpe_count, op4_quality, op5_license_scan,
            op6_toxicity, op7_topk_search, op8_sentencepiece, op9_source_mix, op10_simhash,
            op11_collocations, op12_periodic_runs, op13_fingerprints,
        )
    }


_OP1 = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
sized AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM usable),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sized a JOIN sized b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
),
reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
),
smallest AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, s.component_id, v.vec_id = s.component_id AS kept
FROM embeddings v JOIN smallest s ON s.node = v.vec_id LEFT JOIN counted c ON c.a = v.vec_id
"""

_OP7 = """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM scaled q JOIN scaled c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
),
ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    wanted = license_scan.templates(license_scan.TEMPLATES, 0.85)
    rows = ", ".join(
        f"({i}, {_quoted(t.label)}, {t.needed}, {len(t.words)}, {_quoted(w)})" for i, t in enumerate(wanted) for w in sorted(t.words)
    )
    words = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    lower = f"translate(coalesce(text, ''), '{license_scan._UPPER}', '{license_scan._LOWER}')"
    tests = " OR ".join(
        "(" + " AND ".join(f"w[i + {k}] = {_quoted(x)}" for k, x in enumerate(p.split())) + ")" for p, _ in license_scan.PHRASES
    )
    cases = " ".join(
        "WHEN " + " AND ".join(f"w[i + {k}] = {_quoted(x)}" for k, x in enumerate(p.split())) + f" THEN {_quoted(label)}"
        for p, label in license_scan.PHRASES
    )
    return rf"""
WITH notice(n, label, needed, members, word) AS (VALUES {rows}),
doc AS (SELECT row_number() OVER () AS r, doc_id, {lower} AS body FROM documents),
listed AS (SELECT r, doc_id, regexp_extract_all(body, {words}) AS w FROM doc),
place AS (
  SELECT r, i - 1 AS place, CASE {cases} END AS label
  FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM listed) WHERE {tests}
),
base AS (SELECT r, count(*) AS n, min(place) AS f, max(place) AS l FROM place GROUP BY r),
line AS (SELECT r, row_number() OVER () AS b, line FROM (SELECT r, unnest(regexp_split_to_array(body, '[\n\r]+')) AS line FROM doc)),
word AS (SELECT DISTINCT r, b, unnest(regexp_extract_all(line, {words})) AS word FROM line),
held AS (
  SELECT r, b, n, label, count(*) / any_value(members) AS share FROM word JOIN notice USING (word)
  GROUP BY r, b, n, label HAVING count(*) >= any_value(needed)
),
best AS (SELECT r, max(share) AS score FROM held GROUP BY r),
labels AS (
  SELECT r, string_agg(label, ',' ORDER BY label) AS labels
  FROM (SELECT r, label FROM place UNION SELECT r, label FROM held) GROUP BY r
),
base_labels AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT r, label FROM place) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.f::BIGINT AS first_word,
  base.l::BIGINT AS last_word, coalesce(base_labels.labels, '') AS base_labels, coalesce(labels.labels, '') AS labels,
  coalesce(best.score, 0.0)::DOUBLE AS score
FROM listed LEFT JOIN base USING (r) LEFT JOIN best USING (r) LEFT JOIN labels USING (r) LEFT JOIN base_labels USING (r)
"""


def _hex(expression: str) -> str:
    """The number that the first 8 hexadecimal digits of a text write."""
    digits = [f"(strpos('0123456789abcdef', substr({expression}, {i + 1}, 1)) - 1) * {16 ** (7 - i)}" for i in range(8)]
    return "(" + " + ".join(digits) + ")::BIGINT"


_OP9 = rf"""
WITH doc AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('0:' || coalesce(doc_id::VARCHAR, '')) AS mark
  FROM documents
),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight
  FROM doc GROUP BY source
),
full_first AS (
  SELECT *, 2.0 * source_size AS most,
    coalesce(sum(2.0 * source_size) OVER filled, 0) AS held, sum(weight) OVER () - coalesce(sum(weight) OVER filled, 0) AS open
  FROM src WINDOW filled AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
level AS (
  SELECT arg_min(level, stops) AS level FROM (
    SELECT ((SELECT sum(source_size) FROM src) * 1.5 - held) / open AS level, most / weight AS stops FROM full_first
  ) WHERE level < stops
),
aim AS (SELECT src.*, least(2.0 * source_size, weight * level)::DOUBLE AS target FROM src, level),
seats AS (SELECT round_even(sum(target) / 32, 0)::BIGINT AS n FROM aim),
asked AS (
  SELECT source, (target / 32) / (2 * i + 1) AS quotient, i
  FROM (SELECT *, unnest(generate_series(0, (source_size / 8)::BIGINT + 2)) AS i FROM aim)
),
won AS (SELECT source FROM asked ORDER BY quotient DESC, source NULLS LAST, i LIMIT (SELECT n FROM seats)),
quota AS (
  SELECT aim.*, (SELECT count(*) FROM won WHERE won.source IS NOT DISTINCT FROM aim.source) AS source_quota,
    ceil(docs / 2048)::BIGINT AS shards
  FROM aim
),
dealt AS (
  SELECT doc.*, source_size, target, source_quota, {_hex("mark")} % shards AS shard
  FROM doc JOIN quota ON doc.source IS NOT DISTINCT FROM quota.source
),
part AS (
  SELECT source, shard, sum(size)::BIGINT AS words, any_value(source_quota) AS source_quota,
    greatest(1, ceil(sum(size) / 32))::BIGINT AS blocks,
    CASE WHEN any_value(source_size) > 0 THEN (sum(size)::BIGINT * any_value(source_quota)) / any_value(source_size) ELSE 0.0 END AS ideal
  FROM dealt GROUP BY source, shard
),
part_asked AS (
  SELECT source, shard, source_quota, row_number() OVER (PARTITION BY source ORDER BY ideal / (2 * i + 1) DESC, shard, i) AS place
  FROM (SELECT *, unnest(generate_series(0, 2 * blocks + 2)) AS i FROM part)
),
part_quota AS (SELECT source, shard, count(*) AS given FROM part_asked WHERE place <= source_quota GROUP BY source, shard),
shard AS (
  SELECT part.*, least(coalesce(given, 0), 2 * blocks) AS quota,
    {_hex("md5('0:shard:' || coalesce(part.source, '') || ':' || part.shard)")} % blocks AS start_at
  FROM part LEFT JOIN part_quota ON part.source IS NOT DISTINCT FROM part_quota.source AND part.shard = part_quota.shard
),
stream AS (
  SELECT dealt.*, blocks, quota // blocks AS passes, quota % blocks AS extra, start_at,
    (sum(size) OVER (PARTITION BY dealt.source, dealt.shard ORDER BY mark ROWS UNBOUNDED PRECEDING))::BIGINT AS stop
  FROM dealt JOIN shard ON dealt.source IS NOT DISTINCT FROM shard.source AND dealt.shard = shard.shard
),
edge AS (
  SELECT *, unnest([stop - size, stop]) AS word, unnest([-1, 1]) AS sign FROM stream
),
counted AS (
  SELECT *, sign * (passes * word + ((word // 32) * extra + start_at) // blocks * 32
    + (((word // 32 + 1) * extra + start_at) // blocks - ((word // 32) * extra + start_at) // blocks) * (word % 32)) AS part
  FROM edge
)
SELECT doc_id, size, source_size, target, sum(part)::BIGINT AS taken
FROM counted GROUP BY doc_id, size, source_size, target, mark, stop
"""

_OP11 = r"""
WITH body AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
),
piece AS (SELECT lang, unnest(regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM body),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
placed AS (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM listed, (VALUES (1), (2), (3), (4)) AS sizes(m)),
gram AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*)::BIGINT AS f FROM placed GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM gram WHERE m = 1 GROUP BY lang),
candidate AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM gram WHERE m > 1 AND f >= 30),
cut AS (
  SELECT lang, m, phrase, a, k, array_to_string(w[:k], ' ') AS part, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM candidate)
),
cost AS (
  SELECT cut.*, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cut JOIN gram x ON x.lang = cut.lang AND x.phrase = part JOIN gram y ON y.lang = cut.lang AND y.phrase = rest
),
lowest AS (
  SELECT * FROM cost QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
),
inner_phrase AS (
  SELECT lang, a, array_to_string(w[i:i + s - 1], ' ') AS phrase
  FROM (SELECT *, unnest(generate_series(1, m - s + 1)) AS i FROM (SELECT *, unnest(generate_series(2, m - 1)) AS s FROM candidate WHERE m > 2))
),
covered AS (SELECT lang, phrase, max(a) AS most FROM inner_phrase GROUP BY lang, phrase),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN covered USING (lang, phrase)
  WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


_OP13 = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
speaker AS (SELECT doc_id, arg_min(t, md5(t)) AS t FROM doc WHERE doc_id IS NOT NULL GROUP BY doc_id),
following AS (
  SELECT doc_id, coalesce(lead(t) OVER (ORDER BY doc_id), first(t) OVER (ORDER BY doc_id)) AS next FROM speaker
),
pair AS (
  SELECT r, doc.doc_id, t, next,
    left(t, length(t) - length(t) // 4) || CASE WHEN next IS NULL THEN '' ELSE left(next, length(t) // 4) END AS edited
  FROM doc LEFT JOIN following ON doc.doc_id = following.doc_id
),
body AS (SELECT t FROM pair UNION SELECT edited FROM pair UNION SELECT next FROM pair WHERE next IS NOT NULL),
cut AS (
  SELECT t, list_transform(regexp_extract_all(t, '[^\n]*\n+|[^\n]+'), lambda l: struct_pack(
    blank := contains(l, chr(10) || chr(10)), s := regexp_extract_all(l, '[^.!?\n]*[.!?\n]+|[^.!?\n]+'))) AS p
  FROM body
),
hashed AS (
  SELECT t, list_transform(p, lambda x: struct_pack(
    h := sha256(array_to_string(list_transform(x.s, lambda s: sha256(s)), '')), blank := x.blank,
    l := array_to_string(list_transform(x.s, lambda s: to_base64(unhex(left(sha256(s), 12))) || length(s)), ','))) AS p
  FROM cut
),
closed AS (
  SELECT t, list_transform(p, lambda x: struct_pack(h := x.h, l := x.l, e := CASE WHEN x.blank OR x.h[1] = '0' THEN '|' ELSE ';' END)) AS p
  FROM hashed
),
joined AS (
  SELECT t, array_to_string(list_transform(p, lambda x: x.h || x.e), '') AS h, array_to_string(list_transform(p, lambda x: x.l || x.e), '') AS l
  FROM closed
),
section AS (
  SELECT t, list_transform(string_split(CASE WHEN h = '' THEN '' ELSE h[:-2] END, '|'), lambda x: sha256(x)) AS h,
    string_split(CASE WHEN l = '' THEN '' ELSE l[:-2] END, '|') AS l
  FROM joined
),
tree AS (
  SELECT t, sha256(array_to_string(h, '')) AS root, list_transform(list_zip(h, l), lambda x: left(x[1], 16) || ':' || x[2]) AS branches
  FROM section
),
sides AS (
  SELECT r, 'edited' AS side, a.root = b.root AS same, a.branches AS x, b.branches AS y
  FROM pair JOIN tree a ON a.t = pair.t JOIN tree b ON b.t = pair.edited
  UNION ALL
  SELECT r, 'next', a.root = b.root, a.branches, b.branches FROM pair JOIN tree a ON a.t = pair.t JOIN tree b ON b.t = pair.next
),
apart AS (
  SELECT r, side, same, x, y, list_distinct(list_filter(x, lambda v: list_contains(y, v))) AS common,
    list_filter(x, lambda v: NOT list_contains(y, v)) AS dx, list_filter(y, lambda v: NOT list_contains(x, v)) AS dy
  FROM sides
),
leaf AS (
  SELECT r, side, same,
    flatten(list_transform(common, lambda v: regexp_extract_all(substr(v, 18), '[^,;]+'))) AS common,
    list_distinct(flatten(list_transform(dx, lambda v: regexp_extract_all(substr(v, 18), '[^,;]+')))) AS dx,
    list_distinct(flatten(list_transform(dy, lambda v: regexp_extract_all(substr(v, 18), '[^,;]+')))) AS dy,
    flatten(list_transform(x, lambda v: regexp_extract_all(substr(v, 18), '[^,;]+'))) AS lx,
    flatten(list_transform(y, lambda v: regexp_extract_all(substr(v, 18), '[^,;]+'))) AS ly
  FROM apart
),
sized AS (
  SELECT r, side, same, lx, ly,
    coalesce(list_sum(list_transform(common, lambda v: substr(v, 9)::BIGINT)), 0)::DOUBLE AS c,
    coalesce(list_sum(list_transform(list_filter(dx, lambda v: list_contains(dy, v)), lambda v: substr(v, 9)::BIGINT)), 0)::DOUBLE AS i,
    coalesce(list_sum(list_transform(dx, lambda v: substr(v, 9)::BIGINT)), 0)::DOUBLE AS nx,
    coalesce(list_sum(list_transform(dy, lambda v: substr(v, 9)::BIGINT)), 0)::DOUBLE AS ny,
    coalesce(list_position(list_transform(list_zip(lx, ly), lambda z: z[1] IS NOT DISTINCT FROM z[2]), false), len(lx) + 1) - 1 AS ahead,
    coalesce(list_position(list_transform(list_zip(list_reverse(lx), list_reverse(ly)), lambda z: z[1] IS NOT DISTINCT FROM z[2]), false),
      len(lx) + 1) - 1 AS behind
  FROM leaf
),
found AS (
  SELECT r, side, CASE WHEN same THEN 1.0 WHEN 2 * c + nx + ny = 0 THEN 0.0 ELSE 2.0 * (c + i) / (2 * c + nx + ny) END AS near,
    CASE WHEN same THEN NULL ELSE coalesce(list_sum(list_transform(lx[:ahead], lambda v: substr(v, 9)::BIGINT)), 0) END AS start,
    coalesce(list_sum(list_transform(lx[:len(lx) - behind], lambda v: substr(v, 9)::BIGINT)), 0) AS stop
  FROM sized
)
SELECT doc_id, length(pair.t)::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
  a.root || '|' || array_to_string(a.branches, '|') AS fingerprint, b.root || '|' || array_to_string(b.branches, '|') AS edited_fingerprint,
  e.near::DOUBLE AS near_edited, coalesce(n.near, 0.0)::DOUBLE AS near_next,
  e.start::BIGINT AS edit_start, CASE WHEN e.start IS NOT NULL THEN greatest(e.start, e.stop) END::BIGINT AS edit_stop
FROM pair JOIN tree a ON a.t = pair.t JOIN tree b ON b.t = pair.edited
JOIN found e ON e.r = pair.r AND e.side = 'edited' LEFT JOIN found n ON n.r = pair.r AND n.side = 'next'
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_dedup": _OP1, "op5_license_scan": _license_sql(), "op7_topk_search": _OP7, "op9_source_mix": _OP9,
        "op11_collocations": _OP11, "op13_fingerprints": _OP13,
    }
