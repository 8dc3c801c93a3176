"""Queries of enrichment and interaction networks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omicspark.operators import enrich, network
from omicspark.registry.base import Tables, query
from omicspark.registry.quality import rounded
from omicspark.session import cut_lineage


def ranking_frame(t: Tables) -> DataFrame:
    return enrich.with_positions(t.view("ranking").select("gene", "metric"))


def gene_sets(t: Tables) -> DataFrame:
    return t.view("gene_sets").withColumnRenamed("set_name", "set")


POSITIONED = """pos AS (SELECT gene, metric, row_number() OVER (ORDER BY metric DESC, gene) - 1 AS position, count(*) OVER () AS gene_count FROM ranking)"""
SCORED = f"""{POSITIONED}, hits AS (SELECT set_name, gene, metric, position, gene_count, count(*) OVER (PARTITION BY set_name) AS set_size FROM gene_sets JOIN pos USING (gene)),
allowed AS (SELECT DISTINCT set_name, set_size, gene_count FROM hits WHERE set_size BETWEEN 15 AND 500),
walk AS (SELECT a.set_name, a.set_size, p.position, p.gene, h.gene IS NOT NULL AS hit,
  CASE WHEN h.gene IS NOT NULL THEN abs(p.metric) ELSE 0 END AS w FROM allowed a CROSS JOIN pos p LEFT JOIN hits h ON h.set_name = a.set_name AND h.gene = p.gene),
es AS (SELECT set_name, set_size, gene, position, hit, sum(w) OVER s / sum(w) OVER (PARTITION BY set_name)
  - sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER s / CAST(count(*) OVER (PARTITION BY set_name) - set_size AS DOUBLE) AS es FROM walk
  WINDOW s AS (PARTITION BY set_name ORDER BY position))"""


@query(
    "ranked_genes",
    "G8",
    """SELECT comparison_id, gene, protein_accession, metric FROM ranked WHERE gene <> '' AND comparison_id = 'D1_vs_DMSO'""",
    ("ranked",),
)
def _(t: Tables) -> DataFrame:
    return rounded(enrich.ranked_genes(t.view("diff"), "D1_vs_DMSO"), ["metric"], 9)


@query(
    "ranking_positions",
    "G8 F11",
    """SELECT comparison_id, gene, protein_accession, metric, row_number() OVER (PARTITION BY comparison_id ORDER BY metric DESC, protein_accession) - 1 AS position FROM ranked""",
    ("ranked",),
)
def _(t: Tables) -> DataFrame:
    placed = enrich.with_positions(t.view("ranked"), "protein_accession", ["comparison_id"])
    return placed.select("comparison_id", "gene", "protein_accession", "metric", "position")


@query(
    "cleaned_ranking",
    "G8 I12",
    """SELECT regexp_replace(trim(split_part(gene_name, ';', 1)), '-\\d+$', '') AS gene, round(-log10(p_value) * sign(log2_fold_change) + 0.0, 6) AS metric
FROM diff WHERE gene_name IS NOT NULL AND p_value > 0 AND p_value <= 1 AND log2_fold_change IS NOT NULL""",
    ("diff",),
)
def _(t: Tables) -> DataFrame:
    return rounded(enrich.clean_ranking(t.view("diff")), ["metric"])


@query(
    "enrichment_scores",
    "N1 F8",
    f"""WITH {SCORED} SELECT set_name AS "set", set_size, round(CASE WHEN greatest(max(es), 0) >= -least(min(es), 0) THEN greatest(max(es), 0) ELSE least(min(es), 0) END, 6) AS es
FROM es GROUP BY set_name, set_size""",
    ("ranking", "gene_sets"),
)
def _(t: Tables) -> DataFrame:
    return rounded(enrich.enrichment_score(ranking_frame(t), gene_sets(t)), ["es"])


@query(
    "leading_edges",
    "N3",
    f"""WITH {SCORED}, ends AS (SELECT set_name, max(es) AS hi, min(es) AS lo, arg_min(position, (-round(es, 12), position)) AS at_hi, arg_min(position, (round(es, 12), position)) AS at_lo FROM es GROUP BY 1)
SELECT e.set_name AS "set", gene, position FROM es e JOIN ends USING (set_name) WHERE hit AND
  ((greatest(hi, 0) >= -least(lo, 0) AND position <= at_hi) OR (greatest(hi, 0) < -least(lo, 0) AND position > at_lo))""",
    ("ranking", "gene_sets"),
)
def _(t: Tables) -> DataFrame:
    return enrich.leading_edge(ranking_frame(t), gene_sets(t))


CURVE = f"""{POSITIONED}, s AS (SELECT DISTINCT gene FROM gene_sets WHERE set_name = 'Brand#11'),
m AS (SELECT position, metric, p.gene, s.gene IS NOT NULL AS hit, gene_count, (SELECT count(*) FROM s) AS size FROM pos p LEFT JOIN s ON s.gene = p.gene),
c AS (SELECT position, sum(CASE WHEN hit THEN abs(metric) / (SELECT sum(abs(metric)) FROM m WHERE hit) ELSE -1.0 / (gene_count - size) END) OVER (ORDER BY position) AS es FROM m),
pk AS (SELECT arg_max(es, (round(abs(es), 12), -position)) AS pk FROM c)"""


@query(
    "running_enrichment_curve",
    "F8 N5",
    f"WITH {CURVE} SELECT position, round(es * 1.7 / pk, 6) AS es FROM c, pk",
    ("ranking", "gene_sets"),
)
def _(t: Tables) -> DataFrame:
    ranked = cut_lineage(ranking_frame(t))
    curve = enrich.gsea_curve(ranked, gene_sets(t), "Brand#11", 1.7)["curve"]
    return rounded(curve, ["es"])


@query(
    "set_member_positions",
    "F11 N5",
    f"WITH {POSITIONED} SELECT gene, position, metric FROM pos WHERE upper(gene) IN (SELECT upper(gene) FROM gene_sets WHERE set_name = 'Brand#11')",
    ("ranking", "gene_sets"),
)
def _(t: Tables) -> DataFrame:
    genes = enrich.matching_set(gene_sets(t), "Brand#11").select("gene")
    return enrich.rank_positions(ranking_frame(t), genes)


# Scores from the members alone: a running score turns at members only.
ENDS = """CASE WHEN greatest(max(after), 0) >= -least(min(before), 0) THEN greatest(max(after), 0) ELSE least(min(before), 0) END"""


def member_walk(source: str, keys: str) -> str:
    """(keys, before, after) at each member of ``source``, which has place, w, set_size and gene_count."""
    return f"""SELECT {keys}, set_size, (upto - w) / total - missed AS before, upto / total - missed AS after FROM (
  SELECT {keys}, set_size, w, sum(w) OVER walk AS upto, CASE WHEN sum(w) OVER (PARTITION BY {keys}) > 0 THEN sum(w) OVER (PARTITION BY {keys}) ELSE 1 END AS total,
    (place - row_number() OVER walk + 1) / (gene_count - set_size)::DOUBLE AS missed FROM {source}
  WINDOW walk AS (PARTITION BY {keys} ORDER BY place))"""


NULLS = f"""{POSITIONED},
member AS (SELECT * FROM (SELECT set_name, gene, position, metric, gene_count, count(*) OVER (PARTITION BY set_name) AS set_size FROM gene_sets JOIN pos USING (gene))
  WHERE set_size BETWEEN 15 AND 500 AND set_size < gene_count),
real_member AS (SELECT set_name, set_size, gene_count, position AS place, abs(metric) AS w FROM member),
real_es AS (SELECT set_name, set_size, round({ENDS}, 9) AS es FROM ({member_walk('real_member', 'set_name')}) GROUP BY ALL),
draw AS (SELECT gene, p, row_number() OVER (PARTITION BY p ORDER BY md5('123:' || p || ':' || gene)) - 1 AS place
  FROM pos, generate_series(1, 1000) AS g(p)),
drawn_member AS (SELECT set_name, set_size, m.gene_count, p, place, abs(pos.metric) AS w FROM member m JOIN draw USING (gene) JOIN pos ON pos.position = draw.place),
null_es AS (SELECT set_name, p, round({ENDS}, 9) AS es FROM ({member_walk('drawn_member', 'set_name, p')}) GROUP BY set_name, p),
side AS (SELECT set_name, avg(es) FILTER (WHERE es >= 0) AS up, avg(-es) FILTER (WHERE es < 0) AS down FROM null_es GROUP BY set_name),
base AS (SELECT set_name, set_size, es, es >= 0 AS positive, round(es / CASE WHEN es >= 0 THEN up ELSE down END, 9) AS nes FROM real_es JOIN side USING (set_name)),
tail AS (SELECT b.set_name, count(*) FILTER (WHERE abs(n.es) >= abs(b.es)) / count(*) AS pval FROM base b JOIN null_es n
  ON n.set_name = b.set_name AND (n.es >= 0) = b.positive GROUP BY b.set_name),
scaled AS (SELECT es >= 0 AS positive, round(abs(es / CASE WHEN es >= 0 THEN up ELSE down END), 9) AS size FROM null_es JOIN side USING (set_name)),
shares AS (SELECT set_name, (SELECT count(*) FILTER (WHERE size >= abs(b.nes)) / count(*) FROM scaled s WHERE s.positive = b.positive) AS null_share,
  (SELECT count(*) FILTER (WHERE abs(o.nes) >= abs(b.nes)) / count(*) FROM base o WHERE o.positive = b.positive) AS seen_share FROM base b)"""


@query(
    "permutation_enrichment",
    "N2",
    f"""WITH {NULLS} SELECT set_name AS "set", set_size, round(es, 6) AS es, round(nes, 6) AS nes, round(coalesce(pval, 1), 6) AS pval,
  round(least(coalesce(null_share / seen_share, 1), 1), 6) AS fdr FROM base LEFT JOIN tail USING (set_name) LEFT JOIN shares USING (set_name)""",
    ("ranking", "gene_sets"),
)
def _(t: Tables) -> DataFrame:
    out = enrich.prerank(cut_lineage(ranking_frame(t)), gene_sets(t))
    return rounded(out, ["es", "nes", "pval", "fdr"])


ALL_POSITIONED = """pos AS (SELECT comparison_id, gene, metric, row_number() OVER (PARTITION BY comparison_id ORDER BY metric DESC, gene) - 1 AS position,
  count(*) OVER (PARTITION BY comparison_id) AS gene_count FROM rankings),
member AS (SELECT * FROM (SELECT comparison_id, set_name, gene, position AS place, abs(metric) AS w, gene_count,
  count(*) OVER (PARTITION BY comparison_id, set_name) AS set_size FROM gene_sets JOIN pos USING (gene))
  WHERE set_size BETWEEN 15 AND 500 AND set_size < gene_count)"""


def all_rankings(t: Tables) -> DataFrame:
    rows = t.view("rankings").select("comparison_id", "gene", "metric")
    return enrich.with_positions(rows, by=["comparison_id"])


@query(
    "enrichment_scores_by_comparison",
    "N1 F8",
    f"""WITH {ALL_POSITIONED} SELECT comparison_id, set_name AS "set", set_size, round({ENDS}, 6) AS es
FROM ({member_walk('member', 'comparison_id, set_name')}) GROUP BY ALL""",
    ("rankings", "gene_sets"),
)
def _(t: Tables) -> DataFrame:
    return rounded(enrich.enrichment_score(all_rankings(t), gene_sets(t), by=["comparison_id"]), ["es"])


EACH = "comparison_id, set_name"
ALL_NULLS = f"""{ALL_POSITIONED},
real_es AS (SELECT {EACH}, set_size, round({ENDS}, 9) AS es FROM ({member_walk('member', EACH)}) GROUP BY ALL),
drawn AS (SELECT comparison_id, gene, p, row_number() OVER (PARTITION BY comparison_id, p ORDER BY md5('123:' || p || ':' || gene)) - 1 AS place
  FROM pos, generate_series(1, 1000) AS g(p)),
drawn_member AS (SELECT m.comparison_id, set_name, set_size, m.gene_count, p, d.place, abs(pos.metric) AS w FROM member m
  JOIN drawn d ON d.comparison_id = m.comparison_id AND d.gene = m.gene JOIN pos ON pos.comparison_id = m.comparison_id AND pos.position = d.place),
null_es AS (SELECT {EACH}, p, round({ENDS}, 9) AS es FROM ({member_walk('drawn_member', EACH + ', p')}) GROUP BY {EACH}, p),
side AS (SELECT {EACH}, avg(es) FILTER (WHERE es >= 0) AS up, avg(-es) FILTER (WHERE es < 0) AS down FROM null_es GROUP BY {EACH}),
base AS (SELECT {EACH}, set_size, es, es >= 0 AS positive, round(es / CASE WHEN es >= 0 THEN up ELSE down END, 9) AS nes FROM real_es JOIN side USING ({EACH})),
tail AS (SELECT b.comparison_id, b.set_name, count(*) FILTER (WHERE abs(n.es) >= abs(b.es)) / count(*) AS pval FROM base b JOIN null_es n
  ON n.comparison_id = b.comparison_id AND n.set_name = b.set_name AND (n.es >= 0) = b.positive GROUP BY ALL),
scaled AS (SELECT comparison_id, es >= 0 AS positive, round(abs(es / CASE WHEN es >= 0 THEN up ELSE down END), 9) AS size FROM null_es JOIN side USING ({EACH})),
null_share AS (SELECT b.comparison_id, b.set_name, count(*) FILTER (WHERE size >= abs(b.nes)) / count(size) AS null_share
  FROM base b JOIN scaled s ON s.comparison_id = b.comparison_id AND s.positive = b.positive GROUP BY ALL),
seen_share AS (SELECT b.comparison_id, b.set_name, count(*) FILTER (WHERE abs(o.nes) >= abs(b.nes)) / count(o.nes) AS seen_share
  FROM base b JOIN base o ON o.comparison_id = b.comparison_id AND o.positive = b.positive GROUP BY ALL)"""


@query(
    "permutation_enrichment_by_comparison",
    "N2",
    f"""WITH {ALL_NULLS} SELECT comparison_id, set_name AS "set", set_size, round(es, 6) AS es, round(nes, 6) AS nes, round(coalesce(pval, 1), 6) AS pval,
  round(least(coalesce(null_share / seen_share, 1), 1), 6) AS fdr
FROM base LEFT JOIN tail USING ({EACH}) LEFT JOIN null_share USING ({EACH}) LEFT JOIN seen_share USING ({EACH})""",
    ("rankings", "gene_sets"),
)
def _(t: Tables) -> DataFrame:
    out = enrich.prerank(cut_lineage(all_rankings(t)), gene_sets(t), by=["comparison_id"])
    return rounded(out, ["es", "nes", "pval", "fdr"])


HIT = "abs(nes) >= 1 AND fdr < 0.25"


@query(
    "enrichment_summary",
    "N4",
    f"""SELECT count(*) AS total_pathways, count(*) FILTER (WHERE {HIT}) AS significant_pathways, count(*) FILTER (WHERE {HIT} AND nes > 0) AS overrepresented,
  count(*) FILTER (WHERE {HIT} AND NOT nes > 0) AS underrepresented FROM terms""",
    ("terms",),
)
def _(t: Tables) -> DataFrame:
    return enrich.gsea_summary(t.view("terms"))


@query(
    "term_page",
    "G7",
    """SELECT term AS "set", nes, pval, fdr, matched_genes FROM terms WHERE contains(lower(term), 'brand#1') ORDER BY nes DESC NULLS LAST, term LIMIT 10 OFFSET 10""",
    ("terms",),
)
def _(t: Tables) -> DataFrame:
    rows = t.view("terms").withColumnRenamed("term", "set")
    return enrich.list_terms(rows, search="BRAND#1", page=2, size=10)


@query(
    "term_page_after",
    "G7",
    """SELECT term AS "set", nes, pval, fdr, matched_genes FROM terms ORDER BY matched_genes NULLS LAST, term LIMIT 30 OFFSET 60""",
    ("terms",),
)
def _(t: Tables) -> DataFrame:
    """The third page of thirty, each page behind the last row of the one before."""
    rows, order = t.view("terms").withColumnRenamed("term", "set"), {"sort_by": "matched_genes", "order": "asc", "size": 30}
    after = None
    for _ in range(2):
        last = enrich.list_terms(rows, after=after, **order).collect()[-1]
        after = enrich.Cursor(last["matched_genes"], last["set"])
    return enrich.list_terms(rows, after=after, **order)


@query(
    "top_terms",
    "G6",
    """SELECT * FROM (SELECT term AS "set", nes, 'top' AS side FROM terms ORDER BY nes DESC, term LIMIT 5)
UNION ALL SELECT * FROM (SELECT term, nes, 'bottom' FROM terms ORDER BY nes, term LIMIT 5)""",
    ("terms",),
)
def _(t: Tables) -> DataFrame:
    return enrich.top_terms(t.view("terms").select(F.col("term").alias("set"), "nes"))


@query(
    "strongest_terms",
    "G6 I17",
    """SELECT term AS "set", nes, round(-log10(pval), 6) AS log_p, round(-log10(fdr), 6) AS log_fdr FROM terms ORDER BY abs(nes) DESC, term LIMIT 20""",
    ("terms",),
)
def _(t: Tables) -> DataFrame:
    return rounded(enrich.strongest_terms(t.view("terms").withColumnRenamed("term", "set")), ["log_p", "log_fdr"])


# ----------------------------------------------------------------------- networks

SEEDS = """seeds AS (SELECT protein_accession AS id, min(adjusted_p_value) AS pvalue,
  arg_min(log2_fold_change, (adjusted_p_value, log2_fold_change)) AS fc FROM diff WHERE adjusted_p_value < 0.2 AND abs(log2_fold_change) > 0.5 GROUP BY 1)"""
KEPT = """kept AS (SELECT * FROM edges WHERE paper_count >= 1 AND evidence_count >= 2 AND interaction IN ('Activation', 'Inhibition, Complex') AND abs(correlation) >= 0.2
  AND source IN (SELECT id FROM seeds) AND target IN (SELECT id FROM seeds))"""
EDGE_OPTIONS = {"types": ["Activation", "Inhibition, Complex"], "min_evidence": 2, "min_correlation": 0.2}


def network_frames(t: Tables) -> tuple[DataFrame, DataFrame]:
    return network.subnetwork(t.view("diff"), t.view("edges"), 0.2, 0.5, None, **EDGE_OPTIONS)


@query(
    "subnetwork_edges",
    "N8 D18",
    f"WITH {SEEDS}, {KEPT} SELECT * FROM kept",
    ("diff", "edges"),
)
def _(t: Tables) -> DataFrame:
    return network_frames(t)[1]


@query(
    "subnetwork_nodes",
    "N8 N9 I16",
    f"""WITH {SEEDS}, {KEPT} SELECT id, round(fc, 9) AS "logFC", pvalue, pvalue < 0.05 AND abs(fc) > 1 AS significant,
  CASE WHEN pvalue < 0.05 AND abs(fc) > 1 THEN fc > 0 END AS upregulated, id IN ('P1', 'P500', 'P77') AS is_key_target FROM seeds
WHERE id IN (SELECT source FROM kept UNION SELECT target FROM kept)""",
    ("diff", "edges"),
)
def _(t: Tables) -> DataFrame:
    flags = network.node_flags(network_frames(t)[0], 0.05, 1.0, ["P1", "P500", "P77"])
    return rounded(flags.drop("name", "label"), ["logFC"], 9)


@query(
    "edge_types",
    "I15 N9",
    "SELECT DISTINCT trim(unnest(string_split(interaction, ','))) AS type FROM edges",
    ("edges",),
)
def _(t: Tables) -> DataFrame:
    return network.edge_types(t.view("edges"))
