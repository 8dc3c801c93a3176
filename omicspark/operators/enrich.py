"""Gene-set enrichment over a ranked list.

A running score only turns at the members of a set, so scores are computed
from the members' positions: rows per set and member, never per set and gene.
Every step takes ``by`` columns, such as the comparison, and handles all their
rankings in one job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from omicspark.functions import expressions as E
from omicspark.functions.ranking import finite, order_bin, positions, running_total, same_keys
from omicspark.operators.query import Cursor, page_of
from omicspark.session import cut_lineage

MIN_SIZE, MAX_SIZE = 15, 500
PERMUTATIONS, SEED = 1000, 123
#: Permutations that one task scores, and the decimals at which scores are compared.
PERMUTATIONS_PER_TASK, SCORE_DECIMALS = 100, 9
#: Members, of all its sets together, that one row of a ranking's sets holds on average.
MEMBERS_PER_TASK = 1 << 18
NES_CUT, FDR_CUT = 1.0, 0.25


def ranked_genes(differential: DataFrame, comparison: str | None = None, layer: str = "protein") -> DataFrame:
    """(comparison_id, gene, protein_accession, metric): signed -log10 p of each named protein."""
    rows = differential.where(F.col("result_layer") == layer)
    if comparison is not None:
        rows = rows.where(F.col("comparison_id") == comparison)
    rows = rows.where(
        (F.coalesce(F.col("gene_name"), F.lit("")) != "")
        & (F.col("p_value") > 0)
        & (F.col("p_value") <= 1)
        & F.col("log2_fold_change").isNotNull()
    )
    metric = -F.log10("p_value") * F.signum("log2_fold_change") + F.lit(0.0)
    return rows.select(
        "comparison_id", E.first_member(F.col("gene_name")).alias("gene"), "protein_accession", metric.alias("metric")
    ).where(F.col("gene") != "")


def one_metric_per_gene(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The strongest metric of each gene; ties go to the positive one."""
    order = F.struct(F.abs("metric"), F.col("metric"))
    return ranked.groupBy(*by, "gene").agg(F.max_by("metric", order).alias("metric"))


def with_positions(ranked: DataFrame, tie: str = "gene", by: Sequence[str] = ()) -> DataFrame:
    """0-based place in the descending ranking and the list length, per ``by`` group."""
    return positions(ranked, list(by), "metric", tie, out="position", descending=True, total="gene_count")


def set_members(ranked: DataFrame, sets: DataFrame, min_size: int = MIN_SIZE, max_size: int = MAX_SIZE,
                by: Sequence[str] = ()) -> DataFrame:
    """Positions of the members of each set whose size in the ranking is allowed."""
    hits = sets.select("set", "gene").distinct().join(ranked, "gene")
    sizes = hits.groupBy(*by, "set").agg(F.count(F.lit(1)).alias("set_size"))
    allowed = sizes.where(F.col("set_size").between(min_size, max_size))
    return same_keys(hits, allowed, [*by, "set"])


def _scores(hits: DataFrame, keys: Sequence[str], weight: float) -> DataFrame:
    """Score before and after each member; a set is no longer than its size limit.

    ``hits`` has the keys, position, metric, set_size and gene_count.
    """
    strength = F.pow(F.abs("metric"), F.lit(float(weight))) if weight else F.lit(1.0)
    hits = hits.withColumn("__w", strength)
    group = Window.partitionBy(*keys)
    upto = group.orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("__w").over(group)
    hits = hits.select(
        "*",
        F.when(total > 0, total).otherwise(1.0).alias("__total"),
        F.sum("__w").over(upto).alias("__sum"),
        F.row_number().over(group.orderBy("position")).alias("__k"),
    )
    missed = (F.col("position") - F.col("__k") + 1) / (F.col("gene_count") - F.col("set_size"))
    after = F.col("__sum") / F.col("__total") - missed
    before = (F.col("__sum") - F.col("__w")) / F.col("__total") - missed
    return hits.select(*keys, "gene", "position", "metric", "set_size", "gene_count",
                       before.alias("before"), after.alias("after"))


def _extreme(keys: Sequence[str], scored: DataFrame) -> DataFrame:
    ends = scored.groupBy(*keys).agg(
        F.max("after").alias("high"), F.min("before").alias("low"), F.max("set_size").alias("set_size")
    )
    high, low = F.greatest(F.col("high"), F.lit(0.0)), F.least(F.col("low"), F.lit(0.0))
    return ends.select(*keys, "set_size", F.when(high >= -low, high).otherwise(low).alias("es"))


def member_scores(ranked: DataFrame, sets: DataFrame, min_size: int = MIN_SIZE, max_size: int = MAX_SIZE,
                  weight: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Running score around every member of every allowed set; ``ranked`` has positions."""
    members = set_members(ranked, sets, min_size, max_size, by)
    members = members.where(F.col("set_size") < F.col("gene_count"))
    return _scores(members, [*by, "set"], weight)


def enrichment_score(ranked: DataFrame, sets: DataFrame, min_size: int = MIN_SIZE, max_size: int = MAX_SIZE,
                     weight: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """(by, set, set_size, es): the largest deviation of the running score."""
    return _extreme([*by, "set"], member_scores(ranked, sets, min_size, max_size, weight, by))


def leading_edge(ranked: DataFrame, sets: DataFrame, min_size: int = MIN_SIZE, max_size: int = MAX_SIZE,
                 weight: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """(by, set, gene, position) of the members up to the peak, or from the trough on."""
    keys = [*by, "set"]
    scored = member_scores(ranked, sets, min_size, max_size, weight, by)
    peak = scored.groupBy(*keys).agg(
        F.max("after").alias("high"), F.min("before").alias("low"),
        F.min_by("position", F.struct(-F.col("after"), F.col("position"))).alias("at_high"),
        F.min_by("position", F.struct(F.col("before"), F.col("position"))).alias("at_low"),
    )
    joined = same_keys(scored, peak, keys)
    up = F.greatest(F.col("high"), F.lit(0.0)) >= -F.least(F.col("low"), F.lit(0.0))
    keep = (up & (F.col("position") <= F.col("at_high"))) | (~up & (F.col("position") >= F.col("at_low")))
    return joined.where(keep).select(*keys, "gene", "position")


def drawn_positions(seed: int, permutation: int, genes: Sequence[str]) -> np.ndarray:
    """The place of each gene when genes are ordered by the md5 of 'seed:permutation:gene'."""
    head = f"{seed}:{permutation}:".encode()
    digests = b"".join(hashlib.md5(head + g.encode()).digest() for g in genes)
    halves = np.frombuffer(digests, dtype=">u8").reshape(-1, 2)
    places = np.empty(len(genes), dtype=np.int64)
    places[np.lexsort((halves[:, 1], halves[:, 0]))] = np.arange(len(genes))
    return places


def _block_scores(metrics: np.ndarray, members: np.ndarray, owner: np.ndarray, sizes: np.ndarray,
                  drawn: np.ndarray, weight: float) -> np.ndarray:
    """Scores of all sets under one labelling; ``members`` are genes, ``owner`` their sets in order."""
    places = drawn[members]
    order = np.lexsort((places, owner))
    places, sets = places[order], owner[order]
    gain = np.abs(metrics[places]) ** weight if weight else np.ones(len(places))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    total = np.add.reduceat(gain, starts)
    total[total <= 0] = 1.0
    share = gain / total[sets]
    running = np.cumsum(share)
    # Sums begin anew at each set.
    running -= (running[starts] - share[starts])[sets]
    missed = (places - (np.arange(len(places)) - starts[sets])) / (len(metrics) - sizes[sets])
    high = np.maximum(np.maximum.reduceat(running - missed, starts), 0)
    low = np.minimum(np.minimum.reduceat(running - share - missed, starts), 0)
    return np.where(high >= -low, high, low)


def null_scores(ranked: DataFrame, sets: DataFrame, permutations: int = PERMUTATIONS, seed: int = SEED,
                min_size: int = MIN_SIZE, max_size: int = MAX_SIZE, weight: float = 1.0,
                by: Sequence[str] = ()) -> DataFrame:
    """(by, set, permutation, es) under random gene labels.

    Every permutation orders the genes by a hash of seed, permutation and gene,
    so a lost task draws the same labels. The sets of a ranking are dealt into
    blocks of about ``MEMBERS_PER_TASK`` members by a hash of their names. A task
    gets a ranking, which is as long as a genome has genes, one block of sets and
    one block of permutations, and scores them at once.
    """
    keys = [*by] or ["__all"]
    whole = lambda df: df if by else df.withColumn("__all", F.lit(0))
    listed = whole(ranked).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("position", "gene", "metric"))).alias("r")
    )
    listed = listed.select(*keys, F.col("r.gene").alias("genes"), F.col("r.metric").alias("metrics"))
    members = whole(set_members(ranked, sets, min_size, max_size, by)).where(F.col("set_size") < F.col("gene_count"))
    grouped = members.groupBy(*keys, "set").agg(F.collect_list(F.col("position").cast("bigint")).alias("places"))
    held = grouped.groupBy(*keys).agg(F.ceil(F.sum(F.size("places")) / MEMBERS_PER_TASK).cast("int").alias("parts"))
    dealt = same_keys(grouped, held, keys).withColumn("part", F.pmod(F.xxhash64("set"), "parts").cast("int"))
    grouped = dealt.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("set", "places"))).alias("s"))
    grouped = grouped.select(*keys, "part", F.col("s.set").alias("names"), F.col("s.places").alias("places"))
    blocks = -(-permutations // PERMUTATIONS_PER_TASK)
    units = same_keys(listed, grouped, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        genes, names = list(row["genes"]), list(row["names"])
        metrics = np.asarray(row["metrics"], dtype=float)
        sizes = np.array([len(x) for x in row["places"]])
        found = np.concatenate([np.asarray(x, dtype=np.int64) for x in row["places"]])
        owner = np.repeat(np.arange(len(names)), sizes)
        first = int(row["block"]) * PERMUTATIONS_PER_TASK + 1
        parts = []
        for permutation in range(first, min(first + PERMUTATIONS_PER_TASK, permutations + 1)):
            drawn = drawn_positions(seed, permutation, genes)
            scores = _block_scores(metrics, found, owner, sizes, drawn, weight)
            parts.append(pd.DataFrame({"set": names, "permutation": permutation, "es": scores}))
        out = pd.concat(parts, ignore_index=True)
        for k in by:
            out[k] = row[k]
        return out[[*by, "set", "permutation", "es"]]

    kinds = "".join(f"`{k}` {ranked.schema[k].dataType.simpleString()}, " for k in by)
    return units.groupBy(*keys, "part", "block").applyInPandas(run, f"{kinds}set string, permutation int, es double")


def prerank(ranked: DataFrame, sets: DataFrame, permutations: int = PERMUTATIONS, seed: int = SEED,
            min_size: int = MIN_SIZE, max_size: int = MAX_SIZE, weight: float = 1.0,
            by: Sequence[str] = ()) -> DataFrame:
    """(by, set, set_size, es, nes, pval, fdr) against the permutation null.

    Scores are divided by the mean null of their sign. The false discovery
    rate compares, per sign, the share of null scores beyond an observed one
    with the share of observed scores beyond it. Scores are compared at nine
    decimals.
    """
    keys = [*by, "set"]
    rounded = lambda name: F.round(name, SCORE_DECIMALS)
    observed = enrichment_score(ranked, sets, min_size, max_size, weight, by).withColumn("es", rounded("es"))
    null = null_scores(ranked, sets, permutations, seed, min_size, max_size, weight, by)
    # The null is read four times below.
    null = cut_lineage(null.select(*keys, rounded("es").alias("null_es")))
    means = null.groupBy(*keys).agg(
        F.avg(F.when(F.col("null_es") >= 0, F.col("null_es"))).alias("up"),
        F.avg(F.when(F.col("null_es") < 0, -F.col("null_es"))).alias("down"),
    )
    base = same_keys(observed, means, keys, "left")
    side = F.when(F.col("es") >= 0, F.col("up")).otherwise(F.col("down"))
    base = cut_lineage(base.withColumn("nes", F.round(F.try_divide(F.col("es"), side), SCORE_DECIMALS)))
    tails = same_keys(null, base.select(*keys, "es"), keys)
    same_sign = (F.col("null_es") >= 0) == (F.col("es") >= 0)
    beyond = same_sign & (F.abs("null_es") >= F.abs("es"))
    pvals = tails.groupBy(*keys).agg(
        F.try_divide(F.count_if(beyond), F.count_if(same_sign)).alias("pval")
    )
    scaled = same_keys(null, means, keys)
    null_side = F.when(F.col("null_es") >= 0, F.col("up")).otherwise(F.col("down"))
    scaled = scaled.select(
        *by,
        (F.col("null_es") >= 0).alias("positive"),
        F.round(F.abs(F.try_divide(F.col("null_es"), null_side)), SCORE_DECIMALS).alias("size"),
    )
    seen = base.select(*keys, (F.col("es") >= 0).alias("positive"), F.abs("nes").alias("size"))
    null_share = tail_share(seen, scaled, "null_share", by)
    seen_share = tail_share(seen, seen.select(*by, "positive", "size"), "seen_share", by)
    out = same_keys(same_keys(base, pvals, keys, "left"), null_share, keys, "left")
    out = same_keys(out, seen_share, keys, "left")
    ratio = F.try_divide(F.col("null_share"), F.col("seen_share"))
    return out.select(
        *keys, "set_size", "es", "nes", F.coalesce("pval", F.lit(1.0)).alias("pval"),
        F.least(F.coalesce(ratio, F.lit(1.0)), F.lit(1.0)).alias("fdr"),
    )


def tail_share(points: DataFrame, population: DataFrame, out: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, set, share of the same-sign population whose size is at least the point's).

    Points and population are ordered together, so no point meets every member.
    """
    side = [*by, "positive"]
    both = points.select(*side, "size", F.lit(0).alias("__c")).unionByName(
        population.select(*side, "size", F.lit(1).alias("__c"))
    ).where(F.col("size").isNotNull())
    counts = both.groupBy(*side, "size").agg(F.sum("__c").alias("__c"))
    counts = counts.withColumn("__b", order_bin(F.col("size")))
    inside = Window.partitionBy(*side, "__b").orderBy(F.col("size").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    counts = counts.withColumn("__in", F.sum("__c").over(inside))
    group = Window.partitionBy(*side)
    above = group.orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bins = counts.groupBy(*side, "__b").agg(F.sum("__c").alias("__t")).select(
        *side, "__b",
        F.coalesce(F.sum("__t").over(above), F.lit(0)).alias("__before"),
        F.sum("__t").over(group).alias("__n"),
    )
    ranked = same_keys(counts, bins, [*side, "__b"])
    share = F.try_divide(F.col("__before") + F.col("__in"), F.col("__n"))
    ranked = ranked.select(*side, "size", share.alias(out))
    return same_keys(points, ranked, [*side, "size"]).select(*by, "set", out)


# ------------------------------------------------------------------------ reads


def significant_term() -> Column:
    return (F.abs("nes") >= NES_CUT) & (F.col("fdr") < FDR_CUT)


def gsea_summary(results: DataFrame) -> DataFrame:
    hit = significant_term()
    return results.agg(
        F.count(F.lit(1)).alias("total_pathways"),
        F.count_if(hit).alias("significant_pathways"),
        F.count_if(hit & (F.col("nes") > 0)).alias("overrepresented"),
        F.count_if(hit & ~(F.col("nes") > 0)).alias("underrepresented"),
    )


def list_terms(
    results: DataFrame, significant_only: bool = False, search: str = "", sort_by: str = "nes",
    order: str = "desc", page: int = 1, size: int = 50, after: Cursor | None = None,
) -> DataFrame:
    """A page of terms; nulls last both ways, ties by name. ``after`` is the last row of the page before."""
    rows = results.where(significant_term()) if significant_only else results
    if search:
        rows = rows.where(E.contains_text([F.col("set")], search))
    key = sort_by if sort_by in {"nes", "pval", "fdr", "matched_genes"} else "nes"
    return page_of(rows, key, order.lower() == "desc", "set", page, size, after)


def top_terms(results: DataFrame, n: int = 5) -> DataFrame:
    """The n highest and the n lowest normalised scores."""
    top = results.orderBy(F.col("nes").desc(), "set").limit(n).withColumn("side", F.lit("top"))
    low = results.orderBy("nes", "set").limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


def strongest_terms(results: DataFrame, n: int = 20) -> DataFrame:
    """The n scores of largest size, with their log10 p and q."""
    rows = results.orderBy(F.abs("nes").desc(), "set").limit(n)
    return rows.select(
        "set", "nes",
        E.negative_log10(F.coalesce(F.col("pval"), F.lit(E.SMALLEST_P))).alias("log_p"),
        E.negative_log10(F.coalesce(F.col("fdr"), F.lit(E.SMALLEST_P))).alias("log_fdr"),
    )


def matching_set(sets: DataFrame, term: str) -> DataFrame:
    """Genes of the set named ``term``, else of the first one that extends or begins it."""
    names = sets.select("set").distinct()
    best = names.where(F.startswith(F.col("set"), F.lit(term)) | F.startswith(F.lit(term), F.col("set")))
    best = best.agg(F.min_by("set", F.struct(F.col("set") != term, F.col("set"))).alias("set"))
    return sets.join(best, "set", "left_semi")


def running_es(
    ranked: DataFrame, genes: DataFrame, nes: float | None = None, weighted: bool = True
) -> DataFrame:
    """(position, es) of the whole ranking for one set; scaled so the peak is |nes|.

    Steps are summed in blocks of positions, so the list may be of any length.
    ``genes`` is the full set; its size counts even where genes are not ranked.
    """
    size = genes.select("gene").distinct().count()
    total = ranked.agg(F.max("gene_count")).first()[0] or 0
    schema = "position bigint, es double"
    if size == 0 or size >= total:
        return ranked.sparkSession.createDataFrame([], schema)
    marked = ranked.join(genes.select("gene").distinct().withColumn("__hit", F.lit(True)), "gene", "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    if weighted:
        weight = marked.where(hit).agg(F.sum(F.abs("metric"))).first()[0] or 1.0
        gain = F.abs("metric") / F.lit(float(weight))
    else:
        gain = F.lit(1.0 / size)
    step = F.when(hit, gain).otherwise(F.lit(-1.0 / (total - size)))
    curve = running_total(marked, [], "position", step, "es").select("position", "es")
    if not nes:
        return curve
    # The peak is the first position of the largest size; at most one row.
    peak = curve.agg(F.max_by("es", F.struct(F.abs("es"), -F.col("position"))).alias("peak")).first()["peak"]
    if not peak:
        return curve
    factor = abs(nes) / abs(peak) * (1 if nes > 0 else -1) * (1 if peak >= 0 else -1)
    return curve.withColumn("es", F.col("es") * F.lit(factor))


def rank_positions(ranked: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, position, metric) of the set's members, by upper-case name."""
    wanted = genes.select(F.upper("gene").alias("__u")).distinct()
    return ranked.withColumn("__u", F.upper("gene")).join(wanted, "__u", "left_semi").select(
        "gene", "position", "metric"
    )


def gsea_curve(ranked: DataFrame, sets: DataFrame, term: str, nes: float | None = None) -> dict[str, DataFrame]:
    genes = matching_set(sets, term).select("gene")
    return {
        "curve": running_es(ranked, genes, nes),
        "positions": rank_positions(ranked, genes),
        "size": genes.distinct().agg(F.count(F.lit(1)).alias("pathway_gene_set_size")),
    }


def clean_ranking(df: DataFrame, gene: str = "gene_name", p: str = "p_value", fold: str = "log2_fold_change") -> DataFrame:
    """(gene, metric) for the enrichment run: first gene token without isoform ending."""
    name = E.first_gene(F.col(gene))
    rows = df.where(name.isNotNull() & finite(p).isNotNull() & finite(fold).isNotNull())
    rows = rows.where((F.col(p) > 0) & (F.col(p) <= 1))
    metric = -F.log10(p) * F.signum(fold) + F.lit(0.0)
    return rows.select(name.alias("gene"), metric.alias("metric"))
