"""Interaction subnetworks over a table of edges the user provides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SeedCount(ValueError):
    """No protein, or too many of them, pass the cut-offs."""


def seeds(differential: DataFrame, p_cut: float = 0.05, fold_cut: float = 0.5) -> DataFrame:
    """Proteins beyond both cut-offs, one row each (the smallest adjusted p)."""
    rows = differential.where(
        (F.abs("log2_fold_change") > fold_cut) & (F.col("adjusted_p_value") < p_cut)
    )
    pick = F.struct("adjusted_p_value", "log2_fold_change")
    return rows.groupBy(F.col("protein_accession").alias("id")).agg(
        F.min_by("gene_name", pick).alias("name"),
        F.min_by("log2_fold_change", pick).alias("logFC"),
        F.min("adjusted_p_value").alias("pvalue"),
    )


def filter_edges(
    edges: DataFrame,
    types: Sequence[str] | None = None,
    min_papers: int = 1,
    min_evidence: int = 1,
    min_correlation: float | None = None,
    sources: Sequence[str] | None = None,
) -> DataFrame:
    """Edges (source, target, interaction, evidence_count, paper_count[, correlation, sources])."""
    keep = (F.col("paper_count") >= min_papers) & (F.col("evidence_count") >= min_evidence)
    if types:
        keep = keep & F.col("interaction").isin(list(types))
    if min_correlation is not None:
        keep = keep & (F.abs("correlation") >= min_correlation)
    if sources:
        keep = keep & F.arrays_overlap(F.col("sources"), F.array(*[F.lit(s) for s in sources]))
    return edges.where(keep)


def subnetwork(
    differential: DataFrame,
    edges: DataFrame,
    p_cut: float = 0.05,
    fold_cut: float = 0.5,
    max_seeds: int | None = None,
    **edge_options,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): edges between seed proteins and the seeds that have one.

    ``max_seeds`` refuses as many seeds or more; by default all are taken.
    """
    chosen = seeds(differential, p_cut, fold_cut)
    if chosen.isEmpty():
        raise SeedCount("no proteins pass the cut-offs")
    if max_seeds is not None and chosen.limit(max_seeds).count() >= max_seeds:
        raise SeedCount(f"{max_seeds} or more proteins pass; tighten a cut-off")
    kept = filter_edges(edges, **edge_options)
    kept = kept.join(chosen.select(F.col("id").alias("source")), "source", "left_semi")
    kept = kept.join(chosen.select(F.col("id").alias("target")), "target", "left_semi")
    touched = kept.select(F.col("source").alias("id")).unionByName(kept.select(F.col("target").alias("id")))
    nodes = chosen.join(touched.distinct(), "id", "left_semi")
    return nodes, kept


def edge_types(edges: DataFrame) -> DataFrame:
    """Distinct single interaction types."""
    single = edges.select(F.explode(F.split("interaction", ",")).alias("type"))
    return single.select(F.trim("type").alias("type")).distinct()


def node_flags(
    nodes: DataFrame, p_cut: float = 0.05, fold_cut: float = 0.5, key_targets: Sequence[str] = ()
) -> DataFrame:
    """Display flags: significant, direction (null if not significant), key target."""
    hit = (F.col("pvalue") < p_cut) & (F.abs("logFC") > fold_cut)
    targets = list(key_targets)
    key = F.lit(False)
    if targets:
        key = F.coalesce(F.col("name").isin(targets), F.lit(False)) | F.col("id").isin(targets)
    label = F.when(F.coalesce(F.col("name"), F.lit("")) != "", F.col("name")).otherwise(F.col("id"))
    return nodes.select(
        "*",
        label.alias("label"),
        F.coalesce(hit, F.lit(False)).alias("significant"),
        F.when(hit, F.col("logFC") > 0).alias("upregulated"),
        key.alias("is_key_target"),
    )
