"""Shared-peptide resolution, coverage rules and protein-level counts."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from omicspark.functions import expressions as E
from omicspark.functions.ranking import same_keys
from omicspark.operators.psm import explode_accessions

PSM = "Unique_PSM"
GROUP = "Master_Protein_Accessions"


def psm_candidates(df: DataFrame) -> DataFrame:
    """(PSM, protein, order) of each PSM's group text; the smallest text where files differ."""
    groups = df.groupBy(PSM).agg(F.min(GROUP).alias(GROUP))
    return explode_accessions(groups, PSM, GROUP)


def protein_support(df: DataFrame) -> DataFrame:
    """Distinct PSMs per candidate protein."""
    pairs = psm_candidates(df).select(PSM, "protein").distinct()
    return pairs.groupBy("protein").agg(F.count(F.col(PSM)).alias("psm_count"))


def best_protein(df: DataFrame) -> DataFrame:
    """Per PSM the candidate with most distinct PSMs, the earlier one on a tie."""
    candidates = psm_candidates(df)
    support = (
        candidates.select(PSM, "protein").distinct()
        .groupBy("protein").agg(F.count(F.col(PSM)).alias("psm_count"))
    )
    # An ordered aggregate merges map-side; no PSM's candidates are gathered to be sorted.
    return (
        candidates.join(support, "protein")
        .groupBy(PSM)
        .agg(F.max_by("protein", F.struct("psm_count", -F.col("protein_order"))).alias("protein"))
    )


def resolve_shared(df: DataFrame, enabled: bool = True) -> DataFrame:
    """Replace each group text by the PSM's best protein; unchanged where there is none."""
    if not enabled:
        return df
    best = best_protein(df).withColumnRenamed("protein", "__best")
    joined = df.join(best, PSM, "left")
    return joined.withColumn(GROUP, F.coalesce("__best", GROUP)).select(*df.columns)


def detected_replicates(df: DataFrame) -> DataFrame:
    """Distinct replicates with an abundance per PSM and condition."""
    return (
        df.where(F.col("Abundance").isNotNull())
        .groupBy(PSM, "Condition")
        .agg(F.countDistinct("Replicate").alias("detected_reps"))
    )


def allowed_missing(total: str, fraction: float):
    """floor(total x fraction) with the fraction as an exact decimal."""
    return F.floor(F.col(total).cast("int") * F.lit(Decimal(str(fraction)))).cast("bigint")


def passing_psms(df: DataFrame, design: DataFrame, max_missing: float) -> DataFrame:
    """PSMs that meet the bound in every designed condition.

    Counting the conditions that meet it replaces the PSM x condition grid: a
    condition without a detection can only pass when nothing is required.
    """
    if not 0 <= max_missing <= 1:
        raise ValueError("max_missing must be between 0 and 1")
    if max_missing == 1:
        return df.select(PSM).where(F.col(PSM).isNotNull()).distinct()
    needed = design.select(
        "Condition", (F.col("total_reps") - allowed_missing("total_reps", max_missing)).alias("needed")
    ).where(F.col("needed") > 0)
    needed = needed.withColumn("must", F.count(F.lit(1)).over(Window.partitionBy()))
    met = detected_replicates(df).join(needed, "Condition").where(
        F.col("detected_reps") >= F.col("needed")
    )
    return (
        met.groupBy(PSM)
        .agg(F.count(F.lit(1)).alias("met"), F.max("must").alias("must"))
        .where(F.col("met") == F.col("must"))
        .select(PSM)
    )


def coverage_filter(
    df: DataFrame,
    design: DataFrame | Mapping[str, int] | None = None,
    max_missing: float = 0.40,
    min_psms: int = 1,
) -> DataFrame:
    """Rows of PSMs covered in every condition and of proteins with enough such PSMs.

    ``design`` is (Condition, total_reps); without it the observed replicates
    of ``df`` stand in.
    """
    if not 1 <= min_psms <= 10:
        raise ValueError("min_psms must be between 1 and 10")
    if design is None:
        design = df.groupBy("Condition").agg(F.countDistinct("Replicate").alias("total_reps"))
    elif not isinstance(design, DataFrame):
        if any(int(n) < 1 for n in design.values()):
            raise ValueError("expected replicate counts must be at least 1")
        design = df.sparkSession.createDataFrame(
            [(str(c), int(n)) for c, n in design.items()], "Condition string, total_reps int"
        )
    covered = df.join(passing_psms(df, design, max_missing), PSM, "left_semi")
    if min_psms == 1:
        # Every protein that still has a row has one PSM; only a null group can fail.
        return covered.where(F.col(GROUP).isNotNull())
    proteins = (
        covered.groupBy(GROUP)
        .agg(F.countDistinct(PSM).alias("n"))
        .where((F.col("n") >= min_psms) & F.col(GROUP).isNotNull())
        .select(GROUP)
    )
    return covered.join(proteins, GROUP, "left_semi").select(*df.columns)


def psm_count_per_protein(df: DataFrame) -> DataFrame:
    return df.groupBy(GROUP).agg(F.countDistinct(PSM).alias("PSM_Count"))


def gene_labels(
    proteins: DataFrame,
    gene_map: DataFrame,
    accession: str = GROUP,
    unique: bool = True,
    out: str = "Gene_Name",
) -> DataFrame:
    """Gene label of each protein group: mapped genes in list order joined by ';'.

    Isoform endings are dropped before the lookup; a group without any mapped
    member keeps its own text without the ending.
    """
    groups = proteins.select(accession).distinct()
    members = groups.select(accession, F.posexplode(F.split(F.col(accession), ";")).alias("o", "m"))
    members = members.withColumn("base", E.strip_isoform(F.trim("m")))
    mapped = members.join(gene_map.select(F.col("accession").alias("base"), "gene"), "base")
    mapped = mapped.where(F.coalesce(F.col("gene"), F.lit("")) != "")
    # A list here is one group's own members, as long as its text.
    ordered = mapped.groupBy(accession).agg(F.array_sort(F.collect_list(F.struct("o", "gene"))).alias("g"))
    names = F.transform("g", lambda x: x["gene"])
    names = F.array_distinct(names) if unique else names
    labels = ordered.select(accession, F.array_join(names, ";").alias("__label"))
    return proteins.join(labels, accession, "left").withColumn(
        out, F.coalesce("__label", E.strip_isoform(F.col(accession)))
    ).drop("__label")


def dedupe(df: DataFrame, keys: list[str], order: list, keep: str = "first") -> DataFrame:
    """One row per key by an explicit order; an aggregate, so hot keys merge map-side."""
    if keep not in {"first", "last"}:
        raise ValueError("keep is 'first' or 'last'")
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    packed = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("__r"))
    return packed.select(*keys, *[F.col("__r")[c].alias(c) for c in rest]).select(*df.columns)


def top_features(
    df: DataFrame, n: int = 3, protein: str = GROUP, feature: str = PSM, value: str = "log2_abundance"
) -> DataFrame:
    """Rows of the n features of each protein with the highest mean log abundance."""
    means = df.groupBy(protein, feature).agg(F.avg(value).alias("__mean"))
    # row_number <= n is cut down on the map side before the shuffle.
    order = Window.partitionBy(protein).orderBy(F.col("__mean").desc_nulls_last(), F.col(feature))
    best = means.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= n)
    return same_keys(df, best.select(protein, feature), [protein, feature])
