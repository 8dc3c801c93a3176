"""Canonical long tables: abundances, catalogs and differential results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omicspark.functions.expressions import column, finite

PROTEIN_COLUMNS = [
    "protein_accession", "gene_name", "sample_id", "condition", "replicate", "batch",
    "processed_log2_abundance", "provenance", "observed_feature_count", "imputed_feature_count",
    "imputation_fraction", "pipeline", "result_layer", "sample_order", "condition_order",
]
PEPTIDE_COLUMNS = [
    "protein_accession", "gene_name", "peptide_id", "sample_id", "condition", "replicate", "batch",
    "processed_log2_abundance", "provenance", "pipeline", "result_layer", "sample_order",
    "condition_order",
]
DIFFERENTIAL_COLUMNS = [
    "comparison_id", "protein_accession", "gene_name", "log2_fold_change", "p_value",
    "adjusted_p_value", "standard_error", "statistic", "psm_count", "result_layer", "pipeline",
]
# Accepted names of each result column, in order of preference.
RESULT_ALIASES: dict[str, Sequence[str]] = {
    "protein_accession": ("Master_Protein_Accessions", "ProteinAccession", "Protein", "protein_accession"),
    "gene_name": ("Gene_Name", "GeneName", "Gene", "gene_name"),
    "log2_fold_change": ("logFC", "log2FC", "log2_fold_change"),
    "p_value": ("pval", "pvalue", "p_value"),
    "adjusted_p_value": ("adjPval", "adj.pvalue", "adj_pvalue", "adjusted_p_value"),
    "standard_error": ("se", "SE", "standard_error"),
    "statistic": ("t", "statistic", "Tvalue"),
    "comparison_id": ("Comparison", "Label", "comparison_id"),
    "psm_count": ("PSM_Count", "psm_count", "PSM Count"),
}
MEASURES = ("log2_fold_change", "p_value", "adjusted_p_value", "standard_error", "statistic")


def abundance_to_long(df: DataFrame, ids: Sequence[str], samples: Sequence[str] | None = None) -> DataFrame:
    """Wide protein table to one row per (protein, sample); empty cells stay, as 'missing'."""
    samples = list(samples) if samples else [c for c in df.columns if c not in ids]
    typed = df.select(
        *[column(c) for c in ids],
        *[finite(column(c).cast("string").try_cast("double")).alias(c) for c in samples],
    )
    long = typed.unpivot(
        [column(c) for c in ids], [column(c) for c in samples], "sample_id", "processed_log2_abundance"
    )
    return long.withColumn(
        "provenance",
        F.when(F.col("processed_log2_abundance").isNull(), "missing").otherwise("model_estimated"),
    )


def to_wide(
    df: DataFrame, rows: Sequence[str], columns: str, value: str, names: Sequence[str], agg: str = "sum"
) -> DataFrame:
    """Long to wide for export; the column names are given, so no extra scan finds them.

    'sum' turns 0 into null; rows without any value are dropped.
    """
    pick = {"sum": F.sum, "mean": F.avg}[agg]
    wide = df.groupBy(*rows).pivot(columns, list(names)).agg(pick(value))
    if agg == "sum":
        wide = wide.select(*rows, *[F.when(column(n) != 0, column(n)).alias(n) for n in names])
    return wide.where(F.coalesce(*[column(n) for n in names]).isNotNull())


def with_catalog(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Peptide rows with condition, batch and order of their sample; unknown samples stay."""
    known = catalog.select(
        "sample_id",
        F.col("condition").alias("__c"),
        F.col("replicate").alias("__r"),
        F.col("batch").alias("__b"),
        "sample_order",
        "condition_order",
    )
    joined = df.drop("condition", "batch", "sample_order", "condition_order").join(known, "sample_id", "left")
    own = F.col("replicate").cast("string") if "replicate" in df.columns else F.lit(None).cast("string")
    return (
        joined.withColumn("replicate", F.coalesce(own, "__r"))
        .withColumnRenamed("__c", "condition")
        .withColumnRenamed("__b", "batch")
        .drop("__r")
    )


def feature_provenance(peptides: DataFrame) -> DataFrame:
    """Observed and imputed feature counts per protein, sample and layer."""
    counted = peptides.groupBy("protein_accession", "sample_id", "result_layer").agg(
        F.count_if(F.col("provenance") == "observed").alias("observed_feature_count"),
        F.count_if(F.col("provenance") == "imputed").alias("imputed_feature_count"),
    )
    total = F.col("observed_feature_count") + F.col("imputed_feature_count")
    return counted.withColumn(
        "imputation_fraction", F.when(total > 0, F.col("imputed_feature_count") / total)
    )


def annotate_provenance(proteins: DataFrame, peptides: DataFrame) -> DataFrame:
    """Feature counts attached to protein rows; provenance of the value itself is unchanged."""
    counts = feature_provenance(peptides)
    base = proteins.drop("observed_feature_count", "imputed_feature_count", "imputation_fraction")
    joined = base.join(counts, ["protein_accession", "sample_id", "result_layer"], "left")
    zero = F.lit(0).cast("bigint")
    return joined.withColumn(
        "observed_feature_count", F.coalesce("observed_feature_count", zero)
    ).withColumn("imputed_feature_count", F.coalesce("imputed_feature_count", zero))


def sample_catalog(samples: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """Catalog row per sample with sample and condition order.

    ``samples`` has sample_id, condition, replicate, batch and sample_order;
    conditions are ordered by ``orders`` (condition, condition_order), the rest
    after them by their first sample.
    """
    first = samples.groupBy("condition").agg(F.min("sample_order").alias("first"))
    if orders is None:
        ranked = first.withColumn("known", F.lit(None).cast("int"))
    else:
        ranked = first.join(
            orders.select("condition", F.col("condition_order").cast("int").alias("known")), "condition", "left"
        )
    # One row per condition: ranking them all together is small.
    from pyspark.sql import Window

    order = Window.orderBy(F.col("known").asc_nulls_last(), "first")
    ranked = ranked.select("condition", (F.row_number().over(order) - 1).alias("condition_order"))
    return samples.join(ranked, "condition").select(
        "sample_id", "condition", "replicate", "batch", "sample_order", "condition_order"
    )


def protein_abundance(long: DataFrame, catalog: DataFrame, pipeline: str, layer: str = "protein") -> DataFrame:
    """Rows of a processed protein layer in the canonical columns."""
    gene = F.col("gene_name") if "gene_name" in long.columns else F.lit(None).cast("string")
    joined = long.select(
        "protein_accession", gene.alias("gene_name"), "sample_id", "processed_log2_abundance", "provenance"
    ).join(catalog, "sample_id")
    return joined.select(
        "protein_accession", "gene_name", "sample_id", "condition", "replicate", "batch",
        "processed_log2_abundance", "provenance",
        F.lit(0).cast("bigint").alias("observed_feature_count"),
        F.lit(0).cast("bigint").alias("imputed_feature_count"),
        F.lit(None).cast("double").alias("imputation_fraction"),
        F.lit(pipeline).alias("pipeline"),
        F.lit(layer).alias("result_layer"),
        "sample_order", "condition_order",
    )


def summarized_abundance(layers: Mapping[str, DataFrame], pipeline: str, metadata: DataFrame | None = None) -> DataFrame:
    """Summarised layers (Protein, BioReplicate, Condition, Abundance) stacked and cataloged."""
    stacked = None
    for layer, frame in layers.items():
        part = frame.select(
            F.col("Protein").alias("protein_accession"),
            F.col("BioReplicate").cast("string").alias("sample_id"),
            F.col("Condition").alias("condition"),
            F.col("Abundance").cast("double").alias("processed_log2_abundance"),
            F.lit(layer).alias("result_layer"),
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    if stacked is None:
        raise ValueError("no summarised layer")
    stacked = stacked.withColumn("replicate", F.element_at(F.split("sample_id", "_"), -1))
    samples = stacked.groupBy("sample_id", "condition", "replicate").agg(F.lit(None).cast("string").alias("batch"))
    from pyspark.sql import Window

    # One row per sample of the design.
    samples = samples.withColumn(
        "sample_order", F.row_number().over(Window.orderBy("condition", "sample_id")) - 1
    )
    catalog = sample_catalog(samples)
    orders = catalog.select("sample_id", "sample_order", "condition_order")
    out = stacked.join(orders, "sample_id", "left").withColumn("provenance", F.lit("model_estimated"))
    if metadata is not None:
        genes = metadata.where(F.col("ProteinAccession").isNotNull()).groupBy(
            F.col("ProteinAccession").alias("protein_accession")
        ).agg(F.min("Gene").alias("gene_name"))
        out = out.join(genes, "protein_accession", "left")
    else:
        out = out.withColumn("gene_name", F.lit(None).cast("string"))
    out = out.withColumn("batch", F.lit(None).cast("string"))
    out = out.withColumn("observed_feature_count", F.lit(0).cast("bigint"))
    out = out.withColumn("imputed_feature_count", F.lit(0).cast("bigint"))
    out = out.withColumn("imputation_fraction", F.lit(None).cast("double"))
    return out.withColumn("pipeline", F.lit(pipeline)).select(*PROTEIN_COLUMNS)


def peptide_abundance(features: DataFrame, catalog: DataFrame, pipeline: str, layer: str) -> DataFrame:
    """Model features as peptide rows; a prediction or censoring makes a value imputed.

    ``features``: ProteinName, PeptideSequence, BioReplicate, Condition,
    log2Intensity, optionally predicted and censored.
    """
    predicted = F.col("predicted").cast("double") if "predicted" in features.columns else F.lit(None).cast("double")
    censored = F.coalesce(F.col("censored"), F.lit(False)) if "censored" in features.columns else F.lit(False)
    parts = F.split(F.col("PeptideSequence").cast("string"), r"\|", 2)
    rows = features.select(
        F.col("ProteinName").cast("string").alias("protein_accession"),
        F.lit(None).cast("string").alias("gene_name"),
        F.element_at(parts, -1).alias("peptide_id"),
        F.col("BioReplicate").cast("string").alias("sample_id"),
        F.col("Condition").cast("string").alias("condition"),
        F.element_at(F.split(F.col("BioReplicate").cast("string"), "_"), -1).alias("replicate"),
        F.lit(None).cast("string").alias("batch"),
        F.coalesce(predicted, F.col("log2Intensity").cast("double")).alias("processed_log2_abundance"),
        F.when(predicted.isNotNull() | censored, "imputed").otherwise("observed").alias("provenance"),
        F.lit(pipeline).alias("pipeline"),
        F.lit(layer).alias("result_layer"),
    )
    orders = catalog.select("sample_id", "sample_order", "condition_order")
    return rows.join(orders, "sample_id", "left").select(*PEPTIDE_COLUMNS)


def union_layers(*frames: DataFrame) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    return whole


def canonical_results(df: DataFrame, layer: str, pipeline: str, comparison: str = "comparison") -> DataFrame:
    """A result table under any accepted column names, in the canonical ones."""
    def source(name: str) -> str | None:
        return next((a for a in RESULT_ALIASES[name] if a in df.columns), None)

    if source("protein_accession") is None or source("log2_fold_change") is None:
        raise ValueError(f"no accession or fold change in {df.columns}")
    picked = []
    for name in DIFFERENTIAL_COLUMNS:
        if name == "result_layer":
            picked.append(F.lit(layer).alias(name))
        elif name == "pipeline":
            picked.append(F.lit(pipeline).alias(name))
        else:
            found = source(name)
            text = column(found).cast("string") if found else F.lit(None).cast("string")
            if name in MEASURES:
                picked.append(finite(text.try_cast("double")).alias(name))
            elif name == "psm_count":
                picked.append(text.try_cast("bigint").alias(name))
            elif name == "comparison_id" and not found:
                picked.append(F.lit(comparison).alias(name))
            else:
                picked.append(text.alias(name))
    return df.select(*picked)


def fill_annotations(
    results: DataFrame, psms: DataFrame | None = None, metadata: DataFrame | None = None
) -> DataFrame:
    """psm_count and gene_name filled where they are null."""
    out = results
    if psms is not None:
        counts = psms.groupBy(F.col("ProteinName").alias("protein_accession")).agg(
            F.countDistinct("PSM").alias("__n")
        )
        out = out.join(counts, "protein_accession", "left")
        out = out.withColumn("psm_count", F.coalesce("psm_count", "__n")).drop("__n")
    if metadata is not None:
        genes = metadata.groupBy(F.col("ProteinAccession").alias("protein_accession")).agg(
            F.min("Gene").alias("__g")
        )
        out = out.join(genes, "protein_accession", "left")
        out = out.withColumn("gene_name", F.coalesce("gene_name", "__g")).drop("__g")
    return out.select(*results.columns)


def comparison_catalog(
    differential: DataFrame, configured: DataFrame, samples: DataFrame, p_cut: float = 0.05
) -> DataFrame:
    """Configured comparisons with tested and significant counts and samples per side."""
    produced = differential.where(F.col("result_layer") == "protein").groupBy("comparison_id").agg(
        F.count(F.lit(1)).alias("tested_count"),
        F.count_if(F.col("adjusted_p_value") < p_cut).alias("significant_count"),
    )
    sizes = samples.groupBy("condition").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    out = configured.join(produced, "comparison_id", "left")
    out = out.withColumn("tested_count", F.coalesce("tested_count", zero))
    out = out.withColumn("significant_count", F.coalesce("significant_count", zero))
    out = out.withColumn("result_status", F.when(F.col("tested_count") > 0, "complete").otherwise("missing"))
    for side in ("group1", "group2"):
        side_sizes = sizes.select(
            F.col("condition").alias(f"{side}_label"), F.col("n").alias(f"{side}_sample_count")
        )
        out = out.join(side_sizes, f"{side}_label", "left")
        out = out.withColumn(f"{side}_sample_count", F.coalesce(f"{side}_sample_count", zero))
    return out
