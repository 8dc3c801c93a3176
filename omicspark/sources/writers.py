"""Table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_artifact(
    df: DataFrame,
    folder: str,
    name: str,
    order: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    compression: str = "zstd",
) -> str:
    """Parquet table; rows sorted inside files so that row-group statistics prune.

    ``order`` range-partitions the rows first, which spreads a hot key over
    several files.
    """
    path = f"{folder.rstrip('/')}/{name}.parquet"
    out = df
    if order:
        out = out.repartitionByRange(*[F.col(c) for c in order])
        out = out.sortWithinPartitions(*partition_by, *order)
    writer = out.write.mode("overwrite").option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def comparison_export(df: DataFrame, comparison: str, layer: str = "protein") -> DataFrame:
    """One comparison in the column names of the exchange format, by accession."""
    chosen = df.where((F.col("comparison_id") == comparison) & (F.col("result_layer") == layer))
    return chosen.select(
        F.col("protein_accession").alias("Master_Protein_Accessions"),
        F.col("gene_name").alias("Gene_Name"),
        F.col("log2_fold_change").alias("logFC"),
        F.col("p_value").alias("pval"),
        F.col("adjusted_p_value").alias("adjPval"),
        F.col("standard_error").alias("se"),
        F.col("statistic").alias("t"),
    ).orderBy("Master_Protein_Accessions")


def export_comparison_tsv(df: DataFrame, comparison: str, path: str, layer: str = "protein") -> str:
    export = comparison_export(df, comparison, layer)
    export.write.mode("overwrite").csv(path, sep="\t", header=True)
    return path
