"""The split of labelled rows into a part to learn from and a part held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column, parts: int = 5) -> Column:
    """True where crc32 of the id as text leaves no remainder; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == 0, F.lit(False))


def training_labels(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(id, label 0 or 1) of the rows to learn from: not held out, with an id and a label of 0 or 1."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    return own.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
