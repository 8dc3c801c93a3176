"""A written correlation matrix with a pyramid of means: cells, rows and tiles are read from the blocks that hold them.

The upper triangle lies in squares of ``side`` positions, one Parquet folder per level and block pair. Level 0
holds the cells; level k holds, for each square of 2^k positions, what the means of the full symmetric matrix
need, added up from level k - 1. A read names its folders, so Spark lists and opens no others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from omicspark.functions.ranking import finite
from omicspark.session import fresh_path

SIDE = 256
_CELLS = "i int, j int, correlation double, support bigint, total double, cells bigint, level int, bi int, bj int"


@dataclass(frozen=True)
class CorrelationStore:
    """Where a matrix was written; ``levels`` counts the cells' level and those above it."""

    path: str
    side: int
    levels: int

    def index(self, spark: SparkSession) -> DataFrame:
        """(comparison, position)."""
        return spark.read.schema("comparison string, position int").parquet(f"{self.path}/index")

    def blocks(self, spark: SparkSession, level: int, inside: Column) -> DataFrame:
        """Rows of the blocks of one level for which ``inside``, a condition on bi and bj, holds."""
        cells = spark.read.schema(_CELLS).parquet(f"{self.path}/cells")
        return cells.where((F.col("level") == level) & inside)

    def _positions(self, spark: SparkSession, *names: str) -> list[int]:
        """Positions of ``names``; -1, which no block holds, for one that the store lacks."""
        rows = self.index(spark).where(F.col("comparison").isin(*names)).collect()
        found = {r["comparison"]: r["position"] for r in rows}
        return [found.get(name, -1) for name in names]

    def cell(self, spark: SparkSession, a: str, b: str) -> DataFrame:
        """One row (left, right, correlation, support, sufficient_support), left <= right; none where nothing is shared or known."""
        left, right = sorted((a, b))
        i, j = sorted(self._positions(spark, left, right))
        block = (F.col("bi") == i // self.side) & (F.col("bj") == j // self.side)
        return self.blocks(spark, 0, block).where((F.col("i") == i) & (F.col("j") == j)).select(
            F.lit(left).alias("left"), F.lit(right).alias("right"), "correlation", "support",
            F.col("correlation").isNotNull().alias("sufficient_support"),
        )

    def row(self, spark: SparkSession, item: str) -> DataFrame:
        """(comparison, correlation, support) of every other supported comparison, from the blocks of one row.

        An unknown comparison gives no rows.
        """
        (at,) = self._positions(spark, item)
        block = at // self.side
        held = self.blocks(spark, 0, (F.col("bi") == block) | (F.col("bj") == block))
        held = held.where(((F.col("i") == at) | (F.col("j") == at)) & (F.col("i") != F.col("j")))
        other = F.when(F.col("i") == at, F.col("j")).otherwise(F.col("i")).alias("position")
        cells = held.where(F.col("correlation").isNotNull()).select(other, "correlation", "support")
        return cells.join(self.index(spark), "position").select("comparison", "correlation", "support")

    def tile(self, spark: SparkSession, level: int, row: int, column: int, size: int = SIDE) -> DataFrame:
        """(row, column, correlation, support) per 2^level square of one tile of ``size`` squares a side.

        The mean is over the finite cells of the symmetric matrix, the support their largest. Levels above the
        pyramid, where all fits in one block, are added up from its top.
        """
        if not 1 <= size <= SIDE or min(level, row, column) < 0:
            raise ValueError("invalid tile")
        stored = min(level, self.levels - 1)
        spare = 1 << (level - stored)
        lows = [x * size * spare for x in (row, column)]
        highs = [x + size * spare - 1 for x in lows]
        first = [x // self.side for x in lows]
        last = [x // self.side for x in highs]

        def part(one: int, two: int) -> Column:
            return F.col("bi").between(first[one], last[one]) & F.col("bj").between(first[two], last[two])

        held = self.blocks(spark, stored, part(0, 1) | part(1, 0))
        here = F.struct(F.col("i").alias("i"), F.col("j").alias("j"))
        there = F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
        both = F.when(F.col("i") == F.col("j"), F.array(here)).otherwise(F.array(here, there))
        cells = held.select(F.explode(both).alias("p"), "total", "cells", "support").where(
            F.col("p.i").between(lows[0], highs[0]) & F.col("p.j").between(lows[1], highs[1])
        )
        squares = cells.groupBy(
            F.floor(F.col("p.i") / spare).alias("row"), F.floor(F.col("p.j") / spare).alias("column")
        ).agg(F.sum("total").alias("total"), F.sum("cells").alias("cells"), F.max("support").alias("support"))
        return squares.select("row", "column", F.try_divide("total", "cells").alias("correlation"), "support")


def _written(cells: DataFrame, path: str, side: int, level: int) -> None:
    at = lambda c: F.floor(F.col(c) / side).cast("int")
    placed = cells.withColumns({"level": F.lit(level), "bi": at("i"), "bj": at("j")})
    # All of a block lies in one task, so a block is one file, in the order in which it is looked up.
    placed.repartition("bi", "bj").sortWithinPartitions("bi", "bj", "i", "j").write.mode("append").partitionBy(
        "level", "bi", "bj"
    ).parquet(f"{path}/cells")


def write_store(corr: DataFrame, index: DataFrame, path: str | None = None, side: int = SIDE) -> CorrelationStore:
    """Write a matrix (left, right, correlation, support; each pair once, diagonal included) and its pyramid.

    ``index`` gives each comparison a position from 0, each position once; cells of comparisons that it lacks are
    left out. A level has a quarter of the rows of the one below, and the last one fits in one block.
    """
    spark = corr.sparkSession
    path = path or fresh_path(spark, "correlations")
    index.select(F.col("comparison").cast("string"), F.col("position").cast("int")).write.parquet(f"{path}/index")
    places = spark.read.parquet(f"{path}/index")
    last = places.agg(F.max("position")).first()[0]
    cells = corr.join(places.select(F.col("comparison").alias("left"), F.col("position").alias("p")), "left").join(
        places.select(F.col("comparison").alias("right"), F.col("position").alias("q")), "right"
    )
    value = finite("correlation")
    _written(
        cells.select(
            F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "correlation", F.col("support").cast("bigint"),
            F.coalesce(value, F.lit(0.0)).alias("total"), value.isNotNull().cast("bigint").alias("cells"),
        ),
        path, side, 0,
    )
    level = 0
    store = CorrelationStore(path, side, 1)
    while last is not None and (last >> level) >= side:
        below = store.blocks(spark, level, F.lit(True))
        level += 1
        i, j = F.floor(F.col("i") / 2).cast("int"), F.floor(F.col("j") / 2).cast("int")
        # A square off the diagonal that comes to lie on it brings its mirror image with it.
        times = F.when((i == j) & (F.col("i") != F.col("j")), 2).otherwise(1)
        squares = below.select(
            i.alias("i"), j.alias("j"), "support", (F.col("total") * times).alias("total"), (F.col("cells") * times).alias("cells")
        )
        squares = squares.groupBy("i", "j").agg(
            F.max("support").alias("support"), F.sum("total").alias("total"), F.sum("cells").alias("cells")
        )
        mean = F.try_divide("total", "cells").alias("correlation")
        _written(squares.select("i", "j", mean, "support", "total", "cells"), path, side, level)
        store = CorrelationStore(path, side, level + 1)
    return store
