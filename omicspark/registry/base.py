"""Named queries over the test tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[["Tables"], DataFrame]


class Tables:
    """The parquet tables of one scale folder, and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        """A derived view: the same text that the SQL side uses as a CTE."""
        needs, text = VIEWS[name]
        sources = {n: READS.get((name, n), n) for n in needs}
        frames = {n: self.view(s) if s in VIEWS else self.table(s) for n, s in sources.items()}
        return self.spark.sql(text, **frames)


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}
#: (view, what it needs) to a cheaper view that gives it the same rows.
READS: dict[tuple[str, str], str] = {}


def define_view(name: str, needs: tuple[str, ...], text: str) -> None:
    """Register a view; tables in the text stand in braces."""
    VIEWS[name] = (needs, text)


def _order(name: str, seen: list[str]) -> None:
    if name not in VIEWS or name in seen:
        return
    for other in VIEWS[name][0]:
        _order(other, seen)
    if name not in seen:
        seen.append(name)


def with_views(*names: str) -> str:
    """'WITH RECURSIVE a AS (...), b AS (...)' of the views and what they need."""
    seen: list[str] = []
    for name in names:
        _order(name, seen)
    parts = []
    for name in seen:
        needs, text = VIEWS[name]
        parts.append(f"{name} AS ({text.format(**{n: n for n in needs})})")
    return "WITH RECURSIVE " + ",\n".join(parts)


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Builder
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a builder; ``covers`` lists the inventory ids, ``views`` the CTEs of ``sql``."""

    def register(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        text = sql
        if text is not None and views:
            head = with_views(*views)
            body = text.strip()
            text = f"{head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"{head}\n{body}"
        QUERIES[name] = Query(name, tuple(covers.split()), build, text)
        return build

    return register
