"""Chunkers as table functions that SQL can call, row by row or over the ordered rows of a source.

After ``register(spark)``: ``parent_sections(text)`` and ``child_windows(text)`` give numbered pieces of
a text, for use with LATERAL; ``chunk_units(TABLE(...) PARTITION BY slug ORDER BY ...)`` takes the units of a
source in order, numbers those without a page, and gives parents and children with their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.chunking import child_windows, parent_sections


class ParentSections:
    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(parent_sections(text or ""))


class ChildWindows:
    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(child_windows(text or ""))


class ChunkUnits:
    """Rows of one source (slug, page, text), in the order asked for; only a count is kept between rows."""

    def __init__(self) -> None:
        self.unit = 0

    def eval(self, row) -> Iterator[tuple[str, str | None, str, int, str]]:
        self.unit += 1
        where = f"{row['slug']}:u{self.unit}" if row["page"] is None else f"{row['slug']}:pg{row['page']}"
        for p, parent in enumerate(parent_sections(row["text"] or "")):
            yield f"{where}:p{p}", None, "parent", p, parent
            for c, child in enumerate(child_windows(parent)):
                yield f"{where}:p{p}:c{c}", f"{where}:p{p}", "child", c, child


def register(spark: SparkSession) -> None:
    spark.udtf.register("parent_sections", udtf(ParentSections, returnType="chunk_index int, section string"))
    spark.udtf.register("child_windows", udtf(ChildWindows, returnType="chunk_index int, child string"))
    spark.udtf.register("chunk_units", udtf(ChunkUnits, returnType="chunk_id string, parent_chunk_id string, role string, chunk_index int, text string"))
