"""Parent and child chunks, their ids, and upkeep of an index by checksum."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARENT_TARGET, PARENT_CAP, CHILD_TARGET = 1800, 3200, 480
#: Fixed value: what a block starts with that opens a section.
SECTION = re.compile(r"^\s*(S\.?\s*R\.?\s*O\.?|Sr\.?\s*No\.?|Schedule|SCHEDULE|===\s*Page|\(\s*[ivx]+\s*\))")


def parent_sections(text: str) -> list[str]:
    """Blocks between blank lines, gathered: a section's start, the target or the cap closes a parent.

    A block is never cut; lengths leave out separators.
    """
    out, held, size = [], [], 0
    for block in (b.strip() for b in re.sub(r"\n{3,}", "\n\n", re.sub(r"\r\n?", "\n", text)).strip().split("\n\n")):
        if not block:
            continue
        if held and (SECTION.match(block) or size + len(block) > PARENT_TARGET or size >= PARENT_CAP):
            out.append("\n\n".join(held))
            held, size = [], 0
        held.append(block)
        size += len(block)
    return [*out, "\n\n".join(held)] if held else out


def child_windows(text: str) -> list[str]:
    """Lines gathered up to the target, each counted with its break, blanks around them off.

    A long line stays whole; a parent without any window is its own.
    """
    out, held, size = [], [], 0
    for line in text.split("\n"):
        if held and size + len(line) + 1 > CHILD_TARGET:
            out.append("\n".join(held).strip())
            held, size = [], 0
        held.append(line)
        size += len(line) + 1
    return [x for x in [*out, "\n".join(held).strip()] if x] or [text.strip()]


def chunks(units: DataFrame) -> DataFrame:
    """Parents and children of units (slug, page or null, text), with ids and checksums.

    Greedy gathering is a fold over a unit's blocks, so it runs in batches of pandas.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for slug, page, unit, text in batch[["slug", "page", "unit", "text"]].itertuples(index=False, name=None):
                where = f"{slug}:u{unit}" if pd.isna(page) else f"{slug}:pg{int(page)}"
                for p, parent in enumerate(parent_sections(text or "")):
                    rows.append((f"{where}:p{p}", None, "parent", p, parent))
                    rows += [(f"{where}:p{p}:c{c}", f"{where}:p{p}", "child", c, child) for c, child in enumerate(child_windows(parent))]
            yield pd.DataFrame(rows, columns=["chunk_id", "parent_chunk_id", "role", "chunk_index", "text"])

    made = units.select("slug", "page", "unit", "text").mapInPandas(run, "chunk_id string, parent_chunk_id string, role string, chunk_index int, text string")
    return made.select("*", F.length("text").alias("char_count"), F.sha2("text", 256).alias("checksum"))


def line_children(documents: DataFrame) -> DataFrame:
    """Shipment documents: paragraphs are parents, lines children (sentences, if there is one line)."""
    parents = documents.select("doc_id", F.posexplode(F.filter(F.split("text", r"\n\s*\n"), lambda p: F.trim(p) != "")).alias("parent", "paragraph"))
    lines = F.filter(F.split("paragraph", "\n"), lambda x: F.trim(x) != "")
    children = F.when(F.size(lines) > 1, lines).otherwise(F.filter(F.split("paragraph", r"(?<=[.!?])\s+"), lambda x: F.trim(x) != ""))
    low = F.lower("child")
    section = (
        F.when((F.contains(low, F.lit("invoice")) & F.contains(low, F.lit("no"))) | F.contains(low, F.lit("date")), "header").when(F.contains(low, F.lit("total")), "totals")
        .when(F.contains(low, F.lit("weight")), "weights").otherwise("body")
    )
    return parents.select("doc_id", "parent", F.posexplode(children).alias("child_index", "child")).select("doc_id", "parent", "child_index", F.trim("child").alias("child"), section.alias("section"), F.sha2(F.trim("child"), 256).alias("content_hash"))


def index_actions(chunks_: DataFrame, stored: DataFrame, version: str) -> DataFrame:
    """(chunk_id, action): insert, update (checksum or version differs), keep, delete."""
    new = chunks_.select("chunk_id", F.col("checksum").alias("new_checksum"))
    old = stored.select("chunk_id", F.col("checksum").alias("old_checksum"), F.col("index_version").alias("old_version"))
    action = F.when(F.col("old_checksum").isNull(), "insert").when(F.col("new_checksum").isNull(), "delete").when((F.col("new_checksum") != F.col("old_checksum")) | (F.col("old_version") != version), "update").otherwise("keep")
    return new.join(old, "chunk_id", "full_outer").select("chunk_id", action.alias("action"))


def changed_sources(sources: DataFrame, seen: DataFrame) -> DataFrame:
    """Sources to ingest anew: not seen, or seen with another checksum."""
    same = seen.select("source_path", "checksum")
    return sources.join(same, ["source_path", "checksum"], "left_anti")


def active_chunks(chunks_: DataFrame) -> DataFrame:
    """Of documents of one type in a shipment, only the last one's chunks are active."""
    last = Window.partitionBy("shipment_id", "document_type")
    return chunks_.withColumn("active", F.col("uploaded") == F.max("uploaded").over(last))


def summary_text(ships: DataFrame) -> DataFrame:
    """A shipment's rendered summary and its checksum."""
    text = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("unknown"))) for c in ("shipment_id", "destination", "shipment_date", "code", "exporter", "amount")])
    return ships.select("shipment_id", text.alias("summary"), F.sha2(text, 256).alias("checksum"))


def audit_summary(reports: DataFrame) -> DataFrame:
    """(shipment_id, summary, checksum): ten lines on a finished shipment.

    reports: shipment_id, exporter, destination, status, needs_review, and arrays products, codes,
    mismatches, calculation_errors, regulatory_problems.
    """
    once = lambda c, by, empty: F.coalesce(F.nullif(F.array_join(F.array_distinct(F.filter(c, lambda x: F.coalesce(x, F.lit("")) != "")), by), F.lit("")), F.lit(empty))
    about = lambda word: F.coalesce(F.nullif(F.array_join(F.filter("mismatches", lambda m: F.contains(F.lower(m), F.lit(word))), "; "), F.lit("")), F.lit("none"))
    known = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown"))
    failed = F.concat("mismatches", "calculation_errors", "regulatory_problems")
    lines = (
        ("Shipment ID", F.col("shipment_id").cast("string")), ("Exporter", known("exporter")), ("Destination", known("destination")), ("Products", once(F.col("products"), ", ", "none recorded")), ("PCT codes", once(F.col("codes"), ", ", "none recorded")),
        ("Compliance status", known("status")), ("Failed checks", once(failed, "; ", "none")), ("Weight discrepancies", about("weight")), ("Quantity discrepancies", about("quantity")), ("Human review", F.when(F.col("needs_review"), "required").otherwise("not required")),
    )
    text = F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in lines])
    return reports.select("shipment_id", text.alias("summary"), F.sha2(text, 256).alias("checksum"))
