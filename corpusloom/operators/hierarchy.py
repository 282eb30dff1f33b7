"""Boundary hierarchy: ancestors, descendants, siblings, and tables of contents.

``boundaries`` has the key columns and ord, type, level, boundary_id, title, start_offset, parent_id.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.structure import pages_at
from corpusloom.schema import STRUCTURAL

#: Levels strictly grow down a chain of parents and end at 4, so a chain has at most this many steps.
DEPTH = 4


def ancestors(boundaries: DataFrame, keys: list[str]) -> DataFrame:
    """Closure: key, boundary_id, ancestor_id, ancestor_level, depth (0: itself).  A chain ends where a parent is missing."""
    chain = boundaries.select(*keys, "boundary_id", F.col("boundary_id").alias("__id0"), F.col("level").alias("__level0"), F.col("parent_id").alias("__up0"))
    for d in range(1, DEPTH + 1):  # one look-up join a step, all of the same side, so that its exchange is reused
        above = boundaries.select(*keys, F.col("boundary_id").alias(f"__id{d}"), F.col("level").alias(f"__level{d}"), F.col("parent_id").alias(f"__up{d}"))
        chain = chain.withColumn(f"__id{d}", F.col(f"__up{d - 1}")).join(above, [*keys, f"__id{d}"], "left")
    # A parent that has no row ends the chain: its level is null.
    steps = F.array(*[F.struct(F.col(f"__id{d}").alias("id"), F.col(f"__level{d}").alias("level"), F.lit(d).alias("depth")) for d in range(DEPTH + 1)])
    opened = chain.select(*keys, "boundary_id", F.explode(steps).alias("s")).where("s.level is not null")
    return opened.select(*keys, "boundary_id", F.col("s.id").alias("ancestor_id"), F.col("s.level").alias("ancestor_level"), F.col("s.depth").alias("depth"))


def ancestor_at_level(boundaries: DataFrame, keys: list[str], level: int) -> DataFrame:
    """Each boundary with the nearest one at exactly ``level`` on its chain (itself included), else null."""
    at = ancestors(boundaries, keys).where(F.col("ancestor_level") == level)
    nearest = at.groupBy(*keys, "boundary_id").agg(F.min_by("ancestor_id", "depth").alias("ancestor_id"))
    return boundaries.select(*keys, "boundary_id").join(nearest, [*keys, "boundary_id"], "left")


def siblings(boundaries: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (boundary_id, sibling_id, sibling_ord) with the same parent; roots have none."""
    own = boundaries.where("parent_id is not null")
    a = own.select(*keys, "parent_id", "boundary_id")
    b = own.select(*keys, "parent_id", F.col("boundary_id").alias("sibling_id"), F.col("ord").alias("sibling_ord"))
    return a.join(b, [*keys, "parent_id"]).where("boundary_id <> sibling_id").drop("parent_id")


def chunks_under(chunks: DataFrame, boundaries: DataFrame, keys: list[str], include_children: bool = True) -> DataFrame:
    """Pairs (ancestor_id, chunk columns): the chunks of each boundary, with those of its descendants if wanted."""
    if not include_children:
        return chunks.where("boundary_id is not null").withColumn("ancestor_id", F.col("boundary_id"))
    closure = ancestors(boundaries, keys).select(*keys, "boundary_id", "ancestor_id")
    return chunks.join(closure, [*keys, "boundary_id"])


def toc(boundaries: DataFrame, chunks: DataFrame, keys: list[str], max_depth: int = 3) -> DataFrame:
    """Chapters, sections and subsections up to ``max_depth`` with direct and total chunk counts, page and position.

    Counts are taken per boundary first and summed along the closure, so chunks are never multiplied by their depth.
    ``parent_id`` is null where the parent is not shown.
    """
    direct = chunks.where("boundary_id is not null").groupBy(*keys, "boundary_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    closure = ancestors(boundaries, keys).select(*keys, "boundary_id", "ancestor_id")
    total = closure.join(direct, [*keys, "boundary_id"]).groupBy(*keys, F.col("ancestor_id").alias("boundary_id")).agg(F.sum("chunk_count").alias("total_chunks"))
    shown = pages_at(boundaries, keys).where(F.col("type").isin(*STRUCTURAL) & (F.col("level") <= max_depth))
    parents = shown.select(*keys, F.col("boundary_id").alias("parent_id"), F.lit(True).alias("__shown"))
    zero = F.lit(0).cast("bigint")
    return (
        shown.join(direct, [*keys, "boundary_id"], "left")
        .join(total, [*keys, "boundary_id"], "left")
        .join(parents, [*keys, "parent_id"], "left")
        .select(
            *keys, "ord", "boundary_id", "type", "level", "title", F.when(F.col("__shown"), F.col("parent_id")).alias("parent_id"),
            F.coalesce("chunk_count", zero).alias("chunk_count"), F.coalesce("total_chunks", zero).alias("total_chunks"), "page",
        )
    )


def toc_tree(rows: list[dict]) -> list[dict]:
    """Nested entries of one document's contents (a small collected result), without empty children and pages."""
    nodes = {r["boundary_id"]: {k: r[k] for k in ("boundary_id", "type", "level", "title", "chunk_count", "total_chunks")} | ({"page": r["page"]} if r["page"] is not None else {}) for r in sorted(rows, key=lambda r: r["ord"])}
    roots = []
    for r in sorted(rows, key=lambda r: r["ord"]):
        if r["parent_id"] in nodes:
            nodes[r["parent_id"]].setdefault("children", []).append(nodes[r["boundary_id"]])
        else:
            roots.append(nodes[r["boundary_id"]])
    return roots


def toc_size(entries: list[dict]) -> int:
    """Number of entries of a nested table of contents."""
    return sum(1 + toc_size(e.get("children", [])) for e in entries)


def toc_json(entries: list[dict]) -> str:
    return json.dumps(entries, ensure_ascii=False, indent=2)
