"""Structural content retrieval and point reads over a chunks table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import similarity_ratio
from corpusloom.operators.hierarchy import chunks_under
from corpusloom.schema import STRUCTURAL

#: Least similarity of a title to a query (fixed value).
TITLE_LEAST = 0.3


def assemble(items: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """One row per key: content (chunks by position joined by a blank line while they fit, the first always),
    total_tokens, chunk_count (of all), truncated.  Keys without chunks have no row."""
    w = Window.partitionBy(*keys).orderBy("position")
    running = items.withColumn("used", F.sum("token_count").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(w))
    fits = (F.col("used") <= budget) | (F.col("n") == 1)
    part = F.when(fits, F.struct("position", "content"))
    return running.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["content"]), "\n\n").alias("content"),
        F.max(F.when(fits, F.col("used"))).cast("bigint").alias("total_tokens"),
        F.count(F.lit(1)).alias("chunk_count"),
        (~F.min(fits)).alias("truncated"),
    )


def by_boundary(chunks: DataFrame, boundaries: DataFrame, keys: list[str], boundary_id: str | None = None, include_children: bool = True, budget: int = 8192) -> DataFrame:
    """Content of one boundary, or of each."""
    under = chunks_under(chunks, boundaries, keys, include_children)
    if boundary_id is not None:
        under = under.where(F.col("ancestor_id") == boundary_id)
    return assemble(under, [*keys, "ancestor_id"], budget).withColumnRenamed("ancestor_id", "boundary_id")


def by_pages(chunks: DataFrame, keys: list[str], first: int, last: int, budget: int = 8192) -> DataFrame:
    """Content of a range of pages, both ends included."""
    return assemble(chunks.where(F.col("page").between(first, last)), keys, budget)


def by_positions(chunks: DataFrame, keys: list[str], first: int, last: int, budget: int = 8192) -> DataFrame:
    """Content of a range of chunk positions, both ends included."""
    return assemble(chunks.where(F.col("position").between(first, last)), keys, budget)


def title_match(boundaries: DataFrame, keys: list[str], query: str, boundary_type: str | None = None) -> DataFrame:
    """Per key the structural boundary whose title is most similar to the query (first on ties), if it is at least 0.3."""
    types = [boundary_type] if boundary_type else list(STRUCTURAL)
    titled = boundaries.where(F.col("type").isin(*types) & F.col("title").isNotNull() & (F.col("title") != ""))
    titles = titled.select("title").distinct()
    scored = titles.withColumn("similarity", similarity_ratio(F.lower(F.lit(query)), F.lower("title"))).where(F.col("similarity") >= TITLE_LEAST)
    return titled.join(scored, "title").groupBy(*keys).agg(F.max_by(F.struct("boundary_id", "type", "level", "title", "similarity"), F.struct("similarity", -F.col("ord"))).alias("b")).select(*keys, "b.*")


def by_title(chunks: DataFrame, boundaries: DataFrame, keys: list[str], query: str, boundary_type: str | None = None, include_children: bool = True, budget: int = 8192) -> DataFrame:
    """Content of the boundary with the best matching title."""
    best = title_match(boundaries, keys, query, boundary_type).select(*keys, F.col("boundary_id").alias("ancestor_id"))
    under = chunks_under(chunks, boundaries, keys, include_children).join(best, [*keys, "ancestor_id"], "left_semi")
    return assemble(under, [*keys, "ancestor_id"], budget).withColumnRenamed("ancestor_id", "boundary_id")


def get_chunks(chunks: DataFrame, ids: list[str]) -> DataFrame:
    """Chunks by id in the order asked; missing ones are skipped.  ``place`` is the position in the request."""
    asked = chunks.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], "place int, chunk_id string")
    return chunks.join(F.broadcast(asked), "chunk_id").orderBy("place")


def latest_rows(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row per key, the one with the greatest ``at``; rows with a null key are left out."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(at), F.xxhash64(*[c for c in df.columns if not df.schema[c].dataType.simpleString().startswith("map")]))
    known = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    return known.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def sources(chunks: DataFrame) -> DataFrame:
    """Distinct sources with their number of chunks."""
    return chunks.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))
