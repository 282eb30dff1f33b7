"""Views of the driver's tables that the core queries read: deduplicated chunks, boundaries and vectors, and a structured
corpus assembled from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.runtime import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null")


#: Columns too wide to be sent around for the sake of a few repeated rows; most repeated keys that are broadcast instead.
WIDE, FEW = {"content", "embedding"}, 200_000


def _newest(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key, the latest.

    Narrow rows are combined on the map side.  Of wide rows only those with a repeated key are: the keys are counted
    first, and if the repeated ones are few they are broadcast, so that all other rows stay where they are.
    """
    rest = [c for c in columns if c not in keys]
    known = df.where(" and ".join(f"{k} is not null" for k in keys)).select(*keys, *rest, "indexed_at")

    def combined(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("indexed_at")).alias("r")).select(*keys, "r.*")

    if not WIDE & set(rest):
        return combined(known)
    repeated = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    if repeated.limit(FEW + 1).count() > FEW:
        return combined(known)
    again = F.broadcast(repeated)
    return known.join(again, keys, "left_anti").select(*keys, *rest).unionByName(combined(known.join(again, keys, "left_semi")))


def chunks(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    df = table(spark, sf_dir, "chunks")
    return _newest(df, ["chunk_id"], columns or [c for c in df.columns if c != "indexed_at"])


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "boundaries")
    return _newest(df, ["doc_id", "boundary_id"], [c for c in df.columns if c not in ("indexed_at", "source")])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "chunk_vectors")
    return _newest(df, ["vec_id"], ["vec_id", "chunk_id", "source", "embedding"])


def example_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The embedding that stands in for an embedded query: that of the smallest vector id."""
    row = table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()
    return [float(x) for x in row["embedding"]] if row else [0.0] * 64
