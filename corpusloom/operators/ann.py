"""Approximate vector search: vectors stored by their nearest centre, a search reads the lists nearest to the query.

The centres (spherical k-means) are fitted on a bounded sample, every vector is indexed: it gets the list of its nearest
centre and is written there, a folder per list, so a search scans the folders it probes and no others and ranks what is in
them exactly.  Probing all lists gives the exact result.

Defined cases: null, zero and non-finite vectors and those of another length are in no list; ties go to the smaller id; an
empty table gives an index without lists.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.vectors import nearest, semantic_score

#: Vectors that the centres are fitted on, most lists, and rounds of the fit: bounds of the driver's work.
SAMPLE, LISTS, ROUNDS = 20_000, 1024, 12


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit(sample: np.ndarray, lists: int, seed: int = 1) -> np.ndarray:
    """Centres of length 1 for unit vectors; a centre that loses its vectors starts again at the worst placed one."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(ROUNDS):
        near = sample @ centres.T
        own = near.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.linalg.norm(sums, axis=1) < 1e-9
        sums[empty] = sample[np.argsort(near.max(1))[: int(empty.sum())]]
        centres = _unit(sums)
    return centres


class VectorIndex:
    """Lists of vectors in a folder, and their centres."""

    def __init__(self, spark: SparkSession, path: str, centres: np.ndarray) -> None:
        self.spark, self.path, self.centres = spark, path, centres

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int | None = None) -> VectorIndex:
        """Index a table (chunk_id, source, embedding); the number of lists is the root of that of the vectors."""
        spark = vectors.sparkSession
        first = vectors.where(F.size("embedding") > 0).select(F.size("embedding").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
        size = first["n"] if first else 0
        usable = vectors.where(semantic_score(F.col("embedding"), [1.0] * max(size, 1)).isNotNull())
        total = usable.count()
        sample = [r["embedding"] for r in usable.select("embedding", F.xxhash64("chunk_id").alias("h")).orderBy("h").limit(SAMPLE).collect()]
        count = min(len(sample), LISTS, lists or max(1, round(math.sqrt(total))))
        centres = fit(_unit(np.array(sample, np.float64)), count) if count else np.zeros((0, size))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((rows @ centres.T).argmax(1).astype(np.int32))], names=[*batch.schema.names, "list"])

        if count:
            named = usable.select("chunk_id", "source", F.col("embedding").cast("array<float>").alias("embedding"))
            placed = named.mapInArrow(place, "chunk_id string, source string, embedding array<float>, list int")
            placed.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(os.path.join(path, "lists"))
        spark.createDataFrame([(json.dumps(centres.tolist()),)], "centres string").coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "centres"))
        return cls(spark, path, centres)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        centres = json.loads(spark.read.parquet(os.path.join(path, "centres")).first()["centres"])
        return cls(spark, path, np.array(centres, np.float64))

    def pool(self, query: list[float], probes: int) -> DataFrame:
        """Vectors of the ``probes`` lists nearest to the query, a table like the one that was indexed."""
        if not len(self.centres):
            return self.spark.createDataFrame([], "chunk_id string, source string, embedding array<float>")
        order = np.argsort(-(self.centres @ np.asarray(query, np.float64)), kind="stable")[:probes]
        rows = self.spark.read.schema("chunk_id string, source string, embedding array<float>, list int").parquet(os.path.join(self.path, "lists"))
        return rows.where(F.col("list").isin([int(x) for x in order])).drop("list")

    def search(self, query: list[float], k: int = 5, probes: int = 16) -> DataFrame:
        """The k best chunks of the probed lists by exact score."""
        return nearest(self.pool(query, probes), query, k)
