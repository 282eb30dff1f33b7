"""The index on disk: chunks, boundaries, vectors, words and a manifest as Parquet in hash buckets.

Sources are dealt to ``buckets`` folders by the CRC of their name, so the number of folders and files doesn't grow with
the number of sources and a name needs no escaping.  A save writes a new generation of the buckets it touches (old rows
of other sources with the new ones) beside the old, and one small commit file, created last and only if nobody else
created it, makes all tables switch at once.  Readers hold to the generations of the commit they began with; those of
the last two commits are kept.  JSON-lines export and import carry sparse records (missing fields left out).
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import words
from corpusloom.schema import BOUNDARY, CHUNK

TABLES = {
    "chunks": CHUNK + ", source string",
    "boundaries": BOUNDARY[7:-1].replace(":", " ").replace(",", ", ") + ", source string",
    "vectors": "chunk_id string, embedding array<float>, source string",
    "words": "word string, chunk_id string, source string",
    "manifest": "path string, chunks bigint, indexed_at string, file_type string, has_boundaries boolean, source string",
}
#: Buckets of a new index (an index keeps the number it was made with) and commits whose generations stay.
BUCKETS, KEPT = 64, 2


def columns(name: str) -> list[str]:
    return [c.split()[0] for c in TABLES[name].split(", ")]


def postings(chunks: DataFrame) -> DataFrame:
    """(word, chunk_id, source): the distinct words of every chunk."""
    found = F.array_distinct(words(F.col("content")))
    return chunks.select("chunk_id", "source", F.explode_outer(found).alias("word")).where("word is not null").select(*columns("words"))


class Store:
    """Tables of one index folder.  Reads are lazy; a table that was never written is empty."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root = spark, root
        self._new_buckets = buckets

    # Files, through the file system that the path names.

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.root, *parts))

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        fs, path = self._fs(), self._path(*parts)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _commits(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("_commits") if n.endswith(".json") and n[0] != ".")

    def _state(self, number: int | None = None) -> dict:
        """The last commit, or the one asked: its number, the number of buckets and each table's generation by bucket."""
        number = number if number is not None else max(self._commits(), default=0)
        if not number:
            return {"number": 0, "buckets": self._new_buckets, "tables": {t: {} for t in TABLES}}
        stream = self._fs().open(self._path("_commits", f"{number}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"number": number}

    def _commit(self, state: dict) -> None:
        number = state["number"] + 1
        out = self._fs().create(self._path("_commits", f"{number}.json"), False)  # fails if another writer was faster
        out.write(json.dumps({k: state[k] for k in ("buckets", "tables")}).encode())
        out.close()
        self._sweep()

    def _sweep(self) -> None:
        """Remove commits but the last ones, and generations that none of those names."""
        commits = self._commits()
        for n in commits[:-KEPT]:
            self._fs().delete(self._path("_commits", f"{n}.json"), False)
        used = {(t, g) for n in commits[-KEPT:] for t, at in self._state(n)["tables"].items() for g in at.values()}
        for t in TABLES:
            for folder in self._names(t):
                if folder.startswith("gen=") and (t, folder[4:]) not in used:
                    self._fs().delete(self._path(t, folder), True)

    # Tables.

    def _rows(self, state: dict, name: str, buckets: set[int] | None = None) -> DataFrame:
        at = state["tables"].get(name, {})
        paths = [os.path.join(self.root, name, f"gen={g}", f"bucket={b}") for b, g in at.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*paths)

    def read(self, name: str, source: str | None = None) -> DataFrame:
        """Rows of a table; of one source, only its bucket is scanned."""
        state = self._state()
        if source is None:
            return self._rows(state, name)
        return self._rows(state, name, {zlib.crc32(source.encode()) % state["buckets"]}).where(F.col("source") == source)

    def replace(self, sources: DataFrame, tables: dict[str, DataFrame | Callable[[DataFrame], DataFrame] | None]) -> None:
        """Put new rows (None: none) in the place of all rows of ``sources`` (source) in the named tables, at once.

        A function gets the chunks as they were just written and gives its table's rows, so chunks are computed once.
        """
        state = self._state()
        bucket = lambda df: df.withColumn("bucket", F.pmod(F.crc32(F.encode("source", "UTF-8")), F.lit(state["buckets"])).cast("int"))
        gone = sources.where("source is not null").select("source").distinct()
        touched = {r["bucket"] for r in bucket(gone).select("bucket").distinct().collect()}  # at most the number of buckets
        generation = f"{state['number'] + 1}-{uuid.uuid4().hex[:8]}"
        done = {t: dict(at) for t, at in state["tables"].items()}
        fresh = None
        for name, rows in tables.items():
            kept = self._rows(state, name, touched).join(gone, "source", "left_anti").select(*columns(name))
            new = rows(fresh) if callable(rows) else rows
            whole = kept if new is None else kept.unionByName(new.select(*columns(name)))
            # Rebalancing puts a bucket's rows together but splits a bucket that one large source makes hot.
            bucket(whole).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(os.path.join(self.root, name, f"gen={generation}"))
            written = {int(n[7:]) for n in self._names(name, f"gen={generation}") if n.startswith("bucket=")}
            for b in touched:
                done.setdefault(name, {}).pop(str(b), None)
                if b in written:
                    done[name][str(b)] = generation
            if name == "chunks":
                fresh = self._rows({"tables": done}, "chunks", touched).join(gone, "source", "left_semi").select(*columns(name))
        self._commit(state | {"tables": done})

    def drop(self, source: str) -> None:
        """Remove a source from every table."""
        self.replace(self.spark.createDataFrame([(source,)], "source string"), dict.fromkeys(TABLES))

    def save(self, documents: DataFrame, chunks: DataFrame, boundaries: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> None:
        """All tables of the sources in ``documents`` (source, path, file_type); ``embed`` gives chunks their vectors."""

        def manifest(written: DataFrame) -> DataFrame:
            counts = written.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))
            bounded = boundaries.select("source").distinct().withColumn("__has", F.lit(True))
            entry = documents.select("source", "path", "file_type").join(counts, "source", "left").join(bounded, "source", "left")
            now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            return entry.withColumn("chunks", F.coalesce("chunks", F.lit(0).cast("bigint"))).withColumn("has_boundaries", F.coalesce("__has", F.lit(False))).withColumn("indexed_at", now)

        self.replace(documents, {"chunks": chunks, "boundaries": boundaries, "vectors": embed, "words": postings, "manifest": manifest})

    def add_vectors(self, chunks: DataFrame, vectors: DataFrame) -> None:
        """Vectors for the chunks of some sources; every chunk needs exactly one."""
        bad = chunks.select("chunk_id").join(vectors.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")), "chunk_id", "full_outer").where("n is null or n <> 1").limit(1).count()
        if bad or chunks.count() != vectors.count():
            raise ValueError("the numbers of chunks and vectors differ")
        self.replace(chunks, {"vectors": vectors.join(chunks.select("chunk_id", "source"), "chunk_id")})

    def export_jsonl(self, name: str, path: str) -> None:
        """One JSON object per line, null fields left out."""
        self.read(name).write.mode("overwrite").option("ignoreNullFields", "true").json(path)

    def import_jsonl(self, name: str, path: str) -> DataFrame:
        """Rows of a JSON-lines file (blank lines skipped) or of a single JSON array."""
        lines = self.spark.read.text(path).where(F.trim("value") != "")
        head = lines.limit(1).collect()
        whole = bool(head) and head[0]["value"].lstrip().startswith("[")
        return self.spark.read.schema(TABLES[name]).option("multiLine", str(whole).lower()).json(path)


def sparse_json(df: DataFrame) -> DataFrame:
    """Rows as JSON texts without their null fields."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("json"))
