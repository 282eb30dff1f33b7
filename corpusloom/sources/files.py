"""Document scan: a path or glob of supported files as one row per document, and tables inside files.

Text and Markdown are read natively; office files as bytes and parsed in Arrow batches on the executors.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.tables import csv_text, header_names, padded
from corpusloom.functions.text import custom_source_name, plain_lines, source_name
from corpusloom.schema import BOUNDARY, FILE_TYPES
from corpusloom.sources.office import READERS

TABLE_TYPES = ("docx", "pdf", "pptx", "xlsx")


def supported_extensions() -> list[str]:
    return sorted(FILE_TYPES)


def supported_table_extensions() -> list[str]:
    return sorted(e for e, t in FILE_TYPES.items() if t in TABLE_TYPES)


def file_type(path: Column) -> Column:
    """Type of a path by its extension; null if unsupported."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    out = F.lit(None).cast("string")
    for e, t in FILE_TYPES.items():
        out = F.when(ext == e, F.lit(t)).otherwise(out)
    return out


def resolve(path: str, root: str | None = None) -> str:
    """Absolute form of a path that must lie in the working folder (``CORPUSLOOM_WORKING_DIR`` or the current one)."""
    base = Path(root or os.environ.get("CORPUSLOOM_WORKING_DIR", ".")).resolve()
    full = (base / path).resolve()
    if full != base and base not in full.parents:
        raise PermissionError(f"{path} is outside the working folder")
    return str(full)


def index_dir(root: str | None = None) -> str:
    """Folder of the index (``CORPUSLOOM_INDEX_DIR`` or ``.corpusloom`` in the working folder)."""
    return root or os.environ.get("CORPUSLOOM_INDEX_DIR", os.path.join(os.environ.get("CORPUSLOOM_WORKING_DIR", "."), ".corpusloom"))


def check_file(path: str) -> str:
    """Type of an existing supported file; else an error."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"file not found: {path}")
    ext = os.path.splitext(path)[1].lower()
    if ext not in FILE_TYPES:
        raise ValueError(f"unsupported file format '{ext}'; supported: {', '.join(supported_extensions())}")
    return FILE_TYPES[ext]


SCHEMA = f"path string, file_type string, content string, facts map<string,string>, loader array<{BOUNDARY}>, file_size bigint"


def load_documents(spark: SparkSession, paths: str | list[str], name: str | None = None) -> DataFrame:
    """Columns source, path, file_type, content, facts, loader (boundaries the reader knows), file_size.  Files of other
    types are left out; a broken office file fails with its path."""
    listed = [paths] if isinstance(paths, str) else paths
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(listed)
    typed = files.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), file_type(F.col("path")).alias("file_type"), "content", F.col("length").alias("file_size")).where("file_type is not null")
    plain = typed.where(F.col("file_type").isin("text", "markdown")).select(
        "path", "file_type", plain_lines(F.decode("content", "UTF-8")).alias("content"), F.create_map(F.lit("file_size"), F.col("file_size").cast("string")).alias("facts"), F.lit(None).cast(f"array<{BOUNDARY}>").alias("loader"), "file_size"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.struct([("ord", pa.int32()), ("type", pa.string()), ("level", pa.int32()), ("boundary_id", pa.string()), ("title", pa.string()), ("start_offset", pa.int32()), ("parent_id", pa.string())])), pa.int64()]
        for batch in batches:
            rows = []
            for path, kind, data, size in zip(*(batch.column(k).to_pylist() for k in range(4))):
                try:
                    text, bounds, facts, _ = READERS[kind](data)
                except Exception as bad:
                    raise RuntimeError(f"cannot read {path}: {bad}") from bad
                rows.append((path, kind, text, list((facts | {"file_size": str(size)}).items()), bounds, size))
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["path", "file_type", "content", "facts", "loader", "file_size"])

    office = typed.where(F.col("file_type").isin(*READERS)).mapInArrow(run, SCHEMA)
    label = custom_source_name(F.lit(name)) if name else source_name(F.col("path"))
    return plain.unionByName(office).withColumn("source", label)


def read_document(docs: DataFrame, max_chars: int = 100_000, include_metadata: bool = True, text: str = "content") -> DataFrame:
    """Content cut to ``max_chars``, whether it was cut, and the length after it."""
    short = F.substring(F.col(text), 1, max_chars)
    out = docs.withColumn("truncated", F.length(text) > max_chars).withColumn("char_count", F.length(short)).withColumn(text, short)
    return out if include_metadata else out.drop("facts", "loader")


def list_tables(spark: SparkSession, path: str | list[str], index: int | None = None) -> DataFrame:
    """One row per table: path, table_index, location, headers, rows, row_count, col_count.  With ``index`` only that
    table of a file gets its cells; the others come with their places alone, headers and rows null."""
    files = spark.read.format("binaryFile").load(path)
    typed = files.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), file_type(F.col("path")).alias("file_type"), "content").where(F.col("file_type").isin(*TABLE_TYPES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, kind, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for k, (where, found) in enumerate(READERS[kind](data)[3]):
                    if index not in (None, k):
                        rows.append((p, k, where, None, None, None, None))
                        continue
                    full = padded(found)
                    heads = ([str(h) for h in full[0]] if kind in ("docx", "pptx") else header_names([h or None for h in full[0]] if kind == "pdf" else full[0])) if full else []
                    body = [[None if v is None and kind != "pdf" else str(v if v is not None else "") for v in r] for r in full[1:]]
                    rows.append((p, k, where, heads, body, len(body), len(heads)))
            cols = list(zip(*rows)) if rows else [()] * 7
            texts = pa.list_(pa.string())
            kinds = [pa.string(), pa.int32(), pa.string(), texts, pa.list_(texts), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["path", "table_index", "location", "headers", "rows", "row_count", "col_count"])

    return typed.mapInArrow(run, "path string, table_index int, location string, headers array<string>, rows array<array<string>>, row_count int, col_count int")


def extract_table(spark: SparkSession, path: str, index: int, max_rows: int | None = None) -> dict:
    """One table of one file, read once; an index out of range is an error."""
    places = list_tables(spark, path, index).collect()  # of one file: the wanted table and the places of the others
    hit = [r.asDict() for r in places if r["table_index"] == index]
    if not hit:
        raise ValueError(f"table index {index} out of range; the file has {len(places)} tables")
    row = hit[0]
    if max_rows is not None:
        row["rows"] = row["rows"][:max_rows]
        row["row_count"] = len(row["rows"])
    return row


def table_csv(table: dict, include_headers: bool = True) -> str:
    return csv_text(table["headers"], table["rows"], include_headers)


def facts_json(facts: dict) -> str:
    return json.dumps(facts, ensure_ascii=False, sort_keys=True)
