"""Chunking: structure, regions and packing of every document without a shuffle."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.packing import count_signs, pack
from corpusloom.operators.structure import detect
from corpusloom.schema import CHUNK, ChunkOptions

COLUMNS = [c.split()[0] for c in CHUNK.split(", ")]
KINDS = [pa.string() if c.split()[1] == "string" else pa.int32() for c in CHUNK.split(", ")]


def _number(text: str | None) -> int | None:
    try:
        return int(text) if text is not None else None
    except ValueError:
        return None


def _pages(bounds: list[dict]) -> tuple[list[int], list[int | None]]:
    """Starts of the page markers in order, and the last page number that is one at each."""
    starts, numbers = [], []
    for at, title in sorted({b["start_offset"]: b["title"] for b in reversed(bounds) if b["type"] == "page"}.items()):
        n = _number(title)
        starts.append(at)
        numbers.append(n if n is not None else numbers[-1] if numbers else None)
    return starts, numbers


def chunk_rows(name: str, text: str, bounds: list[dict], options: ChunkOptions, count: Callable[[str], int]) -> list[tuple]:
    """Chunk columns of one document."""
    out: list[list] = []
    ordered = sorted(bounds, key=lambda b: b["start_offset"])
    by_id = {b["boundary_id"]: b for b in reversed(bounds)}
    starts = [b["start_offset"] for b in ordered]
    page_starts, page_numbers = _pages(bounds)
    spans = [(0, starts[0] if starts else len(text), None)]
    spans += [(a, e, b) for a, e, b in zip(starts, [*starts[1:], len(text)], ordered)]
    for start, end, b in spans:
        region = text[start:end].strip()
        if not region:
            continue
        page = sheet = slide = None
        if b:
            if b["type"] == "page":
                page = _number(b["title"])
            elif b["type"] == "sheet":
                sheet = b["title"]
            elif b["type"] == "slide":
                slide = _number(b["boundary_id"].partition(":")[2])
            elif b["type"] == "row_group":
                parent = by_id.get(b["parent_id"])
                sheet = parent["title"] if parent and parent["type"] == "sheet" else None
            if b["type"] != "page":
                known = bisect_right(page_starts, b["start_offset"])
                page = page_numbers[known - 1] if known else None
        info = [b[k] for k in ("type", "boundary_id", "level", "parent_id", "title")] if b else [None] * 5
        for content, tokens in pack(region, options, count):
            out.append([f"{name}:{len(out)}", len(out), 0, content, tokens, *info, page, None, sheet, slide])
    for row in out:
        row[2] = len(out)
    return [tuple(r) for r in out]


def chunk_documents(
    df: DataFrame, key: str = "doc_id", name: str | None = None, text: str = "text", options: ChunkOptions | None = None, loader: str | None = None,
    count: Callable[[str], int] = count_signs, bounds: str | None = None,
) -> DataFrame:
    """Chunks of every document: ``key`` and the chunk columns.  ``name`` (default: the key) begins the chunk ids.

    Null and blank texts have no chunks.  ``count`` is the token counter; any picklable function, such as a BPE's.
    ``bounds`` names an array of boundaries that were detected before.
    """
    opts = options or ChunkOptions()
    opts.validate()
    kind = df.schema[key].dataType.simpleString()
    known = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(name or key).cast("string").alias("name"), F.col(text).alias("text"), *([F.col(loader).alias("loader")] if loader else []), *([F.col(bounds).alias("bounds")] if bounds else []))
    ready = known if bounds else detect(known, "text", "bounds", "loader" if loader else None)
    ready = ready.select("key", "name", "text", "bounds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows: list[tuple] = []
                owner: list[int] = []
                for k, (n, t, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                    got = chunk_rows(n, t, b or [], opts, count)
                    rows += got
                    owner += [k] * len(got)
                cols = list(zip(*rows)) if rows else [()] * len(COLUMNS)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, KINDS)]], names=["key", *COLUMNS])

    return ready.mapInArrow(run, f"key {kind}, {CHUNK}").withColumnRenamed("key", key)
