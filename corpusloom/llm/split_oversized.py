"""Splitting oversized items at natural boundaries, all greedy cuts at once by pointer doubling.

An item longer than its limit is cut into pieces of at most ``chunk_size`` characters; each piece but the first starts
``chunk_overlap`` characters before the end of the one before it, so the pieces without their overlaps are the item
again.  From every position the farthest legal end of a next piece is looked up (structural boundary, else paragraph,
sentence, line or word end in the second half of the window, else the last of any kind before, else the full size), which makes a successor table; the
table is squared until it spans the longest item, and the cuts reached from each item's start are read off it.

Defined cases: items at or under the limit, null contents and items whose option is unknown or has no limit give no
pieces; a very long item needs about a dozen 8-byte numbers per character in one task; unusable option values are read as chunk_size = limit, overlap = 0, and an overlap above half the size as half
the size; repeated rows count once (the latest); boundaries outside the item are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import text_slices

#: Width in characters of the blocks by which boundaries find the items they lie in.
BLOCK = 4096
SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
STOPS, WIDE_STOPS = np.frombuffer(".!?…؟।॥".encode("utf-32-le"), np.uint32), np.frombuffer("。！？．".encode("utf-32-le"), np.uint32)


def cut_positions(texts: list[str], size: np.ndarray, overlap: np.ndarray, marks: list[list[int]]) -> list[np.ndarray]:
    """Ends of the pieces of each text; ``marks`` are structural boundaries inside it."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(lengths + 1) - lengths - 1  # one extra place per text: its end
    total = int((lengths + 1).sum())
    item = np.repeat(np.arange(len(texts)), lengths + 1)
    end = base + lengths
    here = np.ones(total, bool)
    here[end] = False
    chars = np.full(total, 10, np.uint32)
    chars[here] = code
    before = np.concatenate([[np.uint32(10)], chars[:-1]])
    space, gap = np.isin(chars, SPACES), np.isin(before, SPACES)
    word = gap & ~space
    line = word & (before == 10)
    second = np.concatenate([[np.uint32(10)], before[:-1]])
    paragraph = line & (second == 10)
    sentence = (word & np.isin(second, STOPS)) | (np.isin(before, WIDE_STOPS) & ~np.isin(chars, WIDE_STOPS))
    structural = np.zeros(total, bool)
    for k, at in enumerate(marks):
        inside = np.asarray([x for x in at if 0 < x < lengths[k]], np.int64)
        structural[base[k] + inside] = True
    place = np.arange(total)
    start = place - overlap[item]
    limit = start + size[item]
    last = np.minimum(limit, end[item])
    least = np.maximum(place, start + size[item] // 2)
    any_place = np.maximum.accumulate(np.where(word | line | sentence | paragraph | structural, place, 0))[last]
    jump = np.where(limit >= end[item], end[item], np.where(any_place > place, any_place, last))
    for natural in (word, line, sentence, paragraph, structural):  # the strongest comes last and wins
        latest = np.maximum.accumulate(np.where(natural, place, 0))[last]
        jump = np.where((limit < end[item]) & (latest > least), latest, jump)
    first = base.copy()  # the first piece has no overlap
    reach = base + size
    for k in np.flatnonzero(reach < end):
        early = np.flatnonzero((word | line | sentence | paragraph | structural)[base[k] + 1 : reach[k] + 1])
        first[k] = base[k] + 1 + early[-1] if len(early) else reach[k]
        for natural in (structural, paragraph, sentence, line, word):
            found = np.flatnonzero(natural[base[k] + size[k] // 2 + 1 : reach[k] + 1])
            if len(found):
                first[k] = base[k] + size[k] // 2 + 1 + found[-1]
                break
    first = np.where(reach >= end, end, first)
    reached = np.zeros(total, bool)
    reached[first] = True
    while not reached[end].all():
        reached[jump[reached]] = True
        jump = jump[jump]
    cuts = np.flatnonzero(reached)
    bounds = np.searchsorted(cuts, [*base, total])
    return [cuts[a:b] - base[k] for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]


def split_oversized(chunks: DataFrame, boundaries: DataFrame, options: DataFrame) -> DataFrame:
    """Columns chunk_id, piece (from 0), n_pieces, start_offset, end_offset (in the content) and content of each piece."""
    opts = options.where("option_id is not null and max_chunk_size >= 1").groupBy("option_id").agg(
        F.max("max_chunk_size").alias("__max"), F.max("chunk_size").alias("__size"), F.max("chunk_overlap").alias("__lap")
    )
    size = F.when(F.col("__size") >= 1, F.least("__size", "__max")).otherwise(F.col("__max"))
    lap = F.greatest(F.lit(0), F.least(F.coalesce("__lap", F.lit(0)), F.floor(F.col("__size_") / 2)))
    long = (
        chunks.where("chunk_id is not null and content is not null")
        .select("chunk_id", "doc_id", "start_offset", "content", "option_id", "indexed_at")
        .join(opts, "option_id")
        .where(F.length("content") > F.col("__max"))
        .withColumn("__size_", size.cast("int"))
        .withColumn("__lap_", lap.cast("int"))
        .groupBy("chunk_id")
        .agg(F.max_by(F.struct("doc_id", "start_offset", "content", "__size_", "__lap_"), F.struct("indexed_at", "content")).alias("r"))
        .select("chunk_id", "r.*")
    )
    first, past = F.col("start_offset"), F.col("start_offset") + F.length("content")
    blocks = F.sequence(F.floor(first / BLOCK), F.floor(past / BLOCK))
    spans = long.where("start_offset is not null").select("chunk_id", "doc_id", first.alias("__a"), past.alias("__b"), F.explode(blocks).alias("__block"))
    marks = boundaries.where("start_offset is not null").select("doc_id", F.col("start_offset").alias("__at"), F.floor(F.col("start_offset") / BLOCK).alias("__block"))
    inside = (
        spans.join(marks, ["doc_id", "__block"])
        .where("__at > __a and __at < __b")
        .groupBy("chunk_id")
        .agg(F.collect_set(F.col("__at") - F.col("__a")).alias("__marks"))
    )
    ready = long.join(inside, "chunk_id", "left").select("chunk_id", "content", "__size_", "__lap_", F.coalesce("__marks", F.array().cast("array<int>")).alias("__marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 1):
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                sizes, laps = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
                out: list[tuple] = []
                for k, ends in enumerate(cut_positions(texts, sizes, laps, batch.column(4).to_pylist())):
                    ends = ends.tolist()
                    starts = [0, *[e - int(laps[k]) for e in ends[:-1]]]
                    out += [(keys[k], i, len(ends), a, b, texts[k][a:b]) for i, (a, b) in enumerate(zip(starts, ends))]
                names = ["chunk_id", "piece", "n_pieces", "start_offset", "end_offset", "content"]
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return ready.mapInArrow(run, "chunk_id string, piece int, n_pieces int, start_offset int, end_offset int, content string")


def oversized_ids(pieces: DataFrame) -> DataFrame:
    """The items that were cut; a cut item has exactly one last piece."""
    return pieces.where("n_pieces > 1 and piece = n_pieces - 1").select("chunk_id")
