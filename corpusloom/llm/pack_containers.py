"""Filling fixed-capacity containers: patterns of few lengths, repeated as non-negative least squares tells.

Only the histogram of lengths (at most ``capacity`` numbers, whatever the corpus size) goes to the driver.  There,
patterns of few lengths that fill a container are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares, rounded down, and what is left is packed greedily, largest first.  The plan says which
ranks of a length go into which containers; documents find their place by their rank within their length.

Sizes are counts of tokens of a public tokenizer.  An item over the capacity is split into full containers and a rest.
Defined cases: null or empty texts (no tokens) are left out; an item of exactly the capacity fills a container alone;
repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.tokenize_corpus import PATTERN
from corpusloom.runtime import cut, ship, shipped, width

#: Sweeps of the least-squares fit and lengths tried beside each length; both bound the driver's work only.
SWEEPS, PARTNERS = 12, 10


def token_counts(df: DataFrame, key: str, text: str, ranks: str | None = None) -> DataFrame:
    """Columns key, tokens: the number of tokens of each text under the vocabulary's rank file."""
    name = ship(df.sparkSession, ranks or os.environ.get("CORPUSLOOM_BYTE_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(shipped(name), "rb"))}
        count = tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        for batch in batches:
            sizes = [len(count(t.as_py())) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["key", "tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, tokens bigint")


def patterns(sizes: list[int], capacity: int) -> list[tuple[int, ...]]:
    """Combinations of one to four of the lengths, and of many equal short ones, that leave little room."""
    have = np.array(sorted(sizes))
    largest = lambda room: int(have[k]) if (k := int(np.searchsorted(have, room, "right")) - 1) >= 0 else 0
    out: set[tuple[int, ...]] = set()
    spread = [int(have[k]) for k in np.unique(np.linspace(0, len(have) - 1, PARTNERS).astype(int))]
    for a in have.tolist():
        near = [largest(capacity - a)] + [b for b in spread if a + b <= capacity]
        for b in dict.fromkeys(near):
            if not b:
                out.add((a,))
                continue
            chosen = [a, b]
            while len(chosen) < 4 and (c := largest(capacity - sum(chosen))):
                out.add(tuple(sorted(chosen)))
                chosen.append(c)
            out.add(tuple(sorted(chosen)))
        many = [a] * min(capacity // a, 64)
        while (c := largest(capacity - sum(many))) and len(many) < 128:
            many.append(c)
        out.add(tuple(sorted(many)))
    return sorted(out, key=lambda p: (capacity - sum(p), len(p), p))


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) such that every item of the histogram is used exactly once."""
    left = {s: n for s, n in histogram.items() if n}
    out: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...], times: int) -> None:
        need = {s: pattern.count(s) for s in set(pattern)}
        times = min([times, *[left.get(s, 0) // m for s, m in need.items()]])
        if times > 0:
            out.append((pattern, times))
            for s, m in need.items():
                left[s] -= m * times

    if left:
        columns = patterns(list(left), capacity)
        parts = [[(s, p.count(s)) for s in set(p)] for p in columns]
        norms = [sum(m * m for _, m in part) for part in parts]
        fit, rest = [0.0] * len(columns), {s: float(n) for s, n in left.items()}
        for _ in range(SWEEPS):  # coordinate descent on the squared residual under fit >= 0
            for j, part in enumerate(parts):
                new = max(0.0, fit[j] + sum(m * rest[s] for s, m in part) / norms[j])
                if new != fit[j]:
                    for s, m in part:
                        rest[s] -= m * (new - fit[j])
                    fit[j] = new
        for j, pattern in enumerate(columns):
            use(pattern, int(fit[j]))
    sizes = sorted(s for s, n in left.items() if n)
    while sizes:  # the residual: largest first, filled up with the largest that fits
        chosen, room = [], capacity
        for s in reversed(sizes):
            take = min(room // s, left[s])
            chosen += [s] * take
            room -= s * take
            if not room:
                break
        use(tuple(sorted(chosen)), left[sizes[-1]])
        sizes = [s for s in sizes if left[s]]
    return out


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, ranks: str | None = None) -> DataFrame:
    """Columns container_id, slot, key, piece, start_token, tokens."""
    spark = df.sparkSession
    sized = token_counts(df, key, text, ranks).where("tokens > 0")
    piece = F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / capacity).cast("int")))
    items = cut(
        sized.select("key", "tokens", piece.alias("piece")).select(
            "key", "piece", (F.col("piece").cast("long") * capacity).alias("start_token"), F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("int").alias("size")
        )
    )
    histogram = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    slots: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = dict.fromkeys(histogram, 0)
    container = 0
    for lengths, times in plan(histogram, capacity):
        for slot, size in enumerate(lengths):
            slots.append((size, used[size], used[size] + times, container, slot))
            used[size] += times
        container += times
    where = spark.createDataFrame(slots, "size int, from_rank bigint, to_rank bigint, first_container bigint, slot int")
    salted = items.withColumn("salt", F.pmod(F.xxhash64("key", "piece"), F.lit(width(spark))).cast("int"))
    counts = salted.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("size", "salt", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("before"))
    inner = Window.partitionBy("size", "salt").orderBy("key", "piece")
    ranked = salted.withColumn("row", F.row_number().over(inner)).join(before, ["size", "salt"]).withColumn("rank", F.col("row") - 1 + F.col("before"))
    placed = ranked.join(F.broadcast(where), "size").where("rank >= from_rank and rank < to_rank")  # the plan's size depends on the capacity only
    return placed.select(
        (F.col("first_container") + F.col("rank") - F.col("from_rank")).alias("container_id"), "slot", F.col("key").alias(key), "piece", "start_token", F.col("size").alias("tokens")
    )
