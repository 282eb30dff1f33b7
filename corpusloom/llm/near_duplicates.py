"""Near-duplicate records with small edits: T-occurrence search over signatures, DivideSkip style.

A record is the lower-cased run of its letters and digits; its grams are the distinct substrings of 8 characters.  Two
records are copies when at least 60 % of the grams in either are in both.

The grams are hashed into classes and the least hash of each class is kept: two records agree in a class with a
probability of their similarity.  Every (one of ``SLOTS`` classes, least gram) has an inverted list.  Copies must occur
together in T lists; as in DivideSkip a record's lists are divided into short and long ones.  The ``SHORT`` = SLOTS - T + 1
shortest, in one order by a counting filter over all records, are merged, so that two records with T common lists meet in
one that is short for both; lists that no other record is in count among them and need no posting.  The postings are
brought together by list, and each carries a sketch of all the record's lists (``FINE`` classes, 3 bits each), in which
the remaining, long lists are probed at once.  Pairs that reach T in total are kept, and an exact count of their grams
decides.

T, for the lists and for the sketch, leaves three standard deviations below the threshold, so a pair can be missed:
measured recall against brute force is in the README.

Exact copies are one class from the start and are only written out in ``copy_pairs``.  A long list (of a hot group of
near copies) is cut, by its true length, into blocks of which all pairs are compared, each pair of blocks as a group of
its own.

Defined cases: null contents and records with fewer than ``least`` letters and digits are in no group; repeated rows
count once; a null key is left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import cut, width

GRAM, SLOTS = 8, 64
#: Copies agree in 64 * 0.6 lists, less three deviations of 3.9.
T = 26
SHORT = SLOTS - T + 1
#: Classes and bits of the sketch; a candidate pair must agree in 128 * (0.6 + 0.4 / 8) less three deviations of 5.4.
FINE, PLANES, REACH = 128, 3, 67
SKETCH_WORDS = FINE * PLANES // 64
#: The counting filter has a counter of 16 bits for each list, 2^26 (128 MB) at most; collisions only make a list look
#: longer to everyone, so beyond that more lists are merged than need be, and none is lost.
LEAST_BITS, MOST_BITS, FILTER_BLOCKS = 16, 26, 256
#: Longest list (or block of one) that is compared at once, and most lists that can be longer (blocks grow beyond that).
LIST_BLOCK, LONG_LISTS = 4096, 50_000
#: Classes of which a task remembers that it has sent their signature.
SEEN = 200_000
#: Most candidate pairs whose records' keys are broadcast to fetch the texts (some tens of MB).
FEW = 200_000
NONE = np.uint32(0xFFFFFFFF)


@cache
def _kept() -> np.ndarray:
    """Whether a code point is a letter or a digit (Unicode L or N)."""
    import unicodedata

    return np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)])


def normal_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters and digits."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return code[_kept()[code]]


def gram_hashes(code: np.ndarray) -> np.ndarray:
    """64-bit hash of every substring of ``GRAM`` characters."""
    n = len(code) - GRAM + 1
    wide = code.astype(np.uint64)
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(GRAM if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + wide[k : k + n] + np.uint64(1)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def signature(code: np.ndarray) -> bytes:
    """The lists' grams (``SLOTS`` least hashes of 32 bits, ``NONE`` for an empty class) and the sketch behind them."""
    hashed = gram_hashes(code)
    fine = np.full(FINE, NONE, np.uint32)
    np.minimum.at(fine, (hashed >> np.uint64(57)).astype(np.intp), (hashed & np.uint64(0xFFFFFFFE)).astype(np.uint32))
    planes = [np.packbits((fine >> np.uint32(k)).astype(np.uint8) & 1) for k in range(1, PLANES + 1)]
    return np.minimum(fine[::2], fine[1::2]).tobytes() + np.concatenate(planes).tobytes()


def _lists(sig: np.ndarray) -> np.ndarray:
    """Names of the inverted lists of a matrix of signatures: slot and gram in one 64-bit number."""
    return sig.astype(np.uint64) | (np.arange(SLOTS, dtype=np.uint64) << np.uint64(32))


def _counter(lists: np.ndarray, bits: int) -> np.ndarray:
    mixed = lists * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def fingerprints(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """Columns id, copy_class (128-bit digest as hex) and signature; the signature once per class and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: set[bytes] = set()
        for batch in batches:
            ids, classes, sigs = [], [], []
            for k, (i, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                code = normal_codes(t)
                if len(code) < least:
                    continue
                digest = xxhash.xxh3_128_digest(code.tobytes())
                ids.append(i)
                classes.append(digest)
                sigs.append(None if digest in seen else signature(code))
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(digest)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(classes, pa.binary()), pa.array(sigs, pa.binary())], names=["id", "copy_class", "signature"])

    rows = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= least))
    return rows.mapInArrow(run, "id string, copy_class binary, signature binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x[: 4 * SLOTS] for x in column.to_pylist()), np.uint32).reshape(-1, SLOTS)


@dataclass(frozen=True)
class Lengths:
    """How many records are in a list, as far as it matters: counters for the order, true numbers for the long ones."""

    bits: int
    counters: np.ndarray
    block: int
    long: np.ndarray  # names of the lists longer than a block, sorted
    numbers: np.ndarray

    def of(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, number of blocks) of lists."""
        n = self.counters[_counter(lists, self.bits)].astype(np.int64)
        blocks = np.ones(lists.shape, np.int64)
        if len(self.long):
            at = np.minimum(np.searchsorted(self.long, lists), len(self.long) - 1)
            known = self.long[at] == lists
            n = np.where(known, self.numbers[at], n)
            blocks = np.where(known, -(-self.numbers[at] // self.block), 1)
        return n, blocks


def list_lengths(prints: DataFrame) -> Lengths:
    """A counter for each list of a record, in a filter sized by their number, and the true lengths of the long lists."""
    signed = prints.where("signature is not null").select("signature")
    entries = signed.count() * SLOTS
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(entries, 1)))))
    block = max(LIST_BLOCK, -(-entries // LONG_LISTS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint16)
        any_row = False
        for batch in batches:
            if batch.num_rows:
                any_row = True
                sig = _matrix(batch.column(0))
                at, n = np.unique(_counter(_lists(sig)[sig != NONE], bits), return_counts=True)
                total[at] = np.minimum(total[at].astype(np.int64) + n, 65535)
        if any_row:
            parts = total.reshape(FILTER_BLOCKS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(FILTER_BLOCKS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = np.frombuffer(zlib.decompress(c), np.uint16).astype(np.int64)
                totals[b] = np.minimum(totals[b] + new, 65535) if b in totals else new
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([zlib.compress(t.astype(np.uint16).tobytes(), 1) for t in totals.values()], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    spread = signed.mapInArrow(count, schema).repartition(min(FILTER_BLOCKS, width(prints.sparkSession)), "block")
    out = np.zeros((FILTER_BLOCKS, (1 << bits) // FILTER_BLOCKS), np.uint16)
    for row in spread.mapInArrow(add, schema).toLocalIterator():
        out[row["block"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint16)
    counters = out.ravel()
    suspects = min(block, 65534)  # a list can only be long if its counter is
    if not (counters > suspects).any():
        return Lengths(bits, counters, block, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    sent = prints.sparkSession.sparkContext.broadcast(np.packbits(counters > suspects))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            if batch.num_rows:
                sig = _matrix(batch.column(0))
                lists = _lists(sig)[sig != NONE]
                keys, n = np.unique(lists[flags[_counter(lists, bits)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["list", "n"])

    true = signed.mapInArrow(name, "list bigint, n bigint").groupBy("list").agg(F.sum("n").alias("n")).where(F.col("n") > block)
    rows = sorted(true.collect(), key=lambda r: r["list"])  # at most LONG_LISTS
    return Lengths(bits, counters, block, np.array([r["list"] for r in rows], np.uint64), np.array([r["n"] for r in rows], np.int64))


def _postings(prints: DataFrame, lengths) -> DataFrame:
    """One row per record and short list: list, block pair, side, the class's name and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lengths.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                sig = _matrix(batch.column(1))
                lists = _lists(sig)
                n, blocks = known.of(lists)
                n[sig == NONE] = 1 << 60
                # by length, then by the list's own hash, so that all records agree on the order
                order = np.lexsort((lists * np.uint64(0xD6E8FEB86659FD93), n), axis=1)[:, :SHORT]
                n, chosen, blocks = (np.take_along_axis(x, order, 1) for x in (n, lists, blocks))
                row, col = np.nonzero((n > 1) & (n < 1 << 60))  # a list of one record has its place in the order, but no pair
                names = batch.column(0).to_pylist()
                packed = [x[4 * SLOTS :] for x in batch.column(1).to_pylist()]
                name, part, side, ids, sketches = [], [], [], [], []
                for r, l, k in zip(row.tolist(), chosen[row, col].astype(np.int64).tolist(), blocks[row, col].tolist()):
                    mine = (names[r] & 0x7FFFFFFF) % k
                    for other in range(k):
                        name.append(l)
                        part.append(min(mine, other) * k + max(mine, other))
                        side.append(mine > other)
                        ids.append(names[r])
                        sketches.append(packed[r])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name, pa.int64()), pa.array(part, pa.int64()), pa.array(side, pa.bool_()), pa.array(ids, pa.int64()), pa.array(sketches, pa.binary())],
                    names=["list", "part", "side", "name", "sketch"],
                )

    return prints.where("signature is not null").select("name", "signature").mapInArrow(run, "list bigint, part bigint, side boolean, name bigint, sketch binary")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes within a list (sorted input) whose sketches agree in ``REACH`` classes."""
    rest: pa.Table | None = None

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        name, part, side = (t.column(k).to_numpy() for k in range(3))
        ids = t.column(3).to_pylist()
        raw = np.frombuffer(b"".join(t.column(4).to_pylist()), np.uint64).reshape(len(ids), SKETCH_WORDS)
        words = [np.ascontiguousarray(raw[:, k]) for k in range(SKETCH_WORDS)]  # plane by plane, two words each
        heads = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (part[1:] != part[:-1])))
        both: set[tuple[int, int]] = set()

        def compare(a: int, b: int, c: int, d: int) -> None:
            """Rows a to b against rows c to d; of rows against themselves each pair once."""
            step = max(1, 65_536 // (d - c))
            for at in range(a, b, step):
                end, start = min(at + step, b), at if a == c else c
                apart = 0
                for half in (0, 1):
                    differ = words[half][at:end, None] ^ words[half][start:d]
                    for k in range(2 + half, SKETCH_WORDS, 2):
                        differ |= words[k][at:end, None] ^ words[k][start:d]
                    apart = apart + np.bitwise_count(differ)
                close = apart <= FINE - REACH
                for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(close, 1) if a == c else close))):
                    x, y = ids[at + i], ids[start + j]
                    if x != y:
                        both.add((x, y) if x < y else (y, x))

        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(ids)]):
            if b - a > 1:
                middle = b - int(side[a:b].sum())  # sorted: the first block's rows, then the second's
                compare(a, middle, a, middle) if middle == b else compare(a, middle, middle, b)
        if both:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in both], pa.int64()), pa.array([y for _, y in both], pa.int64())], names=["name_a", "name_b"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        name, part = t.column(0).to_numpy(), t.column(1).to_numpy()
        if not len(name):
            continue
        same = (name == name[-1]) & (part == part[-1])
        start = len(name) - int(same.sum())
        if start:
            yield from pairs(t.slice(0, start))
        rest = t.slice(start)
    if rest is not None:
        yield from pairs(rest)


def _similar(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[bytes, np.ndarray] = {}

        def grams(name: bytes, text: str) -> np.ndarray:
            if name not in last:
                if len(last) > 200:
                    last.clear()
                last[name] = np.unique(gram_hashes(normal_codes(text)))
            return last[name]

        for batch in batches:
            keep = []
            for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in range(4))):
                p, q = grams(a, x), grams(b, y)
                need = math.ceil(round(threshold * (len(p) + len(q)) / (1 + threshold), 9))  # occurrences that make them copies
                if len(p) > len(q):
                    p, q = q, p
                if not 0 < need <= len(p):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)  # the shorter list probes the longer one
                keep.append(int((q[at] == p).sum()) >= need)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def copy_links(df: DataFrame, key: str = "chunk_id", text: str = "content", least: int = 400, threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(members: id, copy_class; links: class_a, class_b): classes of exact copies and the links between them."""
    spark = df.sparkSession
    found = cut(fingerprints(df, key, text, least))
    # A short name travels with the postings.  Should two classes share one, both are looked up and the exact count tells.
    prints = found.withColumn("name", F.xxhash64("copy_class"))
    members = found.groupBy("id").agg(F.min("copy_class").alias("copy_class"))
    lengths = spark.sparkContext.broadcast(list_lengths(prints))  # 128 MB of counters and 50,000 long lists at most
    merged = (
        _postings(prints, lengths)
        .repartition(width(spark), "list", "part")
        .sortWithinPartitions("list", "part", "side")
        .mapInArrow(_merge, "name_a bigint, name_b bigint")
    )
    candidates = cut(merged.distinct())
    ends = candidates.select(F.col("name_a").alias("name")).union(candidates.select("name_b")).distinct()
    speakers = prints.groupBy("copy_class", "name").agg(F.min("id").alias("id")).join(ends, "name")
    if candidates.limit(FEW + 1).count() <= FEW:
        speakers = F.broadcast(speakers)  # checked: two rows at most per candidate; else all texts are sent around once
    texts = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).where(F.length("text") >= least)
    needed = texts.join(speakers, "id").groupBy("copy_class", "name").agg(F.first("text").alias("text"))
    left = candidates.join(needed.toDF("class_a", "name_a", "text_a"), "name_a")
    both = left.join(needed.toDF("class_b", "name_b", "text_b"), "name_b")
    checked = both.select("class_a", "class_b", "text_a", "text_b").mapInArrow(_similar(threshold), "class_a binary, class_b binary")
    return members, checked


def copy_pairs(df: DataFrame, key: str = "chunk_id", text: str = "content", least: int = 400, threshold: float = 0.6) -> DataFrame:
    """All pairs of different keys that are copies up to edits, the smaller key (byte by byte) first."""
    members, links = copy_links(df, key, text, least, threshold)
    either = F.explode(F.array(F.struct("class_a", "class_b"), F.struct(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b"))))
    links = links.select(either.alias("l")).select("l.*")  # both directions without working the links out twice
    classes = members.groupBy("copy_class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("copy_class")
    alike = links.union(classes.select("copy_class", "copy_class"))
    a = members.select(F.col("id").alias(f"{key}_a"), F.col("copy_class").alias("class_a"))
    b = members.select(F.col("id").alias(f"{key}_b"), F.col("copy_class").alias("class_b"))
    return alike.join(a, "class_a").join(b, "class_b").where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")


def copy_groups(df: DataFrame, key: str = "chunk_id", text: str = "content", least: int = 400, threshold: float = 0.6) -> DataFrame:
    """One row per record: id, copy_class (hex), number of records in the class and of linked other classes."""
    members, links = copy_links(df, key, text, least, threshold)
    sizes = members.groupBy("copy_class").agg(F.count(F.lit(1)).alias("class_size"))
    degree = links.select("class_a").union(links.select("class_b")).groupBy(F.col("class_a").alias("copy_class")).agg(F.count(F.lit(1)).alias("linked_classes"))
    about = sizes.join(degree, "copy_class", "left")
    return members.join(about, "copy_class").select(F.col("id").alias(key), F.lower(F.hex("copy_class")).alias("copy_class"), "class_size", F.coalesce("linked_classes", F.lit(0).cast("bigint")).alias("linked_classes"))
