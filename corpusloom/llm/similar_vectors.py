"""Most similar vectors for every vector: multiprobe p-stable hashing with exact reranking.

Vectors are scaled to length 1, so Euclidean order is cosine order.  Each of ``TABLES`` tables hashes a vector by M
projections on Gaussian directions, cut into cells of width ``CELL``; M grows with the logarithm of the number of
vectors so that a bucket holds about ``OCCUPANCY`` background vectors at any size.  A vector is stored in its own
bucket of every table and looks into that bucket and into the most promising perturbed ones, in the order of their
estimated success (the expected squared distances of the sorted cell borders).  A bucket's vectors and visitors come
together in one task, with their full coordinates: of every bucket a visitor takes the k most similar by exact cosine,
and the k best of all buckets are its neighbours, both directions of a pair counting.  The buckets are dealt to as many
tasks as keep ``ENTRIES`` visits each, and a vector goes once to a task, whatever number of its buckets lie there.

The copies of a vector that go to tasks are many times the table, so the tasks are run in rounds: a round has some of the
tables, or a share of one table's buckets, and as many of them as let its copies take one and a half times the disk of the
vectors themselves (``ROUND_BYTES`` at least).  Every bucket is in one round, each round hashes the vectors for its tables again,
and its shuffle is removed before the next.  Vectors travel and wait in a lossless code: as 16-bit integers where they
are decimal fractions of up to six digits, else as they are.

A bucket with more than ``MEMBERS`` stored vectors or visits is cut into blocks of both: every block of stored vectors
meets every block of visitors in a group of its own, so no group holds more than about two blocks and nothing is dropped.
Vectors with the same coordinates are one class; their members are written out at the end, at most k + 1 of a class per
vector, smallest identifiers first.

``neighbours`` finds what reaches a cosine.  The k most similar vectors at any distance are too far apart for hashing to
tell them from the rest (in 64 dimensions a fifth neighbour's cosine is often under 0.6), so ``nearest`` compares the
asked ids with all vectors.

Defined cases: null, short, long, zero and non-finite vectors are not usable and left out; repeated rows count once
(the latest); equal cosines rank by identifier; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import Scratch, cut, width

TABLES, CELL, SEED = 6, 2.0, 20_011
#: Chance that two unrelated vectors share a cell of one projection at this width; gives M from the wanted occupancy.
SHARED, OCCUPANCY = 0.486, 1200
MEMBERS, HOT_KEYS = 4096, 50_000
#: Visits dealt to one task; more than the error of a cosine of 64 coordinates in single precision (66 * 2^-24).
ENTRIES, SLACK = 1_000_000, 1e-5
#: Disk for the copies of a round, in any case and times the vectors; bytes of a row of them besides its vector and visits.
ROUND_BYTES, ROUND_SHARE, ROW_BYTES = 400_000_000, 1.5, 24
#: Rows of the blocks that :func:`nearest` compares at once, and queries in one matrix; digits that tell cosines apart.
QUERY_BLOCK, STORED_BLOCK, QUERY_SLICE, DIGITS = 16_384, 8_192, 512, 12


def usable_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", latest: str = "indexed_at", size: int = 64) -> DataFrame:
    """Columns id, v: the latest usable vector of each key."""
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    newest = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("id")).agg(F.max_by(F.col(vector), F.col(latest)).alias("v"))
    return newest.where((F.size("v") == size) & finite & F.exists(F.col("v"), lambda x: x != 0))


def probes(m: int, count: int) -> list[list[int]]:
    """The first perturbation sets, as places in the sorted list of the 2M border distances, by expected score."""
    expected = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    expected += [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    heap: list[tuple[float, list[int]]] = [(expected[0], [0])]
    out: list[list[int]] = []
    while heap and len(out) < count:
        score, places = heappop(heap)
        last = places[-1]
        if not any(2 * m - 1 - p in places for p in places):
            out.append(places)
        if last + 1 < 2 * m:
            heappush(heap, (score - expected[last] + expected[last + 1], [*places[:-1], last + 1]))
            heappush(heap, (score + expected[last + 1], [*places, last + 1]))
    return out


class Hasher:
    """Bucket numbers of unit vectors."""

    def __init__(self, size: int, vectors: int) -> None:
        self.m = max(2, round(math.log(max(vectors, 1) / OCCUPANCY) / -math.log(SHARED))) if vectors > OCCUPANCY else 1
        rng = np.random.default_rng(SEED)
        self.directions = rng.standard_normal((size, TABLES * self.m))
        self.shifts = rng.uniform(0, CELL, TABLES * self.m)
        self.mixers = rng.integers(1, 2**63, (TABLES, self.m), dtype=np.uint64) | np.uint64(1)
        self.salts = rng.integers(1, 2**63, TABLES, dtype=np.uint64)
        self.probes = probes(self.m, self.m + 2)

    def names(self, unit: np.ndarray, tables: range = range(TABLES)) -> tuple[np.ndarray, np.ndarray]:
        """Own buckets (vectors, tables) and perturbed ones (vectors, tables, probes)."""
        own = slice(tables.start * self.m, tables.stop * self.m)
        at = ((unit @ self.directions[:, own] + self.shifts[own]) / CELL).reshape(-1, len(tables), self.m)
        cell = np.floor(at)
        below = at - cell
        order = np.argsort(np.concatenate([below, 1 - below], 2), axis=2)  # borders, nearest first
        mixers = self.mixers[tables.start : tables.stop]
        home = (cell.astype(np.int64).astype(np.uint64) * mixers).sum(2, dtype=np.uint64) + self.salts[tables.start : tables.stop]
        across = np.concatenate([-mixers, mixers], 1)  # what a step across each border adds
        steps = across[np.arange(len(tables))[None, :, None], order]
        visits = np.stack([home + sum(steps[:, :, p] for p in places) for places in self.probes], 2)
        return self._mixed(home), self._mixed(visits)

    @staticmethod
    def _mixed(names: np.ndarray) -> np.ndarray:
        names = names ^ (names >> np.uint64(31))
        return (names * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)


#: First byte of a coded vector: its decimal digits, or RAW; with DOUBLE added if the numbers are doubles.
RAW, DOUBLE, DECIMALS = 15, 16, range(7)


def pack(v: np.ndarray) -> pa.Array:
    """Vectors without loss of a digit: a byte for the code, then the lower and the upper bytes of decimal integers, or the numbers."""
    n, size = v.shape
    codes = np.full(n, RAW, np.uint8)
    whole = np.zeros((n, size), np.int16)
    rest = np.arange(n)
    for digits in DECIMALS:
        for some in (slice(0, 4), slice(0, size)):  # most that fail do so in the first numbers
            scaled = np.rint(v[rest, some].astype(np.float64) * 10.0**digits)
            fits = ((np.abs(scaled) < 2**15) & ((scaled / 10.0**digits).astype(v.dtype) == v[rest, some])).all(1)
            if some.stop == size:
                codes[rest[fits]], whole[rest[fits]] = digits, scaled[fits].astype(np.int16)
                rest = np.setdiff1d(rest, rest[fits])
            elif not fits.any():
                break
    lengths = np.where(codes == RAW, 1 + size * v.itemsize, 1 + 2 * size)
    offsets = np.append(0, np.cumsum(lengths))
    data = np.empty(offsets[-1], np.uint8)
    data[offsets[:-1]] = codes + (DOUBLE if v.itemsize == 8 else 0)
    planes = np.concatenate([(whole & 255).astype(np.uint8), (whole >> 8).astype(np.uint8)], 1)
    for rows, payload in ((np.flatnonzero(codes != RAW), planes), (np.flatnonzero(codes == RAW), np.ascontiguousarray(v).view(np.uint8).reshape(n, size * v.itemsize))):
        if len(rows):
            data[offsets[rows, None] + 1 + np.arange(payload.shape[1])] = payload[rows]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, from 0, and bytes of a binary column."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return offsets.astype(np.int64) - offsets[0], data


def unpack(column: pa.Array, size: int) -> np.ndarray:
    """The vectors that :func:`pack` has coded."""
    offsets, data = _bytes(column)
    codes = data[offsets[:-1]]
    out = np.empty((len(codes), size), np.float64 if (codes >= DOUBLE).any() else np.float32)
    for code in np.unique(codes).tolist():
        rows, kind = np.flatnonzero(codes == code), np.dtype(np.float64 if code >= DOUBLE else np.float32)
        digits = code % DOUBLE
        long = size * (kind.itemsize if digits == RAW else 2)
        if len(rows) == len(codes):
            payload = data.reshape(-1, 1 + long)[:, 1:]
        else:
            payload = data[offsets[rows, None] + 1 + np.arange(long)]
        if digits == RAW:
            out[rows] = np.ascontiguousarray(payload).view(kind)
        else:
            whole = payload[:, :size].astype(np.int16) | payload[:, size:].astype(np.int16) << 8
            out[rows] = (whole / 10.0**digits).astype(kind)
    return out


def _coded(size: int):
    """Rows (id, h1, h2, v) with v coded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                v = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pack(v)], names=["id", "h1", "h2", "v"])

    return run


def _units(batch: pa.RecordBatch, column: int, size: int) -> np.ndarray:
    held = batch.column(column)
    if pa.types.is_binary(held.type) or pa.types.is_large_binary(held.type):
        flat = unpack(held, size).astype(np.float64)
    else:
        flat = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _spread(ids: np.ndarray, seed: int) -> np.ndarray:
    mixed = (ids.astype(np.uint64) ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)).astype(np.int64)


#: Roles of a vector in a group, the last bits of the group's number.
STORED, VISITS = np.uint64(1), np.uint64(2)


def _numbers(name: np.ndarray, block: np.ndarray | int = 0) -> np.ndarray:
    """Numbers of groups, by bucket and block; without the roles."""
    group = name.astype(np.uint64) + np.asarray(block).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    group ^= group >> np.uint64(29)
    group *= np.uint64(0xBF58476D1CE4E5B9)
    group ^= group >> np.uint64(32)
    return group


def _groups(ids: np.ndarray, row: np.ndarray, name: np.ndarray, home: np.ndarray, hot: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, group with roles) of bucket entries.  Every entry visits, home entries are stored as well.

    ``hot`` are the numbers of crowded buckets, their blocks of stored vectors and of visitors: there a visitor goes to its
    block of visitors with every block of stored ones, a stored vector to its block with every block of visitors.
    """
    keys, stored_blocks, visit_blocks = hot
    down = across = np.ones(len(name), np.int64)
    if len(keys):
        where = np.minimum(np.searchsorted(keys, name), len(keys) - 1)
        crowded = keys[where] == name
        down, across = np.where(crowded, stored_blocks[where], 1), np.where(crowded, visit_blocks[where], 1)
    own_down, own_across = _spread(ids[row], 1) % down, _spread(ids[row], 2) % across

    def copies(entries: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.repeat(entries, times)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)

    visitors, to_down = copies(np.arange(len(name)), down)
    stored, to_across = copies(np.flatnonzero(home), across[home])
    other = to_across != own_across[stored]  # where it is stored and visits at once, one entry tells both
    stored, to_across = stored[other], to_across[other]
    entry = np.concatenate([visitors, stored])
    block = np.concatenate([to_down * across[visitors] + own_across[visitors], own_down[stored] * across[stored] + to_across])
    group = _numbers(name[entry], block)
    both = np.where(home[visitors] & (to_down == own_down[visitors]), VISITS | STORED, VISITS)
    role = np.concatenate([both, np.full(len(stored), STORED)])
    return row[entry], group & np.uint64(0xFFFFFFFFFFFFFFFC) | role


def _bucket_names(hasher: Hasher, unit: np.ndarray, tables: range = range(TABLES)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and whether it is the home one, of all buckets that some vectors look into."""
    home, visits = hasher.names(unit, tables)
    n = len(unit)
    row = np.concatenate([np.repeat(np.arange(n), len(tables)), np.repeat(np.arange(n), visits.shape[1] * visits.shape[2])])
    return row, np.concatenate([home.ravel(), visits.ravel()]), np.arange(home.size + visits.size) < home.size


def _entries(
    vectors: DataFrame, hasher: Hasher, size: int, hot: tuple[np.ndarray, np.ndarray, np.ndarray], parts: int, tables: range = range(TABLES), turn: range | None = None
) -> DataFrame:
    """Rows (part, id, visits, v): a vector and its groups, of those that are dealt to one task, with its roles in them.

    Of the groups of ``tables``, dealt to ``parts`` tasks, those of the tasks in ``turn``, which are numbered from 0.
    """
    turn = range(parts) if turn is None else turn

    def place(group: np.ndarray) -> np.ndarray:
        return ((group >> np.uint64(32)) % np.uint64(parts)).astype(np.int64) - turn.start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                ids, n = batch.column(0).to_numpy(), batch.num_rows
                row, name, home = _bucket_names(hasher, _units(batch, 1, size), tables)
                if len(turn) < parts:  # most entries belong to other rounds; only those of crowded buckets aren't known by the bucket
                    part = place(_numbers(name))
                    some = np.flatnonzero((part >= 0) & (part < len(turn)) | np.isin(name, hot[0]))
                    row, name, home = row[some], name[some], home[some]
                row, group = _groups(ids, row, name, home, hot)
                part = place(group)
                if len(turn) < parts:
                    mine = np.flatnonzero((part >= 0) & (part < len(turn)))
                    part, row, group = part[mine], row[mine], group[mine]
                target = part * n + row
                order = np.argsort(target, kind="stable")
                target, group = target[order], np.ascontiguousarray(group[order])
                heads = np.flatnonzero(np.append(True, target[1:] != target[:-1])[: len(target)])
                offsets = (np.append(heads, len(group)) * 8).astype(np.int32)
                lists = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(group)])
                of = target[heads] % n
                yield pa.RecordBatch.from_arrays(
                    [pa.array((target[heads] // n).astype(np.int32)), pa.array(ids[of]), lists, batch.column(1).take(pa.array(of))], names=["part", "id", "visits", "v"]
                )

    return vectors.mapInArrow(run, f"part int, id bigint, visits binary, v {vectors.schema['v'].dataType.simpleString()}")


def _rounds(total: int, visits: int, weight: float, cores: int) -> tuple[int, list[tuple[range, range]]]:
    """Tasks that a table's groups are dealt to, and the tables and tasks of each round.

    As few rounds as keep the copies of ``total`` vectors of ``weight`` bytes, with ``visits`` entries in all, within
    ``ROUND_SHARE`` times the bytes of the vectors or ``ROUND_BYTES``; none has fewer than two tasks for a core, or more
    entries in one than ``ENTRIES``.
    """
    most = max(ROUND_BYTES, ROUND_SHARE * total * weight)
    for tables, slices in chain(((n, 1) for n in range(TABLES, 1, -1) if TABLES % n == 0), ((1, n) for n in count(1))):
        held = visits * tables / TABLES / slices
        tasks = max(2 * cores, math.ceil(held / ENTRIES))
        copies = total * tasks * -math.expm1(-held / max(total, 1) / tasks)  # a vector goes once to a task
        if copies * (weight + ROW_BYTES) + 8 * held <= most:
            break
    return tasks * slices, [(range(t, t + tables), range(s * tasks, (s + 1) * tasks)) for t in range(0, TABLES, tables) for s in range(slices)]


def _candidates(size: int, k: int, least: float):
    """Of each group: for each visitor the ``k`` most similar stored vectors of the least cosine or more."""

    def one(ids: np.ndarray, stored: np.ndarray, asks: np.ndarray, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of one group, by id; a vector that is stored and visits has a row for each role."""
        held, queries = np.flatnonzero(stored), np.flatnonzero(asks)
        matrix = unit[held].T
        rough, rough_matrix = unit[queries].astype(np.float32), matrix.astype(np.float32)
        mine = np.searchsorted(ids[held], ids[queries])  # a visitor's own place among the stored ones
        mine = np.where(ids[held][np.minimum(mine, len(held) - 1)] == ids[queries], mine, -1)
        for at in range(0, len(queries), QUERY_SLICE):
            own = mine[at : at + QUERY_SLICE]
            near = rough[at : at + QUERY_SLICE] @ rough_matrix
            near[np.flatnonzero(own >= 0), own[own >= 0]] = -2
            rows = at + np.flatnonzero(near.max(1) >= least - SLACK)
            if len(rows):
                near = np.round(unit[queries[rows]] @ matrix, DIGITS)
                own = mine[rows]
                near[np.flatnonzero(own >= 0), own[own >= 0]] = -2
                near[near < least] = -2
                i, j = np.nonzero(_best(near, k))
                yield ids[queries[rows[i]]], ids[held[j]], near[i, j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, visits, counts, vectors = [], [], [], []
        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column(1).to_numpy().copy())
                offsets, lists = _bytes(batch.column(2))
                counts.append(np.diff(offsets) // 8)
                visits.append(np.frombuffer(lists.tobytes(), np.uint64))
                vectors.append(unpack(batch.column(3), size))
        if not ids:
            return
        id_, v = np.concatenate(ids), np.concatenate(vectors)
        del vectors
        name, row = np.concatenate(visits), np.repeat(np.arange(len(id_)), np.concatenate(counts))
        by_id = np.argsort(np.argsort(id_))
        order = np.lexsort((by_id[row], name >> np.uint64(2)))
        name, row = name[order], row[order]
        group, stored, asks = name >> np.uint64(2), (name & STORED) > 0, (name & VISITS) > 0
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        tails = np.append(heads[1:], len(group))
        some = (np.add.reduceat(stored.astype(np.int64), heads) > 0) & (np.add.reduceat(asks.astype(np.int64), heads) > 0)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def out() -> pa.RecordBatch:
            x, y, c = (np.concatenate(z) for z in zip(*found))
            pair, at = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0, return_index=True)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(c[at])], names=["a", "b", "cosine"])

        for a, b in zip(heads[some].tolist(), tails[some].tolist()):
            unit = v[row[a:b]].astype(np.float64)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            for x in one(id_[row[a:b]], stored[a:b], asks[a:b], unit):
                found.append(x)
                held += len(x[0])
            if held > ENTRIES:
                yield out()
                found.clear()
                held = 0
        if found:
            yield out()

    return run


def _classes(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keyed: id, v, h1, h2; classes of equal vectors: h1, h2, class, firsts; reps: id, v of a class's smallest id)."""
    same = F.xxhash64("v")
    keyed = cut(vectors.select("id", "v", same.alias("h1"), F.hash("v").alias("h2")))
    heads = _heads(keyed, k + 1)
    return keyed, _firsts(heads), heads.where("place = 1").select("id", "v")


def _heads(keyed: DataFrame, most: int) -> DataFrame:
    """Of every class of equal vectors the ``most`` smallest identifiers, which stand for it."""
    by_class = Window.partitionBy("h1", "h2").orderBy("id")
    return keyed.withColumn("place", F.row_number().over(by_class)).where(F.col("place") <= most)


def _firsts(heads: DataFrame) -> DataFrame:
    return heads.groupBy("h1", "h2").agg(F.min("id").alias("class"), F.array_sort(F.collect_list("id")).alias("firsts"))


def _members(own: DataFrame, classes: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of every row of ``own`` (id, class, firsts) from the cosines of classes."""
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("cosine"), "other_class"))).where(F.col("rank") <= k)
    firsts = classes.select(F.col("class").alias("other_class"), "firsts")
    opened = best.join(firsts, "other_class").groupBy("class").agg(F.flatten(F.collect_list(F.transform("firsts", lambda x: F.struct(-F.col("cosine"), x)))).alias("others"))
    listed = own.join(opened, "class", "left")
    mine = F.transform(F.filter("firsts", lambda x: x != F.col("id")), lambda x: F.struct(F.lit(-1.0).alias("minus"), x.alias("other")))
    return _rank_members(listed.select("id", mine.alias("mine"), "others"), k)


def _best(near: np.ndarray, k: int) -> np.ndarray:
    """Which of a row's cosines are its ``k`` largest; of equal ones the first columns."""
    if near.shape[1] <= k:
        return near > -2
    floor = np.partition(near, near.shape[1] - k, axis=1)[:, -k, None]
    keep = (near >= floor) & (near > -2)
    if len(tied := np.flatnonzero(keep.sum(1) > k)):
        above, level = near[tied] > floor[tied], near[tied] == floor[tied]
        keep[tied] = above | level & (np.cumsum(level, 1, dtype=np.int32) <= k - above.sum(1, keepdims=True))
    return keep


def _scan(size: int, k: int):
    """Of a block of queries and a block of stored vectors the ``k`` best of every query, in double precision."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        ids, asks = t.column("id").to_numpy(), t.column("asks").to_numpy()
        unit = _units(t.select(["v"]).to_batches()[0], 0, size)
        held, queries = ids[~asks], ids[asks]
        matrix, sides = unit[~asks].T, unit[asks]
        rows, columns, cosines = [], [], []
        for at in range(0, len(queries) if len(held) else 0, QUERY_SLICE):
            near = np.round(sides[at : at + QUERY_SLICE] @ matrix, DIGITS)
            near[queries[at : at + QUERY_SLICE, None] == held[None, :]] = -2
            i, j = np.nonzero(_best(near, k))
            rows.append(queries[at + i])
            columns.append(held[j])
            cosines.append(near[i, j])
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"class": join(rows, pa.int64()), "other_class": join(columns, pa.int64()), "cosine": join(cosines, pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, size: int = 64) -> DataFrame:
    """Columns id, other, cosine, rank: the ``k`` most similar vectors, however far, of each id in ``queries``.

    Every query is compared with every vector, block by block, so the result is exact and the work is their product.
    """
    keyed, classes, reps = _classes(vectors, k)
    asked = keyed.join(queries.select("id").distinct(), "id", "left_semi")
    own = cut(asked.join(classes, ["h1", "h2"]).select("id", "class", "firsts"))
    sides = reps.join(own.select(F.col("class").alias("id")).distinct(), "id", "left_semi")
    down, across = (max(1, -(-df.count() // most)) for df, most in ((sides, QUERY_BLOCK), (reps, STORED_BLOCK)))

    def cells(df: DataFrame, asks: bool) -> DataFrame:
        """Copies of the rows in all cells of their block's row or column of the grid."""
        mine = F.pmod(F.xxhash64("id"), F.lit(down if asks else across))
        others = F.explode(F.sequence(F.lit(0), F.lit((across if asks else down) - 1)))
        placed = df.select("id", "v", mine.alias("mine"), others.alias("turn"))
        cell = F.col("mine") * across + F.col("turn") if asks else F.col("turn") * across + F.col("mine")
        return placed.select(cell.alias("cell"), F.lit(asks).alias("asks"), "id", "v")

    grid = cells(sides, True).union(cells(reps, False)).repartition(width(vectors.sparkSession), "cell")
    scored = grid.groupBy("cell").applyInArrow(_scan(size, k), "class bigint, other_class bigint, cosine double")
    return _members(own, classes, scored, k)


def _crowded(reps: DataFrame, hasher: Hasher, size: int, total: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """The buckets with more stored vectors or visits than a block holds, with their numbers of blocks of both, and the
    number of all entries.  A block grows with the corpus so far that at most ``HOT_KEYS`` buckets can be crowded."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                _, name, home = _bucket_names(hasher, _units(whole.slice(at, 4000), 0, size))
                keys, which = np.unique(name, return_inverse=True)  # counted here first: what is sent on is much less
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(which[home], minlength=len(keys))), pa.array(np.bincount(which))], names=["bucket", "stored", "visits"])

    visits = TABLES * (len(hasher.probes) + 1) * total
    block = max(MEMBERS, math.ceil(visits / HOT_KEYS))
    sizes = reps.select("v").mapInArrow(counts, "bucket bigint, stored bigint, visits bigint").groupBy("bucket").agg(F.sum("stored").alias("stored"), F.sum("visits").alias("visits"))
    rows = sizes.where(F.col("visits") > block).orderBy("bucket").collect()  # at most HOT_KEYS
    keys, stored, visiting = (np.array([r[c] for r in rows], np.int64) for c in ("bucket", "stored", "visits"))
    down, across = np.maximum(1, -(-stored // block)), -(-visiting // block)
    return (keys, down, across), visits + int((visiting * (down - 1) + stored * across).sum())


def neighbours(vectors: DataFrame, k: int = 5, least: float = 0.9, size: int = 64) -> DataFrame:
    """Columns id, other, cosine, rank (1 = most similar): up to k most similar vectors of cosine ``least`` or more.

    ``vectors`` has the columns id and v of :func:`usable_vectors`.  For neighbours at any distance see :func:`nearest`.
    """
    spark = vectors.sparkSession
    with Scratch(spark) as files:
        hashed = vectors.select("id", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"), "v")
        keyed = files.write(hashed.mapInArrow(_coded(size), "id bigint, h1 bigint, h2 int, v binary"), "keyed")
        total, weight = keyed.agg(F.count("*"), F.coalesce(F.avg(F.length("v")), F.lit(0.0))).first()
        keys, reps = files.write(keyed.drop("v"), "keys"), files.write(_heads(keyed, 1).select("id", "v"), "reps")
        files.drop("keyed")
        hasher = Hasher(size, total)

        hot, visits = _crowded(reps, hasher, size, total)
        parts, rounds = _rounds(total, visits, weight, spark.sparkContext.defaultParallelism)
        for turn, (tables, tasks) in enumerate(rounds):
            entries = _entries(reps, hasher, size, hot, parts, tables, tasks).repartitionById(len(tasks), F.col("part"))
            found = files.write(entries.mapInArrow(_candidates(size, k, least), "a bigint, b bigint, cosine double"), f"found/{turn}")
        files.drop("reps")
        every = files.read(found, *(f"found/{turn}" for turn in range(len(rounds))))
        pairs = files.write(every.groupBy("a", "b").agg(F.max("cosine").alias("cosine")), "pairs")  # read twice below
        files.drop("found")
        both = pairs.union(pairs.select("b", "a", "cosine")).toDF("class", "other_class", "cosine")
        classes = _firsts(_heads(keys, k + 1))
        own = keys.join(classes, ["h1", "h2"]).select("id", "class", "firsts")
        return cut(_members(own, classes, both, k))


def _rank_members(listed: DataFrame, k: int) -> DataFrame:
    others = F.when(F.col("others").isNull(), F.array().cast("array<struct<minus:double,other:bigint>>")).otherwise(F.col("others").cast("array<struct<minus:double,other:bigint>>"))
    joined = F.slice(F.array_sort(F.concat(F.col("mine").cast("array<struct<minus:double,other:bigint>>"), others)), 1, k)
    return listed.select("id", F.posexplode(joined).alias("pos", "o")).select("id", F.col("o.other").alias("other"), (-F.col("o.minus")).alias("cosine"), (F.col("pos") + 1).alias("rank"))


def similar_pairs(neighbour_rows: DataFrame, key: str = "vec_id") -> DataFrame:
    """Unordered pairs of the neighbour lists, the smaller key first."""
    a: Column = F.least("id", "other")
    return neighbour_rows.select(a.alias(f"{key}_a"), F.greatest("id", "other").alias(f"{key}_b")).distinct()
