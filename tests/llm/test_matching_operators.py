"""Vectors, near-duplicates, rank fusion and splitting, against brute force."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import near_duplicates as nd
from corpusloom.llm import rank_fusion, split_oversized
from corpusloom.llm import similar_vectors as sv

VECTORS = "vec_id bigint, embedding array<float>, indexed_at int, id string, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, at, "x", "y") for i, v, at in rows], VECTORS)


def crowds(seed, groups, size, background):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, 64))
    points = [c + 0.25 * rng.standard_normal(64) for c in centres for _ in range(size)] + list(rng.standard_normal((background, 64)))
    return [(p * rng.uniform(0.5, 8)).astype(np.float32).tolist() for p in points]


def test_similar_pairs(spark):
    points = crowds(2, 40, 9, 2200)
    rows = [(i, p, 1) for i, p in enumerate(points)]
    bad = [(9001, None, 1), (9002, [], 1), (9003, [1.0] * 63, 1), (9004, [0.0] * 64, 1), (9005, [float("nan")] * 64, 1), (9006, [float("inf")] + [1.0] * 63, 1), (None, points[0], 1)]
    stale = [(0, points[5], 0), (1, points[1], 2)]
    near = sv.neighbours(sv.usable_vectors(vectors(spark, rows + bad + stale)))
    got = {(r["vec_id_a"], r["vec_id_b"]) for r in sv.similar_pairs(near).collect()}
    unit = np.array(points, np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -2)
    want = {(min(i, j), max(i, j)) for i in range(len(points)) for j in np.argsort(-cosine[i])[:5].tolist() if cosine[i, j] >= 0.9}
    assert len(want) > 500 and len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_groups_of_a_crowd_stay_bounded(spark):
    """One crowd of 10,000, 20,000 and 40,000 vectors: no group grows with it, and each stored vector meets each visitor."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    for n in (10_000, 20_000, 40_000):
        crowd = (centre + 0.02 * rng.standard_normal((n, 64))).astype(np.float32)
        rows = spark.createDataFrame(((i, v.tolist()) for i, v in enumerate(crowd)), "id bigint, v array<float>").repartition(4).cache()
        hasher = sv.Hasher(64, n)
        hot, entries = sv._crowded(rows, hasher, 64, n)
        assert len(hot[0])
        sizes: dict[int, int] = {}
        total = 0
        for r in sv._entries(rows, hasher, 64, hot, 8).select("visits").toLocalIterator():
            groups = np.frombuffer(r["visits"], np.uint64) >> np.uint64(2)
            total += len(groups)
            for g in groups.tolist():
                sizes[g] = sizes.get(g, 0) + 1
        assert max(sizes.values()) <= 2.5 * sv.MEMBERS and total <= entries
        rows.unpersist()


def test_blocks_meet_once():
    ids = np.arange(500)
    name = np.full(1000, 7)
    home = np.arange(1000) < 500
    row, group = sv._groups(ids, np.tile(ids, 2), name, home, (np.array([7]), np.array([3]), np.array([4])))
    stored, visits = (group & sv.STORED) > 0, (group & sv.VISITS) > 0
    base = group >> np.uint64(2)
    assert len(set(base.tolist())) == 12
    met = np.zeros((500, 500), int)
    for g in set(base.tolist()):
        own = base == g
        met[np.ix_(np.unique(row[own & stored]), np.unique(row[own & visits]))] += 1
    assert (met == 1).all()


def test_copies_and_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(sv, "MEMBERS", 20)  # makes every larger bucket a salted one
    rng = np.random.default_rng(4)
    same = rng.standard_normal(64).astype(np.float32).tolist()
    crowd = [(np.array(same) + 0.02 * rng.standard_normal(64)).astype(np.float32).tolist() for _ in range(60)]
    rows = [(i, same, 1) for i in range(100)] + [(1000 + i, v, 1) for i, v in enumerate(crowd)]
    near = sv.neighbours(sv.usable_vectors(vectors(spark, rows))).collect()
    by = {}
    for r in near:
        by.setdefault(r["id"], []).append((r["rank"], r["other"], r["cosine"]))
    assert set(by) == {i for i, _, _ in rows} and all([x[0] for x in sorted(v)] == [1, 2, 3, 4, 5] for v in by.values())
    assert [o for _, o, _ in sorted(by[50])] == [0, 1, 2, 3, 4] and [o for _, o, _ in sorted(by[2])] == [0, 1, 3, 4, 5]
    unit = np.array([v for _, v, _ in rows], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for i in range(0, 60, 7):
        best = np.sort(np.delete(unit @ unit[100 + i], 100 + i))[::-1][:5]
        assert np.allclose(sorted((c for _, _, c in by[1000 + i]), reverse=True), best, atol=1e-6)
    assert sv.neighbours(sv.usable_vectors(vectors(spark, []))).count() == 0


def test_nearest_has_no_floor(spark, monkeypatch):
    monkeypatch.setattr(sv, "STORED_BLOCK", 100)
    monkeypatch.setattr(sv, "QUERY_BLOCK", 30)
    points = crowds(5, 10, 4, 500)
    rows = [(i, p, 1) for i, p in enumerate(points)] + [(1000 + i, points[40], 1) for i in range(3)]
    usable = sv.usable_vectors(vectors(spark, rows))
    ids = [i for i, _, _ in rows]
    got = {}
    for r in sv.nearest(usable, usable.select("id").where("id % 4 = 0")).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["other"], r["cosine"]))
    unit = np.array([p for _, p, _ in rows], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert set(got) == {i for i in ids if i % 4 == 0}
    for k, i in enumerate(ids):
        if i in got:
            cosine = np.round(unit @ unit[k], 9)
            want = sorted((j for j in ids if j != i), key=lambda j: (-cosine[ids.index(j)], j))[:5]
            assert [o for _, o, _ in sorted(got[i])] == want
    assert sum(c < 0.6 for v in got.values() for _, _, c in v) > 100
    assert sv.nearest(usable.limit(0), usable).count() == 0 and sv.nearest(usable, usable.limit(0)).count() == 0


def test_vectors_are_coded_without_loss():
    rng = np.random.default_rng(11)
    v = rng.standard_normal((300, 64))
    mixed = np.concatenate([np.round(v[:50], 3), v[50:60], np.round(v[60:70], 6), np.zeros((1, 64)), np.full((1, 64), 40_000), np.full((1, 64), 1e30), np.full((1, 64), 1e-30)])
    for some in (np.round(v, 3), v, rng.permutation(mixed), v[:0]):
        for kind in (np.float32, np.float64):
            coded = sv.pack(some.astype(kind))
            assert sv.unpack(coded, 64).dtype == kind or not len(some)
            for part in (slice(0, None), slice(len(some) // 3, len(some) // 2)):
                assert np.array_equal(sv.unpack(coded[part], 64), some.astype(kind)[part])
    assert sv.pack(np.round(v, 3).astype(np.float32)).nbytes < 0.55 * v.astype(np.float32).nbytes


def test_copies_of_a_round_stay_bounded(spark, monkeypatch):
    """The copies that are on disk at once take a few times what the vectors take, and the rounds together have every entry once."""
    for name, value in (("ROUND_BYTES", 1), ("ROUND_SHARE", 4), ("OCCUPANCY", 60), ("MEMBERS", 300)):  # small buckets, and some cut into blocks
        monkeypatch.setattr(sv, name, value)
    points = np.array(crowds(12, 3, 150, 2000), np.float32)
    reps = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(sv.pack(points).to_pylist())], "id bigint, v binary").cache()
    weight = 1 + points[0].nbytes
    hasher = sv.Hasher(64, len(points))
    hot, visits = sv._crowded(reps, hasher, 64, len(points))
    assert len(hot[0])
    entries = lambda rows: [(r["id"], g) for r in rows for g in np.frombuffer(r["visits"], np.uint64).tolist()]
    parts, rounds = sv._rounds(len(points), visits, weight, 2)
    met, sizes = [], []
    for tables, tasks in rounds:
        rows = sv._entries(reps, hasher, 64, hot, parts, tables, tasks).collect()
        sizes.append(sum(len(r["visits"]) + len(r["v"]) + sv.ROW_BYTES for r in rows))
        assert {r["part"] for r in rows} <= set(range(len(tasks)))
        met += entries(rows)
    assert max(sizes) <= 1.5 * 4 * weight * len(points) < sum(sizes) / 3  # buckets aren't of one size
    assert sorted(met) == sorted(entries(sv._entries(reps, hasher, 64, hot, 4).collect()))


def test_rounds_change_no_neighbour(spark, monkeypatch):
    rows = [(i, p, 1) for i, p in enumerate(crowds(13, 30, 9, 1200))] + [(5000 + i, [0.125] * 64, 1) for i in range(8)]
    usable = sv.usable_vectors(vectors(spark, rows))
    once = sorted(map(tuple, sv.neighbours(usable).collect()))
    monkeypatch.setattr(sv, "ROUND_BYTES", 1)
    monkeypatch.setattr(sv, "ROUND_SHARE", 4)
    assert len(sv._rounds(1478, 1478 * 24, 257, 4)[1]) > 1
    assert sorted(map(tuple, sv.neighbours(usable).collect())) == once and len(once) > 1000
    kept = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert not [f for f in os.listdir(kept.removeprefix("file://")) if f.startswith("scratch-")]


def test_crowd_of_almost_equal_vectors(spark):
    rng = np.random.default_rng(8)
    points = (rng.standard_normal(64) + 0.01 * rng.standard_normal((1500, 64))).astype(np.float32)  # mean cosine 0.9999
    points = np.concatenate([points, (rng.standard_normal(64) + 0.001 * rng.standard_normal((300, 64))).astype(np.float32)])  # 0.999999
    near = sv.neighbours(sv.usable_vectors(vectors(spark, [(i, p.tolist(), 1) for i, p in enumerate(points)])))
    got = {(r["id"], r["other"]) for r in near.collect()}
    unit = points.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -2)
    want = {(i, j) for i in range(len(points)) for j in np.argsort(-cosine[i])[:5].tolist()}
    assert len(got) == len(want) and len(got & want) >= 0.99 * len(want)


def test_probe_order():
    sets = sv.probes(3, 10)
    assert sets[0] == [0] and len({tuple(s) for s in sets}) == 10 and all(5 - p not in s for s in sets for p in s)


WORDS = "the pump valve shelf report index review quiet warm needs before after next office station summary ledger crate".split()


def texts(seed, n):
    rng = random.Random(seed)
    base = [" ".join(f"{rng.choice(WORDS)}{rng.randint(1, 60) if rng.random() < 0.4 else ''}" for _ in range(rng.randint(80, 160))) for _ in range(n)]
    out = list(base)
    for t in base[: n // 3]:
        words = t.split()
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(words))
            words[k : k + rng.randint(0, 3)] = [rng.choice(WORDS) for _ in range(rng.randint(0, 3))]
        half = len(words) // 2
        out.append(" ".join(words[half:] + words[:half] if rng.random() < 0.3 else words))
        out.append(t.upper().replace(" ", " - "))
    return out


def brute_pairs(rows):
    sets = {}
    for i, t in rows:
        code = nd.normal_codes(t or "")
        if i is not None and len(code) >= 400:
            s = "".join(map(chr, code))
            sets[i] = {s[k : k + 8] for k in range(len(s) - 7)}
    keys = sorted(sets)
    return {(a, b) for k, a in enumerate(keys) for b in keys[k + 1 :] if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}


def test_copy_pairs(spark, monkeypatch):
    rows = [(f"s:{i}", t) for i, t in enumerate(texts(1, 150))] + [("null", None), ("short", "abc"), ("s:3", texts(1, 150)[3]), (None, texts(1, 150)[0]), ("", texts(1, 150)[7])]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "chunk_id string, content string, id string, copy_class string").repartition(3)
    want = brute_pairs(rows)
    got = [(r["chunk_id_a"], r["chunk_id_b"]) for r in nd.copy_pairs(df).collect()]
    assert len(want) > 80 and set(got) == want and len(got) == len(set(got))
    groups = {r["chunk_id"]: r for r in nd.copy_groups(df).collect()}
    assert len(groups) == len({i for i, t in rows if i is not None and t and len(nd.normal_codes(t)) >= 400})
    assert nd.copy_pairs(df.limit(0)).count() == 0
    monkeypatch.setattr(nd, "FEW", 0)  # texts by a shuffle instead of broadcast keys
    monkeypatch.setattr(nd, "LIST_BLOCK", 2)  # every list of three or more is cut into blocks
    assert {(r["chunk_id_a"], r["chunk_id_b"]) for r in nd.copy_pairs(df).collect()} == want


def test_insertions_into_a_hot_family(spark):
    rng = random.Random(6)
    words = lambda n: [f"{rng.choice(WORDS)}{rng.randint(1, 999)}" for _ in range(n)]
    base = words(160)
    family = [" ".join([*base[:k], *words(1), *base[k + 1 :]]) for k in range(0, 120, 3)]
    longer = []
    for _ in range(14):  # a member with a text of its own in it, which occurs in two rows
        own = [*base[:80], *words(94), *base[80:]]
        longer += [" ".join(own), " ".join([*own[:100], *words(1), *own[101:]])]
    rows = [(f"{i:03}", t) for i, t in enumerate(family + longer)]
    want = brute_pairs(rows)
    crossing = {p for p in want if p[0] < f"{len(family):03}" <= p[1]}
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "chunk_id string, content string, id string, copy_class string").repartition(3)
    got = {(r["chunk_id_a"], r["chunk_id_b"]) for r in nd.copy_pairs(df).collect()}
    assert len(crossing) > 500 and len(crossing & got) >= 0.99 * len(crossing) and got <= want


def test_lists_beyond_the_counters(spark):
    """A list of 70,000 records, more than a counter holds: it gets its true length, and no group grows beyond two blocks."""
    import pandas as pd

    n, rng = 70_000, np.random.default_rng(8)
    sig = rng.integers(0, 2**31, (n, nd.SLOTS + 2 * nd.SKETCH_WORDS), dtype=np.uint32) * np.uint32(2)
    sig[:, 5] = 4242
    sig[:, 10:40] = nd.NONE  # few grams, so that the long list is among those to be merged
    prints = spark.createDataFrame(pd.DataFrame({"name": rng.integers(-(2**62), 2**62, n), "signature": [r.tobytes() for r in sig]}), "name bigint, signature binary").repartition(4).cache()
    lengths = nd.list_lengths(prints)
    assert lengths.numbers.tolist() == [n] and lengths.long.tolist() == [5 << 32 | 4242]
    assert [x.tolist() for x in lengths.of(np.array([[5 << 32 | 4242]], np.uint64))] == [[[n]], [[18]]]
    sent = nd._postings(prints, spark.sparkContext.broadcast(lengths)).where(f"list = {5 << 32 | 4242}")
    groups = [r["count"] for r in sent.groupBy("part").count().collect()]
    assert len(groups) == 18 * 19 // 2 and max(groups) <= 2.2 * nd.LIST_BLOCK and sum(groups) == 18 * n
    prints.unpersist()


SCORES = "query_id bigint, chunk_id string, score double, text_score double, match_type string, served_at int, n string, points string"


@pytest.mark.parametrize("hot", [0, 10**9])
def test_borda(spark, monkeypatch, hot):
    monkeypatch.setattr(rank_fusion, "HOT_ROWS", hot)  # every query by ranges, or none
    nan = float("nan")
    data = [
        (1, "a", 0.9, 1e9, "exact_substring", 1), (1, "b", 0.8, 5.0, "Exact_Substring", 1), (1, "c", 0.8, None, None, 1), (1, "d", nan, 7.0, "fuzzy", 1), (1, "d", 0.1, 7.0, "fuzzy", 0),
        (1, "e", float("-inf"), 7.0, "FUZZY_TOKEN ", 1), (2, "x", None, None, None, 1), (2, "y", None, None, None, 1), (None, "q", 1.0, 1.0, None, 1), (3, None, 1.0, 1.0, None, 1), (4, "z", 0.5, -0.0, "odd", 1), (4, "zz", 0.5, 0.0, "odd", 1),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in data], SCORES)
    got = {(r["query_id"], r["chunk_id"]): r for r in rank_fusion.borda(df).collect()}
    assert set(got) == {(1, c) for c in "abcde"} | {(2, "x"), (2, "y"), (4, "z"), (4, "zz")}
    places = {"score": {"a": 1, "b": 2.5, "c": 2.5, "d": 3, "e": 4}, "text": {"a": 1, "b": 4, "c": 3, "d": 2.5, "e": 2.5}, "match": {"a": 1.5, "b": 1.5, "c": 3, "d": 3.5, "e": 3.5}}
    points = {c: (5 - places["score"][c]) + (5 - places["text"][c]) + 0.5 * (5 - places["match"][c]) for c in "abcde"}
    for c in "abcde":
        assert math.isclose(got[1, c]["points"], points[c])
    order = sorted("abcde", key=lambda c: (-points[c], c))
    assert [got[1, c]["position"] for c in order] == [1, 2, 3, 4, 5]
    assert got[2, "x"]["position"] == 1 and got[2, "x"]["points"] == got[2, "y"]["points"] and got[4, "z"]["position"] == 1
    assert got[1, "d"]["score_rank"] is None
    assert {(r["query_id"], r["chunk_id"]) for r in rank_fusion.front_items(rank_fusion.borda(df)).collect()} == {(1, "a"), (4, "z"), (4, "zz")}
    assert rank_fusion.borda(df.limit(0)).count() == 0


CHUNKS = "chunk_id string, doc_id bigint, start_offset int, content string, option_id int, indexed_at int, piece string, end_offset string"


def brute_cuts(text, size, lap, marks):
    grades = []
    for p in range(len(text) + 1):
        before, after = text[:p], text[p : p + 1]
        word = bool(before) and before[-1].isspace() and bool(after) and not after.isspace()
        g = 0
        if word:
            g = 1
            if before[-1] == "\n":
                g = 2
            if len(before) > 1 and before[-2] in ".!?…؟।॥":
                g = 3
            if before.endswith("\n\n"):
                g = 4
        if before and before[-1] in "。！？．" and after and after not in "。！？．":
            g = max(g, 3)
        if p in marks and 0 < p < len(text):
            g = 5
        grades.append(g)
    cuts, end, start = [], 0, 0
    while end < len(text):
        limit = start + size
        if limit >= len(text):
            end = len(text)
        else:
            window = [p for p in range(max(end, start + size // 2) + 1, limit + 1) if grades[p]]
            before = [p for p in range(end + 1, limit + 1) if grades[p]]
            end = max(window, key=lambda p: (grades[p], p)) if window else max(before, default=limit)
        cuts.append(end)
        start = end - lap
    return cuts


def test_cuts_equal_a_greedy_walk():
    rng = random.Random(9)
    for _ in range(150):
        parts = [rng.choice(["word", "a", "Long_unbroken" * rng.randint(1, 4), ".", "。", "\n", "\n\n", " ", "é😀", "! "]) for _ in range(rng.randint(5, 80))]
        text = " ".join(parts) + "x"
        size = rng.randint(1, 60)
        lap = rng.randint(0, size // 2)
        marks = sorted(rng.sample(range(len(text) + 5), 3))
        got = split_oversized.cut_positions(["filler text here", text], np.array([5, size]), np.array([1, lap]), [[], marks])
        assert got[1].tolist() == brute_cuts(text, size, lap, marks), (text, size, lap, marks)


def test_split(spark):
    text = "One two three. " * 20
    rows = [("a", 1, 100, text, 1, 1), ("a", 1, 100, text, 1, 2), ("b", 1, 0, "short", 1, 1), ("c", 1, 0, None, 1, 1), ("d", 1, 0, text, 9, 1), ("e", 1, None, text, 2, 1), ("f", 1, 0, "y" * 5000, 3, 1), ("g", 1, 0, text, None, 1), ("h", None, 0, text, 1, 1)]
    chunks = spark.createDataFrame([(*r, "x", "y") for r in rows], CHUNKS)
    bounds = spark.createDataFrame([(1, 140), (1, 140), (1, 5), (1, None), (None, 3)], "doc_id bigint, start_offset int")
    options = spark.createDataFrame([(1, 50, 10, 60), (2, 500, 500, 80), (3, 0, None, 90), (9, 10, 1, None), (None, 1, 1, 1)], "option_id int, chunk_size int, chunk_overlap int, max_chunk_size int")
    got = {}
    for r in split_oversized.split_oversized(chunks, bounds, options).collect():
        got.setdefault(r["chunk_id"], []).append(r)
    source = {r[0]: r[3] for r in rows}
    assert set(got) == {"a", "e", "f", "h"} and got["a"][0]["n_pieces"] == len(got["a"])
    for key, size, lap in (("a", 50, 10), ("e", 80, 40), ("f", 90, 0), ("h", 50, 10)):
        pieces = sorted(got[key], key=lambda r: r["piece"])
        assert all(len(p["content"]) <= size and p["content"] == source[key][p["start_offset"] : p["end_offset"]] for p in pieces)
        assert pieces[0]["content"] + "".join(p["content"][lap:] for p in pieces[1:]) == source[key]
        assert all(b["start_offset"] == a["end_offset"] - lap for a, b in zip(pieces, pieces[1:]))
    assert 40 in {p["end_offset"] for p in got["a"]} and 40 not in {p["end_offset"] for p in got["h"]}
    ids = split_oversized.oversized_ids(split_oversized.split_oversized(chunks, bounds, options)).collect()
    assert sorted(r["chunk_id"] for r in ids) == ["a", "e", "f", "h"]
    assert split_oversized.split_oversized(chunks.limit(0), bounds, options).count() == 0 and split_oversized.split_oversized(chunks, bounds.limit(0), options).where(F.col("chunk_id") == "a").count() > 0


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_catalogue(spark):
    import duckdb

    from corpusloom.llm import catalogue

    db = duckdb.connect()
    for name in os.listdir(DATA):
        db.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    for name, query in catalogue.queries().items():
        df = query(spark, DATA)
        columns = sorted(df.columns)
        rows = sorted(tuple(map(repr, (r[c] for c in columns))) for r in df.collect())
        assert rows, name
        if sql := catalogue.oracle_sql().get(name):
            found = db.execute(sql)
            at = [x[0] for x in found.description]
            assert rows == sorted(tuple(repr(r[at.index(c)]) for c in columns) for r in found.fetchall()), name
