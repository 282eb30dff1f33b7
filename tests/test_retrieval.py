import difflib
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import content, hierarchy, search, vectors

KEYS = ["source"]
BOUNDS = [
    ("s", 0, "chapter", 1, "chapter:1", "Introduction", 0, None), ("s", 1, "page", 4, "page:1", "1", 5, "chapter:1"), ("s", 2, "section", 2, "section:1", "Background", 30, "chapter:1"),
    ("s", 3, "page", 4, "page:2", "2", 40, "section:1"), ("s", 4, "subsection", 3, "subsection:1", "Details", 50, "section:1"), ("s", 5, "section", 2, "section:2", "Methods", 60, "chapter:1"), ("s", 6, "chapter", 1, "chapter:2", "Results", 90, None),
]
OWN = ["chapter:1"] * 3 + ["section:1"] * 2 + ["subsection:1"] + ["section:2"] * 2 + ["chapter:2"] * 2


@pytest.fixture(scope="module")
def store(spark):
    chunks = spark.createDataFrame([(f"s:{i}", "s", i, f"Content {i}.", 15, b, 1 + i // 4) for i, b in enumerate(OWN)], "chunk_id string, source string, position int, content string, token_count int, boundary_id string, page int")
    bounds = spark.createDataFrame(BOUNDS, "source string, ord int, type string, level int, boundary_id string, title string, start_offset int, parent_id string")
    return chunks, bounds


def test_toc(store):
    chunks, bounds = store
    rows = [r.asDict() for r in hierarchy.toc(bounds, chunks, KEYS).collect()]
    by = {r["boundary_id"]: r for r in rows}
    assert set(by) == {"chapter:1", "section:1", "subsection:1", "section:2", "chapter:2"}
    assert (by["chapter:1"]["chunk_count"], by["chapter:1"]["total_chunks"], by["section:1"]["total_chunks"]) == (3, 8, 3)
    assert by["subsection:1"]["page"] == 2 and by["chapter:1"]["page"] is None
    tree = hierarchy.toc_tree(rows)
    assert [e["boundary_id"] for e in tree] == ["chapter:1", "chapter:2"] and hierarchy.toc_size(tree) == 5 and "children" not in tree[1]
    assert {r["boundary_id"] for r in hierarchy.toc(bounds, chunks, KEYS, 1).collect()} == {"chapter:1", "chapter:2"}
    shallow = hierarchy.toc(bounds.where("boundary_id <> 'chapter:1'"), chunks, KEYS).where("boundary_id = 'section:1'").first()
    assert shallow["parent_id"] is None


def test_closure(store):
    _, bounds = store
    at = {r["boundary_id"]: r["ancestor_id"] for r in hierarchy.ancestor_at_level(bounds, KEYS, 2).collect()}
    assert at["subsection:1"] == "section:1" and at["section:2"] == "section:2" and at["chapter:1"] is None
    near = {(r["boundary_id"], r["sibling_id"]) for r in hierarchy.siblings(bounds, KEYS).collect()}
    assert ("section:1", "section:2") in near and not any(a.startswith("chapter") for a, _ in near)


def test_content(store):
    chunks, bounds = store
    whole = content.by_boundary(chunks, bounds, KEYS, "chapter:1").first()
    assert (whole["chunk_count"], whole["total_tokens"], whole["truncated"]) == (8, 120, False) and whole["content"].startswith("Content 0.\n\nContent 1.")
    assert content.by_boundary(chunks, bounds, KEYS, "chapter:1", False).first()["chunk_count"] == 3
    short = content.by_boundary(chunks, bounds, KEYS, "chapter:1", budget=30).first()
    assert (short["total_tokens"], short["truncated"], short["chunk_count"]) == (30, True, 8)
    assert content.by_boundary(chunks, bounds, KEYS, "chapter:1", budget=1).first()["content"] == "Content 0."
    assert content.by_boundary(chunks, bounds, KEYS, "none").first() is None
    assert content.by_pages(chunks, KEYS, 1, 2).first()["chunk_count"] == 8 and content.by_pages(chunks, KEYS, 99, 99).first() is None
    assert content.by_positions(chunks, KEYS, 2, 4).first()["chunk_count"] == 3
    assert content.by_title(chunks, bounds, KEYS, "backgroud").first()["boundary_id"] == "section:1"
    assert content.title_match(bounds, KEYS, "zzzzqqqq").first() is None
    assert content.title_match(bounds, KEYS, "methods", "chapter").first() is None or content.title_match(bounds, KEYS, "methods", "chapter").first()["type"] == "chapter"
    assert [r["chunk_id"] for r in content.get_chunks(chunks, ["s:5", "s:x", "s:1"]).collect()] == ["s:5", "s:1"]
    assert content.sources(chunks).first()["chunks"] == 10


def test_latest_rows(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (None, 9, "c"), (2, None, "d")], "k int, at int, v string")
    assert {(r["k"], r["v"]) for r in content.latest_rows(rows, ["k"], "at").collect()} == {(1, "b"), (2, "d")}


def test_neighbours_and_context(spark, store):
    chunks, _ = store
    other = spark.createDataFrame([("t:0", "t", 4, "other", 1, None, 1)], chunks.schema)
    near = vectors.with_neighbours(chunks.union(other), spark.createDataFrame([("s:0",), ("s:5",)], "chunk_id string"), 2)
    assert {(r["target_id"], r["chunk_id"]) for r in near.collect()} == {("s:0", "s:1"), ("s:0", "s:2"), ("s:5", "s:3"), ("s:5", "s:4"), ("s:5", "s:6"), ("s:5", "s:7")}
    ctx = {r["chunk_id"]: r for r in search.context(chunks.union(other), KEYS).collect()}
    assert ctx["s:0"]["before"] is None and ctx["s:0"]["after"] == "Content 1." and ctx["t:0"]["after"] is None
    assert spark.range(1).select(tx.snippet(F.lit("x" * 101)).alias("s")).first()["s"] == "x" * 100 + "..."


def test_vectors(spark):
    rows = [("a", "x", [1.0, 0.0]), ("b", "x", [0.0, 2.0]), ("c", "y", [1.0, 1.0]), ("d", "y", [0.0, 0.0]), ("e", "y", None), ("f", "y", [1.0]), ("g", "y", [float("nan"), 1.0])]
    v = spark.createDataFrame(rows, "chunk_id string, source string, embedding array<float>")
    got = [(r["chunk_id"], round(r["semantic_score"], 4)) for r in vectors.nearest(v, [1.0, 0.0], 10).collect()]
    assert got == [("a", 1.0), ("c", 0.8536), ("b", 0.5)]
    assert len(vectors.nearest(v, [1.0, 0.0], 1).collect()) == 1 and vectors.nearest(v.limit(0), [1.0, 0.0]).count() == 0
    assert {r["chunk_id"] for r in vectors.nearest_per_source(v, [1.0, 0.0], 1).collect()} == {"a", "c"}
    emb = spark.createDataFrame([("one two",), ("",), (None,)], "t string").select(vectors.hash_embedding(F.col("t"), 16).alias("v")).collect()
    assert abs(sum(x * x for x in emb[0]["v"]) - 1) < 1e-5 and sum(emb[1]["v"]) == 0 and emb[2]["v"] is None


def test_devices(monkeypatch):
    monkeypatch.delenv("ONNX_PROVIDER", raising=False)
    cpu, cuda, coreml = "CPUExecutionProvider", "CUDAExecutionProvider", "CoreMLExecutionProvider"
    assert vectors.onnx_providers([cpu]) == [cpu] and vectors.onnx_providers([cpu, coreml, cuda]) == [cuda, cpu] and vectors.onnx_providers([cpu, cuda], "cpu") == [cpu]
    monkeypatch.setenv("ONNX_PROVIDER", "coreml")
    assert vectors.onnx_providers([cpu]) == [cpu] and vectors.onnx_providers([cpu, coreml, cuda]) == [coreml, cpu] and [vectors.default_batch_size(p) for p in (cuda, coreml, cpu)] == [128, 64, 8]


TEXTS = ["Revenue growth was strong this quarter", "The weather is nice", "Gardening needs revenue of patience", "", None, "REVENUE", "growht of revenue"]


def fuzzy_brute(query, text):
    words = [w for w in re.findall(r"\w+", query.lower()) if w not in tx.STOP_WORDS] or re.findall(r"\w+", query.lower())
    have = set(re.findall(r"\w+", (text or "").lower()))
    ok = lambda q, w: q == w or (abs(len(q) - len(w)) <= 0.4 * max(len(q), len(w)) and difflib.SequenceMatcher(None, q, w).ratio() >= 0.8)
    return 0.75 * sum(any(ok(q, w) for w in have) for q in words) / len(words)


def test_text_search(spark):
    chunks = spark.createDataFrame([(f"c{i}", "s", t) for i, t in enumerate(TEXTS)], "chunk_id string, source string, content string")
    for query in ("revenue growth", "the revenue of revenue", "revenue", "the of"):
        got = {r["chunk_id"]: (round(r["text_score"], 6), r["match_type"]) for r in search.text_search(chunks, query).collect()}
        for i, t in enumerate(TEXTS):
            low = (t or "").lower()
            exact = 0.85 + 0.15 * min(len(query) / max(len(low), 1), 1) if query in low else 0.0
            fuzzy = fuzzy_brute(query, t)
            best = max(exact, fuzzy)
            want = (round(best, 6), "exact_substring" if exact >= fuzzy else "fuzzy_token") if best >= 0.3 else None
            assert got.get(f"c{i}") == want, (query, t)
    assert search.text_search(chunks, "  ").count() == 0


def test_merge(spark):
    sem = spark.createDataFrame([("a", 0.9), ("b", 0.5)], "chunk_id string, semantic_score double")
    hits = lambda rows: spark.createDataFrame(rows, "chunk_id string, text_score double, match_type string")
    none = {r["chunk_id"]: r["score"] for r in search.merge_scores(sem, hits([]), 5).collect()}
    assert none == {"a": 0.9, "b": 0.5}
    few = {r["chunk_id"]: r for r in search.merge_scores(sem, hits([("c", 0.9, "exact_substring"), ("b", 0.4, "fuzzy_token")]), 5).collect()}
    w = 0.5 * 0.65
    assert few["c"]["score"] == 0.8 and abs(few["b"]["score"] - ((1 - w) * 0.5 + w * 0.4)) < 1e-9 and few["a"]["text_score"] is None
    many = hits([(f"t{i}", 0.5, "fuzzy_token") for i in range(11)])
    assert abs(search.merge_scores(sem, many, 1).first()["score"] - 0.81) < 1e-9


def test_expand(store):
    chunks, bounds = store
    hit = chunks.where("chunk_id = 's:5'").select("source", "chunk_id", "boundary_id")
    row = search.expand(hit, chunks, bounds, KEYS, "section", 1000).first()
    assert (row["expanded_id"], row["chunk_count"], row["expanded_tokens"]) == ("section:1", 3, 45)
    row = search.expand(hit, chunks, bounds, KEYS, "section", 60, True).first()
    assert row["expanded_tokens"] == 60 and row["expanded_content"].endswith("\n\n---\n\nContent 6.")
    assert search.expand(hit, chunks, bounds, KEYS, "section", 10).first()["expanded_tokens"] == 15
    lone = chunks.where("chunk_id = 's:8'").select("source", "chunk_id", "boundary_id")
    assert search.expand(lone, chunks, bounds, KEYS, "section", 1000).first()["expanded_id"] == "chapter:2"
    free = hit.withColumn("boundary_id", F.lit(None).cast("string"))
    assert search.expand(free, chunks, bounds, KEYS, "section", 1000).first()["expanded_content"] is None
    rows = chunks.withColumn("score", F.lit(1.0) - F.col("position") * 0.01)
    assert search.within_budget(rows, 31).count() == 3


def test_vector_index(spark, tmp_path):
    import numpy as np

    from corpusloom.operators.ann import VectorIndex

    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 32))
    points = np.concatenate([c + 0.35 * rng.standard_normal((60, 32)) for c in centres]).astype(np.float32)
    rows = [(f"c{i:05}", f"s{i % 7}", p.tolist()) for i, p in enumerate(points)] + [("n", "s0", None), ("z", "s0", [0.0] * 32), ("x", "s0", [float("nan")] * 32), ("l", "s0", [1.0])]
    df = spark.createDataFrame(rows, "chunk_id string, source string, embedding array<float>")
    index = VectorIndex.load(spark, VectorIndex.build(df, str(tmp_path / "ann")).path)
    assert len(index.centres) == 49 and index.pool(points[0].tolist(), 49).count() == len(points)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    hits = 0
    for i in range(0, len(points), 240):
        got = {r["chunk_id"] for r in index.search(points[i].tolist(), 10, 6).collect()}
        hits += len(got & {f"c{j:05}" for j in np.argsort(-(unit @ unit[i]))[:10]})
    assert hits >= 0.9 * 10 * len(range(0, len(points), 240))
    files = index.pool(points[0].tolist(), 3).inputFiles()
    exact = [r["chunk_id"] for r in vectors.nearest(df, points[5].tolist(), 10).collect()]
    assert [r["chunk_id"] for r in index.search(points[5].tolist(), 10, 49).collect()] == exact and files
    empty = VectorIndex.build(df.limit(0), str(tmp_path / "none"))
    assert VectorIndex.load(spark, empty.path).search([1.0] * 32).count() == 0
