import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.plans import corpus
from corpusloom.plans.ranking import competition_ranks, positions
from corpusloom.runtime import shared_dir, text_slices


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    data = [(0 if rng.random() < 0.6 else rng.randint(1, 9), rng.choice([0.5, 1.0, 1.5, float("inf"), -3.0, rng.random()]), i) for i in range(800)]
    return data, spark.createDataFrame(data, "g int, v double, id int").repartition(5)


def test_positions(rows):
    data, df = rows
    got = {r["id"]: r["n"] for r in positions(df, ["g"], [F.col("v").desc(), F.col("id")], "n").collect()}
    for g in range(10):
        own = sorted((x for x in data if x[0] == g), key=lambda x: (-x[1], x[2]))
        assert [got[x[2]] for x in own] == list(range(1, len(own) + 1))


def test_competition_ranks(rows):
    data, df = rows
    got = {(r["g"], r["v"]): (r["r"], r["t"]) for r in competition_ranks(df, ["g"], "v", "r", "t").collect()}
    for g in range(10):
        own = Counter(v for h, v, _ in data if h == g)
        assert {v: (1 + sum(n for w, n in own.items() if w > v), own[v]) for v in own} == {v: x for (h, v), x in got.items() if h == g}


def test_empty(spark, rows):
    none = rows[1].limit(0)
    assert positions(none, ["g"], [F.col("id")], "n").count() == 0 and competition_ranks(none, ["g"], "v", "r", "t").count() == 0


def test_shared_dir(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir") and spark.sparkContext.getCheckpointDir()


def test_text_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["aa", None, "bbbbbbbb", "c", "", "dd"])], names=["k", "t"])
    parts = [p.column(0).to_pylist() for p in text_slices(batch, 1, rows=3, size=4)]
    assert parts == [[0, 1], [2], [3, 4, 5]] and [p.num_rows for p in text_slices(batch, 1, rows=4, size=100)] == [4, 2]
    assert list(text_slices(batch.slice(0, 0), 1)) == []


def test_latest_wins(spark, tmp_path):
    cols = "doc_id bigint, source string, ord int, boundary_id string, type string, level int, title string, start_offset int, parent_id string, indexed_at timestamp"
    rows = spark.sql("select 1L, 's', 0, 'a', 'page', 4, 'old', 0, cast(null as string), timestamp'2024-01-01' union all select 1L, 's', 0, 'a', 'page', 4, 'new', 0, null, timestamp'2024-01-02' union all select null, 's', 0, 'a', 'page', 4, 'x', 0, null, timestamp'2024-01-02'")
    spark.createDataFrame(rows.rdd, cols).write.parquet(str(tmp_path / "boundaries.parquet"))
    assert [r["title"] for r in corpus.boundaries(spark, str(tmp_path)).collect()] == ["new"]


def test_wide_rows_stay_unless_repeated(spark, tmp_path, monkeypatch):
    rows = [("a", "x", 1), ("a", "y", 2), ("b", "z", 1), (None, "q", 1)]
    spark.createDataFrame(rows, "chunk_id string, content string, indexed_at int").write.parquet(str(tmp_path / "chunks.parquet"))
    for few in (10, 0):
        monkeypatch.setattr(corpus, "FEW", few)
        got = corpus.chunks(spark, str(tmp_path), ["chunk_id", "content"]).collect()
        assert sorted((r["chunk_id"], r["content"]) for r in got) == [("a", "y"), ("b", "z")]
