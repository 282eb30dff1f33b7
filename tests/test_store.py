import json
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import ratio
from corpusloom.operators import search, structure
from corpusloom.schema import BOUNDARY
from corpusloom.sources import files
from corpusloom.sources.store import Store, postings

ODD = ["a:b", "50%", "k=v", "x/y", "ünï code", "bucket=3"]


def rows(spark, names, text="words of it"):
    chunks = spark.createDataFrame([(n,) for n in names], "source string").select(
        F.concat("source", F.lit(":0")).alias("chunk_id"), F.lit(0).alias("position"), F.lit(1).alias("total_chunks"), F.lit(text).alias("content"), F.lit(3).alias("token_count"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("boundary_type", "string"), ("boundary_id", "string"), ("boundary_level", "int"), ("parent_boundary", "string"), ("boundary_title", "string"), ("page", "int"), ("section", "string"), ("sheet", "string"), ("slide", "int"))], "source",
    )
    docs = chunks.select("source", F.col("source").alias("path"), F.lit("text").alias("file_type"))
    none = spark.createDataFrame([], BOUNDARY[7:-1].replace(":", " ").replace(",", ", ") + ", source string")
    return docs, chunks, none, lambda c: c.select("chunk_id", "source", F.array(F.lit(1.0).cast("float")).alias("embedding"))


def test_many_sources_in_few_folders(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    names = [f"s{i}" for i in range(10_000)] + ODD
    store.save(*rows(spark, names))
    assert store.read("manifest").count() == len(names) == store.read("vectors").count()
    assert len(list((tmp_path / "chunks").glob("gen=*/bucket=*"))) <= 64 and len(list((tmp_path / "chunks").rglob("*.parquet"))) <= 128
    for name in ODD:
        assert [r["source"] for r in store.read("chunks", name).collect()] == [name]
        assert len({f.rpartition("bucket=")[2].partition("/")[0] for f in store.read("chunks", name).inputFiles()}) == 1
        store.save(*rows(spark, [name], "other text"))
        assert [r["content"] for r in store.read("chunks", name).collect()] == ["other text"]
    store.drop("k=v")
    for t in ("chunks", "vectors", "words", "manifest"):
        assert store.read(t).where("source = 'k=v'").count() == 0
    assert store.read("chunks").count() == len(names) - 1 and store.read("words", "50%").select("word").distinct().count() == 2


def test_one_commit_point(spark, tmp_path):
    store = Store(spark, str(tmp_path), 4)
    store.save(*rows(spark, ["a", "b"]))
    before = store.read("chunks")
    docs, chunks, bounds, embed = rows(spark, ["a", "c"], "new")

    def broken(_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.save(docs, chunks, bounds, broken)
    assert {r["content"] for r in store.read("chunks").collect()} == {"words of it"} and store.read("manifest").count() == 2
    store.save(docs, chunks, bounds, embed)
    assert {(r["source"], r["content"]) for r in store.read("chunks").collect()} == {("a", "new"), ("b", "words of it"), ("c", "new")}
    assert before.count() == 2  # a reader keeps the generation it began with
    stale = store._state(1)
    with pytest.raises(Exception, match="exists"):
        store._commit(stale)
    for _ in range(3):
        store.save(docs, chunks, bounds, embed)
    assert len(list((tmp_path / "_commits").glob("[0-9]*.json"))) == 2 and len(list((tmp_path / "chunks").iterdir())) <= 5
    state = json.loads(sorted((tmp_path / "_commits").glob("[0-9]*.json"))[-1].read_text())
    assert state["buckets"] == 4 and Store(spark, str(tmp_path), 9)._state()["buckets"] == 4


def test_line_ends(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"First line.\r\n# Head\rmore\n")
    assert files.load_documents(spark, str(tmp_path)).first()["content"] == "First line.\n# Head\nmore\n"


def test_structure_is_linear(spark):
    def seconds(n):
        text = "\n".join(f"[Page {i}]\nSome words on a page, number {i}." for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id int, text string")
        began = time.time()
        assert structure.regions(structure.detect(df), ["doc_id"]).count() == n
        return time.time() - began

    seconds(100)
    small = min(seconds(4000) for _ in range(2))
    assert min(seconds(8000) for _ in range(2)) <= 2.3 * small + 0.2


def test_could_match_is_a_bound(spark):
    words = ["register", "reguister", "maintenance", "maintenence", "shift", "shit", "aab", "aba", "abc", "cba", "ends", "end", "", "a"]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in pairs.withColumn("could", search.could_match(F.col("a"), F.col("b"))).collect():
        if ratio(r["a"], r["b"]) >= 0.8 and r["a"] and r["b"]:
            assert r["could"], r


def test_postings_give_the_same_hits(spark):
    chunks = spark.createDataFrame([("a", "s", "The pump needs oil"), ("b", "s", "pumps and oils"), ("c", "t", None), ("d", "t", "")], "chunk_id string, source string, content string")
    key = lambda df: sorted((r["chunk_id"], round(r["text_score"], 6), r["match_type"]) for r in df.collect())
    assert key(search.text_search(chunks, "pump oil")) == key(search.text_search(chunks, "pump oil", words_of=postings(chunks))) != []
