import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.packing import BpeCounter, count_signs, pack, split_sentences, tail
from corpusloom.operators.chunking import chunk_documents
from corpusloom.schema import ChunkOptions

SMALL = ChunkOptions(32, 8, 64, 16)


def sample(seed, n):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "Dr.", "e.g.", "gamma!", "Delta?", "x.", "Yes.", "```a. B\nc```", "\n\n", "é", "Mr. Who", "end. "]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_native_and_row_local_sentences_agree(spark):
    texts = [*sample(1, 200), "", "  \n ", "One. Two! three? Four", "A. B"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string").select("k", tx.sentences(F.col("t")).alias("s"), tx.token_count(F.col("t")).alias("n"))
    for r in rows.collect():
        assert r["s"] == split_sentences(texts[r["k"]])
        assert r["n"] == count_signs(texts[r["k"]])
    assert spark.range(1).select(tx.sentences(F.lit(None).cast("string")).alias("s")).first()["s"] is None


def test_bpe_counter(spark, tmp_path):
    import base64
    import pickle

    ranks = tmp_path / "v.tiktoken"
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abc"]
    ranks.write_text("\n".join(f"{base64.b64encode(t).decode()} {i}" for i, t in enumerate(tokens)))
    count = pickle.loads(pickle.dumps(BpeCounter(str(ranks))))
    assert count("abcab") == 2 and count("") == 0
    rows = spark.createDataFrame([(1, "abc. Abab")], "doc_id int, text string")
    assert chunk_documents(rows, count=BpeCounter(str(ranks))).first()["token_count"] == count("abc. Abab")


def test_options():
    for bad, word in ((ChunkOptions(31), "at least 32"), (ChunkOptions(64, 64), "less than"), (ChunkOptions(64, 8, 63, 8), "max_chunk_size"), (ChunkOptions(64, 8, 64, 65), "min_chunk_size")):
        with pytest.raises(ValueError, match=word):
            bad.validate()


def test_tail():
    units = [("a", 5), ("b", 5), ("c", 9)]
    assert tail(units, 0) == [] and tail(units, 8) == [("c", 9)] and tail(units, 14) == units[1:] and tail([], 5) == []


def test_pack_invariants():
    for text in sample(2, 200):
        units = split_sentences(text)
        got = pack(text, SMALL)
        assert bool(units) == bool(got)
        for content, n in got[:-1]:
            assert n <= SMALL.chunk_size + SMALL.max_chunk_size and content
        joined = " ".join(c for c, _ in got)
        assert all(u in joined for u in units)
        if got:
            assert got[-1][1] == count_signs(got[-1][0]) or got[-1][1] > SMALL.max_chunk_size


def test_oversized_sentence_stands_alone():
    big = "word " * 100
    got = pack(f"Small one. {big.strip().capitalize()}. Next one here.", SMALL)
    assert any(n > SMALL.max_chunk_size for _, n in got)


def test_chunk_documents(spark):
    text = "Lead in.\n# A\nBody one. Body two.\n[Page 7]\nOn page. More.\n## B\nLast."
    rows = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "  ", "x"), (4, "Plain. Text.", "x")], "doc_id int, text string, content string")
    got = sorted(chunk_documents(rows).collect(), key=lambda r: (r["doc_id"], r["position"]))
    assert [(r["chunk_id"], r["boundary_id"], r["page"], r["total_chunks"]) for r in got] == [
        ("1:0", None, None, 4), ("1:1", "chapter:1", None, 4), ("1:2", "page:1", 7, 4), ("1:3", "section:1", 7, 4), ("4:0", None, None, 1),
    ]
    assert chunk_documents(rows.limit(0)).count() == 0


def test_sheet_and_slide_fields(spark):
    from corpusloom.operators.chunking import chunk_rows

    bounds = [
        {"ord": 0, "type": "sheet", "level": 1, "boundary_id": "sheet:1", "title": "S", "start_offset": 0, "parent_id": None},
        {"ord": 1, "type": "row_group", "level": 2, "boundary_id": "sheet:1:rows:2-3", "title": "S rows 2-3", "start_offset": 4, "parent_id": "sheet:1"},
        {"ord": 2, "type": "slide", "level": 1, "boundary_id": "slide:5", "title": "T", "start_offset": 8, "parent_id": None},
    ]
    got = chunk_rows("d", "aaa bbb ccc", bounds, ChunkOptions(), count_signs)
    assert [(r[-2], r[-1]) for r in got] == [("S", None), ("S", None), (None, 5)]
