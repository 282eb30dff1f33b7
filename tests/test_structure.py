import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import structure as st
from corpusloom.schema import BOUNDARY


def found(spark, text, loader=None):
    row = spark.createDataFrame([(1, text, loader)], f"k int, text string, loader array<{BOUNDARY}>")
    return st.detect(row, loader="loader" if loader is not None else None).first()["boundaries"]


@pytest.mark.parametrize(
    ("line", "kind", "level", "title"),
    [
        ("# T one", "chapter", 1, "T one"), ("## T", "section", 2, "T"), ("### T", "subsection", 3, "T"), ("#### T", "subsection", 4, "T"), ("[Page 3]", "page", 4, "3"),
        ("--- page 4 ---", "page", 4, "4"), ("Chapter IV: Go", "chapter", 1, "Go"), ("CHAPTER 2", "chapter", 1, None), ("1 Overview", "chapter", 1, "Overview"), ("1.2 Part", "section", 2, "Part"),
        ("1.2.3 Piece", "subsection", 3, "Piece"), ("GENERAL TERMS", "section", 2, "GENERAL TERMS"), ("[Sheet: A b]", "sheet", 1, "A b"), ("[Slide 2: Hi]", "slide", 1, "Hi"), ("[Rows 2-9]", "row_group", 2, "2-9"),
    ],
)
def test_patterns(spark, line, kind, level, title):
    (b,) = found(spark, f"text\n  {line} \nmore")
    assert (b["type"], b["level"], b["title"], b["start_offset"]) == (kind, level, title, 5)


def test_no_boundaries(spark):
    for line in ("ABC", "Intro ..... 4", "42 | Intro", "| cell", "123 Too many", "##### five", "7 not a title", ""):
        assert found(spark, line) == []
    assert found(spark, None) is None


def test_hierarchy_and_ids(spark):
    got = found(spark, "# A\n## B\n### C\n## D\n[Page 2]\n# E")
    assert [(b["boundary_id"], b["parent_id"]) for b in got] == [("chapter:1", None), ("section:1", "chapter:1"), ("subsection:1", "section:1"), ("section:2", "chapter:1"), ("page:1", "section:2"), ("chapter:2", None)]


def test_parents_equal_a_stack(spark):
    rng = random.Random(7)
    marks = {1: "# x", 2: "## x", 3: "### x", 4: "#### x"}
    texts = [[rng.choice((1, 2, 3, 4)) for _ in range(rng.randint(0, 40))] for _ in range(60)]
    rows = spark.createDataFrame([(i, "\n".join(marks[v] for v in t)) for i, t in enumerate(texts)], "k int, text string")
    got = {r["k"]: r["boundaries"] for r in st.detect(rows).collect()}
    for k, levels in enumerate(texts):
        stack, want = [], []
        for level, b in zip(levels, got[k]):
            while stack and stack[-1][0] >= level:
                stack.pop()
            want.append(stack[-1][1] if stack else None)
            stack.append((level, b["boundary_id"]))
        assert [b["parent_id"] for b in got[k]] == want


def test_prune(spark):
    assert found(spark, "\n".join(["# c"] * 101 + ["## s"] * 3)) and {b["type"] for b in found(spark, "\n".join(["# c"] * 101 + ["## s"] * 3))} == {"section"}
    assert len(found(spark, "\n".join(["# c"] * 100))) == 100


def test_loader_types_are_skipped_and_adopt(spark):
    loader = [(0, "slide", 1, "slide:1", "Hi", 0, None), (1, "page", 4, "page:2", "2", 20, None)]
    got = found(spark, "[Slide 1: Hi]\n## In it\n[Page 9]\n## Later", loader)
    assert [(b["boundary_id"], b["parent_id"]) for b in got] == [("slide:1", None), ("section:1", "slide:1"), ("page:2", None), ("section:2", "slide:1")]
    assert [b["ord"] for b in got] == [0, 1, 2, 3]


def test_regions_and_lookup(spark):
    rows = st.detect(spark.createDataFrame([(1, "lead\n# A\nbody\n# B"), (2, "  "), (3, None), (4, "plain")], "k int, text string"))
    got = sorted((r["k"], r["region"], r["boundary_id"], r["content"]) for r in st.regions(rows, ["k"]).collect())
    assert got == [(1, 0, None, "lead"), (1, 1, "chapter:1", "# A\nbody"), (1, 2, "chapter:2", "# B"), (4, 0, None, "plain")]
    points = spark.createDataFrame([(1, o) for o in (0, 5, 13, 99)] + [(4, 0)], "k int, offset int")
    at = st.boundary_at(points, st.boundary_rows(rows, ["k"]), ["k"])
    assert sorted((r["k"], r["offset"], r["boundary_id"]) for r in at.collect()) == [(1, 0, None), (1, 5, "chapter:1"), (1, 13, "chapter:1"), (1, 99, "chapter:2"), (4, 0, None)]


def test_line_offsets_count_code_points(spark):
    got = st.line_offsets(spark.createDataFrame([(1, "é😀\n\n  x ")], "k int, text string"), ["k"]).orderBy("line_no").collect()
    assert [(r["line_no"], r["start_offset"], r["line"]) for r in got] == [(0, 0, "é😀"), (2, 4, "x")]


def test_empty_and_clashing_columns(spark):
    rows = spark.createDataFrame([], "k int, text string, boundaries string, line string")
    assert st.detect(rows.drop("boundaries")).count() == 0
    assert "line" in st.detect(rows.drop("boundaries")).columns
    assert st.boundary_rows(st.detect(rows), ["k"]).count() == 0
    assert rows.select(st.classify(F.col("text"))).count() == 0
