"""Structure of texts: headings and page, sheet, slide and row markers as a hierarchy of boundaries.

All of it is row-local: lines are classified natively, and the few that are boundaries (never the text) go through one
pass of an Arrow function that gives them offsets, identifiers and parents.  Its work is proportional to the number of
lines; array expressions would look back over the array for each element.  No shuffle, no window over lines; a text's
boundaries come out as an array and can be exploded.

Defined cases: a null text gives a null array, a text without boundaries an empty one; offsets count code points.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import strip
from corpusloom.schema import BOUNDARY, PLAUSIBLE

# Line patterns in order of priority, with type, level and the group of the title (0: the line number's
# group is the title).  (?d) and (?U): only \n ends a line, classes are Unicode-aware.
PATTERNS = (
    ("chapter", 1, 1, r"^#\s+(.+)$"),
    ("section", 2, 1, r"^##\s+(.+)$"),
    ("subsection", 3, 1, r"^###\s+(.+)$"),
    ("subsection", 4, 1, r"^####\s+(.+)$"),
    ("sheet", 1, 1, r"^\[Sheet:\s+(.+)\]$"),
    ("slide", 1, 2, r"^\[Slide\s+(\d+):\s+(.+)\]$"),
    ("page", 4, 1, r"(?i)^\[Page\s+(\d+)\]$"),
    ("page", 4, 1, r"(?i)^---\s*Page\s+(\d+)\s*---$"),
    ("row_group", 2, 1, r"^\[Rows\s+(\d+-\d+)\]$"),
    ("chapter", 1, 2, r"^(?:CHAPTER|Chapter)\s+(\d+|[IVXLC]+)(?:[:.]?\s+(.+))?$"),
    ("subsection", 3, 2, r"^(\d+\.\d+\.\d+)\s+(.+)$"),
    ("section", 2, 2, r"^(\d+\.\d+)\s+(.+)$"),
    ("chapter", 1, 2, r"^(\d{1,2})\s+([A-Z][A-Za-z0-9,:\-'()\s]{2,70})$"),
    ("section", 2, 1, r"^([A-Z][A-Z\s]{3,}[A-Z])$"),
)
NOISE = r"(?U)\.{3}|^\d+\s*\|\s|^\|\s"
#: No pattern can match a line that doesn't begin like this.
LIKELY = r"(?dU)^(?:[#\[\d]|---|C[hH]|[A-Z][A-Z\s]{3,}[A-Z]$)"


def is_noise(line: Column) -> Column:
    """Whether a stripped line is a contents entry or a footer rather than a heading."""
    return line.rlike(NOISE)


def classify(line: Column, skip: Column | None = None) -> Column:
    """struct(type, level, title) of a stripped line, or null; types in the array ``skip`` are passed over first."""
    out = F.lit(None)
    for kind, level, group, pattern in reversed(PATTERNS):
        flagged = "(?dU)" + pattern
        title = strip(F.regexp_extract(line, flagged, group))
        found = F.struct(F.lit(kind).alias("type"), F.lit(level).alias("level"), F.when(title != "", title).alias("title"))
        hit = line.rlike(flagged)
        if skip is not None:
            hit = hit & ~F.array_contains(skip, kind)
        out = F.when(hit, found).otherwise(out)
    return F.when(~is_noise(line), out)


def line_offsets(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Non-blank lines with number, offset of the raw line and stripped text.  One window per text."""
    rows = df.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "raw"))
    before = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start_offset", F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0)).cast("int"))
    return placed.withColumn("line", strip(F.col("raw"))).where("line <> ''").drop("raw")


def assemble(marks: list[dict], lengths: list[int], known: list[dict] | None) -> list[dict]:
    """Boundaries of one text from its marked lines (line number, type, level, title), in one pass.

    ``lengths`` are those of all lines.  Types detected implausibly often go; the others are numbered ``type:n`` and put
    under the last one before that has a lower level.  ``known`` are the reader's own boundaries: both come out in order of
    offset (the reader's first on ties), and a detected one without a parent is put under the reader's last one before it
    that has a lower level.
    """
    often = Counter(m["type"] for m in marks)
    starts = list(accumulate((n + 1 for n in lengths), initial=0))
    native = sorted(known or [], key=lambda b: b["start_offset"])
    counts: Counter[str] = Counter()
    out: list[dict] = []
    open_found: list[tuple[int, str]] = []  # chain of the detected ones that may still get children
    open_native: list[tuple[int, str]] = []
    taken = 0

    def above(chain: list[tuple[int, str]], level: int) -> str | None:
        return next((name for at, name in reversed(chain) if at < level), None)

    for m in marks:
        if often[m["type"]] > PLAUSIBLE.get(m["type"], len(marks)):
            continue
        at = starts[m["line_no"]]
        while taken < len(native) and native[taken]["start_offset"] <= at:
            b = native[taken]
            while open_native and open_native[-1][0] >= b["level"]:
                open_native.pop()
            open_native.append((b["level"], b["boundary_id"]))
            out.append(b)
            taken += 1
        counts[m["type"]] += 1
        name = f"{m['type']}:{counts[m['type']]}"
        while open_found and open_found[-1][0] >= m["level"]:
            open_found.pop()
        parent = open_found[-1][1] if open_found else above(open_native, m["level"])
        open_found.append((m["level"], name))
        out.append({"type": m["type"], "level": m["level"], "boundary_id": name, "title": m["title"], "start_offset": at, "parent_id": parent})
    return [b | {"ord": i} for i, b in enumerate([*out, *native[taken:]])]


_FIELDS = [f.split(":") for f in BOUNDARY[7:-1].split(",")]
_ARROW = pa.list_(pa.struct([(n, pa.int32() if t == "int" else pa.string()) for n, t in _FIELDS]))


_SPARK = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if t == "int" else T.StringType()) for n, t in _FIELDS]))


@F.arrow_udf(_SPARK)
def _assembled(marks: pa.Array, lengths: pa.Array, known: pa.Array) -> pa.Array:
    """Column form of :func:`assemble`; only marked lines, line lengths and known boundaries come to Python, never text."""
    rows = zip(marks.to_pylist(), lengths.to_pylist(), known.to_pylist())
    return pa.array([None if m is None else assemble(m, n, k) for m, n, k in rows], _ARROW)


def detect(df: DataFrame, text: str = "text", name: str = "boundaries", loader: str | None = None) -> DataFrame:
    """``df`` with the array ``name`` of boundaries.  ``loader``: an array of boundaries that the file's reader knows;
    their types are not detected again, and the two are merged."""
    skip = F.coalesce(F.transform(F.col(loader), lambda b: b["type"]), F.array().cast("array<string>")) if loader else None
    lines = F.transform(F.split(F.col(text), "\n", -1), lambda raw, i: F.struct(strip(raw).alias("line"), i.alias("i")))
    likely = F.filter(lines, lambda s: s["line"].rlike(LIKELY))
    marked = F.filter(F.transform(likely, lambda s: F.struct(classify(s["line"], skip).alias("m"), s["i"].alias("i"))), lambda s: s["m"].isNotNull())
    marks = F.transform(marked, lambda s: F.struct(s["m"]["type"].alias("type"), s["m"]["level"].alias("level"), s["m"]["title"].alias("title"), s["i"].alias("line_no")))
    # Lengths are only needed where something is marked.
    lengths = F.when(F.size("__marks") > 0, F.transform(F.split(F.col(text), "\n", -1), lambda raw: F.length(raw))).otherwise(F.array().cast("array<int>"))
    known = F.col(loader) if loader else F.lit(None).cast(f"array<{BOUNDARY}>")
    return df.withColumn("__marks", marks).withColumn(name, _assembled(F.col("__marks"), lengths, known)).drop("__marks")


def boundary_rows(df: DataFrame, keys: list[str], name: str = "boundaries") -> DataFrame:
    """One row per boundary.  An outer explode: for a plain one the optimizer would infer a filter on the array and push
    it below the projections that build it, where the whole detection is evaluated again for every reference."""
    return df.select(*keys, F.explode_outer(name).alias("b")).where("b is not null").select(*keys, "b.*")


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stretches(texts: pa.Array, starts: pa.Array) -> pa.Array:
    """Stripped text up to the first start and from each start to the next; native substrings would count from the
    text's beginning for each of them."""
    out = []
    for text, at in zip(texts.to_pylist(), starts.to_pylist()):
        ends = [*(at or []), len(text or "")]
        out.append(None if text is None else [text[a:b].strip() for a, b in zip([0, *ends], ends)])
    return pa.array(out, pa.list_(pa.string()))


def regions(df: DataFrame, keys: list[str], text: str = "text", name: str = "boundaries") -> DataFrame:
    """Stripped non-empty stretches from one boundary to the next, the text before the first one with a null boundary."""
    by_offset = F.array_sort(F.transform(F.col(name), lambda x: F.struct(x["start_offset"].alias("s"), x["ord"].alias("o"), x.alias("b"))), lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["o"] - b["o"]))
    known = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("__text"), by_offset.alias("__order"))
    cut_out = known.select(*keys, "__order", _stretches(F.col("__text"), F.transform("__order", lambda x: x["s"])).alias("__content"))
    rows = cut_out.select(*keys, F.posexplode_outer("__content").alias("region", "content"), "__order").where("content <> ''")
    b = F.try_element_at("__order", F.col("region"))["b"]  # places count from 1: the stretch before the first has none
    own = rows.withColumn("__b", F.when(F.col("region") > 0, b))
    return own.select(*keys, "region", F.col("__b.boundary_id").alias("boundary_id"), F.col("__b.type").alias("type"), F.coalesce("__b.start_offset", F.lit(0)).alias("start_offset"), "content")


def boundary_at(points: DataFrame, boundaries: DataFrame, keys: list[str], offset: str = "offset") -> DataFrame:
    """As-of lookup: ``points`` with the boundary that starts last at or before ``offset`` (ties: the deeper level, then
    the first), null where there is none.  One sorted pass per text instead of a range join."""
    b = boundaries.select(*keys, F.col("start_offset").alias("__at"), F.lit(0).alias("__kind"), "level", (-F.col("ord")).alias("__o"), F.struct("boundary_id", "type", "level", "title", "start_offset").alias("__b"), F.lit(None).cast(points.schema[offset].dataType).alias(offset))
    p = points.select(*keys, F.col(offset).cast("int").alias("__at"), F.lit(1).alias("__kind"), F.lit(0).alias("level"), F.lit(0).alias("__o"), F.lit(None).cast("struct<boundary_id:string,type:string,level:int,title:string,start_offset:int>").alias("__b"), F.col(offset))
    w = Window.partitionBy(*keys).orderBy("__at", "__kind", "level", "__o").rowsBetween(Window.unboundedPreceding, 0)
    seen = b.unionByName(p).withColumn("__b", F.last("__b", ignorenulls=True).over(w))
    return seen.where("__kind = 1").select(*keys, offset, *[F.col(f"__b.{c}").alias(c) for c in ("boundary_id", "type", "level", "title")])


def pages_at(boundaries: DataFrame, keys: list[str]) -> DataFrame:
    """Each boundary with the number of the last page marker at or before its start (null without one)."""
    w = Window.partitionBy(*keys).orderBy("start_offset").rangeBetween(Window.unboundedPreceding, 0)
    number = F.when(F.col("type") == "page", F.expr("try_cast(title as int)"))
    return boundaries.withColumn("page", F.max_by(number, F.when(number.isNotNull(), F.struct("start_offset", -F.col("ord")))).over(w))
