"""Text functions as native column expressions (Python only where Spark has none)."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Stop words of the token search, abbreviations whose full stop ends no sentence.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is it as be was are been being have has had do does did will would could "
    "should may might shall can this that these those not no so if then than too very just about up out into over after"
).split()
ABBREVIATIONS = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Jr.", "Sr.", "Inc.", "Ltd.", "Corp.", "vs.", "etc.", "e.g.", "i.e.")

EDGES = r"(?U)^\s+|\s+$"
WORDS = r"([\p{L}\p{N}_]+)"
TOKENS = r"(?U)([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"
FENCE = r"(?s)```.*?```"
OPEN, SHUT, DOT = "\x01", "\x02", "\x03"


def strip(c: Column) -> Column:
    """Without white space (Unicode) at either end."""
    return F.regexp_replace(c, EDGES, "")


def plain_lines(c: Column) -> Column:
    """Text with every line end (carriage return, line feed or both) as one line feed."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def words(c: Column) -> Column:
    """Lower-case words; an array."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORDS), 1)


def token_count(c: Column) -> Column:
    """Words and single signs; stands in for a model's tokenizer, which a caller may pass to the chunker instead."""
    return F.size(F.regexp_extract_all(c, F.lit(TOKENS), 1))


def sentences(c: Column) -> Column:
    """Sentences of a text: split after . ! ? and white space before a capital, not after the abbreviations, code fences
    kept whole.  Null for null, an empty array for a blank text."""
    fences = F.regexp_extract_all(c, F.lit(f"({FENCE})"), 1)
    parts = F.split(c, FENCE, -1)
    held = F.array_join(F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.lit(OPEN), i.cast("string"), F.lit(SHUT))).otherwise(p)), "")
    for word in ABBREVIATIONS:
        held = F.replace(held, F.lit(word), F.lit(word.replace(".", DOT)))
    units = F.split(held, r"(?U)(?<=[.!?])\s+(?=[A-Z])", -1)

    def restored(unit: Column) -> Column:
        dotted = F.replace(unit, F.lit(DOT), F.lit("."))
        pairs = F.transform(fences, lambda f, i: F.struct(F.concat(F.lit(OPEN), i.cast("string"), F.lit(SHUT)).alias("mark"), f.alias("code")))
        return F.when(F.contains(dotted, F.lit(OPEN)), F.aggregate(pairs, dotted, lambda s, p: F.replace(s, p["mark"], p["code"]))).otherwise(dotted)

    return F.filter(F.transform(units, lambda u: strip(restored(u))), lambda u: u != "")


def exact_score(content: Column, query: str) -> Column:
    """0.85 to 1 by how much of the content a contained query covers, else 0; ``query`` is stripped and lower-case."""
    low = F.lower(content)
    cover = F.least(F.lit(float(len(query))) / F.greatest(F.length(low), F.lit(1)), F.lit(1.0))
    return F.when(F.contains(low, F.lit(query)), F.lit(0.85) + F.lit(0.15) * cover).otherwise(F.lit(0.0))


def query_tokens(query: str) -> list[str]:
    """Words of a query without stop words; all of them if nothing else is left.  Driver side."""
    found = re.findall(r"\w+", query.strip().lower())
    return [w for w in found if w not in STOP_WORDS] or found


def snippet(c: Column, size: int = 100) -> Column:
    """The first characters, with three dots if there are more."""
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def source_name(path: Column) -> Column:
    """Base name of a path without its extension, spaces as underscores."""
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.replace(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""), F.lit(" "), F.lit("_"))


def custom_source_name(name: Column) -> Column:
    """A given source name with spaces and slashes as underscores."""
    return F.translate(name, " /", "__")


def boundary_level(type_name: Column) -> Column:
    """Level of a boundary type."""
    from corpusloom.schema import LEVELS, OTHER_LEVEL

    out = F.lit(OTHER_LEVEL)
    for name, level in LEVELS.items():
        out = F.when(type_name == name, F.lit(level)).otherwise(out)
    return out


def ratio(a: str, b: str) -> float:
    """Ratcliff/Obershelp similarity; the order of the arguments matters."""
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Column form of :func:`ratio`; Spark has no built-in for it."""
    return pd.Series([ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")
