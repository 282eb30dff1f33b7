"""One ranking from several differently scaled scores: weighted Borda count.

Every score is turned into competition ranks within its query, tied rows share the average of their places, a missing
score (null or NaN) counts as the middle place (n + 1) / 2, and an item with average place r among n gets
weight * (n - r) points.  Points are summed and sorted, ties broken by identifier.  Only places enter, so no score can
rule by its range.  A query is ranked within one partition, after one shuffle; only queries of more than ``HOT_ROWS``
rows are spread over tasks.

Defined cases: rows with a null query or item key are left out; repeated (query, item) rows count once, the latest
wins (on equal times the greater scores); a query in which a score is missing everywhere gives all items equal points
for it; infinities are ordinary extreme values; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.ranking import competition_ranks, positions
from corpusloom.runtime import cut

Scores = dict[str, tuple[Column, float]]
#: Rows beyond which a query is ranked by ranges, and most such queries that are broadcast.
HOT_ROWS, FEW = 1_000_000, 100_000
#: Places of match types, better is greater; spelling is folded first.
MATCH_ORDER = {"exact_substring": 2.0, "exact": 2.0, "fuzzy_token": 1.0, "fuzzy": 1.0}


def match_level(match_type: Column) -> Column:
    """Match type as an ordinal score; null when missing or unknown."""
    folded = F.regexp_replace(F.lower(F.trim(match_type)), "[^a-z]+", "_")
    out = F.lit(None).cast("double")
    for name, level in MATCH_ORDER.items():
        out = F.when(folded == name, F.lit(level)).otherwise(out)
    return out


def _latest(clean: DataFrame, scores: Scores) -> DataFrame:
    newest = F.max(F.struct("__at", *[f"__s_{s}" for s in scores])).alias("__row")
    return clean.groupBy("__q", "__i").agg(newest).select("__q", "__i", *[f"__row.__s_{s}" for s in scores])


def _fused(ranked: DataFrame, scores: Scores) -> DataFrame:
    """Places and points from competition ranks ``__r_`` and numbers of tied rows ``__t_``."""
    n = F.col("__n")
    place = {s: F.coalesce(F.col(f"__r_{s}") + (F.col(f"__t_{s}") - 1) / 2, (n + 1) / 2) for s in scores}
    points = sum((F.lit(w) * (n - place[s]) for s, (_, w) in scores.items()), F.lit(0.0))
    return ranked.select("__q", "__i", "__n", *[F.col(f"__r_{s}") for s in scores], *[place[s].alias(f"__p_{s}") for s in scores], points.alias("__points"))


def _whole(clean: DataFrame, scores: Scores) -> DataFrame:
    """Queries that fit a task: one exchange by query serves the latest rows, all ranks and the positions."""
    rows = _latest(clean.repartition("__q"), scores).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("__q")))
    for s in scores:
        down = Window.partitionBy("__q").orderBy(F.col(f"__s_{s}").desc_nulls_last())
        has = F.col(f"__s_{s}").isNotNull()
        rows = rows.withColumn(f"__r_{s}", F.when(has, F.rank().over(down)).cast("bigint")).withColumn(f"__t_{s}", F.count(F.lit(1)).over(down.rangeBetween(0, 0)))
    best = Window.partitionBy("__q").orderBy(F.col("__points").desc(), F.col("__i"))
    return _fused(rows, scores).withColumn("__position", F.row_number().over(best).cast("bigint"))


def _by_ranges(clean: DataFrame, scores: Scores) -> DataFrame:
    """Queries too large for a task: ranks by range partitions and prefix counts."""
    rows = cut(_latest(clean, scores))
    out = rows.join(rows.groupBy("__q").agg(F.count(F.lit(1)).alias("__n")), "__q")
    for s in scores:
        ranks = competition_ranks(rows.where(F.col(f"__s_{s}").isNotNull()), ["__q"], f"__s_{s}", f"__r_{s}", f"__t_{s}")
        out = out.join(ranks, ["__q", f"__s_{s}"], "left")
    return positions(_fused(out, scores), ["__q"], [F.col("__points").desc(), F.col("__i")], "__position").withColumn("__position", F.col("__position").cast("bigint"))


def borda(
    df: DataFrame,
    query: str = "query_id",
    item: str = "chunk_id",
    scores: Scores | None = None,
    latest: str = "served_at",
) -> DataFrame:
    """Columns query, item, n, per score ``<s>_rank`` (null when missing) and ``<s>_place``, points, position.

    ``scores`` maps a name to (expression over the columns of ``df``, weight).
    """
    scores = scores or {
        "score": (F.col("score"), 1.0),
        "text_score": (F.col("text_score"), 1.0),
        "match": (match_level(F.col("match_type")), 0.5),
    }
    clean = df.select(
        F.col(query).alias("__q"),
        F.col(item).alias("__i"),
        F.col(latest).alias("__at"),
        *[F.when(~F.isnan(e), e.cast("double") + F.lit(0.0)).alias(f"__s_{s}") for s, (e, _) in scores.items()],
    ).where("__q is not null and __i is not null")
    # Queries of very many rows are measured; all others are ranked whole within one partition, after one shuffle.
    hot = clean.groupBy("__q").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT_ROWS).select("__q")
    hot = cut(hot)
    many = hot.count()
    if not many:
        ordered = _whole(clean, scores)
    else:
        known = F.broadcast(hot) if many <= FEW else hot
        ordered = _whole(clean.join(known, "__q", "left_anti"), scores).unionByName(_by_ranges(clean.join(known, "__q", "left_semi"), scores))
    n = F.col("__n")
    return ordered.select(
        F.col("__q").alias(query),
        F.col("__i").alias(item),
        n.alias("n"),
        *[F.col(f"__r_{s}").alias(f"{s}_rank") for s in scores],
        *[F.col(f"__p_{s}").alias(f"{s}_place") for s in scores],
        F.col("__points").alias("points"),
        F.col("__position").alias("position"),
    )


def front_items(ranked: DataFrame, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """Items among the first tenth (rounded up) by both scores, from the operator's ranks."""
    k = F.ceil(F.col("n") / 10)
    return ranked.where((F.col("score_rank") <= k) & (F.col("text_score_rank") <= k)).select(query, item)
