"""Text search and hybrid search with sparsity-aware merging, context, boundary expansion and a token budget."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import exact_score, query_tokens, similarity_ratio, snippet, words
from corpusloom.operators.hierarchy import ancestors, siblings
from corpusloom.operators.vectors import nearest_per_source
from corpusloom.runtime import cut
from corpusloom.schema import SearchParams, level_of

#: Fixed values of the search: least score kept, similarity at which tokens match, difference in length gated out.
LEAST, ALIKE, GATE = 0.3, 0.8, 0.4
#: Most matching words that are broadcast.
FEW = 100_000


def could_match(a: Column, b: Column) -> Column:
    """A native bound: false only where two words cannot reach the similarity.  Matching characters are at most those of
    either word less the distinct ones that the other lacks, and twice their number over both lengths is the similarity."""
    la, lb = F.length(a), F.length(b)
    gate = F.abs(la - lb) <= F.greatest(la, lb) * F.lit(GATE)
    signs = lambda c: F.split(c, "")
    common = F.least(la - F.size(F.array_except(signs(a), signs(b))), lb - F.size(F.array_except(signs(b), signs(a))))
    return gate & (2 * F.least(la, lb) >= (la + lb) * F.lit(ALIKE)) & (2 * common >= (la + lb) * F.lit(ALIKE - 1e-9))


def fuzzy_scores(chunks: DataFrame, query: str, words_of: DataFrame | None = None) -> DataFrame:
    """(chunk_id, fuzzy): 0.75 times the share of query tokens that the chunk has, up to spelling.

    ``words_of`` (word, chunk_id) are the chunks' distinct words, such as the store keeps; without it they are taken from
    the contents.  Query tokens meet the vocabulary once, behind a native bound; the words that match go back to the
    chunks, broadcast after their number was checked.
    """
    tokens = Counter(query_tokens(query))
    n = sum(tokens.values())
    spark = chunks.sparkSession
    asked = spark.createDataFrame([(t, c) for t, c in tokens.items()] or [("", 0)], "asked string, times int").where("times > 0")
    held = words_of
    if held is None:  # read twice below, so the contents are taken apart once
        held = cut(chunks.select("chunk_id", F.explode_outer(F.array_distinct(words(F.col("content")))).alias("word")).where("word is not null"))
    pairs = held.select("word").distinct().join(F.broadcast(asked), could_match(F.col("asked"), F.col("word")))  # the query's tokens: at most 10,000 characters by validation
    alike = cut(pairs.where((F.col("asked") == F.col("word")) | (similarity_ratio("asked", "word") >= ALIKE)))
    matched = held.join(F.broadcast(alike) if alike.count() <= FEW else alike, "word").select("chunk_id", "asked", "times").distinct()
    return matched.groupBy("chunk_id").agg((F.lit(0.75) * (F.sum("times") / F.lit(float(max(n, 1))))).alias("fuzzy"))


def text_search(chunks: DataFrame, query: str, least: float = LEAST, fuzzy: bool = True, words_of: DataFrame | None = None) -> DataFrame:
    """(chunk_id, text_score, match_type) of chunks at or above ``least``.  A blank query finds nothing; null contents
    match nothing."""
    low = query.strip().lower()
    exact = chunks.select("chunk_id", (exact_score(F.col("content"), low) if low else F.lit(0.0)).alias("exact"))
    if fuzzy and low:
        # Both sides are hits only, so that the join moves no chunk that matches in no way.
        scored = exact.where("exact > 0").join(fuzzy_scores(chunks, query, words_of), "chunk_id", "full_outer")
    else:
        scored = exact.withColumn("fuzzy", F.lit(0.0))
    first, second = F.coalesce("exact", F.lit(0.0)), F.coalesce("fuzzy", F.lit(0.0))
    best = F.greatest(first, second)
    kind = F.when(first >= second, "exact_substring").otherwise("fuzzy_token")
    return scored.select("chunk_id", best.alias("text_score"), kind.alias("match_type")).where((F.col("text_score") >= least) & (F.col("text_score") > 0))


def text_weight(hits: DataFrame) -> DataFrame:
    """One row (hits, weight): how much text scores count, by how few hits there are above 0.3."""
    strong = hits.where(F.col("text_score") > LEAST).agg(F.count(F.lit(1)).alias("hits"), F.avg("text_score").alias("mean"))
    weight = F.when(F.col("hits") == 0, 0.0).when(F.col("hits") <= 3, 0.5 * F.col("mean")).when(F.col("hits") <= 10, 0.3 * F.col("mean")).otherwise(0.1)
    return strong.select("hits", weight.alias("weight"))


def merge_scores(semantic: DataFrame, text: DataFrame, top_k: int) -> DataFrame:
    """(chunk_id, score, text_score, match_type) of the best ``top_k``; a side that lacks a chunk counts as 0."""
    both = semantic.select("chunk_id", "semantic_score").join(text, "chunk_id", "full_outer").crossJoin(F.broadcast(text_weight(text)))
    sem, txt = F.coalesce("semantic_score", F.lit(0.0)), F.coalesce("text_score", F.lit(0.0))
    blended = (F.lit(1.0) - F.col("weight")) * sem + F.col("weight") * txt
    score = F.when((txt >= 0.85) & (F.col("hits") <= 3), F.greatest(blended, F.lit(0.8))).otherwise(blended)
    return both.select("chunk_id", score.alias("score"), F.when(txt > 0, txt).alias("text_score"), "match_type").orderBy(F.desc("score"), "chunk_id").limit(top_k)


def context(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Every chunk with snippets of the ones before and after it in its source, null at the ends."""
    w = Window.partitionBy(*keys).orderBy("position")
    return chunks.withColumn("before", snippet(F.lag("content").over(w))).withColumn("after", snippet(F.lead("content").over(w)))


def budgeted(items: DataFrame, keys: list[str], order: list[str], budget: int, tokens: str = "token_count") -> DataFrame:
    """Rows of each key while their tokens fit the budget, the first one always; adds ``used``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    running = items.withColumn("used", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(w))
    return running.where((F.col("used") <= budget) | (F.col("__n") == 1)).drop("__n")


def sibling_fold(items: Column, budget: Column, used: Column) -> Column:
    """Fold over (group, tokens, content) in order: take while the budget lasts; a group that overflows is left, the next
    one is tried.  struct(total, blocked, parts)."""
    start = F.struct(used.cast("bigint").alias("total"), F.lit(-1).cast("bigint").alias("blocked"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        fits = (x["group"] != s["blocked"]) & (s["total"] + x["tokens"] <= budget)
        return F.struct(
            (s["total"] + F.when(fits, x["tokens"]).otherwise(0)).cast("bigint").alias("total"),
            F.when(fits, s["blocked"]).otherwise(x["group"]).cast("bigint").alias("blocked"),
            F.when(fits, F.concat(s["parts"], F.array(x["content"]))).otherwise(s["parts"]).alias("parts"),
        )

    return F.aggregate(items, start, step)


def expand(hits: DataFrame, chunks: DataFrame, boundaries: DataFrame, keys: list[str], target: str, budget: int, include_siblings: bool = False) -> DataFrame:
    """Hits (keys, chunk_id, boundary_id) with the content of their boundary at the target's level (else their own).

    Adds expanded_id, expanded_content, expanded_tokens, boundary_type, boundary_level, boundary_title, chunk_count.
    Hits without a boundary get nulls.
    """
    closure = ancestors(boundaries, keys)
    up = closure.where(F.col("ancestor_level") == level_of(target)).groupBy(*keys, "boundary_id").agg(F.min_by("ancestor_id", "depth").alias("__up"))
    aimed = hits.join(up, [*keys, "boundary_id"], "left").withColumn("expanded_id", F.coalesce("__up", "boundary_id")).drop("__up")
    goals = aimed.where("expanded_id is not null").select(*keys, F.col("expanded_id").alias("ancestor_id")).distinct()
    under = closure.join(goals, [*keys, "ancestor_id"], "left_semi").select(*keys, "boundary_id", "ancestor_id")
    inside = chunks.select(*keys, "boundary_id", "position", "token_count", "content").join(under, [*keys, "boundary_id"])
    counts = inside.groupBy(*keys, "ancestor_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    part = F.struct("position", "content", "token_count")
    kept = budgeted(inside, [*keys, "ancestor_id"], ["position"], budget).groupBy(*keys, "ancestor_id").agg(F.array_sort(F.collect_list(part)).alias("__parts"), F.max("used").alias("__used"))
    body = kept.join(counts, [*keys, "ancestor_id"]).select(*keys, F.col("ancestor_id").alias("expanded_id"), F.array_join(F.transform("__parts", lambda p: p["content"]), "\n\n").alias("__body"), "__used", "chunk_count")
    if include_siblings:
        near = siblings(boundaries, keys).join(goals.withColumnRenamed("ancestor_id", "boundary_id"), [*keys, "boundary_id"], "left_semi")
        below = closure.select(*keys, F.col("ancestor_id").alias("sibling_id"), F.col("boundary_id").alias("__leaf"))
        texts = chunks.select(*keys, F.col("boundary_id").alias("__leaf"), "position", "token_count", "content")
        items = near.join(below, [*keys, "sibling_id"]).join(texts, [*keys, "__leaf"])
        item = F.struct(F.col("sibling_ord").cast("bigint").alias("group"), "position", F.col("token_count").cast("bigint").alias("tokens"), "content")
        lists = items.groupBy(*keys, F.col("boundary_id").alias("expanded_id")).agg(F.array_sort(F.collect_list(item)).alias("__items"))
        body = body.join(lists, [*keys, "expanded_id"], "left").withColumn("__fold", sibling_fold(F.coalesce("__items", F.array().cast("array<struct<group:bigint,position:int,tokens:bigint,content:string>>")), F.lit(budget), F.col("__used")))
        body = body.withColumn("__body", F.when(F.size("__fold.parts") > 0, F.concat("__body", F.lit("\n\n---\n\n"), F.array_join("__fold.parts", "\n\n"))).otherwise(F.col("__body"))).withColumn("__used", F.col("__fold.total"))
    info = boundaries.select(*keys, F.col("boundary_id").alias("expanded_id"), F.col("type").alias("expanded_type"), F.col("level").alias("expanded_level"), F.col("title").alias("expanded_title"))
    full = body.select(*keys, "expanded_id", F.col("__body").alias("expanded_content"), F.col("__used").cast("bigint").alias("expanded_tokens"), "chunk_count").join(info, [*keys, "expanded_id"], "left")
    return aimed.join(full, [*keys, "expanded_id"], "left")


def snippets_around(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Few hits (source, chunk_id, position) with snippets of the chunks one position before and after: two equality
    look-ups, without sorting a source."""
    near = hits.select("source", F.col("chunk_id").alias("__of"), F.explode(F.array(F.struct((F.col("position") - 1).alias("position"), F.lit("before").alias("side")), F.struct((F.col("position") + 1).alias("position"), F.lit("after").alias("side")))).alias("n"))
    found = chunks.select("source", "position", "content").join(F.broadcast(near.select("source", "__of", "n.*")), ["source", "position"])
    text = lambda side: F.max(F.when(F.col("side") == side, snippet(F.col("content")))).alias(side)
    return found.groupBy(F.col("__of").alias("chunk_id")).agg(text("before"), text("after"))


def hybrid_search(chunks: DataFrame, vectors: DataFrame, query_vector: list[float], params: SearchParams, words_of: DataFrame | None = None) -> DataFrame:
    """Best chunks by blended score: chunk_id, source, score, text_score, match_type, content and six metadata columns,
    with before and after if asked.  The text hits and the ``top_k`` best are written down once; contents are read for
    those alone."""
    pool, space, known = chunks, vectors, words_of
    if params.sources:
        pool, space, known = (d if d is None else d.where(F.col("source").isin(*params.sources)) for d in (chunks, vectors, words_of))
    semantic = nearest_per_source(space, query_vector, 2 * params.top_k)
    best = merge_scores(semantic, cut(text_search(pool, params.query, words_of=known)), params.top_k).collect()  # at most top_k
    scores = chunks.sparkSession.createDataFrame([tuple(r) for r in best], "chunk_id string, score double, text_score double, match_type string")
    meta = ["position", "total_chunks", "boundary_type", "boundary_id", "boundary_title", "token_count"]
    rows = pool.where(F.col("chunk_id").isin([r["chunk_id"] for r in best])).select("chunk_id", "source", "content", *meta)
    out = rows.join(F.broadcast(scores), "chunk_id").select("chunk_id", "source", F.round("score", 4).alias("score"), F.round("text_score", 4).alias("text_score"), "match_type", "content", *meta)
    if params.include_context:
        out = cut(out)
        near = {r["source"] for r in out.select("source").distinct().collect()}
        out = out.join(snippets_around(out, pool.where(F.col("source").isin(sorted(near)))), "chunk_id", "left")
    return out


def within_budget(results: DataFrame, budget: int) -> DataFrame:
    """A search's best rows up to and including the one that reaches the budget; at most ``top_k`` rows come in."""
    w = Window.orderBy(F.desc("score"), "chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    running = results.withColumn("total_tokens", F.sum("token_count").over(w))
    return running.where(F.col("total_tokens") - F.col("token_count") < budget)
