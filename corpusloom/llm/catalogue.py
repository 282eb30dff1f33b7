"""Queries of the training-data operators, each over its whole tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    markup,
    near_duplicates,
    pack_containers,
    rank_fusion,
    reading_level,
    sentences,
    similar_vectors,
    split_oversized,
    tokenize_corpus,
)
from corpusloom.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = similar_vectors.usable_vectors(table(spark, sf_dir, "chunk_vectors"))
    return similar_vectors.similar_pairs(similar_vectors.neighbours(vectors))


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set (ids divisible by 20) against all rows, at any cosine."""
    vectors = similar_vectors.usable_vectors(table(spark, sf_dir, "chunk_vectors"))
    near = similar_vectors.nearest(vectors, vectors.select("id").where(F.col("id") % 20 == 0))
    return near.select(F.col("id").alias("vec_id"), F.col("other").alias("neighbour_id"), F.round("cosine", 6).alias("score"), "rank")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.copy_pairs(table(spark, sf_dir, "chunks"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.copy_groups(table(spark, sf_dir, "chunks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.markup_cases(table(spark, sf_dir, "documents"))


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = markup.clean(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "clean_text", F.concat_ws(",", "markups").alias("markups"), "kept", "dropped")


def p3_chunk_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = markup.clean(table(spark, sf_dir, "chunks"), "chunk_id", "content")
    return out.select("chunk_id", "clean_text", F.concat_ws(",", "markups").alias("markups"), "kept", "dropped")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    prose = table(spark, sf_dir, "documents").where("is_flow")
    return sentences.sentences(prose, with_text=False).select("doc_id", "end_offset")


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"))


def p4_chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "chunks"), "chunk_id", "content", with_text=False)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_fusion.front_items(rank_fusion.borda(table(spark, sf_dir, "search_results")))


def p5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rank_fusion.borda(table(spark, sf_dir, "search_results"))
    return out.select("query_id", "chunk_id", F.round("points", 4).alias("points"), F.col("position").cast("bigint").alias("position"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized.split_oversized(*(table(spark, sf_dir, t) for t in ("chunks", "boundaries", "chunk_options")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized.oversized_ids(_pieces(spark, sf_dir))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_corpus.encode_texts(table(spark, sf_dir, "documents"))


def p7_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip: what the ids of every text decode to."""
    out = tokenize_corpus.decode_ids(tokenize_corpus.encode_texts(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.md5("text").alias("digest"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_containers.pack(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = reading_level.train(table(spark, sf_dir, "graded_texts"))
    return reading_level.level_cases(table(spark, sf_dir, "documents"), model)


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = reading_level.train(table(spark, sf_dir, "graded_texts"))
    return reading_level.reading_levels(table(spark, sf_dir, "documents"), model)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        p1_found, p1_neighbours, p2_found, p2_groups, p3_found, p3_clean, p3_chunk_clean, p4_found, p4_sentences, p4_chunk_sentences, p5_found, p5_ranking,
        p6_found, p6_pieces, p7_ids, p7_texts, p8_containers, p9_found, p9_levels,
    )}


RANKED = """
with newest as (
  select query_id, chunk_id,
    max({'at': served_at, 's': case when isnan(score) then null else score end, 't': case when isnan(text_score) then null else text_score end,
      'm': case regexp_replace(lower(trim(match_type)), '[^a-z]+', '_', 'g') when 'exact_substring' then 2.0 when 'exact' then 2.0
        when 'fuzzy_token' then 1.0 when 'fuzzy' then 1.0 end::double}) as r
  from search_results where query_id is not null and chunk_id is not null group by all),
items as (select query_id, chunk_id, r.s as s, r.t as t, r.m as m, count(*) over (partition by query_id) as n from newest),
ranked as (
  select *,
    case when s is not null then rank() over (partition by query_id order by s desc nulls last) end as rs,
    case when t is not null then rank() over (partition by query_id order by t desc nulls last) end as rt,
    case when m is not null then rank() over (partition by query_id order by m desc nulls last) end as rm,
    count(*) over (partition by query_id, s) as cs, count(*) over (partition by query_id, t) as ct, count(*) over (partition by query_id, m) as cm
  from items)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": RANKED + "select query_id, chunk_id from ranked where rs <= ceil(n / 10.0) and rt <= ceil(n / 10.0)",
        "p5_ranking": RANKED + """, scored as (
            select query_id, chunk_id, 1.0::double * (n - coalesce(rs + (cs - 1) / 2.0, (n + 1) / 2.0)) + 1.0 * (n - coalesce(rt + (ct - 1) / 2.0, (n + 1) / 2.0))
              + 0.5 * (n - coalesce(rm + (cm - 1) / 2.0, (n + 1) / 2.0)) as points from ranked)
            select query_id, chunk_id, round(points::double, 4) as points, row_number() over (partition by query_id order by points desc, chunk_id) as position from scored""",
        "p7_texts": "select doc_id, md5(coalesce(text, '')) as digest from documents",
        "p6_found": """select distinct c.chunk_id from chunks c join (select option_id, max(max_chunk_size) as m from chunk_options where max_chunk_size >= 1 group by 1) o
            on c.option_id = o.option_id where length(c.content) > o.m""",
    }
