"""Queries of the core engine over the driver's tables, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import tables as tab
from corpusloom.functions import text as tx
from corpusloom.operators import ann, chunking, content, hierarchy, search, structure, vectors
from corpusloom.plans import corpus, planted
from corpusloom.runtime import table
from corpusloom.schema import ChunkOptions, SearchParams
from corpusloom.sources import files, store
from corpusloom.streaming import ingest

DOC = ["doc_id"]
#: What the search queries ask (fixed for the comparison with SQL).
QUERY, TYPO = "the shift ends at", "the shift ends at the reguister of the maintenence"
BUDGET = 300
#: Lines for every pattern of the classifier.
LINES = (
    "# One", "## Two  words", "### Three", "#### Four", "##### Five", "[Sheet: Data 1]", "[Slide 3: Intro]", "[page 12]", "--- Page 7 ---", "---page 8---", "[Rows 2-51]",
    "Chapter 4: The End", "CHAPTER IX. Nine", "Chapter 5", "Chapter Five", "1.2.3 Deep", "1.2 Section", "3 Overview of it", "123 Too big", "7 lower case", "ALL CAPS LINE", "ABCD", "ABCDE", "Intro .... 5",
    "42 | Footer", "| Cell", "Plain text.", "1.2.3.4 Version",
)


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Latest chunks; a missing token count is filled with the engine's own."""
    wanted = ["chunk_id", "doc_id", "source", "position", *columns]
    out = corpus.chunks(spark, d, [*dict.fromkeys([*wanted, "content", "token_count"])])
    return out.withColumn("token_count", F.coalesce("token_count", tx.token_count(F.col("content"))))


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    return corpus.boundaries(spark, d)


def _detected(spark: SparkSession, d: str) -> DataFrame:
    return structure.detect(corpus.documents(spark, d).select("doc_id", "text"))


def line_offsets(spark, d):
    out = structure.line_offsets(corpus.documents(spark, d), DOC)
    return out.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("start_offset").cast("bigint").alias("start_offset"), F.length("line").cast("bigint").alias("chars"), structure.is_noise(F.col("line")).alias("noise"))


def classify_lines(spark, d):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "n bigint, line string").withColumn("c", structure.classify(F.col("line")))
    return rows.select("n", "line", "c.type", F.col("c.level").cast("bigint").alias("level"), "c.title")


def boundary_levels(spark, d):
    kinds = corpus.boundaries(spark, d).select("type").distinct()
    return kinds.select("type", tx.boundary_level(F.col("type")).cast("bigint").alias("level"))


def doc_boundaries(spark, d):
    out = structure.boundary_rows(_detected(spark, d), DOC)
    return out.select("doc_id", F.col("ord").cast("bigint").alias("ord"), "type", F.col("level").cast("bigint").alias("level"), "boundary_id", "title", F.col("start_offset").cast("bigint").alias("start_offset"), "parent_id")


def regions(spark, d):
    out = structure.regions(_detected(spark, d), DOC)
    return out.select("doc_id", F.col("region").cast("bigint").alias("region"), "boundary_id", F.length("content").cast("bigint").alias("chars"), F.md5("content").alias("digest"))


def merged_boundaries(spark, d):
    """The table's pages, slides and sheets as a reader's own boundaries, merged with those found in the text."""
    known = F.array_sort(F.collect_list(F.struct("ord", "type", "level", "boundary_id", "title", "start_offset", "parent_id")))
    native = _bounds(spark, d).where("type in ('page', 'slide', 'sheet')").groupBy("doc_id").agg(known.alias("loader"))
    docs = corpus.documents(spark, d).select("doc_id", "text").join(native, "doc_id", "left")
    out = structure.boundary_rows(structure.detect(docs, loader="loader"), DOC)
    return out.select("doc_id", F.col("ord").cast("bigint").alias("ord"), "type", F.col("level").cast("bigint").alias("level"), "boundary_id", "title", F.col("start_offset").cast("bigint").alias("start_offset"), "parent_id")


def boundary_at_offset(spark, d):
    points = corpus.chunks(spark, d, ["chunk_id", "doc_id", "start_offset"]).select("doc_id", F.col("start_offset").alias("offset")).where("offset is not null").distinct()
    return structure.boundary_at(points, _bounds(spark, d), DOC).select("doc_id", F.col("offset").cast("bigint").alias("offset"), "boundary_id", "type")


def page_of_boundary(spark, d):
    return structure.pages_at(_bounds(spark, d), DOC).select("doc_id", "boundary_id", F.col("page").cast("bigint").alias("page"))


def toc_counts(spark, d):
    out = hierarchy.toc(_bounds(spark, d), corpus.chunks(spark, d, ["chunk_id", "doc_id", "boundary_id"]), DOC)
    return out.select("doc_id", F.col("ord").cast("bigint").alias("ord"), "boundary_id", "type", F.col("level").cast("bigint").alias("level"), "title", "parent_id", "chunk_count", "total_chunks", F.col("page").cast("bigint").alias("page"))


def boundary_ancestors(spark, d):
    return hierarchy.ancestors(_bounds(spark, d), DOC).select("doc_id", "boundary_id", "ancestor_id", F.col("ancestor_level").cast("bigint").alias("ancestor_level"), F.col("depth").cast("bigint").alias("depth"))


def ancestor_at_section(spark, d):
    return hierarchy.ancestor_at_level(_bounds(spark, d), DOC, 2)


def boundary_siblings(spark, d):
    return hierarchy.siblings(_bounds(spark, d), DOC).select("doc_id", "boundary_id", "sibling_id")


def chunks_in_boundary(spark, d):
    out = hierarchy.chunks_under(corpus.chunks(spark, d, ["chunk_id", "doc_id", "position", "boundary_id"]), _bounds(spark, d), DOC)
    return out.select("doc_id", F.col("ancestor_id").alias("boundary_id"), "chunk_id", F.col("position").cast("bigint").alias("position"))


def sentence_units(spark, d):
    out = corpus.documents(spark, d).select("doc_id", F.posexplode_outer(tx.sentences(F.col("text"))).alias("n", "s")).where("s is not null")
    return out.select("doc_id", F.col("n").cast("bigint").alias("n"), F.length("s").cast("bigint").alias("chars"), F.md5("s").alias("digest"))


def token_counts(spark, d):
    return corpus.documents(spark, d).select("doc_id", tx.token_count(F.col("text")).cast("bigint").alias("tokens"))


def doc_chunks(spark, d):
    out = chunking.chunk_documents(corpus.documents(spark, d).select("doc_id", "text"))
    numbers = [F.col(c).cast("bigint").alias(c) for c in ("position", "total_chunks", "token_count", "page", "slide")]
    return out.select("doc_id", "chunk_id", "boundary_id", "sheet", *numbers, F.md5("content").alias("digest"))


def chunk_neighbours(spark, d):
    rows = corpus.chunks(spark, d, ["chunk_id", "source", "position"])
    out = vectors.with_neighbours(rows, rows.select("chunk_id"), 1)
    return out.select("target_id", "chunk_id", F.col("distance").cast("bigint").alias("distance"))


def context_snippets(spark, d):
    return search.context(_chunks(spark, d), ["source"]).select("chunk_id", "before", "after")


def content_by_boundary(spark, d):
    out = content.by_boundary(_chunks(spark, d, "boundary_id"), _bounds(spark, d), DOC, budget=BUDGET)
    return out.select("doc_id", "boundary_id", F.md5("content").alias("digest"), "total_tokens", "chunk_count", "truncated")


def content_by_pages(spark, d):
    out = content.by_pages(_chunks(spark, d, "page"), DOC, 1, 3, BUDGET)
    return out.select("doc_id", F.md5("content").alias("digest"), "total_tokens", "chunk_count", "truncated")


def content_by_positions(spark, d):
    out = content.by_positions(_chunks(spark, d), ["source"], 2, 6, BUDGET)
    return out.select("source", F.md5("content").alias("digest"), "total_tokens", "chunk_count", "truncated")


def content_by_title(spark, d):
    out = content.by_title(_chunks(spark, d, "boundary_id"), _bounds(spark, d), DOC, "maintenance and survey", budget=BUDGET)
    return out.select("doc_id", "boundary_id", F.md5("content").alias("digest"), "total_tokens", "chunk_count", "truncated")


def title_match(spark, d):
    return content.title_match(_bounds(spark, d), DOC, "maintenance and survey").select("doc_id", "boundary_id", "title", F.round("similarity", 6).alias("similarity"))


def _examples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("source"), "embedding")


def knn(spark, d):
    out = vectors.nearest(_examples(spark, d), corpus.example_vector(spark, d), 10)
    return out.select("chunk_id", "source", F.round("semantic_score", 6).alias("score"))


def knn_one_source(spark, d):
    out = vectors.nearest(_examples(spark, d), corpus.example_vector(spark, d), 10, "1")
    return out.select("chunk_id", F.round("semantic_score", 6).alias("score"))


def knn_per_source(spark, d):
    out = vectors.nearest_per_source(_examples(spark, d), corpus.example_vector(spark, d), 10)
    return out.select("chunk_id", "source", F.round("semantic_score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def knn_index(spark, d):
    """Through the index: stored by lists, read back, all lists probed."""
    index = ann.VectorIndex.load(spark, ann.VectorIndex.build(_examples(spark, d), planted.folder(spark)).path)
    out = index.search(corpus.example_vector(spark, d), 10, len(index.centres))
    return out.select("chunk_id", "source", F.round("semantic_score", 6).alias("score"))


def exact_search(spark, d):
    return search.text_search(_chunks(spark, d), QUERY, fuzzy=False).select("chunk_id", F.round("text_score", 6).alias("text_score"), "match_type")


def fuzzy_search(spark, d):
    return search.text_search(_chunks(spark, d), TYPO).select("chunk_id", F.round("text_score", 6).alias("text_score"), "match_type")


def token_search(spark, d):
    """Share of the query's distinct words that a chunk has exactly."""
    asked = list(dict.fromkeys(tx.query_tokens(TYPO)))
    hits = F.size(F.array_intersect(tx.words(F.col("content")), F.array(*map(F.lit, asked))))
    scored = _chunks(spark, d).select("chunk_id", (F.lit(0.75) * (hits / F.lit(float(len(asked))))).alias("score"))
    return scored.where(F.col("score") >= search.LEAST).select("chunk_id", F.round("score", 6).alias("score"))


def hybrid_merge(spark, d):
    space = corpus.vectors(spark, d)
    semantic = vectors.nearest_per_source(space, corpus.example_vector(spark, d), 10)
    hits = search.text_search(_chunks(spark, d), QUERY, fuzzy=False)
    return search.merge_scores(semantic, hits, 20).select("chunk_id", F.round("score", 6).alias("score"), F.round("text_score", 6).alias("text_score"), "match_type")


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d, "total_chunks", "boundary_type", "boundary_id", "boundary_title")
    return search.hybrid_search(rows, corpus.vectors(spark, d), corpus.example_vector(spark, d), SearchParams(TYPO, top_k=20))


def hybrid_search(spark, d):
    out = _hybrid(spark, d)
    return out.select("chunk_id", "source", "score", "text_score", "match_type", F.md5("content").alias("digest"), F.col("position").cast("bigint").alias("position"), "boundary_id", "before", "after")


def search_within_budget(spark, d):
    return search.within_budget(_hybrid(spark, d), 1000).select("chunk_id", "score", F.col("total_tokens").cast("bigint").alias("total_tokens"))


def _expanded(spark: SparkSession, d: str, with_siblings: bool) -> DataFrame:
    rows = _chunks(spark, d, "boundary_id")
    hits = rows.where(F.contains(F.lower("content"), F.lit(QUERY))).select("doc_id", "chunk_id", "boundary_id")
    out = search.expand(hits, rows, _bounds(spark, d), DOC, "section", BUDGET, with_siblings)
    return out.select("doc_id", "chunk_id", "expanded_id", "expanded_type", F.md5("expanded_content").alias("digest"), "expanded_tokens", "chunk_count")


def expand_boundary(spark, d):
    return _expanded(spark, d, False)


def expand_siblings(spark, d):
    return _expanded(spark, d, True)


def markdown_rows(spark, d):
    cols = ["n_nationkey", "n_name", "n_regionkey"]
    return tab.frame_lines(table(spark, d, "nation"), cols).select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "line")


def csv_rows(spark, d):
    cols = ["doc_id", "lang", "source", "path"]
    return tab.frame_lines(table(spark, d, "documents"), cols, "csv").select("doc_id", "line")


def row_groups(spark, d):
    cols = ["c_custkey", "c_name", "c_mktsegment"]
    out = tab.row_groups(table(spark, d, "customer"), ["c_custkey"], cols, "customer")
    return out.select("row_group", "first_row", "last_row", F.md5("content").alias("digest"))


def read_truncated(spark, d):
    out = files.read_document(corpus.documents(spark, d), 500, False, "text")
    return out.select("doc_id", F.md5("text").alias("digest"), "truncated", F.col("char_count").cast("bigint").alias("char_count"))


def source_names(spark, d):
    rows = table(spark, d, "documents").where("path is not null")
    return rows.select("doc_id", tx.source_name(F.col("path")).alias("name"), tx.custom_source_name(F.col("path")).alias("custom_name"), files.file_type(F.col("path")).alias("read_as"))


def list_sources(spark, d):
    return content.sources(corpus.chunks(spark, d, ["chunk_id", "source"]))


def chunk_json(spark, d):
    rows = corpus.chunks(spark, d, ["chunk_id", "page", "section", "sheet", "slide"])
    return store.sparse_json(rows.select("chunk_id", "page", "section", "sheet", "slide"))


def hash_embeddings(spark, d):
    """Every place of the vectors that isn't zero."""
    rows = _chunks(spark, d).select("chunk_id", F.posexplode_outer(vectors.hash_embedding(F.col("content"))).alias("place", "value"))
    return rows.where("value <> 0").select("chunk_id", F.col("place").cast("bigint").alias("place"), F.round(F.col("value").cast("double"), 4).alias("value"))


def event_windows(spark, d):
    return ingest.event_counts(table(spark, d, "events")).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        line_offsets, classify_lines, boundary_levels, doc_boundaries, regions, merged_boundaries, boundary_at_offset, page_of_boundary, toc_counts, boundary_ancestors, ancestor_at_section,
        boundary_siblings, chunks_in_boundary, sentence_units, token_counts, doc_chunks, chunk_neighbours, context_snippets, content_by_boundary, content_by_pages,
        content_by_positions, content_by_title, title_match, knn, knn_one_source, knn_per_source, knn_index, exact_search, fuzzy_search, token_search, hybrid_merge, hybrid_search,
        search_within_budget, expand_boundary, expand_siblings, markdown_rows, csv_rows, row_groups, read_truncated, source_names, list_sources, chunk_json, hash_embeddings, event_windows,
    )} | planted.queries()


# --- SQL ----------------------------------------------------------------------------------------------------------

WS = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


NOISY = rf"regexp_matches(line, '\.\.\.|^\p{{Nd}}+{WS}*\|{WS}|^\|{WS}')"


def _portable(pattern: str) -> str:
    """A boundary pattern with its classes spelled out, as a SQL literal's text."""
    inside = re.sub(r"(?<!\\)\[([^\]]*)\\s([^\]]*)\]", lambda m: f"[{m[1]}{WS[1:-1]}{m[2]}]", pattern)
    return inside.replace(r"\s", WS).replace(r"\d", r"\p{Nd}").replace("'", "''")


ARMS = [(kind, level, group, _portable(pattern)) for kind, level, group, pattern in structure.PATTERNS]


def _case(value: Callable[[tuple], str]) -> str:
    return "case " + " ".join(f"when regexp_matches(line, '{a[3]}') then {value(a)}" for a in ARMS) + " end"


MARKED = f"""case when {NOISY} then null else {_case(lambda a: f"'{a[0]}'")} end as type, {_case(lambda a: str(a[1]))} as level,
  nullif({_strip(_case(lambda a: f"regexp_extract(line, '{a[3]}', {a[2]})"))}, '') as title"""
PLACED = f"""
split as (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents where text is not null),
placed as (select doc_id, line_no, {_strip("raw")} as line, coalesce(sum(length(raw) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint as start_offset from split)"""
def _found(but: str = "") -> str:
    """CTEs up to ``found``; ``but`` is a condition on marked lines."""
    return f"""{PLACED},
marked as (select doc_id, line_no, start_offset, {MARKED} from placed where line <> ''),
counted as (select *, count(*) over (partition by doc_id, type) as n from marked m where type is not null {but}),
kept as (select *, row_number() over (partition by doc_id order by line_no) - 1 as ord, type || ':' || row_number() over (partition by doc_id, type order by line_no) as boundary_id
  from counted where not ((type = 'chapter' and n > 100) or (type = 'section' and n > 500) or (type = 'subsection' and n > 1000))),
found as (select k.doc_id, k.ord, k.type, k.level, k.boundary_id, k.title, k.start_offset, arg_max(p.boundary_id, p.ord) as parent_id
  from kept k left join kept p on p.doc_id = k.doc_id and p.ord < k.ord and p.level < k.level group by all)"""


FOUND = _found()
BOUNDS = "bounds as (select doc_id, boundary_id, r.* from (select doc_id, boundary_id, arg_max({'ord': ord, 'type': type, 'level': level, 'title': title, 'start_offset': start_offset, 'parent_id': parent_id}, indexed_at) as r from boundaries where doc_id is not null and boundary_id is not null group by all))"
TOKENS = r"len(regexp_extract_all(content, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + WS[1:-1] + "]'))"
CHUNKS = f"rows as (select * replace (coalesce(token_count, {TOKENS}) as token_count) from (select *, row_number() over (partition by chunk_id order by indexed_at desc) as nth from chunks where chunk_id is not null) where nth = 1)"
CLOSURE = """closure(doc_id, boundary_id, ancestor_id, ancestor_level, parent_id, depth) as (
  select doc_id, boundary_id, boundary_id, level, parent_id, 0 from bounds
  union all select c.doc_id, c.boundary_id, b.boundary_id, b.level, b.parent_id, c.depth + 1 from closure c join bounds b on b.doc_id = c.doc_id and b.boundary_id = c.parent_id)"""
PAGES = """(select doc_id, boundary_id, (select arg_max(try_cast(p.title as bigint), (p.start_offset, -p.ord)) from bounds p
  where p.doc_id = b.doc_id and p.type = 'page' and p.start_offset <= b.start_offset and try_cast(p.title as bigint) is not null) as page from bounds b)"""
EXAMPLE = "example as (select embedding as q from embeddings order by vec_id limit 1)"


def _cosine(v: str) -> str:
    dots = [f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double))" for a, b in ((v, "q"), (v, v), ("q", "q"))]
    return f"(1 + {dots[0]} / sqrt({dots[1]}) / sqrt({dots[2]})) / 2"


def _budget(keys: str, items: str) -> str:
    return f"""running as (select *, sum(token_count) over (partition by {keys} order by position rows unbounded preceding) as used, row_number() over (partition by {keys} order by position) as n from {items}),
      fitting as (select *, used <= {BUDGET} or n = 1 as fits from running)
      select {keys}, md5(string_agg(content, chr(10) || chr(10) order by position) filter (fits)) as digest, max(used) filter (fits)::bigint as total_tokens, count(*) as chunk_count, not bool_and(fits) as truncated
      from fitting group by {keys}"""


def _sentences() -> str:
    held = "array_to_string(list_transform(parts, lambda p, i: case when i < len(parts) then p || chr(1) || (i - 1) || chr(2) else p end), '')"
    for word in tx.ABBREVIATIONS:
        held = f"replace({held}, '{word}', '{word.replace('.', '~DOT~')}')".replace("~DOT~", "' || chr(3) || '")
    restored = "case when contains(u, chr(1)) then list_reduce(list_concat([u], fences), lambda s, f, i: replace(s, chr(1) || (i - 2) || chr(2), f)) else u end"
    return rf"""with cut as (select doc_id, string_split_regex(text, '(?s)```.*?```') as parts, regexp_extract_all(text, '(?s)```.*?```') as fences from documents where text is not null),
      held as (select doc_id, fences, regexp_replace({held}, '([.!?]){WS}+([A-Z])', '\1' || chr(4) || '\2', 'g') as t from cut),
      units as (select doc_id, fences, unnest(string_split(t, chr(4))) as u, generate_subscripts(string_split(t, chr(4)), 1) as i from held),
      whole as (select doc_id, i, {_strip(f"replace({restored}, chr(3), '.')")} as s from units)
      select doc_id, row_number() over (partition by doc_id order by i) - 1 as n, length(s) as chars, md5(s) as digest from whole where s <> ''"""


def _ratio(asked: str) -> str:
    """CTEs up to ``ratio`` (a, b, similarity) of the pairs ``asked`` (a, b): longest common block (first in a, then in b),
    then the same left and right of it."""
    return f"""blocks(a, b, x, y, way, k) as (
      select a, b, a, b, '', 0 from {asked}
      union all
      select a, b, side.x, side.y, way || side.w, side.k from (
        select a, b, unnest([{{'x': substr(x, 1, i - 1), 'y': substr(y, 1, j - 1), 'w': 'l', 'k': n}}, {{'x': substr(x, i + n), 'y': substr(y, j + n), 'w': 'r', 'k': 0}}]) as side, way
        from (select a, b, x, y, way, m.n as n, -m.i as i, -m.j as j from (
          select a, b, x, y, way, max({{'n': p.n, 'i': -p.i, 'j': -p.j}}) as m
          from (select a, b, x, y, way, i, j, unnest(generate_series(1, least(length(x) - i + 1, length(y) - j + 1))) as n
            from (select *, unnest(generate_series(1, length(y))) as j from (select a, b, x, y, way, unnest(generate_series(1, length(x))) as i from blocks))) p
          where substr(x, i, n) = substr(y, j, n) group by a, b, x, y, way)))),
    ratio as (select a, b, 2.0::double * sum(k) / greatest(length(a) + length(b), 1) as similarity from blocks group by a, b)"""


def _fuzzy(query: str) -> str:
    """CTEs up to ``text_hits`` (chunk_id, text_score, match_type) of a query; needs ``rows``."""
    tokens = tx.query_tokens(query)
    asked = ", ".join(f"('{t}', {tokens.count(t)})" for t in dict.fromkeys(tokens))
    q = query.strip().lower()
    return rf"""held as (select distinct chunk_id, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+')) as word from rows),
    asked(token, times) as (values {asked}),
    gated as (select token as a, word as b from asked, (select distinct word from held) where abs(length(token) - length(word)) <= 0.4 * greatest(length(token), length(word))
      and 2 * least(length(token), length(word)) >= 0.8 * (length(token) + length(word))),
    {_ratio('gated')},
    fuzzy as (select chunk_id, 0.75 * sum(times) / {len(tokens)}.0::double as f from (select distinct chunk_id, token, times from held, ratio, asked where word = b and token = a and (a = b or similarity >= 0.8)) group by 1),
    exact as (select chunk_id, case when contains(lower(content), '{q}') then 0.85 + 0.15 * least({len(q)}::double / greatest(length(lower(content)), 1), 1.0) else 0 end as e from rows),
    text_hits as (select chunk_id, greatest(e, coalesce(f, 0)) as text_score, case when e >= coalesce(f, 0) then 'exact_substring' else 'fuzzy_token' end as match_type
      from exact left join fuzzy using (chunk_id) where greatest(e, coalesce(f, 0)) >= 0.3)"""


def _titles(query: str) -> str:
    """CTEs up to ``best_title`` (doc_id, boundary_id, title, similarity); needs ``bounds``."""
    return f"""titled as (select * from bounds where type in ('chapter', 'section', 'subsection') and title is not null and title <> ''),
    pairs as (select distinct lower('{query}') as a, lower(title) as b from titled), {_ratio('pairs')},
    best_title as (select doc_id, r.* from (select doc_id, arg_max({{'boundary_id': boundary_id, 'title': title, 'similarity': similarity}}, (similarity, -ord)) as r
      from titled join ratio on b = lower(title) where similarity >= 0.3 group by 1))"""


def _packing() -> str:
    """Chunks of whole documents: regions, sentences, the packing fold as a recursion over sentences, chunk metadata."""
    o = ChunkOptions()
    space = WS[:-1] + "\\x1c-\\x1f]"  # what Python takes for white space
    edges = lambda t: f"regexp_replace({t}, '^{space}+|{space}+$', '', 'g')"
    held = "array_to_string(list_transform(parts, lambda p, i: case when i < len(parts) then p || chr(1) || (i - 1) || chr(2) else p end), '')"
    for word in tx.ABBREVIATIONS:
        held = f"replace({held}, '{word}', '{word.replace('.', '~DOT~')}')".replace("~DOT~", "' || chr(3) || '")
    restored = "case when contains(u, chr(1)) then list_reduce(list_concat([u], fences), lambda s, f, i: replace(s, chr(1) || (i - 2) || chr(2), f)) else u end"
    return rf"""with recursive {FOUND},
      spans as (select doc_id, ord + 1 as region, boundary_id, type, title, parent_id, start_offset as a, lead(start_offset) over (partition by doc_id order by start_offset, ord) as b from found
        union all select d.doc_id, 0, null, null, null, null, 0, min(start_offset) from (select doc_id from documents where text is not null) d left join found f on f.doc_id = d.doc_id group by 1),
      texts as (select s.* exclude (a, b), a as start_offset, {edges("substr(text, (a + 1)::bigint, (coalesce(b, length(text)) - a)::bigint)")} as content from spans s join documents using (doc_id)),
      cut as (select doc_id, region, string_split_regex(content, '(?s)```.*?```') as parts, regexp_extract_all(content, '(?s)```.*?```') as fences from texts where content <> ''),
      held as (select doc_id, region, fences, regexp_replace({held}, '([.!?]){space}+([A-Z])', '\1' || chr(4) || '\2', 'g') as t from cut),
      units as (select doc_id, region, fences, unnest(string_split(t, chr(4))) as u, generate_subscripts(string_split(t, chr(4)), 1) as i from held),
      whole as (select doc_id, region, i, {edges(f"replace({restored}, chr(3), '.')")} as content from units),
      numbered as (select doc_id, region, row_number() over (partition by doc_id, region order by i) as i, content as s, {TOKENS} as n from whole where content <> ''),
      sums as (select *, sum(n) over (partition by doc_id, region order by i) as upto, count(*) over (partition by doc_id, region) as most from numbered),
      tails as (select a.doc_id, a.region, a.i, a.s, a.n, a.upto, a.most, coalesce((select min(t.i) from sums t where t.doc_id = a.doc_id and t.region = a.region and t.i < a.i and a.upto - a.n - t.upto + t.n <= {o.chunk_overlap}), a.i - 1) as tail from sums a),
      fold(doc_id, region, i, s, f1, t1, f2, t2) as (
        select distinct doc_id, region, 1::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint from sums
        union all
        select f.doc_id, f.region, f.i + 1,
          case when x.n > {o.max_chunk_size} then 0 when f.s > 0 and x.upto - b.upto + b.n > {o.chunk_size} then greatest(f.s, least(x.tail, x.i - 1)) when f.s > 0 then f.s else x.i end,
          case when f.s > 0 and (x.n > {o.max_chunk_size} or x.upto - b.upto + b.n > {o.chunk_size}) then f.s else 0 end, x.i - 1,
          case when x.n > {o.max_chunk_size} then x.i else 0 end, x.i
        from fold f join tails x on x.doc_id = f.doc_id and x.region = f.region and x.i = f.i left join sums b on b.doc_id = f.doc_id and b.region = f.region and b.i = f.s),
      made as (select doc_id, region, i * 2 as seq, f1 as a, t1 as b, false as final from fold where f1 > 0 union all select doc_id, region, i * 2 + 1, f2, t2, false from fold where f2 > 0
        union all select f.doc_id, f.region, i * 2 + 2, f.s, most, true from fold f join (select distinct doc_id, region, most from sums) m on m.doc_id = f.doc_id and m.region = f.region and f.i = m.most + 1 where f.s > 0),
      joined as (select m.doc_id, m.region, m.seq, m.final, string_agg(x.s, ' ' order by x.i) as content, sum(x.n) as tokens, count(*) over (partition by m.doc_id, m.region) as many
        from made m join sums x on x.doc_id = m.doc_id and x.region = m.region and x.i between m.a and m.b group by m.doc_id, m.region, m.seq, m.final),
      melted as (select *, lead(content) over w as next_content, lead(tokens) over w as next_tokens, lead(final) over w as next_final from joined window w as (partition by doc_id, region order by seq)),
      chunks_ as (select doc_id, region, seq, case when next_final and next_tokens < {o.min_chunk_size} then content || ' ' || next_content else content end as content,
        case when next_final and next_tokens < {o.min_chunk_size} then tokens + next_tokens else tokens end as tokens from melted where not (final and many > 1 and tokens < {o.min_chunk_size})),
      placed_ as (select *, row_number() over (partition by doc_id order by region, seq) - 1 as position, count(*) over (partition by doc_id) as total_chunks from chunks_)
      select p.doc_id, p.doc_id || ':' || p.position as chunk_id, t.boundary_id, case t.type when 'sheet' then t.title when 'row_group' then s.title end as sheet, p.position, p.total_chunks, p.tokens::bigint as token_count,
        case t.type when 'page' then try_cast(t.title as bigint) else (select arg_max(try_cast(g.title as bigint), (g.start_offset, -g.ord)) from found g where g.doc_id = p.doc_id and g.type = 'page' and g.start_offset <= t.start_offset and t.type is not null and try_cast(g.title as bigint) is not null) end as page,
        case when t.type = 'slide' then try_cast(split_part(t.boundary_id, ':', 2) as bigint) end as slide, md5(p.content) as digest
      from placed_ p join texts t on t.doc_id = p.doc_id and t.region = p.region left join found s on s.doc_id = t.doc_id and s.boundary_id = t.parent_id and s.type = 'sheet'"""


def oracle_sql() -> dict[str, str]:
    quoted = ", ".join(f"({i}, '{x.replace(chr(39), chr(39) * 2)}')" for i, x in enumerate(LINES))
    asked = list(dict.fromkeys(tx.query_tokens(TYPO)))
    cover = f"0.85 + 0.15 * least({len(QUERY)}::double / greatest(length(lower(content)), 1), 1.0)"
    near = f"select chunk_id, source, {_cosine('embedding')} as score from"
    examples = "(select vec_id::varchar as chunk_id, label::varchar as source, embedding, q from embeddings, example)"
    usable = """(select vec_id, chunk_id, source, embedding, q from (select vec_id, arg_max({'c': chunk_id, 's': source, 'e': embedding}, indexed_at) as r from chunk_vectors group by 1)
      cross join example, lateral (select r.c as chunk_id, r.s as source, r.e as embedding)
      where len(embedding) = 64 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0)))"""
    ranked = "row_number() over (partition by source order by score desc, chunk_id)"
    cell = lambda c: f"coalesce(replace(replace({c}::varchar, '|', '\\|'), chr(10), ' '), '')"
    csv = lambda c: f"""case when regexp_matches(coalesce({c}::varchar, ''), '[,"\\r\\n]') then '"' || replace({c}::varchar, '"', '""') || '"' else coalesce({c}::varchar, '') end"""
    base = "regexp_extract(path, '([^/\\\\]*)$', 1)"
    blend = f"""sem as (select chunk_id, score from (select *, {ranked} as rank from ({near} {usable})) where rank <= 40),
      w as (select count(*) as hits, avg(text_score) as mean from text_hits where text_score > 0.3),
      merged as (select coalesce(s.chunk_id, t.chunk_id) as chunk_id, coalesce(score, 0) as s, coalesce(text_score, 0) as t, match_type, hits,
        case when hits = 0 then 0 when hits <= 3 then 0.5 * mean when hits <= 10 then 0.3 * mean else 0.1 end as weight from sem s full join text_hits t on s.chunk_id = t.chunk_id cross join w),
      blended as (select chunk_id, t, match_type, case when t >= 0.85 and hits <= 3 then greatest((1 - weight) * s + weight * t, 0.8) else (1 - weight) * s + weight * t end as score from merged),
      best as (select * from blended order by score desc, chunk_id limit 20)"""
    sparse = " || ".join(f"""case when {c} is not null then ',"{c}":' || to_json({c})::varchar else '' end""" for c in ("page", "section", "sheet", "slide"))
    snip = lambda c: f"case when length({c}) > 100 then substr({c}, 1, 100) || '...' else {c} end"
    return {
        "merged_boundaries": f"""with {BOUNDS}, known as (select * from bounds where type in ('page', 'slide', 'sheet')),
            {_found("and not exists (select 1 from known w where w.doc_id = m.doc_id and w.type = m.type)")},
            both_ as (select doc_id, type, level, boundary_id, title, start_offset, parent_id, 0 as late, ord from known where doc_id in (select doc_id from documents where text is not null)
              union all select doc_id, type, level, boundary_id, title, start_offset, coalesce(parent_id, (select arg_max(k.boundary_id, (k.start_offset, k.ord)) from known k where k.doc_id = f.doc_id and k.start_offset <= f.start_offset and k.level < f.level)), 1, ord from found f)
            select doc_id, row_number() over (partition by doc_id order by start_offset, late, ord) - 1 as ord, type, level::bigint as level, boundary_id, title, start_offset::bigint as start_offset, parent_id from both_""",
        "doc_chunks": _packing(),
        "content_by_title": f"with recursive {BOUNDS}, {CLOSURE}, {CHUNKS}, {_titles('maintenance and survey')}, items as (select r.doc_id, c.ancestor_id as boundary_id, r.position, r.content, r.token_count from rows r join closure c on c.doc_id = r.doc_id and c.boundary_id = r.boundary_id join best_title t on t.doc_id = r.doc_id and t.boundary_id = c.ancestor_id), {_budget('doc_id, boundary_id', 'items')}",
        "title_match": f"with recursive {BOUNDS}, {_titles('maintenance and survey')} select doc_id, boundary_id, title, round(similarity, 6) as similarity from best_title",
        "fuzzy_search": f"with recursive {CHUNKS}, {_fuzzy(TYPO)} select chunk_id, round(text_score, 6) as text_score, match_type from text_hits",
        "hybrid_search": f"""with recursive {EXAMPLE}, {CHUNKS}, {_fuzzy(TYPO)}, {blend}
            select b.chunk_id, r.source, round(b.score, 4) as score, case when t > 0 then round(t, 4) end as text_score, b.match_type, md5(r.content) as digest, r.position::bigint as position, r.boundary_id, {snip('p.content')} as before, {snip('n.content')} as after
            from best b join rows r on r.chunk_id = b.chunk_id left join rows p on p.source = r.source and p.position = r.position - 1 left join rows n on n.source = r.source and n.position = r.position + 1""",
        "search_within_budget": f"""with recursive {EXAMPLE}, {CHUNKS}, {_fuzzy(TYPO)}, {blend},
            running as (select b.chunk_id, round(b.score, 4) as score, token_count, sum(token_count) over (order by round(b.score, 4) desc, b.chunk_id rows unbounded preceding)::bigint as total_tokens from best b join rows r on r.chunk_id = b.chunk_id)
            select chunk_id, score, total_tokens from running where total_tokens - token_count < 1000""",
        "expand_siblings": f"""with recursive {BOUNDS}, {CLOSURE}, {CHUNKS}, hits as (select doc_id, chunk_id, boundary_id from rows where contains(lower(content), '{QUERY}')),
            up as (select doc_id, boundary_id, arg_min(ancestor_id, depth) as up from closure where ancestor_level = 2 group by all),
            aimed as (select h.*, coalesce(up, h.boundary_id) as expanded_id from hits h left join up u on u.doc_id = h.doc_id and u.boundary_id = h.boundary_id),
            goals as (select distinct doc_id, expanded_id as boundary_id from aimed where expanded_id is not null),
            under as (select r.doc_id, c.ancestor_id as boundary_id, r.position, r.content, r.token_count from rows r join closure c on c.doc_id = r.doc_id and c.boundary_id = r.boundary_id),
            running as (select u.*, sum(token_count) over (partition by u.doc_id, u.boundary_id order by position rows unbounded preceding) as used, row_number() over (partition by u.doc_id, u.boundary_id order by position) as n from under u join goals g on g.doc_id = u.doc_id and g.boundary_id = u.boundary_id),
            body as (select doc_id, boundary_id, string_agg(content, chr(10) || chr(10) order by position) filter (used <= {BUDGET} or n = 1) as body, max(used) filter (used <= {BUDGET} or n = 1)::bigint as used, count(*) as chunk_count from running group by all),
            near as (select g.doc_id, g.boundary_id, s.boundary_id as sibling_id, s.ord from goals g join bounds b on b.doc_id = g.doc_id and b.boundary_id = g.boundary_id join bounds s on s.doc_id = b.doc_id and s.parent_id = b.parent_id and s.boundary_id <> b.boundary_id),
            lists as (select n.doc_id, n.boundary_id, list({{'total': 0::bigint, 'blocked': 0::bigint, 'parts': []::varchar[], 'g': n.ord::bigint, 'tokens': u.token_count::bigint, 'content': u.content}} order by n.ord, u.position, u.token_count, u.content) as items
              from near n join under u on u.doc_id = n.doc_id and u.boundary_id = n.sibling_id group by all),
            folded as (select b.*, list_reduce(coalesce(items, []), lambda s, x: case when x.g <> s.blocked and s.total + x.tokens <= {BUDGET} then {{'total': s.total + x.tokens, 'blocked': s.blocked, 'parts': list_append(s.parts, x.content), 'g': 0::bigint, 'tokens': 0::bigint, 'content': ''}}
              else {{'total': s.total, 'blocked': x.g, 'parts': s.parts, 'g': 0::bigint, 'tokens': 0::bigint, 'content': ''}} end, {{'total': b.used, 'blocked': -1::bigint, 'parts': []::varchar[], 'g': 0::bigint, 'tokens': 0::bigint, 'content': ''}}) as f
              from body b left join lists l on l.doc_id = b.doc_id and l.boundary_id = b.boundary_id)
            select a.doc_id, a.chunk_id, a.expanded_id, i.type as expanded_type, md5(f.body || case when len(f.f.parts) > 0 then chr(10) || chr(10) || '---' || chr(10) || chr(10) || array_to_string(f.f.parts, chr(10) || chr(10)) else '' end) as digest,
              f.f.total as expanded_tokens, f.chunk_count from aimed a left join folded f on f.doc_id = a.doc_id and f.boundary_id = a.expanded_id left join bounds i on i.doc_id = f.doc_id and i.boundary_id = f.boundary_id""",
        "chunk_json": f"""with {CHUNKS} select '{{"chunk_id":' || to_json(chunk_id)::varchar || {sparse} || '}}' as json from rows""",
        "hash_embeddings": rf"""with {CHUNKS}, marks as (select chunk_id, ('0x' || substr(md5(w), 1, 15))::bigint as h from (select chunk_id, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+')) as w from rows)),
            summed as (select chunk_id, h % {vectors.DIMENSION} as place, sum(1 - 2 * ((h >> 40) & 1))::double as v from marks group by all), lengths as (select chunk_id, sqrt(sum(v * v)) as l from summed group by 1)
            select chunk_id, place, round((v / l)::float::double, 4) as value from summed join lengths using (chunk_id) where v <> 0""",
        "line_offsets": f"with {PLACED} select doc_id, line_no, start_offset, length(line) as chars, {NOISY} as noise from placed where line <> ''",
        "classify_lines": f"select n::bigint as n, line, type, case when type is not null then level::bigint end as level, case when type is not null then title end as title from (select n, line, {MARKED} from (values {quoted}) v(n, line))",
        "boundary_levels": "select distinct type, case type when 'document' then 0 when 'chapter' then 1 when 'section' then 2 when 'subsection' then 3 when 'page' then 4 when 'sheet' then 1 when 'slide' then 1 when 'row_group' then 2 else 3 end::bigint as level from boundaries where doc_id is not null and boundary_id is not null",
        "doc_boundaries": f"with {FOUND} select doc_id, ord, type, level::bigint as level, boundary_id, title, start_offset, parent_id from found",
        "regions": f"""with {FOUND}, spans as (select doc_id, ord + 1 as region, boundary_id, start_offset as a, lead(start_offset) over (partition by doc_id order by start_offset, ord) as b from found
            union all select d.doc_id, 0, null, 0, min(start_offset) from (select doc_id from documents where text is not null) d left join found f on f.doc_id = d.doc_id group by 1),
            texts as (select doc_id, region, boundary_id, {_strip("substr(text, (a + 1)::bigint, (coalesce(b, length(text)) - a)::bigint)")} as content from spans join documents using (doc_id))
            select doc_id, region, boundary_id, length(content) as chars, md5(content) as digest from texts where content <> ''""",
        "boundary_at_offset": f"""with {BOUNDS}, points as (select distinct doc_id, start_offset::bigint as "offset" from chunks where chunk_id is not null and start_offset is not null)
            select p.doc_id, p."offset", arg_max(b.boundary_id, (b.start_offset, b.level, -b.ord)) as boundary_id, arg_max(b.type, (b.start_offset, b.level, -b.ord)) as type
            from points p left join bounds b on b.doc_id = p.doc_id and b.start_offset <= p."offset" group by all""",
        "page_of_boundary": f"with {BOUNDS} select * from {PAGES}",
        "toc_counts": f"""with recursive {BOUNDS}, {CLOSURE}, {CHUNKS}, direct as (select doc_id, boundary_id, count(*) as n from rows where boundary_id is not null group by all),
            total as (select c.doc_id, c.ancestor_id as boundary_id, sum(n)::bigint as n from closure c join direct d on d.doc_id = c.doc_id and d.boundary_id = c.boundary_id group by all),
            shown as (select * from bounds where type in ('chapter', 'section', 'subsection') and level <= 3)
            select s.doc_id, s.ord::bigint as ord, s.boundary_id, s.type, s.level::bigint as level, s.title, p.boundary_id as parent_id, coalesce(d.n, 0) as chunk_count, coalesce(t.n, 0) as total_chunks, g.page
            from shown s left join direct d on d.doc_id = s.doc_id and d.boundary_id = s.boundary_id left join total t on t.doc_id = s.doc_id and t.boundary_id = s.boundary_id
            left join shown p on p.doc_id = s.doc_id and p.boundary_id = s.parent_id left join {PAGES} g on g.doc_id = s.doc_id and g.boundary_id = s.boundary_id""",
        "boundary_ancestors": f"with recursive {BOUNDS}, {CLOSURE} select doc_id, boundary_id, ancestor_id, ancestor_level::bigint as ancestor_level, depth::bigint as depth from closure",
        "ancestor_at_section": f"with recursive {BOUNDS}, {CLOSURE} select b.doc_id, b.boundary_id, arg_min(c.ancestor_id, c.depth) as ancestor_id from bounds b left join closure c on c.doc_id = b.doc_id and c.boundary_id = b.boundary_id and c.ancestor_level = 2 group by all",
        "boundary_siblings": f"with {BOUNDS} select a.doc_id, a.boundary_id, b.boundary_id as sibling_id from bounds a join bounds b on a.doc_id = b.doc_id and a.parent_id = b.parent_id and a.boundary_id <> b.boundary_id",
        "chunks_in_boundary": f"with recursive {BOUNDS}, {CLOSURE}, {CHUNKS} select r.doc_id, c.ancestor_id as boundary_id, r.chunk_id, r.position::bigint as position from rows r join closure c on c.doc_id = r.doc_id and c.boundary_id = r.boundary_id",
        "sentence_units": _sentences(),
        "token_counts": "select doc_id, " + TOKENS.replace("content", "text") + "::bigint as tokens from documents where text is not null",
        "chunk_neighbours": f"with {CHUNKS} select a.chunk_id as target_id, b.chunk_id, (b.position - a.position)::bigint as distance from rows a join rows b on a.source = b.source and b.position in (a.position - 1, a.position + 1)",
        "context_snippets": f"""with {CHUNKS}, around as (select chunk_id, lag(content) over w as p, lead(content) over w as n from rows window w as (partition by source order by position))
            select chunk_id, case when length(p) > 100 then substr(p, 1, 100) || '...' else p end as before, case when length(n) > 100 then substr(n, 1, 100) || '...' else n end as after from around""",
        "content_by_boundary": f"with recursive {BOUNDS}, {CLOSURE}, {CHUNKS}, items as (select r.doc_id, c.ancestor_id as boundary_id, r.position, r.content, r.token_count from rows r join closure c on c.doc_id = r.doc_id and c.boundary_id = r.boundary_id), {_budget('doc_id, boundary_id', 'items')}",
        "content_by_pages": f"with {CHUNKS}, items as (select doc_id, position, content, token_count from rows where page between 1 and 3), {_budget('doc_id', 'items')}",
        "content_by_positions": f"with {CHUNKS}, items as (select source, position, content, token_count from rows where position between 2 and 6), {_budget('source', 'items')}",
        "knn": f"with {EXAMPLE} select chunk_id, source, round(score, 6) as score from ({near} {examples}) order by score desc, chunk_id limit 10",
        "knn_index": f"with {EXAMPLE} select chunk_id, source, round(score, 6) as score from ({near} {examples}) order by score desc, chunk_id limit 10",
        "knn_one_source": f"with {EXAMPLE}, near as ({near} {examples} where source = '1') select chunk_id, round(score, 6) as score from (select * from near order by score desc, chunk_id limit 10)",
        "knn_per_source": f"with {EXAMPLE} select chunk_id, source, round(score, 6) as score, rank from (select *, {ranked} as rank from ({near} {examples})) where rank <= 10",
        "exact_search": f"with {CHUNKS} select chunk_id, round({cover}, 6) as text_score, 'exact_substring' as match_type from rows where contains(lower(content), '{QUERY}')",
        "token_search": rf"""with {CHUNKS}, scored as (select chunk_id, 0.75 * (len(list_intersect(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+'), {asked!r})) / {len(asked)}.0::double) as score from rows)
            select chunk_id, round(score, 6) as score from scored where score >= 0.3""",
        "hybrid_merge": f"""with {EXAMPLE}, {CHUNKS}, sem as (select chunk_id, score from (select *, {ranked} as rank from ({near} {usable})) where rank <= 10),
            txt as (select chunk_id, {cover} as text_score from rows where contains(lower(content), '{QUERY}')), w as (select count(*) as hits, avg(text_score) as mean from txt),
            merged as (select coalesce(s.chunk_id, t.chunk_id) as chunk_id, coalesce(score, 0) as s, coalesce(text_score, 0) as t, hits,
              case when hits = 0 then 0 when hits <= 3 then 0.5 * mean when hits <= 10 then 0.3 * mean else 0.1 end as weight from sem s full join txt t on s.chunk_id = t.chunk_id cross join w),
            blended as (select chunk_id, t, case when t >= 0.85 and hits <= 3 then greatest((1 - weight) * s + weight * t, 0.8) else (1 - weight) * s + weight * t end as score from merged)
            select chunk_id, round(score, 6) as score, case when t > 0 then round(t, 6) end as text_score, case when t > 0 then 'exact_substring' end as match_type from blended order by blended.score desc, chunk_id limit 20""",
        "expand_boundary": f"""with recursive {BOUNDS}, {CLOSURE}, {CHUNKS}, hits as (select doc_id, chunk_id, boundary_id from rows where contains(lower(content), '{QUERY}')),
            up as (select doc_id, boundary_id, arg_min(ancestor_id, depth) as up from closure where ancestor_level = 2 group by all),
            aimed as (select h.*, coalesce(up, h.boundary_id) as expanded_id from hits h left join up u on u.doc_id = h.doc_id and u.boundary_id = h.boundary_id),
            items as (select r.doc_id, c.ancestor_id as boundary_id, r.position, r.content, r.token_count from rows r join closure c on c.doc_id = r.doc_id and c.boundary_id = r.boundary_id),
            full_ as (select * from (with {_budget('doc_id, boundary_id', 'items')}))
            select a.doc_id, a.chunk_id, a.expanded_id, b.type as expanded_type, f.digest, f.total_tokens as expanded_tokens, f.chunk_count from aimed a
            left join full_ f on f.doc_id = a.doc_id and f.boundary_id = a.expanded_id left join bounds b on b.doc_id = f.doc_id and b.boundary_id = f.boundary_id""",
        "markdown_rows": f"select n_nationkey::bigint as n_nationkey, '| ' || {cell('n_nationkey')} || ' | ' || {cell('n_name')} || ' | ' || {cell('n_regionkey')} || ' |' as line from nation",
        "csv_rows": "select doc_id, " + " || ',' || ".join(map(csv, ("doc_id", "lang", "source", "path"))) + " as line from documents",
        "row_groups": """with ranked as (select *, row_number() over (order by c_custkey) as n from customer)
            select (n - 1) // 50 as row_group, min(n) + 1 as first_row, max(n) + 1 as last_row, md5('[Rows ' || (min(n) + 1) || '-' || (max(n) + 1) || ']' || chr(10) || '| c_custkey | c_name | c_mktsegment |' || chr(10) || '| --- | --- | --- |' || chr(10)
              || string_agg('| ' || c_custkey || ' | ' || coalesce(c_name, '') || ' | ' || coalesce(c_mktsegment, '') || ' |', chr(10) order by n)) as digest from ranked group by 1""",
        "read_truncated": "select doc_id, md5(substr(text, 1, 500)) as digest, length(text) > 500 as truncated, least(length(text), 500)::bigint as char_count from documents where text is not null",
        "source_names": f"""select doc_id, replace(regexp_replace({base}, '^(.+)\\.[^.]*$', '\\1'), ' ', '_') as name, replace(replace(path, ' ', '_'), '/', '_') as custom_name,
            case lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1)) when '.txt' then 'text' when '.md' then 'markdown' when '.markdown' then 'markdown' when '.pdf' then 'pdf' when '.docx' then 'docx'
              when '.pptx' then 'pptx' when '.xlsx' then 'xlsx' when '.xls' then 'xlsx' end as read_as from documents where path is not null""",
        "list_sources": f"with {CHUNKS} select source, count(*) as chunks from rows where source is not null group by 1",
        "event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as hour, event_type, count(*) as n from events group by all",
    } | planted.oracle_sql(CHUNKS)
