"""Small files of every format, filled from the fixed tables ``region`` (5 rows) and ``nation`` (25), and the queries that
read, index and ask them; their SQL builds the expected rows from the same tables."""

from __future__ import annotations

import io
import json
import os
import uuid
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.api import Engine
from corpusloom.operators import vectors
from corpusloom.operators.structure import boundary_rows
from corpusloom.plans import corpus
from corpusloom.runtime import cut, shared_dir, table
from corpusloom.schema import ChunkOptions
from corpusloom.sources import files
from corpusloom.sources.store import Store
from corpusloom.validate import InvalidRequest, validate

WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DRAW = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
NOTE = "Speak slowly."


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as pack:
        for name, text in parts.items():
            pack.writestr(name, text)
    return out.getvalue()


def _links(*items: tuple[str, str, str]) -> str:
    return "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'>" + "".join(f"<Relationship Id='{i}' Type='x/{t}' Target='{p}'/>" for i, t, p in items) + "</Relationships>"


def docx(regions: list[tuple[int, str]], nations: list[tuple[int, str, int]]) -> bytes:
    def para(text: str, style: str = "", extra: str = "") -> str:
        return f"<w:p><w:pPr>{f'<w:pStyle w:val={chr(34)}{style}{chr(34)}/>' if style else ''}{extra}</w:pPr><w:r><w:t>{escape(text)}</w:t></w:r></w:p>"

    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{para(str(c))}</w:tc>" for c in cells) + "</w:tr>"
    body = para("Nations", "H1")
    for k, name in regions:
        own = [(n, x) for n, x, r in nations if r == k]
        body += para(name, "H2", "<w:pageBreakBefore/>" if k else "") + para(f"Region {k} has {len(own)} nations.")
        body += f"<w:tbl>{row('Key', 'Name')}{''.join(row(*x) for x in own)}</w:tbl>"
    styles = f"<w:styles {WORD}><w:style w:styleId='H1'><w:name w:val='heading 1'/></w:style><w:style w:styleId='H2'><w:name w:val='heading 2'/></w:style></w:styles>"
    return _zip({"word/document.xml": f"<w:document {WORD}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles})


def pptx(regions: list[tuple[int, str]], nations: list[tuple[int, str, int]]) -> bytes:
    lines = lambda xs: "".join(f"<a:p><a:r><a:t>{escape(str(x))}</a:t></a:r></a:p>" for x in xs)
    shape = lambda kind, xs: f"<p:sp><p:nvSpPr><p:nvPr><p:ph type='{kind}'/></p:nvPr></p:nvSpPr><p:txBody>{lines(xs)}</p:txBody></p:sp>"
    page = lambda inner: f"<p:sld {DRAW}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"
    parts = {
        "ppt/presentation.xml": f"<p:presentation {DRAW}><p:sldIdLst>{''.join(f'<p:sldId r:id={chr(34)}r{k}{chr(34)}/>' for k, _ in regions)}</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": _links(*[(f"r{k}", "slide", f"slides/s{k}.xml") for k, _ in regions]),
        "ppt/slides/_rels/s0.xml.rels": _links(("n", "notesSlide", "../notes/n0.xml")), "ppt/notes/n0.xml": page(shape("body", [NOTE])),
    }
    for k, name in regions:
        own = [x for _, x, r in nations if r == k]
        grid = "".join(f"<a:tr><a:tc><a:txBody>{lines([c])}</a:txBody></a:tc></a:tr>" for c in ("Count", len(own)))
        parts[f"ppt/slides/s{k}.xml"] = page(shape("title", [name]) + shape("body", own) + f"<p:graphicFrame><a:tbl>{grid}</a:tbl></p:graphicFrame>")
    return _zip(parts)


def xlsx(regions: list[tuple[int, str]], nations: list[tuple[int, str, int]]) -> bytes:
    def rows(values: list[tuple]) -> str:
        cell = lambda at, v: f"<c r='{at}'><v>{v}</v></c>" if isinstance(v, int) else f"<c r='{at}' t='inlineStr'><is><t>{escape(v)}</t></is></c>"
        return "".join(f"<row>{''.join(cell(f'{chr(65 + j)}{i}', v) for j, v in enumerate(r) if v is not None)}</row>" for i, r in enumerate(values, 1))

    sheets = {"nation": [("n_nationkey", "n_name", "n_regionkey"), *nations], "pairs": [("nation", "region"), *[(n, r) for _, n, _ in nations for _, r in regions]], "void": []}
    return _zip({
        "xl/workbook.xml": f"<workbook {SHEET}><sheets>{''.join(f'<sheet name={chr(34)}{n}{chr(34)} r:id={chr(34)}{n}{chr(34)}/>' for n in sheets)}</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": _links(*[(n, "worksheet", f"worksheets/{n}.xml") for n in sheets]),
        **{f"xl/worksheets/{n}.xml": f"<worksheet {SHEET}><sheetData>{rows(v)}</sheetData></worksheet>" for n, v in sheets.items()},
    })


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(data)
    out.close()


def folder(spark: SparkSession) -> str:
    """A new folder of the shared directory."""
    return os.path.join(shared_dir(spark), f"planted-{uuid.uuid4().hex[:12]}")


def plant(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file of every format, and one of a kind that isn't read."""
    regions = [tuple(r) for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect()]
    nations = [tuple(r) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]
    at = folder(spark)
    guide = "# Regions\n" + "".join(f"\n## {name}\n\nRegion number {k} is {name}.\n" for k, name in regions)
    for name, data in {
        "my notes.txt": "\r\n".join(n for _, n in regions).encode(), "guide.md": guide.encode(), "report.docx": docx(regions, nations),
        "deck.pptx": pptx(regions, nations), "book.xlsx": xlsx(regions, nations), "other.bin": b"x",
    }.items():
        _put(spark, os.path.join(at, name), data)
    return at


def files_scanned(spark, d):
    out = files.load_documents(spark, plant(spark, d))
    return out.select("source", "file_type", F.length("content").cast("bigint").alias("chars"), F.md5("content").alias("digest"))


def file_boundaries(spark, d):
    out = boundary_rows(files.load_documents(spark, plant(spark, d)), ["source"], "loader")
    return out.select("source", F.col("ord").cast("bigint").alias("ord"), "type", F.col("level").cast("bigint").alias("level"), "boundary_id", "title", F.col("start_offset").cast("bigint").alias("start_offset"), "parent_id")


def file_facts(spark, d):
    out = files.load_documents(spark, plant(spark, d)).select("source", F.explode_outer("facts").alias("fact", "value"))
    return out.where("fact is not null and fact <> 'file_size'")


def file_tables(spark, d):
    at = plant(spark, d)
    out = files.list_tables(spark, [os.path.join(at, n) for n in ("report.docx", "deck.pptx", "book.xlsx")])
    return out.select(files.source_name(F.col("path")).alias("source"), F.col("table_index").cast("bigint").alias("table_index"), "location", F.array_join("headers", ",").alias("headers"), F.col("row_count").cast("bigint").alias("row_count"), F.col("col_count").cast("bigint").alias("col_count"))


def table_lines(spark, d):
    """CSV lines of single tables: all rows with header, at most three, without header."""
    at, rows = plant(spark, d), []
    for name, index, most, heads in (("report.docx", 1, None, True), ("deck.pptx", 2, None, True), ("book.xlsx", 0, 3, True), ("book.xlsx", 1, None, False)):
        got = files.extract_table(spark, os.path.join(at, name), index, most)
        rows += [(name, index, k, line) for k, line in enumerate(files.table_csv(got, heads).split("\r\n")[:-1])]
    return spark.createDataFrame(rows, "file string, table_index bigint, line_no bigint, line string")


def _stored(spark: SparkSession, d: str) -> Store:
    """An index of the driver's whole chunk, boundary and vector tables."""
    store = Store(spark, folder(spark))
    chunks = corpus.chunks(spark, d).withColumn("source", F.coalesce("source", F.lit("unknown")))
    rows = cut(chunks.select(*[c for c in ("chunk_id", "position", "total_chunks", "content", "token_count", "boundary_type", "boundary_id", "boundary_level", "parent_boundary", "boundary_title", "page", "section", "sheet", "slide", "source")]))
    bounds = table(spark, d, "boundaries").where("doc_id is not null and boundary_id is not null").groupBy("doc_id", "boundary_id").agg(F.max_by(F.struct("source", "ord", "type", "level", "title", "start_offset", "parent_id"), "indexed_at").alias("r")).select("boundary_id", "r.*").withColumn("source", F.coalesce("source", F.lit("unknown")))
    space = corpus.vectors(spark, d)
    docs = rows.select("source").distinct().select("source", F.col("source").alias("path"), F.lit("text").alias("file_type"))
    store.save(docs, rows, bounds.join(docs.select("source"), "source", "left_semi"), lambda written: space.select("chunk_id", "embedding").join(written.select("chunk_id", "source"), "chunk_id"))
    return store


def store_counts(spark, d):
    """Rows of each source in every table of the index, after the hot source was dropped."""
    store = _stored(spark, d)
    store.drop("facility_logbook")
    parts = [store.read(t).groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("tbl", F.lit(t)) for t in ("chunks", "boundaries", "vectors", "words", "manifest")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("tbl", "source", "n")


def store_round_trip(spark, d):
    """Chunks after a way through the index, JSON lines and back."""
    store = _stored(spark, d)
    path = folder(spark)
    store.export_jsonl("chunks", path)
    out = store.import_jsonl("chunks", path)
    return out.select("chunk_id", F.md5("content").alias("digest"), F.col("position").cast("bigint").alias("position"), "boundary_id", F.col("page").cast("bigint").alias("page"), "sheet", "source")


def _flat(value: object, name: str = "") -> list[tuple[str, str]]:
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in _flat(v, f"{name}.{k}" if name else k)]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in _flat(v, f"{name}[{i}]")]
    return [(name, "null" if value is None else json.dumps(value) if isinstance(value, (bool, float)) else str(value))]


#: Requests in order over the planted files.
ASKED = [
    ("doc_list", {}), ("doc_index", {"file_path": "guide.md"}), ("doc_index", {"file_path": "report.docx", "source_name": "the_report"}), ("doc_index", {"file_path": "book.xlsx"}),
    ("doc_index", {"file_path": "guide.md"}), ("doc_toc", {"source_name": "guide"}), ("doc_toc", {"source_name": "nothing"}), ("doc_get_content", {"source_name": "guide", "boundary_id": "section:2"}),
    ("doc_get_content", {"source_name": "guide", "section": "africca"}), ("doc_get_content", {"source_name": "guide", "pages": "7"}), ("doc_get_content", {"source_name": "the_report", "pages": "2"}),
    ("doc_get_content", {"source_name": "guide"}), ("doc_chunk", {"chunk_id": "guide:1", "neighbors": 1}), ("doc_chunk", {"chunk_id": "guide:99"}), ("read_document", {"file_path": "my notes.txt", "include_metadata": False}),
    ("list_tables", {"file_path": "report.docx"}), ("extract_table", {"file_path": "book.xlsx", "table_index": 0, "max_rows": 1}), ("extract_table", {"file_path": "book.xlsx", "table_index": 9}), ("doc_index", {"file_path": "gone.md"}),
]


#: Fields that other queries compare.
TOLD_ELSEWHERE = {"target_id", "total_chunks", "token_count", "boundary_type", "boundary_level", "parent_boundary", "boundary_title", "type", "level", "file_type", "has_boundaries"}


def request_answers(spark, d):
    """What the requests answer, value by value; of texts that are free to word only that they are there."""
    at = plant(spark, d)
    engine = Engine(spark, folder(spark), at.removeprefix("file://").removeprefix("file:"))
    rows = []
    for n, (name, arguments) in enumerate(ASKED):
        answer = json.loads(engine.call(name, arguments))
        rows += [(n, name, k, "given" if k in ("error", "suggestion") else v) for k, v in _flat(answer) if k.rpartition(".")[2] not in TOLD_ELSEWHERE]
    return spark.createDataFrame(rows, "n bigint, request string, field string, value string")


#: Requests that break a rule, and the argument that the error names.
BROKEN = [
    ("doc_index", {}, "file_path"), ("doc_index", {"file_path": "a.exe"}, "file_path"), ("doc_index", {"file_path": "a.md", "source_name": "a b"}, "source_name"), ("doc_search", {"query": " "}, "query"), ("doc_search", {"query": "x" * 10_001}, "query"),
    ("doc_search", {"query": "q", "top_k": 0}, "top_k"), ("doc_search", {"query": "q", "expand_to_boundary": "word"}, "expand_to_boundary"), ("doc_search", {"query": "q", "max_return_tokens": 99}, "max_return_tokens"), ("doc_search", {"query": "q", "sources": ["a", " "]}, "sources.1"),
    ("doc_chunk", {"chunk_id": "x"}, "chunk_id"), ("doc_chunk", {"chunk_id": "x:1", "neighbors": 51}, "neighbors"), ("read_document", {"file_path": "a.md", "max_chars": 99}, "max_chars"), ("list_tables", {"file_path": "a.pptx"}, "file_path"), ("extract_table", {"file_path": "a.xlsx", "table_index": -1}, "table_index"),
    ("doc_toc", {"source_name": "s", "max_depth": 5}, "max_depth"), ("doc_get_content", {"source_name": "s"}, None), ("doc_get_content", {"source_name": "s", "chapter": "a", "pages": "1"}, None), ("doc_get_content", {"source_name": "s", "pages": "1-"}, "pages"), ("nothing", {}, None),
    ("doc_list", {}, "accepted"), ("doc_search", {"query": "q"}, "accepted"),
]


def request_errors(spark, d):
    rows = []
    for n, (name, arguments, _) in enumerate(BROKEN):
        try:
            validate(name, arguments)
            rows.append((n, name, "accepted"))
        except InvalidRequest as bad:
            rows.append((n, name, bad.field))
    return spark.createDataFrame(rows, "n bigint, request string, field string")


#: Options and the rule they break.
OPTIONS = [((256, 32, 1024, 64), "none"), ((16, 8, 64, 8), "chunk_size"), ((64, 64, 128, 8), "chunk_overlap"), ((64, 8, 32, 8), "max_chunk_size"), ((64, 8, 128, 65), "min_chunk_size"), ((32, 0, 32, 32), "none")]


def option_rules(spark, d):
    rows = []
    for n, (sizes, _) in enumerate(OPTIONS):
        try:
            ChunkOptions(*sizes).validate()
            rows.append((n, "none"))
        except ValueError as bad:
            rows.append((n, str(bad).split()[0]))
    return spark.createDataFrame(rows, "n bigint, rule string")


def _field(number: int, value: int | bytes | str) -> bytes:
    """One field of the binary message format that model files are written in."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    data = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(data)) + data


#: Words of the planted model, and its weights by token and place.
VOCABULARY = ["[UNK]", "[CLS]", "[SEP]", "[PAD]", "africa", "asia", "middle", "east"]
WIDTH = 4


def model_files(spark: SparkSession) -> tuple[str, str]:
    """A look-up model (one state per token) as an ONNX file, and its word tokenizer."""
    import tempfile

    import numpy as np

    weights = np.array([[(7 * i + 3 * j) % 11 - 5 for j in range(WIDTH)] for i in range(len(VOCABULARY))], np.float32)
    tensor = _field(1, len(VOCABULARY)) + _field(1, WIDTH) + _field(2, 1) + _field(8, "table") + _field(9, weights.tobytes())

    def info(name: str, kind: int, *dims: str) -> bytes:
        shape = b"".join(_field(1, _field(2, x)) for x in dims)
        return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))

    node = _field(1, "table") + _field(1, "input_ids") + _field(2, "states") + _field(4, "Gather")
    graph = _field(1, node) + _field(2, "lookup") + _field(5, tensor) + _field(11, info("input_ids", 7, "b", "n")) + _field(12, info("states", 1, "b", "n", "w"))
    at = tempfile.mkdtemp(prefix="corpusloom-model-")  # the driver's own; the job ships both files
    paths = os.path.join(at, "lookup.onnx"), os.path.join(at, "lookup_words.json")
    open(paths[0], "wb").write(_field(1, 8) + _field(8, _field(2, 13)) + _field(7, graph))
    special = [{"id": i, "content": VOCABULARY[i], "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for i in range(4)]
    piece = lambda t, x: {t: {"id": x, "type_id": 0}}
    json.dump({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": special, "normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "Whitespace"}, "decoder": None,
        "post_processor": {"type": "TemplateProcessing", "single": [piece("SpecialToken", "[CLS]"), piece("Sequence", "A"), piece("SpecialToken", "[SEP]")], "pair": [piece("Sequence", "A"), piece("Sequence", "B")],
            "special_tokens": {t: {"id": t, "ids": [VOCABULARY.index(t)], "tokens": [t]} for t in ("[CLS]", "[SEP]")}},
        "model": {"type": "WordLevel", "vocab": {w: i for i, w in enumerate(VOCABULARY)}, "unk_token": "[UNK]"},
    }, open(paths[1], "w"))
    return paths


def model_embeddings(spark, d):
    """Texts through tokenizer, model, mean pooling and scaling; cut at three tokens, null for a null text."""
    model = vectors.EmbeddingModel(*model_files(spark), WIDTH, 3, "mean", 2)
    rows = table(spark, d, "region").select("r_regionkey", "r_name").union(spark.createDataFrame([(-1, None)], "r_regionkey int, r_name string"))
    out = vectors.embed_with_model(rows, model, "r_name")
    return out.select(F.col("r_regionkey").cast("bigint").alias("r_regionkey"), F.posexplode_outer("embedding").alias("place", "value")).select("r_regionkey", F.col("place").cast("bigint").alias("place"), F.round(F.col("value").cast("double"), 4).alias("value"))


#: Available devices, the forced one, and the order that follows.
DEVICES = [("CPU", "", "CPU"), ("CUDA,CPU", "", "CUDA,CPU"), ("CoreML,CPU", "", "CoreML,CPU"), ("CPU,CoreML,CUDA", "", "CUDA,CPU"), ("CUDA,CPU", "cpu", "CPU"), ("CPU", "cuda", "CPU"), ("CUDA,CoreML,CPU", "coreml", "CoreML,CPU")]


def device_order(spark, d):
    full = lambda names: [f"{n}ExecutionProvider" for n in names.split(",")]
    rows = []
    for n, (have, forced, _) in enumerate(DEVICES):
        order = vectors.onnx_providers(full(have), forced or "auto")
        rows.append((n, ",".join(p.removesuffix("ExecutionProvider") for p in order), vectors.default_batch_size(order[0])))
    return spark.createDataFrame(rows, "n bigint, providers string, batch_size bigint")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        files_scanned, file_boundaries, file_facts, file_tables, table_lines, store_counts, store_round_trip, request_answers, request_errors, option_rules, model_embeddings, device_order,
    )}


# --- SQL ----------------------------------------------------------------------------------------------------------

LF = "chr(10)"
GAP = "chr(10) || chr(10)"
REPORT = f"""(select '# Nations' || string_agg({GAP} || case when r_regionkey > 0 then '[Page ' || (r_regionkey + 1) || ']' || {GAP} else '' end || '## ' || r_name || {GAP} || 'Region ' || r_regionkey || ' has ' || n || ' nations.' || {GAP}
  || '| Key | Name |' || {LF} || '| --- | --- |' || lines, '' order by r_regionkey) as content
  from region join (select n_regionkey, count(*) as n, string_agg({LF} || '| ' || n_nationkey || ' | ' || n_name || ' |', '' order by n_nationkey) as lines from nation group by 1) on n_regionkey = r_regionkey)"""
DECK = f"""(select string_agg('[Slide ' || (r_regionkey + 1) || ': ' || r_name || ']' || {LF} || names || {LF} || '| Count |' || {LF} || '| --- |' || {LF} || '| ' || n || ' |'
  || case when r_regionkey = 0 then {GAP} || '[Notes:]' || {LF} || '{NOTE}' else '' end, {GAP} order by r_regionkey) as content
  from region join (select n_regionkey, count(*) as n, string_agg(n_name, {LF} order by n_nationkey) as names from nation group by 1) on n_regionkey = r_regionkey)"""
GROUPS = f"""rows_ as (select 1 as sheet, row_number() over (order by n_nationkey) + 1 as i, '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' as line from nation
    union all select 2, row_number() over (order by n_nationkey, r_regionkey) + 1, '| ' || n_name || ' | ' || r_name || ' |' from nation, region),
  groups as (select sheet, (i - 2) // 50 as g, min(i) as a, max(i) as b, string_agg({LF} || line, '' order by i) as lines from rows_ group by all),
  parts as (select 1 as sheet, -1 as g, '[Sheet: nation]' as part, null as a, null as b union all select 2, -1, '[Sheet: pairs]', null, null union all select 3, -1, '[Sheet: void]', null, null union all select 3, 0, '*Empty sheet*', null, null
    union all select sheet, g, '[Rows ' || a || '-' || b || ']' || {LF} || case sheet when 1 then '| n_nationkey | n_name | n_regionkey |' || {LF} || '| --- | --- | --- |' else '| nation | region |' || {LF} || '| --- | --- |' end || lines, a, b from groups)"""
GUIDE = f"(select '# Regions' || {LF} || string_agg({LF} || '## ' || r_name || {GAP} || 'Region number ' || r_regionkey || ' is ' || r_name || '.' || {LF}, '' order by r_regionkey) as content from region)"
#: Names of the five regions in order of their keys (fixed values of the table).
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def _answers() -> list[tuple[int, str, str]]:
    """Known answers to :data:`ASKED`."""
    section = [f"## {n}\n\nRegion number {k} is {n}." for k, n in enumerate(REGIONS)]
    toc = [("source_name", "guide"), ("toc[0].boundary_id", "chapter:1"), ("toc[0].title", "Regions"), ("toc[0].chunk_count", "1"), ("total_entries", "6")]
    for k, n in enumerate(REGIONS):
        toc += [(f"toc[0].children[{k}].boundary_id", f"section:{k + 1}"), (f"toc[0].children[{k}].title", n), (f"toc[0].children[{k}].chunk_count", "1")]
    found = lambda k, tokens: [("source_name", "guide"), ("boundary_id", f"section:{k + 1}"), ("content", section[k]), ("total_tokens", tokens), ("chunk_count", "1"), ("truncated", "false")]
    table_of = lambda k: [(f"tables[{k}].table_index", str(k)), (f"tables[{k}].location", f"Table {k + 1}"), (f"tables[{k}].headers[0]", "Key"), (f"tables[{k}].headers[1]", "Name"), (f"tables[{k}].row_count", "5"), (f"tables[{k}].col_count", "2")]
    missing = [("error", "given"), ("field", "source_name"), ("suggestion", "given")]
    chunk = lambda at, k, text, extra=(): [(f"{at}.chunk_id", f"guide:{k}"), (f"{at}.source", "guide"), (f"{at}.position", str(k)), (f"{at}.boundary_id", f"section:{k}" if k else "chapter:1"), (f"{at}.content", text), *extra]
    second = [("source_name", "the_report"), ("content", "[Page 2]\n\n## AMERICA\n\nRegion 1 has 5 nations.\n\n| Key | Name |\n| --- | --- |\n" + "\n".join(f"| {k} | NATION_{k} |" for k in range(1, 25, 5))), ("total_tokens", "52"), ("chunk_count", "2"), ("truncated", "false")]
    csv = [("file_path", "book.xlsx"), ("table_index", "0"), ("location", "nation"), *[(f"headers[{k}]", h) for k, h in enumerate(("n_nationkey", "n_name", "n_regionkey"))], ("row_count", "1"), ("col_count", "3"), ("csv", "n_nationkey,n_name,n_regionkey\r\n0,NATION_0,0\r\n")]
    answers = [
        [("count", "0")], [("source", "guide"), ("chunks", "6")], [("source", "the_report"), ("chunks", "10")], [("source", "book"), ("chunks", "7")], [("source", "guide"), ("chunks", "6")], toc, missing, found(1, "9"), found(0, "9"),
        [("error", "given"), ("suggestion", "given")], second, [("error", "given"), ("suggestion", "given")],
        chunk("chunk", 1, section[0]) + chunk("neighbors[0]", 0, "# Regions", [("neighbors[0].distance", "-1")]) + chunk("neighbors[1]", 2, section[1], [("neighbors[1].distance", "1")]),
        [("error", "given"), ("field", "chunk_id"), ("suggestion", "given")], [("content", "\n".join(REGIONS)), ("truncated", "false"), ("char_count", "38")], [x for k in range(5) for x in table_of(k)] + [("count", "5")], csv, [("error", "given")], [("error", "given"), ("suggestion", "given")],
    ]
    return [(n, ASKED[n][0], k, v) for n, rows in enumerate(answers) for k, v in rows]


def _values(rows: list[tuple]) -> str:
    cell = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


def oracle_sql(chunks: str) -> dict[str, str]:
    """``chunks``: the CTE ``rows`` of the latest chunks."""
    bounds = "bounds as (select boundary_id, coalesce(r.source, 'unknown') as source from (select doc_id, boundary_id, arg_max({'source': source}, indexed_at) as r from boundaries where doc_id is not null and boundary_id is not null group by all))"
    spaces = "space as (select r.c as chunk_id from (select vec_id, arg_max({'c': chunk_id}, indexed_at) as r from chunk_vectors where vec_id is not null group by 1))"
    word_list = "[" + ", ".join(f"'{w}'" for w in VOCABULARY) + "]"
    return {
        "files_scanned": f"""with {GROUPS}, all_ as (select 'report' as source, 'docx' as file_type, content from {REPORT} union all select 'deck', 'pptx', content from {DECK} union all select 'guide', 'markdown', content from {GUIDE}
            union all select 'my_notes', 'text', (select string_agg(r_name, {LF} order by r_regionkey) from region) union all select 'book', 'xlsx', (select string_agg(part, {GAP} order by sheet, g) from parts))
            select source, file_type, length(content) as chars, md5(content) as digest from all_""",
        "file_boundaries": f"""with {GROUPS}, at_ as (select *, coalesce(sum(length(part) + 2) over (order by sheet, g rows between unbounded preceding and 1 preceding), 0)::bigint as start_offset from parts)
            select 'book' as source, row_number() over (order by sheet, g) - 1 as ord, case when a is null then 'sheet' else 'row_group' end as type, case when a is null then 1 else 2 end::bigint as level,
              case when a is null then 'sheet:' || sheet else 'sheet:' || sheet || ':rows:' || a || '-' || b end as boundary_id, case when a is null then part[9:-2] else case sheet when 1 then 'nation' else 'pairs' end || ' rows ' || a || '-' || b end as title,
              start_offset, case when a is not null then 'sheet:' || sheet end as parent_id from at_ where part <> '*Empty sheet*'
            union all select 'deck', r_regionkey, 'slide', 1, 'slide:' || (r_regionkey + 1), r_name, instr(content, '[Slide ' || (r_regionkey + 1) || ':') - 1, null from region, {DECK}
            union all select 'report', r_regionkey - 1, 'page', 4, 'page:' || (r_regionkey + 1), (r_regionkey + 1)::varchar, instr(content, '[Page ' || (r_regionkey + 1) || ']') - 1, null from region, {REPORT} where r_regionkey > 0""",
        "file_facts": "select * from (select 'book' as source, 'sheets' as fact, 'nation,pairs,void' as value union all select 'book', 'total_rows', ((select count(*) from nation) + 1 + (select count(*) from nation, region) + 1)::varchar "
            "union all select 'deck', unnest(['total_slides', 'slides']), (select count(*) from region)::varchar union all select 'deck', 'has_notes', 'true' union all select 'report', unnest(['total_pages', 'pages', 'tables']), (select count(*) from region)::varchar union all select 'report', 'headings', (select count(*) + 1 from region)::varchar)",
        "file_tables": "select 'book' as source, 0::bigint as table_index, 'nation' as location, 'n_nationkey,n_name,n_regionkey' as headers, (select count(*) from nation) as row_count, 3::bigint as col_count union all select 'book', 1, 'pairs', 'nation,region', (select count(*) from nation, region), 2 union all select 'book', 2, 'void', '', 0, 0 "
            "union all select 'deck', r_regionkey, 'Slide ' || (r_regionkey + 1), 'Count', 1, 1 from region union all select 'report', r_regionkey, 'Table ' || (r_regionkey + 1), 'Key,Name', (select count(*) from nation where n_regionkey = r_regionkey), 2 from region",
        "table_lines": "select 'report.docx' as file, 1::bigint as table_index, 0::bigint as line_no, 'Key,Name' as line union all select 'report.docx', 1, row_number() over (order by n_nationkey), n_nationkey || ',' || n_name from nation where n_regionkey = 1 "
            "union all select 'deck.pptx', 2, 0, 'Count' union all select 'deck.pptx', 2, 1, (select count(*)::varchar from nation where n_regionkey = 2) union all select 'book.xlsx', 0, 0, 'n_nationkey,n_name,n_regionkey' "
            "union all select * from (select 'book.xlsx', 0, row_number() over (order by n_nationkey) as i, n_nationkey || ',' || n_name || ',' || n_regionkey from nation) where i <= 3 union all select 'book.xlsx', 1, row_number() over (order by n_nationkey, r_regionkey) - 1, n_name || ',' || r_name from nation, region",
        "store_counts": f"""with {chunks}, {bounds}, {spaces}, own as (select *, coalesce(source, 'unknown') as s from rows)
            select tbl, source, count(*) as n from (select 'chunks' as tbl, s as source from own union all select 'boundaries', source from bounds where source in (select s from own) union all select 'vectors', s from own join space using (chunk_id)
              union all select 'words', s from (select distinct chunk_id, s, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+')) from own) union all select distinct 'manifest', s from own) where source <> 'facility_logbook' group by all""",
        "store_round_trip": f"with {chunks} select chunk_id, md5(content) as digest, position::bigint as position, boundary_id, page::bigint as page, sheet, coalesce(source, 'unknown') as source from rows",
        "request_answers": f"select n::bigint as n, request, field, value from {_values(_answers())} v(n, request, field, value)",
        "request_errors": f"select n::bigint as n, request, field from {_values([(n, name, field) for n, (name, _, field) in enumerate(BROKEN)])} v(n, request, field)",
        "option_rules": f"select n::bigint as n, rule from {_values([(n, rule) for n, (_, rule) in enumerate(OPTIONS)])} v(n, rule)",
        "device_order": f"select n::bigint as n, providers, case split_part(providers, ',', 1) when 'CUDA' then 128 when 'CoreML' then 64 else 8 end::bigint as batch_size from {_values([(n, order) for n, (_, _, order) in enumerate(DEVICES)])} v(n, providers)",
        "model_embeddings": f"""with coded as (select r_regionkey, list_concat([1], list_transform(string_split(lower(r_name), ' ')[:1], lambda w: coalesce(list_position({word_list}, w) - 1, 0)), [2]) as ids from region),
            states as (select r_regionkey, place, avg((7 * id + 3 * place) % 11 - 5) as v from (select r_regionkey, unnest(ids) as id from coded), generate_series(0, {WIDTH - 1}) p(place) group by all),
            lengths as (select r_regionkey, sqrt(sum(v * v)) as l from states group by 1)
            select r_regionkey::bigint as r_regionkey, place::bigint as place, round((v / l)::float::double, 4) as value from states join lengths using (r_regionkey) union all select -1, null, null""",
    }
