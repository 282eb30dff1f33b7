import io
import json
import zipfile

import pytest

from corpusloom.functions import tables as tab
from corpusloom.functions.text import source_name
from corpusloom.sources import files, office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def rels(*items):
    return "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'>" + "".join(f"<Relationship Id='{i}' Type='x/{t}' Target='{p}'/>" for i, t, p in items) + "</Relationships>"


def docx():
    para = lambda t, style="", extra="": f"<w:p><w:pPr>{f'<w:pStyle w:val={chr(34)}{style}{chr(34)}/>' if style else ''}{extra}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in cells) + "</w:tr>"
    body = para("Title", "H1") + para("Intro") + f"<w:tbl>{row('A', 'B')}{row('1', 'x|y')}</w:tbl>" + para("Next", "H2", "<w:pageBreakBefore/>") + para("off", "", "<w:pageBreakBefore w:val='false'/>") + "<w:p/>"
    styles = f"<w:styles {W}><w:style w:styleId='H1'><w:name w:val='heading 1'/></w:style><w:style w:styleId='H2'><w:name w:val='Heading 2'/></w:style></w:styles>"
    return packed({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles})


def pptx():
    shape = lambda kind, *lines: f"<p:sp><p:nvSpPr><p:nvPr><p:ph type='{kind}'/></p:nvPr></p:nvSpPr><p:txBody>" + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in lines) + "</p:txBody></p:sp>"
    table = "<p:graphicFrame><a:tbl><a:tr>" + "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>{x}</a:t></a:r></a:p></a:txBody></a:tc>" for x in ("H", "I")) + "</a:tr></a:tbl></p:graphicFrame>"
    slide = lambda inner: f"<p:sld {A}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"
    return packed({
        "ppt/presentation.xml": f"<p:presentation {A}><p:sldIdLst><p:sldId r:id='r2'/><p:sldId r:id='r1'/></p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": rels(("r1", "slide", "slides/s1.xml"), ("r2", "slide", "slides/s2.xml")),
        "ppt/slides/s1.xml": slide(shape("body", "No title") + table), "ppt/slides/s2.xml": slide(shape("title", "Hello") + shape("body", "one", "two")),
        "ppt/slides/_rels/s2.xml.rels": rels(("n", "notesSlide", "../notes/n1.xml")), "ppt/notes/n1.xml": slide(shape("body", "remember")),
    })


def xlsx(rows=3):
    cell = lambda r, c, v: f"<c r='{c}{r}'><v>{v}</v></c>"
    body = "<row><c r='A1' t='s'><v>0</v></c><c r='C1' t='inlineStr'><is><t>In</t></is></c></row><row/>" + "".join(f"<row>{cell(i, 'A', i)}{cell(i, 'B', i + 0.5)}</row>" for i in range(2, rows + 2))
    return packed({
        "xl/workbook.xml": f"<workbook {S}><sheets><sheet name='Data' r:id='a'/><sheet name='Void' r:id='b'/></sheets></workbook>", "xl/_rels/workbook.xml.rels": rels(("a", "worksheet", "worksheets/1.xml"), ("b", "worksheet", "/xl/worksheets/2.xml")),
        "xl/sharedStrings.xml": f"<sst {S}><si><t>Na</t><t>me</t></si></sst>", "xl/worksheets/1.xml": f"<worksheet {S}><sheetData>{body}</sheetData></worksheet>", "xl/worksheets/2.xml": f"<worksheet {S}><sheetData/></worksheet>",
    })


def test_docx():
    text, bounds, facts, tables = office.read_docx(docx())
    assert text == "# Title\n\nIntro\n\n| A | B |\n| --- | --- |\n| 1 | x\\|y |\n\n[Page 2]\n\n## Next\n\noff"
    assert [(b["boundary_id"], text[b["start_offset"] :][:8]) for b in bounds] == [("page:2", "[Page 2]")] and facts["total_pages"] == "2"
    assert tables == [("Table 1", [["A", "B"], ["1", "x|y"]])]


def test_pptx():
    text, bounds, facts, tables = office.read_pptx(pptx())
    assert text == "[Slide 1: Hello]\none\ntwo\n\n[Notes:]\nremember\n\n[Slide 2: Untitled]\nNo title\n| H | I |\n| --- | --- |"
    assert all(text[b["start_offset"] :].startswith("[Slide") for b in bounds) and facts == {"total_slides": "2", "slides": "2", "has_notes": "true"} and tables[0][0] == "Slide 2"


def test_xlsx():
    text, bounds, _, _ = office.read_xlsx(xlsx(60))
    assert [b["boundary_id"] for b in bounds] == ["sheet:1", "sheet:1:rows:2-51", "sheet:1:rows:52-61", "sheet:2"] and bounds[1]["parent_id"] == "sheet:1"
    assert all(text[b["start_offset"]] == "[" for b in bounds) and text.endswith("[Sheet: Void]\n\n*Empty sheet*")
    assert "| Name | Col2 | In |" in text and "| 2 | 2.5 |  |" in text


def test_pdf_needs_its_library():
    with pytest.raises(RuntimeError, match="pdfplumber"):
        office.read_pdf(b"")


def test_markdown_and_csv():
    assert tab.markdown_table([]) == "" and tab.markdown_table([[None, "a|b"], ["x\ny"]]) == "| Col1 | a\\|b |\n| --- | --- |\n| x y |  |"
    assert tab.markdown_table([["h"], *[[i] for i in range(600)]]).endswith("| 499 |\n\n*... 100 more rows truncated*")
    assert tab.csv_text(["a", "b"], [["x,y", None], ['q"', 1]]) == 'a,b\r\n"x,y",\r\n"q""",1\r\n' and tab.csv_text(["a"], [], False) == "" and tab.csv_text([], [["v", None]]) == "v,\r\n"


def test_native_lines_equal_python(spark):
    rows = [("a|b", None), ("x\ny", 'q"'), ("", "c,d"), (None, "r\r")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r["line"] for r in tab.frame_lines(df, ["a", "b"]).collect()] == [f"| {tab.cell_text(a)} | {tab.cell_text(b)} |" for a, b in rows]
    assert [r["line"] for r in tab.frame_lines(df, ["a", "b"], "csv").collect()] == [tab.csv_text([], [r]).removesuffix("\r\n") for r in rows]
    assert tab.row_groups(df.limit(0), ["a"], ["a", "b"], "s").count() == 0


def test_source_names(spark):
    df = spark.createDataFrame([("/a/b/My File.tar.gz",), ("plain",), (".hidden",), ("/x/.md",)], "p string").select(source_name("p").alias("n"))
    assert [r["n"] for r in df.collect()] == ["My_File.tar", "plain", ".hidden", ".md"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    (root / "guide one.md").write_text("# Start\nAll about pumps. The pump runs.\n## Care\nClean the pump daily. Use oil.\n# End\nBye.")
    (root / "note.txt").write_text("Just a line about valves.")
    (root / "deck.pptx").write_bytes(pptx())
    (root / "book.xlsx").write_bytes(xlsx())
    (root / "text.docx").write_bytes(docx())
    (root / "other.bin").write_bytes(b"x")
    return root


def test_load_and_tables(spark, folder):
    got = {r["source"]: r for r in files.load_documents(spark, str(folder)).collect()}
    assert set(got) == {"guide_one", "note", "deck", "book", "text"} and got["note"]["facts"]["file_size"] == "25" and got["deck"]["loader"][0]["boundary_id"] == "slide:1"
    cut = files.read_document(files.load_documents(spark, str(folder / "note.txt")), 4).first()
    assert (cut["content"], cut["truncated"], cut["char_count"]) == ("Just", True, 4)
    table = files.extract_table(spark, str(folder / "book.xlsx"), 0, 1)
    assert table["headers"] == ["Name", "Col2", "In"] and table["row_count"] == 1 and files.table_csv(table, False) == "2,2.5,\r\n"
    assert files.list_tables(spark, str(folder / "book.xlsx")).where("table_index = 1").first()["row_count"] == 0
    with pytest.raises(ValueError, match="out of range"):
        files.extract_table(spark, str(folder / "book.xlsx"), 9)
    with pytest.raises(FileNotFoundError):
        files.check_file(str(folder / "none.txt"))
    with pytest.raises(ValueError, match="unsupported"):
        files.check_file(str(folder / "other.bin"))
    with pytest.raises(PermissionError):
        files.resolve("../x.txt", str(folder))


def test_requests(spark, folder, tmp_path):
    from corpusloom.api import Engine

    engine = Engine(spark, str(tmp_path / "index"), str(folder))
    ask = lambda name, **args: json.loads(engine.call(name, args))
    assert ask("doc_list")["count"] == 0
    assert ask("doc_index", file_path="guide one.md") == {"source": "guide_one", "file_type": "markdown", "chunks": 3, "has_boundaries": True}
    assert ask("doc_index", file_path="note.txt", source_name="n1")["chunks"] == 1
    assert ask("doc_index", file_path="guide one.md")["chunks"] == 3 and ask("doc_list")["count"] == 2
    toc = ask("doc_toc", source_name="guide_one")
    assert toc["total_entries"] == 3 and toc["toc"][0]["children"][0]["title"] == "Care"
    hit = ask("doc_search", query="clean the pump", top_k=2)
    assert hit["results"][0]["chunk_id"] == "guide_one:1" and hit["results"][0]["context"]["before"].startswith("# Start")
    wide = ask("doc_search", query="clean the pump", expand_to_boundary="chapter", sources=["guide_one"], top_k=1)
    assert wide["results"][0]["boundary_info"]["id"] == "chapter:1" and wide["expansion_applied"] == "chapter"
    assert ask("doc_chunk", chunk_id="guide_one:1", neighbors=1)["neighbors"][0]["position"] == 0
    assert ask("doc_get_content", source_name="guide_one", section="care")["chunk_count"] == 1
    assert ask("doc_get_content", source_name="guide_one", boundary_id="chapter:1")["chunk_count"] == 2
    assert "error" in ask("doc_get_content", source_name="guide_one", pages="1-2") and "error" in ask("doc_toc", source_name="zz") and "error" in ask("doc_chunk", chunk_id="guide_one:99")
    assert ask("read_document", file_path="note.txt", max_chars=100)["char_count"] == 25
    assert ask("list_tables", file_path="book.xlsx")["count"] == 2 and ask("extract_table", file_path="book.xlsx", table_index=0)["row_count"] == 3
    assert ask("doc_index", file_path="gone.md")["suggestion"] == "check the path" and "permission" in ask("doc_index", file_path="/etc/x.md")["error"]
    engine.store.export_jsonl("chunks", str(tmp_path / "out"))
    assert engine.store.import_jsonl("chunks", str(tmp_path / "out")).count() == 4
    assert '"page"' not in next(iter((tmp_path / "out").glob("*.json"))).read_text()


def test_vectors_must_match(spark, tmp_path):
    from corpusloom.sources.store import Store

    store = Store(spark, str(tmp_path))
    chunks = spark.createDataFrame([("a:0", "a"), ("a:1", "a")], "chunk_id string, source string")
    with pytest.raises(ValueError, match="differ"):
        store.add_vectors(chunks, spark.createDataFrame([("a:0", [1.0])], "chunk_id string, embedding array<float>"))
    store.add_vectors(chunks, spark.createDataFrame([("a:0", [1.0]), ("a:1", [0.5])], "chunk_id string, embedding array<float>"))
    assert store.read("vectors").count() == 2
    store.drop("a")
    assert store.read("vectors").count() == 0 and store.read("manifest").count() == 0


def test_streaming(spark, tmp_path):
    from corpusloom.sources.store import Store
    from corpusloom.streaming.ingest import event_counts, start_ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# A\nOne.")
    store = Store(spark, str(tmp_path / "index"))
    for count in (1, 2):
        start_ingest(spark, str(tmp_path / "in"), store, str(tmp_path / "cp")).awaitTermination()
        assert store.read("manifest").count() == count
        (tmp_path / "in/b.txt").write_text("Two.")
    events = spark.sql("select timestamp'2024-01-01 10:05:00' as ts, 'x' as event_type union all select timestamp'2024-01-01 10:59:00', 'x'")
    assert event_counts(events).first()["n"] == 2
