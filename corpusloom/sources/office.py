"""Readers of office files with the standard library (zip and XML); PDF if its library is installed.

A reader takes a file's bytes and gives (text, boundaries, facts, tables): boundaries as records of the structure schema,
facts as a flat map of strings, tables as (location, rows).
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

from corpusloom.functions.tables import markdown_table

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

Parsed = tuple[str, list[dict], dict[str, str], list[tuple[str, list[list]]]]


class Assembler:
    """Parts joined by a blank line, with the offset of the next one."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.offset = 0
        self.bounds: list[dict] = []

    def add(self, part: str) -> None:
        self.parts.append(part)
        self.offset += len(part) + 2

    def mark(self, kind: str, level: int, name: str, title: str, parent: str | None = None) -> None:
        self.bounds.append({"ord": len(self.bounds), "type": kind, "level": level, "boundary_id": name, "title": title, "start_offset": self.offset, "parent_id": parent})

    def text(self) -> str:
        return "\n\n".join(self.parts)


def _relations(pack: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Relation id to (kind, part name) of a package part."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in pack.namelist():
        return {}
    out = {}
    for r in ET.fromstring(pack.read(rels)):
        if r.get("TargetMode") != "External":
            target = r.get("Target", "")
            full = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], full)
    return out


# --- Word ---------------------------------------------------------------------------------------------------------


def _word_text(p: ET.Element) -> str:
    out = []
    for node in p.iter():
        if node.tag == f"{W}t":
            out.append(node.text or "")
        elif node.tag == f"{W}tab":
            out.append("\t")
        elif node.tag == f"{W}br" and node.get(f"{W}type") != "page" or node.tag == f"{W}cr":
            out.append("\n")
    return "".join(out).strip()


def breaks_page(p: ET.Element) -> bool:
    """Whether a paragraph starts a new page: a page break, "page break before" that is not off, or a section's end."""
    if any(b.get(f"{W}type") == "page" for b in p.iter(f"{W}br")):
        return True
    props = p.find(f"{W}pPr")
    if props is None:
        return False
    before = props.find(f"{W}pageBreakBefore")
    off = before is not None and (before.get(f"{W}val") or "").lower() in ("false", "0", "off")
    return (before is not None and not off) or props.find(f"{W}sectPr") is not None


def _word_styles(pack: zipfile.ZipFile) -> dict[str, str]:
    if "word/styles.xml" not in pack.namelist():
        return {}
    names = {}
    for style in ET.fromstring(pack.read("word/styles.xml")).iter(f"{W}style"):
        name = style.find(f"{W}name")
        if name is not None:
            names[style.get(f"{W}styleId", "")] = name.get(f"{W}val", "")
    return names


def _word_rows(table: ET.Element) -> list[list]:
    rows = []
    for tr in table.findall(f"{W}tr"):
        cells: list[str] = []
        for tc in tr.findall(f"{W}tc"):
            text = "\n".join(_word_text(p) for p in tc.findall(f"{W}p")).strip()
            span = tc.find(f"{W}tcPr/{W}gridSpan")
            cells += [text] * int(span.get(f"{W}val", "1") if span is not None else 1)
        rows.append(cells)
    return rows


def read_docx(data: bytes) -> Parsed:
    """Paragraphs in order, headings as # lines, tables as Markdown, page breaks as [Page n] markers."""
    pack = zipfile.ZipFile(io.BytesIO(data))
    styles = _word_styles(pack)
    body = ET.fromstring(pack.read("word/document.xml")).find(f"{W}body")
    out, page, headings, tables = Assembler(), 1, 0, []
    for element in body if body is not None else ():
        if element.tag == f"{W}p":
            if breaks_page(element):
                page += 1
                out.mark("page", 4, f"page:{page}", str(page))
                out.add(f"[Page {page}]")
            if text := _word_text(element):
                ref = element.find(f"{W}pPr/{W}pStyle")
                style = styles.get(ref.get(f"{W}val", ""), ref.get(f"{W}val", "")) if ref is not None else ""
                if style.lower().startswith("heading"):
                    headings += 1
                    number = style[7:].strip()
                    text = "#" * min(int(number) if number.isdigit() else 1, 6) + " " + text
                out.add(text)
        elif element.tag == f"{W}tbl":
            rows = _word_rows(element)
            tables.append((f"Table {len(tables) + 1}", rows))
            if rows:
                out.add(markdown_table([[c.replace("\n", " ") for c in r] for r in rows]))
    return out.text(), out.bounds, {"total_pages": str(page), "headings": str(headings), "tables": str(len(tables)), "pages": str(page)}, tables


# --- Presentations ------------------------------------------------------------------------------------------------


def _frame_text(body: ET.Element | None) -> str:
    lines = []
    for p in body.findall(f"{A}p") if body is not None else ():
        text = "".join((n.text or "") if n.tag == f"{A}t" else "\n" if n.tag == f"{A}br" else "" for n in p.iter()).strip()
        if text:
            lines.append(text)
    return "\n".join(lines)


def _placeholder(shape: ET.Element) -> str | None:
    ph = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
    return None if ph is None else ph.get("type", "obj")


def read_pptx(data: bytes) -> Parsed:
    """One part per slide: its marker with title, text frames, tables, and speaker notes."""
    pack = zipfile.ZipFile(io.BytesIO(data))
    main = "ppt/presentation.xml"
    links = _relations(pack, main)
    order = [links[s.get(f"{R}id", "")][1] for s in ET.fromstring(pack.read(main)).iter(f"{P}sldId")]
    out, tables, noted = Assembler(), [], False
    for i, part in enumerate(order, 1):
        tree = ET.fromstring(pack.read(part)).find(f"{P}cSld/{P}spTree")
        shapes = list(tree) if tree is not None else []
        titles = [s for s in shapes if s.tag == f"{P}sp" and _placeholder(s) in ("title", "ctrTitle")]
        title = (_frame_text(titles[0].find(f"{P}txBody")) if titles else "") or "Untitled"
        lines = [f"[Slide {i}: {title}]"]
        for shape in shapes:
            if shape.tag == f"{P}sp":
                text = _frame_text(shape.find(f"{P}txBody"))
                if text and text != title:
                    lines.append(text)
            for table in shape.iter(f"{A}tbl") if shape.tag == f"{P}graphicFrame" else ():
                rows = [[_frame_text(c.find(f"{A}txBody")) for c in tr.findall(f"{A}tc")] for tr in table.findall(f"{A}tr")]
                tables.append((f"Slide {i}", rows))
                if rows:
                    lines.append(markdown_table([[c.replace("\n", " ") for c in r] for r in rows]))
        for kind, target in _relations(pack, part).values():
            if kind == "notesSlide":
                notes = [s for s in ET.fromstring(pack.read(target)).iter(f"{P}sp") if _placeholder(s) == "body"]
                if notes and (text := _frame_text(notes[0].find(f"{P}txBody"))):
                    noted = True
                    lines.append(f"\n[Notes:]\n{text}")
        out.mark("slide", 1, f"slide:{i}", title)
        out.add("\n".join(lines))
    return out.text(), out.bounds, {"total_slides": str(len(order)), "slides": str(len(order)), "has_notes": str(noted).lower()}, tables


# --- Spreadsheets -------------------------------------------------------------------------------------------------


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Za-z]*", ref).group().upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def _cell(c: ET.Element, shared: list[str]) -> object:
    kind, v = c.get("t", "n"), c.find(f"{S}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{S}t")) or None
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind == "n":
        number = float(v.text)
        return int(number) if number.is_integer() and not re.search("[.eE]", v.text) else number
    return v.text


def sheets(data: bytes) -> list[tuple[str, list[list]]]:
    """(name, non-empty rows of values) of every sheet; formulas by their stored results."""
    pack = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in pack.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ET.fromstring(pack.read("xl/sharedStrings.xml")).findall(f"{S}si")]
    links = _relations(pack, "xl/workbook.xml")
    out = []
    for sheet in ET.fromstring(pack.read("xl/workbook.xml")).iter(f"{S}sheet"):
        rows = []
        for tr in ET.fromstring(pack.read(links[sheet.get(f"{R}id", "")][1])).iter(f"{S}row"):
            row: list = []
            for c in tr.findall(f"{S}c"):
                at = _column(c.get("r", "")) if c.get("r") else len(row)
                row += [None] * (at - len(row))
                row.append(_cell(c, shared))
            if any(v is not None for v in row):
                rows.append(row)
        most = max(map(len, rows), default=0)
        out.append((sheet.get("name", ""), [r + [None] * (most - len(r)) for r in rows]))
    return out


def read_xlsx(data: bytes, rows_per_group: int = 50) -> Parsed:
    """A marker per sheet and a Markdown table per group of rows, the header repeated in each."""
    out, total, found = Assembler(), 0, sheets(data)
    for k, (name, rows) in enumerate(found, 1):
        out.mark("sheet", 1, f"sheet:{k}", name)
        out.add(f"[Sheet: {name}]")
        total += len(rows)
        if not rows:
            out.add("*Empty sheet*")
        elif len(rows) == 1:
            out.add(markdown_table(rows))
        for at in range(1, len(rows), rows_per_group):
            group = rows[at : at + rows_per_group]
            label = f"{at + 1}-{at + len(group)}"
            out.mark("row_group", 2, f"sheet:{k}:rows:{label}", f"{name} rows {label}", f"sheet:{k}")
            out.add(f"[Rows {label}]\n" + markdown_table([rows[0], *group], rows_per_group + 1))
    return out.text(), out.bounds, {"sheets": ",".join(n for n, _ in found), "total_rows": str(total)}, found


def read_pdf(data: bytes) -> Parsed:
    """Non-blank pages behind [Page n] markers, and their tables; needs the optional PDF library."""
    try:
        import pdfplumber
    except ImportError as missing:
        raise RuntimeError("reading PDF files needs the optional package pdfplumber") from missing
    out, tables = Assembler(), []
    with pdfplumber.open(io.BytesIO(data)) as pdf:
        for i, page in enumerate(pdf.pages, 1):
            text = page.extract_text() or ""
            if text.strip():
                out.mark("page", 4, f"page:{i}", str(i))
                out.add(f"[Page {i}]\n{text}")
            tables += [(f"Page {i}", rows) for rows in page.extract_tables() if rows and rows[0]]
        pages = len(pdf.pages)
    return out.text(), out.bounds, {"total_pages": str(pages)}, tables


READERS = {"docx": read_docx, "pptx": read_pptx, "xlsx": read_xlsx, "pdf": read_pdf}
