"""Markup residue in text: HTML, Markdown, wiki and LaTeX to clean text that keeps its structure.

A text is read into blocks (heading, list item, quotation, table, code, formula, paragraph) while marks are taken off
and noted by language.  Blocks are then judged in two passes.  First, length, stop-word density and link density make a
block content, boilerplate or undecided; code, formulas and tables are content.  Second, undecided short blocks take
the label of their nearest decided neighbours (content where these differ or are missing), and a heading shares the
fate of what follows it.  Content blocks are written out: headings with ``#``, list items with ``-``, tables with
``|``, code fenced, formulas in ``$``.

Marks inside a code block are not marks; the block's own are.  Page, sheet, slide and row markers, numbered and capital
headings, special tokens, paths, prices and comparisons stay as they are.

Defined cases: null gives null and no markup; an empty or unmarked text comes out unchanged; unclosed marks are ordinary
text; repeated rows are each converted; an empty table gives none.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed word lists.
TAGS = (
    "a abbr address article aside audio b big blockquote body br button caption center cite code col colgroup dd del details div dl dt em "
    "fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main "
    "mark meta nav ol option p pre q samp script section select small source span strike strong style sub summary sup table tbody td "
    "textarea tfoot th thead time title tr tt u ul var video"
)
BLOCK_TAGS = "address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h[1-6] head header hr html li main nav ol p section table tbody tfoot thead title tr ul"
BARE_COMMANDS = (
    "item hline toprule midrule bottomrule maketitle tableofcontents newpage clearpage noindent centering par newline linebreak bigskip "
    "medskip smallskip LaTeX TeX ldots dots cdot times alpha beta gamma delta epsilon lambda mu pi sigma theta omega leq geq neq approx infty sum int"
)
STOP_WORDS = frozenset(
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which you were there one all we can her has a "
    "der die das und in zu den von mit ist des sich auf für als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war ein eine im nicht "
    "le la les de des et en un une du que est pour qui dans sur par au pas plus ne se avec il ce sont a aux cette ou son mais comme été dont "
    "el los las y que se del por con una para su al lo es más o como pero sus ha este si porque esta entre cuando muy sin sobre "
    "и в не на что с по как это но из у за от так же то для он бы все она его к или если уже мы ещё там где "
    "في من على أن إلى عن هذا هذه التي الذي مع كان كل قد ثم ما لا بعد قبل أو إن هو هي ذلك "
    "में है का के की को और से ने पर यह हैं वह भी तो ही कर एक था नहीं फिर अगर".split()
)
STOP_CHARACTERS = frozenset("的了在是和有就不也这那要被把从与着过吗呢はをがのにでともへやか")
STOP_THAI = re.compile("ที่|ของ|และ|จะ|ได้|แล้ว|ให้|มี|ต้อง|ไม่|เป็น|จาก|ใน")
#: Density, length and link thresholds of the first pass.
SHORT, LONG, LOW, HIGH, LINKS = 70, 200, 0.04, 0.12, 0.6

#: A sign of every rule below: a text without a match has no mark.
SUSPECT = re.compile(r"[<\\`*_|~{\[&$]|==|''|^ {0,3}(?:[#>=]|-{3})", re.M)
HELD = re.compile("\x00(\\d+)\x00")
#: Alternatives of code blocks and of formulas with the text that closes each; one without its closing text is not tried.
CODE_PARTS = (
    ("\n", r"^[ \t]{0,3}(?P<fence>`{3,}|~{3,})[^\n`]*\n(?P<md>.*?)^[ \t]{0,3}(?P=fence)[ \t]*$"),
    ("</pre", r"<pre\b[^>]*>(?P<pre>.*?)</pre\s*>"),
    ("</code", r"<code\b[^>]*>(?P<html>[^<]*\n.*?)</code\s*>"),
    ("\\end{", r"\\begin\{(?P<env>verbatim\*?|lstlisting|minted|Verbatim)\}(?:\[[^\]]*\])?(?P<tex>.*?)\\end\{(?P=env)\}"),
)
FORMULA_PARTS = (
    ("\\end{", r"\\begin\{(?P<env>(?:equation|align|gather|multline|eqnarray|displaymath|math)\*?)\}(?P<block>.*?)\\end\{(?P=env)\}"),
    ("\\]", r"\\\[(?P<display>[^\]]*?[=\\^_+<>][^\]]*?)\\\]"),
    ("\\)", r"\\\((?P<inline>[^()\n]*?[=\\^_+\w][^\n]*?)\\\)"),
    ("$$", r"\$\$(?P<double>[^$]+)\$\$"),
    ("$", r"(?<![\\$\w])\$(?P<dollar>(?!\s)(?:[^$\n]|\n(?!\s*\n))*?(?<![\s\\]))\$(?![\w$])"),
)
MATH_SIGN = re.compile(r"[\\^_{}=]|^[A-Za-z]$|^[A-Za-z]\s*[-+<>]\s*\w+$")
COMMENT = re.compile(r"<!--.*?-->", re.S)
DROPPED = re.compile(r"<(script|style)\b[^>]*>.*?</\1\s*>", re.S | re.I)
TAG = re.compile(rf"</?(?:{'|'.join(TAGS.split())})(?:\s+[\w:-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?)*\s*/?>", re.I)
REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
HTML_HEADING = re.compile(r"<h([1-6])\b[^>]*>(.*?)</h\1\s*>", re.S | re.I)
HTML_LINK = re.compile(r"<a\b[^>]*>(.*?)</a\s*>", re.S | re.I)
BREAKING = re.compile(rf"</?(?:{'|'.join(BLOCK_TAGS.split())})\b[^>]*>", re.I)
ENVIRONMENT = re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]]*\])?(?:\{[^{}\n]*\})?")
LATEX_HEADING = re.compile(r"(?<![\w:\\])\\(part|chapter|section|subsection|subsubsection|paragraph)\*?(?:\[[^\]]*\])?\{([^{}]*)\}")
REFERENCES = re.compile(r"~?(?<![\w:\\])\\(?:cite|citep|citet|ref|eqref|label|pageref|footnotemark|bibliography|index)\*?(?:\[[^\]]*\])?\{[^{}]*\}")
COMMAND = re.compile(r"(?<![\w:\\])\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}(?:\{([^{}]*)\})?")
BARE = re.compile(rf"(?<![\w:\\])\\(?:{'|'.join(BARE_COMMANDS.split())})(?![A-Za-z\\])")
WIKI_HEADING = re.compile(r"^(={2,6})[ \t]*(?=[^=\s])(.+?)[ \t]*\1[ \t]*$", re.M)
WIKI_FILE = re.compile(r"\[\[(?:File|Image|Datei|Fichier|Archivo|Category|Kategorie):[^\[\]]*\]\]", re.I)
WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|]+\|)?([^\[\]|]+)\]\]")
BRACE = re.compile(r"[{}]")
WIKI_EMPHASIS = re.compile(r"(?<!['\w])('{2,3})(?=[^\s'])((?:[^'\n]|'(?!')|\n(?!\s*\n))+?)(?<=[^\s'])\1(?!['\w])|(?<=[^\x00-\x7f])('{2,3})(?=[^\s'])([^'\n]+?)\3")
WIKI_TABLE = re.compile(r"^\{\|.*?^\|\}[ \t]*$", re.S | re.M)
RULE_ROW = re.compile(r"^[ \t]{0,3}(?:\|[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?|:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?)[ \t]*$")
ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$")
UNDERLINE = re.compile(r"^ {0,3}(=+|-{3,})[ \t]*$")
QUOTE = re.compile(r"^ {0,3}>[ \t]?(.*)$")
LIST = re.compile(r"^[ \t]*(?:[-*+•]|\d{1,4}[.)])[ \t]+(\[[ xX]\][ \t]+)?(\S.*)$")
NOTE = re.compile(r"^\[\^[^\]\s]+\]:[ \t]+")
IMAGE = re.compile(r"!\[([^\]\n]*)\]\([^()\n]+\)")
LINK = re.compile(r"(?<!!)\[([^\[\]]+)\]\((?:[^()\s]+)(?:\s+\"[^\"]*\")?\)")
BEGIN = r"(?=[^\s*_~`.,;:!?)\]}])"
INLINE = [
    re.compile(r"(?<!\*)\*\*" + BEGIN + r"((?:[^*\n]|\n(?!\s*\n))+?)(?<=\S)\*\*(?!\*)"),
    re.compile(r"(?<!\w)__" + BEGIN + r"((?:[^_\n]|_(?!_)|\n(?!\s*\n))+?)(?<=\S)__(?!\w)"),
    re.compile(r"(?<![A-Za-z0-9*\\/])\*" + BEGIN + r"((?:[^*\n]|\n(?!\s*\n))+?)(?<=[^\s*(])\*(?![A-Za-z0-9*])"),
    re.compile(r"(?<![\w\\/])_" + BEGIN + r"((?:[^_\n]|\n(?!\s*\n))+?)(?<=[^\s_])_(?![\w/])"),
    re.compile(r"~~(?=\S)((?:[^~\n]|\n(?!\s*\n))+?)(?<=\S)~~"),
    re.compile(r"(?<![`\\])`(?=[^`\s])((?:[^`\n]|\n(?!\s*\n))*?[^`\s])`(?!`)|(?<!`)`([^`\s])`(?!`)"),
]
MARKUPS = ("html", "latex", "markdown", "wiki")


def without_templates(text: str) -> str:
    """The text without its wiki templates, which are double braces that balance, nested ones included."""
    opened: list[int] = []
    spans: list[tuple[int, int]] = []
    last = (-1, -1)
    for m in BRACE.finditer(text):
        if m[0] == "{":
            opened.append(m.start())
        elif opened:
            pair = (opened.pop(), m.start())
            if last == (pair[0] + 1, pair[1] - 1) and pair[1] - pair[0] > 3:
                while spans and spans[-1][0] > pair[0]:
                    spans.pop()
                spans.append(pair)
            last = pair
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b + 1
    return "".join(out) + text[at:]


@cache
def _either(parts: tuple[str, ...], flags: int) -> re.Pattern:
    return re.compile("|".join(parts), flags)


def replace_closed(closers: tuple[str, ...], pattern: re.Pattern, by, text: str) -> str:
    """``pattern.sub`` over the text up to the line of the last place where a mark can close; beyond it no opening mark has
    to look for one, so many unclosed marks cost no more than closed ones."""
    end = -1
    for m in _either(tuple(map(re.escape, closers)), re.I).finditer(text):
        end = m.start()
    if end < 0:
        return text
    stop = text.find("\n", end + 1)
    stop = len(text) if stop < 0 else stop
    return pattern.sub(by, text[:stop]) + text[stop:]


def replace_any(parts: tuple[tuple[str, str], ...], flags: int, by, text: str) -> str:
    """As :func:`replace_closed`, with those alternatives whose closing text occurs."""
    used = [(c, p) for c, p in parts if _either((re.escape(c),), re.I).search(text)]
    if not used:
        return text
    return replace_closed(tuple(c for c, _ in used), _either(tuple(p for _, p in used), flags), by, text)


def group(m: re.Match, name: str) -> str | None:
    """A named group, null in patterns that lack it."""
    return m[name] if name in m.re.groupindex else None


class Reader:
    """Blocks of one text and the markup languages met on the way."""

    def __init__(self, text: str) -> None:
        self.found: set[str] = set()
        self.held: list[tuple[str, str]] = []
        self.linked = 0
        text = replace_any(CODE_PARTS, re.S | re.M | re.I, self._code, text)
        text = self._html(text)
        text = self._latex(text)
        text = self._wiki(text)
        self.blocks = self._markdown(text)

    def _hold(self, kind: str, body: str) -> str:
        self.held.append((kind, body))
        return f"\x00{len(self.held) - 1}\x00"

    def _code(self, m: re.Match) -> str:
        for name, language in (("md", "markdown"), ("pre", "html"), ("html", "html"), ("tex", "latex")):
            if (body := group(m, name)) is not None:
                self.found.add(language)
                if language == "html":
                    body = html.unescape(TAG.sub("", body))
                return "\n\n" + self._hold("code", body.strip("\n")) + "\n\n"
        return m[0]

    def _html(self, text: str) -> str:
        if "<" in text:
            new = replace_closed(("-->",), COMMENT, " ", text)
            new = replace_closed(("</script", "</style"), DROPPED, " ", new)
            new = replace_closed(("</h",), HTML_HEADING, lambda m: "\n\n" + self._hold("heading" + m[1], TAG.sub("", m[2]).strip()) + "\n\n", new)
            new = replace_closed(("</a",), HTML_LINK, lambda m: self._link(m[1]), new)
            new = re.sub(r"<li\b[^>]*>\s*", "\n\n\x01", new, flags=re.I)
            new = re.sub(r"</t[dh]\s*>\s*<t[dh]\b[^>]*>", " | ", new, flags=re.I)
            new = re.sub(r"<tr\b[^>]*>\s*", "\n\x02", new, flags=re.I)
            new = TAG.sub("", BREAKING.sub("\n", new))
            if new != text:
                self.found.add("html")
                text = new
        if "&" in text:
            text = REFERENCE.sub(self._reference, text)
        return text

    def _reference(self, m: re.Match) -> str:
        if m[0][1] != "#" and m[0][1:] not in html5:
            return m[0]
        self.found.add("html")
        return self._hold("sign", html.unescape(m[0]))

    def _link(self, label: str) -> str:
        self.linked += len(label)
        return "\x03" + label + "\x04"

    def _latex(self, text: str) -> str:
        if "$" in text or "\\" in text:
            text = replace_any(FORMULA_PARTS, re.S, self._formula, text)
        if "\\" in text:
            new = LATEX_HEADING.sub(lambda m: "\n\n" + self._hold("heading" + str({"part": 1, "chapter": 1, "section": 2, "subsection": 3}.get(m[1], 4)), m[2].strip()) + "\n\n", text)
            new = re.sub(r"(\\begin\{tabular\*?\}.*?\\end\{tabular\*?\})", lambda m: re.sub(r"\\\\[ \t]*\n?", "\n\x02", m[1]).replace(" & ", " | "), new, flags=re.S)
            new = ENVIRONMENT.sub("\n", REFERENCES.sub("", new))
            new = re.sub(r"(?<![\w:\\])\\item\b(?:\[[^\]]*\])?[ \t]*", "\n\n\x01", new)
            before = ""
            while new != before:  # nested commands, inside out
                before, new = new, COMMAND.sub(lambda m: m[2] or m[1], new)
            new = BARE.sub("", new)
            if new != text:
                self.found.add("latex")
                text = new
        return text

    def _formula(self, m: re.Match) -> str:
        body = next(b for b in (group(m, k) for k in ("block", "display", "inline", "double", "dollar")) if b is not None)
        dollar = group(m, "dollar") is not None
        if dollar and (not MATH_SIGN.search(body) or body[0].isdigit() and not re.search(r"[\\^_{}]", body)):
            return m[0]
        self.found.add("latex")
        display = not dollar and group(m, "inline") is None
        held = self._hold("formula", re.sub(r"\s*\\label\{[^{}]*\}\s*", " ", body).strip())
        return f"\n\n{held}\n\n" if display else held

    def _wiki(self, text: str) -> str:
        new = text
        if "{|" in new:
            new = replace_closed(("|}",), WIKI_TABLE, self._table, new)
        if "==" in new:
            new = WIKI_HEADING.sub(lambda m: "\n\n" + self._hold(f"heading{len(m[1])}", m[2]) + "\n\n", new)
        if "[[" in new:
            new = WIKI_LINK.sub(lambda m: self._link(m[1]), WIKI_FILE.sub("\n\n", new))
        if "{{" in new:
            new = without_templates(new)
        if "''" in new:
            before = ""
            while new != before:
                before, new = new, WIKI_EMPHASIS.sub(lambda m: m[2] or m[4], new)
        if new != text:
            self.found.add("wiki")
        return new

    def _table(self, m: re.Match) -> str:
        rows = []
        for line in m[0].split("\n")[1:-1]:
            if not line.startswith("|-") and line[:1] in "|!":
                rows.append(" | ".join(c.strip() for c in re.split(r"\|\||!!", line[1:])))
        return "\n\n" + "\n".join("\x02" + r for r in rows) + "\n\n"

    def _inline(self, text: str) -> str:
        new = text
        if "[" in new:
            new = LINK.sub(lambda m: self._link(m[1]), IMAGE.sub(lambda m: m[1], new))
        if any(c in new for c in "*_~`"):
            for pattern in INLINE:
                new = pattern.sub(lambda m: m[1] if m[1] is not None else m[2], new)
        if new != text:
            self.found.add("markdown")
        return new

    def _markdown(self, text: str) -> list[tuple[str, str]]:
        blocks: list[tuple[str, str]] = []
        lines = self._inline(text).split("\n")
        para: list[str] = []

        def flush() -> None:
            if para:
                blocks.append(("paragraph", "\n".join(para)))
                para.clear()

        k = 0
        while k < len(lines):
            line = lines[k]
            bare = line.strip()
            nxt = lines[k + 1] if k + 1 < len(lines) else ""
            if not bare:
                flush()
            elif bare[0] == "\x02":
                flush()
                rows = []
                while k < len(lines) and (lines[k].strip()[:1] == "\x02"):
                    if row := lines[k].strip().strip("\x02").strip():
                        rows.append(row)
                    k += 1
                blocks.append(("table", "\n".join(rows)))
                continue
            elif bare[0] == "\x01":
                flush()
                blocks.append(("item", bare.strip("\x01").strip()))
            elif (h := HELD.fullmatch(bare)) and self.held[int(h[1])][0] != "sign":
                flush()
                blocks.append(self.held[int(h[1])])
            elif m := ATX.match(line):
                flush()
                self.found.add("markdown")
                blocks.append((f"heading{len(m[1])}", m[2]))
            elif "|" in line and RULE_ROW.match(nxt) and "|" in nxt:
                flush()
                self.found.add("markdown")
                rows = [line]
                k += 2
                while k < len(lines) and "|" in lines[k] and lines[k].strip():
                    rows.append(lines[k])
                    k += 1
                blocks.append(("table", "\n".join(" | ".join(c.strip() for c in r.strip().strip("|").split("|")) for r in rows)))
                continue
            elif not para and UNDERLINE.match(nxt) and not UNDERLINE.match(line) and "|" not in line:
                self.found.add("markdown")
                blocks.append(("heading1" if "=" in nxt else "heading2", bare))
                k += 1
            elif not para and (m := QUOTE.match(line)):
                self.found.add("markdown")
                quoted = [m[1]]
                while k + 1 < len(lines) and (m := QUOTE.match(lines[k + 1])):
                    quoted.append(m[1])
                    k += 1
                blocks.append(("quote", "\n".join(quoted)))
            elif m := LIST.match(line):
                flush()
                if m[1]:
                    self.found.add("markdown")
                blocks.append(("item", m[2]))
            elif not para and NOTE.match(line):
                self.found.add("markdown")
                blocks.append(("item", NOTE.sub("", line)))
            else:
                para.append(line)
            k += 1
        flush()
        return blocks

    def restore(self, text: str) -> str:
        def back(m: re.Match) -> str:
            kind, body = self.held[int(m[1])]
            return f"${body}$" if kind == "formula" else body

        return re.sub("[\x01-\x04]", "", HELD.sub(back, text))


def densities(text: str) -> tuple[float, float]:
    """Stop-word density and link density of a block with its link marks."""
    linked = sum(len(x) for x in re.findall("\x03([^\x04]*)\x04", text))
    plain = re.sub("[\x01-\x04]", "", text)
    words = plain.lower().split()
    if not words:
        return 0.0, 0.0
    hits = sum(w.strip(".,;:!?«»“”\"'()") in STOP_WORDS for w in words) / len(words)
    wide = sum(c in STOP_CHARACTERS for c in plain) / len(plain) * 2
    thai = len(STOP_THAI.findall(plain)) * 4 / len(plain)
    return max(hits, wide, thai), linked / len(plain)


def judge(blocks: list[tuple[str, str]]) -> list[bool]:
    """Which blocks are content."""
    labels: list[str] = []
    for kind, text in blocks:
        if kind in ("code", "formula", "table"):
            labels.append("good")
            continue
        if kind.startswith("heading"):
            labels.append("heading")
            continue
        stop, link = densities(text)
        n = len(text)
        if link > LINKS and stop < LOW:
            labels.append("bad")
        elif n < SHORT:
            labels.append("good" if stop >= HIGH and not link else "open")
        elif stop >= HIGH:
            labels.append("good")
        elif stop >= LOW or n < LONG:
            labels.append("open")
        else:
            labels.append("bad" if link > LINKS / 2 else "open")
    final = labels[:]
    nearest: list[list[str]] = [[] for _ in labels]  # labels of the nearest decided block on either side
    for ordered in (range(len(labels)), range(len(labels) - 1, -1, -1)):
        last = None
        for k in ordered:
            if labels[k] in ("good", "bad"):
                last = labels[k]
            elif last is not None:
                nearest[k].append(last)
    for k, label in enumerate(labels):
        if label == "open":
            final[k] = "bad" if nearest[k] and set(nearest[k]) == {"bad"} else "good"
    following = "good"
    for k in range(len(labels) - 1, -1, -1):
        if labels[k] == "heading":
            final[k] = following
        else:
            following = final[k]
    return [x != "bad" for x in final]


def convert(text: str | None) -> tuple[str | None, list[str], int, int]:
    """Clean text, markup languages found, blocks kept and dropped."""
    if text is None or not SUSPECT.search(text):
        return text, [], 0, 0
    reader = Reader(text.replace("\x00", " ").replace("\r\n", "\n"))
    if not reader.found:
        return text, [], 0, 0
    keep = judge(reader.blocks)
    out: list[str] = []
    previous = ""
    for (kind, body), kept in zip(reader.blocks, keep):
        body = reader.restore(body).strip("\n")
        if not kept or not body.strip():
            continue
        if kind.startswith("heading"):
            body = "#" * int(kind[7:]) + " " + body
        elif kind == "item":
            body = "- " + body
        elif kind == "code":
            body = f"```\n{body}\n```"
        elif kind == "formula":
            body = f"${body}$"
        out.append(("\n" if kind == previous == "item" else "\n\n") + body if out else body)
        previous = kind
    return "".join(out), sorted(reader.found), sum(keep), len(keep) - sum(keep)


def clean(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, clean_text, markups (sorted array), kept and dropped (numbers of blocks; 0 for unmarked texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [convert(t.as_py()) for t in batch.column(1)]
            cols = list(zip(*got)) if got else [(), (), (), ()]
            kinds = [pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=["key", "clean_text", "markups", "kept", "dropped"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, clean_text string, markups array<string>, kept int, dropped int")
    return out.withColumnRenamed("key", key)


def markup_cases(df: DataFrame) -> DataFrame:
    """One row per document and markup language found."""
    return clean(df).select("doc_id", F.explode("markups").alias("markup"))
