"""Sentence boundaries across languages and scripts by a finite transducer run as a parallel prefix scan.

Every character gets a symbol that depends on its surroundings only (a look-around of bounded kinds: terminator runs,
abbreviations, numbers, which quotation marks pair up, what follows a closing mark).  A transducer of four states
(before a sentence, in it, in a quotation that began it, in a quotation inside it) turns symbols into boundaries.  All
texts of a batch form one symbol stream, a paragraph symbol between them; the stream is cut into equal blocks, each
block's effect on all four states is worked out at once, the effects are composed by a prefix scan, and the blocks are
run again from their true states to emit boundaries.  So one long text costs no more than many short ones.

Rules in words: . ! ? … and their kin end a sentence with the marks that close around them; a full stop does not after
titles and abbreviations, inside numbers, names of files, or as an initial; abbreviations that may close a sentence do
when a capital or a quotation follows; a quotation with its reporting words is one sentence; a blank line always ends a
sentence and a line break never does; in Thai a space does.

Defined cases: null, empty and blank texts give no sentences; a text without terminators is one sentence; a quotation
mark without a partner in its paragraph is an ordinary character; repeated rows are each split; an empty table gives
none.  Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import text_slices

# Fixed word lists, lower case, without the full stop.
#: Never close a sentence.
TITLES = (
    "mr mrs ms dr prof st mt sr sra srta dra dña lic ing mme mlle mgr rev gen col capt lt sgt hon pres messrs approx ca env aprox vs viz cf vgl bzw "
    "ggf sog evtl inkl zzgl bspw gem lt fa hr fr hrn ud uds eg ie z d u o p ej ex i e ev см ср ок т г гр им проф акад ул пр напр "
    "डॉ श्री श्रीमती कि ग्रा पृ सं प्रो د أ م ص ج ق ت هـ ดร นาย น.ส พ.ศ"
).split()
#: Do not close a sentence when a number follows.
NUMBERED = "no nr nos num núm art arts sec secs fig figs vol vols ch chap cap p pp pg pág págs ág s abs abb tab bd kap ziff n nº rt ig ol bs bb hap ap item eq ст рис стр гл п табл ис тр № ص م".split()
#: Close a sentence only before a capital, a quotation or the end.
ENDING = "etc usw inc ltd corp co jr bros uhr a.m p.m am pm u.s u.n u.k e.v jh jhd др пр п д ч мин сек руб тыс млн кг км м h kg km cm mm min max dept est".split()
FIRMS = {"inc", "ltd", "corp", "co"}
ORDINAL_LEADS = set("am der die das dem den des vom zum im ab bis seit zur".split())

O, W, P, T, Q, C, D, E, X, Z = range(10)  # other, space, paragraph, stop, open, close, close+go on, close+end, close+end if led in, Thai space
START, BODY, LEAD, INNER = range(4)
STATES, BLOCK = 4, 512
#: Texts longer than this are taken in sections between blank lines (where a sentence ends in any case); memory only.
SECTION = 1_000_000


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a boundary is emitted, by state and symbol."""
    to, emit = np.zeros((STATES, 10), np.uint8), np.zeros((STATES, 10), bool)
    to[START] = [BODY, START, START, START, LEAD, BODY, BODY, BODY, BODY, START]
    to[BODY] = [BODY, BODY, START, START, INNER, BODY, BODY, START, BODY, START]
    to[LEAD] = [LEAD, LEAD, START, LEAD, LEAD, BODY, BODY, START, BODY, LEAD]
    to[INNER] = [INNER, INNER, START, INNER, INNER, BODY, BODY, START, START, INNER]
    for state, symbols in ((START, [T, E]), (BODY, [P, T, E, Z]), (LEAD, [P, E]), (INNER, [P, E, X])):
        emit[state, symbols] = True
    return to, emit


TO, EMIT = _machine()


def scan(symbols: np.ndarray) -> np.ndarray:
    """Positions at which the transducer, started before a sentence, emits."""
    n = -(-len(symbols) // BLOCK)
    grid = np.full(n * BLOCK, W, np.uint8)
    grid[: len(symbols)] = symbols
    steps = np.ascontiguousarray(grid.reshape(n, BLOCK).T)
    flat_to, flat_emit = TO.ravel(), EMIT.ravel()
    effect = np.tile(np.arange(STATES, dtype=np.uint8), (n, 1))
    for row in steps:
        effect = flat_to[effect * np.uint8(10) + row[:, None]]
    shift = 1
    while shift < n:  # compose effects: after round k a block holds that of the 2^k blocks up to it
        effect[shift:] = np.take_along_axis(effect[shift:], effect[:-shift], 1)
        shift *= 2
    state = np.append(np.uint8(START), effect[:-1, START])
    out = np.zeros((BLOCK, n), bool)
    for k, row in enumerate(steps):
        at = state * np.uint8(10) + row
        out[k] = flat_emit[at]
        state = flat_to[at]
    return np.flatnonzero(out.T.ravel()[: len(symbols)])


SPACE, UPPER, LOWER, DIGIT, LETTER, CASELESS, THAI, STOP, WIDE, CLOSER, NEWLINE = (1 << k for k in range(11))


@cache
def _kinds() -> np.ndarray:
    """Bit set of kinds of every code point."""
    out = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        if s.isspace():
            out[c] |= SPACE
        elif s.isalpha() or 0x0900 <= c < 0x0980 or 0x0E00 <= c < 0x0E80:
            out[c] |= LETTER | (UPPER if s.isupper() or s.istitle() else LOWER if s.islower() else CASELESS)
        elif s.isdigit():
            out[c] |= DIGIT
    out[0x0E00:0x0E80] |= THAI
    out[[0x0964, 0x0965]] = STOP | WIDE
    for s in "。！？．":
        out[ord(s)] = STOP | WIDE
    for s in ".!?…؟‼⁇⁈⁉۔":
        out[ord(s)] = STOP
    for s in ")]}）］｝】〕":
        out[ord(s)] = CLOSER
    out[10] |= NEWLINE
    return out


OPENERS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "‹": "›", "《": "》"}
CLOSING = {"”", "»", "」", "』", "›", "》"}


def _quotes(code: np.ndarray, paragraph: np.ndarray) -> tuple[list[int], list[int]]:
    """Opening and closing marks that pair up within a paragraph."""
    marks = np.flatnonzero(np.isin(code, [ord(c) for c in [*OPENERS, *CLOSING, '"', "＂"]]))
    opened, closed = [], []
    para, stack, straight = -1, [], -1
    for at, c, par in zip(marks.tolist(), map(chr, code[marks].tolist()), paragraph[marks].tolist()):
        if par != para:
            para, stack, straight = par, [], -1
        if c in '"＂':
            if straight < 0:
                straight = at
            else:
                opened.append(straight)
                closed.append(at)
                straight = -1
        elif stack and (c == OPENERS[stack[-1][1]] or (c == "”" and stack[-1][1] == "„")):
            start, _ = stack.pop()
            if not stack:
                opened.append(start)
                closed.append(at)
        elif c in OPENERS:
            if stack and stack[-1][1] == c:
                stack.pop()  # the earlier one never closed
            stack.append((at, c))
        elif c in CLOSING:
            stack = []
    return opened, closed


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol stream of all texts, the start of each text in it, and for each place the last character that is no space."""
    joined = "\n\n".join(texts) + "\n\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    starts = np.cumsum(lengths) - lengths
    kind = _kinds()[code]
    place = np.arange(n)
    space = (kind & SPACE) > 0
    solid = np.maximum.accumulate(np.where(space, -1, place))  # last character up to here that is no space
    after = np.minimum.accumulate(np.where(space, n, place)[::-1])[::-1]  # first from here on
    after = np.append(after, n)
    out = np.full(n, O, np.uint8)
    out[space] = W
    lines = np.cumsum((kind & NEWLINE) > 0)
    first = space & ~np.append(False, space[:-1])
    heads = np.flatnonzero(first)
    tails = after[heads]
    breaks = lines[tails - 1] - np.where(heads > 0, lines[heads - 1], 0)
    out[heads[breaks >= 2]] = P
    for a in starts[1:].tolist():  # a text that begins with spaces still starts afresh
        out[a - 1] = P
    paragraph = np.cumsum(out == P)
    thai = (kind & THAI) > 0
    plain = heads[(breaks < 2) & (heads > 0)]
    nxt = np.minimum(after[plain], n - 1)
    has_blank = np.array([], bool) if not len(plain) else (lines[after[plain] - 1] - lines[plain - 1]) == 0
    out[plain[has_blank & (thai[plain - 1] | thai[nxt]) & ~((kind[plain - 1] & (UPPER | LOWER)) > 0) & ~((kind[nxt] & (UPPER | LOWER)) > 0)]] = Z

    opened, closed = _quotes(code, paragraph)
    is_open, is_close = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    is_open[opened] = True
    is_close[closed] = True
    opener_of = dict(zip(closed, opened))

    # A run of stops with the brackets after it; the last character carries the decision.
    stop = (kind & STOP) > 0
    run_head = np.flatnonzero(stop & ~np.append(False, stop[:-1]))
    run_end = np.flatnonzero(stop & ~np.append(stop[1:], False))
    get_kind, wide = kind, (kind & WIDE) > 0
    ends = np.zeros(n + 1, bool)
    carrier: dict[int, int] = {}
    for a, b in zip(run_head.tolist(), run_end.tolist()):
        last = b
        while last + 1 < n and get_kind[last + 1] & CLOSER:
            last += 1
        nx = int(after[last + 1]) if last + 1 <= n else n
        nk = int(get_kind[nx]) if nx < n else 0
        glued = nx == last + 1
        if not glued:  # a paragraph's end is always fine
            if out[last + 1] == P:
                ends[last] = True
                carrier[b] = last
                continue
        dots = joined[a : b + 1]
        if wide[a : b + 1].any() or dots[0] in "؟?!‼⁇⁈⁉۔" or dots[-1] in "؟?!":
            if glued and nx < n and not (is_close[nx] or is_open[nx]) and not wide[a : b + 1].any() and nk & (LETTER | DIGIT) and not nk & (CASELESS | UPPER):
                continue
            ok = True
        elif len(dots) > 1 or dots == "…":
            ok = (not glued or is_close[nx]) and not nk & LOWER
            if nx < n and nk & CASELESS and glued:
                ok = False
        else:
            ok = _full_stop(joined, a, nx, glued, nk, kind, is_close, is_open)
        if ok:
            ends[last] = True
            carrier[b] = last
    stops_at = np.flatnonzero(ends[:n])
    out[stops_at] = T
    out[opened] = Q
    for at in closed:
        prior = int(solid[at - 1]) if at else -1
        if prior >= 0 and (ends[prior] or (stop[prior] and prior in carrier) or (stop[prior] and joined[prior] in ".…" and prior > opener_of[at])):
            nx = int(after[at + 1]) if at + 1 <= n else n
            nk = int(kind[nx]) if nx < n else 0
            gap = joined[at + 1 : nx]
            if nx >= n or gap.count("\n") >= 2:
                out[at] = E
            elif nk & LOWER or joined[nx] in ",;:،、，—–-" or nk & STOP:
                out[at] = D
            elif nk & UPPER:
                out[at] = E
            elif nk & CASELESS and joined[nx] in "とって说問问道" and joined[at] in "」』":
                out[at] = D
            else:
                out[at] = X
            if prior > opener_of[at]:
                out[prior] = O if out[prior] == T else out[prior]
        else:
            out[at] = C
    return out, starts, solid


TITLE_SET, NUMBER_SET, ENDING_SET = frozenset(TITLES), frozenset(NUMBERED), frozenset(ENDING)


def _full_stop(text: str, at: int, nx: int, glued: bool, nk: int, kind: np.ndarray, is_close: np.ndarray, is_open: np.ndarray) -> bool:
    """Whether the single full stop at ``at`` may end a sentence; ``nx`` is the next character that is no space."""
    head = at
    while head > 0 and at - head < 16 and (kind[head - 1] & (LETTER | DIGIT) or text[head - 1] in "ािीुूृेैोौ्ंःँ़'"):
        head -= 1
    word = text[head:at]
    fold = word.lower()
    if glued and nx < len(text) and not is_close[nx]:
        if nk & UPPER and len(word) > 2 and word[-1].islower() and nx + 1 < len(text) and kind[nx + 1] & LOWER:
            return fold not in TITLE_SET  # a missing space
        return bool(is_open[nx]) or bool(nk & CLOSER)
    dotted = head > 0 and text[head - 1] == "." and head > 1 and bool(kind[head - 2] & LETTER)
    starts = bool(nk & (UPPER | CASELESS)) or (nx < len(text) and (is_open[nx] or is_close[nx] or text[nx] in "¿¡«“„\"「（("))
    if not word:
        return True
    if head > 0 and text[head - 1] == "-" and len(word) > 1:
        return True  # the second half of a name
    if word.isdigit():
        if len(word) <= 3 and nk & (UPPER | LOWER) and not (head > 0 and text[head - 1] in ".,:"):
            lead = text[max(0, head - 8) : head].split()
            return not (lead and lead[-1].lower() in ORDINAL_LEADS)
        return True
    if len(word) == 1 and kind[at - 1] & LETTER:
        spaced = head >= 3 and text[head - 1] in "  \n" and text[head - 2] == "." and not (head >= 4 and kind[head - 4] & LETTER) and not kind[at - 1] & UPPER
        if fold in "mмд" and (dotted or spaced) and _letter_before(text, head, dotted) in "apтtu":
            return starts and not nk & LOWER  # a.m., p. m., т. д.
        if fold == "п" and (dotted or spaced) and _letter_before(text, head, dotted) == "т":
            return starts and not nk & LOWER
        if fold in ENDING_SET and not kind[at - 1] & UPPER and not nk & CASELESS:
            return starts and not nk & LOWER
        if dotted and kind[at - 1] & UPPER:  # U.N.
            return False
        return False
    if dotted and len(word) <= 2 and fold not in ENDING_SET:
        return False
    if fold in NUMBER_SET and nk & DIGIT:
        return False
    if fold in TITLE_SET:
        return False
    if fold in FIRMS and word.isupper():
        return False  # in capitals throughout, what follows tells nothing
    if fold in ENDING_SET:
        return starts
    return True


def _letter_before(text: str, head: int, dotted: bool) -> str:
    k = head - 2 if dotted else head - 3
    return text[k].lower() if k >= 0 else " "


def sentence_ends(texts: list[str | None]) -> list[list[int]]:
    """End offsets of the sentences of each text."""
    known = [t or "" for t in texts]
    if not known:
        return []
    if any(len(t) > SECTION for t in known):
        return [_long(t) if len(t) > SECTION else sentence_ends([t])[0] for t in known]
    return _ends(known)


def _long(text: str) -> list[int]:
    out: list[int] = []
    start = 0
    while start < len(text):
        stop = text.find("\n\n", start + SECTION - 1)
        stop = len(text) if stop < 0 else stop
        out += [start + e for e in _ends([text[start:stop]])[0]]
        start = stop
        while start < len(text) and text[start].isspace():
            start += 1
    return out


def _ends(known: list[str]) -> list[list[int]]:
    stream, starts, solid = symbols(known)
    at = scan(stream)
    ends = solid[at] + 1
    owner = np.searchsorted(starts, at, "right") - 1
    # A paragraph mark before the first text character of a text belongs to the text before it.
    local = ends - starts[owner]
    out: list[list[int]] = [[] for _ in known]
    for k, e in zip(owner.tolist(), local.tolist()):
        if 0 < e <= len(known[k]) and (not out[k] or e > out[k][-1]):
            out[k].append(e)
    return out


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """Columns key, sentence (from 0), start_offset, end_offset and, if wanted, the sentence's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 1):
                texts = batch.column(1).to_pylist()
                rows: list[int] = []
                ords: list[int] = []
                begins: list[int] = []
                stops: list[int] = []
                units: list[str] = []
                for k, ends in enumerate(sentence_ends(texts)):
                    start = 0
                    for i, end in enumerate(ends):
                        while texts[k][start].isspace():
                            start += 1
                        rows.append(k)
                        ords.append(i)
                        begins.append(start)
                        stops.append(end)
                        if with_text:
                            units.append(texts[k][start:end])
                        start = end
                cols = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ords, pa.int32()), pa.array(begins, pa.int32()), pa.array(stops, pa.int32())]
                names = ["key", "sentence", "start_offset", "end_offset"]
                if with_text:
                    cols.append(pa.array(units, pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, sentence int, start_offset int, end_offset int" + (", text string" if with_text else "")
    out = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("key", key)
