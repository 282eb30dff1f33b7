"""Packing of a region's sentences into chunks: a sequential fold, so plain Python inside an Arrow batch."""

from __future__ import annotations

import re
from collections.abc import Callable

from corpusloom.functions.text import ABBREVIATIONS
from corpusloom.schema import ChunkOptions

FENCES = re.compile(r"```[\s\S]*?```")
SPLIT = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
SIGNS = re.compile(r"\w+|[^\w\s]")
#: Control characters that hold the places of code fences and of protected full stops.
HELD, DOT = re.compile("\x01(\\d+)\x02"), "\x03"


def count_signs(text: str) -> int:
    """Words and single signs; the default token counter."""
    return len(SIGNS.findall(text))


class BpeCounter:
    """Token counter over a rank file of a byte-pair vocabulary; loaded once per process, so cheap to send around."""

    _loaded: dict[tuple[str, str], object] = {}

    def __init__(self, ranks: str, pattern: str = r"'\p{L}+| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+") -> None:
        self.ranks, self.pattern = ranks, pattern

    def __call__(self, text: str) -> int:
        key = (self.ranks, self.pattern)
        if key not in self._loaded:
            import base64

            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(self.ranks, "rb"))}
            self._loaded[key] = tiktoken.Encoding("counter", pat_str=self.pattern, mergeable_ranks=table, special_tokens={})
        return len(self._loaded[key].encode_ordinary(text))


def split_sentences(text: str) -> list[str]:
    """Row-local twin of the native sentence expression."""
    fences: list[str] = []

    def hold(m: re.Match) -> str:
        fences.append(m[0])
        return f"\x01{len(fences) - 1}\x02"

    held = FENCES.sub(hold, text)
    for word in ABBREVIATIONS:
        held = held.replace(word, word.replace(".", DOT))
    units = (HELD.sub(lambda m: fences[int(m[1])], u.replace(DOT, ".")).strip() for u in SPLIT.split(held))
    return [u for u in units if u]


def tail(sentences: list[tuple[str, int]], overlap: int) -> list[tuple[str, int]]:
    """The last sentences within the overlap; at least one, unless the overlap is 0."""
    if overlap <= 0:
        return []
    total, k = 0, len(sentences)
    while k > 0 and (k == len(sentences) or total + sentences[k - 1][1] <= overlap):
        k -= 1
        total += sentences[k][1]
    return sentences[k:]


def pack(text: str, options: ChunkOptions, count: Callable[[str], int] = count_signs) -> list[tuple[str, int]]:
    """(content, tokens) of each chunk.  A sentence over the maximum stands alone and passes no overlap on; a last chunk
    under the minimum joins the one before it."""
    out: list[tuple[str, int]] = []
    run: list[tuple[str, int]] = []

    def close() -> None:
        out.append((" ".join(s for s, _ in run), sum(n for _, n in run)))

    for unit in split_sentences(text):
        n = count(unit)
        if n > options.max_chunk_size:
            if run:
                close()
                run = []
            out.append((unit, n))
        elif run and sum(k for _, k in run) + n > options.chunk_size:
            close()
            run = [*tail(run, options.chunk_overlap), (unit, n)]
        else:
            run.append((unit, n))
    if run:
        last = " ".join(s for s, _ in run)
        n = count(last)
        if out and n < options.min_chunk_size:
            last = out.pop()[0] + " " + last
            n = count(last)
        out.append((last, n))
    return out
