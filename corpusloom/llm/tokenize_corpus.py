"""Encoding of a whole corpus with a public byte-level BPE tokenizer, by DuckDB recursive queries.

Each task splits its texts into words by the tokenizer's published pattern and encodes every distinct word once.  The
words' token positions are rows of a DuckDB table; a recursive query joins neighbouring tokens with the merge table
and contracts each word's minimum-rank pair (all its places at once, leftmost first) until no pair is left, and an
ordered aggregation gives the ids.

Before that a word is cut at byte positions no vocabulary entry can span (neither the two bytes are an entry nor do
the three bytes around either of them occur inside one), which changes no result and keeps the pieces short in scripts
without spaces.  The recursion runs ``DEPTH`` steps at a time, so that what it keeps stays small for very long words.

Defined cases: null and empty texts give an empty list; strings that look like special tokens are ordinary text;
repeated rows are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import ship, shipped, text_slices

#: Public split pattern of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEPTH = 48
#: Distinct words kept by a task, and characters taken at a time; memory bounds only.
CACHE_WORDS, SLICE_CHARS = 400_000, 2_000_000

STEP = f"""
with recursive state(word, pos, tok, step) as (
  select word, pos, tok, 0 from pieces
  union all
  (with pairs as (
     select word, pos, tok, step, lead(tok) over w as follower, row_number() over w as place
     from state where step < {DEPTH} window w as (partition by word order by pos)),
   ranked as (
     select p.*, m.rank, m.merged, min(m.rank) over (partition by p.word) as least
     from pairs p left join merges m on m.left_id = p.tok and m.right_id = p.follower),
   runs as (
     select *, rank = least as best,
       place - row_number() over (partition by word, rank = least order by place) as run
     from ranked where least is not null),
   chosen as (
     select *, coalesce(best, false) and (row_number() over (partition by word, best, run order by place)) % 2 = 1 as hit
     from runs),
   marked as (select *, lag(hit) over (partition by word order by place) as taken from chosen)
   select word, pos, case when hit then merged else tok end, step + 1 from marked where not coalesce(taken, false))
), latest as (select word, max(step) as step from state group by word)
select s.word, any_value(s.step) as step, list(s.tok order by s.pos) as ids
from state s join latest l on s.word = l.word and s.step = l.step group by s.word
"""


def default_vocabulary() -> str:
    """Path of the vocabulary file; a parameter of the operator."""
    return os.environ.get("CORPUSLOOM_BYTE_BPE", "/opt/tokenizers/byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The published one-letter spelling of bytes in byte-level vocabularies: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Words to ids; holds the merge table in an in-process DuckDB and what it has encoded so far."""

    def __init__(self, vocabulary: str) -> None:
        import duckdb
        import regex

        model = json.load(open(vocabulary, encoding="utf-8"))["model"]
        ids, letters = model["vocab"], _byte_letters()
        self.split = regex.compile(PATTERN)
        self.byte_ids = np.zeros(256, np.int32)
        self.pairs, self.triples = np.zeros(1 << 16, bool), np.zeros(1 << 24, bool)
        for letter, b in letters.items():
            self.byte_ids[b] = ids[letter]
        spelled = [np.array([letters[c] for c in t], np.int64) for t in ids if all(c in letters for c in t)]
        for t in spelled:
            if len(t) == 2:
                self.pairs[t[0] << 8 | t[1]] = True
            elif len(t) > 2:
                self.triples[t[:-2] << 16 | t[1:-1] << 8 | t[2:]] = True
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        table = pa.table({
            "left_id": pa.array([ids[a] for a, _ in merges], pa.int32()), "right_id": pa.array([ids[b] for _, b in merges], pa.int32()),
            "rank": pa.array(range(len(merges)), pa.int32()), "merged": pa.array([ids[a + b] for a, b in merges], pa.int32()),
        })
        self.db.register("merge_rows", table)
        self.db.execute("create table merges as select * from merge_rows")
        spellings = pa.table({"id": pa.array([ids[t] for t in ids if all(c in letters for c in t)], pa.int32()), "bytes": pa.array([bytes(letters[c] for c in t).hex() for t in ids if all(c in letters for c in t)])})
        self.db.register("spelled", spellings)
        self.db.execute("create table vocabulary as select * from spelled")
        self.words: dict[str, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def _contract(self, parts: list[bytes]) -> None:
        """Fill ``self.parts`` for byte strings of two bytes or more."""
        data = np.frombuffer(b"".join(parts), np.uint8)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        word = np.repeat(np.arange(len(parts), dtype=np.int32), lengths)
        pos = (np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        tok = self.byte_ids[data]
        while len(word):
            self.db.register("pieces", pa.table({"word": word, "pos": pos, "tok": tok}))
            got = self.db.sql(STEP).to_arrow_table()
            self.db.unregister("pieces")
            lists = got.column("ids").combine_chunks()
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), lists.offsets.to_numpy()
            names, steps = got.column("word").to_numpy(), got.column("step").to_numpy()
            again: list[int] = []
            for k, (name, step) in enumerate(zip(names.tolist(), steps.tolist())):
                if step < DEPTH:
                    self.parts[parts[name]] = flat[ends[k] : ends[k + 1]].tobytes()
                else:
                    again.append(k)
            sizes = np.array([ends[k + 1] - ends[k] for k in again], np.int64)
            word = np.repeat(names[again].astype(np.int32), sizes) if again else np.zeros(0, np.int32)
            tok = np.concatenate([flat[ends[k] : ends[k + 1]] for k in again]) if again else np.zeros(0, np.int32)
            pos = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]) if again else np.zeros(0, np.int32)

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet."""
        raw = [w.encode("utf-8", "replace") for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        first = np.zeros(len(data) + 1, bool)
        first[0] = True
        first[ends] = True
        two = np.zeros(len(data), bool)
        two[1:] = self.pairs[data[:-1] << 8 | data[1:]]
        three = np.zeros(len(data) + 1, bool)  # at i: the bytes i-1, i, i+1 occur inside an entry, and are one word's
        three[1 : len(data) - 1] = self.triples[data[:-2] << 16 | data[1:-1] << 8 | data[2:]] if len(data) > 2 else False
        three[1:-1] &= ~first[1:-1]
        three[: len(data) - 1] &= ~first[1 : len(data)]
        joined = two.copy()
        joined |= three[:-1]
        joined[1:] |= three[: len(data) - 1]
        start = first[:-1] | ~joined
        cuts = np.append(np.flatnonzero(start), len(data)).tolist()
        whole = b"".join(raw)
        pieces = [whole[a:b] for a, b in zip(cuts, cuts[1:])]
        new = [p for p in dict.fromkeys(pieces) if p not in self.parts]
        for p in new:
            if len(p) == 1:
                self.parts[p] = self.byte_ids[p[0]].tobytes()
        if longer := [p for p in new if len(p) > 1]:
            self._contract(longer)
        k = 0
        for w, end in zip(words, ends.tolist()):
            j = k + 1
            while cuts[j] < end:
                j += 1
            self.words[w] = self.parts[pieces[k]] if j == k + 1 else b"".join(map(self.parts.__getitem__, pieces[k:j]))
            k = j

    def _long(self, text: str) -> bytes:
        """A text too long for its words to be held at once."""
        words = (m.group() for m in self.split.finditer(text))
        out = []
        while run := list(islice(words, 200_000)):
            if new := set(run).difference(self.words):
                self.learn(sorted(new))
            out.append(b"".join([self.words[w] for w in run]))
            if len(self.words) > CACHE_WORDS:
                self.words.clear()
                self.parts.clear()
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        out: list[bytes] = []
        k = 0
        while k < len(texts):
            if len(self.words) > CACHE_WORDS:
                self.words.clear()
                self.parts.clear()
            taken, chars = [], 0
            if len(texts[k] or "") > SLICE_CHARS:
                out.append(self._long(texts[k]))
                k += 1
                continue
            while k < len(texts) and chars < SLICE_CHARS and len(texts[k] or "") <= SLICE_CHARS:
                taken.append(self.split.findall(texts[k] or ""))
                chars += len(texts[k] or "")
                k += 1
            new = set().union(*taken).difference(self.words)
            if new:
                self.learn(sorted(new))
            known = self.words
            out += [b"".join([known[w] for w in ws]) for ws in taken]
        return out


    def decode(self, lists: list[list[int] | None]) -> list[str | None]:
        """The text of each list of ids: tokens join the vocabulary, an ordered aggregation puts their bytes together."""
        known = [k for k, ids in enumerate(lists) if ids]
        sizes = np.array([len(lists[k]) for k in known], np.int64)
        ids = np.fromiter(chain.from_iterable(lists[k] for k in known), np.int32, int(sizes.sum()))
        self.db.register("coded", pa.table({"text": np.repeat(np.array(known, np.int64), sizes), "pos": np.arange(len(ids)), "id": ids}))
        got = self.db.sql("select text, string_agg(bytes, '' order by pos) as bytes, count(*) as n, count(bytes) as known from coded left join vocabulary using (id) group by text").fetchall()
        self.db.unregister("coded")
        out: list[str | None] = [None if ids is None else "" for ids in lists]
        for text, joined, n, spelled in got:
            out[text] = bytes.fromhex(joined).decode("utf-8", "replace") if spelled == n else None
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder per Python worker."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Columns ``key`` and ``ids`` (array of int), one row per row of ``df``."""
    name = ship(df.sparkSession, vocabulary or default_vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shipped(name))
        for whole in batches:
            for batch in text_slices(whole, 1):
                coded = enc.encode(batch.column(1).to_pylist())
                ends = np.zeros(len(coded) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in coded], out=ends[1:])
                values = pa.array(np.frombuffer(b"".join(coded), np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.select(F.col("key").alias(key), "ids")


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Columns ``key`` and ``text``: the inverse of :func:`encode_texts`.  Null ids give null, none an empty text, and an id
    that the vocabulary lacks makes the text null."""
    name = ship(df.sparkSession, vocabulary or default_vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shipped(name))
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(enc.decode(batch.column(1).to_pylist()), pa.string())], names=["key", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
