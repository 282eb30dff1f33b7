"""Reading level of each document: smoothed unigram language models per grade, highest posterior likelihood.

One model per (language, level) is trained on labelled texts, a bounded table (``MAX_REFERENCES`` rows at most are
accepted).  A word's probability interpolates its relative frequency with that of its length class, so that unseen
words still speak for the levels that use words of their length.  A text's language is its row's language if the
models know it, else, for texts in their script, the language of the best model.  Texts in other languages get their
level from models of length classes alone, pooled over the languages.

Defined cases: null texts and texts without letters get a null level; ties go to the lower level; spelling variants of
a language ("EN", "en-x", " en") count as the language; repeated rows are each judged; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_REFERENCES = 100_000
#: Length classes end here; pseudo-count of the length model in a word's probability.
LONGEST, PRIOR = 24, 400.0
WORD = re.compile(r"[^\W\d_]+")
LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿŒœ]")


class LevelModel:
    """Log probabilities of words and length classes under each (language, level)."""

    def __init__(self, rows: list[tuple[str, int, str]]) -> None:
        self.classes = sorted({(lang, level) for lang, level, _ in rows})
        counts = {c: Counter() for c in self.classes}
        for lang, level, text in rows:
            counts[lang, level].update(WORD.findall(text.lower()))
        self.vocabulary = {w: k for k, w in enumerate(sorted(set().union(*counts.values())))}
        n = len(self.vocabulary)
        kinds = np.array([min(len(w), LONGEST) for w in self.vocabulary] + list(range(LONGEST + 1)))
        spread = np.bincount(kinds[:n], minlength=LONGEST + 1) + 50.0  # words a length class is thought to hold
        self.table = np.zeros((n + LONGEST + 1, len(self.classes)))
        lengths = np.zeros((LONGEST + 1, len(self.classes)))
        for j, c in enumerate(self.classes):
            seen = np.zeros(n)
            for w, k in counts[c].items():
                seen[self.vocabulary[w]] = k
            by_length = np.bincount(kinds[:n], weights=seen, minlength=LONGEST + 1) + 0.5
            lengths[:, j] = by_length
            share = by_length / by_length.sum()
            whole = np.append(seen, np.zeros(LONGEST + 1)) + PRIOR * share[kinds] / spread[kinds]
            self.table[:, j] = np.log(whole / (seen.sum() + PRIOR))
        self.levels = sorted({level for _, level in self.classes})
        pooled = np.stack([lengths[:, [k for k, c in enumerate(self.classes) if c[1] == level]].sum(1) for level in self.levels], 1)
        self.pooled = np.log(pooled / pooled.sum(0))
        self.by_lang = {lang: [k for k, c in enumerate(self.classes) if c[0] == lang] for lang, _ in self.classes}

    def judge(self, text: str | None, lang: str | None) -> tuple[str | None, int | None, float | None]:
        """Language of the model (null if pooled), level, posterior of the level."""
        words = WORD.findall(text.lower()) if text else []
        if not words:
            return None, None, None
        given = re.match(r"[a-z]{2}(?![a-z])", (lang or "").strip().lower())
        if not given or given.group() in self.by_lang:
            if given or 2 * len(LATIN.findall(text)) > sum(map(len, words)):
                n, get = len(self.vocabulary), self.vocabulary.get
                places = [k if (k := get(w)) is not None else n + min(len(w), LONGEST) for w in words]
                score = self.table[places].sum(0)
                chosen = self.by_lang[given.group()] if given else range(len(self.classes))
                best = max(chosen, key=lambda k: (score[k], -self.classes[k][1]))
                lang_of = self.classes[best][0]
                rivals = np.array([score[k] for k in self.by_lang[lang_of]])
                return lang_of, self.classes[best][1], float(1 / np.exp(np.clip(rivals - score[best], -700, 0)).sum())
        score = self.pooled[[min(len(w), LONGEST) for w in words]].sum(0)
        best = int(np.argmax(score))
        return None, self.levels[best], float(1 / np.exp(np.clip(score - score[best], -700, 0)).sum())


def train(references: DataFrame) -> LevelModel:
    """Fit the models on the driver; the labelled table is small by contract, which is checked."""
    rows = (
        references.where("text is not null and level is not null and lang is not null")
        .select(F.lower(F.substring(F.trim("lang"), 1, 2)), "level", "text")
        .orderBy("ref_id")
        .limit(MAX_REFERENCES + 1)
        .collect()
    )
    if len(rows) > MAX_REFERENCES:
        raise ValueError(f"more than {MAX_REFERENCES} labelled texts; train on a sample of at most that many")
    return LevelModel([tuple(r) for r in rows])


def reading_levels(docs: DataFrame, model: LevelModel, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Columns key, level_lang (null where pooled), level, posterior."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.judge(t.as_py(), l.as_py()) for t, l in zip(batch.column(1), batch.column(2))]
            langs, levels, shares = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(levels, pa.int32()), pa.array([None if s is None or math.isnan(s) else round(s, 6) for s in shares], pa.float64())],
                names=["key", "level_lang", "level", "posterior"],
            )

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).mapInArrow(run, f"key {kind}, level_lang string, level int, posterior double")
    return out.withColumnRenamed("key", key)


def level_cases(docs: DataFrame, model: LevelModel) -> DataFrame:
    """Levels of prose documents of 600 characters or more in the models' languages."""
    prose = docs.where("is_flow and length(text) >= 600").select("doc_id", "text", "lang")
    return reading_levels(prose, model).where("level_lang is not null").select("doc_id", "level")
