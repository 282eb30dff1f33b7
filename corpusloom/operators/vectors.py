"""Vector search over a table (chunk_id, source, embedding): exact cosine ranking, and an embedder without a model."""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import words
from corpusloom.runtime import ship, shipped

DIMENSION = 384


def semantic_score(embedding: Column, query: list[float]) -> Column:
    """(1 + cosine) / 2; null for null, zero, non-finite vectors and those of another length.  Whole Arrow batches are
    multiplied at once; folding an array natively is interpreted element by element."""
    asked = np.array(query, np.float64)
    asked /= np.linalg.norm(asked) or 1.0

    @F.arrow_udf(T.DoubleType())
    def score(rows: pa.Array) -> pa.Array:
        out = np.full(len(rows), np.nan)
        fitting = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(rows), len(asked)), False).to_numpy(zero_copy_only=False))
        if len(fitting) and len(asked):
            v = rows.take(pa.array(fitting)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(asked))
            lengths = np.sqrt((v * v).sum(1))  # row by row, so that equal vectors have equal scores wherever they lie
            with np.errstate(all="ignore"):
                out[fitting] = np.where((lengths > 0) & np.isfinite(lengths), (1 + (v * asked).sum(1) / lengths) / 2, np.nan)
        return pa.array(out, mask=np.isnan(out))

    return score(embedding)


def nearest(vectors: DataFrame, query: list[float], k: int = 5, source: str | None = None) -> DataFrame:
    """The k best chunks, best first; k is clipped to what there is, ties go to the smaller id.  A source is filtered
    before ranking, so k results come back whenever the source has them."""
    pool = vectors.where(F.col("source") == source) if source is not None else vectors
    scored = pool.select("chunk_id", "source", semantic_score(F.col("embedding"), query).alias("semantic_score"))
    return scored.where("semantic_score is not null").orderBy(F.desc("semantic_score"), "chunk_id").limit(k)


def nearest_per_source(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k best chunks of every source.  Spark keeps k rows per source and task before the shuffle."""
    scored = vectors.select("chunk_id", "source", semantic_score(F.col("embedding"), query).alias("semantic_score")).where("semantic_score is not null")
    w = Window.partitionBy("source").orderBy(F.desc("semantic_score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_neighbours(chunks: DataFrame, wanted: DataFrame, n: int = 1) -> DataFrame:
    """For every row of ``wanted`` (chunk_id) the chunks of the same source at most ``n`` positions away, itself
    excluded.  An equi-join on the 2n + 1 positions, not a range join."""
    offsets = F.explode(F.sequence(F.lit(-n), F.lit(n)))
    targets = chunks.join(wanted.select("chunk_id").distinct(), "chunk_id").select("source", F.col("chunk_id").alias("target_id"), F.col("position").alias("__at"), offsets.alias("distance"))
    around = targets.where("distance <> 0").withColumn("position", F.col("__at") + F.col("distance"))
    return around.join(chunks, ["source", "position"]).drop("__at")


def hash_embedding(text: Column, size: int = DIMENSION) -> Column:
    """Deterministic feature-hashing embedding of length 1: a word adds plus or minus one at a place its hash names (the
    first 60 bits of its MD5, so that any engine can give the same vectors).  Words are found and hashed natively, Arrow
    batches of hashes are summed.  Null for null; zeros for a text without words."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def summed(marks: pd.Series) -> pd.Series:
        out = []
        for hashes in marks:
            if hashes is None:
                out.append(None)
                continue
            h = np.asarray(hashes, np.int64)
            v = np.bincount(h % size, weights=1.0 - 2.0 * ((h >> 40) & 1), minlength=size)
            length = np.linalg.norm(v)
            out.append((v / length if length > 0 else v).astype(np.float32))
        return pd.Series(out)

    return summed(F.transform(words(text), lambda w: F.conv(F.substring(F.md5(w), 1, 15), 16, 10).cast("bigint")))


def onnx_providers(available: list[str], forced: str | None = None) -> list[str]:
    """Execution providers in order: the forced device (``cpu``, ``coreml``, ``cuda``; default from ``ONNX_PROVIDER``) if
    it is available, without a forced one the best of those available, and the CPU behind it."""
    names = {"cuda": "CUDAExecutionProvider", "coreml": "CoreMLExecutionProvider", "cpu": "CPUExecutionProvider"}
    wish = (forced or os.environ.get("ONNX_PROVIDER", "")).strip().lower()
    wanted = [names[wish]] if wish in names else list(names.values())
    first = next((p for p in wanted if p in available), names["cpu"])
    return [first] if first == names["cpu"] else [first, names["cpu"]]


def default_batch_size(provider: str) -> int:
    """Texts per model call (fixed values)."""
    return {"CUDAExecutionProvider": 128, "CoreMLExecutionProvider": 64}.get(provider, 8)


@dataclass(frozen=True)
class EmbeddingModel:
    """An ONNX text encoder and its tokenizer file: what is needed to load it anywhere, and what it does."""

    model_path: str
    tokenizer_path: str
    dimension: int = DIMENSION
    #: Longest input in tokens, special ones included; longer texts are cut there, as the model demands.
    max_tokens: int = 512
    #: ``cls`` takes the first token's state, ``mean`` the average over the text's tokens.
    pooling: str = "cls"
    batch_size: int | None = None


class Encoder:
    """A loaded model: tokens, padded batches, pooling, vectors of length 1."""

    def __init__(self, model: EmbeddingModel, model_path: str, tokenizer_path: str) -> None:
        import onnxruntime
        from tokenizers import Tokenizer

        self.model = model
        self.devices = onnx_providers(onnxruntime.get_available_providers())
        self.session = onnxruntime.InferenceSession(model_path, providers=self.devices)
        self.inputs = {x.name for x in self.session.get_inputs()}
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.enable_truncation(model.max_tokens)
        self.tokenizer.enable_padding()

    def embed(self, texts: list[str]) -> list[list[float]]:
        size = self.model.batch_size or default_batch_size(self.devices[0])
        out: list[list[float]] = []
        for at in range(0, len(texts), size):
            coded = self.tokenizer.encode_batch(texts[at : at + size])
            mask = np.array([x.attention_mask for x in coded], np.int64)
            feeds = {"input_ids": np.array([x.ids for x in coded], np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
            states = self.session.run(None, {k: v for k, v in feeds.items() if k in self.inputs})[0]
            if self.model.pooling == "mean":
                states = (states * mask[..., None]).sum(1) / np.maximum(mask.sum(1), 1)[:, None]
            else:
                states = states[:, 0]
            lengths = np.linalg.norm(states, axis=1, keepdims=True)
            out += (states / np.where(lengths > 0, lengths, 1)).astype(np.float32).tolist()
        return out


_ENCODERS: dict[EmbeddingModel, Encoder] = {}


def embed_with_model(df: DataFrame, model: EmbeddingModel, text: str = "content") -> DataFrame:
    """``df`` with ``embedding``; null for a null text.  The files go along with the job, the model is loaded on first use
    and once per Python worker, on the best device there."""
    spark = df.sparkSession
    files = ship(spark, model.model_path), ship(spark, model.tokenizer_path)
    schema = df.schema.simpleString()[7:-1] + ",embedding:array<float>"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if model not in _ENCODERS:
                _ENCODERS[model] = Encoder(model, *map(shipped, files))
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            known = iter(_ENCODERS[model].embed([t for t in texts if t is not None]))
            rows = [None if t is None else next(known) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float32()))], names=[*batch.schema.names, "embedding"])

    return df.mapInArrow(run, schema)
