"""Texts to unit vectors.  Strategies share one interface; queries and documents must use the same one."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.functions.text import STOP


log = logging.getLogger(__name__)


class Embedder(Protocol):
    """Made once a worker, then called with lists of texts."""

    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class OnnxEmbedder:
    """A sentence encoder in ONNX form: a directory with ``model.onnx`` and ``tokenizer.json``.

    Texts are sorted by length, so a batch pads little; token vectors are averaged under the mask and normalised.
    """

    def __init__(self, path: str, dim: int = 384, max_tokens: int = 512, batch: int = 4):
        self.path, self.dim, self.max_tokens, self.batch, self._model = path, dim, max_tokens, batch, None

    def _load(self):
        import onnxruntime
        from tokenizers import Tokenizer

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        options.enable_cpu_mem_arena = False
        tokenizer = Tokenizer.from_file(str(Path(self.path) / "tokenizer.json"))
        tokenizer.enable_truncation(self.max_tokens)
        return tokenizer, onnxruntime.InferenceSession(str(Path(self.path) / "model.onnx"), options)

    def encode(self, texts: list[str]) -> np.ndarray:
        self._model = self._model or self._load()
        tokenizer, model = self._model
        coded = tokenizer.encode_batch(texts)
        if cut := sum(bool(c.overflowing) for c in coded):
            log.warning("%d of %d texts are longer than %d tokens; their ends are not embedded", cut, len(texts), self.max_tokens)
        out = np.zeros((len(texts), self.dim), np.float32)
        order = np.argsort([-len(c.ids) for c in coded], kind="stable")
        for a in range(0, len(order), self.batch):
            at = order[a : a + self.batch]
            width = max(len(coded[i].ids) for i in at)
            ids, mask = np.zeros((len(at), width), np.int64), np.zeros((len(at), width), np.int64)
            for r, i in enumerate(at):
                n = len(coded[i].ids)
                ids[r, :n], mask[r, :n] = coded[i].ids, 1
            names = {x.name for x in model.get_inputs()}
            feed = {k: v for k, v in (("input_ids", ids), ("attention_mask", mask), ("token_type_ids", np.zeros_like(ids))) if k in names}
            hidden = model.run(None, feed)[0]
            pooled = (hidden * mask[..., None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1e-9)
            if pooled.shape[1] != self.dim:
                raise RuntimeError(f"the model gives {pooled.shape[1]} dimensions, not {self.dim}")
            out[at] = pooled / np.maximum(np.linalg.norm(pooled, axis=1, keepdims=True), 1e-12)
        return out


class TransformerEmbedder:
    """The same encoder by another library, where that is installed: slower to load and larger in memory."""

    name = "transformer"

    def __init__(self, model: str, dim: int = 384, max_tokens: int = 512, batch: int = 16):
        self.model, self.dim, self.max_tokens, self.batch, self._model = model, dim, max_tokens, batch, None

    def encode(self, texts: list[str]) -> np.ndarray:
        if self._model is None:
            from sentence_transformers import SentenceTransformer

            self._model = SentenceTransformer(self.model)
            self._model.max_seq_length = self.max_tokens
        out = np.asarray(self._model.encode(texts, batch_size=self.batch, normalize_embeddings=True, show_progress_bar=False, convert_to_numpy=True), np.float32)
        if len(texts) and out.shape[1] != self.dim:
            raise RuntimeError(f"the model gives {out.shape[1]} dimensions, not {self.dim}")
        return out.reshape(len(texts), self.dim)


class FirstAvailable:
    """The first of several embedders that can encode on this worker; which one that is, is settled once and logged.

    All must give the same vectors, else questions and documents don't meet.
    """

    def __init__(self, *options: Embedder):
        self.options, self.dim, self.chosen = options, options[0].dim, None
        if any(o.dim != self.dim for o in options):
            raise ValueError("embedders of different dimensions")

    def encode(self, texts: list[str]) -> np.ndarray:
        if self.chosen is None:
            for option in self.options:
                try:
                    option.encode(["probe"])
                    self.chosen = option
                    break
                except Exception as error:  # noqa: BLE001 - a missing file, a missing library, a broken model
                    log.warning("embedder %s isn't available: %s: %s", getattr(option, "name", type(option).__name__), type(error).__name__, error)
            else:
                raise RuntimeError("no embedder is available")
        return self.chosen.encode(texts)


BACKENDS = ("onnx", "transformer", "hashed")


def backend(name: str, model: str = "", dim: int = 384, max_tokens: int = 512) -> Embedder:
    """An embedder by name: onnx falls back to transformer, the others stand alone."""
    make: dict[str, Callable[[], Embedder]] = {
        "onnx": lambda: FirstAvailable(OnnxEmbedder(model, dim, max_tokens), TransformerEmbedder(model, dim, max_tokens)),
        "transformer": lambda: TransformerEmbedder(model, dim, max_tokens),
        "hashed": lambda: HashedEmbedder(dim),
    }
    if name not in make:
        raise ValueError(f"the backend must be one of {', '.join(BACKENDS)}, not {name!r}")
    return make[name]()


def embed(df: DataFrame, text: str, embedder: Embedder) -> DataFrame:
    """``df`` with ``embedding``; a null text has a null one."""
    out = df.schema.simpleString()[7:-1] + ",embedding:array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            on = b[text].notna().to_numpy()
            vectors = np.zeros((len(b), embedder.dim), np.float32)
            if on.any():
                got = embedder.encode(b.loc[on, text].tolist())
                if len(got) != on.sum():
                    raise RuntimeError(f"the embedder gave {len(got)} vectors for {on.sum()} texts")
                vectors[on] = got
            yield b.assign(embedding=[v if o else None for v, o in zip(vectors, on, strict=True)])

    return df.mapInPandas(run, f"struct<{out}>")


class HashedEmbedder:
    """A deterministic stand-in without a model: counts of hashed tokens, normalised; all zero for no tokens."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        stop, out = frozenset(STOP), np.zeros((len(texts), self.dim), np.float32)
        for i, text in enumerate(texts):
            for t in re.findall("[a-z0-9]+", text.lower()):
                if len(t) > 1 and t not in stop:
                    out[i, xxhash.xxh64_intdigest(t, 42) % self.dim] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def bad_vectors(df: DataFrame, key: str, vector: str, config: EngineConfig = EngineConfig(), tolerance: float = 1e-4) -> DataFrame:
    """(key, problem) of the rows whose vector is null, of another length, not finite or not of unit length."""
    v = F.col(vector)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    problem = F.when(v.isNull(), "null").when(F.size(v) != config.embed_dim, "length").when(~finite, "not finite").when(F.abs(norm(v) - 1) >= tolerance, "not unit")
    return df.select(F.col(key), problem.alias("problem")).where("problem is not null")
