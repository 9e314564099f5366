"""Filling containers of fixed capacity: vector bin packing with the dot-product heuristic.

Every item has three sizes: tokens, segments (1) and loss-bearing tokens.  A container takes items while all three
stay under its limits; the next item is the one whose size vector has the largest dot product with what is left, both
relative to the limits.  Items are spread evenly over shards of a bounded number of items and packed shard by shard:
at thousands of items each, only the last container of a shard stays open, so nothing is gained by a global order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Limits of a container; ``segments`` and ``loss`` bound what a training step may hold beside its tokens."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


def byte_pieces(text: str, limit: int) -> list[tuple[int, int]]:
    """Byte ranges of at most ``limit`` tokens, cut between characters; the last has room for the end mark."""
    raw = text.encode("utf-8", "surrogatepass")
    out, at = [], 0
    while len(raw) - at + 1 > limit:
        stop = min(at + limit, len(raw))
        while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
            stop -= 1
        out.append((at, stop))
        at = stop
    return [*out, (at, len(raw))]


def pack(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> np.ndarray:
    """The container (from 0) of each item; items that exceed a limit alone get one each.

    Equal items form a class, so that a step looks at each distinct size once.
    """
    n = len(tokens)
    out = np.full(n, -1, np.int64)
    if not n:
        return out
    sizes, which = np.unique(np.stack([-tokens, -loss], 1), axis=0, return_inverse=True)
    which = which.reshape(-1)
    sizes = -sizes
    members = np.argsort(which, kind="stable")
    ends = np.cumsum(np.bincount(which, minlength=len(sizes)))
    left = np.bincount(which, minlength=len(sizes))
    rel = np.stack([sizes[:, 0] / limits.tokens, np.full(len(sizes), 1 / limits.segments), sizes[:, 1] / limits.loss], 1)
    at, todo = 0, n
    while todo:
        room = np.array([limits.tokens, limits.segments, limits.loss], np.int64)
        empty = True
        while room[1] > 0:
            first = int(np.searchsorted(-sizes[:, 0], -room[0], "left"))  # sizes fall: the rest fits by tokens
            fits = (left[first:] > 0) & (sizes[first:, 1] <= room[2])
            if empty and not fits.any():
                first, fits = 0, left > 0  # what is left exceeds a limit alone
            if not fits.any():
                break
            score = np.where(fits, rel[first:] @ (room / (limits.tokens, limits.segments, limits.loss)), -1.0)
            k = first + int(score.argmax())
            out[members[ends[k] - left[k]]] = at
            left[k] -= 1
            todo -= 1
            empty = False
            room = room - (sizes[k, 0], 1, sizes[k, 1])
        at += 1
    return out


def pack_documents(df: DataFrame, key: str, text: str, limits: Limits = Limits(), shard_items: int = 20_000) -> DataFrame:
    """Assign the texts of ``df`` to containers, sized by bytes plus one end mark.

    One row a piece: ``doc_id`` (the key), ``piece``, ``n_pieces``, ``byte_start``, ``byte_end``, ``n_tokens``,
    ``shard`` and ``bin``.  A text is cut only if it alone exceeds a container.  Null texts are no items; empty texts
    are items of one token; copies and rows with the same key are items of their own; a null key stays null.
    The end mark bears no loss, every other token does.
    """
    key_type = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.octet_length(text).alias("n"), F.when(F.octet_length(text) >= limits.tokens, F.col(text)).alias("body"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = [byte_pieces(t, limits.tokens) if t is not None else [(0, n)] for t, n in zip(b["body"], b["n"], strict=True)]
            count = np.array([len(s) for s in spans], int)
            flat = np.array([x for s in spans for x in s], np.int32).reshape(-1, 2)
            piece = np.concatenate([np.arange(c) for c in count]) if len(count) else np.array([], int)
            rows = np.repeat(np.arange(len(b)), count)
            last = piece == count[rows] - 1
            yield pd.DataFrame({"doc_id": b["doc_id"].iloc[rows].reset_index(drop=True), "piece": piece.astype("int32"), "n_pieces": count[rows].astype("int32"), "byte_start": flat[:, 0], "byte_end": flat[:, 1], "n_tokens": (flat[:, 1] - flat[:, 0] + last).astype("int32")})

    schema = f"doc_id {key_type}, piece int, n_pieces int, byte_start int, byte_end int, n_tokens int"
    pieces = rows.mapInPandas(cut, schema)
    loss = F.col("n_tokens") - (F.col("piece") == F.col("n_pieces") - 1).cast("int")
    out = _filled(pieces.withColumn("n_loss", loss), df.where(F.col(text).isNotNull()).count(), limits, shard_items)
    return out.drop("n_loss")


def _filled(pieces: DataFrame, items: int, limits: Limits, shard_items: int) -> DataFrame:
    """``pieces`` (doc_id, piece, n_tokens, n_loss, ...) with ``shard`` and ``bin``; items are spread evenly over shards."""
    shards = max(1, math.ceil(items / shard_items))
    shard = F.lit(0) if shards == 1 else F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(shards)).cast("int")
    pieces = pieces.withColumn("shard", shard)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "n_tokens", "n_loss"], kind="stable").reset_index(drop=True)
        return pdf.assign(bin=pack(pdf["n_tokens"].to_numpy(np.int64), pdf["n_loss"].to_numpy(np.int64), limits))

    return pieces.groupBy("shard").applyInPandas(fill, f"struct<{pieces.schema.simpleString()[7:-1]},bin:bigint>")


def example_pieces(prompt: int, answer: int, limits: Limits) -> list[tuple[int, int]]:
    """(tokens, loss-bearing tokens) of the pieces of an example, as few as both limits allow, in order.

    >>> example_pieces(10, 30, Limits(tokens=25, loss=12)), example_pieces(3, 4, Limits())
    ([(22, 12), (12, 12), (6, 6)], [(7, 4)])
    """
    out = []
    while prompt + answer > 0 or not out:
        head = min(prompt, limits.tokens)
        tail = min(answer, limits.loss, limits.tokens - head)
        out.append((head + tail, tail))
        prompt, answer = prompt - head, answer - tail
    return out


def pack_examples(df: DataFrame, key: str, prompt: str, answer: str, limits: Limits = Limits(segments=16, loss=2048), shard_items: int = 20_000) -> DataFrame:
    """Assign instruction examples to containers: a prompt, which bears no loss, and an answer, which does, with its end mark.

    One row a piece: ``doc_id``, ``piece``, ``n_pieces``, ``n_tokens``, ``n_loss``, ``shard`` and ``bin``.  An example is cut only if it alone
    exceeds a limit.  A null answer is no example; a null prompt is empty; repeated rows are examples of their own.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(answer).isNotNull()).select(F.col(key).alias("doc_id"), F.coalesce(F.octet_length(prompt), F.lit(0)).alias("p"), (F.octet_length(answer) + 1).alias("a"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p, a = b["p"].to_numpy(np.int64), b["a"].to_numpy(np.int64)
            big = (p + a > limits.tokens) | (a > limits.loss)
            spans = [example_pieces(int(x), int(y), limits) if o else [(x + y, y)] for x, y, o in zip(p, a, big, strict=True)]
            count = np.array([len(s) for s in spans], int)
            flat = np.array([x for s in spans for x in s], np.int32).reshape(-1, 2)
            row = np.repeat(np.arange(len(b)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            yield pd.DataFrame({"doc_id": b["doc_id"].iloc[row].reset_index(drop=True), "piece": piece.astype("int32"), "n_pieces": count[row].astype("int32"), "n_tokens": flat[:, 0], "n_loss": flat[:, 1]})

    pieces = rows.mapInPandas(cut, f"doc_id {kind}, piece int, n_pieces int, n_tokens int, n_loss int")
    return _filled(pieces, df.where(F.col(answer).isNotNull()).count(), limits, shard_items)
