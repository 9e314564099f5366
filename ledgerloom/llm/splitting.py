"""Cutting oversized texts at natural boundaries.

A text is a run of words (maximal runs of characters that are no white space).  The offsets of all words are kept as
sorted arrays, so the last word that still fits under both limits is one binary search away, and so is the last
paragraph, line or sentence end before it.  Words that alone exceed the character limit are cut hard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space of Unicode, as one class that Java and Python read alike.
SPACE = r"\t-\r\x1c-\x20\x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WORD = re.compile(f"[^{SPACE}]+")
SENTENCE_END = re.compile("[.!?।][\"'”’)\\]]*$")


@dataclass(frozen=True)
class Budget:
    """A text over ``case_words`` words or ``max_chars`` characters is cut into pieces of at most ``max_words`` and ``max_chars``."""

    case_words: int = 250
    max_words: int = 230
    max_chars: int = 2000
    overlap: int = 80


def n_words(text: Column) -> Column:
    """Words of a text; null for null."""
    return F.when(text.isNotNull(), F.regexp_count(text, F.lit(f"[^{SPACE}]+")))


def oversized(text: Column, budget: Budget) -> Column:
    """True if the text exceeds the budget; a text too short for that many words isn't searched for them."""
    shortest = 2 * budget.case_words + 1
    return F.coalesce((F.length(text) > budget.max_chars) | ((F.length(text) >= shortest) & (n_words(text) > budget.case_words)), F.lit(False))


def cut(text: str, budget: Budget) -> list[tuple[int, int, int, str]]:
    """(start, end, words, kind of its end) of each piece; every word lies in a piece, in order.  A text of white space alone
    is cut by its length into pieces without words.

    >>> [text[a:b] for text in ["one two. three"] for a, b, *_ in cut(text, Budget(max_words=2, overlap=0))]
    ['one two.', 'three']
    """
    starts, ends = [], []
    for m in WORD.finditer(text):
        a, b = m.span()
        while b - a > budget.max_chars:
            starts.append(a)
            ends.append(a := a + budget.max_chars)
        starts.append(a)
        ends.append(b)
    n = len(starts)
    if not n:
        steps = range(0, len(text), budget.max_chars)
        return [(a, min(a + budget.max_chars, len(text)), 0, "hard" if a + budget.max_chars < len(text) else "end") for a in steps]
    start, end = np.array(starts), np.array(ends)
    gaps = [text[b:a] for a, b in zip(starts[1:], ends[:-1], strict=True)]
    lines = np.array([g.count("\n") for g in gaps] + [2])
    stops = np.array([bool(SENTENCE_END.search(text[a:b][-4:])) for a, b in zip(starts, ends, strict=True)])
    # positions p such that a piece may end before word p, by kind, strongest first
    kinds = [(k, np.flatnonzero(x) + 1) for k, x in (("paragraph", lines >= 2), ("line", lines >= 1), ("sentence", stops | (lines >= 1)))]
    out, i, covered = [], 0, 0
    while covered < n:
        limit = min(i + budget.max_words, int(np.searchsorted(end, start[i] + budget.max_chars, "right")), n)
        stop, kind = (n, "end") if limit == n else (0, "")
        for least in ((covered + limit + 1) // 2, covered + 1):  # first a well filled piece, then any
            for k, at in kinds if not kind else ():
                j = int(np.searchsorted(at, limit, "right")) - 1
                if j >= 0 and at[j] >= least:
                    stop, kind = int(at[j]), k
                    break
        if not kind:
            stop, kind = limit, "hard"
        out.append((starts[i], ends[stop - 1], stop - i, kind))
        covered = stop
        if covered == n:
            break
        # the next piece begins at the first natural boundary within the overlap and must reach past what is covered
        least = max(i + 1, covered - budget.overlap, covered + 1 - budget.max_words, int(np.searchsorted(start, ends[covered] - budget.max_chars, "left")))
        at = kinds[2][1]
        j = int(np.searchsorted(at, least, "left"))
        i = int(at[j]) if j < len(at) and at[j] <= covered else covered if least > covered else least
    return out


def split_oversized(df: DataFrame, keys: list[str], text: str, budget: Budget = Budget()) -> DataFrame:
    """The pieces of every row of ``df`` whose text exceeds the budget.

    One row a piece: the keys, ``piece`` (from 0), ``n_pieces``, ``start`` and ``end`` (code points), ``n_words``,
    ``ended`` (paragraph, line, sentence, hard or end) and ``text``.  A long text of white space
    alone gives pieces without words.  Rows with a null or small text give none; rows
    that occur twice are cut twice; null keys stay null; columns that aren't keys are left out, so that no name clashes.
    """
    schema = T.StructType([df.schema[k] for k in keys] + T._parse_datatype_string("piece int, n_pieces int, start int, end int, n_words int, ended string, text string").fields)
    names = [f"key_{i}" for i in range(len(keys))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cuts = [cut(t, budget) for t in b["body"]]
            rows = np.repeat(np.arange(len(b)), [len(c) for c in cuts])
            flat = [x for c in cuts for x in c]
            out = b[names].iloc[rows].reset_index(drop=True).set_axis(keys, axis=1)
            out["piece"] = np.concatenate([np.arange(len(c)) for c in cuts] or [np.array([], int)]).astype("int32")
            out["n_pieces"] = np.repeat([len(c) for c in cuts], [len(c) for c in cuts]).astype("int32")
            for k, c in enumerate(("start", "end", "n_words", "ended")):
                out[c] = [x[k] for x in flat]
            out["text"] = [t[x[0] : x[1]] for t, c in zip(b["body"], cuts, strict=True) for x in c]
            yield out

    rows = df.where(oversized(F.col(text), budget)).select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(text).alias("body"))
    return rows.mapInPandas(run, schema)
