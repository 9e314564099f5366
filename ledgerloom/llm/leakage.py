"""Evaluation items that stand, wholly or partly, in training documents.

Texts become tokens ``[a-z0-9]+``; a token of the items is typed once for all places: number, unit, name (seen only
capitalised in the items) or word.  A template is a window of tokens in which typed tokens are placeholders.  Windows
of documents and items are joined by the hash of their templates, and the slots of each pair of windows are compared:
equal slots are a literal leak; slots that map one to one are the item with other numbers, names or units in it.

A number or name may be exchanged for one of another number of tokens.  So texts are also read in whole parts: a number
with its separators, decimals, currency and unit is one slot, and so is a run of capitalised words.  A window of parts
covers at least as many tokens of the item as a window of tokens, and has at least ``least_words`` words and no more
slots than words; a question that hasn't is compared by its tokens alone.

The windows of the items are few beside those of the documents.  While they stay under ``broadcast_windows`` their
hashes are sent to the readers, which then give out only windows that can join; beyond that every window is joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.storage import spread

TOKEN = re.compile(r"[A-Za-z0-9]+")

# Words that measure, abbreviated or in full.
UNITS = frozenset("lakh lakhs crore crores cr rs inr usd percent bps day days week weeks month months year years hour hours minute minutes kg km kilometres kilometers".split())
NUMBER, UNIT, NAME = 1, 2, 3
CURRENCY = "rs|inr|usd"
_UNIT = "|".join(sorted(UNITS.difference(CURRENCY.split("|")), key=len, reverse=True))
_NUMBER = rf"(?:(?i:{CURRENCY})\.?[ \xa0]*(?=\d))?+[A-Za-z]*+\d[A-Za-z0-9]*+(?:(?<=\d)(?:,\d{{2,3}}(?!\d)|\.\d+))*+[A-Za-z]*+(?:[ \xa0-]+(?i:per[ \xa0]cent|{_UNIT}|(?:{CURRENCY})(?!\.?[ \xa0]*\d))(?![A-Za-z0-9]))*+"
# the first word of a sentence stands alone; a space after it says that a capitalised word follows
_FIRST = r"(?:(?<![^\n])|(?<=[.?!:;\"“”‘(\[*#|>])|(?<=[.?!:;\"“”‘(\[*#|>]\s))[A-Z][A-Za-z]*+(?:[ \xa0](?=[A-Z]))?+"
_RUN = rf"[A-Z][A-Za-z]*+(?:(?:[ \xa0]*[-–&'’][ \xa0]*|[ \xa0]+)(?!(?i:{CURRENCY})(?![A-Za-z]))[A-Z][A-Za-z]*+(?![0-9]))*+"
WHOLE = re.compile(rf"{_NUMBER}|{_FIRST}|{_RUN}|[A-Za-z0-9]+")
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@dataclass(frozen=True)
class Windows:
    """``passage`` tokens in a row of a passage are a leak, as is a whole question; a template join uses windows of up to that size.

    ``least_words`` words must be in a window of whole parts.  A passage with other numbers, names or units in it is a leak only if
    that part (``exchanged``) of its windows is there: one sentence alone may have its frame from anywhere.
    """

    passage: int = 12
    least_words: int = 3
    exchanged: float = 0.5
    broadcast_windows: int = 1_000_000


def tokens(text: str | None) -> list[str]:
    """Tokens with their case; lower-casing before or after is the same but for letters outside ASCII that lower-case into it.

    >>> tokens("Gains of 14.2% (FY)")
    ['Gains', 'of', '14', '2', 'FY']
    """
    return TOKEN.findall(_folded(text))


def _folded(text: str | None) -> str:
    text = text or ""
    return text if text.isascii() else "".join(c.lower() if not c.isascii() and c.lower()[:1].isascii() else c for c in text)


def parts(text: str | None) -> list[str]:
    """Whole numbers, runs of capitalised words and words, as they are written.

    >>> parts("Gains of Rs 1,14,000.5 lakh on Niri Flexi Cap Fund rose 2.5% in 31 months.")
    ['Gains', 'of', 'Rs 1,14,000.5 lakh', 'on', 'Niri Flexi Cap Fund', 'rose', '2.5', 'in', '31 months']
    """
    return WHOLE.findall(_folded(text))


def code(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def kind_of(low: str) -> int:
    return NUMBER if any(c.isdigit() for c in low) else UNIT if low in UNITS else 0


def lexicon(texts: list[str | None]) -> dict[str, int]:
    """Kind of each token of the items; a word is a name if the items never write it in lower case and capitalise it after another word."""
    low, name = set(), set()
    for text in texts:
        for before, t in zip([None, *(ts := tokens(text))], ts):
            if t[0].islower():
                low.add(t)
            elif before and t[0].isupper():
                name.add(t.lower())
            low.update([t] if t.islower() else [])
    words = {t.lower() for text in texts for t in tokens(text)}
    return {w: kind_of(w) or (NAME if w in name and w not in low else 0) for w in words}


def hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` values, wrapping in 64 bits."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * BASE + values[k : k + n]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def window_hashes(values: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, ``hashes``) for ascending sizes, each built on the one before."""
    out, done = np.zeros(len(values), np.uint64), 0
    for size in sizes:
        n = len(values) - size + 1
        if n <= 0:
            return
        for k in range(done, size):
            out = out[:n] * BASE + values[k : k + n]
        done = size
        h = out ^ (out >> np.uint64(29))
        yield size, h * np.uint64(0xBF58476D1CE4E5B9)


class Coder:
    """Exact and template codes of tokens, with what was seen so far kept up to a bound."""

    def __init__(self, kinds: dict[str, int], bound: int = 200_000):
        self.kinds, self.bound, self.known, self.wholes = kinds, bound, {}, {}

    def one(self, t: str) -> tuple[int, int]:
        low = t.lower()
        kind = self.kinds.get(low)
        if kind is None:  # no item has it: it can only fill a slot
            kind = kind_of(low) or (NAME if t[0].isupper() else 0)
        exact = code(low)
        return exact, kind or exact

    def many(self, ts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        both = self._rows(ts, self.known, self.one)
        return both[:, 0], both[:, 1]

    def _rows(self, ts: list[str], known: dict[str, tuple], made) -> np.ndarray:
        """A row of codes for each of ``ts``; each distinct one is looked up once."""
        if len(known) > self.bound:
            known.clear()
        at = {t: k for k, t in enumerate(set(ts))}
        for t in at.keys() - known.keys():
            known[t] = made(t)
        table = np.array([known[t] for t in at], np.uint64).reshape(len(at), -1 if at else 3)
        return table[np.fromiter(map(at.__getitem__, ts), np.int64, len(ts))]


    def whole(self, t: str) -> tuple[int, int]:
        words = TOKEN.findall(t.lower())
        if any(c.isdigit() for c in t):
            return code(" ".join(words)), NUMBER
        return self.one(t.strip()) if len(words) == 1 else (sum(map(code, words)) % 2**64, NAME)

    def parts(self, ts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exact and template codes of parts, and the position in ``ts`` of each: a sentence's first word that is a name joins the name it stands before."""
        both = self._rows(ts, self.wholes, lambda t: (*self.whole(t), t[-1].isspace()))
        exact, shape, before = both[:, 0].copy(), both[:, 1], both[:, 2] > 0
        joined = np.flatnonzero(before[:-1] & (shape[:-1] == NAME) & (shape[1:] == NAME))
        exact[joined + 1] += exact[joined]
        left = np.ones(len(ts), bool)
        left[joined] = False
        return exact[left], shape[left], np.flatnonzero(left)


def _slots(exact: np.ndarray, shape: np.ndarray, at: np.ndarray, size: int) -> list[list[int]]:
    """The tokens in the slots of the windows that begin at ``at``."""
    out = []
    for i in at:
        w = slice(i, i + size)
        out.append(exact[w][shape[w] <= NAME].view(np.int64).tolist())
    return out


_ITEM = "item_id int, part string, whole boolean, size int, at int, needed int, of int, key long, slots array<long>"


def _part_windows(shape: np.ndarray, lengths: np.ndarray, part: str, windows: Windows) -> list[tuple[int, int]]:
    """(at, size) of the windows of whole parts: of a passage the shortest at each place that is long enough and has enough words."""
    word = shape > NAME
    n = len(shape)
    enough = lambda a, b: (k := int(word[a:b].sum())) >= windows.least_words and 2 * k >= b - a
    if part == "question":
        size = min(windows.passage, n)
        return [(a, size) for a in range(n - size + 1)] if n and enough(0, n) else []
    out, covered = [], np.r_[0, np.cumsum(lengths)]
    for a in range(n):
        first = int(np.searchsorted(covered, covered[a] + windows.passage))
        b = next((b for b in range(first, min(n, a + 4 * windows.passage) + 1) if enough(a, b)), None)
        if b:
            out.append((a, b - a))
    return out


def item_windows(items: DataFrame, item_key: str, passage: str, question: str, windows: Windows = Windows()) -> tuple[pd.DataFrame, dict[str, int]]:
    """Windows of all items, on the driver: held-out sets are small and made by hand; the caller checks their number.

    A question shorter than a window is one window of its own size; a passage shorter than a window can't leak.
    """
    pdf = items.select(F.col(item_key).cast("int").alias("i"), F.col(passage).alias("p"), F.col(question).alias("q")).dropna(subset=["i"]).distinct().toPandas().sort_values("i", kind="stable")
    kinds = lexicon([*pdf["p"], *pdf["q"]])
    coder, out = Coder(kinds), []
    for i, p, q in pdf.itertuples(index=False):
        for part, text in (("passage", p), ("question", q)):
            exact, shape = coder.many(tokens(text))
            size = windows.passage if part == "passage" else min(windows.passage, len(exact))
            h = hashes(shape, size) if size else []
            at = np.arange(len(h))
            out += [(i, part, False, size, int(a), 1 if part == "passage" else len(h), len(h), int(k), s) for a, k, s in zip(at, np.asarray(h, np.uint64).view(np.int64), _slots(exact, shape, at, size), strict=True)]
            whole = parts(text)
            exact, shape, at = coder.parts(whole)
            lengths = np.add.reduceat([len(TOKEN.findall(x)) for x in whole], np.r_[0, at[:-1] + 1]) if len(at) else at
            own = _part_windows(shape, lengths, part, windows)
            needed = 1 if part == "passage" else len(own)
            for size, h in window_hashes(shape, sorted({z for _, z in own})):
                at = np.array([a for a, z in own if z == size])
                out += [(i, part, True, size, int(a), needed, len(own), int(k), s) for a, k, s in zip(at, h[at].view(np.int64), _slots(exact, shape, at, size), strict=True)]
    return pd.DataFrame(out, columns=["item_id", "part", "whole", "size", "at", "needed", "of", "key", "slots"]), kinds


class Keys:
    """The keys of windows of one size: a table by leading bits rules out nearly all others, a search the rest."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.keys, self.shift = np.unique(keys), np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.keys >> self.shift).astype(np.int64)] = True

    def has(self, h: np.ndarray) -> np.ndarray:
        """Positions in ``h`` of keys."""
        at = np.flatnonzero(self.table[(h >> self.shift).astype(np.int64)])
        near = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        return at[self.keys[near] == h[at]]


def document_windows(docs: DataFrame, doc_key: str, text: str, kinds: dict[str, int], sizes: dict[bool, list[int]], keys: dict[tuple[bool, int], np.ndarray] | None) -> DataFrame:
    """(doc_id, whole, size, at, key, slots) of the template windows of all texts, of tokens and of whole parts, only those with a key of ``keys`` if given."""
    kind = docs.schema[doc_key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(kinds)
        held = None if keys is None else {k: Keys(v) for k, v in keys.items()}
        for b in batches:
            texts = b.column(1).to_pylist()
            for whole in (w for w in (False, True) if sizes[w]):
                lists = [parts(t) if whole else tokens(t) for t in texts]
                flat = [t for x in lists for t in x]
                owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                if whole:
                    exact, shape, left = coder.parts(flat)
                    owner = owner[left]
                else:
                    exact, shape = coder.many(flat)
                count = np.bincount(owner, minlength=len(lists))
                start = np.cumsum(count) - count
                for size, h in window_hashes(shape, sizes[whole]):
                    at = np.arange(len(h)) if held is None else held[whole, size].has(h)
                    at = at[owner[at] == owner[at + size - 1]]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(owner[at])), pa.array(np.full(len(at), whole)), pa.array(np.full(len(at), size, np.int32)), pa.array((at - start[owner[at]]).astype(np.int32)), pa.array(h[at].view(np.int64)), pa.array(_slots(exact, shape, at, size), pa.list_(pa.int64()))],
                        names=["doc_id", "whole", "size", "at", "key", "slots"],
                    )

    rows = docs.where(F.col(doc_key).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_key).alias("doc_id"), F.col(text).alias("body"))
    return spread(rows).mapInArrow(run, f"doc_id {kind}, whole boolean, size int, at int, key long, slots array<long>")


def one_to_one(a, b):
    """True if the slots ``a`` and ``b`` map onto each other, each value to one value."""
    pairs = F.size(F.array_distinct(F.arrays_zip(a, b)))
    return (pairs == F.size(F.array_distinct(a))) & (pairs == F.size(F.array_distinct(b)))


def leaks(docs: DataFrame, items: DataFrame, *, doc_key: str = "doc_id", text: str = "text", item_key: str = "id", passage: str = "passage", question: str = "question", windows: Windows = Windows(), exchanged: bool = True) -> DataFrame:
    """(doc_id, item_id, part, literal, n_windows): documents with a part of an item.

    ``literal`` leaks have all tokens of the run; the others have half of the passage's windows, or the whole question, with consistently
    exchanged numbers, names or units, of whatever number of tokens; without ``exchanged`` only literal ones are sought.  A question counts only where all its windows follow each other.  Null keys and texts are left out; texts
    without tokens leak nothing; documents with one key count together; no items give no rows.
    """
    spark = docs.sparkSession
    pdf, kinds = item_windows(items, item_key, passage, question, windows)
    if not exchanged:
        pdf = pdf[~pdf["whole"].astype(bool)]
    side = spark.createDataFrame([(int(r[0]), r[1], bool(r[2]), int(r[3]), int(r[4]), int(r[5]), int(r[6]), int(r[7]), r[8]) for r in pdf.itertuples(index=False)], _ITEM)
    groups = {(bool(w), int(z)): g.to_numpy(np.int64).view(np.uint64) for (w, z), g in pdf.groupby(["whole", "size"])["key"]}
    sizes = {w: sorted(z for x, z in groups if x == w) for w in (False, True)}
    few = len(pdf) <= windows.broadcast_windows
    found = document_windows(docs, doc_key, text, kinds, sizes, groups if few else None)
    if few:
        side = F.broadcast(side)
    i, d = side.alias("i"), found.alias("d")
    both = d.join(i, (F.col("d.key") == F.col("i.key")) & (F.col("d.size") == F.col("i.size")) & (F.col("d.whole") == F.col("i.whole")))
    same = F.col("d.slots") == F.col("i.slots")
    checked = both.select(
        "d.doc_id", "i.item_id", "i.part", "i.needed", "i.of", "i.whole", F.col("i.at").alias("item_at"), (same & ~F.col("i.whole")).alias("literal"),
        F.when(F.col("i.part") == "question", F.col("d.at") - F.col("i.at")).alias("line"),
        (same | one_to_one(F.col("d.slots"), F.col("i.slots"))).alias("consistent"),
    ).where("consistent" if exchanged else "literal")
    # windows of a question in a row: all of them, at one distance
    runs = checked.groupBy("doc_id", "item_id", "part", "whole", "needed", "of", "line").agg(F.count_distinct("item_at").alias("n"), F.count_distinct(F.when(F.col("literal"), F.col("item_at"))).alias("n_literal"))
    enough = F.when(F.col("part") == "question", F.col("needed")).otherwise(F.greatest(F.lit(1), F.ceil(F.col("of") * windows.exchanged)))
    runs = runs.where((F.col("n_literal") >= F.col("needed")) | (F.col("n") >= enough))
    return runs.groupBy("doc_id", "item_id", "part").agg(F.max(F.col("n_literal") >= F.col("needed")).alias("literal"), F.max("n").cast("int").alias("n_windows"))
