"""Near-duplicate texts: exact Jaccard similarity of word shingles, by tiles of bit vectors.

A text is the set of its shingles, hashed to 64 bits.  Its bit vector holds the parity of the shingles that fall on
each bit, so the exclusive-or of two vectors has at most as many bits as the two sets have differences: a pair whose bit
count exceeds the radius ``(1 - t) / (1 + t) * (n + m)`` can't reach the similarity ``t``, and no pair within it is lost.

Comparing all tiles with all would be quadratic, so texts are compared within blocks.  All shingles are ordered, rare
ones first, and a text enters the blocks of its first ``n - ceil(t * n) + 1`` shingles; two texts at or above ``t``
always meet in one of them.  The order comes from a table of counters over all shingles; it grows with the collection up
to ``counters`` cells (16 MB, which every task writes once), and a collision changes the order but loses no pair.  Within a block rows are sorted by set size, the
population count of the full vector; tiles that differ in it beyond the radius are skipped.  Blocks stream through a task one
after the other, so its memory is that of the largest block.  A shingle with more than ``hot`` rows of its own, counted exactly
wherever its counter leaves that open, is cut into pairs of tiles that go to different tasks.  What is left is checked on
the texts themselves.

Texts with the same shingles form one class and are compared once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.leakage import hashes
from ledgerloom.storage import settle, spread

TOKEN = re.compile("[a-z0-9]+")
PARTS = 32
WORDS = 8  # 64-bit words of a bit vector: telling for sets of up to some 500 shingles
_SIZE, _SIDE = 16, 2  # low bits of a block id: set size, side of a pair of tiles
WHOLE, LEFT, RIGHT = 2, 0, 1


@dataclass(frozen=True)
class Near:
    """Shingles of ``words`` words; pairs at or above ``similarity``; texts of fewer than ``least_tokens`` tokens take no part.

    ``counters``, ``tile``, ``hot`` and ``cut`` steer the work and change no result.
    """

    words: int = 5
    similarity: float = 0.8
    least_tokens: int = 0
    counters: int = 1 << 22
    tile: int = 512
    hot: int = 20_000
    cut: int = 500_000


def token_sets(texts: list[str | None], near: Near, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle) of all distinct shingles, sorted, and the number of shingles of each text (0: takes no part)."""
    lists = [TOKEN.findall(t.lower()) if t else [] for t in texts]
    lists = [x if len(x) >= near.least_tokens else [] for x in lists]
    if len(known) > 300_000:
        known.clear()
    for x in lists:
        for t in x:
            if t not in known:
                known[t] = xxhash.xxh3_64_intdigest(t)
    count = np.array([len(x) for x in lists], np.int64)
    codes = np.fromiter((known[t] for x in lists for t in x), np.uint64, int(count.sum()))
    owner = np.repeat(np.arange(len(lists)), count)
    h = hashes(codes, near.words)
    same = owner[: len(h)] == owner[len(owner) - len(h) :]
    owner, h = owner[: len(h)][same], h[same]
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    owner, h = owner[first], h[first]
    return owner, h, np.bincount(owner, minlength=len(lists))


def set_ids(owner: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One id for each set of shingles."""
    mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    out = np.zeros(len(n), np.uint64)
    np.add.at(out, owner, mixed ^ (mixed >> np.uint64(33)))
    return (out + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def bit_vectors(owner: np.ndarray, h: np.ndarray, texts: int) -> np.ndarray:
    width = WORDS * 64
    bits = np.bincount(owner * width + (h % np.uint64(width)).astype(np.int64), minlength=texts * width).reshape(texts, width) & 1
    return np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)


def _bucket(h: np.ndarray, counters: int) -> np.ndarray:
    return (h >> np.uint64(64 - int(math.log2(counters)))).astype(np.int64)


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return spread(df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("body")))


def cells(texts: DataFrame, near: Near) -> int:
    """Counters for the collection: about one for each 16 shingles, a word having some six characters; a power of two."""
    chars = texts.agg(F.coalesce(F.sum(F.length("body")), F.lit(0))).first()[0]
    return min(near.counters, 1 << max(20, math.ceil(math.log2(chars / 96 + 1))))


def census(texts: DataFrame, near: Near) -> tuple[DataFrame, np.ndarray]:
    """(id, sid) of every text that takes part, and the counters of all shingles."""
    size = cells(texts, near)
    rows = "id long, sid long, n int, part int, counts binary"
    schema = pa.schema([("id", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known, any_row = np.zeros(size, np.uint32), {}, False
        for b in batches:
            owner, h, n = token_sets(b.column(1).to_pylist(), near, known)
            at, many = np.unique(_bucket(h, size), return_counts=True)
            total[at] += many.astype(np.uint32)
            on = np.flatnonzero(n)
            any_row |= len(on) > 0
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(on)), pa.array(set_ids(owner, h, n)[on]), pa.array(n[on].astype(np.int32)), pa.nulls(len(on), pa.int32()), pa.nulls(len(on), pa.binary())], schema=schema)
        if any_row:
            parts = [zlib.compress(x.tobytes(), 1) for x in total.reshape(PARTS, -1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(PARTS, pa.int64()), pa.nulls(PARTS, pa.int64()), pa.nulls(PARTS, pa.int32()), pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(blob), np.uint32)
                sums[part] = sums[part] + x if part in sums else x.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["part", "counts"])

    table = settle(texts.mapInArrow(run, rows), "census")
    counts = np.zeros((PARTS, size // PARTS), np.uint32)
    for r in table.where("part is not null").select("part", "counts").repartition(PARTS, "part").mapInArrow(add, "part int, counts binary").collect():
        counts[r.part] = np.frombuffer(zlib.decompress(r.counts), np.uint32)
    return table.where("part is null").select("id", "sid", "n"), counts.reshape(-1)


def _prefixes(texts: DataFrame, near: Near, counts: np.ndarray, schema: str, give) -> DataFrame:
    """What ``give`` makes of each batch's prefixes: (owner, shingle, counter) of the first shingles of each new class, its
    class ids, sizes and all its shingles."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, freq = {}, set(), shared.value
        for b in batches:
            owner, h, n = token_sets(b.column(1).to_pylist(), near, known)
            sid = set_ids(owner, h, n)
            new = np.zeros(len(n), bool)
            for i in np.flatnonzero(n):
                if sid[i] not in seen:
                    new[i] = True
                    seen.add(sid[i])
            if len(seen) > 1_000_000:
                seen.clear()
            keep = new[owner]
            mine, g = owner[keep], h[keep]
            f = freq[_bucket(g, len(freq))]
            order = np.lexsort((g, f, mine))
            mine, g, f = mine[order], g[order], f[order]
            size = np.where(new, n, 0)
            rank = np.arange(len(g)) - (np.cumsum(size) - size)[mine]
            on = rank < (n - np.ceil(near.similarity * n - 1e-9).astype(np.int64) + 1)[mine]
            yield give(mine[on], g[on], f[on], sid, n, owner, h)

    return texts.mapInArrow(run, schema)


def hot_shingles(texts: DataFrame, near: Near, counts: np.ndarray) -> dict[int, int]:
    """Shingles with more than ``hot`` rows in their block, and how many.  Only those are counted whose counter leaves it open;
    a row a class and partition, added up within partitions first.  The ``cut`` largest are cut; smaller ones beyond that, if there
    are any, stay whole in one task."""
    if not (counts > near.hot).any():
        return {}

    def give(owner, h, f, sid, n, *_) -> pa.RecordBatch:
        key, many = np.unique(h[f > near.hot], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(many)], names=["key", "n"])

    sums = _prefixes(texts, near, counts, "key long, n long", give).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > near.hot)
    return {r.key: r.n for r in sums.orderBy(F.desc("n"), "key").limit(near.cut).collect()}


def blocks(texts: DataFrame, near: Near, counts: np.ndarray) -> DataFrame:
    """(block, sid, w0, w1, ...) of each class and block; a partition gives out the rows of a class once."""
    names = ["block", "sid", *(f"w{i}" for i in range(WORDS))]
    hot = hot_shingles(texts, near, counts)
    keys = np.array(sorted(hot), np.int64)
    shared = texts.sparkSession.sparkContext.broadcast((keys, np.array([hot[k] for k in keys.tolist()], np.int64)))

    def give(owner, h, f, sid, n, all_owner, all_h) -> pa.RecordBatch:
        vectors = bit_vectors(all_owner, all_h, len(n))
        low = np.uint64(_SIZE + _SIDE)
        base, side = h >> low << low, np.full(len(h), WHOLE, np.uint64)
        keys, rows_of = shared.value
        if len(keys):
            at = np.minimum(np.searchsorted(keys, h.view(np.int64)), len(keys) - 1)
            tiles = np.where(keys[at] == h.view(np.int64), np.ceil(rows_of[at] / near.hot).astype(np.int64), 1)
            if (tiles > 1).any():  # a row for every pair of tiles that this text's tile is in
                rows = np.repeat(np.arange(len(h)), tiles)
                other = np.arange(len(rows)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
                own = (sid[owner].view(np.uint64) % np.maximum(tiles, 1).astype(np.uint64)).astype(np.int64)[rows]
                pair = np.minimum(own, other) * tiles[rows] + np.maximum(own, other)
                mixed = hashes(np.stack([h[rows], pair.astype(np.uint64)], 1).reshape(-1), 2)[::2]
                side = np.where(own == other, WHOLE, np.where(own < other, LEFT, RIGHT)).astype(np.uint64)
                base = np.where(tiles[rows] > 1, mixed, h[rows]) >> low << low
                side = np.where(tiles[rows] > 1, side, np.uint64(WHOLE))
                owner = owner[rows]
        block = base | side << np.uint64(_SIZE) | np.minimum(n[owner], (1 << _SIZE) - 1).astype(np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(block.view(np.int64)), pa.array(sid[owner]), *(pa.array(np.ascontiguousarray(vectors[owner, i])) for i in range(WORDS))], names=names)

    return _prefixes(texts, near, counts, ", ".join(f"{c} long" for c in names), give)


def close_pairs(base: np.ndarray, side: np.ndarray, n: np.ndarray, words: np.ndarray, near: Near) -> np.ndarray:
    """Pairs of rows within a block whose sizes and bit counts allow the similarity; rows sorted by block and size.

    Blocks of up to a tile go together, one diagonal at a time; larger blocks tile by tile.
    """
    t, cap = near.similarity, (1 << _SIZE) - 1
    slack = (1 - t) / (1 + t)

    def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        bits = np.zeros(len(i), np.int64)
        for w in range(words.shape[1]):
            bits += np.bitwise_count(words[i, w] ^ words[j, w])
        ok = (bits <= slack * (n[i] + n[j]) + 1e-9) | (n[j] >= cap)
        return ok & (((side[i] == WHOLE) & (side[j] == WHOLE)) | (side[i] + side[j] == LEFT + RIGHT) & (side[i] != side[j]))

    starts = np.flatnonzero(np.r_[True, base[1:] != base[:-1]]) if len(base) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(base)])
    out = [np.zeros((0, 2), np.int64)]
    small = np.repeat(sizes <= near.tile, sizes)
    ends = np.repeat(starts + sizes, sizes)
    i = np.flatnonzero(small)
    d = 1
    while len(i):
        i = i[i + d < ends[i]]
        i = i[(n[i] >= t * n[i + d] - 1e-9) | (n[i + d] >= cap)]  # sizes rise, so what fails now fails from here on
        ok = test(i, i + d)
        out.append(np.stack([i[ok], i[ok] + d], 1))
        d += 1
    for a in np.flatnonzero(sizes > near.tile):
        cuts = range(starts[a], starts[a] + sizes[a], near.tile)
        stop = starts[a] + sizes[a]
        for x in cuts:
            xs = np.arange(x, min(x + near.tile, stop))
            for y in range(x, stop, near.tile):
                if n[y] < cap and n[xs[-1]] < t * n[y] - 1e-9:
                    break  # the population counts of all further tiles differ beyond the radius
                ys = np.arange(y, min(y + near.tile, stop))
                i, j = (g.reshape(-1) for g in np.meshgrid(xs, ys, indexing="ij"))
                on = i < j
                i, j = i[on], j[on]
                ok = test(i, j) & ((n[i] >= t * n[j] - 1e-9) | (n[j] >= cap))
                out.append(np.stack([i[ok], j[ok]], 1))
    return np.concatenate(out)


def _block_pairs(cols: list[np.ndarray], near: Near) -> np.ndarray:
    """Pairs of classes within whole blocks, given as columns in order of their blocks."""
    block = cols[0].view(np.uint64)
    base, n = block >> np.uint64(_SIZE + _SIDE), (block & np.uint64((1 << _SIZE) - 1)).astype(np.int64)
    twin = np.zeros(len(base), bool)  # blocks of one row are left out first
    twin[1:] = base[1:] == base[:-1]
    twin[:-1] |= twin[1:]
    order = np.flatnonzero(twin)
    order = order[np.lexsort((cols[1][order], n[order], base[order]))]
    base, n, sid = base[order], n[order], cols[1][order]
    side = (block[order] >> np.uint64(_SIZE) & np.uint64((1 << _SIDE) - 1)).astype(np.int64)
    new = np.ones(len(base), bool)
    new[1:] = (base[1:] != base[:-1]) | (sid[1:] != sid[:-1])
    words = np.stack([c[order][new] for c in cols[2:]], 1).view(np.uint64)  # signed, numpy would count the bits of the absolute value
    base, n, sid, side = base[new], n[new], sid[new], side[new]
    pairs = sid[close_pairs(base, side, n, words, near)]
    return np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)


def candidates(rows: DataFrame, near: Near, at_once: int = 50_000) -> DataFrame:
    """(a, b): distinct pairs of classes that pass the bit count.

    The rows of a partition come in order of their blocks; a task holds the rows of whole blocks, ``at_once`` of them or one block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def give(cols: list[np.ndarray]) -> pa.RecordBatch:
            pairs = _block_pairs(cols, near)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"])

        for b in batches:
            held.append([b.column(i).to_numpy() for i in range(2 + WORDS)])
            if sum(len(c[0]) for c in held) < at_once:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            base = cols[0].view(np.uint64) >> np.uint64(_SIZE + _SIDE)
            last = int(np.flatnonzero(base != base[-1])[-1]) + 1 if (base != base[-1]).any() else 0
            if last:
                yield give([c[:last] for c in cols])
            held = [[c[last:].copy() for c in cols]]
        if held:
            yield give([np.concatenate(x) for x in zip(*held, strict=True)])

    placed = rows.repartition(F.shiftrightunsigned("block", _SIZE + _SIDE)).sortWithinPartitions("block")
    return placed.mapInArrow(run, "a long, b long").distinct()


def similar(pairs: DataFrame, texts: DataFrame, reps: DataFrame, near: Near) -> DataFrame:
    """(a, b, similarity) of the pairs of classes whose texts reach the similarity, computed on the texts.

    ``reps`` (sid, rep) names the text that stands for a class; of several texts with that id the one of the class is taken.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for b in batches:
            sid = set_ids(*token_sets(b.column(1).to_pylist(), near, known))
            yield b.filter(pa.array(sid == b.column(0).to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, last = near.words, {}

        def shingles(text: str) -> set[tuple[str, ...]]:
            if text not in last:
                if len(last) > 2_000:
                    last.clear()
                x = TOKEN.findall(text.lower())
                last[text] = set(zip(*(x[i:] for i in range(k)), strict=False))
            return last[text]

        for b in batches:
            got = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = shingles(x), shingles(y)
                both = len(x & y)
                got.append(both / (len(x) + len(y) - both))
            got = np.array(got, np.float64)
            on = pa.array(np.flatnonzero(got >= near.similarity - 1e-12))
            yield pa.RecordBatch.from_arrays([b.column(0).take(on), b.column(1).take(on), pa.array(got).take(on)], names=["a", "b", "similarity"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(reps, "sid")
    found = texts.join(wanted.withColumnRenamed("rep", "id"), "id").select("sid", "body").mapInArrow(own, "sid long, body string")
    bodies = settle(found.dropDuplicates(["sid"]), "bodies")
    left = bodies.select(F.col("sid").alias("a"), F.col("body").alias("x"))
    right = bodies.select(F.col("sid").alias("b"), F.col("body").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, similarity double")


@dataclass(frozen=True)
class Result:
    """``members`` (id, rep, n): the class of each text, named by its smallest id; ``links`` (a, b, similarity) between classes."""

    members: DataFrame
    links: DataFrame


def near_duplicates(df: DataFrame, key: str, text: str, near: Near = Near()) -> Result:
    """Classes of texts with the same shingles and all links between classes.

    ``key`` is an integer id.  Rows with a null key or text, or with too few tokens, take no part.  If a key occurs
    again with other text, each of its texts takes part under that key.  No table: no rows.
    """
    texts = _texts(df, key, text)
    members, counts = census(texts, near)
    reps = members.groupBy("sid").agg(F.min("id").alias("rep"))
    members = settle(members.distinct().join(reps, "sid"), "members")
    reps = members.where(F.col("id") == F.col("rep")).select("sid", "rep").distinct()
    pairs = settle(candidates(blocks(texts, near, counts), near), "pairs")
    links = similar(pairs, texts, reps, near).join(reps.select(F.col("sid").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("sid").alias("b"), F.col("rep").alias("rb")), "b")
    # a key with several texts has several classes, so two of them may have one name
    links = links.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "similarity").where("a != b").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return Result(members.select("id", "rep", "n"), settle(links, "links"))


def expanded(result: Result) -> DataFrame:
    """(a, b): all pairs of texts, copies included, smaller id first."""
    m = result.members.select("id", "rep").distinct()
    left, right = m.select(F.col("id").alias("x"), F.col("rep").alias("a")), m.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = result.links.select("a", "b").join(left, "a").join(right, "b").select("x", "y")
    within = m.alias("l").join(m.alias("r"), (F.col("l.rep") == F.col("r.rep")) & (F.col("l.id") < F.col("r.id"))).select(F.col("l.id").alias("x"), F.col("r.id").alias("y"))
    return across.unionByName(within).where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(links: DataFrame, nodes: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, root): the smallest id that links lead to; alternating large and small stars, each round a written table.

    A large star hangs the larger neighbours of a node on its smallest one, a small star the node and its smaller
    neighbours; both keep the components and halve the paths, so the rounds grow with the logarithm of the longest path.
    Raises if ``rounds`` don't settle them.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        new = settle(small, "edges")
        if new.count() == edges.count() and new.exceptAll(edges).isEmpty():
            break
        edges = new
    else:
        raise RuntimeError(f"the components haven't settled in {rounds} rounds")
    return nodes.join(edges.groupBy("u").agg(F.min("v").alias("root")), nodes["id"] == F.col("u"), "left").select("id", F.coalesce("root", "id").alias("root"))


def groups(result: Result) -> DataFrame:
    """(id, class_id, group_id, n_links): one row a text: its class of equal texts, its group of near ones, and the links of its class."""
    reps = result.members.select(F.col("rep").alias("id")).distinct()
    root = components(result.links, reps)
    degree = result.links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    per_class = root.join(degree, "id", "left").select(F.col("id").alias("rep"), F.col("root").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return result.members.select("id", "rep").distinct().join(per_class, "rep").select("id", F.col("rep").alias("class_id"), "group_id", "n_links")
