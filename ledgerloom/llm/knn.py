"""The most similar vectors of every vector, by navigable small-world graphs.

The collection is cut into shards of similar vectors: spherical k-means in two levels, whose centres grow in number with
the collection.  Every shard holds one hierarchical graph as flat arrays: a level is a matrix of neighbour positions, and its
rows are inserted in batches, each searching the graph that is there, choosing neighbours for closeness and for spread, and
being entered in theirs.  Every vector descends the graph of its own shard, and of those whose centre is nearly as close,
and the shards' answers are merged.  Nothing is compared with a whole shard.

The more shards there are, the less a centre tells where a vector's neighbours are.  So an answer counts both ways, and vectors go
on, in ``rounds``, to the shards that are home to their neighbours and to the neighbours of these, where they haven't been yet.
The graphs are kept for that, a tenth of their vectors in size.

Vectors travel as 16-bit integers with one scale each (an error near 1e-5 of a similarity).  Of vectors that are the same
bit for bit the first enters a graph; the copies answer each other and take part in its answers.

Bounds: the driver holds ``groups_on`` sampled vectors and one centre a shard, ``shards`` of them at most (50 MB).  Up to
``shard`` * ``shards`` = 1.3e8 vectors shards have some ``shard`` vectors; beyond that they grow, a graph's cost with n log n and
its memory with n, so that 4e9 vectors make shards of 60,000 (250 MB).
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.storage import settle, spread


@dataclass(frozen=True)
class Graphs:
    """``k`` neighbours; ``dim`` the length of a usable vector; ``shard`` vectors a graph on average, ``shards`` graphs at most.

    Groups of centres are fitted on ``groups_on`` vectors, the centres of a group on ``points`` sampled ones each.  A vector visits
    the ``probes`` nearest shards whose centre is within ``margin`` of its own.  A row of a graph has ``degree`` neighbours that
    it chose and as many that chose it; ``build`` and ``beam`` rows are followed on inserting and on asking.  In each of ``rounds`` a
vector goes on to ``onward`` shards, those first that are home to most of its neighbours.
    """

    k: int = 5
    dim: int = 384
    shard: int = 2048
    shards: int = 65_536
    groups_on: int = 4096
    points: int = 32
    probes: int = 3
    margin: float = 0.25
    degree: int = 16
    build: int = 32
    beam: int = 32
    fan: int = 16
    batch: int = 512
    rounds: int = 2
    onward: int = 3
    resent: int = 200_000


def encode(rows: np.ndarray) -> np.ndarray:
    """Unit vectors as 16-bit integers; only the direction matters, so the scale needn't be kept."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return np.rint(rows * 32_767).astype(np.int16)


def decode(codes: np.ndarray) -> np.ndarray:
    out = codes.astype(np.float32)
    return out / np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]


def _matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    raw = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    buf = np.frombuffer(raw.buffers()[2], dtype)
    first = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset] // np.dtype(dtype).itemsize
    return buf[first : first + len(raw) * width].reshape(len(raw), width)


def usable(df: DataFrame, row_id: str, item: str, vector: str, stamp: str, graphs: Graphs = Graphs()) -> DataFrame:
    """(item, code, same): usable vectors, one for each row id, encoded.

    A vector is usable if it has ``dim`` finite elements, not all of them zero.  Of several usable ones with one id
    the last ingested counts, a null stamp being the oldest; of those the largest code; of identical rows, as a repeated
    batch leaves them, any one.  Null ids or items are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            fit = np.flatnonzero(np.equal(pa.compute.fill_null(pa.compute.list_value_length(lists), -1).to_numpy(zero_copy_only=False), graphs.dim))
            rows = pa.compute.list_flatten(lists.take(pa.array(fit)))
            rows = rows.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, graphs.dim)  # null elements become NaN
            good = np.isfinite(rows).all(1) & (rows != 0).any(1)
            codes = encode(rows[good])
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(fit[good])) for i in range(3)), pa.array([x.tobytes() for x in codes], pa.binary())], names=["item", "row_id", "stamp", "code"])

    rows = df.where(F.col(row_id).isNotNull() & F.col(item).isNotNull() & F.col(vector).isNotNull())
    rows = rows.select(F.col(item).cast("long").alias("item"), F.col(row_id).cast("string").alias("row_id"), F.col(stamp).cast("string").alias("stamp"), F.col(vector).alias("v"))
    coded = settle(spread(rows).mapInArrow(run, "item long, row_id string, stamp string, code binary").withColumns({"same": F.xxhash64("code"), "copy": F.monotonically_increasing_id()}), "codes")
    # written once, so ``copy`` stays the same and tells identical rows apart
    version = F.struct(F.coalesce("stamp", F.lit("")).alias("s"), F.col("same"), F.col("item"), F.col("copy"))
    last = settle(coded.groupBy("row_id").agg(F.max(version).alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("row_id", "last"), "resent")
    # few ids come again: while they are, their list goes to the codes, beyond that the codes are joined with it
    few = last.count() <= graphs.resent
    rows = coded.join(F.broadcast(last) if few else last, "row_id", "left").where(F.col("last").isNull() | (F.col("last") == version)).select("item", "code", "same")
    return rows if few else settle(rows, "vectors")


def centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of spherical k-means; starts from evenly spaced rows, so dense regions get more of them."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (sample @ c.T).argmax(1)
        order = np.argsort(near, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0])
        sums = np.add.reduceat(sample[order], at, axis=0)
        c[near[order][at]] = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-9)[:, None]
    return c


class Graph:
    """A hierarchical small-world graph over the rows of ``x``, as flat arrays.

    Rows are kept in the order of their insertion, so a level is a prefix of them; ``levels`` has its neighbours, from the top
    down, ``degree`` chosen ones and ``degree`` that chose the row, -1 where there are fewer.  A level holds one in ``fan`` of the
    one below; the rows of the topmost, a few dozen, are all looked at.
    """

    def __init__(self, x: np.ndarray, graphs: Graphs, rng: np.random.Generator):
        self.order = rng.permutation(len(x))
        self.x, self.graphs, self.levels = x[self.order], graphs, []
        size, sizes = len(x), []
        while True:
            sizes.append(size)
            if size <= 4 * graphs.fan:
                break
            size = math.ceil(size / graphs.fan)
        for size in reversed(sizes):
            self.levels.append(self._level(size))

    def kept(self, names: np.ndarray) -> bytes:
        """The graph without its vectors, and the names of these in the order they were given in."""
        out, small = io.BytesIO(), np.uint16 if len(self.x) < 65_535 else np.int32
        np.savez(out, names=names, order=self.order.astype(np.int32), **{f"level{i}": (x + 1).astype(small) for i, x in enumerate(self.levels)})
        return out.getvalue()

    @classmethod
    def again(cls, kept: bytes, names: np.ndarray, x: np.ndarray, graphs: Graphs) -> Graph | None:
        """A graph that was kept, with its vectors; None if it is one of others."""
        with np.load(io.BytesIO(kept)) as f:
            if not np.array_equal(f["names"], names):
                return None
            graph = cls.__new__(cls)
            graph.order = f["order"].astype(np.int64)
            graph.x, graph.graphs = x[graph.order], graphs
            graph.levels = [f[f"level{i}"].astype(np.int32) - 1 for i in range(len(f.files) - 2)]
        return graph

    def _level(self, size: int) -> np.ndarray:
        g = self.graphs
        links, sims = np.full((size, 2 * g.degree), -1, np.int32), np.full((size, 2 * g.degree), -3, np.float32)
        done = 0
        while done < size:
            # the rows of the level above come first: they are where a descent enters
            above = len(self.levels[-1]) if self.levels else size
            stop = min(size, above if not done else done + min(done, g.batch))
            for lo in range(done, stop, g.batch):
                hi = min(stop, lo + g.batch)
                q = self.x[lo:hi]
                mates = q @ q.T  # rows of one batch don't find each other by search
                np.fill_diagonal(mates, -3)
                ids = np.broadcast_to(np.arange(lo, hi), mates.shape)
                if lo:
                    entry = self._enter(q) if done else (np.zeros((len(q), 1), np.int64), (q @ self.x[0])[:, None])
                    got = self._beam(q, links[:lo], *entry, g.build)
                    ids, mates = np.concatenate([got[0], ids], 1), np.concatenate([got[1], mates], 1)
                wide = min(g.build, ids.shape[1])
                top = np.argpartition(-mates, wide - 1, axis=1)[:, :wide]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(mates, top, 1), axis=1, kind="stable"), 1)
                self._connect(links, sims, lo, np.take_along_axis(ids, top, 1), np.take_along_axis(mates, top, 1))
            done = stop
        return links

    def _connect(self, links: np.ndarray, sims: np.ndarray, lo: int, ids: np.ndarray, near: np.ndarray) -> None:
        """Enters the neighbours of the rows from ``lo`` on, chosen from candidates by falling similarity, and these rows in theirs."""
        m = self.graphs.degree
        ids, near = self._spread(ids, near)
        ids = np.where(near > -2, ids, -1)
        links[lo : lo + len(ids), : ids.shape[1]], sims[lo : lo + len(ids), : ids.shape[1]] = ids, near
        r, c = np.nonzero(ids >= 0)
        to, of, s = ids[r, c], lo + r, near[r, c]
        order = np.lexsort((-s, to))
        to, of, s = to[order], of[order], s[order]
        rows, first, count = np.unique(to, return_index=True, return_counts=True)
        rank = np.arange(len(to)) - np.repeat(first, count)
        on = rank < m
        which = np.repeat(np.arange(len(rows)), count)[on]
        more, more_s = np.full((len(rows), m), -1, np.int32), np.full((len(rows), m), -3, np.float32)
        more[which, rank[on]], more_s[which, rank[on]] = of[on], s[on]
        all_i, all_s = np.concatenate([links[rows, m:], more], 1), np.concatenate([sims[rows, m:], more_s], 1)
        best = np.argsort(-all_s, axis=1, kind="stable")[:, :m]
        links[rows, m:], sims[rows, m:] = np.take_along_axis(all_i, best, 1), np.take_along_axis(all_s, best, 1)

    def _spread(self, ids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``degree`` of the candidates: half by similarity, then those that are closer to the row than to the last one chosen, while there are."""
        m = self.graphs.degree
        half = (m + 1) // 2
        if ids.shape[1] <= m or m < 4:
            return ids[:, :m], near[:, :m]
        rest, rest_s = ids[:, half:], near[:, half:]
        away = np.einsum("nd,nkd->nk", self.x[ids[:, half - 1]], self.x[rest]) < rest_s
        order = np.argsort(~away, axis=1, kind="stable")[:, : m - half]
        return np.concatenate([ids[:, :half], np.take_along_axis(rest, order, 1)], 1), np.concatenate([near[:, :half], np.take_along_axis(rest_s, order, 1)], 1)

    def search(self, q: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, similarities) of the ``k`` best found for each query, -1 where there are fewer; queries descend together.

        ``own`` are the rows of the queries themselves, which are no answers; rows as in the ``x`` that was given.
        """
        g = self.graphs
        found = np.full((len(q), g.k), -1, np.int64), np.full((len(q), g.k), -2, np.float32)
        for a in range(0, len(q), g.batch):
            part = q[a : a + g.batch]
            i, s = self._beam(part, self.levels[-1], *self._enter(part), g.beam) if len(self.levels) > 1 else self._all(part)
            i = self.order[i]
            if own is not None:
                s = np.where(i == own[a : a + g.batch, None], -3, s)
                o = np.argsort(-s, axis=1, kind="stable")
                i, s = np.take_along_axis(i, o, 1), np.take_along_axis(s, o, 1)
            kk = min(g.k, i.shape[1])
            found[0][a : a + g.batch, :kk], found[1][a : a + g.batch, :kk] = np.where(s[:, :kk] > -2, i[:, :kk], -1), s[:, :kk]
        return found

    def _all(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the topmost level, best first."""
        s = q @ self.x[: len(self.levels[0])].T
        o = np.argsort(-s, axis=1, kind="stable")[:, : self.graphs.beam]
        return o, np.take_along_axis(s, o, 1)

    def _enter(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the descent of each query through the levels that are linked, but for the last one asked, arrives."""
        ids, sims = self._all(q)
        above = self.levels[1:] if len(self.levels[-1]) < len(self.x) else self.levels[1:-1]
        for links in above:
            ids, sims = self._beam(q, links, ids[:, :8], sims[:, :8], 8)
        return ids[:, :8], sims[:, :8]

    def _beam(self, q: np.ndarray, links: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """A beam search of all queries in lockstep: each expands its best few rows that aren't expanded, until none is left in its beam."""
        n, lead = len(q), 4
        seen = np.zeros((n, len(links)), bool)
        np.put_along_axis(seen, ids, True, 1)
        fill = max(0, width - ids.shape[1])
        pos = np.concatenate([ids, np.zeros((n, fill), np.int64)], 1)[:, :width].astype(np.int64)
        sims = np.concatenate([sims, np.full((n, fill), -3, np.float32)], 1)[:, :width]
        done = sims < -2
        active = np.arange(n)
        while len(active):
            first = np.argsort(done[active], axis=1, kind="stable")[:, :lead]
            live = ~np.take_along_axis(done[active], first, 1)
            on = live[:, 0]
            active, first, live = active[on], first[on], live[on]
            if not len(active):
                break
            np.put_along_axis(done_rows := done[active], first, True, 1)
            new = np.where(live[:, :, None], links[pos[active[:, None], first]], -1).reshape(len(active), -1)
            r, c = np.nonzero((new >= 0) & ~seen[active[:, None], np.maximum(new, 0)])
            flat = np.unique(r * np.int64(len(links)) + new[r, c])
            r, p = flat // len(links), flat % len(links)
            seen[active[r], p] = True
            count = np.bincount(r, minlength=len(active))
            most = int(count.max(initial=0))
            if most:
                slot = np.arange(len(r)) - (np.cumsum(count) - count)[r]
                more_p, more_s = np.zeros((len(active), most), np.int64), np.full((len(active), most), -3, np.float32)
                more_p[r, slot], more_s[r, slot] = p, np.einsum("ij,ij->i", q[active[r]], self.x[p])
                all_p, all_s = np.concatenate([pos[active], more_p], 1), np.concatenate([sims[active], more_s], 1)
                all_d = np.concatenate([done_rows, more_s < -2], 1)
                o = np.argsort(-all_s, axis=1, kind="stable")[:, :width]
                pos[active], sims[active], done[active] = np.take_along_axis(all_p, o, 1), np.take_along_axis(all_s, o, 1), np.take_along_axis(all_d, o, 1)
            else:
                done[active] = done_rows
        return pos, sims


@dataclass(frozen=True)
class Cells:
    """``groups`` of centres, the ``centre`` of each shard by group, where each group's ``first`` is, and how many ``parts`` a shard has."""

    groups: np.ndarray
    centre: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    def near(self, x: np.ndarray, most: int, look: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """(cells, similarities) of the ``most`` centres nearest to each row, among those of its ``look`` nearest groups."""
        s = x @ self.groups.T
        look = min(look, s.shape[1])
        near = np.argpartition(-s, look - 1, axis=1)[:, :look]
        rows = np.repeat(np.arange(len(x)), look)
        order = np.argsort(near.reshape(-1), kind="stable")
        rows, group = rows[order], near.reshape(-1)[order]
        at, best = np.zeros((len(x), most), np.int64), np.full((len(x), most), -3, np.float32)
        for g, (a, b) in enumerate(zip(np.searchsorted(group, np.arange(len(self.groups))), np.searchsorted(group, np.arange(len(self.groups)), "right"), strict=True)):
            lo, hi = self.first[g], self.first[g + 1]
            if a == b or lo == hi:
                continue
            r = rows[a:b]
            got = x[r] @ self.centre[lo:hi].T
            top = np.argsort(-got, axis=1, kind="stable")[:, :most]
            all_i, all_s = np.concatenate([at[r], lo + top], 1), np.concatenate([best[r], np.take_along_axis(got, top, 1)], 1)
            o = np.argsort(-all_s, axis=1, kind="stable")[:, :most]
            at[r], best[r] = np.take_along_axis(all_i, o, 1), np.take_along_axis(all_s, o, 1)
        return at, best


def fit_cells(vectors: DataFrame, n: int, graphs: Graphs) -> Cells:
    """Centres of ``n`` / ``shard`` shards: groups on the driver, on a sample of fixed size; the centres of each group where its sample is."""
    spark, dim = vectors.sparkSession, graphs.dim
    cells = max(1, min(graphs.shards, math.ceil(n / graphs.shard)))
    rows = vectors.select("item", "code", F.pmod(F.xxhash64("item"), F.lit(1 << 40)).alias("h"))

    def sampled(many: int) -> DataFrame:
        return rows.where(F.col("h") < min(1 << 40, int((1 << 40) * many / max(n, 1))))

    few = sampled(graphs.groups_on).select("item", "code").toPandas().sort_values("item", kind="stable")
    few = decode(np.frombuffer(b"".join(few["code"]), np.int16).reshape(-1, dim)) if len(few) else np.zeros((0, dim), np.float32)
    if not len(few):
        return Cells(np.ones((1, dim), np.float32), np.ones((1, dim), np.float32), np.array([0, 1]), np.ones(1, np.int64))
    groups = centres(few, min(math.ceil(math.sqrt(cells)), len(few)))
    many = min(n, max(4 * graphs.groups_on, graphs.points * cells))
    shared = spark.sparkContext.broadcast(groups)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = (decode(_matrix(b.column(1), np.int16, dim)) @ shared.value.T).argmax(1) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), b.column(0), b.column(1)], names=["grp", "item", "code"])

    def divide(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("item").to_numpy(), kind="stable")
        x = decode(_matrix(table.column("code").combine_chunks(), np.int16, dim)[order])
        c = centres(x, max(1, min(len(x), round(cells * len(x) / many))))
        share = np.bincount((x @ c.T).argmax(1), minlength=len(c))
        return pa.table({"grp": pa.array([table.column("grp")[0].as_py()] * len(c), pa.int32()), "share": share, "centre": pa.array([r.tobytes() for r in c.astype(np.float16)], pa.binary())})

    placed = sampled(many).select("item", "code").mapInArrow(place, "grp int, item long, code binary")
    found = sorted(placed.groupBy("grp").applyInArrow(divide, "grp int, share long, centre binary").collect(), key=lambda r: (r.grp, r.centre))
    centre = np.frombuffer(b"".join(r.centre for r in found), np.float16).reshape(-1, dim)
    share = np.array([r.share for r in found]) * n / max(1, sum(r.share for r in found))
    # a cell that the sample shows to be far too large is several shards; all of them are visited
    parts = np.maximum(1, np.ceil(share / (8 * n / len(found)))).astype(np.int64)
    return Cells(groups, centre, np.searchsorted([r.grp for r in found], np.arange(len(groups) + 1)), parts)


def _route(vectors: DataFrame, cells: Cells, graphs: Graphs) -> DataFrame:
    """(shard, own, item, code): each vector in its own shard and as a visitor in those it may have neighbours in."""
    shared = vectors.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        c = Cells(c.groups, c.centre.astype(np.float32), c.first, c.parts)
        offset = np.cumsum(c.parts) - c.parts
        for b in batches:
            if not b.num_rows:
                continue
            cell, s = c.near(decode(_matrix(b.column(1), np.int16, graphs.dim)), graphs.probes)
            item = b.column(0).to_numpy()
            own = offset[cell[:, 0]] + item % c.parts[cell[:, 0]]
            row, rank = np.nonzero((s >= s[:, :1] - graphs.margin) & (s > -2))
            cell = cell[row, rank]
            copies = c.parts[cell]
            row2 = np.repeat(row, copies)
            part = np.arange(len(row2)) - np.repeat(np.cumsum(copies) - copies, copies)
            take = pa.array(row2)
            yield pa.RecordBatch.from_arrays([pa.array((np.repeat(offset[cell], copies) + part).astype(np.int32)), pa.array(own[row2].astype(np.int32)), b.column(0).take(take), b.column(1).take(take)], names=["shard", "own", "item", "code"])

    # a task for each shard or so, however many bytes they have
    return vectors.select("item", "code").mapInArrow(run, "shard int, own int, item long, code binary").repartitionById(int(cells.parts.sum()), F.col("shard"))


def _onward(vectors: DataFrame, wanted: DataFrame, kept: DataFrame, cells: Cells, graphs: Graphs) -> DataFrame | None:
    """(shard, own, item, code): vectors in the further shards they want, with the vectors of these shards, and, where ``item`` is null, their graphs."""
    busy = np.array(sorted(r[0] for r in wanted.select(F.explode("visits")).distinct().collect()), np.int32)
    if not len(busy):
        return None
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((cells, busy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, busy = shared.value
        c = Cells(c.groups, c.centre.astype(np.float32), c.first, c.parts)
        offset = np.cumsum(c.parts) - c.parts
        for b in batches:
            if not b.num_rows:
                continue
            cell = c.near(decode(_matrix(b.column(1), np.int16, graphs.dim)), graphs.probes)[0][:, 0]
            own = offset[cell] + b.column(0).to_numpy() % c.parts[cell]
            home = np.flatnonzero(np.isin(own, busy))
            visits = pa.compute.list_flatten(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int32)
            guest = np.repeat(np.arange(b.num_rows), pa.compute.fill_null(pa.compute.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False))
            row = np.r_[home, guest]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[own[home], visits].astype(np.int32)), pa.array(own[row].astype(np.int32)), b.column(0).take(take), b.column(1).take(take)], names=["shard", "own", "item", "code"])

    rows = vectors.select("item", "code").join(wanted.hint("shuffle_hash"), "item", "left").select("item", "code", "visits")
    rows = rows.mapInArrow(run, "shard int, own int, item long, code binary")
    graph = kept.join(F.broadcast(wanted.select(F.explode("visits").alias("shard")).distinct()), "shard", "left_semi")
    return rows.unionByName(graph.select("shard", F.lit(None).cast("int").alias("own"), F.lit(None).cast("long").alias("item"), F.col("graph").alias("code"))).repartitionById(int(cells.parts.sum()), F.col("shard"))


def _answers(routed: DataFrame, graphs: Graphs) -> DataFrame:
    """(item, other, similarity, own, at, graph): the best of one shard, ``at``, for each of its vectors and visitors, whose shard is ``own``.

    A graph that is built here comes out as a row without an item; where one comes in, only visitors ask.
    """

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        kept = table.filter(pa.compute.is_null(table.column("item"))).column("code").to_pylist()
        table = table.filter(pa.compute.is_valid(table.column("item"))).combine_chunks()
        item, own = table.column("item").to_numpy(), table.column("own").to_numpy()
        home = own == shard
        order = np.lexsort((item, ~home))
        item, own, home = item[order], own[order], home[order]
        x = decode(_matrix(table.column("code").combine_chunks(), np.int16, graphs.dim)[order]) if len(item) else np.zeros((0, graphs.dim), np.float32)
        n = int(home.sum())
        out, built = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int32))], []
        if n:
            graph = Graph.again(kept[0], item[:n], x[:n], graphs) if kept else None
            if graph is None:
                graph = Graph(x[:n], graphs, np.random.default_rng(shard))
            asked = [(n, graph.search(x[n:]))]
            if not kept:
                asked.append((0, graph.search(x[:n], np.arange(n))))
                built.append(graph.kept(item[:n]))
            for first, (at, sims) in asked:
                r, c = np.nonzero(at >= 0)
                out.append((item[first + r], item[at[r, c]], sims[r, c], own[first + r]))
        a, b, s, o = (np.concatenate(x) for x in zip(*out, strict=True))
        none = [None] * len(built)
        return pa.table({
            "item": pa.concat_arrays([pa.array(a), pa.array(none, pa.int64())]), "other": pa.concat_arrays([pa.array(b), pa.array(none, pa.int64())]),
            "similarity": pa.concat_arrays([pa.array(np.round(s.astype(np.float64), 6)), pa.array(none, pa.float64())]), "own": pa.concat_arrays([pa.array(o.astype(np.int32)), pa.array(none, pa.int32())]),
            "at": pa.array([shard] * (len(a) + len(built)), pa.int32()), "graph": pa.concat_arrays([pa.nulls(len(a), pa.binary()), pa.array(built, pa.binary())]),
        })

    return routed.groupBy("shard").applyInArrow(run, "item long, other long, similarity double, own int, at int, graph binary")


def _best(answers: DataFrame, k: int) -> DataFrame:
    """The ``k`` best answers of every item; ties to the smaller other."""
    rest = [c for c in answers.columns if c not in ("item", "other")]
    once = answers.repartition("item").groupBy("item", "other").agg(*(F.max(c).alias(c) for c in rest))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("similarity"), "other"))).where(F.col("rank") <= k)


def _both(answers: DataFrame, k: int) -> DataFrame:
    """The best answers when each counts both ways."""
    best = _best(answers, k).drop("rank")
    back = best.select(F.col("other").alias("item"), F.col("item").alias("other"), "similarity", F.col("at").alias("own"), F.col("own").alias("at"))
    return _best(best.unionByName(back), k).drop("rank")


def _wanted(best: DataFrame, seen: DataFrame, graphs: Graphs) -> DataFrame:
    """(item, visits): the shards that are home to neighbours, or to neighbours of these, and that the item hasn't seen."""
    homes = best.groupBy("item").agg(F.collect_list("at").alias("homes"))
    around = best.select("item", "other").join(homes.withColumnRenamed("item", "other"), "other").groupBy("item").agg(F.flatten(F.collect_list("homes")).alias("around"))
    rows = homes.join(around, "item", "left").join(seen, "item", "left")
    rows = rows.select("item", F.concat("homes", F.coalesce("around", F.array().cast("array<int>"))).alias("all"), F.coalesce("seen", F.array().cast("array<int>")).alias("seen"))
    rows = rows.withColumn("new", F.array_except("all", "seen")).where(F.size("new") > 0)
    ranked = F.sort_array(F.transform("new", lambda s: F.struct((-F.size(F.filter("all", lambda x: x == s))).alias("n"), s.alias("s"))))
    return rows.select("item", F.slice(F.transform(ranked, lambda x: x["s"]), 1, graphs.onward).alias("visits"))


def _search(vectors: DataFrame, cells: Cells, graphs: Graphs) -> DataFrame:
    """(item, other, similarity): the best found by all the shards that a vector visits."""
    found = settle(_answers(_route(vectors, cells, graphs), graphs), "found")
    kept = found.where(F.col("graph").isNotNull()).select(F.col("at").alias("shard"), "graph")
    answers = found.where(F.col("graph").isNull()).drop("graph")
    if int(cells.parts.sum()) == 1:
        return answers.select("item", "other", "similarity")
    seen, best = answers.select("item", "at", "own"), settle(_both(answers, graphs.k), "best")
    for _ in range(graphs.rounds):
        been = seen.groupBy("item").agg(F.array_union(F.collect_set("at"), F.collect_set("own")).alias("seen"))
        wanted = settle(_wanted(best, been, graphs), "wanted")
        routed = _onward(vectors, wanted, kept, cells, graphs)
        if routed is None:
            break
        more = settle(_answers(routed, graphs), "more").where(F.col("graph").isNull()).drop("graph")
        seen, best = seen.unionByName(more.select("item", "at", "own")), settle(_both(best.unionByName(more), graphs.k), "best")
    return best.select("item", "other", "similarity")


def nearest(df: DataFrame, row_id: str, item: str, vector: str, stamp: str, graphs: Graphs = Graphs()) -> DataFrame:
    """(item, other, similarity, rank): the ``k`` most similar other items of every usable vector; ties to the smaller item.

    Unusable vectors (see ``usable``) neither ask nor answer; fewer than k + 1 vectors give what there is.
    """
    k = graphs.k
    vectors = usable(df, row_id, item, vector, stamp, graphs)
    n = vectors.count()
    cells = fit_cells(vectors, n, graphs)
    # of copies, the first stands for all of them
    crowds = vectors.groupBy("same").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    order = Window.partitionBy("same").orderBy("item")
    copies = settle(vectors.select("item", "same").join(crowds, "same").withColumn("r", F.row_number().over(order)).withColumn("lead", F.first("item").over(order)), "copies")
    if copies.isEmpty():
        answers = _search(vectors, cells, graphs)
    else:
        answers = _search(vectors.join(copies.where("r > 1").select("item"), "item", "left_anti"), cells, graphs)
        first, few = copies.where(F.col("r") <= k + 1), copies.where(F.col("n") <= k)
        answers = answers.join(copies.where(F.col("n") > k).select(F.col("lead").alias("item")).distinct(), "item", "left_anti")  # their copies are answer enough
        answers = answers.join(first.select(F.col("lead").alias("other"), F.col("item").alias("as_other")), "other", "left").join(few.select(F.col("lead").alias("item"), F.col("item").alias("as_item")), "item", "left")
        answers = answers.select(F.coalesce("as_item", "item").alias("item"), F.coalesce("as_other", "other").alias("other"), "similarity")
        within = copies.select("item", "same").join(first.select(F.col("item").alias("other"), "same"), "same").where("item != other").select("item", "other", F.lit(1.0).alias("similarity"))
        answers = answers.unionByName(within)
    return _best(answers.where("item != other"), k)
