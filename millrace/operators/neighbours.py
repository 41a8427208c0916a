"""Exact nearest rows among rows with gaps, without comparing all with all.

A tree of boxes cuts the rows at medians of the column that is widest where it cuts. For
a row that asks, the boxes on its own way down say how far its k-th nearest row can be at
most, and only boxes that reach into this distance are searched. Groups of about GROUP rows
are what a task holds; inside, a smaller tree does the same. The tree comes from a sample, the
boxes' ends from all rows, so the answers are exact whatever the sample was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.scratch import Scratch

#: Rows of a group, of the boxes that bound distances between groups, and of a box inside a group; asking rows a task holds.
GROUP = 65_536
BOX = 8192
LEAF = 512
ASKED = 65_536
#: Rows of the sample for each box; trees at most; distances computed at once.
SAMPLED = 64
TREES = 8
BLOCK = 1 << 20


class Tree:
    """Boxes over rows of numbers (missing: NaN). A node has three ways: below its cut, from it on, and without a value."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, leaf: int, group: int, others: bool = False) -> None:
        """Cut by columns, and with others by any column where those are all alike."""
        self.column: list[int] = []
        self.cut: list[float] = []
        self.ways: list[list[int]] = []
        self.top: list[int] = []  # the node that is this node's group, or -1 above the groups
        self.members: dict[int, np.ndarray] = {}
        todo = [(self._node(-1), np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            if self.top[node] < 0 and len(own) <= group:
                self.top[node] = node
            at = self._widest(rows[own], columns) if len(own) > leaf else None
            if at is None and others and len(own) > leaf:
                at = self._widest(rows[own], np.arange(rows.shape[1]))
            if at is None:
                self.top[node] = node if self.top[node] < 0 else self.top[node]
                self.members[node] = own
                continue
            self.column[node], self.cut[node] = at
            v = rows[own, at[0]]
            for here in (v < at[1], v >= at[1], np.isnan(v)):
                self.ways[node].append(self._node(self.top[node]))
                todo.append((self.ways[node][-1], own[here]))
        self.used = np.zeros(rows.shape[1], dtype=bool)
        self.used[[c for c in self.column if c >= 0]] = True

    def _node(self, top: int) -> int:
        self.column.append(-1)
        self.cut.append(0.0)
        self.ways.append([])
        self.top.append(top)
        return len(self.top) - 1

    @staticmethod
    def _widest(rows: np.ndarray, columns: np.ndarray) -> tuple[int, float] | None:
        gone = np.isnan(rows[:, columns])
        low, high = np.where(gone, np.inf, rows[:, columns]).min(axis=0), np.where(gone, -np.inf, rows[:, columns]).max(axis=0)
        with np.errstate(invalid="ignore"):
            spread = np.where(high > low, high / 2 - low / 2, 0.0)
        if not len(columns) or not spread.max() > 0:
            return None
        best = int(spread.argmax())
        c = int(columns[best])
        v = np.sort(rows[~gone[:, best], c])
        cut = v[len(v) // 2]
        return c, float(cut if cut > v[0] else v[np.searchsorted(v, v[0], "right")])

    def locate(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, todo = np.zeros(len(x), dtype=np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            out[own] = node
            if self.ways[node]:
                v = x[own, self.column[node]]
                for way, here in zip(self.ways[node], (v < self.cut[node], v >= self.cut[node], np.isnan(v)), strict=True):
                    if here.any():
                        todo.append((way, own[here]))
        return out

    def measure(self, leaves: dict[int, tuple]) -> Tree:
        """Take rows, rows that have each column, and lowest and highest values from those of the leaves."""
        n, width = len(self.top), len(self.used)
        self.rows, self.have = np.zeros(n, dtype=np.int64), np.zeros((n, width), dtype=np.int64)
        self.low, self.high = np.full((n, width), np.inf), np.full((n, width), -np.inf)
        for leaf, (rows, have, low, high) in leaves.items():
            self.rows[leaf], self.have[leaf], self.low[leaf], self.high[leaf] = rows, have, low, high
        for node in reversed(range(n)):
            if self.ways[node]:
                ways = self.ways[node]
                self.rows[node], self.have[node] = self.rows[ways].sum(), self.have[ways].sum(axis=0)
                self.low[node], self.high[node] = self.low[ways].min(axis=0), self.high[ways].max(axis=0)
        self.some = self.have > 0
        self.every = self.some & (self.have == self.rows[:, None])
        return self

    def farthest(self, x: np.ndarray, holes: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row and hole a distance within which there are k rows that have it, and each row's own leaf."""
        out, home, todo = np.full((len(x), len(holes)), np.inf), np.zeros(len(x), dtype=np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            home[own] = node
            mine = x[own]
            enough = [i for i, h in enumerate(holes) if self.have[node, h] >= k]
            if enough and self.every[node].any():
                has, some = ~np.isnan(mine), np.flatnonzero(self.some[node])
                with np.errstate(all="ignore"):
                    apart = np.maximum(np.abs(mine[:, some] - self.low[node, some]), np.abs(mine[:, some] - self.high[node, some])) ** 2
                    apart = np.where(has[:, some], np.where(np.isnan(apart), np.inf, apart), 0.0).sum(axis=1)
                    shared = has[:, self.every[node]].sum(axis=1)
                    apart = np.where(shared > 0, apart * x.shape[1] / shared * (1 + 1e-9), np.inf)
                for i in enough:
                    out[own, i] = np.minimum(out[own, i], apart)
            if self.ways[node]:
                v, ways = mine[:, self.column[node]], self.ways[node]
                way = np.where(np.isnan(v), int(self.rows[ways].argmax()), (v >= self.cut[node]).astype(int))
                todo += [(w, own[way == i]) for i, w in enumerate(ways) if (way == i).any()]
        return out, home

    def reach(self, x: np.ndarray, bound: np.ndarray, holes: list[int], stop: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Nodes of stop, each with the rows whose bound (rows by holes; read when a node's turn comes) reaches into its box."""
        has = ~np.isnan(x)
        lack = ~has[:, holes]
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            mine, every = x[own], np.flatnonzero(self.every[node])
            with np.errstate(all="ignore"):
                gap = np.maximum(np.maximum(self.low[node, every] - mine[:, every], mine[:, every] - self.high[node, every]), 0.0)
                shared = has[own][:, self.some[node]].sum(axis=1)
                apart = np.where(np.isnan(gap), 0.0, gap**2).sum(axis=1) * x.shape[1] / shared * (1 - 1e-9)
            asks = lack[own] & self.some[node, holes]
            near = (np.where(asks, bound[own], -1.0) >= apart[:, None]).any(axis=1) & (shared > 0) & np.isfinite(apart)
            own = own[near]
            if not len(own):
                continue
            if stop[node]:
                yield node, own
            else:
                todo += [(way, own) for way in self.ways[node] if self.rows[way]]


def table(t: pa.Table | pa.RecordBatch, width: int) -> np.ndarray:
    """The column x as rows of numbers, null as NaN."""
    x = t.column("x")
    flat = x.flatten() if isinstance(x, pa.Array) else pa.chunked_array([c.flatten() for c in x.chunks], pa.float64())
    return np.array(flat.to_numpy() if isinstance(flat, pa.ChunkedArray) else flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float64(), from_pandas=True))


def by_value(x: np.ndarray) -> np.ndarray:
    """Order of the rows column by column, null first, as Spark sorts arrays."""
    there = ~np.isnan(x)
    filled = np.where(there, x, 0.0)
    return np.lexsort([key for c in reversed(range(x.shape[1])) for key in (filled[:, c], there[:, c])])


def search(x: np.ndarray, pool: np.ndarray, holes: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """As search_alike; rows with the same gaps are sought together, those with rare gaps all in one."""
    kinds, kind, sizes = np.unique(~np.isnan(x), axis=0, return_inverse=True, return_counts=True)
    often = np.argsort(-sizes, kind="stable")[:TREES]
    lot = np.full(len(kinds), TREES)
    lot[often] = np.arange(len(often))
    apart, place = np.full((len(x), len(holes), k), np.inf), np.full((len(x), len(holes), k), len(pool), dtype=np.int64)
    for n in np.unique(lot):
        own = np.flatnonzero(lot[kind.reshape(-1)] == n)
        apart[own], place[own] = search_alike(x[own], pool, holes, k)
    return apart, place


def search_alike(x: np.ndarray, pool: np.ndarray, holes: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and places in pool (rows by holes by k) of the nearest rows that have what a row of x lacks; inf where there are none.

    pool is sorted by value; of rows equally near, the first count.
    """
    width, has = x.shape[1], ~np.isnan(x)
    common = has.all(axis=0)
    tree = Tree(pool, np.flatnonzero(common), LEAF, LEAF, others=True)
    there = ~np.isnan(pool)
    low, high = np.where(there, pool, np.inf), np.where(there, pool, -np.inf)
    tree.measure({leaf: (len(own), there[own].sum(axis=0), low[own].min(axis=0), high[own].max(axis=0)) for leaf, own in tree.members.items() if len(own)})
    bound, home = tree.farthest(x, holes, k)
    apart, place = np.full((len(x), len(holes), k), np.inf), np.full((len(x), len(holes), k), len(pool), dtype=np.int64)
    filled, asked, lack = np.where(there, pool, 0.0), np.where(has, x, 0.0), ~has

    def compare(leaf: int, own: np.ndarray) -> None:
        members = tree.members[leaf]
        step = max(1, BLOCK // len(members))
        for own in (own[i : i + step] for i in range(0, len(own), step)):
            total = np.zeros((len(own), len(members)))
            with np.errstate(all="ignore"):
                for c in range(width):
                    mine, its = has[own, c], there[members, c]
                    if mine.any() and its.any():
                        square = (asked[own, c][:, None] - filled[members, c][None, :]) ** 2
                        if not (mine.all() and its.all()):
                            square[~(mine[:, None] & its[None, :])] = 0.0
                        total += square
                total = total * width / (has[own].astype(np.float64) @ there[members].T.astype(np.float64))
            total[np.isnan(total)] = np.inf
            for i, h in enumerate(holes):
                rows, able = np.flatnonzero(lack[own, h]), np.flatnonzero(there[members, h])
                if not len(rows) or not len(able):
                    continue
                part, who = total[np.ix_(rows, able)], own[rows]
                few = min(k, len(able))
                if few <= 16:  # the first of the smallest, few times
                    found = np.empty((len(rows), few), dtype=np.int64)
                    values = np.empty((len(rows), few))
                    line = np.arange(len(rows))
                    for j in range(few):
                        found[:, j] = part.argmin(axis=1)
                        values[:, j] = part[line, found[:, j]]
                        part[line, found[:, j]] = np.inf
                else:
                    found = part.argsort(axis=1, kind="stable")[:, :few]
                    values = np.take_along_axis(part, found, axis=1)
                d, p = np.concatenate([apart[who, i], values], axis=1), np.concatenate([place[who, i], np.where(np.isfinite(values), members[able][found], len(pool))], axis=1)
                first = np.lexsort((p, d), axis=-1)[:, :k]
                apart[who, i], place[who, i] = np.take_along_axis(d, first, axis=1), np.take_along_axis(p, first, axis=1)
                bound[who, i] = np.minimum(bound[who, i], apart[who, i, k - 1])

    order = np.argsort(home, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
        if len(own) and len(tree.members[home[own[0]]]):
            compare(home[own[0]], own)
    leaves = np.array([not ways for ways in tree.ways])
    for leaf, own in tree.reach(x, bound, holes, leaves):
        own = own[home[own] != leaf]
        if len(own):
            compare(leaf, own)
    return apart, place


def _routed(asked: DataFrame, donors: DataFrame, tree: Tree, t: int, used: np.ndarray, holes: list[int], k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows of asked that tree number t serves, (g, x, visits), once for each group they have to visit, and all donors as (g, x)."""
    width = used.shape[1]
    tree.members = {}
    top = np.array(tree.top)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.locate(table(batch, width))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(top[leaf]), batch.column("x")], names=["leaf", "g", "x"])

    located = scratch.save(donors.select("x").mapInArrow(place, "leaf long, g long, x array<double>"))
    x = [F.col("x")[c] for c in range(width)]
    ends = located.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.array(*map(F.count, x)).alias("have"), F.array(*map(F.min, x)).alias("low"), F.array(*map(F.max, x)).alias("high"))
    known = lambda values, none: [none if v is None else v for v in values]
    tree.measure({r["leaf"]: (r["n"], r["have"], known(r["low"], np.inf), known(r["high"], -np.inf)) for r in ends.collect()})
    stop = top == np.arange(len(top))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = table(batch, width)
            able = ~(np.isnan(x)[:, None, :] & used[None]).any(axis=2)
            x = x[able.argmax(axis=1) == t]  # the first tree that can, or the first of all
            bound, _ = tree.farthest(x, holes, k)
            found = list(tree.reach(x, bound, holes, stop))
            visits = np.zeros(len(x), dtype=np.int32)
            for _, own in found:
                visits[own] += 1
            for g, own in found:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), g)), lists(x[own]), pa.array(visits[own])], names=["g", "x", "visits"])

    return scratch.save(asked.select("x").mapInArrow(route, "g long, x array<double>, visits int")), located.select("g", "x")


def fill(asked: DataFrame, donors: DataFrame, width: int, holes: list[int], k: int, scratch: Scratch) -> DataFrame:
    """(x, h, v): the mean of column h in the k nearest rows of donors, for each column h of holes that a row of asked lacks.

    Both have x, an array of numbers, and are saved tables; rows of asked differ. Distance is
    Euclidean over what both rows have, scaled up for what they lack. Of rows equally
    near, the first by value count.
    """
    n = donors.count()
    if n <= GROUP:
        parts = [(asked.select(F.lit(0).cast("long").alias("g"), "x", F.lit(1).alias("visits")), donors.select(F.lit(0).cast("long").alias("g"), "x"))]
    else:
        boxes = -(-n // BOX)
        sample = table(donors.sample(min(1.0, boxes * SAMPLED / n), 7).select("x").toArrow(), width)
        per_row = len(sample) / n
        masks = asked.groupBy(F.transform("x", lambda v: v.isNotNull()).alias("has")).count().orderBy(F.desc("count"), "has").limit(4096).collect()
        left = [np.array(m["has"], dtype=bool) for m in masks if any(m["has"])]
        trees: list[Tree] = []
        while left and len(trees) < TREES:  # a tree serves rows that have all columns where it cuts
            trees.append(Tree(sample, np.flatnonzero(left[0]), int(BOX * per_row), int(GROUP * per_row)))
            left = [m for m in left if (trees[-1].used & ~m).any()]
        parts = []
        for t, tree in enumerate(trees):
            parts.append(_routed(asked, donors, tree, t, np.array([x.used for x in trees]), holes, k, scratch))

    def nearest(asked: pa.Table, given: pa.Table) -> pa.Table:
        xs, hs, aparts, donors_, vs = [np.zeros((0, width))], [], [], [np.zeros((0, width))], []
        if asked.num_rows and given.num_rows:
            x, pool, final = table(asked, width), table(given, width), asked.column("final").to_numpy()
            pool = pool[by_value(pool)]
            apart, place = search(x, pool, holes, k)
            for i, h in enumerate(holes):
                ok = np.isfinite(apart[:, i])
                v = np.where(ok, pool[np.minimum(place[:, i], len(pool) - 1), h], 0.0)
                total = np.zeros(len(x))
                for j in range(k):
                    total += v[:, j]
                done = np.flatnonzero(final & ok.any(axis=1))  # nothing else to compare with: the mean
                xs.append(x[done])
                hs.append(np.full(len(done), h))
                aparts.append(np.zeros(len(done)))
                donors_.append(np.zeros((len(done), width)))
                vs.append(total[done] / ok[done].sum(axis=1))
                row, j = np.nonzero(ok & ~final[:, None])
                xs.append(x[row])
                hs.append(np.full(len(row), h))
                aparts.append(apart[row, i, j])
                donors_.append(pool[place[row, i, j]])
                vs.append(v[row, j])
        flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return pa.table({"x": lists(np.concatenate(xs)), "h": flat([h.astype(np.int32) for h in hs], pa.int32()) if hs else pa.array([], pa.int32()), "apart": flat(aparts, pa.float64()), "donor": lists(np.concatenate(donors_)), "v": flat(vs, pa.float64())})

    found = None
    for routed, located in parts:
        # a group too large, or asked by too many, is dealt out to several tasks
        held = located.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * GROUP)).alias("down")).join(routed.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(ASKED)).alias("across")), "g")
        held = F.broadcast(scratch.save(held))
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        a = routed.join(held, "g").select("g", upto("down").alias("d"), F.pmod(F.xxhash64("x", F.lit(1)), F.col("across")).alias("r"), "x", ((F.col("visits") == 1) & (F.col("down") == 1)).alias("final"))
        b = located.join(held, "g").select("g", F.pmod(F.xxhash64("x"), F.col("down")).alias("d"), upto("across").alias("r"), "x")
        part = a.groupBy("g", "d", "r").cogroup(b.groupBy("g", "d", "r")).applyInArrow(nearest, "x array<double>, h int, apart double, donor array<double>, v double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return donors.limit(0).select("x", F.lit(0).alias("h"), F.lit(0.0).alias("v"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("apart", "donor", "v"))), 1, k)  # at most k rows of each group
    return found.groupBy("x", "h").agg(best.alias("best")).select("x", "h", (F.aggregate("best", F.lit(0.0), lambda a, b: a + b["v"]) / F.size("best")).alias("v"))
