"""Forests and boosted trees grown on histograms of binned columns.

A node is split from counts by (tree, node, column, bin) alone. Where these counts come from is the
caller's: `forest` and `boosted` take them from passes over a DataFrame, in which each task counts its
rows for all trees and fits at once and the tasks that merge the counts choose the splits, so that the
driver gets one split a node; `grow_forest` and `grow_boosted` also take them from arrays, for samples
of a bounded size that one task holds. All sums are of whole numbers (gradients in steps of 1/SCALE),
so both give the same trees whatever the order of the rows.

Columns are binned once, by edges that leave about equally many rows between them; a value goes left
of a cut at bin b if it is at most the edge b. Nulls and NaN go to the last bin.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import held

BINS, BOOSTING_BINS, SCALE = 64, 255, 1 << 24
#: A pass counts for so many trees at once that a task's counts stay within so many bytes.
PASS_BYTES = 256 << 20
# Leaves of a boosted tree at most, rows and curvature of a leaf at least.
MOST_LEAVES, LEAF_ROWS, LEAF_CURVATURE = 31, 20, 1e-3


@dataclass
class Tree:
    """Nodes by number, the root first: column and bin of the split (-1: a leaf), the left child (the right one follows), the value."""

    column: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, column: int, cut: int, values: tuple[float, float]) -> tuple[int, int]:
        self.column[node], self.cut[node], self.left[node] = column, cut, len(self.column)
        for v in values:
            self.column.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.value.append(v)
            self.depth.append(self.depth[node] + 1)
        return self.left[node], self.left[node] + 1

    def arrays(self, depth: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """The tree for walking, cut off at a depth: a leaf leads to itself, as no bin is above its cut."""
        own = np.array(self.depth)
        column, cut, left = np.array(self.column, np.int64), np.array(self.cut, np.int64), np.array(self.left, np.int64)
        end = column < 0 if depth is None else (column < 0) | (own >= depth)
        column[end], cut[end], left[end] = 0, 1 << 30, np.flatnonzero(end)
        deep = own.max() if depth is None else min(int(own.max()), depth)
        return column, cut, left, np.array(self.value), int(deep)


def step(bins: np.ndarray, tree: tuple, at: np.ndarray) -> np.ndarray:
    """The next node of each row of bins."""
    column, cut, left, _, _ = tree
    seen = bins.ravel().take(column.take(at) + np.arange(0, bins.size, bins.shape[1]))
    return left.take(at) + (seen > cut.take(at))


def walk(bins: np.ndarray, tree: tuple) -> np.ndarray:
    """The node that each row of bins ends in."""
    at = np.zeros(len(bins), np.int64)
    if len(bins):
        for _ in range(tree[4]):
            at = step(bins, tree, at)
    return at


def quantile_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """For each column of x: its different values but the last if they are few, else quantiles of it."""
    out = []
    for col in x.T:
        col = np.sort(col[np.isfinite(col)])
        own = np.unique(col)
        if len(own) > bins:
            own = np.unique(np.append(col[[len(col) * k // bins for k in range(1, bins)]], own[-1]))
        out.append(own[:-1])
    return out


def table_edges(df: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """quantile_edges() of a table, by sketches that one pass merges."""
    share = [k / bins for k in range(1, bins)]
    clean = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns]
    got = df.agg(*(F.percentile_approx(c, share, 10_000).alias(f"q{k}") for k, c in enumerate(clean)), *(F.max(c).alias(f"m{k}") for k, c in enumerate(clean))).first()
    return [np.unique([v for v in (got[f"q{k}"] or []) if v < got[f"m{k}"]]) for k in range(len(columns))]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, col, side="left") for col, e in zip(x.T, edges, strict=True)], axis=1).astype(np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers scrambled (the finaliser published as splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POISSON = np.array([min(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)), 1 - 1e-16) * 2.0**64 for k in range(12)])


def weights(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row counts for a tree: a Poisson draw of mean 1 by a hash of the row's key."""
    salt = _mixed(np.array([(seed * 1_000_003 + tree) & (2**64 - 1)], np.uint64))[0]
    return np.searchsorted(_POISSON, _mixed(keys ^ salt).astype(np.float64), side="right")


def drawn_columns(seed: int, tree: int, nodes: list[int], width: int, m: int) -> np.ndarray:
    """(node, m): the columns that each node of a tree may be split by, in order."""
    salt = _mixed(np.array([(seed * 1_000_003 + tree) ^ 0x5EED], np.uint64))[0]
    order = _mixed(_mixed(np.array(nodes, np.uint64) ^ salt)[:, None] + np.arange(width, dtype=np.uint64)[None])
    return np.sort(np.argsort(order, axis=1, kind="stable")[:, :m], axis=1)


def counted(bins: np.ndarray, place: np.ndarray, columns: np.ndarray, size: int, *sums: np.ndarray) -> np.ndarray:
    """(sums, node, slot, bin): sums over the rows of each node (place, -1 for none) by the bin of each of its columns."""
    k, m = columns.shape
    rows = np.flatnonzero(place >= 0)
    at = place[rows]
    out = np.zeros((len(sums), k * m * size), np.int64)
    flat, base = bins.ravel(), rows * bins.shape[1]
    for j in range(m):
        key = (at * m + j) * size + flat.take(base + columns[:, j].take(at))
        for s, what in enumerate(sums):
            out[s] += np.bincount(key, what[rows], k * m * size).astype(np.int64)
    return out.reshape(len(sums), k, m, size)


def purest(counts: np.ndarray, leaf: int) -> list[tuple | None]:
    """For each node the split of least Gini impurity, of (rows, positives) by slot and bin: slot, bin, rows and positives of the left side, and of the node; the first slot and bin on ties. A slot of None: no split."""
    n, s = counts
    left, hits = n.cumsum(axis=2), s.cumsum(axis=2)
    all_, pos = left[:, :1, -1:], hits[:, :1, -1:]
    right, rest = all_ - left, pos - hits
    with np.errstate(divide="ignore", invalid="ignore"):
        worth = (hits.astype(float) ** 2 + (left - hits).astype(float) ** 2) / left + (rest.astype(float) ** 2 + (right - rest).astype(float) ** 2) / right
        before = (pos.astype(float) ** 2 + (all_ - pos).astype(float) ** 2) / all_
    ok = (left >= max(leaf, 1)) & (right >= max(leaf, 1))
    worth = np.where(ok, worth, -np.inf)
    flat = worth.reshape(len(worth), -1)
    best = flat.argmax(axis=1)
    out = []
    for i, b in enumerate(best.tolist()):
        j, cut = divmod(b, n.shape[2])
        total = int(all_[i, 0, 0]), int(pos[i, 0, 0])
        good = flat[i, b] > before[i, 0, 0] * (1 + 1e-12)
        out.append((j, cut, int(left[i, j, cut]), int(hits[i, j, cut]), *total) if good else (None, 0, 0, 0, *total))
    return out


Asked = dict[int, tuple[tuple, np.ndarray, np.ndarray]]


def forest_counts(bins: np.ndarray, y: np.ndarray, keys: np.ndarray, seed: int, asked: Asked, size: int, held: dict | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(tree, counts) of the nodes that are asked for: tree -> (the tree so far, the number of each node among those asked, their columns).

    held keeps each tree's weights and nodes of the rows from one level to the next, for rows that stay at hand.
    """
    for t, (tree, number, columns) in asked.items():
        if held is None:
            # Rows that the tree did not draw take no part.
            w = weights(keys, seed, t)
            drawn = np.flatnonzero(w)
            own, w = bins[drawn], w[drawn]
            yield t, counted(own, number.take(walk(own, tree)), columns, size, w, w * y[drawn])
            continue
        if t in held:
            w, at = held[t][0], step(bins, tree, held[t][1])
        else:
            w, at = weights(keys, seed, t), np.zeros(len(bins), np.int64)
        held[t] = w, at
        yield t, counted(bins, np.where(w > 0, number.take(at), -1), columns, size, w, w * y)


def grow_forest(ask: Callable[[Asked], dict[int, list[tuple]]], width: int, numbers: range, depth: int, leaf: int, seed: int, size: int) -> list[Tree]:
    """The trees of some numbers, level by level; ask() gives the splits (as purest() does) of nodes of many trees at once.

    A tree depends on its number and the seed alone, and is grown level by level: so a forest of fewer
    trees or levels is this one with the others left out.
    """
    m = max(1, int(math.sqrt(width)))
    made, open_ = {t: Tree() for t in numbers}, {t: [0] for t in numbers}
    for _ in range(depth):
        found: dict[int, list[tuple]] = {}
        asked: Asked = {}
        room = 0
        for t, nodes in open_.items():
            number = np.full(len(made[t].column), -1, np.int64)
            number[nodes] = np.arange(len(nodes))
            asked[t] = (made[t].arrays(), number, drawn_columns(seed, t, nodes, width, m))
            room += len(nodes) * m * size * 16
            if room > PASS_BYTES:
                found |= ask(asked)
                asked, room = {}, 0
        if asked:
            found |= ask(asked)
        after: dict[int, list[int]] = {}
        for t, nodes in open_.items():
            own = []
            columns = drawn_columns(seed, t, nodes, width, m)
            for i, node in enumerate(nodes):
                slot, cut, n, s, all_, pos = found[t][i]
                if node == 0:
                    made[t].value[0] = pos / max(all_, 1)
                if slot is None:
                    continue
                children = made[t].split(node, int(columns[i, slot]), cut, (s / n, (pos - s) / (all_ - n)))
                own += [c for c, cn, cs in zip(children, (n, all_ - n), (s, pos - s), strict=True) if 0 < cs < cn and cn >= 2 * leaf]
            if own:
                after[t] = own
        open_ = after
        if not open_:
            break
    return [made[t] for t in numbers]


def local_forest(bins: np.ndarray, y: np.ndarray, keys: np.ndarray, numbers: range, depth: int, leaf: int, seed: int, size: int = BINS) -> list[Tree]:
    """The trees of some numbers on rows that are at hand."""
    held: dict = {}
    return grow_forest(lambda asked: {t: purest(c, leaf) for t, c in forest_counts(bins, y, keys, seed, asked, size, held)}, bins.shape[1], numbers, depth, leaf, seed, size)


def forest_scores(bins: np.ndarray, made: list[tuple]) -> np.ndarray:
    """Mean share of class 1 over the trees (as Tree.arrays gives them)."""
    return sum(t[3][walk(bins, t)] for t in made) / max(len(made), 1)


# --- boosting ------------------------------------------------------------------------------------------------------

def steepest(counts: np.ndarray, leaf: int = LEAF_ROWS) -> list[tuple | None]:
    """For each node the split of the largest gain, of (rows, gradient, curvature) by column and bin: gain, column, bin, and (gradient, curvature) of both sides; None if there is none."""
    n, g, h = counts[0], counts[1] / SCALE, counts[2] / SCALE
    nl, gl, hl = n.cumsum(axis=2), g.cumsum(axis=2), h.cumsum(axis=2)
    na, ga, ha = nl[:, :1, -1:], gl[:, :1, -1:], hl[:, :1, -1:]
    nr, gr, hr = na - nl, ga - gl, ha - hl
    ok = (nl >= leaf) & (nr >= leaf) & (hl >= LEAF_CURVATURE) & (hr >= LEAF_CURVATURE)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, gl * gl / hl + gr * gr / hr - ga * ga / ha, -np.inf)
    flat = gain.reshape(len(gain), -1)
    out = []
    for i, b in enumerate(flat.argmax(axis=1).tolist()):
        j, cut = divmod(b, n.shape[2])
        out.append((float(flat[i, b]), j, cut, (float(gl[i, j, cut]), float(hl[i, j, cut])), (float(gr[i, j, cut]), float(hr[i, j, cut]))) if flat[i, b] > 1e-9 else None)
    return out


class Growing:
    """A boosted tree on its way: the leaf of the largest gain is split next, up to MOST_LEAVES leaves and a depth.

    Splits do not depend on the order in which they are found. So the order is played again and again
    over the splits known so far, each time asking for those that it came by and that are not known;
    some that are asked for turn out not to be wanted.
    """

    def __init__(self, depth: int, rate: float, leaves: int = MOST_LEAVES):
        self.depth, self.rate, self.leaves = depth, rate, leaves
        self.tree, self.known = Tree(), {}
        self.wanted = [0]

    def learn(self, splits: list[tuple | None]) -> None:
        """The splits of the nodes that were wanted."""
        self.known.update(zip(self.wanted, splits, strict=True))
        chosen, self.wanted, leaves = [], [], 1
        heap = [(-self.known[0][0], 0)] if self.known[0] and self.depth > 0 else []
        while heap and leaves < self.leaves:
            _, node = heapq.heappop(heap)
            chosen.append(node)
            leaves += 1
            _, column, cut, left, right = self.known[node]
            if self.tree.column[node] < 0:
                self.tree.split(node, column, cut, tuple(-self.rate * g / h for g, h in (left, right)))
            for child in (self.tree.left[node], self.tree.left[node] + 1):
                if self.tree.depth[child] >= self.depth:
                    continue
                if child not in self.known:
                    self.wanted.append(child)
                elif self.known[child]:
                    heapq.heappush(heap, (-self.known[child][0], child))
        self.chosen = set(chosen)

    def done(self) -> Tree:
        """The tree with the chosen splits alone."""
        out, todo = Tree(), [(0, 0)]
        if not self.chosen:
            return out
        while todo:
            old, new = todo.pop()
            if old not in self.chosen:
                continue
            at = self.tree.left[old]
            pair = out.split(new, self.tree.column[old], self.tree.cut[old], (self.tree.value[at], self.tree.value[at + 1]))
            todo += [(at, pair[0]), (at + 1, pair[1])]
        return out


@dataclass
class Chain:
    """A boosted fit: rounds, rate and depth, the scores' base and the trees so far. Fewer rounds are its beginning."""

    rounds: int
    rate: float
    depth: int
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    growing: Growing | None = None

    def start(self) -> bool:
        if self.growing is None and len(self.trees) < self.rounds:
            self.growing = Growing(self.depth, self.rate)
        return self.growing is not None


def slopes(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the log loss in steps of 1/SCALE."""
    p = 1 / (1 + np.exp(-raw))
    return np.rint((p - y) * SCALE), np.rint(p * (1 - p) * SCALE)


def grow_boosted(ask: Callable[[list[Chain]], list[list[tuple | None]]], chains: list[Chain], positives: float, rows: float) -> None:
    """Grow all chains side by side; ask() gives the splits of the nodes that each chain's tree wants next."""
    for c in chains:
        c.base = math.log(max(positives, 0.5) / max(rows - positives, 0.5))
    while live := [c for c in chains if c.start()]:
        for c, splits in zip(live, ask(live), strict=True):
            c.growing.learn(splits)
            if not c.growing.wanted:
                c.trees.append(c.growing.done())
                c.growing = None


def local_boosted(bins: np.ndarray, y: np.ndarray, chains: list[Chain], size: int = BOOSTING_BINS) -> None:
    """Boost on rows that are at hand: each chain keeps its rows' scores, and those of its present tree by node."""
    width = bins.shape[1]
    flat = bins.astype(np.int64) + np.arange(width) * size
    held: dict[int, dict] = {id(c): {"raw": None, "trees": 0} for c in chains}

    def counts(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        key = flat[rows].ravel()
        return np.stack([np.bincount(key, None if w is None else np.repeat(w[rows], width), width * size) for w in (None, g, h)]).reshape(3, width, size)

    def ask(live: list[Chain]) -> list[list[tuple | None]]:
        out = []
        for c in live:
            own = held[id(c)]
            if own["raw"] is None:
                own["raw"] = np.full(len(y), c.base)
            if own["trees"] < len(c.trees):
                t = c.trees[-1].arrays()
                own["raw"] += t[3][walk(bins, t)]
                own["trees"] += 1
                own.pop("rows", None)
            if "rows" not in own:
                own["rows"], own["counts"], own["slopes"] = {0: np.arange(len(y))}, {}, slopes(own["raw"], y)
            rows, known, tree = own["rows"], own["counts"], c.growing.tree
            for node in c.growing.wanted:
                if node not in rows:
                    # The children of a node: the rows of the smaller one are counted, those of the other are the rest.
                    up = next(k for k in rows if tree.column[k] >= 0 and tree.left[k] in (node, node - 1))
                    right = bins[rows[up], tree.column[up]] > tree.cut[up]
                    pair = (tree.left[up], rows[up][~right]), (tree.left[up] + 1, rows[up][right])
                    rows.update(pair)
                    small, large = sorted(pair, key=lambda x: len(x[1]))
                    known[small[0]] = counts(small[1], *own["slopes"])
                    known[large[0]] = known[up] - known[small[0]]
                elif node not in known:
                    known[node] = counts(rows[node], *own["slopes"])
            out.append(steepest(np.stack([known[n] for n in c.growing.wanted], axis=1)))
        return out

    grow_boosted(ask, chains, float(y.sum()), len(y))


def boosted_scores(bins: np.ndarray, base: float, made: list[tuple]) -> np.ndarray:
    """Probabilities of class 1."""
    raw = np.full(len(bins), base)
    for t in made:
        raw += t[3][walk(bins, t)]
    return 1 / (1 + np.exp(-raw))


# --- over DataFrames -----------------------------------------------------------------------------------------------

SLICE = 1 << 16


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns, labels and keys of rows (key, y, columns...)."""
    cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
    return np.stack([np.asarray(c, float) for c in cols[2:]], axis=1), np.nan_to_num(np.asarray(cols[1], float)).astype(np.int64), np.asarray(cols[0], np.int64).view(np.uint64)


def _keyed(train: DataFrame, columns: list[str], y: str) -> DataFrame:
    """key, label and columns; rows that agree in every column of train have the same key."""
    return train.select(F.xxhash64(*train.columns).alias("key"), F.col(y).cast("double").alias("y"), *(F.col(c).cast("double") for c in columns))


def _pass(rows: DataFrame, count: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]], choose: Callable[[int, np.ndarray], list], parts: int) -> dict[int, list]:
    """Sums of count() over all rows by its key, and what choose() makes of them."""
    import pickle

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s in range(0, len(batch), SLICE):
                for k, c in count(*_arrays(batch.slice(s, SLICE))):
                    total[k] = total[k] + c if k in total else c
        for k, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pickle.dumps(c)], pa.binary())], names=["k", "sums"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total[k] + pickle.loads(c) if k in total else pickle.loads(c)
        for k, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pickle.dumps(choose(k, c))], pa.binary())], names=["k", "sums"])

    made = rows.mapInArrow(local, "k long, sums binary").repartition(parts, "k").mapInArrow(merged, "k long, sums binary")
    return {r.k: pickle.loads(r.sums) for r in made.collect()}


def forest(train: DataFrame, columns: list[str], y: str, trees: int, depth: int, leaf: int, seed: int, parts: int, bins: int = BINS) -> tuple[list[np.ndarray], list[Tree]]:
    """Edges and trees of a forest on any number of rows (in `parts` partitions): a pass a level."""
    edges, rows = table_edges(train, columns, bins), _keyed(train, columns, y)

    def ask(asked: Asked) -> dict[int, list[tuple]]:
        sent = train.sparkSession.sparkContext.broadcast(asked)
        got = _pass(rows, lambda x, y_, keys: forest_counts(binned(x, edges), y_, keys, seed, sent.value, bins), lambda t, c: purest(c, leaf), min(parts, len(asked)))
        sent.destroy()
        return {t: got.get(t) or [(None, 0, 0, 0, 0, 0)] * len(a[2]) for t, a in asked.items()}

    return edges, grow_forest(ask, len(columns), range(trees), depth, leaf, seed, bins)


#: Numbers of rows are summed in digits of so many bits: SLICE products with gradients are exact in floating point.
DIGIT = 12


def cells(train: DataFrame, columns: list[str], y: str, edges: list[np.ndarray]) -> DataFrame:
    """n, y and the bins of the columns: each cell of label and bins that has rows, with their number."""
    names = [f"b{k}" for k in range(len(columns))]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y_, _ = _arrays(batch)
                yield pa.RecordBatch.from_arrays([pa.array(y_), *(pa.array(b.astype(np.int16)) for b in binned(x, edges).T)], names=["y", *names])

    rows = train.select(F.lit(0).cast("long").alias("key"), F.col(y).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)))
    found = rows.mapInArrow(local, "y long, " + ", ".join(f"{n} short" for n in names))
    return found.groupBy("y", *names).agg(F.count("*").alias("n")).select("n", "y", *names)


def counted_cells(bins: np.ndarray, place: np.ndarray, columns: np.ndarray, size: int, n: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """counted() of rows, gradients and curvatures where each row of bins stands for n rows."""
    out, shift = np.zeros((3, *columns.shape, size), np.int64), 0
    while len(rows := np.flatnonzero(n >> shift)) or not shift:
        digit = ((n[rows] >> shift) & ((1 << DIGIT) - 1)).astype(float)
        out += counted(bins[rows], place[rows], columns, size, digit, digit * g[rows], digit * h[rows]) << shift
        shift += DIGIT
    return out


def boosted(train: DataFrame, columns: list[str], y: str, chains: list[Chain], parts: int, bins: int = BOOSTING_BINS) -> list[np.ndarray]:
    """Edges, for chains that are then grown, on any number of rows: each pass counts for the present trees of all chains.

    Rows of one label that share all bins have the same scores throughout, so they are counted once into
    a cell, and passes read cells: no more than rows, and no more than the products of the bins.
    """
    edges, width = table_edges(train, columns, bins), len(columns)
    with held(cells(train, columns, y, edges)) as rows:
        n, positives = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("y")), F.lit(0))).first()

        def ask(live: list[Chain]) -> list[list[tuple | None]]:
            state = []
            for c in live:
                number = np.full(len(c.growing.tree.column), -1, np.int64)
                number[c.growing.wanted] = np.arange(len(c.growing.wanted))
                state.append((c.base, [t.arrays() for t in c.trees], c.growing.tree.arrays(), number, len(c.growing.wanted)))
            sent = train.sparkSession.sparkContext.broadcast(state)

            def count(x: np.ndarray, y_: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
                own, size = x.astype(np.uint8), keys.view(np.int64)
                for k, (base, before, tree, number, wanted) in enumerate(sent.value):
                    raw = np.full(len(own), base)
                    for t in before:
                        raw += t[3][walk(own, t)]
                    g, h = slopes(raw, y_)
                    yield k, counted_cells(own, number[walk(own, tree)], np.tile(np.arange(width), (wanted, 1)), bins, size, g, h)

            got = _pass(rows, count, lambda k, c: steepest(c), min(parts, len(live)))
            sent.destroy()
            return [got.get(k) or [None] * len(c.growing.wanted) for k, c in enumerate(live)]

        grow_boosted(ask, chains, float(positives), float(n))
    return edges


class Model:
    """Trees that score a DataFrame: transform adds margin (the probability of class 1) and prediction."""

    def __init__(self, columns: list[str], edges: list[np.ndarray], score: Callable[[np.ndarray], np.ndarray]):
        self.columns, self.edges, self.score = columns, edges, score

    def column(self) -> Column:
        edges, score = self.edges, self.score

        @F.pandas_udf("double")
        def judged(*cols: pd.Series) -> pd.Series:
            x = np.stack([c.to_numpy(float) for c in cols], axis=1)
            return pd.Series(np.concatenate([score(binned(x[s : s + SLICE], edges)) for s in range(0, len(x), SLICE)]) if len(x) else np.zeros(0))

        return judged(*(F.col(c).cast("double") for c in self.columns))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("margin", self.column()).withColumn("prediction", (F.col("margin") > 0.5).cast("double"))
