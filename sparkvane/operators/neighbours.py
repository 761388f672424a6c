"""Nearest-neighbour mutual information of continuous columns and a label, over all rows (Ross's estimate).

Of each row it takes the distance to the k-th nearest value of its own class and the number of values
of any class that are nearer. In one dimension both are a matter of order: each column's values are
sorted by ranges, a task finds neighbours within a range, and for those beyond its edges it has the k
outermost values of each class in the ranges before and after. The few rows that reach beyond their
range are known from the ranges' outermost values; whole ranges count for them by their sizes, and the
one on either side that is only partly within reach is asked for the rest. What comes to the driver is
a row for each range, with 4k values for each class.

Values are divided by the column's deviation and moved a little at random, so that ties are no neighbours
at distance 0; many rows of one value take whole numbers of a finer unit. Where moves still repeat, rows count by what is nearer than the
k-th neighbour, in their class and in all, or by what is at the same place if that neighbour is there too.
Rows without a value or label are left out.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import held

NEIGHBOURS, TINY = 3, 1e-10
#: Values of a range, about, and rows that a task sorts at once.
RANGE, SLICE = 500_000, 250_000
_HALF = float(1 << 32)
#: The values' expected rows within the last bit of one, from which on they are kept as whole numbers, and half of what these span.
CROWDED, _REACH = 0.05, 1 << 60
_TABLE = [sum(1.0 / i for i in range(1, n)) - 0.5772156649015329 for n in range(1, 17)]


def digamma(n: np.ndarray) -> np.ndarray:
    """At positive integers: a table at first, then the asymptotic series."""
    n = np.asarray(n, float)
    big = np.maximum(n, 16.0)
    series = np.log(big) - 1 / (2 * big) - 1 / (12 * big**2) + 1 / (120 * big**4) - 1 / (252 * big**6)
    return np.where(n <= 16, np.array(_TABLE)[np.clip(n, 1, 16).astype(int) - 1], series)


def digamma_column(n: Column) -> Column:
    """digamma() of a column of integers."""
    x = F.greatest(n, F.lit(16)).cast("double")
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return F.when(n <= 16, F.element_at(F.array(*map(F.lit, _TABLE)), F.greatest(n, F.lit(1)).cast("int"))).otherwise(series)


def inside(order: np.ndarray, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How many of the sorted values are nearer to each x than its radius. Differences are compared, as sums of value and radius are rounded."""
    if order.dtype.kind == "i":
        return np.maximum(np.searchsorted(order, x + radius, "left") - np.searchsorted(order, x - radius, "right"), 0)
    lo = np.searchsorted(order, np.nextafter(x - radius, -np.inf), "left")
    hi = np.searchsorted(order, np.nextafter(x + radius, np.inf), "right")
    for end, step, at in ((lo, 1, 0), (hi, -1, -1)):
        left = np.flatnonzero(lo < hi)
        while len(left := left[(lo[left] < hi[left]) & (np.abs(order[np.clip(end[left] + at, 0, len(order) - 1)] - x[left]) >= radius[left])]):
            end[left] += step
    return hi - lo


def near(mine: np.ndarray, before: np.ndarray, after: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of some sorted values, with those that stand before and after them: the distance to its k-th neighbour, and how many are nearer, itself included."""
    # The k-th neighbour lies within k places on either side: of all ways to take i to the left and the rest to the right, the one that reaches least.
    n, none = len(mine), 4 * _REACH if mine.dtype.kind == "i" else np.inf
    pad = lambda some, value: np.full(max(0, k - len(some)), value, mine.dtype)
    padded = np.concatenate([pad(before, -none), before[max(0, len(before) - k) :], mine, after[:k], pad(after, none)], dtype=mine.dtype)
    radius = np.full(n, np.iinfo(np.int64).max if mine.dtype.kind == "i" else np.inf, mine.dtype)
    left, right = (lambda i: mine - padded[k - i : k - i + n]), (lambda i: padded[k + i : k + i + n] - mine)
    for i in range(k + 1):
        radius = np.minimum(radius, np.maximum(left(i), right(k - i)))
    own = np.ones(n, np.int64)
    for i in range(1, k + 1):
        own += left(i) < radius
        own += right(i) < radius
    return radius, own


def counts(order: np.ndarray, mine: np.ndarray, radius: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of all values, and of the own class, are nearer than the radius; those at the same place, where the k-th neighbour is there too."""
    m, own = inside(order, mine, radius), own.copy()
    if len(at := np.flatnonzero(radius == 0)):
        for among, n in ((order, m), (mine, own)):
            n[at] = np.searchsorted(among, mine[at], "right") - np.searchsorted(among, mine[at], "left")
    return m, own


def information(x: np.ndarray, y: np.ndarray, k: int = NEIGHBOURS, seed: int | None = 42, least: float = 0.0) -> float:
    """The estimate for values at hand, at least `least`; with a seed of None the values are taken as they are."""
    x = np.asarray(x, float)
    if seed is not None:
        scale = x.std()
        x = (x / scale if scale > 0 else x) + TINY * max(1.0, float(np.abs(x).mean()) / (scale or 1.0)) * np.random.default_rng(seed).standard_normal(len(x))
    order, all_, sizes, own = np.sort(x), [], [], []
    for c in np.unique(y):
        mine = np.sort(x[y == c])
        if (n := len(mine)) < 2:
            continue
        for to, part in zip((all_, own), counts(order, mine, *near(mine, mine[:0], mine[:0], min(k, n - 1))), strict=True):
            to.append(part)
        sizes.append(np.full(n, n))
    if not all_:
        return 0.0
    m, n_y, kk = np.concatenate(all_), np.concatenate(sizes), np.concatenate(own)
    return max(least, float(digamma(np.array([len(m)]))[0] + digamma(kk).mean() - digamma(n_y).mean() - digamma(np.maximum(m, 1)).mean()))


def _hash(row_id: str) -> Column:
    return F.xxhash64(row_id)


@dataclass
class _Scale:
    """Of a column's values outside a fold: how many rows, their deviation, the size of a move, and their ends."""

    n: int
    scale: float
    step: float
    low: float
    high: float


def _scales(df: DataFrame, columns: list[str], fold: Column, folds: list[int | None]) -> dict[tuple[int | None, str], _Scale]:
    """For each fold (None: of none) and column, from sums by fold; deviations and moves to 12 digits, so that they do not depend on the order of the rows."""
    aggs = []
    for k, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [f(v).alias(f"{n}{k}") for n, f, v in (("n", F.count, x), ("a", F.avg, x), ("v", F.var_pop, x), ("m", F.avg, F.abs(x)), ("l", F.min, x), ("h", F.max, x))]
    parts = df.groupBy(fold.alias("fold")).agg(F.count("*").alias("n"), *aggs).collect()  # a row a fold
    found, digits = {}, lambda v: float(f"{v:.12g}")
    for f in folds:
        outside = [r for r in parts if f is None or (r.fold is not None and r.fold != f)]
        for k, c in enumerate(columns):
            own = [r for r in outside if r[f"n{k}"]]
            n = np.array([float(r[f"n{k}"]) for r in own])
            mean, spread, size, low, high = (np.array([r[f"{key}{k}"] for r in own]) for key in "avmlh")
            with np.errstate(invalid="ignore"):
                centre = (n * mean).sum() / max(n.sum(), 1.0)
                scale = digits(math.sqrt((n * (spread + (mean - centre) ** 2)).sum() / max(n.sum(), 1.0))) or 1.0
                step = digits(TINY * max(1.0, float((n * size).sum() / max(n.sum(), 1.0)) / scale))
            found[f, c] = _Scale(sum(r.n for r in outside), scale, step, min(low, default=0.0), max(high, default=0.0))
    return found


def moved(df: DataFrame, columns: list[str], y: str, row_id: str, seed: int) -> DataFrame:
    """name, x and y: the columns' scaled values, each moved by a normal draw from a hash of its row and name."""
    scales = _scales(df, columns, F.lit(0), [None])
    values = []
    for c in columns:
        scale, step = scales[None, c].scale, scales[None, c].step
        h = F.xxhash64(F.lit(seed), F.lit(c), _hash(row_id))
        radius, turn = F.sqrt(-2 * F.log((F.shiftrightunsigned(h, 32) + 1) / _HALF)), 2 * math.pi * (h.bitwiseAND(F.lit((1 << 32) - 1)) / _HALF)
        values.append(F.struct(F.lit(c).alias("name"), (F.col(c).cast("double") / scale + step * (radius * F.cos(turn))).alias("x"), F.col(y).cast("double").alias("y")))
    return df.select(F.inline(F.array(*values))).where("x IS NOT NULL AND NOT isnan(x) AND y IS NOT NULL")


def _draws(h: np.ndarray, start: int) -> np.ndarray:
    """The normal draws of moved() for rows' hashes; `start` is the hash of seed and name."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    # xxhash64 of one long.
    v = turned(h * p2, 31) * p1 ^ np.uint64((start + int(p5) + 8) % (1 << 64))
    v = turned(v, 27) * p1 + p4
    v = (v ^ (v >> np.uint64(33))) * p2
    v = (v ^ (v >> np.uint64(29))) * p3
    v ^= v >> np.uint64(32)
    return np.sqrt(-2 * np.log(((v >> np.uint64(32)) + np.uint64(1)) / _HALF)) * np.cos(2 * math.pi * ((v & np.uint64((1 << 32) - 1)) / _HALF))


@dataclass
class _Place:
    """A column outside a fold (or all of it): how its values are moved, and the ranges they are filed in.

    Values are those of moved(). Where so many rows may share one that doubles do not tell their moves apart, they
    are whole multiples of a unit that fills 61 bits instead.
    """

    column: str
    fold: int | None
    of: _Scale
    start: int
    unit: float | None = None
    first: int = 0
    bounds: np.ndarray | None = None

    def __post_init__(self):
        ends, width = max(abs(self.of.low), abs(self.of.high)) / self.of.scale, (self.of.high - self.of.low) / self.of.scale + 64 * self.of.step
        if math.isfinite(width) and self.of.n * np.spacing(ends) > CROWDED * self.of.step:
            self.unit = 2.0 ** (math.floor(math.log2(2 * _REACH / width)))

    def values(self, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Moved values and labels of the rows that count."""
        x = rows[self.column]
        keep = ~(np.isnan(x) | np.isnan(rows["y"]))
        if self.fold is not None:
            keep &= rows["fold"] != self.fold
        x, draws = x[keep], _draws(rows["h"][keep], self.start)
        if self.unit is None:
            return x / self.of.scale + self.of.step * draws, rows["y"][keep]
        place = np.rint((x - self.of.low) / self.of.scale * self.unit).astype(np.int64) - _REACH
        return place + np.rint((self.of.step * self.unit) * (draws + 16)).astype(np.int64), rows["y"][keep]


def _rows(table: pa.Table, columns: list[str]) -> dict[str, np.ndarray]:
    """The columns _h, _y, _fold and values v0, v1, ... of a table as arrays; null is NaN."""
    got = lambda c: table.column(c).to_numpy()
    return {"h": got("_h").view(np.uint64), "y": got("_y").astype(float), "fold": got("_fold"), **{c: got(f"v{k}").astype(float) for k, c in enumerate(columns)}}


def _pieces(places: list[_Place], columns: list[str]):
    """Sorted runs of the values of one range and class."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        some, n = [], 0
        for b in batches:
            some.append(b)
            if (n := n + len(b)) >= SLICE:
                yield pa.Table.from_batches(some)
                some, n = [], 0
        if n:
            yield pa.Table.from_batches(some)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches):
            rows = _rows(table, columns)
            for p in places:
                x, y = p.values(rows)
                out: list[tuple] = []
                for c in np.unique(y):
                    own = np.sort(x[y == c])
                    ends = [0, *np.searchsorted(own, p.bounds).tolist(), len(own)]
                    out += [(p.first + i, c, own[a:b].tobytes()) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if a < b]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int32(), pa.float64(), pa.binary()), strict=True)], names=["r", "y", "x"])

    return local


def _merged(k: int, whole: list[bool]):
    """Of a range: the outermost values of each class, its ends and size, and all its values, sorted class by class."""

    def local(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").combine_chunks()
        classes, parts, kind = {}, [], np.int64 if whole[table.column("r")[0].as_py()] else np.float64
        for c in np.unique(y):
            mine = np.sort(np.concatenate([np.frombuffer(x[int(i)].as_buffer(), kind) for i in np.flatnonzero(y == c)]))
            classes[float(c)] = len(mine), mine[: 2 * k].copy(), mine[max(2 * k, len(mine) - 2 * k) :].copy()
            parts.append(mine)
        told = sum(map(len, parts)), min(p[0] for p in parts), max(p[-1] for p in parts), classes
        return pa.table({"r": pa.array([table.column("r")[0].as_py()], pa.int32()), "s": pa.array([pickle.dumps(told)], pa.binary()), "x": pa.array([np.concatenate(parts).tobytes()], pa.binary())})

    return local


def _questions(ranges: list[tuple[int, tuple]], k: int) -> tuple[dict[int, dict], np.ndarray, np.ndarray]:
    """What tasks need of one column's ranges, and of its open rows, whose neighbours lie beyond their range, the terms and counts known so far.

    A row reaches beyond its range only if fewer than k of its class stand between: at most k for each
    class and edge. Their radius follows from the outermost values. For each range: its rows of
    each class, the k values before and after them, the places of open rows, and for open rows of any
    range that reach into a part of it their number, value and radius.
    """
    sizes, low, high = (np.array([s[j] for _, s in ranges]) for j in (0, 1, 2))
    known: dict[int, dict] = {r: {"kind": np.asarray(s[1]).dtype, "classes": {c: v[0] for c, v in s[3].items()}, "totals": {}, "around": {}, "open": {}, "asked": []} for r, s in ranges}
    terms: list[np.ndarray] = []
    m: list[np.ndarray] = []
    seen = 0
    for c in sorted({c for _, s in ranges for c in s[3]}):
        own = [(i, *s[3][c]) for i, (_, s) in enumerate(ranges) if c in s[3]]
        total = sum(n for _, n, _, _ in own)
        for i, *_ in own:
            known[ranges[i][0]]["totals"][c] = total
        if total < 2:
            continue
        kk = min(k, total - 1)
        v = np.concatenate([a for _, _, head, tail in own for a in (head, tail)])
        at = np.concatenate([np.full(len(head) + len(tail), i) for i, _, head, tail in own])
        place = np.concatenate([np.concatenate([np.arange(len(head)), n - np.arange(len(tail), 0, -1)]) for _, n, head, tail in own])
        size = np.concatenate([np.full(len(head) + len(tail), n) for _, n, head, tail in own])
        first = np.searchsorted(at, np.arange(len(ranges) + 1))
        for i, *_ in own:
            known[ranges[i][0]]["around"][c] = v[max(0, first[i] - k) : first[i]], v[first[i + 1] : first[i + 1] + k]
        radius, nearer = near(v, v[:0], v[:0], kk)
        edge = (place < kk) | (size - 1 - place < kk)
        add, asked = np.zeros(len(v), np.int64), [(at, np.arange(len(v)))]
        reach = np.zeros(len(v), bool)
        for step, far, close in ((-1, low, high), (1, high, low)):
            live, s = np.flatnonzero(edge), at[edge] + step
            while len(live):
                ok = (s >= 0) & (s < len(ranges))
                live, s = live[ok], s[ok]
                ok = np.abs(v[live] - close[s]) < radius[live]
                live, s = live[ok], s[ok]
                reach[live] = True
                whole = np.abs(v[live] - far[s]) < radius[live]
                add[live[whole]] += sizes[s[whole]]
                asked.append((s[~whole], live[~whole]))
                live, s = live[whole], s[whole] + step
        number = np.cumsum(reach) - 1 + seen
        for i in np.unique(at[reach]):
            known[ranges[i][0]]["open"][c] = place[reach & (at == i)]
        to, who = np.concatenate([a[0] if n else at[reach] for n, a in enumerate(asked)]), np.concatenate([a[1] if n else np.flatnonzero(reach) for n, a in enumerate(asked)])
        order = np.argsort(to, kind="stable")
        to, who = to[order], who[order]
        for i in np.unique(to):
            a, b = np.searchsorted(to, [i, i + 1])
            known[ranges[i][0]]["asked"].append((number[who[a:b]], v[who[a:b]], radius[who[a:b]]))
        seen += int(reach.sum())
        terms.append(digamma(nearer[reach]) - digamma(np.array([total])))
        m.append(add[reach])
    return known, np.concatenate([np.zeros(0), *terms]), np.concatenate([np.zeros(0, np.int64), *m])


def _sums(known: dict[int, dict], k: int):
    """Of each range the terms and number of its rows that are not open (uid null), and what it counts for open rows (uid)."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                here, x = known[r], np.frombuffer(raw.as_buffer(), known[r]["kind"])
                order, start, terms, n = np.sort(x), 0, 0.0, 0
                for c, size in here["classes"].items():
                    mine, start = x[start : start + size], start + size
                    if (total := here["totals"][c]) < 2:
                        continue
                    m, own = counts(order, mine, *near(mine, *here["around"][c], min(k, total - 1)))
                    closed = np.ones(size, bool)
                    closed[here["open"].get(c, [])] = False
                    own, m = own[closed], m[closed]
                    terms += float(digamma(own).sum() - digamma(np.maximum(m, 1)).sum()) - len(m) * float(digamma(np.array([total]))[0])
                    n += len(m)
                uids = np.concatenate([np.zeros(0, np.int64), *(u for u, _, _ in here["asked"])])
                found = np.concatenate([np.zeros(0, np.int64), *(inside(order, v, radius) for _, v, radius in here["asked"])])
                yield pa.RecordBatch.from_arrays([pa.array([r] * (1 + len(uids)), pa.int32()), pa.array([None, *uids.tolist()], pa.int64()), pa.array([n, *found.tolist()], pa.int64()), pa.array([terms] + [None] * len(uids), pa.float64())], names=["r", "uid", "n", "terms"])

    return local


def neighbour_information(df: DataFrame, columns: list[str], y: str, row_id: str, seed: int = 42, k: int = NEIGHBOURS) -> DataFrame:
    """(name, mi) of each column by nearest neighbours among all rows."""
    got = _estimate(df, columns, y, row_id, F.lit(0), {None: seed}, k)
    return df.sparkSession.createDataFrame([(c, mi) for (_, c), mi in sorted(got.items(), key=lambda x: x[0][1])], "name string, mi double")


def complement_information(df: DataFrame, columns: list[str], y: str, row_id: str, fold: str, n_folds: int, seed: int = 42, k: int = NEIGHBOURS) -> dict[int, dict[str, float]]:
    """neighbour_information() of the rows outside each fold (with the seed raised by the fold), all from one reading."""
    got = _estimate(df, columns, y, row_id, F.col(fold), {f: seed + f for f in range(n_folds)}, k)
    return {f: {c: mi for (g, c), mi in got.items() if g == f} for f in range(n_folds)}


def _estimate(df: DataFrame, columns: list[str], y: str, row_id: str, fold: Column, seeds: dict[int | None, int], k: int) -> dict[tuple[int | None, str], float]:
    """The estimates of all columns outside each fold that have rows.

    A task sorts what it reads by column, range and class, and runs of values go through the shuffle, not
    rows. Ranges have about RANGE values whatever the rows, so no task holds more as tables grow; their
    bounds come from a sample, which decides nothing else.
    """
    spark = df.sparkSession
    scales = _scales(df, columns, fold, list(seeds))
    n = max((s.n for s in scales.values()), default=0)
    starts = spark.range(1).select(*(F.xxhash64(F.lit(s), F.lit(c)) for s in seeds.values() for c in columns)).first()
    places = [_Place(c, f, scales[f, c], start) for (f, c), start in zip([(f, c) for f in seeds for c in columns], starts or [], strict=True)]
    wide = df.select(_hash(row_id).alias("_h"), F.col(y).cast("double").alias("_y"), fold.cast("int").alias("_fold"), *(F.col(c).cast("double").alias(f"v{j}") for j, c in enumerate(columns)))
    # A row of no fold is outside none, as a comparison with null is not true.
    wide = wide.where("_fold IS NOT NULL")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = max(-(-n // RANGE), -(-parts // max(1, len(places))))
    sample = wide.where(F.pmod(F.col("_h"), F.lit(1 << 30)) < int(min(1.0, max(20_000, 64 * each) / max(n, 1)) * (1 << 30)))
    drawn, total = _rows(sample.toArrow(), columns), 0
    for p in places:
        x = np.sort(p.values(drawn)[0])
        p.first, p.bounds = total, np.unique(x[np.arange(1, each) * len(x) // each]) if len(x) else x
        total += len(p.bounds) + 1
    whole = [p.unit is not None for p in places for _ in range(len(p.bounds) + 1)]
    pieces = wide.mapInArrow(_pieces(places, columns), "r int, y double, x binary").repartition(max(parts, total // 4), "r")
    mi: dict[tuple[int | None, str], float] = {}
    with held(pieces.groupBy("r").applyInArrow(_merged(k, whole), "r int, s binary, x binary")) as order:
        found = sorted((r.r, pickle.loads(r.s)) for r in order.select("r", "s").collect())  # a row a range
        known: dict[int, dict] = {}
        open_, ends = [], [p.first for p in places]
        of = np.searchsorted(ends, [r for r, _ in found], "right") - 1
        for j in range(len(places)):
            here, terms, m = _questions([f for f, at in zip(found, of, strict=True) if at == j], k)
            known |= here
            open_.append((terms, m))
        sums = [[0.0, 0] for _ in places]
        for r in order.select("r", "x").mapInArrow(_sums(known, k), "r int, uid long, n long, terms double").collect():  # a row a range, and those of open rows
            j = int(np.searchsorted(ends, r.r, "right")) - 1
            if r.uid is None:
                sums[j][0] += r.terms
                sums[j][1] += r.n
            else:
                open_[j][1][r.uid] += r.n
        for j, p in enumerate(places):
            terms, m = open_[j]
            all_ = sums[j][1] + len(m)
            if all_:
                mi[p.fold, p.column] = max(0.0, float(digamma(np.array([all_]))[0] + (sums[j][0] + (terms - digamma(np.maximum(m, 1))).sum()) / all_))
            elif (of == j).any():
                mi[p.fold, p.column] = 0.0
    return mi
