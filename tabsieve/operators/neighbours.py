"""Exact nearest distances and within-radius tests between two tables of points.

Two physical forms with the same result. If one side has at most `most_held` distinct points (checked by a count), it is sent to the executors as an index:
a tree of median cuts on the widest axis, whose leaves have bounding boxes. The other side streams past it in Arrow batches, and a probe only looks into
leaves whose box lies within its distance. Beyond that, space itself is cut the same way by a sample of the base: each cell holds about `CELL_ROWS` base points.
Every probe searches its own cell first, which bounds its distance, and then the other cells whose box lies within that distance. Equal base points are one
point, so a value that a third of all rows share fills no cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD = 200_000
LEAF = 128
CELL_ROWS = 50_000
SAMPLE_PER_CELL = 64
PROBES = 2048
SPAN = "cell int, probe boolean, id long, x array<double>, r double, a long, b long"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed column by column in order, as the SQL forms do."""
    total = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        d = a[:, k, None] - b[None, :, k]
        total += d * d
    return np.sqrt(total)


def _cut(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows of x in groups of at most `most` (equal points stay together), by median cuts on the widest axis."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) > most:
            part = x[rows]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            v = part[:, axis]
            middle = np.partition(v, len(v) // 2)[len(v) // 2]
            left = v < middle if (v < middle).any() else v <= middle
            if not left.all():
                todo += [rows[~left], rows[left]]
                continue
        if len(rows):
            out.append(rows)
    return out


class Index:
    """Points in leaves with bounding boxes. Several points may be one (a < b: ids from a to b)."""

    def __init__(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, r: np.ndarray | None = None):
        self.leaves = _cut(x, LEAF)
        self.x, self.a, self.b, self.r = x, a, b, r
        self.lo = np.array([x[k].min(0) for k in self.leaves]).reshape(-1, x.shape[1])
        self.hi = np.array([x[k].max(0) for k in self.leaves]).reshape(-1, x.shape[1])
        self.reach = np.array([r[k].max() for k in self.leaves]) if r is not None else None

    def boxes(self, y: np.ndarray) -> np.ndarray:
        """Distance of each probe to each leaf's box, a hair less than exact so that rounding hides nothing."""
        total = np.zeros((len(y), len(self.leaves)))
        for k in range(y.shape[1]):
            d = np.maximum(np.maximum(self.lo[None, :, k] - y[:, k, None], y[:, k, None] - self.hi[None, :, k]), 0.0)
            total += d * d
        return np.sqrt(total) * (1 - 1e-9)

    def nearest(self, y: np.ndarray, me: np.ndarray | None, best: np.ndarray) -> np.ndarray:
        """Least of best and the distance to a point (of another id, if me is given) for each probe."""
        best = best.copy()
        if not len(self.leaves) or not len(y):
            return best
        box = self.boxes(y)
        home = box.argmin(1)

        def visit(leaf: int, rows: np.ndarray):
            at = self.leaves[leaf]
            m = distances(y[rows], self.x[at])
            if me is not None:
                m[(self.a[at][None, :] == me[rows, None]) & (self.b[at] == self.a[at])[None, :]] = np.inf
            best[rows] = np.minimum(best[rows], m.min(1))

        order = np.argsort(home, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
            visit(int(home[rows[0]]), rows)
        for leaf in range(len(self.leaves)):
            rows = np.flatnonzero((box[:, leaf] <= best) & (home != leaf))
            if len(rows):
                visit(leaf, rows)
        return best

    def within(self, y: np.ndarray) -> np.ndarray:
        """Whether some point is strictly closer than its own radius."""
        flag = np.zeros(len(y), bool)
        if not len(self.leaves) or not len(y):
            return flag
        box = self.boxes(y)
        for leaf, at in enumerate(self.leaves):
            rows = np.flatnonzero((box[:, leaf] < self.reach[leaf]) & ~flag)
            if len(rows):
                flag[rows] = (distances(y[rows], self.x[at]) < self.r[at][None, :]).any(1)
        return flag


def _points(df: DataFrame, key: str, columns: list[str], *more: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), *more)


def _distinct(df: DataFrame) -> DataFrame:
    """(x, a, b, r): distinct points with the least and the largest id and the largest radius."""
    r = F.max("r") if "r" in df.columns else F.lit(None).cast("double")
    return df.groupBy("x").agg(F.min("id").alias("a"), F.max("id").alias("b"), r.alias("r"))


def _matrix(batch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _held(df: DataFrame, d: int) -> Index:
    t = df.toArrow()
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("x").chunks]).reshape(-1, d) if t.num_rows else np.zeros((0, d))
    return Index(x, t.column("a").to_numpy(), t.column("b").to_numpy(), t.column("r").to_numpy() if t.num_rows else np.zeros(0))


def _parts(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, PROBES):
            yield batch.slice(at, PROBES)


def nearest(probe: DataFrame, base: DataFrame, key: str, columns: list[str], others_only: bool = False, most_held: int = HELD) -> DataFrame:
    """(key, dist): distance from each probe row to the nearest base row, or to the nearest with another key."""
    d = len(columns)
    left, right = _points(probe, key, columns), _distinct(_points(base, key, columns))
    n = right.limit(most_held + 1).count()
    if n <= most_held:
        index = _held(right, d)

        def scan(batches):
            for batch in _parts(batches):
                me = batch.column("id").to_numpy()
                best = index.nearest(_matrix(batch, d), me if others_only else None, np.full(len(me), np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(me), pa.array(best, mask=np.isinf(best))], names=["id", "dist"])

        return left.mapInArrow(scan, "id long, dist double").withColumnRenamed("id", key)
    cells = Cells.of(right, d, most_held)
    own = cells.search(cells.at_home(left.withColumn("r", F.lit(float("inf")))), right, others_only)
    rest = cells.search(cells.elsewhere(own.select("id", "x", F.col("dist").alias("r"))), right, others_only)
    both = own.select("id", "dist").unionByName(rest.select("id", "dist"))
    return both.groupBy("id").agg(F.min("dist").alias("dist")).select(F.col("id").alias(key), F.when(F.col("dist") < float("inf"), F.col("dist")).alias("dist"))


def any_within(probe: DataFrame, base: DataFrame, key: str, columns: list[str], radius: str, most_held: int = HELD) -> DataFrame:
    """(key, flag): 1 if some base row is strictly closer than that base row's own radius. The probe may be a stream if the base is held."""
    d = len(columns)
    left, right = _points(probe, key, columns), _distinct(_points(base, key, columns, F.col(radius).cast("double").alias("r")).where("r > 0"))
    n = right.limit(most_held + 1).count()
    if n <= most_held:
        index = _held(right, d)

        def scan(batches):
            for batch in _parts(batches):
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(index.within(_matrix(batch, d)).astype(np.int32))], names=["id", "flag"])

        return left.mapInArrow(scan, "id long, flag int").withColumnRenamed("id", key)
    if left.isStreaming:
        raise ValueError(f"a stream needs base rows of at most {most_held} distinct points")
    # the base rows reach out: each goes to all cells that its radius touches, each probe lies in one
    cells = Cells.of(right, d, most_held)
    hit = cells.touched(left, right).where("hit").select("id").distinct().withColumn("flag", F.lit(1))
    return left.select("id").join(hit, "id", "left").select(F.col("id").alias(key), F.coalesce("flag", F.lit(0)).alias("flag"))


class Cells:
    """A cut of space into boxes with about as many base points each, from a sample that grows with their number."""

    def __init__(self, splits: list[tuple[int, float, int, int]], lo: np.ndarray, hi: np.ndarray, d: int):
        self.splits, self.lo, self.hi, self.d = splits, lo, hi, d

    @classmethod
    def of(cls, base: DataFrame, d: int, most_held: int) -> Cells:
        n = base.count()
        wanted = max(2, -(-n // min(CELL_ROWS, max(most_held, 2))))
        share = min(1.0, wanted * SAMPLE_PER_CELL / n)
        t = base.where(F.pmod(F.xxhash64("a", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))).select("x").toArrow()
        x = np.array(t.column("x").to_pylist(), float).reshape(-1, d)
        splits, lo, hi = [], [], []

        def grow(rows, low, high, many):
            """A node: (axis, value, left, right), leaves as (-1, 0, cell, cell)."""
            me = len(splits)
            splits.append(None)
            part = x[rows]
            axis = int(np.argmax(part.max(0) - part.min(0))) if len(rows) else 0
            value = float(np.median(part[:, axis])) if len(rows) else 0.0
            left = part[:, axis] < value if len(rows) else np.zeros(0, bool)
            if many < 2 or not left.any():
                splits[me] = (-1, 0.0, len(lo), len(lo))
                lo.append(low)
                hi.append(high)
                return me
            edge_high, edge_low = high.copy(), low.copy()
            edge_high[axis], edge_low[axis] = value, value
            a = grow(rows[left], low, edge_high, many // 2)
            b = grow(rows[~left], edge_low, high, many - many // 2)
            splits[me] = (axis, value, a, b)
            return me

        grow(np.arange(len(x)), np.full(d, -np.inf), np.full(d, np.inf), wanted)
        return cls(splits, np.array(lo), np.array(hi), d)

    def cell(self, x: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            axis, value, a, b = self.splits[node]
            if axis < 0:
                out[rows] = a
                continue
            left = x[rows, axis] < value
            todo += [(a, rows[left]), (b, rows[~left])]
        return out

    def touching(self, x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells within r of each point, found from the root down."""
        rows_out, cells_out, todo = [], [], [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            axis, value, a, b = self.splits[node]
            if axis >= 0:
                slack = 1e-9 * (np.abs(x[rows, axis]) + abs(value))
                todo += [(a, rows[x[rows, axis] - r[rows] <= value + slack]), (b, rows[x[rows, axis] + r[rows] >= value - slack])]
                continue
            gap = np.maximum(np.maximum(self.lo[a] - x[rows], x[rows] - self.hi[a]), 0.0)
            near = np.sqrt((gap * gap).sum(1)) * (1 - 1e-9) <= r[rows]
            rows_out.append(rows[near])
            cells_out.append(np.full(near.sum(), a, np.int32))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *rows_out]), np.concatenate([none.astype(np.int32), *cells_out])

    def _dealt(self, df: DataFrame, spread: bool, skip_home: bool, probe: bool) -> DataFrame:
        """df (id, x, r, a, b) in its cells."""

        def deal(batches):
            for batch in _parts(batches):
                x = _matrix(batch, self.d)
                home = self.cell(x)
                if not spread:
                    rows, cells = np.arange(len(x)), home
                else:
                    rows, cells = self.touching(x, np.nan_to_num(batch.column("r").to_numpy(zero_copy_only=False), nan=0.0, posinf=np.inf))
                    if skip_home:
                        other = cells != home[rows]
                        rows, cells = rows[other], cells[other]
                t = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(np.full(len(rows), probe)), *(t.column(c) for c in ("id", "x", "r", "a", "b"))], names=["cell", "probe", "id", "x", "r", "a", "b"])

        full = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double" if c == "r" else "long").alias(c) for c in ("id", "x", "r", "a", "b")])
        return full.mapInArrow(deal, SPAN)

    def at_home(self, probes: DataFrame) -> DataFrame:
        return self._dealt(probes, False, False, True)

    def elsewhere(self, probes: DataFrame) -> DataFrame:
        return self._dealt(probes, True, True, True)

    def _met(self, probes: DataFrame, base: DataFrame):
        return probes.unionByName(base).repartition("cell").sortWithinPartitions("cell", "probe")

    def search(self, probes: DataFrame, base: DataFrame, others_only: bool) -> DataFrame:
        """(id, x, dist): each probe's least distance (its r at most) to the base points of the cells it was dealt to."""
        d = self.d

        def meet(batches):
            for index, batch in _by_cell(batches, d, False):
                me, x = batch.column("id").to_numpy(), _matrix(batch, d)
                best = batch.column("r").to_numpy(zero_copy_only=False)
                if index is not None:
                    best = index.nearest(x, me if others_only else None, best)
                yield pa.RecordBatch.from_arrays([pa.array(me), batch.column("x"), pa.array(best)], names=["id", "x", "dist"])

        return self._met(probes, self._dealt(base.drop("r"), False, False, False)).mapInArrow(meet, "id long, x array<double>, dist double")

    def touched(self, probes: DataFrame, base: DataFrame) -> DataFrame:
        """(id, hit): whether a base point that reaches the probe's cell is closer than its radius."""
        d = self.d

        def meet(batches):
            for index, batch in _by_cell(batches, d, True):
                hit = index.within(_matrix(batch, d)) if index is not None else np.zeros(batch.num_rows, bool)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(hit)], names=["id", "hit"])

        return self._met(self.at_home(probes), self._dealt(base, True, False, False)).mapInArrow(meet, "id long, hit boolean")


def _by_cell(batches, d: int, radii: bool):
    """(index of the cell's base points or None, probes) from rows that come ordered by cell, base points first."""
    cell, index, held = None, None, []
    for whole in batches:
        for batch in _parts([whole]):
            cells, probe = batch.column("cell").to_numpy(), batch.column("probe").to_numpy(zero_copy_only=False)
            key = cells.astype(np.int64) * 2 + probe
            for rows in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key)) + 1):
                if not len(rows):
                    continue
                part = batch.slice(int(rows[0]), len(rows))
                if cells[rows[0]] != cell:
                    cell, index, held = cells[rows[0]], None, []
                if not probe[rows[0]]:
                    held.append(part)
                    continue
                if held:
                    t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    index, held = Index(_matrix(t, d), t.column("a").to_numpy(), t.column("b").to_numpy(), t.column("r").to_numpy() if radii else None), []
                yield index, part
