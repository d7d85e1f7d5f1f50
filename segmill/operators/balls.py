"""What lies in balls around all points: the k nearest points of each, or how many lie nearer than given distances; exact.

Bundles of neighbouring cells of the metric tree (``silhouette._bundles``) lie in blocks, each block a task. A bundle walks down the tree to
learn which others its balls reach; those travel once to each block of which any bundle asks for them, and no others. In a block a cell is
compared only with such cells as a ball of its own cuts; cells that lie inside a ball as a whole count without comparison.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .cells import Tree
from .silhouette import BUNDLE, _bundles, _row
from .sweep import squares

#: Found pairs of a block that are held before only the nearest are kept.
PAIRS = 1 << 22
#: Rounding of squared distances by products, as a part of both points' squared lengths; of distances to a cell's mean.
BLUR, EDGE = 1e-14, 1e-9


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same number for a pair wherever it is computed."""
    return np.sqrt(((a - b) ** 2).sum(-1))


def _meet(cells: DataFrame, width: int, limits: DataFrame, scratch: Scratch, make: Callable, schema: str) -> DataFrame:
    """limits: row, limits (as many for each row, the greatest last). make(means, radius) gives the state of a block: see ``_Block``."""
    tree = Tree(cells, width)
    leaves = np.flatnonzero(tree.cell >= 0)
    means, radius = tree.moments.mean[leaves], tree.radius[leaves]
    bundles, bundle_of = _bundles(cells, tree, scratch)
    place_of = np.full(len(tree.cell), -1)
    place_of[leaves] = np.arange(len(leaves))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = np.frombuffer(rows, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), name), pa.int32()), pa.array(np.arange(len(rows)), pa.int32()), pa.array(rows)], ["bundle", "at", "row"])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("at").combine_chunks()
        return pa.table({"bundle": table["bundle"][:1], "limits": pa.array([table["limits"].combine_chunks().flatten().to_numpy().astype("<f8").tobytes()], pa.binary())})

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                packed = [batch.column(j)[i].as_py() for j in range(9)]
                sizes, x = np.frombuffer(packed[4], "<i4"), np.frombuffer(packed[6], "<f8").reshape(-1, width)
                ball, found, at = np.frombuffer(packed[8], "<f8").reshape(len(x), -1)[:, -1:], set(), 0
                for size in sizes:
                    mine, nodes = slice(at, at := at + size), np.array(tree.roots)
                    while len(nodes):
                        gap = np.sqrt(squares(x[mine], tree.moments.mean[nodes])) - tree.radius[nodes]
                        nodes = nodes[(gap <= ball[mine] + EDGE * (1 + np.abs(ball[mine]))).any(0)]
                        leaf = tree.cell[nodes] >= 0
                        found |= set(bundle_of[place_of[nodes[leaf]]].tolist())
                        nodes = tree.below[nodes[~leaf]].ravel()
                yield _row(BUNDLE + ", limits binary, others array<int>", [*packed, sorted(found)])

    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = bundles.select("bundle", "rows").mapInArrow(rows_of, "bundle int, at int, row long").join(limits, "row").groupBy("bundle").applyInArrow(pack, "bundle int, limits binary")
    names = [c.split()[0] for c in BUNDLE.split(", ")]
    dealt = bundles.join(packed, "bundle").select(*names, "limits").repartition(4 * tasks, "bundle")
    mine = scratch.keep(dealt.mapInArrow(walk, BUNDLE + ", limits binary, others array<int>"), "reach")
    blocks = (mine.agg(F.max("block")).first()[0] or 0) + 1
    columns = ["places", "sizes", "rows", "xs", "weights"]
    asked = mine.select(F.col("block").alias("to"), F.explode("others").alias("bundle")).distinct()
    theirs = asked.join(bundles, "bundle").select(F.col("to").alias("block"), F.lit(1).alias("side"), *columns, F.lit(None).cast("binary").alias("limits"))
    both = mine.select("block", F.lit(0).alias("side"), *columns, "limits").unionByName(theirs).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                block, side, *values = (batch.column(j)[i].as_py() for j in range(8))
                if block != now:
                    if state is not None:
                        yield state.end()
                    now, state = block, make(means, radius)
                (state.add if side else state.hold)(*values)
        if state is not None:
            yield state.end()

    return both.mapInArrow(compare, schema)


class _Block:
    """Points whose cells meet those of the bundles that ``add`` gives, one bundle after another."""

    def __init__(self, means: np.ndarray, radius: np.ndarray):
        self.means, self.radius, self.held, self.x = means, radius, [], None

    def hold(self, *values: bytes) -> None:
        self.held.append(values)

    def begin(self) -> None:
        places, sizes, self.rows, x, self.weights, limits = (np.frombuffer(b"".join(h[i] for h in self.held), t) for i, t in enumerate(("<i4", "<i4", "<i8", "<f8", "<f8", "<f8")))
        self.held = []
        self.x, self.limits = x.reshape(len(self.rows), -1), limits.reshape(len(self.rows), -1)
        self.ends = np.cumsum(sizes)
        self.centers, self.wide = self.means[places], self.radius[places]
        self.top = np.maximum.reduceat(self.limits[:, -1], self.ends - sizes)
        self.sizes = sizes

    def add(self, places: bytes, sizes: bytes, rows: bytes, xs: bytes, weights: bytes, _: None) -> None:
        if self.x is None:
            self.begin()
        places, sizes, rows, weights = np.frombuffer(places, "<i4"), np.frombuffer(sizes, "<i4"), np.frombuffer(rows, "<i8"), np.frombuffer(weights, "<f8")
        y, means, radius = np.frombuffer(xs, "<f8").reshape(len(rows), -1), self.means[places], self.radius[places]
        cell_of, total = np.repeat(np.arange(len(sizes)), sizes), np.add.reduceat(weights, np.cumsum(sizes) - sizes)
        gap = np.sqrt(squares(self.centers, means)) - self.wide[:, None] - radius
        for q in np.flatnonzero((gap <= (self.top + EDGE * (1 + self.top))[:, None]).any(1)):
            at = np.arange(self.ends[q] - self.sizes[q], self.ends[q])
            d = np.sqrt(squares(self.x[at], means))
            hit = d - radius <= (self.limits[at, -1] + EDGE * (1 + self.limits[at, -1]))[:, None]
            at, some = at[hit.any(1)], np.flatnonzero(hit.any(0))
            if not len(at):
                continue
            d = d[np.ix_(hit.any(1), hit.any(0))]
            cut = self.cut(at, d - radius[some], d + radius[some], total[some])
            at, some = at[cut.any(1)], some[cut.any(0)]
            if not len(at):
                continue
            pick = np.flatnonzero(np.isin(cell_of, some))
            self.compare(at, self.centers[q], rows[pick], y[pick], weights[pick])


def _products(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by products, and by how much they may be off."""
    a, b = (x**2).sum(1), (y**2).sum(1)
    return a[:, None] + b - 2 * x @ y.T, BLUR * float(a.max() + b.max())


class _Nearest(_Block):
    """The k nearest other points of each, ties to the smaller name; limits: how far the kth lies at most."""

    def __init__(self, k: int, means: np.ndarray, radius: np.ndarray):
        super().__init__(means, radius)
        self.k, self.pairs, self.many = k, [], 0

    def cut(self, at: np.ndarray, low: np.ndarray, high: np.ndarray, total: np.ndarray) -> np.ndarray:
        return low <= self.limits[at, -1:] + EDGE * (1 + self.limits[at, -1:])

    def compare(self, at: np.ndarray, center: np.ndarray, names: np.ndarray, y: np.ndarray, weights: np.ndarray) -> None:
        d2, blur = _products(self.x[at] - center, y - center)
        i, j = np.nonzero(d2 <= (self.limits[at, -1] ** 2 + blur)[:, None])
        far = _far(self.x[at[i]], y[j])
        real = (far <= self.limits[at[i], -1]) & (names[j] != self.rows[at[i]])
        self.pairs.append((at[i][real], names[j][real], far[real]))
        self.many += int(real.sum())
        if self.many > PAIRS:
            self.shorten()

    def shorten(self) -> None:
        at, names, far = (np.concatenate(v) for v in zip(*self.pairs))
        order = np.lexsort((names, far, at))
        at = at[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, int)
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        keep = order[rank < self.k]
        self.pairs = [(at[rank < self.k], names[keep], far[keep])]
        self.many = len(keep)

    def end(self) -> pa.RecordBatch:
        if self.pairs:
            self.shorten()
        at, names, far = self.pairs[0] if self.pairs else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return pa.RecordBatch.from_arrays([pa.array(self.rows[at] if len(at) else at, pa.int64()), pa.array(names, pa.int64()), pa.array(far, pa.float64())], ["row", "other", "far"])


class _Count(_Block):
    """The weight of the points, itself too, that lie nearer than each of a point's limits."""

    def begin(self) -> None:
        super().begin()
        self.counts = np.zeros(self.limits.shape)

    def cut(self, at: np.ndarray, low: np.ndarray, high: np.ndarray, total: np.ndarray) -> np.ndarray:
        limits, blur = self.limits[at][:, None], EDGE * (1 + high)[:, :, None]
        whole = limits > high[:, :, None] + blur
        cut = ((limits > low[:, :, None] - blur) & ~whole).any(2)
        whole[np.ix_(cut.any(1), cut.any(0))] = False  # these are compared
        self.counts[at] += np.einsum("rcl,c->rl", whole, total)
        return cut

    def compare(self, at: np.ndarray, center: np.ndarray, names: np.ndarray, y: np.ndarray, weights: np.ndarray) -> None:
        d2, blur = _products(self.x[at] - center, y - center)
        limits = self.limits[at]
        t, many = limits**2, limits.shape[1]
        i, j = np.nonzero(d2 < (t[:, -1] + blur)[:, None])
        if not len(i):
            return
        v = d2[i, j]
        first = many - (t[i] > (v + blur)[:, None]).sum(1, dtype=np.int32)  # from here on, limits are greater for sure
        self.counts[at] += np.cumsum(np.bincount(i * (many + 1) + first, weights[j], len(at) * (many + 1)).reshape(len(at), -1)[:, :many], 1)
        for h in np.flatnonzero(t[i, first - 1] > np.where(first > 0, v - blur, np.inf)):  # hardly ever
            c = np.flatnonzero(limits[i[h]] > _far(self.x[at[i[h]]], y[j[h]]))
            self.counts[at[i[h]], c[c < first[h]]] += weights[j[h]]

    def end(self) -> pa.RecordBatch:
        if self.x is None:
            self.begin()
        return pa.RecordBatch.from_arrays([pa.array(self.rows, pa.int64()), pa.array(list(self.counts), pa.list_(pa.float64()))], ["row", "counts"])


def nearest(cells: DataFrame, width: int, k: int, reach: DataFrame, scratch: Scratch) -> DataFrame:
    """row, other, far: the exact k nearest of each point. reach: row, reach (how far the kth lies at most)."""
    limits = reach.select("row", F.array(F.col("reach").cast("double")).alias("limits"))
    return scratch.keep(_meet(cells, width, limits, scratch, lambda m, r: _Nearest(k, m, r), "row long, other long, far double"), "nearest")


def nearer(cells: DataFrame, width: int, limits: DataFrame, scratch: Scratch) -> DataFrame:
    """row, counts: the weight of all points, itself too, that lie nearer than each of ``limits`` (row, limits: as many for each row, in order)."""
    return scratch.keep(_meet(cells, width, limits, scratch, _Count, "row long, counts array<double>"), "nearer")
