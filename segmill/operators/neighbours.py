"""Nearest neighbours of all points, as a table of edges (row, other, far).

``descend`` begins with the nearest points in each cell of the metric tree and in the CLOSE cells whose means are nearest, and improves them by
neighbour descent: neighbours of a common point are compared with each other, and a pair is kept if it beats what either end has. Rounds
are joins on tables; a round sends the points that are compared, at most 2 * k for each point, and gets back improvements only.

``certify`` makes the result exact. A point's kth distance so far bounds the ball that holds its true neighbours; the points of a cell are
compared with all points of those cells that any of their balls reaches, and with no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .cells import PACKED, Cell, Tree, make_cells, matrix, meet

EDGES = "row long, other long, far double"
MOST_ROUNDS, SETTLED, CLOSE = 8, 0.001, 6
#: Points whose candidates a task compares together.
TOGETHER = 256


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same number for a pair wherever it is computed."""
    return np.sqrt(((a - b) ** 2).sum(-1))


def _edges(row: np.ndarray, other: np.ndarray, far: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(other, pa.int64()), pa.array(far, pa.float64())], ["row", "other", "far"])


def _best(far: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of each row, ties to the smaller name. far, names: points x candidates."""
    order = np.lexsort((names, far), axis=1)[:, :k]
    return np.take_along_axis(far, order, 1), np.take_along_axis(names, order, 1)


def _search(rows: DataFrame, wanted: DataFrame, cells: DataFrame, most: int) -> DataFrame:
    """Edges from each point to the ``most`` nearest among the points of those cells that ``wanted`` (cell, other) names for its own."""

    def begin(row: dict) -> list:
        q = Cell.read(*[row[c] for c in PACKED])
        return [q, np.full((len(q.rows), most), np.inf), np.full((len(q.rows), most), np.iinfo(np.int64).max)]

    def add(state: list, other: Cell) -> None:
        q, far, names = state
        for lo in range(0, len(q.rows), 64):
            part = slice(lo, lo + 64)
            d = _far(q.x[part, None], other.x)
            d[q.rows[part, None] == other.rows] = np.inf
            hit = np.flatnonzero((d <= far[part, -1:]).any(1))  # the others keep what they have
            at = lo + hit
            if len(hit):
                far[at], names[at] = _best(np.concatenate((far[at], d[hit]), 1), np.concatenate((names[at], np.broadcast_to(other.rows, (len(hit), len(other.rows)))), 1), most)

    def end(state: list) -> pa.RecordBatch:
        q, far, names = state
        real = np.isfinite(far)
        return _edges(np.repeat(q.rows, most)[real.ravel()], names[real], far[real])

    return meet(rows, wanted, cells, begin, add, end, EDGES)


def _close(tree: Tree):
    """For each cell (cell, moments): itself and the CLOSE cells with the nearest means."""
    leaves = np.flatnonzero(tree.cell >= 0)
    names, means = tree.cell[leaves], tree.moments.mean[leaves]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                gap = ((means - means[names == cell]) ** 2).sum(1)
                found = names[np.argsort(gap, kind="stable")[: CLOSE + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([cell] * len(found)), pa.array(found, pa.int64())], ["cell", "other"])

    return run


def means_apart(tree: Tree, k: int):
    """For each cell (cell): the k cells with the nearest means (all others, if there are fewer), as edges."""
    leaves = np.flatnonzero(tree.cell >= 0)
    names, means = tree.cell[leaves], tree.moments.mean[leaves]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                far = _far(means, means[names == cell])
                far[names == cell] = np.inf
                some = np.argsort(far, kind="stable")[: min(k, len(names) - 1)]
                yield _edges(np.full(len(some), cell), names[some], far[some])

    return run


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each row's edges, without repeats."""
    kept = edges.groupBy("row").agg(F.slice(F.array_sort(F.collect_set(F.struct("far", "other"))), 1, k).alias("e"))
    return kept.select("row", F.explode("e").alias("e")).select("row", "e.other", "e.far")


def _compare(width: int):
    """From rows (row, other, x of other, reach of other) sorted by row: pairs of others of one row that beat an end's reach."""

    def pairs(names: np.ndarray, x: np.ndarray, reach: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(begins), TOGETHER):
            b, e = begins[lo : lo + TOGETHER], ends[lo : lo + TOGETHER]
            at = b[:, None] + np.arange((e - b).max())
            real = at < e[:, None]
            at = np.where(real, at, b[:, None])
            d = _far(x[at][:, :, None], x[at][:, None])
            better = (d < reach[at][:, :, None]) & real[:, :, None] & real[:, None] & (names[at][:, :, None] != names[at][:, None])
            g, i, j = np.nonzero(better)
            yield _edges(names[at[g, i]], names[at[g, j]], d[g, i, j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            row = table["row"].to_numpy()
            last = int(np.searchsorted(row, row[-1])) if len(row) else 0
            if last:
                yield from whole(table.slice(0, last))
            held = table.slice(last).combine_chunks().to_batches()
        if held:
            yield from whole(pa.Table.from_batches(held))

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        row = table["row"].to_numpy()
        if not len(row):
            return
        begins = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        yield from pairs(table["other"].to_numpy(), matrix(table["x"].combine_chunks(), width), table["reach"].to_numpy(), begins, np.append(begins[1:], len(row)))

    return run


def begin(cells: DataFrame, width: int, k: int, scratch: Scratch) -> DataFrame:
    """The k nearest of each point among the points of its cell and of the CLOSE cells with the nearest means."""
    close = cells.select("cell").mapInArrow(_close(Tree(cells, width)), "cell long, other long")
    return scratch.keep(_search(cells.select(*PACKED), close, cells, k), "edges")


def descend(points: DataFrame, cells: DataFrame, width: int, k: int, scratch: Scratch) -> DataFrame:
    """Nearly always the k nearest of each point (all others, if there are fewer). points: row, x."""
    n = points.count()
    if n < 2:
        return points.sparkSession.createDataFrame([], EDGES)
    edges = begin(cells, width, min(k, n - 1), scratch)
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(MOST_ROUNDS):
        reach = edges.groupBy("row").agg(F.when(F.count("*") >= min(k, n - 1), F.max("far")).otherwise(F.lit(float("inf"))).alias("reach"))
        known = points.select("row", "x").join(reach, "row", "left").select(F.col("row").alias("other"), "x", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
        both = edges.unionByName(edges.select(F.col("other").alias("row"), F.col("row").alias("other"), "far")).distinct()
        few = both.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy("far", "other"))).filter(F.col("rank") <= 2 * k).select("row", "other")
        self_too = few.unionByName(points.select("row", F.col("row").alias("other")))
        candidates = self_too.join(known, "other").repartition(4 * tasks, "row").sortWithinPartitions("row").select("row", "other", "x", "reach")
        better = candidates.mapInArrow(_compare(width), EDGES).distinct()
        found = scratch.keep(better.join(edges.select("row", "other"), ["row", "other"], "left_anti").select("row", "other", "far"), "found")
        more = found.count()
        edges = scratch.keep(_nearest(edges.unionByName(found), k), "edges")
        if more <= SETTLED * n * k:
            break
    return edges


def certify(edges: DataFrame, cells: DataFrame, width: int, k: int, scratch: Scratch) -> DataFrame:
    """The exact k nearest of each point. edges: as many as ``descend`` found."""
    most = min(k, (cells.agg(F.sum("n")).first()[0] or 0) - 1)
    if most < 1:
        return edges
    tree = Tree(cells, width)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names = np.frombuffer(rows, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([cell] * len(names)), pa.array(names)], ["cell", "row"])

    reach = edges.groupBy("row").agg(F.when(F.count("*") >= most, F.max("far")).otherwise(F.lit(float("inf"))).alias("reach"))
    of_cell = cells.select("cell", "rows").mapInArrow(places, "cell long, row long").join(reach, "row", "left")
    balls = of_cell.groupBy("cell").agg(F.collect_list(F.struct("row", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))).alias("balls"))  # a cell's points
    rows = scratch.keep(cells.select(*PACKED).join(balls, "cell"), "balls")

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q = Cell.read(*[batch.column(j)[i].as_py() for j in range(5)])
                of = {b["row"]: b["reach"] for b in batch.column(5)[i].as_py()}
                ball = np.array([of[r] for r in q.rows.tolist()])
                nodes, found = np.array(tree.roots), []
                while len(nodes):
                    gap = _far(q.x[:, None], tree.moments.mean[nodes]) - tree.radius[nodes]
                    nodes = nodes[(gap <= ball[:, None] * (1 + 1e-9) + 1e-12).any(0)]
                    leaf = tree.cell[nodes] >= 0
                    found += tree.cell[nodes[leaf]].tolist()
                    nodes = tree.below[nodes[~leaf]].ravel()
                yield pa.RecordBatch.from_arrays([pa.array([q.cell] * len(found)), pa.array(found, pa.int64())], ["cell", "other"])

    wanted = rows.select(*PACKED, "balls").mapInArrow(reached, "cell long, other long")

    return scratch.keep(_search(rows.select(*PACKED), wanted, cells, most), "exact")


def neighbours(points: DataFrame, width: int, k: int, scratch: Scratch, exact: bool = False) -> DataFrame:
    """points: row, x, weight, label (one label for all; distinct points). Edges of each point to its k nearest, written."""
    cells = make_cells(points, width, scratch)
    edges = descend(points, cells, width, k, scratch)
    return certify(edges, cells, width, k, scratch) if exact else edges
