"""A two-dimensional layout of points that keeps neighbours together.

The neighbour graph (exact, ``balls``) gets fuzzy weights: each point's distances, less the nearest one, are scaled by a width found by
bisection so that its weights add up to log2 of the number of neighbours; the two weights of a pair are joined as a probabilistic union. The
layout begins with the two main directions and moves by stochastic gradient descent: neighbours attract each other by weight, randomly drawn
points repel. It goes in rounds: points are dealt by their place in the layout, so that most neighbours meet in one task, each task
moves its points many times against each other and against the other points as they lay at the round's begin, and the next round deals them
along other borders. Random numbers depend on the seed, round and part only.

More points than one part begin from a layout of the means of their cells (``cells``), each near the mean next to it, and go through the last
half of the rounds only. That layout is widened as the points outnumber the cells: sheets of points that main directions fold onto each other
come apart among the means, and points that lie as thin as the means did stay apart, whatever their number.

Copies of a point share its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SEED
from ..scratch import Scratch
from .balls import nearer, nearest
from .cells import PACKED, Cell, Router, Tree, make_cells, weighted
from .neighbours import CLOSE, EDGES, begin, means_apart, neighbours

NEIGHBOURS, LEAST_GAP, SPREAD = 15, 0.1, 1.0
ROUNDS, EPOCHS, REPELLED, STEPS = 4, 60, 5, 8
#: Points that one task moves at most, about; points of the whole layout that each task sees.
PART, SEEN = 20_000, 4_000
#: Power of the squared distance by which near means outweigh others in a point's first place.
SHARP = 8


def falloff(least: float = LEAST_GAP, spread: float = SPREAD) -> tuple[float, float]:
    """a, b of 1 / (1 + a d^(2b)), fitted to 1 up to ``least`` and exp(-(d - least) / spread) beyond."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(d < least, 1.0, np.exp(-(d - least) / spread))
    p = np.array([1.0, 1.0])
    for _ in range(100):
        u = d ** (2 * p[1])
        f = 1 / (1 + p[0] * u)
        slope = np.stack((-u * f**2, -2 * p[0] * u * np.log(d) * f**2), 1)
        p = p - np.linalg.lstsq(slope, f - y, rcond=None)[0]
    return float(p[0]), float(p[1])


def fuzzy(far: np.ndarray, steps: int = 64) -> np.ndarray:
    """Weights of sorted distances: points x neighbours, inf where there is none."""
    known = np.isfinite(far)
    nearest = np.where(known & (far > 0), far, np.inf).min(1)
    gap = np.maximum(far - np.where(np.isfinite(nearest), nearest, 0)[:, None], 0)
    want = np.log2(np.maximum(known.sum(1), 2))
    low, high = np.zeros(len(far)), np.full(len(far), np.inf)
    width = np.ones(len(far))
    for _ in range(steps):
        total = np.where(known, np.exp(-gap / width[:, None]), 0).sum(1)
        more = total < want
        low, high = np.where(more, width, low), np.where(more, high, width)
        width = np.where(np.isfinite(high), (low + high) / 2, 2 * width)
    mean = np.where(known, far, 0).sum(1) / np.maximum(known.sum(1), 1)
    return np.where(known, np.exp(-gap / np.maximum(width, 1e-3 * np.maximum(mean, 1e-12))[:, None]), 0)


def fuzzy_edges(edges: DataFrame, k: int) -> DataFrame:
    """row, other, w: both directions of every edge with its joint weight."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, rows = batch.column(1), batch.column(0).to_numpy()
            counts = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            far, other = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            at = np.arange(k) < counts[:, None]
            table = np.full((len(rows), k), np.inf)
            table[at] = far
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, counts)), pa.array(other), pa.array(fuzzy(table)[at])], ["row", "other", "w"])

    lists = edges.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("far", "other"))).alias("e"))  # k edges of a row
    one = lists.mapInArrow(weigh, "row long, other long, w double")
    pair = one.select(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b"), "w").groupBy("a", "b")
    joint = pair.agg((F.sum("w") - F.when(F.count("*") > 1, F.min("w") * F.max("w")).otherwise(0.0)).alias("w"))
    return joint.select(F.explode(F.array(F.struct(F.col("a").alias("row"), F.col("b").alias("other"), "w"), F.struct(F.col("b").alias("row"), F.col("a").alias("other"), "w"))).alias("e")).select("e.*")


def _noise(n: int, seed: int) -> Column:
    return (F.pmod(F.xxhash64("row", F.lit(seed), F.lit(n)), F.lit(10_007)) / 10_007.0 - 0.5) * 1e-3


def _start(points: DataFrame, width: int, seed: int) -> DataFrame:
    """row, px, py: the two main directions, drawn to a deviation of 5, with a little noise by row."""
    x = lambda i: F.col("x")[i]
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    row = points.agg(*[F.avg(x(i)).alias(f"m{i}") for i in range(width)], *[F.covar_pop(x(i), x(j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    mean, cov = np.array([row[f"m{i}"] or 0.0 for i in range(width)]), np.zeros((width, width))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    values, vectors = np.linalg.eigh(cov)
    main = [(vectors[:, -1 - i], np.sqrt(max(values[-1 - i], 0))) if i < width else (np.zeros(width), 0.0) for i in range(2)]

    def place(v: np.ndarray, s: float, n: int):
        v = v * np.sign(v[np.abs(v).argmax()] or 1.0) * (5 / s if s > 0 else 0.0)
        return (sum(((x(i) - float(mean[i])) * float(v[i]) for i in range(width)), F.lit(0.0)) + _noise(n, seed)).cast("double")

    return points.select("row", place(*main[0], 0).alias("px"), place(*main[1], 1).alias("py"))


def move(places: np.ndarray, head: np.ndarray, tail: np.ndarray, fixed: np.ndarray, w: np.ndarray, seen: np.ndarray, share: float, epochs: range, total: int, curve: tuple[float, float], rng: np.random.Generator, top: float) -> np.ndarray:
    """Moves ``places`` along edges head -> tail; tails from len(places) on are rows of ``fixed``, which don't move. A part ``share`` of what
    repels is drawn from the places, the rest from ``seen``."""
    a, b = curve
    n, drawn = len(places), len(places) + len(fixed)
    table = np.concatenate((places, fixed, seen)).astype(np.float32)  # of which a step needs no more; the first n move
    every = top / np.maximum(w, top / total)
    due = every * rng.random(len(w)) + epochs.start

    a, b, tiny = np.float32(a), np.float32(b), np.float32(1e-12)

    def power(d2: np.ndarray) -> np.ndarray:
        return np.exp(b * np.log(np.maximum(d2, tiny)))

    def push(at: np.ndarray, by: np.ndarray) -> None:
        for c in range(2):
            table[:n, c] += np.bincount(at, by[..., c], n)

    for epoch in epochs:
        rate = 1 - epoch / total
        active = np.flatnonzero(due <= epoch)
        due[active] += every[active]
        for part in np.array_split(rng.permutation(active), STEPS):
            if not len(part):
                continue
            at = head[part]
            gap = table[at] - table[tail[part]]
            d2 = (gap * gap).sum(1)
            p = power(d2)
            gap *= np.where(d2 > 0, -2 * a * b * p / (np.maximum(d2, tiny) * (1 + a * p)), np.float32(0))[:, None]
            push(at, np.clip(gap, -4, 4, out=gap) * np.float32(rate))
            u = rng.random((len(at), REPELLED))
            other = np.where(u < share, np.minimum(u * (n / share), n - 1), np.minimum(drawn + (u - share) * (len(seen) / max(1 - share, 1e-12)), len(table) - 1)).astype(np.int64)
            gap = table[at][:, None] - table[other]
            d2 = gap[..., 0] * gap[..., 0] + gap[..., 1] * gap[..., 1]
            gap *= np.where(d2 > 0, 2 * b / ((np.float32(0.001) + d2) * (1 + a * power(d2))), np.float32(0))[..., None]
            np.clip(gap, -4, 4, out=gap)
            push(at, np.stack([gap[..., c].sum(1) for c in range(2)], 1) * np.float32(rate))
    return table[:n].astype(float)


PLACES = "row long, px double, py double"


def _mover(n: int, seen: np.ndarray, epochs: range, total: int, top: float, seed: int):
    """Moves the points of one part; n: points in all."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows, first, head = np.unique(table["row"].to_numpy(), return_index=True, return_inverse=True)
        places = np.stack([table[c].to_numpy()[first] for c in ("px", "py")], 1)
        real = table["other"].is_valid().to_numpy()
        other = table["other"].fill_null(-1).to_numpy()[real]
        w, ox, oy = (table[c].to_numpy()[real].astype(float) for c in ("w", "ox", "oy"))
        head = head[real]
        order = np.lexsort((other, head))
        head, other, w, ox, oy = (v[order] for v in (head, other, w, ox, oy))
        tail = np.minimum(np.searchsorted(rows, other), len(rows) - 1)
        far = rows[tail] != other
        tail[far] = len(rows) + np.arange(far.sum())
        rng = np.random.default_rng([seed, epochs.start, key[0].as_py()])
        places = move(places, head, tail, np.stack((ox[far], oy[far]), 1), w, seen, len(rows) / n, epochs, total, falloff(), rng, top)
        return pa.table({"row": rows, "px": places[:, 0], "py": places[:, 1]})

    return work


def lay_out(points: DataFrame, edges: DataFrame, width: int, scratch: Scratch, seed: int = SEED, rounds: int = ROUNDS, epochs: int = EPOCHS, begun: DataFrame | None = None) -> DataFrame:
    """row, px, py of each point. edges: row, other, w in both directions. begun: places from which the last half of the rounds goes on."""
    n = points.count()
    now = scratch.keep(_start(points, width, seed) if begun is None else begun, "places")
    top = edges.agg(F.max("w")).first()[0]
    if top is None:
        return now
    for r in range(0 if begun is None else rounds // 2, rounds):
        seen = np.array([[p["px"], p["py"]] for p in now.orderBy(F.xxhash64("row", F.lit(seed), F.lit(r))).limit(SEEN).collect()])
        turn = np.array([[np.cos(r), -np.sin(r)], [np.sin(r), np.cos(r)]])
        route = Router(seen @ turn.T, -(-n // PART))

        def deal(batches: Iterator[pa.RecordBatch], route=route, turn=turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                xy = np.stack([batch.column(j).to_numpy() for j in (1, 2)], 1)
                yield pa.RecordBatch.from_arrays([pa.array(route(xy @ turn.T), pa.int64()), *batch.columns], ["part", *batch.schema.names])

        dealt = now.mapInArrow(deal, "part long, " + PLACES)
        there = now.select(F.col("row").alias("other"), F.col("px").alias("ox"), F.col("py").alias("oy"))
        full = dealt.join(edges.join(there, "other"), "row", "left")

        now = scratch.keep(full.select("part", "row", "px", "py", "other", "w", "ox", "oy").groupBy("part").applyInArrow(_mover(n, seen, range(r * epochs, (r + 1) * epochs), rounds * epochs, top, seed), PLACES), "places")
    return now


def _among_means(cells: DataFrame, n: int, width: int, k: int, scratch: Scratch, seed: int, **layout) -> DataFrame:
    """row, px, py of the n points of the cells, by a layout of the cells' means. The driver gets a row for each cell."""
    tree = Tree(cells, width)
    points = scratch.keep(cells.select(F.col("cell").alias("row"), F.slice("moments", 1, width).alias("x")), "means")
    edges = scratch.keep(fuzzy_edges(points.select("row").mapInArrow(means_apart(tree, k), "row long, other long, far double"), k), "weights")
    placed = lay_out(points, edges, width, scratch, seed, **layout).toPandas().set_index("row")
    leaves = np.flatnonzero(tree.cell >= 0)
    names, means = tree.cell[leaves], tree.moments.mean[leaves]
    wide = float(np.sqrt(n / len(names)))
    places = wide * placed.loc[names, ["px", "py"]].to_numpy()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = Cell.read(*[batch.column(j)[i].as_py() for j in range(5)])
                some = np.argsort(((means - means[names == cell.cell]) ** 2).sum(1), kind="stable")[: CLOSE + 1]
                d = np.maximum(((cell.x[:, None] - means[some]) ** 2).sum(2), 1e-100)
                w = (d.min(1, keepdims=True) / d) ** SHARP
                xy = w / w.sum(1, keepdims=True) @ places[some]
                yield pa.RecordBatch.from_arrays([pa.array(cell.rows), pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["row", "px", "py"])

    near = cells.select(*PACKED).mapInArrow(place, PLACES)
    return near.select("row", *[(F.col(c) + _noise(i, seed) * wide).alias(c) for i, c in enumerate(("px", "py"))])


def embedding_projection(points: DataFrame, columns: list[str], k: int = NEIGHBOURS, seed: int = SEED, **layout) -> DataFrame:
    """points with dim_x, dim_y. columns: scaled numbers; nulls count as 0. A table without rows stays without; a single point lies at the
    origin, nearly."""
    scratch = Scratch(points.sparkSession, "embedding")
    try:
        width = len(columns)
        x = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns])
        rest = [c for c in points.columns if c not in ("dim_x", "dim_y")]
        kept = scratch.keep(points.select(*[F.col(f"`{c}`") for c in rest], F.transform(x, lambda v: v + F.lit(0.0)).alias("_x")), "given")
        distinct = weighted(kept, F.col("_x"), F.lit(0), scratch)
        cells, n = make_cells(distinct, width, scratch), distinct.count()
        edges = scratch.keep(fuzzy_edges(_closest(cells, width, k, scratch), k), "weights")
        begun = _among_means(cells, n, width, k, scratch, seed, **layout) if n > PART else None
        places = lay_out(distinct, edges, width, scratch, seed, **layout, begun=begun)
        named = distinct.select("row", F.col("x").alias("_x")).join(places, "row").select("_x", F.col("px").alias("dim_x"), F.col("py").alias("dim_y"))
        out = Scratch(points.sparkSession, "layout")
        return out.keep(kept.join(named, "_x").select(*[F.col(f"`{c}`") for c in rest], "dim_x", "dim_y"), "layout")
    finally:
        scratch.drop()


def neighbour_distances(points: DataFrame, columns: list[str], k: int) -> DataFrame:
    """x (the columns), rank (from 1), far: the exact distances from each distinct point to its k nearest distinct others."""
    scratch = Scratch(points.sparkSession, "neighbours")
    try:
        x = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns])
        distinct = weighted(points, x, F.lit(0), scratch)
        found = neighbours(distinct, len(columns), k, scratch, exact=True)
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy("far", "other")))
        return Scratch(points.sparkSession, "distances").keep(distinct.select("row", "x").join(ranked, "row").select("x", "rank", "far"), "distances")
    finally:
        scratch.drop()


def _closest(cells: DataFrame, width: int, k: int, scratch: Scratch) -> DataFrame:
    """row, other, far: the exact k nearest of each point (all others, if there are fewer)."""
    n = cells.agg(F.sum("n")).first()[0] or 0
    k = min(k, n - 1)
    if k < 1:
        return cells.sparkSession.createDataFrame([], EDGES)
    some = begin(cells, width, k, scratch)
    return nearest(cells, width, k, some.groupBy("row").agg(F.when(F.count("*") >= k, F.max("far")).otherwise(F.lit(float("inf"))).alias("reach")), scratch)


def trustworthiness(points: DataFrame, columns: list[str], dims: tuple[str, str] = ("dim_x", "dim_y"), k: int = NEIGHBOURS) -> float:
    """How far the neighbours in the layout are neighbours among ``columns`` too (1: all are), over all rows, each compared with all rows; of
    rows equally near in the layout, copies come first. Copies count with their number."""
    array = lambda names: F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) + F.lit(0.0) for c in names])
    scratch = Scratch(points.sparkSession, "trust")
    try:
        counted = points.select(array(columns).alias("x"), array(dims).alias("y")).groupBy("x", "y").agg(F.count("*").cast("double").alias("weight"))
        both = scratch.keep(counted.select(F.monotonically_increasing_id().alias("row"), "x", "y", "weight", F.lit(0).alias("label")), "both")
        n = int(both.agg(F.sum("weight")).first()[0] or 0)
        if n < 3 * k:
            k = max(1, n // 3)
        if n < 4:
            return 1.0
        near = _closest(make_cells(both.select("row", F.col("y").alias("x"), "weight", "label"), 2, scratch), 2, k, scratch)
        other = near.join(both.select(F.col("row").alias("other"), F.col("x").alias("ox"), F.col("weight").alias("ow")), "other").join(both.select("row", "x", "weight"), "row")
        # Of the k places the row's own copies take the first ones, at distance 0.
        before = F.col("weight") - 1 + F.coalesce(F.sum("ow").over(Window.partitionBy("row").orderBy("far", "other").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        taken = other.withColumn("many", F.least(F.col("ow"), k - before)).filter(F.col("many") > 0)
        apart = F.sqrt(F.aggregate(F.zip_with("x", "ox", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)) * (1 - 1e-12)
        lists = taken.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(apart.alias("d"), "many"))).alias("e"))  # at most k of a row
        # Lists shorter than k begin with distances of 0, nearer than which nothing lies.
        filled = scratch.keep(lists.select("row", F.concat(F.array_repeat(F.lit(0.0), k - F.size("e")), F.col("e")["d"]).alias("limits"), F.concat(F.array_repeat(F.lit(0.0), k - F.size("e")), F.col("e")["many"]).alias("many")), "limits")
        places = both.join(filled, "row", "left").select("row", "x", "weight", "label", F.coalesce("limits", F.array_repeat(F.lit(0.0), k)).alias("limits"))
        found = nearer(make_cells(both.select("row", "x", "weight", "label"), len(columns), scratch), len(columns), places.select("row", "limits"), scratch)
        # The row itself counts among the nearer ones, so that the count is the rank.
        loss = F.aggregate(F.zip_with("counts", "many", lambda c, m: F.greatest(c - k, F.lit(0.0)) * m), F.lit(0.0), lambda a, b: a + b)
        lost = found.join(filled, "row").join(both.select("row", "weight"), "row").agg(F.sum(loss * F.col("weight")).alias("lost")).first()["lost"] or 0.0
        return 1 - 2 * lost / (n * k * (2 * n - 3 * k - 1))
    finally:
        scratch.drop()
