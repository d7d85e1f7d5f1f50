"""Exact top-k by inner product with block-at-a-time pruning (operator 4).

Rows and queries are put into one global order by their two best pivots (a bounded, deterministic choice of rows; pivots only decide the
order) and their ids, and cut into groups of a bounded size. A group's rows are cut into ranges: the blocks. A block keeps each term's
largest and smallest weight and its forward index (the rows themselves). A query's bound for a block is the sum over terms of the largest
product that the block allows; blocks are visited by falling bound and scored through their forward indexes until the next bound is
below the k-th score.

1. Every query meets its home first, the group that it falls into: that gives it a k-th score to beat. Groups report the bounds of their
   ranges of ``RANGE`` rows.
2. Chunks of queries meet those bounds only. A pair of group and chunk goes on if any query's bound for any of the group's ranges reaches
   its k-th score; the rows of all other groups don't travel to that chunk.
3. In the pairs that are left blocks are visited as above, beginning with the k-th scores from home, and each query's best of all groups are
   merged. Bounds equal to the k-th score are still visited, so ties go to the smaller id.

How much is pruned depends on the vectors: clustered ones fall into few groups, for directions without any structure every bound lies
above every k-th score and all pairs go on (see the README). Groups, chunks and sets of bounds hold a fixed amount of numbers.

Rows whose id or vector is null, and vectors with null or non-finite components, take no part; missing components of shorter
vectors count as 0. Repeated query ids are answered once (with the smallest of their vectors); a query's own id is never among its
results; other repeated rows compete as often as they occur, and many equal vectors are split between groups by their ids. Fewer
candidates than k give fewer rows, an empty table none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize, read_table, tasks_for

#: Numbers in a group, in a chunk of queries and in a set of bounds at most.
GROUP, CHUNK, BOUNDS = 4_000_000, 2_000_000, 2_000_000
#: Queries that visit blocks together, rows of a block, blocks of a query in one wave, rows of a range, rows that serve as pivots.
TOGETHER, BLOCK, WAVE, RANGE, PIVOTS = 1_024, 64, 4, 256, 64
FOUND = "query_id long, vec_id long, score long"
ROW, QUERY, BEST, BOUND = range(4)


def quantized(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, whole numbers as doubles; null if the vector takes no part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    cells = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double"))
    return F.when(sound, cells)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def upper_bounds(queries: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """queries x ranges: no row of a range scores higher."""
    return np.maximum(queries, 0) @ top.T + np.minimum(queries, 0) @ low.T


def best_in_group(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray | None = None, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(number of the query, id, score) of each query's k best of ``rows`` that reach its score in ``kth``, and how many pairs of query and
    block were scored. Rows come in an order that puts like ones together."""
    largest = np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0) * rows.shape[1]
    kind = np.float64 if largest < 2**53 else np.int64  # doubles hold whole numbers to here
    rows, queries = rows.astype(kind), queries.astype(kind)
    lowest = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
    kth = np.full(len(queries), lowest, kind) if kth is None else np.where(kth == np.iinfo(np.int64).min, lowest, kth).astype(kind)
    starts = np.arange(0, len(ids), block)
    top, low = np.maximum.reduceat(rows, starts), np.minimum.reduceat(rows, starts)
    out, visits = [], 0
    for at in range(0, len(queries), TOGETHER):
        part = slice(at, at + TOGETHER)
        number, found, score, n = _visit(ids, rows, starts, top, low, query_ids[part], queries[part], k, kth[part].copy(), block)
        out.append((number + at, found, score))
        visits += n
    return *(np.concatenate(x) for x in zip(*out)), visits


def _visit(ids, rows, starts, top, low, query_ids, queries, k, kth, block):
    bounds = upper_bounds(queries, top, low)
    visit = np.argsort(-bounds, axis=1, kind="stable")
    bounds = np.take_along_axis(bounds, visit, 1)
    number, found, score, visits = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, rows.dtype), 0
    for w in range(0, len(starts), WAVE):
        who, at = np.nonzero(bounds[:, w : w + WAVE] >= kth[:, None])
        if not len(who):
            break
        visits += len(who)
        which = visit[who, w + at]
        new: list[tuple] = [(number, found, score)]
        by_block = np.argsort(which, kind="stable")
        for part in np.split(by_block, np.flatnonzero(np.diff(which[by_block])) + 1):
            q, lo = who[part], starts[which[part[0]]]
            s = queries[q] @ rows[lo : lo + block].T
            i, j = np.nonzero((s >= kth[q][:, None]) & (ids[lo : lo + block] != query_ids[q][:, None]))
            new.append((q[i], ids[lo + j], s[i, j]))
        number, found, score = (np.concatenate(x) for x in zip(*new))
        by = np.lexsort((found, -score, number))
        number, found, score = number[by], found[by], score[by]
        first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        rank = np.arange(len(number)) - np.repeat(first, np.diff(np.append(first, len(number))))
        number, found, score, rank = (x[rank < k] for x in (number, found, score, rank))
        full = rank == k - 1
        kth[number[full]] = np.maximum(kth[number[full]], score[full])
    return number, found, score.astype(np.int64), visits


def _lists(matrix: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(matrix.ravel()))


def _in_order(rows: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """rows (id, v, asks) in the order of their two best pivots and ids."""
    units = (pivots / np.maximum(np.sqrt((pivots**2).sum(1)), 1)[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _matrix(batch.column(1), width) @ units
            c1 = near.argmax(1) if len(near) else np.zeros(0, np.int64)
            near[np.arange(len(near)), c1] = -np.inf
            c2 = near.argmax(1) if len(near) else c1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c1, pa.int32()), pa.array(c2, pa.int32())], ["id", "v", "asks", "c1", "c2"])

    placed = rows.mapInArrow(run, "id long, v array<double>, asks boolean, c1 int, c2 int")
    return placed.repartitionByRange(tasks_for(rows), "c1", "c2", "id", "asks").sortWithinPartitions("c1", "c2", "id", "asks")


def _groups(k: int, width: int, group: int, chunk: int):
    """Cuts the ordered rows into groups. Returned are rows and queries with their group, each query's best of it, and bounds of ranges."""
    names = ["kind", "grp", "part", "id", "other", "score", "v", "low"]

    def batch(kind, grp, part, ids, other=None, score=None, v=None, low=None) -> pa.RecordBatch:
        n = len(ids)
        cell = lambda x, t: pa.nulls(n, t) if x is None else x if isinstance(x, pa.Array) else pa.array(x, t)
        whole = lambda x: pa.array(np.full(n, x), pa.int64())
        numbers = pa.list_(pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind), pa.int32()), whole(grp), whole(part), cell(ids, pa.int64()), cell(other, pa.int64()), cell(score, pa.int64()), cell(v, numbers), cell(low, numbers)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, min(4096, group // max(1, width)))
        part, index, held, numbers, waiting = TaskContext.get().partitionId() << 32, 0, [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, v, asks = (np.concatenate(x) for x in zip(*held))
            grp, rows, query_ids, queries = part + index, v[~asks], ids[asks], v[asks]
            ids, kth = ids[~asks], np.full(asks.sum(), np.iinfo(np.int64).min)
            if len(ids):
                starts = np.arange(0, len(ids), RANGE)
                yield batch(ROW, grp, None, ids, v=_lists(rows))
                yield batch(BOUND, grp, None, np.arange(len(starts)), v=_lists(np.maximum.reduceat(rows, starts)), low=_lists(np.minimum.reduceat(rows, starts)))
            if len(ids) and len(query_ids):
                number, found, score, _ = best_in_group(ids, rows, query_ids, queries, k)
                last = np.bincount(number, minlength=len(query_ids)) >= k
                kth[last] = score[np.cumsum(np.bincount(number, minlength=len(query_ids)))[last] - 1]
                yield batch(BEST, grp, None, query_ids[number], found, score)
            if len(query_ids):
                yield batch(QUERY, grp, part + waiting * width // chunk, query_ids, score=kth, v=_lists(queries))

        for b in batches:
            for at in range(0, b.num_rows, step):
                piece = b.slice(at, step)
                held.append((piece.column(0).to_numpy(), _matrix(piece.column(1), width), np.array(piece.column(2).to_pylist(), bool)))
                numbers += piece.num_rows * width
                if numbers >= group:
                    yield from flush()
                    waiting += sum(int(x[2].sum()) for x in held)
                    index, held, numbers = index + 1, [], 0
        if held:
            yield from flush()

    return run


def _survivors(bounds: pa.Table, queries: pa.Table) -> pa.Table:
    """Pairs of group and chunk in which a query's bound reaches its k-th score; its home is done."""
    out = set()
    if bounds.num_rows and queries.num_rows:
        width = len(queries["v"][0])
        top, low, grp = _matrix(bounds["v"], width), _matrix(bounds["low"], width), bounds["grp"].to_numpy()
        asked, home, kth, chunk = _matrix(queries["v"], width), queries["grp"].to_numpy(), queries["score"].to_numpy(), queries["chunk"][0].as_py()
        for at in range(0, len(asked), TOGETHER):
            part = slice(at, at + TOGETHER)
            # sums of bounds are whole numbers; beyond what doubles hold a little is added
            reach = upper_bounds(asked[part], top, low)
            on = (reach + np.abs(reach) * 2.0**-50 >= kth[part][:, None]) & (home[part][:, None] != grp)
            out |= {(g, chunk) for g in np.unique(grp[on.any(0)]).tolist()}
    return pa.table({"grp": pa.array([g for g, _ in out], pa.int64()), "chunk": pa.array([c for _, c in out], pa.int32())})


def _searcher(k: int):
    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if rows.num_rows and queries.num_rows:
            queries = queries.filter(pa.array(queries["grp"].to_numpy() != queries["home"].to_numpy()))
        if rows.num_rows and queries.num_rows:
            width, query_ids, kth = len(rows["v"][0]), queries["id"].to_numpy(), queries["score"].to_numpy()
            order = np.argsort(rows["place"].to_numpy(), kind="stable")
            number, found, score, _ = best_in_group(rows["id"].to_numpy()[order], _matrix(rows["v"], width)[order], query_ids, _matrix(queries["v"], width), k, kth)
            return pa.table({"query_id": query_ids[number], "vec_id": found, "score": score})
        return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})

    return search


def grouped(vectors: DataFrame, queries: DataFrame, k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the table of ``_groups``, the queries with their chunks, pairs of group and chunk that go on)."""
    width = vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    both = scratch.keep(vectors.select("id", "v", F.lit(False).alias("asks")).unionByName(queries.select("id", "v", F.lit(True).alias("asks"))), "both")
    pivots = both.filter("NOT asks").orderBy(F.xxhash64("id", "v"), "id").limit(PIVOTS).collect()
    matrix = np.zeros((max(1, len(pivots)), width))
    for i, r in enumerate(pivots):
        matrix[i, : len(r["v"])] = r["v"]
    parts = "kind int, grp long, part long, id long, other long, score long, v array<double>, low array<double>"
    table = scratch.keep(_in_order(both, matrix, width).mapInArrow(_groups(k, width, GROUP, CHUNK), parts), "groups").withColumn("place", F.monotonically_increasing_id())
    asked = table.filter(F.col("kind") == QUERY)
    sizes = asked.groupBy("part").agg((F.count("*") * max(1, width)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each full chunk of a task
    chunks = sizes.select("part", F.floor(F.coalesce(before, F.lit(0)) / CHUNK).cast("int").alias("chunk"))
    asked = scratch.keep(asked.join(F.broadcast(chunks), "part").select("grp", "chunk", "id", "v", "score"), "queries")
    bounds = table.filter(F.col("kind") == BOUND).select("grp", "v", "low")
    n_chunks = (chunks.agg(F.max("chunk")).first()[0] or 0) + 1
    n_sets = -(-max(1, bounds.count() * 2 * width) // BOUNDS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sets = bounds.select("*", F.pmod(F.xxhash64("grp"), F.lit(n_sets)).cast("int").alias("set"), every(n_chunks).alias("chunk")).groupBy("set", "chunk")
    tiles = sets.cogroup(asked.select("*", every(n_sets).alias("set")).groupBy("set", "chunk")).applyInArrow(_survivors, "grp long, chunk int")
    return table, asked, scratch.keep(tiles, "pairs")


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Both: id long, v array<double> of whole numbers. Returns query_id, rank (from 1), vec_id, score."""
    scratch = Scratch(vectors.sparkSession, "top-k")
    table, asked, tiles = grouped(vectors, queries, k, scratch)
    rows = table.filter(F.col("kind") == ROW).select("grp", "id", "v", "place").join(tiles, "grp")
    asked = asked.withColumnRenamed("grp", "home").join(tiles, "chunk")
    best = rows.groupBy("grp", "chunk").cogroup(asked.groupBy("grp", "chunk")).applyInArrow(_searcher(k), FOUND)
    best = best.unionByName(table.filter(F.col("kind") == BEST).select(F.col("id").alias("query_id"), F.col("other").alias("vec_id"), "score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most k of each pair
    out = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    out = materialize(out, "top-k")
    scratch.drop()
    return out


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), quantized(F.col("embedding")).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    return top_k(rows, rows.filter("id % 50 = 0"), 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
