"""Near-duplicate groups by SetSketch (operator 7).

A document's set holds its distinct shingles of five words (words: runs of anything but ASCII white space, A-Z lower-cased); with
fewer words the whole sequence is the only shingle. Documents are linked if 100 * |A and B| >= percent * |A or B|; a component is
everything that links reach.

1. Documents with equal sets (128-bit hash) share one representative with a number of its own; only representatives go on.
2. Each set gets a SetSketch: register i is floor(1 - log_b x), x the minimum of exponentially distributed hashes of the elements,
   truncated to 16 bits. Sketches of unions are register-wise maxima; with b near 1 two registers agree about as often as sets do.
   Beside it lie the parities of ``PARITIES`` hashed cells: cells of odd difference never outnumber the elements that only one of
   two sets has, so too many of them prove that a pair isn't linked.
3. Registers are banded. Rows (band value, representative) are sorted by ranges, so a bucket of any size spreads over tasks, and the
   sorted rows are read as a stream. Each bucket's members are compared with its first member only, later with one member of each
   component: inside a component no further pair is made.
4. Compared pairs pass a joint maximum-likelihood estimate of the similarity from both sketches (pairs under the limit by more than
   five standard deviations end here) and the parities, and are then verified on their whole sets.
5. Components grow by hooking and pointer jumping on tables. Rounds repeat while they link a hundredth of the members. At the end all
   remaining pairs between different components of a bucket are compared by their sketches, block against block of a bucket, and
   those that may be linked are verified, so no bucket or candidate is capped.

With 32 bands of 6 registers a pair at the limit 0.85 is missed with a probability of about 3e-7, at 0.8 of about 5e-5 (unless other
links join it anyway).

Null and empty texts, and texts of white space only, have an empty set: they are linked with nothing and are kept. Rows with a null
doc_id are linked with nothing; their component_id is null and they are kept. Repeated rows are equal sets and stay in the result; rows
that share a doc_id but not the text are documents of their own, each with its component. Long texts are hashed whole, sketches and
sets in bounded pieces. An empty table gives no rows. Only doc_id and text are read, so other columns may have any name. All tables but
the result are deleted at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, materialize, read_table, slices, tasks_for, unique_columns
from .hashing import mixed, run_hashes

SHINGLE, BANDS, ROWS = 5, 32, 6
BASE, RATE, TOP = 1.001, 20.0, 65_534
MARGIN = 5.0
PARITIES = 2_048
#: Members of a bucket's block, blocks of a bucket unless that makes larger ones than the largest.
BLOCK, COPIES, LARGEST = 512, 64, 8_192
_RNG = np.random.default_rng(2024)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)
_PLACES = _RNG.integers(0, 1 << 63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(0, 1 << 63, (2, BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Each text's set as sorted distinct 64-bit hashes."""
    raw = [t.encode().lower() for t in texts]  # bytes.lower changes A-Z only
    bases = np.append(0, np.cumsum([len(r) + 1 for r in raw]))
    codes = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (~_BLANK[codes]).view(np.int8), [0]))))
    a, b = edge[::2], edge[1::2]
    words = mixed(run_hashes(codes, a, b))
    first = np.searchsorted(a, bases)
    n = np.diff(first)
    whole = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        whole += words[k : k + len(whole)] * _PLACES[k]
    whole = mixed(whole)
    out = []
    for at, count in zip(first[:-1].tolist(), n.tolist()):
        if count >= SHINGLE:
            out.append(np.unique(whole[at : at + count - SHINGLE + 1]))
        else:
            out.append(mixed((words[at : at + count] * _PLACES[:count]).sum(keepdims=True) + np.uint64(count) * _PLACES[-1]) if count else words[:0])
    return out


def sketch(elements: np.ndarray) -> np.ndarray:
    """Registers of a set of 64-bit hashes."""
    least = np.full(len(_FACTORS), ~np.uint64(0))
    for at in range(0, len(elements), 1024):
        np.minimum(least, (elements[at : at + 1024, None] * _FACTORS + _SHIFTS).min(0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def parities(elements: np.ndarray) -> np.ndarray:
    """Bits of the cells that hold an odd number of elements."""
    return np.packbits(np.bincount((elements >> np.uint64(20)).astype(np.int64) % PARITIES, minlength=PARITIES).astype(np.uint8) & 1)


def possible(odd: np.ndarray, na: np.ndarray, nb: np.ndarray, limit: float) -> np.ndarray:
    """Whether sets of these sizes whose parities differ in ``odd`` cells may have the similarity ``limit``."""
    return odd <= (na + nb) * (1 - limit) / (1 + limit) + 1e-6


WIDTH = 2 * BANDS * ROWS


def unpacked(column: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Registers and parities of rows of sketches."""
    both = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)
    return np.ascontiguousarray(both[:, :WIDTH]).view(np.uint16), both[:, WIDTH:]


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarities; a, b: pairs x registers, na, nb: set sizes. Bisection on the derivative of the likelihood of
    how many registers are larger in a, larger in b, equal."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    c, log_b = (BASE - 1) / BASE, np.log(BASE)
    p = lambda z: -np.log1p(-np.clip(z, 1e-12, 1) * c) / log_b
    slope = lambda z: c / (1 - np.clip(z, 1e-12, 1) * c) / log_b
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):
        j = (low + high) / 2
        p1, p2 = p(u - v * j), p(v - u * j)
        d1, d2 = -v * slope(u - v * j), -u * slope(v - u * j)
        up = more * d1 / p1 + less * d2 / p2 - same * (d1 + d2) / np.maximum(1 - p1 - p2, 1e-12) > 0
        low, high = np.where(up, j, low), np.where(up, high, j)
    return (low + high) / 2


def band_keys(registers: np.ndarray) -> np.ndarray:
    """rows x BANDS: a 64-bit value of each band's registers."""
    r = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    return mixed((mixed(r * _BAND[0]) * _BAND[1]).sum(2) + np.arange(BANDS, dtype=np.uint64))


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names.split())


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (hash of the set), sketch (registers and parities; null for empty sets), h (hash of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, most=500_000):
                sets = shingle_sets(texts[a:b])
                k1, k2 = zip(*map(_set_hash, sets))
                both = pa.array([sketch(s).tobytes() + parities(s).tobytes() if len(s) else None for s in sets], pa.binary())
                yield _batch("doc_id n_shingles k1 k2 sketch h", batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), both, batch.column(2).slice(a, b - a))

    rows = unique_columns(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, sketch binary, h long")


def _bands(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(unpacked(batch.column(1).to_pylist())[0])
                yield _batch("key id", keys.view(np.int64).ravel(), np.repeat(batch.column(0).to_numpy(), BANDS))

    return reps.select("id", "sketch").mapInArrow(run, "key long, id long")


#: Writes a table under a name and reads it back.
Keep = Callable[[DataFrame, str], DataFrame]


def _sorted(rows: DataFrame, *by: str) -> DataFrame:
    return rows.repartitionByRange(tasks_for(rows), *by).sortWithinPartitions(*by)


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of buckets with several members, and every row at the edge of a task (whose bucket may go on in the next task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far, and whether it is surely kept
        kept = True
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            same = np.append(False, key[1:] == key[:-1])
            keep = same | np.append(same[1:], False)
            if held is None:
                keep[0] = True
            else:
                goes_on = held.column(0)[0].as_py() == key[0]
                if kept or goes_on:
                    yield held
                keep[0] |= goes_on
            if batch.num_rows > 1:
                yield batch.filter(pa.array(np.append(keep[:-1], False)))
            held, kept = batch.slice(batch.num_rows - 1, 1), bool(keep[-1])
        if held is not None:
            yield held

    return _sorted(rows, "key", "id").mapInArrow(run, "key long, id long")


def _one_per_component(rows: DataFrame, name: str, keep: Keep) -> DataFrame:
    """rows: key, id, comp. Pairs (a < b) of one member of each bucket's first component with one member of each other component; which
    members differs from bucket to bucket and from call to call. Tasks report their first and last bucket, and the driver joins
    buckets that span tasks (two rows for each task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, lead, last, first = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, comp, ids = (batch.column(i).to_numpy() for i in (0, 1, 3))
            new_key = np.append(last is None or last[0] != key[0], key[1:] != key[:-1])
            new_comp = new_key | np.append(last is None or last[1] != comp[0], comp[1:] != comp[:-1])
            if first is None:
                first = (int(key[0]), int(ids[0]), int(comp[0]))
            at = np.flatnonzero(new_key)
            leaders = np.append(lead[1] if lead else 0, ids[at])[np.cumsum(new_key)]
            comps = np.append(lead[2] if lead else 0, comp[at])[np.cumsum(new_key)]
            hit = new_comp & ~new_key & (comps != comp)
            if hit.any():
                yield _batch("a b task edge key comp", np.minimum(leaders, ids)[hit], np.maximum(leaders, ids)[hit], pa.nulls(int(hit.sum()), pa.int32()), pa.nulls(int(hit.sum()), pa.int32()), pa.nulls(int(hit.sum()), pa.int64()), pa.nulls(int(hit.sum()), pa.int64()))
            if len(at):
                lead = (int(key[at[-1]]), int(ids[at[-1]]), int(comp[at[-1]]))
            last = (int(key[-1]), int(comp[-1]))
        if first is not None:
            yield _batch("a b task edge key comp", [first[1], lead[1]], [0, 0], pa.array([task] * 2, pa.int32()), pa.array([0, 1], pa.int32()), [first[0], lead[0]], [first[2], lead[2]])

    spark = rows.sparkSession
    ordered = _sorted(rows.select("key", "comp", F.xxhash64("id", "key", F.lit(name)).alias("turn"), "id"), "key", "comp", "turn", "id")
    found = keep(ordered.mapInArrow(run, "a long, b long, task int, edge int, key long, comp long"), name)
    edges = sorted(found.filter("task IS NOT NULL").select("task", "edge", "key", "a", "comp").collect())
    ends: list[tuple[int, int]] = []
    lead = None
    for (_, _, key, a, comp), (_, _, last_key, last_a, last_comp) in zip(edges[::2], edges[1::2]):
        if lead and lead[0] == key:
            if lead[2] != comp and lead[1] != a:
                ends.append((min(lead[1], a), max(lead[1], a)))
            if last_key == key:
                continue
        lead = (last_key, last_a, last_comp)
    pairs = found.filter("task IS NULL").select("a", "b")
    return pairs.unionByName(spark.createDataFrame(ends, "a long, b long")) if ends else pairs


def _between_components(rows: DataFrame, members: DataFrame, limit: float, keep: Keep) -> DataFrame:
    """All pairs of members of different components that share a bucket and may be linked; rows: key, id, comp. Buckets are dealt into
    blocks of about BLOCK members, and a task sees two blocks at a time; a pair comes from the first band that it shares only."""
    keys = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).filter("lo < hi")
    pieces = F.greatest(F.least(F.ceil(F.col("size") / BLOCK), F.lit(COPIES)), F.ceil(F.col("size") / LARGEST))  # a sketch travels so often
    keys = keep(keys.select("key", pieces.cast("int").alias("blocks")), "mixed")
    rows = keep(rows.join(keys, "key"), "mixed-rows")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = rows.join(members, "id").select("key", "id", "comp", "n", "sketch", own.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "comp", "n", "sketch")
    least = _least(limit)

    def compare(part: pa.Table) -> pa.Table:
        key, p, q = (part.column(i)[0].as_py() for i in range(3))
        block, ids, comp, n = (part.column(i).to_numpy() for i in range(3, 7))
        registers, odd = unpacked(part.column(7).to_pylist())
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        found = []
        for at in range(0, len(left), 32):
            x = left[at : at + 32]
            for to in range(0, len(right), 256):
                y = right[to : to + 256]
                i, j = np.nonzero(comp[x][:, None] != comp[y])
                i, j = x[i], y[j]
                if p == q:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                on = possible(np.bitwise_count(odd[i] ^ odd[j]).sum(1, dtype=np.int64), n[i], n[j], limit)
                i, j = i[on], j[on]
                if len(i):
                    shared = (registers[i] == registers[j]).reshape(len(i), BANDS, ROWS).all(2).argmax(1)
                    on = (band_keys(registers[i]).view(np.int64)[np.arange(len(i)), shared] == key) & (joint_estimate(registers[i], registers[j], n[i], n[j]) >= least)
                    found.append((ids[i[on]], ids[j[on]]))
        a, b = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.groupBy("key", "p", "q").applyInArrow(compare, "a long, b long")


def _least(limit: float) -> float:
    return limit - MARGIN * float(np.sqrt(limit * (1 - limit) / (BANDS * ROWS)))


def _likely(pairs: DataFrame, members: DataFrame, limit: float) -> DataFrame:
    """Pairs whose parities allow a link and whose estimated similarity isn't surely below ``limit``."""
    least = _least(limit)
    side = lambda k: members.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, na, nb = (batch.column(i).to_numpy() for i in range(4))
                (ra, oa), (rb, ob) = (unpacked(batch.column(i).to_pylist()) for i in (4, 5))
                on = possible(np.bitwise_count(oa ^ ob).sum(1, dtype=np.int64), na, nb, limit) & (joint_estimate(ra, rb, na, nb) >= least)
                yield _batch("a b", a[on], b[on])

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    return (int(s.sum().astype(np.int64)), int(mixed(s ^ _PLACES[0]).sum().astype(np.int64))) if len(s) else (0, 0)


def _whole_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """id, elements: the members' sets, made from the texts of their doc_id and text hash that have the set's hash. Rows that only share a
    doc_id don't meet each other's members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column(3).to_pylist(), list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            for a, b in slices(texts, most=500_000):
                found = [(i, s) for i, s in enumerate(shingle_sets(texts[a:b]), a) if _set_hash(s) == wanted[i]]
                yield _batch("id elements", batch.column(0).take(pa.array([i for i, _ in found], pa.int64())), pa.array([s.tobytes() for _, s in found], pa.binary()))

    keyed = docs.filter("text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    texts = keyed.join(members.select("id", "k1", "k2", F.col("doc").alias("doc_id"), "h"), ["doc_id", "h"]).select("id", "k1", "k2", "text")
    return texts.mapInArrow(run, "id long, elements binary").groupBy("id").agg(F.first("elements").alias("elements"))  # equal ones


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked: whether their whole sets reach the limit."""
    side = lambda k: sets.select(F.col("id").alias(k), F.col("elements").alias(f"e{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield _batch("a b linked", batch.column(0), batch.column(1), pa.array(linked, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ea", "eb").mapInArrow(run, "a long, b long, linked boolean")


def components(links: DataFrame, keep: Keep = materialize) -> DataFrame:
    """id, comp: for every id that occurs in links (a, b), the smallest id it is connected with. Every joined table is read from files,
    so that ids with very many links split between tasks."""
    edges = keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    done = None
    while not edges.isEmpty():
        up = keep(edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("comp")), "hooks")  # to a smaller id: no cycles
        while True:
            above = up.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
            step = up.join(above, "comp", "left").select("id", F.coalesce("top", "comp").alias("comp"), F.col("top").isNotNull().alias("moved"))
            step = keep(step, "jumps")
            up, moved = step.select("id", "comp"), not step.filter("moved").isEmpty()
            if not moved:
                break
        to = lambda k: up.select(F.col("id").alias(k), F.col("comp").alias(f"{k}_top"))
        rest = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_top", "a").alias("x"), F.coalesce("b_top", "b").alias("y"))
        edges = keep(rest.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if done is None:
            done = up
        else:
            moved_on = done.join(up.select(F.col("id").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("id", F.coalesce("top", "comp").alias("comp"))
            done = keep(moved_on.unionByName(up), "components")
    roots = lambda d: d.unionByName(d.select(F.col("comp").alias("id"), "comp").distinct())
    return links.select(F.col("a").alias("id"), F.col("b").alias("comp")).limit(0) if done is None else keep(roots(done), "components")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = unique_columns(docs, ["doc_id", "text"])
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    keep = scratch.keep
    all_sketches = keep(sketches(docs), "sketches")
    of = all_sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2")
    first = F.min(F.struct("doc_id", "h")).alias("first")
    reps = of.agg(first, F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")).select("k1", "k2", "first.doc_id", "first.h", "n", "sketch").withColumnRenamed("doc_id", "doc")
    reps = keep(reps.withColumn("id", F.monotonically_increasing_id()), "representatives")
    buckets = keep(_shared(_bands(reps)), "buckets")
    members = keep(reps.join(buckets.select("id").distinct(), "id").select("id", "doc", "h", "k1", "k2", "n", "sketch"), "members")
    sets, several = keep(_whole_sets(docs, members), "sets"), members.count()
    tested, comps, turn, whole = None, None, 0, several == 0
    while not whole:
        if comps is None:
            rows = buckets.withColumn("comp", F.col("id"))
        else:
            rows = keep(buckets.join(comps, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp")), "bucket-components")
        whole = turn > 0 and new * 100 < several
        if whole:
            likely = _between_components(rows, members, percent / 100, keep)
        else:
            pairs = _one_per_component(rows, f"pairs-{turn}", keep)
            if turn:
                pairs = pairs.distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
            else:  # one attempt for each member: the partner that it met in most buckets
                pairs = pairs.groupBy("a", "b").count().groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a")).select("a", "b")
            likely = _likely(keep(pairs, "candidates"), members, percent / 100)
        result = keep(_verified(keep(likely, "likely"), sets, percent), "verified")
        tested = result if tested is None else tested.unionByName(result)
        new = result.filter("linked").count()
        if new:
            comps = components(tested.filter("linked"), keep)
        turn += 1
    found = reps.select("k1", "k2", F.col("doc").alias("component_id"))
    if comps is not None:
        of = reps.select("k1", "k2", "id", "doc").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        first = of.groupBy("comp").agg(F.min("doc").alias("component_id"))
        found = keep(of.join(first, "comp").select("k1", "k2", "component_id"), "groups")
    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    nothing = F.when(~linkable, F.coalesce("doc_id", F.monotonically_increasing_id()))  # rows without a set don't meet in one task
    keyed = all_sketches.select("doc_id", "n_shingles", F.coalesce(nothing, "k1").alias("k1"), F.when(linkable, F.col("k2")).alias("k2"))
    out = keyed.join(found, ["k1", "k2"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    out = materialize(out, "near-duplicates")
    scratch.drop()
    return out


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), 85)
