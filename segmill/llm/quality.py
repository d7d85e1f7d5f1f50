"""Quality classifier on random-indexing word vectors (operator 3).

Tokens are runs of letters (and other non-ASCII characters), of digits, or of signs; case counts. A token falls into one of
``BUCKETS`` buckets by hash, so the table of vectors has a fixed size at any scale. Each bucket has a fixed sparse ternary index
vector; its word vector is the sum, over all its occurrences in all documents, of the index vectors of the ``WINDOW`` tokens on
either side, scaled to length one. Partial sums are merged by blocks of buckets. A document is pooled into the mean word vector, the
mean product of neighbouring word vectors (high where words repeat), and shares of kinds of tokens. A network of two layers in numpy
gives a logit; a temperature fitted on rows that training didn't see calibrates it.

The network is trained on at most ``TRAIN_ROWS`` labelled texts chosen by hashes of doc_id and text, copies of one counting once (the
documented bound of this classifier's sample); word vectors use all documents, scoring uses whole texts. Labels, lang, source and doc_id are never inputs.
Rows of ``labels`` with null doc_id or quality are ignored, several for one doc_id are averaged and ties between 0 and 1 dropped.
With no usable labels, or labels of one class, the score is that class's share (0.5 without labels).

Null and empty texts have all features 0 and get a score like any other. Rows are independent and repeat as they come; an empty table
gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import read_table, shuffle_partitions, slices, unique_columns
from .hashing import run_hashes

BUCKETS, DIM, NONZERO, WINDOW, BLOCKS = 1 << 14, 32, 4, 2, 256
TRAIN_ROWS, HIDDEN, EPOCHS, SEED = 10_000, 32, 40, 7
THRESHOLD = 0.3
STATS = 10

LETTERS, DIGITS, SIGNS, BLANK = range(4)
_KIND = np.full(256, SIGNS, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTERS
_KIND[48:58] = DIGITS
_KIND[[9, 10, 11, 12, 13, 32, 0]] = BLANK


def index_vectors() -> np.ndarray:
    """BUCKETS x DIM, each row with NONZERO entries of 1 or -1."""
    rng = np.random.default_rng(99)
    places = rng.random((BUCKETS, DIM)).argsort(1)[:, :NONZERO]
    out = np.zeros((BUCKETS, DIM), np.int8)
    np.put_along_axis(out, places, rng.choice(np.array([-1, 1], np.int8), (BUCKETS, NONZERO)), 1)
    return out


class Words:
    """Tokens of several texts: bucket, text (its number), kind, size, capitals (whether all letters are capital A-Z)."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        bases = np.append(0, np.cumsum([len(r) + 1 for r in raw]))
        codes = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        kinds = _KIND[codes]
        cut = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1]))
        end = np.append(cut[1:], len(codes))
        keep = kinds[cut] != BLANK
        a, b = cut[keep], end[keep]
        hashes = run_hashes(codes, a, b)
        self.bucket = (hashes >> np.uint64(64 - 14)).astype(np.int32)
        self.text = (np.searchsorted(bases, a, side="right") - 1).astype(np.int32)
        self.kind, self.size = kinds[a], (b - a).astype(np.int32)
        capitals = np.append(0, np.cumsum((codes >= 65) & (codes <= 90), dtype=np.int32))
        self.capitals = capitals[b] - capitals[a] == self.size
        self.same = np.append(False, (hashes[1:] == hashes[:-1]) & (self.text[1:] == self.text[:-1])) if len(a) else np.zeros(0, bool)
        self.n = len(texts)


def context_sums(words: Words, index: np.ndarray) -> np.ndarray:
    """BUCKETS x DIM: for each bucket the index vectors around its occurrences, added up."""
    n = len(words.bucket)
    if not n:
        return np.zeros((BUCKETS, DIM), np.int32)
    own = index[words.bucket]
    around = np.zeros((n, DIM), np.int8)
    for d in range(1, min(WINDOW, n - 1) + 1):
        together = (words.text[d:] == words.text[:-d]).view(np.int8)[:, None]
        around[:-d] += own[d:] * together
        around[d:] += own[:-d] * together
    order = np.argsort(words.bucket, kind="stable")
    sorted_buckets = words.bucket[order]
    starts = np.flatnonzero(np.append(True, sorted_buckets[1:] != sorted_buckets[:-1]))
    out = np.zeros((BUCKETS, DIM), np.int32)
    out[sorted_buckets[starts]] = np.add.reduceat(around[order], starts, axis=0, dtype=np.int32)
    return out


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIM vectors of length one (or 0 for buckets never seen), from all texts. The driver gets BLOCKS rows of fixed size."""
    width = BUCKETS // BLOCKS

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(), np.zeros((BUCKETS, DIM), np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in slices(texts, most=1_000_000):
                total += context_sums(Words(texts[a:b]), index)
        cells = total.reshape(BLOCKS, width * DIM)
        small = np.abs(total).max(initial=0) < 1 << 15
        seen = np.flatnonzero(cells.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array([small] * len(seen), pa.bool_()), pa.array([c.astype("<i2" if small else "<i8").tobytes() for c in cells[seen]], pa.binary())], ["block", "small", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, small, data in zip(*(c.to_pylist() for c in batch.columns)):
                sums[block] = sums.get(block, 0) + np.frombuffer(data, "<i2" if small else "<i8").astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.astype("<i8").tobytes() for s in sums.values()], pa.binary())], ["block", "sums"])

    parts = docs.select("text").mapInArrow(part, "block int, small boolean, sums binary")
    merged = parts.repartition(min(BLOCKS, shuffle_partitions(docs.sparkSession)), "block").mapInArrow(merge, "block int, sums binary")
    out = np.zeros((BLOCKS, width * DIM))
    for r in merged.collect():
        out[r["block"]] = np.frombuffer(r["sums"], "<i8")
    out = out.reshape(BUCKETS, DIM)
    return (out / np.maximum(np.sqrt((out**2).sum(1)), 1e-9)[:, None]).astype(np.float32)


def _stretches(starts: np.ndarray, n: int, most: int = 100_000) -> Iterator[tuple[int, int]]:
    """Runs of at most ``most`` tokens. Texts are cut only if they are longer, and then at the same places whatever stands around them."""
    ends, lo = np.append(starts[1:], n), 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        if b - lo > most and a > lo:
            yield lo, a
            lo = a
        while b - lo > most:
            yield lo, lo + most
            lo += most
    yield lo, n


def pooled(words: Words, vectors: np.ndarray) -> np.ndarray:
    """Features of each text: mean vector, mean product of neighbours, shares."""
    out = np.zeros((words.n, 2 * DIM + STATS), np.float32)
    if not len(words.bucket):
        return out
    starts = np.flatnonzero(np.append(True, words.text[1:] != words.text[:-1]))
    who = words.text[starts]
    count = np.diff(np.append(starts, len(words.text))).astype(np.float32)
    for lo, hi in _stretches(starts, len(words.bucket)):
        text = words.text[lo:hi]
        at = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        v = vectors[words.bucket[lo:hi]]
        out[text[at], :DIM] += np.add.reduceat(v, at, axis=0)
        pairs = np.zeros_like(v)
        np.multiply(v[1:], v[:-1], out=pairs[1:])
        pairs[at] = 0
        if lo and words.text[lo - 1] == text[0]:
            pairs[0] = v[0] * vectors[words.bucket[lo - 1]]
        out[text[at], DIM : 2 * DIM] += np.add.reduceat(pairs, at, axis=0)
    out[who, : 2 * DIM] /= count[:, None]
    mean = lambda x: np.add.reduceat(x.astype(np.float32), starts) / count
    letters = words.kind == LETTERS
    stats = [np.log1p(count) / 10, mean(letters), mean(words.kind == DIGITS), mean(words.kind == SIGNS), mean(letters & words.capitals & (words.size > 1)), mean(words.same), mean(np.minimum(words.size, 40)) / 10, mean((words.kind == SIGNS) & (words.size > 1)), mean((words.size > 20) & letters), mean((words.kind == SIGNS) & words.same)]
    out[who, 2 * DIM :] = np.stack(stats, 1)
    return out


@dataclass
class Network:
    """logit = relu((x - mean) / scale @ w1 + b1) @ w2 + b2, divided by the temperature. Without weights: a constant score."""

    constant: float = 0.5
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    w1: np.ndarray | None = None
    b1: np.ndarray | None = None
    w2: np.ndarray | None = None
    b2: float = 0.0
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.w1 is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the cross entropy; a fifth of the rows is kept back and sets the temperature."""
    if not len(y) or y.min() == y.max():
        return Network(constant=float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    back, train = (order[: len(y) // 5], order[len(y) // 5 :]) if len(y) >= 50 else (order, order)
    net = Network(mean=x[train].mean(0), scale=x[train].std(0) + 1e-3)
    z = (x - net.mean) / net.scale
    params = [rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    moments, step = [(np.zeros_like(p), np.zeros_like(p)) for p in params], 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
            step += 1
            a, t = z[at], y[at]
            h = np.maximum(a @ params[0] + params[1], 0)
            miss = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -60, 60))) - t) / len(at)
            up = np.outer(miss, params[2]) * (h > 0)
            for p, g, (m, v) in zip(params, (a.T @ up, up.sum(0), h.T @ miss, miss.sum(keepdims=True)), moments):
                g = g + 1e-5 * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logits, t = net.logits(x[back]), y[back]
    choices = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    net.temperature = float(min(choices, key=lambda c: float((np.logaddexp(0, logits / c) - t * logits / c).mean())))
    return net


class Scorer:
    def __init__(self, vectors: np.ndarray, network: Network):
        self.vectors, self.network = vectors, network

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return self.network.scores(pooled(Words([t or "" for t in texts]), self.vectors))


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    """docs: doc_id, text. labels: doc_id, quality; the caller leaves out rows that must not be learned from."""
    spark = docs.sparkSession
    docs = unique_columns(docs, ["doc_id", "text"])
    vectors = word_vectors(docs)
    known = labels.select("doc_id", F.col("quality").cast("double").alias("q")).dropna().groupBy("doc_id").agg(F.avg("q").alias("q")).filter("q <> 0.5")
    here = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")  # labels of other documents take no place in the sample
    chosen = here.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS).withColumnRenamed("doc_id", "_id")
    shared = spark.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in slices(texts, most=1_000_000):
                x = pooled(Words(texts[a:b]), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], ["key", "q", "x"])

    picked = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["_id"]).select("text", F.xxhash64("doc_id", "text").alias("key"), "q")  # TRAIN_ROWS ids at most
    once = picked.mapInArrow(features, "key long, q double, x binary").groupBy("key").agg(F.first("q").alias("q"), F.first("x").alias("x"))  # equal ones
    rows = once.orderBy("key").limit(TRAIN_ROWS).collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float64).reshape(-1, 2 * DIM + STATS)
    return Scorer(vectors, fit(x, np.array([r["q"] > 0.5 for r in rows], float)))


def score(docs: DataFrame, scorer: Scorer, column: str = "score") -> DataFrame:
    """docs with the score added (a column of that name is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # BUCKETS vectors and a small network
    docs = docs.drop(column)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in slices(texts, most=1_000_000):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(shared.value(texts[a:b]), pa.float64())], [*batch.schema.names, column])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(column, "double"))


def held_out(n: int = 5):
    return F.crc32(F.col("doc_id").cast("string")) % n == 0


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scorer = train(docs, labels.filter(~held_out()))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), scorer).drop("text").withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
