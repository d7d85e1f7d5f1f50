"""Best-fit packing with certified repacking (operator 10).

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt evenly to partitions and each is packed by best-fit
decreasing. Dual-feasible functions bound from below how many sequences a partition needs; while the sequences of all partitions
exceed the bound of all pieces, every partition releases its emptiest sequences (as many as its own gap, and two more), eight
partitions pool what they released and pack it again. Rounds end when the bound is met or one pool is left. A pool holds a bounded
number of sequences whatever the input's size.

Null text counts as empty; an empty text is one piece that has only the end id. Repeated rows are packed as often as they occur.
An empty table gives no rows. Columns besides doc_id and text are ignored by the query; the packer itself keeps all columns.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, slices, unique_columns
from .wordbpe import encoder

CAPACITY = 4096
#: Pieces of a partition in the first round.
PARTITION_PIECES = 8_192
#: Partitions whose released sequences are pooled.
FAN_IN = 8
PIECE = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def lower_bound(counts: np.ndarray) -> int:
    """Fewest sequences that can hold ``counts[n]`` pieces of n tokens; the capacity is ``len(counts) - 1``.

    The largest bound of: total volume; f_e (over capacity - e: a whole sequence; under e: nothing); u_k (round to k-ths).
    """
    cap, n = len(counts) - 1, np.arange(len(counts))
    best = -(-int(counts @ n) // cap)
    upto, volume = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * n))
    e = np.arange(1, cap // 2 + 1)
    whole = upto[-1] - upto[cap - e + 1]
    middle = volume[cap - e + 1] - volume[e]
    best = max(best, int((whole - (-middle // cap)).max(initial=0)))
    for k in range(1, 51):
        scaled = (k + 1) * n
        twice = np.where(scaled % cap == 0, n * k, scaled // cap * cap)  # k * capacity times u_k
        best = max(best, -(-int(counts @ twice) // (k * cap)))
    return best


def best_fit_decreasing(lengths: np.ndarray, cap: int) -> np.ndarray:
    """The sequence of each piece. Free space is found by the lowest set bit of a number whose bit r says that a sequence with r free
    tokens is open."""
    out, free, mask, made = np.zeros(len(lengths), np.int64), [[] for _ in range(cap + 1)], 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b, made = cap, made, made + 1
        out[i] = b
        if left := room - n:
            free[left].append(b)
            mask |= 1 << left
    return out


def _packer(cap: int, shift: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda part: _pack(part, cap, shift, last)


def _pack(part: pd.DataFrame, cap: int, shift: int, last: bool) -> pd.DataFrame:
    """Adds sequence_id, offset and open (released for the next round); pool becomes that of the next round."""
    lengths = part["length"].to_numpy()
    bins = best_fit_decreasing(lengths, cap)
    used = np.bincount(bins, weights=lengths).astype(np.int64)
    gap = len(used) - lower_bound(np.bincount(lengths, minlength=cap + 1))
    released = np.zeros(len(used), bool)
    if not last:
        released[np.argsort(used, kind="stable")[: gap + 2]] = True
        released &= used < cap
    order = np.lexsort((part["uid"].to_numpy(), bins))
    sizes, of = lengths[order], bins[order]
    ends = np.cumsum(sizes)
    first = np.append(True, of[1:] != of[:-1])
    at = np.empty(len(of), np.int64)
    at[order] = ends - sizes - np.maximum.accumulate(np.where(first, ends - sizes, 0))
    return part.assign(sequence_id=shift + part["pool"].to_numpy() * 2**24 + bins, offset=at, open=released[bins], pool=part["pool"] // FAN_IN)


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """pieces: uid long (unique), length long (1 to capacity) and any other columns but pool, open. Adds sequence_id and offset."""
    sizes = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    if not sizes:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes:
        counts[r["length"]] = r["count"]
    bound, pools = lower_bound(counts), max(1, -(-int(counts.sum()) // partition_pieces))
    now = pieces.withColumn("pool", F.pmod(F.xxhash64("uid"), F.lit(pools)))
    settled, total, rounds = None, 0, 0
    while True:
        last = pools == 1
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in now.schema) + ", sequence_id long, offset long, open boolean"
        packed = materialize(now.groupBy("pool").applyInPandas(_packer(capacity, rounds << 56, last), schema), f"packed-{rounds}")
        seen = packed.groupBy("open").agg(F.countDistinct("sequence_id").alias("n")).collect()  # two rows
        n = {r["open"]: r["n"] for r in seen}
        done = last or total + sum(n.values()) <= bound
        total += n.get(False, 0)
        here = (packed if done else packed.filter(~F.col("open"))).drop("pool", "open")
        settled = here if settled is None else settled.unionByName(here)
        if done or not n.get(True):
            return settled
        now, pools, rounds = packed.filter("open").drop("sequence_id", "offset", "open"), -(-pools // FAN_IN), rounds + 1


def pieces(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids and the end id, cut at multiples of ``capacity``; only longer documents are cut."""
    end = struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, uid = encoder(tokenizer, kind), TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, most=1_000_000):
                rows = []
                for key, code in zip(keys[a:b], enc.encode(texts[a:b])):
                    code += end
                    for k, at in enumerate(range(0, len(code), 4 * capacity)):
                        ids = code[at : at + 4 * capacity]
                        rows.append((uid, key, k, at // 4, len(ids) // 4, zlib.crc32(ids)))
                        uid += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 3])], ["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return unique_columns(docs, ["doc_id", "text"]).mapInArrow(cut, PIECE)


def pack_documents(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialize(pieces(docs, tokenizer, kind, end_id, capacity), "pieces"), capacity).drop("uid")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
