"""Token-id files of directly addressable codes (operator 9).

Ids are cut into 8-bit chunks. Level 0 holds every id's lowest chunk and one continuation bit per id; level k holds the next
chunk of those ids whose bit on level k-1 is set. A rank directory counts the set bits before each 512-bit word of a bitmap, so
the place of an id's chunk on the next level takes one lookup and one popcount: any token is read without decoding a block.

A block (little-endian): magic ``DAC1``, u64 ids, u32 levels; per level u64 entries, the chunks, the bitmap (bit i of byte i//8,
padded to whole 64-byte words), then u64 set bits before each word.

Blocks lie in Parquet files in the shared folder, one file per range of rows in ascending doc_id order. Documents are never split between
blocks, however long. ``read_documents`` reads documents in order, ``read_tokens`` single tokens of any documents: it finds their blocks
by an index that holds no codes, and takes each token through the rank directories.

Null text counts as empty; an empty text has only its end id. Rows with equal doc_id are written one after another by a hash of their
texts, and however many there are, ranges split them; null doc_ids come first. Empty tables give no rows. Columns besides doc_id and text
are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, slices, tasks_for, unique_columns
from .wordbpe import encoder

WORD_BYTES = 64
BLOCK_TOKENS = 500_000
BLOCKS = "shard int, block int, start long, n_docs long, n_tokens long, doc_ids binary, known binary, lengths binary, codes binary"


def dac_encode(ids: np.ndarray) -> bytes:
    """ids: unsigned integers below 2**32."""
    levels, now = [], ids.astype(np.uint32)
    while True:
        more = now >= 256
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % WORD_BYTES))
        ones = np.bitwise_count(bits.reshape(-1, WORD_BYTES)).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u8") if len(ones) else np.zeros(0, "<u8")
        levels.append(struct.pack("<Q", len(now)) + (now & 255).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        if not more.any():
            return struct.pack("<4sQI", b"DAC1", len(ids), len(levels)) + b"".join(levels)
        now = now[more] >> np.uint32(8)


class DacReader:
    """Random access (``reader[i]``) and whole decoding (``decode``) of one block."""

    def __init__(self, code: bytes):
        magic, self.n, count = struct.unpack_from("<4sQI", code)
        if magic != b"DAC1":
            raise ValueError("not a block of directly addressable codes")
        at, self.levels = 16, []
        for _ in range(count):
            (n,) = struct.unpack_from("<Q", code, at)
            size = -(-n // (8 * WORD_BYTES)) * WORD_BYTES
            chunks = np.frombuffer(code, np.uint8, n, at + 8)
            bits = np.frombuffer(code, np.uint8, size, at + 8 + n)
            ranks = np.frombuffer(code, "<u8", size // WORD_BYTES, at + 8 + n + size)
            self.levels.append((chunks, bits, ranks))
            at += 8 + n + size + ranks.nbytes

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            byte, bit = divmod(i, 8)
            if not bits[byte] >> bit & 1:
                break
            word = byte // WORD_BYTES
            i = int(ranks[word]) + int(np.bitwise_count(bits[word * WORD_BYTES : byte]).sum()) + (int(bits[byte]) & (1 << bit) - 1).bit_count()
        return value

    def take(self, at: np.ndarray) -> np.ndarray:
        """The ids at many positions, each through the rank directories; nothing else is decoded."""
        at = np.asarray(at, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("no such position")
        out = np.zeros(len(at), np.uint32)
        for lo in range(0, len(at), 8_192):
            where, i = np.arange(lo, min(lo + 8_192, len(at))), at[lo : lo + 8_192]
            for k, (chunks, bits, ranks) in enumerate(self.levels):
                out[where] |= chunks[i].astype(np.uint32) << np.uint32(8 * k)
                more = (bits[i >> 3] >> (i & 7).astype(np.uint8)) & 1 == 1
                where, i = where[more], i[more]
                if not len(i):
                    break
                word, byte = i // (8 * WORD_BYTES), (i >> 3) % WORD_BYTES
                inside = np.bitwise_count(bits.reshape(-1, WORD_BYTES)[word]) * (np.arange(WORD_BYTES) < byte[:, None])
                part = np.bitwise_count(bits[i >> 3] & ((1 << (i & 7)) - 1).astype(np.uint8))
                i = ranks[word].astype(np.int64) + inside.sum(1, dtype=np.int64) + part
        return out

    def decode(self) -> np.ndarray:
        above = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            now = chunks.astype(np.uint32)
            if len(above):
                now[np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)] |= above << np.uint32(8)
            above = now
        return above


def _blocks(path: str, kind: str, end: bytes):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "block", "start", "n_docs", "n_tokens", "doc_ids", "known", "lengths", "codes"]
        shard, block, start, enc = TaskContext.get().partitionId(), 0, 0, encoder(path, kind)
        keys: list = []
        ids: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held
            lengths = np.array([len(x) // 4 for x in ids], "<u4")
            row = [shard, block, start, len(ids), held, np.array([k or 0 for k in keys], "<i8").tobytes(), np.array([k is not None for k in keys], np.uint8).tobytes(), lengths.tobytes(), dac_encode(np.frombuffer(b"".join(ids), "<u4"))]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            block, start, held = block + 1, start + held, 0
            keys.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, most=1_000_000):
                for key, code in zip(doc_ids[a:b], enc.encode(texts[a:b])):
                    keys.append(key)
                    ids.append(code + end)
                    held += len(code) // 4 + 1
                    if held >= BLOCK_TOKENS:
                        yield flush()
        if ids:
            yield flush()

    return write


def write_token_files(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 2, name: str = "tokens") -> DataFrame:
    """Writes the ids of all documents in ascending doc_id order and returns the table of blocks as read from the files.

    tokenizer: path of a tokenizers file that every executor has; kind: its splitting rule (see wordbpe).
    """
    rows = unique_columns(docs, ["doc_id", "text"]).withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(tasks_for(docs), "doc_id", "_hash", "_row").sortWithinPartitions("doc_id", "_hash", "text").select("doc_id", "text")
    return materialize(ordered.mapInArrow(_blocks(tokenizer, kind, struct.pack("<I", end_id)), BLOCKS), name)


def _before(blocks: DataFrame) -> dict[int, int]:
    """Ids in all files before each file; the driver adds up one number for each."""
    totals = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    before, at = {}, 0
    for shard in sorted(totals):
        before[shard], at = at, at + totals[shard]
    return before


def _documents(r: dict) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """doc_ids, first positions and numbers of ids of a block's documents."""
    lengths = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
    return pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.frombuffer(r["known"], np.uint8) == 0), np.cumsum(lengths) - lengths, lengths


def read_documents(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32, middle_id (the id at n_tokens // 2, taken by random
    access), and on demand ids."""
    before = _before(blocks)
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "middle_id", "ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                reader = DacReader(r["codes"])
                ids = reader.decode().astype("<u4")
                doc_ids, begins, lengths = _documents(r)
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(begins, lengths)]
                columns = [doc_ids, pa.array(before[r["shard"]] + r["start"] + begins, pa.int64()), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(reader.take(begins + lengths // 2).astype(np.int64))]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begins, len(ids)), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return blocks.select("shard", "start", "doc_ids", "known", "lengths", "codes").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, middle_id long" + ", ids array<long>" * with_ids)


def document_index(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, shard, block, at (its first position in the block); no codes are read."""
    before = _before(blocks)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                doc_ids, begins, lengths = _documents(r)
                same = lambda k: pa.array(np.full(len(begins), r[k]), pa.int32())
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(before[r["shard"]] + r["start"] + begins, pa.int64()), pa.array(lengths), same("shard"), same("block"), pa.array(begins)], ["doc_id", "start", "n_tokens", "shard", "block", "at"])

    return blocks.select("shard", "block", "start", "doc_ids", "known", "lengths").mapInArrow(read, "doc_id long, start long, n_tokens long, shard int, block int, at long")


#: Tokens of one block that a task takes at once at most, about.
TAKEN = 1_000_000


def read_tokens(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: doc_id, position (from 0). Returns doc_id, start, position, id for each wanted row and each document of that doc_id; positions
    beyond a document's end give no row, nor do null doc_ids. Blocks meet only the positions that are asked of them, the more often asked
    ones in several tasks."""
    found = wanted.select("doc_id", "position").join(document_index(blocks), "doc_id").filter("position >= 0 AND position < n_tokens")
    found = materialize(found.select("doc_id", "start", "position", "shard", "block", (F.col("at") + F.col("position")).alias("at")), "wanted")
    parts = found.groupBy("shard", "block").agg(F.ceil(F.count("*") / TAKEN).cast("int").alias("parts"))
    asked = found.join(parts, ["shard", "block"]).select("*", F.pmod(F.xxhash64("start", "position"), F.col("parts")).cast("int").alias("part"))
    codes = blocks.select("shard", "block", "codes").join(parts, ["shard", "block"]).select("shard", "block", "codes", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def take(asked: pa.Table, codes: pa.Table) -> pa.Table:
        ids = DacReader(codes["codes"][0].as_py()).take(asked["at"].to_numpy()) if asked.num_rows else np.zeros(0, np.uint32)
        return asked.select(["doc_id", "start", "position"]).append_column("id", pa.array(ids.astype(np.int64)))

    by = ["shard", "block", "part"]
    return asked.groupBy(*by).cogroup(codes.groupBy(*by)).applyInArrow(take, "doc_id long, start long, position long, id long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_documents(write_token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
