"""Alignment of two tokenizers over a corpus through a dictionary of groups (operator 13).

Both tokenizers cut a text's bytes; places where both cut divide the tokens into groups. Most groups occur again and again, so the corpus is
reduced to its distinct groups before anything is counted:

1. ``encode_groups`` tokenizes every text once and writes a row per document: counts, digest, its distinct groups with how often each occurs.
2. ``dictionary`` counts every distinct group over the corpus.
3. ``links`` expands a distinct group once into the pairs of ids whose bytes overlap; ``pair_counts`` multiplies them by the group's frequency.
4. ``group_values`` says for each distinct group what its links are worth, and ``align`` joins that back to the documents by group.

Joins with dictionaries go through ``look_up``: the most frequent keys, at most ``BROADCAST`` of them, are broadcast, and the rows that have none
of those are joined by a shuffle, so neither a frequent group (which may be in every document) nor the size of a dictionary matters.

A token's bytes: A's entries are byte-level characters, B's pieces are UTF-8 with U+2581 for a space, or single bytes. A's text begins with a
space that is put before it; B puts its own there. Texts that are null or empty, or whose tokens of A or B don't give back space + text (B
normalises some characters), have no tokens: zeros, no groups. Texts are tokenized whole. Names of special tokens inside texts are plain text.
Rows are kept apart by a key of their own, so repeated rows and null or repeated doc_ids each give a row; an empty table gives no rows; further
columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table, slices, unique_columns
from .wordbpe import WordEncoder

#: Keys of a dictionary that are broadcast at most (some 40 MB).
BROADCAST = 200_000


def byte_characters() -> dict[str, int]:
    """Byte-level alphabets show printable bytes as themselves and the others, in order, as characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """The two tokenizers of a worker and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = WordEncoder(path_a, "byte")
        # Special tokens are no special case: texts are split as if these weren't there.
        self.a.tokenizer.encode_special_tokens = True
        self.a.added, self.a.folded = [], []
        alphabet = byte_characters()
        entries = self.a.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A and by B of each text; none for a text that either doesn't give back."""
        ids_a = [np.frombuffer(i, "<u4").tolist() for i in self.a.encode([" " + t for t in texts])]
        ids_b = self.b.encode(texts, num_threads=1)
        for i, t in enumerate(texts):
            want = (" " + t).encode()
            if not t or b"".join(map(self.bytes_a.__getitem__, ids_a[i])) != want or b"".join(map(self.bytes_b.__getitem__, ids_b[i])) != want:
                ids_a[i], ids_b[i] = [], []
        return ids_a, ids_b


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """One pair per worker process."""
    return Tokenizers(path_a, path_b)


def groups_of(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group ends among A's ids and among B's; both cover the same bytes. Texts one after another may be cut at once, since a
    text's end is a cut."""
    ends_a, ends_b = np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b])
    _, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
    return at_a + 1, at_b + 1


def _distinct(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The number of each group among the distinct ones, and those as text ``a1,a2|b1,b2``."""
    shapes = np.stack((np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)), 1)
    begins_a, begins_b = ends_a - shapes[:, 0], ends_b - shapes[:, 1]
    numbers, texts = np.zeros(len(shapes), np.int64), []
    # Groups of one shape are rows of one table; short ones, which are nearly all, are packed into integers.
    which = np.unique(shapes[:, 0] << 32 | shapes[:, 1], return_inverse=True)[1]
    by_shape = np.argsort(which, kind="stable")
    for at in np.split(by_shape, np.flatnonzero(np.diff(which[by_shape])) + 1) if len(by_shape) else []:
        m, k = shapes[at[0]]
        rows = np.concatenate((a[begins_a[at][:, None] + np.arange(m)], b[begins_b[at][:, None] + np.arange(k)]), 1).astype(np.uint32)
        keys = np.ascontiguousarray(rows).view(np.dtype((np.void, 4 * (m + k)))).ravel() if m + k > 2 else rows[:, 0].astype(np.uint64) << np.uint64(32) | rows[:, 1]
        _, first, of = np.unique(keys, return_index=True, return_inverse=True)
        numbers[at] = of + len(texts)
        texts += [",".join(map(str, r[:m])) + "|" + ",".join(map(str, r[m:])) for r in rows[first].tolist()]
    return numbers, texts


ENCODED = "_row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups array<string>, times array<int>"


def encode_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: numbers of tokens and groups, the digest of its groups in order, its distinct groups and how often each occurs."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(path_a, path_b)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for lo, hi in slices(texts, most=1_000_000):
                ids_a, ids_b = both.encode(texts[lo:hi])
                a, b = (np.array([i for ids in x for i in ids], np.int64) for x in (ids_a, ids_b))
                ends_a, ends_b = groups_of(a, b, both.sizes_a, both.sizes_b)
                numbers, names = _distinct(a, b, ends_a, ends_b)
                many_a, many_b = (np.array([len(i) for i in x], np.int64) for x in (ids_a, ids_b))
                cuts = np.concatenate(([0], np.searchsorted(ends_a, np.cumsum(many_a), side="right")))
                digests, lists, times, offsets = [], [], [], [0]
                for i in range(hi - lo):
                    mine = numbers[cuts[i] : cuts[i + 1]]
                    digests.append(hashlib.sha256(";".join(map(names.__getitem__, mine.tolist())).encode()).hexdigest() if len(mine) else "")
                    found, count = np.unique(mine, return_counts=True)
                    lists.append(found)
                    times.append(count)
                    offsets.append(offsets[-1] + len(found))
                keys = pa.DictionaryArray.from_arrays(pa.array(np.concatenate(lists), pa.int32()), pa.array(names, pa.string())).cast(pa.string())
                at = pa.array(offsets, pa.int32())
                columns = [batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(many_a), pa.array(many_b), pa.array(np.diff(cuts)), pa.array(digests, pa.string()), pa.ListArray.from_arrays(at, keys), pa.ListArray.from_arrays(at, pa.array(np.concatenate(times), pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ENCODED.split(", ")])

    rows = unique_columns(docs, ["doc_id", "text"]).select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(encode, ENCODED)


def _occurrences(encoded: DataFrame) -> DataFrame:
    """_row, group, times: one row for each distinct group of each document."""
    return encoded.select("_row", F.explode(F.arrays_zip("groups", "times")).alias("g")).select("_row", F.col("g.groups").alias("group"), F.col("g.times").alias("times"))


def dictionary(encoded: DataFrame) -> DataFrame:
    """group, frequency (occurrences in the corpus), documents: every distinct group once. Occurrences are added up before the shuffle."""
    return _occurrences(encoded).groupBy("group").agg(F.sum("times").alias("frequency"), F.count("*").alias("documents"))


def overlaps(sizes_a: list[int], sizes_b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of A's and B's tokens in a group whose byte ranges overlap."""
    out, i, j, end_a, end_b = [], 0, 0, sizes_a[0], sizes_b[0]
    while True:
        out.append((i, j))
        if end_a == end_b and i == len(sizes_a) - 1 and j == len(sizes_b) - 1:
            return out
        if end_a <= end_b:
            step_b = end_a == end_b
            i += 1
            end_a += sizes_a[i]
        else:
            step_b = True
        if step_b:
            j += 1
            end_b += sizes_b[j]


def links(groups: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """group, frequency, a, b, times: every pair of ids that a distinct group links, and how often within it."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(path_a, path_b)
        sizes_a, sizes_b = both.sizes_a.tolist(), both.sizes_b.tolist()
        for batch in batches:
            rows: list[tuple] = []
            for n, group in enumerate(batch.column(0).to_pylist()):
                a, b = ([int(i) for i in side.split(",")] for side in group.split("|"))
                counts: dict = {}
                for i, j in overlaps([sizes_a[i] for i in a], [sizes_b[j] for j in b]):
                    counts[a[i], b[j]] = counts.get((a[i], b[j]), 0) + 1
                rows += [(n, x, y, t) for (x, y), t in counts.items()]
            table = np.array(rows, np.int64).reshape(-1, 4)
            at = pa.array(table[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(table[:, i], pa.int32()) for i in (1, 2, 3))], ["group", "frequency", "a", "b", "times"])

    return groups.select("group", "frequency").mapInArrow(expand, "group string, frequency long, a int, b int, times int")


def pair_counts(linked: DataFrame) -> DataFrame:
    """a, b, count (links of the corpus that hold the two ids), groups (distinct groups with such a link), best (whether no other id of A has
    a higher count with this b)."""
    counts = linked.groupBy("a", "b").agg(F.sum(F.col("frequency") * F.col("times")).alias("count"), F.count("*").alias("groups"))
    top = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(top, "b").select("a", "b", "count", "groups", (F.col("count") == F.col("most")).alias("best"))


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, values: list[str], reduce, most: int = BROADCAST) -> DataFrame:
    """``rows`` joined with ``table`` (one row for each key, written already), and ``reduce`` applied to both parts of the result: what meets the
    ``most`` keys of highest weight goes by broadcast, the rest by shuffle."""
    slim = table.select(*keys, *values, F.col(weight).alias("_weight"))
    if table.count() <= most:
        return reduce(rows.join(F.broadcast(slim.drop("_weight")), keys))
    cut = slim.orderBy(F.desc("_weight")).limit(most).agg(F.min("_weight")).first()[0]
    hot, cold = slim.filter(F.col("_weight") > cut).drop("_weight"), slim.filter(F.col("_weight") <= cut).drop("_weight")
    known = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return reduce(rows.join(F.broadcast(hot), keys)).unionByName(reduce(known.join(cold.hint("shuffle_merge"), keys)))


def _summed(by: str, times: Column):
    return lambda df: df.groupBy(by).agg(F.sum(F.col("n_best") * times).alias("n_best"), F.sum(F.col("count_sum") * times).alias("count_sum"))


def group_values(linked: DataFrame, counts: DataFrame) -> DataFrame:
    """group, frequency, n_best (its links whose count is the highest of their id of B), count_sum (sum of its links' counts)."""

    def value(df: DataFrame) -> DataFrame:
        n_best, count_sum = F.when(F.col("best"), F.col("times")).otherwise(0), F.col("times") * F.col("count")
        return df.groupBy("group", "frequency").agg(F.sum(n_best).alias("n_best"), F.sum(count_sum).alias("count_sum"))

    found = look_up(linked, counts, ["a", "b"], "groups", ["count", "best"], value)
    return found.groupBy("group", "frequency").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


class Alignment:
    """The written tables of one alignment: ``encoded``, ``groups``, ``linked``, ``pairs``, ``values`` (see the functions of the module)."""

    def __init__(self, docs: DataFrame, path_a: str, path_b: str):
        self.scratch = Scratch(docs.sparkSession, "alignment")
        keep = self.scratch.keep
        self.encoded = keep(encode_groups(docs, path_a, path_b), "encoded")
        self.groups = keep(dictionary(self.encoded), "groups")
        self.linked = keep(links(self.groups, path_a, path_b), "linked")
        self.pairs = keep(pair_counts(self.linked), "pairs")
        self.values = keep(group_values(self.linked, self.pairs), "values")

    def documents(self) -> DataFrame:
        """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
        part = look_up(_occurrences(self.encoded), self.values, ["group"], "frequency", ["n_best", "count_sum"], _summed("_row", F.col("times")))
        summed = _summed("_row", F.lit(1))(part)
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        # Ids of a group without inner cuts overlap in a chain: one link fewer than it has tokens.
        n_links = (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links")
        return self.encoded.drop("groups", "times").join(summed, "_row", "left").select("doc_id", "n_a", "n_b", "n_groups", n_links, zero("n_best"), zero("count_sum"), "groups_sha256")


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Tables of the work stay in the scratch folder as long as the result may be read."""
    return Alignment(docs, path_a, path_b).documents()


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
