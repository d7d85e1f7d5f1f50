"""SentencePiece sampling without replacement, and decoding (operator 2).

A text's segmentations are the paths of its lattice of vocabulary pieces (characters without a piece go through their byte pieces). A
piece of rank r has weight 1 / (r + 2.7), a path the product of its pieces' weights, normalised over all paths. Adding Gumbel noise
to every path's log probability and taking the k largest draws k distinct segmentations without replacement. The search is A* on
perturbed scores: a region is the set of paths that share a beginning and avoid some next pieces; its largest perturbed score is a
Gumbel number at the region's log mass, truncated by its parent's. The best region is taken, one of its paths sampled and emitted with
the region's score, and the rest of the region falls apart into regions by where they leave that path. The next score after the
k-th gives each path's inclusion score 1 - exp(-exp(log p - threshold)); it is 1 if no path is left over.

No piece reaches over the start of a run of spaces, so lattices are built once per distinct end of a word in a slice of texts; sums over paths,
sampling and truncated noise are numpy over all texts of a slice. Noise depends only on the row's key, the sample's number and the
place in the text, so results don't depend on batches, partitions or retries.

Long texts are sampled whole; a slice's tables grow with the distinct ends of its words times the longest piece, so a text without any
space takes the most memory. Equal perturbed scores (which differ with probability one) go by the order in which regions were found.
Null and empty texts have one segmentation, without pieces. A text with fewer than k segmentations gives all of them. Equal keys
and texts give equal results, so repeated rows repeat; an empty table gives no rows. Columns besides the key and the text are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import read_table, slices
from .hashing import Lookup, mixed, _powers

SPACE = "▁"
OFFSET = 2.7
_BASE = 0xA24BAED4963EE407 | 3
_SALT = np.array([0x9FB21C651E98DF25, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7], np.uint64)


def _salted(seed: np.ndarray, kind: int, sample: int) -> np.ndarray:
    return mixed(seed + _SALT[:1] * np.uint64(kind + 1) + _SALT[1:2] * np.uint64(sample))


def _uniform(salted: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on the arguments only."""
    return ((mixed(salted + place.astype(np.uint64) * _SALT[2]) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(self.processor)
        self.texts = [self.processor.id_to_piece(i) for i in range(n)]
        byte = [self.processor.is_byte(i) for i in range(n)]
        special = [self.processor.is_control(i) or self.processor.is_unknown(i) or self.processor.is_unused(i) for i in range(n)]
        normal = [i for i in range(n) if not byte[i] and not special[i]]
        if any(SPACE in self.texts[i].lstrip(SPACE) or "\n" in self.texts[i] for i in normal):
            raise ValueError("a piece reaches over a space or a line end")
        scores = np.array([self.processor.get_score(i) for i in normal])
        rank = np.empty(len(normal))
        rank[np.argsort(-scores, kind="stable")] = np.arange(len(normal))
        self.longest = max(len(self.texts[i]) for i in normal)
        self.ids, self.logs = np.array(normal, np.int32), -np.log(rank + OFFSET)
        number = {self.texts[i]: k for k, i in enumerate(normal)}
        begins = sorted({t[:k] for t in number for k in range(1, len(t) + 1)})
        #: All beginnings of pieces, and which of them are pieces (-1: none).
        self.lookup = Lookup(np.array([self._hash_one(b) for b in begins], np.uint64))
        self.number = np.array([number.get(b, -1) for b in begins], np.int32)
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(n):
            if byte[i]:
                self.byte_ids[int(self.texts[i][1:-1], 16)] = i
        self.byte_log = -np.log(len(normal) + OFFSET)
        self.powers = _powers(_BASE, 1 << 10), _powers(pow(_BASE, -1, 1 << 64), 1 << 10)
        spelled = [bytes([int(t[1:-1], 16)]) if byte[i] else b"" if special[i] else t.replace(SPACE, " ").encode() for i, t in enumerate(self.texts)]
        #: All pieces' bytes one after another; where each begins and how many it has.
        self.spelled, self.size = np.frombuffer(b"".join(spelled), np.uint8), np.array([len(x) for x in spelled], np.int32)
        self.place = np.append(0, np.cumsum(self.size))[:-1].astype(np.int32)

    @staticmethod
    def _hash_one(piece: str) -> int:
        total, power = 0, 1
        for value in mixed(np.array([ord(c) + 1 for c in piece], np.uint64)).tolist():
            total, power = (total + value * power) & 0xFFFFFFFFFFFFFFFF, power * _BASE & 0xFFFFFFFFFFFFFFFF
        return total

    def _power(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers[0]) < n:
            size = 1 << n.bit_length()
            self.powers = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        return self.powers[0][:n], self.powers[1][:n]

    def decode_bytes(self, many: list[np.ndarray], most: int = 40_000) -> list[bytes]:
        """The UTF-8 bytes of segmentations: their pieces' bytes one after another, without the space that was put first."""
        out: list[bytes] = []
        for lo, hi in slices(many, most=most):
            ids = np.concatenate(many[lo:hi])
            size = self.size[ids]
            ends = np.append(0, np.cumsum(size))
            at = np.repeat(self.place[ids] - ends[:-1].astype(np.int32), size)
            at += np.arange(len(at), dtype=np.int32)
            raw = self.spelled[at].tobytes()
            cuts = ends[np.append(0, np.cumsum([len(x) for x in many[lo:hi]]))].tolist()
            out += [raw[a + (raw[a : a + 1] == b" ") : b] for a, b in zip(cuts, cuts[1:])]
        return out


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One per worker process."""
    return PieceModel(path)


class Lattices:
    """The lattices of several texts. Per character: its row in the tables of distinct words. Tables, rows x longest piece: logs, log
    probability of each piece length given that a path comes here; cdf, running sums of the probabilities; piece (its number, -1:
    bytes); and options, how many lengths are possible."""

    def __init__(self, m: PieceModel, texts: list[str]):
        self.m = m
        marked = [(SPACE + t.replace(" ", SPACE)) if t else "" for t in texts]
        self.begin = np.append(0, np.cumsum([len(t) for t in marked])).astype(np.int64)
        self.codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4")
        n = len(self.codes)
        space = self.codes == ord(SPACE)
        line = self.codes == 10
        first = np.zeros(n + 1, bool)
        first[:n] = space & ~np.append(False, space[:-1]) | line
        if n:
            first[1:n] |= line[:-1]
        first[self.begin] = True
        first[n] = False
        self.word_start = np.flatnonzero(first)
        sizes = np.diff(np.append(self.word_start, n))
        power, inverse = m._power(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(self.codes.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        words = (sums[self.word_start + sizes] - sums[self.word_start]) * inverse[self.word_start]
        _, one, which = np.unique(words, return_index=True, return_inverse=True)
        size = sizes[one]
        base = np.append(0, np.cumsum(size))
        self.rows = int(base[-1])
        place = np.repeat(self.word_start[one], size) + np.arange(self.rows) - np.repeat(base[:-1], size)
        left = np.repeat(base[1:], size) - np.arange(self.rows)  # characters to the word's end
        # words with the same end share its rows, which are kept by that distance, so that all rows of a distance lie together
        _, ending, where = np.unique((sums[place + left] - sums[place]) * inverse[place], return_index=True, return_inverse=True)
        order = np.argsort(left[ending].astype(np.int32), kind="stable")
        self.rows = len(order)
        sorted_ = np.empty(self.rows, np.int32)
        sorted_[order] = np.arange(self.rows, dtype=np.int32)
        where, word_row = sorted_[where], ending[order]
        place, left = place[word_row], left[word_row]
        offset = np.arange(n) - np.repeat(self.word_start, sizes)
        self.row = where[np.repeat(base[which], sizes) + offset]
        self.word_end = np.repeat(self.word_start + sizes, sizes)
        fits, hits = np.arange(self.rows), []
        while len(hits) < m.longest and len(fits):
            k = len(hits)
            fits = fits[left[fits] > k]
            at = place[fits]
            begun = m.lookup((sums[at + k + 1] - sums[at]) * inverse[at])
            on = begun >= 0
            fits, number = fits[on], m.number[begun[on]]
            hits.append((fits[number >= 0], number[number >= 0]))
        while len(hits) > 1 and not len(hits[-1][0]):
            hits.pop()
        width = max(1, len(hits))
        self.piece = np.full((self.rows, width), -1, np.int16 if len(m.ids) < 1 << 15 else np.int32)
        logs = np.full((self.rows, width), -np.inf)
        for k, (rows, number) in enumerate(hits):
            self.piece[rows, k] = number
            logs[rows, k] = m.logs[number]
        bare = np.flatnonzero(np.isneginf(logs[:, 0]))
        codes = self.codes[place[bare]]
        logs[bare, 0] = m.byte_log * (1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))
        beta = np.zeros(self.rows)
        levels = np.flatnonzero(np.append(True, left[1:] != left[:-1])) if self.rows else np.zeros(0, np.int64)
        for lo, hi in zip(levels.tolist(), [*levels[1:].tolist(), self.rows]):
            distance = int(left[lo])
            through = logs[lo:hi]
            inner = min(width, distance - 1)  # lengths that stay inside the word
            if inner:
                through[:, :inner] += beta[where[word_row[lo:hi, None] + 1 + np.arange(inner)]]
            top = through.max(1)
            beta[lo:hi] = top + np.log(np.exp(through - top[:, None]).sum(1))
            through -= beta[lo:hi, None]
        self.logs = logs
        self.options = np.isfinite(logs).sum(1, dtype=np.int8)
        cdf = logs.astype(np.float32)
        np.exp(cdf, out=cdf)
        np.cumsum(cdf, axis=1, out=cdf)
        cdf /= cdf[:, -1:]
        #: As many columns as fill whole words of eight comparisons; those added are never passed.
        self.cdf = np.full((self.rows, -(-width // 8) * 8), 2, np.float32)
        self.cdf[:, :width] = cdf

    def walk(self, flags: np.ndarray, at: np.ndarray, seed: np.ndarray) -> None:
        """Samples on from each place to the end of its word; every piece's first character is marked in ``flags``."""
        while len(at):
            flags[at] = True
            u = np.minimum(_uniform(seed, at - self.begin[self.owner[at]]).astype(np.float32), np.float32(1 - 2**-24))
            passed = np.bitwise_count((self.cdf.take(self.row[at], axis=0) <= u[:, None]).view(np.uint64))
            at = at + 1
            for column in passed.T:
                at += column
            on = np.flatnonzero(at < self.word_end[at - 1])
            at, seed = at[on], seed[on]


#: Places of a path at which regions are looked for first.
NEAR = 96


def _scores(lat: Lattices, g: np.ndarray, row: np.ndarray, length: np.ndarray, before: np.ndarray, avoided: dict[int, tuple], noise: np.ndarray) -> np.ndarray:
    """Perturbed scores of the regions that leave paths at their places; all arrays: paths x places, ``before``: log probability of the
    path up to the place. ``avoided``: by path, the lengths that its first place had to avoid."""
    rest = -np.expm1(lat.logs[row, length - 1])
    left = lat.options[row] > 1
    for i, avoid in avoided.items():
        rest[i, 0] = 1 - np.exp(lat.logs[row[i, 0], [x - 1 for x in (*avoid, int(length[i, 0]))]]).sum()
        left[i, 0] = lat.options[row[i, 0]] > len(avoid) + 1
    mass = np.where(left, before + np.log(np.maximum(rest, 1e-300)), -np.inf)
    return -np.logaddexp(-g[:, None], np.log(-np.log(noise)) - mass)


def _regions(lat: Lattices, g: np.ndarray, avoided: dict[int, tuple], starts: np.ndarray, length: np.ndarray, cum: np.ndarray, begin: np.ndarray, first: np.ndarray, end: np.ndarray, noise: np.ndarray, most: int) -> list[list[tuple[float, int]]]:
    """For each path (pieces begin[i] to end[i] of all pieces, new from first[i] on) the ``most`` best (score, number of the piece) among
    the regions that leave it. A region's mass is at most the probability of the path so far, so that pieces near the beginning
    settle it, unless the rest with the largest noise that it has could still win; then the path is looked at as far as that noise could."""
    at = first[:, None] + np.arange(min(NEAR, int((end - first).max())))
    inside = at < end[:, None]
    at = np.minimum(at, len(starts) - 1)
    score = _scores(lat, g, lat.row[starts[at]], length[at], cum[at] - cum[begin][:, None], avoided, noise[at])
    score[~inside] = -np.inf
    top = min(most, score.shape[1])
    few = np.argpartition(-score, top - 1, axis=1)[:, :top]
    best = np.take_along_axis(score, few, 1)
    out = [[(s, f + j) for s, j in zip(ss, js) if s > -np.inf] for f, ss, js in zip(first.tolist(), best.tolist(), few.tolist())]
    rest = np.flatnonzero(first + score.shape[1] < end)
    if len(rest):
        ends = np.stack((first[rest] + score.shape[1], end[rest]), 1)
        largest = -np.log(-np.log(np.maximum.reduceat(np.append(noise, 0), ends.ravel())[::2]))
        least = best[rest].min(1) if top == most else np.full(len(rest), -np.inf)
        open_ = cum[ends[:, 0]] - cum[begin[rest]] + largest >= least
        for i, bar in zip(rest[open_].tolist(), (least - largest + cum[begin[rest]])[open_].tolist()):
            # as far as a region with the largest noise reaches the least of the best; ``cum`` never rises
            last = int(first[i] + np.searchsorted(-cum[first[i] : end[i]], 1e-9 - bar, side="right"))
            all_ = np.arange(first[i], last)[None]
            whole = _scores(lat, g[i : i + 1], lat.row[starts[all_]], length[all_], cum[all_] - cum[begin[i]], {0: avoided[i]} if i in avoided else {}, noise[all_])[0]
            out[i] = [(float(whole[j]), int(first[i] + j)) for j in np.argsort(-whole, kind="stable")[:most].tolist() if whole[j] > -np.inf]
    return out


def sample(m: PieceModel, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per text, by falling perturbed score: (ids, log probability, perturbed score, inclusion score) of up to k segmentations."""
    lat = Lattices(m, texts)
    count, n = len(texts), len(lat.codes)
    lat.owner = np.repeat(np.arange(count), np.diff(lat.begin))
    seeds = mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(77))
    first_word = np.searchsorted(lat.word_start, lat.begin)
    results: list[list[tuple]] = [[] for _ in texts]
    heaps: list[list[tuple]] = [[] for _ in texts]
    flags = np.zeros((k, n), bool)
    root = -np.log(-np.log(_uniform(_salted(seeds, 2, 0), np.zeros(count, np.int64))))
    # a region: minus its score, a number, the sample that it begins like, the place where it leaves that, lengths not to take there
    current: list[tuple | None] = [(-float(root[d]), 0, -1, int(lat.begin[d]), ()) for d in range(count)]
    for d in range(count):
        if lat.begin[d] == lat.begin[d + 1]:
            results[d].append((np.zeros(0, np.int32), 0.0, float(root[d])))
            current[d] = None
    for r in range(k):
        live = [d for d in range(count) if current[d] is not None]
        if not live:
            break
        f, ids = flags[r], np.array(live)
        lead = np.array([current[d][3] for d in live])
        p = np.exp(lat.logs[lat.row[lead]])
        for i, d in enumerate(live):
            _, _, source, place, avoid = current[d]
            if avoid:
                p[i, [x - 1 for x in avoid]] = 0
            if source >= 0:
                f[lat.begin[d] : place] = flags[source, lat.begin[d] : place]
        cdf = np.cumsum(p, 1)
        steps_seed, noise_seed = _salted(seeds, 0, r), _salted(seeds, 1, r)
        u = _uniform(steps_seed[ids], lead - lat.begin[ids]) * cdf[:, -1]
        after = lead + np.minimum((cdf <= u[:, None]).sum(1), p.shape[1] - 1) + 1
        f[lead] = True
        inside = after < lat.word_end[lead]
        next_word = np.searchsorted(lat.word_start, lead, side="right")
        spans = first_word[ids + 1] - next_word
        words = np.repeat(next_word - np.append(0, np.cumsum(spans)[:-1]), spans) + np.arange(spans.sum())
        at = np.concatenate((after[inside], lat.word_start[words]))
        lat.walk(f, at, steps_seed[lat.owner[at]])
        starts = np.flatnonzero(f)
        owner = lat.owner[starts]
        length = np.diff(np.append(starts, n))
        last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
        length[last] = lat.begin[owner[last] + 1] - starts[last]
        row = lat.row[starts]
        cum = np.append(0, np.cumsum(lat.logs[row, length - 1]))
        piece = lat.piece[row, length - 1]
        coded = m.ids[np.maximum(piece, 0)]
        bare = np.flatnonzero(piece < 0)
        codes = lat.codes[starts[bare]]
        coded[bare[codes < 128]] = m.byte_ids[codes[codes < 128]]
        wide = bare[codes >= 128]
        heads, lead_at = np.searchsorted(starts, lat.begin), np.searchsorted(starts, lead)
        wide_of = np.searchsorted(wide, heads)
        avoided = {i: current[d][4] for i, d in enumerate(live) if current[d][4]}
        scores = np.array([-current[d][0] for d in live])
        regions = _regions(lat, scores, avoided, starts, length, cum, heads[ids], lead_at, heads[ids + 1], _uniform(noise_seed[owner], starts - lat.begin[owner]), k - r)
        for i, d in enumerate(live):
            g, avoid, lo, hi, at = -current[d][0], current[d][4], int(heads[d]), int(heads[d + 1]), int(lead_at[i])
            for score, j in regions[i]:
                x = int(length[j])
                heapq.heappush(heaps[d], (-score, r * n + int(starts[j]), r, int(starts[j]), (*avoid, x) if j == at else (x,)))
            own = coded[lo:hi]
            if wide_of[d] < wide_of[d + 1]:
                own = _with_bytes(m, own, wide[wide_of[d] : wide_of[d + 1]] - lo, lat.codes[starts[wide[wide_of[d] : wide_of[d + 1]]]])
            results[d].append((own, float(cum[hi] - cum[lo]), g))
            current[d] = heapq.heappop(heaps[d]) if heaps[d] else None
    out = []
    for d in range(count):
        threshold = -current[d][0] if current[d] is not None else -np.inf
        out.append([(i, lp, g, 1.0 if threshold == -np.inf else float(-np.expm1(-np.exp(np.clip(lp - threshold, -700, 700))))) for i, lp, g in results[d]])
    return out


def _with_bytes(m: PieceModel, ids: np.ndarray, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """ids with the byte pieces of the characters ``codes`` in the places ``at``."""
    raw = [chr(c).encode("utf-8", "surrogatepass") for c in codes.tolist()]
    ids = ids.copy()
    ids[at] = m.byte_ids[[x[0] for x in raw]]
    return np.insert(ids, np.repeat(at + 1, [len(x) - 1 for x in raw]), m.byte_ids[[b for x in raw for b in x[1:]]])


SAMPLED = {"doc_id": "long", "sample": "int", "n_pieces": "int", "log_p": "double", "score": "double", "inclusion": "double", "ids_crc32": "long", "text_crc32": "long", "round_trip": "boolean", "ids": "array<int>"}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}


def encode_samples(docs: DataFrame, path: str, k: int, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, sample (from 1), n_pieces, log_p, score, inclusion, ids_crc32 (little-endian unsigned 32-bit ids), of the sample's decoded
    text text_crc32 (UTF-8) and round_trip (whether it is the text), and on demand ids. A null key counts as 0 for the noise."""
    names = [n for n in SAMPLED if with_ids or n != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, most=1_000_000):
                found = sample(m, texts[a:b], np.array([x or 0 for x in keys[a:b]], np.int64), k)
                decoded, rows = iter(m.decode_bytes([ids for of in found for ids, *_ in of])), []
                for d, t, of in zip(keys[a:b], texts[a:b], found):
                    raw = t.encode()
                    for i, (ids, log_p, score, inclusion) in enumerate(of):
                        ids, back = np.asarray(ids, "<u4"), next(decoded)
                        rows.append((d, i + 1, len(ids), log_p, score, inclusion, zlib.crc32(ids.tobytes()), zlib.crc32(back), back == raw, *([ids] * with_ids)))
                yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[SAMPLED[n]]) for c, n in zip(zip(*rows), names)], names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ", ".join(f"{n} {SAMPLED[n]}" for n in names))


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``encoded`` with a column of texts made from ids (a column of that name is replaced); null ids give null. Bytes that are no UTF-8
    become replacement characters."""
    encoded = encoded.drop(out)
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            lists = batch.column(at).to_pylist()
            for a, b in slices(lists, most=1_000_000):
                part = m.decode_bytes([np.array(x or [], np.int64) for x in lists[a:b]])
                texts = [None if x is None else raw.decode("utf-8", "replace") for x, raw in zip(lists[a:b], part)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields]).add(out, "string"))


def op2_piece_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_samples(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 3, with_ids=False)
