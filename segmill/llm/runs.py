"""Periodic runs of words (operator 11), by the linear tandem-repeat method of Gusfield and Stoye.

Each text becomes numbers of words. The blocks of its Lempel-Ziv factorization, read off a suffix tree, give a leftmost-covering set of
squares by two longest common extensions for each period; these are marked in the tree at their leftmost occurrences, and walks over
suffix links mark every rotation that also occurs, so that the marks are the whole vocabulary of squares. The leaves below a mark whose
root is primitive are its occurrences; occurrences of one period at consecutive places merge into runs.

A run is a stretch with smallest period q that neither neighbour extends keeping that period. ``runs`` returns those of at least two
periods; the operator asks for more and first cuts the text at words and pairs of words that are too rare to lie in such a run, which
loses none (see ``_pieces``).

Texts are handled whole, each inside one task: work is about linear in the words that survive the cut. Null texts and texts without words
have no runs. Rows are independent of each other: repeated rows and null doc_ids are handled like any other, an empty table gives no rows,
further columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, unique_columns

LEAST_WORDS = 6
LEAST_PERIODS = 4


class Extensions:
    """Longest common extensions of many pairs of places at once. names[k][i] is equal for equal stretches of 2**k symbols."""

    def __init__(self, symbols: np.ndarray):
        self.n, self.names = len(symbols), [symbols.astype(np.int64)]
        size = 1
        while 2 * size <= self.n:
            now = self.names[-1]
            pairs = now[:-size] * (int(now.max()) + 1) + now[size:]
            found, named = np.unique(pairs, return_inverse=True)
            self.names.append(named)
            size *= 2
            if len(found) == len(named):
                break

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How long the stretches that begin at a and b agree; places may equal the length."""
        return self._walk(a.copy(), b.copy(), 1) - a

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How long the stretches that end before a and b agree."""
        return a - self._walk(a.copy(), b.copy(), -1)

    def _walk(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        for k in reversed(range(len(self.names))):
            names, size = self.names[k], 1 << k
            if not len(names):
                continue
            # Two different places can agree over the longest tabled stretch several times.
            again = np.arange(len(a))
            while len(again):
                x, y = (a[again], b[again]) if way > 0 else (a[again] - size, b[again] - size)
                inside = (x >= 0) & (y >= 0) & (x < len(names)) & (y < len(names))
                same = inside.copy()
                same[inside] = names[x[inside]] == names[y[inside]]
                again = again[same]
                a[again] += way * size
                b[again] += way * size
                if k < len(self.names) - 1:
                    break
        return a


class SuffixTree:
    """Ukkonen's tree over ``symbols`` (numbers from 0), of which the last must occur once. Nodes are numbers, 0 the root."""

    def __init__(self, symbols: list[int]):
        n, many = len(symbols), max(symbols) + 1
        self.symbols, self.many, self.n = symbols, many, n
        start, end, link, child = [0], [0], [0], {}
        node = edge = length = waiting = 0
        for i, c in enumerate(symbols):
            last = 0
            waiting += 1
            while waiting:
                if not length:
                    edge = i
                key = node * many + symbols[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    begin = start[below]
                    reach = min(end[below], i + 1) - begin
                    if length >= reach:
                        edge += reach
                        length -= reach
                        node = below
                        continue
                    if symbols[begin + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    split = len(start)
                    start += [begin, i]
                    end += [begin + length, n]
                    link += [0, 0]
                    child[key] = split
                    child[split * many + c] = split + 1
                    start[below] = begin + length
                    child[split * many + symbols[begin + length]] = below
                    if last:
                        link[last] = split
                    last = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.link, self.child = link, child
        self._number(start, end)

    def _number(self, start: list[int], end: list[int]) -> None:
        """parent, depth, first (smallest leaf below), low and high (its leaves in ``leaves``), and the node of each leaf."""
        size = len(start)
        parent, below = [0] * size, [[] for _ in range(size)]
        for key, v in self.child.items():
            u = key // self.many
            parent[v] = u
            below[u].append(v)
        depth, order, todo = [0] * size, [], [0]
        while todo:
            u = todo.pop()
            order.append(u)
            for v in below[u]:
                depth[v] = depth[u] + end[v] - start[v]
                todo.append(v)
        first, low, high, leaves, leaf_of = [self.n] * size, [0] * size, [0] * size, [], [0] * self.n
        for u in order:
            low[u] = len(leaves)
            if u and not below[u]:
                first[u] = self.n - depth[u]
                leaf_of[first[u]] = u
                leaves.append(first[u])
        for u in reversed(order):
            high[u] = max(high[u], low[u] + (not below[u]))
            p = parent[u]
            if first[u] < first[p]:
                first[p] = first[u]
            if high[u] > high[p]:
                high[p] = high[u]
        self.parent, self.depth, self.first, self.low, self.high, self.leaves, self.leaf_of = parent, depth, first, low, high, leaves, leaf_of

    def blocks(self) -> np.ndarray:
        """Where the blocks of the Lempel-Ziv factorization begin, and the length at the end: a block is the longest stretch that also begins
        further left, or one symbol."""
        begins, i = [], 0
        symbols, child, first, depth, many = self.symbols, self.child, self.first, self.depth, self.many
        while i < self.n:
            begins.append(i)
            u = 0
            while i + depth[u] < self.n:
                v = child.get(u * many + symbols[i + depth[u]])
                if v is None or first[v] >= i:
                    break
                u = v
            i += max(1, depth[u])
        return np.array(begins + [self.n], np.int64)


def covering_squares(begins: np.ndarray, ext: Extensions) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of a leftmost-covering set of squares: for each block, those that reach over its end with their left half's end inside
    it, and those that begin before it or inside it with their centre inside it."""
    n, sizes = int(begins[-1]), np.diff(begins)
    following = np.append(sizes[1:], 0)

    def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = np.repeat(np.arange(len(counts)), counts)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + 1

    of, k = spread(sizes)
    end = begins[of + 1]
    q = end - k
    right, left = ext.right(end, q), ext.left(end, q)
    hit = (right + left >= k) & (right > 0)
    found = [(np.maximum(q - left, q - k + 1)[hit], k[hit])]

    of, k = spread(sizes + following)
    h = begins[of]
    inside = h + k < n
    of, k, h = of[inside], k[inside], h[inside]
    q = h + k
    right, left = ext.right(h, q), ext.left(h, q)
    start = np.maximum(h - left, h - k + 1)
    hit = (right + left >= k) & (right > 0) & (left > 0) & (start + k <= begins[of + 1])
    found.append((start[hit], k[hit]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def vocabulary(tree: SuffixTree, starts: np.ndarray, periods: np.ndarray) -> set[tuple[int, int]]:
    """Every distinct square as (node below its end, its length), completed from a leftmost-covering set by walks over suffix links."""
    symbols, parent, depth, first, link, child, many = tree.symbols, tree.parent, tree.depth, tree.first, tree.link, tree.child, tree.many
    order = np.lexsort((-periods, starts))
    marks: set[tuple[int, int]] = set()
    at, v = -1, 0
    for i, k in zip(starts[order].tolist(), periods[order].tolist()):
        if i != at:
            at, v = i, tree.leaf_of[i]
        while depth[parent[v]] >= 2 * k:
            v = parent[v]
        if first[v] == i:
            marks.add((v, 2 * k))
    for v, d in list(marks):
        while True:
            i = first[v]
            u = link[parent[v]] if parent[v] else 0
            # Down to the place of symbols[i + 1 : i + d], whose suffix link this is.
            w = u
            while depth[w] < d - 1:
                w = child[w * many + symbols[i + 1 + depth[w]]]
            if depth[w] == d - 1:
                w = child.get(w * many + symbols[i])
                if w is None:
                    break
            elif symbols[first[w] + d - 1] != symbols[i]:
                break
            if (w, d) in marks:
                break
            marks.add((w, d))
            v = w
    return marks


def _primitive(starts: np.ndarray, periods: np.ndarray, ext: Extensions) -> np.ndarray:
    """Whether the stretch of ``periods`` symbols at each start is no repetition of a shorter one."""
    good, left = np.ones(len(starts), bool), periods.copy()
    p = 2
    while len(left) and p <= left.max():
        if p * p > left.max():
            # What is left of each period is 1 or a prime.
            at, parts = np.flatnonzero(left > 1), left[left > 1]
            left = np.ones_like(left)
        else:
            at = np.flatnonzero(left % p == 0)
            parts = np.full(len(at), p)
            while len(now := at[left[at] % p == 0]):
                left[now] //= p
        step = periods[at] // parts
        good[at] &= ext.right(starts[at], starts[at] + step) < periods[at] - step
        p += 1
    return good


def runs(symbols: np.ndarray) -> np.ndarray:
    """All maximal runs of at least two periods: rows (start, length, smallest period) by start, then period."""
    n = len(symbols)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    named = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    closed = np.append(named, named.max() + 1)
    tree, ext = SuffixTree(closed.tolist()), Extensions(closed)
    marks = np.array(sorted(vocabulary(tree, *covering_squares(tree.blocks(), ext))), np.int64).reshape(-1, 2)
    nodes, periods = marks[:, 0], marks[:, 1] // 2
    first, low, high = (np.array(x, np.int64)[nodes] for x in (tree.first, tree.low, tree.high))
    good = _primitive(first, periods, ext)
    periods, low, counts = periods[good], low[good], (high - low)[good]
    at = np.arange(counts.sum()) + np.repeat(low - (np.cumsum(counts) - counts), counts)
    key = np.sort(np.repeat(periods, counts) * (n + 2) + np.array(tree.leaves, np.int64)[at])
    begins = np.flatnonzero(np.diff(key, prepend=-2) != 1)
    ends = np.append(begins[1:], len(key)) - 1
    period, start = (key[begins] // (n + 2), key[begins] % (n + 2)) if len(key) else (key, key)
    length = key[ends] - key[begins] + 2 * period if len(key) else key
    found = np.stack((start, length, period), 1)
    return found[np.lexsort((period, start))]


def _pieces(names: np.ndarray, least_words: int, least_periods: int) -> np.ndarray:
    """Which words may lie in a run of at least ``least_periods`` periods and ``least_words`` words, with a cut (False) between the pieces.

    In a run of e whole periods every word occurs e times or more, and so do e - 1 times or more every two and, from period 2 on, every three
    neighbouring words (at period 1 there are least_words - 2 places for three). Words that lie in no such pair and triple are left out; a
    piece shorter than least_words goes. A run can't reach over what is left out, so the runs of the pieces are those of the text."""
    n = len(names)
    keep = np.bincount(names)[names] >= min(least_periods, least_words)
    for size, least in ((2, min(least_periods - 1, least_words - 1)), (3, min(least_periods - 1, least_words - 2))):
        if least < 2 or n < size or not keep.any():
            continue
        places = np.flatnonzero(np.logical_and.reduce([keep[i : n - size + 1 + i] for i in range(size)]))
        many = int(names.max()) + 1
        joined = names[places]
        for i in range(1, size):
            joined = (np.unique(joined, return_inverse=True)[1] if many * (int(joined.max(initial=0)) + 1) > 1 << 62 else joined) * many + names[places + i]
        _, which, count = np.unique(joined, return_inverse=True, return_counts=True)
        good = places[count[which] >= least]
        covered = np.zeros(n + 1, np.int64)
        np.add.at(covered, good, 1)
        np.add.at(covered, good + size, -1)
        keep &= np.cumsum(covered)[:n] > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], keep, [False])).astype(np.int8)))
    for a, b in edges.reshape(-1, 2):
        if b - a < least_words:
            keep[a:b] = False
    return keep


def word_runs(words: list, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Runs of a text's words with at least ``least_words`` words and ``least_periods`` whole periods (2 or more of both)."""
    none = np.zeros((0, 3), np.int64)
    if len(words) < least_words:
        return none
    counts = Counter(words)
    if max(counts.values()) < min(least_periods, least_words):
        return none
    names = np.fromiter(map(dict(zip(counts, range(len(counts)))).__getitem__, words), np.int64, len(words))
    keep = _pieces(names, least_words, least_periods)
    if not keep.any():
        return none
    # Each gap becomes one symbol that occurs nowhere else.
    gap = ~keep & np.concatenate(([False], keep[:-1]))
    shown = keep | gap
    symbols = names[shown]
    cut = gap[shown]
    symbols[cut] = len(counts) + np.arange(cut.sum())
    found = runs(symbols)
    found = found[found[:, 1] >= np.maximum(least_words, least_periods * found[:, 2])]
    found[:, 0] = np.flatnonzero(shown)[found[:, 0]]
    return found


def collapsed(words: list, found: np.ndarray) -> list:
    """The words without those that any run repeats after its first period."""
    if not len(found):
        return words
    ends = np.zeros(len(words) + 1, np.int64)
    np.add.at(ends, found[:, 0] + found[:, 2], 1)
    np.add.at(ends, found[:, 0] + found[:, 1], -1)
    return [w for w, gone in zip(words, np.cumsum(ends).tolist()) if not gone]


FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per document: its words counted, its runs by start and period, and its words joined by one space without what runs repeat.
    Words are split at ASCII white space. ``edit`` may change a document's words (UTF-8) before."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, offsets, found_rows, texts = batch.column(0), [], [0], [], []
            for key, text in zip(keys.to_pylist(), batch.column(1)):
                words = (text.as_py() or "").encode().split()
                if edit:
                    words = edit(key, words)
                found = word_runs(words, least_words, least_periods)
                counts.append(len(words))
                found_rows.append(found)
                offsets.append(offsets[-1] + len(found))
                texts.append(b" ".join(collapsed(words, found)))
            rows = np.concatenate(found_rows) if found_rows else np.zeros((0, 3), np.int64)
            named = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["start", "length", "period"])
            columns = [keys, pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), named), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    rows = unique_columns(docs, ["doc_id", "text"])
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, FOUND)


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document, by a hash of its doc_id, repeats a stretch of its words up to its end; rows without a doc_id stay as they are."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns beside the contract's: n_words, n_collapsed (words that runs repeat after their first period)."""
    found = periodic_runs(read_table(spark, sf_dir, "documents"), edit=periodic_tail)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("before"), (-r.period).alias("shorter"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    of = found.withColumn("_longest", longest)
    return of.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_longest.before")).alias("start"), F.col("_longest.length").alias("length"), (-F.col("_longest.shorter")).alias("period"),
        F.expr("_longest.length * 1000 div -_longest.shorter").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"), "n_words",
    )
