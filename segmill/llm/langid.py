"""Language identification by prediction by partial matching (operator 1).

Each language has a context tree over bytes up to ``ORDER`` bytes deep. In a context seen T times with D different followers, a
follower seen c times costs -log2(c / (T + D)) bits; any other first costs -log2(D / (T + D)) for the escape and is then coded in the
context without its first byte; a context never seen passes on free of charge; below the empty context a byte costs 8 bits. The
statistics are frozen, so a text's code length is a sum over its bytes, and the whole cost of each n-gram that any language has
seen is worked out once; only n-grams that none has seen are escaped step by step. The shortest code names the language.

The trees are learned from at most ``TRAIN_ROWS`` distinct texts of each language, of all languages there are: those with the least hashes,
however many copies they have, and of texts longer than ``TRAIN_CHARS`` characters a stretch whose place the hash decides. With more than
``TRAIN_TEXTS`` / ``TRAIN_ROWS`` languages each has a smaller share of ``TRAIN_TEXTS``, but ``TRAIN_LEAST`` texts. These are the documented bounds
of this classifier's sample. Texts are scored whole.

score is the share of the winner's probability 2**-bits among all languages. Null text and text without a letter (``str.isalpha``; number
signs are none) are ``und`` with score 0, as is everything if nothing was learned. Ties go to the first language by name. Rows are
independent; an empty table gives no rows; only doc_id and text are read for a prediction. held_out is null for a null doc_id, which is
never learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import read_table, slices
from .hashing import Lookup

ORDER = 3
TRAIN_ROWS, TRAIN_CHARS, TRAIN_TEXTS, TRAIN_LEAST = 1_000, 20_000, 100_000, 20
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: A letter, for Spark.
LETTERS = r"\p{L}"


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in LETTER.finditer(text))


def padded(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each after ``order`` zero bytes; where each begins (the end last)."""
    pad = bytes(order)
    codes = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8)
    return codes, np.append(0, np.cumsum([len(t) + order for t in texts])).astype(np.int64)


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each position as one number (positions before n - 1 lack bytes and count them as 0)."""
    key = codes.astype(np.uint32)
    for k in range(1, n):
        key[k:] |= codes[:-k].astype(np.uint32) << np.uint32(8 * k)
    return key


class PartialMatching:
    """langs: names; costs[g]: grams of g bytes x languages, bits of the last byte after the others; escapes[k]: contexts of k bytes x
    languages."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER):
        self.order, self.langs = order, sorted(samples)
        n = len(self.langs)
        counted = []
        for lang in self.langs:
            codes, begins = padded(samples[lang], order)
            real = np.ones(len(codes), bool)
            for k in range(order):
                real[begins[:-1] + k] = False
            counted.append([np.unique(grams(codes, g)[real], return_counts=True) for g in range(1, order + 2)])
        self.costs, self.escapes, self.grams, self.contexts = [None], [], [None], []
        cost, lookup = np.full((256, n), 8.0), None
        for g in range(1, order + 2):
            keys = np.arange(256, dtype=np.uint32) if g == 1 else np.unique(np.concatenate([c[g - 1][0] for c in counted])) if n else np.zeros(0, np.uint32)
            above = np.unique(keys >> np.uint32(8))
            low = keys & np.uint32((1 << 8 * (g - 1)) - 1)
            below = cost[low] if g == 1 else cost[lookup(low)]
            if g == 1:
                below = np.full((256, n), 8.0)
            new, esc = np.empty((len(keys), n)), np.zeros((len(above), n))
            context = np.searchsorted(above, keys >> np.uint32(8))
            for i in range(n):
                seen, count = counted[i][g - 1]
                c = np.zeros(len(keys))
                c[np.searchsorted(keys, seen)] = count
                t, d = np.bincount(context, c, len(above)), np.bincount(context, c > 0, len(above))
                esc[:, i] = np.where(d > 0, np.log2(np.maximum(t + d, 1)) - np.log2(np.maximum(d, 1)), 0)
                new[:, i] = np.where(c > 0, np.log2(np.maximum(t + d, 1))[context] - np.log2(np.maximum(c, 1)), esc[context, i] + below[:, i])
            cost, lookup = new, Lookup(keys)
            self.costs.append(new.astype(np.float32))
            self.escapes.append(esc.astype(np.float32))
            self.grams.append(lookup)
            self.contexts.append(Lookup(above))

    def _escaped(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits by language at positions whose longest gram no language has seen."""
        out = np.zeros((len(at), len(self.langs)))
        left = np.arange(len(at))
        for g in range(self.order + 1, 0, -1):
            key = np.zeros(len(left), np.uint32)
            for k in range(g):
                key |= codes[at[left] - k].astype(np.uint32) << np.uint32(8 * k)
            if g <= self.order:
                found = self.grams[g](key)
                hit = found >= 0
                out[left[hit]] += self.costs[g][found[hit]]
                left, key = left[~hit], key[~hit]
            context = self.contexts[g - 1](key >> np.uint32(8))
            known = context >= 0
            out[left[known]] += self.escapes[g - 1][context[known]]
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text by language: texts x languages."""
        codes, begins = padded(texts, self.order)
        out = np.zeros((len(texts), len(self.langs)))
        if not len(codes) or not self.langs:
            return out
        found = self.grams[self.order + 1](grams(codes, self.order + 1))
        for k in range(self.order):
            found[begins[:-1] + k] = -2
        unseen = np.flatnonzero(found == -1)
        bare = found < 0
        found[bare] = 0
        for i in range(len(self.langs)):
            bits = self.costs[-1][:, i][found]
            bits[bare] = 0
            out[:, i] = np.add.reduceat(bits, begins[:-1], dtype=np.float64)
        if len(unseen):
            more, text = self._escaped(codes, unseen), np.searchsorted(begins, unseen, side="right") - 1
            for i in range(len(self.langs)):
                out[:, i] += np.bincount(text, more[:, i], len(texts))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None]]:
        """Language, score, and bits per byte in that language (null for ``und``)."""
        raw = [(t or "").encode() for t in texts]
        bits = self.code_lengths(raw)
        langs, scores, rates = [], [], []
        for t, b, row in zip(texts, raw, bits):
            if not t or not self.langs or not has_letter(t):
                langs.append(UNKNOWN)
                scores.append(0.0)
                rates.append(None)
                continue
            best = int(row.argmin())
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp2(np.maximum(row[best] - row, -1000)).sum()))
            rates.append(float(row[best] / len(b)))
        return langs, scores, rates


def remainder(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string")) % n


def train(rows: DataFrame) -> PartialMatching:
    """rows: text, lang. Copies of a text count once, so no number of them hides a language's other texts. The driver gets the sample."""
    usable = rows.filter("text IS NOT NULL AND lang IS NOT NULL AND text <> ''").select("lang", F.xxhash64("text").alias("h"), "text")
    langs = usable.select("lang").distinct().count()
    share = max(TRAIN_LEAST, min(TRAIN_ROWS, TRAIN_TEXTS // max(1, langs)))
    least = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # a task sends ``share`` hashes of a language at most
    wanted = usable.select("lang", "h").distinct().withColumn("r", least).filter(F.col("r") <= share)
    begin = F.pmod("h", F.greatest(F.length("text") - TRAIN_CHARS + 1, F.lit(1))).cast("int") + 1
    excerpt = F.when(F.length("text") > TRAIN_CHARS, F.substring("text", begin, F.lit(TRAIN_CHARS))).otherwise(F.col("text"))
    few = F.broadcast(wanted) if langs * share <= 2 * TRAIN_TEXTS else wanted
    near = usable.join(few, ["lang", "h"]).select("lang", "r", excerpt.alias("text"))
    chosen = near.groupBy("lang", "r").agg(F.min("text").alias("text"))
    samples: dict[str, list[bytes]] = {}
    for r in chosen.select("lang", "text", "r").orderBy("lang", "r").collect():
        samples.setdefault(r["lang"], []).append(r["text"].encode())
    return PartialMatching(samples)


def identify(docs: DataFrame, model: PartialMatching, names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """docs with language, score and bits per byte added under ``names`` (columns of these names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    added = [*names]
    docs = docs.drop(*added)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in slices(texts, most=1_000_000):
                langs, scores, rates = shared.value.predict(texts[a:b])
                columns = [*batch.slice(a, b - a).columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *added])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(added[0], "string").add(added[1], "double").add(added[2], "double"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 4) == 2
    model = train(docs.filter(~held).select("text", "lang"))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
