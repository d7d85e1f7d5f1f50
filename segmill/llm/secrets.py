"""Secret scans with a linear-chain conditional random field (operator 5).

Tokens are runs of letters, digits and ``+ / _ -``. Each is tagged as begin, inside or outside of a secret. A tag's score sums weights
of the token's features: its length, kinds of characters and changes between kinds, its shape (the sequence of kinds) and its first four
characters by hash, the words before and after it by hash, what stands between it and them; and of features of the whole text (its size,
its share of digits); and weights of neighbouring tags. Viterbi gives the best sequence of tags. Where outside beats every other tag by
more than neighbours can ever add, the best path must pass through outside, so the chain falls apart there and only the short stretches
between such tokens are decoded step by step.

Weights are fitted by likelihood, in one task, to a bounded sample: at most ``TRAIN_ROWS`` distinct texts (stretches of ``TRAIN_CHARS``
characters of longer ones) of a pool of about ``TRAIN_POOL`` rows, and of their windows of tokens ``WINDOWS`` at most, which never reach
over the ends of a text. Tags come from the base patterns; made-up secrets of other forms join the sample, and made-up look-alikes (paths,
names, numbers, addresses) that are none. Base patterns always count; the field adds spans (kind ``crf``) that base spans don't cover.

Null counts as empty text; empty text has no spans; an empty table gives no rows; repeated rows repeat. Texts are scanned whole, however
long. Of equally good paths the one with lower tags wins. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices, unique_columns
from .hashing import run_hashes

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A text without these (in any case) has no assign span.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words that announce made-up secrets, and prefixes of issued keys.
CUES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "bearer", "authorization", "credential", "credentials", "auth", "access_key", "secret_key", "private_key")
PREFIXES = ("ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "glpat-", "eyJ")
#: Distinct texts that the training sample is drawn from, texts of it at most, characters of each at most.
TRAIN_POOL, TRAIN_ROWS, TRAIN_CHARS = 20_000, 1_500, 20_000
#: Windows of tokens that the weights are fitted to at most.
WINDOWS = 4_000
#: Spans of the field are at least so long.
LEAST = 12

LOWER, UPPER, DIGIT, MARK, WIDE, QUOTE, EQUALS, LINE, SPACE, OTHER = range(10)
_CLASS = np.full(257, OTHER, np.uint8)
_CLASS[256] = WIDE
for _chars, _kind in (("abcdefghijklmnopqrstuvwxyz", LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), ("0123456789", DIGIT), ("+/_-", MARK), ("\"'", QUOTE), ("=:", EQUALS), ("\n\r", LINE), (" \t", SPACE)):
    for _c in _chars:
        _CLASS[ord(_c)] = _kind
_CLASS[192:256] = WIDE
#: (feature, number of values); a token has one value of each. Words, shapes and beginnings go by hash.
FEATURES = {
    "length": 8, "kinds": 32, "changes": 6, "hex": 3, "before": 5, "after": 5, "gap": 4, "digits": 5, "file_digits": 4, "file_size": 4, "bias": 1,
    "shape": 1_024, "head": 1_024, "previous": 2_048, "second": 2_048, "next": 2_048,
}
OFFSETS = dict(zip(FEATURES, np.cumsum([0, *FEATURES.values()])[:-1].tolist()))
N_FEATURES = sum(FEATURES.values())
OUT, BEGIN, IN = range(3)


class Tokens:
    """Tokens of several texts at once: text (its number), start, end (code points in that text), feature values (one column each)."""

    def __init__(self, texts: list[str]):
        sizes = np.array([len(t) + 1 for t in texts])
        self.bases = np.append(0, np.cumsum(sizes))
        codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = _CLASS[np.minimum(codes, 256)]
        inside = kinds <= WIDE
        edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
        a, b = edge[::2], edge[1::2]
        self.text = np.searchsorted(self.bases, a, side="right") - 1
        self.start, self.end = a - self.bases[self.text], b - self.bases[self.text]
        self.kinds, self.a, self.b = kinds, a, b
        if not len(a):
            self.features = np.zeros((0, len(FEATURES)), np.int16)
            return
        many = lambda mask: (c := np.append(0, np.cumsum(mask, dtype=np.int32)))[b] - c[a]
        n = b - a
        counts = {k: many(kinds == k) for k in (LOWER, UPPER, DIGIT, MARK, WIDE)}
        changes = np.append(False, kinds[1:] != kinds[:-1])
        changes[a] = False
        changed = many(changes)
        low = codes | np.where(kinds == UPPER, 32, 0).astype(np.uint32)
        hexed = many((kinds == DIGIT) | ((low >= 97) & (low <= 102)))
        share = counts[DIGIT] / n
        gap = np.append(1 << 20, a[1:] - b[:-1])
        around = lambda at: np.select([kinds[at] == QUOTE, kinds[at] == EQUALS, kinds[at] == LINE, kinds[at] == SPACE], [0, 1, 2, 3], 4)
        before = around(np.maximum(a - 1, 0))
        before[a == 0] = 2
        has_equals = np.append(0, np.cumsum(kinds == EQUALS, dtype=np.int32))
        equals = has_equals[a] - has_equals[np.append(0, b[:-1])] > 0
        folded = (low & 255).astype(np.uint8)
        words = run_hashes(folded, a, b)
        last = np.append(self.text[1:] != self.text[:-1], True)
        within = lambda h, size: (h >> np.uint64(33)).astype(np.int64) % (size - 1) + 1
        near = lambda far: np.where((self.text == np.roll(self.text, far)) & (np.arange(len(a)) >= far), within(np.roll(words, far), 2_048), 0)
        changes[a] = True
        runs = np.flatnonzero(changes & inside)  # where a run of one kind begins
        at, end = np.searchsorted(runs, a), np.searchsorted(runs, b)
        shape = run_hashes(kinds[runs], at, np.minimum(end, at + 12))
        digits_of = np.bincount(self.text, counts[DIGIT], len(texts)) / np.maximum(sizes, 1)
        values = {
            "length": np.searchsorted([4, 8, 12, 16, 20, 32, 48], n, side="right"),
            "kinds": sum((counts[k] > 0) << i for i, k in enumerate((LOWER, UPPER, DIGIT, MARK, WIDE))),
            "changes": np.searchsorted([1, 2, 4, 8, 14], changed, side="right"),
            "hex": np.where(hexed < n, 0, np.where(n < 16, 1, 2)),
            "before": before,
            "after": around(np.minimum(b, len(kinds) - 1)),
            "gap": np.where(equals, 3, np.searchsorted([2, 4], gap, side="right")),
            "digits": np.searchsorted([0.01, 0.2, 0.5, 0.99], share, side="right"),
            "file_digits": np.searchsorted([0.001, 0.02, 0.1], digits_of, side="right")[self.text],
            "file_size": np.searchsorted([300, 3_000, 30_000], sizes, side="right")[self.text],
            "bias": np.zeros(len(a), np.int64),
            "shape": within(shape, 1_024),
            "head": within(run_hashes(folded, a, np.minimum(b, a + 4)), 1_024),
            "previous": near(1),
            "second": near(2),
            "next": np.where(last, 0, within(np.roll(words, -1), 2_048)),
        }
        self.features = np.stack([values[f] + OFFSETS[f] for f in FEATURES], 1).astype(np.int16)


def base_spans(text: str, hexes: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), in order."""
    low = text.lower()
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if any(w in low for w in NAMES) else []
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    if hexes is None:
        hexes = [(m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans + [(a, 2, b) for a, b in hexes])


def viterbi(scores: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The best tags of one chain; scores: tokens x 3; steps[i, j]: from tag i to j. Lower tags win ties."""
    best, back = scores[0].copy(), np.zeros(scores.shape, np.int8)
    best[IN] = -np.inf
    for t in range(1, len(scores)):
        through = best[:, None] + steps
        back[t] = through.argmax(0)
        best = through.max(0) + scores[t]
    tags = [int(best.argmax())]
    for t in range(len(scores) - 1, 0, -1):
        tags.append(int(back[t, tags[-1]]))
    return np.array(tags[::-1])


class SecretField:
    """weights: features x 3; steps: 3 x 3, where outside never leads to inside."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps
        usable = steps[np.isfinite(steps)]
        self.slack = 2 * float(usable.max() - usable.min())

    def scores(self, tokens: Tokens) -> np.ndarray:
        out = np.zeros((len(tokens.features), 3))
        for k in range(tokens.features.shape[1]):
            out += self.weights[tokens.features[:, k]]
        return out

    def tags(self, tokens: Tokens) -> np.ndarray:
        scores = self.scores(tokens)
        out = np.zeros(len(scores), np.int8)
        open_ = np.flatnonzero(scores[:, OUT] - scores[:, 1:].max(1, initial=-np.inf) <= self.slack)
        if len(open_):
            # a stretch is decoded between the certain tokens around it, or the ends of its text
            for part in np.split(open_, np.flatnonzero((np.diff(open_) > 1) | (np.diff(tokens.text[open_]) > 0)) + 1):
                lo, hi = part[0], part[-1] + 1
                lo -= bool(lo > 0 and tokens.text[lo - 1] == tokens.text[part[0]])
                hi += bool(hi < len(scores) and tokens.text[hi] == tokens.text[part[0]])
                out[lo:hi] = viterbi(scores[lo:hi], self.steps)
        return out

    def spans(self, tokens: Tokens) -> dict[int, list[tuple[int, int]]]:
        """By text: (start, end) of the tagged secrets."""
        tags, found = self.tags(tokens), {}
        for t in np.flatnonzero(tags == BEGIN).tolist():
            last = t
            while last + 1 < len(tags) and tags[last + 1] == IN and tokens.text[last + 1] == tokens.text[t]:
                last += 1
            found.setdefault(int(tokens.text[t]), []).append((int(tokens.start[t]), int(tokens.end[last])))
        return found


_ALNUM = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))


def _secret(rng: np.random.Generator) -> str:
    """A random run of letters and digits, at times with marks, behind a prefix or none."""
    body = "".join(rng.choice(_ALNUM, int(rng.integers(20, 64))))
    if rng.random() < 0.3:
        cut = int(rng.integers(6, len(body) - 6))
        body = body[:cut] + str(rng.choice(list("-_/+"))) + body[cut:]
    made_up = "".join(rng.choice(_ALNUM[26:], int(rng.integers(2, 6)))).lower() + str(rng.choice(["_", "-"]))
    return str(rng.choice(["", "", made_up, *PREFIXES])) + body


def _look_alike(rng: np.random.Generator, words: list[str]) -> str:
    """Something as long that is no secret: a path, a name of several words, a number, a time, an address."""
    w = [x for x in rng.choice(words, 5).tolist() if x.isalnum()] or ["name"]
    digits = "".join(map(str, rng.integers(0, 10, int(rng.integers(8, 16)))))
    kinds = ["/".join(["", *w]), "_".join(w), "-".join(w), "".join(x.capitalize() for x in w), f"https://{w[0]}.org/{'-'.join(w)}/{digits[:4]}", digits, f"{w[0]}{digits[:3]}@{w[-1]}.com", f"20{digits[:2]}-11-0{digits[3]}T10:{digits[4:6]}:00Z", f"{w[0].upper()}-{digits}", f"v{digits[0]}.{digits[1]}.{digits[2]}-{w[0]}"]
    return str(rng.choice(kinds))


def _made_up(rng: np.random.Generator, text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """``text`` with a secret, announced or not, or a look-alike between two of its words, and where its secrets are then."""
    real = rng.random() < 0.6
    inset = _secret(rng) if real else _look_alike(rng, text.split()[:200])
    lead = f"{rng.choice(CUES)}{rng.choice([' = ', '=', ': ', ' ', ' := '])}{rng.choice(['', chr(34), chr(39)])}" if rng.random() < (0.6 if real else 0.1) else ""
    at = text.find(" ", int(rng.integers(0, max(1, len(text))))) + 1
    more = len(lead) + len(inset) + 1
    moved = [(a + more * (a >= at), b + more * (a >= at)) for a, b in spans if not a < at < b]
    if real:
        moved.append((at + len(lead), at + len(lead) + len(inset)))
    return f"{text[:at]}{lead}{inset} {text[at:]}", moved


def _tagged(tokens: Tokens, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    """Tags of tokens whose texts have secrets at these places."""
    tags = np.zeros(len(tokens.a), np.int8)
    for k, places in enumerate(spans):
        lo, hi = np.searchsorted(tokens.text, [k, k + 1])
        for a, b in places:
            hit = lo + np.flatnonzero((tokens.start[lo:hi] < b) & (tokens.end[lo:hi] > a))
            tags[hit] = IN
            tags[hit[:1]] = BEGIN
    return tags


def _windows(tokens: Tokens, tags: np.ndarray, width: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Features and tags of stretches of ``width`` tokens around secrets and elsewhere. Places beyond a text's ends have the feature
    N_FEATURES, which is no feature, and are outside."""
    middles = np.flatnonzero(tags == BEGIN)
    middles = np.concatenate((middles, rng.integers(0, len(tags), len(middles) + 20))) if len(tags) else middles
    at = middles[:, None] - width // 2 + np.arange(width)
    inside = (at >= 0) & (at < len(tags))
    at = np.clip(at, 0, max(0, len(tags) - 1))
    inside &= tokens.text[at] == tokens.text[middles][:, None]
    return np.where(inside[:, :, None], tokens.features[at], N_FEATURES), np.where(inside, tags[at], OUT)


def train(texts: list[str], seed: int = 0, window: int = 24, rounds: int = 80) -> SecretField:
    """Likelihood of the tags of windows of tokens around secrets, and of as many windows elsewhere; gradient steps of Adam."""
    rng = np.random.default_rng(seed)
    rows = [(t, [(a if kind else m_start(t, a), b) for a, kind, b in base_spans(t)]) for t in texts]
    rows += [_made_up(rng, t, spans) for _ in range(max(1, 600 // max(1, len(rows)))) for t, spans in rows if t]
    xs, ys = [np.zeros((0, window, len(FEATURES)), np.int64)], [np.zeros((0, window), np.int64)]
    for lo, hi in slices([t for t, _ in rows], most=200_000):
        tokens = Tokens([t for t, _ in rows[lo:hi]])
        if len(tokens.a):
            x, y = _windows(tokens, _tagged(tokens, [spans for _, spans in rows[lo:hi]]), window, rng)
            xs.append(x)
            ys.append(y)
    x, y = np.concatenate(xs), np.concatenate(ys).astype(np.int64)
    if len(x) > WINDOWS:
        chosen = np.sort(rng.permutation(len(x))[:WINDOWS])
        x, y = x[chosen], y[chosen]
    weights, steps = np.zeros((N_FEATURES + 1, 3)), np.zeros((3, 3))
    steps[OUT, IN] = -np.inf
    if not len(x):
        weights[:, OUT] = 1.0
        return SecretField(weights[:-1], steps)
    y[:, 0] = np.where(y[:, 0] == IN, BEGIN, y[:, 0])
    beyond = np.where((x[:, :, :1] == N_FEATURES) & (np.arange(3) != OUT), -1e9, 0.0)
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros((3, 3)), np.zeros((3, 3))]
    total = lambda z, axis: (m := z.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(z - m).sum(axis))
    flat = x.reshape(-1, x.shape[2])
    for step in range(1, rounds + 1):
        s = sum(weights[x[:, :, k]] for k in range(x.shape[2])) + beyond
        f, b = np.empty_like(s), np.zeros_like(s)
        f[:, 0] = s[:, 0]
        f[:, 0, IN] = -1e9
        moves = np.where(np.isfinite(steps), steps, -1e9)
        for t in range(1, window):
            f[:, t] = total(f[:, t - 1][:, :, None] + moves, 1) + s[:, t]
        for t in range(window - 2, -1, -1):
            b[:, t] = total(moves + (s[:, t + 1] + b[:, t + 1])[:, None, :], 2)
        z = total(f[:, -1], 1)
        p = np.exp(f + b - z[:, None, None])
        miss = (np.eye(3)[y] - p).reshape(-1, 3)
        gw = np.stack([sum(np.bincount(flat[:, k], miss[:, tag], N_FEATURES + 1) for k in range(flat.shape[1])) for tag in range(3)], 1)
        gw[N_FEATURES] = 0
        pair = np.exp(f[:, :-1, :, None] + moves + (s + b)[:, 1:, None, :] - z[:, None, None, None]).sum((0, 1))
        gs = np.bincount((y[:, :-1] * 3 + y[:, 1:]).ravel(), minlength=9).reshape(3, 3) - pair
        for i, (value, g) in enumerate(((weights, gw / len(x) - 3e-4 * weights), (moves, gs / len(x) - 1e-4 * moves))):
            m, v = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights[N_FEATURES] = 0
        steps = np.clip(moves, -8, 8)
        steps[OUT, IN] = -np.inf
    return SecretField(weights[:-1], steps)


def m_start(text: str, start: int) -> int:
    """Where the value of an assignment begins."""
    m = ASSIGN.match(text, start)
    return m.start(2)


def training_sample(docs: DataFrame) -> DataFrame:
    """text: at most TRAIN_ROWS distinct texts with what looks like a secret, chosen by a hash of the text among about TRAIN_POOL distinct ones; of
    longer ones a stretch of TRAIN_CHARS characters whose place the hash decides."""
    h = F.xxhash64("text")
    n = docs.agg(F.approx_count_distinct(h)).first()[0]  # copies don't thin out the others
    one_in = max(1, n // TRAIN_POOL)
    pool = docs.filter(F.pmod(h, F.lit(one_in)) == 0) if one_in > 1 else docs
    begin = F.pmod(h, F.greatest(F.length("text") - TRAIN_CHARS + 1, F.lit(1))).cast("int") + 1
    seen = pool.filter(F.col("text").rlike("AKIA[A-Z0-9]{14}|[0-9a-f]{16}|(?i:password|passwd|secret|token|api_?key)"))
    seen = seen.select(h.alias("h"), F.when(F.length("text") > TRAIN_CHARS, F.substring("text", begin, F.lit(TRAIN_CHARS))).otherwise(F.col("text")).alias("text"))
    return seen.groupBy("h").agg(F.min("text").alias("text")).orderBy("h", "text").limit(TRAIN_ROWS).select("text")


def training_texts(docs: DataFrame) -> list[str]:
    return [r["text"] for r in training_sample(docs).collect()]


def fit(docs: DataFrame) -> SecretField:
    """The field of a table's sample, fitted in one task; the driver gets its weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = train([t for batch in batches for t in batch.column(0).to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array([field.weights.tobytes()], pa.binary()), pa.array([field.steps.tobytes()], pa.binary())], ["weights", "steps"])

    row = training_sample(docs).coalesce(1).mapInArrow(run, "weights binary, steps binary").first()
    if row is None:
        return train([])
    return SecretField(np.frombuffer(row["weights"]).reshape(-1, 3).copy(), np.frombuffer(row["steps"]).reshape(3, 3).copy())


def find_spans(texts: list[str], field: SecretField) -> list[list[tuple[int, int, int]]]:
    """Per text: base spans and those that the field adds, as (start, number of the kind, end)."""
    tokens = Tokens(texts)
    found = field.spans(tokens)
    is_hex = _hex_mask(tokens, texts)
    out = []
    for k, text in enumerate(texts):
        base = base_spans(text, is_hex.get(k, []))
        more = [(a, 3, b) for a, b in found.get(k, []) if b - a >= LEAST and not _covered(a, b, base)]
        out.append(sorted(base + more))
    return out


def _covered(a: int, b: int, base: list[tuple[int, int, int]]) -> bool:
    """Whether base spans (in order) leave no character of a:b out."""
    for x, _, y in base:
        if x <= a < y:
            a = y
    return a >= b


def _hex_mask(tokens: Tokens, texts: list[str]) -> dict[int, list[tuple[int, int]]]:
    """Runs of 16 and more of 0-9a-f; every such run lies inside one token."""
    out: dict[int, list[tuple[int, int]]] = {}
    for t in np.flatnonzero(tokens.b - tokens.a >= 16).tolist():
        k, a = int(tokens.text[t]), int(tokens.start[t])
        for m in _HEX.finditer(texts[k], a, int(tokens.end[t])):
            if m.end() - m.start() >= 16:
                out.setdefault(k, []).append((m.start(), m.end()))
    return out


_HEX = re.compile("[0-9a-f]+")


@lru_cache(maxsize=1)
def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, field: SecretField) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added (those of the field)."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in slices(texts, most=1_000_000):
                rows = []
                for key, spans in zip(keys[lo:hi], find_spans(texts[lo:hi], field)):
                    base = [s for s in spans if s[1] < 3]
                    rows.append((key, *(sum(s[1] == k for s in base) for k in range(3)), _digest(listed(base)), listed(spans), len(spans) - len(base)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return unique_columns(docs, ["doc_id", "text"]).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, field: SecretField, mark: str = "[SECRET]") -> DataFrame:
    """All columns; in text every span (overlapping ones as one) is replaced by ``mark``; n_chars, if there, follows. Null stays null."""
    schema = docs.schema
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            texts = batch.column(at).to_pylist()
            changed: dict[int, str] = {}
            for lo, hi in slices(texts, most=1_000_000):
                part = [t or "" for t in texts[lo:hi]]
                for k, spans in enumerate(find_spans(part, field)):
                    if spans:
                        out, end = [], 0
                        for a, _, b in spans:
                            if a >= end:
                                out += [part[k][end:a], mark]
                            end = max(end, b)
                        changed[lo + k] = "".join(out) + part[k][end:]
            columns = list(batch.columns)
            columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], batch.schema.field(at).type)
            if "n_chars" in names and changed:
                n = names.index("n_chars")
                columns[n] = pa.array([len(changed[i]) if i in changed else v for i, v in enumerate(columns[n].to_pylist())], batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
