"""Operators 11 to 13 against brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from segmill.llm import alignment, fingerprints, runs
from tests.llm.test_ops import BASE, ROWS, SCHEMA, SF, prose

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(20, "na " * 40 + "end", "en", "s", 1, 1.0), (21, "<|endoftext|> is </s> plain <0x41> ▁", "en", "s", 1, 1.0), (22, "tail　ＡＢ ﬁ  two  spaces ", "en", "s", 1, 1.0), (None, "three little words", "fr", "s", 3, 1.0), (23, "a b " * 30 + prose(3, 40), "en", "s", 1, 1.0)]
    return spark.createDataFrame(ROWS + odd, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# 11


def plain_runs(s, least_words=2, least_periods=2):
    out = []
    for p in range(1, len(s) // 2 + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            length = j + p - i
            shorter = any(all(s[t] == s[t + q] for t in range(i, j + p - q)) for q in range(1, p)) if length >= 2 * p else True
            if not shorter and length >= max(least_words, least_periods * p):
                out.append((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = np.random.default_rng(0)
    for k in range(1500):
        s = rng.integers(0, rng.integers(1, 4), rng.integers(0, 45))
        if k % 3 == 0 and len(s) > 5:
            s = np.tile(s[: rng.integers(1, 6)], len(s))[: len(s)]
        assert [tuple(r) for r in runs.runs(s).tolist()] == plain_runs(s.tolist())
        words = [b"%d" % x for x in s]
        for least in ((6, 4), (2, 2), (5, 3)):
            assert [tuple(r) for r in runs.word_runs(words, *least).tolist()] == plain_runs(s.tolist(), *least)


@pytest.mark.parametrize("a, b", [("a", "ab"), ("ab", "a"), ("abaab", "ab")])
def test_runs_of_fibonacci_like_words(a, b):
    for _ in range(6):
        a, b = a + b, a
    s = [ord(c) for c in a]
    assert [tuple(r) for r in runs.runs(np.array(s)).tolist()] == plain_runs(s)


def test_the_vocabulary_is_every_distinct_square():
    s = np.random.default_rng(5).integers(0, 2, 60)
    closed = np.append(s, 2)
    tree, ext = runs.SuffixTree(closed.tolist()), runs.Extensions(closed)
    marks = runs.vocabulary(tree, *runs.covering_squares(tree.blocks(), ext))
    found = sorted(tuple(closed[tree.first[v] : tree.first[v] + d].tolist()) for v, d in marks)
    squares = {tuple(s[i : i + 2 * k].tolist()) for k in range(1, 31) for i in range(61 - 2 * k) if (s[i : i + k] == s[i + k : i + 2 * k]).all()}
    assert found == sorted(squares)


def test_runs_of_long_texts_take_linear_space():
    assert runs.word_runs([b"x"] * 200_000).tolist() == [[0, 200_000, 1]]
    mixed = [b"%d" % x for x in np.random.default_rng(1).integers(0, 30, 60_000)]
    assert runs.word_runs(mixed + mixed[-100:] * 9)[-1].tolist() == [59_900, 1000, 100]


def plain_op11(doc_id, text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words, 6, 4)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines, kept = "".join("%d,%d,%d\n" % r for r in found), " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, best[1] * 1000 // best[2] if found else None, sha(lines), sha(kept))


CONTRACT_11 = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_op11_equals_the_plain_version(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    short = [(i, prose(i, 12 + i % 90)) for i in range(30, 330)]
    spark.createDataFrame(short, "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    got = runs.op11_periodic_runs(spark, str(tmp_path)).select(CONTRACT_11)
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", "text").collect() if len(r["text"] or "") < 20_000]
    longs = {8}
    want = [plain_op11(*r) for r in given]
    assert sorted((r for r in rows_of(got) if r[0] not in longs), key=repr) == sorted(want, key=repr)
    assert sum(r[1] for r in want) > 10


def test_op11_of_nothing(none):
    assert rows_of(runs.periodic_runs(none)) == []


# 12


def test_extensions_and_joined_arrays():
    rng = np.random.default_rng(2)
    s, t = ("".join(rng.choice(list("ab"), 300)) for _ in range(2))
    x, y = (fingerprints.PrefixHashes(fingerprints.code_points(v)) for v in (s, t))
    a, b = rng.integers(0, 301, 400), rng.integers(0, 301, 400)

    def plain(s, i, t, j):
        k = 0
        while i + k < len(s) and j + k < len(t) and s[i + k] == t[j + k]:
            k += 1
        return k

    assert fingerprints.extensions(x, a, y, b).tolist() == [plain(s, i, t, j) for i, j in zip(a, b)]
    assert fingerprints.extensions(x, a, y, b, backward=True).tolist() == [plain(s[::-1], 300 - i, t[::-1], 300 - j) for i, j in zip(a, b)]
    one = fingerprints.PrefixHashes(fingerprints.code_points(s[:123] + t[:77]))
    assert all((p == q).all() for p, q in zip(one.arrays, x.joined(123, y, 77).arrays))


def test_arrays_of_long_texts_are_built_in_stretches(monkeypatch):
    text = prose(9, 200)
    whole = fingerprints.PrefixHashes(fingerprints.code_points(text))
    spans = whole.windows(24)
    monkeypatch.setattr(fingerprints, "STRETCH", 100)
    parts = fingerprints.PrefixHashes(fingerprints.code_points(text))
    assert all((p == q).all() for p, q in zip(whole.arrays, parts.arrays)) and (parts.windows(24) == spans).all()


def test_likeness_is_the_jaccard_similarity_of_spans():
    grams = lambda t, w: {t[i : i + w] for i in range(len(t) - w + 1)}
    a, b = prose(4, 20), prose(4, 20)[:70] + "quite another end"
    for x, y in ((a, b), (a, a), ("", ""), ("", "x"), ("abcdefgh", "abcdefgx")):
        w = fingerprints.NARROW
        want = 1.0 if x == y else len(grams(x, w) & grams(y, w)) / len(grams(x, w) | grams(y, w) or "x")
        assert fingerprints.likeness(fingerprints.fingerprint(x), fingerprints.fingerprint(y)) == pytest.approx(want, abs=0.1)
    long = prose(6, 3000)
    changed = long[:9000] + prose(7, 1000)
    g, h = grams(long, 24), grams(changed, 24)
    assert fingerprints.likeness(fingerprints.fingerprint(long), fingerprints.fingerprint(changed)) == pytest.approx(len(g & h) / len(g | h), abs=0.15)


def test_op12_pairs_rows_with_the_next_and_equals_the_plain_version(spark, docs):
    got = rows_of(fingerprints.compare_next(docs))
    given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted((r[:2] for r in got), key=repr) == sorted(((i, len(t or "")) for i, t in given), key=repr)
    distinct = {i: t or "" for i, t in given if i is not None}
    ids = sorted((i for i in distinct if i != 2), reverse=True)
    after = dict(zip(ids, ids[1:]))
    by_id = {r[0]: r for r in got if r[0] in after and after[r[0]] is not None}
    for i, j in after.items():
        if {i, j} & {3, 1}:
            continue  # neighbours of the repeated doc_id
        text, n = distinct[i], len(distinct[i])
        edited = text[: n - n // 2] + distinct[j][: n // 2]
        prints = [fingerprints.fingerprint(t) for t in (text, edited, distinct[j])]
        common = lambda u, v: next((k for k, (p, q) in enumerate(zip(u, v)) if p != q), min(len(u), len(v)))
        assert by_id[i] == (i, n, hashlib.sha256(edited.encode()).hexdigest(), *prints[:2], fingerprints.likeness(*prints[:2]), fingerprints.likeness(prints[0], prints[2]), common(text, edited), common(text, distinct[j]))


def test_op12_wraps_over_many_ranges_and_hot_ids(spark, none):
    table = spark.range(400).selectExpr("id doc_id", "concat('text number ', id, ' of many') text").repartition(7)
    got = {r["doc_id"]: r for r in fingerprints.compare_next(table).collect()}
    for i in range(400):
        text, after = f"text number {i} of many", f"text number {(i - 1) % 400} of many"
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    hot = spark.range(300).selectExpr("if(id < 200, 7, id) doc_id", "if(id < 100, 'same', concat('t', id)) text").repartition(5)
    assert Counter(r["doc_id"] for r in fingerprints.compare_next(hot).collect()) == Counter({7: 200, **{i: 1 for i in range(200, 300)}})
    assert rows_of(fingerprints.compare_next(none)) == []
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    assert [(r["near_next"], r["edited_sha256"]) for r in fingerprints.compare_next(one).collect()] == [(1.0, hashlib.sha256(b"abcabc").hexdigest())]


# 13


def plain_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    table = alignment.byte_characters()
    of_a = lambda i: bytes(table[c] for c in ta.id_to_token(i))
    of_b = lambda i: bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for key, text in rows:
        a, b = ([], []) if not text else (ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text))
        want = (" " + (text or "")).encode()
        if not text or b"".join(map(of_a, a)) != want or b"".join(map(of_b, b)) != want:
            found.append((key, 0, 0, 0, [], ""))
            continue
        ends = [list(np.cumsum([len(f(i)) for i in x])) for f, x in ((of_a, a), (of_b, b))]
        pairs = [(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if max(ends[0][i] - len(of_a(x)), ends[1][j] - len(of_b(y))) < min(ends[0][i], ends[1][j])]
        counts.update(pairs)
        text, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            m, k = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            text.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:k])))
            i, j = m, k
        found.append((key, len(a), len(b), len(text), pairs, hashlib.sha256(";".join(text).encode()).hexdigest()))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    return [(k, na, nb, ng, len(p), sum(counts[q] == top[q[1]] for q in p), sum(counts[q] for q in p), d) for k, na, nb, ng, p, d in found]


def small(docs):
    return docs.filter("doc_id is null or doc_id <> 8")


@pytest.mark.parametrize("most", [200_000, 20])
def test_op13_equals_the_plain_version(spark, docs, most, monkeypatch):
    monkeypatch.setattr(alignment.look_up, "__defaults__", (most,))
    some = small(docs)
    got = rows_of(alignment.align(some, A, B))
    want = plain_alignment([(r["doc_id"], r["text"]) for r in some.select("doc_id", "text").collect()])
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[4] for r in got) > 1000 and sum(r[1] == 0 for r in got) >= 3


def test_op13_on_the_given_documents(spark):
    some = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 1500")
    got = rows_of(alignment.align(some, A, B))
    assert sorted(got) == sorted(plain_alignment([(r["doc_id"], r["text"]) for r in some.select("doc_id", "text").collect()]))


def test_op13_of_nothing(none):
    assert rows_of(alignment.align(none, A, B)) == []


def test_links_overlap():
    assert alignment.overlaps([3], [3]) == [(0, 0)]
    assert alignment.overlaps([2, 3], [4, 1]) == [(0, 0), (1, 0), (1, 1)]
    assert alignment.overlaps([1, 1, 4], [3, 3]) == [(0, 0), (1, 0), (2, 0), (2, 1)]
    assert BASE
