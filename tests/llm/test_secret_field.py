"""What the field adds to the base patterns: planted secrets of forms that neither the patterns nor its training know."""

import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmill.llm import secrets

SF = "/root/testdata/sf0.001"
#: Lead, fixed beginning, length and characters of the random rest.
FORMS = [
    ("", "AIza", 35, ""), ("Authorization: Bearer ", "", 40, ""), ("SENDGRID=", "npm_", 36, ""), ("AccountKey=", "", 64, "+/"), ("pwd: ", "", 24, ""),
    ("", "ghs_", 36, ""), ("client id and ", "pypi-", 60, ""), ("dsn='", "", 32, ""), ("ssh-rsa ", "", 70, "/"), ("hook ", "T0", 24, "_"),
]
PLAIN = ["see https://example.org/docs/getting-started/install-guide now", "in /usr/local/share/applications/readme we read", "call update_customer_address_record twice", "ISBN 9783161484100 and 2024-11-03T10:15:00Z", "SegmentedCustomerRevenueReport is a name"]


def planted(texts, seed):
    rng = np.random.default_rng(seed)
    for n, text in enumerate(texts):
        lead, begin, size, marks = FORMS[n % len(FORMS)]
        secret = begin + "".join(rng.choice(list(string.ascii_letters + string.digits + marks), size))
        at = text.find(" ", int(rng.integers(0, len(text)))) + 1
        yield f"{text[:at]}{lead}{secret} {text[at:]}", at + len(lead), at + len(lead) + len(secret)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def field(documents):
    return secrets.fit(documents)


def test_recall_and_precision_on_planted_secrets(documents, field):
    hosts = [r["text"] for r in documents.filter("length(text) BETWEEN 200 AND 4000").orderBy("doc_id").collect()]
    hosts = [t for t in hosts if not secrets.base_spans(t)][:100]
    hit = other = 0
    for text, lo, hi in planted(hosts, 5):
        spans = [(a, b) for a, kind, b in secrets.find_spans([text], field)[0] if kind == 3]
        hit += any(min(b, hi) - max(a, lo) >= 0.9 * (hi - lo) for a, b in spans)
        other += sum(a >= hi or b <= lo for a, b in spans)
    assert len(hosts) >= 50 and hit >= 0.9 * len(hosts) and other <= 0.1 * (hit + other)
    assert not any(secrets.find_spans(PLAIN, field)) and not any(kind == 3 for s in secrets.find_spans(hosts, field) for _, kind, _ in s)


def test_the_query_counts_added_spans(spark, documents, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in documents.filter("length(text) BETWEEN 200 AND 4000").orderBy("doc_id").limit(60).collect()]
    changed = [(i, t) for (i, _), (t, _, _) in zip(rows, planted([t for _, t in rows], 9))]
    rest = documents.select("doc_id", "text").join(spark.createDataFrame(rows, "doc_id long, text string").select("doc_id"), "doc_id", "left_anti")
    rest.unionByName(spark.createDataFrame(changed, "doc_id long, text string")).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in secrets.op5_secrets(spark, str(tmp_path)).collect()}
    assert sum(got[i]["n_added"] > 0 for i, _ in rows) >= 0.9 * len(rows)
    for r in got.values():
        assert r["n_added"] == r["spans"].count("crf:") and r["n_assign"] + r["n_access"] + r["n_hex"] + r["n_added"] == (r["spans"].count(":") // 2)


def test_windows_stay_inside_their_text():
    texts = ["a few words", "token = abcdefghijklmnop12 and more", ""]
    tokens = secrets.Tokens(texts)
    tags = secrets._tagged(tokens, [[], [(8, 26)], []])
    x, y = secrets._windows(tokens, tags, 8, np.random.default_rng(0))
    for features, tag in zip(x, y):
        real = features[:, 0] < secrets.N_FEATURES
        rows = [int(np.flatnonzero((tokens.features == f).all(1))[0]) for f in features[real]]
        assert len(set(tokens.text[rows].tolist())) == 1 and (tag[~real] == secrets.OUT).all()


def test_the_sample_is_distinct_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(secrets, "TRAIN_ROWS", 5)
    monkeypatch.setattr(secrets, "TRAIN_CHARS", 60)
    rows = [("token = abcdefghijklmnop",)] * 300 + [(f"{i} token = abcdefghijklmnop{i}",) for i in range(20)] + [("x " * 90 + "token = abcdefghijklmnop",)]
    got = secrets.training_texts(spark.createDataFrame(rows, "text string").withColumn("n", F.lit(1)).repartition(3))
    assert len(got) == len(set(got)) == 5 and all(len(t) <= 60 for t in got)
