"""Samples and joins when one key or text has most of the rows."""

import numpy as np

from segmill.llm import neardup, quality, secrets
from tests.llm.test_ops import plain_components, prose


def test_labels_of_other_documents_take_no_place_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_ROWS", 100)
    good, bad = (lambda i: prose(i, 60)), (lambda i: "buy!!! 1234 $$$ " * 12 + str(i))
    docs = spark.createDataFrame([(i, good(i) if i % 2 else bad(i)) for i in range(200)], "doc_id long, text string")
    labels = spark.range(50_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert np.mean([scores[i] >= 0.5 for i in range(1, 200, 2)]) > 0.95 and np.mean([scores[i] < 0.5 for i in range(0, 200, 2)]) > 0.95


def test_labels_meet_a_doc_id_with_many_rows_once(spark):
    docs = spark.range(3_000).selectExpr("IF(id < 2900, 5, id) AS doc_id", "IF(id % 2 = 0, 'fine words here', 'x!!') AS text")
    labels = spark.range(3_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    assert quality.score(docs, quality.train(docs, labels)).count() == 3_000


def test_copies_do_not_thin_out_the_secret_sample(spark, monkeypatch):
    monkeypatch.setattr(secrets, "TRAIN_POOL", 100)
    others = spark.createDataFrame([(f"password = abcdef123456{i}",) for i in range(50)], "text string")
    table = spark.range(100_000).selectExpr("'password: 0123456789abcdef' AS text").unionByName(others)
    assert secrets.training_sample(table).count() == 51


def test_rows_that_share_a_doc_id(spark):
    rows = [(7, prose(i // 2, 80) + (" more" if i % 2 else "")) for i in range(600)] + [(i, prose(i % 30, 80)) for i in range(8, 60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(table).collect())
    # Brute force over rows of their own, then named by the doc_ids.
    sizes, top = plain_components(list(enumerate(t for _, t in rows)), 85)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[top[i]] = min(least.get(top[i], doc), doc)
    assert got == sorted((doc, len(sizes[i]), least[top[i]]) for i, (doc, _) in enumerate(rows))


def test_whole_sets_do_not_multiply(spark):
    rows = [(7, prose(i, 30)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = neardup.sketches(docs).selectExpr("k1", "k2", "doc_id AS doc", "h").distinct().selectExpr("monotonically_increasing_id() AS id", "*")
    plan = neardup._whole_sets(docs, made)
    assert plan.count() == 400
