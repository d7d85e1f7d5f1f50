"""Exact quantiles by sketch and refinement, and the published table of choices."""

import numpy as np
import pytest

from segmill.operators import clustering, personas, questions
from segmill.schema import K_TABLE

SHARES = (0.2, 0.4, 0.6, 0.8)


@pytest.mark.parametrize("accuracy", [10_000, 3])
def test_quantiles_equal_numpy(spark, monkeypatch, accuracy):
    """With a useless sketch the brackets miss, and are opened."""
    monkeypatch.setattr(personas, "ACCURACY", accuracy)
    rng = np.random.default_rng(1)
    columns = {"a": rng.normal(size=3000), "b": rng.integers(0, 3, 3000).astype(float), "c": np.full(3000, 7.0), "d": rng.exponential(size=3000)}
    rows = [tuple(None if n == "d" and i % 3 == 0 else float(v[i]) for n, v in columns.items()) + (None,) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(5)
    got = personas.quintile_edges(df, list("abcde"), SHARES).first()
    for n, v in columns.items():
        assert got[n] == pytest.approx(np.quantile(v[np.arange(3000) % 3 != 0] if n == "d" else v, SHARES), rel=1e-12)
    assert got["e"] is None


def test_quantiles_of_few_rows(spark):
    df = spark.createDataFrame([(5.0,)], "a double")
    assert personas.quintile_edges(df, ["a"], SHARES).first()["a"] == [5.0] * 4
    assert personas.quintile_edges(df.limit(0), ["a"], SHARES).first()["a"] is None


#: A published selection table, for which k = 2 must be recommended.
PUBLISHED = [
    (2, 0.3377, 1.1185, 0.9993, 0.4002, False), (3, 0.3333, 1.1159, 0.9902, 0.2356, False), (4, 0.3006, 1.1163, 0.9984, 0.1676, False), (5, 0.2937, 1.0583, 1.0, 0.1568, False),
    (6, 0.2831, 1.1163, 0.9862, 0.0632, False), (7, 0.2764, 1.1079, 0.9283, 0.0625, False), (8, 0.277, 1.0903, 0.9624, 0.0337, False), (9, 0.2643, 1.1197, 0.6547, 0.042, False),
    (10, 0.2579, 1.1244, 0.7559, 0.0219, True), (11, 0.2583, 1.0934, 0.8626, 0.0178, True), (12, 0.2567, 1.084, 0.7835, 0.0178, True), (13, 0.2552, 1.0852, 0.8133, 0.018, True),
    (14, 0.2558, 1.0874, 0.796, 0.0122, True), (15, 0.2526, 1.0878, 0.732, 0.0122, True),
]


def test_the_published_table(spark):
    assert clustering.recommend_k(spark.createDataFrame(PUBLISHED, K_TABLE)).first()["k"] == 2


def test_values_of_a_summary_are_the_first_by_name(spark):
    df = spark.range(5_000).selectExpr("concat('c', lpad(cast(id AS string), 5, '0')) AS top_category", "IF(id % 2 = 0, 'a', NULL) AS persona")
    got = questions.schema_summary(df)
    assert got["values"] == {"top_category": [f"c{i:05}" for i in range(8)], "persona": ["a"]}
