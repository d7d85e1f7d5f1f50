"""Columns mapped by what they hold, and the assignment against every permutation."""

import datetime as dt
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmill.operators import assignment, mapping
from segmill.sources.files import ROW


def best_sum(matrix):
    rows, columns = matrix.shape
    wide = np.concatenate((matrix, np.zeros((rows, rows))), 1)
    return max(float(wide[np.arange(rows), list(p)].sum()) for p in permutations(range(columns + rows), rows))


def test_the_assignment_is_the_best_one():
    rng = np.random.default_rng(0)
    for _ in range(200):
        m = np.where(rng.random((rows := rng.integers(1, 5), cols := rng.integers(1, 5))) < 0.3, 0.0, rng.random((rows, cols)).round(1))
        chosen = assignment.assign(m)
        used = [c for c in chosen if c >= 0]
        assert len(set(used)) == len(used)
        assert sum(m[i, c] for i, c in enumerate(chosen) if c >= 0) == pytest.approx(best_sum(m))


def export(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        order = i // 3
        customer = (order * 31) % 47
        day = dt.date(2023, 1, 1) + dt.timedelta(days=(order * 17) % 400)
        quantity, price = int(rng.integers(1, 9)), float(rng.integers(200, 9000)) / 100
        rows.append((f"cus-{customer:05}", str(70_000 + order), day.strftime("%d-%m-%Y"), f"${quantity * price:,.2f}", str(quantity), f"{price:.2f}", ["Toys", "Books", "Garden"][i % 3], f"c{customer}@shop.org", (dt.date(2020, 5, 1) + dt.timedelta(days=customer * 3)).isoformat(), "free text no " + str(i * 7919 % 1000), None))
    fields = ["customer_id", "order_id", "order_date", "order_value", "quantity", "unit_price", "product_category", "customer_email", "signup_date", "none", "none"]
    order = np.random.default_rng(seed + 1).permutation(len(fields))
    names = [f"col {k}.x" for k in range(len(fields))]
    df = spark.createDataFrame([tuple(r[j] for j in order) for r in rows], ", ".join(f"c{k} string" for k in range(len(fields)))).toDF(*names)
    return df, {n: fields[j] for n, j in zip(names, order)}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_columns_without_telling_names(spark, seed):
    df, want = export(spark, seed=seed)
    got = assignment.map_by_values(df.withColumn(ROW, F.monotonically_increasing_id()))
    assert {m["raw_column"]: m["internal_field"] for m in got} == want
    assert all(0 <= m["confidence"] <= 1 for m in got)


def test_two_columns_that_fit_equally_are_unsure(spark):
    df, want = export(spark)
    value = next(c for c, f in want.items() if f == "customer_email")
    both = assignment.map_by_values(df.withColumn("again", F.col(f"`{value}`")))
    sure = {m["raw_column"]: m["confidence"] for m in assignment.map_by_values(df)}
    found = {m["raw_column"]: m for m in both}
    assert found[value]["internal_field"] == "customer_email" and found["again"]["internal_field"] == "none"  # ties go to the earlier column
    assert found[value]["confidence"] <= 0.51 < sure[value]


def test_names_decide_where_values_do_not(spark):
    df = spark.createDataFrame([(f"{i}", f"{i % 7}") for i in range(200)], "a string, `Support Tickets` string")
    got = {m["raw_column"]: m["internal_field"] for m in assignment.map_by_values(df, mapping.name_scores(df.columns))}
    assert got["Support Tickets"] == "support_tickets"


def test_nothing_to_map(spark):
    assert assignment.map_by_values(spark.createDataFrame([], "a string, b string")) == [{"raw_column": c, "internal_field": "none", "confidence": 0.0} for c in "ab"]
    assert assignment.map_by_values(spark.range(3).select()) == []


def test_a_file_is_mapped_without_a_mapper(spark, tmp_path):
    df, want = export(spark)
    (tmp_path / "x.csv").write_text("\n".join([",".join(df.columns), *[",".join('"' + (v or "") + '"' for v in r) for r in df.collect()]]))
    raw, proposals, report = mapping.run_mapping(spark, str(tmp_path / "x.csv"), None)
    assert {p["raw_column"]: p["internal_field"] for p in proposals} == {c: f for c, f in want.items() if c in raw.columns}
    assert report.status != "rejected" and mapping.apply_mapping(raw, report.mapping).count() == 600


def test_the_customers_day_is_told_from_the_orders_day():
    """Among very many rows hardly any day is unique, and an order determines both days; distinct counts are off by a few hundredths."""
    plain = {"n": 6e5, "date": 0.0, "whole": 0.0, "amount": 1.0, "email": 0.0, "words": 0.0, "cents": 0.0, "spaced": 0.0, "mean": 0.0}
    features = {c: plain | {"distinct": n, "unique": n / 6e5} for c, n in (("order", 1.5e5), ("customer", 1.5e4))}
    features |= {c: plain | {"amount": 0.0, "date": 1.0, "distinct": n, "unique": n / 6e5} for c, n in (("ordered", 2400), ("signed", 900))}
    depends = {("order", "customer"): 1.02, ("customer", "order"): 10.0, ("order", "ordered"): 0.99, ("order", "signed"): 1.02, ("customer", "ordered"): 9.8, ("customer", "signed"): 1.03}
    valued = assignment.scores(features, depends, {})
    assert valued["ordered"]["order_date"] + valued["signed"]["signup_date"] > valued["signed"]["order_date"] + valued["ordered"]["signup_date"] + 0.1


def test_patterns_meet_shapes_and_numbers_are_read_once(spark, monkeypatch):
    """Neither are patterns tried on every row, nor is a column's number read again for each product."""
    frames, plans = type(spark.range(1)), []
    for name in ("collect", "first"):

        def run(self, *args, plain=getattr(frames, name)):
            plans.append(self._jdf.queryExecution().executedPlan().toString())
            return plain(self, *args)

        monkeypatch.setattr(frames, name, run)
    df = spark.createDataFrame([(f"{i}", f"{i % 7}", f"{i * (i % 7)}.00", f"0{i}/03/2020") for i in range(100, 300)] + [(None, " ", "x", "-5")], "a string, b string, c string, d string")
    features = assignment.column_features(df)
    assert all(re.search(r"keys=\[i#\d+, v#\d+\]", p) for p in plans if "RLIKE" in p) and any("RLIKE" in p for p in plans)
    assert (features["a"]["n"], features["b"]["n"], features["c"]["n"]) == (200, 200, 201)
    assert features["d"]["date"] == 200 / 201 and features["d"]["amount"] == 1 / 201 and features["c"]["cents"] == 200 / 201 and features["b"]["whole"] == 1
    assert features["b"]["mean"] == pytest.approx(np.mean([i % 7 for i in range(100, 300)]))
    plans.clear()
    depends, products = assignment.column_relations(df, ["a", "b"], ["d"], ["a", "b", "c"])
    assert sum(p.count("regexp_replace(") for p in plans) <= 3 * 4  # a number holds it twice, a plan is printed twice
    assert products["a", "b", "c"] == 200 / 201 and depends["a", "b"] == pytest.approx(1, abs=0.05) and depends["b", "a"] > 20
