"""A stream of order lines against the features of all lines at once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from segmill.operators import cleaning, clustering, features
from segmill.streaming import customers

SCHEMA = "customer_id string, order_id string, order_date timestamp_ntz, order_value double, quantity long, signup_date timestamp_ntz"


@pytest.fixture
def rocks(spark):
    spark.conf.set(*customers.STORE)
    yield spark
    spark.conf.unset(customers.STORE[0])


def made(n=120, seed=0):
    day = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        k = (i * 7919 + seed) % 23
        rows.append((f"c{k}", f"o{i // 2}", day + dt.timedelta(hours=37 * i % 4000, microseconds=i), round(3.1 * (i % 17) + 0.105, 3), i % 5, day - dt.timedelta(days=k) if k % 3 else None))
    return rows


def run(spark, tmp_path, quiet=None):
    stream = customers.line_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, files=1)
    customers.follow(stream, str(tmp_path / "out"), str(tmp_path / "check"), quiet).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_the_stream_ends_where_the_batch_does(rocks, tmp_path):
    lines = sorted(made(), key=lambda r: r[2])
    late, repeated = lines[5:15], lines[30:45]
    files = [lines[:5] + lines[15:70], repeated + lines[70:] + lines[70:75], late + repeated + [(None, "o1", lines[0][2], 1.0, 1, None)]]
    for k, part in enumerate(files):
        rocks.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k != 1:  # the second and third file come in one run, one batch each
            updates = run(rocks, tmp_path)
        if k == 0:
            want = features.rfm(rocks.createDataFrame(files[0], SCHEMA))
            assert rows_of(customers.features_now(updates)) == rows_of(want)
    everything = cleaning.drop_repeated_rows(rocks.createDataFrame([r for f in files for r in f], SCHEMA))
    batch = features.rfm(everything)
    assert rows_of(customers.features_now(updates)) == rows_of(batch)
    assert updates.groupBy("customer_id", "version").count().filter("count > 1").isEmpty()
    model = clustering.fit_final(batch, features.numeric_features(batch), 3, starts=1)
    assert rows_of(customers.score_now(updates, model).select("customer_id", "cluster")) == rows_of(clustering.assign(model, batch).select("customer_id", "cluster"))
    later = dt.datetime(2025, 1, 1)
    assert rows_of(customers.features_now(updates, later)) == rows_of(features.rfm(everything, later))


def test_timers_tell_who_is_quiet(rocks, tmp_path):
    rocks.createDataFrame(made(20), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    first = customers.current(run(rocks, tmp_path, dt.timedelta(milliseconds=1)))
    assert first.filter("quiet").isEmpty()
    rocks.createDataFrame([("new", "o", dt.datetime(2024, 5, 1), 2.0, 1, None)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = customers.current(run(rocks, tmp_path, dt.timedelta(milliseconds=1)))
    assert {r["customer_id"]: r["quiet"] for r in again.collect()} == {**{r[0]: True for r in made(20)}, "new": False}
    assert rows_of(customers.features_now(again).filter(F.col("customer_id") != "new").select("customer_id", "monetary")) == rows_of(customers.features_now(first).select("customer_id", "monetary"))
