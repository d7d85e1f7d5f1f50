"""Customers kept up to date from a stream of order lines.

Each customer has a state: sign-up, first and last order, distinct orders, money, and the lines seen, so that a line that comes twice counts
once and a late one counts as if it had come in time. Every batch of files emits what changed, one row per customer that got a new line,
with a growing ``version``; the last version of each is the truth (``current``), and from it follow the same features as from all lines at
once. A customer from whom nothing was heard for ``quiet`` emits a row that says so when a timer rings; a new line takes it back.

State and progress live in the checkpoint folder: a stream that stops goes on where it was. Lines without a customer are left out. State
grows with the distinct lines of a customer, whose lines one task handles, in pieces.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions import scalars as S
from ..operators.clustering import assign
from ..schema import MARGIN

#: The state store that keeps maps within a state.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
UPDATES = "customer_id string, signup string, first string, last string, frequency long, money decimal(38,8), quiet boolean, version long"
FACTS = ("signup", "first", "last", "frequency", "money", "version")


class _Customer(StatefulProcessor):
    """Dates are texts of fixed width, which sort as dates do."""

    def __init__(self, quiet: dt.timedelta | None):
        self.quiet = None if quiet is None else int(quiet.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", "signup string, first string, last string, frequency long, money decimal(38,8), version long")
        self.orders = handle.getMapState("orders", "order_id string", "seen boolean")
        self.lines = handle.getMapState("lines", "line long", "seen boolean")

    def _row(self, key: Any, facts: tuple, quiet: bool) -> pd.DataFrame:
        signup, first, last, frequency, money, version = facts
        return pd.DataFrame({"customer_id": [key[0]], "signup": [signup], "first": [first], "last": [last], "frequency": [frequency], "money": [money], "quiet": [quiet], "version": [version]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        signup, first, last, frequency, money, version = self.facts.get() if self.facts.exists() else (None, None, None, 0, Decimal(0), 0)
        changed = False
        least = lambda a, b: b if a is None else a if b is None else min(a, b)
        for part in rows:
            for line, order, date, value, sign in part[["line", "order_id", "date", "value", "signup"]].itertuples(index=False, name=None):
                if self.lines.containsKey((int(line),)):
                    continue
                self.lines.updateValue((int(line),), (True,))
                changed = True
                if order is not None and not self.orders.containsKey((order,)):
                    self.orders.updateValue((order,), (True,))
                    frequency += 1
                signup, first = least(signup, sign), least(first, date)
                last = date if last is None or (date is not None and date > last) else last
                money += value if value is not None else 0
        if not changed:
            return
        facts = (signup, first, last, frequency, money, version + 1)
        self.facts.update(facts)
        if self.quiet is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
        yield self._row(key, facts, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        *facts, version = self.facts.get()
        facts = (*facts, version + 1)
        self.facts.update(facts)
        yield self._row(key, facts, True)

    def close(self) -> None:
        pass


def line_stream(spark: SparkSession, folder: str, schema: StructType, files: int = 100) -> DataFrame:
    """Order lines from Parquet files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def customer_updates(lines: DataFrame, quiet: dt.timedelta | None = None) -> DataFrame:
    """A stream of changes, one row for each customer that a batch changed. lines: cleaned order lines, a stream. The session's state store must
    be RocksDB (``STORE``)."""
    text = lambda c: F.date_format(F.col(c).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    signup = text("signup_date") if "signup_date" in lines.columns else F.lit(None).cast("string")
    keyed = lines.filter("customer_id IS NOT NULL").select(
        "customer_id", F.xxhash64(*lines.columns).alias("line"), "order_id", text("order_date").alias("date"), F.col("order_value").cast("decimal(38,8)").alias("value"), signup.alias("signup"),
    )
    mode = "None" if quiet is None else "ProcessingTime"
    return keyed.groupBy("customer_id").transformWithStateInPandas(_Customer(quiet), StructType.fromDDL(UPDATES), "Append", mode)


def follow(lines: DataFrame, out: str, checkpoint: str, quiet: dt.timedelta | None = None) -> StreamingQuery:
    """Takes all files that are there, appends the changes to ``out`` and ends; started again with the same checkpoint it goes on. With timers one
    batch takes all files, since batches for timers would never end; those that have rung meanwhile are heard then."""
    writer = customer_updates(lines, quiet).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if quiet is None else writer.trigger(once=True)).start(out)


def current(updates: DataFrame) -> DataFrame:
    """The last version of each customer."""
    last = F.max_by(F.struct(*[c for c in updates.columns if c not in ("customer_id", "version")]), "version")
    return updates.groupBy("customer_id").agg(last.alias("u"), F.max("version").alias("version")).select("customer_id", "u.*", "version")


def features_now(updates: DataFrame, snapshot: dt.datetime | None = None) -> DataFrame:
    """The features of ``features.rfm`` from the changes written so far; days count back from the snapshot (default: the last order)."""
    date = lambda c: F.col(c).cast("timestamp_ntz")
    now = current(updates).withColumns({"_last": date("last"), "_start": F.coalesce(date("signup"), date("first")), "monetary": S.round2(F.col("money").cast("double"))})
    if snapshot is None:
        now = now.crossJoin(F.broadcast(updates.agg(F.max("last").cast("timestamp_ntz").alias("_snap"))))  # one row
    else:
        now = now.withColumn("_snap", F.lit(snapshot.isoformat(sep=" ")).cast("timestamp_ntz"))
    return now.select(
        "customer_id", S.elapsed_days(F.col("_last"), F.col("_snap")).alias("recency"), "frequency", "monetary",
        S.round2(F.col("monetary") / F.col("frequency")).alias("aov"), S.round2(F.col("monetary") * MARGIN).alias("clv"),
        F.greatest(S.elapsed_days(F.col("_start"), F.col("_snap")), F.lit(0)).alias("tenure"),
    )


def score_now(updates: DataFrame, model: PipelineModel, snapshot: dt.datetime | None = None) -> DataFrame:
    """The customers' clusters by a fitted model, as of the changes written so far."""
    return assign(model, features_now(updates, snapshot))
