"""Recency, frequency, monetary value and what follows from them, one row per customer.

All numbers come from one aggregation; Spark adds up partial results before the shuffle, so a customer with very many lines is no
burden. The snapshot is one row and joins by broadcast.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import MARGIN, REQUIRED


def require(lines: DataFrame) -> None:
    missing = [f for f in REQUIRED if f not in lines.columns]
    if missing:
        raise ValueError(f"order lines lack {', '.join(missing)}")


def rfm(lines: DataFrame, snapshot: dt.datetime | None = None) -> DataFrame:
    """customer_id, recency, frequency, monetary, aov, clv, tenure; days count back from the snapshot (default: the last order)."""
    require(lines)
    lines = lines.filter("customer_id IS NOT NULL")
    started = F.min("order_date") if "signup_date" not in lines.columns else F.coalesce(F.min("signup_date"), F.min("order_date"))
    per = lines.groupBy("customer_id").agg(
        F.max("order_date").alias("_last"), started.alias("_start"), F.count_distinct("order_id").alias("frequency"), S.round2(S.money_sum(F.col("order_value"))).alias("monetary")
    )
    if snapshot is None:
        per = per.crossJoin(F.broadcast(lines.agg(F.max("order_date").alias("_snap"))))  # one row
    else:
        per = per.withColumn("_snap", F.lit(snapshot.isoformat(sep=" ")).cast("timestamp_ntz"))
    return per.select(
        "customer_id", S.elapsed_days(F.col("_last"), F.col("_snap")).alias("recency"), "frequency", "monetary",
        S.round2(F.col("monetary") / F.col("frequency")).alias("aov"), S.round2(F.col("monetary") * MARGIN).alias("clv"),
        F.greatest(S.elapsed_days(F.col("_start"), F.col("_snap")), F.lit(0)).alias("tenure"),
    )


def top_category(lines: DataFrame) -> DataFrame:
    """customer_id, top_category: the most frequent category, the first by name among equals; customers without any are left out."""
    counts = lines.filter("customer_id IS NOT NULL AND product_category IS NOT NULL").groupBy("customer_id", "product_category").count()
    return counts.groupBy("customer_id").agg(F.min(F.struct((-F.col("count")).alias("n"), F.col("product_category").alias("c")))["c"].alias("top_category"))


def one_hot(df: DataFrame, column: str = "top_category", prefix: str = "cat_") -> DataFrame:
    """Columns cat_<value> with 0 or 1 for every value that occurs. The driver gets the distinct values, one for each new column."""
    values = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
    return df.select("*", *[F.when(F.col(column) == v, 1).otherwise(0).cast("long").alias(f"{prefix}{v}") for v in values])


def engineer_features(lines: DataFrame, snapshot: dt.datetime | None = None, hot: bool = True) -> DataFrame:
    out = rfm(lines, snapshot)
    if "product_category" not in lines.columns:
        return out
    out = out.join(top_category(lines), "customer_id", "left")
    return one_hot(out) if hot else out


def numeric_features(features: DataFrame) -> list[str]:
    """Columns that clustering uses."""
    kinds = dict(features.dtypes)
    return [c for c in features.columns if kinds[c] in ("double", "bigint", "int", "float") and not c.startswith("cat_") and c not in ("cluster", "dim_x", "dim_y", "priority_score")]


def feature_matrix(features: DataFrame) -> DataFrame:
    """customer_id and the numeric features as doubles, missing ones 0."""
    return features.select("customer_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numeric_features(features)])
