"""Where revenue sits, and what may be lost. Two aggregations over one table; percentages of customers use valid rows in the first
report and all rows in the second."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import AT_RISK


def _valued(df: DataFrame, segment: str, value: str) -> DataFrame:
    v = F.col(value).cast("string").try_cast("double") if dict(df.dtypes)[value] == "string" else F.col(value).cast("double")
    return df.select(F.col(segment).alias("segment"), F.when((v > 0) & ~F.isnan(v), v).alias("v"))


def concentration(df: DataFrame, segment: str = "persona", monetary: str = "monetary") -> DataFrame:
    """Per segment: customer_count, pct_of_customers, total_revenue, pct_of_revenue, avg_revenue_per_customer; the largest share first.
    Rows of no segment count in the totals only."""
    per = _valued(df, segment, monetary).filter("v IS NOT NULL").groupBy("segment").agg(F.count("*").alias("customer_count"), S.money_sum(F.col("v")).alias("r"))
    whole = Window.partitionBy(F.lit(1))  # over one row per segment
    shares = per.select("segment", "customer_count", "r", F.sum("customer_count").over(whole).alias("n"), F.sum("r").over(whole).alias("total"))
    out = shares.filter("segment IS NOT NULL").orderBy(F.desc(F.col("r") / F.col("total")), "segment")
    c = F.col
    return out.select(
        "segment", "customer_count", S.round2(c("customer_count") / c("n") * 100).alias("pct_of_customers"), S.round2(c("r")).alias("total_revenue"),
        S.round2(c("r") / c("total") * 100).alias("pct_of_revenue"), S.round2(c("r") / c("customer_count")).alias("avg_revenue_per_customer"),
    )


def concentration_totals(df: DataFrame, segment: str = "persona", monetary: str = "monetary") -> DataFrame:
    """One row: total_revenue, total_customers, excluded_count, avg_revenue_per_customer."""
    v = _valued(df, segment, monetary).agg(F.count("v").alias("total_customers"), F.count_if(F.col("v").isNull()).alias("excluded_count"), F.coalesce(S.money_sum(F.col("v")), F.lit(0.0)).alias("t"))
    return v.select(S.round2(F.col("t")).alias("total_revenue"), "total_customers", "excluded_count", S.round2(F.coalesce(F.try_divide("t", "total_customers"), F.lit(0.0))).alias("avg_revenue_per_customer"))


def clv_breakdown(df: DataFrame, segment: str = "persona", clv: str = "clv", patterns: list[str] = AT_RISK) -> DataFrame:
    """Per segment that matches a pattern: customer_count (all rows), total_clv, pct_of_total_clv."""
    per = _valued(df, segment, clv).groupBy("segment").agg(F.count("*").alias("customer_count"), F.coalesce(S.money_sum(F.col("v")), F.lit(0.0)).alias("c"))
    shares = per.withColumn("total", F.sum("c").over(Window.partitionBy(F.lit(1))))  # over one row per segment
    hit = shares.filter(F.col("segment").isNotNull() & S.contains_any(F.col("segment"), patterns))
    return hit.select("segment", "customer_count", S.round2(F.col("c")).alias("total_clv"), S.round2(F.coalesce(F.try_divide("c", "total"), F.lit(0.0)) * 100).alias("pct_of_total_clv"))


def clv_at_risk(df: DataFrame, segment: str = "persona", clv: str = "clv", patterns: list[str] = AT_RISK) -> DataFrame:
    """One row; customers count whether or not their value is valid."""
    hit = F.coalesce(S.contains_any(F.col("segment"), patterns), F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    a = _valued(df, segment, clv).agg(
        zero(S.money_sum(F.when(hit, F.col("v")))).alias("r"), zero(S.money_sum(F.col("v"))).alias("t"), F.count_if(hit).alias("customer_count_at_risk"), F.count("*").alias("n"),
        F.count_if(F.col("v").isNull()).alias("excluded_count"), F.sort_array(F.collect_set(F.when(hit, F.col("segment")))).alias("matched_segments"),
    )
    pct = lambda x, y: S.round2(zero(F.try_divide(F.col(x), F.col(y))) * 100)
    return a.select(
        (F.size("matched_segments") > 0).alias("any_at_risk"), "matched_segments", S.round2(F.col("r")).alias("total_clv_at_risk"), "customer_count_at_risk", pct("r", "t").alias("pct_of_total_clv_at_risk"),
        pct("customer_count_at_risk", "n").alias("pct_of_total_customers_at_risk"), S.round2(F.col("t")).alias("total_clv"), "excluded_count",
    )


def long_form(shares: DataFrame) -> DataFrame:
    """segment, metric, pct: two rows for each segment."""
    renamed = shares.select("segment", F.col("pct_of_customers").alias("% of Customers"), F.col("pct_of_revenue").alias("% of Revenue"))
    return renamed.unpivot("segment", ["% of Customers", "% of Revenue"], "metric", "pct")


def display_table(shares: DataFrame) -> DataFrame:
    """The numbers as texts."""
    c = F.col
    return shares.select(
        "segment", "customer_count", S.format_percent(c("pct_of_customers")).alias("pct_of_customers"), S.format_currency(c("total_revenue")).alias("total_revenue"),
        S.format_percent(c("pct_of_revenue")).alias("pct_of_revenue"), S.format_currency(c("avg_revenue_per_customer")).alias("avg_revenue_per_customer"),
    )
