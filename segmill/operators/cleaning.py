"""From order lines as strings to typed, deduplicated order lines, and the counts of what happened on the way.

The order of steps decides the counts: currencies of raw values, types, derived totals, customer ids, order ids, categories, then rows
with missing fields, repeated rows, values of 0 and less, and future dates go. ``_row_id`` (see sources) tells which spelling of a
customer came first; it takes no part in comparing rows. ``clean`` parses every cell once, into a scratch table that all later steps read.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.categories import normalize_category
from ..schema import FIELDS, OPTIONAL, REQUIRED
from ..scratch import Scratch

ROW = "_row_id"
PARSERS = {"string": S.text_or_null, "datetime": S.parse_date, "float": S.parse_money, "int": S.parse_quantity}


def _data(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW]


def coerce_types(df: DataFrame) -> DataFrame:
    """Fields of the schema that are strings are parsed by their kind; typed ones and other columns stay."""
    kinds = dict(df.dtypes)
    return df.withColumns({f: PARSERS[kind](F.col(f)) for f, kind in FIELDS.items() if kinds.get(f) == "string"})


def derive_order_value(df: DataFrame) -> DataFrame:
    """Missing totals from quantity times unit price, where both columns exist."""
    if not {"quantity", "unit_price"} <= set(df.columns):
        return df
    total = F.col("quantity") * F.col("unit_price")
    return df.withColumn("order_value", F.coalesce("order_value", total) if "order_value" in df.columns else total)


def normalize_customer_ids(df: DataFrame) -> DataFrame:
    """Every spelling of a customer becomes the one in the first row. Spellings are reduced to one row per key before the join."""
    if "customer_id" not in df.columns:
        return df
    spread = F.concat(F.lit("none "), F.pmod(F.xxhash64(*_data(df), *([ROW] if ROW in df.columns else [])), F.lit(4096)).cast("string"))
    keyed = df.withColumn("_key", F.coalesce(S.canonical_customer_id(F.col("customer_id")), spread))  # no key holds a space, so these match nothing
    first = F.min_by("customer_id", F.col(ROW)) if ROW in df.columns else F.min("customer_id")
    chosen = keyed.filter("_key NOT LIKE 'none %'").groupBy("_key").agg(first.alias("_first"))
    return keyed.join(chosen, "_key", "left").withColumn("customer_id", F.col("_first")).select(df.columns)


def _merges(given: DataFrame) -> DataFrame:
    keys = given.select("k", "customer_id").distinct().groupBy("k").count()
    return keys.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("ids_before"), F.count("*").alias("ids_after"), F.count_if(F.col("count") > 1).alias("merged_groups"))


def _merge_examples(given: DataFrame, groups: int = 5, variants: int = 6) -> DataFrame:
    rows = given.groupBy("k", "customer_id").agg(F.min(ROW).alias("at"))
    found = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.min_by("customer_id", "at").alias("merged_to")).filter("n > 1").orderBy("first").limit(groups)
    top = rows.join(F.broadcast(found), "k").withColumn("turn", F.row_number().over(Window.partitionBy("k").orderBy("at"))).filter(F.col("turn") <= variants)  # a few rows
    out = top.groupBy("first", "merged_to").agg(F.array_sort(F.collect_list(F.struct("turn", "customer_id"))).alias("v"))
    return out.orderBy("first").select("first", "merged_to", F.col("v.customer_id").alias("variants"))


def _given(df: DataFrame) -> DataFrame:
    return df.withColumn("k", S.canonical_customer_id(F.col("customer_id"))).filter("k IS NOT NULL")


def id_merge_report(df: DataFrame) -> DataFrame:
    """ids_before, ids_after, merged_groups."""
    return _merges(_given(df))


def id_merge_examples(df: DataFrame, groups: int = 5, variants: int = 6) -> DataFrame:
    """The first merged customers and their first spellings: merged_to, variants."""
    return _merge_examples(_given(df), groups, variants).drop("first")


def normalize_order_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("order_id", S.normalize_order_id(F.col("order_id"))) if "order_id" in df.columns else df


def order_id_report(df: DataFrame) -> DataFrame:
    """duplicate_placeholders, nulled: of order ids before normalisation."""
    new = S.normalize_order_id(F.col("order_id"))
    return df.agg(F.count_if(F.lower(S.strip(F.col("order_id"))) == "duplicate").alias("duplicate_placeholders"), F.count_if(F.col("order_id").isNotNull() & new.isNull()).alias("nulled"))


def normalize_categories(df: DataFrame) -> DataFrame:
    return df.withColumn("product_category", normalize_category("product_category")) if "product_category" in df.columns else df


def category_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """distinct_after, nulled."""
    old = before.agg(F.count_if(F.col("product_category").isNull()).alias("b"))
    new = after.agg(F.count_distinct("product_category").alias("distinct_after"), F.count_if(F.col("product_category").isNull()).alias("a"))
    return new.crossJoin(F.broadcast(old)).select("distinct_after", F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("nulled"))  # one row each


def missing_required(df: DataFrame) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f).isNull() for f in REQUIRED if f in df.columns], F.lit(False))


def drop_null_required(df: DataFrame) -> DataFrame:
    return df.filter(~missing_required(df))


def drop_repeated_rows(df: DataFrame) -> DataFrame:
    """Rows equal in every column but the row id, nulls being equal; without order ids nothing is dropped."""
    return df.dropDuplicates(_data(df)) if "order_id" in df.columns else df


def _repeated(df: DataFrame, n: int) -> DataFrame:
    copies = df.groupBy(_data(df)).agg(F.count("*").alias("n"), F.max(ROW).alias("at")).filter("n > 1")
    return copies.groupBy("order_id").agg(F.min("at").alias("at")).orderBy("at").limit(n)


def repeated_row_examples(df: DataFrame, n: int = 10) -> DataFrame:
    """Order ids of rows that repeat an earlier row, by repetition."""
    return _repeated(df, n).select("order_id")


def drop_nonpositive_values(df: DataFrame) -> DataFrame:
    return df.filter("order_value > 0") if "order_value" in df.columns else df


def midnight(reference: dt.datetime | None) -> Column:
    """Without a reference: the beginning of today."""
    day = reference or dt.datetime.combine(dt.datetime.now(dt.UTC).date(), dt.time())
    return F.lit(day.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def drop_future_orders(df: DataFrame, reference: dt.datetime | None = None) -> DataFrame:
    """An order stamped later than the reference goes, even if only by hours."""
    return df.filter(F.col("order_date") <= midnight(reference)) if "order_date" in df.columns else df


def currency_scan(raw: DataFrame) -> DataFrame:
    """currencies_found (sorted codes), mixed. Each task reduces its rows to a set of at most a dozen codes."""
    codes = raw.filter("order_value IS NOT NULL").select(F.explode(S.currencies(F.col("order_value").cast("string"))).alias("code"))
    return codes.agg(F.sort_array(F.collect_set("code")).alias("currencies_found")).withColumn("mixed", F.size("currencies_found") > 1)


@dataclass
class Cleaned:
    """lines and report read a scratch table, which ``release`` deletes."""

    lines: DataFrame
    report: DataFrame
    scratch: Scratch

    def report_dict(self) -> dict:
        return self.report.first().asDict(recursive=True)

    def release(self) -> None:
        self.scratch.drop()


def typed(raw: DataFrame) -> DataFrame:
    """All steps that keep rows."""
    return normalize_categories(normalize_order_ids(normalize_customer_ids(derive_order_value(coerce_types(raw)))))


#: What ``prepared`` notes of raw cells: the customer's spelling, currencies, whether a total was missing, a placeholder stood for an order, an
#: order or a category was there.
SPELLING, CODES, DERIVED, PLACEHOLDER, HAD_ORDER, HAD_CATEGORY = FACTS = ["_spelling", "_codes", "_derived", "_placeholder", "_had_order", "_had_category"]


def prepared(raw: DataFrame) -> DataFrame:
    """Every row with parsed cells, the customer's key in the place of its spelling, and what the report asks about raw cells."""
    c, had = F.col, set(raw.columns)
    df = raw.withColumn(CODES, S.currencies(c("order_value").cast("string"))) if "order_value" in had else raw
    df = coerce_types(df)
    if {"quantity", "unit_price"} <= had:
        df = derive_order_value(df.withColumn(DERIVED, c("order_value").isNull() if "order_value" in had else F.lit(True)))
    if "customer_id" in had:
        df = df.withColumns({SPELLING: c("customer_id"), "customer_id": S.canonical_customer_id(c("customer_id"))})
    if "order_id" in had:
        df = df.withColumns({PLACEHOLDER: F.lower(S.strip(c("order_id"))) == "duplicate", HAD_ORDER: c("order_id").isNotNull(), "order_id": S.normalize_order_id(c("order_id"))})
    if "product_category" in had:
        df = df.withColumns({HAD_CATEGORY: c("product_category").isNotNull(), "product_category": normalize_category("product_category")})
    return df


def _compared(base: DataFrame) -> list[str]:
    """Columns in which repeated rows are equal; customers are equal if their keys are."""
    return [x for x in base.columns if x not in (ROW, *FACTS)]


def _row_counts(base: DataFrame) -> DataFrame:
    """One row from one pass: rows, missing fields, and what was found in raw cells."""
    c, had = F.col, set(base.columns)
    out = [F.count("*").alias("rows_in"), F.count_if(missing_required(base)).alias("null_required"), *[F.count_if(c(f).isNull()).alias(f"null_{f}") for f in REQUIRED if f in had]]
    if DERIVED in had:
        out.append(F.count_if(DERIVED).alias("rows_computed"))
    if PLACEHOLDER in had:
        out += [F.count_if(PLACEHOLDER).alias("duplicate_placeholders"), F.count_if(c(HAD_ORDER) & c("order_id").isNull()).alias("nulled")]
    if HAD_CATEGORY in had:
        out += [F.count_distinct("product_category").alias("categories"), F.count_if(c(HAD_CATEGORY) & c("product_category").isNull()).alias("categories_nulled")]
    if CODES not in had:
        return base.agg(*out)
    found = F.sort_array(F.array_distinct(F.flatten(F.collect_set(CODES)))).alias("currencies_found")  # lists of a dozen codes at most
    return base.agg(*out, found).withColumn("mixed", F.size("currencies_found") > 1)


def _group_counts(base: DataFrame, reference: dt.datetime | None) -> DataFrame:
    """One row: how many rows each later step drops. Rows are counted by equality first, then each kind is a sum over groups."""
    c, had = F.col, set(base.columns)
    groups = drop_null_required(base).groupBy(_compared(base)).agg(F.count("*").alias("_n"))
    n = F.lit(1) if "order_id" in had else c("_n")
    late = c("order_date") > midnight(reference) if "order_date" in had else F.lit(False)
    value = c("order_value") if "order_value" in had else F.lit(1.0)
    good = (value > 0) & ~late
    total = lambda mask: F.coalesce(F.sum(F.when(mask, n)), F.lit(0))
    out = [F.coalesce(F.sum(c("_n") - n), F.lit(0)).alias("duplicates"), total(value < 0).alias("negative"), total(value == 0).alias("zero"), total((value > 0) & late).alias("future_orders"), total(good).alias("rows_out")]
    if "signup_date" in had:
        out.append(total(good & (c("signup_date") > midnight(reference))).alias("future_signups"))
    out += [total(good & c(f).isNull()).alias(f"missing_{f}") for f in OPTIONAL if f in had]
    if "customer_id" in had:
        out.append(F.count_distinct(F.when(good, c("customer_id"))).alias("n_customers"))
    if "order_date" in had:
        out += [F.min(F.when(good, c("order_date"))).alias("first_date"), F.max(F.when(good, c("order_date"))).alias("last_date")]
    return groups.agg(*out)


def cleaning_counts(base: DataFrame, reference: dt.datetime | None = None) -> DataFrame:
    """One row about ``base`` (see ``prepared``): what each step dropped, merged and found, with a few examples."""
    parts = [_group_counts(base, reference)]
    if SPELLING in base.columns:
        given = base.select(F.col("customer_id").alias("k"), F.col(SPELLING).alias("customer_id"), *([ROW] if ROW in base.columns else [F.lit(0).alias(ROW)])).filter("k IS NOT NULL")
        parts += [_merges(given), _merge_examples(given).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "merged_to", "variants"))), lambda x: F.struct(x["merged_to"].alias("merged_to"), x["variants"].alias("variants"))).alias("merge_examples"))]
    if "order_id" in base.columns and ROW in base.columns:
        again = _repeated(drop_null_required(base).select(*_compared(base), ROW), 10)
        parts.append(again.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "order_id"))), lambda x: x["order_id"]).alias("duplicate_ids")))
    report = _row_counts(base)
    for part in parts:
        report = report.crossJoin(F.broadcast(part))  # one row each
    return report.withColumn("rows_dropped", F.col("rows_in") - F.col("rows_out")).withColumn("n_orders", F.col("rows_out"))


def clean(raw: DataFrame, reference: dt.datetime | None = None) -> Cleaned:
    scratch = Scratch(raw.sparkSession, "cleaning")
    base = scratch.keep(prepared(raw), "typed")
    kept = drop_null_required(base).select(_compared(base))
    kept = drop_future_orders(drop_nonpositive_values(kept.distinct() if "order_id" in base.columns else kept), reference)
    if "customer_id" in base.columns:
        first = F.min_by(SPELLING, F.col(ROW)) if ROW in base.columns else F.min(SPELLING)
        chosen = base.filter("customer_id IS NOT NULL").groupBy("customer_id").agg(first.alias(SPELLING))
        kept = kept.join(chosen, "customer_id").withColumn("customer_id", F.col(SPELLING)).select(kept.columns)
    return Cleaned(kept, cleaning_counts(base, reference), scratch)


def warnings(report: dict) -> list[str]:
    """In words, from a report's row."""
    out = []
    if report.get("mixed"):
        out.append(f"Several currencies ({', '.join(report['currencies_found'])}); values are not converted.")
    if report.get("rows_computed"):
        out.append(f"order_value was missing in {report['rows_computed']} rows and follows from quantity and unit_price there.")
    if report.get("merged_groups"):
        out.append(f"{report['merged_groups']} customers had ids in several spellings ({report['ids_before']} ids, {report['ids_after']} customers).")
    if report.get("duplicate_placeholders"):
        out.append(f"{report['duplicate_placeholders']} order ids were placeholders and count as missing.")
    if not report["rows_out"]:
        out.append("No rows are left.")
    return out
