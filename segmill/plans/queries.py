"""One query for each operator over the star schema's tables, and the SQL that says the same."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.categories import CATEGORIES, normalize_category
from ..operators import assignment, cleaning, clustering, embedding, features, mapping, personas, questions, revenue
from ..schema import ACTIONS, AT_RISK, FIELDS, MARGIN
from ..scratch import Scratch, materialize
from ..sources.files import ROW, sample_orders

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as order lines."""
    return _t(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("customer_id"), F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_orderdate").alias("order_date"), F.col("o_totalprice").alias("order_value"))


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    o, l, p = (_t(spark, sf, n) for n in ("orders", "lineitem", "part"))
    joined = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(p, l["l_partkey"] == p["p_partkey"])
    c = F.col
    return joined.select(c("o_custkey").cast("string").alias("customer_id"), c("o_orderkey").cast("string").alias("order_id"), c("o_orderdate").alias("order_date"), c("l_extendedprice").alias("order_value"), c("l_quantity").cast("long").alias("quantity"), c("p_type").alias("product_category"))


def purchases(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").filter("event_type = 'purchase'")
    return e.select(F.col("user_id").cast("string").alias("customer_id"), F.col("event_id").cast("string").alias("order_id"), F.col("ts").alias("order_date"), F.col("value").alias("order_value"))


def messy(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a messy export with the schema's names; some rows repeat, some values are blank, negative or late."""
    rows = sample_orders(_t(spark, sf, "orders"))
    k = F.col("clean_order")
    value = F.when(k % 37 == 0, F.lit(None).cast("string")).when(k % 41 == 0, F.concat(F.lit("-"), F.col("Total $"))).when(k % 43 == 0, "0.00").otherwise(F.col("Total $"))
    order = F.when(k % 53 == 0, "DUPLICATE").otherwise(F.col("Order #"))
    lines = rows.select(F.col("Cust ID").alias("customer_id"), order.alias("order_id"), F.col("Order Date").alias("order_date"), value.alias("order_value"), k.alias(ROW))
    return lines.unionByName(lines.filter(F.col(ROW) % 29 == 0).withColumn(ROW, F.col(ROW) + 10_000_000_000))


# the same tables in SQL

ORDERS = "SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_orderkey AS VARCHAR) AS order_id, o_orderdate AS order_date, o_totalprice AS order_value FROM orders"
LINES = "SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_orderkey AS VARCHAR) AS order_id, o_orderdate AS order_date, l_extendedprice AS order_value, CAST(l_quantity AS BIGINT) AS quantity, p_type AS product_category FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"
PURCHASES = "SELECT CAST(user_id AS VARCHAR) AS customer_id, CAST(event_id AS VARCHAR) AS order_id, ts AS order_date, value AS order_value FROM events WHERE event_type = 'purchase'"
LAST_DAY = dt.datetime(2000, 6, 30)
MESSY = f"""SELECT c, o, d, v, t FROM (
  SELECT o_custkey AS c, o_orderkey % 4 AS t, CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_orderkey END AS o, o_orderdate AS d,
    CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN -o_totalprice WHEN o_orderkey % 43 = 0 THEN 0 ELSE o_totalprice END AS v, 1 + CAST(o_orderkey % 29 = 0 AS INT) AS copies FROM orders), range(copies)"""


def r2(x: str) -> str:
    return f"round_even(({x}) * 100, 0) / 100"


def total(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(38, 8))) AS DOUBLE)"


def days(since: str, until: str) -> str:
    return f"CAST(floor((epoch_us({until}) - epoch_us({since})) / 86400000000.0) AS BIGINT)"


def rfm_sql(lines: str) -> str:
    return f"""WITH l AS ({lines}), s AS (SELECT max(order_date) AS snap FROM l),
a AS (SELECT customer_id, max(order_date) AS last, min(order_date) AS first, count(DISTINCT order_id) AS frequency, {r2(total("order_value"))} AS monetary FROM l GROUP BY customer_id)
SELECT customer_id, {days("last", "snap")} AS recency, frequency, monetary, {r2("monetary / frequency")} AS aov, {r2(f"monetary * {MARGIN}")} AS clv, greatest({days("first", "snap")}, 0) AS tenure FROM a, s"""


# features


@query("rfm_orders", rfm_sql(ORDERS))
def rfm_orders(spark, sf):
    return features.rfm(orders(spark, sf))


@query("rfm_lines", rfm_sql(LINES))
def rfm_lines(spark, sf):
    return features.rfm(order_lines(spark, sf))


@query("rfm_purchases", rfm_sql(PURCHASES))
def rfm_purchases(spark, sf):
    return features.rfm(purchases(spark, sf))


@query("recency_elapsed_days", f"WITH p AS ({PURCHASES}), s AS (SELECT max(order_date) AS m FROM p) SELECT order_id, {days('order_date', 'm')} AS days, {days('m', 'order_date')} AS back FROM p, s")
def recency_elapsed_days(spark, sf):
    p = purchases(spark, sf)
    both = p.crossJoin(F.broadcast(p.agg(F.max("order_date").alias("m"))))  # one row
    return both.select("order_id", S.elapsed_days(F.col("order_date"), F.col("m")).alias("days"), S.elapsed_days(F.col("m"), F.col("order_date")).alias("back"))


TOP = f"SELECT customer_id, product_category AS top_category FROM (SELECT customer_id, product_category, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, product_category) AS r FROM (SELECT customer_id, product_category, count(*) AS n FROM ({LINES}) GROUP BY 1, 2)) WHERE r = 1"


@query("top_category", TOP)
def top_category(spark, sf):
    return features.top_category(order_lines(spark, sf))


@query("top_category_onehot", f"SELECT top_category AS category, count(*) AS customers FROM ({TOP}) GROUP BY 1")
def top_category_onehot(spark, sf):
    hot = features.one_hot(features.top_category(order_lines(spark, sf)))
    names = [c for c in hot.columns if c.startswith("cat_")]
    sums = hot.agg(*[F.sum(f"`{c}`").alias(str(i)) for i, c in enumerate(names)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c[4:]).alias("category"), F.col(str(i)).alias("customers")) for i, c in enumerate(names)])).alias("x")).select("x.*")


@query("engineer_features", f"WITH t AS ({TOP}), f AS ({rfm_sql(LINES)}) SELECT f.*, top_category FROM f LEFT JOIN t USING (customer_id)")
def engineer_features(spark, sf):
    return features.engineer_features(order_lines(spark, sf), hot=False)


FEATURE_NAMES = ["recency", "frequency", "monetary", "aov", "clv", "tenure"]


@query("feature_matrix", f"SELECT customer_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FEATURE_NAMES)} FROM ({rfm_sql(ORDERS)})")
def feature_matrix(spark, sf):
    return features.feature_matrix(features.rfm(orders(spark, sf)))


# parsing


@query("parse_money_roundtrip", "SELECT o_orderkey AS id, round(o_totalprice, 2) AS value FROM orders")
def parse_money_roundtrip(spark, sf):
    return sample_orders(_t(spark, sf, "orders")).select(F.col("clean_order").alias("id"), S.parse_money(F.col("Total $")).alias("value"))


#: Styles of an order's date (a midnight) or of 13:05 of that day, by turns.
DATE_STYLES = ["dd-MM-yyyy", "MM/dd/yyyy", "yyyy-MM-dd", "MMM dd yyyy", "MMM d, yyyy", "yyyy/MM/dd", "yyyyMMdd", "d MMMM yyyy", "EEE, dd MMM yyyy", "yyyy.MM.dd", "ddMMMyyyy"]
TIMED_STYLES = ["M/d/yyyy h:mm a", "yyyy-MM-dd h:mm a", "dd-MMM-yyyy HH:mm", "yyyy-MM-dd'T'HH:mm:ss'Z'", "MM-dd-yyyy HH:mm", "MM.dd.yyyy HH:mm:ss", "h:mm a MMM d yyyy", "yyyyMMdd'T'HHmmss", "MMMM d, yyyy HH:mm:ss.SSS"]
STYLES = len(DATE_STYLES) + len(TIMED_STYLES)


@query("parse_date_roundtrip", f"SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) + CASE WHEN o_orderkey % {STYLES} >= {len(DATE_STYLES)} THEN INTERVAL '13 hours 5 minutes' ELSE INTERVAL 0 SECOND END AS date FROM orders")
def parse_date_roundtrip(spark, sf):
    day, turn = F.col("o_orderdate").cast("timestamp"), (F.col("o_orderkey") % STYLES).cast("int")
    later = day + F.expr("INTERVAL '13:05' HOUR TO MINUTE")
    texts = F.array(*[F.date_format(day, x) for x in DATE_STYLES], *[F.date_format(later, x) for x in TIMED_STYLES])
    rows = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(texts, turn + 1).alias("text"))
    return rows.select("id", S.parse_date(F.col("text")).alias("date"))


@query("parse_quantity_roundtrip", "SELECT l_orderkey AS id, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem")
def parse_quantity_roundtrip(spark, sf):
    q = F.col("l_quantity").cast("long")
    words = F.create_map(*[F.lit(x) for w, n in S.NUMBER_WORDS.items() for x in (n, w.title())])
    turn = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(3))
    text = F.coalesce(F.when(turn == 0, F.try_element_at(words, q.cast("int"))), F.when(turn == 1, F.concat(q.cast("string"), F.lit(" pcs"))), F.concat(F.lit("  "), q.cast("string"), F.lit(".0")))
    return _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), S.parse_quantity(text).alias("quantity"))


@query("canonical_ids", "SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS customer FROM orders")
def canonical_ids(spark, sf):
    return sample_orders(_t(spark, sf, "orders")).select(F.col("clean_order").alias("id"), S.canonical_customer_id(F.col("Cust ID")).alias("customer"))


@query("normalize_order_ids", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 53 <> 0 THEN 'ORD' || o_orderkey END AS order_id FROM orders")
def normalize_order_ids(spark, sf):
    return cleaning.normalize_order_ids(messy(spark, sf).filter(F.col(ROW) < 10_000_000_000)).select(F.col(ROW).alias("id"), "order_id")


@query("order_id_report", f"SELECT count(*) FILTER (o IS NULL) AS duplicate_placeholders, count(*) FILTER (o IS NULL) AS nulled FROM ({MESSY})")
def order_id_report(spark, sf):
    return cleaning.order_id_report(messy(spark, sf))


@query("normalize_customer_ids", "SELECT o_orderkey AS id, o_custkey AS customer, count(*) OVER (PARTITION BY o_custkey) AS orders FROM orders")
def normalize_customer_ids(spark, sf):
    raw = sample_orders(_t(spark, sf, "orders")).select(F.col("Cust ID").alias("customer_id"), F.col("clean_order").alias(ROW))
    one = cleaning.normalize_customer_ids(raw)
    sizes = one.groupBy("customer_id").agg(F.count("*").alias("orders"))
    return one.join(sizes, "customer_id").select(F.col(ROW).alias("id"), S.canonical_customer_id(F.col("customer_id")).cast("long").alias("customer"), "orders")


@query("id_merge_report", "SELECT CAST(sum(n) AS BIGINT) AS ids_before, count(*) AS ids_after, count(*) FILTER (n > 1) AS merged_groups FROM (SELECT o_custkey, count(DISTINCT lower(trim(s))) AS n FROM (SELECT o_custkey, CASE l_mod WHEN 0 THEN 'C' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') WHEN 1 THEN 'cus-' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS s FROM (SELECT *, o_orderkey % 3 AS l_mod FROM orders)) GROUP BY 1)")
def id_merge_report(spark, sf):
    key, turn = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 3
    ids = F.when(turn == 0, F.concat(F.lit("C"), F.lpad(key, 9, "0"))).when(turn == 1, F.concat(F.lit("cus-"), key)).otherwise(key)
    return cleaning.id_merge_report(_t(spark, sf, "orders").select(ids.alias("customer_id")))


TYPED = ["  toys ", "TOYS", "Beuaty", "buety", "Electrnics", "sprots", "home and garden", "home", "t-shirts", "unknown", "port", "Food  &  Grocery"]
PLAIN = ["Toys", "Toys", "Beauty", "Beauty", "Electronics", "Sports", "Home & Garden", "Home", "T-Shirts", None, "Sports", "Food & Grocery"]


@query("normalize_categories", f"SELECT p_partkey AS id, ([{', '.join('NULL' if x is None else repr(x) for x in PLAIN)}])[1 + p_partkey % {len(PLAIN)}] AS category FROM part")
def normalize_categories(spark, sf):
    typed = F.element_at(F.array(*map(F.lit, TYPED)), (F.col("p_partkey") % len(TYPED) + 1).cast("int"))
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), normalize_category(typed).alias("category"))


@query("category_report", f"SELECT {len(set(PLAIN)) - 1}::BIGINT AS distinct_after, count(*) FILTER (p_partkey % {len(PLAIN)} = {PLAIN.index(None)}) AS nulled FROM part")
def category_report(spark, sf):
    typed = F.element_at(F.array(*map(F.lit, TYPED)), (F.col("p_partkey") % len(TYPED) + 1).cast("int"))
    before = _t(spark, sf, "part").select(typed.alias("product_category"))
    return cleaning.category_report(before, cleaning.normalize_categories(before))


# cleaning


@query("derive_order_value", "SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice ELSE l_quantity * (l_linenumber + 0.5) END AS order_value FROM lineitem")
def derive_order_value(spark, sf):
    l = _t(spark, sf, "lineitem")
    given = l.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), (F.col("l_linenumber") + 0.5).alias("unit_price"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice")).alias("order_value"))
    return cleaning.derive_order_value(given).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), "order_value")


@query("drop_null_required", f"SELECT c AS customer, count(*) AS n FROM ({MESSY}) WHERE v IS NOT NULL AND o IS NOT NULL GROUP BY 1")
def drop_null_required(spark, sf):
    left = cleaning.drop_null_required(cleaning.normalize_order_ids(cleaning.coerce_types(messy(spark, sf))))
    return left.groupBy(S.canonical_customer_id(F.col("customer_id")).cast("long").alias("customer")).agg(F.count("*").alias("n"))


@query("dedup_rows", "SELECT l_orderkey AS id, count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity FROM lineitem GROUP BY 1")
def dedup_rows(spark, sf):
    l = _t(spark, sf, "lineitem").withColumn("order_id", F.col("l_orderkey"))
    twice = l.unionByName(l.filter("l_linenumber % 2 = 1")).withColumn(ROW, F.monotonically_increasing_id())
    return cleaning.drop_repeated_rows(twice).groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("drop_nonpositive", "SELECT o_orderkey AS id, o_totalprice - 100000 AS order_value FROM orders WHERE o_totalprice > 100000")
def drop_nonpositive(spark, sf):
    shifted = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") - 100000).alias("order_value"))
    return cleaning.drop_nonpositive_values(shifted)


@query("drop_future", f"SELECT event_id AS id FROM events WHERE ts <= (SELECT date_trunc('day', max(ts)) FROM events)")
def drop_future(spark, sf):
    e = _t(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("order_date"))
    last = e.agg(F.max("order_date")).first()[0]
    return cleaning.drop_future_orders(e, dt.datetime.combine(last.date(), dt.time())).select("id")


CURRENCY_TEXTS = ["$5.00", "R$ 7", "12 EUR", "CNY 8", "9.99", "¥1 or JPY 1", "usd 3"]


@query("currency_scan", f"""WITH v AS (SELECT ([{', '.join(map(repr, CURRENCY_TEXTS))}])[1 + n_nationkey % {len(CURRENCY_TEXTS)}] AS v FROM nation),
f AS (SELECT unnest(regexp_extract_all(v, '\\b(USD|EUR|GBP|JPY|CNY|INR|AUD|CAD|KRW|RUB|BRL|CHF)\\b')) AS c FROM v UNION ALL SELECT 'BRL' FROM v WHERE contains(v, 'R$')
  UNION ALL SELECT 'USD' FROM v WHERE contains(replace(v, 'R$', ''), '$') UNION ALL SELECT c FROM v, (VALUES ('€', 'EUR'), ('£', 'GBP'), ('¥', 'JPY'), ('₹', 'INR'), ('₩', 'KRW'), ('₽', 'RUB')) t(s, c) WHERE contains(v, s))
SELECT list_sort(list(DISTINCT c)) AS currencies_found, count(DISTINCT c) > 1 AS mixed FROM f""")
def currency_scan(spark, sf):
    texts = F.array(*map(F.lit, CURRENCY_TEXTS))
    return cleaning.currency_scan(_t(spark, sf, "nation").select(F.element_at(texts, F.col("n_nationkey") % len(CURRENCY_TEXTS) + 1).alias("order_value")))


@query("currency_scan_orders", "SELECT list(DISTINCT c) AS currencies_found, count(DISTINCT c) > 1 AS mixed FROM (SELECT 'USD' AS c FROM orders WHERE o_orderkey % 4 IN (0, 2) AND o_orderkey % 37 <> 0 AND (o_orderkey % 41 = 0 OR o_orderkey % 43 <> 0))")
def currency_scan_orders(spark, sf):
    return cleaning.currency_scan(messy(spark, sf))


_STEPS = f"""WITH m AS ({MESSY}), k AS (SELECT *, v IS NULL OR o IS NULL AS missing FROM m), g AS (SELECT c, o, d, v, count(*) AS n FROM k WHERE NOT missing GROUP BY ALL)"""


GOOD = f"v > 0 AND d <= TIMESTAMP '{LAST_DAY}'"


@query("cleaning_report", f"""{_STEPS}, s AS (SELECT c, count(DISTINCT t) AS n FROM k GROUP BY 1)
SELECT count(*) AS rows_in, count(*) FILTER (missing) AS null_required, 0::BIGINT AS null_customer_id, count(*) FILTER (o IS NULL) AS null_order_id, 0::BIGINT AS null_order_date, count(*) FILTER (v IS NULL) AS null_order_value,
  count(*) FILTER (o IS NULL) AS duplicate_placeholders, count(*) FILTER (o IS NULL) AS nulled, list_sort(list(DISTINCT u) FILTER (u IS NOT NULL)) AS currencies_found, count(DISTINCT u) > 1 AS mixed, {', '.join(f'any_value({x}) AS {x}' for x in ('duplicates', 'negative', 'zero', 'future_orders', 'rows_out', 'n_customers', 'first_date', 'last_date', 'ids_before', 'ids_after', 'merged_groups'))},
  count(*) - any_value(rows_out) AS rows_dropped, any_value(rows_out) AS n_orders
FROM (SELECT k.*, CASE WHEN t IN (0, 2) AND v <> 0 THEN 'USD' END AS u FROM k), (SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) FILTER (v < 0) AS negative, count(*) FILTER (v = 0) AS zero,
  count(*) FILTER (v > 0 AND d > TIMESTAMP '{LAST_DAY}') AS future_orders, count(*) FILTER ({GOOD}) AS rows_out, count(DISTINCT CASE WHEN {GOOD} THEN c END) AS n_customers, min(CASE WHEN {GOOD} THEN d END) AS first_date, max(CASE WHEN {GOOD} THEN d END) AS last_date FROM g) g,
  (SELECT CAST(sum(n) AS BIGINT) AS ids_before, count(*) AS ids_after, count(*) FILTER (n > 1) AS merged_groups FROM s) i""")
def cleaning_report(spark, sf):
    return cleaning.clean(messy(spark, sf), LAST_DAY).report.drop("merge_examples", "duplicate_ids")


@query("clean_lines", f"{_STEPS} SELECT c AS customer, count(*) AS n, {r2(total('v'))} AS value FROM g WHERE v > 0 AND d <= TIMESTAMP '{LAST_DAY}' GROUP BY 1")
def clean_lines(spark, sf):
    lines = cleaning.clean(messy(spark, sf), LAST_DAY).lines
    return lines.groupBy(S.canonical_customer_id(F.col("customer_id")).cast("long").alias("customer")).agg(F.count("*").alias("n"), S.round2(S.money_sum(F.col("order_value"))).alias("value"))


# mapping


@query("column_profile", "WITH t AS (" + " UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS name, CAST({c} AS VARCHAR) AS v, c_custkey AS pos FROM customer" for i, c in enumerate(["c_name", "c_mktsegment", "c_nationkey"])) + "), s AS (SELECT i, v, min(pos) AS pos FROM t WHERE v IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY pos) AS r FROM s) SELECT name, (SELECT list(v ORDER BY r) FROM r WHERE r.i = t.i AND r <= 5) AS samples, count(v) AS non_null, count(*) - count(v) AS \"null\" FROM t GROUP BY i, name")
def column_profile(spark, sf):
    return mapping.profile_columns(_t(spark, sf, "customer").select("c_name", "c_mktsegment", F.col("c_nationkey").cast("string").alias("c_nationkey"), F.col("c_custkey").alias(ROW)))


@query("apply_mapping", "SELECT o_orderkey AS id, 'ORD' || o_orderkey AS order_id, CAST(o_custkey AS VARCHAR) AS customer FROM orders")
def apply_mapping(spark, sf):
    raw = sample_orders(_t(spark, sf, "orders"))
    names = ["Cust ID", "Order #", "Order Date", "Total $"]
    head = [r.asDict() for r in mapping.profile_columns(raw.select(*[f"`{n}`" for n in names], F.col("clean_order").alias(ROW))).collect()]  # one row per column
    found = mapping.resolve_duplicates(mapping.checked(mapping.propose(head)))
    lines = mapping.apply_mapping(raw.withColumn(ROW, F.col("clean_order")), mapping.validate_mapping(found).mapping)
    return lines.select(F.col(ROW).alias("id"), S.normalize_order_id(F.col("order_id")).alias("order_id"), S.canonical_customer_id(F.col("customer_id")).alias("customer"))


@query("detect_date_format", "SELECT 1.0::DOUBLE AS parseable_fraction, false AS dayfirst")
def detect_date_format(spark, sf):
    found = mapping.detect_date_format(sample_orders(_t(spark, sf, "orders")), "Order Date")
    return spark.createDataFrame([(found["parseable_fraction"], found["dayfirst"])], "parseable_fraction double, dayfirst boolean")


# scaling, bands, profiles; clusters of known labels stand in for fitted ones


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with features and, as cluster, the number of their market segment by name."""
    c = _t(spark, sf, "customer")
    names = F.array(*map(F.lit, SEGMENT_NAMES))
    return features.rfm(orders(spark, sf)).join(c.select(F.col("c_custkey").cast("string").alias("customer_id"), (F.array_position(names, F.col("c_mktsegment")) - 1).cast("int").alias("cluster"), F.col("c_mktsegment").alias("top_category")), "customer_id")


SEGMENT_NAMES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
LABELLED = f"SELECT f.*, CAST(list_position([{', '.join(map(repr, SEGMENT_NAMES))}], c_mktsegment) - 1 AS INTEGER) AS cluster, c_mktsegment AS top_category FROM ({rfm_sql(ORDERS)}) f JOIN customer ON CAST(c_custkey AS VARCHAR) = f.customer_id"
LOGS = {c: f"ln(1 + greatest(CAST({c} AS DOUBLE), 0))" if c in clustering.LOGGED else f"CAST({c} AS DOUBLE)" for c in FEATURE_NAMES}
SCALED = f"SELECT customer_id, cluster, {', '.join(f'coalesce(({x} - avg({x}) OVER ()) / nullif(stddev_pop({x}) OVER (), 0), 0) AS {c}' for c, x in LOGS.items())} FROM ({LABELLED})"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.rint(F.col(c) * 10**digits) / 10**digits + F.lit(0.0) for c, t in df.dtypes if t == "double"})


def r_(x: str, digits: int = 6) -> str:
    return f"round_even(({x}) * 1e{digits}, 0) / 1e{digits} + 0.0"


@query("scaled_features", f"SELECT customer_id, {', '.join(f'{r_(c, 4)} AS {c}' for c in FEATURE_NAMES)} FROM ({SCALED})")
def scaled_features(spark, sf):
    return rounded(clustering.scale_features(labelled(spark, sf), FEATURE_NAMES).select("customer_id", *FEATURE_NAMES), 4)


@query("quintile_edges", "SELECT " + ", ".join(f"list_transform(quantile_cont(CAST({c} AS DOUBLE), [0.2, 0.4, 0.6, 0.8]), lambda x: {r_('x', 3)}) AS {c}" for c in FEATURE_NAMES) + f" FROM ({LABELLED})")
def quintile_edges(spark, sf):
    edges = personas.quintile_edges(labelled(spark, sf))
    return edges.select(*[F.transform(c, lambda x: F.rint(x * 1000) / 1000 + F.lit(0.0)).alias(c) for c in FEATURE_NAMES])


BAND_LIST = "['very_low', 'low', 'mid', 'high', 'very_high']"
PROFILES = f"""WITH l AS ({LABELLED}), e AS (SELECT {', '.join(f'quantile_cont(CAST({c} AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS e_{c}' for c in FEATURE_NAMES)} FROM l),
p AS (SELECT cluster, count(*) AS size, {', '.join(f'{r2(f"{total(c)} / count({c})")} AS {c}' for c in FEATURE_NAMES)}, (SELECT count(*) FROM l) AS n FROM l GROUP BY cluster),
b AS (SELECT p.*, {', '.join(f'({BAND_LIST})[1 + len(list_filter(e_{c}, lambda x: x <= {c}))] AS b_{c}' for c in FEATURE_NAMES)} FROM p, e)"""


@query("cluster_profile", f"{PROFILES} SELECT cluster, size, round_even(size * 1000.0 / n, 0) / 10 AS share_pct, {', '.join(f'{c}, b_{c} AS band_{c}' for c in FEATURE_NAMES)} FROM b")
def cluster_profile(spark, sf):
    p = personas.profiles(labelled(spark, sf))
    return p.select("cluster", "size", "share_pct", *[x for c in FEATURE_NAMES for x in (F.col("averages")[c].alias(c), F.col("relative")[c].alias(f"band_{c}"))])


@query("separating_features", f"{PROFILES}, u AS ({' UNION ALL '.join(f'''SELECT '{c}' AS feature, b_{c} AS band FROM b''' for c in FEATURE_NAMES)}) SELECT feature, count(DISTINCT band) AS n_bands, count(DISTINCT band) > 1 AS separates FROM u GROUP BY 1")
def separating_features(spark, sf):
    return personas.separating_features(personas.profiles(labelled(spark, sf)))


def _rules_sql(b: str) -> str:
    high, low = (f"({b}{{}} IN ({', '.join(map(repr, x))}))" for x in (personas.HIGH, personas.LOW))
    m = lambda f, *names: " AND ".join(f.format(n) for n in names)
    return f"CASE WHEN {m(high, 'monetary', 'frequency')} AND {m(low, 'recency')} THEN 'Loyal Big Spenders' WHEN {m(high, 'monetary', 'recency')} THEN 'At-Risk High Value' WHEN {m(low, 'tenure', 'frequency')} THEN 'New Customers' WHEN {b}frequency = 'very_low' AND {m(low, 'monetary')} THEN 'One-Time Buyers' ELSE 'Low Engagement' END"


EACH = f"""SELECT l.*, {', '.join(f'({BAND_LIST})[1 + len(list_filter(e_{c}, lambda x: x <= {c}))] AS b_{c}' for c in FEATURE_NAMES)} FROM ({LABELLED}) l, (SELECT {', '.join(f'quantile_cont(CAST({c} AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS e_{c}' for c in FEATURE_NAMES)} FROM ({LABELLED}))"""
PERSONAS = f"SELECT *, {_rules_sql('b_')} AS persona FROM ({EACH})"


def with_personas(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer as a cluster of its own: bands of the customer's numbers, persona by the rules."""
    df = labelled(spark, sf)
    edges = personas.quintile_edges(df, FEATURE_NAMES).select(F.struct(*FEATURE_NAMES).alias("_e"))
    bands = F.create_map(*[x for c in FEATURE_NAMES for x in (F.lit(c), personas.band(F.col(c), F.col("_e")[c]))])
    return personas.label_by_rules(df.crossJoin(F.broadcast(edges)).withColumn("relative", bands).drop("_e"))  # one row


@query("personas_rules", f"SELECT customer_id, persona FROM ({PERSONAS})")
def personas_rules(spark, sf):
    return with_personas(spark, sf).select("customer_id", "persona")


ACTION_ROWS = ", ".join(str(tuple(a)) for a in ACTIONS)


@query("actions_join", f"SELECT customer_id, p.persona, action, channel, priority, CAST(priority_score AS INTEGER) AS priority_score FROM ({PERSONAS}) p JOIN (VALUES {ACTION_ROWS}) a(persona, action, channel, priority, priority_score) USING (persona)")
def actions_join(spark, sf):
    return personas.map_actions(with_personas(spark, sf)).select("customer_id", "persona", "action", "channel", "priority", "priority_score")


@query("segment_summary", f"{PROFILES} SELECT cluster, size, persona, action, priority, CAST(priority_score AS INTEGER) AS priority_score FROM (SELECT *, {_rules_sql('b_')} AS persona FROM b) JOIN (VALUES {ACTION_ROWS}) a(persona, action, channel, priority, priority_score) USING (persona)")
def segment_summary(spark, sf):
    return personas.segments(personas.profiles(labelled(spark, sf))).select("cluster", "size", "persona", "action", "priority", "priority_score")


@query("label_customers", f"{PROFILES}, s AS (SELECT cluster, {_rules_sql('b_')} AS persona FROM b) SELECT customer_id, cluster, persona FROM l JOIN s USING (cluster)")
def label_customers(spark, sf):
    return personas.label_customers(labelled(spark, sf))[0].select("customer_id", "cluster", "persona")


# cluster quality


@query("davies_bouldin", f"""WITH z AS ({SCALED}), m AS (SELECT cluster, {', '.join(f'avg({c}) AS {c}' for c in FEATURE_NAMES)} FROM z GROUP BY 1),
s AS (SELECT z.cluster, avg(sqrt({' + '.join(f'(z.{c} - m.{c}) ** 2' for c in FEATURE_NAMES)})) AS s FROM z JOIN m USING (cluster) GROUP BY 1), c AS (SELECT m.*, s.s FROM m JOIN s USING (cluster))
SELECT {r_('avg(r)', 4)} AS davies_bouldin FROM (SELECT a.cluster, max((a.s + b.s) / sqrt({' + '.join(f'(a.{c} - b.{c}) ** 2' for c in FEATURE_NAMES)})) AS r FROM c a JOIN c b ON a.cluster <> b.cluster GROUP BY 1)""")
def davies_bouldin(spark, sf):
    return rounded(clustering.davies_bouldin(clustering.scale_features(labelled(spark, sf), FEATURE_NAMES), FEATURE_NAMES), 4)


@query("adjusted_rand", f"""WITH n AS (SELECT cluster AS a, persona AS b, count(*)::DOUBLE AS n FROM ({PERSONAS}) GROUP BY ALL), t AS (SELECT sum(n * (n - 1) / 2) AS c, sum(n) AS n FROM n), x AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM n GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT sum(n) AS n FROM n GROUP BY b))
SELECT {r_('(c - e) / ((x + y) / 2 - e)')} AS adjusted_rand FROM (SELECT c, x, y, x * y / (n * (n - 1) / 2) AS e FROM t, x, y)""")
def adjusted_rand(spark, sf):
    return rounded(clustering.adjusted_rand(with_personas(spark, sf), "cluster", "persona"))


@query("cluster_sizes", f"SELECT cluster, count(*) AS size FROM ({LABELLED}) GROUP BY 1")
def cluster_sizes(spark, sf):
    return clustering.cluster_sizes(labelled(spark, sf))


def _silhouette_sql(points: str, distance: str) -> str:
    """One row, silhouette, of points (id, own, and what ``distance`` needs)."""
    return f"""WITH e AS ({points}), d AS (SELECT a.id, a.own, b.own AS other, sum(CASE WHEN a.id <> b.id THEN {distance} ELSE 0 END) AS s, count(*) AS n FROM e a, e b GROUP BY ALL),
i AS (SELECT id, s / nullif(n - 1, 0) AS a FROM d WHERE own = other), o AS (SELECT id, min(s / n) AS b FROM d WHERE own <> other GROUP BY 1)
SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM i JOIN o USING (id)"""


@query("silhouette_exact", f"SELECT {r_('silhouette')} AS silhouette FROM ({_silhouette_sql('SELECT vec_id AS id, label AS own, embedding::DOUBLE[64] AS v FROM embeddings', 'array_distance(a.v, b.v)')})")
def silhouette_exact(spark, sf):
    names = [f"x{i}" for i in range(64)]
    e = _t(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cluster"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return rounded(clustering.silhouettes(e, names).agg(F.avg("silhouette").alias("silhouette")))


_POINTS = f"SELECT customer_id AS id, cluster AS own, [{', '.join(FEATURE_NAMES)}]::DOUBLE[6] AS v FROM z"


@query("silhouette_bounds", f"WITH z AS ({SCALED}) SELECT {r_('silhouette')} AS silhouette, true AS holds, true AS narrow FROM ({_silhouette_sql(_POINTS, 'array_distance(a.v, b.v)')})")
def silhouette_bounds(spark, sf):
    """The tree's mean silhouette at tolerance 0, and whether the bounds at 0.05 hold it and are that narrow."""
    points = clustering.scale_features(labelled(spark, sf), FEATURE_NAMES)
    exact = clustering.silhouette_bounds(points, FEATURE_NAMES, tolerance=0.0).select(F.col("silhouette_low").alias("silhouette"))
    wide = clustering.silhouette_bounds(points, FEATURE_NAMES, tolerance=0.05)
    one = exact.crossJoin(F.broadcast(wide))  # one row each
    held = F.col("silhouette").between(F.col("silhouette_low") - 1e-12, F.col("silhouette_high") + 1e-12)
    return rounded(one.select("silhouette", held.alias("holds"), (F.col("silhouette_high") - F.col("silhouette_low") <= 0.05).alias("narrow")))


@query("neighbour_distances", f"""WITH z AS ({SCALED}), c AS ({_POINTS}), p AS (SELECT DISTINCT v FROM c),
d AS (SELECT id, array_distance(c.v, p.v) AS far, row_number() OVER (PARTITION BY id ORDER BY array_distance(c.v, p.v)) AS rank FROM c JOIN p ON c.v <> p.v) SELECT id AS customer_id, CAST(rank AS INTEGER) AS rank, {r_('far', 4)} AS far FROM d WHERE rank <= 5""")
def neighbour_distances(spark, sf):
    """Distances from every customer to the five nearest other points, by neighbour descent and its certification."""
    z = clustering.scale_features(labelled(spark, sf), FEATURE_NAMES).select("customer_id", F.array(*[F.col(c) + F.lit(0.0) for c in FEATURE_NAMES]).alias("x"))
    z = materialize(z, "scaled")
    named = z.select("customer_id", "x", *[F.col("x")[i].alias(c) for i, c in enumerate(FEATURE_NAMES)])
    found = embedding.neighbour_distances(named, FEATURE_NAMES, 5)
    return rounded(z.join(found, "x").select("customer_id", "rank", "far"), 4)


@query("embedding_projection", f"SELECT count(*) AS customers, count(*) AS placed, true AS trustworthy FROM ({LABELLED})")
def embedding_projection(spark, sf):
    """The layout of all customers: how many got a place, and whether its trustworthiness is 0.9 or more."""
    shown = embedding.embedding_projection(clustering.scale_features(labelled(spark, sf), FEATURE_NAMES), FEATURE_NAMES)
    trust = embedding.trustworthiness(shown, FEATURE_NAMES)
    return shown.agg(F.count("*").alias("customers"), F.count(F.col("dim_x") + F.col("dim_y")).alias("placed")).withColumn("trustworthy", F.lit(trust >= 0.9))


#: A table of choices made from order lines: k by line number, its measures by averages that stand in for them.
CHOICES = f"""SELECT CAST(l_linenumber + 1 AS INTEGER) AS k, {r_('avg(l_discount)', 4)} AS avg_silhouette, {r_('avg(l_tax)', 4)} AS avg_davies_bouldin, {r_('avg(l_quantity) / 50 + (l_linenumber % 3) * 0.15', 4)} AS avg_stability_ari,
  {r_('count(*) / (SELECT count(*) FROM lineitem)', 4)} AS min_cluster_pct, count(*) < 0.1 * (SELECT count(*) FROM lineitem) AS disqualified FROM lineitem GROUP BY l_linenumber"""


@query("recommend_k", f"SELECT k FROM ({CHOICES}) ORDER BY CASE WHEN avg_silhouette IS NULL THEN 3 WHEN disqualified THEN 2 WHEN avg_stability_ari > 0.7 THEN 0 ELSE 1 END, avg_silhouette DESC, k LIMIT 1")
def recommend_k(spark, sf):
    lines = _t(spark, sf, "lineitem")
    share = F.col("n") / F.sum("n").over(Window.partitionBy())  # seven rows
    by = lines.groupBy("l_linenumber").agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.avg("l_quantity").alias("q"), F.count("*").alias("n"))
    table = by.select(
        (F.col("l_linenumber") + 1).cast("int").alias("k"), F.col("d").cast("double").alias("avg_silhouette"), F.col("t").cast("double").alias("avg_davies_bouldin"),
        (F.col("q") / 50 + F.col("l_linenumber") % 3 * 0.15).cast("double").alias("avg_stability_ari"), share.alias("min_cluster_pct"), (share < 0.1).alias("disqualified"),
    )
    return clustering.recommend_k(rounded(table, 4)).select("k")


GROUPS = "SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_custkey % 3 AS cluster FROM customer"


def grouped(spark, sf) -> DataFrame:
    """Customers in three groups far apart."""
    c = _t(spark, sf, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("customer_id"), (F.col("c_custkey") % 3 * 400 + F.col("c_nationkey")).cast("double").alias("recency"), (F.col("c_custkey") % 3 * F.col("c_custkey") % 7 + 1).cast("long").alias("tenure"))


@query("score_nearest_centroid", GROUPS)
def score_nearest_centroid(spark, sf):
    """The final fit and its scoring, clusters numbered by their least recency."""
    df = grouped(spark, sf)
    scored = clustering.assign(clustering.fit_final(df, ["recency"], 3), df)
    order = scored.groupBy("cluster").agg(F.min("recency").alias("r")).withColumn("number", F.row_number().over(Window.orderBy("r")) - 1)  # three rows
    return scored.join(F.broadcast(order), "cluster").select("customer_id", F.col("number").cast("long").alias("cluster"))


def _small(spark, sf) -> DataFrame:
    return features.rfm(orders(spark, sf))


@query("kmeans_sweep")
def kmeans_sweep(spark, sf):
    f = _small(spark, sf)
    columns = features.numeric_features(f)
    return clustering.select_optimal_k(clustering.scale_features(f, columns), columns).table


@query("kmeans_fit")
def kmeans_fit(spark, sf):
    f = _small(spark, sf)
    return clustering.assign(clustering.fit_final(f, features.numeric_features(f), 3), f).select("customer_id", "cluster")


@query("pca_projection")
def pca_projection(spark, sf):
    f = _small(spark, sf)
    return clustering.project(f, features.numeric_features(f)).select("customer_id", "dim_x", "dim_y")


@query("cluster_metrics", f"""WITH z AS ({SCALED}), s AS ({_silhouette_sql(f"SELECT customer_id AS id, cluster AS own, [{', '.join(FEATURE_NAMES)}]::DOUBLE[6] AS v FROM z", 'array_distance(a.v, b.v)')}),
m AS (SELECT cluster, {', '.join(f'avg({c}) AS {c}' for c in FEATURE_NAMES)} FROM z GROUP BY 1), c AS (SELECT m.*, t.s FROM m JOIN (SELECT z.cluster, avg(sqrt({' + '.join(f'(z.{c} - m.{c}) ** 2' for c in FEATURE_NAMES)})) AS s FROM z JOIN m USING (cluster) GROUP BY 1) t USING (cluster)),
b AS (SELECT avg(r) AS davies_bouldin FROM (SELECT a.cluster, max((a.s + b.s) / sqrt({' + '.join(f'(a.{c} - b.{c}) ** 2' for c in FEATURE_NAMES)})) AS r FROM c a JOIN c b ON a.cluster <> b.cluster GROUP BY 1))
SELECT (SELECT CAST(count(DISTINCT cluster) AS INTEGER) FROM z) AS k, {r_('silhouette', 4)} AS silhouette, {r_('davies_bouldin', 4)} AS davies_bouldin, (SELECT count(*) FROM z) AS n_customers,
  (SELECT string_agg(cluster || ':' || n, ',' ORDER BY cluster) FROM (SELECT cluster, count(*) AS n FROM z GROUP BY 1)) AS cluster_sizes FROM s, b""")
def cluster_metrics(spark, sf):
    m = clustering.cluster_metrics(clustering.scale_features(labelled(spark, sf), FEATURE_NAMES), FEATURE_NAMES)
    sizes = F.transform(F.array_sort(F.map_entries("cluster_sizes")), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string")))
    return rounded(m, 4).withColumn("cluster_sizes", F.array_join(sizes, ","))


# revenue

SHARES = f"""WITH v AS (SELECT persona AS segment, CASE WHEN monetary > 0 THEN monetary END AS v FROM ({PERSONAS})), t AS (SELECT count(v) AS n, {total('v')} AS t FROM v)
SELECT segment, count(v) AS customer_count, {r2('count(v) / any_value(n) * 100')} AS pct_of_customers, {r2(total('v'))} AS total_revenue, {r2(f'{total("v")} / any_value(t) * 100')} AS pct_of_revenue, {r2(f'{total("v")} / count(v)')} AS avg_revenue_per_customer FROM v, t WHERE v IS NOT NULL GROUP BY segment"""


@query("revenue_concentration", SHARES)
def revenue_concentration(spark, sf):
    return revenue.concentration(with_personas(spark, sf))


@query("revenue_totals", f"SELECT {r2(total('monetary'))} AS total_revenue, count(*) FILTER (monetary > 0) AS total_customers, count(*) FILTER (coalesce(monetary, 0) <= 0) AS excluded_count, {r2(f'{total("monetary")} / count(*)')} AS avg_revenue_per_customer FROM ({PERSONAS})")
def revenue_totals(spark, sf):
    return revenue.concentration_totals(with_personas(spark, sf)).select(F.col("total_revenue"), "total_customers", "excluded_count", "avg_revenue_per_customer")


@query("revenue_long", f"WITH s AS ({SHARES}) SELECT segment, '% of Customers' AS metric, pct_of_customers AS pct FROM s UNION ALL SELECT segment, '% of Revenue', pct_of_revenue FROM s")
def revenue_long(spark, sf):
    return revenue.long_form(revenue.concentration(with_personas(spark, sf)))


@query("revenue_display", f"WITH s AS ({SHARES}) SELECT segment, customer_count, printf('%.1f%%', pct_of_customers) AS pct_of_customers, '$' || format('{{:,.2f}}', total_revenue) AS total_revenue, printf('%.1f%%', pct_of_revenue) AS pct_of_revenue, '$' || format('{{:,.2f}}', avg_revenue_per_customer) AS avg_revenue_per_customer FROM s")
def revenue_display(spark, sf):
    return revenue.display_table(revenue.concentration(with_personas(spark, sf)))


@query("clv_at_risk", f"""WITH p AS (SELECT *, persona = 'At-Risk High Value' AS r FROM ({PERSONAS})) SELECT bool_or(r) AS any_at_risk, {r2(f"coalesce({total('CASE WHEN r THEN clv END')}, 0)")} AS total_clv_at_risk, count(*) FILTER (r) AS customer_count_at_risk,
{r2(f"coalesce({total('CASE WHEN r THEN clv END')}, 0) / {total('clv')} * 100")} AS pct_of_total_clv_at_risk, {r2('count(*) FILTER (r) / count(*) * 100')} AS pct_of_total_customers_at_risk, {r2(total('clv'))} AS total_clv,
coalesce(list_sort(list(DISTINCT persona) FILTER (r)), []) AS matched_segments, count(*) FILTER (coalesce(clv, 0) <= 0) AS excluded_count FROM p""")
def clv_at_risk(spark, sf):
    return revenue.clv_at_risk(with_personas(spark, sf), patterns=AT_RISK)


@query("clv_breakdown", f"WITH p AS ({PERSONAS}), t AS (SELECT {total('clv')} AS t FROM p) SELECT persona AS segment, count(*) AS customer_count, {r2(total('clv'))} AS total_clv, {r2(f'{total("clv")} / any_value(t) * 100')} AS pct_of_total_clv FROM p, t WHERE persona = 'At-Risk High Value' GROUP BY 1")
def clv_breakdown(spark, sf):
    return revenue.clv_breakdown(with_personas(spark, sf))


# questions


def _ask(n: int):
    return lambda spark, sf: questions.answer(questions.EXAMPLES[n], with_personas(spark, sf).withColumn("priority", F.lit("-")))["result"]


for _n, (_name, _sql) in enumerate({
    "q_segment_counts": f"SELECT persona, count(*) AS customers FROM ({PERSONAS}) GROUP BY 1",
    "q_avg_spend_loyal": f"SELECT round(avg(monetary), 2) AS value FROM ({PERSONAS}) WHERE persona = 'Loyal Big Spenders'",
    "q_top5_monetary": f"SELECT customer_id, monetary FROM ({PERSONAS}) ORDER BY monetary DESC, customer_id LIMIT 5",
    "q_one_time_count": f"SELECT count(*) AS customers FROM ({PERSONAS}) WHERE frequency = 1",
}.items()):
    query(_name, _sql)(_ask(_n))


#: Columns of order lines under names that tell nothing: what they must be mapped to, and the value that each row has.
NAMELESS = {
    "k1": ("customer_id", "concat('C', o_custkey)"), "k2": ("order_id", "concat('#', o_orderkey)"), "k3": ("order_date", "date_format(o_orderdate, 'MM/dd/yyyy')"),
    "k4": ("order_value", "format_string('%.2f', l_extendedprice)"), "k5": ("quantity", "cast(cast(l_quantity AS int) AS string)"),
    "k6": ("unit_price", "format_string('%.2f', l_extendedprice / l_quantity)"), "k7": ("customer_email", "concat('u', o_custkey, '@mail.example.com')"),
    "k8": ("signup_date", "date_format(date_add(DATE'1990-01-01', cast(o_custkey % 900 AS int)), 'yyyy-MM-dd')"),
}


@query("map_by_values", "WITH n AS (SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey) " + " UNION ALL ".join(f"SELECT '{c}' AS raw_column, '{f}' AS internal_field, n AS filled FROM n" for c, (f, _) in NAMELESS.items()))
def map_by_values(spark, sf):
    """The fields that columns without telling names are assigned to by what they hold, and how many values each has."""
    o, l = _t(spark, sf, "orders"), _t(spark, sf, "lineitem")
    lines = l.join(o, l["l_orderkey"] == o["o_orderkey"]).selectExpr(*[f"{e} AS {c}" for c, (_, e) in NAMELESS.items()])
    scratch = Scratch(spark, "nameless")
    try:
        lines = scratch.keep(lines, "lines")  # joined once, read by several passes
        found = {m["raw_column"]: m["internal_field"] for m in assignment.map_by_values(lines)}
        counts = lines.agg(*[F.count(c).alias(c) for c in NAMELESS]).first()
    finally:
        scratch.drop()
    return spark.createDataFrame([(c, found[c], counts[c]) for c in NAMELESS], "raw_column string, internal_field string, filled long")


LINE_FIELDS = {"customer_id": "o_custkey", "order_id": "o_orderkey", "order_date": "o_orderdate", "order_value": "l_extendedprice", "quantity": "l_quantity", "product_category": "p_type"}


@query("schema_fields", f"WITH j AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), n AS (SELECT {', '.join(f'count({c}) AS {f}' for f, c in LINE_FIELDS.items())} FROM j) " + " UNION ALL ".join(f"SELECT {i} AS position, '{n}' AS field, '{k}' AS kind, {n if n in LINE_FIELDS else 0}::BIGINT AS filled FROM n" for i, (n, k) in enumerate(FIELDS.items())))
def schema_fields(spark, sf):
    """The fields of an order line, and how many of the given lines have each."""
    typed = cleaning.coerce_types(order_lines(spark, sf).select(*[F.col(c).cast("string").alias(c) for c in LINE_FIELDS]))
    counts = typed.agg(*[F.count(c).alias(c) for c in LINE_FIELDS])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(n).alias("field"), F.lit(k).alias("kind"), (F.col(n) if n in LINE_FIELDS else F.lit(0)).cast("long").alias("filled")) for i, (n, k) in enumerate(FIELDS.items())]
    return counts.select(F.inline(F.array(*rows)))


@query("known_categories", f"SELECT c AS category, count(p_partkey) AS parts FROM (SELECT unnest([{', '.join(map(repr, CATEGORIES))}]) AS c, unnest(range({len(CATEGORIES)})) AS i) LEFT JOIN part ON p_partkey % {len(CATEGORIES)} = i GROUP BY 1")
def known_categories(spark, sf):
    """Parts by category, each written in capitals by turns."""
    typed = F.element_at(F.array(*[F.lit(c.upper()) for c in CATEGORIES]), (F.col("p_partkey") % len(CATEGORIES) + 1).cast("int"))
    return _t(spark, sf, "part").select(normalize_category(typed).alias("category")).groupBy("category").agg(F.count("*").alias("parts"))
