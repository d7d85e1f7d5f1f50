"""Order exports as all-string tables, and results as files.

A delimited file is read by Spark; only its first bytes come to the driver, to learn delimiter and header. One pass over all lines tells the
encoding and whether quoted cells hold line ends; if they do, ``quoted`` puts the records together, by as many tasks as lines are read by. A
second pass over the cells tells empty columns, empty rows and rows with too many cells. ``_row_id`` follows the order of rows in files.
"""

from __future__ import annotations

import csv
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quoted

ROW = "_row_id"
#: Cells that count as missing when a file is read.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
DELIMITED, EXCEL = (".csv", ".tsv", ".txt"), (".xlsx", ".xls")
PROBE = 1 << 16


def _head(spark: SparkSession, path: str) -> bytes:
    """The first bytes of the first file, and no more, through the file system that Spark uses."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isDirectory():
        files = sorted((f.getPath().toString(), f.getPath()) for f in fs.listStatus(at) if f.isFile() and f.getPath().getName()[0] not in "._")
        if not files:
            return b""
        at = files[0][1]
    stream = fs.open(at)
    try:
        return bytes(stream.readNBytes(PROBE))
    finally:
        stream.close()


def text_facts(spark: SparkSession, path: str, delimiter: str = ",") -> tuple[str, bool]:
    """(encoding, whether a quoted cell holds a line end). One pass over all lines: a single one that isn't UTF-8 makes the whole input
    Latin-1."""
    table = quoted.lines(spark, path, delimiter)
    row = table.agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), quoted.opens(table).alias("open")).first()
    return "UTF-8" if row["utf8"] in (True, None) else "ISO-8859-1", bool(row["open"])


def delimiter_of(text: str) -> str:
    try:
        return csv.Sniffer().sniff(text[:4096], ",;\t|").delimiter
    except csv.Error:
        return ","


def header_of(text: str, delimiter: str) -> list[str]:
    """Stripped names; repeated ones get .1, .2 and so on."""
    names, seen = next(csv.reader(text.splitlines(True), delimiter=delimiter, skipinitialspace=True), []), {}
    out = []
    for i, name in enumerate(n.strip() or f"Unnamed: {i}" for i, n in enumerate(names)):
        seen[name] = seen.get(name, -1) + 1
        out.append(f"{name}.{seen[name]}" if seen[name] else name)
    return out


def _cells(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """c0, c1 and so on, _more (what a row has beyond the header's cells) and the row's id; and the columns' names."""
    head = _head(spark, path)
    delimiter = delimiter_of(head.decode("latin-1"))
    encoding, open_cells = text_facts(spark, path, delimiter)
    names = header_of(head.decode("utf-8-sig" if encoding == "UTF-8" else "latin-1", errors="ignore"), delimiter)
    if not names:
        raise ValueError(f"{path} is empty")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*(f"c{i}" for i in range(len(names))), "_more"]])
    options = {"sep": delimiter, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true"}
    if not open_cells:
        return spark.read.schema(schema).options(**options, header="true", enforceSchema="true", encoding=encoding).csv(path).withColumn(ROW, F.monotonically_increasing_id()), names
    table = quoted.lines(spark, path, delimiter)
    found = quoted.records(table, quoted.plan_ranges(table)).filter("NOT first")
    text = F.regexp_replace(F.decode("bytes", encoding), "\r$", "")
    rows = found.select(text.alias("text"), F.col("place").alias(ROW)).filter(F.trim("text") != "")
    return rows.select(F.from_csv("text", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("r"), ROW).select("r.*", ROW), names


def _named(cells: DataFrame, names: list[str]) -> DataFrame:
    return cells.select(*[F.when(~F.col(f"c{i}").isin(MISSING), F.col(f"c{i}")).alias(n) for i, n in enumerate(names)], ROW)


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """All cells as strings. Files are split between tasks, whether or not quoted cells hold line ends."""
    cells, names = _cells(spark, path)
    if not cells.filter("_more IS NOT NULL").isEmpty():
        raise ValueError(f"{path}: a row has more cells than the header")
    return _named(cells, names)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet, through pandas on the driver (a sheet holds a million rows at most); needs a reader that pandas knows."""
    import pandas as pd

    rows = pd.read_excel(path, sheet_name=0, dtype=str)
    rows.columns = [str(c).strip() for c in rows.columns]
    rows[ROW] = range(len(rows))
    schema = T.StructType([T.StructField(c, T.LongType() if c == ROW else T.StringType()) for c in rows.columns])
    return spark.createDataFrame(rows.astype(object).where(rows.notna(), None), schema)


def _filled(names: list[str]):
    return reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in names], F.lit(False))


def drop_empty(df: DataFrame) -> DataFrame:
    """Without rows, then columns, that have no value; one aggregation finds the columns."""
    names = [c for c in df.columns if c != ROW]
    df = df.filter(_filled(names))
    counts = df.agg(*[F.count(f"`{c}`").alias(str(i)) for i, c in enumerate(names)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(names) if counts[i]], ROW)


def _delimited(spark: SparkSession, path: str) -> DataFrame:
    """As ``drop_empty`` of ``read_delimited``, with one pass over the cells for all that must be known about them."""
    cells, names = _cells(spark, path)
    df = _named(cells, names)
    value = [F.when(~F.col(f"c{i}").isin(MISSING), F.col(f"c{i}")) for i in range(len(names))]
    counts = cells.agg(F.count("_more"), *map(F.count, value)).first()
    if counts[0]:
        raise ValueError(f"{path}: a row has more cells than the header")
    kept = [n for i, n in enumerate(names) if counts[1 + i]]
    return df.select(*[F.col(f"`{n}`") for n in kept], ROW).filter(_filled(kept))


def load_raw_file(spark: SparkSession, path: str) -> DataFrame:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in DELIMITED + EXCEL:
        raise ValueError(f"{suffix or 'no suffix'}: use {', '.join(DELIMITED + EXCEL)}")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        raise FileNotFoundError(path)
    df = drop_empty(read_excel(spark, path)) if suffix in EXCEL else _delimited(spark, path)
    if len(df.columns) < 2:  # a column that is left has a value
        raise ValueError(f"{path} has no rows")
    return df


def with_row_ids(df: DataFrame) -> DataFrame:
    """For tables from elsewhere: ids in the order of partitions."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


def save_upload(content: bytes, folder: str, name: str) -> str:
    """Puts a file's bytes into a folder that Spark will read; returns its path."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, os.path.basename(name))
    with open(path, "wb") as f:
        f.write(content)
    return path


def export_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def sample_orders(orders: DataFrame) -> DataFrame:
    """A messy export made from clean orders: four date styles, several spellings of ids, money with and without signs. Deterministic.
    Columns as in an export, and the clean values beside them for round trips."""
    turn = F.pmod("o_orderkey", F.lit(4)).cast("int")
    date = F.col("o_orderdate").cast("timestamp")
    dates = [F.date_format(date, f) for f in ("dd-MM-yyyy", "MM/dd/yyyy", "yyyy-MM-dd", "MMM dd yyyy")]
    key = F.col("o_custkey").cast("string")
    ids = [F.concat(F.lit("C"), F.lpad(key, 9, "0")), F.concat(F.lit("cus-"), key), key, F.concat(F.lit(" Client 00"), key)]
    value = F.format_number("o_totalprice", 2)
    money = [F.concat(F.lit("$"), value), value, F.concat(value, F.lit(" USD")), F.format_string("%.2f", "o_totalprice")]
    pick = lambda options: F.element_at(F.array(*options), turn + 1)
    return orders.select(
        pick(ids).alias("Cust ID"), F.concat(F.when(turn == 1, "#").otherwise(""), F.lit("ORD"), F.col("o_orderkey").cast("string")).alias("Order #"), pick(dates).alias("Order Date"), pick(money).alias("Total $"),
        F.col("o_custkey").alias("clean_customer"), F.col("o_orderkey").alias("clean_order"), F.col("o_orderdate").alias("clean_date"), F.col("o_totalprice").alias("clean_value"),
    )
