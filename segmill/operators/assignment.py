"""Mapping columns by what they hold, as one assignment of columns to fields.

One pass over all rows gives each column's features: how many values look like dates, whole numbers, amounts, addresses; how many are distinct;
and a second pass, over pairs of the few columns in question, tells which columns depend on which (an order has one customer, a customer one
day of sign-up) and whether the product of two columns is a third. From these each column gets a score for each field, names add what they
tell, and the assignment with the highest sum is taken: no field is used twice, so no column is mapped only because a better one was overlooked.
A column's confidence is its score, less if the sum would hardly suffer without that choice: two columns that fit a field equally well
come out unsure. Ties go to the earlier column.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import FIELDS
from ..sources.files import ROW

#: Shapes of values, for Spark.
DATE = r"^\s*(\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|[A-Za-z]{3,9} \d{1,2},? \d{4}|\d{1,2}[- ][A-Za-z]{3,9}[- ]\d{4})"
WHOLE = r"^\s*\d{1,6}\s*(pcs|units?)?\s*$"
AMOUNT = r"^[^\dA-Za-z]*[-(]?\d[\d,]*(\.\d+)?\)?( ?[A-Z]{3})?\s*$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[a-z]{2,}\s*$"
#: Scores below this map to nothing; a choice whose loss costs the sum less than MARGIN is less sure.
LEAST, MARGIN = 0.35, 0.25


def _texts(df: DataFrame) -> DataFrame:
    """The columns (but not the row number) as trimmed texts, blank ones null."""
    return df.select(*[S.text_or_null(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns if c != ROW])


def _number(text: Column) -> Column:
    """``parse_money``; a text of digits and points only needs no search."""
    return F.when(F.btrim(text, F.lit("0123456789.")) == "", text.try_cast("double")).otherwise(S.parse_money(text))


def column_features(df: DataFrame) -> dict[str, dict[str, float]]:
    """By column: shares of the values that are dates, whole numbers, amounts, addresses, words, or have inner blanks; distinct values per value; mean number.

    The patterns tell no digit from another, so that they are tried once for each shape of a column's values (its digits as 0), not for each value."""
    names, texts = [c for c in df.columns if c != ROW], _texts(df)
    shape = lambda i: F.translate(F.col(f"`{names[i]}`"), "123456789", "0" * 9)
    each = texts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), shape(i).alias("v")) for i in range(len(names))])).alias("e")).select("e.*") if names else None
    v, tests = F.col("v"), {"date": DATE, "whole": WHOLE, "amount": AMOUNT, "email": EMAIL, "words": r"^[A-Za-z][A-Za-z &'-]*$", "cents": r"[.]\d\d?\b|[$€£¥]", "spaced": r"\S\s\S*\s?\S"}
    share = lambda p: F.sum(F.when(v.rlike(p), F.col("count")).otherwise(0)) / F.sum("count")
    shapes = each.filter("v IS NOT NULL").groupBy("i", "v").count().groupBy("i").agg(F.sum("count").alias("n"), *[share(p).alias(t) for t, p in tests.items()]).collect() if names else []  # one row for a column
    found = {names[r["i"]]: r.asDict() for r in shapes}
    row = texts.agg(*[a for c in names for a in (F.approx_count_distinct(f"`{c}`", 0.02), F.avg(_number(F.col(f"`{c}`"))))]).first() if names else []
    out = {}
    for i, c in enumerate(names):
        f = {k: float(found[c][k]) if c in found else 0.0 for k in ("n", *tests)} | {"distinct": float(row[2 * i]), "mean": float(row[2 * i + 1] or 0)}
        out[c] = f | {"unique": min(1.0, f["distinct"] / f["n"]) if f["n"] else 0.0}
    return out


def column_relations(df: DataFrame, keys: list[str], dates: list[str], numbers: list[str]) -> tuple[dict, dict]:
    """(a, b): distinct pairs per distinct a, near 1 if a determines b; (a, b, c): the share of rows with a * b = c, to a hundredth. Each text is hashed
    once, each number read once for a row."""
    pairs = [(a, b) for a in keys for b in [*keys, *dates] if a != b]
    triples = [(a, b, c) for c in numbers for a, b in combinations([x for x in numbers if x != c], 2)]
    hashed, money = ({c: f"{p}{i}" for i, c in enumerate(dict.fromkeys(some))} for p, some in (("h", [*keys, *dates]), ("m", numbers)))
    known = lambda c: F.col(f"`{c}`")
    rows = _texts(df).select(*[F.when(known(c).isNotNull(), F.xxhash64(known(c))).alias(h) for c, h in hashed.items()], *[_number(known(c)).alias(m) for c, m in money.items()])
    both = lambda a, b, value: F.when(F.col(hashed[a]).isNotNull() & F.col(hashed[b]).isNotNull(), value)
    near = lambda a, b, c: F.avg(F.when(F.abs(F.col(money[a]) * F.col(money[b]) - F.col(money[c])) <= 0.011 + 0.001 * F.abs(F.col(money[c])), 1.0).otherwise(0.0))
    asked = [x for a, b in pairs for x in (F.approx_count_distinct(both(a, b, F.xxhash64(hashed[a], hashed[b])), 0.02), F.approx_count_distinct(both(a, b, F.col(hashed[a])), 0.02))] + [near(*t) for t in triples]
    row = rows.agg(*asked).first() if asked else []
    depends = {p: row[2 * i] / row[2 * i + 1] if row[2 * i + 1] else np.inf for i, p in enumerate(pairs)}
    return depends, {t: float(row[2 * len(pairs) + i] or 0) for i, t in enumerate(triples)}


def scores(features: dict[str, dict[str, float]], depends: dict, products: dict) -> dict[str, dict[str, float]]:
    """By column and field, between 0 and 1, from values alone."""
    out: dict[str, dict[str, float]] = {}
    sure = lambda ds: max((max(0.0, 1 - 4 * (d - 1)) for d in ds if d >= 0.9), default=0.0)
    keys = {a for a, _ in depends}
    # An order determines the day of the order and, by its customer, that of the sign-up; only a key that another key determines tells them apart.
    grouped = {b for (_, b), d in depends.items() if b in keys and sure([d]) > 0.5}
    for c, f in features.items():
        key = (1 - f["date"]) * (1 - f["email"]) * (1 - f["cents"]) * (1 - f["spaced"]) if f["n"] else 0.0
        plain = max(0.0, f["amount"] - f["date"])
        few = 1 - f["unique"]
        holds = [d for (a, b), d in depends.items() if a == c and b in features]  # what c determines
        held = [d for (a, b), d in depends.items() if b == c]
        by_customer = [d for (a, b), d in depends.items() if b == c and a in (grouped or keys)]
        whole = max((v for (a, b, _), v in products.items() if c in (a, b)), default=0.0)
        made = max((v for (_, _, t), v in products.items() if t == c), default=0.0)
        words = f["words"] * (1 - f["email"])
        out[c] = {
            "customer_id": key * (0.35 + 0.35 * few + 0.3 * sure(held)) * (1 - 0.8 * f["words"]) * (0.5 if f["distinct"] < 20 and f["n"] > 100 else 1),
            "order_id": key * (0.3 + 0.4 * f["unique"] + 0.3 * sure(holds)) * (1 - 0.9 * f["words"]),
            "order_date": f["date"] * (0.7 + 0.3 * f["unique"]),
            "order_value": plain * (0.4 + 0.25 * f["cents"] + 0.15 * f["unique"] + 0.2 * made),
            "quantity": f["whole"] * (0.35 + 0.25 * few + 0.4 * whole) * (1 if f["mean"] < 1_000 else 0.4),
            "unit_price": plain * f["cents"] * (0.3 + 0.5 * whole) * (1 - 0.5 * made),
            "product_category": words * (0.5 + 0.5 * few),
            "customer_email": f["email"],
            "signup_date": f["date"] * (0.45 + 0.3 * few + 0.25 * sure(by_customer)),
            "support_tickets": f["whole"] * few * (0.5 if f["mean"] < 10 else 0.1) * (1 - 0.5 * whole),
        }
    return out


def assign(matrix: np.ndarray) -> np.ndarray:
    """For each row the column of the assignment with the highest sum (each column once; -1 if rows outnumber columns), by shortest
    augmenting paths. A choice worth nothing isn't made."""
    rows, columns = matrix.shape
    cost = np.concatenate((-matrix, np.zeros((rows, rows))), 1)  # a row may stay alone, at 0
    u, v = np.zeros(rows + 1), np.zeros(columns + rows + 1)
    owner, way = np.zeros(columns + rows + 1, int), np.zeros(columns + rows + 1, int)
    for i in range(1, rows + 1):
        owner[0], at = i, 0
        least, used = np.full(columns + rows + 1, np.inf), np.zeros(columns + rows + 1, bool)
        while owner[at]:
            used[at] = True
            free = ~used
            free[0] = False
            now = cost[owner[at] - 1] - u[owner[at]] - v[1:]
            better = free[1:] & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], at
            then = int(np.flatnonzero(free)[least[free].argmin()])
            step = least[then]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            at = then
        while at:
            owner[at] = owner[way[at]]
            at = way[at]
    out = np.full(rows, -1)
    for j in range(1, columns + 1):
        if owner[j] and matrix[owner[j] - 1, j - 1] > 0:
            out[owner[j] - 1] = j - 1
    return out


def _sum(matrix: np.ndarray) -> float:
    chosen = assign(matrix)
    return float(matrix[np.arange(len(matrix)), chosen][chosen >= 0].sum())


def map_by_values(df: DataFrame, names: dict[str, dict[str, float]] | None = None) -> list[dict]:
    """raw_column, internal_field, confidence for every column. names: what names tell, by column and field, between 0 and 1; by default nothing."""
    features = column_features(df)
    columns, fields = list(features), list(FIELDS)
    likely = lambda test: [c for c in columns if features[c]["n"] and test(features[c])][:8]
    keys = likely(lambda f: max(f["date"], f["email"], f["cents"]) < 0.5 and f["words"] < 0.9)
    depends, products = column_relations(df, keys, likely(lambda f: f["date"] >= 0.5), likely(lambda f: f["amount"] >= 0.5 and f["date"] < 0.5)[:6])
    valued = scores(features, depends, products)
    score = np.array([[max(valued[c][t], (0.3 * valued[c][t] + 0.7 * names[c].get(t, 0.0)) if names else 0.0) for t in fields] for c in columns]).reshape(-1, len(fields))
    matrix = np.where(score >= LEAST, score, 0.0) - 1e-9 * np.arange(len(columns))[:, None] * (score >= LEAST)
    chosen, total, out = assign(matrix), _sum(matrix) if len(columns) else 0.0, []
    for i, c in enumerate(columns):
        t = chosen[i]
        if t < 0:
            out.append({"raw_column": c, "internal_field": "none", "confidence": 0.0})
            continue
        # What the best assignment would lose if another column had this field.
        other = matrix.copy()
        other[i, t] = 0.0
        others = np.delete(np.arange(len(columns)), i)
        rival = max((matrix[j, t] for j in others), default=0.0)
        loss = total - _sum(other)
        sure = min(1.0, max(loss, 0.0) / MARGIN) if rival > 0 else 1.0
        out.append({"raw_column": c, "internal_field": fields[t], "confidence": round(float(min(1.0, score[i, t]) * (0.5 + 0.5 * sure)), 3)})
    return out
