"""Questions about the labelled customers, answered by a filter, a grouping, an aggregate, an order and a limit.

A translator turns a question into such a query or declines; the one here knows patterns of questions and works offline, another asks a
language model. A query is data, not code: whatever the translator says, only named columns, comparisons and aggregates are applied, with
DataFrame functions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import Provider, strip_fences, structured, text  # noqa: F401

LONGEST, MOST_ROWS = 1500, 1000
DECLINED = "This question can't be answered from the customer table."
#: Questions to start with.
EXAMPLES = [
    "How many customers are in each segment?",
    "What is the average spend of Loyal Big Spenders?",
    "Which 5 customers have the highest monetary value?",
    "How many one-time buyers (frequency = 1) are there?",
]
#: Words that mean a column, and words that mean an aggregate.
COLUMNS = {"spend": "monetary", "spending": "monetary", "revenue": "monetary", "monetary": "monetary", "orders": "frequency", "frequency": "frequency", "order value": "aov", "aov": "aov", "lifetime value": "clv", "clv": "clv", "recency": "recency", "tenure": "tenure"}
AGGREGATES = {"average": "avg", "mean": "avg", "total": "sum", "sum": "sum", "highest": "max", "maximum": "max", "lowest": "min", "minimum": "min", "median": "median"}
COMPARE = {"=": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v}
MEASURE = {"avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "median": F.median}


@dataclass
class Query:
    """filters: (column, comparison, value). measure: count, or an aggregate of ``column``; without one, ``columns`` of rows are listed. order:
    (column of the result, whether it falls)."""

    filters: list[tuple[str, str, str | float]] = field(default_factory=list)
    group: str | None = None
    measure: str | None = None
    column: str | None = None
    columns: list[str] = field(default_factory=list)
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None


@dataclass
class Translation:
    query: Query | None = None
    reason: str = ""


Translator = Callable[[str, dict], Translation]


def schema_summary(df: DataFrame, values: int = 8, rows: int = 3) -> dict:
    """Column types, the first values of columns that name things, some rows. However many values a column has, tasks send ``values`` of them."""
    named = [c for c in ("persona", "priority", "top_category") if c in df.columns]
    first = lambda c: [r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().orderBy(c).limit(values).collect()]
    return {"columns": dict(df.dtypes), "values": {c: first(c) for c in named}, "rows": [r.asDict() for r in df.limit(rows).collect()]}


def translate(question: str, schema: dict) -> Translation:
    q, columns = question.lower(), schema["columns"]
    if not re.search(r"customer|segment|persona|buyer|spend|revenue|order|categor|priority|clv|recency|tenure|monetary|frequency", q):
        return Translation(reason="It isn't about customers.")
    value = next((c for w, c in COLUMNS.items() if re.search(rf"\b{w}\b", q) and c in columns), None)
    filters: list = [(c, op, float(number)) for c, op, number in re.findall(r"\b(recency|frequency|monetary|aov|clv|tenure)\s*(=|>=|<=|>|<)\s*(\d+(?:\.\d+)?)", q) if c in columns]
    asked = q.replace("one-time buyers", "") if filters else q
    for column, known in schema["values"].items():
        filters += [(column, "=", v) for v in known if v and re.search(rf"\b{re.escape(str(v).lower())}\b", asked)]
    group = next((c for w, c in (("segment", "persona"), ("persona", "persona"), ("priority", "priority"), ("category", "top_category")) if re.search(rf"\b(each|per|by)\s+(top\s+)?{w}", q) and c in columns), None)
    top = re.search(r"\b(?:top|which|highest|largest)\b\D{0,20}?(\d+)\b", q)
    if top and value:
        return Translation(Query(filters, columns=["customer_id", value], order=[(value, "lowest" not in q), ("customer_id", False)], limit=int(top[1])))
    measure = next((a for w, a in AGGREGATES.items() if re.search(rf"\b{w}\b", q)), None) if value else None
    if not measure and not re.search(r"how many|count|number of", q):
        return Translation(reason="No measure was recognised.")
    return Translation(Query(filters, group, measure or "count", value if measure else None, order=[(group, False)] if group else []))


def model_translator(provider: Provider) -> Translator:
    """A translator that asks a language model for the fields of a query."""

    def ask(question: str, schema: dict) -> Translation:
        prompt = (
            f"A table of customers has these columns and types: {json.dumps(schema['columns'])}. Some values: {json.dumps(schema['values'])}. Rows: {json.dumps(schema['rows'], default=str)}.\n"
            f"Question: {question}\nIf the table can't answer it, return {{\"reason\": one sentence}}. Else return an object with any of: filters (list of [column, one of {list(COMPARE)}, value]), group (column), "
            f"measure (count or one of {list(MEASURE)}), column (what is measured), columns (to list rows), order (list of [result column, true if falling]), limit."
        )
        found = structured(provider, prompt, lambda x: x if isinstance(x, dict) else {}["query"])
        if "reason" in found:
            return Translation(reason=str(found["reason"]) or DECLINED)
        fields = {k: v for k, v in found.items() if k in Query.__dataclass_fields__ and v is not None}
        return Translation(Query(**fields | {k: [tuple(x) for x in fields[k]] for k in ("filters", "order") if k in fields}))

    return ask


def is_safe(query: Query, columns: list[str]) -> str | None:
    """What is wrong with a query over these columns; None if nothing is."""
    name = lambda c: isinstance(c, str) and c in columns
    shown = [query.group, "customers" if query.measure == "count" else "value"] if query.measure else query.columns
    checks = [
        (all(len(f) == 3 and name(f[0]) and f[1] in COMPARE and isinstance(f[2], (str, int, float)) for f in query.filters), "filters"),
        (query.group is None or name(query.group) and query.measure is not None, "group"),
        (query.measure in (None, "count") or query.measure in MEASURE and name(query.column), "measure"),
        (bool(query.measure) or bool(query.columns) and all(map(name, query.columns)), "columns"),
        (all(len(o) == 2 and o[0] in shown and o[0] is not None for o in query.order), "order"),
        (query.limit is None or isinstance(query.limit, int) and not isinstance(query.limit, bool) and 0 < query.limit <= MOST_ROWS, "limit"),
    ]
    wrong = [what for fine, what in checks if not fine]
    return f"The query's {wrong[0]} can't be applied to the customers." if wrong else None


def run(query: Query, customers: DataFrame) -> DataFrame:
    """The answer's rows. Raises ValueError for a query that isn't safe."""
    if wrong := is_safe(query, customers.columns):
        raise ValueError(wrong)
    rows = customers.filter(reduce(lambda a, b: a & b, [COMPARE[op](F.col(f"`{c}`"), F.lit(v)) for c, op, v in query.filters], F.lit(True)))
    if query.measure:
        what = F.count("*").alias("customers") if query.measure == "count" else F.round(MEASURE[query.measure](F.col(f"`{query.column}`")), 2).alias("value")
        out = rows.groupBy(*[F.col(f"`{query.group}`")] * (query.group is not None)).agg(what)
    else:
        out = rows.select(*[F.col(f"`{c}`") for c in query.columns])
    if query.order:
        out = out.orderBy(*[F.desc(f"`{c}`") if falls else F.asc(f"`{c}`") for c, falls in query.order])
    return out.limit(query.limit) if query.limit else out


def explain(rows: list, question: str, provider: Provider | None = None) -> str:
    """The result in a sentence or a short table, or in a language model's words."""
    if not rows:
        return "No customers match."
    if len(rows) == 1 and len(rows[0]) == 1:
        name, value = next(iter(rows[0].asDict().items()))
        plain = f"{name}: {value:,}" if isinstance(value, (int, float)) else f"{name}: {value}"
    else:
        plain = "\n".join(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in rows)[:LONGEST]
    return plain if provider is None else text(provider, f"Question: {question}\nResult:\n{plain}\nAnswer the question from the result alone, in two sentences at most.")


def answer(question: str, customers: DataFrame, translator: Translator = translate, most: int = 100, provider: Provider | None = None) -> dict:
    """question, query (its fields), result (a DataFrame), text, error, out_of_scope; every failure becomes an error."""
    out = {"question": question, "query": None, "result": None, "text": DECLINED, "error": None, "out_of_scope": False}
    try:
        found = translator(question, schema_summary(customers))
        if found.query is None:
            return {**out, "text": found.reason or DECLINED, "error": found.reason or DECLINED, "out_of_scope": True}
        out["query"] = asdict(found.query)
        result = run(found.query, customers)
        return {**out, "result": result, "text": explain(result.limit(most).collect(), question, provider)}
    except Exception as e:
        return {**out, "error": str(e).splitlines()[0] if str(e) else type(e).__name__}
