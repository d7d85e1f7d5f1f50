"""From raw columns to the fixed schema: a profile of each column, a proposal, its validation, and the projection.

The profile is one pass over the rows; proposals and validation handle one small record per column on the driver. ``propose`` works offline from
names and values; ``model_mapper`` asks a language model in its place.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import CONFIDENT, FIELDS, MIN_REQUIRED, REQUIRED, SAMPLES
from ..sources.files import ROW, load_raw_file
from .assignment import map_by_values
from .models import Provider, structured

NONE = "none"
Mapper = Callable[[list[dict]], list[dict]]


def profile_columns(df: DataFrame, n: int = SAMPLES) -> DataFrame:
    """name, samples (the first distinct stripped non-empty values), non_null, null. Each task keeps the ``n`` earliest values of each
    column of its rows, so no more than those leave it."""
    names = [c for c in df.columns if c != ROW]
    counts = df.agg(*[F.count(f"`{c}`").alias(str(i)) for i, c in enumerate(names)], F.count("*").alias("all"))
    each = counts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("name"), F.col(str(i)).alias("non_null"), (F.col("all") - F.col(str(i))).alias("null")) for i, c in enumerate(names)])).alias("c")).select("c.*")
    at = F.col(ROW).cast("long") if ROW in df.columns else F.monotonically_increasing_id()
    cells = df.select(at.alias("at"), *[S.text_or_null(F.col(f"`{c}`").cast("string")).alias(f"c{i}") for i, c in enumerate(names)])
    first = cells.mapInArrow(_earliest(n), "i int, v string, at long").groupBy("i", "v").agg(F.min("at").alias("at"))
    turn = F.row_number().over(Window.partitionBy("i").orderBy("at", "v"))  # n rows of each task and column
    top = first.withColumn("r", turn).filter(F.col("r") <= n).groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias("samples"))
    return each.join(top, "i", "left").orderBy("i").select("name", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), "non_null", "null")


def _earliest(n: int):
    """A value that is among the n earliest of all rows is among the n earliest when its earliest row has been seen, and stays there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, dict[str, int]] = {}
        for batch in batches:
            at = batch.column(0)
            for i in range(batch.num_columns - 1):
                now = pa.table({"v": batch.column(i + 1), "at": at}).filter(pc.field("v").is_valid()).group_by("v").aggregate([("at", "min")])
                now = now.sort_by([("at_min", "ascending"), ("v", "ascending")]).slice(0, n)
                merged = kept.setdefault(i, {})
                for v, a in zip(now["v"].to_pylist(), now["at_min"].to_pylist()):
                    merged[v] = min(a, merged.get(v, a))
                kept[i] = dict(sorted(merged.items(), key=lambda x: (x[1], x[0]))[:n])
        rows = [(i, v, a) for i, values in kept.items() for v, a in values.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64()))], ["i", "v", "at"])

    return run


#: Names that point to a field, after letters and digits only; more telling ones first.
SYNONYMS = {
    "customer_id": ["customerid", "custid", "customer", "clientid", "client", "buyerid", "userid", "cust", "memberid", "accountid"],
    "order_id": ["orderid", "ordernumber", "orderno", "order", "invoiceno", "invoice", "invoiceid", "transactionid", "receipt"],
    "order_date": ["orderdate", "invoicedate", "purchasedate", "date", "createdat", "orderedat", "transactiondate"],
    "order_value": ["ordervalue", "total", "totalprice", "ordertotal", "linetotal", "grandtotal", "amount", "totalamount", "revenue", "sales", "value"],
    "quantity": ["quantity", "qty", "units", "itemcount", "count"],
    "unit_price": ["unitprice", "price", "priceeach", "rate", "itemprice"],
    "product_category": ["productcategory", "category", "skucategory", "department", "producttype", "type"],
    "customer_email": ["customeremail", "email", "emailaddress", "mail"],
    "signup_date": ["signupdate", "registrationdate", "joined", "membersince", "accountcreated", "registeredat"],
    "support_tickets": ["supporttickets", "tickets", "complaints", "cases"],
}
_DATE = re.compile(r"^(\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|[A-Za-z]{3,9} \d{1,2},? \d{4}|\d{1,2} [A-Za-z]{3,9} \d{4})")
_NUMBER = re.compile(r"^[^\dA-Za-z]*[-(]?[\d.,]+\)?( ?[A-Z]{3})?$")


def _fits(kind: str, samples: list[str]) -> float:
    """The share of samples that look like the kind."""
    tests = {"datetime": lambda s: bool(_DATE.match(s)), "float": lambda s: bool(_NUMBER.match(s)), "int": lambda s: bool(re.match(r"^-?\d+([.,]\d+)?\b", s)), "string": lambda s: True}
    return sum(map(tests[kind], samples)) / len(samples) if samples else 0.5


def name_scores(columns: list[str]) -> dict[str, dict[str, float]]:
    """How well each column's name, without any value, fits each field."""
    plain = {c: re.sub(r"[^a-z0-9]", "", c.lower().replace("#", "number")) for c in columns}
    exact = lambda n, words: max((1.0 - 0.02 * i for i, w in enumerate(words) if n == w), default=0.0)
    part = lambda n, words: 0.55 if any(len(w) > 3 and (w in n or len(n) > 3 and n in w) for w in words) else 0.0
    return {c: {t: max(exact(n, words), part(n, words)) for t, words in SYNONYMS.items()} for c, n in plain.items()}


def propose(profile: list[dict]) -> list[dict]:
    """raw_column, internal_field, confidence for every column."""
    out = []
    for column in profile:
        name = re.sub(r"[^a-z0-9]", "", column["name"].lower().replace("#", "number"))
        best, score = NONE, 0.0
        for target, words in SYNONYMS.items():
            exact = max((1.0 - 0.02 * i for i, w in enumerate(words) if name == w), default=0.0)
            part = max((0.55 for w in words if len(w) > 3 and (w in name or name in w and len(name) > 3)), default=0.0)
            now = max(exact, part) * (0.5 + 0.5 * _fits(FIELDS[target], column["samples"]))
            if now > score:
                best, score = target, now
        out.append({"raw_column": column["name"], "internal_field": best if score >= 0.3 else NONE, "confidence": round(min(1.0, score), 3)})
    return out


def mapping_prompt(profile: list[dict]) -> str:
    """What a language model is asked: the fields with their meaning, the rules, and the columns with their samples."""
    optional = [f for f in FIELDS if f not in REQUIRED]
    return "\n".join([
        "Assign each column of an order export to one field of a fixed schema, by its name and its sample values.",
        f"Needed fields: {', '.join(REQUIRED)}. Further fields: {', '.join(optional)}. A column that fits no field gets '{NONE}'.",
        "No field may be used twice: the best column gets it, the others '" + NONE + "'.",
        "order_value is the whole amount of an order or line. unit_price is the price of one piece; if the export has only that and a quantity, use unit_price and leave order_value out.",
        "order_date is the day of the order, signup_date the day on which the customer registered.",
        'Return {"mappings": [{"raw_column": name, "internal_field": field, "confidence": 0 to 1}, ...]} with one entry for each column.',
        "Columns: " + json.dumps(profile, default=str, ensure_ascii=False),
    ])


def model_mapper(provider: Provider) -> Mapper:
    """A mapper that asks a language model; columns that it leaves out are mapped to none."""

    def ask(profile: list[dict]) -> list[dict]:
        read = lambda x: {str(m["raw_column"]): m for m in x["mappings"] if float(m["confidence"]) >= 0 and m["internal_field"]}
        found = structured(provider, mapping_prompt(profile), read)
        return checked([found.get(c["name"], {"internal_field": NONE, "confidence": 0.0}) | {"raw_column": c["name"]} for c in profile])

    return ask


def checked(proposals: list[dict]) -> list[dict]:
    """Unknown fields become none, confidences lie in 0 to 1."""
    return [{"raw_column": p["raw_column"], "internal_field": p["internal_field"] if p["internal_field"] in FIELDS else NONE, "confidence": round(max(0.0, min(1.0, float(p["confidence"]))), 3)} for p in proposals]


@dataclass
class MappingReport:
    status: str
    mapping: dict[str, str]
    uncertain: list[dict] = field(default_factory=list)
    unmapped_columns: list[str] = field(default_factory=list)
    missing_required: list[str] = field(default_factory=list)
    duplicate_targets: dict[str, list[str]] = field(default_factory=dict)
    messages: list[str] = field(default_factory=list)
    suggestions: list[str] = field(default_factory=list)


def validate_mapping(proposals: list[dict]) -> MappingReport:
    sure = [p for p in proposals if p["internal_field"] != NONE and p["confidence"] >= CONFIDENT]
    report = MappingReport("ok", {p["raw_column"]: p["internal_field"] for p in sure})
    report.unmapped_columns = [p["raw_column"] for p in proposals if p["internal_field"] == NONE]
    report.uncertain = [p for p in proposals if p["internal_field"] != NONE and p["confidence"] < CONFIDENT]
    columns: dict[str, list[str]] = {}
    for p in sure:
        columns.setdefault(p["internal_field"], []).append(p["raw_column"])
    report.duplicate_targets = {f: c for f, c in columns.items() if len(c) > 1}
    derived = "order_value" not in columns and {"quantity", "unit_price"} <= set(columns)
    found = [f for f in REQUIRED if f in columns or f == "order_value" and derived]
    report.missing_required = [f for f in REQUIRED if f not in found]
    if len(found) < MIN_REQUIRED:
        report.status = "rejected"
        report.messages.append("This doesn't look like order data: customer id, order id, order date and order value are needed.")
        report.messages.append("Missing: " + ", ".join(report.missing_required) + ".")
        report.suggestions.append("Provide an export with one row per order line, or rename its columns.")
        return report
    if report.missing_required:
        report.messages.append("Not found with confidence: " + ", ".join(report.missing_required) + ".")
        report.suggestions.append("Name the columns that hold " + ", ".join(report.missing_required) + ".")
    for p in report.uncertain:
        report.messages.append(f"'{p['raw_column']}' may be '{p['internal_field']}' (confidence {p['confidence']}).")
    for f, c in report.duplicate_targets.items():
        report.messages.append(f"Several columns claim '{f}': {', '.join(c)}.")
    if report.missing_required or report.uncertain or report.duplicate_targets:
        report.status = "needs_confirmation"
        if report.uncertain or report.duplicate_targets:
            report.suggestions.append("Confirm uncertain columns and choose one column per field.")
    else:
        report.messages.append("All required fields were found." + " order_value follows from quantity and unit_price." * derived)
    return report


def resolve_duplicates(proposals: list[dict]) -> list[dict]:
    """Of several columns for one field the most confident stays, the first among equals; the others become none."""
    winner: dict[str, int] = {}
    for i, p in enumerate(proposals):
        f = p["internal_field"]
        if f != NONE and (f not in winner or p["confidence"] > proposals[winner[f]]["confidence"]):
            winner[f] = i
    return [p if p["internal_field"] == NONE or winner[p["internal_field"]] == i else {**p, "internal_field": NONE} for i, p in enumerate(proposals)]


def apply_overrides(proposals: list[dict], overrides: dict[str, str]) -> list[dict]:
    unknown = [f for f in overrides.values() if f != NONE and f not in FIELDS]
    if unknown:
        raise ValueError(f"no such field: {', '.join(unknown)}")
    return [{**p, "internal_field": overrides[p["raw_column"]], "confidence": 1.0} if p["raw_column"] in overrides else p for p in proposals]


def detect_date_format(values: DataFrame, column: str, examples: int = 3) -> dict:
    """parseable_fraction, dayfirst (only if strictly better), strategy, unparseable_examples of a column of strings. Month-first reads
    a/b/y as month/day unless only day/month is possible, day-first the other way round, so shares differ only for forms that one of
    them can't read."""
    t = S.strip(F.col(column))
    rows = values.select(t.alias("t")).filter("t <> ''")
    month, day = (S.parse_mixed(F.col("t"), first) for first in (False, True))
    a = rows.agg(F.count("*").alias("n"), F.count(month).alias("m"), F.count(day).alias("d")).first()
    if not a["n"]:
        return {"parseable_fraction": 0.0, "dayfirst": False, "strategy": "mixed", "unparseable_examples": []}
    use_day = a["d"] > a["m"]
    bad = rows.filter((day if use_day else month).isNull()).limit(examples).collect()
    return {"parseable_fraction": round(max(a["d"], a["m"]) / a["n"], 3), "dayfirst": use_day, "strategy": "mixed", "unparseable_examples": [r["t"] for r in bad]}


def apply_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The mapped columns under their fields' names, required ones first; the rest goes."""
    if len(set(mapping.values())) < len(mapping):
        raise ValueError("two columns for one field")
    absent = [c for c in mapping if c not in df.columns]
    if absent:
        raise ValueError(f"no such column: {', '.join(absent)}")
    column = {f: c for c, f in mapping.items()}
    keep = [F.col(ROW)] if ROW in df.columns else []
    return df.select(*[F.col(f"`{column[f]}`").alias(f) for f in FIELDS if f in column], *keep)


def run_mapping(spark: SparkSession, path: str, mapper: Mapper | None = propose) -> tuple[DataFrame, list[dict], MappingReport]:
    """Reads, profiles, proposes, settles duplicates and validates: (raw table, proposals, report). Without a mapper the columns are assigned by
    what all their rows hold, names helping where they tell something (``assignment``)."""
    raw = load_raw_file(spark, path)
    if mapper is None:
        proposals = checked(map_by_values(raw, name_scores([c for c in raw.columns if c != ROW])))
        return raw, proposals, validate_mapping(proposals)
    profile = [r.asDict() for r in profile_columns(raw).collect()]  # one row per column
    proposals = resolve_duplicates(checked(mapper(profile)))
    return raw, proposals, validate_mapping(proposals)


def finalize_mapping(raw: DataFrame, proposals: list[dict], overrides: dict[str, str] | None = None) -> tuple[DataFrame | None, MappingReport]:
    proposals = resolve_duplicates(apply_overrides(proposals, overrides) if overrides else proposals)
    report = validate_mapping(proposals)
    return (None if report.status == "rejected" else apply_mapping(raw, report.mapping)), report
