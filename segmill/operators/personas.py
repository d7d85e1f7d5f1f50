"""Profiles of clusters, their bands against all customers, and the persona and action of each. Rules replace a language model; the
labeller is a function from profiles to labels; ``label_by_model`` makes one that asks a model."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import ACTIONS, BANDS, FALLBACK_PERSONA, actions
from ..scratch import Scratch
from .models import Provider, structured

FIELDS = ["recency", "frequency", "monetary", "aov", "clv", "tenure"]


def present(df: DataFrame) -> list[str]:
    return [f for f in FIELDS if f in df.columns]


#: One in so many ranks is how far a sketch of a column's ranks may be off.
ACCURACY = 10_000


def quintile_edges(df: DataFrame, fields: list[str] | None = None, shares: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """One row: for each feature the exact quantiles, interpolated; null for a feature without values. A mergeable sketch of each feature's ranks
    brackets every quantile in one pass; a second pass counts the values below a bracket and, one by one, those inside, which are a few in
    ten thousand. A bracket that misses its rank is opened to all values."""
    fields = fields or present(df)
    values = df.select(*[F.col(f"`{f}`").cast("double").alias(str(i)) for i, f in enumerate(fields)])
    slack = 3 / ACCURACY
    probes = [min(max(s + d, 0.0), 1.0) for s in shares for d in (-slack, slack)]
    facts = [x for i in range(len(fields)) for x in (F.count(str(i)), F.min(str(i)), F.max(str(i)), F.percentile_approx(str(i), probes, ACCURACY))]
    row = values.agg(*facts).first() if fields else []
    known = {i: row[4 * i : 4 * i + 4] for i in range(len(fields)) if row[4 * i]}
    places = {(i, j): share * (known[i][0] - 1) for i in known for j, share in enumerate(shares)}
    open_ends = {(i, j): (known[i][3][2 * j], known[i][3][2 * j + 1]) for i, j in places}
    found: dict[tuple[int, int], float] = {}
    while missing := {k: v for k, v in places.items() if k not in found}:
        found |= _exact(values, {k: (*open_ends[k], v) for k, v in missing.items()})
        open_ends |= {(i, j): (known[i][1], known[i][2]) for i, j in missing}
    edges = [F.array(*[F.lit(found[i, j]) for j in range(len(shares))]) if i in known else F.lit(None).cast("array<double>") for i in range(len(fields))]
    return df.sparkSession.range(1).select(*[e.alias(f) for e, f in zip(edges, fields)])


def _exact(values: DataFrame, wanted: dict[tuple[int, int], tuple[float, float, float]]) -> dict[tuple[int, int], float]:
    """wanted: by column and number the bracket of a quantile and its place among the ranks. The quantiles whose ranks lie in their brackets."""
    entry = lambda i, j, v: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), v.alias("v"))
    none = F.lit(None).cast("double")
    cells = [F.when(F.col(str(i)) < low, entry(i, j, none)).when(F.col(str(i)) <= high, entry(i, j, F.col(str(i)))) for (i, j), (low, high, _) in wanted.items()]
    counts = values.select(F.explode(F.array_compact(F.array(*cells))).alias("e")).groupBy("e.i", "e.j", "e.v").agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.partitionBy("i", "j").orderBy(F.col("v").asc_nulls_first()))  # a bracket's values; those below it are one row
    ends = counts.withColumn("end", running)
    ranks = values.sparkSession.createDataFrame([(i, j, r) for (i, j), (_, _, place) in wanted.items() for r in {int(place), -int(-place // 1)}], "i int, j int, r long")
    at = ends.join(F.broadcast(ranks), ["i", "j"]).filter("v IS NOT NULL AND r >= end - n AND r < end")  # two rows for each quantile
    hit: dict[tuple[int, int], dict[int, float]] = {}
    for r in at.select("i", "j", "r", "v").collect():
        hit.setdefault((r["i"], r["j"]), {})[r["r"]] = r["v"]
    out = {}
    for k, (_, _, place) in wanted.items():
        low, high = int(place), -int(-place // 1)
        if k in hit and low in hit[k] and high in hit[k]:
            out[k] = hit[k][low] + (hit[k][high] - hit[k][low]) * (place - low)
    return out


def band(value: Column, edges: Column) -> Column:
    """How many edges are at most the value."""
    names = F.array(*map(F.lit, BANDS))
    return F.element_at(names, F.size(F.filter(edges, lambda e: e <= value)) + 1)


def profiles(df: DataFrame) -> DataFrame:
    """Per cluster: size, share_pct, averages, relative (bands of the rounded averages), top_category; highest mean monetary first."""
    fields = present(df)
    top = [F.mode("top_category", True).alias("top_category")] if "top_category" in df.columns else [F.lit(None).cast("string").alias("top_category")]
    per = df.groupBy("cluster").agg(F.count("*").alias("size"), *[S.round2(S.money_sum(F.col(f)) / F.count(f)).alias(f) for f in fields], *top)
    edges = quintile_edges(df, fields).select(F.struct(*fields).alias("_edges"))
    rows = per.crossJoin(F.broadcast(edges))  # one row
    pairs = lambda make: F.create_map(*[x for f in fields for x in (F.lit(f), make(f))])
    total = F.sum("size").over(Window.partitionBy(F.lit(1)))  # over one row per cluster
    out = rows.select("cluster", "size", (F.rint(F.col("size") * 1000 / total) / 10).alias("share_pct"), pairs(F.col).alias("averages"), pairs(lambda f: band(F.col(f), F.col("_edges")[f])).alias("relative"), "top_category")
    return out.orderBy(F.desc(F.col("averages")["monetary"]), "cluster") if "monetary" in fields else out


def separating_features(profile: DataFrame) -> DataFrame:
    """feature, n_bands, separates: whether its band differs between clusters."""
    long = profile.select("cluster", F.explode("relative").alias("feature", "band"))
    return long.groupBy("feature").agg(F.count_distinct("band").alias("n_bands")).withColumn("separates", F.col("n_bands") > 1)


def _is(bands: Column, field: str, *names: str) -> Column:
    return F.coalesce(bands[field].isin(*names), F.lit(False))


HIGH, LOW = ("high", "very_high"), ("low", "very_low")


def persona_rules(bands: Column) -> list[tuple[str, str, Column]]:
    """Persona, the rule in words, the rule; the first that holds counts."""
    return [
        ("Loyal Big Spenders", "monetary high, frequency high, recency low", _is(bands, "monetary", *HIGH) & _is(bands, "frequency", *HIGH) & _is(bands, "recency", *LOW)),
        ("At-Risk High Value", "monetary high, recency high", _is(bands, "monetary", *HIGH) & _is(bands, "recency", *HIGH)),
        ("New Customers", "tenure low, frequency low", _is(bands, "tenure", *LOW) & _is(bands, "frequency", *LOW)),
        ("One-Time Buyers", "frequency very_low, monetary low", _is(bands, "frequency", "very_low") & _is(bands, "monetary", *LOW)),
        (FALLBACK_PERSONA, "monetary low, frequency low, recency high", _is(bands, "monetary", *LOW) & _is(bands, "frequency", *LOW) & _is(bands, "recency", *HIGH)),
    ]


def label_by_rules(profile: DataFrame) -> DataFrame:
    """profile with persona and reasoning (the rule and the bands it looked at)."""
    rules = persona_rules(F.col("relative"))
    pick = lambda i, rest: reduce(lambda acc, rule: F.when(rule[2], F.lit(rule[i])).otherwise(acc), reversed(rules), F.lit(rest))
    bands = F.array_join(F.transform(F.array_sort(F.map_entries("relative")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return profile.withColumns({"persona": pick(0, FALLBACK_PERSONA), "reasoning": F.concat(pick(1, "no rule holds"), F.lit(": "), bands)})


def label_by_model(provider: Provider) -> Callable[[DataFrame], DataFrame]:
    """A labeller that shows a language model the profiles; clusters without a usable answer are labelled by the rules."""

    def label(profile: DataFrame) -> DataFrame:
        rows = [r.asDict(recursive=True) for r in profile.collect()]  # one row per cluster
        personas = [p[0] for p in ACTIONS]
        prompt = (
            f"Give each cluster of customers one of these personas: {', '.join(personas)}. Bands compare its averages with all customers; features whose bands are alike in all clusters say nothing.\n"
            f"Clusters: {json.dumps(rows, default=str)}\nReturn {{\"labels\": [{{\"cluster\": number, \"persona\": name, \"reasoning\": one sentence}}, ...]}}."
        )
        found = structured(provider, prompt, lambda x: {int(a["cluster"]): (str(a["persona"]), str(a.get("reasoning", ""))) for a in x["labels"]})
        said = profile.sparkSession.createDataFrame([(c, p, r) for c, (p, r) in found.items() if p in personas], "cluster int, _persona string, _reasoning string")
        ruled = label_by_rules(profile).join(F.broadcast(said), "cluster", "left")  # one row per cluster
        return ruled.withColumns({"persona": F.coalesce("_persona", "persona"), "reasoning": F.coalesce("_reasoning", "reasoning")}).drop("_persona", "_reasoning")

    return label


def map_actions(labels: DataFrame) -> DataFrame:
    """labels (with persona) with action, channel, priority, priority_score; unknown personas get the fallback's."""
    table = actions(labels.sparkSession).withColumnRenamed("persona", "_persona")
    known = [r["_persona"] for r in table.select("_persona").collect()]  # five rows
    wanted = F.when(F.col("persona").isin(known), F.col("persona")).otherwise(FALLBACK_PERSONA)
    return labels.withColumn("_key", wanted).join(F.broadcast(table), F.col("_key") == F.col("_persona"), "left").drop("_key", "_persona")


def segments(profile: DataFrame, labeller: Callable[[DataFrame], DataFrame] = label_by_rules) -> DataFrame:
    """Profiles with persona and action, the most urgent first."""
    return map_actions(labeller(profile)).orderBy(F.desc("priority_score"), F.desc(F.col("averages")["monetary"]), "cluster")


def label_customers(df: DataFrame, labeller: Callable[[DataFrame], DataFrame] = label_by_rules) -> tuple[DataFrame, DataFrame]:
    """(customers with persona, action, channel, priority, priority_score; the segments)."""
    found = segments(profiles(df), labeller)
    return df.join(F.broadcast(found.select("cluster", "persona", "action", "channel", "priority", "priority_score")), "cluster", "left"), found  # one row per cluster
