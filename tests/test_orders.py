"""From a messy export to labelled customers: a made-up export whose clean values are known, and hand-made values."""

import csv
import datetime as dt
import json
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmill.operators import cleaning, clustering, features, mapping, models, personas, questions, revenue
from segmill.plans.pipeline import Pipeline
from segmill.schema import K_TABLE, ORDER_LINE
from segmill.sources import files
from segmill.streaming import scoring

LATE = dt.datetime(2025, 1, 1)
HEAD = ["Cust ID", "Order #", "Order Date", "Total $", "SKU Category", "Qty"]
STYLES = ["%d-%m-%Y", "%m/%d/%Y", "%Y-%m-%d", "%b %d %Y"]


@pytest.fixture(scope="module")
def export(tmp_path_factory):
    """(path, rows of the file, clean rows: customer, order, date, value, category, quantity; how many rows each step must drop)."""
    rng, rows, good = np.random.default_rng(8), [], []
    drops = Counter()
    for i in range(400):
        customer, order, day = f"C{rng.integers(1, 81):03d}", f"ORD{1000 + i}", dt.datetime(2024, 1, 1) + dt.timedelta(days=int(rng.integers(0, 180)))
        value, category, quantity = round(float(rng.uniform(5, 600)), 2), str(rng.choice(["Toys", "Beauty", "Sports", "Footwear", ""])), int(rng.integers(1, 6))
        money = [f"{value:.2f}", f"${value:,.2f}"][i % 2]
        kind = "" if i < 8 else str(rng.choice(["", "null_required", "negative", "zero"], p=[0.94, 0.02, 0.02, 0.02]))
        text = {"": money, "null_required": "", "negative": f"-{money}", "zero": "0.00"}[kind]
        rows.append([customer, order, day.strftime(STYLES[i % 4]), text, category.upper() if i % 5 == 0 else category, str(quantity)])
        drops[kind or "rows_out"] += 1
        if not kind:
            good.append((customer, order, day, value, category or None, quantity))
            if i % 40 == 7:
                rows.append(rows[-1])
                drops["duplicates"] += 1
    path = tmp_path_factory.mktemp("export") / "orders.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([HEAD, *rows])
    return str(path), rows, good, drops


@pytest.fixture(scope="module")
def raw(spark, export):
    return files.load_raw_file(spark, export[0])


@pytest.fixture(scope="module")
def lines(raw):
    profile = [r.asDict() for r in mapping.profile_columns(raw).collect()]
    found, report = mapping.finalize_mapping(raw, mapping.checked(mapping.propose(profile)))
    assert report.status == "ok" and report.mapping == dict(zip(HEAD, ["customer_id", "order_id", "order_date", "order_value", "product_category", "quantity"]))
    return found


def test_profile_keeps_the_order_of_rows(raw, export):
    for i, r in enumerate(mapping.profile_columns(raw).collect()):
        values = [x[i] for x in export[1] if x[i]]
        assert r["name"] == HEAD[i] and r["samples"] == list(dict.fromkeys(values))[:5] and (r["non_null"], r["null"]) == (len(values), len(export[1]) - len(values))


def test_cleaning_counts(lines, export):
    _, rows, good, drops = export
    done = cleaning.clean(lines, LATE)
    r = done.report_dict()
    want = {"rows_in": len(rows), "rows_out": len(good), "rows_dropped": len(rows) - len(good), "future_orders": 0, "n_customers": len({g[0] for g in good}), "n_orders": len(good), "missing_product_category": sum(g[4] is None for g in good), "merged_groups": 0, "currencies_found": ["USD"], "mixed": False, "null_order_value": drops["null_required"]}
    want |= {k: drops[k] for k in ("null_required", "duplicates", "negative", "zero")}
    assert {k: r[k] for k in want} == want and all(drops[k] for k in ("null_required", "duplicates", "negative", "zero"))
    assert (r["first_date"], r["last_date"]) == (min(g[2] for g in good), max(g[2] for g in good))
    clean = {(x["customer_id"], x["order_id"], x["order_date"], x["order_value"], x["product_category"], x["quantity"]) for x in done.lines.collect()}
    assert clean == set(good) and cleaning.warnings(r) == []
    repeated = {x["order_id"] for x in cleaning.repeated_row_examples(cleaning.drop_null_required(cleaning.typed(lines)), 100).collect()}
    assert repeated == {o for o, n in Counter(x[1] for x in rows).items() if n > 1}


def test_late_orders_go(lines, export):
    day = dt.datetime(2024, 3, 1)
    r = cleaning.clean(lines, day).report_dict()
    assert r["future_orders"] == sum(g[2] > day for g in export[2]) and r["rows_out"] == sum(g[2] <= day for g in export[2])


def test_features(lines, export):
    rows = {r["customer_id"]: r for r in features.engineer_features(cleaning.clean(lines, LATE).lines).collect()}
    by = defaultdict(list)
    for g in export[2]:
        by[g[0]].append(g)
    last = max(g[2] for g in export[2])
    assert rows.keys() == by.keys()
    for c, own in by.items():
        monetary, n = round(sum(g[3] for g in own), 2), len(own)
        top = min(((-k, v) for v, k in Counter(g[4] for g in own if g[4]).items()), default=(0, None))[1]
        want = ((last - max(g[2] for g in own)).days, n, pytest.approx(monetary), pytest.approx(monetary / n, abs=0.006), pytest.approx(monetary * 0.3, abs=0.006), (last - min(g[2] for g in own)).days, top)
        assert tuple(rows[c][f] for f in ("recency", "frequency", "monetary", "aov", "clv", "tenure", "top_category")) == want
        assert [rows[c][f"cat_{v}"] for v in ("Beauty", "Footwear", "Sports", "Toys")] == [int(v == top) for v in ("Beauty", "Footwear", "Sports", "Toys")]


def test_customer_spellings_become_the_first(spark):
    df = spark.createDataFrame([(0, "AB-12"), (1, "xy12"), (2, "UNKNOWN"), (3, None), (4, "John Doe"), (5, "johndoe"), (6, "9")], "_row_id long, customer_id string")
    got = {r["_row_id"]: r["customer_id"] for r in cleaning.normalize_customer_ids(df).collect()}
    assert got == {0: "AB-12", 1: "AB-12", 2: None, 3: None, 4: "John Doe", 5: "John Doe", 6: "9"}
    assert tuple(cleaning.id_merge_report(df).first()) == (5, 3, 2)
    assert [tuple(r) for r in cleaning.id_merge_examples(df).collect()] == [("AB-12", ["AB-12", "xy12"]), ("John Doe", ["John Doe", "johndoe"])]


def test_steps_without_their_columns_change_nothing(spark):
    df = spark.createDataFrame([(1, 2)], "_row_id long, other int")
    for step in (cleaning.coerce_types, cleaning.derive_order_value, cleaning.normalize_customer_ids, cleaning.normalize_order_ids, cleaning.normalize_categories, cleaning.drop_repeated_rows, cleaning.drop_nonpositive_values, cleaning.drop_future_orders):
        assert step(df).collect() == df.collect()
    with pytest.raises(ValueError):
        features.rfm(df)


def test_empty_lines(spark):
    none = spark.createDataFrame([], ORDER_LINE)
    assert features.rfm(none).count() == 0 and cleaning.clean(none).report_dict()["rows_out"] == 0


# files


@pytest.mark.parametrize(("name", "content", "columns", "rows"), [
    ("a.csv", "﻿x, y\n1, 2\n\n".encode(), ["x", "y"], [("1", "2")]),
    ("b.tsv", b"a\ta\tb\n1\tN/A\tunknown\n2\t\tz\n", ["a", "b"], [("1", "unknown"), ("2", "z")]),
    ("c.txt", "n;v\n\"two\nlines\";é\n".encode("latin-1"), ["n", "v"], [("two\nlines", "é")]),
    ("d.csv", b"a,a,b\n1,2,3\n4,5\n", ["a", "a.1", "b"], [("1", "2", "3"), ("4", "5", None)]),
])
def test_files(spark, tmp_path, name, content, columns, rows):
    (tmp_path / name).write_bytes(content)
    df = files.load_raw_file(spark, str(tmp_path / name))
    assert df.columns == [*columns, "_row_id"] and [tuple(r)[:-1] for r in df.orderBy("_row_id").collect()] == rows


def test_bad_files(spark, tmp_path):
    (tmp_path / "long.csv").write_text("a,b\n1,2,3\n")
    (tmp_path / "none.csv").write_text("a,b\n")
    for name, error in (("absent.csv", FileNotFoundError), ("x.pdf", ValueError), ("long.csv", ValueError), ("none.csv", ValueError)):
        with pytest.raises(error):
            files.load_raw_file(spark, str(tmp_path / name))


def test_export(spark, tmp_path):
    files.export_csv(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "out"), single=True)
    assert spark.read.csv(str(tmp_path / "out"), header=True).collect() == [("1", "x")]
    assert open(files.save_upload(b"x", str(tmp_path / "up"), "../n.csv")).read() == "x"


# mapping


def proposals(*rows):
    return [{"raw_column": c, "internal_field": f, "confidence": x} for c, f, x in rows]


def test_mapping_rules():
    full = [("a", "customer_id", 0.9), ("b", "order_id", 0.9), ("c", "order_date", 0.9)]
    assert mapping.validate_mapping(proposals(*full, ("d", "order_value", 0.6))).status == "ok"
    assert mapping.validate_mapping(proposals(*full, ("d", "quantity", 1), ("e", "unit_price", 1))).status == "ok"
    low = mapping.validate_mapping(proposals(*full, ("d", "order_value", 0.59)))
    assert low.status == "needs_confirmation" and low.missing_required == ["order_value"] and len(low.uncertain) == 1
    assert mapping.validate_mapping(proposals(full[0])).status == "rejected"
    twice = proposals(*full, ("d", "order_value", 0.8), ("e", "order_value", 0.8), ("f", "none", 1))
    assert mapping.validate_mapping(twice).duplicate_targets == {"order_value": ["d", "e"]}
    assert [p["internal_field"] for p in mapping.resolve_duplicates(twice)] == ["customer_id", "order_id", "order_date", "order_value", "none", "none"]
    assert mapping.apply_overrides(twice, {"e": "quantity"})[4] == {"raw_column": "e", "internal_field": "quantity", "confidence": 1.0}
    with pytest.raises(ValueError):
        mapping.apply_overrides(twice, {"e": "nonsense"})
    assert mapping.checked(proposals(("x", "nonsense", 7)))[0] == {"raw_column": "x", "internal_field": "none", "confidence": 1.0}


def test_mapping_projection(spark):
    df = spark.createDataFrame([("v", "c", "x")], ["Total $", "Cust", "rest"])
    assert mapping.apply_mapping(df, {"Total $": "order_value", "Cust": "customer_id"}).columns == ["customer_id", "order_value"]
    for wrong in ({"Total $": "order_value", "Cust": "order_value"}, {"absent": "order_id"}):
        with pytest.raises(ValueError):
            mapping.apply_mapping(df, wrong)


def test_date_format_of_a_column(spark):
    df = spark.createDataFrame([("2023-01-02",), ("13/14/2023",), (" ",), ("Jan 5 2023",), ("x",)], "d string")
    got = mapping.detect_date_format(df, "d")
    assert got["parseable_fraction"] == 0.5 and not got["dayfirst"] and set(got["unparseable_examples"]) == {"13/14/2023", "x"}
    assert mapping.detect_date_format(df.limit(0), "d")["parseable_fraction"] == 0.0


# revenue


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame([("A", "Loyal Big Spenders", 700.0, 210.0), ("B", "At-Risk High Value", 200.0, 60.0), ("C", "One-Time Buyers", 100.0, 30.0), ("D", "New Customers", 0.0, 0.0)], "customer_id string, persona string, monetary double, clv double")


def test_concentration(four):
    rows = revenue.concentration(four).collect()
    assert [(r["segment"], r["pct_of_revenue"], r["customer_count"]) for r in rows] == [("Loyal Big Spenders", 70.0, 1), ("At-Risk High Value", 20.0, 1), ("One-Time Buyers", 10.0, 1)]
    assert rows[0]["pct_of_customers"] == 33.33
    t = revenue.concentration_totals(four).first()
    assert (t["total_revenue"], t["total_customers"], t["excluded_count"]) == (1000.0, 3, 1)
    assert revenue.long_form(revenue.concentration(four)).count() == 6
    assert revenue.display_table(revenue.concentration(four)).first()["total_revenue"] == "$700.00"


def test_value_at_risk(four):
    r = revenue.clv_at_risk(four).first()
    assert (r["total_clv_at_risk"], r["pct_of_total_clv_at_risk"], r["customer_count_at_risk"], r["pct_of_total_customers_at_risk"], r["excluded_count"], r["matched_segments"]) == (60.0, 20.0, 1, 25.0, 1, ["At-Risk High Value"])
    none = revenue.clv_at_risk(four, patterns=["nothing"]).first()
    assert (none["any_at_risk"], none["total_clv_at_risk"], none["matched_segments"]) == (False, 0.0, [])
    zero = four.withColumn("monetary", F.lit(0.0))
    assert revenue.concentration(zero).collect() == [] and revenue.concentration_totals(zero).first()["excluded_count"] == 4
    assert revenue.clv_breakdown(four).first()["total_clv"] == 60.0


# clustering


def blobs(spark, centers, sizes, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(float(x), float(y), i) for i, (c, n) in enumerate(zip(centers, sizes)) for x, y in rng.normal(c, 0.6, (n, 2))]
    return spark.createDataFrame([(str(k), *r) for k, r in enumerate(rows)], "customer_id string, f0 double, f1 double, truth int")


THREE = [(0, 0), (10, 10), (20, 0)]


def test_three_blobs(spark):
    df = blobs(spark, THREE, [100] * 3)
    got = clustering.select_optimal_k(df, ["f0", "f1"], starts=3)
    assert got.recommended_k == 3 and got.table.filter("k = 3").first()["avg_stability_ari"] > 0.7 and got.table.count() == 14
    assert got.table.schema == K_TABLE and not got.sampled


def test_picture_of_the_selection(spark, tmp_path):
    import xml.etree.ElementTree as xml

    table = spark.createDataFrame([(2, 0.3, 1.0, 0.9, 0.4, False), (3, 0.4, 0.9, 0.95, 0.2, False), (4, None, None, 0.5, 0.01, True)], K_TABLE)
    selection = clustering.Selection(table, 3, "", False, (2, 4))
    clustering.save_diagnostic(selection, str(tmp_path / "plot"))
    tree = xml.fromstring("\n".join(r["value"] for r in spark.read.text(str(tmp_path / "plot")).collect()))
    marks = [e for e in tree.iter() if e.tag.endswith("circle")]
    assert len(marks) == 2 + 2 + 3 and sum(e.get("fill") == "white" for e in marks) == 1


def test_small_cluster_is_disqualified(spark):
    got = clustering.select_optimal_k(blobs(spark, [(0, 0), (12, 12), (24, 0)], [220, 220, 25]), ["f0", "f1"], k_range=(2, 5), min_share=0.08, starts=3)
    rows = {r["k"]: r for r in got.table.collect()}
    assert rows[3]["disqualified"] and max(rows.values(), key=lambda r: r["avg_silhouette"])["k"] == 3 and got.recommended_k != 3


def test_too_few_rows(spark):
    with pytest.raises(ValueError):
        clustering.select_optimal_k(blobs(spark, THREE, [1, 1, 2]), ["f0", "f1"], k_range=(10, 15))


def test_quality_measures(spark):
    df = blobs(spark, THREE, [20, 30, 1])
    x = np.array([[r["f0"], r["f1"]] for r in df.collect()])
    y = np.array([r["truth"] for r in df.collect()])
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    want = []
    for i in range(len(x)):
        means = {c: d[i, y == c].sum() / max(1, (y == c).sum() - (c == y[i])) for c in set(y)}
        other = min(v for c, v in means.items() if c != y[i])
        want.append(0 if (y == y[i]).sum() == 1 else (other - means[y[i]]) / max(other, means[y[i]]))
    m = clustering.cluster_metrics(df, ["f0", "f1"], "truth").first()
    assert m["silhouette"] == pytest.approx(np.mean(want)) and m["k"] == 3
    centers = np.array([x[y == c].mean(0) for c in range(3)])
    s = [np.sqrt(((x[y == c] - centers[c]) ** 2).sum(1)).mean() for c in range(3)]
    r = [max((s[i] + s[j]) / np.sqrt(((centers[i] - centers[j]) ** 2).sum()) for j in range(3) if j != i) for i in range(3)]
    assert m["davies_bouldin"] == pytest.approx(np.mean(r))
    assert clustering.adjusted_rand(df, "truth", "truth").first()[0] == 1.0
    assert clustering.cluster_metrics(df.withColumn("truth", F.lit(1)), ["f0", "f1"], "truth").first()["silhouette"] is None


def test_recommendation_falls_back(spark):
    table = lambda *rows: spark.createDataFrame(list(rows), K_TABLE)
    assert clustering.recommend_k(table((2, 0.5, 1.0, 0.7, 0.3, False), (3, 0.4, 1.0, 0.71, 0.3, False))).first()["k"] == 3
    assert clustering.recommend_k(table((2, 0.5, 1.0, 0.1, 0.3, False), (3, 0.6, 1.0, 0.2, 0.3, False))).first()["k"] == 3
    assert clustering.recommend_k(table((2, 0.5, 1.0, 0.9, 0.01, True), (3, 0.5, 1.0, 0.9, 0.01, True))).first()["k"] == 2
    assert clustering.recommend_k(table((4, None, None, 1.0, 0.3, False), (5, None, None, 1.0, 0.3, False))).first()["k"] == 4


def test_scaling(spark):
    df = spark.createDataFrame([(0.0, 5.0), (0.0, 5.0), (10.0, 5.0), (10.0, 5.0)], "recency double, tenure double")
    assert [tuple(r) for r in clustering.scale_features(df, ["recency", "tenure"]).collect()] == [(-1.0, 0.0), (-1.0, 0.0), (1.0, 0.0), (1.0, 0.0)]


# personas


def test_bands_and_personas(spark):
    df = spark.createDataFrame([(i // 25, float(100 - i), float(i), float(i * i), float(i)) for i in range(100)], "cluster int, recency double, frequency double, monetary double, tenure double")
    p = personas.profiles(df).collect()
    assert [r["cluster"] for r in p] == [3, 2, 1, 0] and p[0]["relative"]["monetary"] == "very_high" and p[0]["share_pct"] == 25.0
    labelled, segments = personas.label_customers(df)
    assert labelled.filter("persona IS NULL").count() == 0 and segments.first()["priority_score"] == max(r["priority_score"] for r in segments.collect())
    by = {r["cluster"]: r["persona"] for r in segments.collect()}
    assert by[3] == "Loyal Big Spenders" and by[0] == "New Customers"
    assert {r["feature"]: r["separates"] for r in personas.separating_features(personas.profiles(df)).collect()}["monetary"]
    odd = personas.map_actions(spark.createDataFrame([("Strangers",)], "persona string")).first()
    assert odd["priority"] == "deprioritize"


# questions


@pytest.fixture(scope="module")
def customers(spark):
    rows = [(str(i), "Loyal Big Spenders" if i % 2 else "One-Time Buyers", float(i), i % 3, "retain") for i in range(12)]
    return spark.createDataFrame(rows, "customer_id string, persona string, monetary double, frequency int, priority string")


def test_example_questions(customers):
    got = [questions.answer(q, customers) for q in questions.EXAMPLES]
    assert all(g["error"] is None for g in got)
    assert sorted(map(tuple, got[0]["result"].collect())) == [("Loyal Big Spenders", 6), ("One-Time Buyers", 6)]
    assert got[1]["result"].first()[0] == 6.0 and [r[0] for r in got[2]["result"].collect()] == ["11", "10", "9", "8", "7"]
    assert got[3]["result"].first()[0] == 4


def test_unanswerable_and_unsafe(customers):
    got = questions.answer("What is the weather?", customers)
    assert got["error"] and got["out_of_scope"] and got["result"] is None
    q = questions.Query
    unsafe = [
        q(), q(measure="count", filters=[("nowhere", "=", 1)]), q(measure="count", filters=[("persona", "LIKE", "x")]), q(measure="count", filters=[("persona", "=", ["x"])]), q(measure="reflect", column="monetary"),
        q(measure="avg", column="java_method('x')"), q(columns=["customer_id", "secret"]), q(columns=["customer_id"], limit=0), q(columns=["customer_id"], limit=10**6), q(columns=["customer_id"], order=[("monetary", True)]), q(columns=["customer_id"], group="persona"),
    ]
    for query in unsafe:
        assert questions.is_safe(query, customers.columns)
        assert questions.answer("customers?", customers, lambda q, s, query=query: questions.Translation(query))["error"]
    fine = q([("frequency", ">", 1)], "persona", "avg", "monetary", order=[("persona", False)], limit=5)
    assert questions.is_safe(fine, customers.columns) is None and [tuple(r) for r in questions.run(fine, customers).collect()] == [("Loyal Big Spenders", 8.0), ("One-Time Buyers", 5.0)]  # rows 2, 5, 8 and 11


class Model:
    def __init__(self, *answers):
        self.answers, self.prompts = list(answers), []

    def complete(self, prompt, temperature=0.2):
        self.prompts.append(prompt)
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def test_models_answers_are_asked_again():
    assert models.structured(Model("nonsense", '```json\n{"a": 1}\n```'), "?", lambda x: x) == {"a": 1}
    assert models.text(Model(OSError("gone"), " fine "), "?", pause=0) == "fine"
    with pytest.raises(RuntimeError):
        models.text(Model(*[OSError("gone")] * 3), "?", pause=0)


def test_models_in_the_place_of_rules(spark, customers):
    profile = [{"name": "Kunde", "samples": ["1"], "non_null": 1, "null": 0}, {"name": "Rest", "samples": [], "non_null": 0, "null": 1}]
    model = Model('{"mappings": [{"raw_column": "Kunde", "internal_field": "customer_id", "confidence": 0.9}]}')
    assert mapping.model_mapper(model)(profile) == [{"raw_column": "Kunde", "internal_field": "customer_id", "confidence": 0.9}, {"raw_column": "Rest", "internal_field": "none", "confidence": 0.0}]
    assert all(f in model.prompts[0] for f in ("customer_id", "unit_price", "Kunde"))
    ask = questions.model_translator(Model('{"filters": [["frequency", ">", 1]], "measure": "count"}', '{"reason": "no"}'))
    got = questions.answer("how many came back?", customers, ask, provider=Model("Four came back."))
    assert got["text"] == "Four came back." and got["result"].first()[0] == 4
    assert questions.answer("weather?", customers, ask)["out_of_scope"]
    df = spark.createDataFrame([(i // 25, float(100 - i), float(i), float(i * i), float(i)) for i in range(100)], "cluster int, recency double, frequency double, monetary double, tenure double")
    label = personas.label_by_model(Model('{"labels": [{"cluster": 0, "persona": "Low Engagement", "reasoning": "quiet"}, {"cluster": 1, "persona": "Strangers"}]}'))
    by = {r["cluster"]: r["persona"] for r in personas.segments(personas.profiles(df), label).collect()}
    assert by[0] == "Low Engagement" and by[3] == "Loyal Big Spenders"


def test_provider_from_settings(spark):
    import http.server
    import threading

    class Endpoint(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = json.dumps({"choices": [{"message": {"content": f"{asked['model']}:{asked['messages'][0]['content']}:{self.headers['Authorization']}"}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    with pytest.raises(RuntimeError):
        models.get_provider(spark)
    server = http.server.HTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    for name, value in (("url", f"http://127.0.0.1:{server.server_port}/v1/"), ("key", "k"), ("name", "m")):
        spark.conf.set(f"spark.segmill.model_{name}", value)
    assert models.text(models.get_provider(spark), "hello") == "m:hello:Bearer k" and models.get_provider(spark) is models.get_provider(spark)
    for name in ("url", "key", "name"):
        spark.conf.unset(f"spark.segmill.model_{name}")
    server.shutdown()


# everything


def test_pipeline_and_stream(spark, tmp_path, export):
    p, good = Pipeline(spark), export[2]
    n = len({g[0] for g in good})
    labelled = p.run(export[0], reference=LATE, k_range=(2, 4), seeds=2, starts=2)
    assert labelled.count() == n and labelled.filter("persona IS NULL OR dim_x IS NULL").count() == 0
    assert p.clustered.metadata["n_customers"] == n and json.dumps(p.clustered.metadata, default=str)
    assert p.revenue()["totals"].first()["total_revenue"] == pytest.approx(sum(g[3] for g in good))
    assert p.ask(questions.EXAMPLES[3])["result"].first()[0] == sum(k == 1 for k in Counter(g[0] for g in good).values())
    clustering.save(p.clustered.model, p.clustered.metadata, p.features, str(tmp_path / "m"))
    model, metadata = clustering.load(spark, str(tmp_path / "m"))
    assert metadata["final_k"] == p.clustered.metadata["final_k"]
    p.features.write.parquet(str(tmp_path / "in"))
    query = scoring.score_stream(scoring.feature_stream(spark, str(tmp_path / "in"), p.features.schema), model, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    stream = {r["customer_id"]: r["cluster"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert stream == {r["customer_id"]: r["cluster"] for r in labelled.collect()}
    p.forget()


def test_an_odd_byte_at_the_end_decides_the_encoding(spark, tmp_path):
    body = "Cust,Order,Note\n" + "".join(f"{i},{i},plain text to fill the file\n" for i in range(4000))
    (tmp_path / "late.csv").write_bytes((body + "9,9,café\n").encode("latin-1"))
    assert files.text_facts(spark, str(tmp_path / "late.csv")) == ("ISO-8859-1", False)
    df = files.load_raw_file(spark, str(tmp_path / "late.csv"))
    assert df.count() == 4001 and df.filter("Note = 'café'").count() == 1
    (tmp_path / "open.csv").write_text('a,b\n1,"two\nlines"\n3,"say ""x"""\n')
    assert files.text_facts(spark, str(tmp_path / "open.csv"))[1]
    assert [r["b"] for r in files.load_raw_file(spark, str(tmp_path / "open.csv")).orderBy("_row_id").collect()] == ["two\nlines", 'say "x"']


def test_report_counts_derived_rows_and_shows_examples(spark):
    rows = [("c1", "a", "2024-01-02", None, "2", "3.5"), ("C01", "a", "2024-01-02", None, "2", "3.5"), ("c1", "b", "2024-01-03", "9", "1", "1"), (None, "c", "2024-01-03", "9", "1", "1")]
    raw = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "customer_id string, order_id string, order_date string, order_value string, quantity string, unit_price string, _row_id long")
    done = cleaning.clean(raw, LATE)
    r = done.report_dict()
    assert (r["rows_computed"], r["duplicates"], r["null_required"], r["rows_out"], r["merged_groups"]) == (2, 1, 1, 2, 1)
    assert r["merge_examples"] == [{"merged_to": "c1", "variants": ["c1", "C01"]}] and r["duplicate_ids"] == ["a"]
    assert {(x["customer_id"], x["order_id"], x["order_value"]) for x in done.lines.collect()} == {("c1", "a", 7.0), ("c1", "b", 9.0)}
    assert any("2 rows" in w for w in cleaning.warnings(r))
    done.release()
