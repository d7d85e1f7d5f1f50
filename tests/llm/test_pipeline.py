"""Every stage of the pipeline against the plain operators and brute force, and odd tables through all of it."""

import zlib

import pytest

import corpus_pipeline as cp
from segmill.llm import langid, packing, quality, secrets
from segmill.llm.common import materialize, read_table
from tests.llm.test_ops import ROWS, SCHEMA, check_packing, plain_components, plain_spans

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, SF, "documents")
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    labels = read_table(spark, SF, "labels").filter(~quality.held_out())

    before, after = texts(docs), materialize(cp.quality_stage(spark, docs, SF), "t")
    scorer = quality.train(docs, labels)
    assert texts(after) == {d: t for d, t in before.items() if scorer([t])[0] >= 0.3} and after.columns == docs.columns

    docs, before = after, texts(after)
    after = materialize(cp.language_stage(spark, docs, SF), "t")
    model = langid.train(docs.filter(langid.remainder(docs["doc_id"], 4) != 2).select("text", "lang"))
    keep = {d: t for d, t in before.items() if (p := model.predict([t]))[0][0] != "und" and p[2][0] <= cp.MOST_BITS}
    assert texts(after) == keep and after.columns == docs.columns

    docs, before = after, texts(after)
    after = materialize(cp.near_duplicate_stage(spark, docs, SF), "t")
    top = plain_components(list(before.items()), 80)[1]
    assert texts(after) == {d: t for d, t in before.items() if top[d] == d} and after.columns == docs.columns

    docs, before = after, texts(after)
    after = materialize(cp.secrets_stage(spark, docs, SF), "t")
    clean = texts(after)
    assert clean.keys() == before.keys() and after.columns == docs.columns
    assert any(clean[d] != t for d, t in before.items())
    assert all(not plain_spans(t) for t in clean.values()) and all(clean[d] == t for d, t in before.items() if not plain_spans(t))
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect() if r["text"] != before[r["doc_id"]])

    rows = cp.packing_stage(spark, after, SF).collect()
    check_packing(rows, packing.CAPACITY)
    assert {r["doc_id"] for r in rows} == set(clean)


def test_run_equals_the_stages(spark):
    docs = read_table(spark, SF, "documents")
    for _, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, SF), "t")
    key = lambda r: (r["doc_id"], r["piece"], r["ids_crc32"])
    assert sorted(map(key, cp.run(spark, SF).collect())) == sorted(map(key, docs.collect()))


def test_odd_tables(spark, tmp_path):
    rows = [(*r, "clash", 1, None) for r in ROWS]
    docs = spark.createDataFrame(rows, SCHEMA + ", lang_pred string, component_id int, _kept string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (8, 1, None), (6, 0, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    for name, table in (("some", docs), ("none", docs.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        now = table
        for _, stage in cp.STAGES[:-1]:
            now = materialize(stage(spark, now, str(tmp_path / name)), "t")
            assert now.columns == docs.columns and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema]
        ids = [r["doc_id"] for r in now.collect()]
        assert len(ids) == len(set(ids)) and not set(ids) & {3, 4, 5, 6, 7}
        assert all(r["lang_pred"] == "clash" and r["component_id"] == 1 for r in now.collect())
        assert cp.run(spark, str(tmp_path / name)).count() == sum(1 for _ in cp.packing_stage(spark, now, "").collect())


def test_no_distinct_text_is_lost(spark, tmp_path):
    """Repeated doc_ids with different texts, null doc_ids, null languages and labels that teach nothing."""
    some = [r for r in ROWS if r[1] and len(r[1]) > 40][:1]
    texts = [some[0][1], "entirely other words stand in this second text of the same number", "and a third one that shares nothing at all with both of them"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[0] + " tail"), (4, ""), (5, None)]
    docs = spark.createDataFrame([(*r, None, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.quality_stage(spark, docs, str(tmp_path)).count() == 8
    assert cp.language_stage(spark, docs, str(tmp_path)).count() == 6
    kept = cp.near_duplicate_stage(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(1, texts[0]), (1, texts[1]), (0, texts[2]), (4, ""), (5, "")])
    packed = cp.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["piece"]) for r in packed) == [(False, 0), (False, 0), (True, 0)]


def test_documents_of_languages_without_a_model_stay(spark):
    held = next(i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2)  # a row that teaches nothing
    rows = [(i, "plain words of one language that the model has seen " * 3, "en") for i in range(8)] + [(held, "それはまったく別の言葉で書かれた文章です" * 3, "ja"), (held, "それは", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = {r["lang"] for r in cp.language_stage(spark, docs, "").collect()}
    assert left == {"en", "ja"}


def test_held_out_rows_teach_nothing(spark):
    docs = read_table(spark, SF, "documents")
    kept = [r["doc_id"] for r in docs.filter(quality.held_out()).select("doc_id").collect()]
    assert kept and all(zlib.crc32(str(d).encode()) % 5 == 0 for d in kept)
    assert secrets.training_texts(docs.limit(0)) == []


def test_columns_of_any_name(spark, tmp_path):
    names = ["a.b", "a b", "score", "_key", "_row", "h", "lang_pred", "`tick`", "k1", "_column0"]
    rows = [(*r, *[f"{n}{i}" for n in names]) for i, r in enumerate(ROWS)]
    fields = [*[f.split()[0] for f in SCHEMA.split(", ")], *[f"x{i}" for i in range(len(names))]]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", x{i} string" for i in range(len(names)))).toDF(*fields[:5], "other.score", *names)
    spark.createDataFrame([(1, 1, 0), (8, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in cp.STAGES[:-1]:
        after = materialize(stage(spark, docs, str(tmp_path)), "t")
        assert after.columns == docs.columns, name
        given = {(r["doc_id"], r["a.b"]): tuple(r)[5:] for r in docs.collect()}
        assert all(given[r["doc_id"], r["a.b"]] == tuple(r)[5:] for r in after.collect()), name
    assert cp.packing_stage(spark, docs, str(tmp_path)).count() >= len(ROWS)


def test_columns_that_differ_in_case_only(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (8, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], SCHEMA + ", other int").toDF("doc_id", "text", "lang", "source", "n_chars", "Text", "LANG")
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns and len(after.collect()) > 0, name
