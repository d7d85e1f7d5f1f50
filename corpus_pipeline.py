"""From raw documents to packed training sequences, in five stages over the operators of segmill.llm.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; its result is written
as Parquet and read again as the next stage's docs. All stages but the last return the columns of ``documents``. Texts of any length are
handled whole; an empty table stays empty; extra columns of any name are kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.llm import langid, neardup, packing, quality, secrets
from segmill.llm.common import free_name, materialize, read_table

MOST_BITS = 6.5
SIMILAR = 80
#: Columns that stages read; all others go through a stage under names of their places, so that dots, spaces or letter case do no harm.
READ = ("doc_id", "text", "lang", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def any_names(stage: Stage) -> Stage:
    """The stage for tables whose other columns have any names; the result has the names of docs again."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        return stage(spark, docs.toDF(*[n if n in READ else f"_column{i}" for i, n in enumerate(names)]), sf_dir).toDF(*names)

    return run


@any_names
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a quality score below 0.3, learned from the labels in sf_dir. Without usable labels every score is 0.5 and all
    stay, with labels of one class it is that class's share. Null and empty texts are scored like any other, repeated rows alike; rows
    with null doc_id are scored but never learned from."""
    labels = read_table(spark, sf_dir, "labels").filter(~quality.held_out())
    name = free_name(docs, "score")
    scored = quality.score(docs, quality.train(docs, labels), name)
    return scored.filter(F.col(name) >= quality.THRESHOLD).select(docs.columns)


@any_names
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts among them), and those whose shortest code takes over 6.5 bits a byte, which is
    no language that was learned. A document that names a language nothing was learned about stays, as does everything with a letter if
    nothing was learned at all. Repeated rows fare alike."""
    model = langid.train(docs.filter(langid.remainder(F.col("doc_id"), 4) != 2).select("text", "lang"))
    lang, score, bits = (free_name(docs, n) for n in ("lang_pred", "score", "bits_per_byte"))
    if not model.langs:
        return docs.filter(F.col("text").rlike(langid.LETTERS))
    found = langid.identify(docs, model, (lang, score, bits))
    foreign = F.coalesce(~F.col("lang").isin(model.langs), F.lit(False))
    return found.filter((F.col(lang) != langid.UNKNOWN) & ((F.col(bits) <= MOST_BITS) | foreign)).select(docs.columns)


@any_names
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts with a shingle similarity of 0.8 or more: that with the smallest doc_id (null last), the first
    written among equals. Rows are told apart by a key of their own, so texts that share a doc_id are no duplicates because of it, and
    rows without one take part. Texts without words belong to no group and all stay."""
    key, component = "_key", "_component"
    keyed = materialize(docs.select(F.monotonically_increasing_id().alias(key), F.struct(*docs.columns).alias("_row")), "keyed")
    found = neardup.near_duplicates(keyed.select(F.col(key).alias("doc_id"), F.col("_row.text").alias("text")), SIMILAR)
    found = found.select(F.col("doc_id").alias(key), F.col("component_id").alias(component))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(key))
    named = keyed.select(key, F.col("_row.doc_id").alias("doc_id")).join(found, key)
    first = named.groupBy(component).agg(F.min_by(key, order).alias(key)).select(key)
    return keyed.join(first, key, "left_semi").select("_row.*")


@any_names
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts [SECRET] in the place of every secret; n_chars follows. Null texts stay null; no row is dropped, repeated rows change alike."""
    return secrets.redact(docs, secrets.fit(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 4096: one row per piece. Null and empty texts are the end token alone; repeated rows and
    null doc_ids are packed each for itself."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]
#: Trained models, sketches and packing can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
