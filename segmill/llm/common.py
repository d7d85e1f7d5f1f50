"""What several operators of this subpackage share: scratch tables, the language-neutral word encoder, batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ..scratch import Scratch, materialize, scratch_dir  # noqa: F401

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(table: DataFrame) -> int:
    """Tasks to deal a table's rows to: as many as shuffles have, more if its files are read in more pieces than that."""
    return max(shuffle_partitions(table.sparkSession), table.rdd.getNumPartitions())


def slices(texts: list, size: Callable = len, most: int = 4_000_000, rows: int = 2_000) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of ``texts`` that hold about ``most`` characters, so that arrays over a run stay small; whole texts only."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        n = size(t) if t is not None else 0
        if i > begin and (total + n > most or i - begin >= rows):
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)


def unique_columns(df: DataFrame, keep: Iterable[str]) -> DataFrame:
    """Only the named columns, whatever else the table carries (extra columns with clashing names do no harm)."""
    return df.select(*[df[c] for c in keep])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or that with underscores before it until no column of ``df`` has it."""
    while name in df.columns:
        name = f"_{name}"
    return name
