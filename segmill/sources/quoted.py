"""Records of delimited text whose quoted cells hold line ends, read by many tasks.

A file is read line by line in byte ranges. What a line does to the quoting is a function of the state before it: a line is told apart by
whether it ends inside of a quoted cell if it begins outside of one, and if it begins inside of one. A first pass composes these functions
for each range, for both states at once, since no task knows the state its range begins in. The driver, which gets one row per range, then
knows all of them, and a second pass puts lines together to records. A record that goes on in the next ranges travels in pieces, one from
each range, which meet by the range that it began in; all others stay in their task.

Lines end with a line feed, perhaps after a carriage return. A quote opens a cell only at the cell's beginning, after blanks; doubled quotes
inside of a quoted cell are one quote.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A record's number in its range has so many bits.
PLACE_BITS = 40


def endings(delimiter: str) -> tuple[str, str]:
    """Patterns of lines that end inside of a quoted cell: of those that begin outside of one, and inside."""
    d = re.escape(delimiter)
    inner = r'[^"]*+(?:""[^"]*+)*+'
    blanks = r"[ \t]*+" if delimiter != "\t" else " *+"
    cells = rf'(?:{blanks}(?:"{inner}"[^{d}]*+|(?!")[^{d}]*+){d})*+'
    tail = rf'{cells}{blanks}"{inner}$'
    return f"^\ufeff?{tail}", rf'^{inner}(?:"[^{d}]*+{d}{tail}|$)'


def lines(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """file, begin (of the byte range), bytes, quote (whether the line has any), out, inside: whether it ends inside of a quoted cell if it begins
    outside or inside of one. In the order of the lines within each range."""
    raw = spark.read.option("lineSep", "\n").text(path)
    out, inside = endings(delimiter)
    quote = F.contains("value", F.lit('"'))
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.col("value").cast("binary").alias("bytes"), quote.alias("quote"),
        F.when(quote, F.col("value").rlike(out)).otherwise(False).alias("out"), F.when(quote, F.col("value").rlike(inside)).otherwise(True).alias("inside"), "value",
    )


def opens(table: DataFrame) -> Column:
    """Whether any quoted cell holds a line end: as long as no line that begins outside of a cell ends inside of one, all begin outside."""
    return F.bool_or("out")


@dataclass
class Range:
    """What is known about one byte range: the state it begins in, its place among all, and the range that the record it begins inside of began in."""

    inside: bool
    place: int
    origin: int


def _ranges(columns: list[pa.Array]) -> Iterator[tuple[tuple[str, int], slice]]:
    """The ranges of a batch and where each lies in it."""
    files, begins = columns[0].to_pylist(), columns[1].to_pylist()
    at = 0
    for i in range(1, len(files) + 1):
        if i == len(files) or (files[i], begins[i]) != (files[at], begins[at]):
            yield (files[at], begins[at]), slice(at, i)
            at = i


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, begin, out, inside (the range's end for both beginnings), shut: whether a range that begins inside has a line that ends outside."""
    found: dict[tuple[str, int], list[bool]] = {}
    for batch in batches:
        out, inside = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        for key, at in _ranges(batch.columns[:2]):
            state = found.setdefault(key, [False, True, False])
            for o, i in zip(out[at].tolist(), inside[at].tolist()):
                state[0], state[1] = (i if state[0] else o), (i if state[1] else o)
                state[2] |= not state[1]
    keys = list(found)
    rows = [[k[0] for k in keys], [k[1] for k in keys], *[[found[k][j] for k in keys] for j in range(3)]]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
    yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], ["file", "begin", "out", "inside", "shut"])


def plan_ranges(table: DataFrame) -> dict[tuple[str, int], Range]:
    """The state of each range. Lines without quotes change nothing, so they don't take part."""
    every = table.select("file", "begin").distinct()
    ends = table.filter("quote").select("file", "begin", "out", "inside").mapInArrow(_compose, "file string, begin long, out boolean, inside boolean, shut boolean")
    rows = every.join(ends, ["file", "begin"], "left").orderBy("file", "begin").collect()  # one row per range
    plan: dict[tuple[str, int], Range] = {}
    file, inside, origin = None, False, -1
    for place, r in enumerate(rows):
        if r["file"] != file:
            if inside:
                raise ValueError(f"{file}: a quoted cell never ends")
            file, inside, origin = r["file"], False, -1
        plan[r["file"], r["begin"]] = Range(inside, place, origin)
        whole = r["out"] is None
        ends_inside = inside if whole else r["inside"] if inside else r["out"]
        # The open record began here unless the whole range lies inside of an earlier one.
        if not inside or (not whole and r["shut"]):
            origin = place
        inside = ends_inside
    if inside:
        raise ValueError(f"{file}: a quoted cell never ends")
    return plan


RECORDS = "place long, piece long, origin long, bytes binary"


def _join(plan: dict[tuple[str, int], Range]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """place orders records; piece is null for whole records, else the range's place; origin is the place of the range a piece belongs to."""
        key, now, number, inside, held = None, None, 0, False, []
        rows: list[tuple] = []

        def leave() -> None:
            """The range ends: what is still open is the first piece of its record, or a middle one."""
            if held:
                first = inside_origin if inside_origin >= 0 else now.place
                rows.append(((now.place << PLACE_BITS) + number, now.place, first, b"\n".join(held)))
                held.clear()

        inside_origin = -1
        for batch in batches:
            out, stay = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            texts = batch.column(4)
            for k, at in _ranges(batch.columns[:2]):
                if k != key:
                    if now is not None:
                        leave()
                    key, now, number = k, plan[k], 0
                    inside, inside_origin = now.inside, now.origin if now.inside else -1
                for i in range(at.start, at.stop):
                    ends_inside = bool(stay[i] if inside else out[i])
                    if not inside and not ends_inside:
                        rows.append(((now.place << PLACE_BITS) + number, None, None, texts[i].as_py()))
                        number += 1
                    else:
                        held.append(texts[i].as_py())
                        if not ends_inside:
                            if inside_origin >= 0:
                                rows.append(((now.place << PLACE_BITS) + number, now.place, inside_origin, b"\n".join(held)))
                                inside_origin = -1
                            else:
                                rows.append(((now.place << PLACE_BITS) + number, None, None, b"\n".join(held)))
                            held.clear()
                            number += 1
                    inside = ends_inside
            if rows:
                yield _batch(rows)
                rows = []
        if now is not None:
            leave()
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["place", "piece", "origin", "bytes"])


def records(table: DataFrame, plan: dict[tuple[str, int], Range]) -> DataFrame:
    """place (orders records of a file, files by name), first (whether it is its file's first), bytes."""
    parts = table.select("file", "begin", "out", "inside", "bytes").mapInArrow(_join(plan), RECORDS)
    whole = parts.filter("piece IS NULL").select("place", "bytes")
    pieces = F.array_sort(F.collect_list(F.struct("piece", "place", "bytes")))  # one piece from each range
    text = F.array_join(F.transform("p", lambda x: F.hex(x["bytes"])), "0A")
    stitched = parts.filter("piece IS NOT NULL").groupBy("origin").agg(pieces.alias("p")).select(F.col("p")[0]["place"].alias("place"), F.unhex(text).alias("bytes"))
    firsts = [r.place << PLACE_BITS for (_, begin), r in plan.items() if begin == 0]
    return whole.unionByName(stitched).select("place", F.col("place").isin(firsts).alias("first"), "bytes")
