"""Files whose quoted cells hold line ends, in ranges of a few bytes, against the csv module."""

import csv
import io
import re

import numpy as np
import pytest

from segmill.sources import files, quoted


def made(seed, rows=120, columns=4, end="\n", delimiter=","):
    rng = np.random.default_rng(seed)
    pieces = ["x", "two words", 'say "so"', "a\nb", "\n", ",", ";", '"', "", "é漢", "1,5", 'q"\n"', "long " * 9, "5\" pipe", "tail "]
    cell = lambda: "".join(rng.choice(pieces, rng.integers(1, 4)))
    table = [[f"n{i}" for i in range(columns)], *[["r%d" % k, *[cell() for _ in range(columns - 1)]] for k in range(rows)]]
    out = io.StringIO()
    csv.writer(out, lineterminator=end, delimiter=delimiter).writerows(table)
    return out.getvalue(), table


def read(spark, path):
    df = files.load_raw_file(spark, str(path))
    rows = [tuple(r)[:-1] for r in df.orderBy(files.ROW).collect()]
    return df, rows


def plain(table):
    clean = lambda v: None if v.lstrip(" ") in files.MISSING or v in files.MISSING else v
    return [tuple(map(clean, r)) for r in table[1:]]


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}

    def set_to(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield set_to
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
@pytest.mark.parametrize("delimiter", [",", "|"])
def test_quoted_line_ends_in_many_ranges(spark, tmp_path, small_ranges, size, delimiter):
    text, table = made(size, 12 if size < 20 else 50, delimiter=delimiter)
    (tmp_path / "a.csv").write_text(text)
    small_ranges(size)
    df, rows = read(spark, tmp_path / "a.csv")
    assert rows == plain(table)
    if size == 64:
        assert quoted.lines(spark, str(tmp_path / "a.csv"), delimiter).rdd.getNumPartitions() > 20


def test_a_quote_inside_of_a_plain_cell_opens_nothing(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text('a,b\n5" pipe,1\n"two\nlines",2\n6" pipe,"x"\n 7,  "y\nz"\n')
    small_ranges(5)
    assert read(spark, tmp_path / "a.csv")[1] == [('5" pipe', "1"), ("two\nlines", "2"), ('6" pipe', "x"), ("7", "y\nz")]
    (tmp_path / "b.csv").write_text('a,b\n5" pipe,1\n6" pipe,2\n')
    assert files.text_facts(spark, str(tmp_path / "b.csv")) == ("UTF-8", False)
    assert read(spark, tmp_path / "b.csv")[1] == [('5" pipe', "1"), ('6" pipe', "2")]


def test_several_files_and_carriage_returns(spark, tmp_path, small_ranges):
    folder = tmp_path / "in.csv"
    folder.mkdir()
    want = []
    for k in range(3):
        text, table = made(k, 40, end="\r\n")
        (folder / f"{k}.csv").write_bytes(text.encode("utf-8-sig" if k == 1 else "utf-8"))
        want += plain(table)
    small_ranges(200)
    assert read(spark, folder)[1] == want


def test_latin_1_with_line_ends(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_bytes('a,b\n"caf\xe9\nau lait",1\n\xfc,2\n'.encode("latin-1"))
    small_ranges(6)
    assert read(spark, tmp_path / "a.csv")[1] == [("café\nau lait", "1"), ("ü", "2")]


def test_cells_that_never_end_and_rows_too_long(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"x\ny",1\n"open,2\n3,4\n')
    with pytest.raises(ValueError, match="never ends"):
        files.load_raw_file(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text('a,b\n"x\ny",1\n1,2,3\n')
    with pytest.raises(ValueError, match="more cells"):
        files.load_raw_file(spark, str(tmp_path / "b.csv"))


def test_endings_of_lines():
    out, inside = (re.compile(p) for p in quoted.endings(","))
    for line, o, i in (('a,b', False, True), ('a,"b', True, False), ('a",b', False, False), ('a","b', True, True), ('"a""', True, False), ('"a"",b",c', False, False), (' "a', True, False), ('x",y', False, False), ('x"', False, False), ('x""', False, True), ("", False, True)):
        assert (bool(out.search(line)), bool(inside.search(line))) == (o, i), line
