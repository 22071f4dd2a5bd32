"""The CSV scan in ranges: equal to the reader that takes a file in one task, whatever the ranges."""

import random
import re

import pytest

from sparkprep.sources import csv_scan
from sparkprep.sources.tables import read_table

NEVER = "\u0000never\u0000"


@pytest.fixture
def ranges(spark):
    """Set the size of a range; back to the default after the test."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}

    def size(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "0")
        spark.conf.set(names[2], "1")

    yield size
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def cell(rng):
    kind = rng.randrange(8)
    if kind == 0:
        return ""
    if kind == 1:
        return '""'
    text = "".join(rng.choice(['a', 'b', ' ', ',', '"', '\n', '\r\n', 'é', "'"]) for _ in range(rng.randrange(1, 25)))
    if kind in (2, 3, 4):
        return '"' + text.replace('"', '""') + '"'
    if kind == 5:                                # a quote that does not open a cell
        return "x" + re.sub(r'[,\n\r]', "", text)
    return re.sub(r'[,"\n\r]', "", text)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_the_reader_of_whole_files(spark, ranges, tmp_path, end):
    rng = random.Random(len(end))
    folder = tmp_path / "t.csv"
    folder.mkdir()
    for part in range(2):
        lines = [",".join([str(i), *(cell(rng) for _ in range(3))]) for i in range(60)]
        (folder / f"part-{part}.csv").write_bytes((end.join(["id,a,b,c", *lines]) + (end if part else "")).encode())
    want = rows_of(read_table(spark, str(folder), infer=False, ranges=False))
    assert len(want) == 120
    for size in (120, 1000, 1 << 20):
        ranges(size)
        got = read_table(spark, str(folder), infer=False)
        # the other reader makes a line feed of every record end, inside quotes too
        got = [tuple(v and v.replace(end, "\n") for v in r) for r in rows_of(got)]
        assert sorted(got, key=repr) == sorted((tuple(v and v.replace(end, "\n") for v in r) for r in want), key=repr), size
    ranges(120)
    assert csv_scan._lines(spark, str(folder)).rdd.getNumPartitions() > 20


def test_a_record_over_many_ranges_and_a_long_header(spark, ranges, tmp_path):
    path = tmp_path / "long.csv"
    body = "\n".join(f'line {i} of ""one"" cell' for i in range(200))
    path.write_text(f'id,"a\nlong\nheader, in three lines",c\n1,"{body}",x\n\n2,"y",z\n3,"{body}\n",w')
    for size in (40, 300, 1 << 20):
        ranges(size)
        df = read_table(spark, str(path), infer=False)
        assert df.columns == ["id", "a\nlong\nheader, in three lines", "c"]
        text = body.replace('""', '"')
        assert rows_of(df) == [("1", text, "x"), ("2", "y", "z"), ("3", text + "\n", "w")]


def test_states_of_lines():
    import pyarrow as pa
    lines = ['a,b', 'a,"b', 'c",d', 'a"b,c', '"a""', '""', '"",x', '"x"y,"z', 'q"']
    got = csv_scan._states(pa.array(lines), False).tolist()
    assert got == [False, True, False, False, True, True, True, True, False]


def test_files_without_rows(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n")
    assert read_table(spark, str(tmp_path / "h.csv")).count() == 0
    (tmp_path / "n.csv").write_text("a,b")
    df = read_table(spark, str(tmp_path / "n.csv"))
    assert df.columns == ["a", "b"] and df.count() == 0
    (tmp_path / "e.csv").write_text("")
    assert read_table(spark, str(tmp_path / "e.csv")).count() == 0


def test_a_quote_that_is_never_closed(spark, ranges, tmp_path):
    path = tmp_path / "open.csv"
    path.write_text('id,a\n1,x\n2,"open\nand on\n3,y\n')
    want = rows_of(read_table(spark, str(path), infer=False, ranges=False))
    for size in (8, 1 << 20):
        ranges(size)
        assert len(rows_of(read_table(spark, str(path), infer=False))) == len(want) == 2
