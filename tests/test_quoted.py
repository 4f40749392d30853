"""Files with line breaks in quoted cells, in many splits, against the reader that takes a file as one task."""

from __future__ import annotations

import csv
import random

import pytest

from tablemend.sources import quoted, tables


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write(path, seed, end="\n", rows=120):
    rng = random.Random(seed)
    cells = ["", "plain", 'say "so"', "two\nlines", "a\n\n\nb", '"', "é,ü", "x" * 900, "many\n" * 400, ",", " padded ", '\n"\n']
    table = [[str(i), rng.choice(cells) + rng.choice(cells), rng.choice(cells)] for i in range(rows)]
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(["id", "a b", "c"])
        out.writerows(table)
    return table


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_cells_with_line_breaks_in_many_splits(spark, tmp_path, small_splits, end):
    expected = write(tmp_path / "one.csv", 1, end) + write(tmp_path / "two.csv", 2, end, 15)
    df = tables.read_csv(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")], symbols=())
    assert df.columns == ["id", "a b", "c"]
    lines = quoted._lines(spark, [str(tmp_path / "one.csv")])
    assert lines.rdd.getNumPartitions() > 8
    got = [tuple(r[c] or "" for c in df.columns) for r in df.collect()]
    assert sorted(got) == sorted(map(tuple, expected))
    whole = tables.read_csv(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")], symbols=(), stray_quotes=True)
    assert sorted(map(str, df.collect())) == sorted(map(str, whole.collect()))


def test_a_record_over_many_splits_and_an_open_end(spark, tmp_path, small_splits):
    (tmp_path / "t.csv").write_text('k,t\n1,"' + "line\n" * 2000 + '"\n2,x\n\n3,"' + "open\n" * 500)
    rows = {r.k: r.t for r in tables.read_csv(spark, str(tmp_path / "t.csv"), symbols=()).collect()}
    assert rows["1"] == "line\n" * 2000 and rows["2"] == "x" and rows["3"].startswith("open\nopen") and len(rows) == 3


def test_schema_separator_header_only_and_stray_quotes(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k;v\n1;'two\nlines'\n2;\n")
    df = tables.read_csv(spark, str(tmp_path / "t.csv"), sep=";", quote="'", schema="k int, v string")
    assert sorted(map(tuple, df.collect())) == [(1, "two\nlines"), (2, None)]
    (tmp_path / "h.csv").write_text("k,v\n")
    empty = tables.read_csv(spark, str(tmp_path / "h.csv"))
    assert empty.columns == ["k", "v"] and empty.collect() == []
    (tmp_path / "s.csv").write_text('k,v\n1,5" pipe\n2,x\n')
    assert tables.read_csv(spark, str(tmp_path / "s.csv"), stray_quotes=True).count() == 2
