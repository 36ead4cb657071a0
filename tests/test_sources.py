import pytest
from pyspark.sql import functions as F

from tidewrack.sources import grids, tables
from tidewrack.streaming import series as stream


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.csv").write_text("﻿Site; Value ;Note\nA;1,5;x\nB;NA;n.a.\nC;2,25;\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("Site,Value,More\nA,1.5,9\n")
    (tmp_path / "roles.csv").write_text("y1;x1;f1\nignored;;\nY;X;F\n")
    return tmp_path


def test_sniffing(spark, folder):
    lines = tables.peek(spark, str(folder / "a.csv"))
    assert tables.sniff_separator(lines) == ";" and tables.sniff_decimal(lines, ";") == ","
    assert tables.sniff_separator(["a,b", "1,2"]) == "," and tables.sniff_separator(["a\tb;c", "1\t2"]) == "\t"


def test_reading(spark, folder):
    df = tables.read_csv(spark, str(folder / "a.csv"), clean=True)
    assert df.columns == ["site", "value", "note"]
    assert [tuple(r) for r in df.collect()] == [("A", "1,5", "x"), ("B", None, None), ("C", "2,25", None)]
    typed = tables.read_typed(spark, str(folder / "b.csv"), ["Value", "More"])
    assert tuple(typed.first()) == ("A", 1.5, 9.0)
    both = tables.read_folder(spark, [str(folder / "b.csv"), str(folder / "b.csv")])
    assert both.count() == 2
    assert tables.roles(spark, str(folder / "roles.csv"), 2) == {"y1": "Y", "x1": "X", "f1": "F"}
    named = tables.with_source(tables.read_csv(spark, str(folder / "b.csv"))).select(*tables.parsed_name(F.col("file"), r"(\w)\.(\w+)", ["stem", "kind"]))
    assert tuple(named.first()) == ("b", "csv")


def test_writing(spark, folder, tmp_path):
    df = spark.createDataFrame([("Big Lake", 0.2, True), ("Sea", 0.9, False), ("Sea", 0.5, None)], "place string, share double, ok boolean")
    tables.write_split(df, "place", str(tmp_path / "split"))
    assert sorted(p.name for p in (tmp_path / "split").iterdir() if p.is_dir()) == ["part=big_lake", "part=sea"]
    tables.write_kept_and_rejected(df, "ok", str(tmp_path / "kept"), str(tmp_path / "rejected"))
    assert tables.read_csv(spark, str(tmp_path / "kept")).count() == 1 and tables.read_csv(spark, str(tmp_path / "rejected")).count() == 2
    assert tables.by_threshold(df, "share", [0.5, 1.0]).groupBy("threshold").count().orderBy("threshold").collect() == [(0.5, 2), (1.0, 3)]


def test_config(spark):
    df = spark.createDataFrame([("filter", "active", "1"), ("filter", "share", "0.9"), ("map", "active", "0")], "action string, parameter string, value string")
    assert tables.parameters(df) == {"filter": {"active": "1", "share": "0.9"}, "map": {"active": "0"}}
    manifest = spark.createDataFrame([("zip", "p", "u"), ("zip", "q", "v"), ("http", "r", "w")], "kind string, product string, url string")
    assert tables.routed(manifest, "kind", ["product", "url"]) == {"zip": ["p||u", "q||v"], "http": ["r||w"]}


def test_grids(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 50\ncellsize 2\nNODATA_value -9999\n1 2 3\n4 -9999 6\n")
    got = {(r["row"], r["col"]): (r["x"], r["y"], r["value"]) for r in grids.read_grids(spark, str(tmp_path / "*.asc")).collect()}
    assert got[0, 0] == (11.0, 53.0, 1.0) and got[1, 1] == (13.0, 51.0, None) and len(got) == 6
    lines = grids.grid_lines(grids.read_grids(spark, str(tmp_path / "*.asc")), ["file"]).orderBy("row").collect()
    assert [r["line"] for r in lines] == ["1.0 2.0 3.0", "4.0 -9999.0 6.0"]


def test_streamed_rows_in_parquet(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 01:00:00", 9.0), ("a", "2024-01-01 01:00:00", 9.5)], "k string, t string, v double").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    stream.run_to_parquet(stream.first_of_duplicates(source, ["k", "t"], "t", "1 day"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
