"""Readers and writers on small files, malformed ones too."""

import bz2
import gzip
import io
import lzma
import tarfile

import pyarrow as pa
from pyspark.sql import functions as F

from tallyline.sources import readers, writers


def values(df):
    return [r["value"] for r in df.collect()]


def test_lines_and_separators(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"one\r\ntwo\n\nlast")
    assert values(readers.lines(spark, str(tmp_path / "a"))) == ["one", "two", "", "last"]
    (tmp_path / "b").write_text("x1y22z\n")
    assert values(readers.lines(spark, str(tmp_path / "b"), "[0-9]+", regex=True)) == ["x", "y", "z"]
    (tmp_path / "c").write_text("a||b||c")
    assert values(readers.lines(spark, str(tmp_path / "c"), "||")) == ["a", "b", "c"]
    (tmp_path / "d").write_text("a;b;c\n")
    assert values(readers.lines(spark, str(tmp_path / "d"), ";"))[:2] == ["a", "b"]


def test_csv_edges(spark, tmp_path):
    (tmp_path / "e.csv").write_text('id,name,comment\n1,"Smith, J","said ""hi"""\n2," padded ",\n3,é,"two\nlines"\n4,=1+1,NULL\n', encoding="utf-8")
    rows = readers.csv(spark, str(tmp_path / "e.csv")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "Smith, J", 'said "hi"'), ("2", " padded ", ""), ("3", "é", "two\nlines"), ("4", "=1+1", "NULL")]
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx y\n")
    assert tuple(readers.tsv(spark, str(tmp_path / "t.tsv")).first()) == ("1", "x y")


def test_compression(spark, tmp_path):
    data = b"one\ntwo\n"
    (tmp_path / "a.gz").write_bytes(gzip.compress(data))
    (tmp_path / "a.bz2").write_bytes(bz2.compress(data))
    (tmp_path / "a.xz").write_bytes(lzma.compress(data))
    with pa.output_stream(str(tmp_path / "a.lz4"), compression="lz4") as out:
        out.write(data)
    with tarfile.open(tmp_path / "a.tgz", "w:gz") as tar:
        for name, part in (("x", b"one\r\n"), ("y", b"two")):
            info = tarfile.TarInfo(name)
            info.size = len(part)
            tar.addfile(info, io.BytesIO(part))
    for name in ("a.gz", "a.bz2", "a.xz", "a.lz4", "a.tgz"):
        assert sorted(values(readers.lines(spark, str(tmp_path / name)))) == ["one", "two"], name


def test_numbering_over_files_and_splits(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}").write_text("".join(f"{k}-{i}\n" for i in range(50)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        rows = readers.numbered(spark, [str(tmp_path / f"f{k}") for k in (2, 0, 1)], "text").orderBy("nr").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["value"] for r in rows] == [f"{k}-{i}" for k in (2, 0, 1) for i in range(50)]
    assert [r["nr"] for r in rows] == list(range(1, 151))
    assert [r["fnr"] for r in rows] == list(range(1, 51)) * 3


def test_json(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"name":"a","n":1,"o":{"x":[1]}}\nnot json\n{"name":"b\\n","n":2.5}\n')
    rows = readers.json_records(spark, str(tmp_path / "j.jsonl")).collect()
    assert [r["fields"] for r in rows] == [["a", "1", '{"x":[1]}'], ["not json"], ["b\n", "2.5"]]
    assert readers.json_lines(spark, str(tmp_path / "j.jsonl"), "name string, n double").filter("name is not null").count() == 2


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, None, "x"), (2, 0.125, "b", "y")], "a int, b double, c string, t string")
    lines = writers.printed(df, "a", "b", "c", ofs="|")
    assert sorted(r["line"] for r in lines.collect()) == ["1|2|", "2|0.125|b"]
    assert sorted(r["line"] for r in writers.printed(df, "b", fmt="%.1f").collect()) == ["0.1", "2.0"]
    writers.write_by(lines.withColumn("t", F.left("line", F.lit(1))), F.col("t"), str(tmp_path / "by"))
    assert {p.name for p in (tmp_path / "by").iterdir() if p.is_dir()} == {"target=1", "target=2"}
    writers.write_lines(lines, str(tmp_path / "l"))
    writers.write_lines(lines, str(tmp_path / "l"), append=True)
    assert spark.read.text(str(tmp_path / "l")).count() == 4
    writers.write_parquet(df, str(tmp_path / "p"))
    assert readers.read(spark, str(tmp_path / "p"), "parquet").count() == 2


def test_small_sources(spark):
    assert values(readers.sequence(spark, 3, 1)) == [3, 2, 1]
    assert values(readers.stdin(spark, "a\r\n\nb")) == ["a", "", "b"]
    assert readers.environment(spark, ["PATH"]).count() == 1
    assert [readers.format_of(n) for n in ("a.csv", "b.TSV.gz", "c.jsonl.zst", "d", "e.parquet")] == ["csv", "tsv", "json", "text", "parquet"]
    split = readers.split_fields(spark.createDataFrame([("a:b:c",)], "value string"), ":", most=1).first()["fields"]
    assert split == ["a", "b:c"]
