"""Queries that read and write records: each writes a table in a format and reads it back, or streams it."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import readers, writers
from ..sources.scratch import scratch
from ..streaming import stream
from .registry import Tables, on_tables


def _lines(t: Tables, name: str, rows: DataFrame, **options: str) -> str:
    path = scratch(t.spark, name)
    rows.write.options(**options).text(path)
    return path


@on_tables("src_01_lines", "SELECT p_name AS value FROM part")
def _(t: Tables) -> DataFrame:
    return readers.lines(t.spark, _lines(t, "lines", t.part.select("p_name")))


@on_tables("src_02_regex_separator", "SELECT unnest(string_split(p_type, ' ')) AS value FROM part")
def _(t: Tables) -> DataFrame:
    path = _lines(t, "regex", t.part.select(F.regexp_replace("p_type", " ", ";;")))
    return readers.lines(t.spark, path, ";+|\n", regex=True)


@on_tables("src_03_single_character_separator", "SELECT p_brand AS value FROM part")
def _(t: Tables) -> DataFrame:
    return readers.lines(t.spark, _lines(t, "single", t.part.select("p_brand"), lineSep=";"), ";")


@on_tables("src_04_csv", "SELECT c_custkey, c_name || ', \"x\"' || chr(10) || c_mktsegment AS note, '' AS empty FROM customer")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "csv")
    note = F.concat("c_name", F.lit(', "x"\n'), "c_mktsegment")
    writers.write_delimited(t.customer.select("c_custkey", note.alias("note"), F.lit("").alias("empty")), path)
    return readers.csv(t.spark, path, schema="c_custkey long, note string, empty string")


@on_tables("src_05_tsv", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "tsv")
    writers.write_delimited(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), path, "\t")
    return readers.tsv(t.spark, path, schema="s_suppkey long, s_name string, s_acctbal double")


@on_tables("src_06_json_lines", "SELECT event_id, event_type, value FROM events")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "json")
    writers.write_json(t.events.select("event_id", "event_type", "value"), path)
    return readers.json_lines(t.spark, path, "event_id long, event_type string, value double")


@on_tables("src_06_json_positional", "SELECT CAST(event_id AS VARCHAR) AS f1, event_type AS f2 FROM events")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "json")
    writers.write_json(t.events.select("event_id", "event_type"), path)
    return readers.json_records(t.spark, path).select(F.get("fields", F.lit(0)).alias("f1"), F.get("fields", F.lit(1)).alias("f2"))


@on_tables("src_07_header", "SELECT n_name, n_regionkey FROM nation")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "header")
    writers.write_delimited(t.nation.repartition(3), path)
    return readers.csv(t.spark, path).select("n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@on_tables("src_08_parquet", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 49")
def _(t: Tables) -> DataFrame:
    return readers.parquet(t.spark, f"{t.folder}/lineitem.parquet").filter("l_quantity > 49").select("l_orderkey", "l_quantity")


@on_tables("src_09_compressed", "SELECT p_name AS value FROM part UNION ALL SELECT p_type FROM part")
def _(t: Tables) -> DataFrame:
    gz = _lines(t, "gz", t.part.select("p_name"), compression="gzip")
    bz = _lines(t, "bz2", t.part.select("p_type"), compression="bzip2")
    return readers.lines(t.spark, [gz, bz])


@on_tables("src_10_detection", "SELECT 'csv' AS a, 'json' AS b, 'parquet' AS c, 'text' AS d")
def _(t: Tables) -> DataFrame:
    names = ("x.csv.gz", "y.jsonl", "z.parquet", "log.zst")
    return t.spark.range(1).select(*[F.lit(readers.format_of(n)).alias(c) for n, c in zip(names, "abcd", strict=True)])


@on_tables("src_11_stdin", "SELECT 'a b' AS value UNION ALL SELECT '' UNION ALL SELECT 'c'")
def _(t: Tables) -> DataFrame:
    return readers.stdin(t.spark, "a b\r\n\nc\n")


@on_tables("src_12_files_numbered", "SELECT CAST(row_number() OVER (ORDER BY f, k) AS BIGINT) AS nr, CAST(row_number() OVER (PARTITION BY f ORDER BY k) AS BIGINT) AS fnr, value FROM (SELECT 1 AS f, n_nationkey AS k, n_name AS value FROM nation UNION ALL SELECT 2, r_regionkey, r_name FROM region)")
def _(t: Tables) -> DataFrame:
    one = _lines(t, "one", t.nation.orderBy("n_nationkey").select("n_name").coalesce(1))
    two = _lines(t, "two", t.region.orderBy("r_regionkey").select("r_name").coalesce(1))
    return readers.numbered(t.spark, [one, two], "text").select("nr", "fnr", "value")


@on_tables("src_13_getline_side_file", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t: Tables) -> DataFrame:
    side = readers.lines(t.spark, _lines(t, "side", t.region.select(F.concat_ws(" ", "r_regionkey", "r_name"))))
    pairs = side.select(F.substring_index("value", " ", 1).cast("int").alias("k"), F.regexp_replace("value", r"^\S+ ", "").alias("r_name"))
    return t.nation.join(pairs, F.col("n_regionkey") == F.col("k")).select("n_name", "r_name")


@on_tables("src_14_slurp", "SELECT string_agg(r_name, chr(10) ORDER BY r_regionkey) || chr(10) AS value FROM region")
def _(t: Tables) -> DataFrame:
    return readers.whole(t.spark, _lines(t, "slurp", t.region.orderBy("r_regionkey").select("r_name").coalesce(1)))


@on_tables("src_15_sequence", "SELECT unnest(range(1, 1001)) AS value UNION ALL SELECT unnest(range(5, 0, -1))")
def _(t: Tables) -> DataFrame:
    return readers.sequence(t.spark, 1, 1000).union(readers.sequence(t.spark, 5, 1))


@on_tables("src_16_generator", "SELECT 15 AS a, 'xx' AS b")
def _(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.lit(5 * 3).alias("a"), F.repeat(F.lit("x"), F.lit(2)).alias("b"))


@on_tables("src_17_environment")
def _(t: Tables) -> DataFrame:
    return readers.environment(t.spark, ["PATH"])


@on_tables("snk_01_print", "SELECT CAST(c_custkey AS VARCHAR) || ';' || c_name || ';' || c_nationkey AS line FROM customer")
def _(t: Tables) -> DataFrame:
    return writers.printed(t.customer, "c_custkey", "c_name", "c_nationkey", ofs=";")


@on_tables("snk_02_printf", "SELECT printf('%-20s %5d', c_name, c_nationkey) AS line FROM customer")
def _(t: Tables) -> DataFrame:
    from ..functions.printf import format_columns

    return t.customer.select(format_columns("%-20s %5d", F.col("c_name"), F.col("c_nationkey"), text=(True, False)).alias("line"))


@on_tables("snk_03_print_array", "SELECT n_regionkey, string_agg(n_name, chr(10) ORDER BY n_name) AS text FROM nation GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(writers.print_array(F.array_sort(F.collect_list("n_name"))).alias("text"))


@on_tables("snk_04_files_by_value", "SELECT event_type AS target, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "by-value")
    writers.write_by(t.events.select(F.col("event_id").cast("string").alias("line"), "event_type"), F.col("event_type"), path)
    return t.spark.read.text(path).groupBy("target").agg(F.count("*").alias("n"))


@on_tables("snk_04_append", "SELECT r_name AS value FROM region UNION ALL SELECT n_name FROM nation")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "append")
    writers.write_lines(t.region.select(F.col("r_name").alias("line")), path)
    writers.write_lines(t.nation.select(F.col("n_name").alias("line")), path, append=True)
    return readers.lines(t.spark, path)


@on_tables("snk_05_sorted_pipe", "SELECT s_name AS line FROM supplier ORDER BY s_name DESC")
def _(t: Tables) -> DataFrame:
    return writers.printed(t.supplier, "s_name").orderBy(F.desc("line"))


@on_tables("snk_09_output_separator", "SELECT r_regionkey || chr(9) || r_name AS line FROM region")
def _(t: Tables) -> DataFrame:
    return writers.printed(t.region, "r_regionkey", "r_name", ofs="\t")


# --- streams --------------------------------------------------------------------------------------------------------

_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(t: Tables, files_a_batch: int = 2) -> DataFrame:
    path = scratch(t.spark, "events")
    t.events.repartitionByRange(4, "event_id").write.parquet(path)
    return stream.tables(t.spark, path, _EVENTS, files_a_batch)


def _drained(t: Tables, out: DataFrame) -> DataFrame:
    return stream.drained_to(out, scratch(t.spark, "streamed"), scratch(t.spark, "stream"))


def _reported(t: Tables, out: DataFrame, *keys: str, mode: str = "update") -> DataFrame:
    return stream.reported(out, list(keys), scratch(t.spark, "reports"), scratch(t.spark, "stream"), mode)


@on_tables("stm_01_running_groups", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return _reported(t, stream.running_groups(_stream(t), "event_type", "value"), "event_type").withColumn("sum", F.round("sum", 4))


@on_tables("stm_02_tumbling", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS sum FROM events GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    rows = _stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    out = _reported(t, stream.tumbling(rows, "ts", "1 hour", "10000 days", "event_type", value="value"), "window", "event_type")
    return out.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", F.round("sum", 4).alias("sum"))


@on_tables("stm_03_distinct", "SELECT DISTINCT user_id FROM events")
def _(t: Tables) -> DataFrame:
    rows = _stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    return _drained(t, stream.distinct(rows, "ts", "10000 days", "user_id").select("user_id"))


@on_tables("stm_04_session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def _(t: Tables) -> DataFrame:
    rows = _stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    out = _reported(t, stream.sessions(rows, "ts", "2 hours", "10000 days", "user_id"), mode="complete")
    return out.select("user_id", F.unix_timestamp("session_window.start").alias("start"), "n")


@on_tables("stm_05_sliding_windows", "SELECT CAST(s AS BIGINT) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT value, unnest([floor(epoch(ts) / 1800) * 1800, floor(epoch(ts) / 1800) * 1800 - 1800]) AS s FROM events) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    rows = _stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    out = _reported(t, stream.sliding(rows, "ts", "1 hour", "30 minutes", "10000 days", value="value"), "window")
    return out.select(F.unix_timestamp("window.start").alias("start"), "n", F.round("mean", 6).alias("mean"))


@on_tables("stm_06_count_window", "SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def _(t: Tables) -> DataFrame:
    rows = _stream(t, 100)  # files of one moment have no order, so they come in one batch
    out = stream.count_window(rows.select("user_id", "event_id", "value"), "user_id", "event_id", "value", 3)
    return _drained(t, out).select("user_id", "event_id", F.round("mean", 6).alias("mean"))


@on_tables("stm_07_every", "SELECT event_id, value FROM events WHERE event_id % 100 = 0")
def _(t: Tables) -> DataFrame:
    return _drained(t, stream.every(_stream(t), 100, "event_id").select("event_id", "value"))


@on_tables("stm_08_tumbling_by_count", "SELECT CAST(floor(event_id / 50) AS BIGINT) AS line, count(*) AS n, round(sum(value), 4) AS sum FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    groups = _stream(t).withColumn("line", F.floor(F.col("event_id") / 50))
    return _reported(t, stream.running_groups(groups, "line", "value"), "line").select("line", "n", F.round("sum", 4).alias("sum"))
