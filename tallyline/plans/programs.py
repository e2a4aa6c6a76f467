"""Programs over the tables: each is parsed, classified and lowered, and must give what its SQL gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lang import Program
from ..operators.ordered import placed
from ..sources.scratch import scratch
from ..sources.writers import write_lines
from .registry import Tables, on_tables


def _program(name: str, sql: str, source: str, table: str, order: str, **options: object) -> None:
    def run(t: Tables) -> DataFrame:
        return Program(source, **options).on(t.spark, getattr(t, table), order).lines

    on_tables(name, sql)(run)


_program("prg_c0_filter_project", "SELECT c_name || ' ' || c_mktsegment AS line FROM customer WHERE c_acctbal > 9000", "$c_acctbal > 9000 { print $c_name, $c_mktsegment }", "customer", "c_custkey")
_program("prg_c0_rules_and_next", "SELECT CASE WHEN p_size > 40 THEN 'big ' || p_partkey WHEN p_size % 7 = 0 THEN 'seven ' || p_name ELSE upper(substr(p_name, 1, 3)) || '-' || length(p_name) END AS line FROM part", '$p_size > 40 { print "big " $p_partkey; next } $p_size % 7 == 0 { print "seven", $p_name; next } { x = toupper(substr($p_name, 1, 3)); print x "-" length($p_name) }', "part", "p_partkey")
_program("prg_c0_fields_and_sub", "SELECT s_suppkey || ',' || regexp_replace(s_name, '0+', '#') || ',' || s_nationkey || ',' || rtrim(rtrim(printf('%.6f', s_acctbal), '0'), '.') AS line FROM supplier", '{ n = $s_name; sub(/0+/, "#", n); $2 = n; print }', "supplier", "s_suppkey", ofs=",")
_program("prg_c1_group", "SELECT l_returnflag || ' ' || CAST(sum(l_quantity) AS BIGINT) || ' ' || count(*) AS line FROM (SELECT *, row_number() OVER () FROM lineitem) GROUP BY l_returnflag", "{ s[$l_returnflag] += $l_quantity; n[$l_returnflag]++ } END { for (k in s) @sort print k, s[k], n[k] }", "lineitem", "l_orderkey")
_program("prg_c1_condition_and_total", "SELECT count(*) FILTER (WHERE value > 50) || ' ' || count(*) FILTER (WHERE event_type = 'error') || ' ' || count(*) AS line FROM events", '$value > 50 { high++ } $event_type == "error" { errors++ } END { print high + 0, errors + 0, NR }', "events", "event_id")
_program("prg_c1_percentages", "SELECT event_type || ': ' || printf('%.2f', round(count(*) / (SELECT count(*) FROM events) * 100, 9)) || '%' AS line FROM events GROUP BY event_type", '{ n[$event_type]++; t++ } END { for (k in n) printf "%s: %.2f%%\\n", k, n[k] / t * 100 }', "events", "event_id")
_program("prg_c1_concatenation", "SELECT n_regionkey || ' ' || string_agg(n_name, ',' ORDER BY n_nationkey) AS line FROM nation GROUP BY n_regionkey", '{ a[$n_regionkey] = a[$n_regionkey] (a[$n_regionkey] ? "," : "") $n_name } END { for (k in a) print k, a[k] }', "nation", "n_nationkey")
_program("prg_c1_largest", "SELECT o_orderkey || ' ' || o_orderstatus AS line FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1", "$o_totalprice > m { m = $o_totalprice; k = $o_orderkey; s = $o_orderstatus } END { print k, s }", "orders", "o_orderkey")
_program("prg_c2_distinct", "SELECT c_mktsegment || ' ' || c_nationkey AS line FROM customer GROUP BY ALL", "!seen[$c_mktsegment, $c_nationkey]++ { print $c_mktsegment, $c_nationkey }", "customer", "c_custkey")
_program("prg_c4_running_total", "SELECT event_id || ' ' || CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS BIGINT) AS line FROM events", '$event_type == "error" { n++ } { print $event_id, n + 0 }', "events", "event_id")
_program("prg_c4_previous", "SELECT event_id || ' ' || p AS line FROM (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY event_id) AS p FROM events) WHERE event_type = 'purchase' AND p IS NOT NULL", '$event_type == "purchase" && x != "" { print $event_id, x } { x = $event_type }', "events", "event_id")
_program("prg_c5_statistics", "SELECT printf('%.4f %.4f %.4f', avg(value), median(value), quantile_cont(value, 0.9)) AS line FROM events", '{ a[NR] = $value } END { printf "%.4f %.4f %.4f\\n", mean(a), median(a), p(a, 90) }', "events", "event_id")
_program("prg_c6_range", "WITH m AS (SELECT event_id, event_type = 'signup' AS s, event_type = 'purchase' AS e FROM events), f AS (SELECT *, last_value(CASE WHEN s THEN 1 WHEN e THEN 0 END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM m) SELECT CAST(event_id AS VARCHAR) AS line FROM f WHERE s OR b = 1", '$event_type == "signup", $event_type == "purchase" { print $event_id }', "events", "event_id")
_program("prg_c7_last", "SELECT CAST(event_id AS VARCHAR) AS line FROM events ORDER BY event_id DESC LIMIT 7", "last 7 { print $event_id }", "events", "event_id")
_program("prg_c8_machine", "SELECT CAST(max(n_nationkey * 10 + n_regionkey) AS VARCHAR) AS line FROM nation", 'function big(a, b) { if (a > b) return a; return b } { m = big(m, $n_nationkey * 10 + $n_regionkey) } END { print m }', "nation", "n_nationkey")
_program("prg_udf_inlined", "SELECT c_custkey || ' ' || (c_nationkey * 2 + 1) AS line FROM customer", "function odd(x) { return x * 2 + 1 } { print $c_custkey, odd($c_nationkey) }", "customer", "c_custkey")


def _text(t: Tables, name: str, line: F.Column, rows: DataFrame) -> str:
    path = scratch(t.spark, name)
    write_lines(rows.select(line.alias("line")), path)
    return path


@on_tables("prg_c3_lookup", "SELECT o_orderkey || ' ' || o_custkey || ' ' || c_mktsegment AS line FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t: Tables) -> DataFrame:
    one = _text(t, "customers", F.concat_ws(" ", "c_custkey", "c_mktsegment"), t.customer)
    two = _text(t, "orders", F.concat_ws(" ", "o_orderkey", "o_custkey"), t.orders)
    return Program("NR == FNR { a[$1] = $2; next } ($2 in a) { print $0, a[$2] }").run(t.spark, [one, two]).lines


@on_tables("prg_c3_anti", "SELECT CAST(c_custkey AS VARCHAR) AS line FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t: Tables) -> DataFrame:
    one = _text(t, "orders", F.col("o_custkey").cast("string"), t.orders)
    two = _text(t, "customers", F.col("c_custkey").cast("string"), t.customer)
    return Program("NR == FNR { s[$1] = 1; next } !($1 in s)").run(t.spark, [one, two]).lines


@on_tables("prg_fields_of_text", "SELECT n || ':' || last || ' ' || (a + b) AS line FROM (SELECT p_partkey AS a, p_size AS b, len(string_split(p_name, ' ')) + 2 AS n, list_extract(string_split(p_name, ' '), -1) AS last FROM part)")
def _(t: Tables) -> DataFrame:
    path = _text(t, "parts", F.concat_ws(" ", "p_partkey", "p_size", "p_name"), t.part)
    return Program('{ print NF ":" $NF, $1 + $2 }').run(t.spark, path).lines


@on_tables("prg_all_fields_counted", "SELECT count(*) || ' ' || w AS line FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY w")
def _(t: Tables) -> DataFrame:
    path = _text(t, "types", F.col("p_type"), t.part)
    return Program("{ for (i = 1; i <= NF; i++) a[$i]++ } END { for (k in a) print a[k], k }").run(t.spark, path).lines


@on_tables("prg_field_lookup", "WITH w AS (SELECT p_partkey, i, list_extract(string_split(p_type, ' '), i) AS w FROM (SELECT p_partkey, p_type, unnest(range(1, len(string_split(p_type, ' ')) + 1)) AS i FROM part)) SELECT p_partkey || ' ' || string_agg(CASE w WHEN 'BRASS' THEN 'alloy' WHEN 'STEEL' THEN 'iron' ELSE w END, ' ' ORDER BY i) AS line FROM w GROUP BY p_partkey")
def _(t: Tables) -> DataFrame:
    words = t.spark.createDataFrame([("BRASS alloy",), ("STEEL iron",)], "line string")
    one, two = _text(t, "metals", F.col("line"), words), _text(t, "types", F.concat_ws(" ", "p_partkey", "p_type"), t.part)
    return Program("NR == FNR { m[$1] = $2; next } { for (i = 1; i <= NF; i++) if ($i in m) $i = m[$i]; print }").run(t.spark, [one, two]).lines


@on_tables("prg_reversed", "SELECT row_number() OVER (ORDER BY o_orderkey DESC) || ' ' || o_orderkey AS line FROM orders")
def _(t: Tables) -> DataFrame:
    """The place of each line in the order of the output stands before it."""
    found = Program("{ a[NR] = $o_orderkey } END { for (i = NR; i >= 1; i--) print a[i] }").on(t.spark, t.orders, "o_orderkey")
    return placed(found.output, "nr", "place", name="_n").select(F.concat_ws(" ", "_n", "line").alias("line"))


_program("prg_running_distinct", "SELECT event_id || ' ' || CAST(sum(f) OVER (ORDER BY event_id) AS BIGINT) AS line FROM (SELECT event_id, CASE WHEN event_id = min(event_id) OVER (PARTITION BY user_id) THEN 1 ELSE 0 END AS f FROM events)", "{ u[$user_id] = 1; n = 0; for (k in u) n++; print $event_id, n }", "events", "event_id")
