"""Queries for projection, selection, joins, aggregation, windows, sorting, sampling and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coerce
from ..operators import aggregate, joins, select, sets
from ..operators.ordered import Ordered, placed
from .registry import Tables, on_tables

ordered = Ordered


# --- projection -----------------------------------------------------------------------------------------------------


@on_tables("prj_01_field_projection", "SELECT p_name, p_partkey FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_name", "p_partkey")


@on_tables("prj_02_named_projection", "SELECT c_name AS \"user-name\", c_mktsegment FROM customer")
def _(t: Tables) -> DataFrame:
    return t.customer.withColumnRenamed("c_name", "user-name").select(F.col("`user-name`"), "c_mktsegment")


@on_tables("prj_03_negative_index", "SELECT p_partkey, list_extract(string_split(p_name, ' '), -1) AS last_field, list_extract(string_split(p_type, ' '), 1) AS first_field FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.element_at(F.split("p_name", " "), -1).alias("last_field"), F.element_at(F.split("p_type", " "), 1).alias("first_field"))


@on_tables("prj_04_computed", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem")
def _(t: Tables) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", net.alias("net"), (net * (1 + F.col("l_tax"))).alias("gross"))


@on_tables("prj_05_field_assignment", "SELECT c_custkey, concat_ws(',', CAST(c_custkey AS VARCHAR), '', c_mktsegment) AS line FROM customer")
def _(t: Tables) -> DataFrame:
    fields = F.array(F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    assigned = F.transform(fields, lambda f, i: F.when(i == 1, "").otherwise(f))
    return t.customer.select("c_custkey", F.array_join(assigned, ",").alias("line"))


@on_tables("prj_06_flip", "SELECT p_partkey, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS flipped FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(F.reverse(F.split("p_name", " ")), " ").alias("flipped"))


@on_tables("prj_07_default_action", "SELECT * FROM nation")
def _(t: Tables) -> DataFrame:
    return t.nation


# --- selection ------------------------------------------------------------------------------------------------------


@on_tables("flt_01_regex", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_type, '(?:BRASS|STEEL)$') OR regexp_matches(p_name, 'a.*e')")
def _(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_type").rlike("(?:BRASS|STEEL)$") | F.col("p_name").rlike("a.*e")).select("p_partkey", "p_name")


@on_tables("flt_02_negated_and_dynamic", "SELECT event_id, event_type FROM events WHERE NOT regexp_matches(event_type, '^p') AND regexp_matches(props, left(event_type, 1) || '|[0-4]')")
def _(t: Tables) -> DataFrame:
    dynamic = F.regexp_like("props", F.concat(F.left("event_type", F.lit(1)), F.lit("|[0-4]")))
    return t.events.filter(~F.col("event_type").rlike("^p") & dynamic).select("event_id", "event_type")


@on_tables("flt_03_truthiness", "SELECT event_id, CAST(value AS VARCHAR) <> '' AND value <> 0 AS t FROM events WHERE value <> 0")
def _(t: Tables) -> DataFrame:
    return t.events.filter(coerce.truthy(F.col("value"), numeric=True)).select("event_id", coerce.truthy(F.col("value").cast("string")).alias("t"))


@on_tables("flt_04_compare_and_ternary", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 AND (l_discount < 0.05 OR NOT l_returnflag = 'N') THEN 'big' ELSE 'small' END AS size FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01'")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.filter(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    big = (F.col("l_quantity") > 25) & ((F.col("l_discount") < 0.05) | ~(F.col("l_returnflag") == "N"))
    return rows.select("l_orderkey", "l_linenumber", F.when(big, "big").otherwise("small").alias("size"))


@on_tables("flt_05_compound_regex", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, 'AN') AND regexp_matches(p_brand, '[13]$')")
def _(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_type").rlike("AN") & F.col("p_brand").rlike("[13]$")).select("p_partkey")


_RANGE = """
WITH m AS (SELECT event_id, {start} AS s, {end} AS e FROM events),
f AS (SELECT event_id, s, CASE WHEN s AND NOT e THEN 1 WHEN {reset} THEN 0 END AS f, {toggle} AS t FROM m),
c AS (SELECT *, sum(t) OVER (ORDER BY event_id) AS n FROM f),
b AS (SELECT event_id, s,
  last_value(CASE WHEN f IS NOT NULL THEN f END IGNORE NULLS) OVER w AS lf,
  last_value(CASE WHEN f IS NOT NULL THEN n END IGNORE NULLS) OVER w AS ln,
  coalesce(sum(t) OVER w, 0) AS sofar
  FROM c WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id FROM b WHERE s OR (coalesce(lf, 0) + sofar - coalesce(ln, 0)) % 2 = 1
"""


@on_tables("flt_06_range", _RANGE.format(start="event_type IN ('signup', 'error')", end="event_type IN ('purchase', 'error')", reset="e AND NOT s", toggle="CASE WHEN s AND e THEN 1 ELSE 0 END"))
def _(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return ordered(t.events, "event_id").between(kind.isin("signup", "error"), kind.isin("purchase", "error")).select("event_id")


@on_tables("flt_06_range_posix", _RANGE.format(start="event_type IN ('signup', 'error')", end="event_type IN ('purchase', 'error')", reset="e", toggle="0"))
def _(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return ordered(t.events, "event_id").between(kind.isin("signup", "error"), kind.isin("purchase", "error"), posix=True).select("event_id")


@on_tables("flt_07_every", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS nr FROM events) WHERE nr % 10 = 0")
def _(t: Tables) -> DataFrame:
    return select.every(ordered(t.events, "event_id").numbered(), 10).select("event_id")


@on_tables("flt_08_last", "SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 25")
def _(t: Tables) -> DataFrame:
    return select.last(t.events, 25, "event_id").select("event_id", "user_id")


@on_tables("flt_09_next_guards", "SELECT event_id, CASE WHEN value > 80 THEN 'high' WHEN event_type = 'click' THEN 'click' ELSE 'rest' END AS label FROM events")
def _(t: Tables) -> DataFrame:
    rules = [(F.col("value") > 80, [F.lit("high")], True), (F.col("event_type") == "click", [F.lit("click")], True), (F.lit(True), [F.lit("rest")], False)]
    return select.guarded(t.events.select("event_id", "value", "event_type"), rules).select("event_id", F.col("c0").alias("label"))


@on_tables("flt_10_nextfile", "WITH s AS (SELECT l_suppkey, min(l_linenumber) AS stop FROM lineitem WHERE l_quantity > 45 GROUP BY 1) SELECT l.l_suppkey, l_orderkey, l_linenumber FROM lineitem l LEFT JOIN s USING (l_suppkey) WHERE stop IS NULL OR l_linenumber <= stop")
def _(t: Tables) -> DataFrame:
    return select.rest_skipped(t.lineitem, F.col("l_quantity") > 45, "l_suppkey", "l_linenumber").select("l_suppkey", "l_orderkey", "l_linenumber")


@on_tables("flt_11_exit", "SELECT event_id FROM events WHERE event_id <= (SELECT min(event_id) FROM events WHERE value > 99)")
def _(t: Tables) -> DataFrame:
    return select.until(t.events, F.col("value") > 99, "event_id").select("event_id")


@on_tables("flt_12_consecutive_duplicates", "SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (ORDER BY event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def _(t: Tables) -> DataFrame:
    return ordered(t.events, "event_id").lag(F.col("event_type"), "p").filter(~F.col("p").eqNullSafe(F.col("event_type"))).select("event_id", "event_type")


@on_tables("flt_13_line_before_and_after", "SELECT event_id, b, a FROM (SELECT event_id, event_type, coalesce(lag(user_id) OVER (ORDER BY event_id), -1) AS b, coalesce(lead(user_id) OVER (ORDER BY event_id), -1) AS a FROM events) WHERE event_type = 'error'")
def _(t: Tables) -> DataFrame:
    before = ordered(t.events, "event_id").lag(F.col("user_id"), "b")
    return ordered(before, "event_id").lead(F.col("user_id"), "a").filter("event_type = 'error'").select("event_id", F.coalesce("b", F.lit(-1)).alias("b"), F.coalesce("a", F.lit(-1)).alias("a"))


# --- joins ----------------------------------------------------------------------------------------------------------


def _status(t: Tables) -> DataFrame:
    """Each customer's last order's status; not every customer has ordered."""
    return joins.array_of(t.orders, "o_custkey", "o_orderstatus", "o_orderkey")


_STATUS = "(SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1)"


@on_tables("jon_01_inner_lookup", f"SELECT c_custkey, status FROM customer JOIN {_STATUS} ON o_custkey = c_custkey")
def _(t: Tables) -> DataFrame:
    return joins.lookup(t.customer, "c_custkey", _status(t), "status").select("c_custkey", "status")


@on_tables("jon_02_left_default", f"SELECT c_custkey, coalesce(status, 'N/A') AS status FROM customer LEFT JOIN {_STATUS} ON o_custkey = c_custkey")
def _(t: Tables) -> DataFrame:
    return joins.lookup_or(t.customer, "c_custkey", _status(t), "status", F.lit("N/A")).select("c_custkey", "status")


@on_tables("jon_03_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(t: Tables) -> DataFrame:
    return joins.semi(t.customer, "c_custkey", _status(t)).select("c_custkey")


@on_tables("jon_04_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t: Tables) -> DataFrame:
    return joins.anti(t.customer, "c_custkey", t.orders.select(F.col("o_custkey").alias("_key"))).select("c_custkey")


@on_tables("jon_05_full_outer", "WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) SELECT coalesce(a.k, b.k) AS key, coalesce(a.n, 0) AS left_value, coalesce(b.n, 0) AS right_value FROM a FULL JOIN b ON a.k = b.k")
def _(t: Tables) -> DataFrame:
    counts = lambda rows, k: rows.groupBy(F.col(k).alias("_key")).agg(F.count("*").alias("_value"))
    return joins.full(counts(t.customer, "c_nationkey"), counts(t.supplier, "s_nationkey")).na.fill(0, ["left_value", "right_value"])


@on_tables("jon_06_update", "SELECT p_partkey, coalesce(b, p_brand) AS p_brand FROM part LEFT JOIN (SELECT l_partkey, 'sold' AS b FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def _(t: Tables) -> DataFrame:
    sold = t.lineitem.select(F.col("l_partkey").alias("_key"), F.lit("sold").alias("_value")).distinct()
    return joins.updated(t.part, "p_partkey", "p_brand", sold).select("p_partkey", "p_brand")


@on_tables("jon_07_dictionary", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE l_returnflag END AS l_returnflag, CASE l_linestatus WHEN 'F' THEN 'final' ELSE l_linestatus END AS l_linestatus FROM lineitem")
def _(t: Tables) -> DataFrame:
    words = {"A": "accepted", "R": "returned", "F": "final"}
    return joins.translated(t.lineitem, ["l_returnflag", "l_linestatus"], words).select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")


@on_tables("jon_08_theta_difference", "SELECT s_suppkey, c_nationkey AS other FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE s_nationkey <> c_nationkey")
def _(t: Tables) -> DataFrame:
    array = joins.array_of(t.customer, "c_custkey", "c_nationkey", "c_custkey")
    return joins.differing(t.supplier, "s_suppkey", "s_nationkey", array, "other").select("s_suppkey", "other")


@on_tables("jon_09_blocklist", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 95)")
def _(t: Tables) -> DataFrame:
    blocked = t.events.filter("event_type = 'error' and value > 95").select(F.col("user_id").alias("_key"))
    return joins.anti(t.events, "user_id", blocked).select("event_id")


@on_tables("jon_10_self_join_by_group", "SELECT a.user_id, a.event_id AS first_id, b.event_id AS next_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) a JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) b ON a.user_id = b.user_id AND b.n = a.n + 1")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    following = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return t.events.select("user_id", F.col("event_id").alias("first_id"), following.alias("next_id")).filter("next_id is not null")


# --- aggregation ----------------------------------------------------------------------------------------------------


@on_tables("agg_01_count", "SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(event_type, '^c')) AS c FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.agg(F.count("*").alias("n"), F.count_if(F.col("event_type").rlike("^c")).alias("c"))


@on_tables("agg_02_sum_mean", "SELECT round(sum(l_quantity), 2) AS s, round(avg(l_extendedprice), 4) AS m FROM lineitem")
def _(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.round(F.sum("l_quantity"), 2).alias("s"), F.round(F.avg("l_extendedprice"), 4).alias("m"))


@on_tables("agg_03_group_count", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return aggregate.frequency(t.lineitem, "l_suppkey")


@on_tables("agg_04_group_sum_mean", "SELECT l_returnflag, round(sum(l_quantity), 2) AS s, count(*) AS n, round(sum(l_quantity) / count(*), 6) AS m FROM lineitem GROUP BY 1")
def flagship(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("s"), F.count("*").alias("n"), F.round(F.sum("l_quantity") / F.count("*"), 6).alias("m"))


@on_tables("agg_05_group_percentage", "SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events) * 100, 6) AS pct FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return aggregate.shares(t.events, "event_type").withColumn("pct", F.round("pct", 6))


@on_tables("agg_06_group_concat", "SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS joined FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return aggregate.concatenated(t.events, ["user_id"], F.col("event_type"), "event_id")


@on_tables("agg_07_cross_tabulation", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return aggregate.frequency(t.orders, "o_orderstatus", "o_orderpriority")


@on_tables("agg_07_pivot", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS F, count(*) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)


@on_tables("agg_08_count_distinct", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def _(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@on_tables("agg_09_distinct_first_kept", "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY 2, 3")
def _(t: Tables) -> DataFrame:
    return Ordered(t.events, "event_id").first_seen("user_id", "event_type").select("event_id", "user_id", "event_type")


@on_tables("agg_10_max_with_payload", "SELECT (SELECT o_orderkey FROM orders WHERE o_totalprice > 0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS line, (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) AS low")
def _(t: Tables) -> DataFrame:
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return t.orders.agg(F.max_by(F.when(price > 0, key), F.when(price > 0, F.struct(price, -key))).alias("line"), aggregate.best(t.orders, price, key, "o_orderkey", largest=False).alias("low"))


@on_tables("agg_11_mode", "SELECT user_id, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, user_id LIMIT 1")
def _(t: Tables) -> DataFrame:
    return aggregate.frequency(t.events, "user_id").orderBy(F.desc("n"), "user_id").limit(1)


@on_tables("agg_12_first_last", "SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.events.groupBy("user_id").agg(aggregate.first_written(kind, "event_id").alias("first_type"), aggregate.last_written(kind, "event_id").alias("last_type"))


@on_tables("agg_13_overwrite", "SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(aggregate.last_written(F.col("o_totalprice"), "o_orderkey").alias("v"))


@on_tables("agg_14_to_19_statistics", "SELECT event_type, round(sum(value), 4) AS sum, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance, round(stddev_pop(value), 6) AS stddev, min(value) AS min, max(value) AS max, round(median(value), 6) AS median FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    digits = {"sum": 4, "mean": 6, "variance": 4, "stddev": 6, "median": 6}
    medians = aggregate.exact_quantiles(t.events, "value", {"median": 50}, "event_type")
    out = t.events.groupBy("event_type").agg(*aggregate.summary(F.col("value"))).join(medians, "event_type")
    return out.select("event_type", *[F.round(c, digits[c]).alias(c) if c in digits else c for c in ("sum", "mean", "variance", "stddev", "min", "max", "median")])


@on_tables("agg_14_sum", "SELECT round(coalesce(sum(c_acctbal), 0), 2) AS total, coalesce(sum(c_acctbal) FILTER (WHERE c_custkey < 0), 0) AS none FROM customer")
def _(t: Tables) -> DataFrame:
    return t.customer.agg(F.round(F.coalesce(F.sum("c_acctbal"), F.lit(0.0)), 2).alias("total"), F.coalesce(F.sum(F.when(F.col("c_custkey") < 0, F.col("c_acctbal"))), F.lit(0.0)).alias("none"))


@on_tables("agg_15_mean", "SELECT c_mktsegment, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 6).alias("mean"))


@on_tables("agg_16_variance", "SELECT round(var_pop(l_quantity), 6) AS variance FROM lineitem")
def _(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.round(F.var_pop("l_quantity"), 6).alias("variance"))


@on_tables("agg_17_stddev", "SELECT l_returnflag, round(stddev_pop(l_discount), 8) AS stddev FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.stddev_pop("l_discount"), 8).alias("stddev"))


@on_tables("agg_18_min_max", "SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@on_tables("agg_19_median", "SELECT round(median(l_extendedprice), 6) AS median FROM lineitem")
def _(t: Tables) -> DataFrame:
    return aggregate.exact_quantiles(t.lineitem, "l_extendedprice", {"median": 50}).select(F.round("median", 6).alias("median"))


@on_tables("agg_20_percentile", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25 FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    found = aggregate.exact_quantiles(t.lineitem, "l_extendedprice", {"p95": 95, "p25": 25}, "l_returnflag")
    return found.select("l_returnflag", F.round("p95", 6).alias("p95"), F.round("p25", 6).alias("p25"))


@on_tables("agg_21_quantile", "SELECT round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.9), 6) AS q90 FROM events")
def _(t: Tables) -> DataFrame:
    found = aggregate.exact_quantiles(t.events, "value", {"q10": 10, "q90": 90})
    return found.select(F.round("q10", 6).alias("q10"), F.round("q90", 6).alias("q90"))


@on_tables("agg_22_iqm", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(avg(value) FILTER (WHERE rn >= greatest(ceil(0.25 * n), 1) AND rn <= floor(0.75 * n)), 6) AS iqm FROM r GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return aggregate.interquartile_mean(t.events, "value", "event_type").withColumn("iqm", F.round("iqm", 6))


@on_tables("agg_23_histogram", "WITH e AS (SELECT min(value) AS a, (max(value) - min(value)) / 12 AS w FROM events), c AS (SELECT CAST(least(greatest(floor((value - a) / w), 0), 11) + 1 AS INTEGER) AS bin, count(*) AS n FROM events, e GROUP BY 1) SELECT CAST(b AS INTEGER) AS bin, round(a + (b - 1) * w, 6) AS low, round(a + b * w, 6) AS high, coalesce(n, 0) AS n FROM range(1, 13) r(b) CROSS JOIN e LEFT JOIN c ON c.bin = b")
def _(t: Tables) -> DataFrame:
    return aggregate.histogram(t.events, "value", 12).withColumn("low", F.round("low", 6)).withColumn("high", F.round("high", 6))


@on_tables("agg_23_histogram_clamped", "WITH c AS (SELECT CAST(least(greatest(floor((value - 20) / 15.0), 0), 3) + 1 AS INTEGER) AS bin, count(*) AS n FROM events GROUP BY 1) SELECT CAST(b AS INTEGER) AS bin, 20.0 + (b - 1) * 15 AS low, 20.0 + b * 15 AS high, coalesce(n, 0) AS n FROM range(1, 5) r(b) LEFT JOIN c ON c.bin = b")
def _(t: Tables) -> DataFrame:
    return aggregate.histogram(t.events, "value", 4, 20.0, 80.0)


@on_tables("agg_24_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def _(t: Tables) -> DataFrame:
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


# --- windows --------------------------------------------------------------------------------------------------------


@on_tables("win_01_running_total", "SELECT event_id, round(sum(value) OVER (ORDER BY event_id), 4) AS total FROM events")
def _(t: Tables) -> DataFrame:
    return ordered(t.events, "event_id").running_sum(F.col("value"), "total").select("event_id", F.round("total", 4).alias("total"))


@on_tables("win_02_sliding_window", "SELECT event_id, round(avg(value) OVER (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean, least(row_number() OVER (ORDER BY event_id), 5) AS size FROM events")
def _(t: Tables) -> DataFrame:
    means = ordered(t.events, "event_id").moving(5, F.avg("value"), "mean")
    return ordered(means, "event_id").moving(5, F.count("value"), "size").select("event_id", F.round("mean", 6).alias("mean"), "size")


@on_tables("win_03_moving_average", "SELECT event_id, m FROM (SELECT event_id, round(avg(value) OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS m, row_number() OVER (ORDER BY event_id) AS n FROM events) WHERE n >= 3")
def _(t: Tables) -> DataFrame:
    return ordered(t.events, "event_id").moving(3, F.avg("value"), "m", full=True).select("event_id", F.round("m", 6).alias("m"))


@on_tables("win_04_norm", "SELECT event_id, round((value - (SELECT min(value) FROM events)) / (SELECT max(value) - min(value) FROM events), 8) AS norm FROM events")
def _(t: Tables) -> DataFrame:
    return aggregate.normalised(t.events, "value").select("event_id", F.round("norm", 8).alias("norm"))


@on_tables("win_05_z_score", "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS z FROM customer")
def _(t: Tables) -> DataFrame:
    return aggregate.z_scores(t.customer, "c_acctbal").select("c_custkey", F.round("z", 6).alias("z"))


@on_tables("win_06_row_number", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS nr FROM orders")
def _(t: Tables) -> DataFrame:
    return ordered(t.orders, "o_orderkey").numbered().select("o_orderkey", F.col("nr").cast("long").alias("nr"))


@on_tables("win_07_number_nonblank", "SELECT event_id, CASE WHEN value > 50 THEN count(*) FILTER (WHERE value > 50) OVER (ORDER BY event_id) ELSE 0 END AS n FROM events")
def _(t: Tables) -> DataFrame:
    filled = F.col("value") > 50
    return ordered(t.events, "event_id").running_sum(filled.cast("int"), "n").select("event_id", F.when(filled, F.col("n")).otherwise(0).alias("n"))


@on_tables("win_08_dense_rank", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    return t.part.select("p_partkey", F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_size")).cast("long").alias("r"))


@on_tables("win_09_running_distinct", "SELECT event_id, CAST(sum(f) OVER (ORDER BY event_id) AS BIGINT) AS n FROM (SELECT event_id, CASE WHEN event_id = min(event_id) OVER (PARTITION BY user_id) THEN 1 ELSE 0 END AS f FROM events)")
def _(t: Tables) -> DataFrame:
    return ordered(t.events, "event_id").running_distinct("user_id", "n").select("event_id", "n")


@on_tables("win_10_lag", "SELECT event_id, lag(value) OVER (ORDER BY event_id) AS before FROM events")
def _(t: Tables) -> DataFrame:
    return ordered(t.events, "event_id").lag(F.col("value"), "before").select("event_id", "before")


@on_tables("win_11_run_length", "WITH c AS (SELECT event_id, event_type, CASE WHEN lag(event_type) OVER (ORDER BY event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS f FROM events), g AS (SELECT *, sum(f) OVER (ORDER BY event_id) AS run FROM c) SELECT CAST(run AS BIGINT) AS run, event_type, count(*) AS n FROM g GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return ordered(t.events, "event_id").runs(F.col("event_type")).groupBy(F.col("run").cast("long").alias("run"), "event_type").agg(F.count("*").alias("n"))


@on_tables("win_12_every_k_joined", "SELECT CAST(floor((nr - 1) / 5) AS BIGINT) AS line, string_agg(event_type, ',' ORDER BY nr) AS joined FROM (SELECT event_type, row_number() OVER (ORDER BY event_id) AS nr FROM events) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    rows = ordered(t.events, "event_id").numbered().withColumn("line", F.floor((F.col("nr") - 1) / 5))
    return aggregate.concatenated(rows, ["line"], F.col("event_type"), "nr")


@on_tables("win_13_group_sequence", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    return t.events.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("n"))


@on_tables("win_14_ntile_first_value", "SELECT p_partkey, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS q, first_value(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS f FROM part")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    return t.part.select("p_partkey", F.ntile(4).over(w).cast("long").alias("q"), F.first("p_name").over(w).alias("f"))


# --- sorting, limits, sampling, sets --------------------------------------------------------------------------------


@on_tables("srt_01_asort", "SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_size)), ' ') AS sizes FROM part GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_size")).cast("array<string>"), " ").alias("sizes"))


@on_tables("srt_02_asorti", "SELECT c_mktsegment, array_to_string(list_sort(list(DISTINCT CAST(c_nationkey AS VARCHAR))), ' ') AS keys FROM customer GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(F.array_join(F.array_sort(F.collect_set(F.col("c_nationkey").cast("string"))), " ").alias("keys"))


_MODES = {"sort": "k", "rsort": "k DESC", "nsort": "CAST(regexp_extract(k, '[0-9]+') AS INTEGER), k", "rnsort": "CAST(regexp_extract(k, '[0-9]+') AS INTEGER) DESC, k", "val": "n, k", "rval": "n DESC, k"}


def _sorted_by(mode: str):  # noqa: ANN202
    def run(t: Tables) -> DataFrame:
        counts = t.part.groupBy(F.col("p_brand").alias("k")).agg(F.count("*").alias("n"))
        number = F.regexp_extract("k", "[0-9]+", 0).cast("int")
        order = {"sort": ["k"], "rsort": [F.desc("k")], "nsort": [number, "k"], "rnsort": [number.desc(), "k"], "val": ["n", "k"], "rval": [F.desc("n"), "k"]}[mode]
        return placed(counts, *order)

    return run


for _mode, _order in _MODES.items():
    on_tables(f"srt_03_for_in_{_mode}", f"SELECT k, n, row_number() OVER (ORDER BY {_order}) AS place FROM (SELECT p_brand AS k, count(*) AS n FROM part GROUP BY 1)")(_sorted_by(_mode))


@on_tables("srt_04_smart_key_order", "SELECT k, row_number() OVER (ORDER BY TRY_CAST(k AS DOUBLE) NULLS LAST, k) AS place FROM (SELECT DISTINCT k FROM (SELECT CAST(p_size AS VARCHAR) AS k FROM part UNION ALL SELECT p_brand FROM part))")
def _(t: Tables) -> DataFrame:
    keys = t.part.select(F.col("p_size").cast("string").alias("k")).union(t.part.select("p_brand")).distinct()
    order = F.when(coerce.looks_numeric(F.col("k")), coerce.to_number(F.col("k"))).asc_nulls_last()
    return placed(keys, order, "k")


@on_tables("srt_05_reverse_lines", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS place FROM orders")
def _(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", (-F.col("o_orderkey")).alias("o"))
    return ordered(rows, "o").numbered("place").select("o_orderkey", F.col("place").cast("long").alias("place"))


@on_tables("srt_06_external_sort", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
def _(t: Tables) -> DataFrame:
    return t.supplier.orderBy(F.desc("s_acctbal"), "s_suppkey").select("s_suppkey", "s_acctbal")


@on_tables("lim_01_head", "SELECT event_id FROM events ORDER BY event_id LIMIT 10")
def _(t: Tables) -> DataFrame:
    return t.events.orderBy("event_id").limit(10).select("event_id")


@on_tables("lim_02_tail", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 10")
def _(t: Tables) -> DataFrame:
    return select.last(t.events, 10, "event_id").select("event_id")


@on_tables("lim_03_slice", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS nr FROM events) WHERE nr BETWEEN 100 AND 200")
def _(t: Tables) -> DataFrame:
    return select.numbers(ordered(t.events, "event_id").numbered(), 100, 200).select("event_id")


@on_tables("lim_04_top_bottom", "SELECT p_brand, array_to_string(list_sort(list(p_size), 'DESC')[1:3], ' ') AS top, array_to_string(list_sort(list(p_size))[1:3], ' ') AS bottom FROM part GROUP BY 1")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    def few(name: str, order) -> DataFrame:  # noqa: ANN001
        """Three sizes of each brand: no brand's sizes are gathered beyond that."""
        ranked = t.part.withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy(order))).filter("r <= 3")
        listed = F.array_sort(F.collect_list(F.struct("r", "p_size")))
        return ranked.groupBy("p_brand").agg(F.array_join(F.transform(listed, lambda x: x["p_size"].cast("string")), " ").alias(name))

    return few("top", F.desc("p_size")).join(few("bottom", F.asc("p_size")), "p_brand")


@on_tables("lim_04_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@on_tables("lim_05_top_by_frequency", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 15")
def _(t: Tables) -> DataFrame:
    return aggregate.frequency(t.lineitem, "l_partkey").orderBy(F.desc("n"), "l_partkey").limit(15)


@on_tables("smp_01_sample")
def _(t: Tables) -> DataFrame:
    return sets.sample(t.orders, 100, F.col("o_orderkey"), 42).select("o_orderkey")


@on_tables("smp_02_shuffle")
def _(t: Tables) -> DataFrame:
    return sets.shuffled(t.customer, F.col("c_custkey"), 42).select("c_custkey")


@on_tables("smp_03_bernoulli")
def _(t: Tables) -> DataFrame:
    return sets.bernoulli(t.orders, 0.2, F.col("o_orderkey"), 42).select("o_orderkey")


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    keys = t.events.select("user_id", "event_type").distinct()
    return keys.filter("event_type = 'error'").select("user_id"), keys.filter("event_type = 'signup'").select("user_id")


_HALVES = "WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') "


@on_tables("set_01_difference", _HALVES + "SELECT * FROM a EXCEPT SELECT * FROM b")
def _(t: Tables) -> DataFrame:
    return sets.difference(*_halves(t), "user_id")


@on_tables("set_02_intersection", _HALVES + "SELECT * FROM a INTERSECT SELECT * FROM b")
def _(t: Tables) -> DataFrame:
    return sets.intersection(*_halves(t), "user_id")


@on_tables("set_03_union", _HALVES + "SELECT * FROM a UNION SELECT * FROM b")
def _(t: Tables) -> DataFrame:
    return sets.union(*_halves(t), "user_id")


@on_tables("set_04_union_of_lines", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@on_tables("set_05_symmetric_difference", _HALVES + "(SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)")
def _(t: Tables) -> DataFrame:
    return sets.symmetric_difference(*_halves(t), "user_id")


@on_tables("set_06_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def _(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).unionByName(t.supplier.select(F.col("s_nationkey").alias("k")))
