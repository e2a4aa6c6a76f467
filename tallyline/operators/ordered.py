"""Operators over a total order of rows, without one task for all rows.

An ``Ordered`` frame has a numeric order column that is unique (a record number, a key). It is cut into buckets of
consecutive order values; windows run within buckets, and a small table with one row a bucket carries what a bucket
hands on to the next ones: counts, sums, last values, or the state of an automaton. Buckets are cut by rank, so a
skewed order column doesn't put most rows into a few of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch

BUCKET = "_bucket"
#: Rows that a bucket has on average; with more rows than ROWS * MOST, buckets are larger instead of more.
ROWS = 250_000
MOST = 100_000
#: Buckets cut by rank; where more are needed, each of these is cut by value.
ZONES = 64


def _zone(x: Column, bounds: list[float], first: int = 0) -> Column:
    """How many of the rising ``bounds`` are at most x, by halving."""
    if not bounds:
        return F.lit(first)
    k = len(bounds) // 2
    return F.when(x < bounds[k], _zone(x, bounds[:k], first)).otherwise(_zone(x, bounds[k + 1 :], first + k + 1))


@dataclass
class Ordered:
    rows: DataFrame
    order: str
    bucket_rows: int = ROWS

    @cached_property
    def cuts(self) -> tuple[list[float], int]:
        """The lower bounds of the zones, and how many buckets each has; a single one needs no bounds."""
        s = self.rows.agg(F.min(self.order).cast("double").alias("low"), F.max(self.order).cast("double").alias("high"), F.count("*").alias("n")).first()
        if not s["n"] or s["n"] <= self.bucket_rows:
            return [], 1
        wanted = math.ceil(s["n"] / max(self.bucket_rows, s["n"] / MOST))
        zones = min(ZONES, wanted)
        probes = [k / zones for k in range(1, zones)]
        found = self.rows.agg(F.percentile_approx(F.col(self.order).cast("double"), probes, 10_000).alias("b")).first()["b"] if probes else []
        return sorted({s["low"], *found}) + [s["high"]], math.ceil(wanted / zones)

    @property
    def single(self) -> bool:
        return not self.cuts[0]

    @cached_property
    def bucketed(self) -> DataFrame:
        """With a bucket number that rises with the order."""
        bounds, each = self.cuts
        if not bounds:
            return self.rows.withColumn(BUCKET, F.lit(0).cast("long"))
        x, lows = F.col(self.order).cast("double"), bounds[:-1]
        zoned = self.rows.withColumn(BUCKET, _zone(x, lows[1:]).cast("long"))
        if each == 1:
            return zoned
        number = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col(BUCKET) + 1).cast("int"))
        widths = [max((b - a) / each, 1e-300) for a, b in zip(lows, bounds[1:], strict=True)]
        within = F.least(F.floor((x - number(lows)) / number(widths)), F.lit(each - 1))
        return zoned.withColumn(BUCKET, F.col(BUCKET) * each + within)

    def given(self, rows: DataFrame, carry: DataFrame, **first: Column) -> DataFrame:
        """``rows`` with the columns of ``carry``; a single bucket gets what stands ``first``, without a join."""
        return rows.withColumns(first) if self.single else rows.join(carry, BUCKET)

    @property
    def within(self) -> Window:
        return Window.partitionBy(BUCKET).orderBy(self.order)

    def carried(self, **sums: Column) -> DataFrame:
        """One row a bucket: BUCKET and each aggregate summed over the buckets before."""
        per = self.bucketed.groupBy(BUCKET).agg(*[c.alias(n) for n, c in sums.items()])
        before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        return per.select(BUCKET, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])

    def numbered(self, name: str = "nr") -> DataFrame:
        """With the 1-based place of each row."""
        carry = self.carried(_n=F.count("*"))
        ranked = self.bucketed.withColumn("_r", F.row_number().over(self.within))
        return self.given(ranked, carry, _n=F.lit(0).cast("long")).withColumn(name, F.col("_r") + F.col("_n")).drop("_r", "_n", BUCKET)

    def running_sum(self, value: Column, name: str) -> DataFrame:
        carry = self.carried(_s=F.sum(value))
        own = F.coalesce(F.sum(value).over(self.within.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
        return self.given(self.bucketed.withColumn("_o", own), carry, _s=F.lit(0)).withColumn(name, F.col("_o") + F.col("_s")).drop("_o", "_s", BUCKET)

    def lag(self, value: Column, name: str) -> DataFrame:
        """With the value of the row before, null for the first."""
        per = self.bucketed.groupBy(BUCKET).agg(F.max_by(F.struct(value.alias("v")), self.order).alias("_last"))
        carry = per.select(BUCKET, F.lag("_last").over(Window.orderBy(BUCKET)).alias("_last"))
        own = F.lag(F.struct(value.alias("v"))).over(self.within)
        rows = self.bucketed.withColumn("_own", own)
        return self.given(rows, carry, _last=F.col("_own")).withColumn(name, F.coalesce("_own", "_last")["v"]).drop("_own", "_last", BUCKET)

    def lead(self, value: Column, name: str) -> DataFrame:
        """With the value of the next row, null for the last."""
        per = self.bucketed.groupBy(BUCKET).agg(F.min_by(F.struct(value.alias("v")), self.order).alias("_first"))
        carry = per.select(BUCKET, F.lead("_first").over(Window.orderBy(BUCKET)).alias("_first"))
        own = F.lead(F.struct(value.alias("v"))).over(self.within)
        rows = self.bucketed.withColumn("_own", own)
        return self.given(rows, carry, _first=F.col("_own")).withColumn(name, F.coalesce("_own", "_first")["v"]).drop("_own", "_first", BUCKET)

    def moving(self, n: int, aggregate: Column, name: str, full: bool = False, lag: int = 0) -> DataFrame:
        """``aggregate`` over the last ``n`` rows; ``full`` keeps only rows that have n.

        Buckets are runs of record numbers; the last n - 1 rows of a run also visit the next one.
        """
        run = max(self.bucket_rows, n)
        numbered = self.numbered("_nr").withColumn("_at", F.floor((F.col("_nr") - 1) / run))
        visits = F.when((F.col("_nr") - 1) % run >= run - (n - 1), F.array(F.col("_at"), F.col("_at") + 1)).otherwise(F.array("_at"))
        seen = numbered.withColumn(BUCKET, F.explode(visits))
        over = Window.partitionBy(BUCKET).orderBy("_nr").rowsBetween(1 - n, 0)
        value = F.lag(aggregate, lag).over(Window.partitionBy(BUCKET).orderBy("_nr")) if lag else aggregate.over(over)
        done = seen.withColumn(name, value).filter(F.col(BUCKET) == F.col("_at"))
        return (done.filter(F.col("_nr") >= n) if full else done).drop("_nr", "_at", BUCKET)

    def first_seen(self, *keys: str, alone: bool = False) -> DataFrame:
        """The first row of each key: one aggregation, combined before its only shuffle.

        ``alone`` gives the keys and the order only, which needs no row of each key to be carried along.
        """
        if alone:
            return self.rows.groupBy(*keys).agg(F.min(self.order).alias(self.order))
        columns = [F.col(f"`{c}`") for c in self.rows.columns]
        first = self.rows.groupBy(*[F.col(k).alias(f"_first_key{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*columns), self.order).alias("_first_row"))
        return first.select("_first_row.*")

    def earlier(self, value: Column, k: int, name: str) -> DataFrame:
        """With the value ``k`` rows before, null in the first k rows."""
        return self.moving(k + 1, value, name, lag=k)

    def running_distinct(self, key: str, name: str) -> DataFrame:
        """With the number of distinct keys so far."""
        first = self.rows.groupBy(key).agg(F.min(self.order).alias("_first")).select("_first")
        marked = self.rows.join(first, F.col(self.order) == F.col("_first"), "left").withColumn("_new", F.col("_first").isNotNull().cast("int")).drop("_first")
        return Ordered(marked, self.order, self.bucket_rows).running_sum(F.col("_new"), name).drop("_new")

    def runs(self, value: Column, name: str = "run") -> DataFrame:
        """With the number of the run of equal values (from 1) that the row is in."""
        flagged = self.lag(value, "_before").withColumn("_change", F.when(value.eqNullSafe(F.col("_before")), 0).otherwise(1))
        # the first row has nothing before it, which equals null only if its value is null
        first = self.rows.select(F.min(self.order)).scalar()
        flagged = flagged.withColumn("_change", F.when(F.col(self.order) == first, 1).otherwise(F.col("_change"))).drop("_before")
        return Ordered(flagged, self.order, self.bucket_rows).running_sum(F.col("_change"), name).drop("_change")

    def between(self, start: Column, end: Column, posix: bool = False) -> DataFrame:
        """Rows of the ranges that ``start`` opens and ``end`` closes, both included.

        By default the end isn't tested on the row that opens; ``posix`` tests it there too. A row with start and end
        toggles the state (posix: resets it), one with start alone sets it, one with end alone resets it. Since a
        bucket either forces a state or toggles the one it gets, buckets compose as rows do.
        """
        s, e = F.coalesce(start, F.lit(False)), F.coalesce(end, F.lit(False))
        force = F.when(s & ~e, 1).when(e & ~s, 0)
        toggle = (s & e).cast("int")
        if posix:
            force, toggle = F.when(s & ~e, 1).when(e, 0), F.lit(0)
        rows = self.bucketed.withColumn("_s", s).withColumn("_force", force).withColumn("_toggle", toggle)
        before = self.within.rowsBetween(Window.unboundedPreceding, -1)

        def state(force: str, toggles: Column, over: Window, given: Column) -> Column:
            last = F.last(F.when(F.col(force).isNotNull(), F.struct(F.col(force).alias("f"), toggles.alias("t"))), ignorenulls=True).over(over)
            count = F.coalesce(F.sum("_toggle").over(over), F.lit(0))
            return F.when(last.isNotNull(), (last["f"] + count - last["t"]) % 2).otherwise((given + count) % 2)

        rows = rows.withColumn("_sofar", F.sum("_toggle").over(self.within.rowsBetween(Window.unboundedPreceding, 0)))
        # what a bucket does: the forced state after its toggles, or null and the parity of its toggles
        forced = F.max_by(F.when(F.col("_force").isNotNull(), F.struct(F.col("_force").alias("f"), F.col("_sofar").alias("t"))), F.when(F.col("_force").isNotNull(), F.col(self.order)))
        per = rows.groupBy(BUCKET).agg(forced.alias("_last"), F.sum("_toggle").alias("_toggle"))
        per = per.withColumn("_force", F.when(F.col("_last").isNotNull(), (F.col("_last.f") + F.col("_toggle") - F.col("_last.t")) % 2)).withColumn("_toggle", F.when(F.col("_last").isNull(), F.col("_toggle")).otherwise(0))
        up_to = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, 0)
        earlier = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        per = per.withColumn("_sofar", F.sum("_toggle").over(up_to))
        given = per.select(BUCKET, state("_force", F.col("_sofar"), earlier, F.lit(0)).alias("_given"))
        joined = self.given(rows, given, _given=F.lit(0))
        inside = joined.withColumn("_active", state("_force", F.col("_sofar"), before, F.col("_given")))
        return inside.filter((F.col("_active") == 1) | F.col("_s")).drop("_s", "_force", "_toggle", "_sofar", "_given", "_active", BUCKET)


def placed(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """With the 1-based place of each row in a sorting by any columns.

    The sorted rows are a written table: a place is that in its partition plus what earlier partitions hold.
    """
    path = scratch(rows.sparkSession, "sorted")
    rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    own = rows.sparkSession.read.parquet(path).withColumn("_part", F.shiftright("_id", 33))
    per = own.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row a partition
    return own.join(F.broadcast(carry), "_part").withColumn(name, F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + F.col("_before")).drop("_id", "_part", "_before")
