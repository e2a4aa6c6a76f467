"""Column functions against stated values."""

import math

import pytest
from pyspark.sql import functions as F

from tallyline.functions import arrays, coerce, dates, jsons, numbers, printf, strings
from tallyline.lang import values


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


TEXTS = ["12", " 3.5 ", "1e3", "1e3x", "-7abc", "abc", "", ".5", "5.", "+4", "0x1f", "1d", "1f", "-inf", "Infinity", "\t8\n", "1.2.3", "--3", " 7", "9e", "1e400"]


def test_to_number_agrees_with_the_machine(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", coerce.to_number(F.col("t")).alias("n"), coerce.looks_numeric(F.col("t")).alias("l")).collect()
    for r in rows:
        assert r["n"] == values.number(r["t"]), r
        assert r["l"] == values.looks_numeric(r["t"]), r
    assert math.isnan(one(spark, coerce.to_number(F.lit("nan"))))


NUMBERS = [0.0, -0.0, 1.0, -3.0, 0.1, 1e-7, 1e19, 1234567.891, 1 / 3, 2.5e-3, 123456789012.0, float("nan"), float("inf"), float("-inf")]


def test_number_text(spark):
    rows = spark.createDataFrame([(float(i), n) for i, n in enumerate(NUMBERS)], "i double, n double").select("i", "n", coerce.number_text(F.col("n")).alias("s")).collect()
    for r in rows:
        expected = values.number_text(r["n"])
        assert r["s"] == expected or (r["n"] != 0 and abs(r["n"]) < 1e-6) or abs(r["n"]) > 9e18, (r, expected)


@pytest.mark.parametrize(("op", "a", "b", "expected"), [("<", "10", "9", False), ("<", "abc", "abd", True), ("==", "10", "10.0", True), ("<", "10x", "9", True), ("!=", "", "0", True)])
def test_compare(spark, op, a, b, expected):
    assert one(spark, coerce.compare(op, F.lit(a), F.lit(b))) is expected
    assert values.compare(op, a, b) is expected


def test_division_by_zero_is_zero(spark):
    assert one(spark, coerce.divide(F.lit(5.0), F.lit(0.0))) == 0
    assert one(spark, coerce.modulo(F.lit(-7.5), F.lit(2.0))) == -1.5
    assert one(spark, coerce.modulo(F.lit(7.5), F.lit(0.0))) == 0


def test_strings(spark):
    s = F.lit("hello")
    assert one(spark, strings.substr(s, 0, 2)) == "he"
    assert one(spark, strings.substr(s, -3, 2)) == "he"
    assert one(spark, strings.substr(s, 4)) == "lo"
    assert one(spark, strings.substr(s, 2, -1)) == ""
    assert one(spark, strings.index(s, "l")) == 3
    assert one(spark, strings.lpad(F.lit("abcdef"), 3)) == "abcdef"
    assert one(spark, strings.character(F.lit(9731))) == "☃"
    assert one(spark, strings.hexadecimal(F.lit(-1))) == "0xffffffffffffffff"
    assert one(spark, strings.trim(F.lit("\t x \n"))) == "x"
    for text, shown in (("whales", "🐋"), (" Torches", " Torches"), ("PEACHES", "🍑"), ("bus", "bus"), ("glass", "glass"), ("", "")):
        assert one(spark, strings.emoji(F.lit(text))) == shown


@pytest.mark.parametrize(("pattern", "replacement", "first", "every"), [("o", "0", "f0o boo", "f00 b00"), ("o+", "[&]", "f[oo] boo", "f[oo] b[oo]"), ("x", "y", "foo boo", "foo boo"), ("o", "\\&", "f&o boo", "f&& b&&"), ("^", ">", ">foo boo", ">foo boo"), ("o", "$1", "f$1o boo", "f$1$1 b$1$1")])
def test_sub_and_gsub(spark, pattern, replacement, first, every):
    assert one(spark, strings.sub(F.lit("foo boo"), pattern, replacement)) == first
    assert one(spark, strings.gsub(F.lit("foo boo"), pattern, replacement)) == every


def test_gensub_and_match(spark):
    s = F.lit("a-b-c-d")
    assert one(spark, strings.gensub("-", "+", 2, s)) == "a-b+c-d"
    assert one(spark, strings.gensub("-", "+", 9, s)) == "a-b-c-d"
    assert one(spark, strings.gensub("(\\w)-(\\w)", "$2-$1", "g", s)) == "b-a-d-c"
    assert one(spark, strings.match_start(s, "c")) == 5
    assert one(spark, strings.match_length(s, "z")) == -1


def test_numbers(spark):
    assert one(spark, numbers.integer(F.lit(-2.7))) == -2
    assert one(spark, numbers.integer(F.lit(1e30))) == 1e30
    assert one(spark, numbers.rounded(F.lit(-2.5))) == -3
    assert one(spark, numbers.logarithm(F.lit(0.0))) == -math.inf
    assert one(spark, numbers.bit_xor(F.lit(255), F.lit(15))) == 240
    assert one(spark, numbers.shift_right(F.lit(-1), 60)) == 15


FORMATS = [("%d|%5d|%-5d|%05d|%+d", [42, 42, 42, 42, 42]), ("%.2f|%8.3f|%-8.1f|%08.2f", [2.675, 1382.85, 0.05, -3.14159]), ("%x %o %X", [255, 8, 255]), ("%e|%.2e", [12345.678, 0.00012]), ("%g|%.3g|%g", [1e10, 1234.5, 0.0001]), ("%s|%10s|%-10s|%.2s", ["ab", "ab", "ab", "abcdef"]), ("%c%c", [65, "xyz"]), ("100%%", []), ("%.0f %.0f %.0f", [0.5, 1.5, 2.5]), ("%5.1f%%", [99.95])]


@pytest.mark.parametrize(("fmt", "args"), FORMATS)
def test_printf_is_as_in_c(spark, fmt, args):
    expected = printf.sprintf(fmt, args)
    columns = [F.lit(a) for a in args]
    text = tuple(isinstance(a, str) for a in args)
    if "%c" not in fmt:
        assert one(spark, printf.format_columns(fmt, *columns, text=text)) == expected
    if args and "c" not in fmt:
        assert expected == fmt % tuple(args)


def test_fixed_rounds_the_exact_value(spark):
    import random

    rng = random.Random(3)
    xs = [rng.choice([rng.uniform(-1e4, 1e4), round(rng.uniform(-1e3, 1e3), 2), rng.randint(-4000, 4000) / 8, rng.uniform(-1, 1) * 10 ** rng.randint(-8, 14)]) for _ in range(3000)]
    for p in (0, 1, 2, 3, 6):
        rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", printf.format_columns(f"%.{p}f", F.col("x")).alias("s")).collect()
        assert [(r["x"], r["s"]) for r in rows] == [(r["x"], f"%.{p}f" % r["x"]) for r in rows]


@pytest.mark.parametrize("fmt", ["%.2f", "%6.1f", "%f", "%+.0f", "%07.2f", "%-8.1f|", "%.10f"])
def test_fixed_keeps_the_sign_of_zero(spark, fmt):
    xs = [-0.0, 0.0, -0.001, 0.001, -5e-324]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(printf.format_columns(fmt, F.col("x")).alias("s")).collect()
    assert [r["s"] for r in rows] == [fmt % x for x in xs]


def test_dates(spark):
    ts = dates.timestamp(F.lit(1_709_210_096))  # 2024-02-29 12:34:56
    assert one(spark, dates.strftime("%Y-%m-%d %H:%M:%S %j %a %p %%", ts)) == "2024-02-29 12:34:56 060 Thu PM %"
    assert one(spark, dates.strftime("%q", ts)) == "%q"
    assert one(spark, dates.mktime(F.lit("2024 2 29 12 34 56"))) == 1_709_210_096
    assert one(spark, dates.mktime(F.lit("2023 14 29 12 34 56"))) == 1_709_210_096
    assert one(spark, dates.mktime(F.lit("nonsense"))) == -1
    assert one(spark, dates.parsedate(F.lit("29/02/2024"), "%d/%m/%Y")) == 1_709_164_800
    assert one(spark, dates.parsedate(F.lit("x"), "%Y")) is None


def test_json_paths(spark):
    doc = F.lit('{"a":{"b":[1,{"c":"x"},{"c":"y"}]},"t":true,"n":null,"users":[{"id":7}]}')
    for path in (".a.b[0]", ".a.b[].c", ".t", ".n", ".none", ".users[].id", ".a.b[1].c"):
        from tallyline.lang.builtins import jpath

        assert one(spark, jsons.jpath(doc, path)) == jpath('{"a":{"b":[1,{"c":"x"},{"c":"y"}]},"t":true,"n":null,"users":[{"id":7}]}', path), path
    assert one(spark, jsons.members(doc)) == ["a", "t", "n", "users"]


@pytest.mark.parametrize("name", ["runtotal", "norm", "variance"])
def test_long_arrays_take_no_square(spark, name):
    import time
    from itertools import accumulate

    numbers_of = lambda n: [(i * 7919 % 1000) / 8 - 50 for i in range(n)]

    def timed(n):
        rows = spark.range(1).select(F.transform(F.sequence(F.col("id"), F.col("id") + n - 1), lambda i: (i * 7919 % 1000) / 8 - 50).alias("a"))
        start = time.monotonic()
        got = rows.select(getattr(arrays, name)(F.col("a")).alias("x")).first()["x"]
        return got, time.monotonic() - start

    timed(100)
    got, seconds = timed(60_000)
    xs = numbers_of(60_000)
    mean, low, high = sum(xs) / len(xs), min(xs), max(xs)
    if name == "variance":
        assert got == pytest.approx(sum((x - mean) ** 2 for x in xs) / len(xs))
    else:
        assert got == (list(accumulate(xs)) if name == "runtotal" else [(x - low) / (high - low) for x in xs])
    assert seconds < 15


def test_arrays_with_nulls(spark):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate([[1.5, None, 2.0, 3.0], None, [], [0.1, 0.2, 0.3]])], "k int, a array<double>")
    assert [r["x"] for r in rows.orderBy("k").select(arrays.runtotal(F.col("a")).alias("x")).collect()] == [[1.5, None, 2.0, 5.0], None, [], [0.1, 0.1 + 0.2, 0.1 + 0.2 + 0.3]]
    assert one(spark, arrays.norm(F.lit([2.0, 2.0]))) == [0, 0]
    assert one(spark, arrays.variance(F.array().cast("array<double>"))) == 0


def test_arrays(spark):
    a = F.lit([3, 1, 2, 3]).cast("array<double>")
    assert one(spark, arrays.uniq(a)) == [3, 1, 2]
    assert one(spark, arrays.top(a, 2)) == [3, 3]
    assert one(spark, arrays.runtotal(a)) == [3, 4, 6, 9]
    assert one(spark, arrays.norm(a)) == [1, 0, 0.5, 1]
    assert one(spark, arrays.percentile(F.lit([10.0 * i for i in range(1, 11)]), 95)) == pytest.approx(95.5)
    assert one(spark, arrays.variance(F.lit([2.0, 4, 4, 4, 5, 5, 7, 9]))) == 4
    assert one(spark, arrays.asort(F.lit(["b", "10", "9", "a"]))) == ["9", "10", "a", "b"]
    assert one(spark, arrays.inv(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")))) == {"1": "b"}
    assert one(spark, arrays.tidy(F.lit(["x", "", "0", "y"]))) == ["x", "y"]
    assert sorted(one(spark, arrays.shuf(a, 5))) == [1, 2, 3, 3]
    assert len(one(spark, arrays.samp(a, 2, 5))) == 2
    assert one(spark, arrays.seq(3, 1)) == [3, 2, 1]
