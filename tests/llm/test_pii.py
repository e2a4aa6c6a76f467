"""Surrogates: consistent, distinct, of the same kind and format; nothing else changes."""

import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from tallyline.llm import pii

SCHEMA = "doc_id long, text string, kinds string, found int"


def done(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], SCHEMA)
    rows = pii.rewritten(df, **{"key": "a key"} | options, kinds="told").collect()
    return {r["doc_id"]: r for r in rows}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_kinds_and_formats(spark):
    texts = [
        "mail ann.lee7@mail3.example.com or ANN.LEE7@MAIL3.EXAMPLE.COM!!",
        "call +1 (743) 555-3824 or +1-743-555-3824, (212) 555-1234, 212-555-1234.",
        "from 192.168.7.40, not 999.1.1.1 or 1.2.3.4.5",
        "card 4111 1111 1111 1111 and 4111111111111111, not 4111111111111112",
        'ssn 123-45-6789; token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" TOKEN = "04DBEBAB91AB85687D33EEAAF9AC699E1188F962"',
        "Mr John Smith met Frau Anna Weber. Mr Smith left, Mrs Smith stayed. г-н Иван Петров",
        "nothing here 12 345", None, "",
    ]
    got = done(spark, texts)
    t = {i: got[i]["text"] for i in got}
    a, b = re.match(r"mail (\S+@\S+) or (\S+@\S+)!!$", t[0]).groups()
    assert b == a.upper() and a != "ann.lee7@mail3.example.com" and re.fullmatch(r"[a-z]{3}\.[a-z]{3}\d@[a-z]{4}\d\.example\.com", a)
    m = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1-(\d{3})-(\d{3})-(\d{4}), \((\d{3})\) (\d{3})-(\d{4}), (\d{3})-(\d{3})-(\d{4})\.", t[1]).groups()
    assert m[:3] == m[3:6] != ("743", "555", "3824") and m[6:9] == m[9:]
    assert re.fullmatch(r"from 192\.\d+\.\d+\.\d+, not 999\.1\.1\.1 or 1\.2\.3\.4\.5", t[2]) and "192.168.7.40" not in t[2]
    m = re.fullmatch(r"card (\d{4}) (\d{4}) (\d{4}) (\d{4}) and (\d{16}), not 4111111111111112", t[3]).groups()
    assert "".join(m[:4]) == m[4] != "4111111111111111" and luhn(m[4]) and m[4][0] == "4"
    m = re.fullmatch(r'ssn (\d{3}-\d{2}-\d{4}); token = "([0-9a-f]{40})" TOKEN = "([0-9A-F]{40})"', t[4]).groups()
    assert m[1] != m[2].lower() and m[0] != "123-45-6789"  # tokens of different case are different tokens
    m = re.fullmatch(r"Mr (\S+) (\S+) met Frau (\S+) (\S+)\. Mr (\S+) left, Mrs (\S+) stayed\. г-н (\S+) (\S+)", t[5]).groups()
    assert m[1] == m[4] == m[5] and m[0] in pii.GIVEN["m"].split() and m[2] in pii.GIVEN["f"].split() and m[6] in pii.GIVEN["cm"].split()
    assert re.fullmatch("[А-Яа-яё]+", m[7])
    assert t[6] == texts[6] and t[7] is None and t[8] == ""
    assert got[0]["kinds"] == "k" and got[3]["told"] == ["card", "card"] and got[7]["told"] == []


def values(n):
    return [f"a.{i % 100:02d}@mail{i // 100}.example.com" for i in range(n)]


@pytest.mark.parametrize("literal", [5000, 3])
def test_distinct_values_stay_distinct(spark, literal):
    mails = values(900)  # one letter and two digits: there are only 1,600 surrogates a host
    phones = [f"+1 (555) 555-{i:04d}" for i in range(300)]
    texts = [" ".join([m, p]) for m, p in zip(mails, phones * 3, strict=True)]
    got = done(spark, texts, literal=literal)
    pairs, back = {}, {}
    for i, t in enumerate(texts):
        for old, new in zip(t.split(" ", 1), got[i]["text"].split(" ", 1), strict=True):
            assert pairs.setdefault(old, new) == new
            assert back.setdefault(new, old) == old
    assert not set(back) & set(pairs)


def test_digit_permutation_is_one_to_one(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d")).select("d", pii._digits("k", F.col("d"), F.lit("t")).alias("s"))
    rows = df.collect()
    assert {r["s"] for r in rows} == {r["d"] for r in rows}


def test_other_keys_give_other_surrogates(spark):
    text = ["x ann.lee7@mail3.example.com y"]
    assert done(spark, text, key="one")[0]["text"] != done(spark, text, key="two")[0]["text"]
    assert done(spark, text, key="one")[0]["text"] == done(spark, text, key="one")[0]["text"]


def test_long_repeated_and_empty(spark):
    long = ("word " * 20000 + "ann.lee7@mail3.example.com ") * 3
    got = done(spark, [long, "a" * 500_000, "1" * 200_000])
    assert got[0]["told"] == ["email"] * 3 and got[1]["told"] == [] and got[2]["text"] == "1" * 200_000
    df = spark.createDataFrame([(1, "10.1.2.3"), (1, "10.1.2.3"), (None, "10.1.2.3")], "doc_id long, text string")
    assert len({r["text"] for r in pii.rewritten(df, "k", literal=0).collect()}) == 1
    assert pii.rewritten(df.limit(0), "k").count() == 0


def test_query_has_no_python(spark, folder):
    out = pii.op6_pii(spark, folder)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    after = out.collect()
    mail = re.compile(r"[\w.+-]+@[\w.-]+\w")
    old = {m for t in before.values() for m in mail.findall(t or "")}
    assert old and not old & {m for r in after for m in mail.findall(r["text"])}
    assert all(r["text"] == before[r["doc_id"]] for r in after if not r["n_values"])


def test_phone_numbers_of_other_countries(spark):
    phones = ["+33 1 23 45 67 89", "+33 6 12 34 56 78", "+33 (0)1 23 45 67 89", "+47 22 33 44 55", "+49 30 1234567", "01 23 45 67 89", "06.12.34.56.78", "0612345678", "030 1234567", "030/1234567", "020 7946 0958", "555 123 4567", "(212) 555 1234"]
    other = ["on 01.02.2020 and 2020-01-02", "0.0123456789 of 1 234 567", "at 05:30 on 05/2020", "0 1 2 3 4 5 6 7 8 9"]
    got = done(spark, [f"call {p}, now" for p in phones] + other)
    for i, p in enumerate(phones):
        assert got[i]["told"] == ["phone"], p
        assert p not in got[i]["text"] and re.sub(r"\d", "9", got[i]["text"]) == re.sub(r"\d", "9", f"call {p}, now")
    assert [got[len(phones) + i]["text"] for i in range(len(other))] == other
    assert got[0]["text"].startswith("call +33 ")


def test_the_key_is_required(spark):
    df = spark.createDataFrame([(1, "10.1.2.3")], "doc_id long, text string")
    with pytest.raises(ValueError, match="key"):
        pii.rewritten(df)
    spark.conf.set(pii.KEY, "from the setting")
    try:
        assert pii.rewritten(df).first()["text"] == pii.rewritten(df, "from the setting").first()["text"]
    finally:
        spark.conf.unset(pii.KEY)


def test_names_without_their_title(spark):
    texts = ["Mr John Smith or John Smith, and John, and SMITH or Smithers. Johnny! Smith's", "John Smith alone", "Mrs Mary Smith saw Smith; Mary-Lou and Mary. Mr Kim Lee, Mrs Kim Roe, Kim"]
    got = {i: r["text"] for i, r in done(spark, texts).items()}
    m = re.fullmatch(r"Mr (\S+) (\S+) or (\S+) (\S+), and (\S+), and SMITH or Smithers\. Johnny! (\S+)'s", got[0]).groups()
    assert m[0] == m[2] == m[4] != "John" and m[1] == m[3] == m[5] != "Smith"
    assert got[1] == texts[1]  # no title shows that it is a name
    m2 = re.fullmatch(r"Mrs (\S+) (\S+) saw (\S+); (\S+)-Lou and (\S+)\. Mr (\S+) (\S+), Mrs (\S+) (\S+), (\S+)", got[2]).groups()
    assert m2[1] == m2[2] == m[1] and m2[0] == m2[3] == m2[4] and m2[9] == m2[5] != m2[7]


def slow_rest(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_ibans_and_addresses(spark):
    texts = [
        "to DE89 3704 0044 0532 0130 00 or DE89370400440532013000, GB82WEST12345698765432; not DE88 3704 0044 0532 0130 00",
        "at 2001:db8::8a2e:370:7334 and 2001:0DB8:0000:0000:0000:8A2E:0370:7334 at 12:34:56, std::string, a::b, 10:20:30:40",
        "version 1.2.3.4, v1.2.3.4, Version: 1.2.3.4 but host 1.2.3.4",
    ]
    got = {i: r["text"] for i, r in done(spark, texts).items()}
    m = re.fullmatch(r"to (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) or (DE\d{20}), (GB\d\d[A-Z]{4}\d{14}); not DE88 3704 0044 0532 0130 00", got[0]).groups()
    assert m[0].replace(" ", "") == m[1] != "DE89370400440532013000" and slow_rest(m[1]) == slow_rest(m[2]) == 1 and "WEST" not in m[2]
    m = re.fullmatch(r"at (2001:[0-9a-f]{1,4}::[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){2}) and (2001:[0-9A-F]{4}:0000:0000:0000(?::[0-9A-F]{4}){3}) at 12:34:56, std::string, a::b, 10:20:30:40", got[1]).groups()
    import ipaddress

    assert ipaddress.ip_address(m[0]) == ipaddress.ip_address(m[1]) != ipaddress.ip_address("2001:db8::8a2e:370:7334")
    assert re.fullmatch(r"version 1\.2\.3\.4, v1\.2\.3\.4, Version: 1\.2\.3\.4 but host 1\.\d+\.\d+\.\d+", got[2]) and not got[2].endswith("host 1.2.3.4")


def test_marks_in_texts(spark):
    odd = ["a\x01b\x02c\x03d\x04 10.1.2.3\x02\x03\x04 10.1.2.3", "\x03\x01\x04\x01\x02 nothing", "\x03" * 5 + "x@y.example.com" + "\x01\x04"]
    got = {i: r["text"] for i, r in done(spark, odd).items()}
    assert re.fullmatch("a\x01b\x02c\x03d\x04 (10\\.\\d+\\.\\d+\\.\\d+)\x02\x03\x04 (10\\.\\d+\\.\\d+\\.\\d+)", got[0])
    assert got[1] == odd[1]
    assert got[2].startswith("\x03" * 5) and got[2].endswith("\x01\x04") and "x@y" not in got[2]


@pytest.mark.parametrize("literal", [5000, 0])
def test_distinctness_and_coreference_by_brute_force(spark, literal):
    """Random tokens of mixed case and random names in random texts: one surrogate a value, one value a surrogate."""
    rng = random.Random(17)
    letters = "abcdefghijklmnopqrstuvwxyz"
    tokens = ["".join(rng.choice([str.upper, str.lower])(rng.choice(letters + "0123456789")) for _ in range(20)) for _ in range(60)]
    tokens += [t.swapcase() for t in tokens[:20]] + [t.lower() for t in tokens[20:40]]
    people = [(rng.choice(["Mr", "Mrs"]), rng.choice(letters).upper() + "".join(rng.choices(letters, k=5)), rng.choice(letters).upper() + "".join(rng.choices(letters, k=6))) for _ in range(60)]
    gender = {}
    people = [p for p in people if gender.setdefault(p[1], p[0]) == p[0]]
    texts, plans = [], []
    for _ in range(200):
        title, given, family = rng.choice(people)
        some = rng.sample(tokens, 2)
        plan = [("", f"{title} "), ("g", given), ("", " "), ("f", family), ("", " has secret="), ("t", some[0]), ("", " but "), ("f", family), ("", ", or "), ("g", given), ("", " "), ("f", family), ("", ", password: "), ("t", some[1]), ("", " end")]
        plans.append(plan)
        texts.append("".join(x for _, x in plan))
    got = done(spark, texts, literal=literal)
    new, old = {}, {}
    for i, plan in enumerate(plans):
        pattern = "".join(re.escape(x) if not k else r"([\p{L}-]+)" if k in "gf" else "([A-Za-z0-9]{20})" for k, x in plan)
        m = regex.fullmatch(pattern, got[i]["text"])
        assert m, got[i]["text"]
        for value, surrogate in zip([x for x in plan if x[0]], m.groups(), strict=True):
            assert new.setdefault(value, surrogate) == surrogate
            assert old.setdefault((value[0], surrogate), value) == value
    for (kind, value), surrogate in new.items():
        assert value != surrogate
        if kind == "t" and not re.fullmatch("[0-9a-f]+|[0-9A-F]+", value):
            shape = lambda x: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", x)))
            assert shape(value) == shape(surrogate)
