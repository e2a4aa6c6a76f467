"""Surrogates for personal data, by DataFrame functions alone.

One pattern finds e-mail addresses, phone numbers, IPv4 and IPv6 addresses, payment cards (Luhn-valid), IBANs (with
right check digits), social security numbers, access tokens, and names after a title; a name that a title has shown is
found in the rest of its text without one as well, whole or in part. Each value has a canonical form (separators and
spacing don't count, case only for tokens), and its surrogate is a keyed function of type and canonical form, so every
mention gets the same one, in its own format:

* digits: a keyed Feistel permutation of the digits (card: first digit kept, check digit renewed; phone: country code
  kept), written into the separators of the mention;
* IPv4: first octet kept, the other 24 bits permuted; IPv6: first group and zero groups kept;
* e-mail: letters to letters and digits to digits, under a reserved domain; IBAN: likewise, country kept, check digits
  renewed; tokens: character by character to the same alphabet and case, published prefixes kept;
* names: given name by the gender that the title shows, family name apart, so "Mr A B" and "Mr B" agree; in the
  script of the mention.

Permutations keep different values different; the rest are hashes. A collision check over the distinct values (a small
table beside the texts, never collected) finds surrogates that two values share or that occur as real values, and
gives all but one of them another attempt until none is left. Values that needed one are few and known to the rewrite
as a literal up to ``LITERAL`` entries, by a join beyond that.

The pattern runs once over each text: texts cut at their matches are a written table, from which the values are
gathered and the new texts put together. The key is a secret of the deployment: an argument, or the setting
``spark.tallyline.pii.key``; there is no default.

Defined cases: a null text stays null with no entities; an empty one stays empty; very long texts are rewritten whole;
repeated rows get a row each; matches that overlap go to the first kind in the order of the pattern; a given name with
titles of both genders goes by the first; numbers that fail their check (cards, IBANs), version numbers and times stay;
an empty table gives an empty result; all columns of the input stay, the new one is named by the caller.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, read_table, written

#: The setting that holds the key, and a key that protects nothing, for the registered query and tests.
KEY = "spark.tallyline.pii.key"
TEST_KEY = "a key for tests, which protects nothing"
LITERAL = 5000
ROUNDS = 24

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
IPV4 = rf"(?<![\d.])(?<!(?i:\b(?:version|release|build|firmware|rev|ver|v)\.?[ :=]{{0,2}}))(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
#: Eight groups, or fewer around "::" with a digit and three groups at least, so that no name of a program is one.
IPV6 = r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*\d)(?=(?:[0-9A-Fa-f]{1,4}:+){2})(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"
IBAN = r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\p{L}\d])"
CARD = r"(?<![\d.\p{L}])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d\p{L}])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
#: With a country code; North American; national ones with a trunk prefix 0. Seven digits at least where groups vary.
PHONE = r"(?<![\w+])\+(?=(?:[ .()-]{0,2}\d){7})\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?(?:\d[ .-])?(?:\d{2}(?:[ .-]\d{2}){3,4}|\d{2,4}(?:[ .-]?\d{2,4}){1,3})(?!\d)|(?<![\w.,+-])0(?=(?:[ ./-]?\d){6,11}(?![\d]))(?:\d(?:[ .-]\d{2}){4}|[1-9]\d{8}|\d{1,4}[ /-]\d{3,8}|\d{1,4}[ /-]\d{3,4}[ -]\d{3,4})(?![\w-])|(?<![\w.,(+-])(?:1[ .-])?[2-9]\d{2} \d{3}[ -]\d{4}(?![\w-])|(?<![\w(])\(\d{3}\) ?\d{3} \d{4}(?!\d)|"
PHONE += r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[.-]\d{4}(?!\d)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])"
TOKEN_HEAD = r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
#: Published prefixes of access tokens.
TOKEN_PREFIX = "AKIA|gh[pousr]_|sk-"
TOKEN = rf"(?<!\p{{L}}){TOKEN_HEAD}[A-Za-z0-9_+/-]{{16,}}+|(?<![\w-])(?:AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|sk-[A-Za-z0-9]{{20,}}+)(?!\w)"
#: Titles that show a gender.
MALE = r"(?:Mr|Herrn?|Monsieur|Señor|Sr|Signor|г-н|господин)"
FEMALE = r"(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Signora|г-жа|госпожа)"
NAME = rf"(?<!\p{{L}})(?:{MALE}|{FEMALE})\.? \p{{Lu}}[\p{{L}}'’-]{{1,40}}(?: \p{{Lu}}[\p{{L}}'’-]{{1,40}})?"
PATTERN = "|".join((EMAIL, TOKEN, IPV4, IPV6, IBAN, CARD, SSN, PHONE, NAME))
#: A text without any of these has no match of PATTERN.
HINT = rf"[0-9@]|(?i:token|secret|passw|key)|(?:{MALE}|{FEMALE})\.? \p{{Lu}}"

#: Parts of surrogate names.
GIVEN = {
    "m": "Adam Bruno Carl David Emil Felix Gustav Hugo Ivan Jonas Karl Leon Martin Noah Oscar Paul",
    "f": "Anna Berta Clara Diana Emma Frida Greta Helen Irene Julia Katrin Laura Maria Nora Olga Petra",
    "cm": "Антон Борис Виктор Глеб Данил Егор Захар Игорь Кирилл Лев Макар Никита Олег Павел Роман Семён",
    "cf": "Анна Вера Галина Дарья Елена Жанна Зоя Инна Кира Лида Мария Нина Ольга Полина Раиса Софья",
}
SYLLABLES = "ba den fel gar hol kim lan mor nes per ros sten tal ver wil zan"
CYRILLIC_SYLLABLES = "ба вел гор дан зин кам лес мар нов пет рог сав тар ури фед чер"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.transform(F.array(value), body)[0]


def _mac(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts]), 256)


def _number(mac: Column) -> Column:
    return F.conv(F.substring(mac, 1, 15), 16, 10).cast("long")


def _power(digits: Column) -> Column:
    return F.pow(F.lit(10.0), digits).cast("long")


def _permuted(key: str, left: Column, right: Column, wide: Column, narrow: Column, tweak: Column) -> Column:
    """Four Feistel rounds on left < wide and right < narrow: struct(l, r), one to one for each tweak."""

    def turn(k: int) -> Callable[[Column], Column]:
        def left_turn(s: Column) -> Column:
            return F.struct(((s["l"] + _number(_mac(key, tweak, F.lit(k), s["r"])) % wide) % wide).alias("l"), s["r"].alias("r"))

        def right_turn(s: Column) -> Column:
            return F.struct(s["l"].alias("l"), ((s["r"] + _number(_mac(key, tweak, F.lit(k), s["l"])) % narrow) % narrow).alias("r"))

        return right_turn if k % 2 else left_turn

    state = F.struct(left.alias("l"), right.alias("r"))
    for k in range(4):
        state = _let(state, turn(k))
    return state


def _digits(key: str, value: Column, tweak: Column) -> Column:
    """A keyed permutation of digit strings of the same length (2 to 30)."""
    half = F.floor(F.length(value) / 2).cast("int")

    def of(n: Column) -> Column:
        rest = F.length(value) - n
        out = _permuted(key, F.substr(value, F.lit(1), n).cast("long"), F.substr(value, n + 1, rest).cast("long"), _power(n), _power(rest), tweak)
        return _let(out, lambda s: F.concat(F.lpad(s["l"].cast("string"), n, F.lit("0")), F.lpad(s["r"].cast("string"), rest, F.lit("0"))))

    return _let(half, of)


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn's sum; from the right, positions of parity ``doubled`` (0: the last one) are doubled."""

    def part(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 != doubled, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), part), F.lit(0), lambda a, b: a + b)


def iban_rest(characters: Column) -> Column:
    """The number modulo 97 that letters (A is 10) and digits make."""
    values = F.transform(F.split(characters, ""), lambda c: F.when(c == "", F.lit(-1)).otherwise(F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1))
    return F.aggregate(values, F.lit(0), lambda n, x: F.when(x < 0, n).when(x < 10, (n * 10 + x) % 97).otherwise((n * 100 + x) % 97))


def _pseudo(key: str, value: Column, tweak: Column) -> Column:
    """Letters to letters and digits to digits by the key; other characters stay. The first 60 characters differ."""

    def of(mac: Column) -> Column:
        letters, figures = F.translate(mac, "0123456789abcdef", "bacedifogulamern"), F.translate(mac, "abcdef", "271838")

        def char(i: Column) -> Column:
            c, at = F.substr(value, i, F.lit(1)), (i - 1) % 60 + 1
            return F.when(c.rlike("^[0-9]$"), F.substr(figures, at, F.lit(1))).when(c.rlike(r"^\p{L}$"), F.substr(letters, at, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), char), "")

    return _let(_mac(key, tweak, value), of)


def _pick(words: str, number: Column) -> Column:
    items = words.split()
    return F.element_at(F.array(*map(F.lit, items)), (number % len(items) + 1).cast("int"))


def canonical_surrogate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The canonical surrogate of a canonical value; another attempt gives another one."""
    tweak = F.concat_ws(":", kind, attempt.cast("string"))

    def email(v: Column) -> Column:
        local, host = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
        more = F.when(attempt > 1, F.substr(F.translate(_mac(key, tweak, v), "0123456789abcdef", "bacedifogulamern"), F.lit(33), attempt)).otherwise("")
        reserved = F.regexp_extract(host, r"(?:^|\.)(example\.(?:com|net|org))$", 1)
        own = F.regexp_replace(host, r"\.?example\.(?:com|net|org)$", "")
        label = F.when(reserved == "", F.concat(_pseudo(key, F.substring_index(host, ".", 1), F.lit("host")), F.lit(".example.com"))).when(own == "", reserved).otherwise(F.concat(_pseudo(key, own, F.lit("host")), F.lit("."), reserved))
        return F.concat(_pseudo(key, local, F.concat_ws(":", tweak, host)), more, F.lit("@"), label)

    def card(v: Column) -> Column:
        body = F.concat(F.left(v, F.lit(1)), _digits(key, F.substr(v, F.lit(2), F.length(v) - 2), tweak))
        return _let(body, lambda b: F.concat(b, ((10 - luhn_sum(b, 0) % 10) % 10).cast("string")))

    def phone(v: Column) -> Column:
        code, rest = F.regexp_extract(v, r"^(\+\d+ )?", 0), F.regexp_replace(v, r"^\+\d+ ", "")
        return F.concat(code, F.when(F.length(rest) > 1, _digits(key, rest, tweak)).otherwise(rest))

    def ip(v: Column) -> Column:
        octet = lambda i: F.split(v, r"\.")[i].cast("long")
        low = octet(1) * 65536 + octet(2) * 256 + octet(3)
        out = _permuted(key, F.floor(low / 4096), low % 4096, F.lit(4096), F.lit(4096), tweak)
        number = _let(out, lambda s: s["l"] * 4096 + s["r"])
        return F.concat_ws(".", octet(0).cast("string"), *[(F.floor(number / d) % 256).cast("string") for d in (65536, 256, 1)])

    def token(v: Column) -> Column:
        """To the same alphabet: hexadecimal digits, or digits, small and capital letters each to their own."""
        hexed = F.when(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit(True)).otherwise(F.lit(False))

        def of(raw: Column) -> Column:
            letters, figures = F.translate(raw, "0123456789abcdef", "kqzmwxtvjrypbdgn"), F.translate(raw, "abcdef", "271838")

            def char(i: Column) -> Column:
                c, at = F.substr(v, i, F.lit(1)), (i - 1) % 256 + 1
                small, capital = c.rlike("[a-z]"), c.rlike("[A-Z]")
                own = F.when(small, F.substr(letters, at, F.lit(1))).when(capital, F.upper(F.substr(letters, at, F.lit(1)))).when(c.rlike("[0-9]"), F.substr(figures, at, F.lit(1))).otherwise(c)
                return F.when(hexed, F.when(v.rlike("[A-F]"), F.upper(F.substr(raw, at, F.lit(1)))).otherwise(F.substr(raw, at, F.lit(1)))).otherwise(own)

            return F.array_join(F.transform(F.sequence(F.lit(1), F.length(v)), char), "")

        return _let(F.concat(*[_mac(key, tweak, v, F.lit(k)) for k in range(4)]), of)

    def iban(v: Column) -> Column:
        body = F.concat(F.substr(v, F.lit(1), F.lit(2)), F.upper(_pseudo(key, F.substr(v, F.lit(5), F.length(v)), tweak)))
        return _let(body, lambda b: F.concat(F.substr(b, F.lit(1), F.lit(2)), F.lpad((98 - iban_rest(F.concat(F.substr(b, F.lit(3), F.length(b)), F.substr(b, F.lit(1), F.lit(2)), F.lit("00")))).cast("string"), 2, "0"), F.substr(b, F.lit(3), F.length(b))))

    def ip6(v: Column) -> Column:
        raw = _mac(key, tweak, v)
        group = lambda g, i: F.when((i == 0) | (g == "0000"), g).otherwise(F.concat(F.translate(F.substr(raw, i * 4 + 1, F.lit(1)), "0", "8"), F.substr(raw, i * 4 + 2, F.lit(3))))
        return F.array_join(F.transform(F.split(v, ":"), group), ":")

    def given(v: Column, gender: str) -> Column:
        n = _number(_mac(key, tweak, v))
        more = lambda words: F.when(attempt > 0, F.concat(F.lit("-"), _pick(words, _number(_mac(key, tweak, v, F.lit("more")))))).otherwise("")
        name = lambda words: F.concat(_pick(words, n), more(words), F.when(attempt > 2, F.concat(F.lit("-"), F.initcap(_pseudo(key, v, tweak)))).otherwise(""))
        return F.when(v.rlike(r"\p{IsCyrillic}"), name(GIVEN[f"c{gender}"])).otherwise(name(GIVEN[gender]))

    def family(v: Column) -> Column:
        part = lambda words, k: _pick(words, _number(_mac(key, tweak, v, F.lit(k))))
        long = lambda words: F.concat(part(words, 0), part(words, 1), part(words, 2), F.when(attempt > 0, F.concat(part(words, 3), part(words, 4), part(words, 5))).otherwise(""))
        return F.initcap(F.when(v.rlike(r"\p{IsCyrillic}"), long(CYRILLIC_SYLLABLES)).otherwise(long(SYLLABLES)))

    return (
        F.when(kind == "email", email(value))
        .when(kind == "card", card(value))
        .when(kind == "ssn", _digits(key, value, tweak))
        .when(kind == "phone", phone(value))
        .when(kind == "ip", ip(value))
        .when(kind == "ip6", ip6(value))
        .when(kind == "iban", iban(value))
        .when(kind == "token", token(value))
        .when(kind == "given-m", given(value, "m"))
        .when(kind == "given-f", given(value, "f"))
        .when(kind == "family", family(value))
    )


def _only_digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _compact(x: Column) -> Column:
    return F.regexp_replace(x, " ", "")


def kind_of(match: Column) -> Column:
    """The type of a match, or null for a number that fails its check. What is no match of PATTERN is a known name."""
    whole = lambda p: match.rlike(f"^(?:{p})$")
    number, iban = _only_digits(match), _compact(match)
    right = iban_rest(F.concat(F.substr(iban, F.lit(5), F.length(iban)), F.substr(iban, F.lit(1), F.lit(4)))) == 1
    return (
        F.when(match.contains("@") & whole(EMAIL), "email")
        .when(whole(TOKEN), "token")
        .when(whole(IPV4), "ip")
        .when(whole(IPV6), "ip6")
        .when(whole(IBAN), F.when(right, "iban"))
        .when(whole(CARD), F.when(luhn_sum(number, 1) % 10 == 0, "card"))
        .when(whole(SSN), "ssn")
        .when(whole(PHONE), "phone")
        .when(whole(NAME), F.when(match.rlike(rf"^{MALE}\.? "), "name-m").otherwise("name-f"))
        .otherwise("known")
    )


def _token_parts(match: Column) -> tuple[Column, Column]:
    head = F.regexp_extract(match, f"^(?:{TOKEN_HEAD})?(?:{TOKEN_PREFIX})?", 0)
    return head, F.substr(match, F.length(head) + 1, F.length(match))


def _name_parts(match: Column) -> tuple[Column, Column, Column]:
    """The title with its blank, the given name or nothing, and the family name."""
    title = F.regexp_extract(match, rf"^(?:{MALE}|{FEMALE})\.? ", 0)
    names = F.split(F.substr(match, F.length(title) + 1, F.length(match)), " ")
    return title, F.when(F.size(names) > 1, names[0]).otherwise(""), F.element_at(names, -1)


def names_of(matches: Column) -> Column:
    """The names after titles: array of struct(gender, given (or empty), family), each once."""

    def one(m: Column) -> Column:
        _, given, family = _name_parts(m)
        return F.struct(F.when(m.rlike(rf"^{MALE}\.? "), "m").otherwise("f").alias("gender"), given.alias("given"), family.alias("family"))

    return F.array_distinct(F.transform(F.filter(matches, lambda m: m.rlike(f"^(?:{MALE}|{FEMALE})\\.? ")), one))


def mentions_of(names: Column) -> Column:
    """The pattern of the names without a title: whole first, then each part by itself."""
    quoted = lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))
    whole = F.transform(F.filter(names, lambda n: n["given"] != ""), lambda n: F.concat(quoted(n["given"]), F.lit(" "), quoted(n["family"])))
    parts = F.concat(F.transform(names, lambda n: n["family"]), F.filter(F.transform(names, lambda n: n["given"]), lambda g: g != ""))
    parts = F.transform(F.array_distinct(parts), quoted)
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.concat(whole, parts), "|"), F.lit(r")(?![\p{L}\p{N}])"))


def ip6_groups(match: Column) -> Column:
    """All eight groups of four hexadecimal digits, joined by colons."""
    low = F.lower(match)
    left, right = (F.filter(F.split(F.substring_index(low, "::", k), ":"), lambda g: g != "") for k in (1, -1))
    every = F.when(low.contains("::"), F.concat(left, F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right)), right)).otherwise(left)
    return F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ":")


def values_of(match: Column, known: Column) -> Column:
    """The array of struct(kind, value) of a match: canonical values with their own surrogates; empty if it is none.

    ``known`` are the names that the text shows with a title.
    """
    one = lambda k, v: F.array(F.struct(F.lit(k).alias("kind"), v.alias("value")))
    code = F.regexp_extract(match, r"^\+\d{1,3}(?=\D)", 0)
    phone = F.when(code == "", F.concat(F.regexp_extract(match, r"^\+", 0), _only_digits(match))).otherwise(F.concat(code, F.lit(" "), _only_digits(F.substr(match, F.length(code) + 1, F.length(match)))))
    _, given, family = _name_parts(match)
    last = F.struct(F.lit("family").alias("kind"), F.lower(family).alias("value"))
    first = lambda gender, name: F.struct(F.concat(F.lit("given-"), gender).alias("kind"), F.lower(name).alias("value"))
    gender_of = lambda name: F.get(F.filter(known, lambda n: n["given"] == name), F.lit(0))["gender"]

    def names(gender: str) -> Column:
        return F.when(given == "", F.array(last)).otherwise(F.array(first(F.lit(gender), given), last))

    def untitled() -> Column:
        alone = F.when(F.exists(known, lambda n: n["family"] == family), F.array(last)).otherwise(F.array(first(gender_of(family), family)))
        return F.when(given == "", alone).otherwise(F.array(first(gender_of(given), given), last))

    def of(kind: Column) -> Column:
        return (
            F.when(kind == "email", one("email", F.lower(match)))
            .when(kind == "token", one("token", _token_parts(match)[1]))
            .when(kind == "ip", one("ip", match))
            .when(kind == "ip6", one("ip6", ip6_groups(match)))
            .when(kind == "iban", one("iban", _compact(match)))
            .when(kind == "card", one("card", _only_digits(match)))
            .when(kind == "ssn", one("ssn", _only_digits(match)))
            .when(kind == "phone", one("phone", F.regexp_replace(phone, r"^\+(\d{2,})$", "$1")))
            .when(kind == "name-m", names("m"))
            .when(kind == "name-f", names("f"))
            .when(kind == "known", untitled())
            .otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
        )

    return _let(kind_of(match), of)


def _in_case(like: Column, text: Column) -> Column:
    return F.when((like == F.upper(like)) & (like != F.lower(like)), F.upper(text)).otherwise(text)


def _filled(like: Column, digits: Column) -> Column:
    """The mention ``like`` with its digits replaced in order."""
    return F.array_join(F.transform(F.split(like, r"\d"), lambda p, i: F.concat(p, F.substr(digits, i + 1, F.lit(1)))), "")


def _ip6_written(like: Column, groups: Column) -> Column:
    """The groups in the form of the mention: what it leaves out or writes short stays so."""
    own, shown = F.split(groups, ":"), F.split(like, ":")
    n, gap = F.size(shown), F.array_position(shown, "")
    place = lambda i: F.when((gap == 0) | (i + 1 < gap), i).otherwise(F.size(own) - n + i)
    short = lambda g, new: F.when(g == "", "").when(F.length(g) == 4, new).otherwise(F.regexp_replace(new, "^0{1,3}", ""))
    text = F.array_join(F.transform(shown, lambda g, i: short(g, F.get(own, place(i).cast("int")))), ":")
    return F.when(like.rlike("[A-F]"), F.upper(text)).otherwise(text)


def _refilled(like: Column, characters: Column) -> Column:
    """The mention ``like`` with its letters and digits replaced in order."""
    return F.array_join(F.transform(F.split(like, "[A-Za-z0-9]"), lambda p, i: F.concat(p, F.substr(characters, i + 1, F.lit(1)))), "")


def written_surrogate(match: Column, values: Column, surrogates: Column) -> Column:
    """The replacement of a mention, given its values and their canonical surrogates."""
    kind, first = values[0]["kind"], surrogates[0]
    head, _ = _token_parts(match)
    title, given, family = _name_parts(match)
    code = F.regexp_extract(match, r"^\+\d{1,3}(?=\D)", 0)
    phone = F.when(code == "", _filled(match, _only_digits(first))).otherwise(F.concat(code, _filled(F.substr(match, F.length(code) + 1, F.length(match)), F.regexp_replace(first, r"^\+\d+ ", ""))))
    name = F.when(given == "", F.concat(title, _in_case(family, first))).otherwise(F.concat(title, _in_case(given, first), F.lit(" "), _in_case(family, F.element_at(surrogates, -1))))
    return (
        F.when(F.size(values) == 0, match)
        .when(kind == "email", _in_case(match, first))
        .when(kind == "token", F.concat(head, first))
        .when(kind == "ip", first)
        .when(kind == "ip6", _ip6_written(match, first))
        .when(kind == "iban", _refilled(match, first))
        .when(kind.isin("card", "ssn"), _filled(match, first))
        .when(kind == "phone", phone)
        .otherwise(name)
    )


#: A character that stands around each match in a marked text, and two that write those that the text itself has.
_MARK, _ESCAPE = "\x03", "\x01"


def cut(text: Column) -> Column:
    """The text cut at the matches of PATTERN: what stands between them at even places, matches at odd ones."""
    own = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "\x02")), F.lit(_MARK), F.lit(_ESCAPE + "\x04"))
    safe = F.when(text.contains(_MARK) | text.contains(_ESCAPE), own).otherwise(text)
    marked = F.when(text.rlike(HINT), F.regexp_replace(safe, PATTERN, f"{_MARK}$0{_MARK}")).otherwise(safe)
    return F.split(marked, _MARK, -1)


def cut_again(parts: Column, pattern: Column) -> Column:
    """The parts, those between matches cut at the matches of ``pattern`` as well."""
    between = lambda p: F.split(F.regexp_replace(p, pattern, F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    return F.flatten(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.array(p)).otherwise(between(p))))


def whole(text: Column) -> Column:
    own = F.replace(F.replace(text, F.lit(_ESCAPE + "\x04"), F.lit(_MARK)), F.lit(_ESCAPE + "\x02"), F.lit(_ESCAPE))
    return F.when(text.contains(_ESCAPE), own).otherwise(text)


def _folded(kind: Column, surrogate: Column) -> Column:
    """What must differ between values: case counts for tokens only."""
    return F.when(kind == "token", surrogate).otherwise(F.lower(surrogate))


def attempts(values: DataFrame, key: str) -> DataFrame:
    """kind, value and attempt (over 0) of the values whose first surrogate collides; ``values`` are distinct."""
    kind, value = F.col("kind"), F.col("value")
    originals = values.select(kind.alias("_kind"), _folded(kind, value).alias("_value")).distinct()
    now = written(values.select("kind", "value", F.lit(0).alias("attempt")).withColumn("surrogate", _folded(kind, canonical_surrogate(key, kind, value, F.lit(0)))), "pii-surrogates")
    for _ in range(ROUNDS):
        shared = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "value")) > 1
        real = now.withColumn("_shared", shared).join(originals, (kind == F.col("_kind")) & (F.col("surrogate") == F.col("_value")), "left")
        again = real.select("kind", "value", "attempt", "surrogate", (F.col("_shared") | F.col("_value").isNotNull()).alias("again"))
        checked = written(again, "pii-checked")
        discard(now)
        if checked.filter("again").limit(1).count() == 0:
            return checked.filter("attempt > 0").select("kind", "value", "attempt")
        bumped = F.col("attempt") + F.col("again").cast("int")
        renewed = F.when(F.col("again"), _folded(kind, canonical_surrogate(key, kind, value, bumped))).otherwise(F.col("surrogate"))
        now = written(checked.select("kind", "value", bumped.alias("attempt"), renewed.alias("surrogate")), "pii-surrogates")
        discard(checked)
    raise RuntimeError("surrogates still collide; use another key")


def _name_key(v: Column) -> Column:
    return F.concat(v["kind"], F.lit(" "), v["value"])


def rewritten(docs: DataFrame, key: str | None = None, literal: int = LITERAL, kinds: str = "kinds") -> DataFrame:
    """``docs`` with surrogates in ``text``, and in the column ``kinds`` the kind of each replaced value in order.

    All other columns stay; those that come and go here have names of their own.
    """
    key = key or docs.sparkSession.conf.get(KEY, None)
    if not key:
        raise ValueError(f"give a secret key, or set {KEY}")
    own = {n: f"_{n}_{uuid.uuid4().hex}" for n in ("again", "parts", "names", "found", "doc", "digest")}
    parts, names = F.col(own["parts"]), F.col(own["names"])
    rows = docs.withColumn(own["parts"], cut(F.col("text").cast("string"))).drop("text")
    rows = rows.withColumn(own["names"], names_of(F.filter(parts, lambda p, i: i % 2 == 1)))
    rows = rows.withColumn(own["parts"], F.when(F.size(names) > 0, cut_again(parts, mentions_of(names))).otherwise(parts))
    found = F.transform(F.filter(parts, lambda p, i: i % 2 == 1), lambda m: F.struct(m.alias("m"), values_of(m, names).alias("v")))
    rows = rows.withColumn(own["found"], found).withColumn(own["parts"], F.filter(parts, lambda p, i: i % 2 == 0)).drop(own["names"])
    rows = written(rows, "pii-parts")
    told = lambda *more: rows.filter(F.size(own["found"]) > 0).select(*more, F.explode(F.flatten(F.transform(own["found"], lambda p: p["v"]))).alias("v")).select(*more, "v.*").distinct()
    again = attempts(written(told(), "pii-values"), key)
    if again.limit(literal + 1).count() <= literal:
        tries = {f"{r['kind']} {r['value']}": r["attempt"] for r in again.collect()}
        rows = rows.withColumn(own["again"], F.from_json(F.lit(json.dumps(tries)), "map<string,int>"))
    else:
        digest = F.xxhash64(F.array_join(F.col(own["parts"]), _MARK), F.array_join(F.transform(own["found"], lambda p: p["m"]), _MARK))
        rows = rows.withColumn(own["digest"], digest)
        names_here = {"doc_id": own["doc"], own["digest"]: own["digest"] + "_"}
        mentions = told("doc_id", own["digest"]).withColumnsRenamed(names_here)
        maps = mentions.join(again, ["kind", "value"]).groupBy(*names_here.values()).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "kind", "value"), "attempt"))).alias(own["again"]))
        rows = rows.join(maps, F.col("doc_id").eqNullSafe(F.col(own["doc"])) & (F.col(own["digest"]) == F.col(own["digest"] + "_")), "left").drop(own["digest"], *names_here.values())
    tried = lambda v: F.coalesce(F.try_element_at(F.col(own["again"]), _name_key(v)), F.lit(0))
    surrogates = lambda vs: F.transform(vs, lambda v: _let(tried(v), lambda t: canonical_surrogate(key, v["kind"], v["value"], t)))
    new = F.transform(own["found"], lambda p, i: F.concat(_let(surrogates(p["v"]), lambda s: written_surrogate(p["m"], p["v"], s)), F.get(parts, i + 1)))
    told_kinds = F.coalesce(F.flatten(F.transform(own["found"], lambda p: F.transform(p["v"], lambda v: v["kind"]))), F.array().cast("array<string>"))
    done = rows.withColumn(kinds, told_kinds).withColumn("text", whole(F.when(F.size(own["found"]) > 0, F.concat(parts[0], F.array_join(new, ""))).otherwise(parts[0])))
    return done.select(*docs.columns, kinds)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with surrogates, and the number of replaced values, in all and of each group of kinds."""
    done = rewritten(read_table(spark, sf_dir, "documents"), spark.conf.get(KEY, TEST_KEY))
    of = lambda *k: F.size(F.filter("kinds", lambda x: x.isin(*k))).cast("long")
    return done.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.size("kinds").cast("long").alias("n_values"),
        of("email").alias("n_email"),
        of("phone").alias("n_phone"),
        of("ip", "ip6").alias("n_ip"),
        of("iban").alias("n_iban"),
        of("card").alias("n_card"),
        of("ssn").alias("n_ssn"),
        of("token").alias("n_token"),
        of("given-m", "given-f", "family").alias("n_name"),
    )
