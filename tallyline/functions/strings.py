"""String and regular expression functions (1-based, by code point)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import trim  # noqa: F401  (part of this module's functions)


def java_regex(pattern: str) -> str:
    """A pattern of linear-time dialects for Java: named groups and absolute anchors differ."""
    return re.sub(r"\(\?P<", "(?<", pattern)


def quote(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|/-])", r"\\\1", text)


def length(s: Column) -> Column:
    return F.length(s)


def substr(s: Column, start: Column | int, n: Column | int | None = None) -> Column:
    """From ``start`` (below 1: from 1, without shortening), at most ``n`` characters (below 0: none)."""
    start = F.lit(start) if isinstance(start, int) else start
    first = F.greatest(start.cast("int"), F.lit(1))
    if n is None:
        return F.substr(s, first)
    n = F.lit(n) if isinstance(n, int) else n
    return F.substr(s, first, F.greatest(n.cast("int"), F.lit(0)))


def index(s: Column, t: Column | str) -> Column:
    """The position of t in s, 0 without, 1 if t is empty."""
    t = F.lit(t) if isinstance(t, str) else t
    return F.position(t, s)


def ltrim(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+", "")


def rtrim(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\s+$", "")


def starts(s: Column, t: str) -> Column:
    return s.startswith(t).cast("int")


def ends(s: Column, t: str) -> Column:
    return s.endswith(t).cast("int")


def character(n: Column) -> Column:
    """The character of a code point (any plane)."""
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0")), "UTF-32")


def code_point(s: Column) -> Column:
    return F.ascii(s)


def hexadecimal(n: Column) -> Column:
    """0x and lower-case digits, two's complement if negative."""
    return F.concat(F.lit("0x"), F.lower(F.hex(n.cast("bigint"))))


def lpad(s: Column, width: int, fill: str = " ") -> Column:
    """Never cuts."""
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, fill[:1]))


def rpad(s: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.length(s) >= width, s).otherwise(F.rpad(s, width, fill[:1]))


def gsub(s: Column, pattern: str, replacement: str) -> Column:
    """All matches replaced; & stands for the match, \\& for an ampersand."""
    return F.regexp_replace(s, java_regex(pattern), _java_replacement(replacement))


def gsub_count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(java_regex(pattern)))


def _java_replacement(r: str) -> str:
    out = []
    k = 0
    while k < len(r):
        if r[k] == "\\" and k + 1 < len(r):
            out.append("&" if r[k + 1] == "&" else "\\\\" if r[k + 1] == "\\" else r[k + 1])
            k += 1
        else:
            out.append("$0" if r[k] == "&" else "\\$" if r[k] == "$" else r[k])
        k += 1
    return "".join(out)


def sub(s: Column, pattern: str, replacement: str) -> Column:
    """The first match replaced."""
    java = java_regex(pattern)
    at = F.regexp_instr(s, F.lit(java))
    found = F.regexp_extract(s, java, 0)
    new = F.regexp_replace(found, rf"(?s)\A.*\z", _java_replacement(replacement))  # noqa: F541
    return F.when(at > 0, F.concat(F.substr(s, F.lit(1), at - 1), F.when(found == "", _replaced_empty(replacement)).otherwise(new), F.substr(s, at + F.length(found)))).otherwise(s)


def _replaced_empty(replacement: str) -> Column:
    return F.lit(re.sub(r"(?<!\\)&", "", replacement).replace("\\&", "&"))


def gsub_literal(s: Column, find: str, replacement: str) -> Column:
    return F.replace(s, F.lit(find), F.lit(replacement))


def gensub(pattern: str, replacement: str, how: str | int, s: Column) -> Column:
    """``how`` "g": all, with $1 groups; n: the n-th match; 0: unchanged."""
    java = java_regex(pattern)
    if str(how)[:1] in ("g", "G"):
        return F.regexp_replace(s, java, replacement)
    n = int(how)
    if n <= 0:
        return s
    parts, found = F.split(s, java, -1), F.regexp_extract_all(s, F.lit(java), F.lit(0))
    joined = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.when(i == n - 1, F.lit(replacement)).otherwise(F.coalesce(F.get(found, i), F.lit(""))))), "")
    return F.when(F.size(found) >= n, joined).otherwise(s)


def match_start(s: Column, pattern: str) -> Column:
    """The 1-based place of the first match, 0 without."""
    return F.regexp_instr(s, F.lit(java_regex(pattern)))


def match_length(s: Column, pattern: str) -> Column:
    """The first match's length, -1 without a match."""
    return F.when(match_start(s, pattern) > 0, F.length(F.regexp_extract(s, java_regex(pattern), 0))).otherwise(-1)


def match_group(s: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(s, java_regex(pattern), group)


def split(s: Column, sep: str | None = None, regex: bool = False) -> Column:
    """Parts of s: by white space (None or " "), a literal separator, or a regular expression."""
    if sep is None or sep == " ":
        bare = F.btrim(s, F.lit(" \t\n\x0b\f\r"))
        return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"\s+"))
    return F.split(s, java_regex(sep) if regex else quote(sep), -1)


#: Names and their pictographs.
_PICTOGRAPHS = """
    anchor ⚓ ant 🐜 apple 🍎 apricot 🍑 art 🎨 avocado 🥑 banana 🍌 battery 🔋 bean 🫘 bee 🐝 beer 🍺 bell 🔔 bird 🐦 bomb 💣
    book 📖 boom 💥 bread 🍞 broccoli 🥦 bug 🐛 burger 🍔 butterfly 🦋 cactus 🌵 cake 🎂 candy 🍬 carrot 🥕 cat 🐱 cheese 🧀
    cherry 🍒 chestnut 🌰 chocolate 🍫 cloud ☁️ clover ☘️ coconut 🥥 coffee ☕ cookie 🍪 corn 🌽 crab 🦀 crown 👑 cucumber 🥒
    date 🌴 diamond 💎 dice 🎲 dog 🐶 dolphin 🐬 donut 🍩 drum 🥁 earth 🌍 egg 🥚 eggplant 🍆 elderberry 🫐 fig 🍈 fire 🔥 fish 🐟
    flag 🚩 flower 🌸 fox 🦊 frog 🐸 garlic 🧄 gear ⚙️ grape 🍇 guitar 🎸 hammer 🔨 heart ❤️ herb 🌿 honey 🍯 key 🔑 kiwi 🥝
    leaf 🍃 lemon 🍋 lettuce 🥬 light 💡 lightning ⚡ lock 🔒 mango 🥭 map 🗺️ melon 🍈 microscope 🔬 milk 🥛 moon 🌙 mountain ⛰️
    mushroom 🍄 music 🎵 octopus 🐙 onion 🧅 orange 🍊 owl 🦉 peach 🍑 peanut 🥜 pear 🍐 penguin 🐧 pepper 🌶️ pie 🥧 pineapple 🍍
    pizza 🍕 popcorn 🍿 potato 🥔 puzzle 🧩 rainbow 🌈 rice 🍚 rocket 🚀 rose 🌹 salt 🧂 scroll 📜 shield 🛡️ shrimp 🦐 snail 🐌
    snake 🐍 snow ❄️ spider 🕷️ star ⭐ strawberry 🍓 sun ☀️ sunflower 🌻 sushi 🍣 sword ⚔️ taco 🌮 tea 🍵 telescope 🔭
    tomato 🍅 tornado 🌪️ tree 🌳 trophy 🏆 tulip 🌷 turtle 🐢 volcano 🌋 water 💧 watermelon 🍉 wave 🌊 whale 🐋 wind 💨 wine 🍷
    wrench 🔧
"""
EMOJI = dict(zip(_PICTOGRAPHS.split()[::2], _PICTOGRAPHS.split()[1::2], strict=True))


def emoji(name: Column) -> Column:
    """The pictograph of a name, whatever its case and surroundings, also in the plural; other text passes."""
    table = F.create_map(*[F.lit(x) for pair in EMOJI.items() for x in pair])
    low = F.lower(F.btrim(name, F.lit(" \t\n\x0b\f\r")))
    plural = lambda end, least: F.when(low.endswith(end) & (F.length(low) > least), F.try_element_at(table, F.left(low, F.length(low) - len(end))))
    return F.coalesce(F.try_element_at(table, low), plural("s", 2), plural("es", 3), name)
