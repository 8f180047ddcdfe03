"""Vehicle identification numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .url import _let, normalize_detail_url, pairs, path, query

SURROGATE = "URLKEY"
#: The letters of surrogates, and the standard's letter values and weights.
ALPHABET = "0123456789ABCDEFGHJKLMNPRSTUVWXY"
LETTERS = "0123456789ABCDEFGHJKLMNPRSTUVWXYZ"
VALUES = "012345678912345678123457923456789"
WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)


def clean_vin(c: Column) -> Column:
    """The first 17 characters that can be a VIN, in upper case; weak look-alikes are null."""

    def strong(t: Column, found: Column) -> Column:
        weak = found.rlike(r"^\d+$") | found.rlike("^[A-Z]+$") | (F.size(F.array_distinct(F.split(found, ""))) < 5)
        template = t.contains("{{") | t.contains("}}") | t.contains("${")
        return F.when((found != "") & ~template & (found.startswith(SURROGATE) | ~weak), found)

    return _let(F.upper(F.trim(c)), lambda t: _let(F.regexp_extract(t, r"(?<![A-Z0-9])([A-HJ-NPR-Z0-9]{17})(?![A-Z0-9])", 1), lambda found: strong(t, found)))


def is_surrogate(c: Column) -> Column:
    return F.coalesce((F.length(c) == 17) & F.upper(c).startswith(SURROGATE), F.lit(False))


def check_digit_ok(c: Column) -> Column:
    """Whether the ninth character is the standard's check digit."""
    v = F.upper(F.trim(c))
    digits = F.translate(v, LETTERS, VALUES)
    total = sum((F.substring(digits, i + 1, 1).try_cast("int") * w for i, w in enumerate(WEIGHTS)), F.lit(0))
    rest = F.pmod(total, F.lit(11))
    want = F.when(rest == 10, "X").otherwise(rest.cast("string"))
    return F.coalesce(v.rlike("^[A-HJ-NPR-Z0-9]{17}$") & (F.substring(v, 9, 1) == want), F.lit(False))


def vin_from_url(u: Column) -> Column:
    """A VIN in a query key named for it, else a part of the path that is one with a right check digit."""
    keyed = F.filter(F.transform(F.filter(pairs(query(u)), lambda p: p["key"].rlike("(?i)(?:^|[^a-z])vin(?:[^a-z]|$)")), lambda p: clean_vin(p["value"])), lambda v: v.isNotNull())
    # a check digit is long to compute: only of parts of the right length
    long = F.filter(F.split(path(u), "[/_.-]"), lambda s: F.length(F.upper(F.trim(s))) == 17)
    parts = F.filter(long, lambda s: F.coalesce((clean_vin(s) == F.upper(F.trim(s))) & check_digit_ok(s), F.lit(False)))
    return F.coalesce(F.get(keyed, F.lit(0)), F.upper(F.get(parts, F.lit(0))))


def _times(a: Column, b: int) -> Column:
    """The low 32 bits of a product of 32-bit numbers, without leaving 64 bits."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * F.lit(b)
    high = F.shiftright(a, 16) * F.lit(b)
    return (low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def surrogate_vin(u: Column) -> Column:
    """A stable 17-character key of a detail URL, from two 32-bit hashes over its UTF-16 units."""
    letters = lambda h, n: F.concat(*(F.substr(F.lit(ALPHABET), F.shiftright(h, 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for k in range(n)))

    def hashes(raw: Column) -> Column:
        units = F.transform(
            F.when(F.length(raw) > 0, F.sequence(F.lit(0), (F.length(raw) / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.conv(F.concat(F.substr(raw, i * 4 + 3, F.lit(2)), F.substr(raw, i * 4 + 1, F.lit(2))), 16, 10).cast("bigint"),
        )
        return F.aggregate(
            F.transform(units, lambda x, i: F.struct(x.alias("x"), i.cast("bigint").alias("i"))),
            F.struct(F.lit(0x811C9DC5).cast("bigint").alias("a"), F.lit(0x01000193).cast("bigint").alias("b")),
            lambda s, p: F.struct(_times(s["a"].bitwiseXOR(p["x"]), 0x01000193).alias("a"), _times(s["b"].bitwiseXOR(p["x"] + p["i"] + 1), 0x85EBCA6B).alias("b")),
        )

    # the URL, its units and their hashes are each evaluated once
    key = lambda raw: F.when(raw.isNotNull(), _let(hashes(raw), lambda both: F.concat(F.lit(SURROGATE), letters(both["a"], 6), letters(both["b"], 5))))
    return _let(F.hex(F.encode(normalize_detail_url(u), "UTF-16LE")), key)
