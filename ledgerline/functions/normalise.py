"""Normalisers of names, codes, money, counts, identifiers and dates."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters without a shape of their own that text may carry.
INVISIBLE = "​‌‍⁠﻿­‎‏"
#: Words of headings, which alone make no organisation.
HEADINGS = (
    "address", "buyer", "consignee", "date", "description", "exporter", "importer", "invoice", "number", "packing", "quantity", "seller", "shipper", "total", "name", "names", "details", "detail", "information", "particulars",
    "contact", "reference", "no", "code", "and", "or", "of",
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def bound(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``x``, with ``x`` computed once however often it is named; an array of one binds it, also within a lambda."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


@F.pandas_udf(StringType())  # a type, not its name: workers that import this have no session
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility fold, for which there is no built-in."""
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def text(x: Column) -> Column:
    """Fold, drop invisible characters, collapse blanks, and three newlines or more to two."""
    folded = F.regexp_replace(nfkc(x), f"[{INVISIBLE}]", "")
    return F.regexp_replace(F.regexp_replace(folded, r"[ \t\x0B\f]+", " "), r"\n{3,}", "\n\n")


def product(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def pct_strict(x: Column) -> Column:
    return F.when(F.trim(x).rlike(r"^\d{4}\.?\d{4}$"), F.replace(F.trim(x), F.lit("."), F.lit("")))


def pct_token(x: Column) -> Column:
    """The first code in a text; else all its digits, if they are eight."""
    found = F.regexp_extract(x, r"\b(\d{4}\.?\d{4})\b", 1)
    digits = F.regexp_replace(x, r"\D", "")
    return F.when(found != "", F.replace(found, F.lit("."), F.lit(""))).when(F.length(digits) == 8, digits)


def pct_capture(x: Column) -> Column:
    return bound(F.regexp_replace(x, r"\D", ""), lambda digits: F.when(F.length(digits).isin(8, 6, 4), digits))


def money(x: Column) -> Column:
    """A number of at most two decimals, without currency, unit, commas and blanks; else null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(x), r"^(?i:usd|eur|gbp|pkr|rs\.?|us\$|\$)\s*|\s*(?i:usd|eur|gbp|pkr|kgs?|kg)\.?$", ""), r"[,\s]", "")
    return bound(bare, lambda b: F.when(b.rlike(r"^\d+(\.\d{1,2})?$"), b.cast("decimal(18,2)")))


def count(x: Column) -> Column:
    found = F.regexp_extract(F.trim(x), r"^(\d[\d,]*)\s*[A-Za-z]*$", 1)
    return bound(found, lambda n: F.when(n != "", F.replace(n, F.lit(","), F.lit("")).cast("int")))


def identifier(x: Column) -> Column:
    return bound(F.regexp_replace(F.trim(x), r"[\s.,;:]+$", ""), lambda bare: F.when(bare.rlike(r"\d"), bare))


def organisation(x: Column) -> Column:
    """Blanks collapsed, outer punctuation off; null without two letters in a row, or if all are headings."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(x), r"\s+", " "), r"^[\s.,;:\-]+|[\s.,;:\-]+$", "")
    own = rf"(?<![a-z])(?!(?:{'|'.join(HEADINGS)})(?![a-z]))[a-z]"  # a word that is no heading
    return bound(bare, lambda b: F.when(b.rlike("[A-Za-z]{2}") & F.lower(b).rlike(own), b))


def country(x: Column) -> Column:
    return bound(F.trim(F.regexp_replace(x, r"\s+", " ")), lambda bare: F.when(bare.rlike(r"^[A-Za-z][A-Za-z .'\-]{1,40}$"), bare))


def upper_token(x: Column) -> Column:
    return F.upper(F.trim(x))


def _day(y: Column, m: Column, d: Column) -> Column:
    y, m, d = (x.try_cast("int") for x in (y, m, d))
    # a day that can't be is settled before it is read, which would raise and catch an error for each
    return F.when(y.between(0, 9999) & m.between(1, 12) & d.between(1, 31), F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), m.cast("string"), d.cast("string")).try_cast("date"))


def date_parts(x: Column) -> Column:
    """struct(date, ambiguous, reason): ISO, spelled months either way round, numbers with / . or -.

    Numbers that could be day-month or month-day, and differ, are null and ambiguous. Years of two
    digits are 2000 on up to 79, then 1900.
    """
    year = lambda y: F.when(F.length(y) == 2, F.when(y.try_cast("int") < 80, y.try_cast("int") + 2000).otherwise(y.try_cast("int") + 1900)).otherwise(y.try_cast("int"))
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    first, second = r"^(\d{1,2})[\s\-]+([a-z]{3})[a-z]*\.?,?[\s\-]+(\d{4}|\d{2})$", r"^([a-z]{3})[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4}|\d{2})$"
    plain = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})$"
    month = lambda m: F.array_position(F.array(*map(F.lit, MONTHS)), m)

    def readings(s: Column) -> Column:
        part = lambda r, k: F.regexp_extract(s, r, k)
        spelled = F.coalesce(
            F.when(s.rlike(iso), _day(part(iso, 1), part(iso, 2), part(iso, 3))), F.when(s.rlike(first), _day(year(part(first, 3)), month(part(first, 2)), part(first, 1))),
            F.when(s.rlike(second), _day(year(part(second, 3)), month(part(second, 1)), part(second, 2))),
        )
        numbers = s.rlike(plain)
        dmy, mdy = F.when(numbers, _day(year(part(plain, 3)), part(plain, 2), part(plain, 1))), F.when(numbers, _day(year(part(plain, 3)), part(plain, 1), part(plain, 2)))
        return F.struct(spelled.alias("spelled"), dmy.alias("dmy"), mdy.alias("mdy"))

    def settled(r: Column) -> Column:
        ambiguous = F.coalesce(r["dmy"] != r["mdy"], F.lit(False))
        found = F.coalesce(r["spelled"], F.when(~ambiguous, F.coalesce(r["dmy"], r["mdy"])))
        reason = F.when(ambiguous, "day and month can be exchanged").when(found.isNull(), "not a date")
        return F.struct(found.alias("date"), ambiguous.alias("ambiguous"), reason.alias("reason"))

    return bound(bound(F.lower(F.trim(x)), readings), settled)


def confusable(x: Column) -> Column:
    """Letters that a scan may have put for digits; flagged, never rewritten."""
    return F.coalesce(x.rlike(r"[OoQDIl|ZSBG]"), F.lit(False))


def company(x: Column) -> Column:
    """Letter-spacing joined, words of letters and digits, private as pvt, limited as ltd."""
    joined = F.regexp_replace(F.lower(x), r"(?<=\b[a-z]) (?=[a-z]\b)", "")
    words = F.filter(F.split(joined, "[^a-z0-9]+"), lambda w: w != "")
    short = F.transform(words, lambda w: F.when(w == "private", "pvt").when(w == "limited", "ltd").otherwise(w))
    return F.array_join(short, " ")


def plain(x: Column) -> Column:
    """Blanks collapsed, lower case, one trailing period off."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))), r"\.$", "")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def same(a: Column, b: Column) -> Column:
    """Two values mean the same: as numbers if both are, else as trimmed text without case."""
    x, y = a.try_cast("decimal(38,6)"), b.try_cast("decimal(38,6)")
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(x.isNotNull() & y.isNotNull(), x == y).otherwise(F.lower(F.trim(a)) == F.lower(F.trim(b)))
