"""Folding, identity keys and stable ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .checks import digits

#: Categories whose identity is their digits.
DIGIT_CATEGORIES = ("PHONE", "CARD", "SNILS", "INN_PERSON", "INN_ORG", "OGRN", "PASSPORT", "OMS", "DRIVER_LICENSE", "BANK_ACCOUNT")


def fold(value: Column) -> Column:
    """The key of every dictionary lookup: caseless, е for ё, ss for ß, without the combining acute."""
    return F.replace(F.replace(F.translate(F.lower(value), "ё́", "е"), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def spaced(value: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def identity_key(category: Column, value: Column) -> Column:
    """One value in different spellings has one key."""
    d = digits(value)
    return (
        F.when((category == "PHONE") & (F.length(d) > 10), F.right(d, F.lit(10)))
        .when(category.isin(*DIGIT_CATEGORIES), d)
        .when(category == "EMAIL", F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")))
        .when(category == "SECRET", F.left(F.sha2(value, 256), F.lit(20)))
        .otherwise(spaced(fold(value)))
    )


def finding_id(*parts: Column) -> Column:
    """24 upper-case hex digits of the SHA-256 of the parts, joined by NUL."""
    return F.upper(F.left(F.sha2(F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts)), 256), F.lit(24)))


def person_id(surname: Column, given: Column, patronymic: Column) -> Column:
    return F.concat(F.lit("LOCAL"), F.upper(F.left(F.sha2(fold(F.concat_ws("|", *(F.coalesce(x, F.lit("")) for x in (surname, given, patronymic)))), 256), F.lit(19))))


def initials_id(surname: Column, letters: Column) -> Column:
    """Of somebody whom the documents only abbreviate; letters is an array."""
    return F.concat(F.lit("INIT"), F.upper(F.left(F.sha2(F.concat(fold(surname), F.lit("|"), F.array_join(F.transform(letters, fold), "")), 256), F.lit(20))))


def is_cyrillic(value: Column) -> Column:
    return value.rlike("[Ѐ-ӿ]")


def is_latin(value: Column) -> Column:
    return value.rlike("[A-Za-z]")


def strip_header_codes(value: Column) -> Column:
    """Spreadsheet header codes (&L, &C, &R) blanked out; lengths stay."""
    return F.regexp_replace(value, "&[LCR]", "  ")
