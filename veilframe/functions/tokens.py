"""Tokens: the readable pseudonyms, their grammar, and how they are read back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Kind:
    code: str
    stem: str
    group: str


# Kinds, in report order, and what the token grammar depends on.
KINDS = (
    Kind("PERSON", "Name", "names"),
    Kind("ORG", "Company", "companies"),
    Kind("PROJECT", "Project", "projects"),
    Kind("CITY", "City", "places"),
    Kind("REGION", "Region", "places"),
    Kind("COUNTRY", "Country", "places"),
    Kind("ADDRESS", "Address", "places"),
    Kind("EMAIL", "Email", "contacts"),
    Kind("PHONE", "Phone", "contacts"),
    Kind("USERNAME", "Handle", "contacts"),
    Kind("DOMAIN", "Domain", "contacts"),
    Kind("FILE", "File", "files"),
    Kind("CONTRACT", "Contract", "documents"),
    Kind("PASSPORT", "Passport", "documents"),
    Kind("SNILS", "Snils", "documents"),
    Kind("INN", "Inn", "documents"),
    Kind("OGRN", "Ogrn", "documents"),
    Kind("KPP", "Kpp", "documents"),
    Kind("BIK", "Bik", "documents"),
    Kind("OMS", "Oms", "documents"),
    Kind("DRIVER_LICENSE", "License", "documents"),
    Kind("VEHICLE_PLATE", "Plate", "documents"),
    Kind("CARD", "Card", "finance"),
    Kind("BANK_ACCOUNT", "Account", "finance"),
    Kind("BIRTH_DATE", "Birthdate", "documents"),
    Kind("IP_ADDRESS", "Ip", "contacts"),
    Kind("TERM", "Term", "custom"),
    Kind("META", "Meta", "hidden"),
    Kind("PII", "Data", "documents"),
    Kind("SECRET", "Secret", "secrets"),
    Kind("BUSINESS", "Biz", "custom"),
)
ALIASES = {"POSSIBLE_PERSON": "PERSON", "POSSIBLE_ENTITY": "TERM", "INN_PERSON": "INN", "INN_ORG": "INN"}
EMAIL_DOMAIN = "example.com"
LATIN_TWINS = {"A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "K": "К", "M": "М", "O": "О", "P": "Р", "T": "Т", "X": "Х", "Y": "У"}
SMALL_TWINS = {"a": "а", "c": "с", "e": "е", "o": "о", "p": "р", "x": "х", "y": "у", "k": "к", "m": "м", "t": "т", "h": "н", "b": "в"}
# End of fixed values.

BY_CODE = {k.code: k for k in KINDS}
_PAIRS = {latin.lower(): twin.lower() for latin, twin in (LATIN_TWINS | SMALL_TWINS).items()}


def _letter(ch: str) -> str:
    """A class for one letter of a stem: either case, Latin or its Cyrillic twin."""
    options = [ch.lower(), ch.upper()]
    if twin := _PAIRS.get(ch.lower()):
        options += [twin.lower(), twin.upper()]
    return f"[{''.join(options)}]"


def _stem(stem: str) -> str:
    return "".join(map(_letter, stem))


_STEMS = "|".join(_stem(k.stem) for k in sorted(KINDS, key=lambda k: -len(k.stem)) if k.code != "EMAIL")
_NUMBER = r"([0-9]{1,7})(?:\\?_([0-9]{1,6}))?"
#: Groups: stem, number, variant.
TOKEN = rf"(?<![A-Za-z0-9_Ѐ-ӿ])({_STEMS}){_NUMBER}(?![A-Za-z0-9_])"
TOKEN_AFTER_UNDERSCORE = rf"(?<![A-Za-z0-9Ѐ-ӿ])({_STEMS}){_NUMBER}(?![A-Za-z0-9])"
EMAIL_TOKEN = rf"(?U)(?<![\w.+-])({_stem('email')}){_NUMBER}@(?i:example\.com)(?![\w-])(?!\.\w)"


def kinds(spark: SparkSession) -> DataFrame:
    """The dimension table of kinds."""
    rows = [(i, k.code, k.stem, k.group) for i, k in enumerate(KINDS)]
    return spark.createDataFrame(rows, "position int, kind string, stem string, `group` string")


def _mapped(pairs: dict[str, str], value: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)), value)


def kind_of(category: Column) -> Column:
    """The kind of a category; an unknown one is PII."""
    known = {k.code: k.code for k in KINDS} | ALIASES
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), category), F.lit("PII"))


def stem_of(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for k in KINDS for x in (k.code, k.stem))), kind)


def group_of(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for k in KINDS for x in (k.code, k.group))), kind)


def format_token(kind: Column, number: Column, variant: Column | None = None) -> Column:
    """Name7, Name7_2, email7@example.com."""
    variant = F.lit(1) if variant is None else variant
    body = F.concat(number.cast("string"), F.when(variant > 1, F.concat(F.lit("_"), variant.cast("string"))).otherwise(F.lit("")))
    return F.when(kind == "EMAIL", F.concat(F.lit("email"), body, F.lit(f"@{EMAIL_DOMAIN}"))).otherwise(F.concat(stem_of(kind), body))


def normal_stem(raw: Column) -> Column:
    """A stem as it is written in KINDS, from any case and script; null if it is none."""
    latin = F.translate(F.lower(raw), "".join(_PAIRS.values()), "".join(_PAIRS))
    return F.try_element_at(F.create_map(*(F.lit(x) for k in KINDS for x in (k.stem.lower(), k.stem))), latin)


def parse_token(raw: Column) -> Column:
    """struct<kind,number,variant,base,suffix> of one whole token, null if it is none."""
    mail = raw.rlike(f"^(?:{EMAIL_TOKEN})$")
    plain = raw.rlike(f"^(?:{TOKEN})$")
    bare = F.regexp_extract(raw, TOKEN, 1)
    kind = F.when(mail, F.lit("EMAIL")).otherwise(F.try_element_at(F.create_map(*(F.lit(x) for k in KINDS for x in (k.stem, k.code))), normal_stem(bare)))
    part = lambda i: F.when(mail, F.regexp_extract(raw, EMAIL_TOKEN, i)).otherwise(F.regexp_extract(raw, TOKEN, i))
    number = part(2).try_cast("bigint")
    variant = F.when(part(3) == "", F.lit(1)).otherwise(part(3).try_cast("int"))
    read = F.struct(kind.alias("kind"), number.alias("number"), variant.alias("variant"), format_token(kind, number).alias("base"), part(3).alias("suffix"))
    return F.when((mail | plain) & kind.isNotNull(), read)


def base_of(token: Column) -> Column:
    """Name7_2 gives Name7; null for what is no token."""
    return parse_token(token)["base"]


def has_token(text: Column) -> Column:
    return text.rlike("[0-9]") & (text.rlike(TOKEN) | text.rlike(EMAIL_TOKEN))
