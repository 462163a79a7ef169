"""Check digits and other validators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digits(value: Column) -> Column:
    """Only the digits of a value (any script's digits, as the rules accept them)."""
    return F.regexp_replace(value, r"(?U)\D", "")


def _weighted(d: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights, 1):
        total = total + F.coalesce(F.substring(d, i, 1).try_cast("int"), F.lit(0)) * w
    return total


def snils(value: Column) -> Column:
    d = digits(value)
    total = _weighted(d, (9, 8, 7, 6, 5, 4, 3, 2, 1))
    rest = F.when(total < 100, total).when(total <= 101, 0).otherwise(F.when(total % 101 == 100, 0).otherwise(total % 101))
    one_digit = F.length(F.replace(F.left(d, F.lit(9)), F.left(d, F.lit(1)), F.lit(""))) == 0
    return F.coalesce((F.length(d) == 11) & ~one_digit & (rest == F.right(d, F.lit(2)).try_cast("int")), F.lit(False))


def inn(value: Column) -> Column:
    d = digits(value)
    ten = _weighted(d, (2, 4, 10, 3, 5, 9, 4, 6, 8)) % 11 % 10 == F.substring(d, 10, 1).try_cast("int")
    first = _weighted(d, (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)) % 11 % 10 == F.substring(d, 11, 1).try_cast("int")
    second = _weighted(d, (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)) % 11 % 10 == F.substring(d, 12, 1).try_cast("int")
    return F.when(F.length(d) == 10, ten).when(F.length(d) == 12, first & second).otherwise(F.lit(False))


def luhn(value: Column) -> Column:
    d = digits(value)
    return F.length(d).between(13, 19) & F.coalesce(F.call_function("luhn_check", d), F.lit(False))


def ogrn(value: Column) -> Column:
    d = digits(value)
    head = lambda n: F.left(d, F.lit(n)).try_cast("bigint")
    last = F.right(d, F.lit(1)).try_cast("int")
    return F.when(F.length(d) == 13, head(12) % 11 % 10 == last).when(F.length(d) == 15, head(14) % 13 % 10 == last).otherwise(F.lit(False))


def iban(value: Column) -> Column:
    compact = F.upper(F.regexp_replace(value, r"(?U)\s", ""))
    shape = F.length(compact).between(15, 34) & compact.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]+$")
    turned = F.concat(F.substr(compact, F.lit(5)), F.left(compact, F.lit(4)))
    # Letters count as two digits (A = 10), so the remainder shifts by 100 for them and by 10 for digits.
    step = lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.try_cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda r, c: F.coalesce(step(r, c), F.lit(0)))
    return shape & (rest == 1)


def account(value: Column) -> Column:
    return F.length(digits(value)) == 20


def not_thousands(value: Column) -> Column:
    """False for a number written in groups of three (+12 345 678), which is not a phone."""
    return ~F.trim(value).rlike(r"^\+\d{1,3}(?: \d{3}){2,}$")


def luhn_ok(value: str) -> bool:
    """luhn() of one value in Python."""
    d = [int(c) for c in value if c.isdigit()]
    return 13 <= len(d) <= 19 and sum(d[-1::-2]) % 10 == -sum(sum(divmod(2 * x, 10)) for x in d[-2::-2]) % 10


def snils_ok(value: str) -> bool:
    d = [int(c) for c in value if c.isdigit()]
    if len(d) != 11 or len(set(d[:9])) == 1:
        return False
    return sum(x * w for x, w in zip(d, range(9, 0, -1), strict=False)) % 101 % 100 == 10 * d[9] + d[10]


def iban_ok(value: str) -> bool:
    v = "".join(value.split()).upper()
    return 15 <= len(v) <= 34 and v.isalnum() and v.isascii() and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


VALIDATORS = {"snils": snils, "inn": inn, "luhn": luhn, "ogrn": ogrn, "iban": iban, "account": account, "not_thousands": not_thousands}


def sensitive_number(value: Column) -> Column:
    """Whether a bare number in a cell is a card, a SNILS, an account or a tax number by its check digits."""
    return luhn(value) | snils(value) | (inn(value) & F.length(digits(value)).isin(10, 12))
