"""Everything that one text tells by itself, in one pass of Python over it: rules, signs and names.

Spark has no function that gives the positions of matches, and forty rules as expressions would copy
each pattern into every use of its result. Here each rule runs once over a text, after a cheap look
for what it needs. Spans are returned in raw coordinates.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .checks import iban_ok, luhn_ok, snils_ok
from .lexicon import DEFAULT, Lexicon, folded
from .names import MENTION, Reader
from .normalize import is_clean, normalized, raw_span
from .patterns import DEFAULT_PRIORITY, HIDE_PRIORITY, LITERAL_PRIORITY, LONE_DATE, Rule, priority_of
from .signs import SIGN, SignReader
from .text import DIGIT_CATEGORIES
from .tokens import EMAIL_TOKEN, TOKEN

HIT = (
    "struct<start:int,end:int,original:string,context:string,category:string,decision:string,confidence:double,reason:string,priority:int,key:string,emit_seq:int>"
)
NAME = MENTION.replace("end:int,", "end:int,original:string,context:string,", 1)
READ = f"struct<rules:array<{HIT}>,signs:array<{SIGN}>,names:array<{NAME}>,birth:boolean>"
AROUND = 90
CHECKS = {"luhn": luhn_ok, "snils": snils_ok, "iban": iban_ok, "not_thousands": lambda v: not re.fullmatch(r"\+\d{1,3}(?: \d{3}){2,}", v.strip())}
#: Rules whose patterns hold Cyrillic letters in every branch.
CYRILLIC = frozenset(
    "snils_3 inn_person_1 inn_org_1 kpp_1 kpp_2 ogrn_1 bik_1 bank_account_2 contract_1 passport_1 oms_1 driver_license_1 vehicle_plate_1 address_1 address_2 address_3 address_4 address_5".split()
)
#: One of these stands in the lower-cased text where the rule matches.
WORDS = {
    "phone_7": ("тел", "моб", "факс", "whatsapp", "telegram"), "card_2": ("карт", "card", "pan"), "birth_date_1": ("рожден", "родил", "р.", "birth", "dob"),
    "secret_2": ("bearer",), "secret_4": ("password", "pwd"), "secret_5": ("passw", "pwd", "пароль", "key", "token", "secret", "session"), "secret_7": ("akia", "gh", "xox", "sk-"),
    "business_1": ("зарплат", "оклад", "преми", "марж", "kpi", "бонус", "выручк", "себестоим"), "phone_2": ("7",), "phone_3": ("(",), "phone_6": ("+",), "bank_account_3": ("40", "30"),
}
_TOKEN, _MAIL_TOKEN = re.compile(TOKEN), re.compile(EMAIL_TOKEN.replace("(?U)", "").replace("(?i:example", "(?i:example"))
_LONE = re.compile(LONE_DATE)
_DIGIT, _CYRILLIC = re.compile(r"\d"), re.compile("[Ѐ-ӿ]")


def identity(category: str, value: str) -> str:
    """One value in different spellings has one key."""
    digits = re.sub(r"\D", "", value)
    if category == "PHONE" and len(digits) > 10:
        return digits[-10:]
    if category in DIGIT_CATEGORIES:
        return digits
    if category == "EMAIL":
        return value.strip().lower()
    if category == "SECRET":
        return hashlib.sha256(value.encode()).hexdigest()[:20]
    return " ".join(folded(value).split())


class Scanner:
    """Rules and hidden terms over one normalised text."""

    def __init__(self, rules: tuple[Rule, ...], literals: bool, hide: tuple[str, ...] = (), lone_dates: bool = True):
        self.rules = [(n, r, re.compile(r.pattern)) for n, r in enumerate(rules)]
        self.literals, self.lone_dates = literals, lone_dates
        terms = "|".join(re.sub("[её]", "[её]", re.escape(t.casefold())) for t in sorted(hide, key=len, reverse=True) if t.strip())
        self.hide = re.compile(rf"(?i)(?<!\w)(?:{terms})(?!\w)") if terms else None

    def __call__(self, text: str) -> list[tuple]:
        """(start, end, category, decision, confidence, reason, priority, emit_seq)."""
        out = []
        low = text.lower()
        digit, cyrillic = bool(_DIGIT.search(text)), bool(_CYRILLIC.search(text))
        for n, rule, pattern in self.rules:
            if rule.needs == "digit" and not digit or rule.needs not in (None, "digit") and rule.needs not in text:
                continue
            if rule.name in CYRILLIC and not cyrillic or rule.name in WORDS and not any(w in low for w in WORDS[rule.name]):
                continue
            for m in pattern.finditer(text):
                if not rule.check or CHECKS[rule.check](m[rule.group]):
                    out.append((*m.span(rule.group), rule.category, "AUTO", rule.confidence, rule.name, priority_of(rule.category), n))
        after = len(self.rules)
        if self.literals and digit:
            out += [(*m.span(), "TERM", "AUTO", 1.0, "literal_token", LITERAL_PRIORITY, after) for p in (_TOKEN, _MAIL_TOKEN) for m in p.finditer(text)]
        if self.hide is not None:
            out += [(*m.span(), "TERM", "AUTO", 1.0, "hidden by the user", HIDE_PRIORITY, after + 1) for m in self.hide.finditer(text)]
        if self.lone_dates and digit and len(text) < 40 and (m := _LONE.match(text)) and 1920 <= int(m[3]) <= date.today().year - 16:
            out.append((m.start(1), m.end(3), "BIRTH_DATE", "REVIEW", 0.6, "lone_date", DEFAULT_PRIORITY, after + 2))
        return out


def reader(scanner: Scanner | None, signs: SignReader | None, lexicon: Lexicon | None, birth: str) -> Callable[[Column], Column]:
    """A column expression: READ of a text. What is not asked for is an empty array."""
    context_of_birth = re.compile(birth)

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [one(t) for t in texts]
        return pd.DataFrame(rows, columns=["rules", "signs", "names", "birth"])

    def one(raw: str | None) -> tuple:
        if not raw:
            return [], [], [], False
        text, runs = (raw, None) if is_clean(raw) else normalized(raw)

        def placed(start: int, end: int) -> dict:
            a, b = raw_span(runs, start, end)
            return {"start": a, "end": b, "original": raw[a:b], "context": raw[max(0, a - AROUND) : b + AROUND].replace("\n", " ")}

        rules, told, named = [], [], []
        for start, end, category, decision, confidence, reason, priority, seq in scanner(text) if scanner else ():
            at = placed(start, end)
            if at["end"] > at["start"]:
                key = identity(category, at["original"])
                if category == "SECRET":  # its text leaves this function as a hash only
                    at |= {"original": "", "context": ""}
                rules.append({**at, "category": category, "decision": decision, "confidence": confidence, "reason": reason, "priority": priority, "key": key, "emit_seq": seq})
        masked = text
        for start, end, category, decision, confidence, reason, priority, key in signs(text) if signs else ():
            told.append({**placed(start, end), "category": category, "decision": decision, "confidence": confidence, "reason": reason, "priority": priority, "key": key})
            if priority >= 680:  # a name within a company's or a place's is none of a person
                masked = masked[:start] + ";" * (end - start) + masked[end:]
        if lexicon is not None:
            named = [{**m, **placed(m["start"], m["end"])} for m in Reader(masked, lexicon)]
        return rules, told, named, context_of_birth.search(text) is not None

    return lambda text: F.pandas_udf(run, READ)(text)


def read(units: DataFrame, keys: list[str], text: str, scanner: Scanner | None, signs: SignReader | None, lexicon: Lexicon | None = DEFAULT, birth: str = "(?!)") -> DataFrame:
    """keys and the fields of READ; units with no text are left out."""
    rows = units.where(F.col(text) != "").select(*keys, reader(scanner, signs, lexicon, birth)(F.col(text)).alias("__read"))
    return rows.select(*keys, "__read.*")
