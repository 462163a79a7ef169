"""Organisations, projects, places, domains and file names that a sign beside them tells: one pass over a text.

A sign is a pattern whose group n is the name. What a name must not be (a sentence, a number format,
an ordinary word) is decided by the guard of its sign.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from .lexicon import Lexicon, folded
from .morphology import GIVEN_PARADIGMS, declined

# Legal forms, words beside names, domains that many share.
LEGAL = "ООО ОАО ЗАО ПАО НАО АО ГК ФГУП МУП ГУП АНО НКО ТОО ЧОП ИП".split()
LATIN_LEGAL = ("LLC", "Ltd", "Inc", "GmbH", "AG", "Corp", "PLC", "S.A.", "B.V.", "Co", "LLP", "Limited")
PUBLIC_DOMAINS = (
    "example.com", "example.net", "example.org", "gmail.com", "mail.ru", "yandex.ru", "ya.ru", "bk.ru", "list.ru", "inbox.ru", "rambler.ru", "outlook.com", "hotmail.com", "yahoo.com", "icloud.com", "proton.me",
)
TOP_DOMAINS = "ru|su|com|net|org|info|biz|eu|de|uk|kz|by|ua|us|io|ai|dev|co|tech|app|online|store|shop|pro|group"
CITIES = """Москва Санкт-Петербург Новосибирск Екатеринбург Казань Красноярск Челябинск Самара Уфа Ростов-на-Дону Краснодар Омск Воронеж Пермь Волгоград
Саратов Тюмень Тольятти Махачкала Барнаул Ижевск Хабаровск Ульяновск Иркутск Владивосток Ярославль Севастополь Томск Ставрополь Кемерово Набережные-Челны
Оренбург Новокузнецк Балашиха Рязань Чебоксары Пенза Липецк Калининград Астрахань Тула Сочи Курск Тверь Магнитогорск Сургут Брянск Якутск Улан-Удэ
Белгород Калуга Чита Волжский Смоленск Череповец Вологда Саранск Владикавказ Мурманск Архангельск Подольск Новороссийск Псков Минск Алматы Астана Ташкент""".split()
COUNTRIES = """Россия Беларусь Казахстан Украина Армения Грузия Азербайджан Узбекистан Киргизия Таджикистан Туркмения Молдавия Латвия Литва Эстония Германия
Франция Италия Испания Португалия Польша Чехия Австрия Швейцария Бельгия Нидерланды Дания Швеция Норвегия Финляндия Греция Турция Китай Япония Индия
Корея Вьетнам Таиланд Индонезия Иран Ирак Израиль Египет Канада Бразилия Мексика Аргентина США Великобритания""".split()
# End of fixed values.

SIGN = "struct<start:int,end:int,original:string,context:string,category:string,decision:string,confidence:double,reason:string,priority:int,key:string>"
_CAP = r"[A-ZА-ЯЁ][\w&-]*"
_RU = "|".join(sorted(LEGAL, key=len, reverse=True))
_LATIN = "|".join(map(re.escape, sorted(LATIN_LEGAL, key=len, reverse=True)))
_LONG = r"(?i:(?:(?:публичн|непубличн|открыт|закрыт)\w{2,3}\s+)?акционерн\w{2,3}\s+обществ\w{1,2}|обществ\w{1,2}\s+с\s+ограниченной\s+ответственностью)"
_QUOTED = r"(?:«(?P<n>[^«»\n]{1,80}?)»|[“„\"](?P<m>[^«»“”„\"\n]{1,80}?)[”“\"])"
_FORMAT = re.compile(r"[\d.,:/\-\s%]+|(?i:utf|iso|win|cp)[-_ ]?\d+|v?\d+(?:\.\d+)+|[ДМГЧС.:/ ]+|[dmyhs.:/ ]+")
_TOKENISED = re.compile(r"[A-Za-z]+[0-9]{1,7}(?:_[0-9]{1,6})?")
_ADJECTIVE_END = r"(?:ский|ской|ская|ского|ском|скую|ским|цкий|цкой|цкая|цкого|цком)"


@dataclass(frozen=True)
class Sign:
    reason: str
    category: str
    priority: int
    pattern: re.Pattern
    guard: Callable[[str, Lexicon], bool] = lambda name, lex: True
    decision: str = "AUTO"
    confidence: float = 0.95
    latin: bool = False  # may match a text without Cyrillic letters


def _brand(name: str, lex: Lexicon) -> bool:
    """No sentence, no format, no token, no ordinary word."""
    words = name.split()
    if not words or len(words) > 8 or name[-1:] in ".!?" or _FORMAT.fullmatch(name) or _TOKENISED.fullmatch(name):
        return False
    return (name[0].isupper() or name[0].isdigit()) and not all(lex.is_ordinary(w) or not w[0].isupper() for w in words)


def _quoted_name(name: str, lex: Lexicon) -> bool:
    return not _FORMAT.fullmatch(name) and not _TOKENISED.fullmatch(name) and len(name.split()) <= 10


def _place(name: str, lex: Lexicon) -> bool:
    return not lex.is_ordinary(name.split()[0])


SIGNS = (
    Sign("a legal form and quotes", "ORG", 950, re.compile(rf"(?<![\w-])(?:{_RU})\.? *{_QUOTED}"), _quoted_name),
    Sign("a legal form in words", "ORG", 950, re.compile(rf"{_LONG}\s*{_QUOTED}"), _quoted_name),
    Sign("a Latin legal form and quotes", "ORG", 950, re.compile(rf"(?<![\w-])(?:{_LATIN})\.? *{_QUOTED}"), _quoted_name, latin=True),
    Sign("a legal form", "ORG", 950, re.compile(rf"(?<![\w-])(?:{_RU}) +(?P<n>{_CAP}(?: +{_CAP}){{0,2}})"), lambda n, lex: _brand(n, lex) and not _person(n, lex)),
    Sign("a legal form after it", "ORG", 950, re.compile(rf"(?<![\w-])(?P<n>{_CAP}) +(?:ООО|АО|ЗАО|ПАО|ОАО)(?![\w])(?! *[«“\"A-ZА-ЯЁ0-9])"), _brand),
    Sign("a Latin legal form after it", "ORG", 950, re.compile(rf"(?<![\w-])(?P<n>[A-Z][\w&-]*(?: +[A-Z][\w&-]*){{0,2}}),? +(?:{_LATIN})(?![\w])"), _brand, latin=True),
    Sign("a project in quotes", "PROJECT", 950, re.compile(rf"(?<![\w])(?i:проект\w*|программ\w+|объект\w*|инициатив\w+|project|program)\s*[:—–-]?\s+(?:под названием\s+)?{_QUOTED}"), _quoted_name, latin=True),
    Sign("a site in quotes", "PROJECT", 950, re.compile(rf"(?<![\w])(?i:участ\w+|площадк\w+|склад\w*|карьер\w*|рудник\w*)\s+{_QUOTED}"), _quoted_name),
    Sign("a company in quotes", "ORG", 950, re.compile(rf"(?<![\w])(?i:компани\w{{1,2}}|фирм\w{{1,2}}|холдинг\w*|завод\w*|банк\w*|групп\w{{1,2}}|организаци\w{{1,2}}|предприяти\w+)\s+(?:под названием\s+)?{_QUOTED}"), _quoted_name),
    Sign("a word such as vendor", "ORG", 940, re.compile(r"(?<![\w])(?i:вендор\w{0,2}|поставщик\w{0,2}|подрядчик\w{0,2})[ \t]+(?P<n>[A-Z][\w-]*)(?! [А-ЯЁ])"), _brand),
    Sign("a word such as portal", "PROJECT", 940, re.compile(r"(?<![\w])(?i:портал\w{0,2}|сервис\w{0,2}|платформ\w{1,2})[ \t]+(?P<n>[A-Z][\w-]*)"), _brand),
    Sign("a general noun at its end", "ORG", 940, re.compile(r"(?<![\w-])(?P<n>[A-ZА-ЯЁ][\w-]* +(?:Групп|Групп[аыеу]|Холдинг\w{0,2}|Корпораци[яиюей]|Group|Holding))(?![\w-])"), lambda n, lex: _brand(n.split()[0], lex) and not lex.is_adjective(n.split()[0])),
    Sign("a word such as client", "POSSIBLE_ENTITY", 410, re.compile(rf"(?<![\w])(?i:клиент\w*|контрагент\w*|партн[её]р\w*|покупател\w+|customer|client|supplier|vendor)\s*[:—–-]?\s+(?P<n>{_CAP}(?: +{_CAP}){{0,2}})"), _brand, "REVIEW", 0.6, latin=True),
    Sign("a word such as city", "CITY", 690, re.compile(r"(?<![\w.])(?:г\. ?|гор\. ?|город(?:а|е|у|ом)? +|пос\. ?|пос[её]л(?:ок|ка|ке|ком) +|сел(?:о|а|е|ом) +|деревн(?:я|и|е|ю) +|станиц(?:а|ы|е|у) +|пгт\.? )(?P<n>[А-ЯЁ][а-яё]+(?:-[А-ЯЁа-яё]+){0,3}|[A-Z][a-z]+(?![\w-]))"), _place),
    Sign("a region and its adjective", "REGION", 690, re.compile(rf"(?<![\w])(?P<n>[А-ЯЁ][а-яё]+(?:-[А-ЯЁа-яё]+)?{_ADJECTIVE_END}) +(?:обл\b\.?|област\w+|кра[йяюе]м?\b|район\w?\b|округ\w?\b|республик\w\b|р-н\w?\b|улус\w?\b)"), lambda n, lex: not re.match("(?:Федеральн|Автономн|Муниципальн|Городск|Сельск|Административн)", n)),
    Sign("a word such as district", "REGION", 690, re.compile(rf"(?<![\w-])(?:р-н[а-я]*\.?|район[а-я]?|улус[а-я]?|(?i:регион|округ|территория)\s*[:—–-]) +(?P<n>[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?{_ADJECTIVE_END})(?![\w])"), _place),
    Sign("a republic", "REGION", 690, re.compile(r"(?<![\w])Республик[аиуе] +(?P<n>[А-ЯЁ][а-яё]+(?:-[А-ЯЁа-яё]+)?)"), _place),
)
_DOMAIN = re.compile(rf"(?i)(?<![\w@.-])(?:https?://)?(?:www\.)?(?P<n>(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+(?:{TOP_DOMAINS}))(?![\w-])(?::\d+)?(?:/[^\s<>\"'»)]*)?")
_MAIL_HOST = re.compile(r"@([A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)+)")
_FILE = re.compile(r"(?i)(?<![\w/\\.])(?P<n>[\w«»()№-][\w«»()№ -]{1,80}?)\.(?:docx?|xlsx?|pptx?|pdf|zip)(?![\w])")
_FILE_END = re.compile(r"(?i)\.(?:doc|xls|ppt|pdf|zip)")
_ALIAS = re.compile(rf"(?P<full>{_CAP}(?: +{_CAP}){{1,4}}) *\((?P<n>[A-ZА-ЯЁ][\w-]{{1,11}})\)")
_ITEMS = re.compile(r"[^,;|/()\n]+")


def _person(name: str, lex: Lexicon) -> bool:
    words = name.split()
    return any(lex.given(w) for w in words[:2]) and len(words) > 1


def entity_key(name: str) -> str:
    """Quotes and punctuation stripped, spaces collapsed, folded."""
    return " ".join(re.sub(r"[«»\"“”„'‘’.,;:()]", " ", folded(name).replace("ß", "ss")).split())


def region_key(name: str) -> str:
    return re.sub(_ADJECTIVE_END + "$", lambda m: m[0][0] + "кий", entity_key(name))


def root_domain(host: str) -> str:
    return ".".join(host.lower().split(".")[-2:])


def place_forms(names: tuple[str, ...]) -> dict[str, str]:
    """Case forms of place names, folded, with the key of each."""
    return {folded(f): entity_key(n) for n in names for f in declined(n, GIVEN_PARADIGMS)}


class SignReader:
    """Finds what signs tell in texts; kinds are the categories looked for, places a bounded gazetteer."""

    def __init__(self, lexicon: Lexicon, kinds: frozenset, places: tuple[str, ...] = (), countries: tuple[str, ...] = ()):
        self.lex, self.kinds = lexicon, kinds
        self.signs = [s for s in SIGNS if s.category in kinds]
        self.gazetteer = {f: ("CITY", k) for f, k in place_forms(places).items()} | {f: ("COUNTRY", k) for f, k in place_forms(countries).items()}
        longest = sorted(self.gazetteer, key=len, reverse=True)
        # one alternation; е stands for ё as well
        forms = "|".join(re.escape(f).replace("е", "[её]") for f in longest)
        self.places = re.compile(rf"(?<![\w-])(?i:{forms})(?![\w-])") if longest else None

    def __call__(self, text: str) -> list[tuple]:
        """(start, end, category, decision, confidence, reason, priority, key) of each sign, best sign first."""
        out = []
        cyrillic = bool(re.search("[А-ЯЁа-яё]", text))
        for s in self.signs:
            if not cyrillic and not s.latin:
                continue
            for m in s.pattern.finditer(text):
                group = next(g for g in ("n", "m") if g in m.re.groupindex and m[g])
                a, b = m.span(group)
                name = text[a:b]
                a, b = a + len(name) - len(name.lstrip()), b - (len(name) - len(name.rstrip()))
                name = text[a:b]
                if len(entity_key(name)) > 1 and s.guard(name, self.lex):
                    key = region_key(name) if s.category == "REGION" else self._place_key(name) if s.category == "CITY" else entity_key(name)
                    out.append((a, b, s.category, s.decision, s.confidence, s.reason, s.priority, key))
        if "ORG" in self.kinds and (cyrillic or out):
            out += self._aliases(text) + self._siblings(text, out)
        if "DOMAIN" in self.kinds and "." in text:
            out += [(*m.span(), "DOMAIN", "AUTO", 0.9, "a site", 945, root_domain(m["n"])) for m in _DOMAIN.finditer(text) if root_domain(m["n"]) not in PUBLIC_DOMAINS]
        if "FILE" in self.kinds and _FILE_END.search(text):
            out += [(*m.span("n"), "FILE", "AUTO", 0.8, "a file name", 780, entity_key(m["n"])) for m in _FILE.finditer(text) if not _TOKENISED.fullmatch(m["n"])]
        if self.places and cyrillic:
            for m in self.places.finditer(text):
                category, key = self.gazetteer[folded(m[0])]
                if m[0][0].isupper() and category in self.kinds:
                    out.append((*m.span(), category, "AUTO", 0.85, "a place of the list", 650, key))
        return out

    def _place_key(self, name: str) -> str:
        """One key for the case forms of a place: that of the list, else of the likeliest nominative."""
        known = self.gazetteer.get(folded(name))
        return known[1] if known else entity_key(name)

    def _aliases(self, text: str) -> list[tuple]:
        """What stands in brackets after a name is the same organisation, if it is made of its letters."""
        out = []
        for m in _ALIAS.finditer(text):
            full, short = m["full"], m["n"]
            letters = iter(folded(full))
            if not self.lex.is_ordinary(full.split()[0]) and not _person(full, self.lex) and all(c in letters for c in folded(short)) and not self.lex.given(full.split()[-1]):
                key = entity_key(full)
                out += [(*m.span("full"), "ORG", "AUTO", 0.85, "a name with its abbreviation", 940, key), (*m.span("n"), "ORG", "AUTO", 0.85, "an abbreviation of a name", 940, key)]
        return out

    def _siblings(self, text: str, found: list[tuple]) -> list[tuple]:
        """Latin names beside an organisation in one list; in brackets after it, the same organisation."""
        out = []
        spans = [f for f in found if f[2] == "ORG" and f[6] >= 940]
        if not spans:
            return out
        for line in re.finditer(r"[^\n]+", text):
            items = [(line.start() + m.start(), line.start() + m.end()) for m in _ITEMS.finditer(line[0])]
            held = [next((f for f in spans if s <= f[0] and f[1] <= e), None) for s, e in items]
            if len(items) < 2 or not any(held):
                continue
            for n, ((s, e), anchor) in enumerate(zip(items, held, strict=True)):
                m = re.fullmatch(r"\s*([A-Z][\w&-]+(?: [A-Z][\w&-]+)?)\s*", text[s:e])
                if anchor or not m or not _brand(m[1], self.lex):
                    continue
                before = held[n - 1] if n and text[s - 1 : s] == "(" else None
                out.append((s + m.start(1), s + m.end(1), "ORG", "AUTO", 0.8, "beside an organisation in a list", 940, before[7] if before else entity_key(m[1])))
        return out


def mail_hosts(text: str) -> list[str]:
    return [h for h in _MAIL_HOST.findall(text) if root_domain(h) not in PUBLIC_DOMAINS]
