"""What is known about single words: names, roles, ordinary words, places. A table of more words can be added.

Without a morphology dictionary, shape() reads a word by its suffixes and by the lists below. A
Lexicon with the words of a table (word, tag) knows those as well; the table is a dictionary, not
data, so its size is checked when it is collected. The tags are the fields of Lexicon.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace
from functools import lru_cache

from pyspark.sql import DataFrame

# Common given names and words; each list may be extended by a table.
MALE = """александр алексей анатолий андрей антон аркадий арсений артем артур борис вадим валентин валерий василий виктор виталий владимир владислав
вячеслав геннадий георгий герман глеб григорий даниил денис дмитрий евгений егор иван игорь илья кирилл константин лев леонид максим марат марк
матвей михаил никита николай олег павел петр роман руслан рустам семен сергей станислав степан тимофей тимур федор эдуард юрий яков ярослав""".split()
FEMALE = """алевтина александра алина алиса алла анастасия ангелина анна антонина валентина валерия вера вероника виктория галина дарья диана ева
евгения екатерина елена елизавета жанна зинаида зоя инна ирина карина кира клавдия кристина ксения лариса лидия любовь людмила маргарита марина
мария надежда наталья нина оксана ольга полина раиса римма светлана софия тамара татьяна ульяна юлия яна""".split()
DIMINUTIVE = """саша леша толя андрюша боря вадик валера вася витя вова слава гена гоша гриша даня дима женя ваня илюша костя леня миша никитка коля
паша петя рома сережа степа тима федя юра яша алена настя аня даша катя лена лиза ира ксюша лида люба люда рита маша надя наташа оля соня таня""".split()
ROLES = """директор руководитель начальник менеджер бухгалтер председатель заместитель куратор ответственный исполнитель подписант представитель
контакт инженер специалист координатор супервайзер автор заказчик подрядчик врач юрист секретарь мастер агент""".split()
ACTORS = """получено получил принято принял подписал подписано утвердил утверждено согласовал согласовано исполнил проверил составил выдал выдано
направлено направил представил сдал оформил разработал передано передал заполнил внес уволен принят назначен вручено вручил""".split()
ORDINARY = """договор приложение акт счет общество директор заказчик исполнитель область район город республика улица проспект отдел компания служба
ведение реестр выгрузка выгрузить отчет модуль согласование формат сервер система данные дата прием товар наименование контрагент задолженность
клиент расход период средство актив учет сдача загрузка возврат табель ставка линия инвентаризация премия приход оплата услуга связь проверка
таблица продажа платеж поручение сверка банк поток станция федерация настоящий сторона согласно общий условие оператор логист кладовщик если сейчас
база поставка знание управление предприятие бухгалтерия положение обязательство задание записка накладная фактура план расчет уведомление заказ
позиция строка офис подразделение оборудование регламент стандарт качество сотрудник уважаемый здравствуйте привет от для при""".split()
PLACE_BEFORE = "ул улица просп проспект пер переулок наб набережная шоссе пл площадь бульвар бул г город гор пос поселок село деревня станция ст метро проезд имени им".split()
PLACE_AFTER = "область обл край район округ республика улица проспект переулок шоссе площадь бульвар набережная проезд филиал отдел завод".split()
NOT_INITIALS = "ИП ЧП АО ОП ГК РФ ТД ПК ТК НП УК СП ЖК БЦ ТЦ СК ЦБ ФЛ ЮЛ".split()
# End of fixed values.

#: The most words that a table may add: a dictionary of a language fits, a corpus does not.
MOST_WORDS = 3_000_000
_CASES = "а|я|у|ю|е|и|ы|ой|ей|ою|ею|ом|ем|ым|ого|ому"
SURNAME = re.compile(r"(?:(?:ов|ев|ин|ын)(?:а|у|ым|е|ы|ых|ыми|ой|ою)?|(?:ск|цк)(?:ий|ая|ое|ого|ому|им|ом|ой|ую|ою|ие|их|ими)|(?:енко|енк[ио]|ук|юк|чук|ян|янц|швили|дзе|оглы)(?:а|у|ом|ем|е)?|(?:ович|евич)(?:а|у|ем|е)?)$")
PATRONYMIC = re.compile(r"(?:(?:ович|евич|ьич|мич|тич)(?:а|у|ем|е)?|(?:овн|евн|ичн|иничн)(?:а|ы|е|у|ой|ою))$")
_ADJECTIVE = re.compile(r"(?:ый|ий|ая|яя|ое|ее|ого|его|ому|ему|ую|юю|ые|ие|ых|их|ым|им|ыми|ими)$")
_TOPONYM = re.compile(r"(?:град|бург|поль|горск|озерск|овка|евка|ово|ево|ино|ыно|ское|цкое|ская область)$")
_VERB = re.compile(r"(?:ал|ил|ел|ял|ала|ила|ела|яла|али|или|ают|яют|ует|ит|ать|ить|еть|ено|ано|ен|ан)$")


def folded(word: str) -> str:
    return word.casefold().replace("ё", "е")


@dataclass(frozen=True)
class Shape:
    """How a word may be read: as what part of a name, whether it is an ordinary word, and its likeliest nominative."""

    surname: bool
    given: bool
    patronymic: bool
    lexical: bool
    known: bool
    feminine: bool | None
    nominative: str


@dataclass(frozen=True)
class Lexicon:
    male: frozenset = frozenset(MALE)
    female: frozenset = frozenset(FEMALE)
    diminutive: frozenset = frozenset(DIMINUTIVE)
    surname: frozenset = frozenset()
    role: frozenset = frozenset(ROLES)
    actor: frozenset = frozenset(ACTORS)
    ordinary: frozenset = frozenset(ORDINARY)
    toponym: frozenset = frozenset()

    def with_table(self, words: DataFrame) -> Lexicon:
        """With the words of a table (word, tag); a ValueError beyond MOST_WORDS rows or for an unknown tag."""
        rows = words.select("word", "tag").where("word IS NOT NULL").distinct().limit(MOST_WORDS + 1).collect()
        if len(rows) > MOST_WORDS:
            raise ValueError(f"a lexicon has at most {MOST_WORDS} words")
        if unknown := {r["tag"] for r in rows} - {f.name for f in fields(self)}:
            raise ValueError(f"unknown tags: {sorted(map(str, unknown))}")
        more = {f.name: frozenset(folded(r["word"]) for r in rows if r["tag"] == f.name) for f in fields(self)}
        return replace(self, **{k: getattr(self, k) | v for k, v in more.items()})

    def stem_in(self, word: str, words: frozenset) -> str | None:
        """The word of a list that word is a case form of: the same up to a case ending."""
        low = folded(word)
        if low in words:
            return low
        for cut in range(1, min(4, len(low) - 2)):
            if not re.fullmatch(_CASES, low[-cut:]):
                continue
            stem = low[:-cut]
            for end in ("", "а", "я", "й", "ь", "о", "е", "ия", "ий", "ый"):
                if stem + end in words:
                    return stem + end
        return None

    def given(self, word: str) -> str | None:
        """The nominative of a given name in any case, Russian or in Latin letters."""
        if word[:1].isascii():
            return _latin_given(self).get(word.casefold())
        return _given_forms(self).get(folded(word))

    def is_ordinary(self, word: str) -> bool:
        """A common word, an adjective that is none of a surname's, a role or a verb of the list."""
        low = folded(word)
        return self.stem_in(low, self.ordinary) is not None or low in self.actor or self.is_role(low)

    def is_role(self, word: str) -> bool:
        return self.stem_in(word, self.role) is not None

    def is_actor(self, word: str) -> bool:
        """A word after which a name stands: what somebody did, or who is meant."""
        low = folded(word)
        return low in self.actor or (low[:-1] in self.actor and low[-1:] in "аои") or self.is_role(low) or low in ("от", "исп", "отв")

    def is_toponym(self, word: str) -> bool:
        low = folded(word)
        return low in self.toponym or (bool(_TOPONYM.search(low)) and low not in self.surname)

    def is_adjective(self, word: str) -> bool:
        return bool(_ADJECTIVE.search(folded(word)))

    def shape(self, word: str) -> Shape:
        low = folded(word)
        given = self.given(word)
        patronymic = len(low) >= 5 and bool(PATRONYMIC.search(low))
        named = low in self.surname
        surname = named or (len(low) >= 4 and bool(SURNAME.search(low)))
        lexical = self.is_ordinary(low)
        feminine = None
        if given:
            feminine = given in self.female
        elif patronymic:
            feminine = bool(re.search(r"н(?:а|ы|е|у|ой|ою)$", low))
        elif surname:
            feminine = True if re.search(r"(?:ов|ев|ин|ын)ой$|(?:ск|цк)(?:ая|ой|ую)$", low) else None
        return Shape(surname, given is not None, patronymic, lexical, named or given is not None or lexical, feminine, self.nominative(word, feminine))

    def nominative(self, word: str, feminine: bool | None) -> str:
        """The likeliest nominative of a part of a name; case of letters as in a name."""
        low = folded(word)
        if (given := self.given(word)) is not None:
            return (word if low == given else given).title()
        if m := re.search(r"(ов|ев|ич|инич)н(?:а|ы|е|у|ой|ою)$", low):
            return (low[: m.start()] + m[1] + "на").title()
        if m := re.search(r"(ович|евич|ьич|мич|тич)(?:а|у|ем|е)?$", low):
            return low[: m.end(1)].title()
        if m := re.search(r"(ск|цк)(?:ий|ая|ое|ого|ому|им|ом|ой|ую|ою)$", low):
            return (low[: m.end(1)] + ("ая" if feminine else "ий")).title()
        if m := re.search(r"(ов|ев|ин|ын)(?:а|у|ым|е|ой|ою|ы|ых|ыми)?$", low):
            return (low[: m.end(1)] + ("а" if feminine else "")).title()
        if not feminine and len(low) > 4 and (m := re.search(r"(?<=[бвгджзклмнпрстфхцчшщ])(?:а|у|ом|ем|е)$", low)):
            return low[: m.start()].title()
        return low.title()


@lru_cache(maxsize=8)
def _given_forms(lexicon: Lexicon) -> dict[str, str]:
    from .morphology import given_forms

    out: dict[str, str] = {}
    for name in sorted(lexicon.male | lexicon.female):
        for form in given_forms(name):
            out.setdefault(folded(form), name)
    return out | {n: n for n in lexicon.male | lexicon.female}


@lru_cache(maxsize=8)
def _latin_given(lexicon: Lexicon) -> dict[str, str]:
    from .morphology import latin_spellings

    out: dict[str, str] = {}
    for name in sorted(lexicon.male | lexicon.female):
        for form in latin_spellings(name)[:12]:
            out.setdefault(form.casefold(), name)
    return out


@lru_cache(maxsize=8)
def diminutive_forms(lexicon: Lexicon) -> frozenset:
    from .morphology import given_forms

    return frozenset(folded(f) for n in lexicon.diminutive for f in given_forms(n))


#: Words about which a process remembers each answer.
REMEMBERED = 1 << 16


class Remembered:
    """A lexicon that remembers its last answers: the texts of a language hold the same words again and again."""

    def __init__(self, lexicon: Lexicon):
        for name in ("shape", "given", "nominative", "is_ordinary", "is_role", "is_actor", "is_toponym", "is_adjective"):
            setattr(self, name, lru_cache(REMEMBERED)(getattr(lexicon, name)))
        self.surname, self.diminutive_forms = lexicon.surname, diminutive_forms(lexicon)


@lru_cache(maxsize=8)
def remembered(lexicon: Lexicon) -> Remembered:
    return Remembered(lexicon)


DEFAULT = Lexicon()
