"""Where a text names people: one pass over its words gives every mention with its shape and its parts.

A mention is read by shape (surname with initials, given name with patronymic, a word after a role)
and by the lexicon. Whether it is somebody whom the texts name elsewhere is decided by a join, not
here; so a lone capitalised word is listed too, with the shape "word", and counts only if it is known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

from .lexicon import DEFAULT, NOT_INITIALS, PATRONYMIC, PLACE_AFTER, PLACE_BEFORE, REMEMBERED, SURNAME, Lexicon, folded, remembered

MENTION = (
    "struct<start:int,end:int,shape:string,surname:string,given:string,patronymic:string,letters:array<string>,confidence:double,"
    "n_surname:string,n_given:string,n_patronymic:string,feminine:boolean>"
)
#: What a shape alone makes of a mention that is nobody known: category, decision, confidence.
SHAPES = {
    "full": ("PERSON", "AUTO", 0.97), "named": ("PERSON", "AUTO", 0.93), "initials": ("PERSON", "AUTO", 0.93), "maybe_initials": ("POSSIBLE_PERSON", "REVIEW", 0.7),
    "honorific": ("PERSON", "AUTO", 0.85), "role": ("PERSON", "AUTO", 0.85), "list": ("PERSON", "AUTO", 0.8), "pair": ("POSSIBLE_PERSON", "REVIEW", 0.78), "maybe_pair": ("POSSIBLE_PERSON", "REVIEW", 0.7),
    "actor": ("POSSIBLE_PERSON", "REVIEW", 0.65), "cell": ("POSSIBLE_PERSON", "REVIEW", 0.65), "diminutive": ("POSSIBLE_PERSON", "REVIEW", 0.6),
    "prose": ("POSSIBLE_PERSON", "REVIEW", 0.55), "latin": ("POSSIBLE_PERSON", "REVIEW", 0.55),
}
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_HONORIFIC = re.compile(r"господин\w{0,2}|госпож\w{1,2}|товарищ\w{0,2}|гражданин\w{0,2}|гражданк\w{1,2}|г-н\w?|г-ж\w|mr|mrs|ms")
_LATIN_SURNAME = re.compile(r"[a-z'-]+(?:ov|ev|iev|yev|in|yn|ova|eva|ina|yna|sky|skiy|skii|ski|skaya|enko|chuk|yan|shvili|dze)$")
#: Latin words that stand in pairs in Russian texts and name nobody.
_PRODUCTS = frozenset("access adobe android apple chrome cloud data excel google linux mac microsoft office oracle outlook point power sap server sheet teams web windows word zoom".split())
_PARTICLE = re.compile(r"\w{1,2}['’][A-ZА-ЯЁ]")
#: What every patronymic holds, in any case of letters.
_MAY_PATRONYMIC = re.compile("(?i)(?:ов|ев|ь|м|т)ич|(?:ов|ев|ич)н")
_LIST_ITEM = re.compile(r"[^,;\n|•]+")


@dataclass(slots=True)
class Word:
    text: str
    start: int
    end: int
    letters: tuple[str, ...] = ()
    dotted: bool = False

    @property
    def cyrillic(self) -> bool:
        return not self.text.isascii()

    @property
    def capital(self) -> bool:
        return self.text[0].isupper() or (not self.text.isalpha() and bool(_PARTICLE.match(self.text)))


def words_of(text: str) -> list[Word]:
    """The words of a text; single capitals and pairs of them as initials where their neighbours allow it."""
    out = [Word(m[0], *m.span()) for m in _WORD.finditer(text)]
    short = [i for i, w in enumerate(out) if w.end - w.start < 3]
    for w in map(out.__getitem__, short):
        dotted = text[w.end : w.end + 1] == "."
        if len(w.text) == 1 and (w.text.isupper() or dotted):
            w.letters, w.dotted = (w.text.upper(),), dotted
        elif len(w.text) == 2 and w.text.isupper():
            w.letters, w.dotted = tuple(w.text), dotted
        if w.letters and dotted:
            w.end += 1
    for i in short:
        w = out[i]
        if not w.letters:
            continue
        # a lone capital without a dot is an initial only beside another one
        if len(w.text) == 1 and w.letters and not w.dotted and not any(0 <= k < len(out) and out[k].letters and _close(text, out[min(i, k)], out[max(i, k)]) for k in (i - 1, i + 1)):
            w.letters = ()
        # a legal form before a full name is no initials
        after = out[i + 1 : i + 3]
        if w.text in NOT_INITIALS and len(after) == 2 and all(x.capital and len(x.text) > 2 for x in after) and _close(text, w, after[0]) and _close(text, *after):
            w.letters = ()
    return out


def _close(text: str, a: Word, b: Word) -> bool:
    """Whether only white space stands between two words: a name does not go over ; | or a bullet."""
    return not text[a.end : b.start].strip()


@lru_cache(REMEMBERED)
def _patronymic(word: str) -> bool:
    """Whether Lexicon.shape() calls the word a patronymic."""
    low = folded(word)
    return len(low) >= 5 and bool(PATRONYMIC.search(low))


class Reader:
    """Reads the mentions of one text."""

    def __init__(self, text: str, lexicon: Lexicon):
        self.text, self.lex, self.words = text, remembered(lexicon), words_of(text)
        self.russian = any(w.cyrillic for w in self.words)

    def run(self, i: int, most: int = 3) -> list[Word]:
        """The words from i on that stand close to each other in one script."""
        out = self.words[i : i + 1]
        for w in self.words[i + 1 : i + most]:
            if not _close(self.text, out[-1], w) or (w.cyrillic != out[0].cyrillic and not w.letters):
                break
            out.append(w)
        return out

    def initials(self, i: int) -> tuple[int, tuple[str, ...]]:
        """(how many words from i on are initials, their letters): at most two letters."""
        n, letters = 0, ()
        while i + n < len(self.words) and self.words[i + n].letters and len(letters) + len(self.words[i + n].letters) <= 2:
            if n and not _close(self.text, self.words[i + n - 1], self.words[i + n]):
                break
            letters += self.words[i + n].letters
            n += 1
        return n, letters

    def surname_like(self, w: Word) -> bool:
        if w.letters or len(w.text) < 2:
            return False
        low = folded(w.text)
        if not w.cyrillic:
            return bool(_LATIN_SURNAME.fullmatch(low))
        return low in self.lex.surname or (len(low) >= 4 and bool(SURNAME.search(low)) and not self.lex.is_ordinary(low))

    def name_word(self, w: Word) -> bool:
        """A capitalised word that may be a surname of any shape."""
        return w.capital and not w.letters and len(w.text) >= 2 and not self.lex.is_ordinary(w.text) and not self.lex.is_role(w.text)

    def geographic(self, i: int, n: int = 1) -> bool:
        last = self.words[i + n - 1]
        before = folded(self.words[i - 1].text) if i and not self.text[self.words[i - 1].end : self.words[i].start].strip(" .") else ""
        after = folded(self.words[i + n].text) if i + n < len(self.words) and _close(self.text, last, self.words[i + n]) else ""
        unit = after in PLACE_AFTER or any(after.startswith(x[:5]) for x in PLACE_AFTER if len(x) > 5)
        return before in PLACE_BEFORE or (unit and self.lex.is_adjective(last.text))

    def full(self, i: int) -> tuple | None:
        w = self.run(i)
        if len(w) < 2 or w[0].letters or w[1].letters:
            return None
        shapes = [self.lex.shape(x.text) for x in w]
        lower = not any(x.capital for x in w)
        if len(w) == 3 and not w[2].letters:
            a, b, c = w
            if shapes[2].patronymic and not shapes[0].patronymic and (shapes[1].given or (b.capital and not lower)) and (self.name_word(a) or (lower and (shapes[0].surname or shapes[1].given))):
                return 3, "full", (a, b, c)
            if shapes[1].patronymic and (shapes[0].given or (a.capital and not shapes[0].lexical)) and (self.name_word(c) or (lower and self.surname_like(c) and shapes[0].given)) and not shapes[2].given:
                return 3, "full", (c, a, b)
        if shapes[1].patronymic and shapes[0].given and (w[0].capital == w[1].capital):
            return 2, "named", (None, w[0], w[1])
        return None

    def with_initials(self, i: int) -> tuple | None:
        w = self.words[i]
        if not w.letters:
            n, letters = self.initials(i + 1)
            if not n or not _close(self.text, w, self.words[i + 1]) or w.cyrillic != self.words[i + 1].cyrillic or len(w.text) < 2:
                return None
            dots = all(x.dotted for x in self.words[i + 1 : i + 1 + n])
            glued = len(self.words[i + 1].text) == 2 and not self.words[i + 1].dotted
            like = self.surname_like(w)
            if like and (w.capital or dots):
                return 1 + n, "initials", (w, letters)
            if glued or not self.name_word(w) or not w.cyrillic or w.text.isupper():
                return None
            strong = dots and len(letters) == 2
            return 1 + n, ("initials" if strong and SURNAME.search(folded(w.text)) else "maybe_initials"), (w, letters)
        n, letters = self.initials(i)
        if not n or i + n >= len(self.words):
            return None
        tail = self.words[i + n]
        if not _close(self.text, self.words[i + n - 1], tail) or tail.cyrillic != w.cyrillic or not tail.capital or len(tail.text) < 3:
            return None
        if i and _close(self.text, self.words[i - 1], w) and self.surname_like(self.words[i - 1]):
            return None  # the initials are those of the surname before them
        if self.surname_like(tail):
            return n + 1, "initials", (tail, letters)
        dots = all(x.dotted for x in self.words[i : i + n])
        if dots and tail.cyrillic and self.name_word(tail) and not tail.text.isupper() and not self.lex.is_adjective(tail.text):
            return n + 1, "maybe_initials", (tail, letters)
        return None

    def pair(self, i: int) -> tuple | None:
        w = self.run(i, 2)
        if len(w) < 2 or any(x.letters or not x.capital or len(x.text) < 2 for x in w) or self.geographic(i, 2):
            return None
        given = [self.lex.given(x.text) is not None for x in w]
        like = [self.surname_like(x) for x in w]
        for g, s in ((0, 1), (1, 0)):
            if given[g] and like[s] and not given[s]:
                return 2, "pair", (w[s], w[g], None)
        for g, s in ((0, 1), (1, 0)):
            if given[g] and not given[s] and w[g].cyrillic and self.name_word(w[s]) and not self.lex.is_adjective(w[s].text) and len(w[s].text) > 2 and not w[s].text.isupper():
                return 2, "maybe_pair", (w[s], w[g], None)
        if not w[0].cyrillic and self.russian and all(x.text.istitle() and len(x.text) > 2 and x.text.lower() not in _PRODUCTS for x in w):
            more = self.run(i, 3)
            if not (len(more) > 2 and more[2].capital) and not (i and not self.words[i - 1].cyrillic and _close(self.text, self.words[i - 1], w[0])):
                return 2, "latin", (w[1], w[0], None)
        return None

    def lone(self, i: int) -> tuple | None:
        w = self.words[i]
        if w.letters or len(w.text) < 3 or not w.capital:
            return None
        before = self.words[i - 1] if i else None
        gap = self.text[before.end : w.start].strip() if before else ""
        close = before is not None and gap in ("", ":", ".", "—", "-", "–")
        if close and _HONORIFIC.fullmatch(folded(before.text)) and self.name_word(w):
            return 1, "honorific", (w, None, None)
        if not w.cyrillic and folded(w.text) not in self.lex.surname and not _LATIN_SURNAME.fullmatch(folded(w.text)):
            return None
        if w.text.isupper() or self.geographic(i) or not self.name_word(w):
            return None
        given = self.lex.given(w.text) is not None
        like = self.surname_like(w) and not self.lex.is_toponym(w.text) and not given
        unit = i + 1 < len(self.words) and self.lex.is_adjective(w.text) and not self.words[i + 1].capital and _close(self.text, w, self.words[i + 1])
        if close and like and not unit and gap in ("", ":", "—", "–", "-"):
            if self.lex.is_role(before.text):
                return 1, "role", (w, None, None)
            if self.lex.is_actor(before.text):
                return 1, "actor", (w, None, None)
        if len(self.words) == 1 and like:
            return 1, "cell", (w, None, None)
        if folded(w.text) in self.lex.diminutive_forms and w.cyrillic and not given:
            return 1, "diminutive", (None, w, None)
        if folded(w.text) in self.lex.surname and not unit and not self.lex.is_toponym(w.text):
            return 1, "prose", (w, None, None)
        if w.cyrillic or _LATIN_SURNAME.fullmatch(folded(w.text)):
            return 1, "word", (w, None, None)
        return None

    def __iter__(self) -> Iterator[dict]:
        # Most words begin no mention: each way of reading is tried only where the words hold what it cannot do without.
        named = {i for i, w in enumerate(self.words) if w.capital}
        brief = {k for i, w in enumerate(self.words) if w.letters for k in (i - 1, i)}
        known = self.russian and _MAY_PATRONYMIC.search(self.text)
        full = {k for i, w in enumerate(self.words) if w.cyrillic and _patronymic(w.text) for k in (i - 2, i - 1)} if known else set()
        found, at = [], 0
        for i in sorted(named | brief | full):
            if i < at:
                continue
            got = self.full(i) if i in full else None
            got = got or (self.with_initials(i) if i in brief else None)
            got = got or (self.pair(i) or self.lone(i) if i in named else None)
            if got is not None:
                found.append((i, *got))
                at = i + got[0]
        yield from (self.row(*f) for f in self.listed(found))

    def listed(self, found: list[tuple]) -> list[tuple]:
        """In a list that names at least two people, an item of one or two names is one as well."""
        items = [m.span() for m in _LIST_ITEM.finditer(self.text)]
        if len(items) < 3 or len(self.text) > 20 * sum(f[1] for f in found) + 200:
            return found
        sure = {"full", "initials", "pair", "named"}

        def whole(f: tuple) -> bool:
            a, b = self.words[f[0]].start, self.words[f[0] + f[1] - 1].end
            return any(not self.text[s:a].strip(" .:") and not self.text[b:e].strip(" .") for s, e in items if s <= a and b <= e)

        inside = [f for f in found if whole(f)]
        if sum(f[2] in sure for f in inside) < 2:
            return found
        return [(*f[:2], "list", f[3]) if f[2] in ("word", "cell", "maybe_pair", "prose", "diminutive") and f in inside and not self.geographic(f[0]) else f for f in found]

    def row(self, i: int, n: int, shape: str, parts: tuple) -> dict:
        letters: tuple[str, ...] = ()
        if len(parts) == 2:
            (surname, letters), given, patronymic = parts, None, None
        else:
            surname, given, patronymic = parts
        shapes = [self.lex.shape(p.text) if p else None for p in (patronymic, given, surname)]
        feminine = next((s.feminine for s in shapes if s and s.feminine is not None), None)
        plain = lambda p: self.lex.nominative(p.text, feminine) if p and p.cyrillic else (p.text if p else None)

        def surname_of(p: Word) -> str:
            if not p.cyrillic:
                return p.text
            return "-".join(self.lex.nominative(x, feminine) if self.lex.given(x) is None else x.title() for x in p.text.split("-"))

        return {
            "start": self.words[i].start, "end": self.words[i + n - 1].end, "shape": shape, "surname": surname and surname.text, "given": given and given.text, "patronymic": patronymic and patronymic.text,
            "letters": list(letters), "confidence": SHAPES.get(shape, ("", "", 0.0))[2], "n_surname": surname and surname_of(surname), "n_given": plain(given), "n_patronymic": plain(patronymic), "feminine": feminine,
        }


def mentions(text: str | None, lexicon: Lexicon = DEFAULT) -> list[dict]:
    return list(Reader(text, lexicon)) if text else []


#: A text without these names nobody: a Cyrillic capital, a patronymic, or a Latin name that is a Russian one.
MAY_NAME = r"[А-ЯЁ]|(?:ович|евич|овн|евн|ичн)|\b[A-Z][a-z'-]*(?:ov|ev|in|yn|ova|eva|ina|yna|sky|skiy|skii|ski|skaya|enko|chuk|yan|shvili|dze)\b"


def name_mentions(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """array<MENTION> of a text. Texts that name nobody are passed as null and cost no more."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([mentions(t, lexicon) for t in texts])

    return F.pandas_udf(run, f"array<{MENTION}>")(F.when(text.rlike(MAY_NAME), text))
