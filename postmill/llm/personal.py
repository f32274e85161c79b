"""Problem 5: personal information in free text, found by patterns, confirmed by validators, weighed by context.

Patterns propose spans. Where a kind of number carries a check digit (mod-97 for account numbers, MOD 11,10 for German tax numbers, the
letter of Spanish identity numbers, Luhn for card-like ones) or a public numbering rule (areas of social security numbers, prefixes of
national insurance numbers, the date inside a driving licence), a number that passes is found by itself; one that fails needs words
before it that tell what it is, as numbers in mail are mistyped, and those of examples come from ranges that are never issued. Words
near a span adjust the score both ways: before a number `passport`, `SSN` or `call` speak for it, `order`, `parcel` or `bug` against it.
Names need a list of names, which may be incomplete: a given name and a surname of the list are a name; where one of them is unknown,
an ending that many surnames of the list share and the words around (titles, `wrote`, an address behind it) must tell, and no word
that makes it a street, a firm or a place. Overlapping spans give way to the better score. A text is scanned once and whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postmill.llm.lookalike import _TABLE as skeleton_table
from postmill.runtime import cut, table

ACCEPT = 0.5
NAMES_HELD = 100_000  # entries of a name list that a task holds; a longer list is joined
CONFIRMED = 0.55  # what a passed validator gives
UNCONFIRMED = {"nino": 0.35, "ssn": 0.35, "licence": 0.35, "tax": 0.1, "iban": 0.2, "dni": 0.2}

# Words that speak for or against a number, by kind.
ID_WORDS = (
    r"id|passport|ssn|soc(?:ial|\.)? sec(?:urity|\.)?|national insurance|ni|nino|national id|identity card|identity|id card|driving licen[cs]e|driver['’]?s? licen[cs]e|licen[cs]e|"
    r"tax(?:payer)?(?: id)?|steuer-?id(?:nr)?|steuernummer|tin|itin|dni|nif|nie|cpf|nhs|personalausweis|reisepass|aadhaar|insee|ausweis"
)
PHONE_WORDS = r"call|ring|phone|tel|telephone|mobile|mob|text|txt|number is|contact|fax|whatsapp|direct|t|dial"
OTHER_WORDS = r"order|invoice|parcel|tracking|meter|reading|bug|version|ref|reference|case|ticket|code|card ending|account|policy|item|serial|booking|flight|case|receipt|batch|part|model|isbn|registered office"
TITLES = "mr|mrs|ms|miss|dr|prof|sir|madam|herr|frau|m|mme|señor|señora|sr|sra"
STREETS = "road|rd|street|st|lane|ln|close|crescent|cres|avenue|ave|drive|terrace|way|court|ct|place|pl|square|sq|gardens|grove|hill|park|row|walk|mews|boulevard|blvd|green|rise|view"
STREET_BEFORE = "rue|avenue|boulevard|place|chemin|allée|quai|calle|avenida|plaza|paseo|viale|piazza|rua|travessa|praça"
STREET_JOINED = "straße|strasse|str.|weg|gasse|allee|platz|damm|ring|ufer"
NOT_NAMES = (
    "the a an and or but for from with this that these those our your my his her their its we you they he she it on in at to of by as is are was were be if when where who what how why not no yes "
    "please thanks hello hi dear subject re fwd fw order call text reply click visit attached minutes could did has have had will may let me got order confirm witness send pick contact tip best kind regards cheers yours "
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december "
    "group office partners ltd limited inc llc gmbh council society library energy tax bank road street lane avenue close drive terrace crescent way square court "
    "sent from date mail phone tel version invoice parcel national insurance passport driving licence order meter reading code flat apt"
)
STOP = frozenset(NOT_NAMES.split()) | frozenset(TITLES.split("|"))
FIRMS = "group|office|partners|ltd|limited|inc|llc|gmbh|plc|company|council|bank|society|services|road|rd|street|st|lane|close|crescent|avenue|ave|drive|terrace|way|court|square|station|bridge|library|courtyard|stadium|school|hotel|park|church|side"

SPACE = r"[^\S\n]"
EMAIL = re.compile(
    r"(?<![\w.+-])(?:\w[\w+'-]*[^\S\n]?[\[({][^\S\n]?dot[^\S\n]?[\])}][^\S\n]?)*[\w][\w.+'-]*(?:"
    r"@[\w-]+(?:\.[\w-]+)+"
    r"|[^\S\n]?(?:[\[({<][^\S\n]?(?:at|@)[^\S\n]?[\])}>]|[^\S\n]at[^\S\n](?=[\w-]+[^\S\n][\[({]?dot\b))[^\S\n]?[\w-]+(?:(?:[^\S\n]?[\[({<][^\S\n]?(?:dot|\.|punkt)[^\S\n]?[\])}>][^\S\n]?|[^\S\n]dot[^\S\n]|\.)[\w-]+)+"
    r"|@[\w-]+(?:(?:[^\S\n]?[\[({][^\S\n]?dot[^\S\n]?[\])}][^\S\n]?|[^\S\n]dot[^\S\n])[\w-]+)+"
    r")(?![\w@])",
    re.IGNORECASE,
)
PHONE = re.compile(r"(?<![\w.,/£$€+-])(?:\+|00|\(|0|1[- .]?\(?|)(?:\d|[ \n.\-()/](?=[\d( ])){7,20}\d(?![\w]|[.,:/-]\d)")
ID_NUMBER = re.compile(
    r"(?<![\w/.-])(?=[A-Z9]{0,5}[ ]?\d)(?:"
    r"(?P<nino>[A-Z]{2}[ \n-]?\d{2}[ \n-]?\d{2}[ \n-]?\d{2}[ \n-]?[A-D])"
    r"|(?P<ssn>\d{3}[ \n-]\d{2}[ \n-]\d{4})"
    r"|(?P<licence>[A-Z9]{5}\d{6}[A-Z9]{2}\w[A-Z]{1,2})"
    r"|(?P<passport>[A-Z]{1,2}[ ]?\d{6,8})"
    r"|(?P<tax>\d{11}|\d{2}[ \n]\d{3}[ \n]\d{3}[ \n]\d{3})"
    r"|(?P<grouped>\d{3,4}(?:[ -]\d{2,4}){2,3})"
    r"|(?P<iban>[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?)"
    r"|(?P<dni>\d{8}[ -]?[A-Z])"
    r"|(?P<plain>[A-Z0-9]*\d[A-Z0-9]{5,17}))(?![\w]|[-/]\w)",
    re.IGNORECASE,
)
_UNIT = r"(?:flat|apt\.?|apartment|unit|suite|wohnung)[^\S\n]?\w{1,5}"
ADDRESS = re.compile(
    rf"(?<![\w/£$€.,-])(?:{_UNIT},?\s)?\d{{1,4}}[A-Za-z]?,?\s(?:[^\W\d_][\w'’-]*\s){{1,3}}(?:(?:ave|blvd|cres)\b\.?|(?:{STREETS})\b(?:\.(?=,|[^\S\n][a-z]))?)(?:,?\s{_UNIT})?"
    rf"|(?<![\w/£$€.,-])(?:{_UNIT},?\s)?\d{{1,4}}[A-Za-z]?,?\s(?:{STREET_BEFORE})\s(?:(?:de|des|du|la|le|les|del|della|da|do|dos)\s){{0,2}}[^\W\d_][\w'’-]+(?:,?\s{_UNIT})?",
    re.IGNORECASE,
)
JOINED = re.compile(rf"(?<![\w])[^\W\d_][\w-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|damm|ufer)\s\d{{1,4}}[A-Za-z]?(?![\w])(?:,?\s{_UNIT})?", re.IGNORECASE)
_JOINED_HINT = re.compile(r"(?:straße|strasse|str\.|weg|gasse|allee|platz|damm|ufer)\s\d", re.IGNORECASE)
_PART = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))+"
_CAPITAL = "[A-Z\u00c0-\u00de\u0160\u017d\u0141\u0150\u0130]"


def _name_pattern(first: str) -> re.Pattern:
    part = _PART.replace(r"[^\W\d_]", first, 1)
    return re.compile(rf"(?<![\w@.'’-])(?:(?P<a>{part})(?P<comma>,?)(?P<gap>[^\S\n]+|[^\S\n]*\n)(?:(?P<mid>{first}\.?)[^\S\n]+)?(?P<b>{part})|(?P<ini>{first})\.[^\S\n]?(?P<c>{part}))(?![\w@])")


NAME, NAME_SMALL = _name_pattern(_CAPITAL), _name_pattern(r"[^\W\d_]")
_NAME_BEFORE = re.compile(r"(?:witness|from|von|to|dr|name is|quoting|contact|reach|by|schrieb|for|mr|mrs|ms)\b[:.]?\*?\s+$", re.IGNORECASE)
_LINE_BEFORE = re.compile(r"(?:^|\n|\d,)[^\S\n]*(?:[>|*][^\S\n]*)*$")
_LINE_AFTER = re.compile(r"[^\S\n]*(?:\n|[|[(–-]|$)")
_SPEAKS_AFTER = re.compile(r"\s+(?:<|wrote\b|writes\b|schrieb\b|a écrit\b|moved\b)|[^\S\n]*\n\S*@", re.IGNORECASE)
_LEFT = 42


_AT = re.compile(r"[\[({<] ?at|\bat [\w-]+ (?:dot|[\[({])", re.IGNORECASE)
_ANY_DIGIT = re.compile(r"\d")
_STREET_WORDS = frozenset(f"{STREETS}|{STREET_BEFORE}|flat|apt|de|des|du|la|le".split("|"))


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return turned.isalnum() and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def tax_check(digits: str) -> bool:
    """German tax number: ISO 7064 MOD 11,10."""
    product = 10
    for c in digits[:-1]:
        total = (int(c) + product) % 10 or 10
        product = total * 2 % 11
    return (11 - product) % 10 == int(digits[-1])


def dni_check(value: str) -> bool:
    """Spanish identity number: the letter is the number modulo 23 in a fixed order."""
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(re.sub(r"\D", "", value)) % 23] == value[-1].upper()


def ssn_rule(digits: str) -> bool:
    """Social security numbers have no area 000, 666 or 9xx, no group 00 and no serial 0000."""
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def nino_rule(value: str) -> bool:
    """National insurance numbers: letters and pairs that no prefix has; QQ is that of public examples."""
    prefix = value[:2].upper()
    return prefix == "QQ" or (prefix[0] not in "DFIQUV" and prefix[1] not in "DFIQUVO" and prefix not in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ"))


def licence_rule(value: str) -> bool:
    """British driving licences hold a month (plus 50 for women) and a day."""
    month, day = int(value[6:8]) % 50, int(value[8:10])
    return 1 <= month <= 12 and 1 <= day <= 31 and int(value[6:8]) < 63


_ID_BEFORE = re.compile(rf"\b(?:{ID_WORDS})\b['’]?(?:[\s:#.!*]|no|nr|number|num|card|card no|code|is)*$", re.IGNORECASE)
_LOCAL_PHONE = re.compile(r"\+?\(?0?\d{2,4}\)?[- ./]?\d{3,4}(?:[- ]\d{2})?")
_PHONE_BEFORE = re.compile(rf"\b(?:{PHONE_WORDS})\b[^\n\d]{{0,24}}$", re.IGNORECASE)
_OTHER_BEFORE = re.compile(rf"\b(?:{OTHER_WORDS})\b(?:[\s:#.]|no|nr|number|num)*$", re.IGNORECASE)
_TITLE_BEFORE = re.compile(rf"\b(?:{TITLES})\.?[^\S\n]+$", re.IGNORECASE)
_FIRM_AFTER = re.compile(rf"[^\S\n]+(?:[\w'-]+[^\S\n]+)?(?:{FIRMS})\b", re.IGNORECASE)
_NUMBER_BEFORE = re.compile(r"(?<![:.\d])\d{1,4}[A-Za-z]?,?[^\S\n]$")  # a house number, not a time


def flatten(text: str) -> tuple[str, list[int] | None]:
    """The text as patterns read it, and the place of each of its characters in `text` (None: the same places).

    Letters of other widths or scripts that look Latin are folded, odd blanks and hyphens made plain, invisible characters left out,
    accents joined to their letters.
    """
    if text.isascii():
        return text, None
    out: list[str] = []
    place: list[int] = []
    for i, c in enumerate(text):
        if c < "\x80":
            out.append(c), place.append(i)
            continue
        piece = _folded(c)
        if out and len(piece) == 1 and unicodedata.combining(piece):
            joined = unicodedata.normalize("NFC", out[-1] + piece)
            out[-1] = joined if len(joined) == 1 else out[-1]
            continue
        for x in piece:
            out.append(x), place.append(i)
    return "".join(out), place


@lru_cache(maxsize=100_000)
def _folded(c: str) -> str:
    return unicodedata.normalize("NFC", skeleton_table[ord(c)])


class Finder:
    """Finds personal data in texts. given, surnames: the list of names; it may be incomplete and hold ordinary words."""

    ENDING = range(4, 7)  # lengths of endings

    def __init__(self, given: set[str], surnames: set[str], endings: set[str] | None = None):
        """endings: those of the whole list, where `given` and `surnames` are a part of it."""
        fold = lambda names: {n.casefold() for n in names if n}
        self.given, self.surnames = fold(given), fold(surnames)
        if endings is None:  # an ending that many surnames of the list share speaks for a surname outside the list
            counts = Counter(name[-k:] for name in self.surnames for k in self.ENDING if len(name) > k + 2)
            endings = {e for e, n in counts.items() if n >= self.least_of(len(self.surnames))}
        self.endings = endings

    @staticmethod
    def least_of(surnames: int) -> int:
        """Surnames that must share an ending: a share, so that the endings are never more than a few hundred."""
        return max(4, surnames // 60)

    def surname(self, word: str) -> int:
        """2: a surname of the list; 1: a word with an ending of surnames; 0: neither."""
        low = word.casefold()
        if low in self.surnames:
            return 2
        return int(low not in self.given and any(low[-k:] in self.endings for k in self.ENDING if len(low) > k + 2))

    @staticmethod
    def _confirmed(kind: str, value: str, digits: str) -> bool:
        """What the validator of a kind says; kinds without one are never confirmed. A card number is no number of a person, so Luhn speaks against one (`numbers`)."""
        if kind == "tax":
            return len(value) > 11 and value[0] != "0" and tax_check(digits)  # eleven digits in a row are as often a telephone number
        if kind == "iban":
            return mod97(re.sub(r"\s", "", value).upper())
        if kind == "dni":
            return dni_check(value)
        if kind == "ssn":
            return ssn_rule(digits)
        return (kind == "nino" and nino_rule(value)) or (kind == "licence" and licence_rule(value))

    def numbers(self, text: str) -> Iterator[Span]:
        for m in ID_NUMBER.finditer(text):
            kind, value = m.lastgroup, m.group()
            before = text[max(0, m.start() - _LEFT) : m.start()]
            digits = re.sub(r"\D", "", value)
            score = CONFIRMED if self._confirmed(kind, value, digits) else UNCONFIRMED.get(kind, 0.0)
            if kind == "nino" and not (value[:2].isupper() or value[:2].islower()):
                score -= 0.3  # a word and a number
            if kind == "grouped" and len(digits) == 16 and luhn(digits):
                score -= 0.6
            if _ID_BEFORE.search(before):
                score += 0.7
            elif _OTHER_BEFORE.search(before):
                score -= 0.6
            if digits and score >= ACCEPT:
                yield Span(m.start(), m.end(), "id_number", score)
        for m in PHONE.finditer(text):
            value = m.group()
            start = m.start() + (len(value) - len(value.lstrip(" \n.-/)")))
            value = text[start : m.end()]
            if "\n" in value:  # a number broken by a line end, or one on either side of it
                head, _, rest = value.partition("\n")
                if len(re.sub(r"\D", "", head)) >= 9:
                    value = head.rstrip(" .-/(")
                elif "\n" in rest or len(re.sub(r"\D", "", value)) > 13:
                    start += len(head) + 1
                    value = rest.partition("\n")[0]
            if value.count("(") != value.count(")"):
                if value.startswith("(") or ")" not in value:
                    start, value = start + value.count("("), value.replace("(", "")
                if value.count("(") != value.count(")"):
                    continue
            digits = re.sub(r"\D", "", value)
            before = text[max(0, start - _LEFT) : start]
            if not 7 <= len(digits) <= 15 or len(re.findall(r"[^\d]{3,}", value)):
                continue
            score = 0.0
            if len(digits) < 9 and not (_LOCAL_PHONE.fullmatch(value) and _PHONE_BEFORE.search(before)):
                continue  # seven or eight digits are a local number only where the words before say so
            if value[0] == "+" or digits.startswith("00"):
                score += 0.6
            elif digits[0] == "0" and 10 <= len(digits) <= 12:
                score += 0.5
            elif re.fullmatch(r"(?:1[- .]?)?(?:\(\d{3}\)[ -]?|\d{3}[-. ])\d{3}[-. ]\d{4}", value):
                score += 0.5
            if _PHONE_BEFORE.search(before):
                score += 0.2 if len(digits) >= 9 else 0.5
            if _OTHER_BEFORE.search(before) or _ID_BEFORE.search(before):
                score -= 0.6
            if re.fullmatch(r"(?:19|20)\d\d[-./]\d\d[-./]\d\d.*|\d{1,2}[-./]\d{1,2}[-./]\d{2,4}.*", value):
                score -= 0.6
            if score >= ACCEPT:
                yield Span(start, start + len(value), "phone", score)

    def names(self, text: str) -> Iterator[Span]:
        at = 0
        pattern = NAME_SMALL if text.islower() else NAME
        while m := pattern.search(text, at):
            at = m.start() + 1
            while at < len(text) and (text[at].isalpha() or text[at] in "'’-"):
                at += 1
            found = self._initial(text, m) if m["ini"] else self._pair(text, m)
            if found:
                yield found
                at = found.end

    def _initial(self, text: str, m: re.Match) -> Span | None:
        last = m["c"]
        if not m["ini"].isupper() and not text.islower() or last.casefold() in STOP:
            return None
        known = self.surname(last)
        if known and not _FIRM_AFTER.match(text, m.end()) and (known == 2 or self._told(text, m)):
            return Span(m.start(), m.end(), "name", 0.8 if known == 2 else 0.6)
        return None

    def _told(self, text: str, m: re.Match) -> bool:
        """Whether the words around tell that this is a person."""
        before, after = text[max(0, m.start() - _LEFT) : m.start()], text[m.end() : m.end() + 24]
        return bool(_TITLE_BEFORE.search(before) or _NAME_BEFORE.search(before) or _SPEAKS_AFTER.match(after) or (_LINE_BEFORE.search(before) and _LINE_AFTER.match(after)))

    def _pair(self, text: str, m: re.Match) -> Span | None:
        a, b = m["a"], m["b"]
        la, lb = a.casefold(), b.casefold()
        if la in STOP or lb in STOP or len(a) < 2 or len(b) < 2:
            return None
        upper = (a[0].isupper(), b[0].isupper())
        if upper[0] != upper[1] or (m["mid"] and m["mid"][0].isupper() != upper[0]):
            return None
        score = 0.0
        before = text[max(0, m.start() - _LEFT) : m.start()]
        ga, gb, sa, sb = la in self.given, lb in self.given, self.surname(a), self.surname(b)
        if m["comma"]:
            score = 0.8 if sa and gb else 0.55 if upper[1] and not sb and (sa == 2 and self._name_end(text, m.end()) or sa and self._told(text, m)) else 0.0
        elif ga and sb or sa and gb:
            score = 0.9 if max(sa, sb) == 2 else 0.8
        elif sb == 2 and not sa or (sb and not sa and self._told(text, m)):
            score = 0.6
        elif sa and not sb and (sa == 2 or self._told(text, m)):
            score = 0.55 if self._name_end(text, m.end()) else 0.4
        elif ga and upper[1] and _NAME_BEFORE.search(before) and self._name_end(text, m.end()):
            score = 0.55
        if "\n" in m["gap"] and score < 0.8:
            return None
        if score and not upper[0]:  # small letters: both halves must be known, or the words around tell
            score = 0.6 if (ga and sb) or (sa and gb) or (sb and self._told(text, m)) else 0.0
        if _TITLE_BEFORE.search(before):
            score += 0.2 if score else 0.0
        if (_NUMBER_BEFORE.search(before) and score < 0.9) or _FIRM_AFTER.match(text, m.end()):
            score -= 0.6
        if score >= ACCEPT:
            return Span(m.start(), m.end(), "name", min(score, 1.0))
        return None

    @staticmethod
    def _name_end(text: str, end: int) -> bool:
        return end >= len(text) or text[end] in "\n,.;:<>()|?!" or text[end : end + 2] in (" <", " (", " |", " -", " –", " m", " w", " a", " s", " i")

    def _addresses(self, text: str) -> Iterator[Span]:
        for m in ADDRESS.finditer(text):
            words = re.findall(r"(?<!\w)[^\W\d_]+", m.group().casefold())
            if not any(w in STOP and w not in _STREET_WORDS for w in words[:-1]):
                yield Span(*m.span(), "address", 0.85)
        if _JOINED_HINT.search(text):
            for m in JOINED.finditer(text):
                yield Span(*m.span(), "address", 0.85)

    def find(self, text: str) -> list[Span]:
        """Spans of `text`, in order, none overlapping."""
        flat, place = flatten(text)
        spans = [Span(*m.span(), "email", 0.95) for m in EMAIL.finditer(flat)] if "@" in flat or _AT.search(flat) else []
        if _ANY_DIGIT.search(flat):
            spans += self.numbers(flat)
            spans += self._addresses(flat)
        spans += self.names(flat)
        spans.sort(key=lambda s: (-s.score, s.start - s.end))
        taken: list[Span] = []
        for s in spans:
            if all(s.end <= t.start or s.start >= t.end for t in taken):
                taken.append(s)
        taken.sort(key=lambda s: s.start)
        if place is None:
            return taken
        return [Span(place[s.start], self._end(text, place[s.end - 1] + 1), s.kind, s.score) for s in taken]

    @staticmethod
    def _end(text: str, end: int) -> int:
        while end < len(text) and unicodedata.combining(text[end]):
            end += 1
        return end

    def replace(self, text: str) -> str:
        out, at = [], 0
        for s in self.find(text):
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
            at = s.end
        return "".join(out) + text[at:]


def _found(finder_of) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kinds, texts = [], [], []
            for i, text, names in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for s in finder_of(names).find(text) if text else ():
                    ids.append(i), kinds.append(s.kind), texts.append(text[s.start : s.end])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=["id", "kind", "found_text"])

    return run


def _masked(finder_of) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masked = [t and finder_of(n).replace(t) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(masked, pa.string())], names=["id", "masked"])

    return run


def _words_of_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word of a text that stands where a name could, once a text, case folded."""
    for b in batches:
        rows, words = [], []
        for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            flat = flatten(text)[0] if text else ""
            own = {w.casefold() for w in re.findall(_PART, flat)}
            rows += [row] * len(own)
            words += own
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(words, pa.string())], names=["row", "word"])


def _search(rows: DataFrame, names: DataFrame, job, schema: str, held: int) -> DataFrame:
    """`job` over (id, text) with the names it needs.

    A list of up to `held` entries is held by each task. A longer one stays a table: the words of each text are joined to it, and
    each row carries the entries that occur in it; the endings of surnames, at most 180 as each is shared by a sixtieth of
    them, are counted in Spark. Both ways find the same.
    """
    listed = names.select(_fold(F.col("name_text")).alias("word"), F.col("name_kind").alias("kind")).filter("word <> '' and kind in ('given', 'surname')").distinct()
    some = listed.limit(held + 1).collect()
    if len(some) <= held:
        given, surnames = ({r[0] for r in some if r[1] == kind} for kind in ("given", "surname"))

        def of_all(batches):
            finder = Finder(given, surnames)
            return job(lambda _: finder)(batches)

        return rows.select("id", "text", F.lit(None).cast("string").alias("names")).mapInArrow(of_all, schema)
    surnames = listed.filter("kind = 'surname'").select("word")
    least = Finder.least_of(surnames.count())
    cut_off = surnames.select(F.explode(F.array(*(F.when(F.length("word") > k + 2, F.right("word", F.lit(k))) for k in Finder.ENDING))).alias("ending"))
    endings = {r[0] for r in cut_off.filter("ending is not null").groupBy("ending").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).collect()}
    kept = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    words = kept.select("row", "text").mapInArrow(_words_of_names, "row bigint, word string")
    known = words.join(listed, "word").groupBy("row").agg(F.to_json(F.struct(*(F.collect_set(F.when(F.col("kind") == k, F.col("word"))).alias(k) for k in ("given", "surname")))).alias("names"))

    def of_each(batches):
        def finder_of(own: str | None) -> Finder:
            sets = json.loads(own) if own else {}
            return Finder(set(sets.get("given", ())), set(sets.get("surname", ())), endings)

        return job(finder_of)(batches)

    return kept.join(known, "row", "left").select("id", "text", "names").mapInArrow(of_each, schema)


def _fold(c: Column) -> Column:
    return F.pandas_udf(lambda names: names.map(lambda n: n.strip().casefold(), na_action="ignore"), "string")(c.cast("string"))


def personal_data(df: DataFrame, names: DataFrame, id_col: str = "msg_id", text_col: str = "text", held: int = NAMES_HELD) -> DataFrame:
    """(id, kind, found_text): each distinct piece of personal data of each row, as it stands in the text.

    Rows without id or text, and empty texts, give nothing; an empty name list leaves names unfound. A map over rows, no shuffle but
    the last `distinct`; a name list of more than `held` entries is joined instead of held. Other columns are not read.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    return _search(rows, names, _found, "id bigint, kind string, found_text string", held).distinct()


def mask_personal_data(df: DataFrame, names: DataFrame, id_col: str = "msg_id", text_col: str = "text", held: int = NAMES_HELD) -> DataFrame:
    """(id, masked) for every row: the text with each piece replaced by its kind in brackets; null for a null text."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return _search(rows, names, _masked, f"id {df.schema[id_col].dataType.simpleString()}, masked string", held)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "corpus"), table(spark, sf_dir, "name_list")).withColumnRenamed("id", "msg_id")


def p5_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_personal_data(table(spark, sf_dir, "corpus"), table(spark, sf_dir, "name_list")).withColumnRenamed("id", "msg_id")
