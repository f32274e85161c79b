"""Problem 7: text decoded with a wrong encoding, by round-trip repair.

UTF-8 read as a single-byte encoding leaves runs that, encoded back, are well-formed UTF-8. For each candidate encoding the runs that
consist of a lead byte's character and its continuation bytes' characters are encoded back and strictly decoded; of all candidates
the one with the lowest garbling cost wins if it lowers the cost, and the step repeats until the cost no longer falls, for text
garbled more than once. Only the runs change, so text that is garbled in part keeps its sound part. A run of letters only may be sound
(Icelandic has `ðæ`): there fewer characters prove nothing, and what comes out must be of the script of the word around it. Words wholly of Latin-1's upper half are tried as a Cyrillic
single-byte encoding read as Latin and accepted when they come out as Cyrillic words of one case pattern. What is lost (U+FFFD, stray C1 controls, lead bytes whose
continuation is gone) cannot be restored but marks the row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from postmill.runtime import table

CANDIDATES = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "mac_roman", "cp437", "cp850", "iso8859-15", "iso8859-2", "koi8-r")
ODD_TAILS = ("cp1252", "latin-1")  # their continuation bytes are signs and controls; in the other encodings many are everyday letters
_HIGH = re.compile(r"[^\x00-\x7f]")
_RUN = re.compile(r"[^\x00-\x7f]{2,}")
CYRILLIC_CODECS = ("cp1251", "koi8-r", "iso8859-5")
_LATIN_TOP = re.compile("(?<![A-Za-z])[\xc0-\xff\xb8\xa8]{2,}(?![A-Za-z])")
UNAMBIGUOUS = 5  # letters in words of nothing but Latin-1's upper half: no sound Latin text has so many
COMMON_CYRILLIC = "оеаинтсрвлкмдпу"

# Blocks a single restored character may come from (first and last code point); others need the evidence of `_other_script`.
PLAUSIBLE = ((0xA0, 0x17F), (0x1CD, 0x21B), (0x2C6, 0x2DD), (0x300, 0x304), (0x370, 0x3FF), (0x400, 0x45F), (0x490, 0x491), (0x501, 0x51D), (0x1E00, 0x1EFF), (0x2000, 0x2026), (0x202F, 0x203A), (0x2060, 0x2060), (0x20A0, 0x20BF), (0x2100, 0x2122), (0x2190, 0x21FF), (0x2200, 0x22FF), (0x2310, 0x2321), (0x2500, 0x27BF), (0x3000, 0x3002), (0xFB00, 0xFB06), (0xFE0F, 0xFE0F), (0xFEFF, 0xFEFF), (0xFF01, 0xFF5E), (0xFFFD, 0xFFFD), (0x1F000, 0x1FAFF))


def _single_bytes(codec: str) -> list[str | None]:
    """Character of each byte; a byte that the encoding leaves undefined reads as its C1 control, as browsers do."""
    return [bytes([b]).decode(codec, "ignore") or (chr(b) if b >= 0x80 else None) for b in range(256)]


@lru_cache(maxsize=None)
def _reader(codec: str) -> tuple[re.Pattern, dict[int, int]]:
    chars = _single_bytes(codec)
    to_byte: dict[int, int] = {}
    for b in range(0x80, 0x100):
        to_byte.setdefault(ord(chars[b]), b)
    span = lambda lo, hi: "[" + "".join(re.escape(chars[b]) for b in range(lo, hi + 1)) + "]"
    tail = span(0x80, 0xBF)
    if codec in ("cp1251", "koi8-r"):  # a Cyrillic letter before a no-break space is ordinary text there
        tail = tail.replace("\xa0", "")
    return re.compile(f"(?:{span(0xC2, 0xDF)}{tail}|{span(0xE0, 0xEF)}{tail}{{2}}|{span(0xF0, 0xF4)}{tail}{{3}})+"), to_byte


@lru_cache(maxsize=65536)
def _plausible(c: str) -> bool:
    return any(lo <= ord(c) <= hi for lo, hi in PLAUSIBLE)


@lru_cache(maxsize=65536)
def _char_cost(c: str) -> int:
    point = ord(c)
    if point < 0x80:
        return 0
    if point == 0xFFFD or 0x80 <= point < 0xA0:
        return 6
    kind = unicodedata.category(c)
    if kind[0] == "L":
        return 2
    return 2 if c in "£€’‘“”–—«»¡¿…°\xa0" else 4


def cost(text: str) -> int:
    """Garbling cost: what its characters beyond ASCII weigh; damage and odd symbols weigh most."""
    return sum(map(_char_cost, _HIGH.findall(text)))


def _undo(text: str, codec: str) -> str:
    pattern, to_byte = _reader(codec)

    def back(m: re.Match) -> str:
        try:
            restored = bytes(to_byte[ord(c)] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()
        sound = _sound_in_cyrillic(m, restored) if codec in CYRILLIC_CODECS else all(map(_plausible_or_layer, restored)) or _other_script(restored)
        return restored if sound and (codec in ODD_TAILS or not m.group().isalpha() or _fits_word(m, restored)) else m.group()

    return pattern.sub(back, text)


def _fits_word(m: re.Match, restored: str) -> bool:
    """Whether letters restored out of nothing but letters are of the script of the letters beside them, or several that stand alone; signs always fit."""
    letters = {_alphabet(c) for c in restored if c.isalpha()}
    edges = {_alphabet(c) for c in m.string[m.start() - 1 : m.start()] + m.string[m.end() : m.end() + 1] if c.isalpha()}
    return not letters or (letters <= edges if edges else len(restored) > 1)


def _sound_in_cyrillic(m: re.Match, restored: str) -> bool:
    """Pairs of Cyrillic letters also stand in sound words (and in Latin ones written with look-alikes): a run counts only if it gives Latin letters or punctuation, or a whole Cyrillic word."""
    if all("\xa0" <= c <= "\u017f" or "\u2010" <= c <= "\u203a" or c in "€™" for c in restored):
        return True
    text = m.string
    edges = text[m.start() - 1 : m.start()] + text[m.end() : m.end() + 1]
    return len(restored) > 1 and _cyrillic_word(restored) and not any(map(str.isalpha, edges))


@lru_cache(maxsize=65536)
def _script(c: str) -> str:
    """The script of a letter beyond Latin, by the first word of its name; the scripts that East Asian text mixes are one."""
    if c < "\u0250" or unicodedata.category(c)[0] != "L":
        return ""
    name = re.split("[ -]", unicodedata.name(c, ""), maxsplit=1)[0]
    return {"HIRAGANA": "CJK", "KATAKANA": "CJK", "HANGUL": "CJK", "BOPOMOFO": "CJK", "FULLWIDTH": "", "HALFWIDTH": "CJK", "LATIN": "", "MODIFIER": ""}.get(name, name)


def _alphabet(c: str) -> str:
    return _script(c) or ("LATIN" if c < "\u0250" else "")


def _other_script(text: str) -> bool:
    """Assigned characters with at least two letters beyond Latin, all of one script: two letters side by side do not come out of sound text by chance."""
    scripts = [x for x in map(_script, text) if x]
    return len(scripts) > 1 and len(set(scripts)) == 1 and all(_plausible_or_layer(c) or _script(c) or (c >= "\u0590" and unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs")) for c in text)


def _plausible_or_layer(c: str) -> bool:
    return _plausible(c) or 0x80 <= ord(c) < 0xA0


def _cyrillic_word(word: str) -> bool:
    return all("\u0401" <= c <= "\u0451" for c in word) and (word[1:].islower() or word.isupper())


def _undo_cyrillic(text: str) -> str:
    """Words of Latin-1's upper half read again as Cyrillic, if most of them fit one encoding: three of them, or fewer of UNAMBIGUOUS letters together."""
    words = _LATIN_TOP.findall(text)
    if not words or 2 * min(cost(_undo(text, c)) for c in ("cp1252", "latin-1")) <= cost(text):  # UTF-8 in Latin's letters
        return text
    least = 3 if sum(map(len, words)) < UNAMBIGUOUS else 1
    best, codec_of = 0.0, ""
    for codec in CYRILLIC_CODECS:
        tried = [w.encode("latin-1").decode(codec, "replace") for w in words]
        good = [w for w in tried if _cyrillic_word(w)]
        if len(good) >= max(least, 0.8 * len(tried)):
            weight = sum(w.lower().count(c) for w in good for c in COMMON_CYRILLIC) / sum(map(len, tried))
            if weight > best:
                best, codec_of = weight, codec
    if best < 0.5:
        return text
    return re.sub("(?<![A-Za-z])[\xc0-\xff\xb8\xa8]+(?![A-Za-z])", lambda m: m.group().encode("latin-1").decode(codec_of, "replace"), text)


def restore(text: str) -> tuple[str, int]:
    """The text with its garbled runs restored, and the number of layers undone (0: none)."""
    layers = 0
    if (again := _undo_cyrillic(text)) != text:
        text, layers = again, 1
    while (runs := "\n".join(set(_RUN.findall(text)))):
        best, least = text, None
        for codec in CANDIDATES:
            if not _reader(codec)[0].search(runs):
                continue
            least = cost(text) if least is None else least
            tried = _undo(text, codec)
            if tried != text and (now := cost(tried)) < least:
                best, least = tried, now
        if best == text:
            break
        text, layers = best, layers + 1
    return text, layers


# What stays behind where bytes were lost: replacement marks, C1 controls, a UTF-8 lead read as cp1252 before a blank or mark inside or at the edge of a word.
_LOST = re.compile("[�\x80-\x84\x86-\x9f]|\\bâ(?=\\s|\\b€)|(?<=\\s)â€|Ã(?=[\\s.,;:!?]*[a-z]{2})(?<=[a-z]Ã)|Ã(?=\\s|$)(?<=\\sÃ)|Â(?=[£€\\s]\\s?\\d)")


def is_garbled(text: str) -> bool:
    return not text.isascii() and (restore(text)[1] > 0 or bool(_LOST.search(text)))


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        done = [(None, 0) if t is None else (t, 0) if t.isascii() else restore(t) for t in texts]
        lost = [t is not None and not t.isascii() and _LOST.search(t) is not None for t in texts]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32()), pa.array([x or d[1] > 0 for x, d in zip(lost, done)], pa.bool_())],
            names=["id", "restored", "layers", "garbled"],
        )


def repair_encoding(df: DataFrame, id_col: str = "msg_id", text_col: str = "text") -> DataFrame:
    """(id, restored, layers, garbled) for every row: the text restored as far as possible, the layers undone, whether it is garbled at all.

    A null text stays null and is not garbled, nor is an empty one. A map over rows: no shuffle. Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_repairs, f"id {kind}, restored string, layers int, garbled boolean")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_encoding(table(spark, sf_dir, "corpus")).filter("garbled").select(F.col("id").alias("msg_id"))


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its text as far as it can be restored."""
    return repair_encoding(table(spark, sf_dir, "corpus")).withColumnRenamed("id", "msg_id")
