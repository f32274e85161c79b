"""Problem 10: text statistics per document and its nearest structural profile, by Jensen-Shannon divergence.

Each line of a text is a distribution over token classes (function words, other words, numbers, machine strings, separators, symbols,
sentence marks). It takes the class of the profile with the least Jensen-Shannon divergence; prose has one profile for each kind of
language (function words of the languages listed, and words of up to three letters, which carry grammar in any alphabetic language).
Short lines have too few tokens to tell and go with the line before them. A document is prose unless more than half of its words
stand in lines of another class.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from postmill.runtime import table

# Common function words by language.
FUNCTION_WORDS = {
    "en": "the a an and or but if of to in on at by for with from as is are was were be been has have had do does did will would can could should may might must not no it its this that these those you your we our they their he she his her who which what when where there then than so please every each",
    "de": "der die das den dem des ein eine einen einem einer und oder aber nicht ist sind war wird werden hat haben zu zum zur mit von vom für auf aus bei nach vor über unter ich du er sie wir ihr mein dein sein uns euch bitte erst sonst weil dass wenn als wie noch schon",
    "fr": "le la les un une des du de et ou mais que qui ne pas est sont sera était dans sur sous pour par avec sans il elle nous vous ils elles ce cette ces son sa ses votre notre leur au aux même déjà très ainsi où avant après",
    "es": "el la los las un una unos unas y o pero que quien no es son está están fue será en de del al con sin por para según su sus nuestro vuestro lo se me te nos más muy también además antes después así dice tu",
    "pt": "o a os as um uma uns umas e ou mas que quem não é são está estão foi será em de do da dos das no na nos nas com sem por para seu sua seus suas mais muito também antes depois lá diz",
    "ru": "и в на не что с по за из у до к о от для это как но он она они мы вы его ваш наш после перед или если уже ещё код",
}
COMMON = frozenset(w for words in FUNCTION_WORDS.values() for w in words.split())

CLASSES = ("function", "word", "number", "machine", "separator", "symbol", "mark", "comma")
# Profiles over CLASSES. Kinds that are prose come first.
PROFILES = {
    "prose": (0.38, 0.47, 0.03, 0.00, 0.00, 0.01, 0.07, 0.04),
    "prose_marked": (0.28, 0.42, 0.06, 0.00, 0.00, 0.04, 0.14, 0.06),
    "prose_terse": (0.17, 0.58, 0.08, 0.01, 0.01, 0.03, 0.06, 0.06),
    "list": (0.02, 0.60, 0.04, 0.00, 0.32, 0.01, 0.00, 0.01),
    "list_numbers": (0.02, 0.40, 0.28, 0.00, 0.27, 0.02, 0.00, 0.01),
    "list_pairs": (0.01, 0.52, 0.00, 0.00, 0.20, 0.00, 0.00, 0.27),
    "pairs": (0.01, 0.66, 0.01, 0.00, 0.00, 0.00, 0.00, 0.32),
    "keywords": (0.05, 0.93, 0.01, 0.00, 0.00, 0.00, 0.01, 0.00),
    "table": (0.02, 0.24, 0.36, 0.01, 0.36, 0.01, 0.00, 0.00),
    "table_words": (0.02, 0.52, 0.03, 0.00, 0.42, 0.01, 0.00, 0.00),
    "machine": (0.02, 0.06, 0.06, 0.70, 0.04, 0.11, 0.00, 0.01),
    "log": (0.02, 0.20, 0.28, 0.14, 0.20, 0.15, 0.00, 0.01),
    "code": (0.02, 0.24, 0.12, 0.10, 0.22, 0.26, 0.01, 0.03),
    "symbols": (0.01, 0.02, 0.07, 0.01, 0.12, 0.67, 0.06, 0.04),
}
PROSE = frozenset(k for k in PROFILES if k.startswith("prose"))
SHORT = 4  # words; a line with fewer goes with the line before

_TOKEN = re.compile(r"(?P<url>(?:(?i:https?)://|(?i:www)\.)\S+|\S+@\S+\.\w+)|(?P<num>[$€£]? ?\d[\d.,:/-]*(?<=\d)%?(?![\w]))|(?P<word>[^\W_](?:[\w'’+/=]*[\w=])?)|(?P<sep>\t|\||;|&|,(?=\S)| {3,}|(?<=\S) {2}(?=\S)|-{3,}|\[.?\]|=|:(?=\S)|\{|\})|(?P<comma>[,:](?=\s|$))|(?P<mark>[.!?…,:]+(?=\s|$|[\"”»)’]))|(?P<sym>[^\w\s'\"’“”«»()-])")
_MARKER = re.compile(r"\s*(?:[-*+•·–—o>]|\[.?\]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+\S")
_HEADER = re.compile(r"\W*subject\W*[:=]", re.IGNORECASE)
_QUOTE = re.compile(r"^[>|\s]*>[>|\s]*")
_WORD = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")
_END = re.compile(r"[.!?…:;\"”»][^\S\n]*$", re.MULTILINE)
_VOWEL = re.compile("[aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýаеёиоуыэюяіїαεηιουω]")


@lru_cache(maxsize=100_000)
def _kind(token: str) -> int:
    low = token.lower()
    if low in COMMON:
        return 0
    letters = low.replace("'", "").replace("’", "")
    if letters.isalpha():
        if len(letters) <= 3:
            return 0 if letters.islower() and (_VOWEL.search(letters) or not letters.isascii()) else 1
        if not letters.isascii() and not _VOWEL.search(letters):
            return 1
        longest = max(map(len, _VOWEL.split(letters)))
        inner_caps = sum(c.isupper() for c in token[1:])
        if longest >= 6 or len(letters) > 24 or (0 < inner_caps < len(token) - 1 and inner_caps > 1 and len(token) > 8):
            return 3
        return 1
    if any(c in "+/=" for c in token) and len(token) < 20:
        return 1 if token.replace("/", "").isalpha() else 2
    digits = sum(c.isdigit() for c in letters)
    return 3 if len(letters) >= 8 else 2 if digits else 1


_PLACE = {"num": 2, "sep": 4, "sym": 5, "mark": 6, "comma": 7}
_BY_INDEX = {index: _PLACE.get(name, -1 if name == "word" else None) for name, index in _TOKEN.groupindex.items()}


def line_counts(line: str) -> list[int]:
    counts, gaps = [0] * 8, 0
    for m in _TOKEN.finditer(line):
        place = _BY_INDEX[m.lastindex]
        if place is None:
            continue
        if place < 0:
            place = _kind(m.group())
        elif place == 4:
            gaps += m.group()[0] == " "
        counts[place] += 1
    if gaps and 6 * counts[0] >= counts[0] + counts[1]:  # wide gaps in a sentence are layout, not columns
        counts[4] -= gaps
    if _MARKER.match(line):
        counts[4] += 1
    return counts


def divergence(counts: list[int], profile: tuple[float, ...]) -> float:
    """Jensen-Shannon divergence, in bits."""
    total = sum(counts)
    out = 0.0
    for n, q in zip(counts, profile):
        p = n / total
        m = (p + q) / 2
        if p:
            out += p * math.log2(p / m)
        if q:
            out += q * math.log2(q / m)
    return out / 2


@lru_cache(maxsize=50_000)
def _nearest(counts: tuple[int, ...]) -> str:
    return min(PROFILES, key=lambda k: divergence(counts, PROFILES[k]))


def line_classes(text: str) -> list[tuple[str, int, list[int]]]:
    """(class, words, counts) of each line that is not blank. The subject header has no words here: a title is neither prose nor matter."""
    out, before, plain = [], None, []
    for line in text.splitlines():
        if ">" in line or "|" in line:
            line = _QUOTE.sub("", line)
        if not line or line.isspace():
            continue
        if _HEADER.match(line):
            out.append(("header", 0, line_counts(line)))
            plain.append(False)
            continue
        counts = line_counts(line)
        found = _WORD.findall(line)
        n = len(found)
        if n >= 5 and 3 * len(set(found)) <= n:  # the same few words again and again
            counts = [0, n, *counts[2:]]
        plain.append(not counts[4] and not counts[3] and counts[5] <= n)
        if not any(counts):
            kind = before or ("prose_terse" if n else "symbols")
        else:
            kind = _nearest(tuple(counts))
            if kind not in PROSE and n < SHORT and before in PROSE and plain[-1]:
                kind = before
            elif kind in PROSE and n < SHORT and before is not None and before not in PROSE and not counts[6]:
                kind = before
        out.append((kind, n, counts))
        before = kind
    for i in range(1, len(out) - 1):  # a plain line between lines of prose is a piece of wrapped prose
        if plain[i] and out[i][0] not in PROSE and out[i][0] != "keywords" and out[i - 1][0] in PROSE and out[i + 1][0] in PROSE:
            out[i] = ("prose_terse", *out[i][1:])
    return out


def profile(text: str) -> tuple:
    """The statistics of COLUMNS."""
    lines = line_classes(text)
    found = _WORD.findall(text)
    n, letters = len(found), sum(map(len, found))
    chars = sum(map(len, text.split()))
    digits = len(_DIGIT.findall(text))
    weight: dict[str, int] = {}
    for kind, k, _ in lines:
        if kind != "header":
            weight[kind] = weight.get(kind, 0) + k
    told = sum(weight.values())
    prose = sum(k for kind, k in weight.items() if kind in PROSE)
    totals = [sum(column) for column in zip(*(c for *_, c in lines))]
    ends = len(_END.findall(text))
    return (
        n,
        len(lines),
        letters / n if n else 0.0,
        (chars - letters) / chars if chars else 0.0,
        digits / chars if chars else 0.0,
        min(1.0, ends / len(lines)) if lines else 0.0,
        sum(map(COMMON.__contains__, map(str.lower, found))) / n if n else 0.0,
        min(divergence(totals, PROFILES[k]) for k in PROSE) if any(totals) else 0.0,
        max(weight, key=lambda k: (weight[k], k)) if weight else "empty",
        prose / told if told else 0.0 if weight else 1.0,
    )


COLUMNS = ("n_words bigint", "n_lines bigint", "mean_word_length double", "symbol_ratio double", "digit_ratio double", "end_punct_share double", "common_word_share double", "prose_divergence double", "nearest_profile string", "prose_share double")


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    for b in batches:
        rows = [(None,) * len(COLUMNS) if t is None else profile(t) for t in b.column(1).to_pylist()]
        columns = list(zip(*rows)) if rows else [()] * len(COLUMNS)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, kinds[d.split()[1]]) for c, d in zip(columns, COLUMNS))], names=["id", *(d.split()[0] for d in COLUMNS)])


def text_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of statistics for every row: (id, COLUMNS..., is_prose).

    A null text gives nulls; an empty one zeros, no profile, and counts as prose (there is nothing else in it). A map over rows: no
    shuffle. Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_profiles, f"id {kind}, {', '.join(COLUMNS)}").withColumn("is_prose", F.col("prose_share") >= 0.5)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(table(spark, sf_dir, "documents")).filter("not is_prose").select(F.col("id").alias("doc_id"))


def p10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
