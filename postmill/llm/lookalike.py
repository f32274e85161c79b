"""Problem 3: texts that look the same on screen and differ in their characters, by a confusables skeleton.

The skeleton of a text: every character decomposed (canonically, and by compatibility for widths, fonts and letter ligatures), every
piece replaced by its prototype from the table of look-alikes, decomposed again. What is invisible goes, every kind of blank becomes
a blank of one width. Blanks keep their number; tabs, carriage returns, line and paragraph separators stay what they are, as they move
what follows them otherwise than a blank or a line feed does; case, quotation marks, dashes, superscripts and accents stay, as they
show. Texts compare equal by skeleton exactly if they look the same.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from postmill.runtime import cut, table

# Look-alike letters, each source character above its Latin prototype (after Unicode's public list of confusables).
CYRILLIC = ("АВЕЅІЈКМНОРСТХҮԌԚԜаеѕіјорсухһԁԛԝӏүѵԍ", "ABESIJKMHOPCTXYGQWaesijopcyxhdqwlyvg")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανιρυϲϳκ", "ABEZHIKMNOPTYXoavipucjk")
ARMENIAN = ("ՕՍԼօհոսցզյք", "OULohnugqjp")
LATIN = ("ɡɑıȷℓ", "gaijl")
HYPHENS = "\u2010\u2011\u2043\u02d7\u2212\u2796\ufe63\uff0d"
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"
LAYOUT = "\t\n\r\u2028\u2029"

PROTOTYPE = {ord(a): b for source, target in (CYRILLIC, GREEK, ARMENIAN, LATIN) for a, b in zip(source, target, strict=True)} | {ord(c): "-" for c in HYPHENS}
SHOWN_FORMS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")


class _Skeleton(dict):
    """Code point -> skeleton piece; worked out when a code point is first met."""

    def __missing__(self, point: int) -> str:
        self[point] = piece = "".join(map(self._prototype, self._decompose(chr(point))))
        return piece

    def _decompose(self, c: str) -> str:
        kind = unicodedata.decomposition(c)
        if not kind:
            return unicodedata.normalize("NFD", c)
        if kind[0] != "<":
            return "".join(self._decompose(x) if x != c else x for x in unicodedata.normalize("NFD", c))
        form = kind.split(" ", 1)[0]
        if form in SHOWN_FORMS and (form != "<compat>" or unicodedata.category(c)[0] == "L"):
            return "".join(map(self._decompose, (chr(int(x, 16)) for x in kind.split()[1:])))
        return c

    @staticmethod
    def _prototype(c: str) -> str:
        point, kind = ord(c), unicodedata.category(c)
        if point in PROTOTYPE:
            return PROTOTYPE[point]
        if c in LAYOUT:
            return c
        if kind == "Zs":
            return " "
        if kind in ("Cf", "Cc") or c in INVISIBLE or 0xFE00 <= point <= 0xFE0F or 0xE0100 <= point <= 0xE01EF:
            return ""
        return unicodedata.normalize("NFD", c)


_TABLE = _Skeleton()


def skeleton(text: str) -> str:
    flat = text.translate(_TABLE)
    return flat if flat.isascii() else unicodedata.normalize("NFD", flat)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        look = [hashlib.md5(skeleton(t).encode("utf-8", "surrogatepass")).digest() for t in texts]
        own = [int.from_bytes(hashlib.md5(t.encode("utf-8", "surrogatepass")).digest()[:8], "little", signed=True) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(look, pa.binary()), pa.array(own, pa.int64())], names=["id", "look", "own"])


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else skeleton(t) for t in b.column(1).to_pylist()], pa.string())], names=["id", "form"])


def one_form(df: DataFrame, id_col: str = "msg_id", text_col: str = "text") -> DataFrame:
    """(id, form) for every row: the text's skeleton; null for a null text, empty for an empty one. Other columns are not read."""
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_forms, f"id {df.schema[id_col].dataType.simpleString()}, form string")


def lookalike_classes(df: DataFrame, id_col: str = "msg_id", text_col: str = "text") -> DataFrame:
    """(id, spelling_id, class_id) for each row whose text has a look-alike: the least id with the same text, and the least with the same skeleton.

    Rows without id or text are left out, and so are rows whose skeleton has one spelling only; a repeated row comes out again. Two
    aggregates with map-side combine, on digests, so a skeleton that a third of all rows share is a few rows a task before any shuffle.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    seen = cut(rows.mapInArrow(_digests, "id bigint, look binary, own bigint"))
    spelled = seen.groupBy("look", "own").agg(F.min("id").alias("spelling_id"))
    varied = spelled.groupBy("look").agg(F.min("spelling_id").alias("class_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return seen.join(spelled.join(varied, "look"), ["look", "own"]).select("id", "spelling_id", "class_id")


def lookalike_pairs(df: DataFrame, id_col: str = "msg_id", text_col: str = "text") -> DataFrame:
    """(a, b), a < b, for all pairs of rows whose texts differ and have one skeleton; repeated ids give one pair.

    Spellings of one class are paired by their representatives first, and the members of either spelling set against each other after;
    the pairs are the result as stated, so a class of many rows costs what it returns. `lookalike_classes` is linear.
    """
    member = cut(lookalike_classes(df, id_col, text_col).distinct())
    spelled = member.select("spelling_id", "class_id").distinct()
    a, b = (spelled.select("class_id", F.col("spelling_id").alias(f"spelling_{s}")) for s in "ab")
    unlike = a.join(b, "class_id").filter("spelling_a < spelling_b").select("spelling_a", "spelling_b")
    x, y = (member.select(F.col("spelling_id").alias(f"spelling_{s}"), F.col("id").alias(s)) for s in "ab")
    pairs = unlike.join(x, "spelling_a").join(y, "spelling_b").filter("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(table(spark, sf_dir, "corpus")).select(F.col("a").alias("msg_id_a"), F.col("b").alias("msg_id_b"))


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_form(table(spark, sf_dir, "corpus")).withColumnRenamed("id", "msg_id")
