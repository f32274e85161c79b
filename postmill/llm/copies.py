"""Problem 6: copies hidden by formatting, collapsed in two steps.

Byte-identical rows collapse first (an aggregate with map-side combine, so a text that a third of all rows hold is one row per task
before the shuffle); only the distinct survivors are brought to canonical text; these group again on the canonical text, summing the
counts. Canonical text: the letters and digits of any script, lower-cased, in order. A text made only of three or more fields
compares by its set of canonical fields instead; such a text and its own letters in plain order are linked as well, so a layout
without separators joins the group of its fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postmill.operators.components import connected_components
from postmill.runtime import cut, table

FIELD = r"^\s*\p{IsLatin}[\p{IsLatin} ]*[:=]\s*\S.*$"
LEAST_FIELDS = 3


def letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def _pieces(text: Column) -> Column:
    return F.filter(F.split(text, r"[\n\r;|]"), lambda x: x.rlike(r"\S"))


def is_fields(text: Column) -> Column:
    pieces = _pieces(text)
    return (F.size(pieces) >= LEAST_FIELDS) & F.forall(pieces, lambda x: x.rlike(FIELD))


def field_key(text: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(_pieces(text), letters)), "\u0001")


def _digest(c: Column) -> Column:
    """128 bits of the whole value: groups are kept apart by full text, shuffles carry 16 bytes."""
    return F.unhex(F.md5(c))


def _survivors(df: DataFrame, id_col: str, text_col: str, by: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.col(by).alias("domain"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    raw = rows.groupBy("domain", "text").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    own = F.concat(F.coalesce(F.concat(F.lit("in:"), F.col("domain").cast("string")), F.lit("none")), F.lit("\u0001"))  # texts are linked inside a `by` value only
    fields = F.when(F.col("text").rlike("[:=]") & is_fields(F.col("text")), _digest(F.concat(F.lit("fields:"), own, field_key(F.col("text")))))
    return cut(raw.select("domain", _digest(F.col("text")).alias("raw"), "first_id", "n", _digest(F.concat(own, letters(F.col("text")))).alias("plain"), fields.alias("fields")))


def _grouped(survivors: DataFrame) -> DataFrame:
    """survivors with `keep_id` and `copies` of their group."""
    hexed = survivors.filter("fields is not null").select(F.hex("plain").alias("p"), F.hex("fields").alias("f")).distinct()
    linked = connected_components(hexed, "p", "f").select(F.unhex("node").alias("plain"), F.unhex("component").alias("linked"))
    keyed = survivors.join(linked, "plain", "left").withColumn("key", F.coalesce("linked", "plain"))
    keyed = cut(keyed.select("domain", "raw", "first_id", "n", "key"))
    groups = keyed.groupBy("domain", "key").agg(F.min("first_id").alias("keep_id"), F.sum("n").alias("copies"))
    a, g = keyed.alias("a"), groups.alias("g")
    return a.join(g, F.expr("a.domain <=> g.domain and a.key = g.key")).select("a.domain", "a.raw", "a.first_id", "g.keep_id", "g.copies")


def collapse_copies(df: DataFrame, id_col: str = "msg_id", text_col: str = "text", by: str = "domain") -> DataFrame:
    """(keep_id, domain, copies): one row for each message of each `by` value, with its least id and its number of rows.

    Rows without id or text are left out; a null `by` is a value of its own; texts without a letter or digit, the empty one too, are
    one message; repeated rows count. Other columns are not read.
    """
    return _grouped(_survivors(df, id_col, text_col, by)).select("keep_id", "domain", "copies").distinct()


def copy_members(df: DataFrame, id_col: str = "msg_id", text_col: str = "text", by: str = "domain") -> DataFrame:
    """(keep_id, id) for every row with an id and a text."""
    grouped = _grouped(_survivors(df, id_col, text_col, by))
    rows = df.select(F.col(id_col).alias("id"), F.col(by).alias("domain"), _digest(F.col(text_col).cast("string")).alias("raw")).filter("id is not null")
    r, g = rows.alias("r"), grouped.alias("g")
    return r.join(g, F.expr("r.domain <=> g.domain and r.raw = g.raw")).select("g.keep_id", "r.id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_members(table(spark, sf_dir, "corpus")).filter("id <> keep_id").select("keep_id", F.col("id").alias("msg_id")).distinct()


def p6_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_copies(table(spark, sf_dir, "corpus"))
