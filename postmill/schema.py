"""Data model: labels, domains, the message schema and the mappings onto it."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

LABELS = ("legit", "spam", "phishing")
DOMAINS = ("sms", "email")
UNLABELLED = "spam_unlabelled"
SEVERITY = {"legit": 0, "spam": 1, UNLABELLED: 1, "phishing": 2}
# Spellings of labels in the sources.
LABEL_MAP = {"ham": "legit", "hard_ham": "legit", "legit": "legit", "spam": "spam", "smishing": "phishing", "phishing": "phishing", UNLABELLED: UNLABELLED}

MESSAGE = StructType(
    [
        StructField("text", StringType()),
        StructField("label", StringType()),
        StructField("domain", StringType()),
        StructField("source", StringType()),
        StructField("year", IntegerType()),
        StructField("group", LongType()),
        StructField("split", StringType()),
        StructField("future_novel", BooleanType()),
        StructField("text_as_packaged", StringType()),
        StructField("direction", StringType()),
        StructField("file", StringType()),
    ]
)


def lookup(c: Column, values: dict) -> Column:
    """The value of `c` in a small constant map, null where it has none."""
    return F.create_map(*map(F.lit, chain.from_iterable(values.items())))[c]


def unify_label(c: Column) -> Column:
    return lookup(F.lower(F.trim(c)), LABEL_MAP)


def severity(c: Column) -> Column:
    return F.coalesce(lookup(c, SEVERITY), F.lit(-1))


def label_index(c: Column) -> Column:
    """0, 1, 2 in the order of LABELS; null for anything else."""
    return F.nullif(F.array_position(F.array(*map(F.lit, LABELS)), c), F.lit(0)).cast("int") - 1


def message_id(domain: Column, number: Column) -> Column:
    return F.concat_ws("-", domain, number.cast("string"))


def union_messages(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """UNION ALL by name; columns a source lacks are null."""
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
