"""Every operator of the problems on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from postmill.llm import copies, encoding, group_split, leakage, lookalike, near_dup, newtext, packing, personal, quality

SCHEMA = "msg_id bigint, text string, label string, domain string, source string, `group` bigint, split string, sender string, sent_at timestamp"
LONG = "The quick brown fox jumps over the lazy dog near the river bank. " * 4000


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([("Mara", "given"), ("Quillfeld", "surname"), (None, "given"), ("Odd", None)], "name_text string, name_kind string")


def operators(names):
    return {
        "newtext": lambda d: newtext.judged_lines(d),
        "near_dup": lambda d: near_dup.near_duplicates(d),
        "pairs": lambda d: lookalike.lookalike_pairs(d),
        "forms": lambda d: lookalike.one_form(d),
        "split": lambda d: group_split.grouped_split(d, ["group", "text"]),
        "leaking": lambda d: group_split.leaking(d),
        "personal": lambda d: personal.personal_data(d, names),
        "masked": lambda d: personal.mask_personal_data(d, names),
        "copies": lambda d: copies.copy_members(d),
        "collapsed": lambda d: copies.collapse_copies(d),
        "encoding": lambda d: encoding.repair_encoding(d),
        "packed": lambda d: packing.pack(packing.token_counts(d, "msg_id"), [("a", 16), ("b", 64)]),
        "leaked": lambda d: leakage.leaked_items(d.withColumnRenamed("msg_id", "doc_id"), d.withColumnRenamed("msg_id", "probe_id")),
        "quality": lambda d: quality.text_quality(d, "msg_id"),
    }


EXPECTED = {  # rows out for the dirty table below
    "newtext": 4, "near_dup": 7, "pairs": 0, "forms": 10, "split": 8, "leaking": 0, "personal": 0, "masked": 10, "copies": 7,
    "collapsed": 3, "encoding": 10, "leaked": 1, "quality": 10,
}
DIRTY = [
    (1, None, None, None, None, None, None, None, None),
    (2, "", "legit", "sms", "a", 5, "train", None, None),
    (3, "", None, "sms", "a", 5, "train", None, None),
    (4, LONG, "spam", "email", None, None, None, "x", None),
    (5, "same text here", "spam", None, "b", None, " TRAIN ", "x", None),
    (6, "same text here", "spam", None, "b", None, "test", "x", None),
    (6, "same text here", "spam", None, "b", None, "test", "x", None),
    (None, "no id", "legit", "sms", "b", 1, "val", "y", None),
    (8, " \n\t ", "legit", "sms", "b", 7, "val", "y", None),
    (9, None, "legit", "sms", "b", 7, "val", "y", None),
]


def test_dirty_rows(spark, names):
    df = spark.createDataFrame(DIRTY, SCHEMA)
    for name, run in operators(names).items():
        rows = run(df).collect()
        if name in EXPECTED:
            assert len(rows) == EXPECTED[name], (name, len(rows))


def test_empty_table(spark, names):
    df = spark.createDataFrame([], SCHEMA)
    for name, run in operators(names).items():
        assert run(df).count() == 0, name


def test_clashing_columns_change_nothing(spark, names):
    df = spark.createDataFrame([r for r in DIRTY if r[0] != 6], SCHEMA)
    clash = df
    for column in ("id", "key", "norm", "component", "bucket", "look", "own", "rep", "kind", "value", "stratum", "tokens", "raw", "plain", "n", "a", "b", "lo", "hi", "restored"):
        clash = clash.withColumn(column, F.lit("clash"))
    for name, run in operators(names).items():
        a, b = run(df), run(clash)
        assert a.columns == b.columns, name
        drop = [c for c in a.columns if c == "window"]  # windows are named by task
        assert sorted(map(str, a.drop(*drop).collect())) == sorted(map(str, b.drop(*drop).collect())), name
