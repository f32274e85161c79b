"""Text operators on literals."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from postmill.functions import attacks as A
from postmill.functions import text as T
from postmill.functions import udfs as U
from postmill.functions.porter import stem


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize("text, fixed", [("Win Â£500 now", "Win £500 now"), ("itâ€™s", "it's"), (" ok ", "ok"), ("a &amp; b", "a & b")])
def test_fix_encoding(spark, text, fixed):
    assert one(spark, text, U.fix_encoding) == fixed


def test_dedup_key(spark):
    assert one(spark, "Win  Â£500 NOW!", T.dedup_key) == one(spark, "win £500 now", T.dedup_key) == "win500now"


def test_latin_share(spark):
    assert one(spark, "1234", T.latin_share) == 1.0
    assert one(spark, "abяя", T.latin_share) == 0.5


@pytest.mark.parametrize(
    "text, plain",
    [("c.l.a.i.m your F R E E p-r-i-z-e", "claim your FREE prize"), ("U.R.G.E.N.T Y*o*u*r account", "URGENT Your account"), ("call 09061790121 for £500", "call 09061790121 for £500"), ("fr33 pr1ze", "free prize"), ("сlаim", "claim"), ("fr​ee", "free")],
)
def test_normalise(spark, text, plain):
    assert one(spark, text, U.normalise) == plain


def prepared(spark, text, domain, normalise=U.normalise):
    return one(spark, text, lambda c: T.prepare(c, F.lit(domain), normalise))


def test_tags(spark):
    tagged = prepared(spark, "Pay £1.99 at www.royalmail-fee.com or call +44 7911 123456", "sms")
    assert all(x in tagged for x in ("xxmoney", "xxurl", "xxphone"))
    assert "xxurl" in prepared(spark, "V1sit www.prize.com", "sms")
    assert "xxyear" in prepared(spark, "your 2024 tax refund", "sms")
    assert "xxemail" in prepared(spark, "contact supp0rt@paypa1.com now", "sms")


def test_prefix_and_scrub(spark):
    assert prepared(spark, "hello", "sms") == "[sms] hello"
    assert prepared(spark, "Hello", "email") == "[email] hello"
    text = "Subject: [Spambayes] Re: price , only 15 $ ! mail jose@monkey.org\nhttp://x.y/mailman/listinfo/fork"
    assert prepared(spark, text, "email") == "[email] subject: re: price, only xxmoney ! mail xxemail"


def test_unpackage(spark):
    assert one(spark, "visit http : / / www . x . com , it ' s high - income", T.unpackage) == "visit http://www.x.com, it's high-income"


def test_tidy_and_html(spark):
    assert one(spark, "a\n> quoted\n\n\n b \t c ", T.tidy) == "a\n b c"
    html = "<style>p{}</style><p>Hi &amp; <b>you</b></p>bye<br>now"
    assert one(spark, html, T.html_to_text).split() == ["Hi", "&", "you", "bye", "now"]
    assert U.page_text(html).split() == ["Hi", "&", "you", "bye", "now"]


def test_attacks_are_drawn_per_row_and_rate_0_is_identity(spark):
    df = spark.createDataFrame([(i, "Claim your free prize now, ok") for i in range(40)], "msg_id bigint, text string")
    for name in (*A.ATTACKS, "mixed"):
        run = lambda d, rate, name=name: [r.t for r in d.select("msg_id", A.attack(F.col("text"), F.col("msg_id"), name, rate).alias("t")).orderBy("msg_id").collect()]
        assert set(run(df, 0.0)) == {"Claim your free prize now, ok"}
        assert run(df, 0.6) == run(df.repartition(7), 0.6)
        assert "Claim" not in "".join(run(df, 1.0)) or name == "spacing"


@pytest.mark.parametrize("name", ["leetspeak", "homoglyph"])
def test_disguise_is_undone(spark, name):
    text = "claim your prize from office"
    back = one(spark, text, lambda c: U.normalise(A.attack(c, F.lit(1), name, 1.0)))
    assert back == text


def test_augment(spark):
    df = spark.createDataFrame([(i, "free prize inside", "spam" if i % 2 else "legit") for i in range(200)], "msg_id bigint, text string, label string")
    counts = {(r.label, r.is_copy): r["count"] for r in A.augment(df).groupBy("label", "is_copy").count().collect()}
    assert counts[("spam", True)] == 100 and 5 <= counts[("legit", True)] <= 40 and counts[("legit", False)] == 100


@pytest.mark.parametrize("word, root", [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("happy", "happi"), ("adjustment", "adjust"), ("controlling", "control"), ("sky", "sky"), ("rate", "rate"), ("probate", "probat")])
def test_porter(word, root):
    assert stem(word) == root


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_repair_is_idempotent_on_what_it_returns(text):
    once = U.repair(text)
    assert U.repair(once) == U.repair(U.repair(once))


def test_nulls_pass(spark):
    for f in (U.fix_encoding, U.normalise, T.dedup_key, T.tag_entities, T.scrub_email, T.tidy, T.html_to_text, T.deleet):
        assert one(spark, None, f) is None
        assert one(spark, "", f) == ""


def test_small_helpers(spark):
    assert one(spark, "abcdefghijkl", T.mask_key) == "...ijkl" and one(spark, "short", T.mask_key) == "..."
    assert one(spark, "x" * 11, lambda c: T.shorten(c, 10)) == "x" * 10 + "…"
    assert one(spark, "Running of the bulls", U.clean_text) == "run bull"


def test_keys_read_entities_widths_and_ligatures(spark):
    same = ["Fish &amp; chips, office", "Ｆｉｓｈ & chips, oﬃce", "fish chips office"]
    rows = spark.createDataFrame([(t,) for t in same], "t string").select(T.dedup_key(F.col("t")).alias("k")).collect()
    assert {r.k for r in rows} == {"fishchipsoffice"}
    assert one(spark, "ＷＩＮ ﬁve", U.fix_encoding) == "WIN five"
    assert one(spark, "<b>&amp;</b>", T.dedup_key) == "bampb"


def test_only_rows_that_need_it_are_undisguised(spark):
    rows = spark.createDataFrame([("plain text 1st",), ("F R E E pr1ze",), ("ｗｉｎ раypal\u200b",), (None,)], "t string").select(U.normalise(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == ["plain text ist", "FREE prize", "win paypal", None]
