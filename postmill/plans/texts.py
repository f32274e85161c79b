"""Queries of the text operators and disguises over whole tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from postmill.functions import attacks as A
from postmill.functions import text as T
from postmill.functions import udfs as U
from postmill.plans import evaluation
from postmill.plans.corpus import corpus
from postmill.plans.registry import query
from postmill.runtime import spread, table

# Shared pieces of oracle SQL: RE2 knows no Unicode \w \d \s \b, so classes are written out.
W, S = "\\p{L}\\p{N}_\\p{M}", "\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def _translate(c: str, a: str, b: str) -> str:
    return f"translate({c}, '{a}', '{b}')"


@query("SELECT msg_id, regexp_extract_all(lower(text), '[a-z0-9]+').array_to_string(' ') AS tokens, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens FROM corpus")
def tokenize(spark, sf_dir):
    tokens = T.tokenize(F.col("text"))
    return corpus(spark, sf_dir).select("msg_id", F.array_join(tokens, " ").alias("tokens"), F.size(tokens).alias("n_tokens"))


@query(f"SELECT msg_id, {_translate('text', T.CONFUSABLE_FROM, T.CONFUSABLE_TO)} AS folded FROM corpus")
def confusables_map(spark, sf_dir):
    return corpus(spark, sf_dir).select("msg_id", T.fold_confusables(F.col("text")).alias("folded"))


@query("SELECT msg_id, regexp_replace(text, '[\\x{200b}-\\x{200f}\\x{2060}\\x{feff}]', '', 'g') AS stripped FROM corpus")
def zero_width_strip(spark, sf_dir):
    return corpus(spark, sf_dir).select("msg_id", T.strip_zero_width(F.col("text")).alias("stripped"))


_RUNS = f"regexp_extract_all(text, '[^{S}]+|[{S}]+')"
_LEETED = (
    f"array_to_string(list_transform({_RUNS}, lambda t: CASE WHEN regexp_matches(t, '\\p{{L}}') AND length(regexp_replace(t, '[^\\p{{Nd}}]', '', 'g')) <= length(t) / 2.0 "
    f"AND NOT regexp_matches(t, '[{W}.+-]+@[{W}-]+\\.[{W}.-]+') THEN translate(t, '{T.LEET_FROM}', '{T.LEET_TO}') ELSE t END), '')"
)


@query(f"SELECT msg_id, {_LEETED} AS deleeted FROM corpus")
def deleet_tokens(spark, sf_dir):
    return corpus(spark, sf_dir).select("msg_id", T.deleet(F.col("text")).alias("deleeted"))


@query("SELECT msg_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^[ \\t\\r\\f\\x0b]*>.*$', '', 'g'), '[ \\t\\r\\f\\x0b]+', ' ', 'g'), '\\n[\\s\\x0b]*\\n+', E'\\n', 'g'), E' \\t\\n\\r\\x0b\\f') AS tidied FROM corpus")
def tidy_text(spark, sf_dir):
    return corpus(spark, sf_dir).select("msg_id", T.tidy(F.col("text")).alias("tidied"))


_HTML = "'<html><head><title>x</title></head><body><p>' || replace(text, '&', '&amp;') || '</p><br/>bye &lt;3</body></html>'"


@query(
    "SELECT msg_id, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<(?:style[^>]*>.*?</style|script[^>]*>.*?</script|head[^>]*>.*?</head)>', ' ', 'g'), "
    f"'(?i)<\\s*(br|/p|/div|/tr|/li|/h\\d)[^>]*>', E'\\n', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') AS plain FROM (SELECT msg_id, {_HTML} AS h FROM corpus)"
)
def html_to_text(spark, sf_dir):
    page = F.concat(F.lit("<html><head><title>x</title></head><body><p>"), F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("</p><br/>bye &lt;3</body></html>"))
    return corpus(spark, sf_dir).select("msg_id", T.html_to_text(page).alias("plain"))


@query("SELECT msg_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '…' ELSE text END AS shortened FROM corpus")
def truncate_ellipsis(spark, sf_dir):
    return corpus(spark, sf_dir).select("msg_id", T.shorten(F.col("text"), 400).alias("shortened"))


@query("SELECT msg_id, CASE WHEN length(sender) > 8 THEN '...' || right(sender, 4) ELSE '...' END AS masked FROM corpus WHERE sender IS NOT NULL")
def masked_sender(spark, sf_dir):
    return corpus(spark, sf_dir).filter("sender is not null").select("msg_id", T.mask_key(F.col("sender")).alias("masked"))


@query("SELECT msg_id, length(text) AS n_chars, len(regexp_extract_all(text, '[^" + S + "]+')) AS n_words, len(string_split(text, E'\\n')) AS n_lines, len(regexp_extract_all(text, '[.!?]+(?:[ \\n]|$)')) AS n_sentences FROM corpus")
def length_counts(spark, sf_dir):
    return corpus(spark, sf_dir).select("msg_id", F.length("text").alias("n_chars"), F.size(T.words(F.col("text"))).alias("n_words"), F.size(F.split("text", "\n")).alias("n_lines"), F.size(F.regexp_extract_all("text", F.lit(r"[.!?]+(?:[ \n]|\z)"), F.lit(0))).alias("n_sentences"))


# The tags in RE2: \b before a digit or letter becomes the edge of a class, kept by a group.
def _tagged(c: str) -> str:
    B = f"(^|[^{W}])"
    steps = (
        (f"[{W}.+-]+@[{W}-]+(\\.[{W}-]+)+", " xxemail "),
        (f"(?i)(https?://|www\\.)[^{S}]+", " xxurl "),
    )
    for pattern, tag in steps:
        c = f"regexp_replace({c}, '{pattern}', '{tag}', 'g')"
    return c


@query(f"SELECT msg_id, {_tagged('text')} AS tagged FROM corpus")
def tag_addresses_urls(spark, sf_dir):
    """The first two tags; the others rest on word edges that the oracle's dialect lacks and are tested on literals."""
    c = F.regexp_replace("text", T.ENTITIES[0][1], " xxemail ")
    return corpus(spark, sf_dir).select("msg_id", F.regexp_replace(c, rf"(?diuU)(https?://|www\.)\S+", " xxurl ").alias("tagged"))


@query()
def tag_entities(spark, sf_dir):
    return corpus(spark, sf_dir).select("msg_id", T.tag_entities(F.col("text")).alias("tagged"))


# On texts of ASCII the classes of both dialects agree, and with them word edges: there the oracle states the whole operators.
ASCII = "regexp_full_match(text, '[\\x00-\\x7f]*')"
_RE2 = lambda c, steps: [c := f"regexp_replace({c}, '{p.replace(chr(39), chr(39) * 2)}', '{r}', 'g')" for p, r in steps][-1]
_SPACE_RE2 = "[\\s\\x0b]"


def _plain(pattern: str) -> str:
    """A pattern of `functions.text` in RE2: flags that only widen classes go."""
    flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    rest = pattern[flags.end() :] if flags else pattern
    kept = "".join(x for x in (flags[1] if flags else "") if x in "ims")
    return (f"(?{kept})" if kept else "") + rest


def _tag_sql(c: str) -> str:
    return _RE2(c, [(_plain(pattern), f" {tag} ") for tag, pattern in T.ENTITIES])


def _scrub_sql(c: str) -> str:
    c = _RE2(c, [(T.ADDRESS, " xxemail "), (_plain(T.LIST_TAG), "\\1"), (_plain(T.LIST_FOOTER), " ")])
    return _RE2(f"lower({c})", [(_plain(T.SPACE_BEFORE), "\\1"), (_plain(T.SPACE_AFTER), "\\1"), (_plain(T.IDENTITY), " ")])


_TEXT = "text"
_PREPARED = f"'[' || domain || '] ' || trim(regexp_replace({_tag_sql(f'CASE WHEN domain = {chr(39)}email{chr(39)} THEN {_scrub_sql(_TEXT)} ELSE text END')}, '{_SPACE_RE2}+', ' ', 'g'))"


def _ascii(spark, sf_dir):
    return corpus(spark, sf_dir).filter(~F.col("text").rlike(r"[^\x00-\x7F]"))


@query(f"SELECT msg_id, {_tag_sql('text')} AS tagged FROM corpus WHERE {ASCII}")
def tag_entities_ascii(spark, sf_dir):
    return _ascii(spark, sf_dir).select("msg_id", T.tag_entities(F.col("text")).alias("tagged"))


@query(f"SELECT msg_id, {_scrub_sql('text')} AS scrubbed FROM corpus WHERE {ASCII} AND domain = 'email'")
def scrub_email_ascii(spark, sf_dir):
    return _ascii(spark, sf_dir).filter("domain = 'email'").select("msg_id", T.scrub_email(F.col("text")).alias("scrubbed"))


@query(f"SELECT msg_id, {_PREPARED} AS prepared FROM corpus WHERE {ASCII}")
def prepare_ascii(spark, sf_dir):
    """Prepared text without the undoing of disguises."""
    return _ascii(spark, sf_dir).select("msg_id", T.prepare(F.col("text"), F.col("domain")).alias("prepared"))


@query(f"SELECT domain, label, count(*) AS n_rows, count(*) FILTER (regexp_matches({_PREPARED}, '{T.HOOKS}')) AS with_hook FROM corpus WHERE {ASCII} GROUP BY ALL")
def hook_filter_ascii(spark, sf_dir):
    prepared = T.prepare(F.col("text"), F.col("domain"))
    return _ascii(spark, sf_dir).select("domain", "label", T.has_hook(prepared).alias("hook")).groupBy("domain", "label").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("hook"), 1)).alias("with_hook"))


@query(
    evaluation.J + f", h AS (SELECT msg_id, regexp_matches({_PREPARED}, '{T.HOOKS}') AS hook FROM corpus WHERE {ASCII}) "
    "SELECT run, j.domain, CASE WHEN hook THEN 'with hook' ELSE 'no hook' END AS slice, count(*) AS n, round(avg(CASE WHEN pred > 0 THEN 1.0 ELSE 0.0 END), 6) AS scam_recall FROM j JOIN h USING (msg_id) WHERE y > 0 GROUP BY ALL"
)
def no_hook_report(spark, sf_dir):
    """Recall of scams with and without an address, number or sum to react to, over messages of ASCII."""
    hook = F.when(T.has_hook(T.prepare(F.col("text"), F.col("domain"))), "with hook").otherwise("no hook")
    slices = _ascii(spark, sf_dir).select("msg_id", hook.alias("slice"))
    scams = evaluation.scored(spark, sf_dir).filter("y > 0").join(slices, "msg_id")
    return scams.groupBy("run", "domain", "slice").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("pred") > 0).cast("double")), 6).alias("scam_recall"))


@query()
def hook_filter(spark, sf_dir):
    prepared = T.prepare(F.col("text"), F.col("domain"))
    return corpus(spark, sf_dir).select("domain", "label", T.has_hook(prepared).cast("int").alias("hook")).groupBy("domain", "label").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("hook").alias("with_hook"))


@query()
def scrub_email(spark, sf_dir):
    return corpus(spark, sf_dir).filter("domain = 'email'").select("msg_id", T.scrub_email(F.col("text")).alias("scrubbed"))


@query()
def prepare_messages(spark, sf_dir):
    rows = spread(corpus(spark, sf_dir).select("msg_id", "text", "domain"))
    return rows.select("msg_id", T.prepare(F.col("text"), F.col("domain"), U.normalise).alias("prepared"))


@query()
def unpackaged_text(spark, sf_dir):
    return corpus(spark, sf_dir).filter("text_as_packaged is not null").select("msg_id", T.unpackage(F.col("text_as_packaged")).alias("unpackaged"))


@query()
def nfkc(spark, sf_dir):
    return corpus(spark, sf_dir).select("msg_id", U.nfkc(F.col("text")).alias("nfkc"))


@query()
def fix_encoding(spark, sf_dir):
    return corpus(spark, sf_dir).select("msg_id", U.fix_encoding(F.col("text")).alias("fixed"))


@query()
def porter_stem(spark, sf_dir):
    return corpus(spark, sf_dir).select("msg_id", U.clean_text(F.col("text")).alias("cleaned"))


_STOP = ",".join(f"'{w}'" for w in sorted(set(U.T_STOPWORDS.split())))


@query(f"SELECT msg_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: t NOT IN ({_STOP})), ' ') AS content FROM corpus")
def content_words(spark, sf_dir):
    return corpus(spark, sf_dir).select("msg_id", F.array_join(U.content_tokens(F.col("text")), " ").alias("content"))


# ---- disguises -------------------------------------------------------------------------------------------------------------------

RATE = 0.5


def _draw(what: str) -> str:
    return f"(('0x' || substr(md5('1:{what}:' || msg_id || ':' || i), 1, 8))::bigint / 4294967296.0)"


_PIECES = "SELECT msg_id, unnest(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+'), 1) - 1 AS i FROM corpus"
_FORMS = {
    "leetspeak": f"translate(w, '{A.LEET_FROM}', '{A.LEET_TO}')",
    "homoglyph": f"translate(w, '{A.HOMOGLYPH_FROM}', '{A.HOMOGLYPH_TO}')",
    "spacing": "CASE floor({u} * 4)::int " + " ".join(f"WHEN {k} THEN array_to_string(string_split(w, ''), '{x}')" for k, x in enumerate(A.SEPARATORS)) + " END",
    "typo": "substr(w, 1, floor({u} * (length(w) - 1))::int) || substr(w, floor({u} * (length(w) - 1))::int + 2, 1) || substr(w, floor({u} * (length(w) - 1))::int + 1, 1) || substr(w, floor({u} * (length(w) - 1))::int + 3)",
}


def _attack_sql(form: str) -> str:
    return (
        f"WITH p AS ({_PIECES}), d AS (SELECT *, {_draw('hit')} AS hit, {_draw('luck')} AS u FROM p) "
        f"SELECT msg_id, string_agg(CASE WHEN regexp_full_match(w, '[A-Za-z]{{3,}}') AND hit < {RATE} THEN {form} ELSE w END, '' ORDER BY i) AS attacked FROM d GROUP BY msg_id"
    )


def _attacked(name: str):
    def run(spark, sf_dir):
        return spread(corpus(spark, sf_dir).select("msg_id", "text")).select("msg_id", A.attack(F.col("text"), F.col("msg_id"), name, RATE).alias("attacked"))

    run.__name__ = f"attack_{name}"
    return run


for _name, _form in _FORMS.items():
    query(_attack_sql(_form.replace("{u}", "u")))(_attacked(_name))
_MIXED = "CASE floor(u * 4)::int " + " ".join(f"WHEN {k} THEN {form.replace('{u}', '(u * 4 - floor(u * 4))')}" for k, form in enumerate(_FORMS.values())) + " END"
query(_attack_sql(_MIXED))(_attacked("mixed"))


@query(
    f"WITH p AS ({_PIECES}), d AS (SELECT *, {_draw('hit')} AS hit FROM p), a AS (SELECT msg_id, string_agg(CASE WHEN regexp_full_match(w, '[A-Za-z]{{3,}}') AND hit < {RATE} THEN {_FORMS['homoglyph']} ELSE w END, '' ORDER BY i) AS attacked FROM d GROUP BY msg_id) "
    f"SELECT count(*) AS n_rows, count(*) FILTER ({_translate('attacked', T.CONFUSABLE_FROM, T.CONFUSABLE_TO)} = {_translate('text', T.CONFUSABLE_FROM, T.CONFUSABLE_TO)}) AS restored FROM a JOIN corpus USING (msg_id)"
)
def attack_roundtrip(spark, sf_dir):
    """Look-alike letters put in and folded out again."""
    c = F.col("text")
    back = T.fold_confusables(A.attack(c, F.col("msg_id"), "homoglyph", RATE)) == T.fold_confusables(c)
    return corpus(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(back, 1)).alias("restored"))


def _u(what: str) -> str:
    return f"(('0x' || substr(md5('0:{what}:' || msg_id), 1, 8))::bigint / 4294967296.0)"


@query(f"SELECT label, sum(n)::bigint AS n_rows, sum(c)::bigint AS n_copies FROM (SELECT label, 1 AS n, CASE WHEN label <> 'legit' OR {_u('legit')} < 0.2 THEN 1 ELSE 0 END AS c FROM corpus WHERE label IS NOT NULL) GROUP BY label")
def augment(spark, sf_dir):
    out = A.augment(corpus(spark, sf_dir).filter("label is not null"))
    return out.groupBy("label").agg(F.count(F.when(~F.col("is_copy"), 1)).alias("n_rows"), F.count(F.when(F.col("is_copy"), 1)).alias("n_copies"))


# ---- ragged SMS lines ------------------------------------------------------------------------------------------------------------

_PARTS = "string_split(line, ',')"


@query(
    f"SELECT raw_id, lower(trim(p[7])) AS label, trim(p[2]) AS direction, coalesce(try_cast(nullif(regexp_extract(p[5], '20\\d\\d'), '') AS INT), 2014) AS year, "
    f"trim(regexp_replace(trim(trim(rtrim(array_to_string(p[8:], ','), ',')), '\"'), '(?i),*\\s*(spam|ham)\\s*$', '')) AS text FROM (SELECT raw_id, {_PARTS} AS p FROM sms_raw) WHERE len(p) >= 8 AND upper(trim(p[7])) IN ('HAM', 'SPAM')"
)
def ragged_sms(spark, sf_dir):
    from postmill.sources.readers import parse_ragged

    return parse_ragged(table(spark, sf_dir, "sms_raw")).select("raw_id", "label", "direction", "year", "text")
