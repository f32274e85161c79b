"""Text operators as Column expressions: they stay in the JVM, inside whole-stage code generation.

Patterns carry the flags d (only a line feed ends a line) and U (Unicode classes), so that they agree with Python's `re`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Look-alike letters and their Latin readings.
CONFUSABLE_FROM = "аеорсухіАВЕКМНОРСТХοαν"
CONFUSABLE_TO = "aeopcyxiABEKMHOPCTXoav"
# Digits and signs read as letters inside words.
LEET_FROM, LEET_TO = "013457@$", "oieastas"
ZERO_WIDTH = "[\\u200b-\\u200f\\u2060\\ufeff]"
# An address; the entities in the order they are tagged.
# Full-width signs stand 0xFEE0 above their ASCII forms. Ligatures of Latin letters.
WIDE = "".join(chr(0xFEE0 + x) for x in range(0x21, 0x7F))
NARROW = "".join(map(chr, range(0x21, 0x7F)))
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("ĳ", "ij"), ("Ĳ", "IJ"), ("ǆ", "dž"), ("ǉ", "lj"), ("ǌ", "nj"))
ADDRESS = r"[\w.+-]+@[\w-]+\.[\w.-]+"
ENTITIES = (
    ("xxemail", r"(?dU)[\w.+-]+@[\w-]+(\.[\w-]+)+"),
    ("xxurl", r"(?diuU)(https?://|www\.)\S+|\b\S+\.(com|co\.uk|net|org|ly|info|biz|io|xyz|top)\b"),
    ("xxphone", r"(?dU)\+?\d[\d\s-]{7,}\d"),
    ("xxmoney", r"(?diuU)[£$€]\s?\d[\d,.]*|\d[\d,.]*\s?([£$€]|pounds\b|gbp\b|usd\b|dollars\b)"),
    ("xxyear", r"(?dU)\b(19[89]\d|20[0-3]\d)\b"),
)
HOOKS = r"\bxx(?:url|phone|money|email)\b"
# What gives an email's collection away.
LIST_TAG = r"(?dimuU)^(subject:\s*)((re|fwd?):\s*)*\[[^\]]{2,30}\]\s*"
LIST_FOOTER = r"(?dimuU)^.*(mailman/listinfo|mailing list|list-unsubscribe|_{20,}|-{20,}).*$"
SPACE_BEFORE = r"(?dU)\s+([,.;:!?%)\]}'])"
SPACE_AFTER = r"(?dU)([(\[{$£€])\s+"
IDENTITY = r"(?diuU)\b(jose|monkey|nazario|enron|kaminski|vince|ect|hou)\b"
# Order and patterns that undo blanks around punctuation.
PACKAGING = (
    (r"(?dU)\b(https?) : / / ", "$1://"),
    (r"(?dU)(\w) ([.@/:]) (?=\w)", "$1$2"),
    (r"(?dU)(\w) ([-']) (?=\w)", "$1$2"),
    (r" ([,.;:!?%)\]])", "$1"),
    (r"([(\[$£]) ", "$1"),
    (r"(?:_ ){3,}_?", "_____"),
)
# What HTML drops with its contents, what breaks a line, any other tag; quoted lines, blanks and blank lines of a body.
HTML_DROPPED = r"(?is)<(style|script|head)[^>]*>.*?</\1>"
HTML_BREAK = r"(?i)<\s*(br|/p|/div|/tr|/li|/h\d)[^>]*>"
HTML_TAG = r"<[^>]+>"
QUOTED_LINE, BLANKS, BLANK_LINES = r"(?m)^[ \t\r\f\x0b]*>.*$", r"[ \t\r\f\x0b]+", r"\n\s*\n+"
NAMED_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def _chain(c: Column, steps) -> Column:
    return reduce(lambda x, step: F.regexp_replace(x, *step), steps, c)


def repair_latin1(c: Column) -> Column:
    """UTF-8 read as Latin-1 restored, where the whole text is of Latin-1 and reads as UTF-8."""
    fits = c.rlike(r"^[\x00-\xFF]*$") & c.rlike(r"[\x80-\xFF]")
    return F.when(fits, F.coalesce(F.try_validate_utf8(F.encode(F.when(fits, c), "ISO-8859-1")), c)).otherwise(c)


def read_entities(c: Column) -> Column:
    """Named entities read, in texts without a tag."""
    return F.when(c.contains("<"), c).otherwise(reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), NAMED_ENTITIES, c))


def plain_forms(c: Column) -> Column:
    """Full-width signs and ligatures as plain letters; a text of ASCII is left alone."""
    flat = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), LIGATURES, F.translate(c, WIDE, NARROW))
    return F.when(c.rlike(r"[^\x00-\x7F]"), flat).otherwise(c)


def dedup_key(c: Column) -> Column:
    """Letters a-z and digits of the text, repaired, entities and other forms of letters read, lower-cased."""
    return F.regexp_replace(F.lower(plain_forms(read_entities(repair_latin1(c)))), "[^a-z0-9]", "")


def latin_share(c: Column) -> Column:
    """Share of ASCII letters among letters; 1 where there are none."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.when(letters == 0, 1.0).otherwise(F.length(F.regexp_replace(c, "[^A-Za-z]", "")) / letters)


def fold_confusables(c: Column) -> Column:
    return F.translate(c, CONFUSABLE_FROM, CONFUSABLE_TO)


def strip_zero_width(c: Column) -> Column:
    return F.regexp_replace(c, ZERO_WIDTH, "")


def deleet(c: Column) -> Column:
    """Leet spelling undone in words that hold a letter, are not mostly digits and hold no address."""
    runs = F.regexp_extract_all(c, F.lit(r"(?dU)\S+|\s+"), F.lit(0))

    def word(t: Column) -> Column:
        digits = F.length(F.regexp_replace(t, r"(?U)[^\d]", ""))
        wordish = t.rlike(r"(?U)\p{L}") & (digits <= F.length(t) / 2) & ~t.rlike(f"(?dU){ADDRESS}")
        return F.when(wordish, F.translate(t, LEET_FROM, LEET_TO)).otherwise(t)

    mixed = c.rlike(r"(?U)\p{L}[^\s]*[013457@$]|[013457@$][^\s]*\p{L}")  # a run with a letter and a sign of LEET_FROM
    return F.when(mixed, F.array_join(F.transform(runs, word), "")).otherwise(c)


def tag_entities(c: Column) -> Column:
    return _chain(c, [(pattern, f" {tag} ") for tag, pattern in ENTITIES])


def has_hook(prepared: Column) -> Column:
    return prepared.rlike(HOOKS)


def scrub_email(c: Column) -> Column:
    c = _chain(c, [(f"(?dU){ADDRESS}", " xxemail "), (LIST_TAG, "$1"), (LIST_FOOTER, " ")])
    return _chain(F.lower(c), [(SPACE_BEFORE, "$1"), (SPACE_AFTER, "$1"), (IDENTITY, " ")])


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def prepare(c: Column, domain: Column, normalise=None) -> Column:
    """The string a model sees: `[domain] ` and the tagged text, blanks squeezed. normalise: what undoes disguises first (None: nothing)."""
    c = normalise(c) if normalise else c
    scrubbed = F.when(domain == "email", scrub_email(c)).otherwise(c)
    return F.concat(F.lit("["), domain, F.lit("] "), squeeze(tag_entities(scrubbed)))


def unpackage(c: Column) -> Column:
    """Text whose punctuation was set off by blanks, joined again."""
    return _chain(c, PACKAGING)


def tidy(c: Column) -> Column:
    """Quoted lines dropped, blanks and blank lines squeezed."""
    c = _chain(c, [(QUOTED_LINE, ""), (BLANKS, " "), (BLANK_LINES, "\n")])
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def html_to_text(c: Column) -> Column:
    """Style, script and head dropped, breaks as line feeds, other tags as blanks, named entities read."""
    c = _chain(c, [(HTML_DROPPED, " "), (HTML_BREAK, "\n"), (HTML_TAG, " ")])
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), NAMED_ENTITIES, c)


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def words(c: Column) -> Column:
    """Runs without blanks."""
    return F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0))


def shorten(c: Column, most: int = 1200) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def as_message(subject: Column, body: Column) -> Column:
    return F.regexp_replace(F.concat(F.lit("Subject: "), F.coalesce(subject, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit(""))), r"^\s+|\s+$", "")


def mask_key(c: Column) -> Column:
    """All but the last four characters of a secret."""
    return F.when(F.length(c) > 8, F.concat(F.lit("..."), F.right(c, F.lit(4)))).otherwise("...")


def draw(seed: str, *parts: Column, size: float = 2.0**32) -> Column:
    """A number in [0, 1) that depends on seed and parts only, not on partitions: eight hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("double") / size
