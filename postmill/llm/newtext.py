"""Problem 1: the text newly written by an email's sender.

Lines are exploded with a normalised key, the mail's thread (its subject without reply and forward marks) and a verdict that the mail's
own layout proposes: `old` (quote marks, introductions, forwarded header blocks and what follows them, delimited signatures, device
taglines, notices, list footers), `new`, or `maybe` (closing lines that may or may not be a signature). Evidence from all mail follows:

* first authorship: the mails of a thread that hold a line are ranked by date; in a reply, a line that another sender wrote in an
  earlier mail of the thread is a repetition, whatever the layout says, and only the first-authored occurrence is kept;
* recurrence: a `maybe` line that closes mails of different content by the same sender is part of a signature.

Both are ranks over (thread, line) and (sender, line), taken as aggregates (least date, least and greatest content) with map-side
combine instead of sorted windows, so that a line a third of all mails share is not gathered in one task. Ranks alone cannot give the
result where the quoted mail is not in the collection, or is wrapped at another width, or where a sender has one mail: there the
layout's proposal stands.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from postmill.llm.encoding import restore
from postmill.llm.lookalike import skeleton
from postmill.runtime import cut, table

NEW, OLD, MAYBE = "new", "old", "maybe"

# Words that introduce, head or close mail in the languages met.
WRITE = "wrote|writes|said|schrieb|a .{0,2}crit|escribio|escreveu|ha scritto"
FROM = "from|von|de|da"
HEADER = "from|von|de|da|sent|date|datum|gesendet|envoye|enviado|enviada|to|an|a|para|cc|bcc|subject|betreff|objet|asunto|assunto|reply-to"
FORWARD = "original message|forwarded message|forwarded by|ursprungliche nachricht|weitergeleitete nachricht|message original|message d'origine|message transfere|mensaje original|mensagem original|mensaje reenviado"
DEVICE = r"sent (?:from|via|with|by) |get \w+ for |von mein\w* \w+ gesendet|gesendet (?:von|mit) |envoye (?:de|depuis|avec) |enviad[oa] (?:desde|de|do|da) "
FIRM = "group|office|partners|ltd|limited|inc|llc|gmbh|plc|co|company|department|team|services|associates|trust|council|university"
NOTICE = (
    r"confidential(?:ity)?\b.{0,30}(?:notice|:)|legal notice|disclaimer\b|"
    r"th(?:is|e contents of this) (?:e-?mail|message|mail|transmission|communication)\b.{0,90}(?:intended|meant|confidential|privileged|addressee|recipient)|"
    r"the (?:views|opinions) (?:expressed )?in this (?:e-?mail|message|mail|transmission|communication)|"
    r"if you are not the (?:intended |named )?(?:recipient|addressee)|if you have received this (?:e-?mail|message|mail|transmission|communication) in error|"
    r"any (?:copying|use|disclosure|review|distribution) of this (?:e-?mail|message|mail|transmission|communication)|"
    r"(?:kindly|please) (?:think of|consider) the (?:trees|environment)|registered (?:office|in|company)\b"
)
LIST_END = r"(?:\S+ )?mailing list$|to unsubscribe|unsubscribe\b|you (?:receive|received|are receiving) this|manage your subscription|to stop receiving|list info"

_ACCENT = re.compile("[\u0300-\u036f]")
_QUOTED = re.compile(r"^\s*(?:(?:[A-Za-z]{1,4})?>|\|)")
_MARK = re.compile(r"^(?:\s*(?:[A-Za-z]{0,4}>|\|))+\s*")
_DATE = r"(?:\d{1,4}[./-]\d{1,2}[./-]\d{1,4}|\d{1,2} [a-z]{3,9}\.? \d{4}|[a-z]{3,9}\.? \d{1,2},? \d{4})"
_ADDRESS = r"[\w.+-]+ ?(?:@|\(at\)|\[at\]| at ) ?[\w.-]+"
_INTRO_END = re.compile(
    rf"^(?:on|am|le|el|em|il) .{{0,60}}\b\d.{{0,120}}\b(?:{WRITE})\b.{{0,80}}:$|^quoting .{{2,120}}:$|^\* .{{2,60}} \[.{{4,40}}\]:$|"
    rf"^(?:[\w.'’-]+,? ){{1,4}}(?:<.{{3,90}}> )?(?:{WRITE}) ?:$|^.{{0,60}}{_DATE}.{{0,120}}\b(?:{WRITE}) ?:$"
)
_INTRO_START = re.compile(rf"^(?:on|am|le|el|em|il) .{{0,30}}\d|^quoting \w|^\* \w|^(?:[\w.'’-]+,? ){{1,4}}(?:<|(?:{WRITE})\b)")
_RULE = re.compile(r"^[-_=*~#+]{2,}$")
_FORWARD = re.compile(rf"^[-_=*~ ]{{2,}} ?(?:{FORWARD})\b.{{0,40}}$|^begin forwarded message ?:|^(?:{FORWARD}) ?:$")
_HEADER = re.compile(rf"^(?:{HEADER}) ?: ?\S")
_FROM = re.compile(rf"^(?:{FROM}) ?: ?\S")
_DEVICE = re.compile(rf"^(?:{DEVICE})")
_NOTICE = re.compile(rf"^(?:{NOTICE})")
_LIST_END = re.compile(rf"^(?:{LIST_END})")
_PHONE = re.compile(r"(?:\+|\(?0)[\d ()./-]{7,}\d|\(\d{3}\) ?\d{3}[ -]\d{4}|\b\d{3}[-.]\d{3}[-.]\d{4}\b")
_CONTACT = re.compile(rf"^(?:tel|t|phone|mobile|mob|m|fax|f|e|e-?mail|mail|w|web)\b ?[:.]? ?(?:\+|\(|\d|{_ADDRESS})|^{_ADDRESS}$|^(?:https?://|www\.)\S+$|\(direct\)$|^(?:\+|\()?\d[\d ()+./-]{{7,}}(?: \(\w+\))?$")
_ROLE = re.compile(rf"^[\w' .-]{{3,40}}, [\w&' .-]{{2,60}}\b(?:{FIRM})\.?$|^[\w' .-]{{4,40}} [|-] [\w' .-]{{3,40}}, [\w&' .-]{{2,60}}\b(?:{FIRM})\.?$")
_STREET = re.compile(r"^(?:(?:flat|apt|apartment|unit) \w+, )?\d+\w? [\w' .-]+,? [\w' .-]+$|^[\w-]+(?:strasse|straße|str\.) \d+\w?\b|^(?:(?:flat|apt) \w+, )?\d+\w? .{3,40}(?:, (?:apt|flat) \w+)?, \w+$")
_NAME = re.compile(r"^(?:[^\W\d_][\w'’-]*\.?,? ){1,3}[^\W\d_][\w'’-]+$")
_REGARDS = re.compile(r"^(?:(?:with )?(?:kind|best|warm|many|all the|yours|kindest) ?\w*|(?:best )?regards|cheers|thanks?|thank you|sincerely|yours|love|bye|mit |viele |liebe |cordialement|saludos|abracos|un saludo)\b[\w ]{0,20},?$")
_PS = re.compile(r"^p\. ?s\b|^ps\b")
_OWN_SUBJECT = re.compile(r"^(?:subject|betreff|objet|asunto) ?[:=]")
_SUBJECT = re.compile(r"^(?:subject|betreff|objet|asunto|assunto) ?[:=] ?")
_REPLY = re.compile(r"^(?:re|fwd?|aw|wg|tr|sv|antw|rv|res|enc) ?(?:\[\d+\])? ?: ?")
# What the parts of a mail are at most, by definition: lines of an introduction, of a header block, of a signature, characters of a signature's line.
INTRO_LINES, HEADER_LINES, SIGNATURE_LINES, SIGNATURE_WIDTH = 3, 8, 8, 110
LEAST_LETTERS = 25  # a shorter line of a thread (a greeting, a closing phrase) is anybody's


def plain(line: str) -> str:
    """A line as layout rules read it: look-alikes and accents folded, lower case, single blanks, no emphasis marks."""
    flat = line if line.isascii() else _ACCENT.sub("", skeleton(restore(line)[0]))
    flat = " ".join(flat.lower().split())
    return flat if _RULE.match(flat) or flat.startswith("* ") else flat.replace("*", "")


def _paragraphs(flat: list[str], verdict: list[str]) -> Iterator[tuple[int, int]]:
    start = None
    for i in range(len(flat) + 1):
        open_ = i < len(flat) and flat[i] != "" and verdict[i] == NEW
        if open_ and start is None:
            start = i
        elif not open_ and start is not None:
            yield start, i
            start = None


def _contact_like(line: str) -> bool:
    return bool(_CONTACT.search(line) or _ROLE.match(line) or _STREET.match(line))


def _quotes(flat: list[str], verdict: list[str]) -> None:
    for i, line in enumerate(flat):
        if line and _QUOTED.match(line):
            verdict[i] = OLD
    for i, line in enumerate(flat):  # introductions of one to three lines
        if verdict[i] == OLD or not line or not _INTRO_START.match(line):
            continue
        joined = ""
        for k in range(i, min(i + INTRO_LINES, len(flat))):
            if not flat[k] or verdict[k] == OLD:
                break
            joined = f"{joined} {flat[k]}".strip()
            if flat[k].endswith(":") and _INTRO_END.match(joined):
                after = next((j for j in range(k + 1, len(flat)) if flat[j]), None)
                if (after is not None and verdict[after] == OLD) or re.search(rf"{_DATE}|{_ADDRESS}|^quoting |\d{{4}}.*\d:\d\d", joined):
                    for j in range(i, k + 1):
                        verdict[j] = OLD
                break


def _forwarded(flat: list[str], verdict: list[str]) -> None:
    """From a forwarded header block on, all is old; the mail's own header at the top is none."""
    n = len(flat)
    for i, line in enumerate(flat):
        if not line or verdict[i] == OLD:
            continue
        at = None
        if _FORWARD.match(line):
            at = i
        elif _FROM.match(line):
            block = [x for x in flat[i + 1 : i + 6] if x]
            if block and _HEADER.match(block[0]) and i > 0:
                at = i
        if at is not None:
            head = [j for j in range(at + 1, min(at + HEADER_LINES, n)) if flat[j] and _HEADER.match(flat[j])]
            if not _FORWARD.match(line) or head or line.startswith("-") or line.startswith("begin"):
                before = next((j for j in range(at - 1, -1, -1) if flat[j]), None)
                if before is not None and _RULE.match(flat[before]) and verdict[before] == NEW:
                    verdict[before] = OLD
                for j in range(at, n):
                    if flat[j]:
                        verdict[j] = OLD
                return


def _signatures(flat: list[str], verdict: list[str]) -> None:
    n = len(flat)
    for i, line in enumerate(flat):
        if verdict[i] != NEW or not line:
            continue
        if _RULE.match(line):
            end = i + 1
            while end < n and flat[end] and verdict[end] == NEW and end - i <= SIGNATURE_LINES:
                end += 1
                if _RULE.match(flat[end - 1]):
                    break
            block = flat[i + 1 : end]
            tail = all(not flat[j] or verdict[j] == OLD or j < end or _closing(flat[j]) or _PS.match(flat[j]) for j in range(end, n))
            if block and all(len(x) <= SIGNATURE_WIDTH for x in block) and (any(map(_contact_like, block)) or any(map(_LIST_END.match, block)) or (tail and len(block) <= 5)):
                for j in range(i, end):
                    verdict[j] = OLD
            elif not block and i > 0 and verdict[i - 1] == OLD:
                verdict[i] = OLD
        elif _DEVICE.match(line) and len(line) <= 70:
            verdict[i] = OLD


def _closing(line: str) -> bool:
    return bool(_DEVICE.match(line) or _NOTICE.match(line) or _LIST_END.match(line) or _RULE.match(line))


def _notices(flat: list[str], verdict: list[str]) -> None:
    """From the line where a notice begins to the end of its paragraph."""
    for start, end in list(_paragraphs(flat, verdict)):
        for i in range(start, end):
            if _NOTICE.match(" ".join(flat[i : i + 3])) or (_LIST_END.match(flat[i]) and len(flat[i]) < 100):
                if i > start and _RULE.match(flat[i - 1]):
                    verdict[i - 1] = OLD
                for j in range(i, end):
                    verdict[j] = OLD
                break


def _bare_signatures(flat: list[str], verdict: list[str]) -> None:
    """A paragraph of contact lines below a full name is a signature; one with little evidence may be."""
    last_new = max((i for i, v in enumerate(verdict) if v == NEW and flat[i]), default=-1)
    for start, end in list(_paragraphs(flat, verdict)):
        block = flat[start:end]
        contacts = sum(map(_contact_like, block))
        if _OWN_SUBJECT.match(block[0]) or any(len(x) > SIGNATURE_WIDTH for x in block):
            continue
        for k in range(len(block)):  # the signature may stand right below the closing phrase and the given name
            rest = block[k:]
            if 2 <= len(rest) <= 6 and _NAME.match(rest[0]) and not _contact_like(rest[0]):
                known = sum(map(_contact_like, rest[1:]))
                if known >= 2 or (known == 1 and len(rest) == 2) or (known and known >= len(rest) - 2):
                    for j in range(start + k, end):
                        verdict[j] = OLD
                    break
        else:
            if contacts and contacts >= len(block) - 1 and start > 0:
                for j in range(start, end):
                    verdict[j] = OLD if contacts >= 2 else MAYBE
            elif end - 1 == last_new and len(block) <= 4 and all(len(x) <= 60 and not x.endswith((".", "!", "?", ",")) for x in block) and len(block) >= 2 and not any(map(_REGARDS.match, block)) and any(" " in x for x in block[1:]):
                for j in range(start, end):
                    verdict[j] = MAYBE


def verdicts(text: str) -> list[tuple[str, str]]:
    """(normalised line, verdict) of each line between line feeds; blank lines have an empty key and are new."""
    flat = [plain(x) for x in text.split("\n")]
    verdict = [NEW] * len(flat)
    _quotes(flat, verdict)
    _forwarded(flat, verdict)
    _notices(flat, verdict)
    _signatures(flat, verdict)
    _bare_signatures(flat, verdict)
    return [(_MARK.sub("", x) if v == OLD else x, v) for x, v in zip(flat, verdict)]


def thread_of(flat: list[str]) -> tuple[str, int]:
    """The subject without reply and forward marks (empty: none), and how many marks it has."""
    first = next((x for x in flat if x), "")
    head = _SUBJECT.match(first)
    rest, marks = (first[head.end() :], 0) if head else ("", 0)
    while mark := _REPLY.match(rest):
        rest, marks = rest[mark.end() :], marks + 1
    return rest.strip(), marks


def _closing_lines(found: list[tuple[str, str]]) -> set[int]:
    """Places of the lines at the end of a mail's own text: from its closing phrase on, or its last paragraph."""
    own = [k for k, (x, v) in enumerate(found) if x and v != OLD]
    if not own:
        return set()
    phrase = next((k for k in reversed(own) if _REGARDS.match(found[k][0])), None)
    start = own[-1]
    while start > 0 and found[start - 1][0] and found[start - 1][1] != OLD:
        start -= 1
    return {k for k in own if k >= (start if phrase is None else min(start, phrase))}


def _key(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_LINES = "id bigint, line_no bigint, key bigint, kind string, closing boolean, long boolean, body bigint, thread bigint, marks int, sender bigint, sent bigint"


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for i, text, sender, sent in zip(*(b.column(k).to_pylist() for k in range(4))):
            found = verdicts(text)
            body = _key("\n".join(x for x, v in found if v == NEW and x))
            subject, marks = thread_of([x for x, _ in found])
            own = (body, _key(subject) if subject else None, marks, None if sender is None else _key(sender), sent)
            closing = _closing_lines(found)
            headed = next((k for k, (x, _) in enumerate(found) if x), -1) if subject else -1
            out += ((i, k + 1, _key(x), v, k in closing, len(x) >= LEAST_LETTERS and k != headed, *own) for k, (x, v) in enumerate(found) if x or v == OLD)
        columns = list(zip(*out)) or [()] * 11
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=[f.split()[0] for f in _LINES.split(", ")])


def _repeated(lines: DataFrame) -> DataFrame:
    """(thread, key, first): lines of a thread that several mails hold with other numbers of reply marks, with their first-authored occurrence."""
    own = lines.filter((F.col("kind") == NEW) & F.col("long") & F.col("thread").isNotNull() & F.col("sent").isNotNull() & F.col("sender").isNotNull())
    ranked = own.groupBy("thread", "key").agg(F.min(F.struct("sent", "sender", "marks")).alias("first"), F.max("marks").alias("most"))
    return ranked.filter("most > first.marks").select("thread", "key", "first")


def judged_lines(df: DataFrame, id_col: str = "msg_id", text_col: str = "text", sender_col: str = "sender", sent_col: str = "sent_at", ranks: bool = True) -> DataFrame:
    """(id, line_no, is_new) for every line with anything on it of every row with an id and a text.

    Lines are counted from 1 between line feeds. A null sender is nobody (nothing recurs for it, it authors nothing first), a null date
    ranks nowhere; a repeated row comes out again and is no evidence, as its content is the same; an empty text has no lines. ranks:
    False leaves layout alone to decide, with `maybe` lines new. Other columns are not read.
    """
    sent = F.unix_micros(F.col(sent_col).cast("timestamp"))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(sender_col).cast("string").alias("sender"), sent.alias("sent")).filter("id is not null and text is not null")
    lines = rows.mapInArrow(_explode, _LINES)
    if not ranks:
        return lines.select("id", "line_no", (F.col("kind") != OLD).alias("is_new"))
    lines = cut(lines)
    open_ = lines.filter(F.col("kind") == MAYBE)
    closes = lines.filter("closing and sender is not null").join(open_.select("key").distinct(), "key", "left_semi").groupBy("sender", "key").agg(F.min("body").alias("b1"), F.max("body").alias("b2"))
    signed = closes.filter("b1 <> b2").select("sender", "key", F.lit(True).alias("recurs"))
    ranked = lines.join(_repeated(lines), ["thread", "key"], "left")
    repeated = F.coalesce(F.col("long") & (F.col("first.sent") < F.col("sent")) & (F.col("first.sender") != F.col("sender")) & (F.col("first.marks") < F.col("marks")), F.lit(False))
    judged = ranked.select("id", "line_no", "kind", "sender", "key", repeated.alias("repeated"))
    sure = judged.filter(F.col("kind") != MAYBE).select("id", "line_no", ((F.col("kind") == NEW) & ~F.col("repeated")).alias("is_new"))
    doubtful = judged.filter(F.col("kind") == MAYBE).join(signed, ["sender", "key"], "left")
    return sure.union(doubtful.select("id", "line_no", (~(F.col("repeated") | F.coalesce("recurs", F.lit(False)))).alias("is_new")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = table(spark, sf_dir, "corpus").filter("domain = 'email'")
    return judged_lines(mail).filter("not is_new").select(F.col("id").alias("msg_id"), "line_no").distinct()
