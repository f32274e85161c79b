"""Disguises that dodge keyword filters, as Column expressions drawn per row and word.

Every draw is an MD5 of seed, row id and word number: the same on any partitioning, and rate 0 changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from postmill.functions.text import draw

# Letters and what they are written as.
LEET_FROM, LEET_TO = "aeiostAEIOST", "431057431057"
HOMOGLYPH_FROM, HOMOGLYPH_TO = "aeopcxyi", "аеорсхуі"
SEPARATORS = (".", " ", "-", "*")
LEAST_LETTERS = 3
Attack = Callable[[Column, Column], Column]


def leetspeak(word: Column, luck: Column) -> Column:
    return F.translate(word, LEET_FROM, LEET_TO)


def homoglyph(word: Column, luck: Column) -> Column:
    return F.translate(word, HOMOGLYPH_FROM, HOMOGLYPH_TO)


def spacing(word: Column, luck: Column) -> Column:
    separator = F.element_at(F.array(*map(F.lit, SEPARATORS)), (F.floor(luck * len(SEPARATORS)) + 1).cast("int"))
    return F.regexp_replace(word, F.lit("(?<=.)(?=.)"), separator)


def typo(word: Column, luck: Column) -> Column:
    """One pair of neighbours changes places."""
    at = (F.floor(luck * (F.length(word) - 1)) + 1).cast("int")
    return F.concat(F.substr(word, F.lit(1), at - 1), F.substr(word, at + 1, F.lit(1)), F.substr(word, at, F.lit(1)), F.substr(word, at + 2, F.length(word)))


ATTACKS: dict[str, Attack] = {"leetspeak": leetspeak, "homoglyph": homoglyph, "spacing": spacing, "typo": typo}


def mixed(word: Column, luck: Column) -> Column:
    """Another disguise for each word."""
    which = F.floor(luck * len(ATTACKS))
    finer = luck * len(ATTACKS) - which
    out = word
    for k, attack in enumerate(ATTACKS.values()):
        out = F.when(which == k, attack(word, finer)).otherwise(out)
    return out


def attack(text: Column, row: Column, name: str, rate: Column | float, seed: str = "1") -> Column:
    """`text` with a share `rate` of its words of three letters or more disguised."""
    how = mixed if name == "mixed" else ATTACKS[name]
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    pieces = F.regexp_extract_all(text, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))

    def drawn(piece: Column, at: Column) -> Column:
        """The piece and its luck, null where it is left alone: drawn here once, not at each use."""
        hit = piece.rlike(f"^[A-Za-z]{{{LEAST_LETTERS},}}$") & (draw(f"{seed}:hit", row, at) < rate)
        return F.struct(piece.alias("piece"), F.when(hit, draw(f"{seed}:luck", row, at)).alias("luck"))

    def touch(word: Column) -> Column:
        return F.when(word["luck"].isNull(), word["piece"]).otherwise(how(word["piece"], word["luck"]))

    return F.array_join(F.transform(F.transform(pieces, drawn), touch), "")


def augment(df: DataFrame, id_col: str = "msg_id", text_col: str = "text", label_col: str = "label", seed: str = "0") -> DataFrame:
    """`df` and a disguised copy of every scam and of a fifth of the legitimate messages, at a rate between 0.15 and 0.5 each; `is_copy` tells them apart."""
    row = F.col(id_col)
    chosen = df.filter((F.col(label_col) != "legit") | (draw(f"{seed}:legit", row) < 0.2))
    rate = draw(f"{seed}:rate", row) * 0.35 + 0.15
    copies = chosen.withColumn(text_col, attack(F.col(text_col), row, "mixed", rate, seed)).withColumn("is_copy", F.lit(True))
    return df.withColumn("is_copy", F.lit(False)).unionByName(copies)
