"""Readers: every source ends in the columns text, label, domain, source, year (schema.MESSAGE), read lazily and pruned by Catalyst.

Schemas are declared, never inferred. Paths may be folders or globs; nothing is listed on the driver beyond what Spark lists.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from postmill.functions import text as T
from postmill.functions import udfs as U

TWO_COLUMNS = StructType([StructField("label", StringType()), StructField("text", StringType())])


def _named(df: DataFrame, domain: str, source: str, year: int | Column) -> DataFrame:
    year = year if isinstance(year, Column) else F.lit(year)
    return df.withColumn("domain", F.lit(domain)).withColumn("source", F.lit(source)).withColumn("year", year.cast("int"))


def read_tsv(spark: SparkSession, path: str, domain: str = "sms", source: str = "tsv", year: int = 2011) -> DataFrame:
    """Headerless label and text, parted by a tab; quotes are text."""
    return _named(spark.read.schema(TWO_COLUMNS).csv(path, sep="\t", quote="", encoding="UTF-8"), domain, source, year)


# Bytes 0x80-0x9f of Windows-1252, which the CSV reader knows as the controls of Latin-1 only.
C1 = bytes(b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))


def read_csv(spark: SparkSession, path: str, domain: str = "sms", source: str = "csv", year: int = 2022, encoding: str = "ISO-8859-1", header: bool = True, schema: StructType = TWO_COLUMNS) -> DataFrame:
    """Quoted CSV, any encoding the JVM knows; labels come out lower-cased, texts repaired."""
    windows = encoding.lower() in ("windows-1252", "cp1252")
    df = spark.read.schema(schema).csv(path, header=header, encoding="ISO-8859-1" if windows else encoding, multiLine=True, escape='"')
    if windows:
        df = df.withColumn("text", F.translate("text", C1.decode("latin-1"), C1.decode("cp1252")))
    return _named(df.select(F.lower(F.trim("label")).alias("label"), U.fix_encoding("text").alias("text")), domain, source, year)


def parse_ragged(df: DataFrame, line: str = "line") -> DataFrame:
    """Lines `type,direction,sender,sender,timestamp,?,HAM/SPAM,message` whose message holds bare commas.

    Kept are lines of eight parts or more with a known tag; the message is what follows, without trailing commas, quotes and a tag
    that the file repeats; the year is the timestamp's, 2014 where it has none.
    """
    parts = F.split(F.col(line), ",", -1)
    tag = F.upper(F.trim(F.get(parts, F.lit(6))))
    message = F.array_join(F.slice(parts, 8, F.greatest(F.size(parts) - 7, F.lit(1))), ",")
    message = F.trim(F.regexp_replace(message, ",+$", ""))
    message = F.regexp_replace(message, '^"+|"+$', "")
    message = F.trim(F.regexp_replace(message, r"(?i),*\s*(spam|ham)\s*$", ""))
    year = F.expr("try_cast(nullif(regexp_extract(_stamp, '20[0-9][0-9]', 0), '') AS INT)")
    kept = df.withColumn("_stamp", F.get(parts, F.lit(4))).filter((F.size(parts) >= 8) & tag.isin("HAM", "SPAM"))
    return kept.select("*", F.lower(tag).alias("label"), F.trim(F.get(parts, F.lit(1))).alias("direction"), F.coalesce(year, F.lit(2014)).alias("year"), message.alias("text")).drop("_stamp")


def read_ragged(spark: SparkSession, path: str, source: str = "sms_survey") -> DataFrame:
    return parse_ragged(spark.read.text(path).withColumnRenamed("value", "line")).drop("line").withColumn("domain", F.lit("sms")).withColumn("source", F.lit(source))


def read_mail_parquet(spark: SparkSession, *paths: str, source: str = "mail_corp", most: int = 3000) -> DataFrame:
    """Parquet files with subject, message, label 0/1 and date, the text both as packaged and with its punctuation joined."""
    df = spark.read.parquet(*paths)
    body = F.substring("message", 1, most)
    year = F.coalesce(F.year(F.expr("try_to_timestamp(cast(date as string))")), F.lit(2004))
    out = df.select(
        F.when(F.col("label").cast("int") == 0, "ham").when(F.col("label").cast("int") == 1, "spam").alias("label"),
        U.fix_encoding(T.as_message(T.unpackage(F.col("subject")), T.unpackage(body))).alias("text"), T.as_message(F.col("subject"), body).alias("text_as_packaged"), year.alias("_year"),
    )
    return _named(out, "email", source, F.col("_year")).drop("_year")


def _mail(raw: DataFrame, label: Column, source: str, default_year: int, boxed: bool = False) -> DataFrame:
    parsed = raw.withColumn("_m", U.parse_mime("content", boxed))
    text = U.fix_encoding(T.as_message(F.col("_m.subject"), F.col("_m.body")))
    return _named(parsed.select(label.alias("label"), text.alias("text"), F.coalesce("_m.year", F.lit(default_year)).alias("_year"), *[c for c in raw.columns if c == "file"]), "email", source, F.col("_year")).drop("_year")


def read_mail_folders(spark: SparkSession, folders: dict[str, str], source: str = "mail_lists", default_year: int = 2002) -> DataFrame:
    """One message a file, in folders that each have a label; files named `cmds` are left out."""
    out = None
    for path, label in folders.items():
        raw = spark.read.format("binaryFile").load(path).filter(~F.col("path").rlike("/cmds$"))
        df = _mail(raw.select("content"), F.lit(label), source, default_year)
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no folders")
    return out


def read_mbox(spark: SparkSession, path: str, label: str = "phishing", source: str = "mail_phish", default_year: int = 2005) -> DataFrame:
    """Mailboxes cut at their `From ` lines by the text source, so a large mailbox is split over tasks; the year is the file name's.

    The source hands on the bytes of a record as they are, and they go to the parser as binary: bodies in any charset stay whole.
    """
    raw = spark.read.option("lineSep", "\nFrom ").text(path).select(F.col("value").cast("binary").alias("content"), F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"))
    mail = _mail(raw.filter(F.octet_length("content") > 1), F.lit(label), source, default_year, boxed=True)
    return mail.withColumn("year", F.coalesce(F.expr(r"try_cast(regexp_extract(file, '(\\d{4})$', 1) AS INT)"), F.lit(default_year)))


def _members(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """(member, bytes) of the files in a zip or a tar archive, compressed or not, one at a time."""
    import io
    import tarfile
    import zipfile

    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            yield from ((x, archive.read(x)) for x in archive.namelist() if not x.endswith("/"))
    elif re.search(r"\.(?:tar|tgz|tbz2?|txz)(?:\.(?:gz|bz2|xz))?$", name):
        with tarfile.open(fileobj=io.BytesIO(content)) as archive:
            yield from ((x.name, archive.extractfile(x).read()) for x in archive if x.isfile())
    else:
        raise ValueError(f"no archive: {name}")


def read_archive(spark: SparkSession, path: str, member: str = "") -> DataFrame:
    """(path, member, content) of the files inside zip and tar archives whose name holds `member`; one archive a task at a time, each member its own row and batch."""

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                for inner, data in _members(name, content):
                    if member in inner:
                        yield pd.DataFrame({"path": [name], "member": [inner], "content": [data]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "path string, member string, content binary")


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines, or files that each hold one value or an array of them (found by their first character)."""
    lines = spark.read.text(path, wholetext=False).limit(1).collect()
    whole = bool(lines) and (lines[0][0].lstrip().startswith("[") or not lines[0][0].rstrip().endswith("}"))
    return spark.read.schema(schema).json(path, multiLine=whole)


# The public collections the message schema was made for: where each is read from below a root folder, and how. Archives are fetched by hand.
CATALOGUE: dict[str, tuple[str, str, str]] = {
    "sms_archive": ("sms_archive/*.tsv", "sms", "tsv"), "sms_relabel": ("sms_relabel/*.csv", "sms", "csv"), "sms_survey": ("sms_survey/*.csv", "sms", "ragged"),
    "mail_corp": ("mail_corp/*.parquet", "email", "mail_parquet"), "mail_lists": ("mail_lists", "email", "mail_folders"), "mail_phish": ("mail_phish/*", "email", "mbox"),
}


def read_catalogue(spark: SparkSession, root: str, *names: str, folders: dict[str, str] | None = None) -> DataFrame:
    """The named sources of CATALOGUE (all, if none is named) below `root`, in one table; folders: label of each folder of `mail_lists`."""
    from postmill.schema import union_messages

    readers = {
        "tsv": lambda p, s: read_tsv(spark, p, source=s), "csv": lambda p, s: read_csv(spark, p, source=s), "ragged": lambda p, s: read_ragged(spark, p, source=s), "mail_parquet": lambda p, s: read_mail_parquet(spark, p, source=s),
        "mail_folders": lambda p, s: read_mail_folders(spark, {f"{p}/{folder}": label for folder, label in (folders or {"easy_ham": "ham", "hard_ham": "hard_ham", "spam": "spam"}).items()}, source=s), "mbox": lambda p, s: read_mbox(spark, p, source=s),
    }
    if unknown := set(names) - set(CATALOGUE):
        raise ValueError(f"no such source: {sorted(unknown)}")
    return union_messages(*(readers[kind](f"{root.rstrip('/')}/{path}", name) for name, (path, _, kind) in CATALOGUE.items() if not names or name in names))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """An append-only JSON-lines cache, the newest entry of each (model, variant, id)."""
    rows = spark.read.schema("seq bigint, model string, variant string, id string, label string, secs double").json(path)
    return newest(rows)


def newest(rows: DataFrame, keys: tuple[str, ...] = ("model", "variant", "id"), seq: str = "seq") -> DataFrame:
    """The row with the highest `seq` of each key, by an aggregate with map-side combine."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))
