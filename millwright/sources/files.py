"""File intake: manifests, format detection, text decoding and e-mail bodies."""

from __future__ import annotations

from collections.abc import Iterator
from email import policy
from email.parser import BytesParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.functions import text as tx
from millwright.functions.common import let

# Leading bytes, as hex, and the format they mean.
MAGIC = (
    ("25504446", "pdf"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpg"), ("49492A00", "tiff"), ("4D4D002A", "tiff"),
    ("424D", "bmp"), ("41433130", "dwg"),
)
ZIP_MAGIC = ("504B0304", "504B0506", "504B0708")
OLE_MAGIC = "D0CF11E0A1B11AE1"


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files below a folder: name, length and content; content is read only where a query uses it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("name"), F.col("length").alias("size_bytes"), "modificationTime", "content")


def manifest(files: DataFrame, max_mb: int = 50) -> DataFrame:
    """Accepted or refused, with the reason; needs names and sizes only."""
    reason = tx.upload_verdict(F.col("name"), F.col("size_bytes"), max_mb)
    return files.select("name", "size_bytes", reason.alias("reason")).withColumn("accepted", F.col("reason") == "")


def _latin(content: Column, size: int) -> Column:
    return F.decode(F.substring(content, 1, size), "ISO-8859-1")


def _any_start(magic: Column, prefixes) -> Column:
    test = F.lit(False)
    for digits in prefixes:
        test = test | F.startswith(magic, F.lit(digits))
    return test


def is_zip(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 4)).isin(*ZIP_MAGIC)


def sniffed_format(content: Column, by_name: Column) -> Column:
    """Format by leading bytes, else by what the head reads like; zip containers are not opened here."""
    head = F.struct(
        F.hex(F.substring(content, 1, 8)).alias("magic"),
        F.upper(_latin(content, 1024)).alias("upper"),
        F.lower(_latin(content, 4096)).alias("lower"),
        _latin(content, 8192).alias("body"),
    )
    return let(head, lambda h: _format_of_head(h, by_name))


def _format_of_head(head: Column, by_name: Column) -> Column:
    has = lambda part, word: F.contains(head[part], F.lit(word))
    dxf = has("upper", "SECTION") & (has("upper", "HEADER") | has("upper", "ENTITIES") | has("upper", "EOF"))
    eml = (has("lower", "subject:") | has("lower", "from:")) & (has("lower", "mime-version:") | has("lower", "content-type:"))
    kind = F.when(_any_start(head["magic"], [MAGIC[0][0]]), MAGIC[0][1])
    for digits, name in MAGIC[1:]:
        kind = kind.when(_any_start(head["magic"], [digits]), name)
    return (
        kind.when(_any_start(head["magic"], ZIP_MAGIC), F.when(by_name.isin("docx", "xlsx"), by_name).otherwise("unknown"))
        .when(head["magic"] == OLE_MAGIC, F.when(by_name.isin("doc", "xls", "msg"), by_name).otherwise("doc"))
        .when(dxf, "dxf")
        .when(eml, "eml")
        .when((head["body"] != "") & ~has("body", "\x00"), "txt")
        .otherwise("unknown")
    )


# Fixed values of zip containers: the mark that ends the directory of members, turned round, and the bytes it ends within.
END_REVERSED, END_BYTES = "\x06\x05KP", 65557


def _has_member(directory: Column, name: str) -> Column:
    """Whether a zip directory, read as Latin-1, has an entry with just this name."""
    size = f"\\x{len(name) & 255:02x}\\x{len(name) >> 8:02x}"
    return directory.rlike(rf"(?s)PK\x01\x02.{{24}}{size}.{{16}}\Q{name}\E")


def container_format(content: Column, otherwise: Column) -> Column:
    """Office format of a zip container by its members; a damaged one keeps what ``otherwise`` says.

    Only the end of the file and the directory of members that it points to are looked at, no member is unpacked.
    """
    tail = F.substring(content, -END_BYTES, END_BYTES)

    def directory(end: Column) -> Column:
        digits = F.hex(F.substr(content, end + 13, F.lit(4)))
        size = F.conv(F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)]), 16, 10).cast("long")
        inside = (size <= end) & (end + 22 <= F.length(content))
        return let(size, lambda n: F.when(inside, F.decode(F.substr(content, (end - n + 1).cast("int"), n.cast("int")), "ISO-8859-1")))

    def by_members(found: Column) -> Column:
        return F.when(_has_member(found, "word/document.xml"), "docx").when(_has_member(found, "xl/workbook.xml"), "xlsx").otherwise(otherwise)

    back = F.locate(END_REVERSED, F.reverse(F.decode(tail, "ISO-8859-1")))
    end = F.when(back > 0, F.length(content) - back - 3)  # bytes ahead of the mark
    return let(let(end, directory), by_members)


def detect_formats(files: DataFrame) -> DataFrame:
    """Detected format of every file, and whether its extension says otherwise."""
    by_name = tx.extension_format(F.col("name"))
    sniffed = sniffed_format(F.col("content"), by_name)
    detected = F.when(is_zip(F.col("content")), container_format(F.col("content"), sniffed)).otherwise(sniffed)
    known = files.select("name", by_name.alias("by_name"), detected.alias("detected"))
    chosen = F.when(F.col("detected") != "unknown", F.col("detected")).otherwise(F.col("by_name"))
    mismatch = (F.col("detected") != "unknown") & (F.col("by_name") != "unknown") & (F.col("detected") != F.col("by_name"))
    return known.select("name", chosen.alias("format"), mismatch.alias("mismatch"))


def decode_text(content: Column) -> Column:
    """Cleaned text and the encoding it was read with: UTF-8, else Latin-1."""
    utf8 = content.cast("string")
    valid = F.is_valid_utf8(utf8)
    return F.struct(
        tx.clean_text(F.when(valid, utf8).otherwise(F.decode(content, "ISO-8859-1"))).alias("text"),
        F.when(valid, "utf-8").otherwise("latin-1").alias("encoding"),
    )


def _read_mail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, subjects = [], []
        for content in batch["content"]:
            message = BytesParser(policy=policy.default).parsebytes(bytes(content))
            headers = [f"{name}: {message.get(name.lower(), '')}" for name in ("From", "To", "Subject", "Date")]
            parts = message.walk() if message.is_multipart() else [message]
            bodies = [str(p.get_content()) for p in parts if p.get_content_type() == "text/plain"]
            texts.append("\n".join(headers + bodies))
            subjects.append(str(message.get("subject", "")))
        yield pd.DataFrame({"name": batch["name"], "raw_text": texts, "subject": subjects})


def email_text(files: DataFrame) -> DataFrame:
    """Header lines and plain-text parts of e-mail files."""
    mails = files.select("name", "content").mapInPandas(_read_mail, "name string, raw_text string, subject string")
    return mails.select("name", tx.clean_text(F.col("raw_text")).alias("text"), "subject")
