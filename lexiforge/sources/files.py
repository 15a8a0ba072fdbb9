"""Readers of text in many formats and encodings, and sinks.  Decoding runs in Arrow batches; failures give nulls."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html import unescape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexiforge.sources.encodings import read_text

ENCODINGS = ("utf-8", "gb18030", "latin-1")
_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, modificationTime, length, content) of all files under a folder; Spark passes over empty ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.withColumn("kind", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))


def decode_text(data: bytes, encodings: tuple[str, ...] = ENCODINGS) -> tuple[str, str]:
    """(text, encoding): by byte-order mark, else the first encoding that fits, else UTF-8 with replacements."""
    for mark, name in _MARKS:
        if data.startswith(mark):
            return data.decode(name, "replace"), name
    for name in encodings:
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace"), "utf-8"


def _zip_text(data: bytes, kind: str) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if kind == "docx":
            root = ElementTree.fromstring(z.read("word/document.xml"))
            space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
            return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))
        pages = [n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm"))]
        parts = [" ".join(unescape(re.sub(r"<[^>]+>", " ", decode_text(z.read(n))[0])).split()) for n in pages]
        return "\n\n".join(filter(None, parts))


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("encoding", StringType())]))
def _read(contents: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for data, kinds in contents:
        out = []
        for d, kind in zip(data, kinds, strict=True):
            try:
                out.append((_zip_text(d, kind), "zip") if kind in ("epub", "docx") else decode_text(d))
            except Exception:  # a broken file is a null row, listed by failures()
                out.append((None, None))
        yield pd.DataFrame(out, columns=["text", "encoding"])


def texts(files: DataFrame, kinds: tuple[str, ...] = ("txt", "md", "html", "epub", "docx")) -> DataFrame:
    """(path, kind, text, encoding) of scanned files of the given kinds."""
    rows = files.where(F.col("kind").isin(*kinds)).select("path", "kind", _read("content", "kind").alias("_t"))
    return rows.select("path", "kind", "_t.text", "_t.encoding")


#: Fixed value: the CJK share under which a converted text is suspicious.
SUSPICIOUS = 0.10


def inventory(files: DataFrame, kinds: tuple[str, ...] = ("txt", "epub", "mobi")) -> DataFrame:
    """(kind, n, bytes) of scanned files; kinds that are not named are ``other``."""
    kind = F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise("other")
    return files.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def converted(files: DataFrame, done: DataFrame | None = None, kinds: tuple[str, ...] = ("txt", "md")) -> DataFrame:
    """(path, text, encoding, cjk_ratio) of scanned text files, by detected encodings; those that ``done`` (path,
    modificationTime) has in the same or a later state are skipped."""
    rows = files.where(F.col("kind").isin(*kinds))
    if done is not None:
        known = done.groupBy("path").agg(F.max("modificationTime").alias("_done"))
        rows = rows.join(known, "path", "left").where("_done is null or _done < modificationTime").drop("_done")
    return rows.select("path", read_text("content").alias("_t")).select("path", "_t.text", "_t.encoding", "_t.cjk_ratio")


def quality_report(read: DataFrame) -> DataFrame:
    """(path, encoding, cjk_ratio, n_chars, suspicious) of converted files; what could not be read is suspicious."""
    low = F.coalesce(F.col("cjk_ratio") < SUSPICIOUS, F.lit(True))
    return read.select("path", "encoding", F.round("cjk_ratio", 4).alias("cjk_ratio"), F.length("text").alias("n_chars"), low.alias("suspicious"))


def failures(read: DataFrame) -> DataFrame:
    return read.where("text is null").select("path", "kind")


def strip_html(html: Column) -> Column:
    """Tags to blanks, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))


def markdown_sections(docs: DataFrame, level: int = 2) -> DataFrame:
    """(path, index, title, body): the parts of a Markdown text at headings of one level."""
    mark = "#" * level
    parts = F.filter(F.split("text", rf"(?m)(?=^{mark} )", -1), lambda x: x.startswith(f"{mark} "))
    rows = docs.select("path", F.posexplode(parts).alias("index", "_p"))
    return rows.select("path", "index", F.trim(F.regexp_extract("_p", rf"^{mark} ([^\n]*)", 1)).alias("title"), F.regexp_replace(F.regexp_replace("_p", rf"^{mark} [^\n]*\n?", ""), r"(?U)^\s+|\s+$", "").alias("body"))


def write_collection(df: DataFrame, path: str, by: str | None = None) -> None:
    """Overwrites a collection, partitioned by a column if one is given."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
