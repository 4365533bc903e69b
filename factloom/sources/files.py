"""Readers and writers: documents by separator, JSON lines, wiki XML, exchanges, books, ids of tokens."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.functions.text import strip

# Header of the id file.
MAGIC, HEADER = b"CV0I", "<4sBB2xQQ"


def read_documents(spark: SparkSession, path: str, separator: str = "\n\f\n") -> DataFrame:
    """(source, text) of files whose documents stand between separators; blank documents are left out."""
    return spark.read.text(path, lineSep=separator).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"), F.col("value").alias("text")).filter(strip(F.col("text")) != "")


def write_documents(df: DataFrame, path: str, separator: str = "\n\f\n") -> None:
    """Texts with separators between them; a form feed inside a text becomes a blank."""
    df.select(F.replace(F.coalesce("text", F.lit("")), F.lit("\f"), F.lit(" ")).alias("value")).write.mode("errorifexists").text(path, lineSep=separator)


def read_json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows by a declared schema; a line that doesn't parse gives nulls."""
    return spark.read.schema(schema).json(path)


def read_json_whole(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_wiki(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of the pages of a dump."""
    pages = spark.read.format("xml").option("rowTag", "page").schema("title string, revision struct<text:string>").load(path)
    return pages.select("title", F.col("revision.text").alias("text"))


def read_marked(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of files in one, each after a marker with its name."""
    parts = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^====\nFILE: ")).alias("p"))
    rx = r"(?s)^([^\n]+)\n====\n(.*)$"
    return parts.filter(F.col("p").rlike(rx)).select(F.regexp_extract("p", rx, 1).alias("name"), F.regexp_extract("p", rx, 2).alias("text"))


def read_exchanges(spark: SparkSession, path: str) -> DataFrame:
    """(q, a) of files of User:/Assistant: blocks."""
    rx = r"(?s)^User: (.*?)\nAssistant: (.*)$"
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n\n(?=User: )")).alias("b")).filter(F.col("b").rlike(rx))
    return blocks.select(F.regexp_extract("b", rx, 1).alias("q"), strip(F.regexp_extract("b", rx, 2)).alias("a"))


def clean_book(content: Column, path: Column) -> Column:
    """A book's text: latin-1 for names that end in -8.txt, without byte order mark, carriage returns and licence frame."""
    text = F.when(path.endswith("-8.txt"), F.decode(content, "ISO-8859-1")).otherwise(F.decode(content, "UTF-8"))
    text = F.replace(F.replace(text, F.lit("﻿"), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    text = F.regexp_replace(text, r"(?s)^.*?\*\*\* ?START OF[^\n]*\n", "")
    return strip(F.regexp_replace(text, r"(?s)\*\*\* ?END OF.*$", ""))


def read_books(spark: SparkSession, path: str) -> DataFrame:
    b = spark.read.format("binaryFile").load(path)
    return b.select("path", clean_book(F.col("content"), F.col("path")).alias("text"))


def pack_ids(ids: list[int], vocabulary: int, dictionary: int) -> bytes:
    """An id file: header with the dictionary's hash, then ids of two bytes, four for a vocabulary above 65,536."""
    width = 2 if vocabulary <= 65_536 else 4
    return struct.pack(HEADER, MAGIC, 1, width, dictionary, len(ids)) + b"".join(i.to_bytes(width, "little") for i in ids)


def unpack_ids(data: bytes, dictionary: int) -> list[int]:
    size = struct.calcsize(HEADER)
    magic, version, width, own, count = struct.unpack(HEADER, data[:size])
    if magic != MAGIC or version != 1 or own != dictionary or len(data) != size + width * count:
        raise ValueError("not an id file of this dictionary")
    return [int.from_bytes(data[i : i + width], "little") for i in range(size, len(data), width)]


def packed_ids(df: DataFrame, vocabulary: int, dictionary: int, codes: str = "codes") -> DataFrame:
    """df's codes as id files, one a row: (…, packed binary)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else pack_ids([int(i) for i in x], vocabulary, dictionary))

    return df.withColumn("packed", F.pandas_udf(run, "binary")(F.col(codes)))
