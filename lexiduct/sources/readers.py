"""Readers of raw terms: JSON arrays, JSON lines, CSV columns, plain lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiduct.functions import text as T


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """value: the elements of files that each hold one JSON array of strings; null elements
    become the empty string.  Fails if a file is anything else.  A file is one row, so
    split large feeds into many files or use read_json_lines."""
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    fine = kind.isin("ARRAY<STRING>", "ARRAY<VOID>")
    items = F.when(fine, F.variant_get("v", "$", "array<string>")).otherwise(F.raise_error(F.lit("expected a JSON array of strings")).cast("array<string>"))
    return raw.select(F.explode(items).alias("value")).select(F.coalesce("value", F.lit("")).alias("value"))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: one JSON string a line; splittable."""
    raw = spark.read.text(path).where("trim(value) <> ''").select(F.try_parse_json("value").alias("v"))
    s = F.when(F.schema_of_variant("v") == "STRING", F.variant_get("v", "$", "string")).when(F.is_variant_null("v"), F.lit("")).otherwise(F.raise_error(F.lit("expected a JSON string")).cast("string"))
    return raw.select(s.alias("value"))


def read_csv_column(spark: SparkSession, path: str, column: str, multiline: bool = False) -> DataFrame:
    """value: the trimmed, non-empty cells of a CSV column, picked by header name without
    regard to case and outer space (the first that fits).  Ragged rows are tolerated and a
    byte-order mark is dropped.  multiline allows line breaks within quotes, at the price
    of files that can't be split."""
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", multiline).csv(path)
    names = [c.removeprefix("﻿").strip() for c in df.columns]
    at = next((i for i, c in enumerate(names) if c.casefold() == column.strip().casefold()), None)
    if at is None:
        raise ValueError(f"column {column!r} not found; available: {', '.join(names)}")
    cells = df.toDF(*[f"c{i}" for i in range(len(names))]).select(T.trim_space(F.col(f"c{at}")).alias("value"))
    return cells.where("value is not null and value <> ''")


def csv_terms(spark: SparkSession, path: str, column: str, blacklist: DataFrame | None = None) -> DataFrame:
    """read_csv_column without values whose normal form is blacklisted; repeats stay."""
    cells = read_csv_column(spark, path, column)
    if blacklist is None:
        return cells
    return cells.withColumn("word", T.normalise("value")).join(blacklist.select("word").distinct(), "word", "left_anti").select("value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of a text file without their line ends (carriage returns before a
    line feed too); spaces stay."""
    return spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", r"\r+$", "").alias("value"))


def read_pinned(spark: SparkSession, path: str) -> DataFrame:
    """prefix: lines that are no comment (#) and not blank, normalised."""
    rows = spark.read.text(path).select(F.trim("value").alias("value")).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    return rows.select(T.normalise("value").alias("prefix")).where("prefix <> ''").distinct()


def read_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """word: normalised, distinct, without blanks."""
    return spark.read.text(path).select(T.normalise("value").alias("word")).where("word <> ''").distinct()
