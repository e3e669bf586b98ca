"""Corpus set operations: diff, merge, prune, blacklist, retention, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiduct.functions import text as T


def diff(current: DataFrame, staged: DataFrame) -> DataFrame:
    """added, dropped, retained: one full outer join, or rather one aggregation by word."""
    both = current.select("word", F.lit(1).alias("old"), F.lit(0).alias("new")).unionByName(staged.select("word", F.lit(0).alias("old"), F.lit(1).alias("new")))
    by = both.groupBy("word").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    return by.agg(F.count_if(F.expr("new > old")).alias("added"), F.count_if(F.expr("old > new")).alias("dropped"), F.count_if(F.expr("old = new")).alias("retained"))


def merge(current: DataFrame, staged: DataFrame) -> DataFrame:
    return current.select("word").unionByName(staged.select("word")).distinct()


def live_buckets(buckets: DataFrame, max_hits: int = 0) -> DataFrame:
    return buckets.where(F.col("hits") > max_hits).select("prefix").distinct()


def prune(corpus: DataFrame, buckets: DataFrame, depth: int = 3, max_hits: int = 0) -> DataFrame:
    """Keeps the words whose bucket has more than max_hits.  A bucket shorter than depth
    protects only the word that is as short itself."""
    alive = live_buckets(buckets, max_hits)
    return corpus.select("word", T.bucket("word", depth).alias("prefix")).join(alive, "prefix", "left_semi").select("word")


def kept_dropped(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: kept, dropped, of a corpus and what a prune or a blacklist left of it."""
    return diff(before, after).select(F.col("retained").alias("kept"), "dropped")


def without(corpus: DataFrame, blacklist: DataFrame) -> DataFrame:
    """The corpus without blacklisted whole words."""
    return corpus.select("word").join(blacklist.select("word").distinct(), "word", "left_anti")


def blacklist_add(current: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the new blacklist sorted, one row added / total): words are normalised, empty ones
    don't count."""
    new = words.select(T.normalise("word").alias("word")).where("word <> ''").distinct()
    by = current.select("word", F.lit(0).alias("n")).unionByName(new.withColumn("n", F.lit(1))).groupBy("word").agg(F.min("n").alias("n"))
    counts = by.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("added"), F.count("*").alias("total"))
    return by.select("word").orderBy("word"), counts


def retention_plan(manifests: DataFrame, current: str, keep: int = 3) -> DataFrame:
    """version, n: the versions to delete: all but the newest keep by number, never the
    current one; names that aren't vN don't take part."""
    n = T.version_number(F.col("version"))
    rows = manifests.select("version", n.alias("n")).where("n is not null").distinct()
    ranked = rows.withColumn("age", F.row_number().over(Window.orderBy(F.desc("n"))))
    return ranked.where((F.col("age") > keep) & (F.col("version") != current)).select("version", "n")


def lineage(spark: SparkSession, manifests: DataFrame, most: int = 1000) -> DataFrame:
    """version, ancestor, steps: every version with each of its ancestors (itself at 0),
    up to `most` steps.  Manifests are a short table."""
    base = manifests.select("version", "parent_version")
    front = base.select("version", F.col("version").alias("ancestor"), F.lit(0).alias("steps"))
    out, n = front, 0
    parents = base.select(F.col("version").alias("ancestor"), "parent_version")
    while n < most:
        n += 1
        front = front.join(parents, "ancestor").where("parent_version is not null and parent_version <> ''").select("version", F.col("parent_version").alias("ancestor"), F.lit(n).alias("steps"))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out
