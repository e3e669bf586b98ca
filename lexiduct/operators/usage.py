"""Long-term usage: hits by short prefix, words ever surfaced, hot and cold lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiduct.functions import text as T


def bucket_hits(records: DataFrame, depth: int = 3) -> DataFrame:
    """prefix, hits: records (query string) counted by their first code points (depth below
    1 means 3); shorter queries make buckets of their own.  Pre-aggregated."""
    depth = depth if depth >= 1 else 3
    return records.groupBy(T.bucket("query", depth).alias("prefix")).agg(F.count("*").alias("hits"))


def surfaced(records: DataFrame) -> DataFrame:
    """word: every word ever returned (records: words array<string>)."""
    return records.select(F.explode("words").alias("word")).distinct()


def is_surfaced(words: DataFrame, seen: DataFrame) -> DataFrame:
    """words (any columns, word string) with surfaced: whether the word ever came back."""
    known = seen.select("word").distinct().withColumn("surfaced", F.lit(True))
    return words.join(known, "word", "left").withColumn("surfaced", F.coalesce("surfaced", F.lit(False)))


def unsurfaced(corpus: DataFrame, seen: DataFrame) -> DataFrame:
    return corpus.select("word").join(seen.select("word"), "word", "left_anti")


def hot(buckets: DataFrame, n: int = 0) -> DataFrame:
    """The busiest buckets; n below 1 gives all.  Ties by prefix."""
    out = buckets.orderBy(F.desc("hits"), "prefix")
    return out.limit(n) if n > 0 else out


def cold(buckets: DataFrame, max_hits: int) -> DataFrame:
    return buckets.where(F.col("hits") <= max_hits).orderBy("hits", "prefix")


def stats(records: DataFrame, depth: int = 3) -> DataFrame:
    """tracked_prefixes, surfaced_words, total_records."""
    b = bucket_hits(records, depth).agg(F.count("*").alias("tracked_prefixes"), F.coalesce(F.sum("hits"), F.lit(0)).alias("total_records"))
    return b.join(surfaced(records).agg(F.count("*").alias("surfaced_words")), F.lit(True)).select("tracked_prefixes", "surfaced_words", "total_records")


def merge_counts(*buckets: DataFrame) -> DataFrame:
    """One row a prefix over several usage tables."""
    out = buckets[0].select("prefix", "hits")
    for b in buckets[1:]:
        out = out.unionByName(b.select("prefix", "hits"))
    return out.groupBy("prefix").agg(F.sum("hits").alias("hits"))


def migrate(seen: DataFrame, corpus: DataFrame) -> DataFrame:
    """The surfaced words that a new corpus still has; bucket counts move unchanged."""
    return seen.select("word").distinct().join(corpus.select("word"), "word", "left_semi")


def as_map(buckets: DataFrame) -> DataFrame:
    """One row: prefix_hits map.  For snapshots of usage tables, which are short."""
    return buckets.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("prefix", "hits")))).alias("prefix_hits"))
