"""Promotion: from threshold crossings to a materialised hot set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiduct.functions import text as T
from lexiduct.operators.match import prefix_join_topk


def queue(crossed: DataFrame, resident: DataFrame, capacity: int = 256) -> DataFrame:
    """prefix, accepted: each crossed prefix once, without resident ones, in order of its
    first crossing (ts, event_id); those beyond the capacity are dropped."""
    first = crossed.groupBy("prefix").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    new = first.join(resident.select("prefix"), "prefix", "left_anti")
    head = new.orderBy("at", "prefix").limit(capacity).select(F.col("prefix").alias("_in"))
    return new.select("prefix").join(head, F.col("prefix") == F.col("_in"), "left").select("prefix", F.col("_in").isNotNull().alias("accepted"))


def build(prefixes: DataFrame, corpus: DataFrame, max_words: int = 50_000) -> DataFrame:
    """prefix, rank, word: the words of each prefix, the first max_words in byte order."""
    return prefix_join_topk(prefixes.select(F.col("prefix").alias("query")), corpus, max_words).withColumnRenamed("query", "prefix")


def prefix_sizes(prefixes: DataFrame, corpus: DataFrame, max_words: int = 50_000) -> DataFrame:
    """prefix, words, truncated for each distinct prefix, 0 where the corpus has none.
    Counts are pre-aggregated, no list is built."""
    p = prefixes.select("prefix").where("prefix <> ''").distinct()
    lengths = sorted(r[0] for r in p.select(F.length("prefix")).distinct().collect())
    fits = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("word"))
    heads = corpus.select(F.explode(F.transform(fits, lambda n: F.left("word", n))).alias("prefix"))
    n = heads.join(F.broadcast(p), "prefix", "left_semi") if p.count() <= 100_000 else heads.join(p, "prefix", "left_semi")
    n = n.groupBy("prefix").agg(F.count("*").alias("n"))
    return p.join(n, "prefix", "left").select("prefix", F.least(F.coalesce("n", F.lit(0)), F.lit(max_words)).cast("long").alias("words"), (F.coalesce("n", F.lit(0)) > max_words).alias("truncated"))


def pinned(lines: DataFrame, corpus: DataFrame, max_words: int = 50_000) -> DataFrame:
    """Warm-up: the pinned prefixes (lines of a text file: value) with their words."""
    p = lines.select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')").select(T.normalise("value").alias("prefix")).where("prefix <> ''").distinct()
    return build(p, corpus, max_words)


def within_budget(entries: DataFrame, cap: int) -> DataFrame:
    """An approximation of the LRU's content by one window: the most recent entries until
    the budget is spent, and the most recent one in any case (entries: prefix, words,
    last_used).  Entries are one row a hot prefix."""
    order = Window.orderBy(F.desc("last_used"), "prefix")
    out = entries.withColumn("_sum", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(order))
    return out.where((F.col("_sum") <= cap) | (F.col("rank") == 1)).drop("_sum")
