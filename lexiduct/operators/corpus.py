"""Building and indexing corpora: distinct, sorted sets of normalised words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiduct.functions import text as T

PIVOTS = 255


def tokens(texts: DataFrame, col: str = "text") -> DataFrame:
    """Candidate words of running text: value, split at ASCII white space."""
    return texts.select(F.explode(F.split(F.col(col), "[ \t\r\n]+")).alias("value"))


def build_corpus(values: DataFrame, blacklist: DataFrame | None = None) -> DataFrame:
    """word: the distinct accepted normal forms of values (value string), without those on
    the blacklist (word string).  Raw values are made distinct before they are
    normalised, so each costs its regular expressions once; the shuffles carry
    pre-aggregated keys.  The policy is a column, not a filter: a filter would be pushed
    below the projection and normalise once more."""
    forms = values.select("value").distinct().select(T.normalise("value").alias("word")).withColumn("ok", T.accept("word"))
    words = forms.groupBy("word").agg(F.max("ok").alias("ok")).where("ok").select("word")
    return words.join(blacklist.select("word").distinct(), "word", "left_anti") if blacklist is not None else words


def ingest_counts(values: DataFrame) -> DataFrame:
    """source_count, rejected, unique_count of an ingest (null values are rejected), over
    one scan: values are pre-aggregated by normal form."""
    by = values.groupBy("value").agg(F.count("*").alias("n")).select(T.normalise("value").alias("word"), "n")
    by = by.groupBy("word").agg(F.sum("n").alias("n")).withColumn("ok", T.accept("word"))
    return by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("source_count"),
        F.coalesce(F.sum(F.when(~F.col("ok"), F.col("n"))), F.lit(0)).alias("rejected"),
        F.count_if("ok").alias("unique_count"),
    )


def reject_reasons(values: DataFrame) -> DataFrame:
    """reason, values: how many distinct normal forms each rule rejects (one form may fall
    under several)."""
    w = values.select("value").distinct().select(T.normalise("value").alias("word")).distinct()
    flags = T.junk_flags(F.col("word"))
    counts = w.agg(*[F.count_if(c).alias(k) for k, c in flags.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("reason"), F.col(k).alias("n_words")) for k in flags])).alias("r")).select("r.*")


def ordered(corpus: DataFrame, partitions: int | None = None) -> DataFrame:
    """Range-partitioned and sorted by word: files whose statistics prune prefix scans."""
    dealt = corpus.repartitionByRange(partitions, "word") if partitions else corpus.repartitionByRange("word")
    return dealt.sortWithinPartitions("word")


def pivots(rows: DataFrame, col: str) -> list[str]:
    """PIVOTS values of a column at most, ascending: those with the least hashes, so a
    random choice in one pass, the same at each."""
    few = rows.select(F.col(col).alias("v")).distinct().orderBy(F.xxhash64("v"), "v").limit(PIVOTS)
    return sorted((r.v for r in few.collect()), key=str.encode)


def stretch(col: str, ascending: list[str]):
    """The number of pivots not above a value: stretches of the byte order that hold about
    as many of the rows that the pivots were chosen from."""
    return F.size(F.filter(F.lit(ascending).cast("array<string>"), lambda p: p <= F.col(col)))


def positions(corpus: DataFrame) -> DataFrame:
    """word, line (from 0) and byte offset in the newline-delimited sorted file.  Numbering
    runs within stretches between random pivots, and the stretches' totals (one row each)
    are added up apart; no task sees the whole corpus, whatever its words begin with."""
    at = stretch("word", pivots(corpus, "word"))
    size = (F.octet_length("word") + 1).cast("long")
    rows = corpus.select("word", at.alias("part"), size.alias("size"))
    totals = rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    inner = Window.partitionBy("part").orderBy("word")
    run = rows.withColumn("line", F.row_number().over(inner) - 1).withColumn("off", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return run.join(base, "part").select("word", (F.col("line") + F.col("n0")).cast("long").alias("line"), (F.col("off") + F.col("b0")).cast("long").alias("offset"))


def skip_index(corpus: DataFrame, stride: int = 4096) -> DataFrame:
    """word, offset of every stride-th word of the sorted corpus."""
    return positions(corpus).where(F.col("line") % stride == 0).select("word", "offset")


def index_seek(queries: DataFrame, anchors: DataFrame) -> DataFrame:
    """query, anchor, offset: the greatest anchor not above the query, or (null, 0).  An
    as-of join without a range join: anchors and queries go together to stretches between
    anchors, each of which begins with one, and there the last anchor before a query in
    byte order is carried to it by a window.  No pair of query and anchor is formed."""
    at = pivots(anchors, "word")
    a = anchors.select(F.col("word").alias("key"), F.lit(0).alias("kind"), F.struct("word", "offset").alias("a"))
    q = queries.select(F.col("query").alias("key")).where("key is not null").distinct()
    rows = a.unionByName(q.select("key", F.lit(1).alias("kind"), F.lit(None).cast(a.schema["a"].dataType).alias("a")))
    order = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("part", stretch("key", at)).withColumn("hit", F.last("a", ignorenulls=True).over(order)).where("kind = 1")
    return out.select(F.col("key").alias("query"), F.col("hit.word").alias("anchor"), F.coalesce("hit.offset", F.lit(0)).cast("long").alias("offset"))
