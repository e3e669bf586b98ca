"""Structured Streaming forms of ledger, usage and promotion."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexiduct.functions import text as T
from lexiduct.operators import hotset, promote

COUNTED = "prefix string, event_id long, us long, window_us long, hits long, crossed boolean"


class LedgerProcessor(StatefulProcessor):
    """The anchored counter of each key as keyed state.  Rows of a micro-batch are put in
    the order of (time, event id); across batches the order of arrival counts.  Idle
    keys leave the state after the TTL.  A `mark` of an unknown key begins a window with
    no hit; a `clear` of one is ignored."""

    def __init__(self, threshold: int, window_s: int, idle_ttl_s: int):
        self.threshold, self.span, self.ttl = threshold, window_s * 1_000_000, idle_ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counter", "window_us long, hits long, promoted boolean", ttlDurationMs=self.ttl * 1000 if self.ttl else None)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.state.update((int(r["window_us"]), int(r["hits"]), bool(r["promoted"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable")
        start, hits, promoted = self.state.get() if self.state.exists() else (None, 0, False)
        out = []
        for e, us, kind in zip(f["event_id"], f["us"], f["kind"]):
            if kind in ("mark", "clear"):  # control events edit the flag and count nothing
                if kind == "mark" and start is None:
                    start = int(us)
                promoted = kind == "mark" if start is not None else False
                continue
            if start is None or us - start > self.span:
                start, hits, promoted = int(us), 0, False
            hits += 1
            crossed = not promoted and hits >= self.threshold
            promoted = promoted or crossed
            out.append((key[0], int(e), int(us), start, hits, crossed))
        if start is not None:
            self.state.update((start, hits, promoted))
        yield pd.DataFrame(out, columns=["prefix", "event_id", "us", "window_us", "hits", "crossed"])

    def close(self) -> None:
        pass


def ledger_stream(events: DataFrame, threshold: int = 20, window_s: int = 60, idle_ttl_s: int = 0, restored: DataFrame | None = None) -> DataFrame:
    """For a stream of events (event_id, ts, query; kind `hit`, `mark` or `clear`, `hit`
    where absent): one row for each hit with its window's start, its number in the window
    and whether it crossed.  restored is a ledger's state (prefix, hits, window_start,
    promoted), as `demand.read_snapshot` gives it, that a new stream starts from.  Needs
    the RocksDB state store."""
    kind = F.col("kind") if "kind" in events.columns else F.lit("hit")
    rows = events.select("query", F.col("event_id").cast("long").alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), kind.alias("kind"))
    first = None
    if restored is not None:
        first = restored.select(F.col("prefix").alias("query"), F.unix_micros("window_start").alias("window_us"), "hits", "promoted").groupBy("query")
    return rows.groupBy("query").transformWithStateInPandas(
        statefulProcessor=LedgerProcessor(threshold, window_s, idle_ttl_s), outputStructType=COUNTED, outputMode="Append", timeMode="ProcessingTime" if idle_ttl_s else "None", initialState=first
    )


def usage_stream(events: DataFrame, depth: int = 3) -> DataFrame:
    """prefix, hits so far; use complete or update mode.  The state is a row a prefix."""
    return events.groupBy(T.bucket("query", depth).alias("prefix")).agg(F.count("*").alias("hits"))


def windowed_usage(events: DataFrame, width: str = "1 day", late: str = "1 hour", depth: int = 3) -> DataFrame:
    """hits by prefix and epoch-aligned window; the watermark bounds the state and drops
    what comes later than that."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width), T.bucket("query", depth).alias("prefix"))
    return by.agg(F.count("*").alias("hits")).select(F.col("window.start").alias("start"), "prefix", "hits")


def surfaced_stream(answers: DataFrame) -> DataFrame:
    """word: each word once, when it first comes back."""
    return answers.select(F.explode("words").alias("word")).dropDuplicates(["word"])


ENTRIES = "prefix string, words long, loaded_us long, used_us long, loaded_in long"
WORDS = "prefix string, rank int, word string"
STATS = "batch long, enqueued long, dropped long, built long, empty long, evicted long, build_ms long"
CONTROLS = "event_id long, ts timestamp, query string, kind string"


class PromotionSink:
    """The hot set that a ledger_stream feeds, under a folder:

        entries/batch=N    the resident entries after batch N, one row each
        words/batch=N      the words of the entries loaded in batch N
        controls/batch=N   `clear` events for the ledger: evicted and empty prefixes
        stats/batch=N      what the batch queued, dropped, built and evicted

    `sink` is a foreachBatch body.  Every batch starts from the entries of the batch before
    and overwrites only its own folders, so one that runs again gives the same.  A stream
    of `controls(spark)`, joined to the events by a union, clears the ledger's flags."""

    def __init__(self, spark: SparkSession, corpus: DataFrame, path: str, cap: int = 100_000, capacity: int = 256, max_words: int = 50_000):
        self.spark, self.corpus, self.path = spark, corpus, path.rstrip("/")
        self.cap, self.capacity, self.max_words = cap, capacity, max_words

    def _read(self, kind: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{kind}")
        except Exception as e:  # nothing has been written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], f"{schema}, batch long")

    def entries(self, before: int | None = None) -> DataFrame:
        """The resident entries after the last batch (of those before a batch)."""
        every = self._read("state", "at long")
        last = (every if before is None else every.where(F.col("batch") < before)).agg(F.max("batch")).first()[0]
        if last is None:
            return self.spark.createDataFrame([], ENTRIES)
        return self._read("entries", ENTRIES).where(F.col("batch") == last).drop("batch")

    def hot(self) -> DataFrame:
        """prefix, rank, word of the resident entries."""
        e = self.entries().select("prefix", F.col("loaded_in").alias("batch"))
        return self._read("words", WORDS).join(e, ["prefix", "batch"]).select("prefix", "rank", "word")

    def stats(self) -> DataFrame:
        """One row: enqueued, dropped, built, empty, evicted, avg_build_ms so far."""
        s = self._read("stats", STATS.removeprefix("batch long, "))
        sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("enqueued", "dropped", "built", "empty", "evicted")]
        return s.agg(*sums, F.coalesce(F.sum("build_ms") / F.nullif(F.sum("built"), F.lit(0)), F.lit(0.0)).alias("avg_build_ms"))

    def controls(self) -> DataFrame:
        """The stream of events that clear flags (event_id, ts, query, kind)."""
        self._write_once("controls", CONTROLS)
        return self.spark.readStream.schema(CONTROLS).option("recursiveFileLookup", True).parquet(f"{self.path}/controls")

    def _write_once(self, kind: str, schema: str) -> None:
        """Makes the folder that a stream reads, if nothing has yet."""
        if self._read(kind, schema).isEmpty():
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/{kind}/batch=-1")

    def _write(self, df: DataFrame, kind: str, batch_id: int) -> DataFrame:
        to = f"{self.path}/{kind}/batch={batch_id}"
        df.write.mode("overwrite").parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def sink(self, batch: DataFrame, batch_id: int) -> None:
        """Takes a batch of counted events: lookups make entries recent, crossings go through
        the bounded queue, their ranges are loaded, and the least recent entries leave
        until the budget holds (the most recent one stays in any case)."""
        began = time.monotonic()
        seen = batch.select("prefix", "event_id", "us", "crossed").persist()
        try:
            old = self.entries(batch_id)
            looked = hotset.longest_prefix_match(seen.select(F.col("prefix").alias("query"), "us"), old).where("hot_prefix is not null")
            looked = looked.groupBy(F.col("hot_prefix").alias("prefix")).agg(F.max("us").alias("_us"))
            crossed = seen.where("crossed").select("prefix", "event_id", F.timestamp_micros("us").alias("ts"))
            # A prefix that crosses again, in a new window, is loaded anew.
            queue = promote.queue(crossed, old.select("prefix").where(F.lit(False)), self.capacity)
            at = crossed.groupBy("prefix").agg(F.max(F.unix_micros("ts")).alias("_at"))
            built = promote.build(queue.where("accepted"), self.corpus, self.max_words)
            words = self._write(built, "words", batch_id)
            new = words.groupBy("prefix").agg(F.count("*").alias("words")).join(at, "prefix")
            new = new.select("prefix", "words", F.col("_at").alias("loaded_us"), F.col("_at").alias("used_us"), F.lit(batch_id).cast("long").alias("loaded_in"))
            kept = old.join(new.select("prefix"), "prefix", "left_anti").join(looked, "prefix", "left").withColumn("used_us", F.greatest("used_us", F.coalesce("_us", "used_us"))).drop("_us")
            every = kept.unionByName(new)
            resident = promote.within_budget(every.withColumn("last_used", F.col("used_us")), self.cap).drop("last_used", "rank")
            resident = self._write(resident.select("prefix", "words", "loaded_us", "used_us", "loaded_in"), "entries", batch_id)
            gone = every.join(resident.select("prefix"), "prefix", "left_anti").select("prefix")
            empty = queue.where("accepted").select("prefix").join(new.select("prefix"), "prefix", "left_anti")
            clear = gone.select("prefix", F.lit("evicted").alias("why")).unionByName(empty.select("prefix", F.lit("empty").alias("why")))
            last = seen.agg(F.max("event_id").alias("event_id"), F.timestamp_micros(F.max("us")).alias("ts"))
            clear = clear.join(F.broadcast(last), F.lit(True)).select("event_id", "ts", F.col("prefix").alias("query"), F.lit("clear").alias("kind"), "why")
            clear = self._write(clear, "controls", batch_id)
            n = queue.agg(F.count_if("accepted").alias("enqueued"), F.count_if(~F.col("accepted")).alias("dropped")).first()
            lost = {r.why: r.n for r in clear.groupBy("why").agg(F.count("*").alias("n")).collect()}
            row = (batch_id, n.enqueued, n.dropped, new.count(), lost.get("empty", 0), lost.get("evicted", 0), int((time.monotonic() - began) * 1000))
            self._write(self.spark.createDataFrame([row], STATS).drop("batch"), "stats", batch_id)
            # Written last: the batch counts from here on, with entries or without.
            self._write(self.spark.createDataFrame([(batch_id,)], "at long"), "state", batch_id)
        finally:
            seen.unpersist()
