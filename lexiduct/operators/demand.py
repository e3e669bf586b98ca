"""The ledger: anchored fixed-window counters with a one-shot threshold crossing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOWS = "prefix string, window_us long, hits long, last_us long, crossed_id long, crossed_us long"


class AnchoredCounter:
    """The counter of one key.  A window begins at its first event; an event later than
    the window's length after that begins a new one.  crossed is told once a window, when
    the hits reach the threshold."""

    def __init__(self, threshold: int, window_us: int):
        self.threshold, self.span = threshold, window_us
        self.start = self.last = None
        self.hits, self.promoted = 0, False

    def record(self, us: int) -> bool:
        if self.start is None or us - self.start > self.span:
            self.start, self.hits, self.promoted = us, 0, False
        self.hits += 1
        self.last = us
        if not self.promoted and self.hits >= self.threshold:
            self.promoted = True
            return True
        return False


def ledger_windows(events: DataFrame, threshold: int = 20, window_s: int = 60) -> DataFrame:
    """For events (event_id, ts, query): one row for each anchored window of each key, with
    window_start, hits, last_seen, and the event that crossed the threshold (or null).

    Partitions are sorted by (query, ts, event_id) and streamed; a task carries the
    counter of one key from batch to batch, so a key of any size needs no memory of its
    own, and windows are found by bisection instead of event by event."""
    span = int(window_s * 1_000_000)
    rows = events.select("query", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").cast("long").alias("event_id")).where("query is not null and us is not null")
    rows = rows.repartition("query").sortWithinPartitions("query", "us", "event_id")

    def run(batches):
        key, start, hits, last, cid, cus = None, 0, 0, 0, None, None
        for b in batches:
            out: list[tuple] = []
            us, ids = b["us"].to_numpy(), b["event_id"].to_numpy(zero_copy_only=False)
            codes = b["query"].dictionary_encode()
            idx = codes.indices.to_numpy()
            names = codes.dictionary.to_pylist()
            edges = np.flatnonzero(np.concatenate([[True], idx[1:] != idx[:-1], [True]])) if len(idx) else []
            for lo, hi in zip(edges[:-1], edges[1:]):
                name, at = names[idx[lo]], int(lo)
                if name != key:
                    if key is not None:
                        out.append((key, start, hits, last, cid, cus))
                    key, start, hits, cid, cus = name, int(us[lo]), 0, None, None
                while at < hi:
                    if us[at] - start > span:
                        out.append((key, start, hits, last, cid, cus))
                        start, hits, cid, cus = int(us[at]), 0, None, None
                    end = at + int(np.searchsorted(us[at:hi], start + span, "right"))
                    n = end - at
                    if cid is None and hits + n >= threshold:
                        j = at + max(0, threshold - hits - 1)
                        cid, cus = int(ids[j]), int(us[j])
                    hits += n
                    last = int(us[end - 1])
                    at = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), KINDS)], names=NAMES)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((key, start, hits, last, cid, cus), KINDS)], names=NAMES)

    out = rows.mapInArrow(run, WINDOWS)
    return out.select(
        "prefix", F.timestamp_micros("window_us").alias("window_start"), "hits", F.timestamp_micros("last_us").alias("last_seen"), F.col("crossed_id"), F.timestamp_micros("crossed_us").alias("crossed_at")
    )


def ledger_hits(events: DataFrame, window_s: int = 60, keys: tuple[str, ...] = ("query",)) -> DataFrame:
    """events (ts, event_id and the keys; other columns stay) with window_us and hit: the
    start of the event's anchored window and its number in it.  Keys are counted in
    parallel, streamed as in ledger_windows."""
    span = int(window_s * 1_000_000)
    rows = events.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("_key", F.to_json(F.struct(*keys)))
    rows = rows.where("_us is not null").repartition("_key").sortWithinPartitions("_key", "_us", "event_id")
    names = events.columns

    def run(batches):
        key, start, hits = None, 0, 0
        for b in batches:
            us = b["_us"].to_numpy()
            codes = b["_key"].dictionary_encode()
            idx, known = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            window, number = np.zeros(len(us), np.int64), np.zeros(len(us), np.int64)
            edges = np.flatnonzero(np.concatenate([[True], idx[1:] != idx[:-1], [True]])) if len(idx) else []
            for lo, hi in zip(edges[:-1], edges[1:]):
                at = int(lo)
                if known[idx[lo]] != key:
                    key, start, hits = known[idx[lo]], int(us[lo]), 0
                while at < hi:
                    if us[at] - start > span:
                        start, hits = int(us[at]), 0
                    end = at + int(np.searchsorted(us[at:hi], start + span, "right"))
                    window[at:end], number[at:end] = start, np.arange(hits + 1, hits + 1 + end - at)
                    hits, at = hits + end - at, end
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(window), pa.array(number)], names=[*names, "window_us", "hit"])

    return rows.mapInArrow(run, events.schema.add("window_us", "long").add("hit", "long"))


KINDS = [pa.string(), *[pa.int64()] * 5]
NAMES = ["prefix", "window_us", "hits", "last_us", "crossed_id", "crossed_us"]


def crossings(windows: DataFrame) -> DataFrame:
    """prefix, event_id, ts of each crossing."""
    return windows.where("crossed_id is not null").select("prefix", F.col("crossed_id").alias("event_id"), F.col("crossed_at").alias("ts"))


def ledger_state(windows: DataFrame) -> DataFrame:
    """The counters as they stand at the end: prefix, hits, window_start, last_seen, promoted."""
    last = F.max_by(F.struct("hits", "window_start", "last_seen", "crossed_id"), "window_start")
    return windows.groupBy("prefix").agg(last.alias("s")).select("prefix", "s.hits", "s.window_start", "s.last_seen", F.col("s.crossed_id").isNotNull().alias("promoted"))


def sweep(state: DataFrame, now, idle_ttl_s: int = 600) -> DataFrame:
    """The counters that aren't idle: seen at most idle_ttl_s before now (a column or value)."""
    return state.where(F.unix_micros(F.lit(now).cast("timestamp") if not hasattr(now, "cast") else now.cast("timestamp")) - F.unix_micros("last_seen") <= int(idle_ttl_s * 1_000_000))


def write_snapshot(state: DataFrame, path: str, number: int) -> str:
    """Writes a ledger's state as path/snapshot=<number>.  Spark's committer puts a marker
    beside complete files only, and readers take the highest number that has one."""
    to = f"{path.rstrip('/')}/snapshot={number}"
    state.select("prefix", "hits", "window_start", "last_seen", "promoted").write.mode("overwrite").parquet(to)
    state.sparkSession.createDataFrame([(number,)], "n long").write.mode("overwrite").parquet(f"{path.rstrip('/')}/done/snapshot={number}")
    return to


def read_snapshot(spark: SparkSession, path: str, now=None, idle_ttl_s: int = 600) -> DataFrame:
    """The state of the last complete snapshot without counters that are idle at `now` (a
    timestamp; None keeps all).  Where nothing was written, an empty state: a cold start."""
    schema = "prefix string, hits long, window_start timestamp, last_seen timestamp, promoted boolean"
    try:
        last = spark.read.schema("n long").option("recursiveFileLookup", True).parquet(f"{path.rstrip('/')}/done").agg(F.max("n")).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = None
    if last is None:
        return spark.createDataFrame([], schema)
    state = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/snapshot={last}")
    return state if now is None else sweep(state, now, idle_ttl_s)


def mark_promoted(state: DataFrame, prefixes: DataFrame, promoted: bool = True) -> DataFrame:
    """Sets or clears the flag of the given prefixes (prefix string)."""
    hit = prefixes.select("prefix").distinct().withColumn("_hit", F.lit(True))
    return state.join(hit, "prefix", "left").withColumn("promoted", F.when(F.col("_hit"), F.lit(promoted)).otherwise(F.col("promoted"))).drop("_hit")


def watch_list(state: DataFrame, n: int = 100) -> DataFrame:
    """The busiest counters that aren't promoted; ties by prefix."""
    return state.where(~F.col("promoted")).select("prefix", "hits").orderBy(F.desc("hits"), "prefix").limit(n)


def hot_prefixes(state: DataFrame) -> DataFrame:
    return state.where("promoted").select("prefix")


def ledger_stats(windows: DataFrame) -> DataFrame:
    """total_records, total_promotions, keys."""
    return windows.agg(F.sum("hits").alias("total_records"), F.count("crossed_id").alias("total_promotions"), F.count_distinct("prefix").alias("keys"))
