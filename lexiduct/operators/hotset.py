"""The hot set: longest-prefix matching, LRU replay under a word budget, statistics."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiduct.operators import demand


def longest_prefix_match(queries: DataFrame, hot: DataFrame) -> DataFrame:
    """queries (any columns, query string) with hot_prefix: the longest prefix of the hot
    set (prefix string) that the query starts with, or null.  Each distinct query offers
    its own prefixes to a hash join; no range condition is joined."""
    q = queries.select("query").where("query <> ''").distinct()
    offers = q.select("query", F.explode(F.transform(F.sequence(F.lit(1), F.length("query")), lambda n: F.left("query", n))).alias("prefix"))
    best = offers.join(hot.select("prefix").distinct(), "prefix").groupBy("query").agg(F.max_by("prefix", F.length("prefix")).alias("hot_prefix"))
    return queries.join(best, "query", "left")


def is_resident(prefixes: DataFrame, hot: DataFrame) -> DataFrame:
    """prefixes (any columns, prefix string) with resident: whether the hot set has exactly
    that prefix."""
    known = hot.select("prefix").distinct().withColumn("resident", F.lit(True))
    return prefixes.join(known, "prefix", "left").withColumn("resident", F.coalesce("resident", F.lit(False)))


def hit_stats(matched: DataFrame) -> DataFrame:
    """hits, misses, hit_rate (0 without lookups) of longest_prefix_match rows."""
    out = matched.agg(F.count("hot_prefix").alias("hits"), F.count_if(F.col("hot_prefix").isNull()).alias("misses"))
    return out.withColumn("hit_rate", F.coalesce(F.col("hits") / F.nullif(F.col("hits") + F.col("misses"), F.lit(0)), F.lit(0.0)))


def entry_hits(matched: DataFrame) -> DataFrame:
    """prefix, hits of each hot prefix that was hit."""
    return matched.where("hot_prefix is not null").groupBy(F.col("hot_prefix").alias("prefix")).agg(F.count("*").alias("hits"))


class LruBudget:
    """A recency-ordered set of entries with a budget of words in all.

    Inserting replaces an entry of the same key, makes it the most recent, and evicts
    from the other end until the budget holds or only the new entry is left, which may
    exceed it alone.  A lookup finds the longest resident prefix and makes it recent."""

    def __init__(self, cap: int):
        self.cap = cap
        self.entries: OrderedDict[str, list[int]] = OrderedDict()  # prefix -> [words, hits]
        self.words = self.hits = self.misses = self.inserted = self.evicted = 0

    def insert(self, prefix: str, words: int) -> list[str]:
        if prefix in self.entries:
            self.words -= self.entries.pop(prefix)[0]
        self.entries[prefix] = [words, 0]
        self.words += words
        self.inserted += 1
        gone = []
        while self.words > self.cap and len(self.entries) > 1:
            key, (n, _) = self.entries.popitem(last=False)
            self.words -= n
            gone.append(key)
        self.evicted += len(gone)
        return gone

    def lookup(self, query: str) -> str | None:
        for n in range(len(query), 0, -1):
            if (p := query[:n]) in self.entries:
                self.entries.move_to_end(p)
                self.entries[p][1] += 1
                self.hits += 1
                return p
        self.misses += 1
        return None

    def evict(self, prefix: str) -> bool:
        if prefix not in self.entries:
            return False
        self.words -= self.entries.pop(prefix)[0]
        self.evicted += 1
        return True

    def newest_first(self) -> list[tuple[str, int, int]]:
        return [(p, w, h) for p, (w, h) in reversed(self.entries.items())]


REPLAY = "project string, seq long, event_id long, ts timestamp, query string, kind string, hot_prefix string, inserted string, inserted_words long, evicted array<string>, resident_words long, hits long"


def lru_replay(events: DataFrame, prefix_words: DataFrame, cap: int = 100_000, threshold: int = 20, window_s: int = 60, max_words: int = 50_000) -> DataFrame:
    """Replays a query log (project, event_id, ts, query; kind `hit` or `evict`, `hit` where
    absent) against ledger and hot set together, one row for each event, numbered by seq:
    what was hit, inserted and evicted, the words resident after it, and the hits of the
    entry that was hit.  An `evict` takes the entry of that very name out and counts nothing.

    Each event is counted by the ledger first; a crossing inserts the query's prefix range
    (prefix_words: prefix, words; capped at max_words) at once, an empty range clears the
    flag instead, so that the next event crosses again, and evicted prefixes lose their
    flag.  Counting is done before, in parallel by key.  What is left depends on the order
    across all keys of a project, so a project is one sequential stream: partitions are
    sorted by (project, ts, event_id) and passed through batch by batch.  The state is the
    resident entries with the window in which each crossed (only they can be flagged), so
    the budget bounds it, however many queries the log has; a task takes some 100,000
    events a second."""
    sizes = prefix_words.select(F.col("prefix").alias("query"), F.least("words", F.lit(max_words)).cast("long").alias("words"))
    kind = F.col("kind") if "kind" in events.columns else F.lit("hit")
    log = events.select("project", "event_id", "ts", "query", kind.alias("kind")).where("query is not null")
    counted = demand.ledger_hits(log.where("kind <> 'evict'"), window_s, ("project", "query"))
    counted = counted.unionByName(log.where("kind = 'evict'").withColumns({"window_us": F.lit(None).cast("long"), "hit": F.lit(0).cast("long")}))
    # Before the threshold an event can't cross, so it needs no range.
    rows = counted.join(sizes, "query", "left").withColumn("words", F.when(F.col("hit") >= threshold, F.coalesce("words", F.lit(0))).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).repartition("project").sortWithinPartitions("project", "us", "event_id")
    rows = rows.select("project", "event_id", "us", "query", F.coalesce("window_us", F.lit(-1)).alias("window_us"), "words", "kind")

    def run(frames):
        project, cache, flagged, seq = None, None, {}, 0
        for f in frames:
            out = []
            for p, e, us, q, window, words, kind in zip(f["project"], f["event_id"], f["us"], f["query"], f["window_us"], f["words"], f["kind"]):
                if cache is None or p != project:
                    project, cache, flagged, seq = p, LruBudget(cap), {}, 0
                found = cache.lookup(q) if q and kind != "evict" else None
                inserted, gone = None, []
                if kind == "evict" and cache.evict(q):
                    gone = [q]
                    del flagged[q]
                if words and flagged.get(q) != window:
                    inserted, flagged[q] = q, window
                    gone = cache.insert(q, int(words))
                    for g in gone:
                        del flagged[g]
                seq += 1
                out.append((p, seq, e, us, q, kind, found, inserted, int(words) if inserted else None, gone, cache.words, cache.entries[found][1] if found in cache.entries else 0))
            t = pd.DataFrame(out, columns=["project", "seq", "event_id", "ts", "query", "kind", "hot_prefix", "inserted", "inserted_words", "evicted", "resident_words", "hits"])
            t["ts"] = pd.to_datetime(t["ts"], unit="us", utc=True)
            t["inserted_words"] = t["inserted_words"].astype("Int64")
            yield t

    return rows.mapInPandas(run, REPLAY)


def resident_entries(replayed: DataFrame) -> DataFrame:
    """What is resident at the end of a replay, one row an entry: project, prefix, words,
    hits since it was loaded, loaded_at, and rank (1 for the most recently used).

    An entry is resident if its last insertion comes behind its last eviction.  Counting
    starts anew with an insertion, which comes behind the lookup of its own event."""
    ins = replayed.where("inserted is not null").groupBy("project", F.col("inserted").alias("prefix")).agg(F.max(F.struct("seq", "inserted_words", "ts")).alias("at"))
    out = replayed.select("project", "seq", F.explode("evicted").alias("prefix")).groupBy("project", "prefix").agg(F.max("seq").alias("out"))
    live = ins.join(out, ["project", "prefix"], "left").where("out is null or out < at.seq").select("project", "prefix", "at")
    used = replayed.where("hot_prefix is not null").select("project", F.col("hot_prefix").alias("prefix"), "seq")
    used = used.join(live, ["project", "prefix"]).where("seq > at.seq").groupBy("project", "prefix").agg(F.count("*").alias("hits"), F.max("seq").alias("used"))
    rows = live.join(used, ["project", "prefix"], "left").select(
        "project", "prefix", F.col("at.inserted_words").alias("words"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.col("at.ts").alias("loaded_at"), F.coalesce(F.col("used") * 2, F.col("at.seq") * 2 + 1).alias("_used")
    )
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("_used")))).drop("_used")


def replay_stats(replayed: DataFrame) -> DataFrame:
    """One row a project: lookups, hits, misses, hit_rate, inserted, evicted."""
    out = replayed.groupBy("project").agg(
        F.count_if(F.col("kind") != "evict").alias("lookups"), F.count("hot_prefix").alias("hits"), F.count("inserted").alias("inserted"), F.sum(F.size("evicted")).cast("long").alias("evicted")
    )
    return out.withColumn("misses", F.col("lookups") - F.col("hits")).withColumn("hit_rate", F.col("hits") / F.col("lookups"))


def recency_listing(entries: DataFrame, alphabetical: bool = False) -> DataFrame:
    """entries (prefix, words, hits, last_used) with rank 1 for the most recent; listed by
    recency or by name."""
    ranked = entries.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("last_used"), "prefix")))
    return ranked.orderBy("prefix" if alphabetical else "rank")
