"""The engine: one project's corpus, hot set and usage behind suggest()."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiduct.config import Settings
from lexiduct.functions import text as T
from lexiduct.operators import demand, hotset, match, metrics, promote, usage
from lexiduct.sources import readers
from lexiduct.sources.store import ApplyResult, Store


def suggest_batch(queries: DataFrame, corpus: DataFrame, hot: DataFrame, settings: Settings | None = None, limit: int | None = None, fuzzy: bool = False) -> DataFrame:
    """query, rank, word, source for each distinct query (query string).

    Queries are normalised; those below the least length in bytes get no rows.  A query
    with a resident prefix (hot: prefix, word) is answered from that prefix's words and
    labelled hot, tolerant of typos if fuzzy; all others from the corpus by prefix, cold."""
    s = settings or Settings()
    k = T.clamp_limit(limit, s.default_limit, s.max_limit)
    q = queries.select(T.normalise("query").alias("query")).where(match.min_length_ok(F.col("query"), s.min_query_len)).distinct()
    found = hotset.longest_prefix_match(q, hot)
    warm = found.where("hot_prefix is not null")
    pairs = warm.join(hot.withColumnRenamed("prefix", "hot_prefix"), "hot_prefix").select("query", "word")
    scored = match.fuzzy_scores(pairs, True, True) if fuzzy else pairs.where(F.col("word").startswith(F.col("query"))).withColumn("dist", F.lit(0)).withColumn("infix", F.lit(False))
    top = match.rank_fuzzy(scored, k).select("query", "rank", "word", F.lit("hot").alias("source"))
    cold = match.prefix_join_topk(found.where("hot_prefix is null"), corpus, k).select("query", "rank", "word", F.lit("cold").alias("source"))
    return top.unionByName(cold)


class Engine:
    """One project behind suggest(): the live corpus, the hot set under its word budget, the
    ledger that promotes into it, and usage.

    Single queries (`suggest`) count in the driver, as a service would: a counter a prefix,
    swept when idle, and promotion as soon as one crosses.  Batches (`suggest_batch`,
    `record_usage`) are DataFrames and count in Spark."""

    def __init__(self, spark: SparkSession, root: str, project: str = "default", settings: Settings | None = None):
        self.spark, self.settings = spark, settings or Settings()
        self.store = Store(spark, root, project)
        self.store.ensure()
        self.started = time.time()
        self._empty()

    def _empty(self) -> None:
        if getattr(self, "hot", None) is not None:
            self.hot.unpersist()
        self.hot = self.spark.createDataFrame([], "prefix string, word string")
        self.entries = hotset.LruBudget(self.settings.word_cap)
        self.counters: dict[str, demand.AnchoredCounter] = {}
        self.asked: list[str] = []
        self.answered: list[tuple[str, str]] = []

    def reload(self) -> str:
        """Reads the live version anew.  What was resident came from the version before, so
        the hot set and its counters start empty; usage asked so far is written first."""
        self.flush_usage()
        self.spark.catalog.refreshByPath(self.store.home)
        self._empty()
        return self.store.current()

    def upload(self, csv: str, column: str, mode: str = "merge") -> ApplyResult:
        """A CSV column into the live corpus in one call: stage, apply, retain, reload.  Usage
        asked so far is written before, so that it moves along."""
        self.flush_usage()
        out = self.store.ingest_csv(csv, column, mode, self.settings.versions_kept)
        self.reload()
        return out

    def restore(self, archive: str) -> str:
        """Replaces the project by a backup and serves that."""
        self.store.restore(archive)
        return self.reload()

    # -- the hot set -----------------------------------------------------------------------

    def _load(self, prefixes: list[str]) -> int:
        """Makes prefixes resident that have words; evicted ones and those without lose their flag."""
        p = self.spark.createDataFrame([(x,) for x in prefixes], "prefix string").distinct()
        sizes = {r.prefix: r.words for r in promote.prefix_sizes(p, self.store.words(), self.settings.promotion_max_words).where("words > 0").collect()}
        for x in dict.fromkeys(prefixes):
            if x in sizes:
                for gone in self.entries.insert(x, sizes[x]):
                    self._clear(gone)
            else:
                self._clear(x)
        old = self.hot
        resident = self.spark.createDataFrame([(x,) for x, _, _ in self.entries.newest_first()], "prefix string")
        self.hot = promote.build(resident, self.store.words(), self.settings.promotion_max_words).select("prefix", "word").cache()
        old.unpersist()
        return len(sizes)

    def _clear(self, prefix: str) -> None:
        if prefix in self.counters:
            self.counters[prefix].promoted = False

    def warm(self, prefixes: list[str], deadline_s: float | None = None) -> int:
        """Makes the words of prefixes resident and marks them as promoted; returns how many
        prefixes have any.  With a deadline they are loaded a few at a time, in their order,
        until it has passed; a load that has begun is finished."""
        p = self.spark.createDataFrame(list(enumerate(prefixes)), "i int, prefix string").orderBy("i")
        clean = [r.p for r in p.select(T.normalise("prefix").alias("p")).collect() if r.p]
        step = len(clean) if deadline_s is None else 16
        end, n = time.monotonic() + (deadline_s or 0), 0
        for at in range(0, len(clean), max(1, step)):
            if deadline_s is not None and time.monotonic() >= end:
                break
            n += self._load(clean[at : at + step])
        for x, _, _ in self.entries.newest_first():
            if x in clean:
                self._counter(x).promoted = True
        return n

    def warm_pinned(self, path: str, deadline_s: float | None = None) -> int:
        """warm() with the pinned prefixes of a text file."""
        return self.warm([r.prefix for r in readers.read_pinned(self.spark, path).orderBy("prefix").collect()], deadline_s)

    def _counter(self, prefix: str) -> demand.AnchoredCounter:
        if prefix not in self.counters:
            c = self.counters[prefix] = demand.AnchoredCounter(self.settings.promotion_threshold, self.settings.promotion_window_s * 1_000_000)
            c.start = c.last = time.time_ns() // 1000
        return self.counters[prefix]

    def sweep(self) -> int:
        """Drops counters that are idle; returns how many."""
        least = time.time_ns() // 1000 - self.settings.ledger_idle_ttl_s * 1_000_000
        idle = [k for k, c in self.counters.items() if c.last < least]
        for k in idle:
            del self.counters[k]
        return len(idle)

    def ledger_state(self) -> DataFrame:
        """The counters as a ledger's state, for `demand.write_snapshot`."""
        rows = [(k, c.hits, c.start, c.last, c.promoted) for k, c in self.counters.items()]
        out = self.spark.createDataFrame(rows, "prefix string, hits long, w long, l long, promoted boolean")
        return out.select("prefix", "hits", F.timestamp_micros("w").alias("window_start"), F.timestamp_micros("l").alias("last_seen"), "promoted")

    def restart_warm(self, state: DataFrame) -> int:
        """Takes over a ledger's state and loads its promoted prefixes; returns how many have words."""
        for r in state.select("prefix", "hits", F.unix_micros("window_start").alias("w"), F.unix_micros("last_seen").alias("l"), "promoted").collect():
            c = self._counter(r.prefix)
            c.hits, c.start, c.last, c.promoted = r.hits, r.w, r.l, r.promoted
        hot = sorted(k for k, c in self.counters.items() if c.promoted)
        return self._load(hot) if hot else 0

    # -- suggestions -----------------------------------------------------------------------

    def suggest(self, query: str, limit: int | None = None, fuzzy: bool = False) -> list[dict]:
        """[{word, source}] for one query; too short a query raises ValueError and counts
        nowhere.  The query is counted by the ledger, promoted if it crosses, and its
        answer goes to usage."""
        norm = self.spark.range(1).select(T.normalise(F.lit(query)).alias("q")).first().q
        if len(norm.encode()) < self.settings.min_query_len:
            raise ValueError(f"query must be at least {self.settings.min_query_len} characters")
        k = T.clamp_limit(limit, self.settings.default_limit, self.settings.max_limit)
        crossed = self._counter(norm).record(time.time_ns() // 1000)
        if self.entries.lookup(norm) is None:
            found = [{"word": r.word, "source": "cold"} for r in match.prefix_search(self.store.words(), norm, k).collect()]
        else:
            one = self.spark.createDataFrame([(norm,)], "query string")
            rows = suggest_batch(one, self.store.words(), self.hot, self.settings, k, fuzzy).orderBy("rank").collect()
            found = [{"word": r.word, "source": r.source} for r in rows]
        if crossed:
            self._load([norm])
        if self.settings.usage_enabled:
            self.asked.append(norm)
            self.answered += [(norm, x["word"]) for x in found]
        return found

    def suggest_response(self, query: str, limit: int | None = None, fuzzy: bool = False) -> dict:
        found = self.suggest(query, limit, fuzzy)
        return {"query": query, "suggestions": found, "count": len(found)}

    def suggest_batch(self, queries: DataFrame, limit: int | None = None, fuzzy: bool = False) -> DataFrame:
        return suggest_batch(queries, self.store.words(), self.hot, self.settings, limit, fuzzy)

    def record_usage(self, requests: DataFrame, suggestions: DataFrame) -> None:
        """Adds requests (query; each row counts, answered or not, unless it is too short) and
        what came back (suggestions: query, word) to the live version's usage tables."""
        asked = requests.select(T.normalise("query").alias("query")).where(match.min_length_ok(F.col("query"), self.settings.min_query_len))
        hits = usage.bucket_hits(asked, self.settings.usage_depth)
        seen = suggestions.select("word").distinct()
        if not self.settings.usage_track_surfaced:
            seen = seen.where(F.lit(False))
        if self.store.usage_hits() is not None:
            hits = usage.merge_counts(self.store.usage_hits(), hits)
            seen = self.store.surfaced().unionByName(seen).distinct()
        self.store.write_usage(hits, seen)

    def flush_usage(self) -> int:
        """Writes what suggest() has counted since the last time; returns the requests."""
        asked, answered = self.asked, self.answered
        self.asked, self.answered = [], []
        if asked:
            self.record_usage(self.spark.createDataFrame([(x,) for x in asked], "query string"), self.spark.createDataFrame(answered, "query string, word string"))
        return len(asked)

    # -- state -----------------------------------------------------------------------------

    def uptime_s(self) -> int:
        return int(time.time() - self.started)

    def health(self) -> dict:
        return {"status": "ok", "engine": "spark", "corpus_words": self.store.word_count(), "version": self.store.current(), "uptime_s": self.uptime_s()}

    def health_json(self) -> str:
        return json.dumps(self.health())

    def live_stats(self) -> DataFrame:
        """One row: corpus, hot and cold words, entries, hits, misses, hit_rate, budget."""
        e = self.entries
        entries = self.spark.createDataFrame([(p, n) for p, n, _ in e.newest_first()], "prefix string, words long")
        rate = e.hits / (e.hits + e.misses) if e.hits + e.misses else 0.0
        stats = self.spark.createDataFrame([(e.hits, e.misses, rate)], "hits long, misses long, hit_rate double")
        return metrics.live_stats(self.store.words(), entries, stats, self.settings.word_cap)

    def overview(self) -> DataFrame:
        """One row of the project's state: live statistics, ledger and usage."""
        ledger = self.spark.createDataFrame([(sum(c.hits for c in self.counters.values()), sum(c.promoted for c in self.counters.values()), len(self.counters))], "window_hits long, promoted long, keys long")
        hits = self.store.usage_hits()
        tracked = hits.agg(F.count("*").alias("tracked_prefixes")) if hits is not None else self.spark.createDataFrame([(0,)], "tracked_prefixes long")
        return metrics.overview(self.live_stats(), ledger, tracked)

    def metrics_text(self, log: DataFrame) -> str:
        """The text exposition of a request log (method, route, status, ms, ts) and of the
        engine's own state."""
        o, by = metrics.observed(log), ("method", "route")
        stats = metrics.route_stats(o, by).join(metrics.route_percentiles(o, by=by), list(by))
        return metrics.prometheus(stats, self.live_stats(), statuses=metrics.status_histogram(o, by), uptime_s=self.uptime_s())

    def metrics_json(self, log: DataFrame) -> str:
        """The same as JSON: uptime_s and a list of routes."""
        o, by = metrics.observed(log), ("method", "route")
        stats = metrics.route_stats(o, by).join(metrics.route_percentiles(o, by=by), list(by)).orderBy(*by)
        return json.dumps({"uptime_s": self.uptime_s(), "routes": [json.loads(r.json) for r in metrics.snapshot_json(stats).collect()]})
