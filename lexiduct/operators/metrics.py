"""Service analytics over a request log (ts, method, route, status, ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING = 4096
QUIET_ROUTES = ("/metrics", "/metrics/json", "/health")


def observed(log: DataFrame, quiet: tuple[str, ...] = QUIET_ROUTES) -> DataFrame:
    """The requests that count; those without a route fold into <not found>."""
    route = F.when(F.col("route").isNull() | (F.col("route") == ""), F.lit("<not found>")).otherwise(F.col("route"))
    return log.withColumn("route", route).where(~F.col("route").isin(*quiet)) if quiet else log.withColumn("route", route)


def route_stats(log: DataFrame, by: tuple[str, ...] = ("route",)) -> DataFrame:
    """count, errors (status from 400), sum_ms, min_ms, max_ms, avg_ms by route."""
    return log.groupBy(*by).agg(
        F.count("*").alias("count"), F.count_if(F.col("status") >= 400).alias("errors"), F.sum("ms").alias("sum_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.avg("ms").alias("avg_ms")
    )


def status_histogram(log: DataFrame, by: tuple[str, ...] = ("route",)) -> DataFrame:
    return log.groupBy(*by, "status").agg(F.count("*").alias("count"))


def nearest_rank(ordered: Column, percent: float, even: bool = False) -> Column:
    """The element at round(percent / 100 * (n - 1)) of an ascending array: halves away from
    zero, or to the even neighbour."""
    place = F.lit(percent / 100.0) * (F.size(ordered) - 1)
    at = (F.bround(place) if even else F.round(place)).cast("int")
    return F.when(F.size(ordered) > 0, F.get(ordered, at))


def route_percentiles(log: DataFrame, percents=(50, 95, 99), ring: int = RING, by: tuple[str, ...] = ("route",), order=("ts",)) -> DataFrame:
    """p50, p95, p99 of the last `ring` requests of each route.  The window keeps `ring` a
    route before its shuffle, so a list is at most that long."""
    last = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    kept = log.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= ring)
    lists = kept.groupBy(*by).agg(F.sort_array(F.collect_list("ms")).alias("_ms"))
    return lists.select(*by, *[nearest_rank(F.col("_ms"), p).alias(f"p{p}") for p in percents])


def latency_report(samples: DataFrame, percents=(50, 90, 95, 99)) -> DataFrame:
    """n, mean_ms, per_second and percentiles (rounded to even) of a load test's samples (ms):
    sequential requests, as many as the test made."""
    one = samples.agg(F.sort_array(F.collect_list("ms")).alias("_ms"), F.count("*").alias("n"), F.avg("ms").alias("mean_ms"), F.sum("ms").alias("_sum"))
    return one.select("n", "mean_ms", (F.col("n") * 1000 / F.col("_sum")).alias("per_second"), *[nearest_rank(F.col("_ms"), p, even=True).alias(f"p{p}") for p in percents])


def live_stats(corpus: DataFrame, entries: DataFrame, stats: DataFrame, cap: int) -> DataFrame:
    """One row: corpus, hot and cold words (never below 0), entries, cap, hits, misses,
    hit_rate.  entries: prefix, words; stats: hits, misses, hit_rate."""
    c = corpus.agg(F.count("*").alias("corpus_words"))
    e = entries.agg(F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("hot_words"), F.count("*").alias("hot_entries"))
    out = c.join(e, F.lit(True)).join(stats, F.lit(True))
    return out.withColumn("cold_words", F.greatest(F.lit(0), F.col("corpus_words") - F.col("hot_words"))).withColumn("word_cap", F.lit(cap).cast("long"))


def snapshot_json(stats: DataFrame) -> DataFrame:
    """One JSON text a row of stats."""
    return stats.select(F.to_json(F.struct(*stats.columns)).alias("json"))


# The families of the text exposition and their kinds.
COUNT_FAMILIES = (
    ("http_requests_total", "counter", "Requests by route.", "count"),
    ("http_request_errors_total", "counter", "Responses with a status from 400.", "errors"),
)
QUANTILES = (("0.5", "p50"), ("0.95", "p95"), ("0.99", "p99"))
CORPUS_FAMILIES = (
    ("corpus_words", "gauge", "Words of the live corpus.", "corpus_words"),
    ("hot_words", "gauge", "Words resident in the hot set.", "hot_words"),
    ("cold_words", "gauge", "Words served from disk.", "cold_words"),
    ("hot_entries", "gauge", "Prefixes resident in the hot set.", "hot_entries"),
    ("hot_word_cap", "gauge", "Budget of the hot set in words.", "word_cap"),
    ("hot_hits_total", "counter", "Lookups answered by the hot set.", "hits"),
    ("hot_misses_total", "counter", "Lookups not answered by the hot set.", "misses"),
    ("hot_hit_rate", "gauge", "Hits by lookups.", "hit_rate"),
)


def prometheus(stats: DataFrame, live: DataFrame | None = None, prefix: str = "lexiduct", statuses: DataFrame | None = None, uptime_s: int | None = None) -> str:
    """The text exposition (version 0.0.4): route statistics with percentiles and the
    responses by status (statuses: as status_histogram gives them), sorted by method and
    route, one row of live statistics, and the uptime.  A method is a label where the
    tables have one.  One row a route, or a route's status, comes to the driver."""
    out: list[str] = []
    quoted = lambda s: '"' + str(s).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    place = lambda r: (r.get("method") or "", r["route"])

    def family(name: str, kind: str, text: str) -> str:
        out.extend((f"# HELP {prefix}_{name} {text}", f"# TYPE {prefix}_{name} {kind}"))
        return f"{prefix}_{name}"

    def sample(name: str, r: dict, value, **more) -> None:
        labels = {k: r[k] for k in ("method", "route") if k in r} | more
        text = f"{value:.6g}" if isinstance(value, float) else value
        out.append(f"{name}{{{','.join(f'{k}={quoted(v)}' for k, v in labels.items())}}} {text}")

    rows = sorted((r.asDict() for r in stats.collect()), key=place)
    for name, kind, text, col in COUNT_FAMILIES:
        full = family(name, kind, text)
        for r in rows:
            sample(full, r, r[col])
    if statuses is not None:
        full = family("http_responses_total", "counter", "Responses by status.")
        for r in sorted((r.asDict() for r in statuses.collect()), key=lambda r: (*place(r), r["status"])):
            sample(full, r, r["count"], status=r["status"])
    full = family("http_request_duration_ms", "summary", "Latency of requests in milliseconds.")
    for r in rows:
        for q, col in QUANTILES:
            if r.get(col) is not None:
                sample(full, r, round(r[col], 3), quantile=q)
        sample(f"{full}_sum", r, round(r["sum_ms"], 3))
        sample(f"{full}_count", r, r["count"])
    full = family("http_request_duration_ms_max", "gauge", "Longest request in milliseconds.")
    for r in rows:
        sample(full, r, round(r["max_ms"], 3))
    if uptime_s is not None:
        out.append(f"{family('uptime_seconds', 'gauge', 'Seconds since the start.')} {int(uptime_s)}")
    for r in live.collect() if live is not None else ():
        for name, kind, text, col in CORPUS_FAMILIES:
            out.append(f"{family(name, kind, text)} {r[col]}")
    return "\n".join(out) + "\n"


def overview(live: DataFrame, ledger: DataFrame, usage: DataFrame) -> DataFrame:
    """One row of a project's state, from three one-row tables."""
    return live.join(ledger, F.lit(True)).join(usage, F.lit(True))
