"""Queries of the base library, by name, each with its DuckDB equivalent.

Every query runs over its whole tables.  Limits appear only where they are the
feature: top-k suggestions, listings, retention.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiduct import engine
from lexiduct.functions import text as T
from lexiduct.operators import corpus as C
from lexiduct.operators import demand, hotset, match, metrics, promote, setops, usage
from lexiduct.plans import inputs as I
from lexiduct.plans.session import ready
from lexiduct.streaming import flows

STRIDE = 64
FUZZY_QUERIES = ("lage ring", "smal", "ring", "stel", "blu*", "ket", "ab", "***", "polishd", "old", "hcocolate", "gren")
_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__
        _Q[name] = lambda spark, sf_dir: f(ready(spark), sf_dir)
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def _long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


# ---- text and corpus ----------------------------------------------------------------------


@query(f"SELECT DISTINCT value, {I.sql_norm('value')} AS word FROM ({I.TOK})")
def normalise_tokens(spark, d):
    return I.values(spark, d).distinct().select("value", T.normalise("value").alias("word"))


@query(f"SELECT word, {I.sql_accept('word')} AS ok FROM (SELECT DISTINCT {I.sql_norm('value')} AS word FROM ({I.TOK}))")
def accept_filter(spark, d):
    return I.values(spark, d).select(T.normalise("value").alias("word")).distinct().select("word", T.accept("word").alias("ok"))


_FLAGS = {"empty": "word = ''", "no_letter": "word <> '' AND NOT regexp_matches(word, '\\pL')", **{k: f"regexp_matches(word, '{v}')" for k, v in I.SQL_JUNK.items()}}


@query(" UNION ALL ".join(f"SELECT '{k}' AS reason, count(*) FILTER (WHERE {c})::BIGINT AS n_words FROM (SELECT DISTINCT {I.sql_norm('value')} AS word FROM ({I.TOK}))" for k, c in _FLAGS.items()))
def reject_reasons(spark, d):
    return C.reject_reasons(I.values(spark, d))


@query(I.WORDS)
def corpus_build(spark, d):
    return I.words(spark, d)


@query(
    f"SELECT count(*)::BIGINT AS source_count, count(*) FILTER (WHERE NOT ok)::BIGINT AS rejected, count(DISTINCT word) FILTER (WHERE ok)::BIGINT AS unique_count FROM (SELECT word, {I.sql_accept('word')} AS ok FROM (SELECT {I.sql_norm('value')} AS word FROM ({I.TOK})))"
)
def ingest_counts(spark, d):
    return C.ingest_counts(I.values(spark, d))


_POS = f"SELECT word, row_number() OVER (ORDER BY word) - 1 AS line, (sum(strlen(word) + 1) OVER (ORDER BY word ROWS UNBOUNDED PRECEDING) - strlen(word) - 1)::BIGINT AS off FROM ({I.WORDS})"
_ANCHORS = f'SELECT word, off AS "offset" FROM ({_POS}) WHERE line % {STRIDE} = 0'


@query(_ANCHORS)
def skip_index(spark, d):
    return C.skip_index(I.words(spark, d), STRIDE)


@query(f"""WITH a AS ({_ANCHORS}), q AS (SELECT DISTINCT query FROM ({I.QLOG}))
SELECT query, max(word) AS anchor, coalesce(max(a."offset"), 0)::BIGINT AS "offset" FROM q LEFT JOIN a ON word <= query GROUP BY query""")
def index_seek(spark, d):
    return C.index_seek(I.qlog(spark, d), C.skip_index(I.words(spark, d), STRIDE))


@query(f'SELECT word, line::BIGINT AS line, off AS "offset" FROM ({_POS})')
def corpus_positions(spark, d):
    return C.positions(I.words(spark, d))


# ---- search -------------------------------------------------------------------------------


@query(f"SELECT word FROM ({I.WORDS}) WHERE starts_with(word, 'the') ORDER BY word LIMIT 10")
def prefix_scan(spark, d):
    return match.prefix_search(I.words(spark, d), "the", 10)


@query(f"SELECT word FROM ({I.WORDS}) WHERE starts_with(word, 'the')")
def prefix_scan_all(spark, d):
    return match.prefix_search(I.words(spark, d), "the", None)


def _topk(corpus: str, k: int) -> str:
    return f"SELECT query, row_number() OVER (PARTITION BY query ORDER BY word)::BIGINT AS rank, word FROM (SELECT DISTINCT query FROM ({I.QLOG})) JOIN ({corpus}) ON starts_with(word, query) QUALIFY rank <= {k}"


@query(_topk(I.WORDS, 10))
def prefix_join_topk(spark, d):
    return _long(match.prefix_join_topk(I.qlog(spark, d), I.words(spark, d), 10), "rank")


_LPM = "SELECT query, max_by(prefix, length(prefix)) AS hot_prefix FROM q LEFT JOIN h ON starts_with(query, prefix) GROUP BY query"


@query(f"WITH RECURSIVE {I.LEDGER}, h AS ({I.HOT}), q AS (SELECT DISTINCT query FROM ({I.QLOG})) {_LPM}")
def longest_prefix_match(spark, d):
    return hotset.longest_prefix_match(I.qlog(spark, d).select("query").distinct(), I.hot_prefixes(spark, d))


@query(f"""WITH RECURSIVE {I.LEDGER}, h AS ({I.HOT}), q AS (SELECT DISTINCT {I.sql_norm('query')} AS query FROM ({I.QLOG})), m AS ({_LPM}), p AS ({I.PARTS})
SELECT query, row_number() OVER (PARTITION BY query ORDER BY word)::BIGINT AS rank, word, CASE WHEN hot_prefix IS NULL THEN 'cold' ELSE 'hot' END AS source
FROM m JOIN p ON starts_with(word, query) WHERE strlen(query) >= 2 QUALIFY rank <= 10""")
def suggest_hot_cold(spark, d):
    """Hot queries are answered from their resident prefix, cold ones from the corpus."""
    p = I.parts(spark, d)
    hot = promote.build(I.hot_prefixes(spark, d), p).select("prefix", "word")
    return _long(engine.suggest_batch(I.qlog(spark, d), p, hot), "rank")


@query(f"SELECT DISTINCT query, CASE WHEN length(query) >= 5 THEN 2 WHEN length(query) >= 3 THEN 1 ELSE 0 END AS edits FROM ({I.QLOG})")
def edit_budget(spark, d):
    return I.qlog(spark, d).select("query").distinct().select("query", T.edit_budget(F.col("query")).alias("edits"))


@query(f"SELECT DISTINCT query, CASE WHEN length(query) >= 6 THEN 3 WHEN length(query) >= 4 THEN 2 ELSE 1 END AS edits, strlen(query) >= 3 AS long_enough FROM ({I.QLOG})")
def edit_scheme(spark, d):
    """A scheme of one's own, and the least length in bytes."""
    q = I.qlog(spark, d).select("query").distinct()
    return q.select("query", T.edit_budget(F.col("query"), {0: 1, 4: 2, 6: 3}).alias("edits"), match.min_length_ok(F.col("query"), 3).alias("long_enough"))


def _best(q: str, w: str, k: str, free: bool) -> str:
    starts = f"range(1, length({w}) + 1)" if free else "[1]"
    return f"list_min(list_transform({starts}, lambda s: list_min(list_transform(range(greatest(0, length({q}) - {k}), length({q}) + {k} + 1), lambda n: levenshtein({q}, substr({w}, s, n))))))"


def _fuzzy_sql(fuzzy: bool, lev: bool, limit: int) -> str:
    """The closed form over all pairs; parts' names are ASCII, as DuckDB's distance needs."""
    values = ", ".join(f"('{q}')" for q in FUZZY_QUERIES)
    k = "CASE WHEN length(query) >= 5 THEN 2 WHEN length(query) >= 3 THEN 1 ELSE 0 END" if lev else "0"
    dropped = f"len(list_filter(range(1, length(q) + 1), lambda i: {_best('(left(q, (i - 1)::INT) || substr(q, i + 1))', 'word', 'k', True)} <= dist - 1)) > 0"
    infix = f"CASE WHEN q = '' THEN false ELSE NOT ({_best('q', 'word', 'k', False)} = dist OR (dist > 0 AND {dropped})) END" if fuzzy else "false"
    return f"""WITH p AS (SELECT query, replace(query, '*', '') AS q, {k} AS k, word FROM (VALUES {values}) v(query), ({I.PARTS})),
s AS (SELECT *, CASE WHEN q = '' THEN 0 ELSE {_best('q', 'word', 'k', fuzzy)} END AS dist FROM p),
f AS (SELECT query, word, dist::BIGINT AS dist, {infix} AS infix FROM s WHERE dist <= k)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY dist, infix, word)::BIGINT AS rank, word, dist, infix FROM f QUALIFY rank <= {limit}"""


def _fuzzy(spark, d, **options):
    q = spark.createDataFrame([(x,) for x in FUZZY_QUERIES], "query string")
    return _long(match.fuzzy_search(q, I.parts(spark, d), 20, **options), "rank", "dist")


@query()
def fuzzy_words(spark, d):
    """The whole word corpus; DuckDB's distance counts bytes, so there is no SQL for it."""
    q = spark.createDataFrame([(x,) for x in FUZZY_QUERIES], "query string")
    return _long(match.fuzzy_search(q, I.words(spark, d), 20), "rank", "dist")


@query(_fuzzy_sql(False, True, 20))
def fuzzy_search_parts(spark, d):
    return _fuzzy(spark, d, fuzzy=False)


@query(_fuzzy_sql(True, True, 20))
def fuzzy_infix(spark, d):
    return _fuzzy(spark, d)


@query(_fuzzy_sql(True, False, 20))
def fuzzy_nolev(spark, d):
    return _fuzzy(spark, d, levenshtein=False)


@query(f"""WITH hits AS ({_fuzzy_sql(True, True, 5)}), o AS (SELECT DISTINCT p_name AS original, {I.sql_norm('p_name')} AS word FROM part)
SELECT query, rank, h.word, original FROM hits h JOIN o ON o.word = h.word""")
def fuzzy_originals(spark, d):
    q = spark.createDataFrame([(x,) for x in FUZZY_QUERIES], "query string")
    out = match.search_originals(q, I.table(spark, d, "part").select(F.col("p_name").alias("original")), 5)
    return _long(out.select("query", "rank", "word", F.explode("originals").alias("original")), "rank")


# ---- usage --------------------------------------------------------------------------------

_BUCKETS = f"SELECT left(query, 3) AS prefix, count(*)::BIGINT AS hits FROM ({I.QLOG}) GROUP BY 1"


@query(_BUCKETS)
def usage_bucket_hits(spark, d):
    return usage.bucket_hits(I.qlog(spark, d), 3)


@query(f"SELECT * FROM ({_BUCKETS}) ORDER BY hits DESC, prefix LIMIT 10")
def usage_hot_topn(spark, d):
    return usage.hot(usage.bucket_hits(I.qlog(spark, d), 3), 10)


@query(f"SELECT * FROM ({_BUCKETS}) WHERE hits <= (SELECT count(*) // 20 FROM events)")
def usage_cold(spark, d):
    return usage.cold(usage.bucket_hits(I.qlog(spark, d), 3), I.table(spark, d, "events").count() // 20)


@query(f"WITH a AS ({I.ANSWERS}) SELECT count(DISTINCT left(query, 3))::BIGINT AS tracked_prefixes, (SELECT count(DISTINCT w) FROM (SELECT unnest(words) AS w FROM a))::BIGINT AS surfaced_words, count(*)::BIGINT AS total_records FROM a")
def usage_stats(spark, d):
    return usage.stats(I.answers(spark, d), 3)


@query(f"SELECT DISTINCT unnest(words) AS word FROM ({I.ANSWERS})")
def surfaced_words(spark, d):
    return usage.surfaced(I.answers(spark, d))


@query(f"SELECT word FROM ({I.STAGED}) WHERE word NOT IN (SELECT unnest(words) FROM ({I.ANSWERS}))")
def unsurfaced_words(spark, d):
    return usage.unsurfaced(I.staged(spark, d), usage.surfaced(I.answers(spark, d)))


@query(f"SELECT DISTINCT w AS word FROM (SELECT unnest(words) AS w FROM ({I.ANSWERS})) WHERE w IN (SELECT word FROM ({I.STAGED}))")
def usage_migrate(spark, d):
    return usage.migrate(usage.surfaced(I.answers(spark, d)), I.staged(spark, d))


@query(f"SELECT prefix, sum(hits)::BIGINT AS hits FROM ({_BUCKETS} UNION ALL SELECT left(query, 3), count(*) FROM ({I.ANSWERS}) GROUP BY 1) GROUP BY prefix")
def usage_merge(spark, d):
    return usage.merge_counts(usage.bucket_hits(I.qlog(spark, d), 3), usage.bucket_hits(I.answers(spark, d), 3))


@query(f"""SELECT '{{' || string_agg('"' || prefix || '":' || hits, ',' ORDER BY prefix) || '}}' AS snapshot FROM ({_BUCKETS})""")
def usage_snapshot(spark, d):
    return usage.as_map(usage.bucket_hits(I.qlog(spark, d), 3)).select(F.to_json("prefix_hits").alias("snapshot"))


@query(f"SELECT us // 86400000000 * 86400000000 AS start_us, left(query, 3) AS prefix, count(*)::BIGINT AS hits FROM ({I.QLOG}) GROUP BY 1, 2")
def usage_by_day(spark, d):
    return flows.windowed_usage(I.qlog(spark, d)).select(F.unix_micros("start").alias("start_us"), "prefix", "hits")


@query(f"SELECT word, word IN (SELECT unnest(words) FROM ({I.ANSWERS})) AS surfaced FROM ({I.STAGED})")
def surfaced_lookup(spark, d):
    return usage.is_surfaced(I.staged(spark, d), usage.surfaced(I.answers(spark, d)))


# ---- demand -------------------------------------------------------------------------------


def _windows(spark, d):
    return demand.ledger_windows(I.qlog(spark, d), I.THRESHOLD, I.WINDOW_S)


@query(f"WITH RECURSIVE {I.LEDGER} SELECT prefix, window_us, hits, last_us, crossed_id, crossed_us FROM windows")
def ledger_windows(spark, d):
    w = _windows(spark, d)
    return w.select("prefix", F.unix_micros("window_start").alias("window_us"), "hits", F.unix_micros("last_seen").alias("last_us"), "crossed_id", F.unix_micros("crossed_at").alias("crossed_us"))


@query(f"WITH RECURSIVE {I.LEDGER} SELECT prefix, crossed_id AS event_id, crossed_us AS us FROM windows WHERE crossed_id IS NOT NULL")
def ledger_crossings(spark, d):
    return demand.crossings(_windows(spark, d)).select("prefix", "event_id", F.unix_micros("ts").alias("us"))


@query(f"WITH RECURSIVE {I.LEDGER} SELECT sum(hits)::BIGINT AS total_records, count(crossed_id)::BIGINT AS total_promotions, count(DISTINCT prefix)::BIGINT AS keys FROM windows")
def ledger_stats(spark, d):
    return demand.ledger_stats(_windows(spark, d))


@query(f"WITH RECURSIVE {I.LEDGER} SELECT prefix, hits, window_us, last_us, promoted FROM state WHERE (SELECT max(us) FROM ({I.QLOG})) - last_us <= 43200000000")
def ledger_sweep(spark, d):
    now = I.qlog(spark, d).agg(F.max("ts")).first()[0]
    kept = demand.sweep(demand.ledger_state(_windows(spark, d)), now, 43_200)
    return kept.select("prefix", "hits", F.unix_micros("window_start").alias("window_us"), F.unix_micros("last_seen").alias("last_us"), "promoted")


@query(f"WITH RECURSIVE {I.LEDGER} SELECT prefix, hits FROM state WHERE NOT promoted ORDER BY hits DESC, prefix LIMIT 100")
def watch_list(spark, d):
    return demand.watch_list(demand.ledger_state(_windows(spark, d)))


@query(f"""WITH RECURSIVE {I.LEDGER}, f AS (SELECT prefix, min((crossed_us, crossed_id)) AS first_at FROM windows WHERE crossed_id IS NOT NULL GROUP BY prefix),
fresh AS (SELECT * FROM f WHERE length(prefix) > 2), t AS (SELECT prefix FROM fresh ORDER BY first_at, prefix LIMIT 20), p AS ({I.PARTS})
SELECT t.prefix, least(count(word), 5)::BIGINT AS words, count(word) > 5 AS truncated FROM t LEFT JOIN p ON starts_with(word, t.prefix) GROUP BY t.prefix""")
def promotion_plan(spark, d):
    """Crossed prefixes beyond two letters (those are resident), the first 20 of them, with
    the words that each brings, 5 at most."""
    c = demand.crossings(_windows(spark, d))
    resident = c.where("length(prefix) <= 2").select("prefix").distinct()
    q = promote.queue(c, resident, 20).where("accepted")
    return promote.prefix_sizes(q, I.parts(spark, d), 5)


def _replayed(spark, d):
    log = I.qlog(spark, d)
    sizes = promote.prefix_sizes(log.select(F.col("query").alias("prefix")), I.parts(spark, d), _MOST)
    return hotset.lru_replay(log, sizes, cap=_CAP, threshold=I.THRESHOLD, window_s=I.WINDOW_S, max_words=_MOST)


@query(f"""WITH RECURSIVE {I.LEDGER}, h AS ({I.HOT}), p AS ({I.PARTS})
SELECT prefix, row_number() OVER (PARTITION BY prefix ORDER BY word)::BIGINT AS rank, word FROM h JOIN p ON starts_with(word, prefix) QUALIFY rank <= 5""")
def promotion_words(spark, d):
    return _long(promote.build(I.hot_prefixes(spark, d), I.parts(spark, d), 5), "rank")


@query(f"WITH RECURSIVE {I.LEDGER}, h AS ({I.HOT}) SELECT DISTINCT query AS prefix, query IN (SELECT prefix FROM h) AS resident FROM ({I.QLOG})")
def resident_lookup(spark, d):
    return hotset.is_resident(I.qlog(spark, d).select(F.col("query").alias("prefix")).distinct(), I.hot_prefixes(spark, d))


_CAP, _MOST = 60, 40
#: The hot set as a list, least recently used first, carried from event to event.
_REPLAY = f"""WITH RECURSIVE {I.LEDGER}, sz AS MATERIALIZED (SELECT query, least(count(word), {_MOST})::BIGINT AS words FROM (SELECT DISTINCT query FROM ({I.QLOG})) JOIN ({I.PARTS}) ON starts_with(word, query) GROUP BY query),
ev AS MATERIALIZED (SELECT row_number() OVER (ORDER BY r.us, r.event_id) AS seq, r.event_id, r.us, r.query, r.ws, CASE WHEN r.hits >= {I.THRESHOLD} THEN coalesce(sz.words, 0) ELSE 0 END AS words FROM r LEFT JOIN sz ON sz.query = r.query),
st AS (
  SELECT 0::BIGINT AS seq, NULL::BIGINT AS event_id, NULL::BIGINT AS us, NULL::VARCHAR AS query, NULL::VARCHAR AS hot_prefix, NULL::VARCHAR AS inserted, []::VARCHAR[] AS evicted, []::STRUCT(p VARCHAR, w BIGINT, f BIGINT, h BIGINT, t BIGINT)[] AS c
  UNION ALL
  SELECT seq, event_id, us, query, hot_prefix, inserted, list_transform(c3[1:gone], lambda x: x.p), c3[gone + 1:]
  FROM (SELECT *, coalesce(list_min(list_filter(range(0, len(c3)), lambda k: k = len(c3) - 1 OR coalesce(list_sum(list_transform(c3[k + 1:], lambda x: x.w)), 0) <= {_CAP})), 0) AS gone
    FROM (SELECT *, CASE WHEN inserted IS NULL THEN c2 ELSE list_append(list_filter(c2, lambda x: x.p <> query), {{'p': query, 'w': words, 'f': ws, 'h': 0::BIGINT, 't': us}}) END AS c3
      FROM (SELECT *, CASE WHEN words > 0 AND len(list_filter(c2, lambda x: x.p = query AND x.f = ws)) = 0 THEN query END AS inserted
        FROM (SELECT *, CASE WHEN hot_prefix IS NULL THEN c ELSE list_concat(list_filter(c, lambda x: x.p <> hot_prefix), list_transform(list_filter(c, lambda x: x.p = hot_prefix), lambda x: {{'p': x.p, 'w': x.w, 'f': x.f, 'h': x.h + 1, 't': x.t}})) END AS c2
          FROM (SELECT ev.*, st.c, list_reverse(list_sort(list_transform(list_filter(st.c, lambda x: starts_with(ev.query, x.p)), lambda x: x.p)))[1] AS hot_prefix FROM st JOIN ev ON ev.seq = st.seq + 1)))))
)"""


@query(f"""{_REPLAY} SELECT 'default' AS project, seq, event_id, query, hot_prefix, inserted, array_to_string(evicted, ',') AS evicted, coalesce(list_sum(list_transform(c, lambda x: x.w)), 0)::BIGINT AS resident_words,
coalesce(list_filter(c, lambda x: x.p = hot_prefix)[1].h, 0)::BIGINT AS hits FROM st WHERE seq > 0""")
def lru_replay(spark, d):
    return _replayed(spark, d).withColumn("evicted", F.array_join("evicted", ",")).drop("ts", "kind", "inserted_words")


@query(f"""{_REPLAY} SELECT 'default' AS project, count(*)::BIGINT AS lookups, count(hot_prefix)::BIGINT AS hits, count(inserted)::BIGINT AS inserted, sum(len(evicted))::BIGINT AS evicted,
(count(*) - count(hot_prefix))::BIGINT AS misses, round(count(hot_prefix) / count(*), 6) AS hit_rate FROM st WHERE seq > 0""")
def cache_stats(spark, d):
    return hotset.replay_stats(_replayed(spark, d)).withColumn("hit_rate", F.round("hit_rate", 6))


@query(f"""{_REPLAY}, l AS (SELECT c FROM st ORDER BY seq DESC LIMIT 1), e AS (SELECT unnest(c) AS x, unnest(range(len(c), 0, -1)) AS rank FROM l)
SELECT 'default' AS project, x.p AS prefix, x.w AS words, x.h AS hits, x.t AS loaded_us, rank::BIGINT AS rank FROM e""")
def cache_entries(spark, d):
    e = hotset.resident_entries(_replayed(spark, d))
    return _long(e.select("project", "prefix", "words", "hits", F.unix_micros("loaded_at").alias("loaded_us"), "rank"), "rank")


_MATCHED = f"WITH RECURSIVE {I.LEDGER}, h AS ({I.HOT}), q AS (SELECT DISTINCT query FROM ({I.QLOG})), m AS ({_LPM}), l AS (SELECT hot_prefix FROM ({I.QLOG}) x JOIN m ON m.query = x.query)"


@query(f"{_MATCHED} SELECT count(hot_prefix)::BIGINT AS hits, (count(*) - count(hot_prefix))::BIGINT AS misses, round(count(hot_prefix) / count(*), 6) AS hit_rate FROM l")
def hot_hit_rate(spark, d):
    return hotset.hit_stats(hotset.longest_prefix_match(I.qlog(spark, d), I.hot_prefixes(spark, d))).withColumn("hit_rate", F.round("hit_rate", 6))


@query(f"{_MATCHED} SELECT hot_prefix AS prefix, count(*)::BIGINT AS hits FROM l WHERE hot_prefix IS NOT NULL GROUP BY 1")
def hot_entry_hits(spark, d):
    return hotset.entry_hits(hotset.longest_prefix_match(I.qlog(spark, d), I.hot_prefixes(spark, d)))


# ---- lifecycle ----------------------------------------------------------------------------


@query(f"SELECT count(*) FILTER (WHERE a.word IS NULL)::BIGINT AS added, count(*) FILTER (WHERE b.word IS NULL)::BIGINT AS dropped, count(*) FILTER (WHERE a.word = b.word)::BIGINT AS retained FROM ({I.PARTS}) a FULL JOIN ({I.STAGED}) b ON a.word = b.word")
def corpus_diff(spark, d):
    return setops.diff(I.parts(spark, d), I.staged(spark, d))


@query(f"({I.PARTS}) UNION ({I.STAGED})")
def corpus_merge(spark, d):
    return setops.merge(I.parts(spark, d), I.staged(spark, d))


@query(I.STAGED)
def corpus_replace(spark, d):
    return I.staged(spark, d)


@query(f"SELECT word FROM ({I.WORDS}) WHERE left(word, 3) IN (SELECT prefix FROM ({_BUCKETS}) WHERE hits > 0)")
def corpus_prune(spark, d):
    return setops.prune(I.words(spark, d), usage.bucket_hits(I.qlog(spark, d), 3), 3, 0)


@query(f"SELECT word FROM ({I.WORDS}) WHERE word NOT IN ({I.BLACKLIST})")
def corpus_blacklist(spark, d):
    return setops.without(I.words(spark, d), I.blacklist(spark, d))


@query(f"SELECT count(*) FILTER (WHERE k)::BIGINT AS kept, count(*) FILTER (WHERE NOT k)::BIGINT AS dropped FROM (SELECT left(word, 3) IN (SELECT prefix FROM ({_BUCKETS}) WHERE hits > 0) AS k FROM ({I.WORDS}))")
def prune_counts(spark, d):
    w = I.words(spark, d)
    return setops.kept_dropped(w, setops.prune(w, usage.bucket_hits(I.qlog(spark, d), 3), 3, 0))


@query(f"SELECT count(*) FILTER (WHERE k)::BIGINT AS kept, count(*) FILTER (WHERE NOT k)::BIGINT AS dropped FROM (SELECT word NOT IN ({I.BLACKLIST}) AS k FROM ({I.WORDS}))")
def blacklist_counts(spark, d):
    w = I.words(spark, d)
    return setops.kept_dropped(w, setops.without(w, I.blacklist(spark, d)))


@query(f"WITH old AS (SELECT word FROM ({I.BLACKLIST}) WHERE length(word) > 6), new AS (SELECT DISTINCT {I.sql_norm('p_name')} AS word FROM part) SELECT count(*) FILTER (WHERE old.word IS NULL)::BIGINT AS added, count(*)::BIGINT AS total FROM old FULL JOIN new ON old.word = new.word")
def blacklist_add(spark, d):
    old = I.blacklist(spark, d).where("length(word) > 6")
    return setops.blacklist_add(old, I.table(spark, d, "part").select(F.col("p_name").alias("word")))[1]


#: A version a supplier, each built from the one of half its number, and a foreign name a nation.
_MAN = "SELECT 'v' || s_suppkey AS version, CASE WHEN s_suppkey > 1 THEN 'v' || (s_suppkey // 2) ELSE '' END AS parent_version FROM supplier UNION ALL SELECT lower(n_name), 'v1' FROM nation"
_KEPT, _CURRENT = 20, "v3"


def _manifests(spark, d):
    s = I.table(spark, d, "supplier").select(F.concat(F.lit("v"), "s_suppkey").alias("version"), F.when(F.col("s_suppkey") > 1, F.concat(F.lit("v"), F.expr("cast(s_suppkey div 2 as string)"))).otherwise("").alias("parent_version"))
    return s.unionByName(I.table(spark, d, "nation").select(F.lower("n_name").alias("version"), F.lit("v1").alias("parent_version")))


@query(f"WITH n AS (SELECT version, regexp_extract(version, '^v(\\d+)$', 1)::INT AS n FROM ({_MAN}) WHERE regexp_matches(version, '^v\\d+$')) SELECT version, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC) AS age FROM n) WHERE age > {_KEPT} AND version <> '{_CURRENT}'")
def retention_plan(spark, d):
    return setops.retention_plan(_manifests(spark, d), _CURRENT, _KEPT)


@query(f"WITH RECURSIVE m AS ({_MAN}), r AS (SELECT version, version AS ancestor, 0 AS steps FROM m UNION ALL SELECT r.version, m.parent_version, steps + 1 FROM r JOIN m ON m.version = r.ancestor WHERE m.parent_version <> '') SELECT * FROM r")
def version_lineage(spark, d):
    return setops.lineage(spark, _manifests(spark, d))


# ---- metrics ------------------------------------------------------------------------------


@query(f"SELECT route, count(*)::BIGINT AS count, count(*) FILTER (WHERE status >= 400)::BIGINT AS errors, round(sum(ms), 3) AS sum_ms, round(min(ms), 3) AS min_ms, round(max(ms), 3) AS max_ms, round(avg(ms), 3) AS avg_ms FROM ({I.REQUESTS}) GROUP BY route")
def route_stats(spark, d):
    s = metrics.route_stats(metrics.observed(I.requests(spark, d)))
    return s.select("route", "count", "errors", *[T.round3(F.col(c)).alias(c) for c in ("sum_ms", "min_ms", "max_ms", "avg_ms")])


_PCT = ", ".join(f"s[round({p} / 100.0 * (len(s) - 1))::INT + 1] AS p{p}" for p in (50, 95, 99))


@query(f"WITH k AS (SELECT route, ms FROM ({I.REQUESTS}) QUALIFY row_number() OVER (PARTITION BY route ORDER BY ts DESC, event_id DESC) <= 4096), l AS (SELECT route, list_sort(list(ms)) AS s FROM k GROUP BY route) SELECT route, {_PCT} FROM l")
def route_percentiles(spark, d):
    return metrics.route_percentiles(metrics.observed(I.requests(spark, d)), order=("ts", "event_id"))


@query(f"SELECT route, status, count(*)::BIGINT AS count FROM ({I.REQUESTS}) GROUP BY route, status")
def status_histogram(spark, d):
    return metrics.status_histogram(metrics.observed(I.requests(spark, d)))


_ODD_ROUTES = "CASE event_type WHEN 'signup' THEN '/health' WHEN 'error' THEN NULL WHEN 'view' THEN '' ELSE event_type END"


@query(f"SELECT * FROM (SELECT CASE WHEN coalesce(r, '') = '' THEN '<not found>' ELSE r END AS route, count(*)::BIGINT AS count FROM (SELECT {_ODD_ROUTES} AS r FROM events) GROUP BY 1) WHERE route NOT IN ('/metrics', '/metrics/json', '/health')")
def observed_routes(spark, d):
    """Routes that aren't counted, and requests without one."""
    e = I.requests(spark, d).withColumnRenamed("route", "event_type").withColumn("route", F.expr(_ODD_ROUTES))
    return metrics.observed(e).groupBy("route").agg(F.count("*").alias("count"))


@query(f"""SELECT '{{"route":"' || route || '","count":' || count(*) || ',"errors":' || count(*) FILTER (WHERE status >= 400) || '}}' AS json FROM ({I.REQUESTS}) GROUP BY route""")
def metrics_snapshot(spark, d):
    return metrics.snapshot_json(metrics.route_stats(metrics.observed(I.requests(spark, d))).select("route", "count", "errors"))


_LIVE = f"""{_MATCHED}, e AS (SELECT prefix, count(word) AS n FROM h JOIN ({I.PARTS}) ON starts_with(word, prefix) GROUP BY prefix),
live AS (SELECT (SELECT count(*) FROM ({I.PARTS}))::BIGINT AS corpus_words, (SELECT coalesce(sum(n), 0) FROM e)::BIGINT AS hot_words, (SELECT count(*) FROM e)::BIGINT AS hot_entries,
  (SELECT count(hot_prefix) FROM l)::BIGINT AS hits, (SELECT count(*) - count(hot_prefix) FROM l)::BIGINT AS misses, (SELECT round(count(hot_prefix) / count(*), 6) FROM l) AS hit_rate, 100000::BIGINT AS word_cap)"""
_LIVE_COLS = "corpus_words, hot_words, hot_entries, hits, misses, hit_rate, greatest(0, corpus_words - hot_words)::BIGINT AS cold_words, word_cap"


def _live(spark, d):
    hot = I.hot_prefixes(spark, d)
    p = I.parts(spark, d)
    entries = promote.prefix_sizes(hot, p).where("words > 0")
    stats = hotset.hit_stats(hotset.longest_prefix_match(I.qlog(spark, d), hot)).withColumn("hit_rate", F.round("hit_rate", 6))
    return _long(metrics.live_stats(p, entries, stats, 100_000), "cold_words")


@query(f"{_LIVE} SELECT {_LIVE_COLS} FROM live")
def live_stats(spark, d):
    return _live(spark, d)


@query(f"""{_LIVE}, lg AS (SELECT sum(hits)::BIGINT AS total_records, count(crossed_id)::BIGINT AS total_promotions, count(DISTINCT prefix)::BIGINT AS keys FROM windows),
us AS (SELECT count(*)::BIGINT AS tracked_prefixes FROM ({_BUCKETS})) SELECT {_LIVE_COLS}, total_records, total_promotions, keys, tracked_prefixes FROM live, lg, us""")
def project_overview(spark, d):
    b = usage.bucket_hits(I.qlog(spark, d), 3).agg(F.count("*").alias("tracked_prefixes"))
    return metrics.overview(_live(spark, d), demand.ledger_stats(_windows(spark, d)), b)


@query(f"SELECT query, array_to_string(list_transform(range(1, length(query) + 1), lambda i: left(query, i)), '|') AS prefixes FROM (SELECT DISTINCT query FROM ({I.QLOG}))")
def prefix_enumeration(spark, d):
    every = F.transform(F.sequence(F.lit(1), F.length("query")), lambda i: F.left("query", i))
    return I.qlog(spark, d).select("query").distinct().select("query", F.array_join(every, "|").alias("prefixes"))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
