"""Inputs that the queries derive from the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiduct.functions import text as T
from lexiduct.operators import corpus as C

WINDOW_S, THRESHOLD = 86_400, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(df: DataFrame, col: str):
    """Microseconds since 1970, whatever the session's time zone."""
    if dict(df.dtypes)[col] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {col})")
    return F.unix_micros(col)


def values(spark, sf_dir) -> DataFrame:
    return C.tokens(table(spark, sf_dir, "documents"))


def words(spark, sf_dir) -> DataFrame:
    """The corpus of all words of documents."""
    return C.build_corpus(values(spark, sf_dir))


def parts(spark, sf_dir) -> DataFrame:
    """A small corpus: the names of parts."""
    return C.build_corpus(table(spark, sf_dir, "part").select(F.col("p_name").alias("value")))


def staged(spark, sf_dir) -> DataFrame:
    """Names of parts with odd keys, and all types."""
    p = table(spark, sf_dir, "part")
    return C.build_corpus(p.where("p_partkey % 2 = 1").select(F.col("p_name").alias("value")).unionByName(p.select(F.col("p_type").alias("value"))))


def blacklist(spark, sf_dir) -> DataFrame:
    """Words of the benchmark's items."""
    return table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[ \t\r\n]+")).alias("v")).select(T.normalise("v").alias("word")).where("word <> ''").distinct()


def qlog(spark, sf_dir) -> DataFrame:
    """A query log: project, event_id, user_id, ts, query, from events and part names."""
    p = table(spark, sf_dir, "part")
    n = p.count()
    e = table(spark, sf_dir, "events")
    e = e.select("event_id", "user_id", micros(e, "ts").alias("us"), (F.col("event_id") % n).alias("p_partkey"))
    q = e.join(p.select(F.col("p_partkey").cast("long").alias("p_partkey"), T.normalise("p_name").alias("name")), "p_partkey")
    return q.select(F.lit("default").alias("project"), "event_id", "user_id", F.timestamp_micros("us").alias("ts"), F.expr("left(name, cast(2 + event_id % 6 as int))").alias("query"))


def hot_prefixes(spark, sf_dir) -> DataFrame:
    """prefix: what crossed the threshold in the log."""
    from lexiduct.operators import demand

    return demand.crossings(demand.ledger_windows(qlog(spark, sf_dir), THRESHOLD, WINDOW_S)).select("prefix").distinct()


def answers(spark, sf_dir) -> DataFrame:
    """query, words: each logged event with the first three part names of its query."""
    from lexiduct.operators import match

    top = match.prefix_join_topk(qlog(spark, sf_dir), parts(spark, sf_dir), 3).groupBy("query").agg(F.sort_array(F.collect_list("word")).alias("words"))
    return qlog(spark, sf_dir).join(top, "query").select("event_id", "query", "words")


def requests(spark, sf_dir) -> DataFrame:
    """A request log: ts, event_id, method, route, status, ms."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.timestamp_micros(micros(e, "ts")).alias("ts"), "event_id", F.lit("GET").alias("method"), F.col("event_type").alias("route"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("ms")
    )


# ---- the same as SQL ---------------------------------------------------------------------

_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_norm(x: str) -> str:
    return f"lower(strip_accents(regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')))"


#: What marks a term as junk, as in functions/text.py.
SQL_JUNK = {
    "url": r"(?i)https?://|www\.",
    "domain": r"(?i)\.(?:com|net|org|co|in|io)\d*\b",
    "escape": r"(?i)\\u[0-9a-f]{4}",
    "control": r"[\x00-\x1f]",
}


def sql_accept(w: str) -> str:
    return " AND ".join([f"regexp_matches({w}, '\\pL')", *(f"NOT regexp_matches({w}, '{rx}')" for rx in SQL_JUNK.values())])


def sql_corpus(raw: str) -> str:
    """SELECT of the distinct accepted words of a SELECT with a column value."""
    return f"SELECT DISTINCT word FROM (SELECT {sql_norm('value')} AS word FROM ({raw})) WHERE {sql_accept('word')}"


TOK = "SELECT unnest(regexp_split_to_array(text, '[ \\t\\r\\n]+')) AS value FROM documents"
WORDS = sql_corpus(TOK)
PARTS = sql_corpus("SELECT p_name AS value FROM part")
STAGED = sql_corpus("SELECT p_name AS value FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_type FROM part")
BLACKLIST = f"SELECT DISTINCT word FROM (SELECT {sql_norm('v')} AS word FROM (SELECT unnest(regexp_split_to_array(text, '[ \\t\\r\\n]+')) AS v FROM benchmark)) WHERE word <> ''"
QLOG = f"""SELECT event_id, user_id, epoch_us(ts) AS us, left({sql_norm('p_name')}, (2 + event_id % 6)::INT) AS query
FROM events JOIN part ON p_partkey = event_id % (SELECT count(*) FROM part)"""
LEDGER = f"""
n AS (SELECT query, us, event_id, row_number() OVER (PARTITION BY query ORDER BY us, event_id) AS rn FROM ({QLOG})),
r AS (
  SELECT query, rn, us AS ws, us, event_id, 1 AS hits FROM n WHERE rn = 1
  UNION ALL
  SELECT n.query, n.rn, CASE WHEN n.us - r.ws > {WINDOW_S}000000 THEN n.us ELSE r.ws END, n.us, n.event_id,
    CASE WHEN n.us - r.ws > {WINDOW_S}000000 THEN 1 ELSE r.hits + 1 END
  FROM r JOIN n ON n.query = r.query AND n.rn = r.rn + 1
),
windows AS (
  SELECT query AS prefix, ws AS window_us, count(*) AS hits, max(us) AS last_us,
    max(CASE WHEN hits = {THRESHOLD} THEN event_id END) AS crossed_id, max(CASE WHEN hits = {THRESHOLD} THEN us END) AS crossed_us
  FROM r GROUP BY query, ws
),
state AS (
  SELECT prefix, hits, window_us, last_us, crossed_id IS NOT NULL AS promoted FROM windows QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY window_us DESC) = 1
)"""
HOT = "SELECT DISTINCT prefix FROM windows WHERE crossed_id IS NOT NULL"
ANSWERS = f"""SELECT event_id, q.query, list(p.word ORDER BY p.word) AS words FROM ({QLOG}) q
JOIN (SELECT query, word FROM (SELECT DISTINCT query FROM ({QLOG})) JOIN ({PARTS}) ON starts_with(word, query)
  QUALIFY row_number() OVER (PARTITION BY query ORDER BY word) <= 3) p ON p.query = q.query GROUP BY event_id, q.query"""
REQUESTS = "SELECT ts, event_id, event_type AS route, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value AS ms FROM events"
