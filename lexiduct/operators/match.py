"""Prefix and typo-tolerant search, for one query and for tables of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiduct.functions import text as T


def prefix_search(corpus: DataFrame, query: str, limit: int | None = 10) -> DataFrame:
    """The first `limit` words, in byte order, that start with a normalised query.  The
    filter is pushed to the scan and the limit needs no full sort; None gives all."""
    hits = corpus.where(F.col("word").startswith(query)).select("word").orderBy("word")
    return hits if limit is None else hits.limit(limit)


def prefix_join_topk(queries: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """query, rank (from 1), word: the first k words of each distinct query's prefix range.

    A prefix condition alone would be a nested-loop join.  Instead each word offers its
    prefixes of the lengths that queries have (a short list), which is an equi-join on
    the whole prefix; then the window keeps k a query before and after its shuffle."""
    q = queries.select("query").where("query <> ''").distinct()
    lengths = sorted(r[0] for r in q.select(F.length("query")).distinct().collect())
    if not lengths:
        return q.select("query", F.lit(0).alias("rank"), F.col("query").alias("word")).where(F.lit(False))
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("word"))
    offers = corpus.select("word", F.explode(F.transform(fits, lambda n: F.left("word", n))).alias("query"))
    first = Window.partitionBy("query").orderBy("word")
    return offers.join(q, "query").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query", "rank", "word")


def _closest(q: str, w: str, k: str, free_start: bool) -> str:
    """SQL for the least edit distance of q to a substring of w (a prefix, unless the start
    is free).  Substrings whose length differs by more than k can't be within k."""
    starts = f"sequence(1, greatest(1, length({w})))" if free_start else "array(1)"
    return (
        f"array_min(transform({starts}, s -> array_min(transform(sequence(greatest(0, length({q}) - {k}), length({q}) + {k}), "
        f"n -> levenshtein({q}, substring({w}, s, n))))))"
    )


def fuzzy_scores(pairs: DataFrame, fuzzy: bool = True, levenshtein: bool = True, scheme: dict[int, int] | None = None) -> DataFrame:
    """Adds dist and infix to pairs (query, word) and keeps those within the edit budget.

    The end of the word is free, and so is its start if fuzzy.  `*` in a query is skipped
    at no cost but counts for its budget.  infix says that the best match needs a free
    start: neither does a match at the word's start reach dist, nor a match that drops a
    character of the query (after a dropped character a match no longer counts as infix)."""
    budget = T.edit_budget(F.col("query"), scheme) if levenshtein else F.lit(0)
    rows = pairs.withColumn("_q", F.replace("query", F.lit("*"), F.lit(""))).withColumn("_k", budget)
    rows = rows.where("query <> ''").withColumn("dist", F.when(F.col("_q") == "", F.lit(0)).otherwise(F.expr(_closest("_q", "word", "_k", fuzzy))))
    rows = rows.where("dist <= _k")
    at_start = F.expr(f"{_closest('_q', 'word', '_k', False)} = dist")
    shorter = "concat(left(_q, i - 1), substring(_q, i + 1))"
    dropped = F.expr(f"dist > 0 AND exists(sequence(1, length(_q)), i -> {_closest(shorter, 'word', '_k', True)} <= dist - 1)")
    infix = F.lit(False) if not fuzzy else F.when(F.col("_q") == "", F.lit(False)).otherwise(~(at_start | dropped))
    return rows.withColumn("infix", infix).drop("_q", "_k")


def fuzzy_candidates(queries: DataFrame, corpus: DataFrame, levenshtein: bool = True, scheme: dict[int, int] | None = None) -> DataFrame:
    """query, word pairs that may match, without trying all pairs: if at most k edits lead
    from a query to a piece of a word, then of k + 1 parts of the query at least one is in
    the word as it stands.  Parts and equally long substrings of words are joined; only
    queries with no more characters than edits meet every word."""
    budget = T.edit_budget(F.col("query"), scheme) if levenshtein else F.lit(0)
    q = queries.select("query").where("query <> ''").distinct().withColumn("q", F.replace("query", F.lit("*"), F.lit(""))).withColumn("k", budget)
    cut = q.where("length(q) > k")
    part = F.expr("transform(sequence(0, k), i -> substring(q, 1 + cast(floor(i * length(q) / (k + 1)) as int), cast(floor((i + 1) * length(q) / (k + 1)) as int) - cast(floor(i * length(q) / (k + 1)) as int)))")
    parts = cut.select("query", F.explode(part).alias("part")).distinct()
    lengths = sorted(r[0] for r in parts.select(F.length("part")).distinct().collect())
    words = corpus.select("word").distinct()
    grams = words.select("word", F.explode(F.lit(lengths).cast("array<int>")).alias("n")).where("length(word) >= n")
    grams = grams.select("word", F.explode(F.expr("array_distinct(transform(sequence(1, length(word) - n + 1), s -> substring(word, s, n)))")).alias("part"))
    near = parts.join(grams, "part").select("query", "word").distinct()
    every = q.where("length(q) <= k").select("query")
    return near.unionByName(every.join(words, F.lit(True)))


def rank_fuzzy(scored: DataFrame, limit: int = 0, by: tuple[str, ...] = ("query",)) -> DataFrame:
    """Ranks by distance, then matches at a word's start, then the word's bytes; limit 0
    keeps all."""
    order = Window.partitionBy(*by).orderBy("dist", "infix", "word")
    out = scored.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= limit) if limit else out


def fuzzy_search(queries: DataFrame, corpus: DataFrame, limit: int = 10, fuzzy: bool = True, levenshtein: bool = True, scheme: dict[int, int] | None = None, normalised: bool = True, case_sensitive: bool = False) -> DataFrame:
    """query, rank, word, dist, infix for each distinct query over the whole corpus."""
    clean = (lambda c: T.strip_marks(F.col(c))) if normalised else F.col
    shape = (lambda c: clean(c)) if case_sensitive else (lambda c: T.lower_each(clean(c)))
    q = queries.select(shape("query").alias("query"))
    w = corpus.select(shape("word").alias("word")).where("word <> ''").distinct()
    return rank_fuzzy(fuzzy_scores(fuzzy_candidates(q, w, levenshtein, scheme), fuzzy, levenshtein, scheme), limit).select("query", "rank", "word", "dist", "infix")


def search_originals(queries: DataFrame, originals: DataFrame, limit: int = 10, **options) -> DataFrame:
    """query, rank, word, originals: as fuzzy_search over the normal forms of originals
    (original string); all originals of a listed word come back, in byte order, so there
    may be more of them than the limit."""
    names = originals.select("original", T.normalise("original").alias("word")).where("word <> ''")
    hits = fuzzy_search(queries, names, limit, **options)
    lists = names.join(hits.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.sort_array(F.collect_set("original")).alias("originals"))
    return hits.join(lists, "word").select("query", "rank", "word", "originals")


def min_length_ok(col: Column, least: int = 2) -> Column:
    """Queries count by bytes."""
    return F.octet_length(col) >= least
