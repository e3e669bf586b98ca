import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from lexiduct.operators import hotset, match, promote, usage


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def model(q, w, fuzzy=True, edits=True):
    """(dist, infix) by trying every substring, or None."""
    k = (2 if len(q) >= 5 else 1 if len(q) >= 3 else 0) if edits else 0
    s = q.replace("*", "")
    if s == "":
        return 0, False
    best = lambda s, starts: min(lev(s, w[a:b]) for a in starts for b in range(a, len(w) + 1))
    d = best(s, range(len(w)) if fuzzy else [0])
    if d > k:
        return None
    if not fuzzy:
        return d, False
    free = best(s, [0]) == d or d > 0 and any(best(s[:i] + s[i + 1 :], range(len(w))) <= d - 1 for i in range(len(s)))
    return d, not free


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abé*", min_size=1, max_size=6), min_size=3, max_size=8), st.lists(st.text("abcé", min_size=1, max_size=8), min_size=3, max_size=8), st.booleans(), st.booleans())
def test_fuzzy_against_model(spark, qs, ws, fuzzy, edits):
    q, w = (spark.createDataFrame([(x,) for x in set(v)], f"{c} string") for v, c in ((qs, "query"), (ws, "word")))
    got = {(r.query, r.word): (r.dist, r.infix) for r in match.fuzzy_scores(match.fuzzy_candidates(q, w, edits), fuzzy, edits).collect()}
    assert got == {(a, b): m for a in set(qs) for b in set(ws) if (m := model(a, b, fuzzy, edits))}


@pytest.mark.parametrize(
    "q,w,fuzzy,want",
    [("appliaction", "application security", True, (2, False)), ("mar", "market", False, (0, False)), ("ket", "market", True, (0, True)), ("ket", "market", False, None), ("ab", "b", True, None), ("***", "any", True, (0, False))],
)
def test_fuzzy_cases(spark, words, q, w, fuzzy, want):
    got = match.fuzzy_search(words(q, col="query"), words(w), 0, fuzzy=fuzzy).collect()
    assert [(r.dist, r.infix) for r in got] == ([want] if want else [])


def test_fuzzy_query_over_the_word_corpus(spark, tmp_path):
    from lexiduct.plans import catalog

    rnd = random.Random(7)
    text = ["".join(rnd.choice("glnorté") for _ in range(rnd.randint(1, 8))) for _ in range(150)] + ["Polished", "chocolaté", "oldring", "ketten", "blue", "www.x"]
    spark.createDataFrame([(i, " ".join(text[i::5])) for i in range(5)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["fuzzy_words"](spark, str(tmp_path)).collect()
    corpus = {w.lower().replace("é", "e") for w in text} - {"www.x"}
    want = []
    for q in catalog.FUZZY_QUERIES:
        hits = sorted((*m, w.encode()) for w in corpus if (m := model(q, w)))
        want += [(q, i, w.decode(), d, x) for i, (d, x, w) in enumerate(hits[:20], 1)]
    assert sorted((r.query, r["rank"], r.word, r.dist, r.infix) for r in got) == sorted(want)


def test_fuzzy_ranks_and_originals(spark, words):
    got = match.fuzzy_search(words("mar", col="query"), words("tamar", "market", "mxr", "mar"), 3).orderBy("rank").collect()
    assert [r.word for r in got] == ["mar", "market", "tamar"]
    out = match.search_originals(words("ete", col="query"), words("Été", "ete", "x", col="original"), 1).collect()
    assert [(r.word, r.originals) for r in out] == [("ete", ["ete", "Été"])]
    assert match.fuzzy_search(words("", col="query"), words("a")).collect() == []
    assert len(match.fuzzy_search(words("ABC", col="query"), words("ABC"), case_sensitive=True).collect()) == 1


def test_prefix_join(spark, words):
    ws = ["market", "marketing", "marine", "mango", "été", "日本語"]
    got = rows(match.prefix_join_topk(words("mar", "m", "日", "zz", "", "mar", col="query"), words(*ws), 2))
    assert got == [("m", 1, "mango"), ("m", 2, "marine"), ("mar", 1, "marine"), ("mar", 2, "market"), ("日", 1, "日本語")]
    assert match.prefix_join_topk(words("x", col="query").where("false"), words(*ws)).collect() == []


def test_plans_have_no_nested_loop(spark, words):
    plan = match.prefix_join_topk(words("mar", col="query"), words("market"), 2)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_longest_prefix(spark, words):
    m = hotset.longest_prefix_match(words("marketing", "madrid", "xylophone", "", col="query"), words("ma", "mark", col="prefix"))
    assert dict(m.collect()) == {"marketing": "mark", "madrid": "ma", "xylophone": None, "": None}
    s = hotset.hit_stats(hotset.longest_prefix_match(words("apple", "apple", "zzz", col="query"), words("a", col="prefix"))).first()
    assert (s.hits, s.misses, round(s.hit_rate, 3)) == (2, 1, 0.667)
    assert hotset.hit_stats(m.where("false")).first().hit_rate == 0


def test_lru_budget():
    c = hotset.LruBudget(5)
    assert [c.insert(p, 2) for p in "abc"] == [[], [], ["a"]] and c.words == 4
    c = hotset.LruBudget(100)
    for p in ("aa", "bb", "cc"):
        c.insert(p, 1)
    c.lookup("aaa")
    assert c.newest_first()[0][0] == "aa"
    c.insert("mark", 1), c.insert("mark", 3)
    assert c.entries["mark"][0] == 3 and c.lookup("") is None
    assert c.evict("mark") and not c.evict("mark")
    big = hotset.LruBudget(2)
    assert big.insert("x", 9) == [] and big.words == 9 and big.insert("y", 1) == ["x"]


def test_replay_promotes_after_the_crossing_event(spark, words):
    log = spark.createDataFrame([("p", i, f"2024-01-01 00:00:0{i}", q) for i, q in enumerate(["mar", "mar", "mar", "zz", "zz", "zz"])], "project string, event_id long, ts string, query string").withColumn("ts", F.to_timestamp("ts"))
    sizes = promote.prefix_sizes(log.select(F.col("query").alias("prefix")), words("market", "marine", "mango"))
    assert rows(sizes) == [("mar", 2, False), ("zz", 0, False)]
    got = hotset.lru_replay(log, sizes, threshold=2).orderBy("event_id").collect()
    assert [(r.hot_prefix, r.inserted) for r in got] == [(None, None), (None, "mar"), ("mar", None), (None, None), (None, None), (None, None)]
    st = hotset.replay_stats(hotset.lru_replay(log, sizes, threshold=2)).first()
    assert (st.lookups, st.hits, st.inserted, st.evicted) == (6, 1, 1, 0)


def plain_replay(log, sizes, cap, threshold, span):
    """The hot set and its ledger as plain lists, event by event."""
    cache, ledger, out = [], {}, []  # entries: [prefix, words, hits], least recent first
    for e, us, q, kind in sorted(log, key=lambda r: (r[1], r[0])):
        if kind == "evict":
            gone = [x[0] for x in cache if x[0] == q]
            cache = [x for x in cache if x[0] != q]
            if gone:
                ledger[q][2] = False
            out.append((e, None, None, gone, sum(x[1] for x in cache)))
            continue
        c = ledger.setdefault(q, [us, 0, False])
        if us - c[0] > span:
            c[:] = [us, 0, False]
        c[1] += 1
        crossed = not c[2] and c[1] >= threshold
        c[2] = c[2] or crossed
        fits = sorted((x for x in cache if q.startswith(x[0])), key=lambda x: len(x[0]))
        if fits:
            cache.remove(fits[-1])
            cache.append(fits[-1])
            fits[-1][2] += 1
        gone, inserted = [], None
        if crossed and sizes[q]:
            inserted = q
            cache = [x for x in cache if x[0] != q] + [[q, sizes[q], 0]]
            while sum(x[1] for x in cache) > cap and len(cache) > 1:
                gone.append(cache.pop(0)[0])
                ledger[gone[-1]][2] = False
        elif crossed:
            c[2] = False
        out.append((e, fits[-1][0] if fits else None, inserted, gone, sum(x[1] for x in cache)))
    return out, [(p, w, h, n + 1) for n, (p, w, h) in enumerate(reversed(cache))]


@pytest.mark.parametrize("seed", range(3))
def test_replay_against_a_plain_model(spark, seed):
    rnd = random.Random(seed)
    sizes = {q: rnd.choice([0, 1, 2, 5, 9]) for q in ["a", "ab", "abc", "b", "bc", "c", "ca", "cab"]}
    log = [(i, rnd.randint(0, 400), rnd.choice(list(sizes)), "evict" if rnd.random() < 0.03 else "hit") for i in range(500)]
    df = spark.createDataFrame([("p", *r) for r in log], "project string, event_id long, us long, query string, kind string").withColumn("ts", F.timestamp_seconds("us"))
    got = hotset.lru_replay(df, spark.createDataFrame(list(sizes.items()), "prefix string, words long"), cap=10, threshold=3, window_s=40)
    want, left = plain_replay(log, sizes, 10, 3, 40)
    assert [(r.event_id, r.hot_prefix, r.inserted, r.evicted, r.resident_words) for r in got.orderBy("seq").collect()] == want
    assert [tuple(r) for r in hotset.resident_entries(got).select("prefix", "words", "hits", "rank").orderBy("rank").collect()] == left
    s = hotset.replay_stats(got).first()
    hits = [r for r in log if r[3] == "hit"]
    assert (s.lookups, s.hits + s.misses, s.evicted) == (len(hits), len(hits), sum(len(w[3]) for w in want))


def test_lookups(spark, words):
    assert rows(hotset.is_resident(words("ma", "mar", col="prefix"), words("ma", col="prefix"))) == [("ma", True), ("mar", False)]
    assert rows(usage.is_surfaced(words("x", "y"), words("y"))) == [("x", False), ("y", True)]


def test_promotion_queue_and_pins(spark, words):
    c = spark.createDataFrame([("mar", 1, 1), ("mar", 2, 5), ("zz", 3, 2), ("ok", 4, 3)], "prefix string, event_id long, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert rows(promote.queue(c, words("ok", col="prefix"), 1)) == [("mar", True), ("zz", False)]
    lines = words("# c", "", "MAR", col="value")
    assert rows(promote.pinned(lines, words("market", "marine", "x"))) == [("mar", 1, "marine"), ("mar", 2, "market")]
    e = spark.createDataFrame([("a", 3, 1), ("b", 3, 2), ("c", 9, 3)], "prefix string, words int, last_used int")
    assert rows(promote.within_budget(e, 5), "prefix") == [("c",)]
