import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from lexiduct.config import Settings
from lexiduct.engine import Engine
from lexiduct.operators import demand, metrics, setops, usage
from lexiduct.sources.store import Projects, Store, valid_project

S = 1_000_000


def events(spark, pairs):
    return spark.createDataFrame([(i, q, us) for i, (q, us) in enumerate(pairs)], "event_id long, query string, us long").select("event_id", "query", F.timestamp_micros("us").alias("ts"))


def model(pairs, threshold, window_us):
    counters, out, wins = {}, [], {}
    for i, q, us in sorted(((i, q, us) for i, (q, us) in enumerate(pairs)), key=lambda r: (r[2], r[0])):
        c = counters.setdefault(q, demand.AnchoredCounter(threshold, window_us))
        if c.record(us):
            out.append((q, i))
        wins[(q, c.start)] = c.hits
    return sorted(out), wins


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "ç"]), st.integers(0, 60)), min_size=1, max_size=60), st.integers(1, 4), st.integers(0, 20))
def test_ledger_against_model(spark, pairs, threshold, window):
    pairs = [(q, s * S) for q, s in pairs]
    w = demand.ledger_windows(events(spark, pairs), threshold, window)
    want, wins = model(pairs, threshold, window * S)
    assert rows(demand.crossings(w), "prefix", "event_id") == want
    assert {(r.prefix, r.us): r.hits for r in w.select("prefix", F.unix_micros("window_start").alias("us"), "hits").collect()} == wins


def test_ledger_cases(spark):
    w = demand.ledger_windows(events(spark, [("m", t * S) for t in (0, 10, 60, 61, 62)]), 2, 60)
    assert rows(w.select(F.unix_seconds("window_start"), "hits")) == [(0, 3), (61, 2)]
    s = demand.ledger_state(demand.ledger_windows(events(spark, [("one", 0), ("two", 1), ("two", 2), ("old", -3600 * S)]), 2, 60))
    assert rows(demand.hot_prefixes(s)) == [("two",)]
    assert rows(demand.watch_list(s)) == [("old", 1), ("one", 1)]
    assert rows(demand.sweep(s, F.timestamp_seconds(F.lit(0)), 600), "prefix") == [("one",), ("two",)]
    cleared = demand.mark_promoted(s, spark.createDataFrame([("two",)], "prefix string"), False)
    assert demand.hot_prefixes(cleared).collect() == []
    assert demand.ledger_windows(events(spark, [("a", 0)]).where("false")).collect() == []


def test_stream_equals_batch(spark, tmp_path):
    from lexiduct.streaming import flows

    pairs = [(q, t * S) for t, q in enumerate("aababbbacaabbbccccab" * 3)]
    e = events(spark, pairs)
    src = str(tmp_path / "src")
    e.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(e.schema).parquet(src)
    q = flows.ledger_stream(stream, 3, 5).writeStream.format("memory").queryName("ledger").option("checkpointLocation", str(tmp_path / "c1")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("ledger")
    assert rows(got.where("crossed"), "prefix", "event_id") == rows(demand.crossings(demand.ledger_windows(e, 3, 5)), "prefix", "event_id")
    q = flows.usage_stream(stream, 1).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "c2")).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("hits")) == rows(usage.bucket_hits(e, 1))


def counted(spark, *rows_):
    """Rows as a ledger_stream gives them: prefix, event_id, us, crossed."""
    return spark.createDataFrame([(p, i, us * S, 0, 1, c) for p, i, us, c in rows_], "prefix string, event_id long, us long, window_us long, hits long, crossed boolean")


def test_promotion_under_a_budget(spark, tmp_path):
    from lexiduct.streaming import flows

    corpus = spark.createDataFrame([(w,) for w in ("oak", "oat", "pine", "pint", "rye", "sage", "sago", "sand")], "word string")
    sink = flows.PromotionSink(spark, corpus, str(tmp_path / "hot"), cap=5, capacity=2)
    assert sink.entries().collect() == [] and sink.stats().first().built == 0
    sink.sink(counted(spark, ("oa", 1, 10, True), ("zz", 2, 11, True), ("ry", 3, 12, True)), 0)
    assert rows(sink.entries(), "prefix", "words") == [("oa", 2)]  # zz has no words, ry came behind the queue's end
    assert rows(sink.hot()) == [("oa", 1, "oak"), ("oa", 2, "oat")]
    sink.sink(counted(spark, ("pin", 4, 20, True)), 1)
    sink.sink(counted(spark, ("oats", 5, 30, False)), 2)  # oa is recent again
    sink.sink(counted(spark, ("sa", 6, 40, True)), 3)
    assert rows(sink.entries(), "prefix", "words", "loaded_in") == [("oa", 2, 0), ("sa", 3, 3)]
    sink.sink(counted(spark, ("sa", 6, 40, True)), 3)  # a batch that runs again
    assert rows(sink.entries(), "prefix") == [("oa",), ("sa",)]
    again = flows.PromotionSink(spark, corpus, str(tmp_path / "hot"), cap=1)
    again.sink(counted(spark, ("p", 7, 50, True)), 4)  # larger than the budget, and alone in it
    assert rows(again.entries(), "prefix", "words") == [("p", 2)]
    s = again.stats().first()
    assert (s.enqueued, s.dropped, s.built, s.empty, s.evicted) == (5, 1, 4, 1, 3) and s.avg_build_ms > 0
    cleared = spark.read.schema(flows.CONTROLS).option("recursiveFileLookup", True).parquet(str(tmp_path / "hot" / "controls"))
    assert rows(cleared, "query", "kind") == [("oa", "clear"), ("pin", "clear"), ("sa", "clear"), ("zz", "clear")]
    again.sink(counted(spark, ("none", 8, 60, False)), 5)
    assert rows(again.entries(), "prefix") == [("p",)]


def test_marks_clears_and_restored_state_in_a_stream(spark, tmp_path):
    from lexiduct.streaming import flows

    schema = "event_id long, us long, query string, kind string"
    told = [(1, 1, "a", "hit"), (2, 2, "a", "clear"), (3, 3, "a", "hit"), (4, 4, "u", "clear"), (5, 90, "u", "hit"), (6, 91, "u", "hit"), (7, 5, "m", "mark"), (8, 6, "m", "hit"), (9, 7, "m", "hit"), (10, 8, "m", "clear"), (11, 9, "m", "hit"), (12, 2, "r", "hit"), (13, 2, "p", "hit")]
    src = str(tmp_path / "src")
    spark.createDataFrame([(i, us * S, q, k) for i, us, q, k in told], schema).coalesce(1).write.parquet(src)
    before = spark.createDataFrame([("r", 1, 0, False), ("p", 5, 0, True)], "prefix string, hits long, w long, promoted boolean").withColumn("window_start", F.timestamp_micros("w"))
    stream = spark.readStream.schema(schema).parquet(src).withColumn("ts", F.timestamp_micros("us"))
    q = flows.ledger_stream(stream, 2, 60, restored=before).writeStream.format("memory").queryName("marks").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    # u's window begins with its first hit, not with the clear; r goes on from one hit; p is promoted already.
    got = {(r.prefix, r.event_id): (r.window_us // S, r.hits, r.crossed) for r in spark.table("marks").collect()}
    assert got == {("a", 1): (1, 1, False), ("a", 3): (1, 2, True), ("u", 5): (90, 1, False), ("u", 6): (90, 2, True), ("m", 8): (5, 1, False), ("m", 9): (5, 2, False), ("m", 11): (5, 3, True), ("r", 12): (0, 2, True), ("p", 13): (0, 6, False)}


def test_ledger_snapshots(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert demand.read_snapshot(spark, path).collect() == []
    s = demand.ledger_state(demand.ledger_windows(events(spark, [("one", 0), ("two", 1), ("two", 2), ("old", -3600 * S)]), 2, 60))
    demand.write_snapshot(s, path, 1)
    demand.write_snapshot(s.where("prefix <> 'one'"), path, 2)
    spark.createDataFrame([("half",)], "prefix string").write.parquet(f"{path}/snapshot=3")  # never finished
    got = demand.read_snapshot(spark, path)
    assert rows(got, "prefix", "hits", "promoted") == [("old", 1, False), ("two", 2, True)]
    assert rows(demand.read_snapshot(spark, path, F.timestamp_seconds(F.lit(0))), "prefix") == [("two",)]


def test_usage(spark):
    r = spark.createDataFrame([("marketing", ["a"]), ("market", ["a", "b"]), ("mar", []), ("ab", ["c"])], "query string, words array<string>")
    b = usage.bucket_hits(r, 3)
    assert rows(b) == [("ab", 1), ("mar", 3)] and rows(usage.hot(b, 1)) == [("mar", 3)] and rows(usage.cold(b, 1)) == [("ab", 1)]
    assert rows(usage.bucket_hits(r, 0)) == rows(b)
    assert tuple(usage.stats(r).first()) == (2, 3, 4)
    c = spark.createDataFrame([("a",), ("z",)], "word string")
    assert rows(usage.unsurfaced(c, usage.surfaced(r))) == [("z",)] and rows(usage.migrate(usage.surfaced(r), c)) == [("a",)]
    assert usage.as_map(usage.merge_counts(b, b)).first().prefix_hits == {"ab": 2, "mar": 6}
    assert tuple(usage.stats(r.where("false")).first()) == (0, 0, 0)


def test_setops(spark, words):
    a, b = words("drum", "dulcimer", "flute", "harp", "horn"), words("drum", "harp", "lyre")
    assert tuple(setops.diff(a, b).first()) == (1, 3, 2)
    assert rows(setops.merge(a, b)) == [("drum",), ("dulcimer",), ("flute",), ("harp",), ("horn",), ("lyre",)]
    hits = spark.createDataFrame([("du", 0), ("ha", 3), ("h", 9), ("fl", 1)], "prefix string, hits long")
    assert rows(setops.prune(a, hits, 2)) == [("flute",), ("harp",)] and rows(setops.prune(a, hits, 2, 1)) == [("harp",)]
    new, n = setops.blacklist_add(words("horn"), words("HORN ", "Lyre", "\t", "lyre"))
    assert rows(new) == [("horn",), ("lyre",)] and tuple(n.first()) == (1, 2)


def test_store_lifecycle(spark, tmp_path, words):
    v = lambda *xs: words(*xs, col="value")
    s = Store(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        s.words()
    m = s.bootstrap(v("apple", "apricot", "banana"), "f")
    assert (m.version, m.mode, m.word_count, s.current(), s.word_count()) == ("v1", "bootstrap", 3, "v1", 3)
    with pytest.raises(FileExistsError):
        s.bootstrap(v("x"), "f", "v1")
    s.write_usage(spark.createDataFrame([("app", 2), ("ban", 1)], "prefix string, hits long"), words("apple", "banana"))
    with pytest.raises(FileNotFoundError):
        s.apply("replace")
    s.stage(v("apple", "apricot", "blueberry"))
    out = s.apply("replace")
    assert (out.new_version, out.previous_version, out.usage_migrated) == ("v2", "v1", True)
    assert rows(s.surfaced()) == [("apple",)] and rows(s.usage_hits()) == [("app", 2), ("ban", 1)]
    s.stage(v("date"))
    assert s.apply("merge").word_count == 4
    pruned = s.apply("prune")
    assert pruned.diff == {"added": 0, "dropped": 3, "retained": 1} and rows(s.words()) == [("apple",)]
    assert s.rollback("v2") == ("v4", "v2") and s.next_version() == "v5"
    with pytest.raises(FileNotFoundError):
        s.rollback("v99")
    for bad in ("", "staging", "..", "v3/corpus", "a\\b", "v4.old", s.current()):
        with pytest.raises(ValueError):
            s.delete_version(bad)
    s.delete_version("v1")
    with pytest.raises(FileNotFoundError):
        s.delete_version("v1")
    out = s.add_to_blacklist(["Apricot", "nope"])
    assert (out["added"], out["total"], out["removed"]) == (2, 2, 1) and rows(s.words()) == [("apple",), ("blueberry",)]
    s.reset_usage()
    with pytest.raises(ValueError, match="no live usage"):
        s.apply("prune")
    s.stage(v("x"))
    with pytest.raises(ValueError, match="unknown mode"):
        s.apply("what")
    s.delete_staging()
    with pytest.raises(FileNotFoundError):
        s.delete_staging()
    assert s.retain(2) == ["v2", "v3"] and s.versions() == ["v4", "v5"]
    z = str(tmp_path / "b.zip")
    assert s.backup(z) > 3
    s.stage(v("other"))
    s.apply("replace")
    assert s.restore(z) == "v5" and rows(s.words()) == [("apple",), ("blueberry",)]
    with zipfile.ZipFile(tmp_path / "evil.zip", "w") as f:
        f.writestr("../evil.txt", "x")
    with pytest.raises(ValueError, match="unsafe"):
        s.restore(str(tmp_path / "evil.zip"))
    assert s.current() == "v5"
    p = Projects(spark, str(tmp_path))
    p.create("orchard")
    assert p.names() == ["default", "orchard"] and p.get("orchard").project == "orchard"
    with pytest.raises(FileExistsError):
        p.create("orchard", exists_ok=False)
    with pytest.raises(FileNotFoundError):
        p.get("meadow")
    p.delete("orchard")
    with pytest.raises(ValueError):
        p.delete("default")


def test_names_retention_lineage(spark):
    assert all(map(valid_project, ("x", "7", "orchard", "old-town-9", "q" * 48))) and not any(map(valid_project, ("", "Orchard", "old town", "-x", "x-", "a/b", "..", "q" * 49)))
    m = spark.createDataFrame([("v1", ""), ("v2", "v1"), ("v3", "v2"), ("v10", "v3")], "version string, parent_version string")
    assert rows(setops.retention_plan(m, "v10", 2), "version") == [("v1",), ("v2",)]
    assert rows(setops.lineage(spark, m).where("version = 'v10'"), "ancestor", "steps") == [("v1", 3), ("v10", 0), ("v2", 2), ("v3", 1)]


def test_a_restore_that_fails_leaves_all_as_it_was(spark, tmp_path, words, monkeypatch):
    s = Store(spark, str(tmp_path / "r"))
    s.bootstrap(words("reed", "rush", col="value"))
    z = str(tmp_path / "b.zip")
    s.backup(z)
    s.stage(words("sedge", col="value"))
    s.apply("merge")
    real, calls = s.tree.rename, []

    def rename(a, b):
        calls.append(b)
        if len(calls) == 2:
            raise OSError("the disk is gone")
        real(a, b)

    monkeypatch.setattr(s.tree, "rename", rename)
    with pytest.raises(OSError, match="gone"):
        s.restore(z)
    assert len(calls) == 3 and s.current() == "v2" and rows(s.words()) == [("reed",), ("rush",), ("sedge",)]
    assert s.restore(z) == "v1" and rows(s.words()) == [("reed",), ("rush",)]


def test_engine(spark, tmp_path):
    csv = tmp_path / "w.csv"
    csv.write_text("name\nharbour\nharbour master\nharvest\nharp\nhazel\nApple\n786\n")
    e = Engine(spark, str(tmp_path / "root"), settings=Settings(promotion_threshold=3, word_cap=4, promotion_max_words=4))
    assert e.suggest("har") == []
    out = e.upload(str(csv), "NAME")
    assert (out.word_count, e.store.sources()[0]["values_read"], e.reload()) == (6, 7, out.new_version)
    with pytest.raises(ValueError, match="at least 2"):
        e.suggest("a")
    with pytest.raises(ValueError):
        e.suggest("é")  # its normal form is one byte
    assert [x["source"] for x in e.suggest("HAR", 2)] == ["cold", "cold"]
    assert e.warm(["harb", "zz"]) == 1 and e.warm(["haz", "har"], deadline_s=0) == 0
    assert e.suggest("harbour", 2) == [{"word": "harbour", "source": "hot"}, {"word": "harbour master", "source": "hot"}]
    assert [x["word"] for x in e.suggest("harbor", fuzzy=True)][0] == "harbour"
    # The third request crosses; its own answer is still cold, the next one is hot, and harb leaves.
    assert [e.suggest("har")[0]["source"] for _ in range(3)] == ["cold", "cold", "hot"]
    assert [x[:2] for x in e.entries.newest_first()] == [("har", 4)] and not e.counters["harb"].promoted
    live = e.live_stats().first()
    assert (live.hot_words, live.hot_entries, live.cold_words, live.hits, live.misses) == (4, 1, 2, 3, 3)
    assert e.overview().first().keys > 3 and e.suggest_response("Hazel")["count"] == 1
    # Every request counts for usage, those without an answer too (one was before the upload); too short ones don't.
    assert e.flush_usage() == 7 and e.flush_usage() == 0
    assert rows(e.store.usage_hits()) == [("har", 7), ("haz", 1)]
    asked = spark.createDataFrame([("har",), ("har",), ("qq",), ("x",)], "query string")
    e.record_usage(asked, e.suggest_batch(asked))
    assert rows(e.store.usage_hits()) == [("har", 9), ("haz", 1), ("qq", 1)]
    # A warm restart takes the ledger over and loads what was promoted.
    demand.write_snapshot(e.ledger_state(), str(tmp_path / "ledger"), 1)
    f = Engine(spark, str(tmp_path / "root"), settings=e.settings)
    assert f.restart_warm(demand.read_snapshot(spark, str(tmp_path / "ledger"))) == 1 and f.suggest("harv")[0]["source"] == "hot"
    assert f.sweep() == 0 and f.health()["corpus_words"] == 6 and f.uptime_s() >= 0
    f.reload()
    assert f.suggest("harv")[0]["source"] == "cold"


def test_metrics(spark):
    log = spark.createDataFrame([("/a", 200, float(x), x) for x in range(1, 11)] + [("/a", 500, 100.0, 11), (None, 404, 1.0, 12), ("/health", 200, 1.0, 13)], "route string, status int, ms double, s int").withColumn("ts", F.timestamp_seconds("s"))
    o = metrics.observed(log)
    s = metrics.route_stats(o).join(metrics.route_percentiles(o), "route")
    a = s.where("route = '/a'").first()
    assert (a["count"], a.errors, a.min_ms, a.max_ms, a.p50, a.p95, a.p99) == (11, 1, 1.0, 100.0, 6.0, 100.0, 100.0)
    assert metrics.route_percentiles(o, ring=3).where("route = '/a'").first().p50 == 10.0
    assert rows(metrics.status_histogram(o)) == [("/a", 200, 10), ("/a", 500, 1), ("<not found>", 404, 1)]
    text = metrics.prometheus(s, statuses=metrics.status_histogram(o), uptime_s=9)
    for line in ('lexiduct_http_requests_total{route="/a"} 11', 'lexiduct_http_responses_total{route="/a",status="500"} 1', "# TYPE lexiduct_http_request_duration_ms summary", 'lexiduct_http_request_duration_ms{route="/a",quantile="0.5"} 6', 'lexiduct_http_request_duration_ms_sum{route="/a"} 155', 'lexiduct_http_request_duration_ms_count{route="/a"} 11', 'lexiduct_http_request_duration_ms_max{route="/a"} 100', "lexiduct_uptime_seconds 9"):
        assert line in text.splitlines()
    assert text.index('route="/a"') < text.index("<not found>")
    by = ("method", "route")
    m = o.withColumn("method", F.lit('G"T'))
    assert 'lexiduct_http_requests_total{method="G\\"T",route="/a"} 11' in metrics.prometheus(metrics.route_stats(m, by).join(metrics.route_percentiles(m, by=by), list(by)))
    r = metrics.latency_report(spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "ms double")).first()
    assert (r.n, r.mean_ms, r.p50, r.per_second) == (3, 2.0, 2.0, 500.0)
    assert metrics.snapshot_json(s.where("route = '/a'").select("route", "count")).first().json == '{"route":"/a","count":11}'
