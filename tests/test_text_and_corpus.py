import json
import random
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from lexiduct.config import Settings
from lexiduct.functions import text as T
from lexiduct.operators import corpus as C
from lexiduct.operators import match
from lexiduct.sources import readers

KEEP = ["oak", "north-west wind", "mr. ferryman", "o'hara's boat", "route 66b", "3 rivers", "a+b", "salt & rye", "lake.company", "x\x7fy", "水車", "ñandú", "v.coma", "wwwild"]
REJECT = ["", "20 41", "7/8", "...", "mill.com", "old mill.net9 here", "go to HTTP://a b", "WWW.lake", "a\\u00e9b", "tab\there", "nul\x00", "ferry.io日", "x.IN", "q.co"]


def norm(spark, *xs):
    return [r.w for r in spark.createDataFrame(list(enumerate(xs)), "i int, v string").orderBy("i").select(T.normalise("v").alias("w")).collect()]


def test_accept_policy(spark):
    df = spark.createDataFrame([(w,) for w in KEEP + REJECT], "word string").select("word", T.accept("word").alias("ok"))
    got = dict(df.collect())
    assert [w for w in KEEP if not got[w]] == [] and [w for w in REJECT if got[w]] == []


def test_normalise_cases(spark):
    assert norm(spark, "  Été\t", "が", "İ", "ΑΣ", "ß", "ø", "\xa0a  b　", None, "", "K") == ["ete", "か", "i", "ασ", "ß", "ø", "a  b", "", "", "k"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", max_codepoint=0x24F, categories=["L", "N", "P", "Zs", "Mn"]), max_size=8), min_size=20, max_size=40))
def test_normalise_against_unicodedata(spark, xs):
    def plain(s):
        t = unicodedata.normalize("NFD", s.strip())
        t = unicodedata.normalize("NFC", "".join(c for c in t if unicodedata.category(c) != "Mn"))
        return "".join(c.lower() if len(c.lower()) == 1 else c for c in t)

    assert norm(spark, *xs) == [plain(x) for x in xs]


def test_small_functions(spark):
    one = spark.createDataFrame([("abcdef", "v12", "GET /a b", "7")], "a string, v string, k string, n string")
    m, r = T.route_key_parts(F.col("k"))
    got = one.select(T.bucket("a", 3), T.edit_budget(F.col("a")), T.version_number(F.col("v")), m, r, T.parse_int(F.col("n"), 3, 1, 5), T.round3(F.lit(1.0005))).first()
    assert tuple(got) == ("abc", 2, 12, "GET", "/a b", 5, 1.001)
    assert [T.clamp_limit(x) for x in (None, 0, -1, 5, 500)] == [10, 10, 10, 5, 100]
    with pytest.raises(ValueError):
        T.edit_budget(F.col("a"), {3: 1})


def test_build_sorts_dedups_and_counts(spark, words):
    raw = words("Willow", "elm", "ELM ", "sãmbu", "Sambu", "larch", "\t", "", "12 34", "elder", "beech.com", "larch", None, col="value")
    c = C.build_corpus(raw)
    assert [r.word for r in c.orderBy("word").collect()] == ["elder", "elm", "larch", "sambu", "willow"]
    assert tuple(C.ingest_counts(raw).first()) == (13, 5, 5)
    assert [r.word for r in match.prefix_search(c, "el", 100).collect()] == ["elder", "elm"]
    assert [r.word for r in match.prefix_search(c, "l", 100).collect()] == ["larch"]
    assert match.prefix_search(c, "yew").collect() == []
    assert rows(C.build_corpus(raw, words("elm", "willow")).where("word < 'm'")) == [("elder",), ("larch",)]
    assert tuple(C.ingest_counts(raw.where("false")).first()) == (0, 0, 0)
    assert C.build_corpus(raw.where("false")).collect() == []


def test_corpus_normalises_once(words):
    # The trimming pattern stands once in the plan: a pushed-down filter would repeat it.
    plan = C.build_corpus(words("a", col="value"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= plan.count("Project [") * 8 and "Filter (isnotnull(value" not in plan
    above = [line for line in plan.splitlines() if "Filter" in line]
    assert all("regexp_replace" not in line for line in above)


def test_limit_and_index(spark, words):
    rnd = random.Random(1)
    ws = sorted({"".join(rnd.choice("kmnoprst") for _ in range(rnd.randint(1, 5))) for _ in range(700)} | {"ää", "日月"}, key=str.encode)
    c = words(*rnd.sample(ws, len(ws)))
    assert [r.word for r in match.prefix_search(c, "k", 10).collect()] == [w for w in ws if w[0] == "k"][:10]
    off, want = 0, []
    for i, w in enumerate(ws):
        if i % 16 == 0:
            want.append((w, off))
        off += len(w.encode()) + 1
    ix = C.skip_index(c, 16)
    assert sorted(rows(ix), key=lambda r: r[0].encode()) == want
    assert [tuple(r) for r in C.positions(c).orderBy("line").collect()][-1][:2] == (ws[-1], len(ws) - 1)
    qs = ["a", "kmn", "k", "zzz", "ro", "0", "日", "日月", "𝄞", *rnd.sample(ws, 30)]
    for anchors, known in ((ix, want), (ix.where("false"), [])):
        seek = C.index_seek(words(*qs, *qs, None, col="query"), anchors)
        got = {r.query: (r.anchor, r.offset) for r in seek.collect()}
        assert len(got) == len(set(qs))
        for q in qs:
            fits = [a for a in known if a[0].encode() <= q.encode()]
            assert got[q] == (fits[-1] if fits else (None, 0))
    plan = C.index_seek(words(*qs, col="query"), ix)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert C.skip_index(c.where("false")).collect() == []


def test_sql_functions(spark):
    from lexiduct.functions import sql

    assert sql.register(spark) == sql.NAMES
    for x in ["  Été\t", "が", "İ", "ΑΣ", "it's \\ odd", "ǖ", "", "ﬁ"]:
        df = spark.createDataFrame([(x,)], "v string")
        df.createOrReplaceTempView("terms")
        got = spark.sql("SELECT lexi_normalise(v), lexi_accept(lexi_normalise(v)), lexi_bucket(v, 2), lexi_edit_budget(v) FROM terms").first()
        want = df.select(T.normalise("v"), T.accept(T.normalise("v")), T.bucket("v", 2), T.edit_budget(F.col("v"))).first()
        assert tuple(got) == tuple(want), x


def test_command_line(spark, tmp_path, capsys):
    from lexiduct.__main__ import main
    from lexiduct.sources.store import Store

    (tmp_path / "a.json").write_text(json.dumps([f"{a}{b}" for a in "pqrs" for b in "lmno"] + ["12", None]))
    run = lambda *more: main(["bootstrap", "--root", str(tmp_path / "root"), "--source", str(tmp_path / "a.json"), *more])
    told = lambda: json.loads(capsys.readouterr().out.splitlines()[-1])
    assert run("--stride", "5") == 0
    first = told()
    assert (first["version"], first["word_count"], first["parent_version"], first["mode"], first["anchors"]) == ("v1", 16, "", "bootstrap", 4)
    run("--mode", "replace")
    second = told()
    assert (second["version"], second["parent_version"], second["mode"], second["anchors"]) == ("v2", "v1", "replace", 1)
    run("--version", "v7", "--parent", "v2", "--stride", "0")
    assert told()["parent_version"] == "v2"
    with pytest.raises(FileExistsError):
        run("--version", "v7")
    s = Store(spark, str(tmp_path / "root"))
    assert s.current() == "v1" and rows(s.skip_index("v1"), "word") == [("pl",), ("qm",), ("rn",), ("so",)]
    with pytest.raises(FileNotFoundError):
        s.skip_index("v7")
    s.export_text(str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines() == sorted(text.splitlines()) and len(text.splitlines()) == 16


def test_json_sources(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps(["x", None, "é"]))
    assert rows(readers.read_json_array(spark, str(p))) == [("",), ("x",), ("é",)]
    for bad in ('{"a": 1}', '["a", 1]', "[1", '"a"'):
        p.write_text(bad)
        with pytest.raises(Exception, match="array of strings"):
            readers.read_json_array(spark, str(p)).collect()
    p.write_text("[]")
    assert readers.read_json_array(spark, str(p)).collect() == []
    p.write_text('"a"\n\n"b c"\n')
    assert rows(readers.read_json_lines(spark, str(p))) == [("a",), ("b c",)]


def test_csv_and_lists(spark, tmp_path, words):
    p = tmp_path / "a.csv"
    p.write_text("﻿id, Name ,x\n1, Apple ,2\n2,\n3,apple\n4,\"Pear, green\",1,2,3\n")
    assert rows(readers.read_csv_column(spark, str(p), "NAME")) == [("Apple",), ("Pear, green",), ("apple",)]
    assert rows(readers.csv_terms(spark, str(p), "name", words("apple"))) == [("Pear, green",)]
    with pytest.raises(ValueError, match="available: id, Name, x"):
        readers.read_csv_column(spark, str(p), "nope")
    p.write_bytes("a \r\n b\n\nc\r\r\n d\re".encode())
    assert [r.value for r in readers.read_lines(spark, str(p)).collect()] == ["a ", " b", "", "c", " d\re"]
    p.write_text("# note\n\nMar\n  ÉTÉ \n")
    assert rows(readers.read_pinned(spark, str(p))) == [("ete",), ("mar",)]
    p.write_text("B\nb\n\nÁ\n")
    assert rows(readers.read_blacklist(spark, str(p))) == [("a",), ("b",)]


def test_settings():
    assert Settings().word_cap == 100_000 and Settings(min_query_len=0).min_query_len == 1
    assert Settings.from_env({"LEXIDUCT_USAGE_DEPTH": "4", "LEXIDUCT_USAGE_ENABLED": "no", "LEXIDUCT_WORD_CAP": "x"}) == Settings(usage_depth=4, usage_enabled=False)
    for bad in ({"word_cap": 1}, {"usage_depth": 9}, {"versions_kept": 0}, {"max_query_latency_ms": 1}):
        with pytest.raises(ValueError):
            Settings(**bad)
