"""The registered queries as wholes, against rules written down anew: folds, inputs, rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lexiduct.llm import queries as Q

SYL = {"en": "the of and ing ion er th in".split(), "fr": "le de et eau ou é re qu".split()}


def remainder(doc_id, k):
    return zlib.crc32(str(doc_id).encode()) % k


def words(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYL[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def documents(seed=11, n=260):
    """(doc_id, text, lang, quality, toxic): junk lines are bad, insults are toxic."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        lang = rnd.choice(["en", "fr"])
        lines = [words(rnd, lang, 9).capitalize() + "." for _ in range(rnd.randint(2, 6))]
        good, toxic = int(i % 3 > 0), int(i % 5 == 1)
        if not good:
            lines = [" | ".join(words(rnd, lang, 5).split()) + " $$$ ###" for _ in lines]
        if toxic:
            lines.append("you miserable blockhead, blockheads all")
        out.append((i, "\n".join(lines), lang, good, toxic))
    return out


#: Rows that the contract must hold for as well: (doc_id, text, lang).
ODD = [(5, None, "en"), (5, "", None), (None, "le eau de qu ou re", "fr"), (None, None, None), (9001, " \n\t", "fr"), (9002, "12 34 !?", None), (9003, "the of and ing " * 30_000, None)]


def store(spark, path, docs, odd=ODD):
    rows = [(d, t, lang) for d, t, lang, _, _ in docs] + odd
    table = [(d, t, lang, "src", len(t or ""), "clash", 1.0) for d, t, lang in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, q, x) for d, _, _, q, x in docs] + [(None, 1, 1), (77_777, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def run(query, spark, path):
    got = defaultdict(list)
    for r in query(spark, str(path)).collect():
        got[r.doc_id].append(r)
    return got


@pytest.mark.parametrize("query,k,out_fold,place", [(Q.op1_quality_crf, 5, 0, 3), (Q.op4_toxicity_fm, 4, 2, 4)])
def test_scores_learn_only_outside_the_held_out_fold(spark, tmp_path, query, k, out_fold, place):
    docs = documents()
    rows = store(spark, tmp_path / "a", docs)
    got = run(query, spark, tmp_path / "a")
    assert query(spark, str(tmp_path / "a")).columns == ["doc_id", "held_out", "score", "predicted"]
    assert sum(map(len, got.values())) == len(rows) and len(got[5]) == 3 and len(got[None]) == 2
    for d, rs in got.items():
        for r in rs:
            assert r.held_out == (d is not None and remainder(d, k) == out_fold) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [d for d in docs if remainder(d[0], k) == out_fold and d[0] != 5]
    assert len(held) > 30 and np.mean([got[d[0]][0].predicted == d[place] for d in held]) > 0.95
    # Labels, ids' languages and sources inside the fold change nothing; those outside do.
    flip = lambda pick: [(d, t, "en", *((1 - q, 1 - x) if pick(d) else (q, x))) for d, t, _, q, x in docs]
    store(spark, tmp_path / "b", flip(lambda d: remainder(d, k) == out_fold))
    same = run(query, spark, tmp_path / "b")
    assert all(sorted(r.score for r in same[d]) == pytest.approx(sorted(r.score for r in got[d]), abs=1e-12) for d in got)
    store(spark, tmp_path / "c", flip(lambda d: remainder(d, k) != out_fold))
    turned = run(query, spark, tmp_path / "c")
    assert np.mean([turned[d[0]][0].predicted == d[place] for d in held]) < 0.2
    # A text's score is its own: equal texts score alike wherever they stand.
    texts = {d: t for d, t, *_ in docs}
    twins = [(100_000 + i, texts[i], "fr", 0, 0) for i in (1, 2, 3, 6)]
    store(spark, tmp_path / "d", docs, ODD + [t[:3] for t in twins])
    more = run(query, spark, tmp_path / "d")
    assert all(more[t[0]][0].score == pytest.approx(got[t[0] - 100_000][0].score, abs=1e-9) for t in twins)


def test_languages_learn_only_outside_the_held_out_fold(spark, tmp_path):
    docs = documents(12)
    rows = store(spark, tmp_path / "a", docs)
    got = run(Q.op2_language_id, spark, tmp_path / "a")
    assert Q.op2_language_id(spark, str(tmp_path / "a")).columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert sum(map(len, got.values())) == len(rows)
    for d, rs in got.items():
        assert all(r.held_out == (d is not None and remainder(d, 3) == 1) and 0 <= r.score <= 1 for r in rs)
    assert sorted(r.lang_pred for r in got[5])[-2:] == ["und", "und"] and {r.lang_pred for r in got[None]} == {"fr", "und"}
    assert got[9001][0].lang_pred == got[9002][0].lang_pred == "und" and got[9003][0].lang_pred == "en"
    held = [d for d in docs if remainder(d[0], 3) == 1 and d[0] != 5]
    assert len(held) > 50 and all(got[d[0]][0].lang_pred == d[2] for d in held)
    swap = lambda pick: [(d, t, {"en": "fr", "fr": "en"}[lang] if pick(d) else lang, q, x) for d, t, lang, q, x in docs]
    store(spark, tmp_path / "b", swap(lambda d: remainder(d, 3) == 1))
    same = run(Q.op2_language_id, spark, tmp_path / "b")
    assert all(sorted((r.lang_pred, r.score) for r in same[d]) == sorted((r.lang_pred, r.score) for r in got[d]) for d in got)
    store(spark, tmp_path / "c", swap(lambda d: remainder(d, 3) != 1))
    turned = run(Q.op2_language_id, spark, tmp_path / "c")
    assert all(turned[d[0]][0].lang_pred != d[2] for d in held)


def test_empty_tables_of_scoring_queries(spark, tmp_path):
    store(spark, tmp_path / "a", documents(n=10))
    for t in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/a/{t}.parquet").where("false").write.parquet(f"{tmp_path}/none/{t}.parquet")
    spark.read.parquet(f"{tmp_path}/a/documents.parquet").write.parquet(f"{tmp_path}/bare/documents.parquet")
    spark.read.parquet(f"{tmp_path}/none/labels.parquet").write.parquet(f"{tmp_path}/bare/labels.parquet")
    for query in (Q.op1_quality_crf, Q.op2_language_id, Q.op4_toxicity_fm):
        assert query(spark, f"{tmp_path}/none").collect() == []
        assert query(spark, f"{tmp_path}/bare").count() == 10 + len(ODD)  # documents without any label


def library_ids(text):
    from tokenizers import Tokenizer

    global _lib
    if _lib is None:
        _lib = Tokenizer.from_file(Q.tokenizer_path())
    return [*_lib.encode(text or "", add_special_tokens=False).ids, 1]


_lib = None


def token_crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_of_the_whole_query(spark, tmp_path):
    docs = documents(13, 40)
    rows = store(spark, tmp_path, docs, [o for o in ODD if o[0] != 5])
    got = Q.op7_token_ids(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {d: library_ids(t) for d, t, _ in rows if d is not None}
    before = sum(len(library_ids(t)) for d, t, _ in rows if d is None)  # null ids come first
    for d in sorted(by):
        r = next(r for r in got if r.doc_id == d)
        assert (r.start, r.n_tokens, r.ids_crc32) == (before, len(by[d]), token_crc(by[d]))
        before += len(by[d])


def test_packing_of_the_whole_query(spark, tmp_path):
    docs = documents(14, 60)
    rows = store(spark, tmp_path, docs, [o for o in ODD if o[0] != 5])
    got = Q.op8_best_fit_packing(spark, str(tmp_path)).collect()
    want = defaultdict(list)
    for d, t, _ in rows:
        ids = library_ids(t)
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[d].append((k, at, len(ids[at : at + 4096]), token_crc(ids[at : at + 4096])))
    have = defaultdict(list)
    sequences = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {d: sorted(v) for d, v in have.items()} == {d: sorted(v) for d, v in want.items()} and len(want[9003]) > 1
    for s in sequences.values():
        end = 0
        for offset, n in sorted(s):
            assert offset == end
            end += n
        assert end <= 4096
    tokens = sum(n for v in want.values() for _, _, n, _ in v)
    assert len(sequences) == -(-tokens // 4096) or len(sequences) <= -(-tokens // 4096) + 1


def test_pages_of_the_whole_query(spark, tmp_path):
    html = "<nav><li><a href=a>Home</a></li></nav><div class='ad'>Buy it.</div><article><h1>T &amp; U</h1><p>One   two.</p><p>So.</p></article><footer>(c)</footer>"
    pages = [(1, "u", html), (2, None, None), (2, "v", html), (None, "w", html), (3, "x", ""), (4, "y", "<p>" + "word " * 100_000)]
    spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in Q.op5_html_extraction(spark, str(tmp_path)).collect()), key=str)
    main = "T & U\nOne two.\nSo."
    long = ("word " * 100_000).strip()
    assert got == sorted([(1, "u", main, len(main)), (2, None, "", 0), (2, "v", main, len(main)), (None, "w", main, len(main)), (3, "x", "", 0), (4, "y", long, len(long))], key=str)
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in Q.op9_warc_normaliser(spark, str(tmp_path)).collect()), key=str)
    # A page without an id neither revisits nor is revisited; page 2 holds two payloads.
    assert kinds == sorted([(1, "response", None), (2, "response", None), (2, "revisit", 1), (None, "response", None), (3, "revisit", 2), (4, "response", None)], key=str)
