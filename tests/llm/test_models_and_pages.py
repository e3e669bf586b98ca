import base64
import gzip
import hashlib
import io
import json
import random
import zlib

import numpy as np
import pyarrow.compute as pc
import pytest

from lexiduct.llm import extract, langid, quality, toxicity, warc
from lexiduct.llm.shared import labelled_sample

TOY = {"en": "the of and ing ion er th in".split(), "fr": "le de et eau ou é re qu".split(), "de": "der und sch ung ei ü ich".split()}


def toy_text(rnd, lang, n):
    return " ".join("".join(rnd.choice(TOY[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def test_language_id(spark):
    rnd = random.Random(0)
    docs = [(i, toy_text(rnd, lang := rnd.choice(sorted(TOY)), rnd.randint(5, 60)), lang, "x") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score string").repartition(3)
    m = langid.fit_language_model(df.where("doc_id < 150").unionByName(spark.createDataFrame([(1, None, "en", ""), (2, "x", None, "")], df.schema)))
    assert m.langs == ["de", "en", "fr"]
    odd = spark.createDataFrame([(-1, None, None, ""), (-2, "", None, ""), (-3, "123 !? \n", None, ""), (-4, "x" * 300_000, None, "")], df.schema)
    got = {r.doc_id: r for r in langid.identify_languages(df.unionByName(odd), m).collect()}
    assert sum(got[d].lang_pred == lang for d, _, lang, _ in docs if d >= 150) >= 148
    assert all((got[d].lang_pred, got[d].score) == ("und", 0.0) for d in (-1, -2, -3)) and got[-4].lang_pred in m.langs
    assert all(0 <= r.score <= 1 for r in got.values())
    # A text's answer doesn't depend on its neighbours.
    assert m.score([docs[0][1]])[1][0] == pytest.approx(m.score([d[1] for d in docs])[1][0])
    # Brute force: counts of one text's n-grams times the matrix.
    text = docs[3][1]
    lone = sum(m.logp[idx].astype(np.float64).sum(axis=0) for _, _, feats, _ in langid.ngram_groups([text]) for idx, _ in feats)
    assert m.langs[int((lone + m.prior).argmax())] == m.score([text])[0][0]
    assert langid.fit_language_model(df.where("false")).score(["abc"])[0] == ["und"]
    assert langid.identify_languages(df.where("false"), m).collect() == []


def test_factorization_machine(spark):
    rnd = random.Random(1)
    words = ["w%d" % i for i in range(300)]
    docs = []
    for i in range(900):
        w = [rnd.choice(words) for _ in range(rnd.randint(5, 40))]
        kind = rnd.choice(["none", "insult", "group", "both"])
        if kind in ("insult", "both"):
            w.insert(rnd.randrange(len(w)), "scoundrel")
        if kind in ("group", "both"):
            w.insert(rnd.randrange(len(w)), "Martians")
        docs.append((i, " ".join(w), int(kind == "both"), "x"))
    df = spark.createDataFrame(docs, "doc_id long, text string, label int, score string")
    fm = toxicity.fit_toxicity(df, df.where("doc_id < 600"), epochs=300)
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, fm).collect()}
    # Neither word alone is toxic: the pair is learned.
    held = [d for d in docs if d[0] >= 600]
    assert np.mean([got[d[0]].predicted == d[2] for d in held]) > 0.97
    odd = spark.createDataFrame([(-1, None, 0, ""), (-2, "", 0, ""), (-3, "é", 0, "")], df.schema)
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(odd, fm).collect())
    assert toxicity.score_toxicity(odd, toxicity.fit_toxicity(df, df.where("false"))).count() == 3
    # The sums over pairs agree with the plain double loop.
    x = np.array([0, 1, 2])
    v = np.random.default_rng(0).normal(size=(3, 4))
    m = toxicity.FactorizationMachine(np.arange(3), 0.5, np.array([1.0, 2, 3]), v)
    assert m.logits(x, np.array([0, 3]))[0] == pytest.approx(6.5 + sum(v[i] @ v[j] for i in range(3) for j in range(i)))


def test_sample_is_bounded_where_ids_repeat(spark):
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, label int")
    plain = [(i, f"text {i}") for i in range(40)]
    once, rates = labelled_sample(spark.createDataFrame(plain, "doc_id long, text string"), labels, 50, 100)
    assert once.num_rows == 40 and rates == {0: 1.0, 1: 1.0}
    # Repeated rows count once, and many texts of one id don't outgrow the bound.
    odd = plain * 30 + [(0, f"another {i}") for i in range(2000)] + [(1, None), (2, "x" * 101), (None, "y")]
    got, rates = labelled_sample(spark.createDataFrame(odd, "doc_id long, text string").repartition(5), labels, 50, 100)
    n = dict(zip(*np.unique(got["label"].to_numpy(), return_counts=True)))
    assert n[0] == 30 and 10 <= n[1] <= 100 and rates[0] == 1.0 and rates[1] == pytest.approx(50 / 2010)
    assert set(got.filter(pc.equal(got["label"], 0))["text"].to_pylist()) == {t for i, t in plain if i % 4}


def test_forward_backward_against_brute_force():
    rng = np.random.default_rng(3)
    n = [3, 0, 1, 5]
    bounds = np.concatenate([[0], np.cumsum(n)])
    emit, move = rng.normal(size=(bounds[-1], 2)), rng.normal(size=(2, 2))
    marg, pair, _ = quality.forward_backward(emit, move, bounds)
    want_pair = np.zeros((2, 2))
    for a, z in zip(bounds[:-1], bounds[1:]):
        k = z - a
        total, good, moves = 0.0, np.zeros(k), np.zeros((2, 2))
        for code in range(2**k if k else 0):
            y = [(code >> i) & 1 for i in range(k)]
            p = np.exp(sum(emit[a + i, y[i]] for i in range(k)) + sum(move[y[i], y[i + 1]] for i in range(k - 1)))
            total += p
            good += p * np.array(y)
            for i in range(k - 1):
                moves[y[i], y[i + 1]] += p
        if k:
            assert np.allclose(marg[a:z, 1], good / total)
            want_pair += moves / total
    assert np.allclose(pair, want_pair)


def test_quality(spark):
    rnd = random.Random(2)
    line = lambda: " ".join(toy_text(rnd, "en", 8).split()).capitalize() + "."
    junk = lambda: rnd.choice([lambda: " | ".join(toy_text(rnd, "en", 6).split()), lambda: "buy " * 12, lambda: "$$$ ### @@@ !!!"])()
    docs = [(i, "\n".join((junk if bad else line)() for _ in range(rnd.randint(1, 20))), 1 - bad, "x") for i in range(400) for bad in [rnd.randint(0, 1)]]
    df = spark.createDataFrame(docs, "doc_id long, text string, label int, predicted string")
    field = quality.fit_quality(df, df.where("doc_id < 250"))
    got = {r.doc_id: r for r in quality.score_quality(df, field).collect()}
    assert np.mean([got[d[0]].predicted == d[2] for d in docs if d[0] >= 250]) > 0.97
    odd = spark.createDataFrame([(-1, None, 0, ""), (-2, "", 0, ""), (-3, "\n \n", 0, ""), (-4, "a\n" * 50_000, 0, "")], df.schema)
    low = quality.score_quality(odd, field).collect()
    assert all(0 <= r.score <= 1 for r in low) and low[0].score == low[1].score
    lines = quality.line_labels(df.where("doc_id = 0"), field).collect()
    assert len(lines) == docs[0][1].count("\n") + 1 and all(0 <= r.good <= 1 for r in lines)
    assert quality.score_quality(odd, quality.fit_quality(df, df.where("false"))).count() == 4


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy it.</div>
<article><h1>Head &amp; line</h1><p><b>First   one.<br><p>Second&nbsp;<i>bold</i> <a href=x>link</a>.</p><p>Ok.</p>
<div class="newsletter"><form><p>Sign up for all of our news.</p></form></div><script>x</script></article>
<div class="cookie-notice">We use cookies.</div><aside><p>Most read of this week.</p></aside>
<section id="comments"><p>I like this article very much, thank you for it.</p></section><footer>&copy; x</footer></body></html>"""


def test_extraction(spark):
    x, y = extract.labelled_table()
    assert (extract.decide(extract.train_tree(), x) == y).mean() > 0.98
    want = "Head & line\nFirst one.\nSecond bold link.\nOk."
    pages = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<p>" + "long words here " * 30_000), (5, "u", "<nav>x"), (6, "u", "<article><p>A < B &lt; C</p><p>a<!-- open"), (7, "u", "<script>never closed <p>x</p>")]
    got = {r.page_id: r for r in extract.extract_text(spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")).collect()}
    assert got[1].text == want and got[1].n_chars == len(want)
    assert got[2].text == got[3].text == got[5].text == got[7].text == ""
    assert got[4].n_chars == len("long words here " * 30_000) - 1 and got[6].text.startswith("A < B < C")


#: Pages of generic markup, no element or class of which tells main text from the rest; + marks it.
GENERIC = """
<div><div><a href=1>-Start</a></div><div><a href=2>-World</a> <a href=3>Sport</a></div><div><a href=4>-Money</a></div></div>
<div><h2>+The bakery on the corner of our street has closed for good after ninety years of early mornings, warm bread and long queues on Sundays in winter</h2>
<p>+For as long as anybody here can remember the shop opened at five, and the first to come in were the drivers of the trams from the depot across the road.</p><p>+Not any more.</p>
<p>+The owner says that flour, gas and rent cost twice what they did, that no young baker wants to get up at two, and that <a href=5>the big stores</a> sell rolls for less than he pays for the dough.</p></div>
<div><div><a href=6>-Ten cakes for spring</a></div><div><a href=7>-Who bakes best in town</a></div><div>-Imprint</div></div>
""", """
<table><tr><td><a href=1>-News</a></td><td><a href=2>-Shop</a></td><td>-Menu</td></tr></table>
<div><p>+When the last of the snow had gone we walked up to the hut, found the door open and a note on the table that asked us to close it behind us when we left.</p>
<p>+We did so.</p><p>+Nobody ever told us who had written it, though we asked in the village, at the inn and at the small station where the path begins.</p></div>
<p><a href=3>-Older</a> <a href=4>Newer</a></p><p>-All rights reserved</p>
"""


def test_the_tree_goes_by_words_and_links_of_a_block_and_its_neighbours():
    tree = extract.train_tree()
    used, todo = set(), [tree]
    while todo:
        n = todo.pop()
        if n.low is not None:
            used.add(extract.FEATURES[n.feature])
            todo += [n.low, n.high]
    assert {"words", "link_density", "prev_words", "next_words", "next_link_density"} <= used
    assert extract.FEATURES[tree.feature] not in ("boiler", "comment", "main_name")  # no list of names comes first
    right, blind, alone = [], [], []
    for page in GENERIC:
        found = extract.blocks_of(page)
        want = [b.text[0] == "+" for b in found]
        x = extract.features(found)
        right += list(extract.decide(tree, x) == want)
        for columns, out in ((slice(0, 6), blind), (slice(2, 6), alone)):
            z = x.copy()
            z[:, columns] = 0
            out += list(extract.decide(tree, z) == want)
    assert all(right) and np.mean(blind) < 0.7 and sum(alone) < len(alone)
    # The same holds for pages in the table's own manner that the tree hasn't seen.
    seen = len(extract.labelled_pages())
    later = [extract.labelled_pages(extract.VARIANTS + 3)[i] for i in range(0, seen, 7)]
    hits = [ok for page, want in later for ok in extract.decide(tree, extract.features(extract.blocks_of(page))) == want]
    assert np.mean(hits) > 0.95


def test_names_behind_any_white_space():
    for gap in (" ", "\n", "\t", "\r\n", "\f"):
        ad, note, plain = extract.blocks_of(f'<div{gap}class="sidebar">Buy it.</div><div{gap}id="comments">I like it.</div><div>Text.</div>')
        assert (ad.boiler, note.comment, plain.boiler, plain.comment) == (True, True, False, False)


def test_warc_round_trip(spark, tmp_path):
    rnd = random.Random(4)
    pages = [(i, f"http://x/{i}", rnd.choice([None, "", "same", "é" * 500, "<p>%d</p>" % i, "\r\n\r\nContent-Length: 3\r\n\r\n"]), "x") for i in rnd.sample(range(500), 80)] + [(900, None, "big " * 200_000, "x"), (901, "a b\r\nX: y", "tail", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, sha string").repartition(3)
    got = {r.page_id: r for r in warc.archive_digest(spark, df).collect()}
    first: dict[str, int] = {}
    for p, _, h, _ in sorted(pages):
        first.setdefault(h or "", p)
    assert len(got) == len(pages)
    for p, _, h, _ in pages:
        raw = (h or "").encode()
        f = first[h or ""]
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if f == p else "revisit", None if f == p else f)
        assert tuple(got[p])[1:] == want
    assert warc.archive_digest(spark, df.where("false")).collect() == []
    twice = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (2, "u", "a")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.record_type) for r in warc.archive_digest(spark, twice).collect()) == [(1, "response"), (1, "response"), (2, "revisit")]


def test_normaliser_members_and_index():
    records = [warc.record("response", f"urn:page:{i}", "http://x", b"x" * n, warc.payload_digest(b"x" * n), {}) for i, n in enumerate((0, 5, 700_000))]
    for whole in (gzip.compress(b"".join(records)), b"".join(gzip.compress(r) for r in records)):
        out, index = io.BytesIO(), io.StringIO()
        assert warc.normalise_file(io.BytesIO(whole), out, index) == 3
        for r, line in zip(records, index.getvalue().splitlines(), strict=True):
            p = json.loads(line)
            assert zlib.decompress(out.getvalue()[p["offset"] : p["offset"] + p["length"]], 31) == r
        assert gzip.decompress(out.getvalue()) == b"".join(records)
    with pytest.raises(ValueError, match="within a record"):
        list(warc.inflated_records(io.BytesIO(gzip.compress(b"".join(records)[:-9]))))
