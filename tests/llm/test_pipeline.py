import random
from collections import defaultdict

import corpus_pipeline as P
from lexiduct.llm.queries import tokenizer_path
from lexiduct.llm.bpe import encoder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def make(spark, tmp_path):
    rnd = random.Random(6)
    syl = {"en": "the of and ing ion er th in".split(), "fr": "le de et eau ou é re qu".split()}
    text = lambda lang, n: " ".join("".join(rnd.choice(syl[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        lang = rnd.choice(["en", "fr"])
        t, toxic = text(lang, rnd.randint(30, 80)), int(i % 8 == 3)
        if toxic:
            t += " scumbag you scumbag idiots"
        rows.append((i, t, lang))
        labels.append((i, 1, toxic))
    item = text("en", 30)
    near = rows[0][1].split()
    near[5] = "changed"
    rows += [(300, rows[0][1], "en"), (301, " ".join(near), "en"), (302, text("en", 10) + " " + item, "en"), (303, "12 34 !!", None), (304, None, None), (305, "", "en"), (306, rows[1][1], "fr"), (306, rows[1][1], "fr")]
    docs = [(d, t, lang, "src0", len(t or "")) for d, t, lang in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows


def test_stages_and_run(spark, tmp_path):
    rows = make(spark, tmp_path)
    assert [n for n, _ in P.STAGES] == ["language", "toxicity", "near_duplicates", "decontamination", "packing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == COLUMNS
        kept[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    clean = [i for i in range(240) if i % 8 != 3]
    assert kept["language"] == sorted([*range(240), 300, 301, 302, 306, 306])
    assert kept["toxicity"] == sorted([*clean, 300, 301, 302, 306, 306])
    assert kept["near_duplicates"] == sorted([*clean, 302]) and kept["decontamination"] == clean
    out = P.run(spark, str(tmp_path)).collect()
    by = defaultdict(int)
    for r in out:
        by[r.doc_id] += r.length
    text = {d: t for d, t, _ in rows}
    assert by == {i: len(encoder(tokenizer_path()).whole(text[i])) + 1 for i in clean}


def test_repeated_and_missing_ids(spark, tmp_path):
    rnd = random.Random(8)
    text = lambda n=30: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    a, b, c, d, e, item, other = (text() for _ in range(7))
    rows = [(5, a), (5, b), (5, b), (6, a), (None, b), (None, c), (None, c), (None, c + " end"), (7, d), (9, d.upper()), (7, d + " end"), (9, e)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    make = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], ", ".join(f"{n} {t}" for n, t in zip(COLUMNS, ["long", "string", "string", "string", "long"])))
    got = [(r.doc_id, r.text) for r in P.drop_near_duplicates(spark, P.written(make([*rows, (None, ""), (3, None)]), "t"), str(tmp_path)).collect()]
    assert len(got) == 7 and {(5, a), (5, b), (9, e), (None, ""), (3, None)} <= set(got)
    assert len({(None, c), (None, c + " end")} & set(got)) == 1 and len({(7, d), (7, d + " end")} & set(got)) == 1
    left = P.drop_contaminated(spark, make([(5, item), (5, other), (None, item), (None, a), (8, None)]), str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(5, other), (None, a), (8, None)], key=str)


def test_empty_tables(spark, tmp_path):
    make(spark, tmp_path / "full")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/full/{t}.parquet").where("false").write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert P.run(spark, f"{tmp_path}/none").collect() == []
