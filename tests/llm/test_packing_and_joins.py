import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiduct.llm import decontam, jaccard, neardup, packing
from lexiduct.llm.queries import tokenizer_path


@pytest.mark.parametrize("seed", range(3))
def test_evolve_keeps_every_item_once(seed):
    rnd = random.Random(seed)
    lens = [rnd.choice([rnd.randint(1, 99), rnd.randint(30, 60)]) for _ in range(120)]
    bins, _ = packing.evolve(lens, 100, [], seed, 6, 12)
    fill = defaultdict(int)
    for n, b in zip(lens, bins, strict=True):
        fill[b] += n
    assert max(fill.values()) <= 100
    a, b = packing.build(lens, 100, [], range(120)), packing.build(lens, 100, [], sorted(range(120), key=lambda i: -lens[i]))
    child = packing.mutate(packing.crossover(a, b, rnd), rnd)
    assert sorted(i for x in child.bins for i in x) == list(range(120)) and min(child.room) >= 0
    # An elite is the least that comes back.
    assert max(packing.evolve(lens, 100, [bins], seed + 9, 6, 3)[0]) <= max(bins)


def triplets(n, cap, seed):
    """Lengths of which three each fill n sequences to the last token, and no other way is easy."""
    rnd, out = random.Random(seed), []
    for _ in range(n):
        a = rnd.randint(cap * 38 // 100, cap * 49 // 100)
        b = rnd.randint((cap - a) * 42 // 100, (cap - a) // 2)
        out += [a, b, cap - a - b]
    rnd.shuffle(out)
    return out


def longest_first(lens, cap):
    return len(packing.build(lens, cap, [], sorted(range(len(lens)), key=lambda i: -lens[i])).bins)


def test_crossover_and_migration_beat_best_fit_on_hard_lengths():
    better = 0
    for seed in range(4):
        lens = triplets(100, 1000, seed)
        a, made = packing.evolve(lens, 1000, [], seed, 8, 40)
        b, _ = packing.evolve(lens, 1000, [], seed + 50, 8, 40)
        both, _ = packing.evolve(lens, 1000, [a, b], seed + 90, 8, 40)  # an island that got its neighbour's elite
        none, idle = packing.evolve(lens, 1000, [], seed, 8, 0)
        assert idle == 0 and made == 40 and longest_first(lens, 1000) >= 110 and max(none) + 1 >= 108
        assert max(a) + 1 <= 104 and max(both) <= min(max(a), max(b))
        better += max(both) < max(a) or max(both) < max(b)
    assert better


def test_islands_evolve_and_migrate_on_spark(spark, monkeypatch):
    lens, cap, states, write = triplets(300, 1000, 5), 1000, [], packing.written

    def kept(df, tag):
        out = write(df, tag)
        if tag == "island":
            states.append(out)
        return out

    monkeypatch.setattr(packing, "written", kept)
    pieces = write(spark.createDataFrame(list(enumerate(lens)), "doc_id long, length long"), "t")
    got = packing.pack(pieces, cap, problem_items=900)
    n = got.select("sequence_id").distinct().count()
    assert 300 <= n <= 306 and longest_first(lens, cap) >= 330
    assert len(states) == 2 and states[0].agg(F.min("crossovers")).first()[0] == 40 and states[1].agg(F.sum("crossovers")).first()[0] > 0
    first, last = (min(r.bins for r in s.collect()) for s in states)
    assert last <= first  # elites are never lost on their way


def test_packed_documents(spark):
    rnd = random.Random(2)
    docs = [(i, rnd.choice([None, "", "a b c " * rnd.randint(1, 60), "word " * 700]), "s") for i in range(200)] + [(7, "same", "s"), (7, "same", "s"), (None, "no id", "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, offset string")
    got = packing.pack(packing.written(packing.token_pieces(df, tokenizer_path(), 256), "t"), 256, problem_items=40).collect()
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
        assert 1 <= r.length <= 256
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 256
    lens = sorted((r.length for r in got), reverse=True)
    assert len(seqs) <= len(packing.build(lens, 256, [], range(len(lens))).bins) + 2  # best fit of all at once
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for d, rs in by.items():
        if d != 7 and d is not None:
            rs.sort(key=lambda r: r.piece)
            assert [r.piece for r in rs] == list(range(len(rs))) and all(r.length == 256 for r in rs[:-1])
    assert len(by[7]) == 3 or sum(r.length for r in by[7]) > 0
    assert packing.packed_documents(df.where("false"), tokenizer_path()).collect() == []


@pytest.mark.parametrize("n,tiny,cap", [(2001, 1, 4096), (5000, 1, 4096), (100_000, 3, 4096)])
def test_packing_of_many_tiny_pieces_ends(spark, monkeypatch, n, tiny, cap):
    steps, write = [], packing.written

    def counted(df, tag):
        steps.append(tag)
        assert len(steps) <= 40, "the levels don't shrink"
        return write(df, tag)

    monkeypatch.setattr(packing, "written", counted)
    # One piece of `tiny` is an end id alone, as of a null text; the others are like documents.
    length = F.when(F.col("id") % tiny == 0, 1).otherwise(F.pmod(F.xxhash64("id"), F.lit(900)) + 20)
    pieces = write(spark.range(0, n, 1, 4).select(F.col("id").alias("doc_id"), length.cast("long").alias("length")), "t")
    packed = write(packing.pack(pieces, cap), "t")
    assert packed.select("doc_id").distinct().count() == packed.count() == n
    seqs = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.max(F.col("offset") + F.col("length")).alias("end"), F.countDistinct("offset").alias("n"), F.count("*").alias("m"))
    assert seqs.where(f"fill <> end or n <> m or fill > {cap}").isEmpty()
    tokens = packed.agg(F.sum("length")).first()[0]
    assert seqs.count() <= -(-tokens // cap) * 1.01 + 1


SPACE_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_groups(docs, k, percent):
    sets = []
    for _, t in docs:
        w = SPACE_WORDS.findall((t or "").encode().lower())
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    comp = list(range(len(docs)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                comp[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (1, 50)])
def test_jaccard_against_brute_force(spark, k, percent):
    rnd = random.Random(k)
    vocab = ["w%d" % i for i in range(40)] + ["É", "x.y"]
    docs = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One two"), (1004, "one  TWO"), (1005, "one two three")]
    for g in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([5, 30, 90]))]
        for _ in range(rnd.choice([1, 3, 12])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            docs.append((len(docs), " ".join(w)))
    rnd.shuffle(docs)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, n string, fa int").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(df, k, percent).collect()}
    assert got == brute_groups(docs, k, percent)


@pytest.mark.parametrize("earlier", [64])
def test_last_join_makes_a_pair_once(spark, monkeypatch, earlier):
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for d in range(40):  # near copies on both sides of the threshold
        w = list(base)
        w[rnd.randrange(120)], w[rnd.randrange(120)] = f"x{d}", f"x{d % 7}"
        docs.append((d, " ".join(w)))
    made = []

    def pair(rows, a, b, plain=jaccard._pair):
        made.append((rows.count(), plain(rows, a, b).count()))
        return plain(rows, a, b)

    def all_but_star(pairs, *rest, plain=jaccard.close_enough):
        return plain(pairs if len(made) > 1 else pairs.where("false"), *rest)

    monkeypatch.setattr(jaccard, "_pair", pair)
    monkeypatch.setattr(jaccard, "close_enough", all_but_star)  # so that the last join has to find every link
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    monkeypatch.setattr(jaccard, "EARLIER", earlier, raising=False)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(df, 4, 85).collect()}
    assert got == brute_groups(docs, 4, 85)
    rows, pairs = made[-1]
    assert (rows, pairs > 0) == (pairs, True)


def test_jaccard_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in jaccard.jaccard_groups(df, 4, 85).collect())
    assert got == [(0, 1), (1, 1), (1, 1)]
    assert jaccard.jaccard_groups(df.where("false")).collect() == []


def test_jaccard_links_by_documents_without_an_id(spark):
    w = ["w%d" % i for i in range(40)]
    end, both, other = w[:37] + list("abc"), list("def") + w[3:37] + list("abc"), ["v%d" % i for i in range(40)]
    # Each reaches the threshold only with the next: 1 - null - 2; null - null alone.
    docs = [(d, " ".join(x)) for d, x in [(1, w), (None, end), (2, both), (None, ["p", *other]), (None, ["q", *other]), (3, ["far", "away"])]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in jaccard.jaccard_groups(df, 4, 80).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (None, 1), (2, 1), (None, None), (None, None), (3, 3)], key=str)


def test_hamming_bound_is_a_bound():
    rng = np.random.default_rng(0)
    for n, m, share in ((10, 12, 5), (500, 700, 480), (3, 900, 2), (64, 64, 64)):
        pool = rng.integers(0, 2**63, n + m, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:share], pool[n : n + m - share]]))
        assert jaccard.hamming_bound(jaccard.parity_sketch(a), jaccard.parity_sketch(b)) <= len(np.setxor1d(a, b))


ALNUM_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(docs, items, window=13):
    split = lambda t: ALNUM_WORDS.findall((t or "").encode().lower())
    out = {}
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for i, x in items:
            v = split(x)
            n = min(window, len(v))
            for a in range(len(v) - n + 1) if v else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[a : a + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(i))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block", [200_000, 40])
def test_decontamination_of_repeated_and_null_ids(spark, block):
    rnd = random.Random(9)
    vocab = ["u%d" % i for i in range(12)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([3, 13, 20])))) for i in range(12)]
    texts = [x for _, x in items[:4]] + [" ".join(rnd.choice(vocab) for _ in range(40)) for _ in range(4)] + [None, ""]
    docs = [(rnd.choice([None, None, 1, 2]), t) for t in texts for _ in range(3)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    spans = decontam.contaminated_spans(d, spark.createDataFrame(items, "item_id long, text string"), block_windows=block).collect()
    one = brute_contamination(list(enumerate(t for _, t in docs)), items)
    want = sorted(((i, *one[n][:3]) for n, (i, _) in enumerate(docs)), key=str)
    assert sorted(((r.doc_id, r.n_words, sum(h.len for h in r.hits), len(r["items"])) for r in spans), key=str) == want


@pytest.mark.parametrize("block", [200_000, 40])
def test_decontamination_against_brute_force(spark, block):
    rnd = random.Random(4)
    vocab = ["v%d" % i for i in range(9)] + ["été", "ÀB"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 5, 12, 13, 14, 30])))) for i in range(14)] + [(20, None), (21, ""), (22, "!!"), (101, "v1, V2; v3")]
    docs = [(0, None), (1, ""), (2, "..."), (3, items[0][1]), (4, "v1 v2 v3")]
    for _ in range(40):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 2)):
            p = rnd.randint(0, len(w))
            w[p:p] = (rnd.choice(items)[1] or "").split()
        docs.append((len(docs), rnd.choice([" ", ", ", "\n"]).join(w)))
    d = spark.createDataFrame([(a, t, "x") for a, t in docs], "doc_id long, text string, items string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    spans = decontam.contaminated_spans(d, b, block_windows=block)
    want = brute_contamination(docs, items)
    assert {r.doc_id: (r.n_words, sum(h.len for h in r.hits), len(r["items"])) for r in spans.collect()} == {k: v[:3] for k, v in want.items()}
    if block > 1000:
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.decontamination_digest(d, b).collect()}
        assert got == want
        none = decontam.decontamination_digest(d, b.where("false")).agg(F.sum("n_hit"), F.count("*")).first()
        assert tuple(none) == (0, len(docs))


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, vid = [], 0
    for g in range(25):
        base = rng.normal(size=16)
        for _ in range(int(rng.choice([1, 4, 30]))):
            v = base + rng.normal(size=16) * rng.choice([0.05, 0.1, 0.2])
            rows.append((vid, [float(x) for x in v], int(g % 3), "c"))
            vid += 1
    rows += [(900, None, 0, "c"), (901, [0.0] * 16, 0, "c"), (902, [float("nan")] + [1.0] * 15, 0, "c"), (903, [1.0] * 15 + [None], 0, "c"), (904, rows[0][1], None, "c"), (905, rows[0][1], 0, "c"), (906, rows[0][1], 0, "c"), (907, [1.0], 0, "c"), (908, [2.0], 0, "c"), (909, [float("inf")] * 16, 0, "c"), (910, [], 0, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, class string").repartition(3)
    usable = {r[0]: np.array(r[1]) for r in rows if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}
    label = {r[0]: r[2] for r in rows}
    comp, n = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(usable)
    for i in ids:
        for j in ids:
            if j < i and label[i] == label[j] and len(usable[i]) == len(usable[j]):
                a, b = usable[i], usable[j]
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                    n[i] += 1
                    n[j] += 1
                    x, y = find(i), find(j)
                    comp[max(x, y)] = min(x, y)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == {i: (n[i], find(i), find(i) == i) for i in comp}
    assert neardup.near_duplicates(df.where("false")).collect() == []


def test_near_duplicates_with_repeated_ids_and_extreme_doubles(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    rows = []
    for i in range(90):
        v = base[i % 6] + rng.normal(size=8) * 0.12
        rows.append((int(rng.integers(0, 30)), [float(x) for x in v * 10.0 ** int(rng.choice([-200, -3, 0, 150, 300]))], "ab"[i % 2]))
    rows += [(1, rows[0][1], "a"), (1, rows[0][1], "b"), (1, rows[3][1], "b"), (2, [1e200] + [0.0] * 7, "a"), (40, [1e200, 1e190] + [0.0] * 6, "a"), (41, [1e-200] + [0.0] * 7, "a"), (42, [5e-324] + [0.0] * 7, "a"), (None, rows[0][1], "a")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row int, vec_id long, embedding array<double>, label string")
    unit = []
    for _, v, _ in rows:
        v = np.array(v) / max(map(abs, v))
        unit.append(v / np.linalg.norm(v))
    linked = lambda i, j: i != j and None not in (rows[i][0], rows[j][0]) and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.93
    want = []
    for i, r in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = {j for j in range(len(rows)) if linked(k, j)} - reach
            reach |= new
            todo += new
        least = min((rows[j][0] for j in reach if rows[j][0] is not None), default=None)
        want.append((r[0], sum(linked(i, j) for j in range(len(rows))), least, least is None or least == r[0]))
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and max(w[1] for w in want) > 3


def test_near_duplicates_over_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 8))
    x = base[rng.integers(0, 40, 400)] + rng.normal(size=(400, 8)) * 0.08
    df = spark.createDataFrame([(i, [float(c) for c in v], "s") for i, v in enumerate(x)], "vec_id long, embedding array<float>, label string")
    one = sorted(tuple(r) for r in neardup.near_duplicates(df).collect())
    monkeypatch.setattr(neardup, "BLOCK", 500)
    assert sorted(tuple(r) for r in neardup.near_duplicates(df).collect()) == one and any(r[1] for r in one)


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(2)
    dim = 64
    turn = neardup.rotation(dim, 3)
    assert np.allclose(turn @ turn.T, np.eye(dim))
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.normal(size=(400, dim)))
    y = unit(x + rng.normal(size=x.shape) * 0.06)
    turned, codes, f = neardup.encode(x, turn)
    est = np.einsum("ij,ij->i", neardup.signs(codes, dim), y @ turn.T) / f
    cos = np.einsum("ij,ij->i", x, y)
    assert abs((est - cos).mean()) < 0.01
    assert (np.abs(est - cos) <= np.sqrt(1 - cos**2) * np.sqrt(1 - f**2) / f + 1e-5).all()
