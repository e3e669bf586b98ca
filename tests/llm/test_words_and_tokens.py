import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiduct.llm import bpe, tokenfile
from lexiduct.llm import words as W
from lexiduct.llm.queries import tokenizer_path
from lexiduct.llm.shared import components

SPACE_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@given(st.lists(st.text(st.characters(codec="utf-8", max_codepoint=0x300)), max_size=12), st.integers(1, 64))
@settings(max_examples=100, deadline=None)
def test_words_and_hashes(texts, most):
    for table, rx in ((W.NOT_SPACE, SPACE_WORDS), (W.ALNUM, ALNUM_WORDS)):
        seen: dict[bytes, int] = {}
        for lo, hi, data, off in W.groups(pa.array(texts, pa.string()), most):
            low = W.LOWER[data]
            starts, ends, bounds = W.spans(low, off, table)
            h = W.word_hashes(low, starts, ends)
            for i, t in enumerate(texts[lo:hi]):
                want = rx.findall(t.encode().lower())
                at = range(bounds[i], bounds[i + 1])
                assert [low[starts[j] : ends[j]].tobytes() for j in at] == want
                for w, j in zip(want, at):
                    assert seen.setdefault(w, int(h[j])) == int(h[j])
        assert len(set(seen.values())) == len(seen)


def test_shingles_of_short_and_long_texts():
    texts = ["", "a b c", "a b c d", "a b c d e", None, "a b c"]
    data, off = W.buffers(pa.array(texts, pa.string()))
    s, e, b = W.spans(data, off, W.NOT_SPACE)
    sh, so = W.shingles(W.word_hashes(data, s, e), b, 4)
    assert np.diff(so).tolist() == [0, 1, 1, 2, 0, 1]
    assert sh[so[1]] == sh[so[5]] and sh[so[2]] == sh[so[3]] and sh[so[1]] != sh[so[2]]


def test_fast_ids_equal_the_library():
    enc = bpe.WordBpe(tokenizer_path(), cache_words=50)
    rnd = random.Random(3)
    parts = ["'s", "'", "re", "LL", " ", "\n", "\t", "1", "23", "a", "É", "ß", "İ", "Σ", "-", "!?", "\x1c", "\x85", "\xa0", "日本", "é", "<|endoftext|>", "²", "½", "ª", "'ve", "\x00", "ſ", "ŉ", "Word", "antidisestablishment"]
    texts = [None, ""] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    ids, off = enc.ids(texts)
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == enc.lib.encode(t or "", add_special_tokens=False).ids, t


@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.sampled_from(["bit", "byte"]))
def test_planes_round_trip(ids, unit):
    a = np.array(ids, "<u4")
    assert tokenfile.from_planes(tokenfile.to_planes(a, unit), len(a), unit).tolist() == ids


def test_shards_round_trip(spark, tmp_path):
    rnd = random.Random(1)
    texts = [(i, rnd.choice([None, "", "It's a test!", "Été " * rnd.randint(1, 400), "x" * 5000]), "other") for i in rnd.sample(range(1000), 60)] + [(None, "no id", "o"), (5000, "twice", "o"), (5000, "twice", "o")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, ids string").repartition(3)
    for unit in ("bit", "byte"):
        m = tokenfile.write_token_shards(docs, f"file://{tmp_path}/{unit}", tokenizer_path(), unit=unit, block_ids=256)
        got = sorted(tokenfile.read_token_shards(m).collect(), key=lambda r: r.start)
        enc = bpe.encoder(tokenizer_path())
        order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0))
        at = 0
        for r, (d, t, _) in zip(got, order, strict=True):
            want = enc.whole(t or "").tolist() + [1]
            assert (r.doc_id, r.start, r.ids) == (d, at, want)
            at += len(want)
    dig = tokenfile.token_digest(spark, docs, tokenizer_path()).where("doc_id = 5000").collect()
    assert len(dig) == 2 and dig[0].ids_crc32 == zlib.crc32(np.array(enc.whole("twice").tolist() + [1], "<u4").tobytes())
    assert tokenfile.token_digest(spark, docs.where("false"), tokenizer_path()).collect() == []
    shard = next(iter(sorted((tmp_path / "bit").glob("*.lxpt"))))
    raw = bytearray(shard.read_bytes())
    raw[10] ^= 255
    shard.write_bytes(raw)
    with pytest.raises(Exception, match="damaged"):
        tokenfile.read_token_shards(m.where("false").unionByName(spark.createDataFrame([(0, str(shard), 1, 1, 0)], m.schema))).collect()


def test_components(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {x: find(x) for p in pairs for x in p if p[0] != p[1]}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
