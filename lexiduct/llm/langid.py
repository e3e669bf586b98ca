"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every run of code points that are no letters counts as one
kind of space, and the runs of 1 to 3 code points are hashed into a bounded number of
features.  The log-probability matrix (features x languages) is small and broadcast;
a task scores groups of texts in numpy by gathering the matrix rows of their n-grams
and adding them up by text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiduct.llm.shared import hash_sample

ORDERS = (1, 2, 3)
BITS = 15
GROUP_CHARS = 1 << 18
PAD = "   "
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter (general category L)."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)
    return _letters


def ngram_groups(texts: list[str]):
    """For groups of whole texts: first row, end row, feature numbers and row offsets of
    each order, and whether each text has a letter.  No n-gram spans two texts."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= GROUP_CHARS):
            size += len(texts[hi]) + len(PAD)
            hi += 1
        part = texts[lo:hi]
        cps = np.frombuffer((PAD.join(part) + PAD).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + len(PAD) for t in part])
        is_letter = letters()[cps]
        c = np.where(is_letter, cps, 32)
        first = np.concatenate([[0], ends[:-1]])
        any_letter = np.add.reduceat(is_letter, first) > 0
        # Of a run of spaces only the first counts.
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        keep[first] = True
        c = c[keep].astype(np.uint64)
        bounds = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([first, [len(keep)]])]
        feats = []
        for k, n in enumerate(ORDERS):
            m = max(0, len(c) - n + 1)
            h = np.full(m, n, np.uint64)
            for j in range(n):
                h = (h ^ c[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            # An n-gram belongs to the text where it starts and must end there.
            inside = np.repeat(bounds[1:], np.diff(bounds))[:m] >= np.arange(m) + n
            idx = (h >> np.uint64(64 - BITS)).astype(np.int64) + (k << BITS)
            feats.append((idx[inside], np.searchsorted(np.flatnonzero(inside), bounds)))
        yield lo, hi, feats, any_letter
        lo = hi


@dataclass
class LanguageModel:
    langs: list[str]
    logp: np.ndarray  # features x languages, float32
    prior: np.ndarray

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text (`und` without a letter) and its posterior."""
        out = np.zeros((len(texts), len(self.langs)))
        known = np.zeros(len(texts), bool)
        for lo, hi, feats, any_letter in ngram_groups(texts):
            known[lo:hi] = any_letter
            for idx, off in feats:
                full = off[1:] > off[:-1]
                if full.any():
                    out[lo:hi][full] += np.add.reduceat(self.logp[idx], off[:-1][full], axis=0, dtype=np.float64)
        out += self.prior
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = out.argmax(axis=1)  # ties: the first, and langs ascend
        post = 1 / np.exp(out - out.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[b] if k else "und" for b, k in zip(best, known)], np.where(known, post, 0.0)


def lowered(column) -> list[str]:
    return pc.utf8_lower(pc.fill_null(column, "")).to_pylist()


def fit_language_model(train: DataFrame, docs_per_lang: int = 1500, max_chars: int = 1_000_000, alpha: float = 0.5) -> LanguageModel:
    """Learns from train (doc_id, text, lang): a hash sample of about docs_per_lang
    documents of each language (of those up to max_chars long), counted in tasks.  The
    prior is each language's share of all of train.  More than 256 languages raise, as
    the matrix has 400 kB for each."""
    sample, _, sizes = hash_sample(train.where("lang is not null"), "doc_id", "lang", docs_per_lang)
    sample = sample.where("text is not null").where(F.length("text") <= max_chars)
    features = len(ORDERS) << BITS

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b["lang"].to_pylist()
            for lo, hi, feats, _ in ngram_groups(lowered(b["text"])):
                for idx, off in feats:
                    for i, lang in enumerate(langs[lo:hi]):
                        have = total.setdefault(lang, np.zeros(features, np.int64))
                        have += np.bincount(idx[off[i] : off[i + 1]], minlength=features)
        for lang, t in total.items():
            some = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(t[some])], names=["lang", "f", "n"])

    got = sample.select("text", "lang").repartition(16).mapInArrow(count, "lang string, f long, n long").groupBy("lang", "f").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    counts = np.zeros((features, len(langs)))
    pos = {x: i for i, x in enumerate(langs)}
    cols = np.array([pos[x] for x in got["lang"].to_pylist()], np.int64)
    counts[got["f"].to_numpy(), cols] = got["n"].to_numpy()
    logp = np.zeros_like(counts)
    for k in range(len(ORDERS)):
        part = counts[k << BITS : (k + 1) << BITS]
        logp[k << BITS : (k + 1) << BITS] = np.log((part + alpha) / (part.sum(axis=0) + alpha * len(part)))
    share = np.array([sizes[x] for x in langs], float)
    prior = np.log(share / max(1.0, share.sum()))
    return LanguageModel(langs, logp.astype(np.float32), prior)


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred string (a learned language; `und` for null and empty texts and
    texts without a letter) and score double (the posterior of lang_pred; 0 for `und`).
    Needs text; earlier columns of those names are replaced, repeated rows are scored
    alike, and of tied languages the first by name is given.  Only the text travels to
    Python, and only the two results come back."""

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            lang, post = shared.value.score(lowered(t))
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(post, pa.float64())], names=["lang_pred", "score"])

    found = F.arrow_udf(judge, "struct<lang_pred: string, score: double>").asNondeterministic()  # so that a filter doesn't run it again
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*names, found(F.col("text").cast("string")).alias("_found")).select(*names, "_found.lang_pred", "_found.score")
