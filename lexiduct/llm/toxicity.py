"""Toxicity: a factorization machine over hashed terms.

A document is the set of its hashed terms: its words, and the first four and six
characters of longer words, so that inflected insults count together.  Training keeps the
terms whose document frequency tells the classes apart, and their partners: terms that may
be as common in both classes but tell them apart among the documents that hold a kept
term.  Besides a weight, each has a vector, and the products of two terms' vectors add
what the pair means beyond its parts (an insult next to the mention of a group).  Only
the kept terms travel to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiduct.llm import words as W
from lexiduct.llm.shared import labelled_sample

U = np.uint64
BITS = 20
STEM_CHARS = (4, 6)


def term_groups(column: pa.Array):
    """Groups of rows with the hashed terms of each text: first row, end row, term
    numbers and row offsets (repeats not removed)."""
    for lo, hi, data, off in W.groups(pc.utf8_lower(pc.fill_null(column, ""))):
        starts, ends, bounds = W.spans(data, off, W.ALNUM)
        words = W.word_hashes(data, starts, ends)
        row = np.repeat(np.arange(hi - lo), np.diff(bounds))
        terms, rows = [words], [row]
        # The first characters of a word: bytes that begin a character in UTF-8 are counted.
        lead = np.concatenate([np.flatnonzero((data & 0xC0) != 0x80), np.full(max(STEM_CHARS), len(data))])
        place = np.searchsorted(lead, starts)
        for k in STEM_CHARS:
            cut = lead[place + k]
            longer = cut < ends
            terms.append(W.word_hashes(data, starts[longer], cut[longer]) ^ U(0x5851F42D4C957F2D))
            rows.append(row[longer])
        terms, rows = np.concatenate(terms), np.concatenate(rows)
        order = np.argsort(rows, kind="stable")
        yield lo, hi, (terms[order] >> U(64 - BITS)).astype(np.int64), np.searchsorted(rows[order], np.arange(hi - lo + 1))


@dataclass
class FactorizationMachine:
    terms: np.ndarray  # kept term numbers, ascending
    bias: float
    weight: np.ndarray
    vectors: np.ndarray  # terms x factors

    def table(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, np.int32)
        out[self.terms] = np.arange(len(self.terms))
        return out

    def logits(self, x: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Of rows of distinct kept terms."""
        s = W.per_row_sum(self.vectors[x], off)
        q = W.per_row_sum(self.vectors[x] ** 2, off)
        return self.bias + W.per_row_sum(self.weight[x], off) + 0.5 * (s**2 - q).sum(axis=1)


def kept(terms: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct kept terms of each row."""
    idx = table[terms]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    live = idx >= 0
    pair = np.unique(row[live] * (1 << 32) + idx[live])
    rows = pair >> 32
    return (pair & 0xFFFFFFFF).astype(np.int64), np.searchsorted(rows, np.arange(len(off)))


def apart(d1: np.ndarray, d0: np.ndarray, n1: float, n0: float, least_docs: int) -> np.ndarray:
    """The two-proportion z of terms in d1 of n1 documents and d0 of n0; 0 for terms in
    fewer than least_docs."""
    p = (d1 + d0) / (n1 + n0)
    z = np.abs(d1 / n1 - d0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    z[d1 + d0 < least_docs] = 0
    return z


def partners(parts, y: np.ndarray, kept_terms: np.ndarray, least_docs: int, least_z: float) -> np.ndarray:
    """For every term the largest z that it reaches among the documents of one of the kept
    terms, where that has documents of both classes; below least_z it counts as 0."""
    rows = np.repeat(np.arange(len(y)), np.concatenate([np.diff(o) for _, o in parts]))
    terms = np.concatenate([x for x, _ in parts])
    first = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(y)))])
    out = np.zeros(1 << BITS)
    for t in kept_terms:
        held = rows[terms == t]
        n1, n0 = y[held].sum(), len(held) - y[held].sum()
        if min(n1, n0) < least_docs:
            continue
        d = [np.zeros(1 << BITS), np.zeros(1 << BITS)]
        for r in held:
            d[int(y[r])][terms[first[r] : first[r + 1]]] += 1
        z = apart(d[1], d[0], n1, n0, least_docs)
        z[t] = 0
        np.maximum(out, z, out=out)
    out[out < least_z] = 0
    return out


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 3000,
    max_terms: int = 4096,
    factors: int = 8,
    epochs: int = 150,
    max_bytes: int = 40_000,
    seed: int = 7,
    least_docs: int = 3,
    least_z: float = 3.5,
    pair_terms: int = 64,
    pair_z: float = 9.0,
) -> FactorizationMachine:
    """Learns from docs (doc_id, text) and labels (doc_id, label 0/1): a hash sample of about per_class
    documents of each class (of those up to max_bytes long, so 2 * per_class * max_bytes
    at most) comes to the driver, and Adam minimises the log-loss, each class weighted as
    it occurs.

    Of the terms in least_docs sampled documents or more, those with a z of least_z between
    the classes are kept, and those that reach pair_z among the documents of one of the
    pair_terms strongest of them; at most max_terms, by z."""
    got, rates = labelled_sample(docs, labels, per_class, max_bytes)
    y = got["label"].to_numpy().astype(np.float64)
    if len(np.unique(y)) < 2:
        odds = -6.0 if not len(y) or y[0] == 0 else 6.0
        return FactorizationMachine(np.zeros(0, np.int64), odds, np.zeros(0), np.zeros((0, factors)))
    # Distinct terms are kept by groups of a megabyte of text, in 4 bytes each.
    n1, n0 = y.sum(), len(y) - y.sum()
    d1, d0 = np.zeros(1 << BITS), np.zeros(1 << BITS)
    every = np.arange(1 << BITS, dtype=np.int32)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    first = 0
    for chunk in got["text"].chunks:
        for lo, hi, t, off in term_groups(chunk):
            x, xo = kept(t, off, every)
            toxic = np.repeat(y[first + lo : first + hi] == 1, np.diff(xo))
            d1 += np.bincount(x[toxic], minlength=1 << BITS)
            d0 += np.bincount(x[~toxic], minlength=1 << BITS)
            parts.append((x.astype(np.int32), xo))
        first += len(chunk)
    del got
    z = apart(d1, d0, n1, n0, least_docs)
    z[z < least_z] = 0
    strong = np.lexsort((np.arange(len(z)), -z))[:pair_terms]
    z = np.maximum(z, partners(parts, y, strong[z[strong] > 0], least_docs, pair_z))
    best = np.lexsort((np.arange(len(z)), -z))[:max_terms]
    best = np.sort(best[z[best] > 0])
    fm = FactorizationMachine(best, 0.0, np.zeros(len(best)), np.random.default_rng(seed).normal(0, 0.01, (len(best), factors)))
    table = fm.table()
    some = [kept(x, xo, table) for x, xo in parts]
    parts.clear()
    x = np.concatenate([a for a, _ in some])
    xo = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in some]))]).astype(np.int64)
    weight = np.where(y == 1, 1 / rates.get(1, 1.0), 1 / rates.get(0, 1.0))
    weight /= weight.sum()
    rows = np.repeat(np.arange(len(y)), np.diff(xo))
    state: dict[str, list] = {}

    def adam(name, value, grad, step, rate):
        m, v = state.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        m[...] = 0.9 * m + 0.1 * grad
        v[...] = 0.99 * v + 0.01 * grad**2
        return value - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)

    fm.bias = float(np.log((y * weight).sum() / ((1 - y) * weight).sum()))
    for step in range(1, epochs + 1):
        g = (1 / (1 + np.exp(-np.clip(fm.logits(x, xo), -30, 30))) - y) * weight
        s = W.per_row_sum(fm.vectors[x], xo)
        gx = g[rows]
        gw = np.bincount(x, weights=gx, minlength=len(best)) + 1e-6 * fm.weight
        inner = gx[:, None] * (s[rows] - fm.vectors[x])
        gv = np.stack([np.bincount(x, weights=inner[:, f], minlength=len(best)) for f in range(factors)], axis=1) + 1e-5 * fm.vectors
        fm.bias = float(adam("b", np.array(fm.bias), g.sum(), step, 0.05))
        fm.weight = adam("w", fm.weight, gw, step, 0.05)
        fm.vectors = adam("v", fm.vectors, gv, step, 0.01)
    return fm


def score_toxicity(docs: DataFrame, fm: FactorizationMachine, threshold: float = 0.3) -> DataFrame:
    """docs with score double (the probability that a text is toxic) and predicted int
    (score >= threshold).  Needs text; null and empty texts have no terms and get the
    machine's bias alone, repeated rows are scored alike.  All columns are kept but
    earlier ones of those names.  Only the text travels to Python, and only the two
    results come back."""

    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = fm.table()
        for t in texts:
            score = np.zeros(len(t))
            for lo, hi, terms, off in term_groups(t):
                score[lo:hi] = 1 / (1 + np.exp(-np.clip(fm.logits(*kept(terms, off, table)), -30, 30)))
            yield pa.StructArray.from_arrays([pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["score", "predicted"])

    found = F.arrow_udf(judge, "struct<score: double, predicted: int>").asNondeterministic()  # so that a filter doesn't run it again
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*names, found(F.col("text").cast("string")).alias("_found")).select(*names, "_found.score", "_found.predicted")
