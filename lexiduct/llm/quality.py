"""Quality: a linear-chain conditional random field over the lines of a document.

Every line gets features of its own and of the lines before and behind it.  The field
labels lines good or bad; forward-backward gives each line's probability of being
good, and the mean of these, weighted by line length, is the document's quality,
calibrated on the training documents.  Lines learn from their document's label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiduct.llm import words as W
from lexiduct.llm.shared import labelled_sample

OWN = 13
FEATURES = 3 * OWN + 3  # own, previous and next line's, no previous, no next, 1
GROUP_BYTES = 1 << 19


def line_groups(column: pa.Array):
    """Groups of rows with their lines: first row, end row, features (lines x FEATURES),
    line lengths and the row offsets of lines.  Blank lines don't count."""
    for lo, hi, data, off in W.groups(pc.fill_null(column, ""), GROUP_BYTES):
        not_break = np.ones(256, bool)
        not_break[[10, 13]] = False
        starts, ends, bounds = W.spans(data, off, not_break)
        # Sums over a line come from running totals over the bytes.
        total = lambda flag: np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        over = lambda t: (t[ends] - t[starts]).astype(np.float64)
        char = total((data & 0xC0) != 0x80)
        n = over(char)
        ws, we, _ = W.spans(data, off, W.NOT_SPACE)
        h = W.word_hashes(W.LOWER[data], ws, we)
        first_w, end_w = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
        n_words = (end_w - first_w).astype(np.float64)
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        repeated = np.concatenate([[0], np.cumsum(same)])
        line_of = np.repeat(np.arange(len(starts)), (end_w - first_w))
        order = np.lexsort((h, line_of))
        fresh = np.ones(len(order), bool)
        if len(order) > 1:
            fresh[1:] = (h[order][1:] != h[order][:-1]) | (line_of[order][1:] != line_of[order][:-1])
        distinct = np.bincount(line_of[order][fresh], minlength=len(starts)) if len(order) else np.zeros(len(starts))
        upper = over(total((data >= 65) & (data <= 90)))
        # Non-ASCII capitals of Latin-1 are C3 80..C3 9E.
        wide = np.zeros(len(data), bool)
        wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        upper += over(total(wide))
        letter = over(total(((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90)) | (data >= 0xC2)))
        digit = over(total((data >= 48) & (data <= 57)))
        sym = np.zeros(256, bool)
        sym[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~[]"]] = True
        symbol = over(total(sym[data]))
        bang = over(total((data == 33) | (data == 63)))
        last = data[np.maximum(ends - 1, 0)] if len(ends) else data[:0]
        row = np.repeat(np.arange(hi - lo), np.diff(bounds))
        seen = _repeats(row, W.word_hashes(data, starts, ends))
        some = np.maximum(n, 1)
        words = np.maximum(n_words, 1)
        own = np.stack(
            [
                np.log1p(n) / 8,
                np.log1p(n_words) / 6,
                np.minimum(n / words, 30) / 10,
                letter / some,
                upper / np.maximum(letter, 1),
                digit / some,
                np.minimum(symbol / words, 4),
                np.minimum(bang / words, 3),
                (repeated[end_w] - repeated[np.minimum(first_w + 1, end_w)]) / words,
                1 - distinct / words,
                np.isin(last, [33, 46, 63, 58, 59]).astype(float),
                seen.astype(float),
                (n_words <= 3).astype(float),
            ],
            axis=1,
        ) if len(starts) else np.zeros((0, OWN))
        yield lo, hi, with_neighbours(own, bounds), np.maximum(n, 1), bounds


def _repeats(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a line stood earlier in its text."""
    out = np.zeros(len(row), bool)
    order = np.lexsort((np.arange(len(row)), h, row))
    if len(order) > 1:
        out[order[1:]] = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1])
    return out


def with_neighbours(own: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = len(own)
    out = np.zeros((n, FEATURES), np.float32)
    if not n:
        return out
    full = bounds[1:] > bounds[:-1]
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[bounds[:-1][full]], last[bounds[1:][full] - 1] = True, True
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[first, OWN : 2 * OWN] = 0
    out[:-1, 2 * OWN : 3 * OWN] = own[1:]
    out[last, 2 * OWN : 3 * OWN] = 0
    out[:, 3 * OWN], out[:, 3 * OWN + 1], out[:, 3 * OWN + 2] = first, last, 1
    return out


def forward_backward(emit: np.ndarray, move: np.ndarray, bounds: np.ndarray):
    """Marginals (lines x 2), expected moves (2 x 2) and log-partition of each document.
    emit: lines x 2, move: 2 x 2, both logarithms.  All documents of the group step
    through their lines together, the longest ones to the end."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    begin, size = bounds[:-1][order], n[order]
    fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
    most = int(size.max(initial=0))
    live = np.searchsorted(-size, -np.arange(most), "left")  # documents with more than t lines
    lse = np.logaddexp
    for t in range(most):
        at = begin[: live[t]] + t
        if t == 0:
            fwd[at] = emit[at]
        else:
            p = fwd[at - 1]
            fwd[at, 0] = emit[at, 0] + lse(p[:, 0] + move[0, 0], p[:, 1] + move[1, 0])
            fwd[at, 1] = emit[at, 1] + lse(p[:, 0] + move[0, 1], p[:, 1] + move[1, 1])
    for t in range(most - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        q = bwd[at + 1] + emit[at + 1]
        bwd[at, 0] = lse(q[:, 0] + move[0, 0], q[:, 1] + move[0, 1])
        bwd[at, 1] = lse(q[:, 0] + move[1, 0], q[:, 1] + move[1, 1])
    both = fwd + bwd
    z = np.logaddexp(both[:, 0], both[:, 1])
    marg = np.exp(both - z[:, None])
    inner = np.ones(len(emit), bool)
    inner[bounds[:-1][n > 0]] = False
    at = np.flatnonzero(inner)
    pair = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            pair[a, b] = np.exp(fwd[at - 1, a] + move[a, b] + emit[at, b] + bwd[at, b] - z[at]).sum()
    return marg, pair, z


@dataclass
class QualityField:
    weight: np.ndarray  # FEATURES x 2
    move: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    slope: float
    shift: float
    empty: float  # the score of a text without lines

    def marginals(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The probability of each line to be good."""
        if not len(x):
            return np.zeros(0)
        return forward_backward(((x - self.mean) / self.scale).astype(np.float64) @ self.weight, self.move, bounds)[0][:, 1]

    def document(self, good: np.ndarray, length: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        mean = W.per_row_sum(good * length, bounds) / np.maximum(W.per_row_sum(length, bounds), 1)
        out = 1 / (1 + np.exp(-np.clip(self.slope * mean + self.shift, -30, 30)))
        return np.where(np.diff(bounds) > 0, out, self.empty)


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1500, epochs: int = 80, max_bytes: int = 80_000, max_lines: int = 400) -> QualityField:
    """Learns from docs (doc_id, text) and labels (doc_id, label 0/1): a hash sample of about per_class
    documents of each class (of those up to max_bytes and max_lines, so 2 * per_class *
    max_bytes at most) comes to the driver."""
    got, rates = labelled_sample(docs, labels, per_class, max_bytes)
    y = got["label"].to_numpy().astype(int)
    xs, lens, ns = [], [], []
    for chunk in got["text"].chunks:
        for _, _, x, length, bounds in line_groups(chunk):
            xs.append(x)
            lens.append(length)
            ns.append(np.diff(bounds))
    n = np.concatenate(ns) if ns else np.zeros(0, np.int64)
    if len(np.unique(y)) < 2 or not n.sum():
        p = 0.99 if len(y) and y[0] == 1 else 0.01
        return QualityField(np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(FEATURES), np.ones(FEATURES), 0.0, float(np.log(p / (1 - p))), p)
    x, length = np.concatenate(xs), np.concatenate(lens)
    use = (n > 0) & (n <= max_lines)
    line_use = np.repeat(use, n)
    x, length, yd, n = x[line_use].astype(np.float64), length[line_use], y[use], n[use]
    bounds = np.concatenate([[0], np.cumsum(n)])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    x = (x - mean) / scale
    yl = np.repeat(yd, n)
    class_w = np.where(yd == 1, 1 / rates.get(1, 1.0), 1 / rates.get(0, 1.0))
    # A document counts as one, so its long lists of short lines don't outweigh others.
    line_w = length / np.repeat(np.add.reduceat(length, bounds[:-1]), n)
    weight, move = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    state = [np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(move), np.zeros_like(move)]
    onehot = np.stack([1 - yl, yl], axis=1).astype(np.float64)
    inner = np.ones(len(x), bool)
    inner[bounds[:-1]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (yl[at - 1], yl[at]), 1)
    for step in range(1, epochs + 1):
        marg, pair, _ = forward_backward(x @ weight, move, bounds)
        gw = x.T @ ((marg - onehot) * line_w[:, None]) / len(yd) + 1e-4 * weight
        gm = (pair - seen) / len(x) + 1e-2 * move
        for value, grad, m, v, rate in ((weight, gw, state[0], state[1], 0.1), (move, gm, state[2], state[3], 0.05)):
            m[:] = 0.9 * m + 0.1 * grad
            v[:] = 0.99 * v + 0.01 * grad**2
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    field = QualityField(weight, move, mean, scale, 1.0, 0.0, 0.0)
    good = forward_backward(x @ weight, move, bounds)[0][:, 1]
    doc = W.per_row_sum(good * length, bounds) / W.per_row_sum(length, bounds)
    a, b = 4.0, -2.0
    for _ in range(200):  # Newton steps on the weighted log-loss
        p = 1 / (1 + np.exp(-np.clip(a * doc + b, -30, 30)))
        r, q = class_w * (p - yd), class_w * p * (1 - p) + 1e-9
        h = np.array([[(q * doc * doc).sum() + 1e-3, (q * doc).sum()], [(q * doc).sum(), q.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(r * doc).sum() + 1e-3 * a, r.sum() + 1e-3 * b])
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    field.slope, field.shift = float(a), float(b)
    field.empty = float(1 / (1 + np.exp(-np.clip(b, -30, 30))))  # as if every line were bad
    return field


def score_quality(docs: DataFrame, field: QualityField, threshold: float = 0.3, keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs (only the columns of keep, if given) with score double (the probability that a text is good) and predicted int.
    Needs text; null, empty and blank texts have no lines and get the score of a text
    whose every line is bad.  All columns are kept but earlier ones of those names."""
    names = [c for c in keep or docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*names).schema
    for c, t in (("score", "double"), ("predicted", "integer")):
        schema = schema.add(c, t)

    def run(batches):
        for b in batches:
            score = np.zeros(b.num_rows)
            for lo, hi, x, length, bounds in line_groups(b["text"]):
                score[lo:hi] = field.document(field.marginals(x, bounds), length, bounds)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)


def line_labels(docs: DataFrame, field: QualityField) -> DataFrame:
    """doc_id, line (from 0, blank lines not counted), good double: the field's own
    output, one row for each line of docs (doc_id, text)."""

    def run(batches):
        for b in batches:
            for lo, hi, x, _, bounds in line_groups(b["text"]):
                n = np.diff(bounds)
                rows = np.repeat(np.arange(lo, hi), n)
                line = np.arange(len(x)) - np.repeat(bounds[:-1], n)
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(rows)), pa.array(line.astype(np.int32)), pa.array(field.marginals(x, bounds))], names=["doc_id", "line", "good"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, line int, good double")
