"""Benchmark decontamination by a prefix-filtered set join.

A window (13 consecutive words of an item, or all words of a shorter item) is
contained in a document only if each of its word shingles is, so one necessary
prefix token is enough to join on: the window's rarest shingle, with rarity counted
over all documents.  A joined pair of places fixes where the window would have to
lie; positional and length bounds drop what would stick out of the document, and the
rest is verified word by word over exactly the window's size.

Items go through in blocks of bounded size (``block_windows``): only a block's sorted
key tables travel to the tasks, and a larger benchmark takes more passes.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiduct.llm import words as W
from lexiduct.llm.shared import written

U = np.uint64

class Block:
    """The windows of some items: word hashes and the shingles of each window."""

    def __init__(self, items: list[tuple[str, str]], window: int, k: int):
        column = pa.array([t or "" for _, t in items], pa.string())
        data, off = W.buffers(column)
        low = W.LOWER[data]
        starts, ends, bounds = W.spans(low, off, W.ALNUM)
        self.words = W.word_hashes(low, starts, ends)
        self.ids = [i for i, _ in items]
        n = np.diff(bounds)
        count = np.where(n >= window, n - window + 1, (n > 0).astype(np.int64))
        self.item = np.repeat(np.arange(len(items)), count)  # of each window
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.at = np.repeat(bounds[:-1], count) + inner  # its first word
        self.len = np.repeat(np.minimum(n, window), count)
        self.k = k
        # Shingles of k words inside windows; a window of fewer words is one shingle.
        self.sh_at, self.sh_hash = self._shingles()

    def _shingles(self):
        """For each window and offset its shingle hash; offsets that don't exist repeat the first."""
        most = int((self.len - self.k + 1).max(initial=1))
        offs = np.minimum(np.arange(max(1, most))[None, :], np.maximum(self.len - self.k, 0)[:, None])
        return offs, self.hash_at(self.words, (self.at[:, None] + offs).ravel(), np.repeat(np.minimum(self.len, self.k), offs.shape[1])).reshape(offs.shape)

    def hash_at(self, words: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), U)
        for m in np.unique(size):
            pick = size == m
            out[pick] = W.combine([words[at[pick] + j] for j in range(m)], int(m))
        return out

    @property
    def sizes(self) -> list[int]:
        return sorted({int(x) for x in np.unique(np.minimum(self.len, self.k))})

def _doc_shingles(words: np.ndarray, bounds: np.ndarray, sizes: list[int]):
    """(hash, first word) of all runs of the given sizes that lie within a document."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    for m in sizes:
        at = np.flatnonzero(np.arange(len(words)) + m <= ends)
        if len(at):
            yield m, W.combine([words[at + j] for j in range(m)], m), at

def _in_sorted(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in the ascending keys.  A 16-bit table of the keys' leading
    bits settles nearly all of them without a search."""
    lead = np.zeros(1 << 16, bool)
    lead[(keys >> U(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(lead[(values >> U(48)).astype(np.int64)])
    at = np.searchsorted(keys, values[maybe])
    at[at == len(keys)] = 0
    return maybe[keys[at] == values[maybe]] if len(keys) else maybe[:0]

def _rarity(docs: DataFrame, block: Block) -> np.ndarray:
    """In how many documents each distinct shingle of the block occurs, aligned with
    np.unique(block.sh_hash).  Counts are added up in tasks, then by Spark."""
    keys = np.unique(block.sh_hash)
    sizes = block.sizes

    def count(batches):
        total = np.zeros(len(keys), np.int64)
        for b in batches:
            for _, _, data, off in W.groups(b["text"]):
                low = W.LOWER[data]
                starts, ends, bounds = W.spans(low, off, W.ALNUM)
                words = W.word_hashes(low, starts, ends)
                for _, h, at in _doc_shingles(words, bounds, sizes):
                    hit = _in_sorted(keys, h)
                    if len(hit):
                        row = np.searchsorted(bounds, at[hit], "right")
                        pair = np.unique(np.stack([row, np.searchsorted(keys, h[hit])]), axis=1)
                        np.add.at(total, pair[1], 1)
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["k", "n"])

    got = docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(keys), np.int64)
    out[got["k"].to_numpy()] = got["n"].to_numpy()  # at most one row for each shingle of the block
    return out

def _item_blocks(items: DataFrame, block_windows: int):
    """The items in blocks of about block_windows windows, one in memory at a time."""
    block, size = [], 0
    # Only the benchmark passes through the driver, item by item; it isn't the corpus.
    for r in items.where("text is not null and item_id is not null").select(F.col("item_id").cast("string").alias("i"), "text").orderBy("i", "text").toLocalIterator():
        if size > block_windows:
            yield block
            block, size = [], 0
        block.append((r.i, r.text))
        size += len(r.text) // 2 + 1
    yield block

def contaminated_spans(docs: DataFrame, items: DataFrame, window: int = 13, k: int = 4, block_windows: int = 200_000) -> DataFrame:
    """For docs (doc_id, text; other columns are ignored) and items (item_id, text):
    doc_id, n_words, hits array<struct<at, len>> (word runs inside occurring windows,
    merged, ascending), items array<string> (the item_ids that occur, sorted as strings).

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z; null and
    empty texts have none.  Items that are null or have no word never occur.  Every row
    of docs gives a row, repeated and null ids too."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = _item_blocks(items, block_windows)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _scan(plain, Block(first, window, k)).drop("text_hash")
    # Several blocks: what they find is put together by id and text (a hash of it); rows
    # that are equal in both are one row until the end.
    both = None
    for i, b in enumerate(itertools.chain((first, second), blocks)):
        part = written(_scan(plain, Block(b, window, k)).withColumn("block", F.lit(i)), "decontam")
        both = part if both is None else both.unionByName(part)
    once = both.groupBy("doc_id", "text_hash", "block").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n_words", "hits", "items")])
    merged = once.groupBy("doc_id", "text_hash").agg(F.max("copies").cast("int").alias("copies"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    rows = merged.select("doc_id", "text_hash", "n_words", "hits", "items", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return rows.drop("copy").mapInArrow(_merge, SPANS).select("doc_id", "n_words", "hits", "items")

SPANS = "doc_id long, text_hash long, n_words long, hits array<struct<at:long,len:long>>, items array<string>"

def _spans_batch(doc_ids, hashes, n_words, hits, items) -> pa.RecordBatch:
    run = pa.struct([("at", pa.int64()), ("len", pa.int64())])
    return pa.RecordBatch.from_arrays(
        [doc_ids, hashes, pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(run)), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "text_hash", "n_words", "hits", "items"]
    )

def _merge(batches):
    for b in batches:
        hits = []
        for runs in b["hits"].to_pylist():
            out: list[dict] = []
            for r in sorted(runs, key=lambda r: r["at"]):
                if out and r["at"] <= out[-1]["at"] + out[-1]["len"]:
                    out[-1]["len"] = max(out[-1]["len"], r["at"] + r["len"] - out[-1]["at"])
                else:
                    out.append(dict(r))
            hits.append(out)
        yield _spans_batch(b["doc_id"], b["text_hash"], b["n_words"].to_pylist(), hits, b["items"].to_pylist())

def _scan(docs: DataFrame, block: Block) -> DataFrame:
    n_docs = _rarity(docs, block) if len(block.at) else np.zeros(0, np.int64)
    uniq = np.unique(block.sh_hash)
    # The necessary prefix token of each window: its rarest shingle, ties by hash.
    if len(block.at):
        rank = np.empty(len(uniq), np.int64)
        rank[np.lexsort((uniq, n_docs))] = np.arange(len(uniq))
        best = rank[np.searchsorted(uniq, block.sh_hash)].argmin(axis=1)
        rows = np.arange(len(best))
        key, off = block.sh_hash[rows, best], block.sh_at[rows, best]
        order = np.argsort(key, kind="stable")
        key, off, win = key[order], off[order], order
    else:
        key, off, win = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, length, item, ids, item_words, sizes = block.at, block.len, block.item, block.ids, block.words, block.sizes
    keys = np.unique(key)

    def scan(batches):
        for b in batches:
            for lo, hi, data, offs in W.groups(b["text"]):
                low = W.LOWER[data]
                starts, ends, bounds = W.spans(low, offs, W.ALNUM)
                words = W.word_hashes(low, starts, ends)
                found_w, found_at = [], []
                for _, h, place in _doc_shingles(words, bounds, sizes) if len(keys) else ():
                    hit = _in_sorted(keys, h)
                    if not len(hit):
                        continue
                    a, z = np.searchsorted(key, h[hit], "left"), np.searchsorted(key, h[hit], "right")
                    for s in range(0, len(hit), 20_000):  # bounded for very common passages
                        n = (z - a)[s : s + 20_000]
                        j = np.repeat(a[s : s + 20_000], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        p = np.repeat(place[hit[s : s + 20_000]], n)
                        begin, w = p - off[j], win[j]
                        row = np.searchsorted(bounds, p, "right") - 1
                        fits = (begin >= bounds[row]) & (begin + length[w] <= bounds[row + 1])
                        begin, w = begin[fits], w[fits]
                        same = np.ones(len(w), bool)
                        for q in range(int(length[w].max(initial=0))):
                            live = np.flatnonzero(same & (length[w] > q))
                            same[live] = words[begin[live] + q] == item_words[at[w[live]] + q]
                        found_w.append(w[same])
                        found_at.append(begin[same])
                n_words = np.diff(bounds)
                hits, items = [[] for _ in range(hi - lo)], [[] for _ in range(hi - lo)]
                if found_w and sum(map(len, found_w)):
                    w, begin = np.concatenate(found_w), np.concatenate(found_at)
                    cover = np.zeros(len(words) + 1, np.int32)
                    np.add.at(cover, begin, 1)
                    np.add.at(cover, begin + length[w], -1)
                    covered = np.cumsum(cover[:-1]) > 0
                    row_of = np.searchsorted(bounds, begin, "right") - 1
                    for row in np.unique(row_of):
                        c = covered[bounds[row] : bounds[row + 1]]
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], c, [False]]).astype(np.int8)))
                        hits[row] = [{"at": int(s), "len": int(e - s)} for s, e in zip(edge[::2], edge[1::2])]
                        items[row] = sorted({ids[i] for i in np.unique(item[w[row_of == row]])})
                yield _spans_batch(b["doc_id"].slice(lo, hi - lo), b["text_hash"].slice(lo, hi - lo), n_words, hits, items)

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(scan, SPANS)

def decontamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spans = contaminated_spans(docs, items)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["len"])
    return spans.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words")))

