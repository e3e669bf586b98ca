"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

Pieces as long as a sequence are sequences of their own.  The others are dealt at
random to problems of bounded size; each problem lives on several islands, which
are rows that tasks evolve on their own, and between epochs the elites of a problem
migrate around the ring of its islands (a shuffle of one row an island).  The worst
bins of each solved problem are opened again and their pieces go to the next level,
which has far fewer problems, until one problem is left; so what bins stay badly
filled doesn't grow with the number of problems.  A problem has tokens for several
times the bins that it reopens, so every level is smaller than the one before.
"""

from __future__ import annotations

import math
import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiduct.llm import bpe
from lexiduct.llm.shared import written

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---- the algorithm, on plain lists ----------------------------------------------------


class Packing:
    """Bins of item numbers; rooms keeps (room left, bin) ascending, so that the
    tightest bin that still fits is one bisection away."""

    def __init__(self, lengths: list[int], cap: int):
        self.lengths, self.cap = lengths, cap
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self.rooms: list[tuple[int, int]] = []

    def new_bin(self, items: list[int]) -> None:
        left = self.cap - sum(self.lengths[i] for i in items)
        self.bins.append(items)
        self.room.append(left)
        insort(self.rooms, (left, len(self.bins) - 1))

    def best_fit(self, items) -> None:
        """Puts each item where the least room stays."""
        for i in items:
            n = self.lengths[i]
            at = bisect_left(self.rooms, (n, -1))
            if at == len(self.rooms):
                self.new_bin([i])
                continue
            left, b = self.rooms.pop(at)
            self.bins[b].append(i)
            self.room[b] = left - n
            insort(self.rooms, (left - n, b))

    def fitness(self) -> float:
        """Fewer bins first, then fuller ones: the mean of the squared fills."""
        return sum(((self.cap - r) / self.cap) ** 2 for r in self.room) / max(1, len(self.room))


def build(lengths: list[int], cap: int, whole: list[list[int]], loose) -> Packing:
    p = Packing(lengths, cap)
    for b in whole:
        p.new_bin(b)
    p.best_fit(loose)
    return p


def exchanged(p: Packing, loose: list[int], rng: random.Random, tries: int = 48) -> list[int]:
    """Replaces one item or two of a bin by as many loose ones that fill it better, in some
    of the bins that have room, and returns the items that are loose then.  These are
    smaller in sum than before, so they fit elsewhere more easily."""
    at = p.lengths.__getitem__
    pool = sorted((at(i), i) for i in loose)
    open_bins = [k for k, r in enumerate(p.room) if r]
    for k in rng.sample(open_bins, min(tries, len(open_bins))):
        items, room = p.bins[k], p.room[k]
        best = (0, None)  # what the bin gains, the items to take out and those to put in
        for i in items:
            j = bisect_left(pool, (at(i) + room + 1, -1)) - 1
            if j >= 0 and pool[j][0] - at(i) > best[0]:
                best = (pool[j][0] - at(i), ((i,), (pool[j],)))
        few = items if len(items) <= 8 else rng.sample(items, 8)
        for x in range(len(few)):
            for y in range(x):
                pair = at(few[x]) + at(few[y])
                lo, hi = 0, len(pool) - 1
                while lo < hi and best[0] < room:
                    total = pool[lo][0] + pool[hi][0]
                    if total > pair + room:
                        hi -= 1
                        continue
                    if total - pair > best[0]:
                        best = (total - pair, ((few[x], few[y]), (pool[lo], pool[hi])))
                    lo += 1
        if best[1] is None:
            continue
        gone, come = best[1]
        for c in come:
            del pool[bisect_left(pool, c)]
        for i in gone:
            insort(pool, (at(i), i))
        p.bins[k] = [i for i in items if i not in gone] + [i for _, i in come]
        del p.rooms[bisect_left(p.rooms, (room, k))]
        p.room[k] = room - best[0]
        insort(p.rooms, (p.room[k], k))
    return [i for _, i in pool]


def rebuilt(lengths: list[int], cap: int, whole: list[list[int]], loose: list[int], rng: random.Random) -> Packing:
    """Whole bins, then the displaced items: exchanged for smaller ones where that fills
    a bin better, and best-fitted, longest first."""
    p = build(lengths, cap, whole, [])
    loose = exchanged(p, loose, rng)
    p.best_fit(sorted(loose, key=lambda i: -lengths[i]))
    return p


def crossover(a: Packing, b: Packing, rng: random.Random) -> Packing:
    """Injects most of b's best-filled bins whole into a, drops a's bins that share an item
    with them, and best-fits the displaced items."""
    order = sorted(range(len(b.bins)), key=lambda k: (b.room[k], rng.random()))
    injected = [b.bins[k] for k in order[: max(1, len(order) // 2)] if rng.random() < 0.7]
    taken = {i for x in injected for i in x}
    kept, displaced = [], []
    for x in a.bins:
        if taken.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in taken]
    return rebuilt(a.lengths, a.cap, [*map(list, injected), *kept], displaced, rng)


def mutate(a: Packing, rng: random.Random) -> Packing:
    """Opens the worst bins and a few others, and places their items anew."""
    order = sorted(range(len(a.bins)), key=lambda k: -a.room[k])
    out = set(order[: max(1, len(order) // 20)]) | set(rng.sample(range(len(a.bins)), min(len(a.bins), 3)))
    loose = [i for k in out for i in a.bins[k]]
    return rebuilt(a.lengths, a.cap, [list(a.bins[k]) for k in range(len(a.bins)) if k not in out], loose, rng)


def evolve(lengths: list[int], cap: int, elites: list[list[int]], seed: int, population: int, generations: int) -> tuple[list[int], int]:
    """The best packing found, as a bin number for each item, and how many crossovers were
    made for it.  Stops as soon as the number of bins meets its lower bound, which is
    then the least there can be."""
    rng = random.Random(seed)
    bound = math.ceil(sum(lengths) / cap)
    longest = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    key = lambda p: (len(p.bins), -p.fitness())
    pool = []
    for e in elites:
        bins: dict[int, list[int]] = {}
        for i, b in enumerate(e):
            bins.setdefault(b, []).append(i)
        pool.append(build(lengths, cap, list(bins.values()), []))
    if not pool:
        pool.append(build(lengths, cap, [], longest))
    while len(pool) < population and min(len(p.bins) for p in pool) > bound:
        noisy = sorted(longest, key=lambda i: -lengths[i] * rng.uniform(0.7, 1.3))
        pool.append(build(lengths, cap, [], noisy))
    crossovers = 0
    for _ in range(generations):
        pool.sort(key=key)
        if len(pool[0].bins) <= bound or len(pool) < 2:
            break
        a, b = rng.sample(pool[: max(2, len(pool) // 2)], 2)
        child = crossover(a, b, rng)
        crossovers += 1
        if rng.random() < 0.5:
            child = mutate(child, rng)
        if key(child) < key(pool[-1]):
            pool[-1] = child
    best = min(pool, key=key)
    out = [0] * len(lengths)
    for k, b in enumerate(best.bins):
        for i in b:
            out[i] = k
    return out, crossovers


# ---- on Spark --------------------------------------------------------------------------


def token_pieces(docs: DataFrame, tokenizer: str, max_len: int, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of docs (doc_id, text): the ids of each
    text and its end id, cut only where longer than max_len.  A null or empty text has
    the end id alone; repeated rows give their pieces again."""

    def cut(batches):
        enc = bpe.encoder(tokenizer)
        for b in batches:
            doc_ids = b["doc_id"].to_pylist()
            for lo in range(0, b.num_rows, 256):
                flat, off = enc.ids(b["text"].slice(lo, 256).to_pylist())
                rows: list[list] = [[], [], [], [], []]
                for i, d in enumerate(doc_ids[lo : lo + 256]):
                    ids = np.append(flat[off[i] : off[i + 1]], end_id).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), max_len)):
                        part = ids[at : at + max_len]
                        for col, v in zip(rows, (d, k, at, len(part), zlib.crc32(part.tobytes()))):
                            col.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(cut, PIECE_SCHEMA)


def pack(
    pieces: DataFrame,
    max_len: int = 4096,
    problem_items: int = 2000,
    islands: int = 2,
    epochs: int = 2,
    population: int = 8,
    generations: int = 40,
    reopen: int = 2,
) -> DataFrame:
    """Adds sequence_id and offset to pieces (length long of 1..max_len, any other
    columns): every piece lies in one sequence, whole, and a sequence's pieces follow
    each other from 0 without gaps, longest first.

    pieces is read several times, so give a written table.  An empty table gives no
    rows.  Problems have about problem_items pieces whatever the input's size, and more
    where pieces are short: enough to fill 4 * reopen sequences, so at most about
    8 * reopen * max_len pieces.  At each level the `reopen` worst bins of a problem are
    opened again for the next, which so has a quarter of the tokens at most."""
    names = pieces.columns
    least = 4 * max(1, reopen) * max_len
    numbered = pieces.withColumn("_mid", F.monotonically_increasing_id())
    done = [numbered.where(F.col("length") >= max_len).select(*names, (-1 - F.col("_mid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    open_ = numbered.where(F.col("length") < max_len).select(F.struct(*names).alias("row"), F.col("length").cast("int").alias("n"), "_mid")
    (n, tokens), level = _size(open_), 0
    while n:
        problems = max(1, min(-(-n // problem_items), tokens // least))
        g = F.pmod(F.xxhash64("_mid", F.lit(level)), F.lit(problems))
        # A problem's rows are bounded (about problem_items, dealt by hash of a unique number).
        held = written(
            open_.groupBy(g.alias("g")).agg(F.sort_array(F.collect_list(F.struct("n", "_mid", "row"))).alias("items")).withColumn("lens", F.transform("items", lambda x: x["n"])),
            "pack-problem",
        )
        # Rows are few and small but cost seconds each, so their tasks go by number, not by bytes.
        tasks = min(problems * islands, max(4 * pieces.sparkSession.sparkContext.defaultParallelism, problems * islands // 64))
        best = _islands(held.select("g", "lens"), max_len, islands, epochs, population, generations, level, tasks)
        packed = held.join(best, "g").select("g", "last", F.explode(F.arrays_zip("items", "bin", "offset", "worst")).alias("x"))
        packed = written(packed.select("g", F.col("x.items.row").alias("row"), F.col("x.items.n").alias("n"), F.col("x.items._mid").alias("_mid"), F.col("x.bin").alias("bin"), F.col("x.offset").alias("offset"), F.col("x.worst").alias("worst")), "packed")
        final = problems == 1
        stays = F.lit(True) if final else F.col("worst") >= reopen
        seq = F.lit(level << 56) + F.col("g") * F.lit(1 << 24) + F.col("bin")
        done.append(packed.where(stays).select("row.*", seq.cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset")))
        open_ = packed.where(~stays).select("row", "n", "_mid")
        (n, tokens), level = (0, 0) if final else _size(open_), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _size(open_: DataFrame) -> tuple[int, int]:
    """Pieces and tokens."""
    n, tokens = open_.agg(F.count("*"), F.sum("n")).first()
    return n, tokens or 0


def _islands(problems: DataFrame, cap: int, islands: int, epochs: int, population: int, generations: int, level: int, tasks: int) -> DataFrame:
    """The best packing of each problem: g, and for each item bin, offset and the rank
    of its bin from the worst filled (0)."""
    state = problems.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("elites", F.expr("cast(array() as array<array<int>>)"))
    schema = "g long, island int, lens array<int>, elite array<int>, bins int, crossovers int"
    for epoch in range(epochs):

        def run(frames, epoch=epoch):
            for f in frames:
                out = []
                for g, i, lens, elites in zip(f["g"], f["island"], f["lens"], f["elites"]):
                    lens = [int(x) for x in lens]
                    elite, made = evolve(lens, cap, [list(map(int, e)) for e in elites], hash((level, int(g), int(i), epoch)), population, generations)
                    out.append((g, i, lens, elite, max(elite, default=-1) + 1, made))
                yield pd.DataFrame(out, columns=["g", "island", "lens", "elite", "bins", "crossovers"])

        state = written(state.select("g", "island", "lens", "elites").repartition(tasks, "g", "island").mapInPandas(run, schema), "island")
        if epoch + 1 < epochs:
            # Each island's elite moves to the next of its problem's ring; both stay.
            movers = state.select("g", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("elite").alias("guest"))
            state = state.join(movers, ["g", "island"]).withColumn("elites", F.array("elite", "guest"))
    best = state.groupBy("g").agg(F.min_by(F.struct("lens", "elite"), F.struct("bins", "island")).alias("b")).select("g", "b.*")

    def place(frames):
        for f in frames:
            out = []
            for g, lens, elite in zip(f["g"], f["lens"], f["elite"]):
                lens, elite = np.asarray(lens, np.int64), np.asarray(elite, np.int64)
                fill = np.bincount(elite, weights=lens).astype(np.int64)
                rank = np.empty(len(fill), np.int64)
                rank[np.argsort(fill, kind="stable")] = np.arange(len(fill))
                order = np.lexsort((-lens, elite))
                before = np.cumsum(lens[order]) - lens[order]
                first = np.r_[True, elite[order][1:] != elite[order][:-1]]
                offset = np.empty(len(lens), np.int64)
                offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
                out.append((g, True, elite, offset, rank[elite]))
            yield pd.DataFrame(out, columns=["g", "last", "bin", "offset", "worst"])

    return best.mapInPandas(place, "g long, last boolean, bin array<long>, offset array<long>, worst array<long>")


def packed_documents(docs: DataFrame, tokenizer: str, max_len: int = 4096) -> DataFrame:
    """Tokenises docs once, and packs their pieces."""
    return pack(written(token_pieces(docs, tokenizer, max_len), "pieces"), max_len)
