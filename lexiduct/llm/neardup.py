"""Embedding near-dedup with randomised-rotation binary codes.

Vectors are normalised, turned by one random rotation, and coded as the signs of
their coordinates.  With a code goes its correction factor f = <code, vector>: for a
query vector q, <code, q> / f is an unbiased estimate of the cosine, and what it
misses is at most sqrt(1 - cos^2) * sqrt(1 - f^2) / f, as the part of the code off its
vector is orthogonal to it.  A pair is dropped only if its estimate lies below the
threshold by more than that bound (or by more than ``sigmas`` standard deviations of
the error, where that is asked for); every other pair is recomputed in double
precision from the stored components.

Only equal labels are compared.  Equal vectors of a label are one class, counted by
its copies and named by a number of its own.  The classes of a label are dealt to blocks
of bounded bytes, which are coded once; a task compares two blocks at a time: it returns
how many vectors each class links to and the edges of a spanning forest, so links within
a large group are counted and never listed.  Every pair of blocks of a label is visited,
as an exact answer needs, so the work grows with the square of a label's distinct
vectors, and each block travels as often as its label has blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiduct.llm.shared import components, discard, written

BLOCK = 1 << 20  # components of a block
QUERIES = 256  # compared at a time, which bounds a task's memory


#: What a block holds, row by row: class numbers, copies, vectors, sign codes, correction factors.
HELD = ("ids", "copies", "x", "codes", "factors")


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation: the orthogonal factor of a Gaussian matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, packed sign codes and correction factors of unit vectors."""
    turned = unit @ turn.T
    bits = turned >= 0
    factor = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return turned.astype(np.float32), np.packbits(bits, axis=1), factor


def signs(codes: np.ndarray, dim: int) -> np.ndarray:
    return (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))


def candidates(codes: np.ndarray, factor: np.ndarray, query: np.ndarray, threshold: float, sigmas: float | None) -> np.ndarray:
    """(code row, query row) of the pairs whose cosine may reach the threshold."""
    dim = query.shape[1]
    est = (signs(codes, dim) @ query.T) / factor[:, None].astype(np.float32)
    off = np.sqrt(np.maximum(1 - factor**2, 0)) / factor
    if sigmas is not None:
        off = np.minimum(off, sigmas * off / np.sqrt(max(1, dim - 1)))
    # Of all cosines from the threshold up, the error is largest at the threshold.
    low = threshold - np.sqrt(max(0.0, 1 - threshold**2)) * off - 1e-4
    return np.argwhere(est >= low[:, None].astype(np.float32))


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding array<double>, usable: false for null labels and for
    vectors that are null, empty, zero or hold null or non-finite components."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & fine & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), e.alias("embedding"), F.coalesce(usable, F.lit(False)).alias("usable"))


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in doubles, each times a power of two that brings its largest component to
    0.5..1, and their norms: cosines neither overflow nor underflow, and no digit changes
    but of components too small to matter."""
    x = x.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x, np.linalg.norm(x, axis=1)


def links_of_blocks(xi, codes, factor, idx, wi, xj, idj, wj, same: bool, threshold: float, turn: np.ndarray, sigmas: float | None):
    """Linked copies of each class of both blocks (in doubles) and forest edges.  The first
    block takes part by its codes and factors; its vectors only where a pair is recomputed."""
    (xi, ni), (xj, nj) = scaled(xi), scaled(xj)
    query = ((xj / nj[:, None]) @ turn.T).astype(np.float32)
    n_i, n_j = np.zeros(len(idx), np.int64), np.zeros(len(idj), np.int64)
    a_out, b_out = [], []
    # Union-find over both blocks keeps one edge for each joining of two parts.
    parent = list(range(len(idx) + (0 if same else len(idj))))
    base = 0 if same else len(idx)

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for lo in range(0, len(idj), QUERIES):
        p = candidates(codes, factor, query[lo : lo + QUERIES], threshold, sigmas)
        p[:, 1] += lo
        if same:
            p = p[p[:, 0] < p[:, 1]]
        for part in np.array_split(p, -(-len(p) // (1 << 15)) or 1):
            cos = np.einsum("ij,ij->i", xi[part[:, 0]], xj[part[:, 1]]) / (ni[part[:, 0]] * nj[part[:, 1]])
            part = part[cos >= threshold]
            np.add.at(n_i, part[:, 0], wj[part[:, 1]])
            np.add.at(n_j, part[:, 1], wi[part[:, 0]])
            for a, b in part.tolist():
                u, v = find(a), find(base + b)
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    a_out.append(idx[a])
                    b_out.append(idj[b])
    return n_i, n_j, a_out, b_out


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, sigmas: float | None = None, seed: int = 11) -> DataFrame:
    """For vectors (vec_id long, embedding array, label; other columns are ignored):
    vec_id, n_links (other vectors linked directly), component_id (smallest vec_id
    reachable), kept (vec_id = component_id), one row for each row.

    Vectors link if their labels are equal and not null and their cosine, in double
    precision, is at least the threshold; vectors of different length never link.  Each
    row is a vector of its own: rows that share a vec_id link only by their vectors and
    may so be in different components.  Null, empty and zero vectors and those with null
    or non-finite components have no links and are their own component; so is a row with
    a null vec_id.  Any finite doubles are fine, however large or small.  sigmas=None
    drops pairs only on the certain bound, so no link is lost."""
    spark = vectors.sparkSession
    # Blocks keep the components as they are stored; cosines are always computed in doubles.
    stored = np.float32 if "float" in dict(vectors.dtypes)["embedding"] else np.float64
    rows = clean_vectors(vectors).withColumn("dim", F.size("embedding"))
    # A vector's exact components name its class, in which copies meet (-0.0 counts as 0.0).
    key = F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: F.hex(F.when(x == 0, F.lit(0.0)).otherwise(x).cast("string").cast("binary")))), 256)
    rows = written(rows.withColumn("class", F.when(F.col("usable") & F.col("vec_id").isNotNull(), key)), "vec-rows")
    live = rows.where("class is not null")
    classes = live.groupBy("label", "dim", "class").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "vec-classes")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") * F.col("dim") / BLOCK).cast("int"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))

    def gathered(t: pa.Table) -> pa.Table:
        # A block has about BLOCK components, dealt by hash of the class.
        dim = t["dim"][0].as_py()
        x = t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(stored).reshape(-1, dim)
        wide, norm = scaled(x)
        _, codes, factor = encode(wide / norm[:, None], rotation(dim, seed))
        packed = [t["cid"].to_numpy(), t["copies"].to_numpy(), x, codes, factor]
        keys = {k: pa.array([t[k][0].as_py()], kind) for k, kind in (("label", pa.string()), ("dim", pa.int32()), ("block", pa.int32()), ("blocks", pa.int32()))}
        return pa.table(keys | {k: pa.array([v.tobytes()], pa.binary()) for k, v in zip(HELD, packed)})

    packed = dealt.select("label", "dim", "block", "blocks", "cid", "copies", "embedding").groupBy("label", "dim", "block", "blocks")
    packed = written(packed.applyInArrow(gathered, "label string, dim int, block int, blocks int, " + ", ".join(f"{k} binary" for k in HELD)), "vec-blocks")
    left = packed.select("label", "dim", F.col("block").alias("i"), *[F.col(k).alias(f"{k}_i") for k in HELD], F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"))
    right = packed.select("label", "dim", F.col("block").alias("j"), *[F.col(k).alias(f"{k}_j") for k in HELD[:3]])
    pairs = left.join(right, ["label", "dim", "j"]).select("dim", (F.col("i") == F.col("j")).alias("same"), *[f"{k}_i" for k in HELD], *[f"{k}_j" for k in HELD[:3]])

    def compare(batches):
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            for r in range(b.num_rows):
                dim = b["dim"][r].as_py()
                turn = turns.setdefault(dim, rotation(dim, seed))
                get = lambda c, t: np.frombuffer(b[c][r].as_buffer(), t)  # noqa: B023, E731
                idx, idj = get("ids_i", np.int64), get("ids_j", np.int64)
                xi, xj = (get(c, stored).reshape(-1, dim) for c in ("x_i", "x_j"))
                codes, factor = get("codes_i", np.uint8).reshape(len(idx), -1), get("factors_i", np.float64)
                n_i, n_j, a, e = links_of_blocks(xi, codes, factor, idx, get("copies_i", np.int64), xj, idj, get("copies_j", np.int64), b["same"][r].as_py(), threshold, turn, sigmas)
                hit_i, hit_j = np.flatnonzero(n_i), np.flatnonzero(n_j)
                cid = np.concatenate([idx[hit_i], idj[hit_j], np.array(a, np.int64)])
                n = np.concatenate([n_i[hit_i], n_j[hit_j], np.zeros(len(a), np.int64)])
                to = pa.array([None] * (len(hit_i) + len(hit_j)) + [int(v) for v in e], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(n), to], names=["cid", "n", "to"])

    # Rows are few and large, so tasks go by their number: some pairs of blocks each.
    n = packed.groupBy("label", "dim").agg(F.count("*").alias("b")).agg(F.sum(F.col("b") * (F.col("b") + 1) / 2)).first()[0] or 1
    tasks = int(max(1, min(n, max(spark.sparkContext.defaultParallelism, n // 8))))
    found = written(pairs.repartition(tasks).mapInArrow(compare, "cid long, n long, to long"), "vec-links")
    discard(packed)
    comp = components(found.where("to is not null").select(F.col("cid").alias("a"), F.col("to").alias("b")), "vec-cc").withColumnRenamed("node", "cid")
    first = classes.select("cid", "rep").join(comp, "cid").groupBy("component").agg(F.min("rep").alias("first"))
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    named = classes.select("label", "dim", "class", "cid", "rep", "copies").join(counts, "cid", "left").join(comp, "cid", "left").join(first, "component", "left")
    named = named.select("label", "dim", "class", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("first", "rep").alias("component_id"))
    out = rows.select("vec_id", "label", "dim", "class").join(named, ["label", "dim", "class"], "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
