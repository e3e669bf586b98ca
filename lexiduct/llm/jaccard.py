"""N-gram Jaccard self-join: rare-first prefix filtering, verified once per pair.

Texts with the same set of shingles are one class.  Shingles are ordered by rarity
over all documents, and a class emits only its prefix: if two sets reach the
threshold, they share a prefix shingle.  Pairs that share one pass a length and a
positional filter in Spark, a suffix filter (a lower bound of the sets' Hamming
distance from small sketches), and one exact comparison of the two sets, which only
the survivors fetch.

Groups of near copies would share a prefix shingle pairwise, so pairs are tested in
rounds, and the links found are contracted to components before the next.  First each
class only with the smallest class of each of its prefix shingles (a star).  Then, once
and again while all pairs left would cost much and rounds lower that, with its neighbour in a random order
of the classes of a prefix shingle, where that is in another component: a few such
rounds, each linear in the postings and far smaller than the one before, join a group
of near copies.  Last, for prefix shingles that still join different components, the
classes outside of the shingle's largest component with all its classes of other
components, each pair at the first shingle that it shares.  Pairs within one component
are never tested, as they can't change it; no other pair is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiduct.llm import words as W
from lexiduct.llm.shared import components, discard, written

U = np.uint64
HEAVY_ROWS = 1 << 21  # shingles gathered in a task before those seen often are told
HEAVY_LEAST = 2
CELL_BITS = 23  # cells of the hash space that have a level of rarity, a byte each
PART_BITS = 15
ROUNDS = 3  # of neighbours in random orders, at most
BITS = 8  # longs of the short sketch that a join compares
EARLIER = 16  # shingles before a posting's own that the last join compares
CHEAP = 64  # pairs a posting up to which all pairs left are tested at once


def sets_of(column: pa.Array, k: int):
    """Groups of rows with their shingle sets: first row, end row, ascending distinct hashes, offsets."""
    for lo, hi, data, off in W.groups(column):
        low = W.LOWER[data]
        starts, ends, bounds = W.spans(low, off, W.NOT_SPACE)
        sh, sh_off = W.shingles(W.word_hashes(low, starts, ends), bounds, k)
        yield lo, hi, *W.distinct_sorted(sh, sh_off)


def fingerprints(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    n = np.diff(off).astype(U)
    a = W.mix(W.per_row_sum(W.mix(values ^ U(0x3C79AC492BA7B653)), off) + n)
    b = W.mix(W.per_row_sum(W.mix(values + U(0x1C69B3F74AC4AE35)), off) ^ (n * U(0x9E3779B97F4A7C15)))
    return a.view(np.int64), b.view(np.int64)


def parity_sketch(values: np.ndarray) -> bytes:
    """A bit for each cell of the hash space: whether the set has an odd number of
    shingles there.  Twice the cells that a set of n shingles has at most, a power of
    two and 64 at least; a wider sketch folds to a narrower one."""
    cells = max(64, 1 << int(len(values)).bit_length())
    odd = np.bincount((values & U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def hamming_bound(a: bytes, b: bytes) -> int:
    """The suffix filter: what two sets' symmetric difference has at least, since each
    cell of unlike parity holds one of its members."""
    u, v = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(u) > len(v):
        u = u[: len(u) // 2] ^ u[len(u) // 2 :]
    while len(v) > len(u):
        v = v[: len(v) // 2] ^ v[len(v) // 2 :]
    return int(np.bitwise_count(u ^ v).sum())


def text_hash():
    """Tells texts apart where ids don't; null and empty texts are alike."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), text_hash().alias("text_hash"))


def document_sets(docs: DataFrame, k: int) -> DataFrame:
    """A row for each document: doc_id, text_hash, n (set size), fa, fb (fingerprints of the
    set), sketch, and bits, a sketch of a fixed BITS * 64 cells that joins can compare.
    In the same pass rows of another kind, whose n is null: cell, h, c, the shingles that
    a task met HEAVY_LEAST times or more in a run of its documents, and how often."""
    numbers = pa.struct([(f"b{i}", pa.int64()) for i in range(BITS)])
    kinds = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("fa", pa.int64()), ("fb", pa.int64()), ("sketch", pa.binary()), ("bits", numbers), ("cell", pa.int32()), ("h", pa.int64()), ("c", pa.int64())])

    def rows(length, **columns):
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(length, f.type) for f in kinds], schema=kinds)

    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def told():
            v, c = np.unique(np.concatenate(held), return_counts=True)
            v, c = v[c >= HEAVY_LEAST], c[c >= HEAVY_LEAST]
            return rows(len(v), cell=pa.array(_cell(v).astype(np.int32)), h=pa.array(v.view(np.int64)), c=pa.array(c.astype(np.int64)))

        for b in batches:
            for lo, hi, v, off in sets_of(b["text"], k):
                fa, fb = fingerprints(v, off)
                sketch = pa.array([parity_sketch(v[a:z]) for a, z in zip(off[:-1], off[1:])], pa.binary())
                row = np.repeat(np.arange(hi - lo), np.diff(off))
                cells = np.bincount(row * (BITS * 64) + (v % U(BITS * 64)).astype(np.int64), minlength=(hi - lo) * BITS * 64) & 1
                odd = np.packbits(cells.astype(np.uint8), bitorder="little").view(np.int64).reshape(hi - lo, BITS)
                bits = pa.StructArray.from_arrays([pa.array(odd[:, i].copy()) for i in range(BITS)], fields=list(numbers))
                yield rows(hi - lo, doc_id=b["doc_id"].slice(lo, hi - lo), text_hash=b["text_hash"].slice(lo, hi - lo), n=pa.array(np.diff(off)), fa=pa.array(fa), fb=pa.array(fb), sketch=sketch, bits=bits)
                held.append(v)
                size += len(v)
                if size >= HEAVY_ROWS:
                    yield told()
                    held, size = [], 0
        if size:
            yield told()

    fields = ", ".join(f"b{i}: long" for i in range(BITS))
    return _texts(docs).mapInArrow(run, f"doc_id long, text_hash long, n long, fa long, fb long, sketch binary, bits struct<{fields}>, cell int, h long, c long")


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(64 - CELL_BITS)).astype(np.int64)


def _level(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of binary orders, 1 for a single one."""
    return np.minimum(np.frexp(counts.astype(np.float64))[1], 255).astype(np.uint8)


def _table(counts: DataFrame) -> np.ndarray:
    """The levels of all cells from (cell int, c long), packed by tasks: the driver gets
    at most one byte a cell, whatever the input's size."""
    most = counts.groupBy("cell").agg(F.max("c").alias("c")).withColumn("part", F.shiftright("cell", PART_BITS))

    def pack(group: pa.Table) -> pa.Table:
        levels = np.zeros(1 << PART_BITS, np.uint8)
        levels[group["cell"].to_numpy() & ((1 << PART_BITS) - 1)] = _level(group["c"].to_numpy())
        return pa.table({"part": pa.array([group["part"][0].as_py()], pa.int32()), "levels": pa.array([levels.tobytes()])})

    out = np.zeros(1 << CELL_BITS, np.uint8)
    for r in most.groupBy("part").applyInArrow(pack, "part int, levels binary").toArrow().to_pylist():
        out[r["part"] << PART_BITS : (r["part"] + 1) << PART_BITS] = np.frombuffer(r["levels"], np.uint8)
    return out


def rarity_levels(met: DataFrame) -> np.ndarray:
    """What orders shingles from rare to frequent: a level for each cell of the hash
    space, from how often runs of documents met them (cell, h, c), over all documents.
    Any order gives exact results, so shingles that share a cell cost time and no link."""
    return _table(met.groupBy("cell", "h").agg(F.sum("c").alias("c")))


def prefix_postings(docs: DataFrame, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    """token, fa, n, pos: the prefix of each class in rare-first order.  A task emits a
    class once, however many copies it meets (as far as it remembers them)."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for _, _, v, off in sets_of(b["text"], k):
                fa, _ = fingerprints(v, off)
                n = np.diff(off)
                new = 100 * n >= percent * (n + 1)  # no other set is near enough to a smaller one
                for i in np.flatnonzero(new).tolist():
                    f = int(fa[i])
                    new[i] = f not in seen
                    if len(seen) < 1_000_000:
                        seen.add(f)
                if not new.any():
                    continue
                # Hashes ascend within a set, so a stable sort by (set, level) orders each by (level, hash).
                row = np.repeat(np.arange(len(n)), n)
                order = np.argsort((row.astype(np.int64) << 8) | levels[_cell(v)], kind="stable")
                pos = np.arange(len(v)) - np.repeat(off[:-1], n)
                first = (pos < np.repeat(n - -(-percent * n // 100) + 1, n)) & np.repeat(new, n)
                row, pos = row[first], pos[first]
                out = [pa.array(v[order[first]].view(np.int64)), pa.array(fa[row]), pa.array(n[row].astype(np.int32)), pa.array(pos.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, names=["token", "fa", "n", "pos"])

    return _texts(docs).select("text").mapInArrow(run, "token long, fa long, n int, pos int")


def _overlap_possible(a: str, b: str, percent: int):
    """Length and positional filters for a shared shingle at two places.  A pair that
    reaches the threshold passes at its first shared shingle, from whose places on all
    of the overlap lies in both; that it may fail at a later one rules nothing out."""
    na, nb, pa_, pb = (F.col(x).cast("long") for x in (f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos"))
    most = F.least(na - pa_, nb - pb)
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (most * (100 + percent) >= (na + nb) * percent)


def _bits_near(a: str, b: str, na: str, nb: str, percent: int):
    """The suffix filter on the short sketches, within the condition of a join."""
    apart = sum((F.bit_count(F.col(f"{a}.b{i}").bitwiseXOR(F.col(f"{b}.b{i}"))) for i in range(1, BITS)), F.bit_count(F.col(f"{a}.b0").bitwiseXOR(F.col(f"{b}.b0"))))
    size = F.col(na).cast("long") + F.col(nb)
    need = F.floor((size * percent + (99 + percent)) / (100 + percent))
    return apart <= size - need * 2


def close_enough(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that the suffix filter can't rule out (classes: fa, n, sketch)."""
    a = classes.select(F.col("fa").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("sx"))
    b = classes.select(F.col("fa").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("sy"))

    def run(batches):
        for batch in batches:
            sizes = batch["nx"].to_numpy() + batch["ny"].to_numpy()
            # union - intersection = nx + ny - 2 * intersection, with the least overlap allowed
            most = sizes - 2 * -(-percent * sizes // (100 + percent))
            near = np.array([hamming_bound(u, v) for u, v in zip(batch["sx"].to_pylist(), batch["sy"].to_pylist())], np.int64) <= most
            keep = pa.array(near)
            yield pa.RecordBatch.from_arrays([batch["x"].filter(keep), batch["y"].filter(keep)], names=["x", "y"])

    full = pairs.join(a, "x").join(b, "y").select("x", "y", "nx", "ny", "sx", "sy")
    return full.mapInArrow(run, "x long, y long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets (fa, hashes binary) reach the threshold."""
    a = sets.select(F.col("fa").alias("x"), F.col("hashes").alias("hx"))
    b = sets.select(F.col("fa").alias("y"), F.col("hashes").alias("hy"))
    full = pairs.join(b, "y").join(a, "x").select("x", "y", "hx", "hy")

    def run(batches):
        for batch in batches:
            hx, hy = batch["hx"], batch["hy"]
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                u, v = np.frombuffer(hx[i].as_buffer(), U), np.frombuffer(hy[i].as_buffer(), U)
                need = -(-percent * (len(u) + len(v)) // (100 + percent))
                ok[i] = len(np.intersect1d(u, v, assume_unique=True)) >= need
            yield pa.RecordBatch.from_arrays([batch["x"].filter(pa.array(ok)), batch["y"].filter(pa.array(ok))], names=["x", "y"])

    return full.mapInArrow(run, "x long, y long")


def _class_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """fa, hashes of the wanted classes, from one document of each (wanted: fa, doc_id,
    text_hash).  Only a class without any id is found by the hash of a text."""
    lone = F.when(F.col("doc_id").isNull(), F.col("text_hash")).alias("lone")
    texts, keys = _texts(docs).select("doc_id", "text", lone), wanted.select("doc_id", lone)
    rows = texts.join(keys, texts["doc_id"].eqNullSafe(keys["doc_id"]) & texts["lone"].eqNullSafe(keys["lone"]), "left_semi")

    def run(batches):
        for b in batches:
            for _, _, v, off in sets_of(b["text"], k):
                fa, _ = fingerprints(v, off)
                yield pa.RecordBatch.from_arrays([pa.array(fa), pa.array([v[a:z].tobytes() for a, z in zip(off[:-1], off[1:])], pa.binary())], names=["fa", "hashes"])

    return rows.select("text").mapInArrow(run, "fa long, hashes binary").dropDuplicates(["fa"])


def similar_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(documents, links): doc_id, text_hash, n, fa, fb, sketch, bits of every document, and
    links (x, y) between classes (by fa) that reach 100 * intersection >= percent * union,
    enough of them to give the right components: pairs that earlier links already join
    aren't tested."""
    told = written(document_sets(docs, k), "jac-docs")
    docs_sets = told.where("n is not null").drop("cell", "h", "c")
    classes = docs_sets.where("n > 0").groupBy("fa").agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bits").alias("bits"))
    classes = written(classes, "jac-classes")  # read for every round of links
    by = Window.partitionBy("token")
    posts = prefix_postings(docs, k, percent, rarity_levels(told.where("n is null"))).withColumn("hub", F.min(F.struct("fa", "n", "pos")).over(by)).withColumn("last", F.max("fa").over(by))
    posts = written(posts.where(F.col("hub.fa") != F.col("last")).select("token", F.struct("fa", "n", "pos").alias("p"), "hub").distinct(), "jac-posts")

    star = posts.where(F.col("p.fa") != F.col("hub.fa")).where(_overlap_possible("p", "hub", percent))
    star = written(_pair(star, "hub.fa", "p.fa"), "jac-star")

    def linked(pairs: DataFrame) -> DataFrame:
        near = written(close_enough(pairs, classes, percent), "jac-near")
        used = near.select(F.col("x").alias("fa")).unionByName(near.select(F.col("y").alias("fa")))
        sets = written(_class_sets(docs, classes.join(used, "fa", "left_semi"), k), "jac-sets")
        links = written(verified(near, sets, percent), "jac-links")
        discard(near, sets)
        return links

    links = linked(star)
    comp = written(components(links.select(F.col("x").alias("a"), F.col("y").alias("b")), "jac-cc"), "jac-comp")

    found, mixed, used, pairs_left = [links], posts, [star], 0
    for n in range(ROUNDS + 1):
        before, mixed = mixed, _mixed(mixed, comp)
        discard(before)
        size = mixed.groupBy("token").agg(F.count("*").alias("n"), F.count_if(~F.col("in_big")).alias("out"))
        cost = size.agg(F.sum(F.col("n") * F.col("out")).alias("pairs"), F.sum("n").alias("postings")).first()
        # Rounds join groups of copies that are near enough; where the last one didn't take
        # the pairs left to a quarter, as among copies below the threshold, another won't.
        left, pairs_left = pairs_left, cost.pairs or 0
        if n == ROUNDS or (n and (pairs_left <= CHEAP * (cost.postings or 0) or pairs_left * 4 > left)):
            break
        order = Window.partitionBy("token").orderBy(F.xxhash64("p.fa", "token", F.lit(n)), "p.fa")
        near = mixed.select("p", "comp", F.lag(F.struct("p", "comp")).over(order).alias("q")).where(F.col("comp") != F.col("q.comp"))
        near = written(_pair(near.where(_overlap_possible("p", "q.p", percent)), "p.fa", "q.p.fa"), "jac-round")
        more = linked(near)
        used.append(near)
        found.append(more)
        known = comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
        before, comp = comp, written(components(known.unionByName(more.select(F.col("x").alias("a"), F.col("y").alias("b"))), "jac-cc"), "jac-comp")
        discard(before)

    used.append(mixed)
    # A pair of different components shares only shingles that are mixed, and a linked one passes all
    # filters at the first of them, so later ones needn't make it again.  The lists only tell which are
    # later: what a bound leaves out of them makes a pair twice, and loses none.
    before = Window.partitionBy("fa").orderBy("p.pos", "token").rowsBetween(-EARLIER, -1)
    mixed = mixed.withColumn("fa", F.col("p.fa")).withColumn("met", F.collect_list("token").over(before))
    mixed = mixed.join(classes.select("fa", "bits"), "fa").select("token", "p", "comp", "in_big", "bits", "met")
    small = mixed.where("not in_big").select("token", F.col("p").alias("s"), F.col("comp").alias("sc"), F.col("bits").alias("sbits"), F.col("met").alias("smet"))
    rest = mixed.join(small, "token").where(F.col("comp") != F.col("sc"))
    rest = rest.where(F.col("in_big") | (F.col("p.fa") < F.col("s.fa"))).where(_overlap_possible("p", "s", percent)).where(_bits_near("bits", "sbits", "p.n", "s.n", percent)).where(~F.arrays_overlap("met", "smet"))
    rest = written(_pair(rest, "p.fa", "s.fa"), "jac-rest")
    found.append(linked(rest))
    discard(rest, comp, classes, *used)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return docs_sets, out


def _pair(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()


def _mixed(posts: DataFrame, comp: DataFrame) -> DataFrame:
    """token, p, comp, in_big: the postings of shingles that still join different
    components, and whether they are of the shingle's largest one.  posts may be the
    mixed ones of a round before, as components only grow."""
    c = comp.select(F.col("node").alias("fa"), "component")
    at = posts.select("token", "p", F.col("p.fa").alias("fa")).join(c, "fa", "left").select("token", "p", F.coalesce("component", "fa").alias("comp"))
    by = Window.partitionBy("token")
    sized = at.withColumn("size", F.count("*").over(Window.partitionBy("token", "comp")))
    seen = sized.withColumn("big", F.max(F.struct("size", "comp")).over(by)).withColumn("least", F.min("comp").over(by)).withColumn("most", F.max("comp").over(by))
    return written(seen.where("least <> most").select("token", "p", "comp", (F.col("comp") == F.col("big.comp")).alias("in_big")), "jac-mixed")


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """For docs (doc_id, text; other columns are ignored): doc_id, n_shingles,
    component_id, one row for each row of docs.

    Words are runs of anything but ASCII white space after lower-casing A-Z; the set
    holds the distinct runs of k words, or the whole sequence if shorter.  Two documents
    link when 100 * intersection >= percent * union; component_id is the smallest doc_id
    reachable by links.  Null, empty and blank texts have no shingles and link with
    nothing.  A document with a null doc_id links like any other, but is the component of
    none; component_id is null where no document with an id is reachable."""
    out = similar_documents(docs, k, percent)
    named = F.when(F.col("component").isNull(), F.col("doc_id")).when(~F.col("component.lone"), F.col("component.id"))
    return out.select("doc_id", "n_shingles", named.alias("component_id"))


def similar_documents(docs: DataFrame, k: int = 5, percent: int = 80, one_id: bool = True) -> DataFrame:
    """doc_id, text_hash, n_shingles, fa, component of each row of docs: component is the
    first class that links reach, by (lone, id, class): lone if no document of the class
    has an id, id the smallest of its doc_ids (else fa), and class its fa.  It is null
    for texts without shingles.  With one_id, rows that share an id are one document and
    so connect their classes (class is 0 then where there is an id)."""
    rows, links = similar_classes(docs, k, percent)
    # Classes are told apart by both fingerprints; links name them by the first.
    classes = rows.where("n > 0").groupBy("fa", "fb").agg(F.min("doc_id").alias("rep"))
    name = F.lit(0).cast("long") if one_id else F.col("fa")
    classes = written(classes.select("fa", "fb", F.struct(F.col("rep").isNull().alias("lone"), F.coalesce("rep", "fa").alias("id"), name.alias("class")).alias("node")), "jac-names")
    edges = links.join(classes.select(F.col("fa").alias("x"), F.col("node").alias("a")), "x").join(classes.select(F.col("fa").alias("y"), F.col("node").alias("b")), "y")
    comp = components(edges.select("a", "b"), "jac-cc")
    named = classes.join(comp, "node", "left").select("fa", "fb", F.coalesce("component", "node").alias("component"))
    return rows.join(named, ["fa", "fb"], "left").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "fa", "component")
