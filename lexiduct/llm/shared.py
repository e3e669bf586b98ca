"""Places, tables and connected components that the operators share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='lexiduct-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    # A path without a scheme is one of Spark's default file system, for our own files too.
    return _hadoop(spark, base)[1].toString().rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path with its scheme."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/lexiduct/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read again: cuts
    lineage and survives the loss of executors."""
    path = work_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that `written` gave, once all that reads them has been
    written itself."""
    for t in tables:
        if path := getattr(t, "_written_to", None):
            fs, p = _hadoop(t.sparkSession, path)
            fs.delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: str, k: int):
    """crc32 of the id as text, modulo k (null for a null id)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(k)


def hash_sample(df: DataFrame, key: str, strata: str, cap: int, most: int = 256) -> tuple[DataFrame, dict, dict]:
    """About cap rows of each stratum (all of a smaller one), picked by a hash of
    the key, so the choice repeats and no rows are shuffled.  Returns the sample,
    and the rate and the rows of each stratum.  More than `most` strata raise."""
    sizes = {r[0]: r[1] for r in df.where(F.col(strata).isNotNull()).groupBy(strata).count().limit(most + 1).collect()}
    if len(sizes) > most:
        raise ValueError(f"{strata} has more than {most} values")
    rates = {k: min(1.0, cap / n) for k, n in sizes.items()}
    if not rates:
        return df.where(F.lit(False)), rates, sizes
    rate = F.coalesce(*[F.when(F.col(strata) == F.lit(k), F.lit(v)) for k, v in rates.items()])
    picked = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1_000_000)) < rate * 1_000_000
    return df.where(picked), rates, sizes


def labelled_sample(docs: DataFrame, labels: DataFrame, cap: int, max_bytes: int) -> tuple[pa.Table, dict]:
    """text, label of about cap documents of each label (labels: doc_id, label), of texts up
    to max_bytes, and the rate of each label.  Labels are counted and sampled before they
    meet the documents, so only a sample of cap labels is broadcast.

    An id may have many rows: those equal in id and text are one document, and where more than
    twice cap documents of a label are met, a hash of id and text picks about cap of them.
    So the driver gets 2 * cap * max_bytes of a label at most, whatever the ids."""
    sample, rates, _ = hash_sample(labels.where("label is not null and doc_id is not null"), "doc_id", "label", cap)
    met = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", "label")), "doc_id").where(F.octet_length("text") <= max_bytes)
    met = written(met.dropDuplicates(["doc_id", "text"]), "sample")
    picked = met
    for label, n in [tuple(r) for r in met.groupBy("label").count().collect()]:
        if n > 2 * cap:
            rates[label] *= cap / n
            few = F.pmod(F.xxhash64("doc_id", "text", F.lit(19)), F.lit(1_000_000)) < cap / n * 1_000_000
            picked = picked.where((F.col("label") != F.lit(label)) | few)
    got = picked.select("text", "label").toArrow().sort_by([("label", "ascending"), ("text", "ascending")])  # so that a fit repeats
    discard(met)
    return got, rates


#: Edges that one task may contract; more are contracted by rounds of joins.
FEW_EDGES = 16_384


def _contract(edges: DataFrame, tag: str) -> DataFrame:
    """node, p (its component) of a few edges, by union-find in one task."""
    schema = edges.select(F.col("a").alias("node"), F.col("b").alias("p")).schema
    fields = getattr(schema["node"].dataType, "names", None)

    def run(batches):
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        kind = None
        key = (lambda v: tuple(v[f] for f in fields)) if fields else (lambda v: v)  # in Spark's order of structs
        for b in batches:
            kind = b["a"].type
            for x, y in zip(b["a"].to_pylist(), b["b"].to_pylist()):
                x, y = find(key(x)), find(key(y))
                if x != y:
                    parent[max(x, y)] = min(x, y)
        if parent:
            nodes = list(parent)
            value = (lambda v: dict(zip(fields, v))) if fields else (lambda v: v)
            yield pa.RecordBatch.from_arrays([pa.array([value(v) for v in nodes], kind), pa.array([value(find(v)) for v in nodes], kind)], names=["node", "p"])

    return written(edges.select("a", "b").coalesce(1).mapInArrow(run, schema), tag)


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of edges (a, b: longs or structs without nulls) -> (node,
    component), the component being its smallest node.  Nodes without an edge are not returned.

    Each round maps every node to its smallest neighbour (or itself), shortens
    the pointers once, and contracts the graph to the edges left between
    different parents.  At least half of the nodes vanish in a round.  Minima are
    pre-aggregated before the shuffle and the joins are plain equi-joins, so a
    node with very many edges doesn't land in one task.  Once FEW_EDGES or fewer are left,
    one task contracts them."""
    left = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), tag)
    maps: list[DataFrame] = []
    while n := left.limit(FEW_EDGES + 1).count():
        if n <= FEW_EDGES:
            maps.append(_contract(left, tag))
            discard(left)
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("p"))
        near = written(up, tag)
        over = near.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        up = written(near.join(over, "p", "left").select("node", F.coalesce("pp", "p").alias("p")), tag)
        maps.append(up)
        to_a = up.select(F.col("node").alias("a"), F.col("p").alias("pa"))
        to_b = up.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        rest = left.join(to_a, "a").join(to_b, "b").where("pa <> pb")
        rest = written(rest.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), tag)
        discard(near, left)
        left = rest
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).where(F.lit(False))
    out = maps[0].select("node", F.col("p").alias("component"))
    for later in maps[1:]:
        step = later.select(F.col("node").alias("component"), F.col("p").alias("next"))
        out = out.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return out
