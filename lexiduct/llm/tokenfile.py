"""Token-ID output: bit-plane shuffled shards of token ids.

A shard holds the ids of consecutive documents.  Its ids are cut into blocks of
``block_ids``; each block is transposed into planes -- plane b holds bit (or byte)
b of every id, so the always-zero high planes and the slowly changing ones
compress well -- and every plane is compressed with zstandard on its own.  A plane
that is all zeros takes no bytes.  The footer is the chunk index: where every
block and plane lies, its checksum, and the documents with their ids' places.

    "LXPT1\\n" | planes of block 0 | planes of block 1 | ... | footer | footer length (8 bytes) | "LXPT1\\n"

Any block can be read alone, and a document's ids need only the blocks they touch.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiduct.llm import bpe, files
from lexiduct.llm.shared import work_path

MAGIC = b"LXPT1\n"
BLOCK_IDS = 1 << 16


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """The 32 bit planes or 4 byte planes of unsigned 32-bit ids, lowest first; zero planes are empty."""
    raw = np.ascontiguousarray(ids, "<u4")
    if unit == "byte":
        planes = list(raw.view(np.uint8).reshape(-1, 4).T)
    else:
        top = int(raw.max(initial=0)).bit_length()
        planes = [np.packbits(((raw >> np.uint32(b)) & np.uint32(1)).astype(np.uint8), bitorder="little") for b in range(top)]
        planes += [np.zeros(0, np.uint8)] * (32 - top)
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    out = np.zeros(n, "<u4")
    for b, p in enumerate(planes):
        if p:
            bits = np.frombuffer(p, np.uint8)
            values = bits if unit == "byte" else np.unpackbits(bits, count=n, bitorder="little")
            out |= values.astype("<u4") << np.uint32(b * (8 if unit == "byte" else 1))
    return out


class ShardWriter:
    """Writes one shard to a stream; holds one block at a time."""

    def __init__(self, out, unit: str = "bit", block_ids: int = BLOCK_IDS, level: int = 3):
        self.out, self.unit, self.block_ids = out, unit, block_ids
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.pos = out.write(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.chunks: list[dict] = []
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= self.block_ids:
            flat = np.concatenate(self.waiting)
            full = len(flat) // self.block_ids * self.block_ids
            for i in range(0, full, self.block_ids):
                self._block(flat[i : i + self.block_ids])
            self.waiting, self.n_waiting = [flat[full:]], len(flat) - full

    def _block(self, ids: np.ndarray) -> None:
        sizes, at, crc = [], self.pos, 0
        for plane in to_planes(ids, self.unit):
            packed = self.zstd.compress(plane) if plane else b""
            sizes.append(len(packed))
            crc = zlib.crc32(packed, crc)
            self.out.write(packed)
            self.pos += len(packed)
        self.chunks.append({"at": at, "n": len(ids), "planes": sizes, "crc32": crc})

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        head = {"unit": self.unit, "block_ids": self.block_ids, "n_ids": self.n_ids, "n_docs": len(self.docs), "chunks": self.chunks}
        docs = pa.table({"doc_id": pa.array([d for d, _ in self.docs], pa.int64()), "n": pa.array([n for _, n in self.docs], pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema) as w:
            w.write_table(docs)
        head, body = json.dumps(head).encode(), sink.getvalue().to_pybytes()
        footer = len(head).to_bytes(8, "little") + head + zstandard.ZstdCompressor().compress(body)
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)


class ShardReader:
    def __init__(self, source):
        self.f = source
        size = source.size()
        tail = source.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError("not a token shard, or cut short")
        n = int.from_bytes(tail[:8], "little")
        footer = source.read_at(n, size - 8 - len(MAGIC) - n)
        k = int.from_bytes(footer[:8], "little")
        self.head = json.loads(footer[8 : 8 + k])
        docs = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(footer[8 + k :])).read_all()
        self.doc_ids = docs["doc_id"].to_pylist()
        self.doc_n = docs["n"].to_numpy()
        self.doc_at = np.concatenate([[0], np.cumsum(self.doc_n)]).astype(np.int64)
        self.zstd = zstandard.ZstdDecompressor()
        self.held: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def block(self, i: int) -> np.ndarray:
        if self.held[0] == i:
            return self.held[1]
        c = self.head["chunks"][i]
        raw = self.f.read_at(sum(c["planes"]), c["at"])
        if zlib.crc32(raw) != c["crc32"]:
            raise ValueError(f"block {i} is damaged")
        planes, at = [], 0
        for n in c["planes"]:
            planes.append(self.zstd.decompress(raw[at : at + n]) if n else b"")
            at += n
        self.held = (i, from_planes(planes, c["n"], self.head["unit"]))
        return self.held[1]

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """The ids lo..hi of the shard, from the blocks that they touch."""
        size = self.head["block_ids"]
        out = [self.block(b)[max(lo - b * size, 0) : hi - b * size] for b in range(lo // size, -(-hi // size))] if hi > lo else []
        return np.concatenate(out) if out else np.zeros(0, "<u4")


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, unit: str = "bit", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encodes docs (doc_id long, text string, any other columns ignored) and writes
    shards in ascending order of doc_id to the folder `path`.  Runs at once and
    returns the manifest: shard (ascending with doc_id), uri, n_docs, n_ids, base
    (ids in all shards before).

    A null or empty text has the end id alone; null ids come first; repeated ids keep
    all their rows, next to each other, in the order of a hash of their texts.  Documents
    are dealt by ranges of id and hash, so a shard needs no other, and an id that very
    many rows share is dealt to several; one task holds a batch of texts and a block of ids."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    plain = plain.withColumn("_hash", F.xxhash64("text"))
    ordered = plain.repartitionByRange("doc_id", "_hash").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_hash", "text").select("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        shard = TaskContext.get().partitionId()
        uri = f"{path}/shard-{shard:06d}.lxpt"
        enc = bpe.encoder(tokenizer)
        with files.new_file(uri) as out:
            w = ShardWriter(out, unit, block_ids)
            lo = first["doc_id"][0].as_py()
            for b in _chain(first, batches):
                ids = b["doc_id"].to_pylist()
                for a in range(0, b.num_rows, 256):
                    flat, off = enc.ids(b["text"].slice(a, 256).to_pylist())
                    for i, d in enumerate(ids[a : a + 256]):
                        w.add(d, np.append(flat[off[i] : off[i + 1]], end_id).astype("<u4"))
            w.close()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "uri": [uri], "n_docs": [len(w.docs)], "n_ids": [w.n_ids], "first_doc": pa.array([lo], pa.int64())})

    # One row a shard: the driver orders them and adds up their sizes.
    rows = ordered.mapInArrow(write, "shard long, uri string, n_docs long, n_ids long, first_doc long").collect()
    base, out = 0, []
    for r in sorted(rows, key=lambda r: (r.first_doc is not None, r.first_doc or 0, r.shard)):
        out.append((r.shard, r.uri, r.n_docs, r.n_ids, base))
        base += r.n_ids
    return spark.createDataFrame(out, "shard long, uri string, n_docs long, n_ids long, base long")


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """Reads every shard back: doc_id, start (ids of all documents before it), ids."""

    def read(batches):
        for b in batches:
            for uri, base in zip(b["uri"].to_pylist(), b["base"].to_pylist()):
                with files.random_access(uri) as f:
                    r = ShardReader(f)
                    for a in range(0, len(r.doc_ids), 64):
                        z = min(a + 64, len(r.doc_ids))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(r.doc_ids[a:z], pa.int64()),
                                pa.array(base + r.doc_at[a:z], pa.int64()),
                                pa.array([r.ids(r.doc_at[i], r.doc_at[i + 1]).astype(np.int32) for i in range(a, z)], pa.list_(pa.int32())),
                            ],
                            names=["doc_id", "start", "ids"],
                        )

    n = manifest.count()
    return manifest.select("uri", "base").repartition(max(1, n)).mapInArrow(read, "doc_id long, start long, ids array<int>")


def _chain(first, rest):
    yield first
    yield from rest


def token_digest(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes docs as shards, reads them back and returns doc_id, start, n_tokens, ids_crc32."""
    manifest = write_token_shards(docs, work_path(spark, "tokens"), tokenizer)

    def digest(batches):
        for b in batches:
            ids = b["ids"]
            off = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["start"], pa.array(np.diff(off), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_token_shards(manifest).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
