"""WARC archives and the normaliser of monolithic gzip streams.

Crawls often come as one gzip stream over a whole WARC file, in which no record can be
reached without inflating all before it.  The normaliser inflates such a file once,
as a stream, writes every record as a gzip member of its own, and leaves a sidecar
index (JSON lines: place and length of the member, record id, type, URI, digest), so
that any record can be read alone by its offset.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiduct.llm import files
from lexiduct.llm.shared import work_path, written

DATE = "1970-01-01T00:00:00Z"
SALTS = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 18


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, extra: dict[str, str]) -> bytes:
    """A whole record; a revisit carries no payload."""
    clean = "".join(c for c in uri if c > " " and c != "\x7f")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *(f"{k}: {v}" for k, v in extra.items()),
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one whole record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k: v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record of another length than it says")
    return headers, rest[:n]


def inflated_records(source):
    """The records of a gzip stream of one or many members, one at a time, whole; what
    is inflated and not yet returned stays below a record and a chunk."""
    held, need = bytearray(), None
    z = zlib.decompressobj(31)
    while True:
        raw = source.read(CHUNK)
        if not raw:
            break
        while raw:
            held += z.decompress(raw, CHUNK)
            raw = z.unconsumed_tail
            if z.eof:
                raw, z = z.unused_data, zlib.decompressobj(31)
            while True:
                if need is None:
                    end = held.find(b"\r\n\r\n")
                    if end < 0:
                        break
                    length = next(int(x[15:]) for x in held[:end].split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    need = end + 4 + length + 4
                if len(held) < need:
                    break
                yield bytes(held[:need])
                del held[:need]
                need = None
    if held.strip():
        raise ValueError("the stream ends within a record")


def normalise_file(source, out, index: io.TextIOBase, level: int = 3) -> int:
    """Writes each record of source as its own member to out, and its line to index."""
    at = n = 0
    for data in inflated_records(source):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = z.compress(data) + z.flush()
        head, _ = parse_record(data)
        index.write(json.dumps({"offset": at, "length": len(member), "id": head["WARC-Record-ID"][1:-1], "type": head["WARC-Type"], "uri": head["WARC-Target-URI"], "digest": head["WARC-Payload-Digest"]}) + "\n")
        out.write(member)
        at += len(member)
        n += 1
    return n


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html (null: empty) and original: the smallest page_id with the same
    payload, where the page revisits it, else null.  Payloads of fewer than least_bytes
    never revisit.  Only digests shared by several ids are joined back; rows of one
    page_id and payload are the same page, and none of them revisits another.  A page with
    a null page_id is a response of its own that no other revisits."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    plain = plain.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    # Payloads don't travel by digest, which very many pages may share: ids meet their
    # digest's first one, dealt by a salt too, and payloads only their own id's answer.
    light = plain.where((F.octet_length("html") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "sha")
    shared = light.groupBy("sha").agg(F.min("page_id").alias("original"), F.max("page_id").alias("last_id")).where("original <> last_id")
    shared = shared.select("sha", "original", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    light = light.distinct().withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    revisits = light.join(shared, ["sha", "salt"]).where("page_id > original").select("page_id", "sha", "original")
    return plain.join(revisits, ["page_id", "sha"], "left").select("page_id", "url", "html", "original")


def write_monolithic(pages: DataFrame, path: str) -> DataFrame:
    """Writes pages (page_id, url, html, original) as WARC files, each one gzip stream
    over the whole file, one for each task.  Runs at once; returns uri, records."""

    def run(batches):
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        uri, n = f"{path}/crawl-{TaskContext.get().partitionId():06d}.warc.gz", 0
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        with files.new_file(uri) as out:
            for b in (x for part in ((first,), batches) for x in part):
                for page, url, html, original in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html", "original"))):
                    payload = html.encode("utf-8", "surrogatepass")
                    digest = payload_digest(payload)
                    name = f"urn:page:{'' if page is None else page}"
                    if original is None:
                        data = record("response", name, url, payload, digest, {})
                    else:
                        extra = {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{original}>", "Payload-Length": str(len(payload))}
                        data = record("revisit", name, url, b"", digest, extra)
                    out.write(z.compress(data))
                    n += 1
            out.write(z.flush())
        yield pa.RecordBatch.from_pydict({"uri": [uri], "records": [n]})

    return _listed(pages.mapInArrow(run, "uri string, records long"))


def normalise_archives(archives: DataFrame) -> DataFrame:
    """Normalises each archive (uri) to <name>.norm.warc.gz beside it, with its sidecar
    index.  Runs at once; returns uri, index_uri, records."""

    def run(batches):
        for b in batches:
            for uri in b["uri"].to_pylist():
                to = uri.removesuffix(".warc.gz") + ".norm.warc.gz"
                lines = io.StringIO()
                with files.stream(uri) as source, files.new_file(to) as out:
                    n = normalise_file(source, out, lines)
                with files.new_file(to + ".idx") as side:
                    side.write(lines.getvalue().encode())
                yield pa.RecordBatch.from_pydict({"uri": [to], "index_uri": [to + ".idx"], "records": [n]})

    return _listed(_one_each(archives).mapInArrow(run, "uri string, index_uri string, records long"))


def _listed(df: DataFrame) -> DataFrame:
    """Runs df, one row for each file, and keeps its rows."""
    return written(df, "warc-list")


def _one_each(df: DataFrame) -> DataFrame:
    return df.repartition(max(1, df.count()))


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of normalised archives (uri, index_uri), each read by its own place in
    the index: page_id, uri, record_type, refers_to, payload_bytes, payload_digest and
    payload (null for revisits).  Payloads are checked against their digests."""
    names = ["page_id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def run(batches):
        number = lambda s: int(s) if (s := s.strip("<>").removeprefix("urn:page:")) else None
        for b in batches:
            for uri, side in zip(b["uri"].to_pylist(), b["index_uri"].to_pylist()):
                with files.stream(side) as s:
                    places = [json.loads(x) for x in s.read().decode().splitlines()]
                with files.random_access(uri) as f:
                    for lo in range(0, len(places), 100):
                        rows = []
                        for p in places[lo : lo + 100]:
                            head, payload = parse_record(zlib.decompress(f.read_at(p["length"], p["offset"]), 31))
                            told = head["WARC-Payload-Digest"].removeprefix("sha1:")
                            revisit = head["WARC-Type"] == "revisit"
                            if not revisit and payload_digest(payload) != told:
                                raise ValueError(f"{p['id']}: its payload is damaged")
                            size = int(head["Payload-Length"]) if revisit else len(payload)
                            rows.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], number(head["WARC-Refers-To"]) if revisit else None, size, told, None if revisit else payload))
                        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return _one_each(archives.select("uri", "index_uri")).mapInArrow(run, "page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def archive_digest(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages as monolithic archives, normalises them and reads them back."""
    crawl = write_monolithic(with_originals(pages), work_path(spark, "warc"))
    return read_archives(normalise_archives(crawl)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
