"""Sharded WARC archives: written in order of a key, read back record by record.

Writing is deterministic: the ranges come from the data, records are sorted, files are rolled by
compressed size, and headers, identifiers and digests are made anew. A task writes under names that no
other attempt uses; the list of what the successful attempts wrote is stored first, and only
those files get their final names and an entry in the manifest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kifuframe.llm.common import range_bounds, shuffle_width, stored
from kifuframe.sources.files import filesystem_of

ROLL_BYTES = 1 << 30
LATEST = (1 << 63) - 1
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ_BYTES = 1 << 20
MANIFEST = "shard int, file int, temporary string, name string, records bigint, bytes bigint, sha256 string"
_MANIFEST_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("file", pa.int32()), ("temporary", pa.string()), ("name", pa.string()),
    ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def digest32(payload: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(ident: int | None, copy: int) -> str:
    return f"<urn:record:{'none' if ident is None else ident}:{copy}>"


def ident_of(record: str | None) -> int | None:
    """The row id in a record id; None for a row without one."""
    name = record.strip("<>").split(":")[2] if record else "none"
    return None if name == "none" else int(name)


def record_bytes(ident: int | None, copy: int, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record as a gzip member without a time stamp; a revisit has the HTTP headers only."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id(ident, copy)}",
            f"WARC-Date: {DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;()@*[]' + chr(39))}")
    if refers_to:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


class _Shard:
    """Writes the files of one shard, one after the other."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.fs, self.base = filesystem_of(folder)
        self.shard, self.roll, self.number = shard, roll, 0
        self.out = None
        self.attempt = uuid.uuid4().hex
        self.rows: list[tuple] = []

    def add(self, record: bytes) -> None:
        if self.out is not None and self.size + len(record) > self.roll:
            self.close()
        if self.out is None:
            self.temporary = f"_temporary/{self.shard:06d}-{self.number:05d}-{self.attempt}"
            self.fs.create_dir(f"{self.base}/_temporary")
            self.out = self.fs.open_output_stream(f"{self.base}/{self.temporary}", compression=None)
            self.size, self.records, self.sum = 0, 0, hashlib.sha256()
        self.out.write(record)
        self.sum.update(record)
        self.size += len(record)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append((self.shard, self.number, self.temporary, f"{self.shard:06d}-{self.number:05d}.warc.gz",
                              self.records, self.size, self.sum.hexdigest()))
            self.number += 1
            self.out = None


def _records(pages: DataFrame, ident: str, url: str, payload: str, least_bytes: int) -> DataFrame:
    """Records and, before each group of equal payloads that is held elsewhere, a marker that says by whom."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(ident).cast("bigint").alias("ident"), F.col(url).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumns({
        "key": F.coalesce("ident", F.lit(LATEST)),
        "digest": F.when(F.octet_length("body") >= least_bytes, F.sha1("body"))})
    light = rows.where(F.col("digest").isNotNull()).groupBy("digest", "key").agg(F.lit(1).alias("one"))
    firsts = light.groupBy(F.col("digest").alias("d")).agg(
        F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    markers = light.join(firsts.repartition("first"), (F.col("digest") == F.col("d")) & (F.col("key") != F.col("first")))
    return rows.select("key", "digest", F.lit(1).alias("kind"), "ident", "url", "body", F.lit(None).cast("bigint").alias("first")) \
        .unionByName(markers.select(
            "key", "digest", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("ident"),
            F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("body"), "first"))


def write_warc(pages: DataFrame, folder: str, ident: str = "page_id", url: str = "url", payload: str = "html",
               shards: int | None = None, roll_bytes: int = ROLL_BYTES, least_bytes: int = 0) -> DataFrame:
    """Writes one record per row below ``folder`` and returns the manifest, which is stored there too.

    Of rows with equal payloads of at least ``least_bytes`` bytes, the one with the smallest id is a
    response and the others are revisits of it; smaller payloads are all responses.

    * A null payload is empty, a null url gives no target header. A null id counts as the largest.
    * Rows of equal id and payload: the first by url is the response, or all are revisits of a smaller id.
    * An empty table gives no file and an empty manifest. Other columns are not written.

    Equal payloads are found on digests alone; the payloads move once, into ranges of the id
    (``shards`` of them, by default as many as the session has shuffle partitions), with the markers of
    revisits in the same exchange. ``folder`` must be new and on a file system that all executors share.
    """
    spark = pages.sparkSession
    tagged = _records(pages, ident, url, payload, least_bytes)
    own_key = pages.select(F.coalesce(F.col(ident).cast("bigint"), F.lit(LATEST)).alias("key"))
    bounds = range_bounds(own_key, F.col("key"), shards or shuffle_width(spark)) or [0]

    @F.pandas_udf("int")
    def shard_of(keys):
        return type(keys)(np.searchsorted(bounds, keys.to_numpy(), side="right") - 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = group = first = last = None
        copy = 0
        for batch in batches:
            for place, key, digest, kind, row, link, body, marked in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if shard is None:
                    shard = _Shard(folder, place, roll_bytes)
                if (key, digest) != group:
                    group, first = (key, digest), None
                if kind == 0:  # the marker comes before its records
                    first = record_id(None if marked == LATEST else marked, 0)
                    continue
                copy = copy + 1 if key == last else 0
                last = key
                shard.add(record_bytes(row, copy, link, body, digest32(body), first))
                if digest is not None and first is None:
                    first = record_id(row, copy)
        if shard is not None:
            shard.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*shard.rows, strict=True), _MANIFEST_SCHEMA, strict=True)],
                schema=_MANIFEST_SCHEMA)

    written = (
        tagged.withColumn("place", shard_of("key")).repartitionById(len(bounds), F.col("place"))
        .sortWithinPartitions("key", "digest", "kind", "url")
        .select("place", "key", "digest", "kind", "ident", "url", "body", "first")
        .mapInArrow(run, MANIFEST))
    manifest = stored(written, "warc-manifest")
    _commit(manifest, folder)
    return manifest


def _commit(manifest: DataFrame, folder: str) -> None:
    """Final names for the listed files (a repeated task finds them in place), then the manifest itself."""

    def rename(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem_of(folder)
        for batch in batches:
            for r in batch.to_pylist():
                final = f"{base}/{r['name']}"
                if fs.get_file_info(final).size != r["bytes"]:
                    fs.move(f"{base}/{r['temporary']}", final)
            yield batch

    stored(manifest.mapInArrow(rename, MANIFEST), "warc-renamed")
    manifest.drop("temporary").write.parquet(f"{folder}/_manifest")
    fs, base = filesystem_of(folder)
    if fs.get_file_info(f"{base}/_temporary").type.name == "Directory":
        fs.delete_dir(f"{base}/_temporary")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one record each."""
    inflate, held, rest = zlib.decompressobj(31), [], b""
    while True:
        chunk = rest or stream.read(_READ_BYTES)
        if not chunk:
            if held and any(held):
                raise ValueError("the archive ends inside a record")
            return
        held.append(inflate.decompress(chunk))
        rest = b""
        if inflate.eof:
            yield b"".join(held)
            rest, held, inflate = inflate.unused_data, [], zlib.decompressobj(31)


def parse_record(raw: bytes) -> tuple:
    """``record_type, record_id, target_uri, refers_to, payload_bytes, payload_digest, payload`` of one record.

    The block digest, and for responses the payload digest, are compared with what is there.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    named = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    block = rest[:int(named["content-length"])]
    if len(rest) != len(block) + 4 or f"sha1:{digest32(block)}" != named["warc-block-digest"]:
        raise ValueError(f"damaged record {named.get('warc-record-id')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(h.split(b":")[1]) for h in http.split(b"\r\n") if h.lower().startswith(b"content-length:"))
    digest = named["warc-payload-digest"].removeprefix("sha1:")
    response = named["warc-type"] == "response"
    if response and (len(payload) != size or digest32(payload) != digest):
        raise ValueError(f"damaged payload in {named.get('warc-record-id')}")
    return (named["warc-type"], named["warc-record-id"], named.get("warc-target-uri"), named.get("warc-refers-to"),
            size, digest, payload if response else None)


RECORD = ("record_type string, record_id string, target_uri string, refers_to_id string, payload_bytes bigint, "
          "payload_digest string, payload binary")
_RECORD_SCHEMA = pa.schema([
    ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to_id", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest lists, one task per file; files are streamed, not loaded."""
    from kifuframe.llm.common import batches_of

    listed = spark.read.parquet(f"{folder}/_manifest").select("shard", "file", "name")
    files = max(1, listed.count())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem_of(folder)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for name in batch.column("name").to_pylist():
                    with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                        for raw in members(stream):
                            record = parse_record(raw)
                            yield record if payloads else (*record[:-1], None)

        yield from batches_of(rows(), _RECORD_SCHEMA)

    return listed.repartition(files).mapInArrow(run, RECORD)
