"""WARC archives: a writer task per partition and a sequential reader.

An archive is a sequence of gzip members, one for each record. The reader inflates one member at a time with an
incremental zlib object, takes the block by Content-Length, and compares block and payload with their SHA-1 digests.

Cases: a null payload is empty; a null url gives the target ``urn:unknown``; a row with a null id is written and comes
back with a null id. Of rows with equal payloads those with the largest id are responses, the others revisit it; if all
ids are null, all are responses. Repeated rows are records of their own. An empty table gives no record. Columns beside
those named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm.util import shared_dir, steady

CHUNK = 1 << 20
#: An archive is closed once it has this many compressed bytes.
ARCHIVE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
RECORDS = "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, digest_ok boolean, error string"


class WarcError(ValueError):
    pass


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(ident: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """One record as a gzip member: a response, or a revisit if refers_to is given."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    uri = "".join(c for c in url or "urn:unknown" if c.isprintable())
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'none' if ident is None else ident}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[5:5] = [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + press.compress(block + b"\r\n\r\n") + press.flush()


def members(source: BinaryIO, chunk: int = CHUNK) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one after the other."""
    rest = b""
    while True:
        rest = rest or source.read(chunk)
        if not rest:
            return
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not rest and not (rest := source.read(chunk)):
                raise WarcError("the archive ends inside a member")
            try:
                parts.append(inflate.decompress(rest))
            except zlib.error as e:
                raise WarcError(f"a member is not gzip: {e}") from e
            rest = inflate.unused_data
        yield b"".join(parts)


def parse(member: bytes) -> dict[str, Any]:
    """A record of an inflated member. error tells what is wrong with its framing or digests."""
    end = member.find(b"\r\n\r\n")
    first, *lines = member[: max(end, 0)].decode("utf-8", "replace").split("\r\n")
    if end < 0 or not first.startswith("WARC/"):
        raise WarcError("a member does not start with a WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not fields.get("content-length", "").isdigit():
        raise WarcError("a record has no Content-Length")
    size = int(fields["content-length"])
    block = member[end + 4 : end + 4 + size]
    errors = []
    if len(block) != size or member[end + 4 + size :] != b"\r\n\r\n":
        errors.append("length")
    split = block.find(b"\r\n\r\n")
    head, payload = (block[:split], block[split + 4 :]) if split >= 0 else (b"", block)
    revisit = fields.get("warc-type") == "revisit"
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields.get("warc-block-digest", "").removeprefix("sha1:") != digest(block):
        errors.append("block digest")
    if not revisit and stated != digest(payload):
        errors.append("payload digest")
    length = next((int(x[15:]) for x in head.decode("latin-1").split("\r\n") if x.lower().startswith("content-length:")), len(payload))
    number = lambda k: int(x) if (x := fields.get(k, "").removeprefix("<urn:x-page:").rstrip(">")).lstrip("-").isdigit() else None
    return {
        "id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": fields.get("warc-type"), "payload_bytes": length if revisit else len(payload),
        "payload_digest": stated, "refers_to": number("warc-refers-to"), "payload": None if revisit else payload, "digest_ok": not errors, "error": ", ".join(errors) or None,
    }


def records(source: BinaryIO) -> Iterator[dict[str, Any]]:
    """The records of an archive; where it cannot be read on, its last record has only an error."""
    try:
        for member in members(source):
            yield parse(member)
    except (WarcError, zlib.error) as broken:
        yield dict.fromkeys(x.split()[0] for x in RECORDS.split(", ")) | {"digest_ok": False, "error": str(broken)}


def opened(path: str, write: bool = False):  # noqa: ANN201
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    if not write:
        return system.open_input_stream(at, compression=None)
    system.create_dir(os.path.dirname(at), recursive=True)
    return system, at


def write_archives(df: DataFrame, folder: str, id_col: str, url_col: str, payload_col: str, refers_col: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 6) -> DataFrame:
    """Writes each partition of df to archives below folder (any store that pyarrow opens); returns their manifest, lazily.

    A task writes under a name of its own attempt and renames at the end, so a lost or repeated task leaves one archive.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, out, system, temp, size, n = TaskContext.get(), 0, None, None, "", 0, 0

        def close() -> pa.RecordBatch:
            nonlocal out, made
            out.close()
            final = f"{folder}/part-{task.partitionId():06d}-{made:04d}.warc.gz"
            system.move(temp, opened(final, write=True)[1])
            out, made = None, made + 1
            return pa.RecordBatch.from_pydict({"path": [final], "records": [n], "bytes": [size]})

        for batch in batches:
            for ident, url, payload, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    system, temp = opened(f"{folder}/_open/{task.partitionId()}-{task.taskAttemptId()}-{made}", write=True)
                    out, size, n = system.open_output_stream(temp, compression=None), 0, 0
                out.write(record(ident, url, payload or b"", refers, level))
                size, n = out.tell(), n + 1
                if size >= archive_bytes:
                    yield close()
        if out is not None:
            yield close()

    return df.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(payload_col).cast("binary"), F.col(refers_col).cast("long")).mapInArrow(steady(write), MANIFEST)


def read_archives(manifest: DataFrame, errors: str = "raise", payloads: bool = True) -> DataFrame:
    """A row for each record of the archives in manifest.path. errors: raise on a broken record, or keep it with its error; an
    archive that is cut or no archive gives the records before the break and one row with the error."""
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[x.split()[1]] for x in RECORDS.split(", ")]

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types, strict=True)], names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with opened(path) as source:
                    for r in records(source):
                        if r["error"] and errors == "raise":
                            raise WarcError(f"{path}: {r['error']}")
                        if not payloads:
                            r["payload"] = None
                        held += len(r["payload"] or b"")
                        rows.append(r)
                        if len(rows) >= 2000 or held >= CHUNK * 8:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return manifest.select("path").coalesce(1).repartition(n).mapInArrow(steady(read), RECORDS)


def with_revisits(df: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """Adds refers_to: of rows whose payloads of at least min_bytes are equal, the largest id; null for that row itself."""
    key = F.when(F.octet_length(payload_col) >= min_bytes, F.sha1(payload_col))
    keyed = df.withColumn("_key", key)
    largest = df.select(key.alias("_key"), F.col(id_col).alias("_id")).filter("_key is not null").groupBy("_key").agg(F.max("_id").alias("_largest"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 and _largest is not null").select("_key", "_largest")
    joined = keyed.join(largest, "_key", "left")
    return joined.withColumn("refers_to", F.when(F.col(id_col).eqNullSafe(F.col("_largest")), None).otherwise(F.col("_largest"))).drop("_key", "_largest")


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives of pages(page_id, url, html), written to the shared folder and read back."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), F.coalesce(pages["html"].cast("binary"), F.lit(bytearray())).alias("payload"))
    folder = shared_dir(spark, "warc")
    write_archives(with_revisits(rows, "page_id", "payload", min_bytes), f"{folder}/archives", "page_id", "url", "payload", "refers_to").write.parquet(f"{folder}/manifest")
    return read_archives(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest"), payloads=False)
