"""Dictionary-compressed WARC archives (op3).

Each archive is a file of its own: a leading skippable frame (magic 0x184D2A5D) that holds a Zstandard
dictionary, then one frame a record, compressed on its own with the dictionary, so any record can
be read from its offset. The dictionary is built from the archive's own records, spread evenly
over it, up to ``SAMPLE_BYTES``; an archive with too little to learn from has an empty dictionary frame.

Payloads that are equal and at least ``min_bytes`` long are stored once: the smallest page_id has a response
record, the others are revisits that name it and repeat size and digest. Digests are computed in one narrow
pass; only digests of two or more pages take part in a join, so large groups of copies cost one row a page and
no payload is shuffled for them.

Archives are written to the shared folder under a name of their own for each attempt and renamed when they are complete, so a task
that runs again replaces its archive by an equal one. A worker holds one archive's payloads (``ARCHIVE_BYTES``) at
a time.

Defined results: a null html is an empty payload; a null or odd url becomes a urn of the page; rows that repeat the
smallest page_id of their payload are responses each; a row without a page_id has a record whose id names none: a revisit where a
page with an id has its payload, else a response; an empty table writes no archive and reads no record. Only
the id, url and html columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import bound_batches, delete_at_exit, join_spread, materialize, scratch_path, table

SKIPPABLE = 0x184D2A5D
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 32 << 20, 2 << 20, 64 << 10, 3
MIN_SAMPLES = 16
DATE = "1970-01-01T00:00:00Z"  # the tables have no time of capture
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_ID = "urn:epistola:page:"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; with ``refers_to`` a revisit without payload."""
    if refers_to is None:
        block, kind, extra = _HTTP % len(payload) + payload, "response", ""
    else:
        block, kind = _HTTP % size, "revisit"
        extra = f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <{_ID}{refers_to}>\r\n"
    target = url if url and not any(c <= " " for c in url) else f"{_ID}{'none' if page_id is None else page_id}"
    own = f"{_ID}{'none' if page_id is None else page_id}"
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{own}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {target}\r\n"
        f"WARC-Payload-Digest: sha1:{digest}\r\n{extra}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record: {lines[0][:20]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    length = int(fields["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("the record's block has another length than its header says")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    refers = fields.get("warc-refers-to")
    if fields["warc-type"] == "response" and (size, digest) != (len(payload), payload_digest(payload)):
        raise ValueError("the payload differs from its digest")
    number = lambda x: None if (n := x.removeprefix(f"<{_ID}").removesuffix(">")) == "none" else int(n)
    return {"page_id": number(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": number(refers) if refers else None, "payload": payload}


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    total = sum(map(len, records))
    step = max(1, -(-total // sample_bytes))
    samples = records[::step]
    used = sum(map(len, samples))
    if len(samples) < MIN_SAMPLES or used < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, used // 10)), samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too little that repeats
        return b""


def write_archive(records: list[bytes], level: int = LEVEL) -> bytes:
    dictionary = build_dictionary(records)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(dictionary)), dictionary, *map(compressor.compress, records)])


def read_archive(raw: bytes) -> Iterator[bytes]:
    """The records of an archive, each from its own frame."""
    magic, length = struct.unpack_from("<II", raw)
    if magic != SKIPPABLE:
        raise ValueError("the archive has no dictionary frame")
    dictionary = raw[8 : 8 + length]
    dicted = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    view, at = memoryview(raw), 8 + length
    while at < len(raw):
        one = dicted.decompressobj()
        parts, step = [], 1 << 16
        while not one.eof and at < len(raw):
            parts.append(one.decompress(view[at : at + step]))
            at += step
        at = min(at, len(raw)) - len(one.unused_data)
        yield b"".join(parts)


def _plan(pages: DataFrame, min_bytes: int) -> DataFrame:
    """pages with ``refers_to``: the response's page_id for revisits."""
    schema = pa.schema([("page_id", pa.int64()), ("digest", pa.binary())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(h.as_py() or "").encode("utf-8", "replace") for h in batch.column(1)]
            keep = [k for k, r in enumerate(raw) if len(r) >= min_bytes]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([hashlib.sha1(raw[k]).digest() for k in keep], pa.binary())], schema=schema)

    each = materialize(pages.select("page_id", "html").mapInArrow(digests, "page_id long, digest binary"), "digests")
    shared = each.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").select("digest", "refers_to")
    revisits = join_spread(each, shared, ["digest"]).where("page_id is null or page_id <> refers_to").select("page_id", "refers_to", "digest")
    return materialize(revisits, "revisits")


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE, level: int = LEVEL, held_bytes: int = 64 << 20) -> DataFrame:
    """Write archives to ``path``; a row for each: archive, records, bytes. ``path`` is one that workers can write to."""
    spark = pages.sparkSession
    bound_batches(spark)
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    revisits = _plan(p, min_bytes)
    small = revisits.count() * 120 <= held_bytes
    if small:
        got = revisits.toArrow()
        held = spark.sparkContext.broadcast(dict(zip(zip(got.column("page_id").to_pylist(), got.column("digest").to_pylist(), strict=True), got.column("refers_to").to_pylist(), strict=True)))
    else:  # a page_id may repeat with other payloads: the digest is compared, too
        few = revisits.groupBy("page_id").agg(F.collect_set(F.struct("digest", "refers_to")).alias("r"))
        few = few.withColumnRenamed("page_id", "own_id")
        p = p.join(few, p["page_id"].eqNullSafe(few["own_id"]), "left").drop("own_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, records, size, n = TaskContext.get(), [], 0, 0
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)

        def close() -> pa.RecordBatch:
            nonlocal records, size, n
            raw = write_archive(records, level)
            name = f"part-{task.partitionId():06d}-{n:04d}.warc.zst"
            trial = f"{root}/.{name}.{task.taskAttemptId()}"
            with store.open_output_stream(trial, compression=None) as out:
                out.write(raw)
            store.move(trial, f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([len(records)], pa.int64()), "bytes": pa.array([len(raw)], pa.int64())})
            records, size, n = [], 0, n + 1
            return row

        for batch in batches:
            more = batch.column(3).to_pylist() if not small else [None] * batch.num_rows
            for page, url, html, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), more, strict=True):
                payload = (html.as_py() or "").encode("utf-8", "replace")
                sha = hashlib.sha1(payload).digest()
                refers = held.value.get((page, sha)) if small else next((x["refers_to"] for x in r or () if x["digest"] == sha), None)
                one = record(page, url, b"" if refers is not None else payload, len(payload), base64.b32encode(sha).decode(), refers, date)
                records.append(one)
                size += len(one)
                if size >= archive_bytes:
                    yield close()
        if records:
            yield close()

    return materialize(p.mapInArrow(write, "archive string, records long, bytes long"), "archives")


def read_warc(archives: DataFrame, path: str, *, with_payload: bool = False) -> DataFrame:
    """The records of the archives that ``write_warc`` returned."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * with_payload
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    raw = f.read()
                rows: list[dict] = []
                for one in read_archive(raw):
                    rows.append(parse(one) | {"archive": name})
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string" + ", payload binary" * with_payload
    n = max(1, archives.count())
    return archives.select("archive").repartition(n).mapInArrow(read, ddl)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    archives = write_warc(table(spark, sf_dir, "pages"), path)
    delete_at_exit(spark, path)
    return read_warc(archives, path).drop("archive")
