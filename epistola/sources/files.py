"""Sources over folders: a Spark data source of JSON lines (batch, stream), a sink for label changes, and a table for look-ups by id.

``mail_jsonl`` reads a folder of provider messages. Filters on internalDate and sent are pushed to it, and files whose ``.stats`` (written by
``write_stats``) show no message in their range aren't opened. As a stream its offset is, for each file, the bytes up to its last whole line, so a run that starts again goes on where the last one was committed, also within a file.

``mail_labels`` takes label changes: each task writes its own to a file aside, and only the commit of all tasks makes them the provider's; a failed or aborted write leaves nothing.

``KeyedTable`` holds messages in buckets by id, sorted, with a Bloom filter of the ids in each file; looking up some ids opens their buckets' files only.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from ..errors import ConfigError
from .mail import FULL, MailSource, Scope, TableSource

#: Bytes of a file that one partition reads; bytes at a file's end that are searched for its last line at a time.
SPLIT_BYTES, TAIL_BYTES = 128 << 20, 1 << 16


@dataclass
class _Split(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class _Range:
    """What is asked for: internalDate from low to high, both included; sent, not sent, or both."""

    low: int | None = None
    high: int | None = None
    sent: bool | None = None

    def narrow(self, f: Filter) -> bool:
        """Whether the filter is one of these, which then holds too."""
        column = f.attribute if hasattr(f, "attribute") else None
        value = getattr(f, "value", None)
        if column == ("sent",) and isinstance(f, EqualTo) and isinstance(value, bool):
            if self.sent is not None and self.sent != value:
                self.low, self.high = 1, 0  # nothing is both
            self.sent = value
            return True
        if column != ("internalDate",) or not isinstance(value, int):
            return False
        low = {GreaterThanOrEqual: value, GreaterThan: value + 1, EqualTo: value}.get(type(f))
        high = {LessThanOrEqual: value, LessThan: value - 1, EqualTo: value}.get(type(f))
        self.low = low if self.low is None else self.low if low is None else max(self.low, low)
        self.high = high if self.high is None else self.high if high is None else min(self.high, high)
        return low is not None or high is not None

    def has(self, at: int | None, sent: bool) -> bool:
        if (self.low is not None or self.high is not None) and at is None:
            return False
        return (self.low is None or at >= self.low) and (self.high is None or at <= self.high) and (self.sent is None or sent == self.sent)

    def may_be_in(self, stats: dict) -> bool:
        dated = self.low is None and self.high is None or (stats["low"] is not None and (self.low is None or stats["high"] >= self.low) and (self.high is None or stats["low"] <= self.high))
        return dated and (self.sent is None or (stats["sent"] if self.sent else stats["rows"] - stats["sent"]) > 0)


def _files(path: str):
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    return store, sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(root)) if f.is_file and f.path.endswith(".jsonl"))


def _row(line: bytes) -> tuple:
    m = json.loads(line.decode("utf-8", "replace"))
    labels = m.get("labelIds") or []
    at = int(m["internalDate"]) if m.get("internalDate") else None
    return m.get("id"), m.get("threadId"), at, labels, json.dumps(m.get("payload") or {}), "SENT" in labels


class _Lines:
    """What batch and stream readers share: lines of splits, in the range asked for."""

    def __init__(self, options: dict):
        if "path" not in options:
            raise ConfigError("mail_jsonl needs a path")
        self.path = options["path"]
        self.range = _Range(int(options["since_ms"]) if "since_ms" in options else None, None, None if str(options.get("include_sent", "true")).lower() != "false" else False)
        self.split = int(options.get("split_bytes", SPLIT_BYTES))

    def _splits(self, path: str, start: int, end: int) -> list[_Split]:
        return [_Split(path, at, min(end, at + self.split)) for at in range(start, end, self.split)]

    def read(self, partition: _Split) -> Iterator[tuple]:
        """The lines that start within the partition's bytes."""
        from pyarrow import fs

        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.path) as raw:
            raw.seek(max(0, partition.start - 1))
            f = io.BufferedReader(raw)
            at = partition.start
            if at:  # the line that the byte before belongs to is another partition's
                at += len(f.readline()) - 1
            while at < partition.end and (line := f.readline()):
                at += len(line)
                if line.strip() and self.range.has((row := _row(line))[2], row[5]):
                    yield row


class _Batch(_Lines, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if not self.range.narrow(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        store, files = _files(self.path)
        out: list[InputPartition] = []
        for path, size in files:
            stats = read_stats(store, path, size)
            if stats is None or self.range.may_be_in(stats):
                out += self._splits(path, 0, size)
        return out or [_Split("", 0, 0)]


class _Stream(_Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """For each file, the bytes up to the end of its last whole line."""
        store, files = _files(self.path)
        return {path: _whole_lines(store, path, size) for path, size in files}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [s for path, to in sorted(end.items()) for s in self._splits(path, start.get(path, 0), to)] or [_Split("", 0, 0)]

    def commit(self, end: dict) -> None:
        """Spark's checkpoint holds the offset."""


def _whole_lines(store, path: str, size: int) -> int:
    with store.open_input_file(path) as f:
        end = size
        while end > 0:
            start = max(0, end - TAIL_BYTES)
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


class JsonLinesMail(DataSource):
    """``spark.read.format("mail_jsonl").load(folder)``, or ``readStream``: provider messages, a partition for each ``split_bytes`` of a file; options since_ms
    and include_sent, and pushed filters, are applied while reading."""

    @classmethod
    def name(cls) -> str:
        return "mail_jsonl"

    def schema(self) -> str:
        return "id string, threadId string, internalDate bigint, labelIds array<string>, payload string, sent boolean"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)


def read_stats(store, path: str, size: int) -> dict | None:
    """What ``write_stats`` noted of the file, as long as it has the size that it had then."""
    from pyarrow import fs

    if store.get_file_info(f"{path}.stats").type != fs.FileType.File:
        return None
    with store.open_input_file(f"{path}.stats") as f:
        stats = json.loads(f.read())
    return stats if stats["size"] == size else None


def write_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Notes rows, sent rows and the first and last time of each file beside it; a task a file. Gives what it noted."""
    _, files = _files(folder)

    def note(batches):
        import pandas as pd
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, size in zip(batch["path"], batch["size"], strict=True):
                own = _Lines({"path": folder})
                rows = sent = 0
                low = high = None
                for r in own.read(_Split(path, 0, int(size))):
                    rows, sent = rows + 1, sent + r[5]
                    if r[2] is not None:
                        low, high = r[2] if low is None else min(low, r[2]), r[2] if high is None else max(high, r[2])
                with store.open_output_stream(f"{path}.stats") as f:
                    f.write(json.dumps({"size": int(size), "rows": rows, "sent": sent, "low": low, "high": high}).encode())
                yield pd.DataFrame({"path": [path], "rows": [rows], "sent": [sent]})

    given = spark.createDataFrame(files, "path string, size long").repartition(max(1, len(files)))
    return spark.createDataFrame(given.mapInPandas(note, "path string, rows long, sent long").collect(), "path string, rows long, sent long")  # a row a file


# -- label changes -----------------------------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    path: str | None
    rows: int


class _LabelWriter(DataSourceWriter):
    """Changes of one write, in a folder of their own until all tasks are done."""

    def __init__(self, options: dict):
        if "path" not in options:
            raise ConfigError("mail_labels needs a path")
        self.path, self.batch = options["path"], options.get("batch") or uuid.uuid4().hex
        self.fail = options.get("fail_on")

    def write(self, rows) -> WriterCommitMessage:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        lines = []
        for r in rows:
            if self.fail and r["message_id"] == self.fail:
                raise OSError(f"the provider refuses {r['message_id']}")
            add, remove = ([x for x in (r[c] or []) if x and x.strip()] for c in ("add", "remove"))
            if add or remove:
                lines.append(json.dumps({"account": r["account"], "message_id": r["message_id"], "add": add, "remove": remove}))
        if not lines:
            return _Written(None, 0)
        store.create_dir(f"{root}/_aside/{self.batch}", recursive=True)
        own = f"{root}/_aside/{self.batch}/{uuid.uuid4().hex}.jsonl"
        with store.open_output_stream(own) as f:
            f.write(("\n".join(lines) + "\n").encode())
        return _Written(own, len(lines))

    def commit(self, messages: list) -> None:
        """The files that tasks handed over, and no others, such as those of tasks that ran twice, become one batch."""
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        paths = {m.path for m in messages if m is not None and m.path}
        aside = f"{root}/_aside/{self.batch}"
        if paths:
            for f in store.get_file_info(fs.FileSelector(aside)):
                if f.path not in paths:
                    store.delete_file(f.path)
            store.move(aside, f"{root}/{self.batch}.changes")  # a folder gets its name at once

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        self._clear(*fs.FileSystem.from_uri(self.path))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/_aside/{self.batch}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_aside/{self.batch}")


class LabelChanges(DataSource):
    """``changes.write.format("mail_labels").mode("append").save(folder)``: account, message_id, add, remove."""

    @classmethod
    def name(cls) -> str:
        return "mail_labels"

    def schema(self) -> str:
        return "account string, message_id string, add array<string>, remove array<string>"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _LabelWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes both known to the session, and lets it push filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JsonLinesMail)
    spark.dataSource.register(LabelChanges)


# -- look-ups by id ----------------------------------------------------------------------------------


@dataclass
class KeyedTable(MailSource):
    """A source over ``FULL`` rows in ``buckets`` by id. Up to ``few`` ids are looked up in their buckets' files; more are joined."""

    spark: SparkSession
    path: str
    address: str | None = None
    buckets: int = 256
    few: int = 10_000
    now_ms: int | None = None
    one_pass: bool = field(default=True)

    @staticmethod
    def write(rows: DataFrame, path: str, buckets: int = 256) -> None:
        """Sorted by id within a bucket; a bucket is a file."""
        b = rows.withColumn("bucket", _bucket(buckets))
        b.repartition(buckets, "bucket").sortWithinPartitions("bucket", "id").write.partitionBy("bucket").option("parquet.bloom.filter.enabled#id", "true").mode("overwrite").parquet(path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"{FULL}, bucket int").parquet(self.path)

    def check(self) -> dict:
        return {"ok": True, "address": self.address}

    def list_ids(self, scope: Scope) -> DataFrame:
        return TableSource(self.rows().drop("bucket"), self.address, now_ms=self.now_ms).list_ids(scope)

    def get_metadata(self, ids: DataFrame) -> DataFrame:
        return self.get_full(ids).drop("bodyText", "bodyHtml", "mimeType")

    def get_full(self, ids: DataFrame) -> DataFrame:
        wanted = ids.select("id").distinct()
        named = [r["id"] for r in wanted.limit(self.few + 1).collect()]
        if len(named) > self.few:
            keyed = wanted.withColumn("bucket", _bucket(self.buckets))
            return self.rows().join(keyed, ["bucket", "id"], "left_semi").drop("bucket")
        held = sorted({r["bucket"] for r in self.spark.createDataFrame([(i,) for i in named], "id string").select(_bucket(self.buckets).alias("bucket")).distinct().collect()})
        return self.rows().where(F.col("bucket").isin(held) & F.col("id").isin(named)).drop("bucket")


def _bucket(n: int):
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
