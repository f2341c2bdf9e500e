"""Incremental, reversible line dedup (op10).

A line's key is the line without white space at its ends, A-Z lower-cased. ``LineStore`` keeps, in the
shared file system, an exact table of reference counts (a 128-bit hash of the key and the number of
documents that hold it) and cuckoo filters, a shard of the hashes each, that hold the keys which
reached ``min_docs`` documents. ``insert`` and ``delete`` add and take away documents: counts change by
what the documents hold, keys that cross the threshold upwards are inserted into their shard's
filter and keys that cross it downwards are deleted from it, so deleting what was inserted gives the
former state. ``apply`` drops lines: the filter says which lines may be frequent, the exact table
decides.

Each change writes a new version of table and filters and then a small commit file, so a store that is opened again, also by another
session, goes on at the last version that was finished; what a failed change left is overwritten. A change deletes the versions before the one
it started from. Shards double when frequent keys outgrow ``keys_per_shard``, so what a task gathers of a shard is bounded.

Counting combines within a batch and within a task before its one shuffle, so a line that every
document holds costs a row a task. Where the frequent keys, whose number is read from the table, and the filters take
up to ``held_bytes``, they are sent to the workers as arrays and documents are not shuffled. Beyond
it, lines that pass the filters (all lines, if even those are larger) are joined with the exact table
by their hash, and documents with their lines' places by a row number.

Defined results: a null or empty text is one empty line; empty keys are never dropped; a line repeated
within a document counts once for it and all its places go; each input row is a document of its
own, also where ids repeat; an empty table gives no rows; deleting a document that isn't held is an error and changes nothing. Only the text
column is read; the two added counts replace columns of their names, no other name clashes.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cuckoo import CuckooFilter
from .runtime import bound_batches, delete_at_exit, fresh_name, join_spread, materialize, release, scratch_path, table

MIN_DOCS, MIN_CHARS = 10, 1
#: Largest size of what is sent to every worker: frequent keys (16 bytes each) and filters.
HELD_BYTES = 64 << 20
#: Frequent keys of one shard, about.
KEYS_PER_SHARD = 1_000_000
_BLANK = b" \t\n\x0b\x0c\r"
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_REFS = "h1 long, h2 long, n long"


def line_key(line: str) -> bytes:
    return line.encode("utf-8", "replace").strip(_BLANK).translate(_FOLD)


def key_hash(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    key = line_key(line)
    return xxhash.xxh3_128_digest(key) if len(key) and len(key.decode("utf-8")) >= min_chars else None


def _columns(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
    return both[:, 0], both[:, 1]


class LineStore:
    """Reference counts and filters of a growing set of documents, under ``path``. ``shards``, ``min_docs`` and ``min_chars`` hold for a new store;
    one that is there keeps its own."""

    def __init__(self, spark: SparkSession, path: str | None = None, *, shards: int = 16, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, held_bytes: int = HELD_BYTES, keys_per_shard: int = KEYS_PER_SHARD):
        self._scratch = path is None
        self.spark, self.path, self.held_bytes, self.keys_per_shard = spark, (path or scratch_path(spark, "lines")).rstrip("/"), held_bytes, keys_per_shard
        self.version, self.shards, self.min_docs, self.min_chars = 0, shards, min_docs, min_chars
        if versions := self._committed():
            self.version = versions[-1]
            held = json.loads(self._read(f"commit-{self.version}"))
            self.shards, self.min_docs, self.min_chars = held["shards"], held["min_docs"], held["min_chars"]

    # -- state -----------------------------------------------------------------------------------

    def _fs(self, name: str = ""):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        at, files = self._fs()
        return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []

    def _committed(self) -> list[int]:
        return sorted(int(n.removeprefix("commit-")) for n in self._names() if n.startswith("commit-"))

    def _read(self, name: str) -> str:
        at, files = self._fs(name)
        stream = files.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _commit(self, version: int, shards: int) -> None:
        """A file that is complete when it gets its name."""
        text = json.dumps({"shards": shards, "min_docs": self.min_docs, "min_chars": self.min_chars})
        draft, files = self._fs(f"draft-{version}")
        stream = files.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not files.rename(draft, self._fs(f"commit-{version}")[0]):
            raise OSError(f"{self.path} has a version {version} already")
        for name in self._names():
            kind, _, number = name.partition("-")
            old = number.isdigit() and int(number) < version - 1 and kind in ("refs", "filters", "commit")
            if old or kind in ("changed", "updated"):
                files.delete(self._fs(name)[0], True)

    def refs(self) -> DataFrame:
        """h1, h2, n: every key held by a document, and by how many."""
        return self._refs(self.version)

    def _refs(self, version: int) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], _REFS)
        return self.spark.read.schema(_REFS).parquet(f"{self.path}/refs-{version}")

    def filters(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], "shard int, filter binary")
        return self.spark.read.schema("shard int, filter binary").parquet(f"{self.path}/filters-{self.version}")

    def frequent(self) -> DataFrame:
        return self.refs().where(F.col("n") >= self.min_docs)

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineStore:
        return self._change(docs, text_col, 1)

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineStore:
        return self._change(docs, text_col, -1)

    def _change(self, docs: DataFrame, text_col: str, sign: int) -> LineStore:
        import pandas as pd  # only where filters are updated: workers' memory

        bound_batches(self.spark)
        min_docs, to = self.min_docs, self.version + 1
        change = self._counted(docs, text_col).withColumn("n", F.col("n") * sign)
        if not self.version:
            new = change.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("before"))
        else:
            new = (
                self.refs().select("h1", "h2", "n", F.col("n").alias("b"))
                .unionByName(change.withColumn("b", F.lit(0).cast("long")))
                .groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.sum("b").alias("before"))
            )
        new.write.mode("overwrite").parquet(f"{self.path}/changed-{to}")
        if self._scratch:
            delete_at_exit(self.spark, self.path)
        changed = self.spark.read.schema(new.schema).parquet(f"{self.path}/changed-{to}")
        if sign < 0 and not changed.where("n < 0").isEmpty():
            raise ValueError("documents to delete hold lines that the store doesn't")
        changed.where("n > 0").select("h1", "h2", "n").write.mode("overwrite").parquet(f"{self.path}/refs-{to}")
        shards = self.shards
        while self._refs(to).where(F.col("n") >= min_docs).count() > shards * self.keys_per_shard:
            shards *= 2
        changed = changed.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
        exact = changed.where(F.col("n") >= min_docs).select("shard", "h1")
        filter_of = lambda x: pd.DataFrame({"shard": [x["shard"].iloc[0]], "filter": [CuckooFilter.of(x["h1"].to_numpy().view(np.uint64)).to_bytes()]})
        if shards != self.shards:  # keys of a shard are dealt over two
            rebuilt = exact.groupBy("shard").applyInPandas(filter_of, "shard int, filter binary")
            rebuilt.write.mode("overwrite").parquet(f"{self.path}/filters-{to}")
            self._commit(to, shards)
            self.version, self.shards = to, shards
            return self
        crossed = changed.where((F.col("n") >= min_docs) != (F.col("before") >= min_docs)).select("shard", "h1", (F.col("n") >= min_docs).alias("added"))

        def update(key: tuple, old: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
            held = CuckooFilter.from_bytes(old["filter"].iloc[0]) if len(old) else CuckooFilter(max(64, 2 * len(moved)))
            held.delete(moved.loc[~moved["added"], "h1"].to_numpy().view(np.uint64))
            full = not held.insert(moved.loc[moved["added"], "h1"].to_numpy().view(np.uint64))
            return pd.DataFrame({"shard": [key[0]], "filter": [held.to_bytes()], "full": [full]})

        fresh = self.filters().groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(update, "shard int, filter binary, full boolean")
        fresh.write.mode("overwrite").parquet(f"{self.path}/updated-{to}")
        updated = self.spark.read.schema("shard int, filter binary, full boolean").parquet(f"{self.path}/updated-{to}")
        rebuilt = exact.join(updated.where("full").select("shard"), "shard", "left_semi").groupBy("shard").applyInPandas(filter_of, "shard int, filter binary")
        updated.where("not full").select("shard", "filter").unionByName(rebuilt).write.mode("overwrite").parquet(f"{self.path}/filters-{to}")
        self._commit(to, shards)
        self.version = to
        return self

    def _counted(self, docs: DataFrame, text_col: str) -> DataFrame:
        """h1, h2, n with a row for each key and batch; n is the number of documents."""
        min_chars = self.min_chars
        schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            for batch in batches:
                count: Counter[bytes] = Counter()
                for text in batch.column(0):
                    count.update({h for x in set((text.as_py() or "").split("\n")) if (h := key_hash(x, min_chars))})
                if count:
                    h1, h2 = _columns(list(count))
                    yield pa.record_batch([pa.array(h1), pa.array(h2), pa.array(list(count.values()), pa.int64())], schema=schema)

        return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "h1 long, h2 long, n long")

    # -- use -------------------------------------------------------------------------------------

    def apply(self, docs: DataFrame, text_col: str = "text", added: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
        """``docs`` with frequent lines gone from ``text_col``; two counts are added, in place of columns of their names."""
        hot = self.frequent().select("h1", "h2")
        sizes = self.filters().agg(F.coalesce(F.sum(F.octet_length("filter")), F.lit(0)).alias("b")).first()["b"]
        if hot.count() * 16 + sizes <= self.held_bytes:
            return self._apply_held(docs, text_col, hot, added)
        return self._apply_joined(docs, text_col, hot, sizes <= self.held_bytes, added)

    def _held_filters(self) -> dict[int, bytes]:
        return {r["shard"]: bytes(r["filter"]) for r in self.filters().collect()}

    def _apply_held(self, docs: DataFrame, text_col: str, hot: DataFrame, added: tuple[str, str]) -> DataFrame:
        keys = hot.toArrow().sort_by("h1")
        sent = self.spark.sparkContext.broadcast((self.shards, self._held_filters(), keys.column("h1").to_numpy(), keys.column("h2").to_numpy()))
        docs, names = _with_text(docs, text_col, added)
        at, min_chars = names.index(text_col), self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            shards, raw, k1, k2 = sent.value
            test = _tester(shards, raw, (k1, k2))
            for batch in batches:
                texts, n_lines, n_dropped = [], [], []
                lines = [(t.as_py() or "").split("\n") for t in batch.column(at)]
                digests = [[key_hash(x, min_chars) for x in ls] for ls in lines]
                gone = test([d for ds in digests for d in ds if d])
                for ls, ds in zip(lines, digests, strict=True):
                    kept = [x for x, d in zip(ls, ds, strict=True) if d not in gone]
                    texts.append("\n".join(kept))
                    n_lines.append(len(ls))
                    n_dropped.append(len(ls) - len(kept))
                columns = batch.columns
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, *added])

        return docs.mapInArrow(run, _grown(docs, added))

    def _apply_joined(self, docs: DataFrame, text_col: str, hot: DataFrame, use_filters: bool, added: tuple[str, str]) -> DataFrame:
        sent = self.spark.sparkContext.broadcast((self.shards, self._held_filters())) if use_filters else None
        min_chars = self.min_chars
        docs, names = _with_text(docs, text_col, added)
        row, gone_of, lines_of = (fresh_name(docs, n) for n in ("row", "gone", "lines"))
        # rows have no key of their own: ids may repeat. A row's number holds for the written copy.
        path = scratch_path(self.spark, "rows")
        docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
        delete_at_exit(self.spark, path)
        rows = self.spark.read.parquet(path)

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            test = _tester(*sent.value) if sent else None
            for batch in batches:
                number, pos, digests = [], [], []
                for r, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for i, x in enumerate((t.as_py() or "").split("\n")):
                        if d := key_hash(x, min_chars):
                            number.append(r)
                            pos.append(i)
                            digests.append(d)
                if digests:
                    maybe = test(digests) if test else None
                    keep = [k for k, d in enumerate(digests) if maybe is None or d in maybe]
                    if keep:
                        h1, h2 = _columns([digests[k] for k in keep])
                        yield pa.RecordBatch.from_arrays([pa.array([number[k] for k in keep], pa.int64()), pa.array([pos[k] for k in keep], pa.int32()), pa.array(h1), pa.array(h2)], names=[row, "pos", "h1", "h2"])

        found = materialize(rows.select(row, f"`{text_col}`").mapInArrow(places, f"`{row}` long, pos int, h1 long, h2 long"), "line-places")
        # a line that every document holds is many tasks
        gone = join_spread(found, hot, ["h1", "h2"]).groupBy(row).agg(F.collect_set("pos").alias(gone_of))
        text = F.col(f"`{text_col}`")
        lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
        return (
            rows.join(gone, row, "left").withColumn(gone_of, F.coalesce(gone_of, F.array().cast("array<int>"))).withColumn(lines_of, lines)
            .withColumn(added[0], F.size(lines_of).cast("long")).withColumn(added[1], F.size(gone_of).cast("long"))
            .withColumn(text_col, F.when(F.size(gone_of) == 0, F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.filter(lines_of, lambda x, i: ~F.array_contains(gone_of, i)), "\n")))
            .select(*(f"`{c}`" for c in (*names, *added)))
        )


def _with_text(docs: DataFrame, text_col: str, added: tuple[str, str]) -> tuple[DataFrame, list[str]]:
    """Columns that would clash with the two added ones go."""
    names = [c for c in docs.columns if c not in added]
    return docs.select(*(F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in names)), names


def _grown(docs: DataFrame, added: tuple[str, str]) -> T.StructType:
    return T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in added)])


def _tester(shards: int, raw: dict[int, bytes], exact: tuple[np.ndarray, np.ndarray] | None = None):
    filters = {k: CuckooFilter.from_bytes(v) for k, v in raw.items()}

    def test(digests: list[bytes]) -> set[bytes]:
        """The digests whose shard's filter may hold them; with ``exact`` (keys in the order of h1), of those the ones that it holds."""
        distinct = list(dict.fromkeys(digests))
        if not distinct:
            return set()
        h1, h2 = _columns(distinct)
        hit = np.zeros(len(distinct), bool)
        shard = h1 % shards
        for s, f in filters.items():
            own = np.flatnonzero(shard == s)
            if len(own):
                hit[own] = f.contains(h1[own].view(np.uint64))
        maybe = np.flatnonzero(hit)
        if exact is not None:
            k1, k2 = exact
            lo, hi = np.searchsorted(k1, h1[maybe], "left"), np.searchsorted(k1, h1[maybe], "right")
            maybe = [k for k, a, b in zip(maybe, lo, hi, strict=True) if (k2[a:b] == h2[k]).any()]
        return {distinct[k] for k in maybe}

    return test


def dedup_lines(docs: DataFrame, text_col: str = "text", *, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shards: int | None = None, held_bytes: int = HELD_BYTES, added: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` without the lines that ``min_docs`` or more of its documents hold."""
    spark = docs.sparkSession
    store = LineStore(spark, shards=shards or max(4, int(spark.conf.get("spark.sql.shuffle.partitions"))), min_docs=min_docs, min_chars=min_chars, held_bytes=held_bytes)
    return store.insert(docs, text_col).apply(docs, text_col, added)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
