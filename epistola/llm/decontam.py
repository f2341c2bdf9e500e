"""Benchmark decontamination by a prefix-filtered set join (op9).

Benchmark items and documents are compared on windows of ``window`` words, the size of a window being
the item's own length where it is shorter. A window is contained in a document only if all its words
are, so for exact containment a prefix of one word is enough: words are ordered by how rare they are in the
benchmark, and each window is joined on its rarest word alone. A joined pair of places fixes where the
window would start in the document (the positional bound) and end (the length bound); only places within
both are verified, word for word, on 64-bit word hashes.

Distinct windows are indexed as sorted arrays: about 40 bytes a window and 8 a word of the benchmark. Windows are counted
first. Up to ``held_windows`` of them are sent to the workers, which then read the documents once and shuffle nothing. Beyond
that, windows are a table: places of documents are joined with it by the rarest word and the word beside it (of places, only those whose word is the rarest
of some window leave the worker, as long as those words are few enough to be sent), verified by comparing bytes, and put together by
document. A pair of words with many places is dealt over several tasks. Both ways give the same rows.

Defined results: each row of documents is judged by itself, also where ids repeat or are null; null and empty texts have no
words; an item without words has no window; repeated items (equal ids, a null id counting as an empty one) count once; an item in two
texts of one id counts if any of them occurs; an empty benchmark hits nothing. Only id and text columns are read. Order and ties never matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import bound_batches, fresh_name, join_spread, materialize, release, table
from .wordhash import Words, hash_words, mix

WINDOW = 10
#: Most windows that are sent to every worker, at about 50 bytes each.
HELD_WINDOWS = 1_000_000
#: Most distinct rarest words that are sent to every worker beyond that, at 8 bytes each.
HELD_WORDS = 4_000_000
#: Places of one pair of words that go to one task, about.
HOT_PLACES = 200_000
_PAIRS = 1 << 20
_B = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Index:
    """Distinct windows in the order of their rarest word."""

    rare: np.ndarray  # the rarest word of each window
    at: np.ndarray  # its place in the window
    first: np.ndarray  # where the window starts in ``words``
    size: np.ndarray
    words: np.ndarray
    owner_offsets: np.ndarray
    owners: np.ndarray  # places in ``items``
    items: list[str]

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.rare, self.at, self.first, self.size, self.words, self.owner_offsets, self.owners)) + sum(len(i) + 60 for i in self.items)


def _places(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with ``counts`` words: the text, first word and length of every window."""
    offsets = np.concatenate([[0], np.cumsum(counts)])
    per = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), per)
    first = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(per)])[:-1], per) + np.arange(per.sum())
    return text, first, np.minimum(counts[text], size)


def _rarest(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The place of the rarest word in each window; of equally rare ones that with the smallest hash."""
    distinct, inverse, counts = np.unique(words, return_inverse=True, return_counts=True)
    rank = np.empty(len(distinct), np.int64)
    rank[np.lexsort((distinct, counts))] = np.arange(len(distinct))
    rank = rank[inverse]
    at, low = np.zeros(len(first), np.int64), rank[first] if len(first) else np.zeros(0, np.int64)
    for k in range(1, int(size.max(initial=1))):
        here = np.flatnonzero(size > k)
        r = rank[first[here] + k]
        better = r < low[here]
        at[here[better]], low[here[better]] = k, r[better]
    return at


def build_index(items: list[str], hashes: list[np.ndarray], size: int = WINDOW) -> Index:
    """items and the word hashes of their texts, side by side."""
    names = sorted(set(items))
    number = {n: i for i, n in enumerate(names)}
    own = np.array([number[i] for i in items], np.int32)
    words = np.concatenate([np.zeros(0, np.uint64), *hashes])
    text, first, length = _places(np.array([len(h) for h in hashes], np.int64), size)
    at = _rarest(words, first, length)
    h1 = h2 = np.zeros(len(first), np.uint64)
    for k in range(int(length.max(initial=0))):
        w = np.where(length > k, words[np.minimum(first + k, max(0, len(words) - 1))], np.uint64(k + 1))
        h1, h2 = mix(h1 * _B + w), mix(h2 ^ (w * _B))
    order = np.lexsort((h2, h1, words[first + at])) if len(first) else np.zeros(0, np.int64)
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    distinct, group = order[new], np.cumsum(new) - 1
    owned = np.unique(np.stack([group, own[text[order]]], 1), axis=0) if len(order) else np.zeros((0, 2), np.int64)
    offsets = np.searchsorted(owned[:, 0], np.arange(len(distinct) + 1))
    return Index((words[first + at])[distinct], at[distinct].astype(np.int16), first[distinct].astype(np.int32), length[distinct].astype(np.int16), words, offsets.astype(np.int32), owned[:, 1].astype(np.int32), names)


def scan(run: Words, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, window) of every occurrence of a window in a run of texts."""
    h = run.hashes
    lo = np.searchsorted(index.rare, h, "left")
    here = np.flatnonzero(index.rare[np.minimum(lo, len(index.rare) - 1)] == h) if len(index.rare) else np.zeros(0, np.int64)
    found = [(np.zeros(0, np.int64),) * 3]
    lo, many = lo[here], np.searchsorted(index.rare, h[here], "right") - lo[here]
    ends = np.cumsum(many)
    text = np.searchsorted(run.offsets, here, "right") - 1
    low, high = run.offsets[text], run.offsets[text + 1]
    done = 0
    while done < len(here):  # places by windows of their word, some at a time
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + _PAIRS, "right")))
        m = many[done:upto]
        place = np.repeat(np.arange(done, upto), m)
        window = np.repeat(lo[done:upto] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        start = here[place] - index.at[window]
        keep = np.flatnonzero((start >= low[place]) & (start + index.size[window] <= high[place]))
        start, window = start[keep], window[keep]
        for k in range(int(index.size[window].max(initial=0))):
            same = (index.size[window] <= k) | (h[np.minimum(start + k, len(h) - 1)] == index.words[np.minimum(index.first[window] + k, len(index.words) - 1)])
            start, window = start[same], window[same]
        found.append((start, start + index.size[window], window))
        done = upto
    return tuple(np.concatenate([f[c] for f in found]) for c in range(3))


def _digest(items: list[str] | set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _merged(ranges: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"first": a, "end": b})
    return out


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<first:long,end:long>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", _SPANS)])
_NONE = _digest(set())


def _row(n_words: int, ranges: list[tuple[int, int]], items: set[str]) -> tuple:
    spans = _merged(ranges)
    return n_words, sum(s["end"] - s["first"] for s in spans), len(items), _digest(items) if items else _NONE, bool(spans), spans


def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(columns, list(_ARROW)[1:], strict=True))], schema=_ARROW)


def _hashed(b: DataFrame) -> DataFrame:
    """item, n (words) and h (their hashes) of each benchmark text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for r in hash_words(batch.column(1).to_pylist()):
                n = r.counts()
                own = np.flatnonzero(n)
                items = batch.column(0).take(pa.array(own + r.first))
                yield pa.RecordBatch.from_arrays([items, pa.array(n[own], pa.int64()), pa.array([r.hashes[r.offsets[k] : r.offsets[k + 1]].tobytes() for k in own], pa.binary())], names=["item", "n", "h"])

    return b.mapInArrow(run, "item string, n long, h binary")


def _benchmark(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    b = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return materialize(_hashed(b), "benchmark")


def _n_windows(b: DataFrame, window: int) -> int:
    return b.agg(F.coalesce(F.sum(F.greatest(F.col("n") - window + 1, F.lit(1)) + F.col("n") / 5), F.lit(0)).alias("w")).first()["w"]


def _broadcast_index(b: DataFrame, window: int):
    got = b.select("item", "h").toArrow().sort_by("item")
    return b.sparkSession.sparkContext.broadcast(build_index(got.column("item").to_pylist(), [np.frombuffer(h.as_py(), np.uint64) for h in got.column("h")], window))


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, held_windows: int = HELD_WINDOWS, held_words: int = HELD_WORDS, hot_places: int = HOT_PLACES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the merged word ranges hit."""
    bound_batches(docs.sparkSession)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    b = _benchmark(benchmark, item_col, item_text_col)
    if _n_windows(b, window) <= held_windows:
        return _by_broadcast(d, b, window)
    rows = materialize(d.withColumn("row", F.monotonically_increasing_id()), "rows")
    return _judged(rows, _hits(rows, "row", "text", b, window, held_words, hot_places))


def _by_broadcast(d: DataFrame, b: DataFrame, window: int) -> DataFrame:
    index = _broadcast_index(b, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held = index.value
        for batch in batches:
            out = []
            for r in hash_words(batch.column(1).to_pylist()):
                first, end, win = scan(r, held)
                text = np.searchsorted(r.offsets, first, "right") - 1
                order = np.argsort(text, kind="stable")
                cuts = np.searchsorted(text[order], np.arange(len(r.offsets)))
                for k, n in enumerate(r.counts().tolist()):
                    own = order[cuts[k] : cuts[k + 1]]
                    if not len(own):
                        out.append((n, 0, 0, _NONE, False, []))
                        continue
                    base = int(r.offsets[k])
                    items = {held.items[o] for w in np.unique(win[own]).tolist() for o in held.owners[held.owner_offsets[w] : held.owner_offsets[w + 1]].tolist()}
                    out.append(_row(n, [(a - base, e - base) for a, e in zip(first[own].tolist(), end[own].tolist(), strict=True)], items))
            yield _batch(batch.column(0), out)

    return d.mapInArrow(run, SCHEMA)


# -- beyond what workers hold ------------------------------------------------------------------------


def _pair(rare: np.ndarray, beside: np.ndarray, side: int) -> np.ndarray:
    return mix(rare * _B + beside + np.uint64(side)).view(np.int64)


def _windows(b: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """win, rare, key, at, n, words of distinct windows, and win, item. A rarest word is the rarest of the whole benchmark."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                h = np.frombuffer(raw.as_py(), np.uint64)
                _, first, size = _places(np.array([len(h)]), window)
                own = [h[f : f + s].tobytes() for f, s in zip(first, size, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.string()), pa.array(own, pa.binary())], names=["item", "words"])

    win = F.sha2("words", 256)
    each = materialize(b.mapInArrow(cut, "item string, words binary").select(win.alias("win"), "item", "words").distinct(), "windows")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for raw in batch.column(2):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw.as_py(), np.int64))], names=["word"])

    counts = b.mapInArrow(words_of, "word long").groupBy("word").agg(F.count(F.lit(1)).alias("f"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = np.frombuffer(raw.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(h)), pa.array(np.arange(len(h)), pa.int32()), pa.array(h)], names=["win", "at", "word"])

    distinct = each.select("win", "words").dropDuplicates(["win"])
    ranked = distinct.mapInArrow(places, "win string, at int, word long").join(counts, "word")
    rarest = ranked.groupBy("win").agg(F.min_by(F.struct("word", "at"), F.struct("f", "word", "at")).alias("r"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            at, raw = batch.column(2).to_pylist(), batch.column(3)
            keys = []
            for k, one in zip(at, raw, strict=True):
                h = np.frombuffer(one.as_py(), np.uint64)
                beside, side = (h[k + 1 : k + 2], 1) if k + 1 < len(h) else (h[k - 1 : k], 2) if k else (h[k : k + 1], 0)
                keys.append(int(_pair(h[k : k + 1], beside, side)[0]))
            n = [len(one.as_py()) // 8 for one in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], raw, pa.array(keys, pa.int64()), pa.array(n, pa.int32())], names=["win", "rare", "at", "words", "key", "n"])

    of = rarest.join(distinct, "win").select("win", F.col("r.word").alias("rare"), F.col("r.at").alias("at"), "words")
    return materialize(of.mapInArrow(keyed, "win string, rare long, at int, words binary, key long, n int"), "rarest"), each.select("win", "item")


def _hits(rows: DataFrame, row: str, text: str, b: DataFrame, window: int, held_words: int, hot_places: int) -> DataFrame:
    """row, ranges and items of the rows that hold a window."""
    windows, owners = _windows(b, window)
    rare = windows.select("rare").distinct()
    held = None
    if rare.count() <= held_words:
        held = rows.sparkSession.sparkContext.broadcast(np.sort(rare.toArrow().column(0).to_numpy()).view(np.uint64))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known = np.sort(held.value) if held else None
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for r in hash_words(batch.column(1).to_pylist()):
                h = r.hashes
                if not len(h):
                    continue
                own = np.arange(len(h))
                if known is not None:
                    own = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h) if len(known) else own[:0]
                doc = np.searchsorted(r.offsets, own, "right") - 1
                low, high = r.offsets[doc], r.offsets[doc + 1]
                before = np.minimum(own - low, window - 1)
                end = np.minimum(high, own + window)
                # whether a window's rarest word is followed by another in it, is its last or its only one
                for side, at in ((1, own + 1), (2, own - 1), (0, own)):
                    ok = np.flatnonzero((at >= low) & (at < high))
                    key = _pair(h[own[ok]], h[at[ok]], side)
                    around = pa.array([h[a:e].tobytes() for a, e in zip((own - before)[ok], end[ok], strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[doc[ok] + r.first]), pa.array((own - low)[ok], pa.int64()), pa.array(before[ok], pa.int32()), pa.array(key), around], names=["row", "i", "before", "key", "around"])

    p = rows.select(F.col(row).alias("row"), F.col(text).alias("text")).mapInArrow(places, "row long, i long, before int, key long, around binary")
    p = materialize(join_spread(materialize(p, "rare-places"), windows.select("key").distinct(), ["key"]), "places")
    hot = materialize(p.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot_places).select("key", F.ceil(F.col("c") / hot_places).cast("int").alias("parts")), "hot")
    one = F.lit(1)
    p = p.join(hot, "key", "left").withColumn("part", F.pmod(F.xxhash64("row", "i"), F.coalesce("parts", one)).cast("int"))
    w = windows.join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", one) - 1))).drop("parts")
    there = F.expr("before >= at AND substring(around, (before - at) * 8 + 1, n * 8) = words")
    hits = materialize(p.drop("parts").join(w, ["key", "part"]).where(there).select("row", (F.col("i") - F.col("at")).alias("first"), (F.col("i") - F.col("at") + F.col("n")).alias("end"), "win").distinct(), "hits")
    items = hits.select("row", "win").distinct().join(owners, "win").groupBy("row").agg(F.collect_set("item").alias("items"))
    return hits.groupBy("row").agg(F.collect_set(F.struct("first", "end")).alias("ranges")).join(items, "row")


def _judged(rows: DataFrame, hits: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            n = np.concatenate([np.zeros(0, np.int64), *(r.counts() for r in hash_words(batch.column(1).to_pylist()))])
            out = [_row(k, [(a["first"], a["end"]) for a in ranges or ()], set(items or ())) for k, ranges, items in zip(n.tolist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield _batch(batch.column(0), out)

    return rows.join(hits, "row", "left").select("doc_id", "text", "ranges", "items").mapInArrow(run, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, held_windows: int = HELD_WINDOWS, held_words: int = HELD_WORDS, hot_places: int = HOT_PLACES) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; each row is judged by itself."""
    bound_batches(docs.sparkSession)
    b = _benchmark(benchmark, item_col, item_text_col)
    if _n_windows(b, window) > held_windows:
        row, columns = fresh_name(docs, "row"), docs.columns
        rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        texts = rows.select(F.col(row).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
        gone = _hits(texts, "row", "text", b, window, held_words, hot_places).select(F.col("row").alias(row))
        return rows.join(gone, row, "left_anti").select(*(f"`{c}`" for c in columns))
    index, at = _broadcast_index(b, window), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            clean = []
            for r in hash_words(batch.column(at).cast(pa.string()).to_pylist()):
                hit = np.zeros(len(r.offsets) - 1, bool)
                hit[np.searchsorted(r.offsets, scan(r, index.value)[0], "right") - 1] = True
                clean += (~hit).tolist()
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")
