"""Ranked lexical search by block-max pruning (op11).

The index cuts the documents, in the order in which a task reads them, into blocks of up to ``BLOCK_DOCS`` documents. A block's row of ``forward``
holds its documents and, by term, how often each document has it; its row of ``maxima`` holds the largest part that each term can add to the score of
any of its documents. The sum of these over a query's terms bounds every score of the block, exactly, as all of it is integers.

A search reads the maxima first: the ``FIRST_BLOCKS`` blocks with the highest bounds of each query are scored, and the k-th best score found there is the
query's threshold. Then only blocks whose bound reaches it are scored, in each task from the highest bound down and with a threshold that rises as
better documents are found. A block that is left out can't hold one of the k best, nor one of equal score.

Terms are held as 64-bit hashes; two of one corpus collide with a probability of about n**2 / 2**65. Nothing is shuffled but the k best of each task. Blocks to score go to the forward rows by broadcast up to ``HELD_PAIRS`` pairs of block and query, and are joined by block beyond. Queries go
in groups of about ``HELD_TERMS`` terms, whose terms are broadcast; each group is one search.

Defined results: a null text has no terms; documents without terms aren't counted and never found; an empty table of either side gives no rows; rows that
repeat, of documents or items, are ranked each by itself; equal scores rank by ascending id, null ids last; an item without terms, or whose terms no
document has, gives no rows. Only ids and texts are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import bound_batches, drop_scratch, materialize, table
from .wordhash import hash_words

BLOCK_DOCS, BLOCK_WORDS = 64, 65_536
K, FIRST_BLOCKS = 10, 8
HELD_TERMS, HELD_PAIRS = 200_000, 2_000_000

_FORWARD = "block long, ids array<long>, words binary, terms binary, df binary, docs binary, tf binary"
_MAXIMA = "block long, terms binary, maxima binary"
_FOUND = "q int, doc_id long, score long"


@dataclass(frozen=True)
class BlockIndex:
    """forward and maxima, each a row a block; documents with terms, and all their terms."""

    forward: DataFrame
    maxima: DataFrame
    n_docs: int
    n_terms: int


def _edges(new: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs start, and their lengths. new: whether each element but the first starts one."""
    first = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(new) + 1])
    return first, np.diff(first, append=end)


def _block(words: list[np.ndarray]) -> dict[str, np.ndarray]:
    """terms (sorted), df (documents of each), docs and tf (for each term, by document) of one block."""
    h, d = np.concatenate(words), np.repeat(np.arange(len(words)), [len(w) for w in words])
    order = np.argsort(h, kind="stable")
    h, d = h[order], d[order]
    each, tf = _edges((h[1:] != h[:-1]) | (d[1:] != d[:-1]), len(h))
    h, d = h[each], d[each]
    first, df = _edges(h[1:] != h[:-1], len(h))
    return {"terms": h[first], "df": df.astype(np.uint16), "docs": d.astype(np.uint16), "tf": tf.astype(np.int32)}


def _cut(block_docs: int, block_words: int):
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("words", "terms", "df", "docs", "tf"))])

    def row(number: int, ids: list, words: list[np.ndarray]) -> pa.RecordBatch:
        of = {"words": np.array([len(w) for w in words], np.int64), **_block(words)}
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids], pa.list_(pa.int64())), *(pa.array([a.tobytes()], pa.binary()) for a in of.values())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, words, size = TaskContext.get().partitionId() << 33, [], [], 0
        for batch in batches:
            named = batch.column(0).to_pylist()
            for r in hash_words(batch.column(1).to_pylist()):
                for i in np.flatnonzero(r.counts()).tolist():
                    ids.append(named[r.first + i])
                    words.append(r.hashes[r.offsets[i] : r.offsets[i + 1]])
                    size += len(words[-1])
                    if len(ids) >= block_docs or size >= block_words:
                        yield row(number, ids, words)
                        number, ids, words, size = number + 1, [], [], 0
        if ids:
            yield row(number, ids, words)

    return run


def _parts(words: np.ndarray, df: np.ndarray, docs: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each (term, document) adds to a score, for a term of weight 1."""
    m = 10 + (90 * n_docs * words) // n_terms
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m[docs])


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS, block_words: int = BLOCK_WORDS) -> BlockIndex:
    """Both tables, written to the shared folder: the texts are tokenised once, the maxima follow once all lengths are known."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    forward = materialize(rows.mapInArrow(_cut(min(block_docs, 1 << 16), block_words), _FORWARD), "forward")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(x) for x in w)]), pa.array([sum(int(x.sum()) for x in w)])], names=["n", "l"])

    total = forward.select("words").mapInArrow(sizes, "n long, l long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("l"), F.lit(0)).alias("l")).first()
    n_docs, n_terms = total["n"], total["l"]

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, terms, df, at, tf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                df = np.frombuffer(df, np.uint16).astype(np.int64)
                parts = _parts(np.frombuffer(words, np.int64), df, np.frombuffer(at, np.uint16), np.frombuffer(tf, np.int32), n_docs, n_terms)
                most = np.maximum.reduceat(parts, np.cumsum(df) - df).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([terms], pa.binary()), pa.array([most.tobytes()], pa.binary())], names=["block", "terms", "maxima"])

    maxima = materialize(forward.select("block", "words", "terms", "df", "docs", "tf").mapInArrow(largest, _MAXIMA), "maxima")
    return BlockIndex(forward, maxima, n_docs, n_terms)


@dataclass
class Queries:
    """Query i has the terms terms[at[first[i]:first[i + 1]]]; weights are the terms'."""

    terms: np.ndarray
    at: np.ndarray
    first: np.ndarray
    weights: np.ndarray

    def places(self, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which terms are in ``held`` (sorted), and where."""
        where = np.minimum(np.searchsorted(held, self.terms), len(held) - 1)
        known = np.flatnonzero(held[where] == self.terms)
        return known, where[known]

    def bounds(self, held: np.ndarray, maxima: np.ndarray) -> np.ndarray:
        part = np.zeros(len(self.terms), np.int64)
        known, where = self.places(held)
        part[known] = self.weights[known] * maxima[where]
        return np.add.reduceat(part[self.at], self.first[:-1])


def _queries(rows: pa.Table) -> Queries:
    own = [np.frombuffer(t.as_py(), np.uint64) for t in rows.column("terms")]
    terms, at = np.unique(np.concatenate(own), return_inverse=True)
    return Queries(terms, at.reshape(-1), np.concatenate([[0], np.cumsum([len(t) for t in own])]), np.zeros(len(terms), np.int64))


def _document_frequency(index: BlockIndex, terms: np.ndarray) -> np.ndarray:
    held = index.forward.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Queries(held.value, np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64))
        df = np.zeros(len(held.value), np.int64)
        for batch in batches:
            for own, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                known, where = q.places(np.frombuffer(own, np.uint64))
                df[known] += np.frombuffer(n, np.uint16)[where]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(df[some])], names=["t", "df"])

    got = index.forward.select("terms", "df").mapInArrow(run, "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(terms), np.int64)
    out[got.column("t").to_numpy()] = got.column("df").to_numpy()
    return out


def best_blocks(index: BlockIndex, queries: Queries, most: int) -> DataFrame:
    """q, block: the ``most`` blocks of highest bound of each query; a task hands on as many."""
    held = index.maxima.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = held.value
        n = len(q.first) - 1
        bound, block = np.zeros((0, n), np.int64), np.zeros((0, n), np.int64)
        for batch in batches:
            new = np.array([q.bounds(np.frombuffer(t, np.uint64), np.frombuffer(m, np.int32)) for t, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], np.int64).reshape(-1, n)
            bound = np.concatenate([bound, new])
            block = np.concatenate([block, np.broadcast_to(batch.column(0).to_numpy()[:, None], new.shape)])
            if len(bound) > most:
                top = np.argpartition(-bound, most - 1, axis=0)[:most]
                bound, block = np.take_along_axis(bound, top, 0), np.take_along_axis(block, top, 0)
        some = bound > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(some)[1], pa.int32()), pa.array(block[some]), pa.array(bound[some])], names=["q", "block", "bound"])

    each = index.maxima.mapInArrow(run, "q int, block long, bound long")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.col("bound").desc(), "block"))
    return each.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def blocks_above(index: BlockIndex, queries: Queries, thresholds: np.ndarray) -> DataFrame:
    """block, qs, bounds: the queries whose bound of the block is above 0 and reaches their threshold; blocks without one are left out."""
    held = index.maxima.sparkSession.sparkContext.broadcast((queries, np.maximum(thresholds, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, least = held.value
        for batch in batches:
            rows = []
            for block, t, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bounds = q.bounds(np.frombuffer(t, np.uint64), np.frombuffer(m, np.int32))
                if len(some := np.flatnonzero(bounds >= least)):
                    rows.append((block, some.tolist(), bounds[some].tolist()))
            blocks, qs, bounds = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(qs, pa.list_(pa.int32())), pa.array(bounds, pa.list_(pa.int64()))], names=["block", "qs", "bounds"])

    return index.maxima.mapInArrow(run, "block long, qs array<int>, bounds array<long>")


class _Best:
    """The k best documents of each query that a task has seen, and the score to reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k, self.new = least.copy(), k, []
        self.held = tuple(np.zeros(0, np.int64) for _ in range(4))

    def add(self, q: int, ids: np.ndarray, nulls: np.ndarray, scores: np.ndarray) -> None:
        some = np.flatnonzero(scores >= self.least[q])
        if len(some) > self.k:
            low = np.partition(scores[some], -self.k)[-self.k]
            some = some[scores[some] >= low]
            self.least[q] = max(self.least[q], low)
        if len(some):
            self.new.append((np.full(len(some), q), scores[some], nulls[some], ids[some]))

    def settle(self) -> None:
        if not self.new:
            return
        q, s, n, i = (np.concatenate([h, *x]) for h, x in zip(self.held, zip(*self.new, strict=True), strict=True))
        order = np.lexsort((i, n, -s, q))
        q = q[order]
        first, size = _edges(q[1:] != q[:-1], len(q))
        nth = np.arange(len(q)) - np.repeat(first, size)
        keep = order[nth < self.k]
        kth = np.flatnonzero(nth == self.k - 1)
        self.least[q[kth]] = np.maximum(self.least[q[kth]], s[order[kth]])
        self.held, self.new = (q[nth < self.k], s[keep], n[keep], i[keep]), []


def _scored(index: BlockIndex, queries: Queries, pairs: DataFrame, thresholds: np.ndarray, k: int) -> DataFrame:
    """q, doc_id, score: the k best documents of each query in the blocks of ``pairs`` (block, qs, bounds)."""
    held = index.forward.sparkSession.sparkContext.broadcast((queries, np.maximum(thresholds, 1)))
    n_docs, n_terms = index.n_docs, index.n_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, least = held.value
        best = _Best(least, k)
        column = np.full(len(q.terms), -1, np.int64)
        for batch in batches:
            rows = sorted(range(batch.num_rows), key=lambda r: -max(batch.column("bounds")[r].as_py()))  # highest bound first
            for r in rows:
                own = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                wanted = [(x, b) for x, b in zip(own["qs"], own["bounds"], strict=True) if b >= best.least[x]]
                if not wanted:
                    continue
                terms, df = np.frombuffer(own["terms"], np.uint64), np.frombuffer(own["df"], np.uint16).astype(np.int64)
                words, docs, tf = np.frombuffer(own["words"], np.int64), np.frombuffer(own["docs"], np.uint16), np.frombuffer(own["tf"], np.int32)
                nulls = np.array([i is None for i in own["ids"]], np.int64)
                ids = np.array([i or 0 for i in own["ids"]], np.int64)
                known, where = q.places(terms)
                first, size = np.cumsum(df)[where] - df[where], df[where]
                entry = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                col = np.repeat(np.arange(len(known)), size)
                parts = _parts(words, df, docs[entry], tf[entry], n_docs, n_terms) * np.repeat(q.weights[known], size)
                grid = np.zeros((len(known) + 1, len(ids)), np.int64)  # the last row is of terms that the block lacks
                grid[col, docs[entry]] = parts
                column[known] = np.arange(len(known))
                for x, _ in wanted:
                    best.add(x, ids, nulls, grid[column[q.at[q.first[x] : q.first[x + 1]]]].sum(axis=0))
                column[known] = -1
                if len(best.new) > 512:
                    best.settle()
            best.settle()
        at, s, n, i = best.held
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(i, pa.int64(), mask=n.astype(bool)), pa.array(s, pa.int64())], names=["q", "doc_id", "score"])

    return index.forward.join(pairs, "block").mapInArrow(run, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", nth).where(F.col("rank") <= k)


def search_group(index: BlockIndex, queries: Queries, k: int, first_blocks: int, held_pairs: int) -> tuple[DataFrame, DataFrame]:
    """Ranked documents of each query, and the blocks that were scored for them (block, qs, bounds)."""
    df = _document_frequency(index, queries.terms)
    queries.weights = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()], np.int64)
    n = len(queries.first) - 1
    # at most first_blocks pairs a query
    start = best_blocks(index, queries, first_blocks).groupBy("block").agg(F.collect_list("q").alias("qs"), F.collect_list("bound").alias("bounds"))
    got = _ranked(_scored(index, queries, F.broadcast(start), np.zeros(n, np.int64), k), k).where(F.col("rank") == k).select("q", "score").toArrow()
    thresholds = np.zeros(n, np.int64)
    thresholds[got.column("q").to_numpy()] = got.column("score").to_numpy()
    pairs = materialize(blocks_above(index, queries, thresholds), "pairs")
    few = pairs.agg(F.coalesce(F.sum(F.size("qs")), F.lit(0)).alias("n")).first()["n"] <= held_pairs
    return _ranked(_scored(index, queries, F.broadcast(pairs) if few else pairs, thresholds, k), k), pairs


def search(items: DataFrame, index: BlockIndex, *, id_col: str = "item_id", text_col: str = "text", k: int = K, first_blocks: int = FIRST_BLOCKS, held_terms: int = HELD_TERMS, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """item (``id_col``), rank, doc_id and score of each item's ``k`` best documents."""
    spark = items.sparkSession

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(r.hashes[a:e]).tobytes() for r in hash_words(batch.column(1).to_pylist()) for a, e in zip(r.offsets[:-1], r.offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["item", "terms"])

    given = items.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    named = given.mapInArrow(terms_of, given.select("item").schema.add("terms", "binary")).where(F.length("terms") > 0).withColumn("row", F.monotonically_increasing_id())
    named = materialize(named, "items")
    total = named.agg(F.coalesce(F.sum(F.length("terms")), F.lit(0)).alias("n")).first()["n"] // 8
    empty = spark.createDataFrame([], given.select("item").schema.add("rank", "integer").add("doc_id", "long").add("score", "long"))
    groups = -(-total // held_terms) if index.n_docs else 0
    out = []
    for g in range(groups):
        some = named.where(F.pmod(F.xxhash64("row"), F.lit(groups)) == g)
        rows = some.select("row", "terms").toArrow()
        if not rows.num_rows:
            continue
        found, pairs = search_group(index, _queries(rows), k, first_blocks, held_pairs)
        numbers = spark.createDataFrame(list(enumerate(rows.column("row").to_pylist())), "q int, row long")
        best = materialize(found.join(F.broadcast(numbers), "q").select("row", "rank", "doc_id", "score"), "best")
        drop_scratch(pairs)
        out.append(some.select("row", "item").join(F.broadcast(best), "row").select("item", "rank", "doc_id", "score"))  # k rows an item
    return reduce(DataFrame.unionByName, out, empty).withColumnRenamed("item", id_col)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "benchmark"), build_index(table(spark, sf_dir, "documents")))
