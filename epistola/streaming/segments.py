"""The stored search index: immutable segments, updates by small ones, and a search that reads the best blocks only.

A segment numbers its messages and cuts them into blocks of ``BLOCK_DOCS``. Its tables: ``docs`` (a row a message), ``postings`` (a row a term and column of a message, with the message's number, account, weighted count of the term and
length) and ``blocks`` (for each term and block: its messages, their highest count and their smallest length). Postings are dealt over files by ranges of (term, block), so a term that
most messages hold fills many files, none above about ``FILE_ROWS`` rows, and a term or prefix still touches neighbouring files only, which a small ``directory`` names.

An update writes one segment of the messages that changed, and for each older segment the list of its messages that are gone from it. How many messages and tokens live is kept as sums in the manifest. Segments merge when there are many, smaller ones first, or when
a quarter of one is gone.

A search knows from ``blocks`` how high a message of each block can score. It scores the blocks with the highest bounds first; the k-th best score found there is the threshold, and only blocks whose
bound reaches it are read after that. The score falls with a message's length and rises with its counts, so a bound from the highest count and the smallest length holds whatever the mean length is by now. Hits equal
those of a search of everything, in all digits but for the order of sums.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import StoreError
from ..operators.search import B, IDF_FLOOR, K1, KEY, LENGTHS, POSTINGS, WEIGHTS, Phrase, SearchIndex, located, term_matches
from ..scratch import FEW_ROWS, drop, written
from .store import KEPT_VERSIONS, TRIES, Store

BLOCK_BITS = 9
BLOCK_DOCS = 1 << BLOCK_BITS
FILE_ROWS = 2_000_000
#: Blocks that are scored first; blocks up to which all of them are; segments, share of gone messages and file names that are too many.
FIRST_BLOCKS, FEW_BLOCKS, MOST_SEGMENTS, MOST_GONE, MOST_FILES = 16, 64, 8, 0.25, 1_000

_POSTINGS = "term string, block long, doc long, account string, col string, positions array<int>, f double, lead boolean, length long"
_BLOCKS = "term string, block long, n long, most double, shortest long"
_DOCS = "doc long, block long, account string, message_id string, length long"
_GONE = "doc long, block long"


@dataclass(frozen=True)
class Found:
    """A search's hits (account, message_id, score; smaller is better), and how many blocks were there and were read."""

    hits: DataFrame
    blocks: int
    read: int


class StoredIndex:
    def __init__(self, store: Store, name: str = "index", stemmed: bool = True, file_rows: int = FILE_ROWS):
        self.store, self.spark, self.name, self.stemmed, self.file_rows = store, store.spark, name, stemmed, file_rows

    def _path(self, segment: str, table: str) -> str:
        return f"{self.store.path}/{self.name}/{segment}/{table}"

    def segments(self) -> list[dict]:
        return self.store.manifest(self.name)["parts"]

    def _table(self, segment: dict, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._path(segment["path"], table))

    def _gone(self, segment: dict) -> DataFrame | None:
        return self.spark.read.schema(_GONE).parquet(*segment["gone"]) if segment["gone"] else None

    def _live(self, segment: dict, rows: DataFrame) -> DataFrame:
        gone = self._gone(segment)
        return rows if gone is None else rows.join(gone.select("doc"), "doc", "left_anti")

    # -- writing

    def _write(self, postings: DataFrame, docs: DataFrame, rows: int) -> dict:
        """A segment of ``postings`` (without their blocks) and ``docs``."""
        path = uuid.uuid4().hex
        block = F.shiftright("doc", BLOCK_BITS)
        docs.withColumn("block", block).select("doc", "block", *KEY, "length").write.parquet(self._path(path, "docs"))
        files = max(1, -(-rows // self.file_rows))
        dealt = postings.withColumn("block", block).select(*(c.split()[0] for c in _POSTINGS.split(", ")))
        dealt.repartitionByRange(files, "term", "block", "doc").sortWithinPartitions("term", "block", "doc").write.parquet(self._path(path, "postings"))
        segment = {"path": path, "gone": [], "rows": rows}
        own = self._table(segment, "postings", _POSTINGS)
        own.where("lead").groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("f").alias("most"), F.min("length").alias("shortest")).repartitionByRange(max(1, files // 8), "term", "block").sortWithinPartitions("term", "block").write.parquet(self._path(path, "blocks"))
        own.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("term").alias("low"), F.max("term").alias("high"), F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(self._path(path, "directory"))
        size = self._table(segment, "docs", _DOCS).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("l")).first()
        return segment | {"docs": size["n"], "length": size["l"], "gone_docs": 0, "gone_length": 0}

    def _segment_of(self, rows: DataFrame) -> dict:
        t = written(located(rows, self.stemmed, in_runs=True), "located")
        n = t.where("term is not null").count()
        out = self._write(t.where("term is not null"), t.where("term is null").select("doc", *KEY, "length"), n)
        drop(t)
        return out

    def rebuild(self, rows: DataFrame) -> None:
        """One segment of all searched rows, in place of what there was."""
        segment = self._segment_of(rows)
        self.store._commit(self.name, lambda m: {"parts": [segment], "added": []})

    def update(self, rows: DataFrame, keys: DataFrame) -> None:
        """``rows`` in place of what the index had of the messages of ``keys``; keys without a row leave it."""
        keys = written(keys.select(*KEY).distinct(), "keys")
        segment = self._segment_of(rows.join(keys, KEY, "left_semi"))
        for _ in range(TRIES):  # another writer's segment may have some of the keys, too: then theirs are looked up again
            held = self.store.manifest(self.name)
            parts = [self._without(s, keys) for s in held["parts"]]
            if segment["docs"]:
                parts.append(segment)
            if self.store._create(self.name, {"version": held["version"] + 1, "parts": parts, "added": []}):
                break
        else:
            raise StoreError(f"{self.name}: {TRIES} times another writer was first")
        drop(keys)
        self._merge_where_due()

    def _without(self, segment: dict, keys: DataFrame) -> dict:
        docs = self._live(segment, self._table(segment, "docs", _DOCS))
        path = self._path(segment["path"], f"gone-{uuid.uuid4().hex}")
        docs.join(keys, KEY, "left_semi").select("doc", "block", "length").write.parquet(path)
        new = self.spark.read.schema(f"{_GONE}, length long").parquet(path).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("l")).first()
        if not new["n"]:
            return segment
        return segment | {"gone": [*segment["gone"], path], "gone_docs": segment["gone_docs"] + new["n"], "gone_length": segment["gone_length"] + new["l"]}

    def vacuum(self, keep: int = KEPT_VERSIONS) -> int:
        """Deletes versions but the last ``keep``, and segments that only those held; gives how many segments went."""
        versions = self.store.versions(self.name)
        held = {v: {s["path"] for s in self.store.manifest(self.name, v)["parts"]} for v in versions}
        gone = set().union(*(held[v] for v in versions[:-keep])) - set().union(*(held[v] for v in versions[-keep:])) if len(versions) > keep else set()
        for v in versions[:-keep]:
            self.store._delete(f"{self.store.path}/{self.name}/log/v{v:08d}.json")
        for path in gone:
            self.store._delete(f"{self.store.path}/{self.name}/{path}")
        return len(gone)

    def _merge_where_due(self) -> None:
        parts = self.segments()
        live = lambda s: s["docs"] - s["gone_docs"]
        old = [s for s in parts if s["gone_docs"] > MOST_GONE * s["docs"]]
        if len(parts) > MOST_SEGMENTS:  # the smaller ones, as long as those already taken weigh half of the next
            size = 0
            for s in sorted(parts, key=live):
                if size and live(s) > 2 * size and len(old) > 1:
                    break
                size += live(s)
                old += [s] if s not in old else []
        if old:
            self._merge(old)

    def _merge(self, old: list[dict]) -> bool:
        """One segment in place of ``old``; False where another writer has changed one of them meanwhile."""
        docs = reduce(DataFrame.unionByName, (self._live(s, self._table(s, "docs", _DOCS)).withColumn("s", F.lit(i)) for i, s in enumerate(old)))
        numbered = written(docs.select("s", F.col("doc").alias("old"), *KEY, "length").coalesce(max(1, sum(s["docs"] for s in old) // (1 << 20))).withColumn("doc", F.monotonically_increasing_id()), "numbered")
        each = reduce(DataFrame.unionByName, (self._table(s, "postings", _POSTINGS).withColumn("s", F.lit(i)) for i, s in enumerate(old)))
        postings = each.withColumnRenamed("doc", "old").drop("account", "length").join(numbered, ["s", "old"])
        segment = self._write(postings, numbered, max(1, sum(s["rows"] for s in old)))
        drop(numbered)

        def replace(m: dict) -> dict | None:
            if not all(s in m["parts"] for s in old):
                return None
            return {"parts": [segment, *(s for s in m["parts"] if s not in old)], "added": []}

        return self.store._commit(self.name, replace) is not None

    # -- reading

    def as_index(self) -> SearchIndex:
        """All live postings and lengths."""
        parts = self.segments()
        if not parts:
            return SearchIndex(self.spark.createDataFrame([], POSTINGS), self.spark.createDataFrame([], LENGTHS))
        of = lambda table, schema, wanted: reduce(DataFrame.unionByName, (self._live(s, self._table(s, table, schema)).select(*(c.split()[0] for c in wanted.split(", "))) for s in parts))
        named = (self._live(s, self._table(s, "postings", _POSTINGS)).drop("account").join(self._table(s, "docs", _DOCS).select("doc", *KEY), "doc").select(*(c.split()[0] for c in POSTINGS.split(", "))) for s in parts)
        return SearchIndex(reduce(DataFrame.unionByName, named), of("docs", _DOCS, LENGTHS))

    def terms(self) -> DataFrame:
        """term, n: the live messages that hold each term. Blocks are summed; only those with gone messages are counted anew."""
        out = None
        for s in self.segments():
            blocks = self._table(s, "blocks", _BLOCKS).select("term", "n")
            if s["gone_docs"]:
                gone = self._gone(s)
                lost = self._table(s, "postings", _POSTINGS).where("lead").join(gone, ["doc", "block"], "left_semi").groupBy("term").agg((-F.count(F.lit(1))).alias("n"))
                blocks = blocks.unionByName(lost)
            out = blocks if out is None else out.unionByName(blocks)
        out = out if out is not None else self.spark.createDataFrame([], "term string, n long")
        return out.groupBy("term").agg(F.sum("n").alias("n")).where("n > 0")

    @property
    def postings(self) -> DataFrame:
        return self.as_index().postings

    @property
    def lengths(self) -> DataFrame:
        return self.as_index().lengths

    def _files(self, segment: dict, stems: list[tuple[str, bool]]) -> list[str] | None:
        """Files of postings that may hold one of the terms or prefixes; None where they are too many to name."""
        d = self.spark.read.schema("file string, low string, high string, n long").parquet(self._path(segment["path"], "directory"))
        reach = [(F.col("high") >= t) & ((F.col("low") <= t) | F.col("low").startswith(t) if p else F.col("low") <= t) for t, p in stems]
        names = [r["file"] for r in d.where(reduce(Column.__or__, reach)).select("file").limit(MOST_FILES + 1).collect()]
        return names if len(names) <= MOST_FILES else None

    def _postings(self, segment: dict, stems: list[tuple[str, bool]]) -> DataFrame:
        files = self._files(segment, stems)
        base = self._path(segment["path"], "postings")
        if files == []:
            rows = self.spark.createDataFrame([], _POSTINGS)
        else:
            rows = self.spark.read.schema(_POSTINGS).parquet(*([base] if files is None else [f"{base}/{f}" for f in files]))
        return self._live(segment, rows.where(reduce(Column.__or__, (term_matches(F.col("term"), t, p) for t, p in stems))))

    def search(self, phrases: list[Phrase], k: int | None = 15, account: str | None = None, first_blocks: int = FIRST_BLOCKS, few_blocks: int = FEW_BLOCKS) -> Found:
        """The k best hits of any phrase, all those that tie with the last included; all hits where ``k`` is None."""
        parts = self.segments()
        n_docs, tokens = sum(s["docs"] - s["gone_docs"] for s in parts), sum(s["length"] - s["gone_length"] for s in parts)
        none = self.spark.createDataFrame([], "account string, message_id string, score double")
        if not phrases or not n_docs:
            return Found(none, 0, 0)
        stems = [[(t, p.prefix and i == len(p.terms) - 1) for i, t in enumerate(p.terms)] for p in phrases]
        every = list(dict.fromkeys(s for own in stems for s in own))
        blocks = reduce(DataFrame.unionByName, (self._table(s, "blocks", _BLOCKS).where(reduce(Column.__or__, (term_matches(F.col("term"), *x) for x in every))).withColumn("s", F.lit(i)) for i, s in enumerate(parts)))
        tags = F.array_compact(F.array(*(F.when(term_matches(F.col("term"), *x), F.struct(F.lit(i).alias("phrase"), F.lit(j).alias("stem"))) for i, own in enumerate(stems) for j, x in enumerate(own))))
        each = blocks.select("s", "block", "term", "n", "most", "shortest", F.explode(tags).alias("t")).select("*", "t.*").drop("t")
        seen = {(r["phrase"], r["stem"]): r for r in each.groupBy("phrase", "stem").agg(F.count_distinct("term").alias("terms"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
        postings = [self._postings(s, every) for s in parts]
        held = reduce(DataFrame.unionByName, (p.withColumn("s", F.lit(i)) for i, p in enumerate(postings)))
        df = self._frequencies(stems, seen, held, parts)
        mean = tokens / n_docs
        idf = [max(math.log((n_docs - n + 0.5) / (n + 0.5)), IDF_FLOOR) for n in df]
        total = sum(r["rows"] for r in seen.values())
        if k is None or min(total, sum((s["docs"] >> BLOCK_BITS) + 1 for s in parts)) <= few_blocks:
            most = sum(r["n"] for r in seen.values())
            return Found(self._best(self._scores(held, stems, idf, mean), k, account, parts, most), total, total)
        # what a message of each block can reach: of a phrase, the count of its rarest stem in the longest of the shortest messages
        by_stem = each.groupBy("s", "block", "phrase", "stem").agg(F.sum("most").alias("most"), F.min("shortest").alias("shortest"))
        sizes, weights = F.array(*(F.lit(len(own)) for own in stems)), F.array(*map(F.lit, idf))
        by_phrase = by_stem.groupBy("s", "block", "phrase").agg(F.count(F.lit(1)).alias("stems"), F.min("most").alias("f"), F.max("shortest").alias("length"))
        by_phrase = by_phrase.where(F.col("stems") == F.get(sizes, F.col("phrase")))
        bounds = written(by_phrase.groupBy("s", "block").agg((F.sum(F.get(weights, F.col("phrase")) * _part(F.col("f"), F.col("length"), mean)) * (1 + 1e-9)).alias("bound")), "bounds")
        first = [(r["s"], r["block"]) for r in bounds.orderBy(F.col("bound").desc()).limit(first_blocks).collect()]
        one_of = reduce(Column.__or__, ((F.col("s") == s) & F.col("block").isin([b for x, b in first if x == s]) for s in {s for s, _ in first}), F.lit(False))
        found = [r["score"] for r in self._best(self._scores(held.where(one_of), stems, idf, mean), k, account, parts).select("score").collect()]
        threshold = -sorted(found)[k - 1] if len(found) >= k else 0.0
        above = bounds.where(F.col("bound") >= threshold).select("s", "block")
        n = above.count()
        read = held.join(F.broadcast(above) if n <= 100_000 else above, ["s", "block"], "left_semi")
        return Found(self._best(self._scores(read, stems, idf, mean), k, account, parts), bounds.count(), n)

    def _frequencies(self, stems: list[list[tuple[str, bool]]], seen: dict, held: DataFrame, parts: list[dict]) -> list[int]:
        """Live messages that hold each phrase: for one that is a single term, by the sums of its blocks without those that are gone; for others they are counted."""
        df: list[int | None] = []
        for i, own in enumerate(stems):
            if any((i, j) not in seen for j in range(len(own))):
                df.append(0)
            elif len(own) == 1 and seen[i, 0]["terms"] == 1:
                df.append(seen[i, 0]["n"] - self._gone_frequency(own[0], parts))
            else:
                df.append(None)
        for i, n in enumerate(df):
            if n is None:
                df[i] = _places(held, stems[i]).select("s", "doc").distinct().count()
        return df

    def _gone_frequency(self, stem: tuple[str, bool], parts: list[dict]) -> int:
        """Messages with the term among those that are gone; of the postings, only their blocks are read."""
        n = 0
        for s in parts:
            if s["gone_docs"]:
                gone = F.broadcast(self._gone(s)) if s["gone_docs"] <= 1_000_000 else self._gone(s)
                rows = self._table(s, "postings", _POSTINGS).where(term_matches(F.col("term"), *stem) & F.col("lead"))
                n += rows.join(gone, ["doc", "block"], "left_semi").count()
        return n

    def _scores(self, held: DataFrame, stems: list[list[tuple[str, bool]]], idf: list[float], mean: float) -> DataFrame:
        counted = reduce(DataFrame.unionByName, (_places(held, own).withColumn("idf", F.lit(idf[i])) for i, own in enumerate(stems)))
        return counted.groupBy("s", "doc").agg(F.first("account").alias("account"), (-F.sum(F.col("idf") * _part(F.col("f"), F.col("length"), mean))).alias("score"))

    def _best(self, scores: DataFrame, k: int | None, account: str | None, parts: list[dict], most: int | None = None) -> DataFrame:
        if account:
            scores = scores.where(F.col("account") == account)
        scores = scores.select("s", "doc", "score")
        if k is None:
            return self._named(scores, parts, most)
        nth = F.rank().over(Window.orderBy("score"))  # each task hands on its own k best and their ties
        return self._named(scores.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth"), parts)

    def _named(self, scores: DataFrame, parts: list[dict], most: int | None = None) -> DataFrame:
        """account, message_id, score: postings only number their messages, and only hits are looked up. Of ``most`` hits, where that is known, few are sent to all workers and more are dealt: a planner
        goes by the files of their postings, which are far smaller than their rows, and keeps a broadcast that it has planned."""
        if most is not None:
            scores = F.broadcast(scores) if most <= FEW_ROWS else scores.hint("merge")
        docs = reduce(DataFrame.unionByName, (self._table(p, "docs", _DOCS).select(F.lit(i).alias("s"), "doc", *KEY) for i, p in enumerate(parts)))
        return docs.join(scores, ["s", "doc"]).select(*KEY, "score")

    def hits(self, phrases: list[Phrase], k: int | None = None, account: str | None = None) -> DataFrame:
        return self.search(phrases, k, account).hits


def _part(f: Column, length: Column, mean: float) -> Column:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))


def _places(held: DataFrame, stems: list[tuple[str, bool]]) -> DataFrame:
    """s, doc, account, length, f of the messages that hold a phrase. A single stem needs no positions."""
    of = ["s", "doc", "account", "length"]
    if len(stems) == 1:
        return held.where(term_matches(F.col("term"), *stems[0]) & F.col("lead")).groupBy(*of).agg(F.sum("f").alias("f"))
    out = None
    for i, (t, p) in enumerate(stems):
        shift = F.lit(i)
        at = held.where(term_matches(F.col("term"), t, p)).select(*of, "col", F.explode(F.transform("positions", lambda x: x - shift)).alias("start")).distinct()
        out = at if out is None else out.join(at, [*of, "col", "start"])
    weight = F.coalesce(*(F.when(F.col("col") == c, w) for c, w in WEIGHTS.items()))
    return out.groupBy(*of).agg(F.sum(weight).alias("f"))
