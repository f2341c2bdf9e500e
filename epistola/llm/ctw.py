"""Language-model scoring by context-tree weighting over bytes (op13), with a unigram baseline.

The model. A text is its bytes and an end byte, 0xFF, which UTF-8 has not; before its first byte stand ``DEPTH`` end bytes. Each byte is eight binary decisions,
highest bit first; the bits of a byte seen so far, after a leading 1, number the decision from 1 to 255. Every decision has a context tree of its own over the bytes before, the nearest one first,
from depth 0 to ``DEPTH``. A node's counts of zeros and ones give the Krichevsky-Trofimov estimate of its sequence; its weighted probability is the mean of that
and of its children's product, at full depth the estimate alone. The counts of all training documents are gathered first, so a text's probability is that of what the trees,
left as they are, say next: at a node, the weighted mean of its own estimate and of the child on the path, with the posterior weight that mixing has given it; a
node that no training text has met says one half. Probabilities of all texts sum to 1.

As Spark runs it. Grams (``DEPTH`` + 1 bytes, in one integer) are counted a task at a time and summed by key; nodes of full depth follow from them, and each shallower level by a sum over the nodes
whose context is longer by a byte: ``DEPTH`` aggregations of ever smaller tables, in column expressions. The way down multiplies the weights along each path, so that a node says what a path that ends there
predicts. Grams of texts that aren't learned from are listed with the counts, so that each gram of any text gets its one number beforehand. Numbers of grams and counts of words are broadcast as sorted arrays where they
take up to ``held_bytes``; beyond, those of the most frequent keys are, as many as fit, and only the rare keys of each text are joined with the rest. All splits give the same figures but for the order of sums.

The baseline adds log10((c + 1) / (N + V + 1)) over tokens: words of ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and one end a text. Words are held as 64-bit hashes.

Defined results: a null text is empty and has one token, its end; a row without an id is scored but not learned from, and its held_out is null; rows that repeat are learned from
and scored each; where nothing is learned from, each bit has a probability of one half and the baseline is 0; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import bound_batches, join_spread, materialize, table
from .wordhash import hash_words

FOLDS, HELD_OUT = 7, 2
DEPTH = 4
HELD_BYTES, HELD_COUNTS, SPAN = 16 << 20, 1_000_000, 1 << 19
END = 0xFF
WORD, GRAM = 0, 1
LOG10_2 = float(np.log10(2.0))

#: Bytes of a token, A-Z lower-cased; the blanks part them.
_TOKEN = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))
#: The end of a text as a token's key: no word's hash is changed for it, as words' keys are even and this is odd.
END_KEY = 1

_NODE = ["ctx", "node"]


# -- texts -----------------------------------------------------------------------------------------


def word_keys(hashes: np.ndarray) -> np.ndarray:
    return (hashes & ~np.uint64(1)).view(np.int64)


def grams(texts: list[str | None], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of a run of texts, and each text's number of them (bytes and the end)."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    pad, end = bytes([END]) * depth, bytes([END])
    data = np.frombuffer(b"".join(x for t in raw for x in (pad, t, end)) or end, np.uint8).astype(np.int64)
    sizes = np.array([len(t) + 1 for t in raw], np.int64)
    inside = np.ones(len(data), bool)
    starts = np.cumsum(sizes + depth) - sizes - depth
    for k in range(depth):
        inside[starts + k] = False
    keys = np.zeros(len(data) - depth, np.int64)
    for k in range(depth + 1):
        keys = (keys << 8) | data[k : len(data) - depth + k]
    return keys[inside[depth:]], sizes


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Parts of a batch of about SPAN characters; a longer text is a part of its own."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > first and size + n > SPAN:
            yield first, i
            first, size = i, 0
        size += n
    if len(texts) > first:
        yield first, len(texts)


class _Counts:
    """Counts by key that a task holds, up to a bound."""

    def __init__(self, kind: int, held: int):
        self.kind, self.held, self.parts, self.size = kind, held, [], 0

    def add(self, keys: np.ndarray, learned: bool = True) -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(keys, return_counts=True)
        self.parts.append((keys, n * learned))
        self.size += len(keys)
        if self.size > 2 * self.held:
            self._settle()
            if self.size > self.held:
                yield from self.out()

    def _settle(self) -> None:
        keys = np.concatenate([k for k, _ in self.parts])
        n = np.concatenate([c for _, c in self.parts])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        self.parts = [(keys[first], np.add.reduceat(n[order], first))]
        self.size = len(first)

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self._settle()
            keys, n = self.parts[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), self.kind, np.int8)), pa.array(keys), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])
        self.parts, self.size = [], 0


def count_corpus(rows: DataFrame, depth: int = DEPTH, held: int = HELD_COUNTS) -> DataFrame:
    """kind, key, n: words with ends, and grams, of the texts to learn from; grams that only other texts have come with 0. rows: text, learn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found = _Counts(WORD, held), _Counts(GRAM, held)
        for batch in batches:
            given, learn = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for learned in (True, False):
                own = [t for t, x in zip(given, learn, strict=True) if bool(x) is learned]
                for first, end in _runs(own):
                    some = own[first:end]
                    if learned:
                        hashes = [word_keys(r.hashes) for r in hash_words(some, SPAN, _TOKEN)]
                        yield from words.add(np.concatenate([*hashes, np.full(len(some), END_KEY, np.int64)]))
                    yield from found.add(grams(some, depth)[0], learned)
        yield from words.out()
        yield from found.out()

    return rows.select("text", "learn").mapInArrow(run, "kind tinyint, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


# -- the trees -------------------------------------------------------------------------------------


def _log_gamma(x: Column) -> Column:
    """For x of 1/2 and more, by Stirling's series eight steps up."""
    y = x + 8
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    return (y - 0.5) * F.log(y) - y + 0.5 * float(np.log(2 * np.pi)) + series - F.log(product)


def _estimate(n0: Column, n1: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - float(np.log(np.pi))


def trees(counted: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """For each depth, written: ctx, node, own0 and own1 (what the node itself predicts), weight (of itself against its child)."""
    x, j = F.col("key").bitwiseAND(F.lit(255)).cast("int"), F.col("j")
    bits = counted.select(F.shiftright("key", 8).alias("ctx"), x.alias("x"), "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"))
    bits = bits.select("ctx", F.expr("cast(shiftleft(1, j) | shiftright(x, 8 - j) as int)").alias("node"), F.expr("shiftright(x, 7 - j) & 1").alias("bit"), "n")
    zeros, ones = (F.coalesce(F.sum(F.when(F.col("bit") == b, F.col("n"))), F.lit(0)) for b in (0, 1))
    level = bits.groupBy(*_NODE).agg(zeros.alias("n0"), ones.alias("n1")).withColumn("below", F.lit(None).cast("double"))
    out: list[DataFrame] = []
    for d in range(depth, -1, -1):
        own = _estimate(F.col("n0").cast("double"), F.col("n1").cast("double"))
        level = materialize(level.withColumn("own", own), f"tree-{d}")
        total = F.col("n0") + F.col("n1") + 1.0
        # own and below are logarithms; weight is own / (own + below)
        weight = F.when(F.col("below").isNull(), 1.0).otherwise(1 / (1 + F.exp(F.least(F.col("below") - F.col("own"), F.lit(700.0)))))
        out.insert(0, level.select(*_NODE, ((F.col("n0") + 0.5) / total).alias("own0"), ((F.col("n1") + 0.5) / total).alias("own1"), weight.alias("weight")))
        most = F.greatest("own", "below")
        mixed = F.coalesce(most + F.log1p(F.exp(F.least("own", "below") - most)) - float(np.log(2.0)), F.col("own"))  # at full depth nothing is below
        if d:
            shorter = F.col("ctx").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1)) if d > 1 else F.lit(0).cast("long")
            up = level.select(shorter.alias("ctx"), "node", "n0", "n1", F.when(F.col("below").isNull(), F.col("own")).otherwise(mixed).alias("w"))
            level = up.groupBy(*_NODE).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("w").alias("below"))
    return out


def _node_key(d: int, ctx: Column, node: Column) -> Column:
    return F.lit(d).cast("long") * F.lit(1 << 56) + ctx * 256 + node


def predictions(levels: list[DataFrame]) -> DataFrame:
    """key (depth, context and decision in one integer), l0, l1: log10 of what a path that ends at the node predicts."""
    out = path = None
    for d, level in enumerate(levels):
        if path is None:
            own = level.select(*_NODE, (F.col("weight") * F.col("own0")).alias("a0"), (F.col("weight") * F.col("own1")).alias("a1"), (1 - F.col("weight")).alias("rest"))
        else:
            shorter = F.col("ctx").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1)) if d > 1 else F.lit(0).cast("long")
            above = path.select(F.col("ctx").alias("up"), "node", F.col("a0").alias("b0"), F.col("a1").alias("b1"), F.col("rest").alias("r"))
            own = level.withColumn("up", shorter).join(above, ["up", "node"])
            part = lambda b, o: (F.col(b) + F.col("r") * F.col("weight") * F.col(o))
            own = own.select(*_NODE, part("b0", "own0").alias("a0"), part("b1", "own1").alias("a1"), (F.col("r") * (1 - F.col("weight"))).alias("rest"))
        path = materialize(own, f"path-{d}")
        said = path.select(_node_key(d, F.col("ctx"), F.col("node")).alias("key"), F.log10(F.col("a0") + F.col("rest") / 2).alias("l0"), F.log10(F.col("a1") + F.col("rest") / 2).alias("l1"))
        out = said if out is None else out.unionByName(said)
    return out


def _decisions(keys: DataFrame) -> DataFrame:
    """key -> key, ctx, node, bit: the eight decisions of each gram."""
    x = keys.select("key", F.shiftright("key", 8).alias("ctx"), F.col("key").bitwiseAND(F.lit(255)).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"))
    return x.select("key", "ctx", F.expr("cast(shiftleft(1, j) | shiftright(x, 8 - j) as int)").alias("node"), F.expr("shiftright(x, 7 - j) & 1").alias("bit"))


def unseen_values(new: DataFrame, said: DataFrame, depth: int) -> DataFrame:
    """key, value (log10) of grams that training has not met: each decision by the deepest node on its path."""
    each = _decisions(new.select("key"))
    d = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d")
    at = each.select("key", "node", "bit", "ctx", d).withColumn("at", F.expr("cast(d as bigint) * 72057594037927936 + (ctx & (shiftleft(1L, 8 * d) - 1)) * 256 + node"))
    met = at.join(said.withColumnRenamed("key", "at"), "at", "left").where("d = 0 or l0 is not null")
    deepest = met.groupBy("key", "node", "bit").agg(F.max_by(F.struct("l0", "l1"), "d").alias("l"))
    value = F.coalesce(F.when(F.col("bit") == 1, F.col("l.l1")).otherwise(F.col("l.l0")), F.lit(-LOG10_2))
    return deepest.groupBy("key").agg(F.sum(value).alias("value"))


def gram_values(counted: DataFrame, said: DataFrame, depth: int) -> DataFrame:
    """key, value (log10) of the grams that training has met, whose nodes are all of full depth."""
    at = _decisions(counted.select("key")).withColumn("at", _node_key(depth, F.col("ctx"), F.col("node")))
    value = F.when(F.col("bit") == 1, F.col("l1")).otherwise(F.col("l0"))
    return at.join(said.withColumnRenamed("key", "at"), "at").groupBy("key").agg(F.sum(value).alias("value"))


# -- scoring ---------------------------------------------------------------------------------------


@dataclass
class Held:
    """Values (log10) by sorted key of each kind. Whether they are all that there are, and what a word has that isn't among them then."""

    keys: list[np.ndarray]
    values: list[np.ndarray]
    whole: bool
    unknown: float

    def find(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key, 0 where it isn't here, and whether it is."""
        held, values = self.keys[kind], self.values[kind]
        if not len(held):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
        known = held[at] == keys
        return np.where(known, values[at], 0.0), known


def hold(model: DataFrame, held_bytes: int, unknown: float) -> tuple[Held, int]:
    """The values of the most frequent keys, as many as fit, and the count from which a key is held (0: all are). model: kind, key, n, value."""
    room = held_bytes // 16
    power = F.when(F.col("n") > 0, F.floor(F.log2(F.col("n").cast("double")))).otherwise(-1).cast("int")
    sizes = {r["p"]: r["c"] for r in model.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}  # at most 65 rows
    least, whole = 0, sum(sizes.values()) <= room
    if not whole:
        least, total = 1 << 62, 0
        for p in sorted(sizes, reverse=True):
            total += sizes[p]
            if total > room or p < 0:
                break
            least = 1 << p
    t = model.where(F.col("n") >= least).select("kind", "key", "value").orderBy("kind", "key").toArrow()
    kind = t.column("kind").to_numpy()
    cut = int(np.searchsorted(kind, GRAM))
    part = lambda c: [t.column(c).slice(0, cut).to_numpy(), t.column(c).slice(cut).to_numpy()]
    return Held(part("key"), part("value"), whole, unknown), least


_SUMS = "n_tokens long, n_known long, n_bytes long, base_score double, score double"
_RARE = "row long, kind tinyint, key long, n long"


def _by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums by text; offsets from 0 on."""
    total = np.add.reduceat(np.append(values, 0), np.minimum(offsets[:-1], len(values)))
    return np.where(np.diff(offsets) > 0, total, 0)


def _summed(rows: DataFrame, held: Held, depth: int) -> DataFrame:
    """row, doc_id, held_out and sums of what is held; where not all is, also rows with a row's rare keys. rows: row, doc_id, held_out, text."""
    broadcast = rows.sparkSession.sparkContext.broadcast(held)
    names = [c.split()[0] for c in _SUMS.split(", ")]
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), *((n, pa.float64() if "score" in n else pa.int64()) for n in names), ("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64())])

    def sums(batch: pa.RecordBatch, parts: list) -> pa.RecordBatch:
        n = batch.num_rows
        arrays = [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays, pa.nulls(n, pa.int8()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema)

    def rare(rows_: np.ndarray, kind: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        order = np.lexsort((keys, rows_))
        r, k = rows_[order], keys[order]
        first = np.concatenate([[0], np.flatnonzero((r[1:] != r[:-1]) | (k[1:] != k[:-1])) + 1])
        n = len(first)
        none = {f.name: pa.nulls(n, f.type) for f in schema}
        of = none | {"row": pa.array(r[first]), "kind": pa.array(np.full(n, kind, np.int8)), "key": pa.array(k[first]), "n": pa.array(np.diff(first, append=len(r)))}
        yield pa.RecordBatch.from_arrays([of[f.name] for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broadcast.value
        end, end_known = m.find(WORD, np.array([END_KEY], np.int64))
        if m.whole and not end_known[0]:
            end = np.array([m.unknown])
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers, texts, parts = batch.column(0).to_numpy(), batch.column(3).to_pylist(), []
            for first, last in _runs(texts):
                some, own = texts[first:last], numbers[first:last]
                n, known, base = [], [], []
                for r in hash_words(some, SPAN, _TOKEN):
                    keys = word_keys(r.hashes)
                    value, met = m.find(WORD, keys)
                    if m.whole:
                        value[~met] = m.unknown
                    else:
                        yield from rare(np.repeat(own[r.first : r.first + len(r.counts())], r.counts())[~met], WORD, keys[~met])
                    n.append(r.counts() + 1)
                    known.append(_by_text(met.astype(np.int64), r.offsets) + int(end_known[0]))
                    base.append(_by_text(value, r.offsets) + end[0])
                if not m.whole and not end_known[0]:
                    yield from rare(own, WORD, np.full(len(own), END_KEY, np.int64))
                keys, sizes = grams(some, depth)
                each, back = np.unique(keys, return_inverse=True)
                value, met = m.find(GRAM, each)
                back = back.reshape(-1)
                if not m.whole:
                    lost = ~met[back]
                    yield from rare(np.repeat(own, sizes)[lost], GRAM, keys[lost])
                parts.append((np.concatenate(n), np.concatenate(known), sizes, np.concatenate(base), _by_text(value[back], np.concatenate([[0], np.cumsum(sizes)]))))
            yield sums(batch, parts)

    return rows.select("row", "doc_id", "held_out", "text").mapInArrow(run, f"row long, doc_id long, held_out boolean, {_SUMS}, kind tinyint, key long, n long")


def _with_rare(summed: DataFrame, model: DataFrame, least: int, unknown: float) -> DataFrame:
    """``summed`` and what the rare keys add, from the part of the model that isn't held."""
    rare = summed.where("kind is not null").select(*(c.split()[0] for c in _RARE.split(", ")))
    few = model.where(F.col("n") < least).select("kind", "key", "value", (F.col("n") > 0).alias("met"))
    # rare keys have few rows each, but with nothing held all keys are here, and common ones are hot
    known = join_spread(rare, few, ["kind", "key"])
    new = rare.where(F.col("kind") == WORD).join(few.where(F.col("kind") == WORD).select("kind", "key"), ["kind", "key"], "left_anti").withColumns({"value": F.lit(unknown), "met": F.lit(False)})
    each = known.unionByName(new)
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0))
    n, v = F.col("n"), F.col("n") * F.col("value")
    more = each.groupBy("row").agg(of(WORD, F.when(F.col("met"), n).otherwise(0)).alias("more_known"), of(WORD, v).alias("more_base"), of(GRAM, v).alias("more_score"))
    out = summed.where("kind is null").drop("kind", "key", "n").join(more, "row", "left").na.fill(0, ["more_known", "more_base", "more_score"])
    return out.withColumns({"n_known": F.col("n_known") + F.col("more_known"), "base_score": F.col("base_score") + F.col("more_base"), "score": F.col("score") + F.col("more_score")})


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, depth: int = DEPTH, held_bytes: int = HELD_BYTES, held_counts: int = HELD_COUNTS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and bits_per_byte (the code length, the end byte included)."""
    if not 0 <= depth <= 6:
        raise ValueError("a gram of depth + 1 bytes and its depth must fit 64 bits: depth is from 0 to 6")
    bound_batches(docs.sparkSession)
    ident = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(ident.alias("doc_id"), (F.crc32(ident.cast("string").cast("binary")) % folds == held_out).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counted = materialize(count_corpus(rows.select("text", (~F.col("held_out")).alias("learn")), depth, held_counts), "counted")
    words, found = counted.where((F.col("kind") == WORD) & (F.col("n") > 0)).select("key", "n"), counted.where(F.col("kind") == GRAM).select("key", "n")
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total = size["n"] + size["v"] + 1
    seen, new = found.where("n > 0"), found.where("n = 0")
    said = materialize(predictions(trees(seen, depth)), "said")
    values = gram_values(seen, said, depth).join(seen, "key").unionByName(unseen_values(new, said, depth).withColumn("n", F.lit(0).cast("long")))
    of = lambda kind, x: x.select(F.lit(kind).cast("tinyint").alias("kind"), "key", "n", "value")
    model = materialize(of(WORD, words.withColumn("value", F.log10((F.col("n") + 1) / F.lit(total)))).unionByName(of(GRAM, values)), "model")
    unknown = -float(np.log10(total))
    held, least = hold(model, held_bytes, unknown)
    if held.whole:
        scored = _summed(rows.withColumn("row", F.lit(0).cast("long")), held, depth)
    else:
        # rows are numbered in the pass that writes both their sums and their rare keys
        numbered = rows.withColumn("row", F.monotonically_increasing_id())
        scored = _with_rare(materialize(_summed(numbered, held, depth), "summed"), model, least, unknown)
    bits = -F.col("score") / LOG10_2 / F.col("n_bytes")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(size["n"]).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))


def op13_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
