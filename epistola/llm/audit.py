"""Source divergence audit by joint count histograms (op12).

Each language keeps the terms that at least ``MIN_DOCS`` of its documents hold. For two sources of a language, only how often each combination of
their two counts is met among the kept terms matters: the divergence is evaluated once a combination and multiplied. Combinations of two counts above
zero are tallied term by term, combined in each task before they are shuffled. Cells with a zero follow from what is known without a pair: of the terms with count c
in one source, those not tallied with the other have zero there; and what neither has is the rest of the language's terms. So a term that few sources use costs few
pairs, and a pair's cost beyond its shared terms is the number of distinct counts.

With smoothing ``ALPHA`` and ``SCALE``, p = 1 + floor(SCALE * (count + ALPHA) / (N + ALPHA * V)) and f = floor((p - q)**2 / q), all in integers; products that pass 64 bits are decimals.

Defined results: null text, lang and source count as ''; every (lang, source) is a group, even without terms; a language without kept terms gives pairs of
value 0; rows that repeat count each; an empty table gives no rows. Only text, lang and source are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import bound_batches, join_spread, materialize, table

MIN_DOCS, ALPHA, SCALE, TOP_TERMS = 3, 1, 1_000_000_000, 200
#: (group, term) counts that a task holds before it hands them on; combinations likewise; groups that are broadcast at most.
HELD_COUNTS, HELD_CELLS, HELD_GROUPS = 300_000, 1_000_000, 200_000

_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_CELL = ["a", "b", "ca", "cb"]


def terms_of(text: str) -> list[bytes]:
    """Maximal runs of letters and non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(_TERM_BYTES).split()


def _count(held: int):
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("df", pa.int64())])

    def rows(groups: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in groups.items():
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array([source] * len(n)), pa.array(n.keys(), pa.binary()), pa.array(n.values(), pa.int64()), pa.array([df[t] for t in n], pa.int64())], schema=schema)
                n.clear()
                df.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, df = groups.setdefault((lang, source), (Counter(), Counter()))
                terms = terms_of(text)
                n.update(terms)
                df.update(set(terms))
            if sum(len(n) for n, _ in groups.values()) > held:
                yield from rows(groups)
        yield from rows(groups)
        if groups:  # a row for each group, even without terms
            langs, sources = zip(*groups, strict=True)
            none = pa.nulls(len(groups), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(sources), pa.nulls(len(groups), pa.binary()), none, none], schema=schema)

    return run


def _combined(parts: list[np.ndarray]) -> np.ndarray:
    """Rows a, b, ca, cb, n with equal cells added."""
    x = np.concatenate(parts, axis=1)
    x = x[:, np.lexsort(x[3::-1])]
    first = np.concatenate([[0], np.flatnonzero((x[:4, 1:] != x[:4, :-1]).any(axis=0)) + 1]) if x.shape[1] else np.zeros(0, np.int64)
    return np.concatenate([x[:4, first], np.add.reduceat(x[4:], first, axis=1) if len(first) else x[4:]])


def _tally(held: int):
    """Lists of (group, count) of each term -> a, b, ca, cb, n for groups a < b."""

    def out(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=[*_CELL, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            group, count = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            lengths = lists.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(lengths)), lengths)
            order = np.lexsort((group, row))
            group, count = group[order], count[order]
            left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(row))  # entries from here to the list's end
            for step in range(1, int(lengths.max(initial=1))):
                k = np.flatnonzero(left > step)
                parts.append(np.stack([group[k], group[k + step], count[k], count[k + step], np.ones(len(k), np.int64)]))
                size += len(k)
                if size > 2 * held:
                    parts = [_combined(parts)]
                    size = parts[0].shape[1]
                    if size > held:
                        yield out(parts[0])
                        parts, size = [], 0
        if parts:
            yield out(_combined(parts))

    return run


def _p(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + ALPHA) / total), in decimals where the product passes 64 bits."""
    c = count + ALPHA
    return F.when(c <= (1 << 62) // SCALE, 1 + F.call_function("div", c * SCALE, total)).otherwise(1 + F.call_function("div", c.cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(19,0)")))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, held_counts: int = HELD_COUNTS, held_cells: int = HELD_CELLS, held_groups: int = HELD_GROUPS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    bound_batches(docs.sparkSession)
    d = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    each = d.mapInArrow(_count(held_counts), "lang string, source string, term binary, n long, df long")
    counts = materialize(each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "counts")
    named = materialize(counts.where("term is null").select("lang", "source").withColumn("g", F.monotonically_increasing_id()), "names")
    few = named.count() <= held_groups
    found = counts.where("term is not null")
    found = found.join(F.broadcast(named), ["lang", "source"]) if few else join_spread(found, named, ["lang", "source"])
    # the list of a term has an entry a source
    kept = found.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"), F.collect_list(F.struct("g", "n")).alias("held")).where(F.col("df") >= min_docs)
    kept = materialize(kept.select("lang", F.col("term").cast("string").alias("term"), "n", "held"), "kept")

    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n_lang"))
    entries = kept.select("lang", "term", F.col("n").alias("total"), F.explode("held").alias("e")).select("lang", "term", "total", "e.g", F.col("e.n").alias("c"))
    margins = materialize(entries.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n")), "margins")
    own = margins.groupBy("g").agg(F.sum(F.col("c") * F.col("n")).alias("n_own"), F.sum("n").alias("v_own"))
    sized = named.join(own, "g", "left").join(langs, "lang", "left").na.fill(0, ["n_own", "v_own", "v", "n_lang"])
    groups = materialize(sized.withColumn("d_own", F.col("n_own") + ALPHA * F.col("v")).withColumn("d_lang", F.col("n_lang") + ALPHA * F.col("v")), "groups")
    hold = F.broadcast if few else lambda x: x

    # cells of each pair of sources a < b: positive ones as tallied, those with a zero from the margins
    joint = materialize(kept.select("held").mapInArrow(_tally(held_cells), "a long, b long, ca long, cb long, n long").groupBy(*_CELL).agg(F.sum("n").alias("n")), "joint")
    side = lambda x: groups.select("lang", *(F.col(c).alias(f"{x}_{c}") for c in ("g", "source", "d_own", "v_own")), F.col("v").alias(f"{x}_v"))
    a, b = side("a"), side("b")
    pairs = materialize(a.join(hold(b), "lang").where("a_g < b_g"), "pairs")
    zero = F.lit(0).cast("long")
    cell = lambda x, ca, cb, n: x.select("a", "b", ca.alias("ca"), cb.alias("cb"), n.alias("n"))
    c = F.col
    ab = pairs.select(c("a_g").alias("a"), c("b_g").alias("b"))
    of_a, of_b = ab.join(margins.withColumnRenamed("g", "a"), "a"), ab.join(margins.withColumnRenamed("g", "b"), "b")
    both = joint.groupBy("a", "b").agg(F.sum("n").alias("both"))
    neither = pairs.select(c("a_g").alias("a"), c("b_g").alias("b"), "a_v", "a_v_own", "b_v_own").join(both, ["a", "b"], "left")
    cells = (
        joint
        .unionByName(cell(joint, c("ca"), zero, -c("n"))).unionByName(cell(of_a, c("c"), zero, c("n")))
        .unionByName(cell(joint, zero, c("cb"), -c("n"))).unionByName(cell(of_b, zero, c("c"), c("n")))
        .unionByName(cell(neither, zero, zero, c("a_v") - c("a_v_own") - c("b_v_own") + F.coalesce("both", zero)))
        .groupBy(*_CELL).agg(F.sum("n").alias("n")).where("n <> 0")
    )
    totals = groups.select(c("g").alias("a"), c("d_own").alias("da")), groups.select(c("g").alias("b"), c("d_own").alias("db"))
    p = cells.join(hold(totals[0]), "a").join(hold(totals[1]), "b").select("a", "b", "n", _p(c("ca"), c("da")).alias("pa"), _p(c("cb"), c("db")).alias("pb"))
    value = p.groupBy("a", "b").agg(F.sum(c("n") * _f(c("pa"), c("pb"))).alias("ab"), F.sum(c("n") * _f(c("pb"), c("pa"))).alias("ba"))
    valued = pairs.join(value, (c("a_g") == c("a")) & (c("b_g") == c("b")), "left")
    ways = F.explode(F.array(*(F.struct(c(f"{x}_source").alias("source"), c(f"{y}_source").alias("item"), F.coalesce(f"{x}{y}", zero).alias("value")) for x, y in ("ab", "ba"))))
    pair = valued.select("lang", ways.alias("w")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "w.value")

    spoken = entries.select("g", "term", "total", "c").join(hold(groups.select("g", "lang", "source", "d_own", "d_lang")), "g")
    term = spoken.select("lang", "source", F.lit("term").alias("part"), c("term").alias("item"), _p(c("c"), c("d_own")).alias("p"), _p(c("total"), c("d_lang")).alias("q")).where("p > q")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(c("value").desc(), "item")))
    term = ranked(term.select("lang", "source", "part", "item", _f(c("p"), c("q")).alias("value"))).where(c("rank") <= top_terms)
    return ranked(pair).unionByName(term)


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
