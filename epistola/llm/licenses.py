"""Licence scan by ordered signature rules (op2).

A text's words are searched once for the rules' keywords (one automaton); only rules whose keyword is
there run their regular expression. Overlapping detections are resolved in the rules' order: by
priority, then length, then place; a detection that lies within one accepted before it is suppressed, which takes time in proportion to
n log n for n detections. Base
phrases are rules as well, of the lowest priority; their places are counted before
suppression, and their labels stay.

Score: 1 minus the product of (1 - weight) over the accepted detections' rules, each rule once; 0 without any.

Defined results: null and empty texts have no words; phrases may run across lines; rows that repeat
are scanned each; an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_rules import BASE, Rule, build_rules
from .runtime import bound_batches, table
from .wordhash import words

Detection = tuple[str, str, int, int, int, float]


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self._base = {f"base-{label}" for label in BASE.values()}
        gates: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            gates.setdefault(r.keyword if r.inside or len(r.keyword) >= 4 else f" {r.keyword} ", []).append(i)
        self._automaton = ahocorasick.Automaton()
        for keyword, own in gates.items():
            self._automaton.add_word(keyword, own)
        self._automaton.make_automaton()

    def gated(self, plain: str) -> set[int]:
        """Places in ``rules`` of those whose keyword these words, with one space between them, hold."""
        return {i for _, own in self._automaton.iter(f" {plain} ") for i in own}

    def scan(self, text: str | None) -> tuple[int, list[Detection], list[Detection]]:
        """Number of words; base places; accepted detections (rule, label, first word, end word, priority, weight)."""
        w = words(text)
        plain = b" ".join(w).decode("utf-8", "replace")
        gated = sorted(self.gated(plain))
        if not gated:
            return len(w), [], []
        blanks = np.flatnonzero(np.frombuffer(plain.encode("utf-32-le", "replace"), "<u4") == 0x20)
        found: list[Detection] = []
        for i in gated:
            r = self.rules[i]
            if spans := [m.span() for m in r.pattern.finditer(plain)]:
                first, last = np.searchsorted(blanks, np.array(spans).T).tolist()
                found += [(r.name, r.label, a, b + 1, r.priority, r.weight) for a, b in zip(first, last, strict=True)]
        base = [d for d in found if d[0] in self._base]
        return len(w), base, _resolved(found)


def _resolved(found: list[Detection]) -> list[Detection]:
    """Detections in the rules' order, without those that lie within one accepted before; in the order of their first word."""
    starts = sorted({d[2] for d in found})
    place = {s: k + 1 for k, s in enumerate(starts)}
    furthest = [0] * (len(starts) + 1)  # a tree of prefix maxima: the furthest end of accepted detections by their start
    accepted: list[Detection] = []
    for d in sorted(found, key=lambda d: (-d[4], d[2] - d[3], d[2], d[0])):
        k, end = place[d[2]], 0
        while k:
            end = max(end, furthest[k])
            k &= k - 1
        if end >= d[3]:
            continue
        accepted.append(d)
        k = place[d[2]]
        while k < len(furthest):
            furthest[k] = max(furthest[k], d[3])
            k += k & -k
    return sorted(accepted, key=lambda d: d[2])


@cache
def scanner() -> Scanner:
    return Scanner(build_rules())


_SCHEMA = "doc_id long, n_words long, base array<struct<label:string,first:long>>, detections array<struct<rule:string,label:string,first:long,end:long,priority:int>>, score double"
_BASE_TYPE = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())]))
_FOUND_TYPE = pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("priority", pa.int32())]))


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base (places of base phrases), detections (accepted, as word ranges) and score."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for batch in batches:
            n_words, bases, all_found, scores = [], [], [], []
            for text in batch.column(1):
                n, base, found = s.scan(text.as_py())
                rest = 1.0
                for weight in {d[0]: d[5] for d in found}.values():
                    rest *= 1 - weight
                n_words.append(n)
                bases.append([{"label": d[1], "first": d[2]} for d in base])
                all_found.append([{"rule": d[0], "label": d[1], "first": d[2], "end": d[3], "priority": d[4]} for d in found])
                scores.append(1 - rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(bases, _BASE_TYPE), pa.array(all_found, _FOUND_TYPE), pa.array(scores, pa.float64())],
                names=["doc_id", "n_words", "base", "detections", "score"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _SCHEMA)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    labels = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    places = F.transform("base", lambda x: x["first"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        joined(labels("base")).alias("base_labels"), joined(F.concat(labels("base"), labels("detections"))).alias("labels"), "score",
    )
