"""Ranked search, source audit and context-tree scoring, against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from epistola.llm import audit, ctw, lexical

from .helpers import FOLD, awkward, docs, empty, words

# -- search ----------------------------------------------------------------------------------------


def ranked(texts, items, k=10):
    """(item row, rank, document, score), from the formula."""
    own = [words(t) for t in texts]
    n_docs, n_terms = sum(1 for w in own if w), sum(map(len, own))
    df = Counter(t for w in own for t in set(w))
    out = []
    for i, item in enumerate(items):
        found = []
        for d, w in enumerate(own):
            if not w:
                continue
            m, tf = 10 + (90 * len(w) * n_docs) // n_terms, Counter(w)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in set(words(item)) if tf[t])
            if s > 0:
                found.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return out


def prose(rng, n, vocabulary, least=1, most=60):
    weights = [1 / (1 + i) for i in range(len(vocabulary))]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randint(least, most))) for _ in range(n)]


def item_table(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")


def search_rows(df):
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"first_blocks": 1, "held_pairs": 0}, {"held_terms": 12}])
def test_search_like_brute_force(spark, options):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(150)] + ["éclair", "ß", "x9"]
    texts = prose(rng, 300, vocabulary) + ["", None, "...", "w1 w2 w3", "w1 w2 w3", "W1, W2! w3"]
    items = [*prose(rng, 8, vocabulary, 1, 25), "w1 w2 w3", "nowhere", "", None, "w149 W149"]
    got = lexical.search(item_table(spark, items), lexical.build_index(docs(spark, *texts), block_docs=16), **options)
    assert search_rows(got) == ranked(texts, items)


def test_search_skips_blocks(spark):
    """Documents on one subject lie together; only their blocks are scored once the threshold is known."""
    rng = random.Random(6)
    common = [f"c{i}" for i in range(50)]
    texts = [" ".join([*rng.choices(common, k=40), *rng.choices([f"s{i // 40}-{j}" for j in range(5)], k=6)]) for i in range(2000)]
    items = ["c1 c2 s7-1 s7-2 s7-3", "c3 s33-0 s33-4 c4"]
    index = lexical.build_index(docs(spark, *texts), block_docs=20)
    rows = index.maxima.count()
    hashes = {w: h for r in lexical.hash_words(items) for w, h in zip([x for t in items for x in words(t)], r.hashes.tolist(), strict=True)}
    table = spark.createDataFrame([(i, bytearray(np.unique(np.array([hashes[w] for w in words(t)], np.uint64)).tobytes())) for i, t in enumerate(items)], "row bigint, terms binary")
    found, pairs = lexical.search_group(index, lexical._queries(table.orderBy("row").toArrow()), 10, 4, 1000)
    assert sorted((r["q"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()) == ranked(texts, items)
    assert rows == 100 and pairs.count() <= 12


def test_search_bounds_hold(spark):
    """A block's bound is never below one of its scores, and is reached where one document has every maximum."""
    rng = random.Random(7)
    texts = prose(rng, 60, [f"w{i}" for i in range(20)])
    index = lexical.build_index(docs(spark, *texts), block_docs=7)
    q = lexical.Queries(*np.unique(next(iter(lexical.hash_words(["w1 w4 w19 gone"]))).hashes, return_inverse=True), np.array([0, 4]), np.array([3, 5, 7, 11], np.int64))
    scored = {}
    every = lexical.blocks_above(index, q, np.zeros(1, np.int64))
    for r in every.collect():
        one = lexical._scored(index, q, every.where(F.col("block") == r["block"]), np.zeros(1, np.int64), 1).collect()
        scored[r["block"]] = one[0]["score"]
        assert one[0]["score"] <= r["bounds"][0]
    assert len(scored) > 3


def test_search_awkward(spark):
    index = lexical.build_index(awkward(spark))
    items = spark.createDataFrame([(1, "ONE two", "z", 5), (1, "ONE two", "z", 5), (None, "id here", "z", 5), (2, None, "z", 5), (3, "", "z", 5)], "item_id bigint, text string, block string, q int")
    got = lexical.search(items, index).collect()
    of = lambda i: [(r["rank"], r["doc_id"]) for r in got if r["item_id"] == i]
    assert sorted(of(1)) == [(1, 4), (1, 4), (2, 4), (2, 4), (3, 5), (3, 5)] and of(None) == [(1, None)] and not of(2) and not of(3)
    assert lexical.search(empty(items), index).count() == 0
    assert lexical.search(items, lexical.build_index(empty(awkward(spark)))).count() == 0


def test_search_orders_null_ids_last(spark):
    rows = spark.createDataFrame([(None, "a b"), (7, "a b"), (3, "a b"), (None, "c"), (9, "c d")], "doc_id bigint, text string")
    got = lexical.search(item_table(spark, ["a"]), lexical.build_index(rows)).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [3, 7, None]


# -- audit -----------------------------------------------------------------------------------------


def letters(text):
    out, word = [], ""
    for c in (text or "").translate(FOLD) + " ":
        if c in "abcdefghijklmnopqrstuvwxyz" or ord(c) >= 0x80:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def audited(rows, min_docs=3, top=200):
    """rows: (text, lang, source)."""
    rows = [(letters(t), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        df = Counter(t for w, x, _ in rows if x == lang for t in set(w))
        kept = [t for t, n in df.items() if n >= min_docs]
        sources = sorted({s for _, x, s in rows if x == lang})
        count = {s: Counter(t for w, x, y in rows if (x, y) == (lang, s) for t in w) for s in sources}
        total = sum(count.values(), Counter())
        size = lambda c: sum(c[t] for t in kept) + len(kept)
        p = lambda c, t: 1 + 1_000_000_000 * (c[t] + 1) // size(c)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p(count[s], t), p(count[o], t)) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p(count[s], t), p(total, t)), t.encode()) for t in kept if count[s][t] and p(count[s], t) > p(total, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, i.decode(), -v, r) for r, (v, i) in enumerate(found, 1)]
    return sorted(out)


def source_rows(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string")


def audit_rows(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"held_counts": 20, "held_cells": 5, "held_groups": 0}])
def test_audit_like_brute_force(spark, options):
    rng = random.Random(9)
    texts = prose(rng, 160, [*(f"word{'abcdefghijklmnop'[i % 16]}{'qrstuvwx'[i // 16]}" for i in range(100)), "Éa", "a1b2", "ß"])
    rows = [(t, rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "s2", "ü", None])) for t in texts]
    rows += [("", "fr", "s1"), (None, "fr", "s2"), ("un deux", "fr", "s3"), ("seul", "it", "s0")]
    assert audit_rows(audit.audit(source_rows(spark, rows), **options)) == audited(rows)


def test_audit_decimal_way(spark):
    """Products beyond 64 bits are exact."""
    rows = [(9, 10), (10**13, 10**14), (9_223_372_036, 10**12), (4_611_686_018, 10**11), (0, 3)]
    got = spark.createDataFrame(rows, "c bigint, n bigint").select("c", "n", audit._p(F.col("c"), F.col("n")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 1) // r["n"] for r in got)


def test_audit_cells_by_hand():
    """Lists of one term each: three sources make three pairs, equal cells are one."""
    import pyarrow as pa

    held = pa.array([[{"g": 2, "n": 5}, {"g": 0, "n": 1}], [{"g": 0, "n": 1}, {"g": 1, "n": 1}, {"g": 2, "n": 5}], [{"g": 1, "n": 4}], []], pa.list_(pa.struct([("g", pa.int64()), ("n", pa.int64())])))
    for bound in (1, 1000):
        got = Counter()
        for b in audit._tally(bound)(iter([pa.RecordBatch.from_arrays([held], names=["held"])])):
            for *cell, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got[tuple(cell)] += n
        assert got == {(0, 2, 1, 5): 2, (0, 1, 1, 1): 1, (1, 2, 1, 5): 1}


def test_audit_awkward(spark):
    d = awkward(spark)
    rows = [(r["text"], r["lang"], r["source"]) for r in d.collect()]
    assert audit_rows(audit.audit(d)) == audited(rows)
    assert audit.audit(empty(d)).count() == 0


# -- context trees ---------------------------------------------------------------------------------


class Tree:
    """Context-tree weighting as it is defined: nested nodes, log probabilities by recursion."""

    def __init__(self, depth):
        self.depth, self.nodes = depth, defaultdict(lambda: [0, 0])

    @staticmethod
    def decisions(data, depth):
        padded = b"\xff" * depth + data + b"\xff"
        for i in range(depth, len(padded)):
            node = 1
            for j in range(7, -1, -1):
                bit = padded[i] >> j & 1
                yield padded[i - depth : i], node, bit
                node = 2 * node + bit

    def learn(self, data):
        for context, node, bit in self.decisions(data, self.depth):
            for d in range(self.depth + 1):
                self.nodes[node, context[self.depth - d :]][bit] += 1

    def close(self):
        self.estimate = {k: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for k, (a, b) in self.nodes.items()}
        self.below, self.weighted = defaultdict(float), {}
        for node, context in sorted(self.nodes, key=lambda k: -len(k[1])):
            e = self.estimate[node, context]
            w = e if len(context) == self.depth else math.log(0.5) + np.logaddexp(e, self.below[node, context])
            self.weighted[node, context] = w
            if context:
                self.below[node, context[1:]] += w

    def predict(self, node, context, d=0):
        key = node, context[self.depth - d :]
        if key not in self.nodes:
            return 0.5
        a, b = self.nodes[key]
        own = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return own
        weight = 1 / (1 + math.exp(min(700, self.below[key] - self.estimate[key])))
        return weight * own + (1 - weight) * self.predict(node, context, d + 1)

    def score(self, data):
        return sum(math.log10(p if bit else 1 - p) for context, node, bit in self.decisions(data, self.depth) for p in [self.predict(node, context)])


def tokens(text):
    return [w.translate(FOLD) for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def scored(rows, depth=4):
    """rows: (doc_id, text) -> held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held = [zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else None for i, _ in rows]
    train = [t for (_, t), h in zip(rows, held, strict=True) if h is False]
    count = Counter(w for t in train for w in [*tokens(t), None])
    n, v = sum(count.values()), len(count)
    tree = Tree(depth)
    for t in train:
        tree.learn((t or "").encode())
    tree.close()
    out = []
    for (_, t), h in zip(rows, held, strict=True):
        own = [*tokens(t), None]
        out.append((h, len(own), sum(count[w] > 0 for w in own), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), tree.score((t or "").encode())))
    return out


def same_scores(got, expected):
    assert len(got) == len(expected)
    for r, e in zip(got, expected, strict=True):
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == e[:4]
        assert r["base_score"] == pytest.approx(e[4], abs=1e-6) and r["score"] == pytest.approx(e[5], abs=1e-6)


@pytest.mark.parametrize("options", [{}, {"held_bytes": 0}, {"held_bytes": 400}, {"held_counts": 50}, {"depth": 0}, {"depth": 2, "held_bytes": 0}])
def test_context_trees_like_brute_force(spark, options):
    rng = random.Random(11)
    texts = [*prose(rng, 50, ["the", "then", "That", "is", "été", "Ω.", "a,b", "\x00"], 1, 20), "", None, "never seen: ÄÖ#\x0bthe", "the"]
    got = ctw.score(docs(spark, *texts), **options).orderBy("doc_id").collect()
    same_scores(got, scored(list(enumerate(texts)), options.get("depth", 4)))


def test_context_trees_awkward(spark):
    d = awkward(spark)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    rows = [(r["doc_id"], (r["text"] or "")[:300]) for r in sorted(d.collect(), key=key)]
    short = d.withColumn("text", F.substring("text", 1, 300))
    for options in ({}, {"held_bytes": 0}):
        same_scores(sorted(ctw.score(short, **options).collect(), key=key), scored(rows))
    whole = [r for r in ctw.score(d).collect() if r["doc_id"] == 3][0]
    assert whole["n_tokens"] == 40_001
    assert ctw.score(empty(d)).count() == 0
    with pytest.raises(ValueError):
        ctw.score(d, depth=7)


def test_context_trees_without_training(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    d = spark.createDataFrame([(held, "abc"), (None, "x")], "doc_id bigint, text string")
    for options in ({}, {"held_bytes": 0}):
        got = {r["doc_id"]: r for r in ctw.score(d, **options).collect()}
        assert got[held]["score"] == pytest.approx(-4 * 8 * math.log10(2)) and got[held]["base_score"] == 0 and got[held]["n_known"] == 0
        assert got[None]["held_out"] is None and got[None]["bits_per_byte"] == pytest.approx(8)


def test_next_bytes_have_probability_one(spark):
    """What the model says of each next byte, met or not, sums to 1."""
    texts = ["abracadabra", "abba", "banana", "cabana"] * 5
    counted = ctw.count_corpus(docs(spark, *texts).select("text", F.lit(True).alias("learn")))
    found = counted.where("kind = 1").select("key", "n")
    said = ctw.predictions(ctw.trees(found))
    for context in (b"\xff\xff\xff\xff", b"bana", b"zzzz", b"\xff\xffab"):
        keys = spark.range(256).select((F.lit(int.from_bytes(context, "big") << 8) + F.col("id")).alias("key"))
        assert ctw.unseen_values(keys, said, ctw.DEPTH).agg(F.sum(F.pow(F.lit(10.0), "value"))).first()[0] == pytest.approx(1, abs=1e-9)
    known = ctw.gram_values(found, said, ctw.DEPTH).join(ctw.unseen_values(found, said, ctw.DEPTH).withColumnRenamed("value", "again"), "key")
    assert known.count() == found.count() and known.where("abs(value - again) > 1e-9").count() == 0


def test_deeper_contexts_code_held_out_texts_shorter(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    mean = {depth: ctw.score(d, depth=depth).where("held_out and n_tokens > 20").agg(F.avg("bits_per_byte")).first()[0] for depth in (0, 2, 4)}
    assert mean[4] < mean[2] < mean[0] < 8
