"""The stored index in segments: updates cost what they bring, hot terms are split, searches skip blocks."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from epistola.operators import search as S
from epistola.streaming import segments as G
from epistola.streaming.store import Store

ROW = "account string, message_id string, subject string, sender string, recipients string, body string"


def rows(spark, given):
    return spark.createDataFrame([(a, str(i), *x) for a, i, *x in given], ROW)


def texts(rng, n, first=0, vocabulary=None):
    words = vocabulary or [f"w{k}" for k in range(40)]
    some = lambda m: " ".join(rng.choices(words, [1 / (1 + k) for k in range(len(words))], k=rng.randint(0, m)))
    return [(rng.choice("ab"), first + i, some(4), f"p{rng.randrange(5)}", None, some(30)) for i in range(n)]


def found(df, digits=9):
    return sorted((r["account"], r["message_id"], round(r["score"], digits)) for r in df.collect())


def best(df, k, digits=9):
    every = sorted((round(r["score"], digits), r["account"], r["message_id"]) for r in df.collect())
    last = every[k - 1][0] if len(every) >= k else 0
    return sorted((a, i, s) for s, a, i in every if s <= last)


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def test_search_equals_a_search_of_everything(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_BITS", 3)
    given = rows(spark, texts(random.Random(2), 300))
    index, whole = G.StoredIndex(Store(spark, f"file://{tmp_path}/s"), stemmed=False, file_rows=500), S.build_index(given, False)
    index.rebuild(given)
    for query, prefix, account in (("w1 w2", False, None), ("w2-w1 w39", False, "a"), ("w3-w0 w7 w", True, None), ("nowhere", False, None), ("", False, None)):
        phrases = S.parse(query, False, prefix, False)
        everything = S.bm25(whole, phrases)
        assert found(index.hits(phrases)) == found(everything)
        of = everything.where(F.col("account") == account) if account else everything
        assert found(index.search(phrases, 5, account, first_blocks=2, few_blocks=0).hits) == best(of, 5)


def test_many_hits_are_dealt(spark, tmp_path, monkeypatch):
    """All hits of a common term are joined with their messages by shuffles, however small the files of their postings are; few are broadcast; both give the same rows."""
    given = rows(spark, texts(random.Random(9), 300))
    index, phrases = G.StoredIndex(Store(spark, f"file://{tmp_path}/s"), stemmed=False), S.parse("w0 w2", False, False, False)
    index.rebuild(given)
    few = index.hits(phrases)
    want = found(few)
    assert want and "BroadcastExchange" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(G, "FEW_ROWS", len(want) - 1, raising=False)
    many = index.hits(phrases)
    assert found(many) == want and "Broadcast" not in many._jdf.queryExecution().executedPlan().toString()


def test_updates_equal_a_fresh_build(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_BITS", 3)
    monkeypatch.setattr(G, "MOST_SEGMENTS", 2)
    rng, held = random.Random(3), {}
    index = G.StoredIndex(Store(spark, f"file://{tmp_path}/s"), stemmed=False)
    for turn in range(5):
        new = {(r[0], r[1]): r for r in texts(rng, 80 if turn == 0 else 6, rng.randrange(100))}
        gone = set(rng.sample(sorted(held), 3)) if turn > 1 else set()
        held = {k: r for k, r in held.items() if k not in gone} | new
        keys = spark.createDataFrame([(a, str(i)) for a, i in {*new, *gone}], "account string, message_id string")
        index.update(rows(spark, held.values()), keys) if turn else index.rebuild(rows(spark, held.values()))
        if turn in (1, 4):
            whole = S.build_index(rows(spark, held.values()), False)
            for query in ("w1 w2-w1", "w"):
                phrases = S.parse(query, False, query == "w", False)
                assert found(index.hits(phrases)) == found(S.bm25(whole, phrases))
                assert found(index.search(phrases, 4, None, 1, 0).hits) == best(S.bm25(whole, phrases), 4)
    assert len(index.segments()) <= 3
    ix = index.as_index()
    assert sorted(map(repr, ix.postings.collect())) == sorted(map(repr, whole.postings.collect())) and sorted(map(repr, ix.lengths.collect())) == sorted(map(repr, whole.lengths.collect()))
    assert index.vacuum(1) > 0 and found(index.hits(phrases)) == found(S.bm25(whole, phrases))


def test_a_small_update_writes_a_small_segment(spark, tmp_path):
    given = spark.range(20_000).select(F.lit("a").alias("account"), F.col("id").cast("string").alias("message_id"), F.concat(F.lit("common w"), F.col("id") % 997).alias("subject"), *(F.lit(None).cast("string").alias(c) for c in ("sender", "recipients")), F.concat(F.lit("body v"), F.col("id") % 5003).alias("body"))
    index, path = G.StoredIndex(Store(spark, f"file://{tmp_path}/s"), file_rows=15_000), f"{tmp_path}/s/index"
    index.rebuild(given)
    before = size(path)
    new = given.where("id < 10").withColumn("subject", F.lit("common changed")) if "id" in given.columns else given.limit(10).withColumn("subject", F.lit("common changed"))
    index.update(new, new.select("account", "message_id"))
    assert size(path) - before < before / 20 and len(index.segments()) == 2
    assert index.search(S.parse("changed"), 20).hits.count() == 10 and index.search(S.parse("common"), None).hits.count() == 20_000
    # no file holds more than its share, though every message holds the term, and a rare term's range is one file
    base = index.segments()[0]
    files = [r["n"] for r in spark.read.parquet(f"file://{path}/{base['path']}/directory").collect()]
    assert len(files) >= 5 and max(files) < 3 * 15_000
    assert len(index._files(base, [("common", False)])) > 1 and len(index._files(base, [("v4999", False)])) == 1 and index._files(base, [("zzz", True)]) == []


def test_most_blocks_of_a_common_term_are_not_read(spark, tmp_path):
    """One in a thousand messages says it often; the rest once, in longer texts."""
    text = F.when(F.col("id") % 6000 < 5, F.lit("common common common")).otherwise(F.concat(F.lit("common "), F.repeat(F.lit("filler "), 20)))
    given = spark.range(60_000).select(F.lit("a").alias("account"), F.col("id").cast("string").alias("message_id"), *(F.lit(None).cast("string").alias(c) for c in ("subject", "sender", "recipients")), text.alias("body"))
    index = G.StoredIndex(Store(spark, f"file://{tmp_path}/s"))
    index.rebuild(given)
    done = index.search(S.parse("common", prefix=False), 10, first_blocks=4)
    assert done.hits.count() == 50 and done.blocks >= 115 and done.read <= 20


def test_two_writers_of_an_index(spark, tmp_path):
    """A second writer's segment is kept, and what both bring is there once."""
    store = Store(spark, f"file://{tmp_path}/s")
    index, other = G.StoredIndex(store, stemmed=False), G.StoredIndex(Store(spark, store.path), stemmed=False)
    index.rebuild(rows(spark, [("a", 1, "one", None, None, None), ("a", 2, "two", None, None, None)]))
    create, calls = store._create, []

    def late(name, manifest):
        if not calls:
            calls.append(1)
            new = rows(spark, [("a", 2, "other", None, None, None), ("a", 3, "other", None, None, None)])
            other.update(new, new.select("account", "message_id"))
        return create(name, manifest)

    store._create = late
    new = rows(spark, [("a", 2, "mine", None, None, None)])
    index.update(new, new.select("account", "message_id"))
    hits = lambda q: sorted(r["message_id"] for r in index.hits(S.parse(q, stemmed=False)).collect())
    assert (hits("one"), hits("two"), hits("other"), hits("mine")) == (["1"], [], ["3"], ["2"])


def test_postings_come_in_runs_and_name_no_message(spark, tmp_path, monkeypatch):
    """Rows are dealt in runs of a term, all of them, and only hits are looked up by name."""
    monkeypatch.setattr(S, "LOCATED_ROWS", 50)
    given = rows(spark, texts(random.Random(7), 60)).coalesce(1)
    plain, runs = S.located(given, False).collect(), S.located(given, False, in_runs=True).collect()
    once = lambda r: repr(r.asDict() | {"message_id": None if r["term"] else r["message_id"]})
    assert sorted(map(once, plain)) == sorted(map(repr, (r.asDict() for r in runs)))
    falls = lambda got: sum((a["term"] or "~") > (b["term"] or "~") for a, b in zip(got, got[1:], strict=False))
    assert falls(runs) < falls(plain) / 5
    index = G.StoredIndex(Store(spark, f"file://{tmp_path}/s"), stemmed=False)
    index.rebuild(given)
    assert "message_id" not in spark.read.parquet(index._path(index.segments()[0]["path"], "postings")).columns
    phrases = S.parse("w1 w2-w1", False, False, False)
    assert found(index.hits(phrases)) == found(S.bm25(S.build_index(given, False), phrases))
