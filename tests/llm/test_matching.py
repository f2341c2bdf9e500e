import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from epistola.llm import decontam, linededup, ngramjoin, wordhash
from epistola.llm.components import connected_components
from epistola.llm.cuckoo import CuckooFilter
from epistola.llm.runtime import join_spread, materialize

from .helpers import BLANK, FOLD, awkward, docs, empty, near_groups, shingle_set, words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_word_hashes_follow_words(texts):
    seen = {}
    runs = list(wordhash.hash_words(texts, span=30))
    hashes = [run.hashes[a:b].tolist() for run in runs for a, b in zip(run.offsets[:-1], run.offsets[1:], strict=True)]
    assert len(hashes) == len(texts)
    for text, hs in zip(texts, hashes, strict=True):
        assert len(hs) == len(words(text)) and [w.decode() for w in wordhash.words(text)] == words(text)
        for w, h in zip(words(text), hs, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_shingles_by_hand():
    run = next(wordhash.hash_words(["a b c d e f", "a b", "", "b c d e f", "A, b"]))
    s, offsets = wordhash.shingles(run, 5)
    assert np.diff(offsets).tolist() == [2, 1, 0, 1, 1] and s[1] == s[3] and s[2] == s[4] and s[0] != s[1]
    assert run.heads(3).tolist() == run.hashes.tolist()


def variants(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    out = []
    for size in (4, 12, 60, 200):
        base = [word() for _ in range(size)]
        out += [" ".join(base), " ".join(base).upper() + "!", " ".join(base)]
        for change in (1, 2, 5, 20):
            x = list(base)
            for _ in range(change):
                x[rng.randrange(size)] = word()
            out.append(" ".join(x))
    return [*out, "", "...", " ".join(word() for _ in range(80))]


#: all in one block; many blocks; without the list of candidates; pairs of blocks dealt over tasks
SETTINGS = [{}, {"block_shingles": 120}, {"block_shingles": 120, "held_bytes": 0, "paired_blocks": 1}]


@pytest.mark.parametrize("options", SETTINGS)
def test_ngram_join_like_brute_force(spark, options):
    texts = variants()
    links, groups = near_groups(texts)
    got = {r["doc_id"]: r for r in ngramjoin.ngram_join(docs(spark, *texts), **options).collect()}
    assert [got[i]["n_links"] for i in range(len(texts))] == links and [got[i]["class_id"] for i in range(len(texts))] == groups


def test_ngram_join_large_group(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base[:k] + [f"x{rng.randrange(10**9)}"] + base[k + 1 :]) for k in [rng.randrange(150) for _ in range(300)]] + [" ".join(base)] * 50
    links, groups = near_groups(texts)
    got = {r["doc_id"]: r for r in ngramjoin.ngram_join(docs(spark, *texts), block_shingles=5000, paired_blocks=2).collect()}
    assert [got[i]["n_links"] for i in range(len(texts))] == links and {r["class_id"] for r in got.values()} == set(groups)


@pytest.mark.parametrize("options", [SETTINGS[0], SETTINGS[2]])
def test_ngram_join_by_row(spark, options):
    """Repeated ids with other texts, and null ids: every row has the links of its own text, and one row of a group stays."""
    rng = random.Random(8)
    a, b = ([f"{x}{rng.randrange(1000)}" for _ in range(60)] for x in "ab")
    a2, b2 = [*a[:-1], "other"], [*b[:-1], "other"]
    texts = [(5, a), (5, b), (6, a2), (7, b2), (None, a), (None, b2), (3, b), (None, ["lone"]), (None, ["lone"]), (9, []), (9, [])]
    rows = [(i, " ".join(t)) for i, t in texts]
    links, groups = near_groups([t for _, t in rows])
    smallest = {g: min((rows[k][0] for k in range(len(rows)) if groups[k] == g and rows[k][0] is not None), default=None) for g in set(groups)}
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, row int, _row string")
    got = ngramjoin.ngram_join(df, **options).collect()
    assert sorted((repr(r["doc_id"]), repr(r["class_id"]), r["n_links"]) for r in got) == sorted((repr(r[0]), repr(smallest[g]), n) for r, g, n in zip(rows, groups, links, strict=True))
    kept = ngramjoin.drop_near_copies(df, **options)
    assert kept.columns == df.columns
    best = {g: min((k for k in range(len(rows)) if groups[k] == g), key=lambda k: (rows[k][0] is None, rows[k][0], k)) for g in set(groups)}
    assert sorted(repr((r["doc_id"], r["text"])) for r in kept.collect()) == sorted(repr(rows[k]) for k in best.values())


def test_ngram_join_recall_near_the_threshold(spark):
    """Planted pairs by their true similarity: all of at least 0.8 are found, and none below."""
    rng = random.Random(12)
    texts = []
    for i in range(250):
        base = [f"t{i}w{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 300))]
        other = list(base)
        for _ in range(max(1, int(len(base) * rng.uniform(0.01, 0.045)))):
            other[rng.randrange(len(base))] = f"n{rng.randrange(10**6)}"
        texts += [" ".join(base), " ".join(other)]
    true = []
    for k in range(0, len(texts), 2):
        x, y = shingle_set(texts[k]), shingle_set(texts[k + 1])
        true.append(len(x & y) / len(x | y))
    assert sum(0.8 <= t < 0.85 for t in true) > 20 and sum(0.75 <= t < 0.8 for t in true) > 10
    got = {r["doc_id"]: r["n_links"] for r in ngramjoin.ngram_join(docs(spark, *texts)).collect()}
    assert [got[2 * k] for k in range(len(true))] == [int(t >= 0.8) for t in true]


def test_block_pairs_of_one_hot_key(spark):
    """A key of 2,000 blocks: all pairs, dealt over tasks, none twice."""
    bucket = spark.range(2000).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("block")).union(spark.range(3).select(F.lit(2).cast("long"), F.col("id")))
    pairs = ngramjoin._block_pairs(bucket, 100)
    assert pairs.count() == 2000 * 1999 // 2 == pairs.where("x < y").count()


def test_join_spread(spark):
    left = materialize(spark.range(30_000).select((F.col("id") % 7 * (F.col("id") % 3 == 0).cast("long")).alias("k"), "id"), "left")
    right = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plain = left.join(right, ["k"])
    for hot in (1_000, 100_000):
        assert sorted(map(tuple, join_spread(left, right, ["k"], hot).collect())) == sorted(map(tuple, plain.select("k", "id", "v").collect()))


def test_ngram_join_awkward(spark):
    rows = ngramjoin.ngram_join(awkward(spark)).collect()
    assert len(rows) == 10
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["n_links"] for r in by[4]] == [2, 2] and by[5][0]["class_id"] == 4 and by[0][0]["n_links"] == 0 and by[1][0]["class_id"] == 1
    assert ngramjoin.ngram_join(empty(awkward(spark))).count() == 0
    kept = ngramjoin.drop_near_copies(awkward(spark))
    assert kept.columns == awkward(spark).columns and kept.count() == 8


def test_bands_reach_their_recall():
    bands, rows = ngramjoin.choose_bands(0.8, 0.9998)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9998 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == got[101] == got[100] == 100
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- line dedup


def brute_lines(texts, least=10):
    key = lambda x: x.strip(BLANK).translate(FOLD)
    count = {}
    for t in texts:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    return ["\n".join(x for x in (t or "").split("\n") if not key(x) or count[key(x)] < least) for t in texts]


def some_lines(n=60):
    rng = random.Random(5)
    return ["\n".join(rng.choice(["Common line", " common LINE\t", "often", "rare %d" % rng.randrange(40), "", "x" * 50]) for _ in range(rng.randrange(1, 9))) for _ in range(n)] + [None, ""]


@pytest.mark.parametrize("held_bytes", [1 << 20, 2_000, 0])
def test_line_dedup_like_brute_force(spark, held_bytes):
    texts = some_lines()
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs(spark, *texts), held_bytes=held_bytes).collect()}
    assert [got[i]["text"] for i in range(len(texts))] == brute_lines(texts)
    assert [got[i]["n_lines"] - got[i]["n_dropped"] for i in range(len(texts))] == [len(b.split("\n")) if b or (t or "").split("\n").count("") else 0 for t, b in zip(texts, brute_lines(texts), strict=True)]


def holds_frequent(store):
    held = {r["shard"]: CuckooFilter.from_bytes(bytes(r["filter"])) for r in store.filters().collect()}
    for r in store.frequent().collect():
        assert held[r["h1"] % store.shards].contains(np.array([r["h1"]]).view(np.uint64))[0]


def test_line_store_opens_again(spark, tmp_path):
    """Insert, open again, insert, open again, delete: counts as if at once; old versions go; a change that failed is overwritten."""
    texts, more = some_lines(), some_lines(90)[60:]
    path = f"file://{tmp_path}/store"
    linededup.LineStore(spark, path, shards=2, min_docs=5).insert(docs(spark, *texts))
    again = linededup.LineStore(spark, path)
    assert (again.version, again.shards, again.min_docs) == (1, 2, 5) and again.refs().count() > 0
    before = sorted(map(tuple, again.refs().collect()))
    (tmp_path / "store" / "changed-2").mkdir()
    (tmp_path / "store" / "changed-2" / "left").write_text("by a change that failed")
    again.insert(docs(spark, *more))
    third = linededup.LineStore(spark, path, keys_per_shard=1)
    at_once = linededup.LineStore(spark, min_docs=5).insert(docs(spark, *texts, *more))
    assert third.version == 2 and sorted(map(tuple, third.refs().collect())) == sorted(map(tuple, at_once.refs().collect()))
    assert [r["text"] for r in third.apply(docs(spark, *texts)).orderBy("doc_id").collect()] == brute_lines([*texts, *more], 5)[: len(texts)]
    third.delete(docs(spark, *more))
    assert third.shards > 2 and sorted(map(tuple, third.refs().collect())) == before
    holds_frequent(third)
    last = linededup.LineStore(spark, path)
    assert (last.version, last.shards) == (3, third.shards) and [r["text"] for r in last.apply(docs(spark, *texts)).orderBy("doc_id").collect()] == brute_lines(texts, 5)
    assert sorted(p.name for p in (tmp_path / "store").iterdir() if not p.name.startswith(".")) == [f"{k}-{v}" for k in ("commit", "filters", "refs") for v in (2, 3)]


def test_line_store_is_reversible(spark):
    a, b = docs(spark, *some_lines()), docs(spark, *some_lines(90)[60:])
    store = linededup.LineStore(spark, shards=3).insert(a)
    before = sorted(map(tuple, store.refs().collect()))
    hot = lambda s: {r["h1"] for r in s.frequent().collect()}
    first = hot(store)
    store.insert(b)
    assert hot(store) >= first and store.refs().agg({"n": "sum"}).first()[0] > sum(r[2] for r in before)
    store.delete(b)
    assert sorted(map(tuple, store.refs().collect())) == before and hot(store) == first
    with pytest.raises(ValueError):
        store.delete(docs(spark, "never held"))
    assert sorted(map(tuple, store.refs().collect())) == before
    holds_frequent(store)
    store.delete(a)
    assert store.refs().count() == 0 and sum(int((f.table > 0).sum()) for f in (CuckooFilter.from_bytes(bytes(r["filter"])) for r in store.filters().collect())) == 0


def spread_from(monkeypatch, module, rows):
    """The module's joins treat keys of more than ``rows`` rows as hot; gives how often one was."""
    seen = []

    def spread(left, right, on):
        seen.append(left.groupBy(*on).count().where(F.col("count") > rows).count())
        return join_spread(left, right, on, rows)

    monkeypatch.setattr(module, "join_spread", spread)
    return seen


def test_line_dedup_with_a_line_in_every_document(spark, monkeypatch):
    texts = [f"own {i}\nin all of them\n\n{'twice' if i % 500 == 0 else i}" for i in range(3000)]
    held = linededup.dedup_lines(docs(spark, *texts), min_docs=2)
    seen = spread_from(monkeypatch, linededup, 1000)
    joined = linededup.dedup_lines(docs(spark, *texts), min_docs=2, held_bytes=0)
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, held.collect())) and max(seen) >= 1
    assert joined.where("text like '%in all of them%'").count() == 0


def test_decontamination_with_a_pair_in_every_document(spark, monkeypatch):
    item = " ".join(f"rare{i}" for i in range(10))
    texts = [f"{i} {item} {i}" if i % 10 == 0 else f"rare0 rare1 rare2 {i} rare4 rare5 rare6" for i in range(2000)]
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    held = judged(decontam.find_contamination(docs(spark, *texts), bench).collect())
    seen = spread_from(monkeypatch, decontam, 100)
    assert judged(decontam.find_contamination(docs(spark, *texts), bench, held_windows=0, hot_places=50).collect()) == held and max(seen) >= 1


def test_line_dedup_awkward(spark):
    df = awkward(spark).withColumns({"row": F.lit("r"), "_row": F.lit(1), "gone": F.lit(2), "lines": F.lit("l"), "h1": F.lit(0)})
    joined = linededup.dedup_lines(df, min_docs=2, added=("_a", "_b"), held_bytes=0)
    out = linededup.dedup_lines(df, min_docs=2, added=("_a", "_b"))
    assert joined.columns == out.columns and sorted(map(repr, joined.collect())) == sorted(map(repr, out.collect()))
    got = [(r["doc_id"], r["text"], r["_a"], r["_b"]) for r in out.collect()]
    assert out.columns == [*df.columns, "_a", "_b"] and len(got) == 10
    assert (0, "", 1, 0) in got and (1, "", 1, 0) in got and got.count((4, "", 1, 1)) == 2 and (7, "a\n\na\nb\r\nB \n", 6, 0) in got
    assert "n_lines" in linededup.dedup_lines(df).columns and linededup.dedup_lines(empty(df)).count() == 0


def test_cuckoo_filter():
    keys = np.arange(1, 5001, dtype=np.uint64) * np.uint64(2654435761)
    f = CuckooFilter.of(keys)
    assert f.contains(keys).all() and f.contains(keys + np.uint64(1)).mean() < 0.01
    g = CuckooFilter.from_bytes(f.to_bytes())
    assert g.delete(keys[:2500]) == 2500 and g.contains(keys[2500:]).all() and g.contains(keys[:2500]).mean() < 0.01
    twice = CuckooFilter(64)
    assert twice.insert(np.array([7, 7, 7], np.uint64)) and twice.delete(np.array([7, 7], np.uint64)) == 2 and twice.contains(np.array([7], np.uint64))[0]
    assert twice.delete(np.array([7, 7], np.uint64)) == 1 and not twice.table.any()
    small = CuckooFilter(4)
    assert not small.insert(keys[:100])


# -- decontamination


def brute_hits(text, items, size=10):
    w = words(text)
    hit, found = set(), set()
    for i, item in items:
        v = words(item)
        for window in {tuple(v[k : k + size]) for k in range(max(1, len(v) - size + 1))} if v else ():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def contaminated(spark):
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.5 else f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 9, 10, 11, 30, 30, 1])] + [(9, None), (10, "?!"), (2, "the of and the of and the of and the of and")]
    texts = [" ".join(word() for _ in range(rng.randrange(80))) for _ in range(30)]
    for i, t in items:
        if t:
            texts += [f"before {t} after {t.upper()}", " ".join(t.split()[2:]), "\n".join(t.split()[: 12])]
    return texts + [None, ""], items


#: held by the workers; joined; joined with hot pairs of words dealt over tasks and without the list of rarest words
WAYS = [{}, {"held_windows": 0}, {"held_windows": 0, "held_words": 0, "hot_places": 2}]


def judged(rows):
    """Results by text, so that repeated and null ids can be told apart."""
    return sorted((repr(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows)


@pytest.mark.parametrize("options", WAYS)
def test_decontamination_like_brute_force(spark, options):
    texts, items = contaminated(spark)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontam.find_contamination(docs(spark, *texts), bench, **options).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute_hits(t, items), t
        assert sum(s["end"] - s["first"] for s in r["spans"]) == r["n_hit"]
    kept = {r["doc_id"] for r in decontam.drop_contaminated(docs(spark, *texts), bench, **options).collect()}
    assert kept == {i for i, t in enumerate(texts) if not brute_hits(t, items)[-1]}


@pytest.mark.parametrize("options", WAYS)
def test_decontamination_by_row(spark, options):
    """Repeated and null ids: each row has its own result, whichever way the index goes."""
    item = " ".join(f"b{i}" for i in range(12))
    rows = [(1, f"x {item} y"), (1, "all clean here"), (None, item), (None, "clean"), (None, None), (2, ""), (1, f"x {item} y"), (3, item[:-3]), (3, " ".join(item.split()[1:5]))]
    bench = [(None, item), (7, "one two"), (7, item + " more")]
    df = spark.createDataFrame([(*r, "keep", 1) for r in rows], "doc_id bigint, text string, row string, _row int")
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    named = [("" if i is None else i, t) for i, t in bench]
    assert judged(decontam.find_contamination(df, b, **options).collect()) == sorted((repr(i), *brute_hits(t, named)) for i, t in rows)
    kept = decontam.drop_contaminated(df, b, **options)
    assert kept.columns == df.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, df.where("text is null or text not like '%b0 %' and text not like 'b0 %'").collect()))


@pytest.mark.parametrize("options", [WAYS[0], WAYS[2]])
def test_decontamination_awkward(spark, options):
    df, items = awkward(spark), [(1, "one two three"), ("", "word1 and 1")]
    bench = spark.createDataFrame([(i or None, t) for i, t in items], "item_id bigint, text string")
    texts = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert judged(decontam.find_contamination(df, bench, **options).collect()) == sorted((repr(i), *brute_hits(t, items)) for i, t in texts)
    assert decontam.find_contamination(df, empty(bench), **options).where("contaminated").count() == 0
    assert decontam.find_contamination(empty(df), bench, **options).count() == 0
    out = decontam.drop_contaminated(df, bench, **options)
    assert out.columns == df.columns and out.count() == sum(not brute_hits(t, items)[-1] for _, t in texts)


def test_window_index_is_small():
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(400)]
    runs = list(wordhash.hash_words(texts))
    hashes = [r.hashes[a:b] for r in runs for a, b in zip(r.offsets[:-1], r.offsets[1:], strict=True)]
    index = decontam.build_index([str(i) for i in range(400)], hashes)
    assert len(index.rare) == 400 * 51 and index.nbytes() < 50 * len(index.rare)
