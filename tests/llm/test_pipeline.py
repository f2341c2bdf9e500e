"""Stages of the pipeline against brute force, on documents with planted cases."""

import shutil
import weakref

import duckdb
import pytest
from pyspark.sql import functions as F

from epistola.llm import decontam, packing, toxicity
from epistola.llm.queries import ORACLE_SQL, QUERIES
from epistola.llm.runtime import materialize

from .helpers import awkward, empty, near_groups
from .test_matching import brute_hits, brute_lines

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf), name)
        out.append((name, before.toPandas(), docs.toPandas()))
    return {name: (b, a) for name, b, a in out}


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]


def test_toxic_documents_go(spark, sf, stages):
    before, after = stages["toxicity"]
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.score(docs, *toxicity.train(toxicity._inputs(docs), labels)).toPandas()
    assert set(after.doc_id) == set(scored[~scored.toxic].doc_id) and list(after.columns) == list(before.columns)


def test_lines_go(stages):
    before, after = stages["line_dedup"]
    after = after.set_index("doc_id")
    assert list(after.loc[before.doc_id].text) == brute_lines(list(before.text)) and (after.n_chars == after.text.str.len()).all()


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    before = before.sort_values("doc_id")
    _, groups = near_groups(list(before.text))
    assert sorted(after.doc_id) == sorted({list(before.doc_id)[g] for g in groups})


def test_contaminated_documents_go(sf, stages):
    before, after = stages["decontamination"]
    items = duckdb.connect().execute(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    assert set(after.doc_id) == {i for i, t in zip(before.doc_id, before.text, strict=True) if not brute_hits(t, items)[-1]}


def test_everything_left_is_packed(stages):
    before, after = stages["packing"]
    assert set(after.doc_id) == set(before.doc_id) and (after.groupby("doc_id").length.sum() == after.groupby("doc_id").doc_tokens.first()).all()


def test_awkward_documents_pass_every_stage(spark, sf, tmp_path):
    for kind in ("awkward", "empty"):
        d = tmp_path / kind
        d.mkdir()
        for t in ("labels", "benchmark"):
            shutil.copy(f"{sf}/{t}.parquet", d / f"{t}.parquet")
        docs = awkward(spark).withColumns({c: F.lit(c) for c in ("lines", "lines_dropped", "row", "_lines_before")})
        docs = docs if kind == "awkward" else empty(docs)
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = materialize(stage(spark, docs, str(d)), name)
            assert name == "packing" or docs.columns == columns
        assert (docs.count() > 0) == (kind == "awkward")
    assert decontam.WINDOW == 10


def test_run_gives_the_last_stage(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert set(zip(got.doc_id, got.start, got.ids_crc32, strict=True)) == set(zip(*(stages["packing"][1][c] for c in ("doc_id", "start", "ids_crc32")), strict=True))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_duckdb(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    found = con.execute(ORACLE_SQL[name])
    theirs = [x[0] for x in found.description]
    assert sorted(theirs) == sorted(df.columns)
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert plain(tuple(r[theirs.index(c)] for c in df.columns) for r in found.fetchall()) == plain(map(tuple, df.collect()))


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "near_duplicates", "decontamination"])
def test_stages_drop_what_packing_left_in_the_workers(spark, sf, monkeypatch, name):
    """A worker serves all stages: one that packed documents before must not hold its tokenizer and chunks during the others."""
    frame = type(spark.range(0))
    plain, met = frame.mapInArrow, []

    def spied(self, f, *args, **options):
        def run(batches):
            from epistola.llm import packing

            class Light:
                def __init__(self, *_):
                    pass

            own, packing.ChunkTokenizer = packing.ChunkTokenizer, Light
            try:
                left = weakref.ref(packing.tokenizer("a tokenizer"))
            finally:
                packing.ChunkTokenizer = own
            yield from f(batches)
            assert left() is None, "held beside the stage's own data"

        met.append(f)
        return plain(self, run, *args, **options)

    monkeypatch.setattr(frame, "mapInArrow", spied)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(300)
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    materialize(dict(corpus_pipeline.STAGES)[name](spark, docs, sf), name)
    assert met


def test_fewer_remembered_chunks_give_the_same_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    few, all_ = (sorted(map(tuple, packing.pack_documents(docs, remembered=n, with_ids=True).collect())) for n in (50, None))
    assert few == all_ and few
