"""Shapes of physical plans: no theta joins, top-k without a full sort, pruned scans."""

import re
from pathlib import Path

import pyarrow as pa
import pytest

from epistola import views as V
from epistola.operators import search as S
from epistola.registry import QUERIES

ONE_ROW_CROSS = {"search_bm25", "search_phrase", "search_stemmed", "threads_for_query", "tool_refresh_inbox"}  # the one row of statistics, or of the account that is listed


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ONE_ROW_CROSS - {"graph_communities"}))
def test_no_theta_joins(spark, sf, name):
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan(QUERIES[name](spark, sf)))


def test_top_k(spark, sf):
    for name in ("label_membership", "list_contacts_volume", "catch_up_threads"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, sf))


def test_scans_read_what_they_need(spark, sf):
    text = plan(QUERIES["accounts_union"](spark, sf))
    assert all("value" not in x for x in re.findall(r"ReadSchema: (.*)", text))
    assert "PushedFilters: [IsNotNull(event_type)" in plan(V.table(spark, sf, "events").where("event_type = 'view'").select("event_id"))


def test_no_python_in_relational_queries(spark, sf):
    for name in ("cadence_by_brand", "contact_rollup", "thread_rollup", "engagement_scores", "inbox_reconcile", "deboilerplate", "image_triage", "search_bm25", "search_phrase", "search_stemmed", "catch_up_keywords"):
        assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|MapInArrow", plan(QUERIES[name](spark, sf)))


def counted(df):
    """Regular-expression calls and scans of the optimised plan."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(r"regexp_\w+\(|RLIKE", text)), len(re.findall(r"(?m)Relation \[", text))


def test_expressions_are_not_repeated(spark, sf):
    assert counted(QUERIES["cadence_by_brand"](spark, sf))[0] < 10
    for name in ("contact_rollup", "thread_rollup", "graph_edges", "engagement_scores"):
        assert counted(QUERIES[name](spark, sf))[0] < 25


def written_bytes(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*") if f.is_file())


def test_questions_write_nothing(spark, sf):
    """The mailbox is derived by the first query that needs it; after that queries read its columns and rows, and write nothing before or while they run."""
    names = ("enrich_candidates_profile", "compact_eligible", "catch_up_important", "digest_sources", "list_contacts_volume", "contact_rollup", "search_bm25", "search_phrase")
    for name in names:
        QUERIES[name](spark, sf).count()
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    held = {f.name for f in Path(folder).iterdir()}
    before = written_bytes(folder)
    for name in names:
        text = plan(QUERIES[name](spark, sf))
        QUERIES[name](spark, sf).count()
        if name not in ("contact_rollup", "search_bm25", "search_phrase"):
            assert "events.parquet" not in text, name
    assert written_bytes(folder) == before and {f.name for f in Path(folder).iterdir()} == held


def test_questions_read_the_columns_they_need(spark, sf):
    schemas = re.findall(r"ReadSchema: struct<([^\n]*)>", plan(QUERIES["catch_up_important"](spark, sf)))
    mail = [s for s in schemas if "from_addr" in s]
    assert mail and all("snippet" not in s and "body_text" not in s and "labels" not in s for s in mail)
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(internal_date,", plan(QUERIES["catch_up_important"](spark, sf)))


def test_search_reads_the_terms_it_needs(spark, sf):
    text = plan(QUERIES["search_bm25"](spark, sf))
    assert re.search(r"PushedFilters: \[.*StringStartsWith\(term,thre\)", text) and "positions" not in "".join(re.findall(r"ReadSchema: (.*)", text))


def test_located_batches_are_bounded(monkeypatch):
    """However large the input's batches and texts are, what a task holds at once is bounded; the rows are those of one batch."""
    context = type("Context", (), {"partitionId": lambda self: 3})()
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: context)
    n = 400
    text = pa.array([" ".join(f"w{i * j % 997}" for j in range(150)) for i in range(n)])
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * n), pa.array([str(i) for i in range(n)]), text, pa.array(["x y"] * n), pa.nulls(n, pa.string()), text], names=["account", "message_id", *S.WEIGHTS])
    whole = pa.Table.from_batches(S._located(False)(iter([batch])))
    monkeypatch.setattr(S, "LOCATED_ROWS", 1_000)
    monkeypatch.setattr(S, "LOCATED_PLACES", 5_000)
    parts = list(S._located(False)(iter([batch])))
    assert len(parts) > 20 and max(b.num_rows for b in parts) <= 1_000 + 303 and pa.Table.from_batches(parts).equals(whole)


@pytest.mark.parametrize("name", ["entities", "quoted_printable", "distill_pages"])
def test_texts_go_to_python_in_small_batches(spark, sf, name):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        QUERIES[name](spark, sf)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("name", ["tool_modify_labels", "tool_domains_to_categorize", "tool_refresh_inbox", "tool_list_threads"])
def test_tools_that_look_nothing_up_build_no_index(spark, sf, name, monkeypatch):
    def never(*args, **named):
        raise AssertionError("an index was opened")

    monkeypatch.setattr("epistola.views.stored_index", never)
    assert QUERIES[name](spark, sf).count() > 0


def test_contacts_deal_mail_once(spark, sf):
    """Both windows and the people of received and of sent mail come from one shuffle of messages by thread."""
    from epistola.operators.aggregate import touches

    text = plan(touches(V.messages(spark, sf), V.own_addresses(spark)))
    assert len(re.findall(r"hashpartitioning\(account#\d+, thread#", text)) == 1
