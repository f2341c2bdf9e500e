"""Source mechanisms: pushed filters, a resumable stream, a sink that commits, look-ups by id, payloads of any depth."""

import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from epistola.errors import ConfigError
from epistola.sources import files as R
from epistola.sources import mail as M

DAY = 86_400_000
NOW = 1_781_481_600_000


def put_file(folder, name, ids, sent=(), mode="w", end="\n"):
    rows = [{"id": str(i), "threadId": "t", "internalDate": str(i * 10), "labelIds": ["SENT"] if i in sent else ["INBOX"], "payload": {"mimeType": "text/plain"}} for i in ids]
    with open(Path(folder) / name, mode, encoding="utf-8") as f:
        f.write("\n".join(map(json.dumps, rows)) + end)


def test_filters_are_pushed_and_files_skipped(spark, tmp_path):
    R.register(spark)
    for k in range(5):
        put_file(tmp_path, f"p{k}.jsonl", range(100 * k, 100 * k + 100), sent=range(400, 450))
    folder = f"file://{tmp_path}"
    assert sorted((r["rows"], r["sent"]) for r in R.write_stats(spark, folder).collect()) == [(100, 0)] * 4 + [(100, 50)]
    read = lambda: spark.read.format("mail_jsonl").load(folder)
    ids = lambda df: sorted(int(r["id"]) for r in df.collect())
    files = lambda df: df.rdd.getNumPartitions()
    late, between, sent = read().where("internalDate >= 3500"), read().where("internalDate > 1500 and internalDate < 1530"), read().where("sent")
    assert ids(late) == list(range(350, 500)) and files(late) == 2
    assert ids(between) == [151, 152] and files(between) == 1
    assert ids(sent) == list(range(400, 450)) and files(sent) == 1
    assert ids(read().where("sent and internalDate = 4200")) == [420] and read().where("sent and internalDate < 100").count() == 0
    assert ids(read().where("internalDate >= 3500 and id like '%7'")) == [i for i in range(350, 500) if i % 10 == 7]  # what isn't pushed is left to Spark
    assert files(read()) == 5 and not re.search(r"Filter \(.*internalDate", late._jdf.queryExecution().executedPlan().toString())
    put_file(tmp_path, "p0.jsonl", [1000], mode="a")  # its stats no longer hold
    assert 1000 in ids(read().where("internalDate >= 9000"))


def test_ranges():
    r = R._Range()
    assert r.narrow(R.GreaterThan(("internalDate",), 5)) and r.narrow(R.LessThanOrEqual(("internalDate",), 9)) and not r.narrow(R.EqualTo(("id",), "x"))
    assert [r.has(x, True) for x in (5, 6, 9, 10, None)] == [False, True, True, False, False]
    stats = {"rows": 2, "sent": 2, "low": 10, "high": 20}
    assert not r.may_be_in(stats) and R._Range(20).may_be_in(stats) and not R._Range(sent=False).may_be_in(stats) and not R._Range(1).may_be_in(stats | {"low": None, "high": None})
    both = R._Range(sent=False)
    assert both.narrow(R.EqualTo(("sent",), True)) and not both.has(1, True) and not both.has(1, False)
    with pytest.raises(ConfigError):
        R._Lines({})


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Also within a file, without loss or repeats; half a line waits until it is whole."""
    R.register(spark)
    folder, out, check = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/check"
    folder.mkdir()
    put_file(folder, "a.jsonl", range(5))

    def run():
        stream = spark.readStream.format("mail_jsonl").option("split_bytes", 100).load(f"file://{folder}").select("id")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(once=True).start().awaitTermination()
        return sorted(int(r["id"]) for r in spark.read.parquet(out).collect())

    assert run() == list(range(5))
    put_file(folder, "a.jsonl", range(5, 8), mode="a")
    with open(folder / "a.jsonl", "a", encoding="utf-8") as f:
        f.write('{"id": "8", "threa')
    put_file(folder, "b.jsonl", range(20, 22))
    assert run() == [*range(8), 20, 21] == run()
    with open(folder / "a.jsonl", "a", encoding="utf-8") as f:
        f.write('dId": "t"}\n')
    assert run() == [*range(9), 20, 21]


def test_label_changes_commit_together(spark, tmp_path):
    R.register(spark)
    folder = f"file://{tmp_path}/provider"
    rows = [("a", str(i), ["X", " "], ["INBOX"] if i % 2 else []) for i in range(20)] + [("a", "none", [" "], None)]
    changes = spark.createDataFrame(rows, "account string, message_id string, add array<string>, remove array<string>").repartition(4)
    with pytest.raises(Exception, match="refuses 7"):
        changes.write.format("mail_labels").option("fail_on", "7").mode("append").save(folder)
    there = lambda: sorted(str(p.relative_to(tmp_path / "provider")) for p in (tmp_path / "provider").rglob("*") if p.is_file()) if (tmp_path / "provider").exists() else []
    assert there() == []
    changes.write.format("mail_labels").option("batch", "one").mode("append").save(folder)
    assert there() and all(p.startswith("one.changes/") for p in there())
    got = [json.loads(x) for p in there() for x in (tmp_path / "provider" / p).read_text().splitlines()]
    assert sorted(int(r["message_id"]) for r in got) == list(range(20)) and all(r["add"] == ["X"] for r in got)


def test_look_ups_open_few_files(spark, tmp_path):
    path = f"file://{tmp_path}/keyed"
    rows = spark.range(100_000).select(F.format_string("m%d", "id").alias("id"), F.lit("t").alias("threadId"), (NOW - F.col("id")).alias("internalDate"), F.array(F.when(F.col("id") % 2 == 0, F.lit("SENT")).otherwise(F.lit("INBOX"))).alias("labels"), F.repeat(F.lit("x"), 20).alias("bodyText"))
    full = spark.createDataFrame([], M.FULL).unionByName(rows, allowMissingColumns=True)
    R.KeyedTable.write(full, path, 64)
    source = R.KeyedTable(spark, path, buckets=64)
    ids = spark.createDataFrame([(f"m{i}",) for i in (5, 77, 99_999, 123_456, 77)], "id string")
    found = source.get_full(ids)
    assert sorted(r["id"] for r in found.collect()) == ["m5", "m77", "m99999"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    opened = re.search(r"PartitionFilters: \[bucket#\d+ IN \(([\d,]+)\)", plan)
    assert len(opened[1].split(",")) <= 4 and re.search(r"PushedFilters: \[.*In\(id", plan)
    few = R.KeyedTable(spark, path, buckets=64, few=2)
    assert sorted(r["id"] for r in few.get_metadata(ids).collect()) == ["m5", "m77", "m99999"] and "bodyText" not in few.get_metadata(ids).columns
    assert source.list_ids(M.Scope(limit=3, include_sent=False)).collect() == [("m1",), ("m3",), ("m5",)]


def test_since(spark):
    rows = spark.createDataFrame([], M.FULL).unionByName(spark.createDataFrame([(str(d), NOW - d * DAY, []) for d in (0, 1, 2, 40, 400)], "id string, internalDate bigint, labels array<string>"), allowMissingColumns=True)
    source = M.TableSource(rows, now_ms=NOW)
    ids = lambda since: [r["id"] for r in source.list_ids(M.Scope(since=since)).collect()]
    assert (ids("1d"), ids("36h"), ids("1w"), ids("2mo"), ids("2m"), ids("2y")) == (["0", "1"], ["0", "1"], ["0", "1", "2"], ["0", "1", "2", "40"], ["0", "1", "2", "40"], ["0", "1", "2", "40", "400"])
    assert M.since_ms("2026-06-14", NOW) == NOW - DAY and M.since_ms("2026-06-14T00:00:00Z", NOW) == NOW - DAY
    with pytest.raises(ConfigError):
        source.list_ids(M.Scope(since="soon"))


@pytest.mark.parametrize("depth", [10, 4_998, 4_999, 30_000])
def test_payloads_nested_without_a_bound(depth):
    inner = '{"mimeType":"text/plain","body":{"data":"ZGVlcA"}}'
    text = '{"headers":[{"name":"From","value":"a \\"b\\" {c}, [d]: 1"}],"n":-1.5e3,"t":true,"x":null,"e":{},"l":[],"parts":[' + '{"mimeType":"multipart/mixed","parts":[' * depth + inner + "]}" * depth + "]}"
    got = M.first_parts(text)
    assert got == {"plain": "ZGVlcA", "html": None, "headers": [{"name": "From", "value": 'a "b" {c}, [d]: 1'}]}


def test_odd_payloads():
    none = {"plain": None, "html": None, "headers": None}
    for odd in ('{"body": ["x"]}', '{"parts": {"a": 1}, "body": 3}', "[]", "3", '"x"', "{", "", None, '{"mimeType": 5, "parts": [1, null, "x"]}', "[" * 9_000, "[" * 9_000 + "}" * 9_000, '{"headers": {"From": 1}}'):
        assert M.first_parts(odd) == none, odd
    assert M.first_parts('{"headers": [{"name": "A", "value": 3}, 7], "mimeType": "text/html", "body": {"data": "x"}}') == {"plain": None, "html": "x", "headers": [{"name": "A", "value": "3"}]}
