"""The body ladder as a stateful stream gives what the batch upsert gives, whatever comes in which order."""

import random

import pytest
from pyspark.sql import functions as F

from epistola.operators.merge import upsert_messages
from epistola.schemas import MESSAGES
from epistola.streaming import ladder as L
from epistola.streaming.store import Store

DAY = 86_400_000


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def arriving(spark, rows):
    """rows: (message_id, subject, labels, body_state, body_text, arrival, summarized_at, at in days)."""
    given = [("a", i, s, labels, state, text, n, when, at * DAY) for i, s, labels, state, text, n, when, at in rows]
    df = spark.createDataFrame(given, "account string, message_id string, subject string, labels array<string>, body_state string, body_text string, arrival bigint, summarized_at bigint, at_ms bigint")
    df = spark.createDataFrame([], MESSAGES).unionByName(df, allowMissingColumns=True)
    return df.withColumn("at", F.timestamp_millis("at_ms")).drop("at_ms")


def run(spark, folder, out, check, schema, late="30 days"):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    L.into_store(L.ladder(stream, late=late), Store(spark, out), check).awaitTermination()


def test_ladder_equals_the_batch_upsert(spark, tmp_path, rocksdb):
    rng = random.Random(4)
    rows = [(str(rng.randrange(12)), f"s{n}", rng.choice([[], ["INBOX", "X"]]), rng.choice(("meta", "full", "summary-only")), f"b{n}", n, None, 1) for n in range(60)]
    expected = upsert_messages(spark.createDataFrame([], MESSAGES), arriving(spark, rows).drop("summarized_at", "at"))
    shuffled = [*rows, *rng.sample(rows, 20)]
    rng.shuffle(shuffled)
    folder, out = f"{tmp_path}/in", f"file://{tmp_path}/store"
    for k in range(0, len(shuffled), 27):
        arriving(spark, shuffled[k : k + 27]).coalesce(1).write.mode("append").parquet(folder)
    schema = arriving(spark, []).schema
    run(spark, folder, out, f"{tmp_path}/check", schema)
    names = [f.split()[0] for f in MESSAGES.split(", ")]
    got = lambda: sorted(map(repr, Store(spark, out).read("messages", MESSAGES).select(*names).collect()))
    assert got() == sorted(map(repr, expected.select(*names).collect()))
    version = Store(spark, out).version("messages")
    run(spark, folder, out, f"{tmp_path}/check", schema)  # nothing new
    assert Store(spark, out).version("messages") == version
    arriving(spark, rows[:10]).coalesce(1).write.mode("append").parquet(folder)  # what came before comes again
    run(spark, folder, out, f"{tmp_path}/check", schema)
    assert got() == sorted(map(repr, expected.select(*names).collect()))


def test_bodies_go_after_the_grace_period(spark, tmp_path, rocksdb):
    folder, out, schema = f"{tmp_path}/in", f"file://{tmp_path}/store", arriving(spark, []).schema
    put = lambda *rows: arriving(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    states = lambda: {r["message_id"]: (r["body_state"], r["body_text"]) for r in Store(spark, out).read("messages", MESSAGES).collect()}
    put(("1", "s", [], "full", "body", 1, 2 * DAY, 2), ("2", "s", [], "full", "kept", 1, None, 2), ("3", "s", [], "meta", None, 1, 2 * DAY, 2))
    run(spark, folder, out, f"{tmp_path}/check", schema, "0 seconds")
    assert states() == {"1": ("full", "body"), "2": ("full", "kept"), "3": ("meta", None)}
    put(("4", "s", [], "meta", None, 1, None, 8))
    run(spark, folder, out, f"{tmp_path}/check", schema, "0 seconds")
    assert states()["1"] == ("full", "body")  # six days
    put(("5", "s", [], "meta", None, 1, None, 10))
    run(spark, folder, out, f"{tmp_path}/check", schema, "0 seconds")
    assert states()["1"] == ("summary-only", None) and states()["2"] == ("full", "kept") and states()["3"] == ("meta", None)
    put(("1", "new subject", [], "full", "again", 2, None, 11))
    run(spark, folder, out, f"{tmp_path}/check", schema, "0 seconds")
    row = Store(spark, out).read("messages", MESSAGES).where("message_id = '1'").first()
    assert (row["body_state"], row["body_text"], row["subject"]) == ("summary-only", None, "new subject")
