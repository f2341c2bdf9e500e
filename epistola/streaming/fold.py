"""Contacts and threads kept up to date by what a commit touched.

Mail folds by thread: who replied, who initiated and what a thread looks like depend on its own messages only; mail without a thread folds by itself. So each thread's part
of each contact is kept (counts, first and last times, the earliest name), and a contact is the sum of its parts. After new versions of the message store, ``fold`` takes the change feed, finds the threads that any
change was or is in, folds those threads anew from the touched accounts' messages, replaces their parts, and sums the contacts that had or have a part in one of them. The result is what a
rebuild from all messages gives; what is shuffled and written follows the touched threads and contacts.

Three tables of the store, in parts by account: ``thread_rows``, ``contact_parts`` and ``contact_rows``. A thread's or contact's rows of the latest arrival hold; a row without values says that there are none any more.
Each records in its manifest's version log only whole folds: ``folded`` holds the message version that they show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.aggregate import combine_contacts, contact_parts, thread_rollup
from ..operators.merge import KEY
from ..schemas import CONTACTS, IDENTITY, MESSAGES
from ..scratch import drop, written
from .store import MERGES, Store

THREADS = "subject string, participants array<string>, msg_count bigint, unread_count bigint, user_participated boolean, any_list boolean, first_at bigint, last_at bigint"
THREAD_ROWS = f"account string, thread_id string, {THREADS}"
_ORDER = "struct<dated:boolean,internal_date:bigint,message_id:string,pos:int>"
CONTACT_PARTS = (
    f"account string, fold string, address string, name string, named {_ORDER}, domain string, msgs_received bigint, msgs_sent bigint, read_count bigint, replied_count bigint, initiated_count bigint, "
    "starred_count bigint, important_count bigint, first_seen bigint, last_seen bigint"
)
FOLDED = "version bigint"
#: What a fold depends on: other columns may change without one.
MAIL = ", ".join(c for c in MESSAGES.split(", ") if c.split()[0] in {"account", "message_id", "thread_id", "internal_date", "from_addr", "to_addr", "cc_addr", "subject", "is_list", "direction", "unread", "starred", "important", "body_state"})


def _latest(key: list[str]):
    """The rows of each key's latest arrival."""

    def reduce(rows: DataFrame) -> DataFrame:
        last = F.max("arrival").over(Window.partitionBy(*key))
        return rows.withColumn("_last", last).where("arrival = _last").drop("_last", "arrival")

    return reduce


MERGES |= {"thread_rows": _latest(["account", "thread_id"]), "contact_parts": _latest(["account", "fold"]), "contact_rows": _latest(["account", "address"])}


def fold_key(thread: Column, message: Column) -> Column:
    """The thread, or the message where it has none."""
    return F.when(F.coalesce(thread, F.lit("")) != "", F.concat(F.lit("t:"), thread)).otherwise(F.concat(F.lit("m:"), message))


def threads(store: Store) -> DataFrame:
    return store.read("thread_rows", THREAD_ROWS).where("msg_count is not null")


def contacts(store: Store) -> DataFrame:
    return store.read("contact_rows", CONTACTS).where("msgs_received is not null")


def folded_version(store: Store) -> int:
    row = store.read("folded", FOLDED).agg(F.max("version")).first()
    return row[0] or 0


def fold(store: Store) -> dict[str, int]:
    """Brings threads and contacts up to the store's last version: the folds touched and the contacts summed."""
    since, until = folded_version(store), store.version("messages")
    if since == until:
        return {"folds": 0, "contacts": 0}
    came, known = store.came(MAIL, since, until)
    each = (came if known is None else came.join(known, KEY, "left_anti")).select("account", fold_key(F.col("thread_id"), F.col("message_id")).alias("fold"))
    if known is not None:
        changes = store.changes("messages", MAIL, since, until, known)
        each = each.unionByName(changes.select("account", F.explode(F.array(*(F.when(F.col(s).isNotNull(), fold_key(F.col(f"{s}.thread_id"), F.col("message_id"))) for s in ("before", "after")))).alias("fold")))
    touched = written(each.where("fold is not null").distinct(), "touched")
    counted = {r["account"]: r["n"] for r in touched.groupBy("account").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = set(counted)
    if not of:
        store.write("folded", store.spark.createDataFrame([(until,)], FOLDED))
        return {"folds": 0, "contacts": 0}
    mail = store.messages(MAIL, until, of).withColumn("fold", fold_key(F.col("thread_id"), F.col("message_id")))
    if store.manifest("messages", since)["parts"]:  # else all mail is touched
        mail = mail.join(touched, ["account", "fold"], "left_semi")
    mail = written(mail, "touched-mail")
    own = store.read("account_identity", IDENTITY).select("account", "address")

    # a touched thread that is gone keeps a row without values
    keys = touched.where("fold like 't:%'").select("account", F.substring("fold", 3, 1 << 30).alias("thread_id"))
    store.put("thread_rows", keys.join(thread_rollup(mail.drop("fold")), ["account", "thread_id"], "left").select(*_names(THREAD_ROWS)))

    new = written(touched.join(contact_parts(mail, own), ["account", "fold"], "left").select(*_names(CONTACT_PARTS)), "parts")
    old = store.read("contact_parts", CONTACT_PARTS, accounts=of).join(touched, ["account", "fold"], "left_semi")
    people = written(old.select("account", "address").unionByName(new.select("account", "address")).where("address is not null").distinct(), "people")
    store.put("contact_parts", new)
    parts = store.read("contact_parts", CONTACT_PARTS, accounts=of).where("address is not null").join(people, ["account", "address"], "left_semi")
    store.put("contact_rows", people.join(combine_contacts(parts), ["account", "address"], "left").select(*_names(CONTACTS)))
    store.write("folded", store.spark.createDataFrame([(until,)], FOLDED))
    n = people.count()
    for t in (touched, mail, new, people):
        drop(t)
    return {"folds": sum(counted.values()), "contacts": n}


def _names(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].split()[0])
            start = i + 1
    return out
