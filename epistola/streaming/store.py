"""The engine's tables in versions, under one folder that all executors share.

A version is a manifest: a small file that names the Parquet folders ("parts") a table is made of. A writer puts its rows into folders of its own first and then creates the
manifest of the next version, which only one writer can do; who comes second looks at the new version and tries again. So nothing is locked, nothing has to be held or renewed, a driver that dies leaves
at most a folder that no manifest names, and readers see whole versions only.

There are two kinds of change. ``update`` and ``write`` give a whole new table, for small ones such as runs and curation. ``put`` adds parts that hold rows of some keys only, one part an account,
for tables in ``MERGES``: readers reduce the parts of an account by key, and ``compact`` does so for good once there are many. A put costs what its rows cost, whatever the table holds, and puts of several drivers follow one another.

Each manifest names the parts that it added, so ``changes`` gives the keys that came or changed between two versions, with what they were and are, from those parts and the touched accounts alone. Versions that
``vacuum`` has dropped can't be read or compared any more.
"""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StoreError
from ..operators.merge import KEY, reduce_arrivals
from ..schemas import SCHEMA_VERSION, body_rank
from ..scratch import FEW_ROWS, few, written

#: Parts of an account from which they are merged for good; how often a commit is tried; versions of a whole-table kind that stay.
MOST_PARTS, TRIES, KEPT_VERSIONS = 8, 200, 20

_KEYS = "account string, message_id string"

#: How the parts of a table are reduced: rows with their ``arrival`` to one row a key.
MERGES: dict[str, Callable[[DataFrame], DataFrame]] = {"messages": reduce_arrivals}


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """A file that is complete when it appears; False where it is there already. Links do that on a local disk, a rename that never replaces elsewhere."""
    jvm = spark.sparkContext._jvm
    url = urlparse(path)
    if url.scheme in ("", "file"):
        draft = f"{url.path}.{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(url.path), exist_ok=True)
        with open(draft, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(draft, url.path)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    draft = f"{path}.{uuid.uuid4().hex}"
    files = at(draft).getFileSystem(conf)
    out = files.create(at(draft), False)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(path).toUri(), conf).rename(at(draft), at(path), options)
    except Exception as e:
        files.delete(at(draft), False)
        if "FileAlreadyExists" in str(e) or files.exists(at(path)):
            return False
        raise
    return True


class Store:
    def __init__(self, spark: SparkSession, path: str, migrations: dict[int, Callable[[Store], None]] | None = None):
        """Opens or creates the store. An older schema is migrated version by version, each recorded when it is done; a newer one is refused."""
        self.spark, self.path = spark, path.rstrip("/")
        steps = default_migrations() if migrations is None else migrations
        known = max([SCHEMA_VERSION, *steps]) if migrations is not None else SCHEMA_VERSION
        held = self.read("schema_version", "version int").agg(F.max("version")).first()[0]
        if held is not None and held > known:
            raise StoreError(f"{path} has schema version {held}; this engine knows {known}")
        for version in [known] if held is None else range(held + 1, known + 1):
            if held is not None and version in steps:
                steps[version](self)
            self.write("schema_version", spark.createDataFrame([(version,)], "version int"))

    # -- files

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        at, files = self._fs(path)
        return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []

    def _delete(self, path: str) -> None:
        at, files = self._fs(path)
        files.delete(at, True)

    def _move(self, names: list[str], source: str, target: str) -> None:
        at, files = self._fs(target)
        files.mkdirs(at)
        for n in names:
            if not files.rename(self._fs(f"{source}/{n}")[0], self._fs(f"{target}/{n}")[0]):
                raise StoreError(f"{source}/{n} can't be moved to {target}")

    def _data(self, name: str) -> str:
        return f"{self.path}/{name}/data"

    # -- versions

    def versions(self, name: str) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names(f"{self.path}/{name}/log") if n.startswith("v") and n.endswith(".json"))

    def version(self, name: str) -> int:
        return (self.versions(name) or [0])[-1]

    def manifest(self, name: str, version: int | None = None) -> dict:
        """version, parts (path, account, arrival, whole) and added (the paths that came with it); empty for version 0."""
        v = self.version(name) if version is None else version
        if v == 0:
            return {"version": 0, "parts": [], "added": []}
        at, files = self._fs(f"{self.path}/{name}/log/v{v:08d}.json")
        if not files.exists(at):
            raise StoreError(f"{name} has no version {v} any more")
        stream = files.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _create(self, name: str, manifest: dict) -> bool:
        return create_once(self.spark, f"{self.path}/{name}/log/v{manifest['version']:08d}.json", json.dumps(manifest))

    def _commit(self, name: str, change: Callable[[dict], dict | None]) -> int | None:
        """The next version, from ``change`` of the last one; again from the newer one where another writer was first. None where ``change`` gives up."""
        for k in range(TRIES):
            held = self.manifest(name)
            new = change(held)
            if new is None:
                return None
            new["version"] = held["version"] + 1
            if self._create(name, new):
                return new["version"]
            time.sleep(random.random() * min(1.0, 0.02 * 2 ** min(k, 6)))
        raise StoreError(f"{name}: {TRIES} times another writer was first")

    # -- reading

    def _read(self, name: str, schema: str, parts: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self._data(name)}/part={p['path']}" for p in parts]
        return self.spark.read.option("basePath", self._data(name)).schema(f"{schema}, part string").parquet(*paths)

    def _rows(self, name: str, schema: str, manifest: dict, accounts: set[str] | None = None, keys: DataFrame | None = None) -> DataFrame:
        parts = [p for p in manifest["parts"] if accounts is None or p["account"] in accounts]
        if name not in MERGES:
            return self._read(name, schema, parts).drop("part")
        by: dict[str, list[dict]] = {}
        for p in parts:
            by.setdefault(p["account"], []).append(p)
        whole = [p for own in by.values() if len(own) == 1 and own[0]["whole"] for p in own]
        rest = [p for p in parts if p not in whole]
        of = (lambda rows: rows) if keys is None else (lambda rows: rows.join(keys, KEY, "left_semi"))
        out = of(self._read(name, schema, whole).drop("part"))
        if not rest:
            return out
        # a row a part of the manifest, which the driver holds
        arrival = F.broadcast(self.spark.createDataFrame([(unquote(p["path"]), p["arrival"]) for p in rest], "part string, arrival long"))
        merged = MERGES[name](of(self._read(name, schema, rest)).join(arrival, "part").drop("part"))
        return merged if not whole else out.unionByName(merged)

    def messages(self, schema: str, version: int, accounts: set[str]) -> DataFrame:
        """The messages of some accounts, as ``read`` gives them. Which keys have several rows is looked up first, in the keys alone; where those are few, only their rows are dealt to be merged."""
        parts = [p for p in self.manifest("messages", version)["parts"] if p["account"] in accounts]
        several = self._read("messages", f"{_KEYS}", parts).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEY)
        several = written(several, "several")
        if several.limit(FEW_ROWS + 1).count() > FEW_ROWS:
            return self.read("messages", schema, version, accounts)
        several = F.broadcast(several)
        once = self._read("messages", schema, parts).drop("part").join(several, KEY, "left_anti")
        return once.unionByName(self._rows("messages", schema, {"parts": parts}, None, several))

    def added(self, name: str, since: int, until: int) -> list[dict]:
        """The parts that came after version ``since``."""
        out: list[dict] = []
        for v in range(since + 1, until + 1):
            m = self.manifest(name, v)
            out += [p for p in m["parts"] if p["path"] in set(m["added"])]
        return out

    def came(self, schema: str, since: int, until: int) -> tuple[DataFrame, DataFrame | None]:
        """Rows that were added to the messages after version ``since``, and those of their keys that it knew; None where it knew none. Only keys are compared."""
        added = self.added("messages", since, until)
        rows, accounts = self._read("messages", schema, added).drop("part"), {p["account"] for p in added}
        old = [p for p in self.manifest("messages", since)["parts"] if p["account"] in accounts]
        if not old or not added:
            return rows, None
        known = written(rows.select(*KEY).join(self._read("messages", _KEYS, old).select(*KEY), KEY, "left_semi").distinct(), "known")
        return rows, None if known.isEmpty() else few(known)

    def read(self, name: str, schema: str, version: int | None = None, accounts: set[str] | None = None) -> DataFrame:
        """The table, as of its last version or an earlier one; of some accounts only, where it has parts by account."""
        return self._rows(name, schema, self.manifest(name, version), accounts)

    # -- writing

    def write(self, name: str, rows: DataFrame) -> int:
        """``rows`` as the whole table, whatever it held."""
        if name in MERGES:
            parts = [{k: v for k, v in p.items() if k != "batch"} for p in self._stage(name, rows)]
            return self._commit(name, lambda m: {"parts": [{**p, "arrival": m["version"] + 1} for p in parts], "added": [p["path"] for p in parts]})
        path = self._put_folder(name, rows)
        return self._commit(name, lambda m: {"parts": [{"path": path, "account": None, "arrival": 0, "whole": True}], "added": [path]})

    def _put_folder(self, name: str, rows: DataFrame) -> str:
        path = uuid.uuid4().hex
        rows.write.parquet(f"{self._data(name)}/part={path}")
        return path

    def update(self, name: str, schema: str, change: Callable[[DataFrame], DataFrame | None]) -> int | None:
        """The whole table, changed; where another writer was first, ``change`` is applied again to what it wrote. An error of ``change`` changes nothing."""
        for k in range(TRIES):
            held = self.manifest(name)
            rows = change(self._rows(name, schema, held))
            if rows is None:
                return None
            path = self._put_folder(name, rows)
            if self._create(name, {"version": held["version"] + 1, "parts": [{"path": path, "account": None, "arrival": 0, "whole": True}], "added": [path]}):
                if (held["version"] + 1) % KEPT_VERSIONS == 0:
                    self.vacuum(name, KEPT_VERSIONS)
                return held["version"] + 1
            self._delete(f"{self._data(name)}/part={path}")
            time.sleep(random.random() * min(2.0, 0.1 * 2 ** min(k, 5)))
        raise StoreError(f"{name}: {TRIES} times another writer was first")

    def _stage(self, name: str, rows: DataFrame, batch: str | None = None) -> list[dict]:
        """Parts of ``rows``, one for each batch and account, which no manifest names yet; one job. It writes to a folder of its own, from which the parts are moved: a job that ends deletes the
        unfinished files of all jobs that write to its folder, whose tasks then lose their rows without a word."""
        own = uuid.uuid4().hex
        number = F.col(batch).cast("string") if batch else F.lit("0")
        part = F.concat_ws("~", F.lit(own), number, F.coalesce("account", F.lit("")))
        out = rows.withColumn("part", part)
        draft = f"{self.path}/{name}/draft/{own}"
        try:
            (out.drop(batch) if batch else out).write.partitionBy("part").parquet(draft)
            found = [n.removeprefix("part=") for n in self._names(draft) if n.startswith(f"part={own}~")]
            self._move([f"part={n}" for n in found], draft, self._data(name))
        finally:
            self._delete(draft)
        entry = lambda n: {"path": n, "account": unquote(n).split("~", 2)[2], "batch": int(unquote(n).split("~", 2)[1]), "arrival": 0, "whole": False}
        return sorted(map(entry, found), key=lambda e: e["batch"])

    def stage(self, name: str, rows: DataFrame, batch: str) -> dict[int, list[dict]]:
        """Parts by the number in column ``batch``, for ``add`` to commit one batch after the other."""
        out: dict[int, list[dict]] = {}
        for e in self._stage(name, rows, batch):
            out.setdefault(e.pop("batch"), []).append(e)
        return out

    def add(self, name: str, parts: list[dict]) -> int:
        """Commits staged parts; rows of a later commit arrive later."""
        version = self._commit(name, lambda m: {"parts": [*m["parts"], *({**p, "arrival": m["version"] + 1} for p in parts)], "added": [p["path"] for p in parts]})
        self._compact_where_due(name, {p["account"] for p in parts})
        return version

    def put(self, name: str, rows: DataFrame) -> int:
        """Adds ``rows`` to what a merged table holds of their keys. Costs what the rows cost."""
        parts = self._stage(name, rows)
        return self.add(name, [{k: v for k, v in p.items() if k != "batch"} for p in parts]) if parts else self.version(name)

    def rows_of(self, name: str, parts: list[dict]) -> int:
        """Rows of parts, from the files' footers."""
        return self.spark.read.parquet(*(f"{self._data(name)}/part={p['path']}" for p in parts)).count() if parts else 0

    def _compact_where_due(self, name: str, accounts: set[str]) -> None:
        parts = self.manifest(name)["parts"]
        for account in sorted(accounts):
            if sum(p["account"] == account for p in parts) > MOST_PARTS:
                self.compact(name, account)

    def compact(self, name: str, account: str) -> bool:
        """One part in place of an account's parts, as the last of them arrived. False where another writer has merged them meanwhile; parts that came meanwhile stay."""
        manifest = self.manifest(name)
        old = [p for p in manifest["parts"] if p["account"] == account]
        if len(old) < 2 and all(p["whole"] for p in old):
            return False
        schema = self._schema(name, old)
        rows = MERGES[name](self._read(name, schema, old).join(F.broadcast(self.spark.createDataFrame([(unquote(p["path"]), p["arrival"]) for p in old], "part string, arrival long")), "part").drop("part"))
        new = [{k: v for k, v in p.items() if k != "batch"} | {"whole": True, "arrival": max(q["arrival"] for q in old)} for p in self._stage(name, rows)]

        def replace(m: dict) -> dict | None:
            held = {p["path"] for p in m["parts"]}
            if not all(p["path"] in held for p in old):
                return None
            gone = {p["path"] for p in old}
            return {"parts": [*(p for p in m["parts"] if p["path"] not in gone), *new], "added": []}

        if self._commit(name, replace) is not None:
            return True
        for p in new:
            self._delete(f"{self._data(name)}/part={p['path']}")
        return False

    def _schema(self, name: str, parts: list[dict]) -> str:
        fields = self.spark.read.parquet(f"{self._data(name)}/part={parts[0]['path']}").schema.fields
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields if f.name != "part")

    def vacuum(self, name: str, keep: int = KEPT_VERSIONS) -> int:
        """Drops all versions but the last ``keep``, and the parts that only those named; gives how many parts went."""
        versions = self.versions(name)
        if len(versions) <= keep:
            return 0
        live = {p["path"] for v in versions[-keep:] for p in self.manifest(name, v)["parts"]} | {a for v in versions[-keep:] for a in self.manifest(name, v)["added"]}
        gone = {p["path"] for v in versions[:-keep] for p in self.manifest(name, v)["parts"]} - live
        for v in versions[:-keep]:
            self._delete(f"{self.path}/{name}/log/v{v:08d}.json")
        for path in gone:
            self._delete(f"{self._data(name)}/part={path}")
        return len(gone)

    # -- changes

    def changes(self, name: str, schema: str, since: int, until: int | None = None, among: DataFrame | None = None) -> DataFrame:
        """account, message_id, change (inserted, updated, demoted), before, after: what came or changed after version ``since``. Reads the parts that were added, and the touched accounts as they
        were and are; keys that came again as they were aren't changes. ``among``: of the keys that came, those asked for."""
        last = self.version(name) if until is None else until
        added = self.added(name, since, last)
        keys = self._read(name, schema, added).select(*KEY).distinct() if among is None else among
        accounts = {p["account"] for p in added}
        side = lambda v, n: self._rows(name, schema, self.manifest(name, v), accounts, keys).select(*KEY, F.struct(*(c for c in self._names_of(schema) if c not in KEY)).alias(n))
        both = side(since, "before").join(side(last, "after"), KEY, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
        lower = body_rank(F.col("after.body_state")) > body_rank(F.col("before.body_state"))
        demoted = lower & (F.col("after.body_state") == "summary-only")
        change = F.when(F.col("before").isNull(), "inserted").when(demoted, "demoted").otherwise("updated")
        return both.select(*KEY, change.alias("change"), "before", "after")

    def _names_of(self, schema: str) -> list[str]:
        return self.spark.createDataFrame([], schema).columns


def default_migrations() -> dict[int, Callable[[Store], None]]:
    """What leads to each schema version from the one before it, in order."""

    def with_search_index(store: Store) -> None:
        from .derive import update_index

        if store.versions("messages"):
            update_index(store)

    return {2: with_search_index}
