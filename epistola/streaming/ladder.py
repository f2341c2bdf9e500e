"""The body ladder as a stateful stream: arriving message rows to message rows as they now are.

State is kept by message: the metadata of the latest arrival, the body of the highest state that ever came (at equal state the latest), so a body never goes down by an arrival, whatever order batches come in and
however often a row comes again. A message that holds a body and has a summary is given a timer: once the watermark of event times passes its summary's time by the grace period, its body goes and its state is
``summary-only``. A later body doesn't bring it back, as in the table.

The output has a row for each message that a batch changed; ``into_store`` adds those rows to the message table, where they merge like any others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.merge import BODY_COLUMNS, KEY
from ..schemas import BODY_STATES, MESSAGES
from .derive import GRACE_MS
from .store import Store

NAMES = [f.split()[0] for f in MESSAGES.split(", ")]
_META = [n for n in NAMES if n not in KEY and n not in BODY_COLUMNS]
#: What the stream takes beside the table's columns: the number of an arrival (later wins), when the message was summarised (null: not), and the event's time.
ARRIVING = "arrival bigint, summarized_at bigint, at timestamp"

_STATE = StructType(
    [
        StructField("meta", StringType()), StructField("meta_arrival", LongType()), StructField("body_state", StringType()), StructField("body_text", StringType()), StructField("body_html", StringType()),
        StructField("body_arrival", LongType()), StructField("due", LongType()),
    ]
)


def rank(state: str | None) -> int:
    return BODY_STATES.index(state) if state in BODY_STATES else -1


def _value(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    return [str(v) for v in x] if hasattr(x, "__iter__") and not isinstance(x, str) else x.item() if hasattr(x, "item") else x


class _Ladder(StatefulProcessor):
    def __init__(self, grace_ms: int):
        self.grace_ms = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("message", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        import json

        was = self.held.get() if self.held.exists() else None
        meta, meta_arrival, state, text, html, body_arrival, due = was if was is not None else (None, -1, None, None, None, -1, None)
        for batch in rows:
            for r in batch.to_dict("records"):
                arrival = int(r["arrival"])
                if arrival >= meta_arrival:
                    meta, meta_arrival = json.dumps({n: _value(r[n]) for n in _META}), arrival
                if (rank(_value(r["body_state"])), arrival) >= (rank(state) if body_arrival >= 0 else -2, body_arrival):
                    state, text, html, body_arrival = _value(r["body_state"]), _value(r["body_text"]), _value(r["body_html"]), arrival
                summarized = _value(r["summarized_at"])
                if summarized is not None:
                    due = max(due or 0, int(summarized) + self.grace_ms)
        now = (meta, meta_arrival, state, text, html, body_arrival, due)
        if was is not None and tuple(was) == now:
            return
        self.held.update(now)
        if due is not None and state == "full" and (was is None or was[6] != due or was[2] != state):
            self.handle.registerTimer(due)
        yield self._row(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if not self.held.exists():
            return
        meta, meta_arrival, state, _, _, body_arrival, due = self.held.get()
        if state != "full" or due is None or expiredTimerInfo.getExpiryTimeInMs() < due:
            return
        now = (meta, meta_arrival, "summary-only", None, None, body_arrival, None)
        self.held.update(now)
        yield self._row(key, now)

    def _row(self, key, state: tuple) -> pd.DataFrame:
        import json

        row = dict(zip(KEY, key, strict=True)) | json.loads(state[0]) | dict(zip(BODY_COLUMNS, state[2:5], strict=True))
        return pd.DataFrame([{n: row[n] for n in NAMES}], dtype=object)

    def close(self) -> None:
        pass


def ladder(arriving: DataFrame, grace_ms: int = GRACE_MS, late: str = "30 days") -> DataFrame:
    """Streaming rows of the message table with ``ARRIVING`` -> the message rows that changed. Rows whose event is more than ``late`` behind the newest are dropped, as Spark drops late rows, and timers wait as long. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    own = arriving.select(*NAMES, *(f.split()[0] for f in ARRIVING.split(", "))).withWatermark("at", late)
    return own.groupBy(*KEY).transformWithStateInPandas(_Ladder(grace_ms), outputStructType=MESSAGES, outputMode="Update", timeMode="EventTime")


def into_store(changed: DataFrame, store: Store, checkpoint: str):
    """An available-now run of ``ladder`` into the message table; the query. Rows of one batch are one commit; one that comes again changes nothing."""

    def put(batch: DataFrame, epoch: int) -> None:
        store.put("messages", batch.select(*(F.col(n) for n in NAMES)))

    return changed.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
