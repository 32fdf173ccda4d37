"""The state of documents under user actions, kept by a stream.

Actions wait in a document's state until the watermark has passed them, then fold in the order of (ts, action_id) with the guards of
register.apply_actions(), so the state after the watermark is what that gives for the same actions, in whatever order they came. An
action that comes twice while it waits is one; one that comes after its time was folded is late: it is left out and counted."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.register import ACTIONS, APPROVERS, CORRECTS, NEEDS_REASON, OPEN, with_targets
from .jobs import _folders

ACTION = "doc_id long, action_id long, ts timestamp, role string, action string, reason string, new_unit string"
STATE = "status string, decision string, unit string, corrections int, accepted int, rejected string, late int, folded long"  # rejected: JSON pairs
WAITING_KEY, WAITING = "us long, action_id long, what string", "role string, action string, reason string, new_unit string, target boolean"
OUT = "doc_id long, status string, decision string, unit string, corrections int, accepted int, rejected array<struct<action_id: bigint, reason: string>>, late int, folded long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def barred(status: str | None, role: str | None, action: str | None, reason: str | None, target: bool) -> str | None:
    """Why an action isn't allowed in this status; None if it is."""
    if role not in APPROVERS:
        return "yetki_yok"
    if action in NEEDS_REASON and not (reason or "").strip(" "):
        return "gerekce_yok"
    if action in ("onayla", "reddet") and status not in OPEN:
        return "sonuclanmis"
    if action == "birim_degistir" and not target:
        return "birim_gecersiz"
    if action == "karari_geri_al":
        return "yalniz_yonetici" if role != "yonetici" else "acik" if status in OPEN else None
    return None if action in ACTIONS else "bilinmeyen"


class Workflow(StatefulProcessor):
    """State and waiting actions of a document."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", STATE)
        self.waiting = handle.getMapState("waiting", WAITING_KEY, WAITING)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: Any) -> None:
        self.now.update((initialState["status"], None, initialState["unit"], 0, 0, "[]", 0, -1))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = self.now.get() if self.now.exists() else ("isleniyor", None, None, 0, 0, "[]", 0, -1)
        late, folded = now[6], now[7]
        for r in rows:
            if r["us"] <= folded:
                late += 1
                continue
            what = repr((r["role"], r["action"], r["reason"], r["new_unit"]))
            self.waiting.updateValue((r["us"], r["action_id"], what), (r["role"], r["action"], r["reason"], r["new_unit"], r["target"]))
            self.handle.registerTimer(r["us"] // 1000 + 1)
        self.now.update((*now[:6], late, folded))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000 - 1  # what is yet to come is later
        due = sorted(((k, v) for k, v in self.waiting.iterator() if k[0] <= upto), key=lambda x: tuple(x[0][:2]) + tuple((c is not None, c or "") for c in x[1][:4]))
        if not due:
            return  # folded by an earlier timer of this batch
        status, decision, unit, corrections, accepted, rejected, late, _ = self.now.get()
        rejected = json.loads(rejected)
        for k, (role, action, reason, new_unit, target) in due:
            why = barred(status, role, action, reason, target)
            self.waiting.removeKey(tuple(k))
            if why:
                rejected.append([k[1], why])
                continue
            accepted, corrections = accepted + 1, corrections + (action in CORRECTS)
            status = {"onayla": "onaylandi", "reddet": "reddedildi", "eksik_bilgi_iste": "eksik_bilgi_bekliyor", "eksik_bilgi_cevabi": "insan_onayi_bekliyor", "karari_geri_al": "insan_onayi_bekliyor"}.get(action, status)
            decision = {"onayla": "onaylandi", "reddet": "reddedildi", "birim_degistir": "birim_degistirildi", "eksik_bilgi_iste": "eksik_bilgi_istendi", "karari_geri_al": None}.get(action, decision)
            unit = new_unit if action == "birim_degistir" else unit
        self.now.update((status, decision, unit, corrections, accepted, json.dumps(rejected), late, upto))
        yield Row(doc_id=key[0], status=status, decision=decision, unit=unit, corrections=corrections, accepted=accepted, rejected=[Row(action_id=i, reason=w) for i, w in rejected], late=late, folded=upto)

    def close(self) -> None:
        pass


def workflow(actions: DataFrame, docs: DataFrame, units: DataFrame | None = None, watermark: str = "1 hour") -> DataFrame:
    """OUT rows, one whenever actions of a document have folded. actions: a stream as ACTION; docs (doc_id, status, unit): the state
    before the first action, read when the stream is first started; a document that isn't there starts as isleniyor, without a unit;
    units (code, routable): targets of a change of unit, any if None. An action without a document, id or time is left out."""
    rows = with_targets(actions.withWatermark("ts", watermark), units).where("doc_id IS NOT NULL AND action_id IS NOT NULL AND ts IS NOT NULL")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "action_id", "role", "action", "reason", "new_unit", "target", F.unix_micros("ts").alias("us"), "ts")
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "status", "unit").groupBy("doc_id")
    return rows.groupBy("doc_id").transformWithState(Workflow(), OUT, "Update", "EventTime", first)


def workflow_stream(spark: SparkSession, path: str, docs: DataFrame, sink: str, checkpoint: str, units: DataFrame | None = None, watermark: str = "1 hour", files: int = 100, schema: StructType | str = ACTION) -> StreamingQuery:
    """Runs workflow() over Parquet files of actions; each batch replaces its own folder under sink/changes. State is in RocksDB under
    the checkpoint, so a query that is started again goes on where it ended."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/changes/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return workflow(stream, docs, units, watermark).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, sink: str) -> DataFrame:
    """The last state of each document that any batch has written."""
    rows = spark.read.schema(OUT).parquet(*_folders(spark, f"{sink}/changes"))
    return rows.groupBy("doc_id").agg(F.max_by(F.struct(*rows.columns[1:]), "folded").alias("s")).select("doc_id", "s.*")
