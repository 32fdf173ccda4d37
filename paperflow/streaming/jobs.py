"""Streaming jobs: stateless intake of documents, and the latest status of each document from an event stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.routing import gate, route
from ..operators.rules import Rule, report, run_rules


def intake(spark: SparkSession, path: str, schema: T.StructType, rules: list[Rule], sink: str, checkpoint: str, files: int = 100, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Documents that arrive as parquet files under path: rule results, then route and gate, appended under sink/results and
    sink/decisions. Every step is narrow, but for the count of violations of a document inside its micro-batch."""

    def batch(docs: DataFrame, number: int) -> None:
        docs = prepare(docs) if prepare else docs
        docs = docs.persist()
        try:
            results = run_rules(docs, rules)
            results.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/results/batch={number}")
            routed = route(docs)
            errors = report(results).select("doc_id", F.col("violated").alias("critical_missing"))
            state = routed.join(errors, "doc_id", "left").select("*", F.lit(None).cast("boolean").alias("gave_up"), F.lit(0).alias("open_errors"), F.lit(False).alias("writer_uncertain"))
            gate(state).write.mode("overwrite").parquet(f"{sink}/decisions/batch={number}")  # a batch that runs again replaces itself
        finally:
            docs.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_status(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Per document the last event by (ts, action_id), of a stream or a table. Repeated events (doc_id, action_id) inside the
    watermark count once."""
    rows = events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["doc_id", "action_id"]) if events.isStreaming else events.dropDuplicates(["doc_id", "action_id"])
    last = F.max_by(F.struct("ts", "action_id", "status"), F.struct("ts", "action_id"))
    return rows.groupBy("doc_id").agg(last.alias("last"), F.count("*").alias("events")).select("doc_id", "last.status", F.col("last.ts").alias("ts"), "events")


def status_stream(spark: SparkSession, path: str, schema: T.StructType, sink: str, checkpoint: str, watermark: str = "1 hour", files: int = 100) -> StreamingQuery:
    """Appends the latest status of the documents that each micro-batch touches under sink/changes, a folder for each batch;
    a batch that runs again replaces its own folder. current_status() reads the state, fold_status() folds the changes into
    sink/base from time to time. An event that comes again after the watermark is counted again; the status stays right."""

    def write(batch: DataFrame, number: int) -> None:
        latest_status(batch).write.mode("overwrite").parquet(f"{sink}/changes/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["doc_id", "action_id"])
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folders(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().toString() for s in fs.listStatus(path)] if fs.exists(path) else []


def current_status(spark: SparkSession, sink: str) -> DataFrame:
    """doc_id, status, ts, events: the last base, and all batches after it."""
    base = max(_folders(spark, f"{sink}/base"), key=lambda p: int(p.rpartition("=")[2]), default=None)
    done = int(base.rpartition("=")[2]) if base else -1
    new = [p for p in _folders(spark, f"{sink}/changes") if int(p.rpartition("=")[2]) > done]
    rows = spark.read.parquet(*([base] if base else []), *new).select("doc_id", "status", "ts", "events")
    return rows.groupBy("doc_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"), F.sum("events").alias("events"))


def fold_status(spark: SparkSession, sink: str) -> None:
    """Writes a base of all batches so far, then deletes what it replaces (readers of those must have ended; no stream runs)."""
    old, changes = _folders(spark, f"{sink}/base"), _folders(spark, f"{sink}/changes")
    last = max((int(p.rpartition("=")[2]) for p in changes), default=None)
    if last is None or any(int(p.rpartition("=")[2]) == last for p in old):
        return
    current_status(spark, sink).write.parquet(f"{sink}/base/batch={last}")
    for folder in (*old, *(p for p in changes if int(p.rpartition("=")[2]) < last)):  # the last stays: a stream may run it again
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
