"""The board from states that a stream keeps, without reading the history again.

The state of a day is how often each value occurred, by stage: counts that add up, so days and batches merge in any order, late events
go to their own day, and an event that is taken back counts -1. Percentiles, means, least and greatest values and histograms follow
exactly from counts of values. States are saved by key, so a batch rewrites only the files of the days that it touches; each
version of the table names the last batch in it, so a batch that runs again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.board import BINS, percentile_of_counts, trust_bin
from ..sources.keyed import KeyedTable

KEY = ["day", "stage", "value"]


def states(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, KEY)


def counted(events: DataFrame, value: str = "ms") -> DataFrame:
    """day, stage, value, n of events (stage, ts, value and, if there is one, sign: 1, or -1 for an event that is taken back). Events
    without a value count under null, those without a time under a null day."""
    sign = F.coalesce(F.col("sign"), F.lit(1)) if "sign" in events.columns else F.lit(1)
    return events.groupBy(F.to_date("ts").alias("day"), "stage", F.col(value).cast("double").alias("value")).agg(F.sum(sign).cast("long").alias("n"))


def fold(at: KeyedTable, events: DataFrame, batch: int | None = None, value: str = "ms") -> dict:
    """Adds a batch of events to the states. batch: its number in its stream; a number that is folded already changes nothing."""

    def merged(old: DataFrame | None) -> DataFrame:
        delta = counted(events, value)
        if old is None:
            return delta
        same = [F.col(f"d.{c}").eqNullSafe(F.col(f"o.{c}")) for c in KEY]
        days = [r.day for r in delta.select("day").distinct().limit(100).collect()]  # of a batch there are few: then other days aren't read
        if len(days) < 100 and None not in days:
            old = old.where(F.col("day").isin(days))
        both = delta.alias("d").join(old.alias("o"), (same[0]) & (same[1]) & (same[2]), "left")
        return both.select(*[F.col(f"d.{c}").alias(c) for c in KEY], (F.col("d.n") + F.coalesce("o.n", F.lit(0))).alias("n"))

    return at.transact(merged, batch)


def stage_times(state: DataFrame, stages: DataFrame) -> DataFrame:
    """stage, n, mean_ms, p95 as board.stage_times() gives them for all events in the state."""
    rows = state.groupBy("stage", "value").agg(F.sum("n").alias("n")).where("n <> 0")
    by = rows.groupBy("stage").agg(F.sum("n").alias("n"), (F.sum(F.col("value") * F.col("n")) / F.sum(F.when(F.col("value").isNotNull(), F.col("n")))).alias("mean_ms"), F.min("value").alias("least"), F.max("value").alias("greatest"))
    both = stages.select("stage").join(by, "stage", "left").join(percentile_of_counts(rows, "value", "n", 0.95, ["stage"]), "stage", "left")
    return both.select("stage", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_ms", F.lit(0.0)).alias("mean_ms"), F.coalesce("p95", F.lit(0.0)).alias("p95"))


def trust_histogram(state: DataFrame, threshold: float = 0.85) -> DataFrame:
    """bin, n, above of a state whose values are trust, as board.trust_histogram() gives them."""
    rows = state.groupBy("value").agg(F.sum("n").alias("n")).where("n <> 0")
    out = rows.groupBy(trust_bin(F.col("value"), BINS).alias("bin")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("value") >= threshold, F.col("n"))).alias("above"))
    return out.select("bin", "n", F.coalesce("above", F.lit(0)).alias("above"))


def board_stream(spark: SparkSession, path: str, schema: StructType | str, at: str, checkpoint: str, value: str = "ms", files: int = 100) -> StreamingQuery:
    """Folds Parquet files of events that arrive under path into the states at the path at."""

    def write(batch: DataFrame, number: int) -> None:
        fold(states(spark, at), batch, number, value)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
