"""The statistics board: totals, stage timings, item counts, rates and histograms as aggregations of small cardinality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nth
from ..sources.scratch import written

BINS = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0)


def _placed(rows: DataFrame, value: str, by: list[str], slots: int) -> DataFrame:
    """by..., value, _last (how many rows stand up to and with the value), _n (rows of the group), of each distinct value.

    Exact without a global window: values are counted first, and the counts ranged over (by, value) are summed inside each
    range and ahead of it, so a heavy group spreads over tasks. The ranges are written first, as both sums must see the same ones."""
    return _placed_counts(rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c")), value, by, slots)


def _placed_counts(counts: DataFrame, value: str, by: list[str], slots: int) -> DataFrame:
    """_placed() of rows by, value, _c: how many rows have the value."""
    ranged = written(counts.repartitionByRange(slots, *by, value).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(*by).agg(F.sum("_c").alias("_n"))
    inside = ranged.withColumn("_run", F.sum("_c").over(Window.partitionBy("_part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    parts = ranged.groupBy("_part", *by).agg(F.sum("_c").alias("_s"))
    ahead = parts.withColumn("_ahead", F.coalesce(F.sum("_s").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    placed = inside.join(ahead, ["_part", *by]) if by else inside.join(ahead, "_part")
    placed = placed.join(totals, by) if by else placed.crossJoin(totals)
    return placed.select(*by, value, (F.col("_run") + F.col("_ahead")).alias("_last"), "_n")


def rank_percentile(rows: DataFrame, value: str, p: float, by: list[str], slots: int = 64) -> DataFrame:
    """by..., pXX: the value at the place min(n - 1, int(n p)) of each group, ties and all (not an interpolation)."""
    place = F.least(F.col("_n") - 1, F.floor(F.col("_n") * p))
    return _placed(rows, value, by, slots).where(F.col("_last") > place).groupBy(*by).agg(F.min(value).alias(f"p{round(p * 100):02d}"))


def percentile_of_counts(counts: DataFrame, value: str, n: str, p: float, by: list[str], slots: int = 64) -> DataFrame:
    """rank_percentile() of rows of which only the number for each value is known; nulls and numbers that aren't above 0 don't count."""
    known = counts.where(F.col(value).isNotNull() & (F.col(n) > 0)).select(*by, value, F.col(n).alias("_c"))
    place = F.least(F.col("_n") - 1, F.floor(F.col("_n") * p))
    return _placed_counts(known, value, by, slots).where(F.col("_last") > place).groupBy(*by).agg(F.min(value).alias(f"p{round(p * 100):02d}"))


def median(rows: DataFrame, value: str, by: list[str], slots: int = 64) -> DataFrame:
    """by..., median: the mean of the one or two middle values."""
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    middle = (F.min(F.when(F.col("_last") > low, F.col(value))) + F.min(F.when(F.col("_last") > high, F.col(value)))) / 2
    return _placed(rows, value, by, slots).groupBy(*by).agg(middle.alias("median"))


def totals(docs: DataFrame) -> DataFrame:
    """One row: documents without those in error, rates, times (mean, least, greatest, median, p95) and queue figures."""
    ok = docs.where(F.coalesce(F.col("status") != "hata", F.lit(True)))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    out = ok.agg(F.count("*").alias("n"), share(F.col("auto")).alias("auto_rate"), share(F.col("corrected")).alias("corrected_rate"), F.avg("ms").alias("mean_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.sum(F.col("status").isin("insan_onayi_bekliyor").cast("long")).alias("pending"), F.sum((F.coalesce("critical", F.lit(0)) > 0).cast("long")).alias("with_critical"), F.avg("waiting_s").alias("mean_waiting_s"))
    return out.crossJoin(median(ok, "ms", []).select(F.col("median").alias("median_ms"))).crossJoin(rank_percentile(ok, "ms", 0.95, []).select(F.col("p95").alias("p95_ms")))  # rows of one each


def stage_times(trace: DataFrame, stages: DataFrame) -> DataFrame:
    """stage, n, mean_ms, p95: stages without rows have zeros."""
    by = trace.groupBy("stage").agg(F.count("*").alias("n"), F.avg("ms").alias("mean_ms"))
    both = stages.select("stage").join(by, "stage", "left").join(rank_percentile(trace, "ms", 0.95, ["stage"]), "stage", "left")
    return both.select("stage", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_ms", F.lit(0.0)).alias("mean_ms"), F.coalesce("p95", F.lit(0.0)).alias("p95"))


def item_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("layer", "severity", "resolved").agg(F.count("*").alias("n"))


def rule_frequency(findings: DataFrame, order: str) -> DataFrame:
    """rule_id, n, and of the first-seen finding severity, message and basis (null where findings have no title or basis); the
    most frequent first, ties by rule."""
    seen = F.min_by(F.struct("severity", *[(F.col(c) if c in findings.columns else F.lit(None).cast("string")).alias(c) for c in ("title", "basis")]), order)
    return findings.groupBy("rule_id").agg(F.count("*").alias("n"), seen.alias("f")).select("rule_id", "n", "f.severity", F.col("f.title").alias("message"), "f.basis").orderBy(F.desc("n"), "rule_id")


def distribution(docs: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, value, n of several columns from one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    return docs.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def routing_hits(docs: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The share of routed documents whose unit nobody changed, and counts of old to new units."""
    changed = corrections.where("kind = 'birim'").select("doc_id").distinct().withColumn("changed", F.lit(True))
    rate = docs.where("target is not null").join(changed, "doc_id", "left").agg(F.count("*").alias("routed"), F.avg(F.col("changed").isNull().cast("double")).alias("hit_rate"))
    pairs = corrections.where("kind = 'birim' and size(fields) >= 2").groupBy(nth("fields", 1).alias("old_unit"), nth("fields", 2).alias("new_unit")).agg(F.count("*").alias("n"))
    return rate, pairs


def funnel(bases: DataFrame) -> DataFrame:
    """fetched, verified, dropped of legal bases."""
    return bases.agg(F.count("*").alias("fetched"), F.sum(F.coalesce("verified", F.lit(False)).cast("long")).alias("verified"), F.sum((~F.coalesce("verified", F.lit(False))).cast("long")).alias("dropped"))


def trust_bin(trust: Column, bins: tuple[float, ...] = BINS) -> Column:
    """The lower bound of the bin of a trust value, 0.0 below the first; the last bin is closed."""
    out = F.when(trust < bins[0], 0.0)
    for lo, hi in zip(bins[:-1], bins[1:], strict=True):
        out = out.when(trust < hi, lo)
    return out.otherwise(bins[-2])


def trust_histogram(decisions: DataFrame, threshold: float = 0.85) -> DataFrame:
    return decisions.groupBy(trust_bin(F.col("trust")).alias("bin")).agg(F.count("*").alias("n"), F.sum((F.col("trust") >= threshold).cast("long")).alias("above"))


def saved_time(docs_a_day: Column, manual_minutes: Column, auto_rate: Column, days: int = 250, hours_a_year: int = 1760) -> Column:
    """struct<hours, people>: yearly hours saved; documents that still go by hand take a third of the time."""
    minutes = docs_a_day * days * (auto_rate * manual_minutes + (1 - auto_rate) * (manual_minutes - manual_minutes / 3))
    return F.struct((minutes / 60).alias("hours"), (minutes / 60 / hours_a_year).alias("people"))


def stage_totals(trace: DataFrame) -> DataFrame:
    """stage, docs, mean_total: each document's rounds of a stage are summed before the mean."""
    return trace.groupBy("doc_id", "stage").agg(F.sum("ms").alias("total")).groupBy("stage").agg(F.count("*").alias("docs"), F.avg("total").alias("mean_total"))
