"""Deterministic samples: order by a hash of the id and a seed, never by chance of execution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


FEW = 50_000  # rows that may be gathered in one task


def first_rows(rows: DataFrame, n: int, *order: Column | str, slots: int = 64) -> DataFrame:
    """The first n rows by order, which must tell all rows apart for the result to be one. Up to FEW rows are a limit behind a sort. More are
    cut where they lie: rows are ranged by the order, the ranges' counts are summed ahead, whole ranges stay or go, and only the one
    that the cut falls into is numbered, so no task holds more than a range."""
    if n <= FEW:
        return rows.orderBy(*order).limit(n)
    ranged = written(rows.repartitionByRange(slots, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = F.broadcast(counts.withColumn("_ahead", ahead))  # at most slots rows
    placed = ranged.join(parts, "_part").where(F.col("_ahead") < n)
    whole = placed.where(F.col("_ahead") + F.col("_n") <= n)
    cut = placed.where(F.col("_ahead") + F.col("_n") > n).withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return whole.select(*rows.columns).unionByName(cut.where(F.col("_r") + F.col("_ahead") <= n).select(*rows.columns))


def _order(seed: int):
    return F.xxhash64(F.col("id").cast("string"), F.lit(seed))


def _firsts(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """rows with r, their place in their class, up to n. The limit on the rank lets Spark cut each class before the shuffle, so
    a class with most of the rows doesn't meet in one task."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy(_order(seed), "id"))).where(F.col("r") <= n)


def class_covering(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """One row of each class, then rounds over the classes by size until n. rows: id, class."""
    sizes = rows.groupBy("class").agg(F.count("*").alias("size"))
    return first_rows(_firsts(rows, n, seed).join(sizes, "class"), n, "r", F.desc("size"), "class", "id").select("id", "class", F.col("r").alias("round"))


def proportional(rows: DataFrame, n: int, least: int = 2, seed: int = 0) -> DataFrame:
    """round(n size / total) rows of each stratum, at least two."""
    sizes = rows.groupBy("class").agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))  # one row
    quota = sizes.crossJoin(total).select("class", F.greatest(F.lit(least), F.round(n * F.col("size") / F.col("total"))).alias("quota"))
    return _firsts(rows, max(n, least), seed).join(quota, "class").where("r <= quota").select("id", "class")


def first_per_class(rows: DataFrame, k: int) -> DataFrame:
    """The first k of each class, clean before defective, then by id. rows: id, class, defect."""
    r = F.row_number().over(Window.partitionBy("class").orderBy(F.col("defect").isNotNull(), "id"))
    return rows.withColumn("r", r).where(F.col("r") <= k).select("id", "class", "defect")


def balanced_defects(rows: DataFrame, n: int) -> DataFrame:
    """Half defective in equal shares of the kinds, the rest clean, each by id."""
    bad, clean = rows.where("defect is not null"), rows.where("defect is null")
    r = F.row_number().over(Window.partitionBy("defect").orderBy("id"))
    chosen = first_rows(bad.withColumn("r", r).where(F.col("r") <= n), n // 2, "r", "defect", "id").select("id", "class", "defect")
    return chosen.unionByName(first_rows(clean, n - n // 2, "id").select("id", "class", "defect"))


def hard_cases(rows: DataFrame, n: int) -> DataFrame:
    """A third of bad scans, the rest clean, each by id. rows: id, class, bad_scan."""
    bad = first_rows(rows.where("bad_scan"), n // 3, "id")
    return bad.unionByName(first_rows(rows.where("not bad_scan"), n - n // 3, "id"))
