"""Sinks: partitioned tier tables that are overwritten by partition, and the snapshot document."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds of a minute, by which a rate gives a number of requests.
SECONDS = 60


def minute_rows(rows: DataFrame) -> DataFrame:
    """Rows of the minute tier as they are stored: requests are the sum of the status classes, or the rate times 60,
    rounded down, where that is 0.  The rate is a column rps, or else follows from the requests of the minute."""
    total = F.col("s2xx") + F.col("s3xx") + F.col("s4xx") + F.col("s5xx")
    rate = F.col("rps") if "rps" in rows.columns else F.col("requests") / F.lit(SECONDS)
    return rows.withColumn("requests", F.when((total == 0) & (rate > 0), F.floor(rate * SECONDS)).otherwise(total))


def path_rows(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("path") != "") & (F.col("requests") > 0))


def country_rows(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("code") != "") & (F.col("requests") > 0))


def day_of(ts: Column) -> Column:
    """The UTC date of epoch seconds, as text."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts / 86400).cast("int")).cast("string")


def write_tier(rows: DataFrame, path: str, tier: str) -> None:
    """Write rows with an epoch column ``ts`` under ``path``/tier=.../dt=...; days that come again are replaced whole,
    so writing the same rows twice changes nothing.  Rows of a day are brought together, large days split."""
    dated = rows.withColumn("tier", F.lit(tier)).withColumn("dt", day_of(F.col("ts"))).hint("rebalance", "dt")
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tier", "dt").parquet(path)


def read_tier(spark: SparkSession, path: str, tier: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows of a tier with ``ts`` from ``start`` to ``end``, both included; only the days between are read."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/tier={tier}")
    for at, keep in ((start, lambda c, v: c >= v), (end, lambda c, v: c <= v)):
        if at is not None:
            day = datetime.datetime.fromtimestamp(at, datetime.timezone.utc).strftime("%Y-%m-%d")
            rows = rows.filter(keep(F.col("dt"), F.lit(day).cast(rows.schema["dt"].dataType)) & keep(F.col("ts"), F.lit(at)))
    return rows.drop("tier", "dt")


def batch_sink(path: str, tier: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch goes to a folder of its own, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("tier", F.lit(tier)).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tier", "batch").parquet(path)

    return write


def snapshot_document(live_rows: DataFrame, totals: DataFrame, as_of: int) -> DataFrame:
    """(vhosts, document): one JSON document of the time, the server's own counters and all virtual hosts' rows, in order of name.

    ``totals`` has one row, or none, which gives a document without ``global``.
    """
    columns = [c for c in live_rows.columns if c != "vhost"]
    entry = F.struct("vhost", F.struct(*columns).alias("v"))
    grouped = live_rows.agg(F.count("*").alias("vhosts"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("m"))
    one = totals.agg(F.first(F.struct(*totals.columns)).alias("g"))
    both = grouped.unionByName(one, allowMissingColumns=True).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("vhosts", "m", "g")])
    whole = F.struct(F.lit(as_of).cast("long").alias("timestamp"), F.col("g").alias("global"), F.col("m").alias("vhosts"))
    return both.select("vhosts", F.to_json(whole).alias("document"))
