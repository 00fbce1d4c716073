"""Tiers of minute, hour and day rows: rollup, expiry, and history over their union."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import expressions as E
from weblens.operators.traffic import BUCKETS, CLIENTS, COUNTERS, classes_total, error_rate, merged_tops

MINUTE, HOUR, DAY = 60, 3600, 86400
#: Ages at which a tier's rows have passed on to the next.
MINUTE_AGE, HOUR_AGE = DAY, 7 * DAY


def rollup(rows: DataFrame, seconds: int) -> DataFrame:
    """Wider rows of (ts, vhost): counters are summed, mean latency is the mean of the rows', percentiles and visitors the maximum."""
    keyed = rows.withColumn("ts", E.bucket_start(F.col("ts"), seconds))
    return keyed.groupBy("ts", "vhost").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.avg("latency_avg").alias("latency_avg"), *[F.max(c).alias(c) for c in ("latency_p95", "latency_p99", "unique_visitors")])


def rollup_paths(rows: DataFrame, seconds: int) -> DataFrame:
    keyed = rows.withColumn("ts", E.bucket_start(F.col("ts"), seconds))
    return keyed.groupBy("ts", "vhost", "path").agg(*[F.sum(c).alias(c) for c in ("requests", "total_time", "s2xx")])


def rollup_countries(rows: DataFrame, seconds: int) -> DataFrame:
    keyed = rows.withColumn("ts", E.bucket_start(F.col("ts"), seconds))
    return keyed.groupBy("ts", "vhost", "code").agg(F.sum("requests").alias("requests"), F.max("name").alias("name"), F.max("flag").alias("flag"))


def cuts(as_of: int, retention_days: int = 90) -> dict[str, int]:
    """Where each tier begins: minutes after the last whole hour a day ago, hours after the last whole day a week ago."""
    return {"minute": (as_of - MINUTE_AGE) // HOUR * HOUR, "hour": (as_of - HOUR_AGE) // DAY * DAY, "day": (as_of - retention_days * DAY) // DAY * DAY}


def retained(rows: DataFrame, tier: str, as_of: int, retention_days: int = 90) -> DataFrame:
    """Rows of a tier that have not passed on or expired; a bucket rolls up once, whole."""
    return rows.filter(F.col("ts") >= cuts(as_of, retention_days)[tier])


def tier_union(minutes: DataFrame, hours: DataFrame, days: DataFrame, as_of: int, retention_days: int = 90) -> DataFrame:
    """All tiers as one, each for the span it owns, with the length of a row's bucket as ``width``."""
    at = cuts(as_of, retention_days)
    same = [c for c in hours.columns if c in minutes.columns]
    owned = [
        minutes.filter(F.col("ts") >= at["minute"]).select(*same, F.lit(MINUTE).alias("width")),
        hours.filter((F.col("ts") >= at["hour"]) & (F.col("ts") < at["minute"])).select(*same, F.lit(HOUR).alias("width")),
        days.filter((F.col("ts") >= at["day"]) & (F.col("ts") < at["hour"])).select(*same, F.lit(DAY).alias("width")),
    ]
    return owned[0].unionByName(owned[1]).unionByName(owned[2])


def rebucketed(union: DataFrame, width: int) -> DataFrame:
    """A tier union as rows of one width, in seconds: rows of narrower buckets are rolled up, wider ones stay as they
    are, as nothing is known inside them.  ``width`` tells each row's."""
    wider = F.greatest(F.col("width"), F.lit(width))
    keyed = union.withColumn("width", wider).withColumn("ts", F.col("ts") - F.pmod(F.col("ts"), F.col("width")))
    counted = [c for c in COUNTERS if c in union.columns]
    least = [c for c in ("latency_p95", "latency_p99", "unique_visitors") if c in union.columns]
    means = [F.avg(c).alias(c) for c in ("latency_avg",) if c in union.columns]
    return keyed.groupBy("ts", "vhost", "width").agg(*[F.sum(c).alias(c) for c in counted], *means, *[F.max(c).alias(c) for c in least])


def series(rows: DataFrame, vhost: str, start: int, end: int, width: int) -> DataFrame:
    """(ts, rps, latency_p95, error_rate, bandwidth ...) of one vhost, or of ``all``, with both bounds inside."""
    inside = rows.filter(F.col("ts").between(start, end))
    if vhost in ("", "all", "_all"):
        inside = inside.groupBy("ts").agg(*[F.sum(c).alias(c) for c in (*COUNTERS, "unique_visitors")], F.avg("latency_avg").alias("latency_avg"), *[F.max(c).alias(c) for c in ("latency_p95", "latency_p99")])
    else:
        inside = inside.filter(F.col("vhost") == vhost).drop("vhost")
    return inside.withColumn("rps", F.col("requests") / F.lit(width)).withColumn("error_rate", error_rate()).orderBy("ts")


def every_series(rows: DataFrame, start: int, end: int, width: int) -> DataFrame:
    """The series of every vhost, and that of all as one under the vhost ``all``: grouping sets over one scan."""
    inside = rows.filter(F.col("ts").between(start, end))
    sums = [F.sum(c).alias(c) for c in (*COUNTERS, "unique_visitors")]
    both = inside.groupingSets([["ts", "vhost"], ["ts"]], "ts", "vhost")
    grouped = both.agg(F.grouping("vhost").alias("_all"), *sums, F.avg("latency_avg").alias("latency_avg"), *[F.max(c).alias(c) for c in ("latency_p95", "latency_p99")])
    named = grouped.withColumn("vhost", F.when(F.col("_all") == 1, "all").otherwise(F.col("vhost"))).drop("_all")
    return named.withColumn("rps", F.col("requests") / F.lit(width)).withColumn("error_rate", error_rate())


def summary(points: DataFrame, seconds: int) -> DataFrame:
    """One row for a series: totals, mean rate, mean of the positive mean latencies, error share, most visitors."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]
    s = points.agg(*sums, F.coalesce(F.avg(F.when(F.col("latency_avg") > 0, F.col("latency_avg"))), F.lit(0.0)).alias("latency_avg"), F.coalesce(F.max("unique_visitors"), F.lit(0)).alias("unique_visitors"))
    s = s.withColumn("avg_rps", F.col("requests") / F.lit(seconds)).withColumn("error_rate", E.ratio(F.col("s4xx") + F.col("s5xx"), classes_total(), 100.0))
    return s.select("requests", "avg_rps", "latency_avg", "error_rate", "bytes_in", "bytes_out", "unique_visitors", *CLIENTS, *BUCKETS)


def history_countries(rows: DataFrame, vhost: str, start: int, end: int, n: int = 10, share_of: str = "top") -> DataFrame:
    """The ``n`` countries with most requests; the share is of these (``top``) or of ``all``."""
    inside = rows.filter(F.col("ts").between(start, end))
    if vhost not in ("", "all", "_all"):
        inside = inside.filter(F.col("vhost") == vhost)
    totals = inside.groupBy("code").agg(F.sum("requests").alias("requests"), F.max("name").alias("name"), F.max("flag").alias("flag"))
    whole = F.sum("requests").over(Window.partitionBy())  # over one row per country
    first = lambda df: df.orderBy(F.col("requests").desc(), "code").limit(n)
    top = first(totals).withColumn("_all", whole) if share_of == "top" else first(totals.withColumn("_all", whole))
    return top.withColumn("pct", E.ratio(F.col("requests"), F.col("_all"), 100.0)).drop("_all")


def history_paths(rows: DataFrame, vhost: str, start: int, end: int, n: int = 10) -> DataFrame:
    """The ``n`` (vhost, path) with most requests: mean latency, share of 2xx, rate."""
    inside = rows.filter(F.col("ts").between(start, end))
    if vhost not in ("", "all", "_all"):
        inside = inside.filter(F.col("vhost") == vhost)
    totals = inside.groupBy("vhost", "path").agg(*[F.sum(c).alias(c) for c in ("requests", "total_time", "s2xx")])
    return _path_columns(totals.orderBy(F.col("requests").desc(), "vhost", "path").limit(n), start, end)


def _path_columns(top: DataFrame, start: int, end: int) -> DataFrame:
    return top.withColumn("avg_ms", F.col("total_time") / F.col("requests") * 1000).withColumn("ok_pct", E.ratio(F.col("s2xx"), F.col("requests"), 100.0)).withColumn("rps", F.col("requests") / F.lit(max(1, end - start)))


def merged_history(countries: DataFrame, start: int, end: int, n: int = 10) -> DataFrame:
    """All vhosts' ``n`` first countries of a time, summed up by code, and of these the ``n`` first; the share is of all codes met."""
    inside = countries.filter(F.col("ts").between(start, end))
    return merged_tops(inside.groupBy("vhost", "code").agg(F.sum("requests").alias("requests"), F.max("name").alias("name"), F.max("flag").alias("flag")), "requests", "code", n=n, share="pct")


def merged_paths(paths: DataFrame, start: int, end: int, n: int = 10) -> DataFrame:
    """Of all vhosts' ``n`` first paths of a time the ``n`` first: mean latency, share of 2xx, rate."""
    inside = paths.filter(F.col("ts").between(start, end)).groupBy("vhost", "path").agg(*[F.sum(c).alias(c) for c in ("requests", "total_time", "s2xx")])
    return _path_columns(merged_tops(inside, "requests", "vhost", "path", n=n), start, end)
