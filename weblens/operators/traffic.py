"""Traffic aggregates per virtual host: per second, over trailing windows, per minute.

Time is event time in epoch seconds (``sec``); windows end at an explicit ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import expressions as E

CLASSES = ["s2xx", "s3xx", "s4xx", "s5xx"]
CLIENTS = ["bot_human", "bot_good", "bot_bad"]
BUCKETS = [f"lat_b{k}" for k in range(10)]
COUNTERS = ["requests", "bytes_in", "bytes_out", *CLASSES, *CLIENTS, *BUCKETS]


def clean(log: DataFrame, ignore_hosts: list[str] = (), ignore_paths: list[str] = ()) -> DataFrame:
    """Drop ignored hosts and paths, strip queries, mask addresses (the raw one stays as raw_addr), read upstream times."""
    kept = log.filter(E.kept_host(F.col("host"), list(ignore_hosts)) & E.kept_path(F.col("uri"), list(ignore_paths)))
    kept = kept.withColumn("raw_addr", F.col("addr")).withColumn("addr", E.anonymize(F.col("addr")))
    return kept.withColumn("uri", E.strip_query(F.col("uri"))).withColumn("upstream_time", E.upstream_seconds(F.col("upstream_time")))


def classified(log: DataFrame) -> DataFrame:
    """Requests with vhost, 0/1 columns for status classes, client classes and latency buckets."""
    client, bucket = F.col("_client"), F.col("_bucket")
    flags = {f"s{k}xx": E.status_class(F.col("status"), k * 100) for k in (2, 3, 4, 5)}
    flags |= {c: F.when(client == n, 1).otherwise(0) for c, n in zip(CLIENTS, ("human", "good_bot", "bad_bot"))}
    flags |= {b: F.when(bucket == k, 1).otherwise(0) for k, b in enumerate(BUCKETS)}
    rows = log.withColumns({"vhost": E.default_vhost(F.col("host")), "_client": E.client_class(F.col("ua")), "_bucket": E.latency_bucket(F.col("req_time"))})
    return rows.withColumns(flags).drop("_client", "_bucket")


def counters() -> list[Column]:
    """All additive counters of requests, in one pass."""
    return [F.count("*").alias("requests"), F.sum("req_len").alias("bytes_in"), F.sum("bytes").alias("bytes_out"), *[F.sum(c).cast("long").alias(c) for c in (*CLASSES, *CLIENTS, *BUCKETS)]]


def classes_total() -> Column:
    return F.col("s2xx") + F.col("s3xx") + F.col("s4xx") + F.col("s5xx")


def error_rate() -> Column:
    return E.ratio(F.col("s4xx") + F.col("s5xx"), classes_total(), 100.0)


def per_second(requests: DataFrame) -> DataFrame:
    """(vhost, sec, latency_sum, counters)."""
    return requests.groupBy("vhost", "sec").agg(F.sum("req_time").alias("latency_sum"), *counters())


def first_seen(requests: DataFrame) -> DataFrame:
    """(vhost, first, last): the seconds of the first and last request of every vhost.  A small table, to be kept."""
    return requests.groupBy("vhost").agg(F.min("sec").alias("first"), F.max("sec").alias("last"))


def zero_filled(seconds: DataFrame, seen: DataFrame, as_of: int, window: int | None = None) -> DataFrame:
    """(vhost, sec, latency_sum, counters) for every second from a vhost's first on, or of the last ``window``; zeros
    where there were no requests.  A vhost's seconds are listed by hours, so no row holds all of them."""
    begin = F.col("first") if window is None else F.greatest(F.col("first"), F.lit(as_of - window + 1))
    hour = F.explode(F.sequence(E.bucket_start(F.col("_begin"), 3600), F.lit(as_of).cast("long"), F.lit(3600).cast("long")))
    hours = seen.select("vhost", begin.cast("long").alias("_begin")).filter(F.col("_begin") <= as_of).withColumn("_hour", hour)
    second = F.explode(F.sequence(F.greatest("_begin", "_hour"), F.least(F.lit(as_of).cast("long"), F.col("_hour") + 3599)))
    rows = hours.select("vhost", second.alias("sec")).join(seconds, ["vhost", "sec"], "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0).cast(t)) for c, t in rows.dtypes if c not in ("vhost", "sec")})


def live(recent: DataFrame, seen: DataFrame, as_of: int, window: int = 5) -> DataFrame:
    """Rates of the last ``window`` seconds per vhost; a vhost seen before without requests now has zeros.

    ``recent`` need hold no more than those seconds; when vhosts were first seen is a table of its own.
    """
    sums = ("requests", "bytes_in", "bytes_out", *CLASSES)
    now = trailing(recent, as_of, window).groupBy("vhost").agg(*[F.sum(c).alias(c) for c in sums])
    rows = seen.filter(F.col("first") <= as_of).select("vhost", "first").join(now, "vhost", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in sums})
    span = F.least(F.lit(window), F.lit(as_of) - F.col("first") + 1)
    return rows.select("vhost", (F.col("requests") / span).alias("rps"), error_rate().alias("error_rate"), "bytes_in", "bytes_out", *CLASSES)


def trailing(requests: DataFrame, as_of: int, window: int) -> DataFrame:
    """Requests of the ``window`` seconds up to ``as_of``."""
    return requests.filter((F.col("sec") > as_of - window) & (F.col("sec") <= as_of))


def quantiles(requests: DataFrame, *keys: str) -> DataFrame:
    """Exact p50, p95, p99 and mean latency in milliseconds.

    Equal latencies are counted first, by latency, so what meets at a group is its different values
    with their numbers; servers write latencies in milliseconds.
    """
    counted = requests.groupBy(*keys, "req_time").agg(F.count("*").alias("_n"))
    q = F.percentile("req_time", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.col("_n"))
    grouped = counted.groupBy(*keys).agg(q.alias("_q"), (F.sum(F.col("req_time") * F.col("_n")) / F.sum("_n")).alias("_avg"))
    return grouped.select(*keys, *[(F.col("_q")[k] * 1000).alias(n) for k, n in enumerate(("latency_p50", "latency_p95", "latency_p99"))], (F.col("_avg") * 1000).alias("latency_avg"))


def path_stats(requests: DataFrame, window: int, *keys: str) -> DataFrame:
    """count, rps, mean latency and share of 2xx per path of what is given."""
    grouped = requests.groupBy(*keys, "uri").agg(F.count("*").alias("count"), F.sum("req_time").alias("total_time"), F.sum("s2xx").cast("long").alias("s2xx"))
    return grouped.withColumn("rps", F.col("count") / F.lit(window)).withColumn("avg_ms", F.col("total_time") / F.col("count") * 1000).withColumn("ok_pct", E.ratio(F.col("s2xx"), F.col("count"), 100.0))


def _number(rows: DataFrame) -> Column:
    """The number of requests: of rows that stand for several, ``n`` has it."""
    return F.sum("n") if "n" in rows.columns else F.count("*")


def country_stats(located: DataFrame, window: int, *keys: str) -> DataFrame:
    """count, rps and share of all countries' requests (or numbers ``n`` of them); requests without country are not
    counted.  Name and flag come along."""
    grouped = located.filter("code != ''").groupBy(*keys, "code").agg(_number(located).alias("count"), F.max("name").alias("name"))
    share = F.col("count") / F.sum("count").over(Window.partitionBy(*keys)) * 100
    return grouped.withColumn("rps", F.col("count") / F.lit(window)).withColumn("pct", share).withColumn("flag", E.country_flag(F.col("code")))


def top_per(df: DataFrame, n: int, keys: list[str], by: str, tie: str) -> DataFrame:
    """The ``n`` rows of each key with the largest ``by``; ties by ``tie``.  n <= 0 keeps all."""
    if n <= 0:
        return df
    order = Window.partitionBy(*keys).orderBy(F.col(by).desc(), F.col(tie))
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")


def minute_metrics(requests: DataFrame, exact: bool = True, seconds: int = 60) -> DataFrame:
    """The minute tier: (ts, vhost, counters, latency, visitors).

    ``exact`` keeps every value of a group to sort it; otherwise sketches bound a group's memory.
    """
    keyed = requests.withColumn("ts", E.bucket_start(F.col("sec"), seconds))
    if exact:
        q = F.percentile("req_time", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
        visitors = F.countDistinct("addr")
    else:
        q = F.percentile_approx("req_time", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.lit(1000))
        visitors = F.approx_count_distinct("addr", 0.02)
    rows = keyed.groupBy("ts", "vhost").agg(*counters(), F.avg("req_time").alias("_avg"), q.alias("_q"), visitors.alias("unique_visitors"))
    named = {f"latency_{n}": F.col("_q")[k] * 1000 for k, n in enumerate(("p50", "p95", "p99"))}
    return rows.withColumns({"latency_avg": F.col("_avg") * 1000, **named}).drop("_avg", "_q")


def minute_paths(requests: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` most requested paths of each minute and vhost; empty paths don't count."""
    keyed = requests.filter("uri != ''").withColumn("ts", E.bucket_start(F.col("sec"), 60))
    grouped = keyed.groupBy("ts", "vhost", F.col("uri").alias("path")).agg(F.count("*").alias("requests"), F.sum("req_time").alias("total_time"), F.sum("s2xx").cast("long").alias("s2xx"))
    return top_per(grouped, n, ["ts", "vhost"], "requests", "path")


def minute_countries(located: DataFrame) -> DataFrame:
    """All countries of each minute and vhost, of requests or of numbers ``n`` of them."""
    keyed = located.filter("code != ''").withColumn("ts", E.bucket_start(F.col("sec"), 60))
    grouped = keyed.groupBy("ts", "vhost", "code").agg(_number(located).alias("requests"), F.max("name").alias("name"))
    return grouped.withColumn("flag", E.country_flag(F.col("code")))


def second_history(filled: DataFrame, vhost: str, as_of: int, window: int = 3600) -> DataFrame:
    """Per-second series of one vhost from zero-filled seconds: requests, error %, bytes, mean latency (ms), counters."""
    own = trailing(filled.filter(F.col("vhost") == vhost), as_of, window)
    return own.select("sec", "requests", error_rate().alias("error_rate"), "bytes_in", "bytes_out", E.ratio(F.col("latency_sum"), F.col("requests"), 1000.0).alias("latency_avg"), *CLASSES, *CLIENTS, *BUCKETS)


def side_by_side(*rows: DataFrame) -> DataFrame:
    """The columns of several tables of one row each (or none) as one row, without a join."""
    whole = rows[0]
    for other in rows[1:]:
        whole = whole.unionByName(other, allowMissingColumns=True)
    return whole.agg(*[F.first(c, ignorenulls=True).alias(c) for c in whole.columns])


def second_summary(history: DataFrame, visitors: DataFrame, window: int = 3600) -> DataFrame:
    """One row over a per-second series: totals, the error share of all requests, the mean of the busy seconds' mean latencies.

    ``visitors`` has one row (visitors).
    """
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]
    s = history.agg(*sums, F.coalesce(F.avg(F.when(F.col("requests") > 0, F.col("latency_avg"))), F.lit(0.0)).alias("latency_avg"))
    s = s.withColumn("avg_rps", F.col("requests") / F.lit(window)).withColumn("error_rate", E.ratio(F.col("s4xx") + F.col("s5xx"), F.col("requests"), 100.0))
    return side_by_side(s, visitors.select("visitors"))


def all_seconds(filled: DataFrame) -> DataFrame:
    """All vhosts' series as one, by time: requests and bytes add up, of the mean latencies the largest counts."""
    latency = E.ratio(F.col("latency_sum"), F.col("requests"), 1000.0)
    sums = [F.sum(c).alias(c) for c in ("requests", "bytes_in", "bytes_out", *CLASSES, *CLIENTS, *BUCKETS)]
    return filled.withColumn("_latency", latency).groupBy("sec").agg(*sums, F.max("_latency").alias("latency_avg")).withColumn("error_rate", error_rate())


def all_summary(series: DataFrame, visitors: DataFrame, window: int = 3600) -> DataFrame:
    """One row for all vhosts: totals, rate, the error share of the classes' sum; ``visitors`` has a row per vhost, which add up."""
    s = series.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])
    s = s.withColumn("avg_rps", F.col("requests") / F.lit(window)).withColumn("error_rate", error_rate())
    return side_by_side(s, visitors.agg(F.coalesce(F.sum("visitors"), F.lit(0)).alias("visitors")))


def merged_tops(rows: DataFrame, by: str, *ties: str, n: int = 10, share: str | None = None) -> DataFrame:
    """Of the vhosts' ``n`` first rows each, the ``n`` first; with ``share`` each one's part of all of them in percent."""
    each = top_per(rows, n, ["vhost"], by, ties[-1])
    if share:
        each = each.groupBy(*ties).agg(*[F.sum(c).alias(c) for c in {by, "rps"} & set(each.columns)], *[F.max(c).alias(c) for c in ("name", "flag") if c in each.columns])
        each = each.withColumn(share, E.ratio(F.col(by), F.sum(by).over(Window.partitionBy()), 100.0))  # over n rows a vhost at most
    return each.orderBy(F.col(by).desc(), *ties).limit(n)


DAY = 86400


def in_days(rows: DataFrame, back: int, sec: str = "sec") -> DataFrame:
    """Rows with _day, the day they are worked on in, and _own: false for those of the ``back`` seconds before it.

    A window over (vhost, _day) then sees what a window over a vhost's whole life would, a day a task.
    """
    day = F.explode(F.sequence(F.floor(F.col(sec) / DAY), F.floor((F.col(sec) + back) / DAY)))
    return rows.withColumn("_day", day).withColumn("_own", F.col("_day") == F.floor(F.col(sec) / DAY))


def trailing_rates(seconds: DataFrame, seen: DataFrame, window: int = 5) -> DataFrame:
    """For every second given, the rate of the ``window`` seconds that end with it; ``seen`` tells each vhost's first."""
    frame = Window.partitionBy("vhost", "_day").orderBy("sec").rangeBetween(-(window - 1), 0)
    sums = in_days(seconds.select("vhost", "sec", "requests"), window - 1).withColumn("_sum", F.sum("requests").over(frame)).filter("_own")
    rows = sums.join(seen.select("vhost", "first"), "vhost")
    return rows.select("vhost", "sec", (F.col("_sum") / F.least(F.lit(window), F.col("sec") - F.col("first") + 1)).alias("rps"))


def trailing_counts(seconds: DataFrame, columns: list[str], window: int) -> DataFrame:
    """For every second given, sums of the columns (whole numbers) over the ``window`` seconds that end with it.

    A second's counts come in at its time and go out ``window`` seconds later, so that one running sum over a day
    has them all and a row costs the same however long the window is.
    """
    rows = in_days(seconds.select("vhost", "sec", *columns), window - 1)
    comes = F.struct(F.col("sec").alias("at"), F.lit(1).alias("sign"))
    goes = F.struct((F.col("sec") + window).alias("at"), F.lit(-1).alias("sign"))
    edges = rows.withColumn("_e", F.explode(F.array(comes, goes))).filter(F.floor(F.col("_e.at") / DAY) <= F.col("_day"))
    edges = edges.select("vhost", "_day", F.col("_e.at").alias("sec"), (F.col("_own") & (F.col("_e.sign") > 0)).alias("_own"), *[(F.col(c) * F.col("_e.sign")).alias(c) for c in columns])
    frame = Window.partitionBy("vhost", "_day").orderBy("sec").rangeBetween(Window.unboundedPreceding, 0)
    return edges.select("vhost", "sec", "_own", *[F.sum(c).over(frame).alias(c) for c in columns]).filter("_own").drop("_own")


def latest_points(series: DataFrame, n: int = 60, key: str = "vhost", ts: str = "ts") -> DataFrame:
    """The last ``n`` points of each series."""
    order = Window.partitionBy(key).orderBy(F.col(ts).desc())
    return series.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")


def all_mean(live_rows: DataFrame) -> DataFrame:
    """All vhosts as one for alerts and the terminal: sums (visitors too, where given), and the mean of the vhosts' latencies."""
    summed = ("rps", "bytes_in", "bytes_out", *CLASSES, *[c for c in ("visitors",) if c in live_rows.columns])
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in summed]
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("latency_avg", "latency_p50", "latency_p95", "latency_p99")]
    return live_rows.agg(*sums, *means).withColumn("error_rate", error_rate())


def shares(live_rows: DataFrame, clients: DataFrame) -> DataFrame:
    """Per vhost the share of each status class, of each client class (``clients`` has their counts), of the busiest
    vhost's rate and of all requests.  Windows over all rows are over one row per vhost."""
    every, total = Window.partitionBy(), classes_total()
    rows = live_rows.join(clients.select("vhost", *CLIENTS), "vhost", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in CLIENTS})
    visits = sum((F.col(c) for c in CLIENTS[1:]), F.col(CLIENTS[0]))
    return rows.select(
        "vhost",
        *[E.ratio(F.col(c), total, 100.0).alias(f"{c}_pct") for c in CLASSES],
        *[E.ratio(F.col(c), visits, 100.0).alias(f"{c}_pct") for c in CLIENTS],
        E.ratio(F.col("rps"), F.max("rps").over(every), 100.0).alias("of_busiest"),
        E.ratio(total, F.sum(total).over(every), 100.0).alias("of_all"),
    )


def all_weighted(live_rows: DataFrame) -> DataFrame:
    """All vhosts as one for the web view: error share weighted by rate, percentiles by maximum, mean latency weighted by
    rate (weight 1 where the rate is 0) over the vhosts that have one."""
    weight = F.when(F.col("rps") > 0, F.col("rps")).otherwise(1.0)
    timed = F.when(F.col("latency_avg") > 0, weight)
    return live_rows.agg(
        F.sum("rps").alias("rps"),
        E.ratio(F.sum(F.col("error_rate") * F.col("rps")), F.sum("rps")).alias("error_rate"),
        *[F.max(c).alias(c) for c in ("latency_p50", "latency_p95", "latency_p99")],
        F.coalesce(F.sum(F.col("latency_avg") * timed) / F.sum(timed), F.lit(0.0)).alias("latency_avg"),
    )


def capped_vhosts(requests: DataFrame, most: int = 50) -> DataFrame:
    """Requests of the first ``most`` vhosts seen."""
    first = requests.groupBy("vhost").agg(F.min("sec").alias("_first")).orderBy("_first", "vhost").limit(most)
    return requests.join(F.broadcast(first.select("vhost")), "vhost", "left_semi")


def connection_rates(status: DataFrame) -> DataFrame:
    """Per second between polls: connections, requests; and connections dropped so far.

    Polls go through hourly groups, of which each knows the last poll of the one before.
    """
    hours = status.withColumn("_hour", E.bucket_start(F.col("collected_at"), 3600))
    last = hours.groupBy("_hour").agg(F.max_by(F.struct("collected_at", "accepts", "requests"), "collected_at").alias("_last"))
    before = last.withColumn("_before", F.lag("_last").over(Window.orderBy("_hour"))).select("_hour", "_before")
    order = Window.partitionBy("_hour").orderBy("collected_at")
    own = hours.join(before, "_hour").withColumn("_prev", F.coalesce(F.lag(F.struct("collected_at", "accepts", "requests")).over(order), "_before"))
    gap = F.col("collected_at") - F.col("_prev.collected_at")
    # a counter that is smaller than before has begun anew
    grown = lambda c: F.when(F.col(c) < F.col(f"_prev.{c}"), F.col(c)).otherwise(F.col(c) - F.col(f"_prev.{c}"))
    rates = [(grown(c) / gap).alias(n) for c, n in (("accepts", "conn_rate"), ("requests", "request_rate"))]
    return own.filter("_prev is not null").select("collected_at", *rates, (F.col("accepts") - F.col("handled")).alias("dropped"))
