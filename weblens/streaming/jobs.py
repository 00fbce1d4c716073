"""Structured Streaming: windows with watermarks, tier sinks, the alert state machine.

Streams carry ``ts`` (timestamp) beside the epoch column ``sec``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weblens.operators import sketches, traffic
from weblens.operators.traffic import COUNTERS, counters, top_per
from weblens.sources import store


def per_window(requests: DataFrame, width: str, delay: str) -> DataFrame:
    """Counters and sketches per vhost and tumbling window; rows later than ``delay`` are dropped (and counted by Spark)."""
    keyed = requests.withWatermark("ts", delay).groupBy(F.window("ts", width), "vhost")
    rows = keyed.agg(*counters(), F.sum("req_time").alias("latency_sum"), F.hll_sketch_agg("addr", 12).alias("visitors"), F.expr("kll_sketch_agg_double(req_time)").alias("latency"))
    return rows.withColumn("ts", F.unix_seconds("window.start")).drop("window")


def per_second(requests: DataFrame, delay: str = "10 seconds") -> DataFrame:
    return per_window(requests, "1 second", delay)


def per_minute(requests: DataFrame, delay: str = "2 minutes") -> DataFrame:
    return per_window(requests, "1 minute", delay)


def live_feed(requests: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, width: str = "5 seconds", delay: str = "10 seconds"):
    """Start a query that hands the windows that changed to ``each`` once a second; a slow consumer gets them together."""
    rows = per_window(requests, width, delay)
    return rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(processingTime="1 second").foreachBatch(each).start()


class Recent:
    """Partial rows per second of a stream, under a path by hour and batch: read by hours, and gone after ``keep`` seconds."""

    def __init__(self, path: str, keep: int) -> None:
        self.path, self.keep = path.rstrip("/"), keep
        self.last: int | None = None  # the last second seen, after the first batch of a run

    def _hours(self, spark: SparkSession, table: str) -> list[int]:
        place, system = store.file_system(spark, f"{self.path}/{table}")
        names = [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []
        return sorted(int(n[5:]) for n in names if n.startswith("hour="))

    def put(self, rows: DataFrame, table: str, batch_id: int) -> None:
        """Keep a batch's rows; a batch that runs again replaces itself.  What is older than ``keep`` isn't kept."""
        if self.last is not None:
            rows = rows.filter(F.col("sec") > self.last - self.keep)
        kept = rows.withColumn("hour", F.floor(F.col("sec") / 3600).cast("long")).withColumn("batch", F.lit(batch_id))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour", "batch").parquet(f"{self.path}/{table}")

    def advance(self, spark: SparkSession, table: str) -> int | None:
        """The last second that is kept; hours beyond ``keep`` before it are deleted, in all tables given so far."""
        hours = self._hours(spark, table)
        if hours:
            found = spark.read.parquet(f"{self.path}/{table}").filter(F.col("hour") == hours[-1]).agg(F.max("sec")).first()[0]
            self.last = max(x for x in (self.last, found) if x is not None)
        return self.last

    def expire(self, spark: SparkSession, table: str) -> None:
        for hour in self._hours(spark, table):
            if (hour + 1) * 3600 <= self.last - self.keep:
                place, system = store.file_system(spark, f"{self.path}/{table}/hour={hour}")
                system.delete(place, True)

    def read(self, spark: SparkSession, table: str, seconds: int) -> DataFrame:
        """Rows of the last ``seconds``; only their hours are read."""
        since = self.last - seconds
        rows = spark.read.parquet(f"{self.path}/{table}")
        return rows.filter((F.col("hour") >= (since + 1) // 3600) & (F.col("sec") > since) & (F.col("sec") <= self.last))


def sliding_views(requests: DataFrame, each: Callable[[DataFrame, int], None], path: str, checkpoint: str, windows: tuple[int, ...] = (5, 60, 3600), delay: str = "10 seconds", trigger: dict | None = None):
    """Start a query that hands sliding views to ``each`` whenever seconds changed.

    The stream gives per-second partials, of which the latest of each second counts; they are kept by hour and batch
    under ``path`` for twice the longest window.  A view has, for every second within the longest window of the last
    one seen, the rate over the first window and all counters over each of ``windows`` seconds that end with it
    (<counter>_<seconds>).
    """
    longest = max(windows)
    kept = Recent(path, 2 * longest)

    def view(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept.put(batch.drop("visitors", "latency").withColumnRenamed("ts", "sec"), "seconds", batch_id)
        if kept.advance(spark, "seconds") is None:
            return
        recent = kept.read(spark, "seconds", 2 * longest)
        latest = recent.groupBy("vhost", "sec").agg(F.max_by(F.struct(*COUNTERS), "batch").alias("c")).select("vhost", "sec", "c.*")
        sums = []
        for window in windows:
            frame = Window.partitionBy("vhost").orderBy("sec").rangeBetween(-(window - 1), 0)  # of two longest windows' seconds
            sums += [F.sum(c).over(frame).alias(f"{c}_{window}") for c in COUNTERS]
        shown = latest.select("vhost", "sec", *sums).withColumn("rps", F.col(f"requests_{windows[0]}") / F.lit(windows[0]))
        each(shown.filter(F.col("sec") > kept.last - longest), batch_id)
        kept.expire(spark, "seconds")

    rows = per_second(requests, delay)
    writer = rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(view)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def live_views(requests: DataFrame, each: Callable[[dict[str, DataFrame], int], None], path: str, checkpoint: str, windows: tuple[int, ...] = (5, 60, 3600), n: int = 10, trigger: dict | None = None):
    """Start a query that hands live views of the last second seen to ``each``: {vhosts, paths, countries}.

    vhosts: for each of ``windows`` all counters, rate and distinct visitors (<name>_<seconds>), mean latency and
    percentiles; paths and countries: the ``n`` most requested of each vhost and window.  Every batch adds its own
    partials per second, however late its requests are, so no state is held; partials older than twice the longest
    window are deleted.  Requests have (code, name) where countries are wanted.
    """
    longest = max(windows)
    kept = Recent(path, 2 * longest)
    located = "code" in requests.columns

    def parts(batch: DataFrame) -> dict[str, DataFrame]:
        out = {
            "seconds": batch.groupBy("vhost", "sec").agg(*sketches.partial_columns()),
            "paths": batch.groupBy("vhost", "sec", "uri").agg(F.count("*").alias("count"), F.sum("req_time").alias("total_time"), F.sum("s2xx").cast("long").alias("s2xx")),
        }
        if located:
            out["countries"] = batch.filter("code != ''").groupBy("vhost", "sec", "code").agg(F.count("*").alias("count"), F.max("name").alias("name"))
        return out

    def top(rows: DataFrame, key: str, *columns) -> DataFrame:
        inside = F.filter(F.array(*[F.lit(w) for w in windows]), lambda w: F.col("sec") > F.lit(kept.last) - w)
        counted = rows.withColumn("window", F.explode(inside)).groupBy("vhost", "window", key).agg(F.sum("count").alias("count"), *columns)
        return top_per(counted, n, ["vhost", "window"], "count", key).withColumn("rps", F.col("count") / F.col("window"))

    def view(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = parts(batch)
        for table, rows in found.items():
            kept.put(rows, table, batch_id)
        if kept.advance(spark, "seconds") is None:
            return
        sums = []
        for w in windows:
            inside = lambda c, w=w: F.when(F.col("sec") > kept.last - w, F.col(c))
            sums += [F.coalesce(F.sum(inside(c)), F.lit(0)).alias(f"{c}_{w}") for c in (*COUNTERS, "latency_sum")]
            sums += [F.hll_union_agg(inside("visitors")).alias(f"_visitors_{w}"), F.expr(f"kll_merge_agg_double(CASE WHEN sec > {kept.last - w} THEN latency END)").alias(f"_latency_{w}")]
        vhosts = kept.read(spark, "seconds", longest).groupBy("vhost").agg(*sums)
        for w in windows:
            some = F.col(f"requests_{w}") > 0
            vhosts = vhosts.withColumns({
                f"rps_{w}": F.col(f"requests_{w}") / F.lit(w),
                f"visitors_{w}": F.when(some, F.hll_sketch_estimate(f"_visitors_{w}")).otherwise(0),
                f"latency_avg_{w}": F.when(some, F.col(f"latency_sum_{w}") / F.col(f"requests_{w}") * 1000).otherwise(0.0),
                f"latency_p95_{w}": F.when(some, F.expr(f"CASE WHEN requests_{w} > 0 THEN kll_sketch_get_quantile_double(_latency_{w}, 0.95D) END") * 1000).otherwise(0.0),
            }).drop(f"_visitors_{w}", f"_latency_{w}", f"latency_sum_{w}")
        views = {"vhosts": vhosts, "paths": top(kept.read(spark, "paths", longest), "uri", F.sum("total_time").alias("total_time"), F.sum("s2xx").alias("s2xx"))}
        if located:
            views["countries"] = top(kept.read(spark, "countries", longest), "code", F.max("name").alias("name"))
        each(views, batch_id)
        for table in found:
            kept.expire(spark, table)

    writer = requests.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(view)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


class Remembered:
    """A small table that each batch of a stream leaves for the next: of bounded size, under a path by batch.

    A batch that runs again finds what the one before it left, and replaces what it left itself.
    """

    def __init__(self, path: str, schema: str) -> None:
        self.path, self.schema = path.rstrip("/"), schema

    def _batches(self, spark: SparkSession) -> list[int]:
        place, system = store.file_system(spark, self.path)
        names = [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []
        return sorted(int(n[6:]) for n in names if n.startswith("batch="))

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        found = [b for b in self._batches(spark) if b < batch_id]
        return spark.read.schema(self.schema).parquet(f"{self.path}/batch={found[-1]}") if found else spark.createDataFrame([], self.schema)

    def leave(self, rows: DataFrame, batch_id: int) -> None:
        """Write the table of this batch, then drop all but that of the one before."""
        spark = rows.sparkSession
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        for old in [b for b in self._batches(spark) if b < batch_id][:-1]:
            place, system = store.file_system(spark, f"{self.path}/batch={old}")
            system.delete(place, True)


def capped_vhosts(each: Callable[[DataFrame, int], None], path: str, most: int = 50) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: hands on the requests of the first ``most`` vhosts seen, by batch, then by second and name."""
    admitted = Remembered(path, "vhost string")

    def view(batch: DataFrame, batch_id: int) -> None:
        known = admitted.before(batch.sparkSession, batch_id).withColumn("_first", F.lit(-1).cast("long"))
        new = batch.groupBy("vhost").agg(F.min("sec").alias("_first"))
        first = known.unionByName(new).groupBy("vhost").agg(F.min("_first").alias("_first")).orderBy("_first", "vhost").limit(most)
        admitted.leave(first.select("vhost"), batch_id)
        allowed = batch.sparkSession.read.schema(admitted.schema).parquet(f"{admitted.path}/batch={batch_id}")
        each(batch.join(F.broadcast(allowed), "vhost", "left_semi"), batch_id)  # ``most`` rows

    return view


def connection_rates(each: Callable[[DataFrame, int], None], path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch of parsed polls: hands on the rates between polls, the first of a batch against the last before it."""
    schema = "collected_at long, active long, accepts long, handled long, requests long, reading long, writing long, waiting long"
    last = Remembered(path, schema)

    def view(batch: DataFrame, batch_id: int) -> None:
        known = last.before(batch.sparkSession, batch_id)
        polls = known.unionByName(batch.select(*known.columns))
        each(traffic.connection_rates(polls), batch_id)
        last.leave(polls.orderBy(F.col("collected_at").desc()).limit(1), batch_id)

    return view


EVENT_SCHEMA = "name string, vhost string, state string, ts long, started_at long, value double"


class AlertMachine(StatefulProcessor):
    """One rule on one vhost: breach since when, last fired when, active or not.  Ticks may be uneven."""

    def __init__(self, cooldown: int) -> None:
        self.cooldown = cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alert", "since long, fired long, active boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        since, fired, active = self.state.get() if self.state.exists() else (-1, -1, False)
        out = []
        ticks = pd.concat(list(rows)).sort_values("ts")
        for ts, value, duration, breach in zip(ticks["ts"], ticks["value"], ticks["duration"], ticks["breach"]):
            ts = int(ts)
            if breach:
                since = ts if since < 0 else since
                if ts - since >= duration and (not active or ts - fired >= self.cooldown):
                    active, fired = True, ts
                    out.append((key[0], key[1], "firing", ts, ts, float(value)))
            else:
                since = -1
                if active:
                    active = False
                    out.append((key[0], key[1], "resolved", ts, fired, float(value)))
        self.state.update((since, fired, active))
        yield pd.DataFrame(out, columns=["name", "vhost", "state", "ts", "started_at", "value"])

    def close(self) -> None:
        pass


def alert_events(evaluated: DataFrame, cooldown: int) -> DataFrame:
    """Events of a stream of evaluated ticks (name, vhost, ts, value, duration, breach).  Needs the RocksDB state store."""
    return evaluated.groupBy("name", "vhost").transformWithStateInPandas(AlertMachine(cooldown), outputStructType=EVENT_SCHEMA, outputMode="Append", timeMode="None")
