"""Streams give what the batch operators give."""

from weblens.operators import alerts, traffic
from weblens.plans import catalog
from weblens.sources import adapters, parsers, sinks
from weblens.streaming import jobs


def drained(stream, tmp_path, name, batch=None):
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True)
    writer = writer.foreachBatch(batch) if batch else writer.format("parquet").option("path", str(tmp_path / name))
    query = writer.start()
    query.awaitTermination(120)
    assert query.exception() is None
    return query


def test_minutes_of_a_stream(spark, sf_dir, tmp_path):
    adapters.log_lines(spark, sf_dir).select("value").repartitionByRange(4, "value").write.text(str(tmp_path / "in"))
    end = '{"ts":"2025-01-01T00:00:00Z","host":"end"}'
    spark.createDataFrame([(end,)], "value string").write.mode("append").text(str(tmp_path / "in"))
    clean = lambda lines: traffic.classified(traffic.clean(parsers.parse_access_log(lines)))
    stream = jobs.per_minute(clean(parsers.read_lines(spark, str(tmp_path / "in"), streaming=True)), "400 days")
    batch = traffic.minute_metrics(clean(parsers.read_lines(spark, str(tmp_path / "in")))).select("ts", "vhost", "requests", "s4xx", "lat_b3")
    drained(stream, tmp_path, "minutes", sinks.batch_sink(str(tmp_path / "minutes"), "1m"))
    # rows stay in state until the watermark passes; with none late, a second source of time closes them
    later = '{"ts":"2027-01-01T00:00:00Z","host":"end"}'
    spark.createDataFrame([(later,)], "value string").write.mode("append").text(str(tmp_path / "in"))
    drained(stream, tmp_path, "minutes", sinks.batch_sink(str(tmp_path / "minutes"), "1m"))
    got = spark.read.parquet(str(tmp_path / "minutes")).filter("vhost != 'end'").select(*batch.columns)
    want = batch.filter("vhost != 'end'")
    assert want.count() == got.count() > 1000
    assert got.exceptAll(want).count() == 0


def test_alerts_of_a_stream(spark, sf_dir, tmp_path):
    evaluated = catalog._evaluated(spark, sf_dir)
    rows = evaluated.select("name", "vhost", "ts", "value", "duration", "breach").cache()
    rows.coalesce(1).write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ticks"))
    drained(jobs.alert_events(stream, catalog.COOLDOWN), tmp_path, "events")
    columns = ["name", "vhost", "state", "ts", "started_at"]
    got = spark.read.parquet(str(tmp_path / "events")).select(*columns)
    want = alerts.events(evaluated, cooldown=catalog.COOLDOWN).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 10
    assert set(r["state"] for r in got.select("state").distinct().collect()) == {"firing", "resolved"}


def test_live_feed_hands_over_changes(spark, sf_dir, tmp_path):
    adapters.log_lines(spark, sf_dir).select("value").limit(200).write.text(str(tmp_path / "in"))
    stream = traffic.classified(traffic.clean(parsers.parse_access_log(parsers.read_lines(spark, str(tmp_path / "in"), streaming=True))))
    seen = []
    query = jobs.live_feed(stream, lambda df, _: seen.append(df.selectExpr("sum(requests)").first()[0]), str(tmp_path / "cp"), delay="400 days")
    query.processAllAvailable()
    query.stop()
    assert sum(x or 0 for x in seen) == parsers.parse_access_log(parsers.read_lines(spark, str(tmp_path / "in"))).count()


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    lines = lambda *at: [(f'{{"ts":"2024-01-01T00:{m:02d}:30Z","host":"h","status":200}}',) for m in at]
    clean = lambda df: traffic.classified(traffic.clean(parsers.parse_access_log(df)))
    progress = []
    for batch in ([1, 2, 30], [3, 31], [40]):  # minute 3 comes when the watermark stands at 28
        spark.createDataFrame(lines(*batch), "value string").coalesce(1).write.mode("append").text(str(tmp_path / "in"))
        stream = jobs.per_minute(clean(parsers.read_lines(spark, str(tmp_path / "in"), streaming=True)), "2 minutes")
        query = drained(stream, tmp_path, "late")
        progress += query.recentProgress
    got = sorted((r["ts"] - 1704067200) // 60 for r in spark.read.parquet(str(tmp_path / "late")).collect())
    assert 3 not in got and {1, 2, 30} <= set(got)
    dropped = sum(op["numRowsDroppedByWatermark"] for p in progress for op in (p["stateOperators"] if isinstance(p, dict) else p.stateOperators and [vars(o) | {"numRowsDroppedByWatermark": o.numRowsDroppedByWatermark} for o in p.stateOperators]))
    assert dropped == 1


def test_sliding_views_of_a_stream(spark, sf_dir, tmp_path):
    log = adapters.access_log(spark, sf_dir, True).filter("event_id < 3000")
    rows = traffic.classified(traffic.clean(log)).withColumn("ts", log["sec"].cast("timestamp"))
    rows.repartitionByRange(3, "sec").sortWithinPartitions("sec").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = {}

    def each(df, batch_id):
        for r in df.collect():
            seen[r["vhost"], r["sec"]] = (r["requests_5"], r["requests_60"], r["s4xx_60"], r["rps"])

    query = jobs.sliding_views(stream, each, str(tmp_path / "seconds"), str(tmp_path / "cp"), windows=(5, 60), delay="400 days", trigger={"availableNow": True})
    query.awaitTermination(300)
    assert query.exception() is None
    seconds = traffic.per_second(rows)
    five, sixty = (traffic.trailing_counts(seconds, ["requests", "s4xx"], n) for n in (5, 60))
    want = {(r["vhost"], r["sec"]): [r["requests"]] for r in five.collect()}
    for r in sixty.collect():
        want[r["vhost"], r["sec"]] += [r["requests"], r["s4xx"]]
    last = max(s for _, s in want)
    recent = {k: v for k, v in want.items() if k[1] > last - 60}
    assert len(recent) > 100 and all(seen[k] == (v[0], v[1], v[2], v[0] / 5) for k, v in recent.items())


def test_live_views_of_a_stream(spark, sf_dir, tmp_path):
    """Visitors, paths and countries over 5 s, 60 s and 1 h equal the batch queries; old partials are gone."""
    import os

    from pyspark.sql import functions as F

    log = adapters.access_log(spark, sf_dir.replace("sf0.01", "sf0.001"), True)
    # the log's begin comes once more as if four hours before, in the first batch
    early = log.filter("event_id < 200").withColumn("sec", F.col("sec") - 4 * 3600)
    rows = traffic.classified(traffic.clean(early.withColumn("_b", F.lit(0)).unionByName(log.withColumn("_b", 1 + F.col("event_id") % 2))))
    located = catalog.geo.locate(rows, adapters.ip_ranges(spark, sf_dir), "raw_addr", adapters.ip6_ranges(spark, sf_dir))
    for k in range(3):
        located.filter(F.col("_b") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(located.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last = {}

    def each(views, batch_id):
        last.update({name: df.collect() for name, df in views.items()})

    query = jobs.live_views(stream, each, str(tmp_path / "parts"), str(tmp_path / "cp"), trigger={"availableNow": True})
    query.awaitTermination(300)
    assert query.exception() is None
    end = log.agg(F.max("sec")).first()[0]
    for w in (5, 60, 3600):
        own = traffic.trailing(located, end, w)
        want = {r["vhost"]: (r["n"], r["s"], r["v"]) for r in own.groupBy("vhost").agg(F.count("*").alias("n"), F.sum("s4xx").alias("s"), F.countDistinct("addr").alias("v")).collect()}
        got = {r["vhost"]: (r[f"requests_{w}"], r[f"s4xx_{w}"], r[f"visitors_{w}"]) for r in last["vhosts"] if r[f"requests_{w}"]}
        assert got == want and want
        paths = traffic.top_per(traffic.path_stats(own, w, "vhost"), 10, ["vhost"], "count", "uri")
        assert sorted((r["vhost"], r["uri"], r["count"], r["s2xx"], r["rps"]) for r in last["paths"] if r["window"] == w) == sorted(map(tuple, paths.select("vhost", "uri", "count", "s2xx", "rps").collect()))
        countries = traffic.top_per(traffic.country_stats(own, w, "vhost"), 10, ["vhost"], "count", "code")
        assert sorted((r["vhost"], r["code"], r["count"], r["name"]) for r in last["countries"] if r["window"] == w) == sorted(map(tuple, countries.select("vhost", "code", "count", "name").collect()))
    for table in ("seconds", "paths", "countries"):
        hours = [int(x[5:]) for x in os.listdir(tmp_path / "parts" / table) if x.startswith("hour=")]
        assert hours and all((h + 1) * 3600 > end - 7200 for h in hours)


class _Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_events_at_any_ticks_are_those_of_the_machine(spark):
    """Ticks with gaps, absent vhosts, breaches over midnight: pointers find what the state machine emits."""
    import random

    import pandas as pd

    rng, rows = random.Random(4), []
    for vhost in ("a", "b", "c"):
        ts, bad = 1704067200 + 86400 - 4000, False
        for _ in range(900):
            ts += rng.choice([1, 3, 5, 5, 5, 8, 40, 900 if rng.random() < 0.02 else 5])
            bad = not bad if rng.random() < 0.03 else bad
            rows.append(("r", vhost, "error_rate", 1.0, 12, ts, float(ts % 50), 5, 1, bad))
    schema = "name string, vhost string, metric string, threshold double, duration int, ts long, value double, total long, errors long, breach boolean"
    got = alerts.events(spark.createDataFrame(rows, schema), tick=None, cooldown=61)
    got = sorted((r["name"], r["vhost"], r["state"], r["ts"], r["started_at"], r["value"]) for r in got.collect())
    want = []
    for vhost in ("a", "b", "c"):
        machine, state = jobs.AlertMachine(61), _Value()
        machine.state = state
        own = pd.DataFrame([r for r in rows if r[1] == vhost], columns=[c.split(" ")[0] for c in schema.split(", ")])
        for half in (own.iloc[:400], own.iloc[400:]):
            for out in machine.handleInputRows(("r", vhost), iter([half]), None):
                want += [tuple(r) for r in out.itertuples(index=False)]
    assert got == sorted(want) and len(got) > 100


def _batches(spark, tmp_path, parts):
    """A stream of one file a batch, in the order given."""
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k:03d}"))
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def test_vhosts_admitted_by_a_stream(spark, sf_dir, tmp_path):
    """The first vhosts seen stay admitted over batches and restarts, and are those of the whole log."""
    rows = traffic.classified(traffic.clean(adapters.access_log(spark, sf_dir.replace("sf0.01", "sf0.001"), True)))
    edge = 1704067200 + 20
    parts = [rows.filter(f"sec < {edge} AND vhost IN ('www.example.com', 'blog.example.com')"), rows.filter(f"sec < {edge} AND vhost = 'api.example.com'"), rows.filter(f"sec >= {edge}")]
    got = []
    for k in range(3):  # a query of its own for each batch: restarts
        stream = _batches(spark, tmp_path / str(k), [parts[k]])
        run = jobs.capped_vhosts(lambda df, _: got.append({r["vhost"]: r["count"] for r in df.groupBy("vhost").count().collect()}), str(tmp_path / "admitted"), 2)
        offset = lambda df, i, run=run, k=k: run(df, 10 * k + i)
        query = stream.writeStream.foreachBatch(offset).option("checkpointLocation", str(tmp_path / f"cp{k}")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    want = {r["vhost"]: r["count"] for r in traffic.capped_vhosts(whole.withColumn("sec", whole["sec"]), 2).groupBy("vhost").count().collect()}
    assert set(want) == {"www.example.com", "blog.example.com"} or len(want) == 2
    total = {}
    for part in got:
        for vhost, n in part.items():
            total[vhost] = total.get(vhost, 0) + n
    assert set(total) == {"www.example.com", "blog.example.com"} and not got[1]


def test_connection_rates_of_a_stream(spark, sf_dir, tmp_path):
    """Rates over batches are those of the whole; a counter that begins anew gives no negative rate."""
    polls = parsers.parse_conn_status(adapters.conn_status(spark, sf_dir)).orderBy("collected_at")
    times = [r["collected_at"] for r in polls.select("collected_at").collect()]
    cuts = [times[len(times) // 3], times[2 * len(times) // 3]]
    polls = polls.selectExpr("collected_at", "active", f"IF(collected_at >= {cuts[1]}, accepts % 1000, accepts) AS accepts", "handled", f"IF(collected_at >= {cuts[1]}, requests % 1000, requests) AS requests", "reading", "writing", "waiting")
    parts = [polls.filter(f"collected_at < {cuts[0]}"), polls.filter(f"collected_at >= {cuts[0]} AND collected_at < {cuts[1]}"), polls.filter(f"collected_at >= {cuts[1]}")]
    got = []
    run = jobs.connection_rates(lambda df, _: got.extend(df.collect()), str(tmp_path / "last"))
    for k, part in enumerate(parts):
        run(part, k)
    want = traffic.connection_rates(polls).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == len(times) - 1
    assert all(r["conn_rate"] >= 0 and r["request_rate"] >= 0 for r in want)


def test_log_lines_of_files(spark, tmp_path):
    """The source gives whole lines, in a batch and as a stream."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text('{"ts":"2024-01-01T00:00:00Z","host":"h"}\nnothing\n')
    assert parsers.read_lines(spark, str(tmp_path / "in")).count() == 2
    drained(parsers.read_lines(spark, str(tmp_path / "in"), streaming=True), tmp_path, "lines")
    assert sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "lines")).collect())[0] == "nothing"
