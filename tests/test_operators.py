"""Small literal cases of the operators."""

import pytest
from pyspark.sql import functions as F

from weblens.functions import expressions as E
from weblens.operators import alerts, geo, sketches, tiers, traffic
from weblens.sources import adapters, parsers, sinks


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def requests(spark, rows):
    """rows: (host, sec, uri, status, seconds, ua)"""
    log = spark.createDataFrame([(*r, f"10.0.0.{k % 200}", 100, 50) for k, r in enumerate(rows)], "host string, sec long, uri string, status int, req_time double, ua string, addr string, bytes long, req_len long")
    return traffic.classified(log)


def test_latency_buckets(spark):
    values = [0.002, 0.009, 0.010, 0.019, 0.020, 0.049, 0.050, 0.099, 0.100, 0.199, 0.200, 0.499, 0.500, 0.999, 1.000, 1.999, 2.000, 4.999, 5.000, 12.34]
    assert column(spark, values, "double", E.latency_bucket) == [k for k in range(10) for _ in (0, 1)]


def test_client_classes(spark):
    cases = dict(zip(adapters.AGENTS, ["human", "good_bot", "bad_bot", "bad_bot", "bad_bot", "bad_bot", "good_bot", "bad_bot", "human", "good_bot"]))
    assert column(spark, list(cases), "string", E.client_class) == list(cases.values())
    assert column(spark, [None, "Nikto/2.1", "Mozilla/5.0 (iPhone) Safari", "my-Spider"], "string", E.client_class) == ["bad_bot", "bad_bot", "human", "good_bot"]


def test_flags(spark):
    assert column(spark, ["DK", "dk", " us ", "", "XYZ", "12"], "string", E.country_flag) == ["🇩🇰", "🇩🇰", "🇺🇸", "🌐", "🌐", "🌐"]


def test_addresses(spark):
    assert column(spark, ["1.2.3.4", "::1", "x"], "string", E.anonymize) == ["1.2.3.0", "::1", "x"]
    assert column(spark, ["2001:db8:1::7", "1.2.3.4"], "string", lambda c: E.anonymize(c, 32)) == ["2001:db8::", "1.2.3.0"]
    assert column(spark, ["0.0.1.2", "255.255.255.255", "1.2.3", "1.2.3.256"], "string", E.ipv4_number) == [258, 4294967295, None, None]
    assert column(spark, ["8.8.8.8", "10.1.1.1", "127.0.0.1", "192.168.0.1", "172.16.0.1", "172.32.0.1", "169.254.1.1", "::1", "fe80::1", "2001:db8::1", "", None], "string", E.routable) == [True, False, False, False, False, True, False, False, False, True, False, False]


def test_upstream_times(spark):
    assert column(spark, ["0.125", "-", "", "0.1, 0.2", None], "string", E.upstream_seconds) == [0.125, 0, 0, 0, 0]


def test_ranges():
    assert [E.range_seconds(x) for x in ("1m", "15min", "6h", "day", "7d", "month", "live", "")] == [60, 900, 21600, 86400, 604800, 2592000, 3600, 3600]


def test_ignored_hosts_and_paths(spark):
    rows = spark.createDataFrame([("stats.example.org", "/"), ("example.com", "/api/v1/alerts"), ("example.com", "/index.html?x=1")], "host string, uri string")
    kept = rows.filter(E.kept_host(F.col("host"), ["  STATS.example.org", ""]) & E.kept_path(F.col("uri"), ["/api/v1/", " "]))
    assert [r["uri"] for r in kept.select(E.strip_query(F.col("uri")).alias("uri")).collect()] == ["/index.html"]


def test_access_log_lines(spark):
    good = '<190>Jan 1 web: {"ts":"2024-01-01T00:00:00Z","host":"h","status":200,"extra":1}'
    bad = ["no object", '{"ts":"2024-01-01T00:00:00Z","host"', '{"ts":"2024-01-01T00:00:00Z","status":"200"}', '{"ts":"2024-01-01T00:00:00Z","bytes":1.5}', '{"ts":"never"}', '{"host":"h"}', ""]
    rows = parsers.parse_access_log(spark.createDataFrame([(x,) for x in [good, *bad]], "value string")).collect()
    assert [(r["host"], r["status"], r["uri"], r["sec"], r["req_time"]) for r in rows] == [("h", 200, "", 1704067200, 0.0)]


def test_connection_status(spark):
    text = "Active connections: 291 \nserver accepts handled requests\n 16630948 16630948 31070465 \nReading: 6 Writing: 179 Waiting: 106 "
    polls = spark.createDataFrame([(1, text), (2, "invalid data"), (3, "")], "collected_at long, body string")
    assert [tuple(r) for r in parsers.parse_conn_status(polls).collect()] == [(1, 291, 16630948, 16630948, 31070465, 6, 179, 106)]


def test_quantiles(spark):
    rows = requests(spark, [("h", 1, "/", 200, float(v), "") for v in range(1, 101)])
    q = traffic.quantiles(rows, "vhost").first()
    assert q["latency_p50"] == pytest.approx(50500, abs=5000) and q["latency_p95"] == pytest.approx(95000, abs=5000) and q["latency_avg"] == pytest.approx(50500)


def test_visitors(spark):
    rows = spark.range(1000).select(F.lit("h").alias("vhost"), F.lit(60).cast("long").alias("sec"), F.concat(F.lit("192.168."), F.col("id").cast("string")).alias("addr"))
    assert abs(sketches.trailing_visitors(rows, lg_k=8).first()["visitors"] - 1000) <= 150
    assert sketches.trailing_visitors(rows.withColumn("addr", F.lit("a"))).first()["visitors"] == 1


def test_top_paths(spark):
    rows = requests(spark, [("h", 1000, p, 200, 0.01, "") for p, n in (("/api/users", 100), ("/api/orders", 50), ("/health", 10)) for _ in range(n)])
    stats = traffic.path_stats(traffic.trailing(rows, 1000, 5), 5, "vhost")
    top = traffic.top_per(stats, 2, ["vhost"], "count", "uri").orderBy(F.desc("count")).collect()
    assert [(r["uri"], r["rps"], r["ok_pct"]) for r in top] == [("/api/users", 20.0, 100.0), ("/api/orders", 10.0, 100.0)]
    assert traffic.trailing(rows, 1010, 5).count() == 0


def test_country_shares(spark):
    rows = spark.createDataFrame([("h", "DK", "Denmark"), ("h", "DK", "Denmark"), ("h", "US", "United States"), ("h", "", "")], "vhost string, code string, name string")
    got = {r["code"]: (r["count"], round(r["pct"], 2), r["flag"]) for r in traffic.country_stats(rows, 60, "vhost").collect()}
    assert got == {"DK": (2, 66.67, "🇩🇰"), "US": (1, 33.33, "🇺🇸")}


def test_locate_wide_and_narrow_ranges(spark):
    ranges = spark.createDataFrame([(16777216, 50331647, "", "", "xx", "Wide"), (16777216, 16777299, "aa", "A", "", "")], "start_ip long, end_ip long, code string, name string, reg_code string, reg_name string")
    rows = spark.createDataFrame([("1.0.0.5",), ("2.9.9.9",), ("9.9.9.9",), ("10.0.0.1",), ("::1",), (None,)], "addr string")
    got = {r["addr"]: (r["code"], r["name"]) for r in geo.locate(rows, ranges).collect()}
    assert got == {"1.0.0.5": ("AA", "A"), "2.9.9.9": ("XX", "Wide"), "9.9.9.9": ("", ""), "10.0.0.1": ("", ""), "::1": ("", ""), None: ("", "")}


def test_geo_join_is_no_nested_loop(spark, sf_dir):
    plan = geo.locate(adapters.access_log(spark, sf_dir), adapters.ip_ranges(spark, sf_dir), ranges6=adapters.ip6_ranges(spark, sf_dir))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ipv6_digits(spark):
    import ipaddress

    good = ["::", "::1", "2001:db8::1", "fe80::1:2", "2001:DB8:0:0:8:800:200C:417A", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8"]
    bad = ["", "1.2.3.4", "1:2:3", ":::", "1::2::3", "g::1", "12345::", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "1:2:3:4:5:6:7:8:9", "1:2:3:4::5:6:7:8", None]
    got = {r["a"]: r["h"] for r in spark.createDataFrame([(x,) for x in good + bad], "a string").select("a", E.ipv6_hex(F.col("a")).alias("h")).collect()}
    assert got == {a: f"{int(ipaddress.IPv6Address(a)):032x}" for a in good} | dict.fromkeys(bad)


def test_locate_ipv6(spark):
    import ipaddress

    def network(text, code):
        n = ipaddress.IPv6Network(text)
        return f"{int(n[0]):032x}", f"{int(n[-1]):032x}", code, code.lower()

    ranges = spark.createDataFrame([], "start_ip long, end_ip long, code string, name string")
    six = spark.createDataFrame([network(*x) for x in (("2001:db8::/32", "AA"), ("2001:db8:7::/48", "BB"), ("2001:db8:7:8::/64", "CC"), ("2400::/12", "DD"), ("2a00:1000::/24", "EE"))], "start_hex string, end_hex string, code string, name string")
    want = {"2001:db8:1::9": "AA", "2001:db8:7::1": "BB", "2001:db8:7:8::1": "CC", "240f:ffff::1": "DD", "2410::1": "", "2a00:10ff::1": "EE", "2a00:1100::1": "", "fe80::1": "", "::1": "", "no": "", None: ""}
    rows = spark.createDataFrame([(a,) for a in want], "addr string")
    assert {r["addr"]: r["code"] for r in geo.locate(rows, ranges, ranges6=six).collect()} == want
    mapped = spark.createDataFrame([(16777216, 16777299, "aa", "A")], "start_ip long, end_ip long, code string, name string")
    assert geo.locate(spark.createDataFrame([("::ffff:1.0.0.5",)], "addr string"), mapped, ranges6=six).first()["code"] == "AA"


def test_zero_filled_seconds(spark):
    rows = requests(spark, [("h", 3598, "/", 200, 1.0, ""), ("h", 3603, "/", 404, 2.0, ""), ("late", 3604, "/", 200, 1.0, "")])
    got = traffic.zero_filled(traffic.per_second(rows), traffic.first_seen(rows), 3605).orderBy("vhost", "sec").collect()
    assert [(r["vhost"], r["sec"], r["requests"]) for r in got] == [("h", s, int(s in (3598, 3603))) for s in range(3598, 3606)] + [("late", 3604, 1), ("late", 3605, 0)]
    last = traffic.zero_filled(traffic.per_second(rows), traffic.first_seen(rows), 3605, 3)
    assert sorted((r["vhost"], r["sec"]) for r in last.collect()) == [("h", 3603), ("h", 3604), ("h", 3605), ("late", 3604), ("late", 3605)]


def test_windows_by_days_are_windows_over_a_life(spark):
    import random

    rng = random.Random(4)
    events = [("h", s, "/", 200, 0.1, "") for s in sorted(rng.sample(range(86400 - 100, 86400 + 100), 90))]
    rows = requests(spark, events)
    got = {r["sec"]: r["requests"] for r in traffic.trailing_counts(traffic.per_second(rows), ["requests"], 60).collect()}
    assert got == {e[1]: sum(e[1] - 60 < x[1] <= e[1] for x in events) for e in events}
    seen = traffic.first_seen(rows)
    rates = {r["sec"]: r["rps"] for r in traffic.trailing_rates(traffic.per_second(rows), seen, 5).collect()}
    assert rates == {e[1]: pytest.approx(sum(e[1] - 5 < x[1] <= e[1] for x in events) / min(5, e[1] - events[0][1] + 1)) for e in events}
    visitors = {r["ts"]: r["visitors"] for r in sketches.trailing_visitors(rows.withColumn("addr", F.col("sec").cast("string"))).collect()}
    slots = {e[1] - e[1] % 60 for e in events}
    assert visitors == {t: sum(t - 240 <= x[1] < t + 60 for x in events) for t in slots}


def test_stored_requests_are_the_classes_sum(spark):
    rows = spark.createDataFrame([(5, 2, 1, 0, 0), (7, 0, 0, 0, 0), (0, 0, 0, 0, 0)], "requests long, s2xx long, s3xx long, s4xx long, s5xx long")
    assert [r["requests"] for r in sinks.minute_rows(rows).collect()] == [3, 7, 0]
    rated = rows.withColumn("rps", F.lit(0.99))
    assert [r["requests"] for r in sinks.minute_rows(rated).collect()] == [3, 59, 59]


def test_history_reads_only_its_days(spark, sf_dir):
    from weblens.plans import catalog

    df = catalog.history_all(spark, sf_dir)
    assert df.count() > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len({line.split("Location")[1] for line in scans}) == 1 and all("PartitionFilters: [isnotnull(dt" in line and "events.parquet" not in line for line in scans)
    union = catalog.tier_union(spark, sf_dir)
    files = union.inputFiles()
    assert files and not any("events.parquet" in f for f in files)


def test_country_stats_look_up_the_window_only(spark, sf_dir):
    from weblens.plans import catalog

    plan = catalog.country_stats(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    scans = plan.count("Relation [event_id")
    assert scans == 2 and sum("Filter" in line and " div 20" in line for line in plan.splitlines()) == scans


def test_merged_quantiles_of_sketches(spark):
    rows = requests(spark, [("h", 60 * (v % 7), "/", 200, float(v), "") for v in range(1, 1001)])
    q = sketches.merged_quantiles(sketches.minute_sketches(rows), "vhost").first()
    assert q["latency_p50"] == pytest.approx(500_000, rel=0.05) and q["latency_p99"] == pytest.approx(990_000, rel=0.03) and q["latency_avg"] == pytest.approx(500_500)


def test_rebucketed_tiers(spark):
    columns = "ts long, vhost string, width int, requests long, latency_avg double, unique_visitors long"
    rows = spark.createDataFrame([(0, "a", 60, 1, 1.0, 3), (60, "a", 60, 2, 3.0, 5), (3600, "a", 3600, 4, 2.0, 4), (86400, "a", 86400, 9, 1.0, 9)], columns)
    got = sorted(tuple(r) for r in tiers.rebucketed(rows, 7200).select("ts", "vhost", "width", "requests", "latency_avg", "unique_visitors").collect())
    assert got == [(0, "a", 7200, 7, 2.0, 5), (86400, "a", 86400, 9, 1.0, 9)]


def test_snapshot_with_globals(spark):
    import json

    live = spark.createDataFrame([("b", 1.5), ("a", 2.0)], "vhost string, rps double")
    row = sinks.snapshot_document(live, spark.createDataFrame([(7, 3)], "active long, waiting long"), 99).first()
    assert row["vhosts"] == 2 and json.loads(row["document"]) == {"timestamp": 99, "global": {"active": 7, "waiting": 3}, "vhosts": {"a": {"rps": 2.0}, "b": {"rps": 1.5}}}
    none = sinks.snapshot_document(live.limit(0), spark.createDataFrame([], "active long"), 99).first()
    assert json.loads(none["document"])["vhosts"] == {} and "global" not in json.loads(none["document"])


def test_islands_go_on_over_days(spark):
    day = 86400
    ticks = [(k * 5, k * 5 not in (day - 30, day + 40, 2 * day + 5)) for k in range((day - 60) // 5, (3 * day + 60) // 5)]
    rows = spark.createDataFrame([("r", "h", "error_rate", 1.0, 10, ts, 2.0, 10, 5, b) for ts, b in ticks], "name string, vhost string, metric string, threshold double, duration int, ts long, value double, total long, errors long, breach boolean")
    got = [(r["state"], r["ts"], r["started_at"]) for r in alerts.events(rows, 5, 20_000).orderBy("ts").collect()]
    assert got == machine(ticks, 10, 20_000)
    assert len(got) > 10


def test_more_rules_than_are_broadcast(spark, monkeypatch):
    """Beyond the bound rules are joined as they come, with the same results."""
    rule = {"name": "a", "metric": "error_rate", "threshold": 5, "vhost": "h"}
    ticks = spark.createDataFrame([("h", 5, 1.0, 0, 0, 30, 10, 1.0, 2.0, 3.0, 25.0)], "vhost string, ts long, rps double, s2xx long, s3xx long, s4xx long, s5xx long, latency_avg double, latency_p95 double, latency_p99 double, error_rate double")
    rules = alerts.rules_table(spark, [rule, rule | {"name": "b", "threshold": 50}])
    want = sorted(map(tuple, alerts.evaluate(ticks, rules).collect()))
    monkeypatch.setattr(alerts, "MOST_RULES", 1)
    assert sorted(map(tuple, alerts.evaluate(ticks, rules).collect())) == want and [r[-1] for r in want] == [True, False]


def test_countries_count_addresses_before_they_are_looked_up(spark, sf_dir):
    """No request is shuffled by its address: what meets the ranges are numbers of (minute, vhost, address)."""
    from weblens.plans import catalog

    plan = catalog.minute_countries(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    left = plan[plan.index("Join Inner") :]
    assert left.index("Aggregate") < left.index("Relation")


def test_ipv6_with_a_dotted_tail(spark):
    rows = spark.createDataFrame([("2001:db8::1.2.3.4",), ("64:ff9b::192.0.2.33",), ("::ffff:1.2.3.4",), ("2001:db8::1.2.3.400",), ("1:2:3:4:5:6:7.8.9.10",)], "addr string")
    got = {r["addr"]: r["h"] for r in rows.select("addr", E.ipv6_hex(F.col("addr")).alias("h")).collect()}
    assert got == {
        "2001:db8::1.2.3.4": "20010db8" + "0" * 16 + "01020304", "64:ff9b::192.0.2.33": "0064ff9b" + "0" * 16 + "c0000221", "::ffff:1.2.3.4": None,
        "2001:db8::1.2.3.400": None, "1:2:3:4:5:6:7.8.9.10": "000100020003000400050006" + "0708090a",
    }


def test_scan_reads_only_what_it_needs(spark, sf_dir):
    plan = traffic.per_second(traffic.classified(adapters.access_log(spark, sf_dir, True))).select("vhost", "sec", "requests")._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[1]


TIER = "ts long, vhost string, requests long, bytes_in long, bytes_out long, s2xx long, s3xx long, s4xx long, s5xx long, latency_avg double, latency_p95 double, latency_p99 double, unique_visitors long, bot_human long, bot_good long, bot_bad long, " + ", ".join(f"lat_b{k} long" for k in range(10))


def tier_row(ts, vhost, s2, s4, s5, visitors, bytes_in, bytes_out):
    return (ts, vhost, s2 + s4 + s5, bytes_in, bytes_out, s2, 0, s4, s5, 10.0, 20.0, 30.0, visitors, 35, 10, 5, 0, 40, 10, *[0] * 7)


def test_history_of_one_and_all(spark):
    rows = spark.createDataFrame([tier_row(60, "site1", 80, 15, 5, 42, 1024, 4096), tier_row(60, "site2", 50, 0, 0, 1, 512, 2048)], TIER)
    one = tiers.summary(tiers.series(rows, "site1", 0, 100, 60), 60).first()
    assert (one["requests"], one["error_rate"], one["unique_visitors"], one["bot_human"], one["lat_b1"]) == (100, 20.0, 42, 35, 40)
    every = tiers.series(rows, "all", 0, 100, 60).collect()
    assert len(every) == 1 and every[0]["requests"] == 150 and every[0]["s2xx"] == 130
    assert round(every[0]["error_rate"], 2) == 13.33 and (every[0]["bytes_in"], every[0]["bytes_out"]) == (1536, 6144)
    assert tiers.series(rows, "unknown", 0, 100, 60).count() == 0


def test_history_tops(spark):
    countries = spark.createDataFrame([(60, "site1", "DK", 70, "", ""), (60, "site1", "US", 30, "", ""), (60, "site2", "DE", 50, "", ""), (60, "site2", "US", 20, "", "")], "ts long, vhost string, code string, requests long, name string, flag string")
    got = tiers.history_countries(countries, "all", 0, 100).orderBy(F.desc("requests"), "code").collect()
    assert [(r["code"], r["requests"]) for r in got] == [("DK", 70), ("DE", 50), ("US", 50)]
    paths = spark.createDataFrame([(60, "s", "/api/v1/status", 30, 0.45, 30), (60, "s", "/index.html", 20, 0.20, 20)], "ts long, vhost string, path string, requests long, total_time double, s2xx long")
    first = tiers.history_paths(paths, "s", 0, 100).orderBy(F.desc("requests")).first()
    assert (first["path"], round(first["avg_ms"], 6), first["ok_pct"]) == ("/api/v1/status", 15.0, 100.0)


def test_rolled_whole_once():
    at = tiers.cuts(1_700_000_000)
    assert at["minute"] % 3600 == 0 and at["hour"] % 86400 == 0 and at["hour"] < at["minute"]


@pytest.mark.parametrize(
    "metric, threshold, least, errors_least, value, total, errors, want",
    [("error_rate", 5, 20, 5, 100, 2, 2, False), ("error_rate", 5, 20, 5, 8, 25, 2, False), ("error_rate", 5, 20, 5, 15, 40, 6, True), ("latency_p95", 500, 10, 0, 750, 15, 0, True), ("latency_p95", 500, 10, 0, 750, 5, 0, False), ("zero_traffic", 0, 0, 0, 0, 0, 0, True)],
)
def test_breach(spark, metric, threshold, least, errors_least, value, total, errors, want):
    row = spark.createDataFrame([(metric, float(threshold), least, errors_least, float(value), total, errors)], "metric string, threshold double, min_requests long, min_errors long, value double, total long, errors long")
    assert row.select(alerts.breached().alias("b")).first()["b"] is want


def test_rule_defaults(spark):
    rules = alerts.rules_table(spark, [{"name": "a", "metric": "error_rate", "threshold": 5, "duration": "bad"}, {"name": "b", "metric": "latency_p95", "threshold": 1, "duration": "1m30s", "vhost": "h"}]).collect()
    assert [tuple(r)[1:] for r in rules] == [("all", "error_rate", 5.0, 60, 20, 5), ("h", "latency_p95", 1.0, 90, 0, 0)]


def machine(ticks, duration, cooldown):
    """The state machine, told in plain Python."""
    since, fired, active, out = None, None, False, []
    for ts, breach in ticks:
        if breach:
            since = ts if since is None else since
            if ts - since >= duration and (not active or ts - fired >= cooldown):
                active, fired = True, ts
                out.append(("firing", ts, ts))
        else:
            since = None
            if active:
                active = False
                out.append(("resolved", ts, fired))
    return out


@pytest.mark.parametrize("duration, cooldown", [(10, 20), (0, 7), (7, 5), (30, 1000)])
def test_events_follow_the_state_machine(spark, duration, cooldown):
    ticks = [(5 * k, bool(b)) for k, b in enumerate([0, 1, 1, 1, 0, 1, 1, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 1, 1, 1, 1])]
    rows = spark.createDataFrame([("r", "h", "error_rate", 1.0, duration, ts, 2.0, 10, 5, b) for ts, b in ticks], "name string, vhost string, metric string, threshold double, duration int, ts long, value double, total long, errors long, breach boolean")
    got = [(r["state"], r["ts"], r["started_at"]) for r in alerts.events(rows, 5, cooldown).orderBy("ts").collect()]
    assert got == machine(ticks, duration, cooldown)


def test_payload(spark):
    event = spark.createDataFrame([("alert-1", "High errors", "h", "error_rate", 5.0, 15.0, "firing", 10, 10, None, "Error rate is 15.0%", "Requests: 100")], "id string, name string, vhost string, metric string, threshold double, value double, state string, ts long, started_at long, resolved_at long, message string, details string")
    got = {r["channel"]: r for r in alerts.payloads(event, "https://d").collect()}
    assert got["push"]["body"] == "Error rate is 15.0%\nRequests: 100" and got["push"]["priority"] == "urgent"
    assert got["push"]["title"] == "🚨 [FIRING] High errors (h)" and "https://d" in got["chat"]["body"] and len(got) == 4


def test_tier_table_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([tier_row(60, "a", 1, 0, 0, 1, 1, 1), tier_row(90000, "a", 2, 0, 0, 1, 1, 1)], TIER)
    for _ in range(2):
        sinks.write_tier(rows, str(tmp_path / "t"), "1m")
    sinks.write_tier(rows.filter("ts = 60").withColumn("s2xx", F.lit(9).cast("long")), str(tmp_path / "t"), "1m")
    assert sorted((r["ts"], r["s2xx"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(60, 9), (90000, 2)]


def test_no_query_joins_everything_with_everything(spark, sf_dir):
    from weblens.plans import catalog

    for name, query in catalog.queries().items():
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_trailing_counts_cost_the_same_whatever_the_window(spark):
    """One running sum: no frame that starts at a row's own window is worked out for each row."""
    rows = [("a", 1704067200 + k, k % 7) for k in range(0, 3 * 86400, 977)] + [("a", 1704067200 + 86400 + k, 1) for k in range(40)] + [("b", 1704067200 + 5, 3)]
    seconds = spark.createDataFrame(rows, "vhost string, sec long, n long")
    for window in (1, 60, 3600, 100_000):
        df = traffic.trailing_counts(seconds, ["n"], window)
        want = sorted((v, s, sum(m for w, t, m in rows if w == v and s - window < t <= s)) for v, s, _ in rows)
        assert sorted(map(tuple, df.select("vhost", "sec", "n").collect())) == want
        assert "unboundedpreceding" in df._jdf.queryExecution().executedPlan().toString()


def test_a_line_is_made_and_parsed_once(spark, sf_dir):
    """Neither a filter nor a column of the result parses a line, or makes it, again."""
    plan = parsers.parse_access_log(adapters.log_lines(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("StructsToJsonEvaluator") == 1
    assert parsers.parse_access_log(spark.createDataFrame([(None,), ("",), ("no {",)], "value string")).count() == 0


def _busy(spark, n=3000):
    """(vhost, sec, addr, raw_addr, req_time): ``n`` requests of two hours with as many latencies and addresses."""
    return spark.range(n).selectExpr("'a' AS vhost", "1704067200 + id * 7200 div %d AS sec" % n, "concat('10.0.', id div 200, '.', id % 200) AS addr", "concat('10.0.', id div 200, '.', id % 200) AS raw_addr", "(id * 7919 % 3001) / 1000.0D AS req_time")


def test_counts_by_value_stay_exact_where_sketches_do_not(spark):
    rows = _busy(spark)
    local = rows.collect()
    times, visits = (sketches.merged_counts(sketches.value_counts(rows, c), c, 3600) for c in ("req_time", "addr"))
    got = {r["ts"]: r for r in sketches.counted_latencies(times).join(sketches.counted_visitors(visits).drop("requests"), ["ts", "vhost"]).collect()}
    assert sorted(got) == [1704067200, 1704070800]
    for ts, r in got.items():
        own = [x for x in local if x["sec"] // 3600 * 3600 == ts]
        order = sorted(x["req_time"] for x in own)
        assert (r["requests"], r["unique_visitors"]) == (len(own), len({x["addr"] for x in own}))
        assert [r[f"latency_p{p}"] for p in (50, 95, 99)] == [order[-(-len(order) * p // 100) - 1] * 1000 for p in (50, 95, 99)]
        assert abs(r["latency_avg"] - sum(order) / len(order) * 1000) < 1e-6


@pytest.mark.parametrize("name", ["visitors_hll", "visitors_trailing_hll", "minute_sketches"])
def test_queries_with_many_addresses_match_their_sql(spark, tmp_path, name):
    import shutil

    import duckdb

    from weblens.plans import catalog

    shutil.copy("/root/testdata/sf0.1/nation.parquet", tmp_path)
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    # all in an hour: more addresses and latencies than a sketch has exactly
    con.execute(f"COPY (SELECT * REPLACE (TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds(event_id % 3600000) AS ts) FROM '/root/testdata/sf0.1/events.parquet') TO '{tmp_path}/events.parquet'")
    for t in ("events", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = catalog.queries()[name](spark, str(tmp_path))
    columns = [c for c in got.columns if c != "latency_avg"]  # a sum of doubles hangs on their order
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)


def test_kept_countries_need_no_shuffle_of_requests(spark, sf_dir, tmp_path):
    """What was found for the addresses is stored before the join, whose plan then knows that it is small."""
    kept = []

    def keep(found):
        kept.append(f"{tmp_path}/found{len(kept)}")
        found.write.parquet(kept[-1])
        return spark.read.parquet(kept[-1])

    rows, ranges = adapters.access_log(spark, sf_dir).withColumn("raw_addr", F.col("addr")), (adapters.ip_ranges(spark, sf_dir), "raw_addr", adapters.ip6_ranges(spark, sf_dir))
    got, want = (geo.locate(rows, *ranges, *more) for more in ((keep,), ()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(kept) == 1 and "hashpartitioning" not in plan
    shown = lambda df: sorted(map(tuple, df.select("event_id", "code", "name").collect()))
    assert shown(got) == shown(want)
