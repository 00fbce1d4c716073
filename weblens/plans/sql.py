"""DuckDB SQL that gives the same rows as the registered queries."""

from __future__ import annotations

from weblens.functions.expressions import BAD_SIGNATURES, BROWSERS, GENERIC_BAD, GENERIC_GOOD, GOOD_SIGNATURES, LATENCY_EDGES, any_of
from weblens.operators.traffic import BUCKETS, CLASSES, CLIENTS, COUNTERS
from weblens.sources.adapters import IP6_RANGES_SQL, IP_RANGES_SQL, access_log_sql

CLIENT = (
    "CASE WHEN ua IN ('', '-') THEN 'bad_bot' "
    + "".join(f"WHEN regexp_matches(lower(ua), '{any_of(w)}') THEN '{c}' " for w, c in ((GOOD_SIGNATURES, "good_bot"), (BAD_SIGNATURES, "bad_bot"), (BROWSERS, "human"), (GENERIC_GOOD, "good_bot"), (GENERIC_BAD, "bad_bot")))
    + "ELSE 'human' END"
)
BUCKET = "CASE " + "".join(f"WHEN req_time * 1000.0 < {e} THEN {k} " for k, e in enumerate(LATENCY_EDGES)) + "ELSE 9 END"
FLAGS = ", ".join(
    [f"CASE WHEN status >= {k}00{f' AND status < {k + 1}00' if k < 5 else ''} THEN 1 ELSE 0 END AS s{k}xx" for k in (2, 3, 4, 5)]
    + [f"CASE WHEN client = '{n}' THEN 1 ELSE 0 END AS {c}" for c, n in zip(CLIENTS, ("human", "good_bot", "bad_bot"))]
    + [f"CASE WHEN bucket = {k} THEN 1 ELSE 0 END AS {b}" for k, b in enumerate(BUCKETS)]
)
COUNTS = ", ".join(["count(*) AS requests", "CAST(sum(req_len) AS BIGINT) AS bytes_in", "CAST(sum(bytes) AS BIGINT) AS bytes_out"] + [f"CAST(sum({c}) AS BIGINT) AS {c}" for c in (*CLASSES, *CLIENTS, *BUCKETS)])
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTERS)
TOTAL = "(s2xx + s3xx + s4xx + s5xx)"
ERROR = f"CASE WHEN {TOTAL} > 0 THEN (s4xx + s5xx) / {TOTAL} * 100 ELSE 0.0 END"


def ms(q: float) -> str:
    return f"round(quantile_cont(req_time, {q}) * 1000, 6)"


def base(dense: bool = False, *more: str) -> str:
    """WITH log, req and further tables."""
    parts = [
        f"log AS ({access_log_sql(dense)})",
        f"req AS (SELECT *, CASE WHEN host = '' THEN '_default' ELSE host END AS vhost, {FLAGS} FROM (SELECT * EXCLUDE (addr, uri), addr AS raw_addr, regexp_replace(addr, '\\.[^.]*$', '.0') AS addr, split_part(uri, '?', 1) AS uri, {CLIENT} AS client, {BUCKET} AS bucket FROM log))",
        *more,
    ]
    return "WITH " + ", ".join(parts) + " "


#: The time at which windows over the dense log end: that of its last request.
NOW = "(SELECT max(sec) FROM log)"
FILLED = (
    f"seen AS (SELECT vhost, min(sec) AS f FROM req GROUP BY vhost), filled AS (SELECT vhost, sec, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('latency_sum', *COUNTERS))} "
    f"FROM (SELECT vhost, unnest(generate_series(f, {NOW})) AS sec FROM seen) LEFT JOIN seconds USING (vhost, sec))"
)


def within(seconds: int) -> str:
    return f"sec > {NOW} - {seconds} AND sec <= {NOW}"


SECONDS = f"seconds AS (SELECT vhost, sec, sum(req_time) AS latency_sum, {COUNTS} FROM req GROUP BY ALL)"
_IP = "list_reduce(list_transform(string_split(raw_addr, '.'), lambda x: CAST(x AS BIGINT)), lambda a, x: a * 256 + x)"
_GROUPS = lambda k: f"list_filter(string_split(split_part(lower(raw_addr), '::', {k}), ':'), lambda x: x <> '')"
_HEX = (
    f"array_to_string(list_transform(list_concat(list_concat({_GROUPS(1)}, list_transform(range(8 - len({_GROUPS(1)}) - len({_GROUPS(2)})), lambda i: '0')), {_GROUPS(2)}), lambda x: lpad(x, 4, '0')), '')"
)
LOCATED = (
    f"ranges AS ({IP_RANGES_SQL}), ranges6 AS ({IP6_RANGES_SQL}), numbered AS (SELECT *, CASE WHEN raw_addr NOT LIKE '%:%' AND raw_addr NOT LIKE '192.168.%' THEN {_IP} END AS ip, CASE WHEN raw_addr LIKE '%::%' THEN {_HEX} END AS hex FROM req), "
    "located AS (SELECT n.*, coalesce(r.code, s.code, '') AS code, coalesce(r.name, s.name, '') AS name FROM numbered n LEFT JOIN ranges r ON n.ip BETWEEN r.start_ip AND r.end_ip LEFT JOIN ranges6 s ON n.hex BETWEEN s.start_hex AND s.end_hex)"
)
FLAG = "concat(chr(127397 + ascii(code[1])), chr(127397 + ascii(code[2])))"
VISITORS = "count(DISTINCT addr) AS unique_visitors"


def minutes(width: int = 60) -> str:
    raw = f"SELECT sec // {width} * {width} AS ts, vhost, {COUNTS}, {VISITORS}, round(avg(req_time) * 1000, 6) AS latency_avg, {ms(0.5)} AS latency_p50, {ms(0.95)} AS latency_p95, {ms(0.99)} AS latency_p99 FROM req GROUP BY ALL"
    return f"minutes AS (SELECT * REPLACE (CASE WHEN {TOTAL} = 0 AND requests / 60 > 0 THEN CAST(floor(requests / 60 * 60) AS BIGINT) ELSE {TOTAL} END AS requests) FROM ({raw}))"


def rolled(source: str, target: str, width: int) -> str:
    return f"{target} AS (SELECT ts // {width} * {width} AS ts, vhost, {SUMS}, avg(latency_avg) AS latency_avg, max(latency_p95) AS latency_p95, max(latency_p99) AS latency_p99, max(unique_visitors) AS unique_visitors FROM {source} GROUP BY ALL)"


MINUTE_PATHS = "minute_paths AS (SELECT * FROM (SELECT sec // 60 * 60 AS ts, vhost, uri AS path, count(*) AS requests, sum(req_time) AS total_time, CAST(sum(s2xx) AS BIGINT) AS s2xx FROM req WHERE uri <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY ts, vhost ORDER BY requests DESC, path) <= 50)"
MINUTE_COUNTRIES = f"minute_countries AS (SELECT sec // 60 * 60 AS ts, vhost, code, count(*) AS requests, max(name) AS name, {FLAG} AS flag FROM located WHERE code <> '' GROUP BY ALL)"


def rollup_paths(source: str, target: str, width: int) -> str:
    return f"{target} AS (SELECT ts // {width} * {width} AS ts, vhost, path, CAST(sum(requests) AS BIGINT) AS requests, sum(total_time) AS total_time, CAST(sum(s2xx) AS BIGINT) AS s2xx FROM {source} GROUP BY ALL)"


def rollup_countries(source: str, target: str, width: int) -> str:
    return f"{target} AS (SELECT ts // {width} * {width} AS ts, vhost, code, CAST(sum(requests) AS BIGINT) AS requests, max(name) AS name, max(flag) AS flag FROM {source} GROUP BY ALL)"


def ticks(tick: int = 5) -> str:
    at = f"CAST(ceil(sec / {tick}) * {tick} AS BIGINT)"
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in CLASSES)
    zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in CLASSES)
    return f"""busy AS (SELECT vhost, {at} AS ts, count(*) AS requests, {sums}, avg(req_time) AS a, quantile_cont(req_time, 0.95) AS p95, quantile_cont(req_time, 0.99) AS p99 FROM req GROUP BY ALL),
firsts AS (SELECT vhost, min(sec) AS f, (SELECT max({at}) FROM req) AS e FROM req GROUP BY ALL),
grid AS (SELECT vhost, f, unnest(generate_series(CAST(ceil(f / {tick}) * {tick} AS BIGINT), e, {tick})) AS ts FROM firsts),
one AS (SELECT vhost, ts, coalesce(requests, 0) / least({tick}, ts - f + 1) AS rps, {zero}, coalesce(a * 1000, 0) AS latency_avg, coalesce(p95 * 1000, 0) AS latency_p95, coalesce(p99 * 1000, 0) AS latency_p99 FROM grid LEFT JOIN busy USING (vhost, ts)),
ticks AS (SELECT *, {ERROR} AS error_rate FROM (SELECT vhost, ts, rps, {", ".join(CLASSES)}, latency_avg, latency_p95, latency_p99 FROM one UNION ALL BY NAME SELECT 'all' AS vhost, ts, sum(rps) AS rps, {sums}, avg(latency_avg) AS latency_avg, avg(latency_p95) AS latency_p95, avg(latency_p99) AS latency_p99 FROM one GROUP BY ts))"""


def evaluated(rules: list[tuple]) -> str:
    values = ", ".join(f"('{n}', '{v}', '{m}', CAST({t} AS DOUBLE), {d}, {a}, {b})" for n, v, m, t, d, a, b in rules)
    return f"""rules AS (SELECT * FROM (VALUES {values}) t(name, vhost, metric, threshold, duration, min_requests, min_errors)),
valued AS (SELECT name, vhost, metric, threshold, duration, ts, {TOTAL} AS total, s4xx + s5xx AS errors, min_requests, min_errors,
 CASE metric WHEN 'error_rate' THEN error_rate WHEN 'latency_p95' THEN latency_p95 WHEN 'latency_avg' THEN latency_avg WHEN 'zero_traffic' THEN rps ELSE 0.0 END AS value FROM ticks JOIN rules USING (vhost)),
evaluated AS (SELECT name, vhost, metric, threshold, duration, ts, value, total, errors,
 CASE WHEN metric = 'error_rate' THEN (min_requests <= 0 OR total >= min_requests) AND (min_errors <= 0 OR errors >= min_errors) AND value > threshold
 WHEN metric = 'zero_traffic' THEN value <= threshold ELSE (min_requests <= 0 OR total >= min_requests) AND value > threshold END AS breach FROM valued)"""


def alert_events(tick: int, cooldown: int) -> str:
    again = -(-cooldown // tick) * tick
    wait = f"CAST(ceil(duration / {tick}) * {tick} AS BIGINT)"
    return f"""marked AS (SELECT *, sum(CASE WHEN breach THEN 0 ELSE 1 END) OVER (PARTITION BY name, vhost ORDER BY ts) AS island FROM evaluated),
held AS (SELECT *, CASE WHEN breach THEN min(CASE WHEN breach THEN ts END) OVER (PARTITION BY name, vhost, island) END AS since, {wait} AS wait FROM marked),
linked AS (SELECT *, lag(ts) OVER w AS pts, lag(since) OVER w AS psince FROM held WINDOW w AS (PARTITION BY name, vhost ORDER BY ts)),
stated AS (SELECT *, CASE WHEN breach AND ts - since >= wait AND (ts - since - wait) % {again} = 0 THEN 'firing' WHEN NOT breach AND pts - psince >= wait THEN 'resolved' END AS state FROM linked),
found AS (SELECT concat('alert-', name, '-', CAST(ts AS VARCHAR)) AS id, name, vhost, metric, threshold, value, state, ts,
 CASE WHEN state = 'firing' THEN ts ELSE psince + wait + (pts - psince - wait) // {again} * {again} END AS started_at, CASE WHEN state = 'resolved' THEN ts END AS resolved_at,
 concat(name, CASE WHEN state = 'firing' THEN ' breached threshold: ' ELSE ' has recovered. Current value: ' END, printf('%.1f', round(round(value, 6), 1)), ' (threshold: ', printf('%.1f', round(threshold, 1)), ')') AS message,
 concat('VHost: ', vhost, ' | Total Requests: ', CAST(total AS VARCHAR), ' | Errors: ', CAST(errors AS VARCHAR)) AS details FROM stated WHERE state IS NOT NULL)"""


def uneven_events(kept: str, cooldown: int) -> str:
    """Events of the ticks that are ``kept``, each firing found from the one before it."""
    return f"""thin AS (SELECT * FROM evaluated WHERE {kept}),
marked AS (SELECT *, sum(CASE WHEN breach THEN 0 ELSE 1 END) OVER (PARTITION BY name, vhost ORDER BY ts) AS island FROM thin),
held AS (SELECT *, CASE WHEN breach THEN min(CASE WHEN breach THEN ts END) OVER (PARTITION BY name, vhost, island) END AS since FROM marked),
linked AS (SELECT *, lag(since) OVER (PARTITION BY name, vhost ORDER BY ts) AS psince FROM held),
could AS (SELECT name, vhost, since, ts FROM held WHERE breach AND ts - since >= duration),
fires AS (SELECT name, vhost, since, min(ts) AS ts FROM could GROUP BY ALL
 UNION ALL SELECT f.name, f.vhost, f.since, min(c.ts) AS ts FROM fires f JOIN could c ON c.name = f.name AND c.vhost = f.vhost AND c.since = f.since AND c.ts >= f.ts + {cooldown} GROUP BY f.name, f.vhost, f.since, f.ts),
lasts AS (SELECT name, vhost, since AS psince, max(ts) AS last FROM fires GROUP BY ALL),
found AS (SELECT l.name, l.vhost, 'firing' AS state, l.ts, l.ts AS started_at, value FROM linked l SEMI JOIN fires f ON f.name = l.name AND f.vhost = l.vhost AND f.ts = l.ts
 UNION ALL SELECT l.name, l.vhost, 'resolved', l.ts, last, value FROM linked l JOIN lasts s ON s.name = l.name AND s.vhost = l.vhost AND s.psince = l.psince WHERE NOT l.breach)"""
