"""Threshold alerts: values per rule and tick, breach islands, firing, firing again, recovery."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weblens.functions import expressions as E
from weblens.operators.traffic import CLASSES, classes_total, error_rate
from weblens.sources import store

TICK, COOLDOWN, DAY = 5, 600, 86400
#: Rules are configuration; up to so many go to every task, more are joined as they come.
MOST_RULES = 10_000
RULE_SCHEMA = "name string, vhost string, metric string, threshold double, duration int, min_requests long, min_errors long"


def seconds_of(text: str | int | None, default: int) -> int:
    """Length of a duration such as 90, ``90s``, ``5m``, ``1h30m``; the default for anything else."""
    import re

    if isinstance(text, int):
        return text
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|s|m|h)", text or "")
    if not parts or "".join(a + b for a, b in parts) != text:
        return default
    return int(sum(float(a) * {"ms": 0.001, "s": 1, "m": 60, "h": 3600}[b] for a, b in parts))


def rules_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rules with defaults filled in: one minute, all vhosts, and for error rates 20 requests and 5 errors at least."""
    rows = []
    for r in rules:
        rate = r["metric"] == "error_rate"
        least = lambda key, n: int(r[key]) if r.get(key) is not None else (n if rate else 0)  # noqa: E731, B023
        rows.append((r["name"], r.get("vhost") or "all", r["metric"], float(r["threshold"]), seconds_of(r.get("duration"), 60), least("min_requests", 20), least("min_errors", 5)))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def tick_metrics(requests: DataFrame, tick: int = TICK) -> DataFrame:
    """(vhost, ts, rps, status classes, latencies) at every tick since a vhost's first request, and of ``all``.

    A tick covers the ``tick`` seconds up to it.  Ticks without requests of a vhost have zeros.
    """
    at = (F.ceil(F.col("sec") / tick) * tick).cast("long")
    q = F.percentile("req_time", F.array(F.lit(0.95), F.lit(0.99)))
    busy = requests.withColumn("ts", at).groupBy("vhost", "ts").agg(F.count("*").alias("requests"), *[F.sum(c).cast("long").alias(c) for c in CLASSES], F.avg("req_time").alias("_avg"), q.alias("_q"))
    firsts = requests.groupBy("vhost").agg(F.min("sec").alias("_first"), F.max(at).alias("_last"))
    ends = firsts.withColumn("_end", F.max("_last").over(Window.partitionBy()))  # over one row per vhost
    # by days, so that no row holds all ticks of a vhost
    start = (F.ceil(F.col("_first") / tick) * tick).cast("long")
    step, day = F.lit(tick).cast("long"), F.lit(DAY).cast("long")
    days = ends.withColumn("_day", F.explode(F.sequence(E.bucket_start(start, DAY), F.col("_end"), day)))
    inside = F.sequence(F.greatest(start, (F.ceil(F.col("_day") / tick) * tick).cast("long")), F.least(F.col("_end"), F.col("_day") + DAY - 1), step)
    grid = days.filter(F.greatest(start, (F.ceil(F.col("_day") / tick) * tick).cast("long")) <= F.least(F.col("_end"), F.col("_day") + DAY - 1)).withColumn("ts", F.explode(inside)).select("vhost", "_first", "ts")
    rows = grid.join(busy, ["vhost", "ts"], "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("requests", *CLASSES)}
    span = F.least(F.lit(tick), F.col("ts") - F.col("_first") + 1)
    rows = rows.withColumns(zero).withColumn("rps", F.col("requests") / span)
    ms = lambda c: F.coalesce(c * 1000, F.lit(0.0))
    rows = rows.select("vhost", "ts", "rps", *CLASSES, ms(F.col("_avg")).alias("latency_avg"), ms(F.col("_q")[0]).alias("latency_p95"), ms(F.col("_q")[1]).alias("latency_p99"))
    every = rows.groupBy("ts").agg(F.sum("rps").alias("rps"), *[F.sum(c).alias(c) for c in CLASSES], *[F.avg(c).alias(c) for c in ("latency_avg", "latency_p95", "latency_p99")])
    return rows.unionByName(every.withColumn("vhost", F.lit("all"))).withColumn("error_rate", error_rate())


def rule_value(metric: Column) -> Column:
    """The metric a rule names; 0 for one that doesn't exist."""
    out = F.lit(0.0)
    for name, col in (("error_rate", "error_rate"), ("latency_p95", "latency_p95"), ("latency_avg", "latency_avg"), ("zero_traffic", "rps")):
        out = F.when(metric == name, F.col(col)).otherwise(out)
    return out


def breached() -> Column:
    """Whether (metric, value, threshold, total, errors, min_requests, min_errors) is a breach."""
    above = F.col("value") > F.col("threshold")
    enough = (F.col("min_requests") <= 0) | (F.col("total") >= F.col("min_requests"))
    errors = (F.col("min_errors") <= 0) | (F.col("errors") >= F.col("min_errors"))
    return F.when(F.col("metric") == "error_rate", enough & errors & above).when(F.col("metric") == "zero_traffic", F.col("value") <= F.col("threshold")).otherwise(enough & above)


def evaluate(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """(name, vhost, metric, ts, value, total, errors, breach ...) per rule and tick; rules of unknown vhosts have no rows.

    The table of rules is configuration; up to MOST_RULES rows of it are broadcast, more are joined as they come.
    """
    few = rules.limit(MOST_RULES + 1).count() <= MOST_RULES
    rows = metrics.join(F.broadcast(rules) if few else rules, "vhost")
    rows = rows.withColumn("value", rule_value(F.col("metric"))).withColumn("total", classes_total()).withColumn("errors", F.col("s4xx") + F.col("s5xx"))
    rows = rows.withColumn("breach", breached())
    return rows.select("name", "vhost", "metric", "threshold", "duration", "ts", "value", "total", "errors", "breach")


_DAY_OF = ("name", "vhost", "_day")


def islands(evaluated: DataFrame) -> DataFrame:
    """Evaluated ticks with the start of the breach that they are in (null outside), and the tick before with its own.

    Ticks are put in order within days only; what goes on from the days before is carried over by a
    table of one row per rule, vhost and day.
    """
    rows = evaluated.withColumn("_day", F.floor(F.col("ts") / DAY))
    fine = F.when(~F.col("breach"), F.col("ts"))
    order = Window.partitionBy(*_DAY_OF).orderBy("ts")
    before = Window.partitionBy("name", "vhost").orderBy("_day")
    days = rows.groupBy(*_DAY_OF).agg(F.max(fine).alias("_fine"), F.max("ts").alias("_last"), F.max_by("breach", "ts").alias("_open"))
    days = days.withColumn("_fine_before", F.max("_fine").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    days = days.withColumn("_last_fine", F.coalesce("_fine", "_fine_before", F.lit(-1).cast("long")))
    days = days.withColumns({"_last_before": F.lag("_last").over(before), "_open_before": F.lag("_open").over(before), "_after_before": F.lag("_last_fine").over(before)})
    rows = rows.withColumn("_fine_here", F.max(fine).over(order)).join(days.select(*_DAY_OF, "_fine_before", "_last_before", "_open_before", "_after_before"), list(_DAY_OF))
    # a breach is named by the last tick without one before it
    rows = rows.withColumn("_after", F.coalesce("_fine_here", "_fine_before", F.lit(-1).cast("long")))
    starts = rows.filter("breach").groupBy("name", "vhost", F.col("_after").alias("_of")).agg(F.min("ts").alias("_since"))
    within = Window.partitionBy(*_DAY_OF).orderBy("ts")
    rows = rows.withColumn("_prev_ts", F.coalesce(F.lag("ts").over(within), "_last_before"))
    rows = rows.withColumn("_prev_after", F.when(F.coalesce(F.lag("breach").over(within), "_open_before"), F.coalesce(F.lag("_after").over(within), "_after_before")))
    # the island of a tick in breach, or of the one before it
    rows = rows.withColumn("_of", F.when(F.col("breach"), F.col("_after")).otherwise(F.col("_prev_after")))
    rows = rows.join(starts, ["name", "vhost", "_of"], "left")
    rows = rows.withColumn("since", F.when(F.col("breach"), F.col("_since"))).withColumn("_prev_since", F.when(F.col("_prev_after").isNotNull(), F.col("_since")))
    return rows.select(*evaluated.columns, "since", "_prev_ts", "_prev_since")


def _one_place(value: Column) -> Column:
    return F.format_string("%.1f", F.round(F.round(value, 6), 1))


_ISLAND = ("name", "vhost", "since")


def fire_times(rows: DataFrame, cooldown: int) -> DataFrame:
    """(name, vhost, since, ts): when rules fire in each breach of ``islands``, whatever the ticks.

    First at the tick at which the breach has lasted the rule's duration, then at the next tick that is a cooldown or
    more after the last firing.  Every tick that could fire points to the next one after it; pointers that double
    reach all firings of a breach in as many rounds as the logarithm of their number.
    """
    could = store.scratch(rows.filter(F.col("breach") & (F.col("ts") - F.col("since") >= F.col("duration"))).select(*_ISLAND, "ts"), "could-fire")
    # ticks and the times that they wait for, put in order within days; what a day lacks is the first tick of a later one
    none = F.lit(None).cast("long")
    both = could.select(*_ISLAND, F.col("ts").alias("_at"), F.col("ts").alias("_tick"), none.alias("ts"))
    both = both.unionByName(could.select(*_ISLAND, (F.col("ts") + cooldown).alias("_at"), none.alias("_tick"), "ts"))
    both = both.withColumn("_day", F.floor(F.col("_at") / DAY))
    later = Window.partitionBy(*_ISLAND).orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    days = both.groupBy(*_ISLAND, "_day").agg(F.min("_tick").alias("_first")).withColumn("_later", F.min("_first").over(later))
    order = Window.partitionBy(*_ISLAND, "_day").orderBy(F.col("_at").desc(), F.col("ts").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_here", F.min("_tick").over(order)).filter("ts is not null")
    met = met.join(days.select(*_ISLAND, "_day", "_later"), [*_ISLAND, "_day"]).withColumn("_next", F.coalesce("_here", "_later"))
    jumps = store.scratch(met.filter("_next is not null").select(*_ISLAND, "ts", "_next"), "jumps")
    fired = store.scratch(could.groupBy(*_ISLAND).agg(F.min("ts").alias("ts")), "fired")
    while True:
        more = fired.join(jumps, [*_ISLAND, "ts"]).select(*_ISLAND, F.col("_next").alias("ts"))
        if not more.limit(1).count():
            return fired
        fired = store.scratch(fired.unionByName(more), "fired")
        ahead = jumps.select(*_ISLAND, F.col("ts").alias("_next"), F.col("_next").alias("_after"))
        jumps = store.scratch(jumps.join(ahead, [*_ISLAND, "_next"]).select(*_ISLAND, "ts", F.col("_after").alias("_next")), "jumps")


def _even(rows: DataFrame, tick: int, cooldown: int) -> DataFrame:
    """Rows of ``islands`` with _firing, _resolved and _last_fire where ticks are even: all follow from the length of the breach."""
    wait = (F.ceil(F.col("duration") / tick) * tick).cast("long")
    again = math.ceil(cooldown / tick) * tick
    held = F.col("ts") - F.col("since")
    lasted = F.col("_prev_ts") - F.col("_prev_since")
    rows = rows.withColumn("_firing", F.col("breach") & (held >= wait) & (F.pmod(held - wait, F.lit(again)) == 0))
    rows = rows.withColumn("_resolved", ~F.col("breach") & (lasted >= wait))
    return rows.withColumn("_last_fire", F.col("_prev_since") + wait + F.floor((lasted - wait) / again) * again)


def _uneven(rows: DataFrame, cooldown: int) -> DataFrame:
    """The same for any ticks, from the firings themselves."""
    rows = store.scratch(rows, "islands")
    fired = fire_times(rows, cooldown)
    rows = rows.join(fired.withColumn("_fired", F.lit(True)), [*_ISLAND, "ts"], "left")
    last = fired.groupBy("name", "vhost", F.col("since").alias("_prev_since")).agg(F.max("ts").alias("_last_fire"))
    rows = rows.join(last, ["name", "vhost", "_prev_since"], "left")
    return rows.withColumn("_firing", F.col("_fired").isNotNull()).withColumn("_resolved", ~F.col("breach") & F.col("_last_fire").isNotNull())


def events(evaluated: DataFrame, tick: int | None = TICK, cooldown: int = COOLDOWN) -> DataFrame:
    """What the state machine emits, without running it.

    In a breach that began at ``since`` the first firing is the tick at which it has lasted the
    rule's duration, then the next one a cooldown or more after the last; the first tick without a
    breach after one that fired resolves, and tells when the last firing was.  A vhost that is absent
    from some ticks keeps its state.  Ticks are ``tick`` seconds apart, without gaps, or any where it is None.
    """
    rows = islands(evaluated)
    rows = _uneven(rows, cooldown) if tick is None else _even(rows, tick, cooldown)
    last_fire = F.col("_last_fire")
    state = F.when(F.col("_firing"), "firing").when(F.col("_resolved"), "resolved")
    found = rows.withColumn("state", state).filter("state is not null")
    # fixed wording of messages and details
    message = F.when(
        F.col("state") == "firing",
        F.concat("name", F.lit(" breached threshold: "), _one_place(F.col("value")), F.lit(" (threshold: "), _one_place(F.col("threshold")), F.lit(")")),
    ).otherwise(F.concat("name", F.lit(" has recovered. Current value: "), _one_place(F.col("value")), F.lit(" (threshold: "), _one_place(F.col("threshold")), F.lit(")")))
    details = F.concat(F.lit("VHost: "), "vhost", F.lit(" | Total Requests: "), F.col("total").cast("string"), F.lit(" | Errors: "), F.col("errors").cast("string"))
    return found.select(
        F.concat(F.lit("alert-"), "name", F.lit("-"), F.col("ts").cast("string")).alias("id"),
        "name", "vhost", "metric", "threshold", "value", "state", "ts",
        F.when(F.col("state") == "firing", F.col("ts")).otherwise(last_fire).alias("started_at"),
        F.when(F.col("state") == "resolved", F.col("ts")).alias("resolved_at"),
        message.alias("message"), details.alias("details"),
    )


def active(found: DataFrame, as_of: int) -> DataFrame:
    """The last firing of every rule that fires at ``as_of``."""
    last = found.filter(F.col("ts") <= as_of).groupBy("name", "vhost").agg(F.max_by(F.struct("metric", "state", "ts", "value", "message"), "ts").alias("e"))
    return last.select("name", "vhost", "e.*").filter("state = 'firing'")


def recent(found: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` events, newest first."""
    return found.orderBy(F.col("ts").desc(), "name", "vhost").limit(n)


# Words, signs and colours of notifications.
TITLES = {"firing": "🚨 [FIRING] ", "resolved": "✅ [RESOLVED] "}
CHAT_TITLES = {"firing": "🚨 *[FIRING] ", "resolved": "✅ *[RESOLVED] "}
PRIORITIES = {"firing": "urgent", "resolved": "default"}
TAGS = {"firing": "warning,rotating_light", "resolved": "white_check_mark,green_circle"}
COLOURS = {"firing": "#e02424", "resolved": "#0e9f6e"}


def payloads(found: DataFrame, dashboard: str = "") -> DataFrame:
    """(id, channel, title, priority, tags, body): what each of four channels is sent for an event."""
    pick = lambda d: F.when(F.col("state") == "firing", d["firing"]).otherwise(d["resolved"])
    lines = F.concat_ws("\n", "message", F.nullif(F.col("details"), F.lit("")))
    title = F.concat(pick(TITLES), "name", F.lit(" ("), "vhost", F.lit(")"))
    note = F.concat(lines, F.lit(f"\nDashboard: {dashboard}")) if dashboard else lines
    chat = F.concat(pick(CHAT_TITLES), "name", F.lit("* on `"), "vhost", F.lit("`\n"), lines, F.lit(f"\n<{dashboard}|View Dashboard>" if dashboard else ""))
    attachment = F.array(F.struct(pick(COLOURS).alias("color"), F.col("message").alias("text")))
    event = F.struct("id", "name", "vhost", "metric", "threshold", "value", "state", "started_at", "resolved_at", "message", "details")
    none = F.lit("")

    def sent(channel: str, priority: Column, tags: Column, body: Column) -> Column:
        return F.struct(F.lit(channel).alias("channel"), title.alias("title"), priority.alias("priority"), tags.alias("tags"), body.alias("body"))

    kinds = F.array(
        sent("push", pick(PRIORITIES), pick(TAGS), lines),
        sent("note", none, none, F.to_json(F.struct(F.lit("note").alias("type"), title.alias("title"), note.alias("body")))),
        sent("chat", none, none, F.to_json(F.struct(chat.alias("text"), attachment.alias("attachments")))),
        sent("webhook", none, none, F.to_json(F.struct(event.alias("event"), F.lit(dashboard).alias("dashboard_url"), F.col("ts").alias("timestamp")))),
    )
    return found.select("id", F.explode(kinds).alias("p")).select("id", "p.*")
