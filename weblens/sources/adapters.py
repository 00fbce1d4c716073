"""Access logs and other inputs derived from the event tables.

Expressions are written once; ``{div}`` and ``{k}`` stand for what Spark and DuckDB write differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = 1704067200
#: One agent for each way a stage of the client classes can be reached, or passed.
AGENTS = [
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "DuckDuckBot-Https/1.1; (+https://search.test/bot)",
    "Nikto-scanner 2.5, plugin 7",
    "",
    "-",
    "Scrapy 2.11 (spider)",
    "AcmeCrawler/1.0",
    "port-scan-tool/2",
    "SomeApp/3.1",
    "Mozilla/5.0 (compatible; Pingdom.check 7)",
]
_AGENT = "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(AGENTS)) + " END"
_STATUS = "CASE WHEN {error} THEN CASE WHEN event_id % 2 = 0 THEN 404 ELSE 502 END WHEN event_id % 101 = 0 THEN 101 WHEN event_id % 11 = 0 THEN 301 ELSE 200 END"
COLUMNS = {
    "event_id": "event_id",
    "host": "CASE WHEN event_id % 97 = 0 THEN '' WHEN user_id % 4 = 0 THEN 'www.example.com' WHEN user_id % 4 = 1 THEN 'api.example.com' WHEN user_id % 4 = 2 THEN 'shop.example.com' ELSE 'blog.example.com' END",
    "addr": "CASE WHEN event_id % 89 = 0 THEN '192.168.1.7' WHEN event_id % 83 = 0 THEN concat('2001:db8:', cast(user_id % 40 AS varchar(9)), '::', cast(event_id % 10 AS varchar(9))) ELSE concat('203.0.', cast(((user_id*37) % 1500) {div} 256 AS varchar(9)), '.', cast(((user_id*37) % 1500) % 256 AS varchar(9))) END",
    "method": "CASE WHEN event_type IN ('signup','purchase') THEN 'POST' ELSE 'GET' END",
    "uri": "CASE WHEN event_id % 53 = 0 THEN '/healthz' ELSE concat('/', event_type, '/', cast(event_id % 20 AS varchar(9)), CASE WHEN event_id % 3 = 0 THEN concat('?k=', {k}) ELSE '' END) END",
    "bytes": "user_id * 37 + event_id % 5000",
    "body_bytes": "event_id % 5000",
    "req_len": "200 + event_id % 300",
    "req_time": "value / 50.0",
    "upstream_time": "CASE event_id % 4 WHEN 0 THEN '-' WHEN 1 THEN '' WHEN 2 THEN '0.125' ELSE '0.1, 0.2' END",
    "upstream_addr": "concat('10.0.0.', cast(event_id % 3 AS varchar(9)), ':8080')",
    "ua": _AGENT,
    "ref": "''",
}
_SPARK = {"div": "div", "k": "get_json_object(props,'$.k')"}
_DUCK = {"div": "//", "k": "json_extract_string(props,'$.k')"}


def _expressions(dialect: dict[str, str], dense: bool) -> dict[str, str]:
    out = {c: e.replace("{div}", dialect["div"]).replace("{k}", dialect["k"]) for c, e in COLUMNS.items()}
    error = f"event_type = 'error' AND (event_id {dialect['div']} 1000) % 3 = 1" if dense else "event_type = 'error'"
    out["status"] = _STATUS.replace("{error}", error)
    if dense:
        out["sec"] = f"{START} + event_id {dialect['div']} 20"
    elif dialect is _SPARK:
        out["sec"] = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
    else:
        out["sec"] = "CAST(floor(epoch(ts)) AS BIGINT)"
    return out


def access_log(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """One request per event: over 30 days, or ``dense`` at 20 a second."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr(*[f"{e} AS {c}" for c, e in _expressions(_SPARK, dense).items()])


def access_log_sql(dense: bool = False) -> str:
    """The same as DuckDB SQL."""
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in _expressions(_DUCK, dense).items()) + " FROM events"


FIRST_IP, IPS_EACH = 3405774848, 60


def ip_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(start_ip, end_ip, code, name): 60 addresses to each nation."""
    n = F.col("n_nationkey")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        (F.lit(FIRST_IP).cast("long") + n * IPS_EACH).alias("start_ip"),
        (F.lit(FIRST_IP).cast("long") + n * IPS_EACH + IPS_EACH - 1).alias("end_ip"),
        F.expr("concat(chr(65 + n_nationkey div 5), chr(65 + n_nationkey % 5))").alias("code"),
        F.col("n_name").alias("name"),
    )


IP_RANGES_SQL = f"SELECT {FIRST_IP} + n_nationkey * {IPS_EACH} AS start_ip, {FIRST_IP} + n_nationkey * {IPS_EACH} + {IPS_EACH - 1} AS end_ip, concat(chr(65 + n_nationkey // 5), chr(65 + n_nationkey % 5)) AS code, n_name AS name FROM nation"



def ip6_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(start_hex, end_hex, code, name): a /48 network to each nation."""
    network = F.concat(F.lit("20010db8"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0"))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        F.concat(network, F.lit("0" * 20)).alias("start_hex"),
        F.concat(network, F.lit("f" * 20)).alias("end_hex"),
        F.expr("concat(chr(65 + n_nationkey div 5), chr(65 + n_nationkey % 5))").alias("code"),
        F.col("n_name").alias("name"),
    )


IP6_RANGES_SQL = "SELECT concat('20010db8', lpad(CAST(n_nationkey AS VARCHAR), 4, '0'), repeat('0', 20)) AS start_hex, concat('20010db8', lpad(CAST(n_nationkey AS VARCHAR), 4, '0'), repeat('f', 20)) AS end_hex, concat(chr(65 + n_nationkey // 5), chr(65 + n_nationkey % 5)) AS code, n_name AS name FROM nation"

WIRE = ["host", "addr", "method", "uri", "status", "bytes", "body_bytes", "req_len", "req_time", "upstream_time", "upstream_addr", "ua", "ref"]


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, value): lines with a syslog header and a JSON object; every 71st is cut short, every 73rd has no object,
    every 79th a text for a number."""
    log = access_log(spark, sf_dir).withColumn("ts", F.timestamp_seconds("sec"))
    line = F.concat(F.lit("<190>Jan  1 00:00:00 web nginx: "), F.to_json(F.struct("ts", *WIRE)))
    lines = log.select("event_id", F.explode(F.array(line)).alias("_line"))  # so that a line is made once, however often it is looked at
    cut = F.when(F.col("event_id") % 71 == 0, F.expr("substring(_line, 1, length(_line) - 9)")).when(F.col("event_id") % 73 == 0, "no object here")
    broken = cut.when(F.col("event_id") % 79 == 0, F.regexp_replace("_line", '"status":', '"status":"x",')).otherwise(F.col("_line"))
    return lines.select("event_id", broken.alias("value"))


def conn_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(collected_at, body): the four-line status text every 5 dense seconds; every 13th is cut short."""
    log = access_log(spark, sf_dir, dense=True)
    tick = (F.floor((F.col("sec") - START) / 5) * 5 + START).cast("long")
    polls = log.groupBy(tick.alias("collected_at")).agg(F.max("event_id").alias("n"))
    n = F.col("n")
    body = F.concat(
        F.lit("Active connections: "), (n % 300).cast("string"), F.lit(" \nserver accepts handled requests\n "),
        (n * 2).cast("string"), F.lit(" "), (n * 2 - F.floor(n / 100)).cast("string"), F.lit(" "), (n * 3).cast("string"),
        F.lit(" \nReading: "), (n % 7).cast("string"), F.lit(" Writing: "), (n % 11).cast("string"), F.lit(" Waiting: "), (n % 13).cast("string"), F.lit(" "),
    )
    return polls.select("collected_at", F.when(n % 13 == 0, "invalid data").otherwise(body).alias("body"))


def zone_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(collected_at, body): a module-status document per dense minute, built from the hosts' totals."""
    log = access_log(spark, sf_dir, dense=True).filter("host != ''")
    minute = (F.col("sec") - F.col("sec") % 60).alias("collected_at")
    hosts = log.groupBy(minute, "host").agg(F.count("*").alias("requestCounter"), F.sum("req_len").alias("inBytes"), F.sum("bytes").alias("outBytes"), F.count_if(F.col("status").between(200, 299)).alias("ok"), F.count_if(F.col("status") >= 500).alias("bad"))
    responses = F.create_map(F.lit("2xx"), F.col("ok"), F.lit("5xx"), F.col("bad"))
    zone = F.struct("host", F.struct("requestCounter", "inBytes", "outBytes", responses.alias("responses"), (F.col("requestCounter") * 2).alias("requestMsec")))
    return hosts.groupBy("collected_at").agg(F.map_from_entries(F.collect_list(zone)).alias("serverZones")).select("collected_at", F.to_json(F.struct("serverZones")).alias("body"))
