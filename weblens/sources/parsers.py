"""Parsers for what a web server emits: log lines, connection status, module status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("host", "addr", "method", "uri")]
    + [T.StructField("status", T.IntegerType())]
    + [T.StructField(n, T.LongType()) for n in ("bytes", "body_bytes", "req_len")]
    + [T.StructField("req_time", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("upstream_time", "upstream_addr", "ua", "ref")]
    + [T.StructField("ts", T.TimestampType())]
)
_CORRUPT = "_corrupt"


def read_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """(value): one row per line of the files under ``path``; as a stream, of files as they arrive."""
    return spark.readStream.text(path) if streaming else spark.read.text(path)


def parse_access_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """Requests of the lines that hold a whole JSON object of the right types; what else came along passes through.

    What stands before the first brace is dropped.  Missing and null fields get the type's zero; a
    request without time is rejected.
    """
    text = F.trim(value)
    body = F.substr(text, F.instr(text, "{"))
    schema = T.StructType([*LOG_SCHEMA.fields, T.StructField(_CORRUPT, T.StringType())])
    others = [c for c in lines.columns if c not in (value, *LOG_SCHEMA.fieldNames())]
    # exploded, so that no filter on what is found is worked out by parsing a line once more
    found = F.explode(F.array(F.from_json(body, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})))
    parsed = lines.filter(F.instr(value, "{") > 0).select(*others, found.alias("_p"))
    parsed = parsed.filter(F.col(f"_p.{_CORRUPT}").isNull() & F.col("_p.ts").isNotNull())
    zero = {T.StringType(): "", T.IntegerType(): 0, T.LongType(): 0, T.DoubleType(): 0.0}
    fields = [F.coalesce(F.col(f"_p.{f.name}"), F.lit(zero[f.dataType]).cast(f.dataType)).alias(f.name) if f.dataType in zero else F.col(f"_p.{f.name}") for f in LOG_SCHEMA.fields]
    return parsed.select(*others, *fields, F.unix_seconds("_p.ts").alias("sec"))


_STATUS_FIELDS = {
    "active": r"Active connections:\s*(\d+)",
    "accepts": r"requests\s*\n\s*(\d+)\s+\d+\s+\d+",
    "handled": r"requests\s*\n\s*\d+\s+(\d+)\s+\d+",
    "requests": r"requests\s*\n\s*\d+\s+\d+\s+(\d+)",
    "reading": r"Reading:\s*(\d+)",
    "writing": r"Writing:\s*(\d+)",
    "waiting": r"Waiting:\s*(\d+)",
}


def parse_conn_status(polls: DataFrame) -> DataFrame:
    """(collected_at, 7 counters) of (collected_at, body); texts that lack a field are left out."""
    fields = [F.regexp_extract("body", p, 1).try_cast("long").alias(n) for n, p in _STATUS_FIELDS.items()]
    return polls.select("collected_at", *fields).dropna()


ZONE_SCHEMA = "struct<serverZones: map<string, struct<requestCounter: bigint, inBytes: bigint, outBytes: bigint, responses: map<string, bigint>, requestMsec: double>>>"


def parse_zone_status(polls: DataFrame) -> DataFrame:
    """One row per poll, zone and response class of (collected_at, body)."""
    zones = polls.select("collected_at", F.explode(F.from_json("body", ZONE_SCHEMA)["serverZones"]).alias("zone", "z"))
    return zones.select("collected_at", "zone", F.col("z.requestCounter").alias("requests"), F.col("z.inBytes").alias("bytes_in"), F.col("z.outBytes").alias("bytes_out"), F.col("z.requestMsec").alias("msec"), F.explode("z.responses").alias("class", "responses"))


def latest_gauges(status: DataFrame) -> DataFrame:
    """The counters of the last poll; no row without polls."""
    return status.agg(F.max_by(F.struct(*status.columns), "collected_at").alias("s")).filter("s is not null").select("s.*")
