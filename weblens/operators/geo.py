"""Countries of addresses by a range join that is an equi-join on address prefixes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.functions import expressions as E

#: Addresses of a bucket: /24 networks.  A range wider than WIDE buckets is listed by /8 networks instead.
NARROW, WIDE, COARSE = 256, 256, 1 << 24
#: Digits that name a bucket of IPv6: /48 networks; a range wider than WIDE buckets is listed by /32, then by /16 networks.
DIGITS = (12, 8, 4)


def normal_ranges(ranges: DataFrame, start: str = "start_ip", end: str = "end_ip") -> DataFrame:
    """Upper-case codes, the registered country where there is none, the code where there is no name."""
    has = set(ranges.columns)
    reg = F.upper("reg_code") if "reg_code" in has else F.lit(None).cast("string")
    code = F.coalesce(F.nullif(F.upper("code"), F.lit("")), reg, F.lit(""))
    reg_name = F.col("reg_name") if "reg_name" in has else F.lit(None).cast("string")
    return ranges.select(start, end, code.alias("code"), F.coalesce(F.nullif(F.col("name"), F.lit("")), reg_name, code).alias("name"))


def _prefix(digits, n: int):
    return F.conv(F.substring(digits, 1, n), 16, 10).cast("long")


#: Kinds of buckets: IPv4 by /24 and /8 networks, then IPv6 by the prefixes of DIGITS.
_KINDS4, _KINDS6 = (NARROW, COARSE), DIGITS


def _listed4(ranges: DataFrame) -> DataFrame:
    """(_kind, _b, start_ip, end_ip, code, name, _rank): ranges by their buckets; the narrowest has the least rank."""
    wide = F.col("end_ip") - F.col("start_ip") >= NARROW * WIDE
    width = F.when(wide, COARSE).otherwise(NARROW)
    buckets = F.sequence(F.floor(F.col("start_ip") / width), F.floor(F.col("end_ip") / width))
    listed = normal_ranges(ranges).withColumns({"_kind": wide.cast("int"), "_b": F.explode(buckets)})
    return listed.withColumn("_rank", F.hex(F.col("end_ip") - F.col("start_ip"))).withColumn("_rank", F.lpad("_rank", 16, "0"))


def _listed6(ranges: DataFrame) -> DataFrame:
    """The same of IPv6, with start_hex and end_hex; the range that begins last, then the one that ends first, has the least rank."""
    span = lambda n: _prefix("end_hex", n) - _prefix("start_hex", n)
    level = F.when(span(DIGITS[0]) < WIDE, 0).when(span(DIGITS[1]) < WIDE, 1).otherwise(2)
    ends = [F.coalesce(*[F.when(F.col("_kind") == len(_KINDS4) + k, _prefix(c, n)) for k, n in enumerate(DIGITS)]) for c in ("start_hex", "end_hex")]
    listed = normal_ranges(ranges, "start_hex", "end_hex").withColumn("_kind", level + len(_KINDS4)).withColumn("_b", F.explode(F.sequence(*ends)))
    return listed.withColumn("_rank", F.concat(F.translate("start_hex", "0123456789abcdef", "fedcba9876543210"), "end_hex"))


def locate(requests: DataFrame, ranges: DataFrame, addr: str = "addr", ranges6: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``requests`` with code and name: empty where no range holds the address.

    Distinct addresses are looked up by the prefixes of the networks that ranges are listed by; then
    they are joined back.  Of several ranges the narrowest counts, then the lower code.  ``ranges``
    has start_ip and end_ip as numbers, ``ranges6`` start_hex and end_hex as 32 lower-case
    hexadecimal digits.  ``keep`` stores what was found before it is joined: then its size is known when
    the join is planned, and few addresses need no shuffle of the requests.
    """
    addresses = requests.groupBy(F.col(addr).alias("_addr")).agg(F.count("*").alias("_n"))
    # as a matter of the count, so that addresses are read once each and not once a request
    addresses = addresses.filter(F.when(F.col("_n") > 0, E.routable(F.col("_addr")))).drop("_n").withColumn("_ip", E.ipv4_number(F.col("_addr")))
    probes = [F.when(F.col("_ip").isNotNull(), F.struct(F.lit(k).alias("_kind"), F.floor(F.col("_ip") / width).alias("_b"))) for k, width in enumerate(_KINDS4)]
    listed, inside = _listed4(ranges), F.col("_ip").between(F.col("start_ip"), F.col("end_ip"))
    if ranges6 is not None:
        addresses = addresses.withColumn("_hex", E.ipv6_hex(F.col("_addr")))
        probes += [F.when(F.col("_hex").isNotNull(), F.struct(F.lit(len(_KINDS4) + k).alias("_kind"), _prefix("_hex", n).alias("_b"))) for k, n in enumerate(_KINDS6)]
        listed = listed.unionByName(_listed6(ranges6), allowMissingColumns=True)
        inside = F.coalesce(inside, F.col("_hex").between(F.col("start_hex"), F.col("end_hex")))
    probed = addresses.withColumn("_p", F.explode(F.filter(F.array(*probes), lambda p: p.isNotNull())))
    probed = probed.select(*addresses.columns, "_p._kind", "_p._b")
    hits = probed.join(listed, ["_kind", "_b"]).filter(inside)
    found = hits.groupBy("_addr").agg(F.min(F.struct("_rank", "code", "name")).alias("_m")).select("_addr", "_m.code", "_m.name")
    found = keep(found) if keep else found
    joined = requests.join(found, requests[addr] == found["_addr"], "left").drop("_addr")
    return joined.withColumn("code", F.coalesce("code", F.lit(""))).withColumn("name", F.coalesce("name", F.lit("")))


def counted(requests: DataFrame, *keys: str, addr: str = "raw_addr") -> DataFrame:
    """(keys, sec, addr, n): numbers of requests by minute (as ``sec``) and address, to be looked up in their place.

    A busy address then is a row a minute, and no request is sent anywhere by its address.
    """
    return requests.groupBy(*keys, E.bucket_start(F.col("sec"), 60).alias("sec"), addr).agg(F.count("*").alias("n"))
