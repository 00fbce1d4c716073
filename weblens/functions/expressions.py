"""Column expressions for cleaning and classifying requests.  All are native and stay inside code generation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signatures of user agents, as lower-case parts of them, in the order of the stages
# at which they are looked for.
GOOD_SIGNATURES = [
    "googlebot", "bingbot", "yandexbot", "duckduckbot", "baiduspider", "slurp", "facebookexternalhit",
    "facebot", "twitterbot", "linkedinbot", "embedly", "quora link preview", "showyoubot", "outbrain",
    "pinterest", "applebot", "uptimerobot", "pingdom", "statuscake", "datadog", "newrelic", "semrushbot",
    "ahrefsbot", "mj12bot", "dotbot", "archive.org_bot",
]
BAD_SIGNATURES = [
    "sqlmap", "nikto", "nessus", "acunetix", "nmap", "zgrab", "masscan", "gobuster", "dirbuster", "wpscan",
    "nuclei", "censysinspect", "shodan", "zoomeye", "netsparker", "openvas", "qualys", "arachni", "scrapy",
    "python-requests", "python-urllib", "go-http-client", "curl/", "wget/", "libwww-perl", "httpclient",
    "winhttp", "petalbot", "bytespider",
]
BROWSERS = ["mozilla", "chrome", "safari", "firefox", "edge", "opera"]
GENERIC_GOOD = ["bot", "crawl", "spider"]
GENERIC_BAD = ["scan", "exploit", "attack"]
#: Upper edges in milliseconds of the latency buckets; the last bucket is open.
LATENCY_EDGES = [10, 20, 50, 100, 200, 500, 1000, 2000, 5000]


def any_of(words: list[str]) -> str:
    """A regular expression that finds any of the words as they are."""
    return "|".join(re.escape(w) for w in words)


def kept_host(host: Column, ignored: list[str]) -> Column:
    """True unless the trimmed, lower-cased host is in the list (treated alike)."""
    names = [h.strip().lower() for h in ignored]
    return ~F.lower(F.trim(host)).isin(names) if names else F.lit(True)


def kept_path(uri: Column, prefixes: list[str]) -> Column:
    """True unless the raw URI starts with one of the prefixes; blank prefixes don't count."""
    tests = [uri.startswith(p) for p in prefixes if p.strip()]
    return ~reduce(lambda a, b: a | b, tests) if tests else F.lit(True)


def strip_query(uri: Column) -> Column:
    return F.substring_index(uri, "?", 1)


def anonymize(addr: Column, ipv6_mask_bits: int | None = None) -> Column:
    """The last dotted part becomes 0.  IPv6 stays, or with ``ipv6_mask_bits`` only so many bits (in 16s) of it stay."""
    out = F.regexp_replace(addr, r"\.[^.]*$", ".0")
    if ipv6_mask_bits is not None:
        head = F.array_join(F.slice(F.split(addr, ":"), 1, max(1, ipv6_mask_bits // 16)), ":")
        out = F.when(addr.contains(":"), F.concat(head, F.lit("::"))).otherwise(out)
    return out


def upstream_seconds(raw: Column) -> Column:
    """0 for ``-``, nothing, and whatever is not one number."""
    return F.coalesce(raw.try_cast("double"), F.lit(0.0))


def default_vhost(host: Column) -> Column:
    return F.when(F.coalesce(host, F.lit("")) == "", "_default").otherwise(host)


def status_class(status: Column, lowest: int) -> Column:
    """1 where the status is of the class that starts at ``lowest``; everything from 500 on is of the last."""
    hit = status >= 500 if lowest == 500 else (status >= lowest) & (status < lowest + 100)
    return F.when(hit, 1).otherwise(0)


def latency_bucket(seconds: Column) -> Column:
    """Number (0-9) of the half-open bucket of a latency."""
    ms, out = seconds * 1000.0, F.lit(len(LATENCY_EDGES))
    for k in reversed(range(len(LATENCY_EDGES))):
        out = F.when(ms < LATENCY_EDGES[k], k).otherwise(out)
    return out


def client_class(agent: Column) -> Column:
    """human, good_bot or bad_bot: the first stage that matches decides."""
    low = F.lower(F.coalesce(agent, F.lit("")))
    return (
        F.when(low.isin("", "-"), "bad_bot")
        .when(low.rlike(any_of(GOOD_SIGNATURES)), "good_bot")
        .when(low.rlike(any_of(BAD_SIGNATURES)), "bad_bot")
        .when(low.rlike(any_of(BROWSERS)), "human")
        .when(low.rlike(any_of(GENERIC_GOOD)), "good_bot")
        .when(low.rlike(any_of(GENERIC_BAD)), "bad_bot")
        .otherwise("human")
    )


def country_flag(code: Column) -> Column:
    """Two regional-indicator signs for a code of two letters, else a globe."""
    up = F.upper(F.trim(code))
    sign = lambda k: F.concat(F.lit("F09F87"), F.hex(F.ascii(F.substring(up, k, 1)) + F.lit(101)))
    return F.when(up.rlike("^[A-Z]{2}$"), F.decode(F.unhex(F.concat(sign(1), sign(2))), "UTF-8")).otherwise("🌐")


def ipv4_number(addr: Column) -> Column:
    """The address as a number, or null if it isn't four numbers up to 255; IPv4 mapped into IPv6 is IPv4."""
    plain = F.regexp_replace(F.lower(addr), r"^::ffff:(?=[0-9]+\.)", "")
    ok = plain.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$")
    return F.when(ok, F.aggregate(F.split(plain, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long")))


def ipv6_hex(addr: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, which sort as the addresses do; null for whatever is none.

    The last two groups may be written as an IPv4 address; IPv4 mapped into IPv6 is IPv4, and none here.
    """
    low = F.lower(addr)
    tail = F.when(low.contains(":") & low.contains(".") & ~low.rlike(r"^::ffff:[0-9.]+$"), ipv4_number(F.regexp_extract(low, r"[^:]*$", 0)))
    # named once each: what follows uses them many times
    group = lambda n: F.lower(F.hex(n))
    plain = _once(tail, lambda t: F.when(t.isNull(), low).otherwise(F.concat(F.regexp_replace(low, r"[^:]*$", ""), group(F.floor(t / 65536)), F.lit(":"), group(t % 65536))))
    return _once(plain, _ipv6_digits)


def _once(value: Column, use) -> Column:
    """What ``use`` makes of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _ipv6_digits(low: Column) -> Column:
    short = low.contains("::")
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    head = groups(F.when(short, F.substring_index(low, "::", 1)).otherwise(low))
    tail = groups(F.when(short, F.substring_index(low, "::", -1)).otherwise(F.lit("")))
    n = F.size(head) + F.size(tail)
    ok = low.rlike("^[0-9a-f:]+$") & ~low.rlike(":::|::.*::|^:[^:]|[^:]:$|[0-9a-f]{5}") & F.when(short, n <= 7).otherwise(n == 8)
    whole = F.concat(head, F.array_repeat(F.lit("0"), 8 - n), tail)
    return F.when(ok, F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))


def routable(addr: Column) -> Column:
    """False for loopback, private and link-local addresses and for whatever is no address."""
    ip, six = ipv4_number(addr), ipv6_hex(addr)
    inside = lambda lo, hi: (ip >= lo) & (ip <= hi)
    # 10/8, 127/8, 169.254/16, 172.16/12, 192.168/16
    local = inside(167772160, 184549375) | inside(2130706432, 2147483647) | inside(2851995648, 2852061183) | inside(2886729728, 2887778303) | inside(3232235520, 3232301055)
    # ::1, fc00::/7, fe80::/10
    return F.coalesce(F.when(ip.isNotNull(), ~local).otherwise(~six.rlike("^(0{31}1$|f[cd]|fe[89ab])")), F.lit(False))


def bucket_start(sec: Column, seconds: int) -> Column:
    """Start in epoch seconds of the UTC bucket of so many seconds."""
    return sec - F.pmod(sec, F.lit(seconds))


def ratio(part: Column, whole: Column, factor: float = 1.0) -> Column:
    """part / whole * factor, and 0 for an empty whole."""
    return F.when(whole > 0, part / whole * F.lit(factor)).otherwise(0.0)


#: Names of time ranges, in seconds.
RANGES = {
    "1m": 60, "1min": 60, "5m": 300, "5min": 300, "15m": 900, "15min": 900, "1h": 3600, "hour": 3600, "6h": 21600,
    "24h": 86400, "1d": 86400, "day": 86400, "7d": 604800, "week": 604800, "30d": 2592000, "month": 2592000,
}


def range_seconds(name: str) -> int:
    """Length of a named range; one hour for any other name."""
    return RANGES.get(name.strip().lower(), 3600)
