"""Personal data: identifiers of fixed forms, and others that the contexts of these lead to.

Bootstrapping: what the fixed forms find are seeds.  The words before and after seeds, and their own shape,
are patterns; a pattern is worth the share of its occurrences, in all texts, that are known identifiers, and
an identifier of a looser form is worth what its patterns are.  Both are scored in turn over the graph of
patterns and instances; instances that reach ACCEPT are identifiers and count for their patterns.
"""

from __future__ import annotations

import ipaddress
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm.common import salted, slices, stage, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Different identifiers that a pattern needs, and rounds of scoring.
SUPPORT, ROUNDS = 3, 3
#: Least worth of a pattern that counts, and of an instance that is taken.
WORTH, ACCEPT = 0.5, 0.9
#: Bits of the filter through which all texts are searched for the contexts of patterns: its size is fixed.
BITS = 1 << 22
#: Code points before and after an identifier in which its context is looked for; tokens kept by a task.
WINDOW, TOKENS = 96, 1 << 18
SALTS = 16

# the fixed forms
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# looser forms, searched where no fixed form was found
_AT = r"(?: ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?| at | AT | ?@ ?)"
_DOT = r"(?: ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| dot | DOT |\.)"
_LOOSE_EMAIL = re.compile(rf"(?<![\w.%+-])[\w.%+-]{{1,64}}{_AT}[\w-]{{1,63}}(?:{_DOT}[\w-]{{1,63}}){{0,8}}")
_LOOSE_IP = re.compile(r"(?<![\w.:])(?:(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}|[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}){3})(?![\w:])")
_GROUPS = re.compile(r"(?<![\w.+])[0-9]+(?:[ .-][0-9]+)*(?!\w)")
_LOOSE_PHONE = re.compile(r"(?<![\w(+])\+?\(?[0-9]{1,4}(?![0-9])\)?(?:[ .-]?\(?[0-9]{2,4}(?![0-9])\)?){1,7}(?!\w)")
_HINT = re.compile(r"[0-9@]|dot|DOT")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_")
_NUMBER = re.compile(r"[0-9]+")

SPAN = "struct<start: bigint, kind: int, end: bigint>"
SEEN = "struct<kind: int, start: bigint, end: bigint, known: boolean, valid: boolean, norm: string, left2: string, left3: string, right2: string, shape: string>"


def luhn(digits: str) -> bool:
    own = [int(c) for c in reversed(digits)]
    return (sum(own[::2]) + sum(sum(divmod(2 * d, 10)) for d in own[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _is_ip(text: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in text.split("."))


def _is_card(text: str) -> bool:
    found = _digits(text)
    return 14 <= len(found) <= 19 and luhn(found)


def _is_phone(text: str) -> bool:
    return 10 <= len(_digits(text)) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: from the @ backwards, as the part before it is all of the characters that reach it."""
    end, at = 0, text.find("@")
    while at >= 0:
        host, start = _HOST.match(text, at), at
        if host:
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, host.end()
                end = host.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all identifiers of the fixed forms, leftmost and without overlaps within a kind."""
    if not _HINT.search(text):
        return []
    out = [(s, 0, e) for s, e in _emails(text)]
    for kind, form, passes in ((1, _IP, _is_ip), (2, _CARD, _is_card), (3, _PHONE, _is_phone)):
        out += [(m.start(), kind, m.end()) for m in form.finditer(text) if passes(m.group())]
    return sorted(out)


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, valid) of what looks like an identifier outside the base spans."""
    parts, at = [], 0
    for start, _, end in base:
        if end > at:
            parts += [text[at:start], "\x00" * (end - max(start, at))]
            at = end
    rest = "".join([*parts, text[at:]])
    out = []
    for m in _LOOSE_EMAIL.finditer(rest) if "@" in rest or "dot" in rest or "DOT" in rest else ():
        marked = "@" in m.group() or re.search("dot|DOT", m.group())
        if marked:
            out.append((m.start(), 0, m.end(), True))
    for m in _LOOSE_IP.finditer(rest):
        found = re.sub(r"[\[\]()]", "", m.group())
        try:
            valid = _is_ip(found) if ":" not in found else bool(ipaddress.ip_address(found))
        except ValueError:
            continue
        out.append((m.start(), 1, m.end(), valid))
    for m in _GROUPS.finditer(rest):
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in _NUMBER.finditer(m.group())]
        for k, (start, end) in enumerate(groups):
            if 14 <= end - start <= 19:
                out.append((start, 2, end, _is_card(rest[start:end])))
            for last in range(k + 2, min(k + 5, len(groups))):
                sizes = [e - s for s, e in groups[k : last + 1]]
                if sizes[0] == 4 and (sizes in ([4, 6, 5], [4, 4, 4, 4]) or sizes[:-1] == [4, 4, 4, 4] and sizes[-1] <= 3):
                    out.append((start, 2, groups[last][1], _is_card(rest[start : groups[last][1]])))
    for m in _LOOSE_PHONE.finditer(rest):
        for g in _NUMBER.finditer(m.group()):
            end = m.start() + g.end()
            end += rest[end : end + 1] == ")" and end < m.end()
            if 7 <= len(_digits(rest[m.start() : end])):
                out.append((m.start(), 3, end, _is_phone(rest[m.start() : end])))
    return out


def _shape(text: str, kind: int) -> str:
    """Digits of numbers as 9, of addresses all runs of letters and digits as a."""
    return re.sub("[0-9]", "9", text) if kind else re.sub(r"(?!\b(?:at|dot|AT|DOT)\b)[\w%+-]+", "a", text)


def tokens(text: str) -> list[str]:
    """Words in lower case, numbers as 0, and single marks."""
    return _TOKEN.findall(_NUMBER.sub("0", text.lower()))


def _observe(text: str, start: int, kind: int, end: int, known: bool, valid: bool) -> dict:
    before, after = tokens(text[max(0, start - WINDOW) : start])[-3:], tokens(text[end : end + WINDOW])[:2]
    own = text[start:end]
    return {
        "kind": kind, "start": start, "end": end, "known": known, "valid": valid,
        "norm": _digits(own) if kind > 1 else own.lower(),
        "left2": " ".join(before[-2:]) if len(before) > 1 else None,
        "left3": " ".join(before) if len(before) > 2 else None,
        "right2": " ".join(after) if len(after) > 1 else None,
        "shape": _shape(own, kind),
    }


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    return to_arrow_type(DataType.fromDDL(kind))


def _hashes(cached: dict[str, int], words: list[str]) -> np.ndarray:
    for word in set(words) - cached.keys():
        cached[word] = zlib.crc32(word.encode("utf-8", "replace"))
    return np.fromiter(map(cached.__getitem__, words), np.uint64, len(words))


def _places(one: np.ndarray, two: np.ndarray, three: np.ndarray | None = None) -> np.ndarray:
    """The filter's bit of two or three words that follow one another."""
    mixed = one * np.uint64(0x9E3779B97F4A7C15) + two * np.uint64(0xC2B2AE3D27D4EB4F)
    if three is not None:
        mixed = mixed * np.uint64(0x165667B19E3779F9) + three
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(32)) & np.uint64(BITS - 1)


def _occurrences(docs: DataFrame, text: str, contexts: DataFrame) -> DataFrame:
    """(context, total): how often each context stands in all texts.  Texts are searched through the filter, and
    what passes wrongly is left out by the join."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached: dict[str, int] = {}
        for batch in batches:
            found = []
            for context in batch.column(0).to_pylist():
                own = _hashes(cached, context.split(" "))
                found.append(int(_places(*[own[k : k + 1] for k in range(len(own))])[0]))
            cached.clear()
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["bit"])

    word = F.expr("bit div 64").alias("word")
    packed = contexts.mapInArrow(bits, "bit long").groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()  # up to BITS / 64 rows
    table = np.zeros(BITS // 64, np.uint64)
    table[packed["word"].to_numpy()] = packed["bits"].to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached: dict[str, int] = {}
        held: Counter = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["context", "n"])

        for batch in batches:
            for part in slices(batch, 128):
                words = tokens("\x00".join(part.column(0).to_pylist()))  # a mark of its own between texts
                if len(cached) > TOKENS:
                    cached.clear()
                own = _hashes(cached, words)
                for size in (2, 3):
                    if len(own) < size:
                        continue
                    at = _places(*[own[k : len(own) - size + 1 + k] for k in range(size)])
                    for k in np.flatnonzero((shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)):
                        held[" ".join(words[k : k + size])] += 1
                if len(held) > TOKENS:
                    yield handed()
                    held.clear()
        yield handed()

    counted = docs.select(text_or_empty(text).alias("text")).mapInArrow(count, "context string, n long")
    return counted.groupBy("context").agg(F.sum("n").alias("total")).join(contexts, "context", "left_semi")


def _graph(seen: DataFrame) -> DataFrame:
    """(kind, side, pattern, norm, known, valid, n): how often an instance is met by a pattern; a pattern of no text is none."""
    at = lambda side, column: F.struct(F.lit(side).alias("side"), F.col(f"s.{column}").alias("pattern"))
    sides = F.array(at("left", "left2"), at("left", "left3"), at("right", "right2"), at("shape", "shape"))
    edges = seen.select("s.kind", "s.norm", "s.known", "s.valid", F.explode(sides).alias("p")).filter("p.pattern is not null")
    return edges.groupBy("kind", "p.side", "p.pattern", "norm", "known", "valid").agg(F.count("*").alias("n"))


def _score(graph: DataFrame, totals: DataFrame) -> DataFrame:
    """(kind, norm, worth) of the looser instances that are taken after ROUNDS rounds."""
    key = ["kind", "side", "pattern"]
    # a pattern may have a third of all instances, and an instance of all patterns
    by = lambda column: F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int").alias("_salt")
    loose = stage(graph.filter("valid and not known").select(*key, "norm", "n"), "pii-loose")
    # what the seeds give a pattern stays; a round adds what is taken so far
    seeds = graph.groupBy(*key).agg(F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("hits"), F.count_if("known").alias("seeds"), F.sum("n").alias("met"))
    seeds = seeds.join(totals.withColumnRenamed("context", "pattern"), "pattern", "left")
    # a shape's occurrences are what was met with it; a context's are counted in all texts, where it has enough instances
    total = F.when(F.col("side") == "shape", F.col("met")).when(F.col("total").isNotNull(), F.greatest("met", "total"))
    seeds = stage(seeds.withColumn("total", total).filter("total is not null"), "pii-patterns")
    taken = None
    for _ in range(ROUNDS):
        patterns = seeds
        if taken is not None:
            more = loose.select("*", by("pattern")).join(salted(taken, SALTS), ["kind", "norm", "_salt"], "left_semi").groupBy(*key).agg(F.sum("n").alias("_more"), F.count("*").alias("_new"))
            patterns = patterns.join(more, key, "left").withColumn("hits", F.col("hits") + F.coalesce("_more", F.lit(0))).withColumn("seeds", F.col("seeds") + F.coalesce("_new", F.lit(0)))
        worth = F.col("hits") / (F.col("total") + 1)
        patterns = patterns.filter((F.col("seeds") >= SUPPORT) & (worth >= WORTH)).select(*key, worth.alias("worth"))
        met = loose.select("*", by("norm")).join(salted(patterns, SALTS), [*key, "_salt"])
        best = [F.coalesce(F.max(F.when(F.col("side") == side, F.col("worth"))), F.lit(0.0)) for side in ("left", "right", "shape")]
        scored = met.groupBy("kind", "norm").agg((1 - (1 - best[0]) * (1 - best[1]) * (1 - best[2])).alias("worth"))
        taken = stage(scored.filter(F.col("worth") >= ACCEPT), "pii-taken")
    return taken


def find_pii(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns with ``base`` and ``spans``, arrays of (start, kind, end) in code points, end exclusive, by start and kind.

    ``base`` are the fixed forms; ``spans`` has these and what the bootstrapping adds, which never overlaps
    another span; of additions that overlap, the one of most worth, then the longest, then the first stays.  An
    addition has a form of its own (an address with its signs spelled out or without a dot, an IPv6 or bracketed
    address, a card number that passes Luhn, 10 to 15 digits of a telephone number).  Null and empty texts have
    none; repeated rows get the same each; texts are read whole; an empty table gives an empty one.
    """
    dtype = _arrow(f"struct<base: array<{SPAN}>, seen: array<{SEEN}>>")

    @F.arrow_udf(f"base array<{SPAN}>, seen array<{SEEN}>")
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for part in slices(batch, 256):
                for text in part.to_pylist():
                    base = base_spans(text)
                    seen = [_observe(text, s, k, e, True, True) for s, k, e in base]
                    if _HINT.search(text):
                        seen += [_observe(text, s, k, e, False, v) for s, k, e, v in loose_spans(text, base)]
                    out.append({"base": [{"start": s, "kind": k, "end": e} for s, k, e in base], "seen": seen})
            yield pa.array(out, dtype)

    rows = docs.select(*carry, look(text_or_empty(text_col)).alias("_found"))
    rows = rows.select(*carry, F.monotonically_increasing_id().alias("_uid"), "_found.base", "_found.seen")
    rows = stage(rows, "pii-seen")
    seen = rows.select("_uid", F.explode("seen").alias("s"))
    graph = stage(_graph(seen), "pii-graph")
    # contexts of enough different instances, known or not, may come to count in some round
    many = graph.filter("valid and side <> 'shape'").groupBy("kind", "side", "pattern").count().filter(F.col("count") >= SUPPORT)
    contexts = stage(many.select(F.col("pattern").alias("context")).distinct(), "pii-contexts")
    taken = _score(graph, stage(_occurrences(docs, text_col, contexts), "pii-occurrences"))

    loose = seen.filter("s.valid and not s.known").select("_uid", "s.kind", "s.norm", "s.start", "s.end")
    salt = F.pmod(F.col("_uid"), F.lit(SALTS)).cast("int")
    met = loose.withColumn("_salt", salt).join(salted(taken, SALTS), ["kind", "norm", "_salt"])
    order = F.array_sort(F.collect_list(F.struct((-F.col("worth")).alias("w"), (F.col("start") - F.col("end")).alias("l"), "start", "kind", "end")))
    span = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    clear = lambda kept, c: ~F.exists(kept, lambda x: (x["start"] < c["end"]) & (c["start"] < x["end"]))
    chosen = F.aggregate(order, F.array().cast(f"array<{SPAN}>"), lambda kept, c: F.when(clear(kept, c), F.array_append(kept, span(c))).otherwise(kept))
    added = met.groupBy("_uid").agg(chosen.alias("_added"))
    open_ = F.exists("seen", lambda s: s["valid"] & ~s["known"])
    plain = rows.filter(~open_).select(*carry, "base", F.col("base").alias("spans"))
    other = rows.filter(open_).drop("seen").join(added, "_uid", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("_added", F.array().cast(f"array<{SPAN}>"))))
    return plain.unionByName(other.select(*carry, "base", spans.alias("spans")))
