"""Exact dedup by most-significant-digit radix partitioning.

Documents are split by length in bytes, then by successive runs of bytes, level after level, until
a group has one row or its text has ended.  Texts are compared themselves; no digest decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblens.llm.common import WHITE, discard, salted, stage, text_or_empty

#: Bytes of the digits of the first levels.  What is longer goes on in blocks of BLOCK bytes: no key has more.
DIGITS, BLOCK = (32, 512, 4096, 32768), 65536
#: A group may hold a third of all rows: the rows of one of LARGE rows or more are dealt over so many join keys.
SALTS, LARGE = 16, 2000


def _spread(groups: DataFrame) -> DataFrame:
    """Groups once per join key of their rows: only what comes of a large group has several."""
    return groups.withColumn("_salt", F.explode(F.when(F.col("_of") >= LARGE, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))


def _dealt() -> Column:
    """The join key of a row, from the size of the group it comes from."""
    return F.when(F.col("_of") >= LARGE, F.pmod(F.xxhash64("_uid"), F.lit(SALTS)).cast("int")).otherwise(0)


def _regroup(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows with _gid (the least uid of the rows with the same key) and _n (their number); null where a row is alone.

    ``_of`` is the size of the group that a row comes from; all rows of a key come from one.
    """
    groups = rows.groupBy(*key).agg(F.min("_uid").alias("_gid"), F.count("*").alias("_n"), F.first("_of").alias("_of")).filter("_n > 1")
    return rows.drop("_gid", "_n").withColumn("_salt", _dealt()).join(_spread(groups).drop("_of"), [*key, "_salt"], "left")


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows with their remaining bytes replaced by _next, the array of their blocks' numbers.

    Blocks at one place of the texts of one group have the same number (the least uid that has them)
    if and only if they are equal, so equal arrays are equal texts and a key is a few longs.
    """
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("_rest") - 1) / BLOCK).cast("int")), lambda k: F.substr("_rest", k * BLOCK + 1, F.lit(BLOCK)))
    parts = rows.select("_uid", "_of", _dealt().alias("_salt"), "_group", F.posexplode(cut).alias("_at", "_block"))
    numbered = parts.groupBy("_group", "_at", "_block").agg(F.min("_uid").alias("_number"), F.first("_of").alias("_of"))
    named = parts.drop("_of").join(_spread(numbered).drop("_of"), ["_group", "_at", "_block", "_salt"])
    rest = named.groupBy("_uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_number"))), lambda p: p["_number"]).alias("_next"))
    return rows.drop("_rest").join(rest, "_uid")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (and ``carry``).

    Texts are equal when identical without the six ASCII white-space characters; null is empty, and
    all empty texts are one group.  Of a group the row with the most code points stays, then the
    smallest id (null ids last), then any one of repeated rows, so exactly one row of each group is
    kept.  Very long texts are compared in blocks.  An empty table gives an empty one.
    """
    text = text_or_empty(text_col)
    norm = F.translate(text, WHITE, "")
    base = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("_chars"), norm.alias("_norm"), *carry)
    base = base.withColumn("_bytes", F.octet_length("_norm")).withColumn("_norm", F.col("_norm").cast("binary"))
    base = base.withColumn("_digit", F.substring("_norm", 1, DIGITS[0]))

    groups = base.groupBy("_bytes", "_digit").agg(F.count("*").alias("_n")).filter("_n > 1")
    numbered = base.withColumn("_uid", F.monotonically_increasing_id())
    salt = F.pmod(F.xxhash64("_uid"), F.lit(SALTS)).cast("int")
    first = numbered.withColumn("_salt", salt).join(salted(groups, SALTS), ["_bytes", "_digit", "_salt"], "left").drop("_salt")
    several = F.col("_n").isNotNull()
    rest = F.when(several & (F.col("_bytes") > DIGITS[0]), F.expr(f"substring(_norm, {DIGITS[0] + 1}, length(_norm))"))
    first = stage(first.withColumn("text_sha256", F.sha2("_norm", 256)).withColumn("_rest", rest).drop("_norm"), "radix-1")

    out = ["doc_id", "_uid", "_chars", "text_sha256", *carry]
    alone = first.filter("_n is null").select(*out, F.lit(None).cast("long").alias("_gid"))
    # groups whose text ended within the first digit
    several = first.filter("_n is not null").withColumnRenamed("_n", "_of")
    done = [_regroup(several.filter(F.col("_bytes") <= DIGITS[0]), ["_bytes", "_digit"]).select(*out, "_gid")]
    left = several.filter(F.col("_bytes") > DIGITS[0])
    key, at, level, tables = ["_bytes", "_digit"], DIGITS[0], 1, [first]
    while left.limit(1).count():
        if level < len(DIGITS):
            width = DIGITS[level]
            cut = left.withColumn("_next", F.expr(f"substring(_rest, 1, {width})")).withColumn("_rest", F.expr(f"substring(_rest, {width + 1}, length(_rest))"))
            ended = F.col("_gid").isNull() | (F.col("_bytes") <= at + width)
        else:
            cut, width, ended = _blocks(left).withColumn("_rest", F.lit(None).cast("binary")), 0, F.lit(True)
        level += 1
        grouped = _regroup(cut, [*key, "_next"])
        grouped = grouped.withColumn("_rest", F.when(~ended, F.col("_rest"))).select(*out, "_bytes", "_gid", "_n", "_rest", ended.alias("_ended"))
        grouped = stage(grouped, f"radix-{level}")
        tables.append(grouped)
        done.append(grouped.filter("_ended").select(*out, "_gid"))
        left = grouped.filter("not _ended").withColumnRenamed("_gid", "_group").withColumnRenamed("_n", "_of")
        key, at = ["_bytes", "_group"], at + width
    rows = alone
    for part in done:
        rows = rows.unionByName(part)
    rows = stage(rows, "radix-groups")  # without the texts
    discard(*tables)

    best = F.min(F.struct(-F.col("_chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("_uid")))
    groups = rows.filter("_gid is not null").groupBy("_gid").agg(best.alias("_best"), F.count("*").alias("group_size"))
    groups = groups.select("_gid", F.col("_best.doc_id").alias("keep_id"), F.col("_best._uid").alias("_keep"), "group_size")
    several = rows.filter("_gid is not null").withColumn("_salt", F.pmod(F.col("_uid"), F.lit(SALTS)).cast("int"))
    several = several.join(salted(groups, SALTS), ["_gid", "_salt"]).withColumn("kept", F.col("_uid") == F.col("_keep"))
    single = rows.filter("_gid is null").withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(1).cast("long")).withColumn("kept", F.lit(True))
    shown = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", *carry]
    return single.select(*shown).unionByName(several.select(*shown))
