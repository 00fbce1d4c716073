"""Mixing sources to target weights by systematic sampling.

Each document of a source expects ``target / source_size`` copies.  Along an order of the source's
documents the expected copies are summed up, one random offset per source is added, and a document
is emitted once for every integer that its part of the sum crosses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblens.llm.common import WORD, stage, text_or_empty

#: Documents of about one size are dealt over so many sub-buckets at least, one for each ROWS rows of the table.
SUBS, ROWS = 64, 1 << 20


def sub_buckets(rows: int) -> int:
    """A power of two, so that no bucket holds many more than ROWS rows whatever part of the table a source is."""
    return max(SUBS, 1 << max(0, -(-rows // ROWS) - 1).bit_length())


def sub_bucket(doc_id: Column, n: int) -> Column:
    """The sub-bucket of an id by its MD5, so that no pattern of ids fills one; 0 for a null id."""
    number = F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return F.coalesce(F.pmod(number, F.lit(n)), F.lit(0)).cast("int")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Targets of sources: ``share`` of all sizes by weight, none above ``most`` times its own size.

    ``sizes`` has source, source_size.  Sources by code point, null last, weigh ``weights`` over and
    over.  What a source can't take is shared anew by weight until none is above: that ends at one
    level L with target = min(most * size, L * weight), found here by a running sum over the sources
    in the order in which they fill up.  There is a row per source, not per document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    fill = Window.orderBy(F.col("_full"), F.col("source").isNull(), F.col("source"))
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    every = Window.partitionBy()
    return (
        sizes.withColumn("_weight", weight.cast("double"))
        .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_full", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))) / F.sum("_weight").over(rest))
        .withColumn("_place", F.row_number().over(fill))
        .withColumn("_level", F.min_by("_level", F.when(F.col("_level") <= F.col("_full"), F.col("_place"))).over(every))
        .withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_level"), F.col("_full")) * F.col("_weight")))
        .select("source", "source_size", "target")
    )


def offset(source: Column, seed: int) -> Column:
    """A source's random offset in [0, 1): the same in every run with the same seed."""
    name = F.concat(F.lit(f"{seed}:"), F.when(source.isNull(), "n").otherwise("s"), F.coalesce(source, F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (and ``carry``).

    Within a source the order is (size class, sub-bucket of the id, size, id).  The running sum never passes
    through one task: counts of the small buckets (size class, sub-bucket) are summed up per source, and
    within a bucket rows are only numbered.  Null and empty texts have size 0 and take no words.
    Null sources form one source.  Null ids come first in their bucket; repeated rows are documents
    of their own, equal in order, so it doesn't matter which of them gets a copy more.  Very long texts are counted
    whole; columns other than those named are ignored.  An empty table gives an empty one.
    """
    size = word_count(text_or_empty(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), *carry)
    bits = F.length(F.bin("size"))
    rows = rows.withColumn("_class", (bits * 8 + F.expr("shiftright(size, greatest(length(bin(size)) - 3, 0))")).cast("int"))
    whole = stage(rows.withColumn("_row", F.monotonically_increasing_id()) if carry else rows, "mix-sizes")
    rows = whole.drop(*carry).withColumn("_sub", sub_bucket(F.col("doc_id"), sub_buckets(whole.count())))

    key = ["source", "_class", "_sub"]
    buckets = rows.groupBy(*key).agg(F.count("*").alias("_n"), F.sum("size").alias("_words"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, most)
    before = Window.partitionBy("source").orderBy("_class", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n", "_words")
    same = buckets["source"].eqNullSafe(targets["source"])
    buckets = buckets.join(targets, same, "left").drop(targets["source"])

    own = Window.partitionBy(*key).orderBy("size", "doc_id")
    ranked = rows.withColumn("_rank", F.row_number().over(own))
    b = buckets.select(F.col("source").alias("_s"), F.col("_class").alias("_c"), F.col("_sub").alias("_u"), "_before", "source_size", "target")
    joined = ranked.join(b, ranked["source"].eqNullSafe(b["_s"]) & (ranked["_class"] == b["_c"]) & (ranked["_sub"] == b["_u"]), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = (F.col("_before") + F.col("_rank")).cast("double")
    crossed = F.floor(rate * at + offset(F.col("source"), seed)) - F.floor(rate * (at - 1) + offset(F.col("source"), seed))
    out = joined.withColumn("copies", F.least(crossed, F.lit(int(-(-most // 1)))).cast("long"))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    if carry:  # what is carried meets its row again at the end and is never sorted
        out = whole.select("_row", *carry).join(out.hint("shuffle_hash"), "_row")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", *carry)


def emit(mixed: DataFrame) -> DataFrame:
    """Each row as often as its copies say."""
    return mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_copy")
