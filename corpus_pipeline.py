"""A corpus pipeline over ``documents``: toxicity, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and its result is
written as Parquet and read again as the next one's docs.  Every stage takes null ids, texts,
languages and sources, empty and very long texts, repeated rows and rows that share an id, and an
empty table (which gives an empty one); columns other than those of ``documents`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblens.llm import linededup, mixing, neardup, packing, toxicity
from weblens.llm.common import discard, held_out, salted, stage, staged_within

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on labels outside the held-out quarter, doesn't reject.

    Null and empty texts have no toxic word and stay; repeated rows go or stay alike; without labels all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id")))
    model = toxicity.learn_toxicity(docs, labels)
    return toxicity.score_toxicity(docs, model).filter("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that three or more share, save in the last that has them; n_chars follows.

    A null text stays null; a text that loses all its lines is empty; repeated rows are one document that keeps or loses a line in each.
    """
    kept = linededup.dedup_lines(docs)
    text = F.when(F.col("text").isNotNull() | (F.col("kept") != ""), F.col("kept"))
    return kept.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): that of the smallest id (null ids last) and text hash.

    Of repeated rows the least by its columns stays.  Texts without words, null ones too, are in no group, and all are kept.
    """
    rows = neardup.rooted_groups(docs, width=5, percent=80)
    same = rows.groupBy("root", "doc_id", "check").agg(F.count("*").alias("n"))
    first = same.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "check", "n")).alias("_f"))
    first = first.select(F.col("_f.doc_id").alias("_id"), F.col("_f.check").alias("_check"), F.col("_f.n").alias("_n"))
    wordless = same.filter("root is null").select(F.col("doc_id").alias("_id"), F.col("check").alias("_check"), F.lit(1).cast("long").alias("_n"))
    groups = stage(first.unionByName(wordless), "pipeline-near-first")
    check = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    keys = lambda left, right: left["doc_id"].eqNullSafe(right["_id"]) & (check == right["_check"])
    once, again = groups.filter("_n = 1"), groups.filter("_n > 1")
    kept = docs.join(once.hint("shuffle_hash"), keys(docs, once), "left_semi").select(*COLUMNS)
    if again.limit(1).count():  # repeated rows: one of each, met first where they lie
        salts = neardup.SALTS
        dealt, repeated = docs.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")), salted(again, salts)
        found = dealt.join(repeated.hint("shuffle_hash"), keys(dealt, repeated) & (dealt["_salt"] == repeated["_salt"]), "left_semi")
        found = found.groupBy("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_check")).agg(F.min(F.struct(*COLUMNS)).alias("_m"))
        kept = kept.unionByName(found.select("_m.*"))
    return kept


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers of copies that the mix gives them, 0 to 2.

    A null source is a source; null and empty texts have size 0 and are copied as any other document; of
    repeated rows, equal in order, either gets a copy more.
    """
    return mixing.emit(mixing.mix(docs.withColumn("_src", F.col("source")), source_col="_src", carry=("text", "lang", "n_chars"))).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in windows of 4096 tokens; each copy is packed, and a null or empty text is one end token."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: SQL can't express the fitted toxicity model; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage staged, and what it read, goes when its result has been written."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        with staged_within(spark) as kept:
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(docs)
        if read is not None:
            discard(read)
        read = docs
    return STAGES[-1][1](spark, docs, sf_dir)
