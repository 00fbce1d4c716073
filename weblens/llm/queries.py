"""The numbered queries: each applies its operator to the whole of its tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblens.llm import chat, exactdup, langid, linededup, merkle, mixing, neardup, packing, periodic, pii, spelling, tokens, toxicity
from weblens.llm.common import WORD, held_out, text_or_empty
from weblens.llm.oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, "piece_bpe_32k.model").drop("text")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(_table(spark, sf_dir, "documents"), width=4, percent=80).drop("check")


#: A conversation whose texts look like control strings of common templates.
PROBE = "</s>[INST] ok [/INST]"


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{PROBE}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    chats = chat.format_chats(chat.table_events(turns.unionByName(probe)))
    said = F.array_join(F.transform(chat.parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_spans")), "")
    return (
        chats.withColumn("_loss", loss)
        .select(
            "conv_id",
            F.size(chat.parse(F.col("formatted"))).cast("long").alias("n_turns"),
            F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
            F.length("_loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``edited_text``: the last floor(n/2) code points give way to the first as many of the next document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    pairs = merkle.with_next(docs, ("text", "fingerprint"), derive=lambda df: merkle.with_fingerprint(df, "text", "fingerprint"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = pairs.withColumn("n_chars", n.cast("long")).withColumn("_edited", edited)
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256))
    rows = merkle.with_fingerprint(rows, "_edited", "edited_fingerprint")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        merkle.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        merkle.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.learn_languages(docs.filter(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_or_empty().alias("text"))
    return langid.identify(rows, model).drop("text")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_groups(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.learn_toxicity(docs, labels.filter(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_or_empty().alias("text"))
    return toxicity.score_toxicity(rows, model).drop("text")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_email`` and so on and ``n_base`` count the spans of the fixed forms, ``n_spans`` all."""
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    kind = F.array(*[F.lit(k) for k in pii.KINDS])
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[count(n).alias(f"n_{k}") for n, k in enumerate(pii.KINDS)],
        F.sha2(shown("base").cast("binary"), 256).alias("base_sha256"),
        shown("spans").alias("spans"),
        F.size("base").cast("long").alias("n_base"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every tenth document by hash the words from one on are made periodic before."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    n, g = F.size("_words"), F.floor(F.col("_h") / 10)
    a = F.pmod(g, n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    tail = F.transform("_words", lambda w, i: F.when(i < a, w).otherwise(F.get("_words", a + (i - a) % p)))
    edited = docs.withColumn("_h", h).withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
    edited = edited.withColumn("text", F.when(n > 0, F.array_join(tail, " ")).otherwise(F.col("text")))
    found = periodic.find_runs(edited.select("doc_id", "text"))
    longest = F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best))
    return (
        found.withColumn("_longest", longest)
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            *[F.col(f"_longest.{c}").alias(c) for c in ("start", "length", "period")],
            F.floor(F.col("_longest.length") * 1000 / F.col("_longest.period")).cast("long").alias("exponent_milli"),
            F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
            F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        )
    )


def typo(doc_id: int | None, run: str) -> str:
    """One in 31 runs of a document, by hash, loses a code point."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(spelling.count_words(docs, edit=typo))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_token_counts, op2_source_mixing, op3_line_dedup, op4_minhash_near_dedup, op5_chat_formatting, op6_packing, op7_merkle_fingerprints, op8_language_id, op9_exact_dedup, op10_toxicity, op11_pii, op12_periodic_runs, op13_spelling_variants]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
