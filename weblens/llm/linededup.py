"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches.  A batch's distinct line keys are merge-anti-joined with the runs that
hold all earlier keys; keys that no run knows get the batch's largest document as holder, keys that
are known only add to the count, and the batch's entries become a run of level 0.  When a level has
``fan_in`` runs they are merged into one run of the next level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblens.llm.common import WHITE, ascii_lower, by_buckets, discard, free_name, key_buckets, salted, stage, stage_sorted, text_or_empty

#: A very common line is dealt over so many join keys.
SALTS = 16
#: Batches into which a one-off table is cut, and runs of a level that are merged into one.
BATCHES, FAN_IN = 4, 2
#: The key of a run.
HASH = ("h1", "h2")


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def line_hash(key: Column) -> Column:
    """128 bits in two longs of two seeds of one family: different lines hardly ever meet, though nothing proves it."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key, F.length(key)).alias("h2"))


class LineRuns:
    """Runs of (h1, h2, holder, n) in levels.  ``holder`` is null in entries that only count.

    A run is a table in buckets by hash, each sorted by it, so only a new batch is shuffled and sorted:
    it meets the runs in merge joins bucket by bucket, and two runs are merged where they lie.  All runs
    of one object have the same number of buckets.
    """

    def __init__(self, fan_in: int = FAN_IN, buckets: int | None = None) -> None:
        self.fan_in, self.buckets, self.levels, self._written = fan_in, buckets, [[]], []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def known(self) -> DataFrame | None:
        """All entries, one for each key, or None before the first batch."""
        return self.merged(*self.runs()) if self.runs() else None

    def _write(self, df: DataFrame) -> DataFrame:
        self._written.append(stage_sorted(df, "line-run", self.buckets, *HASH))
        return self._written[-1]

    def drop(self) -> None:
        """Delete all tables; frames returned by ``add`` can't be read afterwards."""
        discard(*self._written)
        self.levels, self._written = [[]], []

    @staticmethod
    def merged(*runs: DataFrame) -> DataFrame:
        """The runs as one, by a merge join of two at a time."""
        whole = runs[0].select(*HASH, "holder", "n")
        for run in runs[1:]:
            other = run.select(*HASH, F.col("holder").alias("holder_"), F.col("n").alias("n_")).hint("merge")
            sums = F.coalesce("n", F.lit(0)) + F.coalesce("n_", F.lit(0))
            whole = whole.join(other, list(HASH), "full").select(*HASH, F.greatest("holder", "holder_").alias("holder"), sums.alias("n"))
        return whole

    def met(self, batch: DataFrame) -> DataFrame:
        """The entries of a batch of (h1, h2, doc_id), a row per document and key, as a run: ``fresh`` if no run knew the key."""
        counted = batch.groupBy(*HASH).agg(F.max("doc_id").alias("holder"), F.count("*").alias("n"))
        fresh = F.lit(True)
        for k, run in enumerate(self.runs()):
            counted = counted.join(run.select(*HASH, F.lit(True).alias(f"in_{k}")).hint("merge"), list(HASH), "left")
            fresh &= F.col(f"in_{k}").isNull()
        return counted.select(*HASH, F.when(fresh, F.col("holder")).alias("holder"), "n", fresh.alias("fresh"))

    def add(self, batch: DataFrame) -> DataFrame:
        """Take a batch of (h1, h2, doc_id), a row per document and key; return the keys that no run knew."""
        spark = batch.sparkSession
        self.buckets = self.buckets or key_buckets(spark)
        with by_buckets(spark):
            run = self._write(self.met(batch))
            self.levels[0].append(run.drop("fresh"))
            self.compact()
        return run.filter("fresh").select(*HASH, "holder")

    def compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fan_in:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(self.merged(*self.levels[k])))
                self.levels[k] = []


def repeated_lines(lines: DataFrame, min_docs: int, batches: int = BATCHES) -> DataFrame:
    """(h1, h2, holder) of the keys found in ``min_docs`` documents, from lines of (row, doc_id, h1, h2), as a table.

    Batches go by descending id, so the batch in which a key is fresh has its largest document.
    """
    cuts = sorted(set(lines.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)), reverse=True)
    place = F.lit(len(cuts))
    for k, cut in reversed(list(enumerate(cuts))):
        place = F.when(F.col("doc_id") >= cut, k).otherwise(place)
    once = lines.select("row", "doc_id", "h1", "h2", place.alias("_batch")).distinct()
    once = stage(once.drop("row"), "line-keys", "_batch")
    runs = LineRuns()
    for k in range(len(cuts) + 1):
        runs.add(once.filter(F.col("_batch") == k).drop("_batch"))
    with by_buckets(lines.sparkSession):
        found = runs.known().filter(F.col("n") >= min_docs).select(*HASH, "holder")
        found = stage(found, "lines-repeated")
    runs.drop()
    discard(once)
    return found


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its text replaced by its kept lines, and n_lines, n_dropped and kept (the text) added.

    Lines whose key has ``min_chars`` code points or more and is found in ``min_docs`` rows go, except
    in the rows with the largest id holding it.  Null or empty text is one empty line.  Rows that
    share an id but not a text are separate documents that hold a line together; rows that repeat
    both are one.  Rows of null id count, and hold a line only where no other row has it.  Very long
    texts are read whole.  An empty table gives an empty one.  Columns n_lines, n_dropped, kept are
    replaced, all others pass through.
    """
    text = text_or_empty(text_col)
    rows = docs.drop("n_lines", "n_dropped", "kept")
    row, gone, marks, split_ = (free_name(rows, x) for x in ("_row", "_gone", "_marks", "_lines"))
    rows = rows.withColumn(row, F.xxhash64(F.col(id_col), text))
    key = line_key(F.col("line"))
    lines = (
        rows.select(F.col(row).alias("row"), F.col(id_col).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
        .filter(F.length("line") >= min_chars)
        .withColumn("key", key)
        .filter(F.length("key") >= min_chars)
        .select("row", "doc_id", "pos", line_hash(F.col("key")).alias("h"))
        .select("row", "doc_id", "pos", "h.h1", "h.h2")
    )
    lines = stage(lines, "lines")
    repeated = repeated_lines(lines, min_docs)
    goes = (
        lines.withColumn("_salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int"))
        .join(salted(repeated, SALTS), ["h1", "h2", "_salt"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("holder")))
        .groupBy(F.col("row").alias("_goes"), F.col("doc_id").alias("_id"))
        .agg(F.array_sort(F.collect_set("pos")).alias("_of"))
    )
    goes = stage(goes, "lines-gone")
    discard(lines, repeated)
    goes = goes.select(F.col("_goes").alias(f"{row}_goes"), F.col("_id").alias(f"{row}_id"), F.col("_of").alias(gone))
    split = F.split(text, "\n")
    joined = rows.join(goes.hint("shuffle_hash"), (rows[row] == goes[f"{row}_goes"]) & rows[id_col].eqNullSafe(goes[f"{row}_id"]), "left").drop(f"{row}_goes", f"{row}_id")
    marked = joined.withColumn(gone, F.coalesce(gone, F.array().cast("array<int>"))).withColumn("n_lines", F.size(split).cast("long")).withColumn("n_dropped", F.size(gone).cast("long"))
    # the lines between one dropped line and the next; linear in the number of lines
    bounds = F.concat(F.array(F.lit(-1)), F.col(gone), F.array(F.col("n_lines").cast("int")))
    parts = F.flatten(F.zip_with(F.slice(marks, 1, F.size(marks) - 1), F.slice(marks, 2, F.size(marks) - 1), lambda a, b: F.slice(F.col(split_), a + 2, b - a - 1)))
    cut = marked.withColumn(marks, bounds).withColumn(split_, split)
    kept = F.when(F.col("n_dropped") == 0, text).otherwise(F.array_join(parts, "\n"))
    return cut.withColumn("kept", kept).drop(row, gone, marks, split_)
