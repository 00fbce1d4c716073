"""Language identification by bit-sliced Bloom filters of character n-grams.

A slot of the filter holds one bit per language.  The slots of an n-gram's hashes are and-ed, which
gives all languages that contain it at once; per-language counts over a text's n-grams, corrected
for each filter's rate of false positives, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblens.llm.common import free_name, pieces_of, slices, text_or_empty

#: Characters of an n-gram, hashes of it, slots of the filter.
N, HASHES, SLOTS = 4, 3, 1 << 21
#: Bound of the training sample: texts of a language (chosen by hash), and code points of each that is chosen.
TEXTS_PER_LANGUAGE, LONGEST = 2000, 20_000
#: Most languages that a model tells apart, the most frequent ones: the filter has 16 MB for every 64 of them.
MOST_LANGUAGES = 512
#: An n-gram counts for a language if it was seen so often there, at this share of its highest rate at least.
SEEN, RATE = 3, 0.25
UNKNOWN = "und"
#: Code points of the pieces that longer texts are counted in.
LONG_CHARS = 1 << 20

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts, and how many each text has; 0 for a text without letters.

    Texts are lower-cased; every run of other characters than letters becomes one space, a space stands
    at either end, and a mark of the end after it.  The mark may only end an n-gram, so a text of one letter
    has one, and what a text gives doesn't hang on the texts beside it.
    """
    letters = _letters()
    joined = "".join(" " + t.replace("\x00", " ").lower() + " \x00" for t in texts).encode("utf-32-le", "replace")
    codes = np.frombuffer(joined, np.uint32).copy()
    space = ~letters[codes] & (codes != 0)
    codes[space] = 32
    codes = codes[np.concatenate([[True], ~(space[1:] & space[:-1])])] if len(codes) else codes
    ends = codes == 0
    wide = codes.astype(np.uint64)
    n = max(len(codes) - N + 1, 0)
    hashed = np.zeros(n, np.uint64)
    broken = np.zeros(n, bool)
    for j in range(N):
        hashed += wide[j : j + n] * _FACTORS[j]
        if j < N - 1:
            broken |= ends[j : j + n]
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    hashed ^= hashed >> np.uint64(32)
    owner = np.cumsum(ends)[:n]  # n-grams don't begin with a mark
    return hashed[~broken], np.bincount(owner[~broken], minlength=len(texts))


def _slots(hashed: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield (hashed >> np.uint64(21 * k)) & np.uint64(SLOTS - 1)


@dataclass
class LanguageModel:
    """languages; table: slots x words of 64 languages; false: each language's rate of false positives."""

    languages: list[str]
    table: np.ndarray
    false: np.ndarray

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text: the share of the best in the sum of all corrected shares."""
        if not texts:
            return []
        pieces = [pieces_of(t, LONG_CHARS) for t in texts]
        if max(map(len, pieces)) == 1:
            hits, counts = self._hits(texts)
        else:  # the pieces' numbers add up
            parts = [[self._hits([x]) for x in own] for own in pieces]
            hits = np.concatenate([sum(h for h, _ in own) for own in parts])
            counts = np.concatenate([sum(c for _, c in own) for own in parts])
        share = np.maximum(0, (hits / np.maximum(counts, 1)[:, None] - self.false) / (1 - self.false)) if self.languages else hits
        out = []
        for i in range(len(texts)):
            if not counts[i] or not self.languages:
                out.append((UNKNOWN, 0.0))
            else:
                best, total = int(np.argmax(share[i])), float(share[i].sum())
                out.append((self.languages[best], float(share[i, best]) / total if total else 0.0))
        return out

    def _hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many n-grams of each text each language has, and how many the text has."""
        hashed, counts = gram_hashes(texts)
        found = None
        for slots in _slots(hashed):
            got = self.table[slots]
            found = got if found is None else found & got
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        some = counts > 0
        hits = np.zeros((len(texts), len(self.languages)))
        if some.any() and self.languages:
            for k in range(len(self.languages)):
                bit = (found[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                hits[some, k] = np.add.reduceat(bit.astype(np.int64), starts[some])
        return hits, counts


def learn_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = TEXTS_PER_LANGUAGE) -> LanguageModel:
    """Fit on a bounded sample of the rows given: about ``most`` texts a language, chosen by a hash of the text.

    Rows of null language or text are left out; copies of a text count once.  Where there are more than
    MOST_LANGUAGES different languages, those of most rows are learned (of equal ones the first by name)
    and the others never said; an empty table gives a model that says UNKNOWN.  Texts of more than
    LONGEST code points are not sampled while their language has others; where it has none, they are
    cut into pieces of that length, which are sampled like texts.  What reaches the driver is the
    table of n-grams of that sample.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    mark = F.xxhash64(F.lit("langid"), "text")
    counted_by = lambda df, *keys: df.groupBy(*keys).agg(F.countDistinct(mark).alias("n")).collect()
    learned = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MOST_LANGUAGES).collect()]
    rows = rows.filter(F.col("lang").isin(learned)) if learned else rows
    units = rows.filter(F.length("text") <= LONGEST)
    found = counted_by(rows.withColumn("short", F.length("text") <= LONGEST), "lang", "short")
    sizes = {r["lang"]: r["n"] for r in found if r["short"]}
    long_only = sorted({r["lang"] for r in found} - sizes.keys())
    if long_only:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / LONGEST).cast("int")), lambda k: F.substring("text", k * LONGEST + 1, F.lit(LONGEST)))
        cut = rows.filter(F.col("lang").isin(long_only)).select("lang", F.explode(pieces).alias("text"))
        sizes |= {r["lang"]: r["n"] for r in counted_by(cut, "lang")}
        units = units.unionByName(cut)
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((1, 1), np.uint64), np.zeros(0))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, most / sizes[k])))])
    number = F.create_map(*[x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))])
    draw = F.pmod(mark, F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = units.filter(draw < share[F.col("lang")]).select(number[F.col("lang")].alias("k"), mark.alias("_mark"), "text")
    sample = drawn.groupBy("k", "_mark").agg(F.min("text").alias("text")).select("k", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed, counts = gram_hashes(batch.column(1).to_pylist()) if batch.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            owner = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts)
            for k in np.unique(owner):
                values, n = np.unique(hashed[owner == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k), pa.int32()), pa.array(values.view(np.int64)), pa.array(n, pa.int64())], names=["k", "gram", "n"])

    counted = sample.mapInArrow(grams, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n"))
    totals = counted.groupBy("k").agg(F.sum("n").alias("total"))
    rated = counted.join(F.broadcast(totals), "k").withColumn("rate", F.col("n") / F.col("total"))
    rated = rated.withColumn("most", F.max("rate").over(Window.partitionBy("gram"))).filter((F.col("n") >= SEEN) & (F.col("rate") >= RATE * F.col("most")))
    got = rated.select("k", "gram").toArrow()
    table = np.zeros((SLOTS, (len(languages) + 63) // 64), np.uint64)
    owner, values = got["k"].to_numpy(), got["gram"].to_numpy().view(np.uint64)
    for k in range(len(languages)):
        for slots in _slots(values[owner == k]):
            table[slots, k // 64] |= np.uint64(1 << (k % 64))
    fill = np.array([np.mean((table[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)) for k in range(len(languages))])
    return LanguageModel(languages, table, fill**HASHES)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added (replaced, where they exist).

    Null, empty and letterless texts are ``und`` with score 0; ties, and texts with no n-gram that is
    known, go to the first language by name (with score 0); a model without languages says ``und``; only the text is looked at.  Repeated rows get the
    same answer each; very long texts are read whole; an empty table gives an empty one; all other
    columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for part in slices(batch, 256):
                out.extend(shared.value.predict(part.to_pylist()))
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["lang_pred", "score"])

    kept = docs.drop("lang_pred", "score")
    said = free_name(kept, "_said")
    kept = kept.withColumn(said, predict(text_or_empty(text_col)))
    return kept.withColumn("lang_pred", F.col(f"{said}.lang_pred")).withColumn("score", F.col(f"{said}.score")).drop(said)
