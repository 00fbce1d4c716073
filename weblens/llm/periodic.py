"""Runs of words that repeat with a period, found by recursive frequency splitting and a lag scan.

A run has every one of its words at least twice.  So a word that is alone in a segment is in no run of
that segment and splits it; words are counted again within the parts, until no part loses a word.
What survives is scanned lag by lag; long lags are scanned from block to block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm.common import free_name, text_or_empty

#: Fewest words of a run; a run has two periods at least.
LEAST = 12
#: Lags below this are scanned over a whole segment, longer ones from the places where blocks of words come again.
SHORT = 64
#: Rounds of splitting all segments at once; what isn't stable then is split one by one.
ROUNDS = 12
#: Code points, and rows, that are looked at together.
SLICE_CHARS, SLICE_ROWS = 4 << 20, 2048

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _stretches(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hits, [False]]).view(np.int8)))
    return edge[::2], edge[1::2] - edge[::2]


def _scan(ids: np.ndarray, found: dict[tuple[int, int], int]) -> None:
    """Runs of lags below SHORT: stretches of words that equal the word a lag later."""
    for p in range(1, min(SHORT - 1, len(ids) // 2) + 1):
        starts, lengths = _stretches(ids[p:] == ids[:-p])
        for k in np.flatnonzero(lengths >= max(LEAST, 2 * p) - p):
            found.setdefault((int(starts[k]), int(lengths[k]) + p), p)


def _ranks(ids: np.ndarray) -> list[np.ndarray]:
    """For 1, 2, 4, ... words: a number at each place, equal where so many words from there on are equal."""
    out, width = [np.unique(ids, return_inverse=True)[1].astype(np.int64)], 1
    while 4 * width <= len(ids):
        last = out[-1]
        out.append(np.unique(last[:-width] * (len(ids) + 1) + last[width:], return_inverse=True)[1])
        width *= 2
    return out


def _alike(ranks: list[np.ndarray], x: np.ndarray, y: np.ndarray, back: bool) -> np.ndarray:
    """How many words from places x and y on (or before them) are equal."""
    total = np.zeros(len(x), np.int64)
    for level in reversed(range(len(ranks))):
        width, rank, todo = 1 << level, ranks[level], np.arange(len(x))
        while len(todo):
            a, b = (x[todo] - total[todo] - width, y[todo] - total[todo] - width) if back else (x[todo] + total[todo], y[todo] + total[todo])
            inside = (a >= 0) & (b < len(rank))
            todo, a, b = todo[inside], a[inside], b[inside]
            todo = todo[rank[a] == rank[b]]
            total[todo] += width
            if level < len(ranks) - 1:
                break  # at most once below the widest
    return total


def _scan_blocks(ids: np.ndarray, found: dict[tuple[int, int], int]) -> None:
    """Runs of lags from SHORT on: a run of such a lag p has a whole block of p/4 to p/2 words in its first period,
    at a multiple of the block's length, and the block again p words later."""
    ranks, size = _ranks(ids), len(ids)
    level = (SHORT // 2).bit_length() - 1
    while 4 << level <= size:
        block = 1 << level
        rank = ranks[level]
        # inside a run of a period up to a block, blocks come again at multiples of the period only: nothing new
        cover = np.zeros(size, np.int64)
        for (start, length), p in found.items():
            if p <= block:
                cover[start] = max(cover[start], start + length)
        cover = np.maximum.accumulate(cover)
        at = np.arange(0, len(rank), block)
        at = at[cover[at] < np.minimum(at + 5 * block, size)]
        order = np.argsort(rank, kind="stable")
        keys = rank[order] * (size + 1) + order
        low = np.searchsorted(keys, rank[at] * (size + 1) + np.minimum(at + 2 * block, size))
        high = np.searchsorted(keys, rank[at] * (size + 1) + np.minimum(at + 4 * block, size))
        n = np.maximum(high - low, 0)
        x = np.repeat(at, n)
        y = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        before, after, p = _alike(ranks, x, y, True), _alike(ranks, x, y, False), y - x
        whole = before + after >= np.maximum(LEAST, 2 * p) - p
        for start, length, lag in sorted(set(zip((x - before)[whole].tolist(), (before + after + p)[whole].tolist(), p[whole].tolist())), key=lambda r: r[2]):
            found.setdefault((start, length), lag)
        level += 1


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers.

    A stretch found at several lags has the smallest as its period: with two periods inside, a stretch
    of a multiple of its smallest period is the very stretch of that period.
    """
    found: dict[tuple[int, int], int] = {}
    _scan(ids, found)
    if len(ids) >= 2 * SHORT:
        _scan_blocks(ids, found)
    return sorted((start, length, p) for (start, length), p in found.items())


def _split(last: np.ndarray, next_: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Stable parts of the segment [low, high).  A part is looked at from both ends, so a cut costs its shorter side."""
    todo = [(low, high)]
    while todo:
        low, high = todo.pop()
        if high - low < LEAST:
            continue
        for k in range((high - low + 1) // 2):
            cut = next((i for i in (low + k, high - 1 - k) if last[i] < low and next_[i] >= high), None)
            if cut is not None:
                todo += [(low, cut), (cut + 1, high)]
                break
        else:
            yield low, high


def segments(ids: np.ndarray, texts: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of LEAST words or more, within one text each, where no word is alone; all runs are inside them."""
    n = len(ids)
    if not n:
        return []
    order = np.argsort(texts.astype(np.int64) * (int(ids.max()) + 1) + ids, kind="stable")
    same = (ids[order[1:]] == ids[order[:-1]]) & (texts[order[1:]] == texts[order[:-1]])
    last, next_ = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    last[order[1:][same]], next_[order[:-1][same]] = order[:-1][same], order[1:][same]
    part, alive, stable = texts.astype(np.int64), np.ones(n, bool), False
    for _ in range(ROUNDS):
        padded = np.append(part, [-1, -1])  # of -1, and of n
        alone = alive & (padded[last] != part) & (padded[np.minimum(next_, n)] != part)
        if not alone.any():
            stable = True
            break
        alive &= ~alone
        edge = np.concatenate([[True], (texts[1:] != texts[:-1]) | ~alive[1:] | ~alive[:-1]])
        number = np.cumsum(edge)
        alive &= np.bincount(number[alive], minlength=number[-1] + 1)[number] >= LEAST
        part = np.where(alive, number, -2)
    edge = np.concatenate([[True], (texts[1:] != texts[:-1]) | (alive[1:] != alive[:-1]) | (part[1:] != part[:-1])])
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], n)
    whole = [(int(a), int(b)) for a, b in zip(starts, ends) if alive[a] and b - a >= LEAST]
    return whole if stable else [part for a, b in whole for part in _split(last, next_, a, b)]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row, and where each text's begin."""
    lists = pc.ascii_split_whitespace(texts)
    words, starts = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    real = pc.greater(pc.binary_length(words), 0)  # white space at the ends leaves empty words
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return words.filter(real), before[starts]


def _analyse(texts: pa.Array) -> pa.StructArray:
    words, starts = _words(texts)
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(texts)), np.diff(starts))
    runs: list[list[dict]] = [[] for _ in range(len(texts))]
    gone = np.zeros(len(ids) + 1, np.int64)
    for low, high in segments(ids, text):
        for start, length, period in runs_of(ids[low:high]):
            begin = low + start
            runs[text[low]].append({"start": int(begin - starts[text[low]]), "length": length, "period": period})
            gone[begin + period] += 1
            gone[begin + length] -= 1
    kept = np.cumsum(gone)[:-1] == 0
    offsets = np.concatenate([[0], np.cumsum(kept)])[starts]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.filter(pa.array(kept))), " ")
    row = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    found = pa.array([sorted(r, key=lambda x: (x["start"], x["period"])) for r in runs], pa.list_(row))
    return pa.StructArray.from_arrays([found, collapsed], names=["runs", "collapsed"])


def _parts(batch: pa.Array) -> Iterator[pa.Array]:
    """An array of texts in slices of bounded size; a longer text is a slice of its own."""
    sizes = pc.binary_length(batch).to_numpy(zero_copy_only=False)
    at, size = 0, 0
    for k, own in enumerate(sizes):
        if k > at and (size + own > SLICE_CHARS or k - at >= SLICE_ROWS):
            yield batch.slice(at, k - at)
            at, size = k, 0
        size += own
    if at < len(batch):
        yield batch.slice(at)


def find_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``runs``, array of (start, length, period) in words by start and period, and ``collapsed``,
    the words that no run contains after its first period, joined by one space (both replaced, where they exist).

    A run is a stretch of max(12, 2 * period) words or more with that smallest period, which no neighbouring
    word extends.  Null, empty and white texts have no runs and an empty ``collapsed``; runs of different
    periods may overlap, and all are given; repeated rows get the same each; an empty table gives an empty
    one; all other columns pass through.  A text is read whole by one task, in memory in proportion to it
    and time in proportion to n log n of it.
    """

    @F.arrow_udf(f"runs {RUNS}, collapsed string")
    def analyse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [_analyse(part) for part in _parts(batch)]
            yield pa.concat_arrays(parts) if parts else _analyse(batch)

    kept = docs.drop("runs", "collapsed")
    said = free_name(kept, "_said")
    kept = kept.withColumn(said, analyse(text_or_empty(text_col)))
    return kept.withColumn("runs", F.col(f"{said}.runs")).withColumn("collapsed", F.col(f"{said}.collapsed")).drop(said)
