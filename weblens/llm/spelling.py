"""Spelling variants by finite-state composition: acceptor, one-edit transducer, acceptor.

The vocabulary is dealt by the state its acceptor is in after a few code points.  In each part the words'
rests make a minimised acceptor A; the pairs that A, a transducer of exactly one edit and A again accept
are enumerated from that state on.  Pairs that differ before it share their ends, and are found in the same
way among the reversed words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm.common import ascii_lower, salted, slices, stage

#: Letters of a run, and the fewest code points and occurrences of a word of the vocabulary.
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
SHORTEST, SEEN = 7, 2
#: Code points up to an initial state.  Words of 2 * DEPTH + 1 or more within one edit share that many at the
#: beginning, or at the end.
DEPTH = 3
#: Most words of a part; larger ones are dealt anew by one code point more.  Words that one task gets, about.
PART, TASK = 40_000, 60_000
#: A word's form has this many times its occurrences at least.
TIMES = 10
#: Different words whose counts a task holds before it hands them on.
HELD = 200_000
SALTS = 16
FLOW = "word string, n long, n_near long, form_n long, form string"


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Callable[[object, str], str] | None = None) -> DataFrame:
    """(word, n): maximal runs of letters of whole texts, A-Z lower-cased, with SHORTEST code points and SEEN occurrences.

    Null texts have none; ``edit`` may turn a run of a document (its id, or None, and the run) into another word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    runs = Counter(LETTERS.findall(text)) if text else {}
                    for run, n in runs.items():
                        word = edit(doc_id, run) if edit else run
                        if len(word) >= SHORTEST:
                            held[word] += n
                    if len(held) > HELD:
                        yield handed()
                        held.clear()
        yield handed()

    rows = docs.select(id_col, ascii_lower(F.col(text_col).cast("string")).alias(text_col))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= SEEN)


def _ramps(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n[k] numbers from start[k] on, for all k in a row."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Acceptor:
    """The minimised acceptor of sorted different words, as arrays.

    Of arc k: source, label, target, and skip, the words of the source before those of this arc.  first[q] is
    the first arc of a state, count[q] how many words are accepted from it, final[q] whether none more is needed.
    """

    def __init__(self, words: list[str]) -> None:
        known: dict[tuple, int] = {}
        states: list[tuple] = []

        def settle(final: bool, arcs: list[tuple[int, int]]) -> int:
            key = (final, *arcs)
            if key not in known:
                known[key] = len(states)
                states.append(key)
            return known[key]

        # open states along the last word: whether final, and arcs whose targets are settled
        way: list[list] = [[False, []]]
        last = ""
        for word in words:
            same = 0
            while same < min(len(last), len(word)) and last[same] == word[same]:
                same += 1
            for k in range(len(last), same, -1):
                done = way.pop()
                way[-1][1].append((ord(last[k - 1]), settle(*done)))
            way += [[False, []] for _ in range(len(word) - same)]
            way[-1][0] = True
            last = word
        for k in range(len(last), 0, -1):
            done = way.pop()
            way[-1][1].append((ord(last[k - 1]), settle(*done)))
        self.start = settle(*way[0])
        self.final = np.array([s[0] for s in states], bool)
        self.first = np.concatenate([[0], np.cumsum([len(s) - 1 for s in states])]).astype(np.int64)
        arcs = [a for s in states for a in s[1:]]
        self.label, self.target = (np.array([a[k] for a in arcs], np.int64).reshape(-1) for k in (0, 1))
        self.source = np.repeat(np.arange(len(states)), np.diff(self.first))
        count, skip = [], []  # targets are settled before their sources
        for s in states:
            total = int(s[0])
            for _, target in s[1:]:
                skip.append(total)
                total += count[target]
            count.append(total)
        self.count, self.skip = np.array(count, np.int64), np.array(skip, np.int64)
        self.keys = self.source * (1 << 21) + self.label

    def arcs_of(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``states``, arc) of all arcs that leave them."""
        n = self.first[states + 1] - self.first[states]
        place = np.repeat(np.arange(len(states)), n)
        return place, _ramps(self.first[states], n)

    def common(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, arc of p, arc of q) wherever both have an arc of the same label."""
        place, arc = self.arcs_of(p)
        wanted = q[place] * (1 << 21) + self.label[arc]
        other = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        met = self.keys[other] == wanted
        return place[met], arc[met], other[met]


def _edits(a: Acceptor) -> list[np.ndarray]:
    """All ways of the transducer to leave its first state: rows (state, skip left, target left, skip right, target right).

    Either both sides read different code points, or only the left one reads one, and what follows on the right
    is another (or both end), so that every pair of words is met once.  Of two different code points the smaller is left.
    """
    place, arc = a.arcs_of(a.source)
    left, right = place, arc  # arcs of one state in pairs
    smaller = left < right
    swaps = (a.source[left[smaller]], a.skip[left[smaller]], a.target[left[smaller]], a.skip[right[smaller]], a.target[right[smaller]])
    # an arc more on the left: its target goes on as the state itself does by another arc
    other = left != right
    x, y = left[other], right[other]
    wanted = a.target[x] * (1 << 21) + a.label[y]
    found = np.minimum(np.searchsorted(a.keys, wanted), max(len(a.keys) - 1, 0))
    met = a.keys[found] == wanted if len(a.keys) else np.zeros(0, bool)
    x, y, found = x[met], y[met], found[met]
    longer = (a.source[x], a.skip[x] + a.skip[found], a.target[found], a.skip[y], a.target[y])
    return [np.concatenate([s, n]) for s, n in zip(swaps, longer)]


def near_pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of words that are exactly one edit apart, each once; ``words`` are sorted and different."""
    a = Acceptor(words)
    n = len(a.final)
    nothing = np.zeros(0, np.int64)
    if not len(a.label):
        return nothing, nothing
    state, skip_l, left, skip_r, right = _edits(a)
    # pairs of states that can be reached after the edit, and from which of them both sides can end together
    seen = np.unique(left * n + right)
    new, edges = seen[seen // n != seen % n], []
    while len(new):
        place, x, y = a.common(new // n, new % n)
        ahead = a.target[x] * n + a.target[y]
        edges.append((new[place], ahead))
        new = np.setdiff1d(ahead, seen)
        seen = np.union1d(seen, new)
        new = new[new // n != new % n]
    alive = (seen // n == seen % n) | (a.final[seen // n] & a.final[seen % n])
    edges = [(np.searchsorted(seen, source), np.searchsorted(seen, target)) for source, target in reversed(edges)]
    before = -1
    while alive.sum() != before:
        before = alive.sum()
        for source, target in edges:
            alive[source[alive[target]]] = True
    alive_pairs = seen[alive]

    def lives(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        key = p * n + q
        at = np.minimum(np.searchsorted(alive_pairs, key), max(len(alive_pairs) - 1, 0))
        return alive_pairs[at] == key if len(alive_pairs) else np.zeros(len(key), bool)

    some = lives(left, right)
    state, skip_l, left, skip_r, right = state[some], skip_l[some], left[some], skip_r[some], right[some]
    by_state = np.argsort(state, kind="stable")
    state, skip_l, left, skip_r, right = (v[by_state] for v in (state, skip_l, left, skip_r, right))
    # a word that ends where the other has one code point more
    ends = a.final[a.source] & a.final[a.target]
    needed = np.zeros(n, bool)
    needed[state] = True
    needed[a.source[ends]] = True
    before = -1
    while needed.sum() != before:
        before = needed.sum()
        needed[a.source[needed[a.target]]] = True
    out_l, out_r = [], []
    at, base = np.array([a.start]), np.zeros(1, np.int64)
    while len(at):
        keep = needed[at]
        at, base = at[keep], base[keep]
        place, arc = a.arcs_of(at)
        own = ends[arc]
        out_l.append(base[place[own]] + a.skip[arc[own]])
        out_r.append(base[place[own]])
        low, high = np.searchsorted(state, at), np.searchsorted(state, at, side="right")
        who, how = np.repeat(np.arange(len(at)), high - low), _ramps(low, high - low)
        i, j, p, q = base[who] + skip_l[how], base[who] + skip_r[how], left[how], right[how]
        while len(i):
            equal = p == q  # all words from here on are common
            size = a.count[p[equal]]
            rest = _ramps(np.zeros(len(size), np.int64), size)
            both = a.final[p] & a.final[q] & ~equal
            out_l += [np.repeat(i[equal], size) + rest, i[both]]
            out_r += [np.repeat(j[equal], size) + rest, j[both]]
            i, j, p, q = i[~equal], j[~equal], p[~equal], q[~equal]
            pair, x, y = a.common(p, q)
            i, j, p, q = i[pair] + a.skip[x], j[pair] + a.skip[y], a.target[x], a.target[y]
            goes = lives(p, q)
            i, j, p, q = i[goes], j[goes], p[goes], q[goes]
        at, base = a.target[arc], base[place] + a.skip[arc]
    return np.concatenate(out_l), np.concatenate(out_r)


def _compose(batches: Iterator[pa.RecordBatch], backward: bool) -> Iterator[pa.RecordBatch]:
    """Per word of the parts that come sorted by (part, way): how many near words it has here, and the best of them.

    Forward, every word comes out, with its n; backward, only words with near ones, and pairs that share their
    first DEPTH code points are left out, as they are met forward.
    """

    def settled(words: list[str], depth: int, n: list[int]) -> pa.RecordBatch | None:
        x, y = near_pairs([w[depth:] for w in words]) if len(words) > 1 else (np.zeros(0, np.int64),) * 2
        if backward:
            words = [w[::-1] for w in words]
            starts = np.array([w[:DEPTH] for w in words])
            x, y = x[starts[x] != starts[y]], y[starts[x] != starts[y]]
        if backward and not len(x):
            return None
        own = np.array(n, np.int64)
        word, other = np.concatenate([x, y]), np.concatenate([y, x])
        rank = np.empty(len(words), np.int64)  # in code-point order
        rank[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)] = np.arange(len(words))
        best = np.lexsort((rank[other], -own[other], word))
        word, other = word[best], other[best]
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        near = np.bincount(word, minlength=len(words))
        form = np.full(len(words), -1, np.int64)
        form[word[heads]] = other[heads]
        shown = np.flatnonzero(near) if backward else np.arange(len(words))
        pick = pa.array(np.where(form[shown] >= 0, form[shown], 0), mask=form[shown] < 0)
        texts = pa.array(words, pa.string())
        return pa.RecordBatch.from_arrays(
            [texts.take(pa.array(shown)), pa.array(own[shown]), pa.array(near[shown].astype(np.int64)), pa.array(own).take(pick), texts.take(pick)],
            names=["word", "n", "n_near", "form_n", "form"],
        )

    key, words, counts = None, [], []
    for batch in batches:
        for part, way, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if part != key:
                if words and (out := settled(words, len(key), counts)) is not None:
                    yield out
                key, words, counts = part, [], []
            words.append(way)
            counts.append(n)
    if words and (out := settled(words, len(key), counts)) is not None:
        yield out


def _borders(hot: DataFrame, depth: int, backward: bool) -> DataFrame:
    """Pairs of words of a part that differ in the code point after its first ``depth``, as ``_compose`` gives them.

    The rest after it is the same, or is the whole rest of the other word: an equi-join, of few words a key.
    """
    head, rest = F.substring("_way", 1, depth), F.expr(f"substring(_way, {depth + 2})")
    cut = hot.filter(F.length("_way") > depth).select(head.alias("_p"), rest.alias("_rest"), F.substring("_way", depth + 1, 1).alias("_c"), "word", "n")
    whole = hot.select(head.alias("_p"), F.expr(f"substring(_way, {depth + 1})").alias("_rest"), F.substring("_way", depth + 1, 1).alias("_c"), "word", "n")
    other = cut.unionByName(whole).select("_p", "_rest", F.col("_c").alias("_d"), F.col("word").alias("_other"), F.col("n").alias("_on"))
    met = cut.join(other, ["_p", "_rest"]).filter(F.col("_c") != F.col("_d"))
    if backward:  # pairs that share their beginnings are met forward
        met = met.filter(F.substring("word", 1, DEPTH) != F.substring("_other", 1, DEPTH))
    # a word less a code point against a whole word comes once, and is turned; two with one replaced come both ways
    longer = F.length("word") > F.length("_other")
    turned = met.filter(longer).select(F.col("_other").alias("word"), F.col("_on").alias("n"), F.col("word").alias("_other"), F.col("n").alias("_on"))
    both = met.select("word", "n", "_other", "_on").unionByName(turned)
    best = F.min(F.struct((-F.col("_on")).alias("m"), F.col("_other").alias("form")))
    found = both.groupBy("word").agg(F.min("n").alias("n"), F.count("*").alias("n_near"), best.alias("_b"))
    return found.select("word", "n", "n_near", (-F.col("_b.m")).alias("form_n"), F.col("_b.form").alias("form"))


def _side(words: DataFrame, total: int, backward: bool, most: int) -> DataFrame:
    way = F.reverse("word") if backward else F.col("word")
    left = words.withColumn("_way", way)
    spans, found, depth = [], [], DEPTH
    while True:
        part = F.substring("_way", 1, depth)
        large = stage(left.groupBy(part.alias("_part")).count().filter(F.col("count") > most).select("_part"), "spelling-large")
        if large.limit(1).count() == 0:
            spans.append(left.withColumn("_part", part))
            break
        # a part may hold a third of the words: its rows are dealt over several keys
        dealt = left.withColumn("_part", part).withColumn("_salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
        marked = dealt.join(salted(large.withColumn("_large", F.lit(True)), SALTS), ["_part", "_salt"], "left")
        marked = stage(marked.select("word", "n", "_way", "_part", F.col("_large").isNotNull().alias("_large")), "spelling-parts")
        spans.append(marked.filter("not _large").drop("_large"))
        left = marked.filter("_large").select("word", "n", "_way")
        found.append(_borders(left, depth, backward))
        depth += 1
    rows = spans[0]
    for more in spans[1:]:
        rows = rows.unionByName(more)
    rows = rows.select("_part", "_way", "n").repartition(max(1, -(-total // TASK)), "_part").sortWithinPartitions("_part", "_way")
    out = rows.mapInArrow(lambda batches: _compose(batches, backward), FLOW)
    for more in found:
        out = out.unionByName(more)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where each word's chain of forms ends.  Occurrences grow by TIMES from form to form, so
    chains are short, and pointers that double reach the ends in a few rounds."""
    roots = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = roots.join(on, "root", "left")
        if not further.filter("_next is not null").limit(1).count():
            return roots
        roots = stage(further.select("word", F.coalesce("_next", "root").alias("root")), "spelling-roots")


def variants(words: DataFrame, times: int = TIMES, most: int = PART) -> DataFrame:
    """Of a vocabulary (word, n): word, form, root, n, n_near, form_n.

    Words are near if exactly one code point inserted, deleted or replaced parts them, and n_near counts a word's
    near ones.  Its form is the near word of most occurrences (of equals the first by code points) if these are
    ``times`` its own at least, else null, with form_n; its root is the last word that forms lead to, or itself.
    Words are different and not null; those of fewer than 2 * DEPTH + 1 code points are left out; an empty table
    gives an empty one.  No part of more than ``most`` words goes to a task as a whole.
    """
    known = stage(words.filter(F.length("word") > 2 * DEPTH).select("word", "n"), "spelling-words")
    total = known.count()
    flow = _side(known, total, False, most).unionByName(_side(known, total, True, most))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form"))))
    found = flow.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("_b"))
    large = -F.col("_b.m") >= times * F.col("n")
    found = found.select("word", "n", "n_near", F.when(large, F.col("_b.form")).alias("form"), F.when(large, -F.col("_b.m")).alias("form_n"))
    found = stage(found, "spelling-near")
    roots = _roots(found.filter("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
