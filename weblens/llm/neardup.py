"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Each document's word shingles become 64-bit hashes; the k smallest are its sketch, the digest of
   the sorted set its node.  Documents of equal sets share a node.
2. Inverted lists of retained values generate candidates.  A value in many sketches is hot; a node is
   listed under its smallest values that aren't, and under hot ones too where too few are left.
3. Every member of a list is held against the list's leader; an estimate on the sketch of the union
   drops pairs that are far from the threshold, and the full sets decide.
4. Components of the links found so far; lists whose members are all in one component are done.  In
   the others each member is first held against its likeliest partner; members that still have a
   likely partner are then compared by full sets within the list, in blocks where it is long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblens.llm.common import discard, salted, slices, stage, text_or_empty

#: Values a sketch retains; of these the first LOOK are looked at for listing, and LISTED of them are
#: used; of hot ones HOT_LISTED.
K, LOOK, LISTED, HOT_LISTED = 64, 32, 20, 10
#: A value retained by more nodes than this is hot; lists up to this length are paired in one go.
HOT = 32
#: Members of a block of a long list, and about how many shingles they have together.
BLOCK, BLOCK_VALUES = 256, 1_000_000
#: How far below the threshold an estimate from K values may be: over four standard deviations.
SLACK = 0.2
#: Rounds in which each document is held against the likeliest of other components only.
ROUNDS = 3
SALTS = 16

_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GAP = np.array([32], np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64 over all of them (SplitMix64's fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACE = _mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
#: A random number for each byte at each of the first places of a word (tabulation hashing); later places compute theirs.
_TABLED = 64
_KEYED = np.uint64(0x9E3779B97F4A7C15)
_TABLE = _mix(np.arange(1, _TABLED * 256 + 1, dtype=np.uint64) * _KEYED)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of every word of bytes (A-Z lower-cased), and where each word begins and ends.

    A word's hash is the sum of one random number for each of its (place, byte), mixed: unlike sums of
    powers it has no words that meet whatever the base is.
    """
    word = ~_SPACE[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    first, last = edge[::2], edge[1::2]
    at = np.arange(len(data))
    begin = np.zeros(len(data), np.int64)
    begin[first] = first
    place = at - np.maximum.accumulate(begin)
    number = place * 256 + _UPPER[data]
    value = _TABLE[np.minimum(number, len(_TABLE) - 1)]
    far = np.flatnonzero(place >= _TABLED)
    value[far] = _mix((number[far] + 1).astype(np.uint64) * _KEYED)
    value[~word] = 0
    total = np.cumsum(value, dtype=np.uint64)
    return _mix((total[last - 1] - total[first - 1]) ^ ((last - first).astype(np.uint64) * _PLACE[0])), first, last


def _hashed(data: np.ndarray, size: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` and where words begin, worked out by parts that end at white space."""
    hashes, firsts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and not _SPACE[data[end - 1]]:
            more = np.flatnonzero(_SPACE[data[end : end + size]])
            end = end + int(more[0]) + 1 if len(more) else min(len(data), end + size)
        found, first, _ = word_hashes(np.concatenate([_GAP, data[at:end], _GAP]))
        hashes.append(found)
        firsts.append(first + at - 1)
        at = end
    return np.concatenate(hashes), np.concatenate(firsts)


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: ``width`` words each, or the whole text if it has fewer."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    hashes, first = _hashed(data)
    bound = np.searchsorted(first, np.concatenate([[0], ends]), "right")
    n = max(0, len(hashes) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(width):
        rolled += hashes[j : j + n] * _PLACE[j]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = (hashes[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64)
            out.append(_mix(whole + _PLACE[63 - (b - a) : 64 - (b - a)]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _chunks(texts: list[str], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def signatures(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, check, n_shingles, node, sketch) per row; node and sketch are null for texts without words.

    ``check`` is a hash of the text, which with the id finds the row again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, sketches = [], [], []
            for part in slices(batch.column(2)):
                texts = part.to_pylist()
                for a, b in _chunks(texts):
                    for s in shingle_sets(texts[a:b], width):
                        sizes.append(len(s))
                        nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                        sketches.append(s[:K].tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sketches, pa.binary())],
                names=["doc_id", "check", "n_shingles", "node", "sketch"],
            )

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("check"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, check long, n_shingles long, node binary, sketch binary")


def _listed(sketch: np.ndarray, hot: int) -> list[tuple[int, bool]]:
    """The values a node is listed under, and whether each is hot; bit i of ``hot`` tells it of value i."""
    look = sketch[:LOOK].view(np.int64).tolist()
    cold = [v for i, v in enumerate(look) if not hot >> i & 1][:LISTED]
    if len(cold) >= min(LISTED, len(look)):
        return [(v, False) for v in cold]
    more = [(v, True) for i, v in enumerate(look[:HOT_LISTED]) if hot >> i & 1]
    return [(v, False) for v in cold] + more


def postings(nodes: DataFrame) -> DataFrame:
    """(value, node, n): the inverted lists."""

    def retained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(s, np.int64)[:LOOK] for s in batch.column(1).to_pylist()]
            counts = [len(p) for p in parts]
            names = np.repeat(np.arange(len(parts)), counts)
            ranks = np.concatenate([np.arange(c) for c in counts]) if parts else np.zeros(0, np.int64)
            values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(names, pa.int64())), pa.array(values, pa.int64()), pa.array(ranks, pa.int32())], names=["node", "value", "rank"])

    flat = stage(nodes.select("node", "sketch").mapInArrow(retained, "node binary, value long, rank int"), "near-values")
    hot = flat.groupBy("value").agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT).select("value")
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    hits = flat.withColumn("_salt", salt).join(salted(hot, SALTS), ["value", "_salt"])
    masks = hits.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, rank)")).alias("mask"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (v, h, node, n)
                for node, n, sketch, mask in zip(*(c.to_pylist() for c in batch.columns))
                for v, h in _listed(np.frombuffer(sketch, np.uint64), mask & (1 << 64) - 1)
            ]
            columns = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.binary(), pa.int64()))], names=["value", "hot", "node", "n"])

    whole = nodes.join(masks, "node", "left").select("node", "n", "sketch", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))
    lists = stage(whole.mapInArrow(listed, "value long, hot boolean, node binary, n long").drop("hot"), "near-lists")
    discard(flat)
    return lists


def _fits(x: str, y: str, percent: int) -> F.Column:
    """Sizes that allow the similarity: the smaller set has that share of the larger."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _estimate(a: bytes, b: bytes) -> float:
    """Share of common values in the union of two sketches, up to where both are complete."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) == K:
        y = y[: np.searchsorted(y, x[-1], "right")]
    if len(y) == K:
        x = x[: np.searchsorted(x, y[-1], "right")]
    common = len(np.intersect1d(x, y, True))
    return common / max(1, len(x) + len(y) - common)


def estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, likeness) of the pairs whose union sketch doesn't rule the similarity out."""
    least = percent / 100 - SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([_estimate(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], float)
            keep = pa.array(found >= least, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(found[found >= least], pa.float64())], names=["a", "b", "likeness"])

    side = nodes.select("node", "sketch")
    both = pairs.join(side.withColumnsRenamed({"node": "a", "sketch": "sa"}), "a").join(side.withColumnsRenamed({"node": "b", "sketch": "sb"}), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary, likeness double")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) of the pairs whose full sets are similar: 100 * common >= percent * all.

    ``texts`` has node, text.  Pairs arrive in the order of their first text, whose set is kept from one to the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_text, kept_set = None, None
        for batch in batches:
            ok = []
            for part in slices(batch):
                lefts, rights = part.column(2).to_pylist(), part.column(3).to_pylist()
                for i, j in _chunks(rights):
                    for left, right in zip(lefts[i:j], shingle_sets(rights[i:j], width)):
                        if kept_text != left:
                            kept_text, kept_set = left, shingle_sets([left], width)[0]
                        common = len(np.intersect1d(kept_set, right, True))
                        ok.append(100 * common >= percent * (len(kept_set) + len(right) - common))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    # the second text first: the last join leaves pairs in the order of a
    both = pairs.select("a", "b").join(right, "b").join(left.hint("merge"), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is one node of its component.

    Each round every node with a smaller neighbour hooks to the smallest; pointers are doubled until
    they stand; edges between roots go on.  At least half of the nodes that still have edges drop
    out in a round.  Ends that are equal make no edge and no node.
    """
    tidy = lambda e: e.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = stage(tidy(edges), "cc-edges")
    roots = stage(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("root", F.col("node")), "cc-roots")
    while left.limit(1).count():
        up = stage(left.groupBy("b").agg(F.min("a").alias("p")), "cc-up")
        while True:
            above = up.select(F.col("b").alias("p"), F.col("p").alias("q"))
            doubled = stage(up.join(above, "p", "left").select("b", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("_moved")), "cc-up")
            moved = doubled.filter("_moved").limit(1).count()
            discard(up)
            up = doubled.drop("_moved")
            up.staged_path = doubled.staged_path
            if not moved:
                break
        hop = up.select(F.col("b").alias("root"), "p")
        new_roots = stage(roots.join(hop, "root", "left").select("node", F.coalesce("p", "root").alias("root")), "cc-roots")
        ends = left
        for side in ("a", "b"):
            ends = ends.join(up.select(F.col("b").alias(side), F.col("p").alias("_p")), side, "left").withColumn(side, F.coalesce("_p", side)).drop("_p")
        new_left = stage(tidy(ends), "cc-edges")
        discard(roots, left, up)
        roots, left = new_roots, new_left
    discard(left)
    return roots


def merged_roots(roots: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``roots`` (node, root) after further edges: only what lies between known roots is connected anew."""
    if roots is None:
        return components(edges)
    between = edges
    for side in ("a", "b"):
        between = between.join(roots.select(F.col("node").alias(side), F.col("root").alias("_r")), side, "left").withColumn(side, F.coalesce("_r", side)).drop("_r")
    moved = components(between)
    hop = moved.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    known = roots.join(hop, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    # the ends of new edges that had no root have themselves in ``moved``
    found = stage(known.unionByName(moved.join(roots.select("node"), "node", "left_anti")), "near-components")
    discard(moved, roots)
    return found


class Run:
    """The rows (key, node, n, root, role, values) of one key: residents, and visitors that are held against them.

    Residents are a block of a list's members; visitors are a block of those of its members that lie
    outside the list's largest component.  In a list of one block the same rows are both.
    """

    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows
        self.role = np.array([r[4] for r in rows])
        self.roots, self.place = np.unique([r[3] for r in rows], return_inverse=True)
        self.visitors = np.flatnonzero(self.role != RESIDENT)
        self.values = [np.frombuffer(r[5], np.uint64) for r in rows]
        self.held = np.array([len(v) for v in self.values])
        self.resident = self.role != VISITOR
        self.flat = np.concatenate([v if ok else v[:0] for v, ok in zip(self.values, self.resident)])
        order = np.argsort(self.flat, kind="stable")
        self.owner = np.repeat(np.arange(len(rows)), np.where(self.resident, self.held, 0))[order]
        self.flat = self.flat[order]

    def common(self, i: int) -> np.ndarray:
        """How many values each resident shares with row i, counted along the inverted lists of its values."""
        lo, hi = np.searchsorted(self.flat, self.values[i], "left"), np.searchsorted(self.flat, self.values[i], "right")
        some = np.flatnonzero(hi > lo)
        parts = [self.owner[a:b] for a, b in zip(lo[some].tolist(), hi[some].tolist())]
        return np.bincount(np.concatenate(parts), minlength=len(self.rows)) if parts else np.zeros(len(self.rows), np.int64)

    def apart(self, i: int) -> np.ndarray:
        """Residents of other components than row i's."""
        return self.resident & (self.place != self.place[i])

    def pair(self, i: int, j: int) -> tuple[bytes, bytes]:
        x, y = self.rows[i][1], self.rows[j][1]
        return min(x, y), max(x, y)


#: Roles of a row in a run: held against by visitors only, visitor only, both.
RESIDENT, VISITOR, BOTH = 0, 1, 2


def _likely_across(run: Run, percent: int, best: bool) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of a run that lie across components and whose sketches don't rule the similarity out.

    With ``best`` each visitor emits only its likeliest partner.
    """
    if len(run.roots) < 2:
        return
    top = np.array([v[-1] if len(v) == K else np.iinfo(np.uint64).max for v in run.values], np.uint64)
    size = np.array([r[2] for r in run.rows])
    padded = np.full((len(run.rows), K), np.iinfo(np.uint64).max)
    for k, v in enumerate(run.values):
        padded[k, : len(v)] = v
    least = percent / 100 - SLACK
    for i in run.visitors.tolist():
        common = run.common(i)
        fits = run.apart(i) & (np.minimum(size, size[i]) * 100 >= np.maximum(size, size[i]) * percent) & (common >= least * np.maximum(run.held, run.held[i]) * 0.5)
        near = np.flatnonzero(fits)
        if not len(near):
            continue
        # values up to where both sketches are complete
        own = np.where(top[near] < top[i], np.searchsorted(run.values[i], top[near], "right"), run.held[i])
        other = np.where(top[i] < top[near], (padded[near] <= top[i]).sum(1), run.held[near])
        like = common[near] / np.maximum(1, own + other - common[near])
        chosen = near[like >= least] if not best else near[[int(np.argmax(like))]] if like.max() >= least else []
        for j in chosen:
            yield run.pair(i, j)


def _linked_across(run: Run, percent: int) -> Iterator[tuple[bytes, bytes]]:
    """Links of a run of full sets across components: for each visitor one into each other component."""
    if len(run.roots) < 2:
        return
    for i in run.visitors.tolist():
        common = run.common(i)
        hit = np.flatnonzero(run.apart(i) & (100 * common >= percent * (run.held + run.held[i] - common)))
        for j in hit[np.unique(run.place[hit], return_index=True)[1]]:
            yield run.pair(i, j)


_RUN = ("key", "node", "n", "root", "role", "sketch")


def _by_run(lists: DataFrame, names: tuple[str, ...], types: str, each) -> DataFrame:
    """Hand the run of each key to ``each``; its tuples become rows."""
    kinds = [{"binary": pa.binary(), "string": pa.string(), "int": pa.int32()}[t.split()[-1]] for t in types.split(", ")]

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=list(names))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if run and run[-1][0] != row[0]:
                    out.extend(each(Run(run)))
                    run = []
                run.append(row)
            yield table(out)
        yield table(list(each(Run(run))) if run else [])

    ordered = lists.repartition(F.col("key")).sortWithinPartitions("key")
    return ordered.select(*_RUN).mapInArrow(go, types)


def _best_across(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each visitor of a run the likeliest partner of another component."""
    return _by_run(lists, ("a", "b"), "a binary, b binary", lambda run: _likely_across(run, percent, True)).distinct()


def _open_members(lists: DataFrame, percent: int) -> DataFrame:
    """(key, node, role): the members of runs that have a likely partner across components."""

    def members(run: Run) -> Iterator[tuple[str, bytes, int]]:
        some = {x for pair in _likely_across(run, percent, False) for x in pair}
        for row in run.rows:
            if row[1] in some:
                yield row[0], row[1], row[4]

    return _by_run(lists, ("key", "node", "role"), "key string, node binary, role int", members)


def _with_sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, sketch) with the full set in place of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part in slices(batch.column(1)):
                own = part.to_pylist()
                for a, b in _chunks(own):
                    out.extend(s.tobytes() for s in shingle_sets(own[a:b], width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "sketch"])

    return texts.select("node", "text").mapInArrow(run, "node binary, sketch binary")


def _unfinished(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """(value, node, n, root, _blocks, _outer, _minor) of the lists that hold several components.

    _minor marks members outside the list's largest component; _blocks and _outer tell into how many
    blocks all members and these are dealt.
    """
    placed = stage(lists.select("value", "node", "n").join(roots, "node", "left").select("value", "node", "n", F.coalesce("root", "node").alias("root")), "near-placed")
    parts = placed.groupBy("value", "root").agg(F.count("*").alias("_m"), F.sum("n").alias("_v"))
    top = F.max_by(F.struct("root", "_m", "_v"), F.struct("_m", "root"))
    open_ = parts.groupBy("value").agg(F.count("*").alias("_roots"), F.sum("_m").alias("_m"), F.sum("_v").alias("_v"), top.alias("_top")).filter("_roots > 1")
    blocks = lambda m, v: F.ceil(F.greatest(m / F.lit(BLOCK), v / F.lit(BLOCK_VALUES))).cast("int")
    outer = blocks(F.col("_m") - F.col("_top._m"), F.col("_v") - F.col("_top._v"))
    open_ = salted(open_.select("value", F.col("_top.root").alias("_major"), blocks(F.col("_m"), F.col("_v")).alias("_blocks"), outer.alias("_outer")), SALTS)
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    left = placed.withColumn("_salt", salt).join(open_, ["value", "_salt"]).withColumn("_minor", F.col("root") != F.col("_major"))
    left = stage(left.select("value", "node", "n", "root", "_blocks", "_outer", "_minor"), "near-open")
    discard(placed)
    return left


def _in_runs(members: DataFrame, nodes: DataFrame, one: int | None) -> DataFrame:
    """(key, node, n, root, role, sketch): a key is a list, or a block of its members with a block of its visitors.

    So a list whose members are mostly of one component is shuffled about once however long it is.
    With ``one`` each node is only in the list of its (one + 1)-th smallest value.
    """
    if one is not None:
        rank = F.row_number().over(Window.partitionBy("node").orderBy("value"))
        members = members.withColumn("_rank", rank).filter(F.col("_rank") == one + 1)
    block = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n)).cast("int")
    whole = (F.col("_blocks") == 1) & (F.col("_outer") == 1)
    at = lambda i, j, role: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), role.alias("role"))
    zero = F.lit(0)
    alone = F.array(at(zero, zero, F.when(F.col("_minor"), F.lit(BOTH)).otherwise(F.lit(RESIDENT))))
    stays = F.transform(F.sequence(zero, F.col("_outer") - 1), lambda j: at(block(3, "_blocks"), j, F.lit(RESIDENT)))
    visits = F.transform(F.sequence(zero, F.col("_blocks") - 1), lambda i: at(i, block(4, "_outer"), F.lit(VISITOR)))
    dealt = F.when(whole, alone).when(F.col("_minor"), F.concat(stays, visits)).otherwise(stays)
    withs = members.join(nodes.select("node", "sketch"), "node").withColumn("_at", F.explode(dealt))
    key = F.concat_ws(":", "value", "_at.i", "_at.j")
    return withs.select(key.alias("key"), "node", "n", "root", F.col("_at.role").alias("role"), "sketch")


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, check, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct shingles of
    ``width`` words, or the whole sequence if it has fewer.  Sets with 100 * common >= percent * all
    are linked; component_id is the smallest id reachable.  Null, empty and blank texts have no
    shingles, are linked with nothing and are their own component.  Null ids are linked but never
    the smallest; a component of null ids alone has a null component_id.  Repeated rows share a
    component, and each row whose id is the component's is kept.  Very long texts give all their
    shingles.  Columns other than the two are ignored.  An empty table gives an empty one.
    """
    return rooted_groups(docs, width, percent, id_col, text_col).drop("root")


def rooted_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``near_groups`` with root: the same in all rows of a component whatever their ids, null for texts without shingles."""
    whole = stage(signatures(docs, width, id_col, text_col), "near-signatures")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "check"))
    nodes = whole.filter("node is not null").groupBy("node").agg(F.any_value("n_shingles").alias("n"), F.any_value("sketch").alias("sketch"), first.alias("_r"))
    nodes = stage(nodes.select("node", "n", "sketch", F.col("_r.doc_id").alias("rep"), F.col("_r.check").alias("check")), "near-nodes")
    signed = stage(whole.drop("sketch"), "near-signed")
    discard(whole)
    worded = signed.filter("node is not null")
    lists = postings(nodes)

    leaders = lists.groupBy("value").agg(F.min(F.struct("node", "n")).alias("_l"), F.count("*").alias("_m")).filter("_m > 1")
    leaders = leaders.select("value", F.col("_l.node").alias("a"), F.col("_l.n").alias("_na"))
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    star = lists.withColumn("_salt", salt).join(salted(leaders, SALTS), ["value", "_salt"]).filter("a != node").filter(_fits("_na", "n", percent))
    star = star.select("a", F.col("node").alias("b")).distinct()
    likely = stage(estimated(star, nodes, percent), "near-likely")

    # each node first against the leader it is most like; what then still lies across components, against the others
    best = likely.groupBy("b").agg(F.max_by("a", F.struct("likeness", "a")).alias("a"))
    texts = _texts(docs, nodes, likely.select("a", "b"), id_col, text_col)
    found = stage(verified(best, texts, width, percent), "near-edges")
    roots = merged_roots(None, found)
    rest = _between(likely.select("a", "b").join(best, ["a", "b"], "left_anti"), roots)
    more = stage(verified(rest, texts, width, percent), "near-edges")
    roots = merged_roots(roots, more)
    discard(texts, found, more)

    # what stands apart is held against its likeliest partner in one list; then, in all lists, members
    # with any likely partner are held against each other by their full sets
    tested, held = likely.select("a", "b"), [likely]
    for k in range(ROUNDS):
        members = _unfinished(lists, roots)
        discard(lists)
        lists = members
        rest = stage(_best_across(_in_runs(members, nodes, k), percent).join(tested, ["a", "b"], "left_anti"), "near-across")
        held.append(rest)
        if not rest.limit(1).count():
            continue
        texts = _texts(docs, nodes, rest, id_col, text_col)
        found = stage(verified(rest, texts, width, percent), "near-edges")
        tested = tested.unionByName(rest)
        if found.limit(1).count():
            roots = merged_roots(roots, found)
        discard(texts, found)
    members = _unfinished(lists, roots)
    discard(lists)
    runs = _in_runs(members, nodes, None)
    open_ = stage(_open_members(runs, percent), "near-members")
    if open_.limit(1).count():
        own = open_.select("node").distinct()
        texts = _texts(docs, nodes, own.select(F.col("node").alias("a"), F.col("node").alias("b")), id_col, text_col)
        sized = open_.join(nodes.select("node", "n"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        whole_sets = sized.join(_with_sets(texts, width).dropDuplicates(["node"]), "node")
        found = stage(_by_run(whole_sets, ("a", "b"), "a binary, b binary", lambda run: _linked_across(run, percent)), "near-edges")
        if found.limit(1).count():
            roots = merged_roots(roots, found)
        discard(texts, found)

    least = nodes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = stage(least, "near-roots")
    discard(members, open_, nodes, roots, *held)
    ids = least.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = least.join(ids, "root").select("node", "root", "component_id")
    linked = worded.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "check"), F.lit(4)).cast("int"))
    linked = linked.join(salted(named, 4), ["node", "_salt"]).select("doc_id", "check", "n_shingles", "component_id", "root")
    alone = signed.filter("node is null").select("doc_id", "check", "n_shingles", F.col("doc_id").alias("component_id"), F.col("node").alias("root"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component."""
    a = roots.select(F.col("node").alias("a"), F.col("root").alias("_ra"))
    b = roots.select(F.col("node").alias("b"), F.col("root").alias("_rb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").filter(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).select("a", "b")


def _texts(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the nodes in the pairs: one text each (several only for repeated rows)."""
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = nodes.select("node", "rep", "check").join(used, "node", "left_semi")
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_check"), text.alias("text"))
    found = rows.join(wanted.hint("shuffle_hash"), rows["_id"].eqNullSafe(wanted["rep"]) & (rows["_check"] == wanted["check"]))
    return stage(found.select("node", "text"), "near-texts")
