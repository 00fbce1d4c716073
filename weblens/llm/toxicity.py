"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks.

The kernel of two strings counts their common subsequences of four places that span at most seven
characters, each weighted down by its gaps, so that ``idiot`` and ``idxiot`` stay close.  A word's
edge is a place like a letter, at either end of a subsequence.  The machine is linear in kernel
values with landmark strings; as those strings' subsequences are known, its decision is a table of
one weight per subsequence, and scoring a text is adding them up.  A text's margin is that of its
worst window.

It learns from labelled sentences by their windows.  All sentences of clean texts are clean; of a toxic
text at least one is toxic, and which ones those are is found together with the machine: first by letter
groups that tell the classes apart, then by the machine's own margins.  What the machine is then fitted on
are strings of at most fourteen characters of those sentences, mostly single words, and copies of them
that have a letter put in.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblens.llm.common import pieces_of, slices, text_or_empty

#: Places of a subsequence beyond its first, how far they reach, what a skipped character costs, starts in a window.
SPAN, DECAY, STARTS = 6, 0.5, 8
LENGTH = STARTS + SPAN
#: Bounds of the training sample: labelled texts of each class, code points of a text in it, and of all texts of a class.
TEXTS_PER_CLASS, LONGEST, CHARS_PER_CLASS = 3000, 20_000, 12_000_000
#: Landmarks from toxic sentences, from the hardest clean ones and from clean ones at random.
LANDMARKS, HARD_LANDMARKS, CLEAN_LANDMARKS = 144, 64, 32
#: Rounds of training, strings of either side in one, and toxic strings of a text.
ROUNDS, STRINGS, STRINGS_PER_TEXT = 4, 6000, 4
#: Parts of the sample that are each judged by a machine fitted on the others, for the scores' scale.
FOLDS = 3
#: Characters encoded in one go.
CHUNK = 1 << 16
#: Code points of the pieces that longer texts are scored in, and that two of them share.
LONG_CHARS, SHARED = 1 << 18, 256

_PATTERNS = {d3: [(d1, d2) for d1 in range(1, d3) for d2 in range(d1 + 1, d3)] for d3 in range(3, SPAN + 1)}
#: Folded characters: edges of words, marks (which are left out), and what is between texts.
_SPACE, _MARK, _BETWEEN = 0, 1, 2


@lru_cache(maxsize=1)
def _folds() -> np.ndarray:
    """Every code point as a lower-case letter without accent, digits and signs as the letters they look like, space or mark."""
    import unicodedata

    looks = dict(zip("0134579@$", "oieastgas"))
    table = np.full(0x110000, _MARK, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isspace():
            table[i] = _SPACE
        elif c in looks:
            table[i] = ord(looks[c])
        elif c.isalpha():
            table[i] = ord(unicodedata.normalize("NFD", c.lower())[0]) if i < 0x3000 else i
    return table


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of all texts in one array, and where each begins.

    Marks are left out, runs of spaces are one, and so are spaces between single characters: ``i d
    i.o t`` reads ``idiot``.  Between texts stand so many spaces that no window holds parts of two.
    """
    between = "\x02" * (LENGTH + 1)
    joined = (between + between.join(texts) + between).encode("utf-32-le", "replace")
    points = np.frombuffer(joined, np.uint32)
    sizes = np.array([len(t) + LENGTH + 1 for t in texts], np.int64)
    starts = LENGTH + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    out = _folds()[points]
    for k, begin in enumerate(starts.tolist()):  # the separator is a mark inside texts
        out[begin - LENGTH : begin + 1] = _BETWEEN
        if k == len(starts) - 1:
            out[begin + sizes[k] - LENGTH :] = _BETWEEN
    keep = out != _MARK
    place = np.cumsum(keep) - keep
    out, starts = out[keep], place[starts] if len(texts) else starts
    space = out == _SPACE
    edge = space | (out == _BETWEEN)
    keep = np.ones(len(out), bool)
    keep[1:] = ~(space[1:] & edge[:-1])
    keep[:-1] &= ~(space[:-1] & (out[1:] == _BETWEEN))
    place = np.cumsum(keep) - keep
    out, starts = out[keep], place[starts] if len(texts) else starts
    space = out == _SPACE
    edge = space | (out == _BETWEEN)
    keep = np.ones(len(out), bool)
    if len(out) > 4:
        keep[2:-2] = ~(space[2:-2] & edge[:-4] & edge[4:])
    place = np.cumsum(keep) - keep
    out = out[keep]
    out[out == _BETWEEN] = _SPACE
    return out, place[starts] if len(texts) else starts


def _ends(folded: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the texts that begin at ``starts`` end: the spaces behind them."""
    return np.append(starts[1:] - LENGTH, len(folded) - LENGTH - 1) if len(starts) else starts


def _most(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The largest value of each text."""
    return np.maximum.reduceat(values, np.ravel([starts, ends], "F"))[::2]


def _features(codes: np.ndarray, bits: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """For each span: its patterns' subsequences at every start as numbers, and the weight there (0 over an edge inside)."""
    n = len(codes) - SPAN
    first, second, third, last = (codes.astype(np.int32) << (k * bits) for k in (3, 2, 1, 0))
    letter = codes != _SPACE
    clear = letter[1 : n + 1] & letter[2 : n + 2]
    for d3, pairs in _PATTERNS.items():
        clear = clear & letter[d3 - 1 : n + d3 - 1]
        head = first[:n] | last[d3 : n + d3]
        yield [head | second[d1 : n + d1] | third[d2 : n + d2] for d1, d2 in pairs], clear * np.float32(DECAY ** (d3 - 3))


@dataclass
class Alphabet:
    """Codes of folded letters: 0 an edge, 1 any letter that no landmark has, then the landmarks' letters.

    Five bits hold 30 of them, six bits 62; if there are more, the rarest share codes.
    """

    letters: list[int]
    bits: int = field(init=False)

    def __post_init__(self) -> None:
        self.bits = 5 if len(self.letters) <= 30 else 6

    def codes(self, folded: np.ndarray) -> np.ndarray:
        table = self.__dict__.get("_table")
        if table is None:
            table = np.ones(0x110000, np.uint8)
            table[_SPACE] = 0
            own = (1 << self.bits) - 2
            for k, letter in enumerate(self.letters):
                table[letter] = 2 + k % own
            self._table = table
        return table[folded]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_table"}


@dataclass
class ToxicityModel:
    """weights: one per subsequence; margin = worst window's sum + bias; score = logistic(slope * margin + shift)."""

    alphabet: Alphabet
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def __getstate__(self) -> dict:
        """Of the weights only those that aren't 0: some thousands."""
        at = np.flatnonzero(self.weights)
        return self.__dict__ | {"weights": (len(self.weights), at, self.weights[at])}

    def __setstate__(self, state: dict) -> None:
        n, at, values = state["weights"]
        self.__dict__.update(state | {"weights": np.zeros(n, np.float32)})
        self.weights[at] = values

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The sum of the window that begins at each folded character, the beginnings of texts, the characters and what each adds."""
        folded, starts = fold(texts)
        codes = self.alphabet.codes(folded)
        total = np.zeros(len(codes) - SPAN, np.float32)
        for numbers, weight in _features(codes, self.alphabet.bits):
            part = np.zeros_like(total)
            for number in numbers:
                part += self.weights.take(number)
            part *= weight
            total += part
        run = np.concatenate([[0], np.cumsum(total, dtype=np.float64)])
        sums = run[np.minimum(np.arange(len(total)) + STARTS, len(total))] - run[:-1]
        return sums, starts, folded, total

    def margins(self, texts: list[str]) -> np.ndarray:
        """The margin of each text, encoded in chunks; of a long text that of its worst piece, where pieces share more than a window."""
        if not texts:
            return np.zeros(0)
        pieces = [pieces_of(t, LONG_CHARS, SHARED) for t in texts]
        out = []
        for part in _chunks([x for own in pieces for x in own]):
            sums, starts, folded, _ = self.windows(part)
            out.append(_most(sums, starts, _ends(folded, starts)) + self.bias)
        firsts = np.cumsum([0] + [len(own) for own in pieces])[:-1]
        return np.maximum.reduceat(np.concatenate(out), firsts)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -40, 40)))


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) + LENGTH
        if held >= CHUNK or i == len(texts) - 1:
            yield texts[begin : i + 1]
            begin, held = i + 1, 0


#: A sentence, with what ends it.
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")


def _sentences(text: str) -> list[str]:
    """The text's sentences; one that is cut inside words, as by ``id.iot``, goes on to the next space."""
    out: list[str] = []
    for found in SENTENCE.findall(text):
        if out and not out[-1][-1].isspace() and not found[0].isspace():
            out[-1] += found
        else:
            out.append(found)
    return out


#: Lengths of letter groups, slots of the tables that count them, and evidence (twice a log-likelihood ratio) they need.
GROUPS, SLOTS, EVIDENCE = range(4, 9), 1 << 22, 20.0
#: How much more frequent in toxic texts telling groups are: first the plain ones, then others in the texts that have none of those.
PLAIN, TELLING = 20, 3


def _group_slots(folded: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The slot of the group of ``n`` characters that begins at each place, and where there is one: edges only at its ends."""
    m = max(0, len(folded) - n + 1)
    hashed = np.full(m, n, np.uint64)
    clear = np.ones(m, bool)
    for j in range(n):
        hashed = (hashed ^ folded[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
        if 0 < j < n - 1:
            clear &= folded[j : j + m] != _SPACE
    return (hashed >> np.uint64(42)).astype(np.int64), clear


def _group_evidence(texts: list[str], labels: list[int], times: float) -> np.ndarray:
    """How well each slot's letter groups tell toxic texts from clean ones, by the texts that hold them; 0 below EVIDENCE.

    Groups that aren't ``times`` as frequent in toxic texts have none.  A text of which half was seen in texts before is a copy and tells nothing new.
    """
    counts = np.zeros((2, SLOTS), np.int32)
    seen = np.zeros((2, SLOTS), bool)
    total = [0, 0]
    for text, label in zip(texts, labels):
        folded, _ = fold([text])
        passages = _group_slots(np.where(folded == _SPACE, np.uint32(3), folded), 24)[0]
        passages = passages[passages % 16 == 0]
        if len(passages) >= 4 and seen[label, passages].mean() > 0.5:
            continue
        seen[label, passages] = True
        total[label] += 1
        for n in GROUPS:
            slots, clear = _group_slots(folded, n)
            counts[label][slots[clear]] += 1  # once a text
    at = np.flatnonzero(counts[1] >= 3)
    bad, good = counts[1][at].astype(np.float64), counts[0][at].astype(np.float64)
    share = total[1] / max(1, sum(total))
    with np.errstate(divide="ignore", invalid="ignore"):
        found = 2 * (bad * np.log(bad / ((bad + good) * share)) + np.where(good > 0, good * np.log(good / ((bad + good) * (1 - share))), 0))
    telling = (bad / max(1, total[1]) >= times * good / max(1, total[0])) & (found >= EVIDENCE)
    evidence = np.zeros(SLOTS, np.float32)
    evidence[at[telling]] = found[telling]
    return evidence


def _strings_at(folded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of LENGTH characters from each place on: the window as it is scored."""
    return folded[np.minimum(at[:, None] + np.arange(LENGTH), len(folded) - 1)]


def _words_at(folded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The word that each place lies in with its edges, from at most STARTS places before, as a row of LENGTH characters."""
    begin, found = at.copy(), np.zeros(len(at), bool)
    for back in range(STARTS + 1):
        spot = np.maximum(at - back, 0)
        begin = np.where(found, begin, spot)
        found |= (folded[spot] == _SPACE) & (folded[np.minimum(spot + 1, len(folded) - 1)] != _SPACE)
    rows = _strings_at(folded, begin)
    inside = np.arange(LENGTH) > 0
    return np.where(np.cumsum((rows == _SPACE) & inside, axis=1) > 0, np.uint32(_SPACE), rows)


#: Strings that are found n times together weigh as much as n ** EVENED: rare insults, as of a language with few toxic texts, are fitted too.
EVENED = 0.5


def _evened(strings: np.ndarray) -> np.ndarray:
    """What each string weighs, by how often it occurs among ``strings``."""
    _, which, counts = np.unique(strings, axis=0, return_inverse=True, return_counts=True)
    return counts[which.ravel()].astype(np.float64) ** (EVENED - 1)


def _svm(x: np.ndarray, y: np.ndarray, own: np.ndarray, rounds: int = 500, c: float = 1.0) -> np.ndarray:
    """Linear support vector machine with squared hinge loss by accelerated gradient steps; the last column is the bias.

    Both classes weigh the same, and their rows by ``own``.
    """
    weight = own * np.where(y > 0, 0.5 / own[y > 0].sum(), 0.5 / own[y < 0].sum()) * len(y) * c
    lead = w = np.zeros(x.shape[1])
    scale = 2 * np.linalg.norm(x * np.sqrt(weight)[:, None].astype(x.dtype), 2) ** 2 / len(y) + 1e-3
    t = 1.0
    for _ in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ lead.astype(x.dtype)))
        grad = -2 * (weight * y * gap).astype(x.dtype) @ x / len(y) + 1e-3 * lead
        new = lead - grad / scale
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        lead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def _stretched(words: np.ndarray, letters: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The words with one of ``letters`` put in at a random place inside, as those do that hide them: they are as toxic."""
    size = (words[:, 1:] != _SPACE).sum(1)
    at = 2 + (rng.random(len(words)) * np.maximum(size - 1, 1)).astype(int)
    put = rng.choice(letters, len(words))
    place = np.arange(LENGTH)[None, :]
    return np.where(place == at[:, None], put[:, None], np.where(place < at[:, None], words, np.roll(words, 1, axis=1)))


class Landmarks:
    """Landmark strings, their subsequences, and the Nyström coordinates of other strings."""

    def __init__(self, strings: np.ndarray) -> None:
        letters = Counter(strings[strings != _SPACE].tolist())
        self.alphabet = Alphabet([x for x, _ in sorted(letters.items(), key=lambda p: (-p[1], p[0]))])
        numbers, weights, owner = self._numbers(strings)
        self.place = np.unique(numbers)
        z = np.zeros((len(strings), len(self.place)), np.float32)
        np.add.at(z, (owner, np.searchsorted(self.place, numbers)), weights)
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        self.z = z[norm[:, 0] > 0] / norm[norm[:, 0] > 0]
        values, vectors = np.linalg.eigh((self.z @ self.z.T).astype(float))
        self.root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
        self.index = np.full(1 << 4 * self.alphabet.bits, -1, np.int32)
        self.index[self.place] = np.arange(len(self.place))

    def _numbers(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All subsequences that begin within the first STARTS characters of the strings: numbers, weights, whose they are."""
        flat = self.alphabet.codes(np.concatenate([strings.ravel(), np.zeros(SPAN, strings.dtype)]))
        inside = np.arange(strings.size) % LENGTH < STARTS
        numbers, weights, owner = [], [], []
        for found, weight in _features(flat, self.alphabet.bits):
            hit = np.flatnonzero(inside & (weight > 0))
            for number in found:
                numbers.append(number[hit])
                weights.append(weight[hit])
                owner.append(hit // LENGTH)
        return np.concatenate(numbers), np.concatenate(weights), np.concatenate(owner)

    def images(self, strings: np.ndarray) -> np.ndarray:
        """Kernel values of strings with the landmarks, in Nyström coordinates, and a column of ones."""
        out = np.ones((len(strings), len(self.z) + 1), np.float32)
        for a in range(0, len(strings), 64):
            numbers, weights, owner = self._numbers(strings[a : a + 64])
            at = self.index[numbers]
            held, n = at >= 0, len(strings[a : a + 64])
            size = len(self.place)
            dense = np.bincount(owner[held] * size + at[held], weights[held], n * size).reshape(n, size).astype(np.float32)
            out[a : a + 64, :-1] = dense @ self.z.T @ self.root
        return out

    def model(self, w: np.ndarray) -> ToxicityModel:
        weights = np.zeros(len(self.index), np.float32)
        weights[self.place] = (self.root @ w[:-1]) @ self.z
        return ToxicityModel(self.alphabet, weights, float(w[-1]), 1.0, 0.0)


def _distinct(strings: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` most frequent different strings, the first by code point of equally frequent ones."""
    if not len(strings):
        return strings
    rows, counts = np.unique(strings, axis=0, return_counts=True)
    return rows[np.argsort(-counts, kind="stable")[:n]]


def _worst(model: ToxicityModel, texts: list[str], least: float, each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to ``each`` sentences of each text with a margin above ``least``: their worst windows, the words that weigh most there, margins."""
    windows, words, margins = [np.zeros((0, LENGTH), np.uint32)], [np.zeros((0, LENGTH), np.uint32)], [np.zeros(0)]
    for text in texts:
        for part in _chunks(_sentences(text)):
            sums, starts, folded, total = model.windows(part)
            ends = _ends(folded, starts)
            top = _most(sums, starts, ends) + model.bias
            order = [k for k in np.argsort(-top, kind="stable")[:each].tolist() if top[k] > least]
            if order:
                at = np.array([starts[k] + int(np.argmax(sums[starts[k] : ends[k]])) for k in order])
                windows.append(_strings_at(folded, at))
                words.append(_words_at(folded, np.array([a + int(np.argmax(total[a : a + STARTS])) for a in at.tolist()])))
                margins.append(top[order])
    return np.concatenate(windows), np.concatenate(words), np.concatenate(margins)


def _witnesses(texts: list[str], evidence: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The sentences of toxic texts that hold telling letter groups: the word of the strongest of each; and texts without any."""
    strings, without = [np.zeros((0, LENGTH), np.uint32)], []
    for text in texts:
        folded, starts = fold(_sentences(text))
        if not len(starts):
            continue
        best = np.zeros(len(folded), np.float32)
        for n in GROUPS:
            slots, clear = _group_slots(folded, n)
            best[: len(slots)] = np.maximum(best[: len(slots)], evidence[slots] * clear)
        at = np.array([a + int(np.argmax(best[a:b])) for a, b in zip(starts.tolist(), _ends(folded, starts).tolist())])
        at = at[np.argsort(-best[at], kind="stable")[:STRINGS_PER_TEXT]]
        at = at[best[at] > 0]
        strings.append(_words_at(folded, at))
        if not len(at):
            without.append(text)
    return np.concatenate(strings), without


def _plain(texts: list[str], rng: np.random.Generator, n: int) -> np.ndarray:
    """Windows of clean texts that begin at an edge of a word, at random."""
    out = [np.zeros((0, LENGTH), np.uint32)]
    for text in texts:
        folded, _ = fold([text])
        edges = np.flatnonzero((folded[:-1] == _SPACE) & (folded[1:] != _SPACE))
        if len(edges):
            out.append(_strings_at(folded, rng.choice(edges, min(len(edges), 1 + n // max(1, len(texts))))))
    return np.concatenate(out)[:n]


def _flat() -> ToxicityModel:
    """The model of too little: every text gets one low score."""
    return ToxicityModel(Alphabet([]), np.zeros(1 << 20, np.float32), -1.0, 1.0, 0.0)


def machine(texts: list[str], labels: list[int], seed: int = 1) -> ToxicityModel | None:
    """The machine of labelled texts, its scores' scale not set; None without texts of both classes or a letter group that tells them apart.

    It is trained in rounds: on the toxic sentences known so far against random and hard windows of
    clean sentences; then each toxic text's sentences above what clean texts reach become its toxic
    ones, and the hardest clean ones join the other side and the landmarks.  The order of the texts
    doesn't matter.  Besides the texts, memory holds a few tables of SLOTS entries and the strings of
    a round, whatever the texts' number and length.
    """
    pairs = sorted(((zlib.crc32(t.encode("utf-8", "replace")), t, int(bool(x))) for t, x in zip(texts, labels)))
    bad = [t for _, t, x in pairs if x]
    good = [t for _, t, x in pairs if not x]
    if not bad or not good:
        return None
    rng = np.random.default_rng(seed)
    plain, rest = _witnesses(bad, _group_evidence(good + bad, [0] * len(good) + [1] * len(bad), PLAIN))
    other, _ = _witnesses(rest, _group_evidence(good + rest, [0] * len(good) + [1] * len(rest), TELLING))
    witnesses = toxic = np.concatenate([plain, other])
    clean = _plain(good, rng, STRINGS)
    if not len(toxic) or not len(clean):
        return None
    hard, likely, model = np.zeros((0, LENGTH), np.uint32), np.zeros((0, LENGTH), np.uint32), None
    for k in range(ROUNDS):
        some = clean[rng.permutation(len(clean))[:CLEAN_LANDMARKS]]
        landmarks = Landmarks(np.concatenate([_distinct(toxic, LANDMARKS), _distinct(likely, HARD_LANDMARKS), some]))
        shown = toxic[:STRINGS]
        hidden = _stretched(shown, clean[:, 1:][clean[:, 1:] != _SPACE], rng)
        x = np.concatenate([shown, hidden, clean, hard[:STRINGS]])
        y = np.where(np.arange(len(x)) < len(shown) + len(hidden), 1.0, -1.0)
        own = np.concatenate([np.tile(_evened(shown), 2), np.ones(len(x) - 2 * len(shown))])
        w = _svm(landmarks.images(x), y, own)
        model = landmarks.model(w)
        if k == ROUNDS - 1:
            break
        more, words, margin = _worst(model, good, -1.0, 2)
        hard = np.concatenate([more[np.argsort(-margin, kind="stable")], hard])
        hard = hard[np.sort(np.unique(hard, axis=0, return_index=True)[1])]
        likely = np.concatenate([likely, words])
        sure = max(float(np.quantile(model.margins(good), 0.99)), 0.5)
        _, found, _ = _worst(model, bad, sure, STRINGS_PER_TEXT)
        held = landmarks.images(witnesses) @ w
        toxic = np.concatenate([witnesses[held > 0], found])
        toxic = toxic[rng.permutation(len(toxic))] if len(toxic) else witnesses
    return model


def fold_of(text: str) -> int:
    """The part of the cross-fit a text is judged in; copies share it."""
    return zlib.crc32(text.encode("utf-8", "replace")) % FOLDS


def part_of_fit(texts: list[str], labels: list[int], part: int, seed: int = 1) -> tuple[ToxicityModel | None, np.ndarray, np.ndarray]:
    """Part ``part`` of a cross-fit: the machine, and margins and labels of the texts it is to judge.

    Below FOLDS the machine learns from the other folds' texts and judges its own fold's; part FOLDS
    learns from all texts and judges none.
    """
    own = [fold_of(t) == part for t in texts]
    model = machine([t for t, x in zip(texts, own) if not x], [m for m, x in zip(labels, own) if not x], seed)
    if model is None or part == FOLDS:
        return model, np.zeros(0), np.zeros(0)
    return model, model.margins([t for t, x in zip(texts, own) if x]), np.array([float(bool(m)) for m, x in zip(labels, own) if x])


def calibrated(model: ToxicityModel | None, margins: np.ndarray, truth: np.ndarray, stands_for: tuple[float, float] = (1.0, 1.0)) -> ToxicityModel:
    """``model`` with the scale of scores that margins of texts unseen by their machine have.

    A clean and a toxic text count for as many labelled texts as ``stands_for`` says, so that a score
    means the same whatever share of each class was sampled.
    """
    if model is None:
        return _flat()
    order = np.lexsort((truth, margins))  # sums that don't hang on the order of tasks
    margins, truth = margins[order], truth[order]
    share = np.where(truth > 0, stands_for[1], stands_for[0])
    share = share / share.mean() if len(share) else share
    slope, shift = 2.0, 0.0
    for _ in range(4000 if len(margins) else 0):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -40, 40)))
        slope += 0.5 * float((share * (truth - p) * margins).mean())
        shift += 0.5 * float((share * (truth - p)).mean())
    return ToxicityModel(model.alphabet, model.weights, model.bias, max(slope, 0.1), shift)


def fit(texts: list[str], labels: list[int], seed: int = 1, stands_for: tuple[float, float] = (1.0, 1.0)) -> ToxicityModel:
    """Cross-fit on labelled texts: the machine learns from all of them, and the scores' scale from machines that each left a fold out.

    Neither hangs on the order of the texts.  Without texts of both classes, or without a letter
    group that tells them apart, every text gets one low score.
    """
    parts = [part_of_fit(texts, labels, k, seed) for k in range(FOLDS + 1)]
    return calibrated(parts[-1][0], np.concatenate([m for _, m, _ in parts]), np.concatenate([t for _, _, t in parts]), stands_for)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TEXTS_PER_CLASS, most_chars: int = CHARS_PER_CLASS) -> DataFrame:
    """(_h, _id, _label, _text): at most ``most`` texts and ``most_chars`` code points of each class, the first by a hash of the id.

    Repeated labels count once, and of the texts that share an id the least is taken.  Null labels,
    ids and texts, and texts above LONGEST, are left out before the bounds apply, so they don't
    shrink the sample.
    """
    rows = docs.filter(F.col(text_col).isNotNull() & (F.length(text_col) <= LONGEST)).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    usable = _marked(labels, id_col, label_col).join(rows.select("_id").distinct(), "_id", "left_semi")
    pick = lambda k: usable.filter(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(most)
    chosen = pick(1).unionByName(pick(0))  # at most 2 * most rows: small enough to broadcast
    got = rows.join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    upto = F.sum(F.length("_text")).over(Window.partitionBy("_label").orderBy(F.xxhash64("_id"), "_id"))  # over the chosen rows
    got = got.withColumn("_upto", upto).filter(F.col("_upto") <= most_chars)
    return got.select(F.xxhash64("_id").alias("_h"), "_id", "_label", "_text")


def _marked(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    label = F.when(F.col(label_col) == 1, 1).when(F.col(label_col) == 0, 0)
    return labels.select(F.col(id_col).alias("_id"), label.alias("_label")).dropna().distinct()


def learn_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TEXTS_PER_CLASS, most_chars: int = CHARS_PER_CLASS) -> ToxicityModel:
    """Cross-fit on the ``labelled_sample``, each part in a task of its own; the driver gets the model and one margin a text.

    The labels of each class are counted over all rows given: the scores' scale follows their ratio,
    not that of the sample.  Without labels or texts all scores are one low value.
    """
    counts = tuple(_marked(labels, id_col, label_col).agg(*[F.count_if(F.col("_label") == k).alias(str(k)) for k in (0, 1)]).first())
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, most, most_chars)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        texts, marks = table["_text"].to_pylist(), table["_label"].to_pylist()
        part = table["_part"][0].as_py()
        model, margins, truth = part_of_fit(texts, marks, part)
        last = part == FOLDS
        sampled = [marks.count(k) for k in (0, 1)] if last else None
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model) if last else None], pa.binary()), "margins": pa.array([margins.tolist()], pa.list_(pa.float64())), "truth": pa.array([truth.tolist()], pa.list_(pa.float64())), "sampled": pa.array([sampled], pa.list_(pa.int64()))})

    dealt = sample.select("_label", "_text", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))).alias("_part"))
    parts = dealt.repartitionById(FOLDS + 1, F.col("_part")).mapInArrow(train, "model binary, margins array<double>, truth array<double>, sampled array<long>").collect()
    whole = next((r for r in parts if r["sampled"]), None)
    if whole is None:
        return _flat()
    stands_for = tuple(max(1.0, n / max(1, m)) for n, m in zip(counts, whole["sampled"]))
    margins, truth = (np.array([x for r in parts for x in r[k]]) for k in ("margins", "truth"))
    return calibrated(pickle.loads(whole["model"]), margins, truth, stands_for)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score and predicted (1 if score >= threshold) added (replaced, where they exist).

    Null and empty texts have an empty window and get the score of the bias alone.  Whole texts are
    read; only the text is looked at.  Repeated rows are scored each and alike; an empty table gives
    an empty one; all other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            scores = [shared.value.scores(part.to_pylist()) for part in slices(batch)]
            yield pa.array(np.concatenate(scores) if scores else [], pa.float64())

    scored = docs.drop("score", "predicted").withColumn("score", judge(text_or_empty(text_col)))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
