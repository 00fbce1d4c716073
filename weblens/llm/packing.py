"""Packing token sequences into windows of fixed length by the online sum-of-squares rule."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm.common import pieces_of, slices, text_or_empty

WINDOW = 4096
#: Words whose ids a worker remembers before it starts anew.
CACHE_WORDS = 800_000
#: Code points of a text that are split into words at once.
LONG_CHARS = 1 << 20


class WordIds(dict):
    """Token ids (little-endian unsigned 32-bit, as bytes) by white-space-free chunk of text.

    The vocabulary drops white space and no token goes on over it, so a text's ids are those of its
    chunks, one after another.  Chunks of Latin letters, ASCII digits and marks fall into the
    vocabulary's words (runs of letters, single digits, runs of marks), which go straight to its
    model and are remembered; all else goes through the whole tokenizer.
    """

    #: Latin letters that stay themselves under NFC and lower-case to one letter; digits; marks but the apostrophe.
    letters, marks = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž", r"!-&(-/:-@\[-`{-~"
    plain = re.compile(f"[{letters}0-9{marks}]+")
    words_of = re.compile(f"[{letters}]+|[0-9]|[{marks}]+")

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer, self.model, self.words = tokenizer, tokenizer.model, {}
        from tokenizers.pre_tokenizers import ByteLevel

        # the letter by which the vocabulary shows each byte of UTF-8 in a longer letter's encoding
        shown = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {}
        for letter in map(chr, range(0xC0, 0x180)):
            self.shown |= dict(zip(letter.encode(), shown.pre_tokenize_str(letter)[0][0]))

    def word(self, part: str) -> bytes:
        found = self.words.get(part)
        if found is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.shown)
            found = self.words[part] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return found

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            ids = self.word(chunk.lower())
        elif self.plain.fullmatch(chunk) and "<|" not in chunk:
            ids = b"".join(map(self.word, self.words_of.findall(chunk.lower())))
        else:
            ids = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        return b"".join(map(self._ids, pieces_of(text, LONG_CHARS)))

    def _ids(self, text: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.words.clear()
        # str.split() also splits at four control characters that the tokenizer doesn't take as space
        chunks = text.split() if not re.search("[\x1c-\x1f]", text) else re.split("[ \t-\r]+", text)
        return b"".join(map(self.__getitem__, chunks))


@lru_cache(maxsize=2)
def word_ids(name: str) -> WordIds:
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name)))


class SumOfSquares:
    """Online packer of one task.

    ``counts[h]`` is the number of open windows filled to level h.  A piece goes to the level (0: a
    new window) after which the sum of squared counts is least; full windows leave.  ``finish`` fills the
    windows still open with the pieces of the emptiest of them, so nothing is padded and all other
    pieces stay where the rule put them.
    """

    def __init__(self, first_id: int, window: int = WINDOW) -> None:
        self.window, self.next_id = window, first_id
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}

    def level_for(self, size: int) -> int:
        """The level whose use makes the sum of squares least; the fullest of several."""
        n = self.counts
        top = self.window - size
        change = np.full(top + 1, np.iinfo(np.int64).max)
        after = 2 * n[size : self.window + 1] + 1
        after[-1] = 0  # a full window is no longer counted
        used = n[: top + 1] > 0
        change[used] = (after - 2 * n[: top + 1] + 1)[used]
        change[0] = after[0]
        return top - int(np.argmin(change[::-1]))

    def place(self, piece: tuple) -> Iterator[list[tuple]]:
        """Take a piece (doc, start, ids, doc_tokens); yield a window when one is full."""
        size = len(piece[2]) // 4
        if size == self.window:
            yield [piece]
            return
        level = self.level_for(size)
        if level:
            bins = self.open[level]
            pieces = bins.pop()
            self.counts[level] -= 1
        else:
            pieces = []
        pieces.append(piece)
        level += size
        if level == self.window:
            yield pieces
        else:
            self.open.setdefault(level, []).append(pieces)
            self.counts[level] += 1

    def finish(self) -> Iterator[list[tuple]]:
        """The rest: the fullest open windows are filled up with what the emptiest hold, cut where they
        are full; what then remains is less than a window and is cut at powers of two."""
        left = deque((level, pieces) for level in sorted(self.open) for pieces in self.open[level])
        given: deque = deque()
        while left:
            level, pieces = left.pop()
            room = self.window - level
            while room and (given or left):
                if not given:
                    given.extend(left.popleft()[1])
                room -= self._move(given, pieces, room)
            if room:
                given.extend(pieces)
                break
            yield pieces
        size = sum(len(p[2]) for p in given) // 4
        while size:
            room, pieces = 1 << (size.bit_length() - 1), []
            size -= room
            while room:
                room -= self._move(given, pieces, room)
            yield pieces

    @staticmethod
    def _move(given: deque, pieces: list[tuple], room: int) -> int:
        """Move the first given piece, or as much of it as there is room for; tell how many tokens."""
        doc, start, ids, total = given.popleft()
        part, ids = ids[: room * 4], ids[room * 4 :]
        size = len(part) // 4
        pieces.append((doc, start, part, total))
        if ids:
            given.appendleft((doc, start + size, ids, total))
        return size

    def rows(self, pieces: list[tuple]) -> Iterator[tuple]:
        at, number = 0, self.next_id
        self.next_id += 1
        for doc, start, ids, total in pieces:
            size = len(ids) // 4
            yield doc, start, size, zlib.crc32(ids), total, number, at
            at += size


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens, a row per piece.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  Every partition of the input
    is packed by its own packer, so nothing is shuffled and a lost task is simply run again; its
    sequences are numbered from partition * 2**33 on.  A text of more than ``window`` tokens is cut
    into windows and a rest; one text at a time is held as ids, whatever its length.  Null and empty
    texts are one end token; equal or null ids and repeated rows are packed each; other columns are
    ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = word_ids(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        packer = SumOfSquares(TaskContext.get().partitionId() << 33, window)
        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def table(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 7, names=columns)

        for batch in batches:
            out: list[tuple] = []
            for part in slices(batch):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode.ids(text) + end
                    total = len(ids) // 4
                    for at in range(0, total, window):
                        for full in packer.place((doc, at, ids[at * 4 : (at + window) * 4], total)):
                            out.extend(packer.rows(full))
            yield table(out)
        yield table([r for pieces in packer.finish() for r in packer.rows(pieces)])

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
