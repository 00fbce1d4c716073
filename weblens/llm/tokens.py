"""Token counts: batches of texts go through the tokenizer in Arrow functions that return lengths only."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblens.llm.common import slices, text_or_empty

#: Bytes of text per call of the tokenizer.
BATCH_BYTES = 1 << 20
#: Rows that become Python strings at once.
ROWS = 512
#: Texts above this many code points are cut at safe boundaries.
LONG_CHARS = 1 << 16


@lru_cache(maxsize=4)
def _piece_model(name: str):
    """The sentencepiece model of that name, or at that path; checks once that texts may be cut before spaces."""
    import os

    import public_tokenizers
    import sentencepiece

    path = name if os.path.isabs(name) else public_tokenizers.path(name)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    inner = re.compile("[^▁]▁")
    if any(inner.search(model.id_to_piece(i)) for i in range(model.get_piece_size())):
        raise ValueError(f"{name}: a piece goes on over a space, so texts can't be cut there")
    return model


@lru_cache(maxsize=1 << 16)
def _stays(char: str) -> bool:
    """Whether a character keeps to itself under any normalizer: no mark, nothing composed or to compose, no space."""
    if "!" <= char <= "~":
        return True
    return unicodedata.category(char) in ("Lu", "Ll", "Lo", "Nd", "Po") and all(unicodedata.normalize(form, char) == char for form in ("NFC", "NFD", "NFKC", "NFKD")) and not unicodedata.combining(char)


def safe_pieces(text: str, limit: int = LONG_CHARS) -> list[str]:
    """Cut a text so that its pieces, encoded one by one, give as many tokens as the whole text.

    A cut replaces one single space between two characters that no normalizer changes or joins to
    others: no piece of the vocabulary goes on over a space, and the model puts the space back
    before each text.  Where no such space follows, the rest stays whole: there is no safe boundary.
    """
    out, at = [], 0
    while len(text) - at > limit:
        cut = text.find(" ", at + limit)
        while 0 < cut < len(text) - 1 and not (_stays(text[cut - 1]) and _stays(text[cut + 1])):
            cut = text.find(" ", cut + 1)
        if not 0 < cut < len(text) - 1:
            break
        out.append(text[at:cut])
        at = cut + 1
    return [*out, text[at:]]


def _balanced(texts: list[str], batch_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces of all texts in batches of about equal bytes of UTF-8, with the place of the text each belongs to."""
    places, pieces, held = [], [], 0
    for place, text in enumerate(texts):
        for piece in safe_pieces(text):
            size = len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))
            if pieces and held + size > batch_bytes:
                yield places, pieces
                places, pieces, held = [], [], 0
            places.append(place)
            pieces.append(piece)
            held += size
    if pieces:
        yield places, pieces


def token_length(text: Column, model: str, batch_bytes: int = BATCH_BYTES) -> Column:
    """Number of tokens of each text; null counts as the empty text (0 tokens)."""

    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = _piece_model(model)
        for batch in batches:
            counts = [0] * len(batch)
            for k, part in enumerate(slices(batch, ROWS)):
                for places, pieces in _balanced([x or "" for x in part.to_pylist()], batch_bytes):
                    for place, ids in zip(places, tokenizer.encode(pieces, num_threads=1)):
                        counts[k * ROWS + place] += len(ids)
            yield pa.array(counts, pa.int64())

    return lengths(text)


def count_tokens(docs: DataFrame, model: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) added.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; an empty table
    gives an empty table; very long texts are counted in pieces.  Columns of those three names are
    replaced; all others pass through.
    """
    text = text_or_empty(text_col)
    kept = docs.drop("n_bytes", "n_tokens", "over_limit")
    counted = kept.withColumn("n_bytes", F.octet_length(text).cast("long")).withColumn("n_tokens", token_length(text, model))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
