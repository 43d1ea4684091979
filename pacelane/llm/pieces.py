"""SentencePiece encoding and decoding through a table of distinct chunks.

A text is read as the library reads it: one marker in front, every space a marker.
When no piece has a marker behind another character, a merge can never reach over
the place where a run of markers begins, so the text falls into marked words that
are segmented independently.  Each task keeps a table of the distinct marked words
it has met; every distinct word is segmented (and decoded) once by the library, and
a text's ids are the words' ids joined by position.

Null and empty texts have no ids and decode to the empty text.  Repeated rows and
equal texts get equal rows.  Very long texts are cut into words like any other.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelane.llm.frames import plain, ship_package

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class ChunkTable:
    """Distinct marked words, each without its first marker, with their ids; holds ``limit`` words, then starts anew."""

    def __init__(self, model: bytes, limit: int = 300_000):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        count = self.processor.get_piece_size()
        if any(MARK in self.processor.id_to_piece(i).lstrip(MARK) for i in range(count)):
            raise ValueError("pieces of this model cross whitespace markers")
        if self.processor.encode("a b") != self.processor.encode("a") + self.processor.encode("b") or self.processor.encode("  ") == []:
            raise ValueError("this model drops spaces or adds no marker in front")
        self.alone = self.processor.piece_to_id(MARK)
        self.number = [str(i) for i in range(count)]
        self.limit = limit
        self.shown: dict[str, str] = {}
        self.other: dict[str, str] = {}

    def learn(self, words: set[str]) -> None:
        """Segment and decode the words that are not in the table yet."""
        if len(self.shown) > self.limit:
            self.shown, self.other = {}, {}
        new = list(words.difference(self.shown))
        if not new:
            return
        ids = self.processor.encode(new, num_threads=1)
        if "" in words:
            ids = [i or [self.alone] for i in ids]
        for word, text in zip(new, self.processor.decode(ids, num_threads=1), strict=True):
            if word != text:
                self.other[word] = text
        number = self.number
        for word, codes in zip(new, ids, strict=True):
            self.shown[word] = ",".join([number[i] for i in codes])

    def joined(self, words: list[str]) -> str:
        """Ids of a text's words by position, in decimal, joined by commas."""
        return ",".join(map(self.shown.__getitem__, words))

    def decoded(self, words: list[str]) -> str:
        """Decoded words by position; ``other`` holds those that do not decode to themselves."""
        if not self.other or self.other.keys().isdisjoint(words):
            return " ".join(words)
        return " ".join([self.other.get(w, w) for w in words])


def words_of(text: str | None) -> list[str]:
    """Marked words of a text in order, each without its first marker; an empty word is a lone marker."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " ":
        return text.split(" ")
    return [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]


def _groups(texts: pa.Array, size: int) -> Iterator[list[str | None]]:
    """Runs of texts of about ``size`` characters."""
    group, chars = [], 0
    for text in texts:
        group.append(text.as_py())
        chars += len(group[-1] or "")
        if chars >= size:
            yield group
            group, chars = [], 0
    if group:
        yield group


def _lists(rows: list[array]) -> pa.Array:
    """Arrow lists from packed numbers, without an object for each number."""
    offsets = [0, *accumulate(len(r) for r in rows)]
    values = array("i")
    for row in rows:
        values.extend(row)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), len(values), [None, pa.py_buffer(values.tobytes())]))


def piece_codes(df: DataFrame, model: bytes, id_column: str = "doc_id", text_column: str = "text", digest: bool = False) -> DataFrame:
    """Ids of every whole text and the text that they decode to.

    ``model`` holds the bytes of a model file.  Columns: the id, ``n_tokens``, then ``ids``
    (array of int) and ``decoded``; with ``digest`` instead the SHA-256 of the ids (decimal, joined by
    commas) and of the decoded text.
    """
    ship_package(df.sparkSession)
    source = plain(df, id_column, text_column)
    kind = source.schema[id_column].dataType.simpleString()
    rest = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"

    def encode(batches):
        table = ChunkTable(model)
        for batch in batches:
            at = 0
            for group in _groups(batch.column(1), 1 << 20):
                counts, first, second = [], [], []
                split = [words_of(text) for text in group]
                table.learn(set().union(*split))
                for words in split:
                    shown, decoded = table.joined(words), table.decoded(words)
                    counts.append(shown.count(",") + bool(shown))
                    first.append(hashlib.sha256(shown.encode()).hexdigest() if digest else array("i", map(int, shown.split(","))) if shown else array("i"))
                    second.append(hashlib.sha256(decoded.encode()).hexdigest() if digest else decoded)
                ids = pa.array(first, pa.string()) if digest else _lists(first)
                # one output batch for each group keeps little in memory at a time
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), pa.array(counts, pa.int64()), ids, pa.array(second, pa.string())], names)
                at += len(group)

    names = [id_column, "n_tokens", *[c.split()[0] for c in rest.split(", ")]]
    return source.mapInArrow(encode, f"`{id_column}` {kind}, n_tokens long, {rest}")


def decode_ids(df: DataFrame, model: bytes, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Text of every row's ids by the library; null or no ids give the empty text."""
    ship_package(df.sparkSession)
    source = plain(df, id_column, ids_column)
    kind = source.schema[id_column].dataType.simpleString()

    def decode(batches):
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            texts = [processor.decode(ids) if ids else "" for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_column, "decoded"])

    return source.mapInArrow(decode, f"`{id_column}` {kind}, decoded string")


def with_pieces(df: DataFrame, model: bytes) -> DataFrame:
    """Pipeline form: ``doc_id``, ``n_tokens``, ``ids`` and ``decoded`` of every document."""
    return piece_codes(df, model).select("doc_id", "n_tokens", "ids", F.col("decoded"))
