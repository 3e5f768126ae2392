"""Words of many texts at once, found with NumPy and numbered with Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of text handed to a Python worker at once, and looked at together there.
BATCH_BYTES = 4 << 20

WORD, BLANK, STOP = 0, 1, 2


def byte_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers in batches bounded by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def byte_kinds(blanks: bytes, stops: bytes = b"") -> np.ndarray:
    """The kind of each byte: part of a word, a blank, or a stop that parts pieces."""
    kinds = np.full(256, WORD, np.uint8)
    kinds[list(blanks)] = BLANK
    kinds[list(stops)] = STOP
    return kinds


def lower_bytes() -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A"):ord("Z") + 1] += 32
    return table


def list_of_bytes(array: pa.LargeBinaryArray) -> list[bytes]:
    """The values of an array without gaps; much faster than ``to_pylist``."""
    if not len(array):
        return []
    ends = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1].tolist()
    data = array.buffers()[2].to_pybytes()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


class WordBatch:
    """The words of some texts in turn: number in ``words``, text and piece of each.

    ``lower`` maps bytes to those that words are known by.
    """

    def __init__(self, texts: list[bytes], kinds: np.ndarray, lower: np.ndarray | None = None):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        #: Where each text begins; line feeds, which no word holds, part them.
        self.firsts = 1 + np.cumsum(self.sizes + 1) - (self.sizes + 1)
        self.data = np.frombuffer(b"".join([b"\n", b"\n".join(texts), b"\n"]), np.uint8)
        self.kind = kinds[self.data]
        inside = self.kind == WORD
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        #: Where words begin, and their bytes.
        self.at, self.lengths = edges[::2], edges[1::2] - edges[::2]
        places = np.concatenate([[0], np.cumsum(self.lengths)])
        held = self.data[inside]
        flat = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(self.at),
            [None, pa.py_buffer(places), pa.py_buffer(held if lower is None else lower[held])])
        found = flat.dictionary_encode()
        #: Distinct words, as bytes.
        self.words = list_of_bytes(found.dictionary)
        self.code = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.text = np.searchsorted(self.firsts, self.at, side="right") - 1

    @property
    def piece(self) -> np.ndarray:
        """A number that two words share if they are of one text with no stop between them."""
        return np.cumsum(self.kind == STOP)[self.at] + self.text

    def count(self, bytes_hit: np.ndarray) -> np.ndarray:
        """How many of some bytes, few as a rule, each text has."""
        of = np.searchsorted(self.firsts, np.flatnonzero(bytes_hit), side="right") - 1
        return np.bincount(of, minlength=len(self.sizes))

    def word_bytes(self) -> np.ndarray:
        """Bytes of each text that belong to words."""
        return np.bincount(self.text, self.lengths, len(self.sizes)).astype(np.int64)


def spans(texts: list[bytes], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` bytes together; at least one text each."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)
