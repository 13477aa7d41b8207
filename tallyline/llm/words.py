"""Words of whole Arrow text columns as numpy arrays: byte spans, 64-bit hashes, gram hashes.

The per-byte work runs in blocks, so that memory follows the text by a small factor even for one very long text.
Hash arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
BLOCK_BYTES = 1 << 16
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
POWER = np.uint64(0x9E3779B97F4A7C15)
GRAM_POWER = np.uint64(0xD6E8FEB86659FD93)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def not_spaces() -> np.ndarray:
    """Bytes of words between white space: ``[^\\x20\\x09-\\x0D]``."""
    table = np.ones(256, dtype=bool)
    table[list(SPACES)] = False
    return table


def letters_and_digits() -> np.ndarray:
    """Bytes of words of ASCII letters, digits and whatever is beyond ASCII."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


NOT_SPACES = not_spaces()
LETTERS_AND_DIGITS = letters_and_digits()


@dataclass(frozen=True)
class Words:
    """The words of some texts. Text ``t`` has words ``first[t]:first[t + 1]``; word ``w`` is ``data[begin[w]:end[w]]``."""

    data: np.ndarray
    inside: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def word(self, index: int) -> bytes:
        return self.data[self.begin[index] : self.end[index]].tobytes()

    def words(self, start: int, stop: int) -> list[bytes]:
        return [self.word(index) for index in range(start, stop)]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, dtype=np.int64, count=column.offset + len(column) + 1)[column.offset :]
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    whole = np.frombuffer(data, dtype=np.uint8)[places[0] : places[-1]]
    return whole, places - places[0]


def split(column: pa.Array, word_bytes: np.ndarray, lower: bool) -> Words:
    data, places = text_bytes(column)
    if lower:
        data = LOWER[data]
    inside = word_bytes[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    starts = places[:-1]
    starts = starts[starts < len(data)]
    opens[starts] = inside[starts]
    before = starts[starts > 0] - 1
    closes[before] = inside[before]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, inside, begin, end, np.searchsorted(begin, places))


def mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0xA0761D6478BD642F)
    return values ^ (values >> np.uint64(32))


def hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word."""
    lengths = words.end - words.begin
    powers = np.ones(int(lengths.max(initial=0)) + 1, dtype=np.uint64)
    powers[1:] = POWER
    powers = np.cumprod(powers, dtype=np.uint64)
    total = np.concatenate([[0], np.cumsum(lengths)])
    found = np.empty(len(lengths), dtype=np.uint64)
    stop = 0
    while stop < len(found):
        start = stop
        stop = max(start + 1, int(np.searchsorted(total, total[start] + BLOCK_BYTES, side="right")) - 1)
        heads = total[start:stop] - total[start]
        part = slice(words.begin[start], words.end[stop - 1])
        values = words.data[part][words.inside[part]].astype(np.uint64) + np.uint64(1)
        places = np.arange(len(values)) - np.repeat(heads, lengths[start:stop])
        found[start:stop] = np.add.reduceat(values * powers[places], heads)
    return mix(found)


def grams(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` values; runs across texts are included and for the caller to leave out."""
    runs = max(0, len(values) - size + 1)
    total = np.zeros(runs, dtype=np.uint64)
    for place in range(size):
        total = total * GRAM_POWER + values[place : place + runs]
    return mix(total)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts with at most so many bytes of text, or a single row."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def add_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with further columns at its end."""
    names = [*batch.schema.names, *columns]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=names)
