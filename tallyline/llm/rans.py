"""A range variant of asymmetric numeral systems with static frequencies, in numpy, over many interleaved states at once.

The tokens of a block lie in rows of ``LANES``; each lane has a 64-bit state and gives off 32-bit words. All blocks of the
same height are coded in one go. A block's bytes are its lanes' final states and then its words in decoding order, so a
block is decoded without any other.
"""

from __future__ import annotations

import numpy as np

SCALE = 20
LANES = 256
HEIGHT = 256
BLOCK = LANES * HEIGHT
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
MASK = np.uint64(0xFFFFFFFF)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that sum up to ``2**SCALE``, in proportion to the counts."""
    whole = 1 << SCALE
    if len(counts) > whole // 2:
        raise ValueError("too many different tokens for the table")
    if not len(counts):
        return counts.astype(np.uint64)
    exact = counts / counts.sum() * whole
    found = np.maximum(np.floor(exact), 1).astype(np.int64)
    over = int(found.sum()) - whole
    if over < 0:
        found[np.argmax(counts)] -= over
    while over > 0:
        order = np.argsort(-found, kind="stable")
        spare = np.minimum(found[order] - 1, np.maximum(found[order] // 8, 1))
        taken = np.minimum(spare, np.maximum(over - (np.cumsum(spare) - spare), 0))
        found[order] -= taken
        over -= int(taken.sum())
    return found.astype(np.uint64)


def starts(frequencies: np.ndarray) -> np.ndarray:
    return np.cumsum(frequencies) - frequencies


def encode(symbols: np.ndarray, frequencies: np.ndarray) -> list[bytes]:
    """Blocks of ``BLOCK`` symbols, the last one shorter."""
    full = len(symbols) // BLOCK
    out = encode_rows(symbols[: full * BLOCK].reshape(full, HEIGHT, LANES), frequencies) if full else []
    rest = symbols[full * BLOCK :]
    if len(rest):
        padded = np.full(-(-len(rest) // LANES) * LANES, rest[0], dtype=symbols.dtype)
        padded[: len(rest)] = rest
        out += encode_rows(padded.reshape(1, -1, LANES), frequencies)
    return out


def encode_rows(blocks: np.ndarray, frequencies: np.ndarray) -> list[bytes]:
    count, height, lanes = blocks.shape
    first = starts(frequencies)
    most = (LOW >> np.uint64(SCALE) << WORD) * frequencies
    state = np.full(count * lanes, LOW)
    words, owners = [], []
    for row in range(height - 1, -1, -1):
        symbol = blocks[:, row, :].reshape(-1)
        frequency = frequencies[symbol]
        full = np.flatnonzero(state >= most[symbol])
        words.append((state[full] & MASK).astype(np.uint32))
        owners.append(full // lanes)
        state[full] >>= WORD
        quotient = state // frequency
        state = (quotient << np.uint64(SCALE)) + (state - quotient * frequency) + first[symbol]
    words, owners = np.concatenate(words[::-1]), np.concatenate(owners[::-1])
    order = np.argsort(owners, kind="stable")
    ends = np.cumsum(np.bincount(owners, minlength=count))
    parts = np.split(words[order], ends[:-1])
    return [own.astype("<u8").tobytes() + part.astype("<u4").tobytes() for own, part in zip(state.reshape(count, lanes), parts, strict=True)]


def decode(blocks: list[bytes], sizes: list[int], frequencies: np.ndarray) -> np.ndarray:
    """The symbols of blocks with these numbers of symbols."""
    if not blocks:
        return np.zeros(0, dtype=np.int64)
    table = np.repeat(np.arange(len(frequencies), dtype=np.int32), frequencies.astype(np.int64))
    heights = [-(-size // LANES) for size in sizes]
    out: list[np.ndarray | None] = [None] * len(blocks)
    for height in sorted(set(heights)):
        same = [number for number, own in enumerate(heights) if own == height]
        found = decode_rows([blocks[number] for number in same], height, frequencies, table)
        for number, symbols in zip(same, found, strict=True):
            out[number] = symbols[: sizes[number]]
    return np.concatenate(out)


def decode_rows(blocks: list[bytes], height: int, frequencies: np.ndarray, table: np.ndarray) -> np.ndarray:
    head = 8 * LANES
    state = np.concatenate([np.frombuffer(block, "<u8", LANES) for block in blocks]).astype(np.uint64)
    words = np.concatenate([np.frombuffer(block, "<u4", offset=head) for block in blocks] + [np.zeros(LANES, "<u4")]).astype(np.uint64)
    lengths = np.array([(len(block) - head) // 4 for block in blocks])
    at = np.cumsum(lengths) - lengths
    first = starts(frequencies)
    out = np.empty((len(blocks), height, LANES), dtype=np.int32)
    mask = np.uint64((1 << SCALE) - 1)
    for row in range(height):
        slot = state & mask
        symbol = table[slot.astype(np.int64)]
        out[:, row, :] = symbol.reshape(len(blocks), LANES)
        state = frequencies[symbol] * (state >> np.uint64(SCALE)) + slot - first[symbol]
        empty = (state < LOW).reshape(len(blocks), LANES)
        used = np.cumsum(empty, axis=1)
        place = (at[:, None] + used - 1)[empty]
        hungry = np.flatnonzero(empty.reshape(-1))
        state[hungry] = (state[hungry] << WORD) | words[place]
        at += used[:, -1]
    if (state != LOW).any() or (at != np.cumsum(lengths)).any():
        raise ValueError("a block doesn't decode to its start")
    return out.reshape(len(blocks), -1)
