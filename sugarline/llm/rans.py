"""Range asymmetric numeral systems with one fixed table, in numpy.

A block of symbols is dealt out to lanes: symbol i belongs to lane i mod ``lanes``. Every lane is a
coder of its own with a 63-bit state, and all lanes share one stream of 32-bit words, so a step
works on as many symbols at once as there are lanes. Encoding runs from the last step to the first,
decoding from the first to the last. Every ``every`` steps the states and the place in the stream
are kept as a checkpoint, from where decoding can start as well.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

#: A state lies in [LOW, LOW << 32).
LOW = 1 << 31
_WORD = np.uint64(32)


class Table:
    """Frequencies of the symbols that occur, scaled to a sum of 2^bits."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray, bits: int = 20):
        order = np.argsort(symbols)
        self.symbols, counts = symbols[order].astype(np.int64), counts[order].astype(np.float64)
        self.bits, n = bits, len(symbols)
        if n > 1 << bits:
            raise ValueError(f"{n} symbols need more than {bits} bits")
        scaled = np.zeros(n, np.int64)
        if n:
            # Every symbol has one place for certain; the others are shared out by count
            free = (1 << bits) - n
            until = np.floor(np.cumsum(counts) / counts.sum() * free).astype(np.int64)
            until[-1] = free
            scaled = 1 + np.diff(until, prepend=0)
        self.frequency = scaled.astype(np.uint64)
        self.start = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.frequency)[:-1]]) if n else self.frequency
        #: The index of the symbol that owns each slot.
        self.owner = np.repeat(np.arange(n, dtype=np.int32), scaled)

        #: Symbol to its index, -1 for those without a frequency.
        self.places = np.full(int(self.symbols[-1]) + 1 if n else 0, -1, np.int32)
        self.places[self.symbols] = np.arange(n)

    def index(self, values: np.ndarray) -> np.ndarray:
        at = self.places[values] if len(values) and values.max() < len(self.places) else np.full(len(values), -1)
        if len(at) and at.min() < 0:
            raise ValueError("a symbol has no frequency")
        return at


@dataclass
class Block:
    """``n`` encoded symbols. ``states`` holds the lanes' states at every checkpoint, the start
    first; ``places`` the words of the stream that are used up there."""

    n: int
    lanes: int
    every: int
    states: bytes
    places: bytes
    words: bytes
    crc: int

    def checksum(self) -> int:
        return zlib.crc32(self.words, zlib.crc32(self.places, zlib.crc32(self.states)))


def lanes_for(n: int, most: int = 1024) -> int:
    """A lane for every 128 symbols, so that states stay a small part of a block."""
    return max(1, min(most, n // 128))


def encode(values: np.ndarray, table: Table, every: int = 128) -> Block:
    n = len(values)
    lanes = lanes_for(n)
    at = table.index(values)
    frequency, start = table.frequency[at], table.start[at]
    scale = np.uint64(table.bits)
    limit = frequency << np.uint64(63 - table.bits)
    state = np.full(lanes, LOW, np.uint64)
    chunks: list[np.ndarray] = []
    marks: list[tuple[np.ndarray, int]] = []
    written = 0
    for step in reversed(range(-(-n // lanes))):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x, f = state[: b - a], frequency[a:b]
        full = x >= limit[a:b]
        if full.any():
            chunks.append(x[full].astype("<u4"))  # the low 32 bits
            written += len(chunks[-1])
            x = np.where(full, x >> _WORD, x)
        whole = x // f
        state[: b - a] = (whole << scale) + (x - whole * f) + start[a:b]
        if step % every == 0:
            marks.append((state.copy(), written))
    if not marks:
        marks.append((state, 0))
    marks.reverse()
    block = Block(
        n, lanes, every,
        np.concatenate([m[0] for m in marks]).astype("<u8").tobytes(),
        np.array([written - m[1] for m in marks], "<i8").tobytes(),
        np.concatenate(chunks[::-1]).tobytes() if chunks else b"",
        0,
    )
    block.crc = block.checksum()
    return block


def decode(block: Block, table: Table, first: int = 0, past: int | None = None) -> np.ndarray:
    """Symbols ``first`` to ``past`` (exclusive) of a block, from the checkpoint before them."""
    if block.crc != block.checksum():
        raise ValueError("the checksum of a block does not fit its bytes")
    past = block.n if past is None else min(past, block.n)
    if first >= past:
        return np.zeros(0, np.int64)
    lanes = block.lanes
    mark = first // lanes // block.every
    state = np.frombuffer(block.states, "<u8").reshape(-1, lanes)[mark].copy()
    at = int(np.frombuffer(block.places, "<i8")[mark])
    words = np.frombuffer(block.words, "<u4")
    scale, mask, low = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), np.uint64(LOW)
    begin = mark * block.every
    end = -(-past // lanes)
    out = np.empty((end - begin) * lanes, np.int32)
    for step in range(begin, end):
        k = min(block.n - step * lanes, lanes)
        x = state[:k]
        slot = x & mask
        owner = table.owner[slot.astype(np.int64)]
        out[(step - begin) * lanes : (step - begin) * lanes + k] = owner
        x = table.frequency[owner] * (x >> scale) + slot - table.start[owner]
        short = np.flatnonzero(x < low)
        if len(short):
            x[short] = (x[short] << _WORD) | words[at : at + len(short)]
            at += len(short)
        state[:k] = x
    skip = begin * lanes
    return table.symbols[out[first - skip : past - skip]]
