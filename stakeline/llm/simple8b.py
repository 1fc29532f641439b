"""Simple-8b coding of token ids in blocks, and files of such blocks.

A word of 64 bits holds a selector in its top four bits and a number of equal-width values below.
Selectors 0 and 1 hold runs of zeros, 2 to 15 hold values of the widths in ``WIDTHS``. A value that
60 bits can't hold is an escape: the marker word (selector 15, payload ``ESCAPE``), and then the
value as a plain word.

A block holds ``BLOCK`` values (the last one of a document run may hold fewer). A file is

    magic, 8 bytes | blocks, end to end | footer | length of the footer, 8 bytes | magic

with little-endian words throughout. The footer is four arrays after their lengths: per block the
place of its first byte and the number of values before it, per document its id and the number of
values before it. So any block is found and decoded without the others.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

MAGIC = b"S8BTOK01"
BLOCK = 4096
# Values and bits of each selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = (1 << 60) - 1
POWERS = np.array([1 << i for i in range(64)], dtype=np.uint64)
# How a maximum over so many neighbours comes from two over fewer.
SUMS = [(2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 4, 1), (6, 4, 2), (7, 4, 3), (8, 4, 4), (10, 8, 2), (12, 8, 4), (15, 8, 7)]
SUMS += [(20, 10, 10), (30, 15, 15), (60, 30, 30), (120, 60, 60), (240, 120, 120)]
LOW60 = np.uint64(ESCAPE)


def pack(values: np.ndarray) -> np.ndarray:
    """Words for ``values``; each word takes as many of the next values as any selector allows."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    big = values >= LOW60
    if big.any():
        return _pack_with_escapes(values, big)
    if not len(values):
        return np.zeros(0, dtype="<u8")
    return pack_blocks(values, len(values))[0]


def pack_blocks(values: np.ndarray, size: int) -> list[np.ndarray]:
    """Words of each ``size`` values (the last block may hold fewer), all blocks side by side.

    No value may need an escape.
    """
    n = len(values)
    bits = np.full((-(-n // size), size), 255, dtype=np.uint8)
    bits.ravel()[:n] = _bits(values)
    # For each place the first selector whose count of values from there on fits its width.
    widest = _widest(bits)
    choice = np.full(bits.shape, 15, dtype=np.uint8)
    for selector in range(14, -1, -1):
        if COUNTS[selector] <= size:
            choice[widest[int(COUNTS[selector])][:, :size] <= WIDTHS[selector]] = selector
    # Follow the words of each block from its first value on.
    heads, ends = [], []
    for start, jump in zip(range(0, n, size), COUNTS[choice].tolist()):
        at, stop = 0, min(size, n - start)
        while at < stop:
            heads.append(start + at)
            at += jump[at]
        ends.append(len(heads))
    heads = np.array(heads)
    selector = choice.ravel()[heads]
    words = selector.astype(np.uint64) << np.uint64(60)
    for kind in np.unique(selector):
        count, width = int(COUNTS[kind]), int(WIDTHS[kind])
        if width:
            mine = np.flatnonzero(selector == kind)
            first, total = heads[mine], np.zeros(len(mine), dtype=np.uint64)
            for k in range(count):
                total |= values[first + k] << np.uint64(k * width)
            words[mine] |= total
    return np.split(words.astype("<u8"), ends[:-1])


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value takes; 0 for zero."""
    if len(values) and values.max() >> np.uint64(53):
        return np.searchsorted(POWERS, values, "right").astype(np.uint8)
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _widest(bits: np.ndarray) -> dict[int, np.ndarray]:
    """For each count of a selector, the most bits among so many values from each place of a block; 255 past its end."""
    end = np.full((len(bits), 1 + COUNTS[0]), 255, dtype=np.uint8)
    found = {1: np.concatenate([bits, end], axis=1)}
    for size, left, right in SUMS:
        one, two = found[left], found[right][:, left:]
        width = min(one.shape[1], two.shape[1])
        found[size] = np.maximum(one[:, :width], two[:, :width])
    return found


def _pack_with_escapes(values: np.ndarray, big: np.ndarray) -> np.ndarray:
    parts, at = [], 0
    marker = np.array([(15 << 60) | ESCAPE], dtype=np.uint64)
    for place in np.flatnonzero(big):
        parts += [pack(values[at:place]), marker, values[place : place + 1]]
        at = place + 1
    return np.concatenate([*parts, pack(values[at:])]).astype("<u8")


def unpack(words: np.ndarray) -> np.ndarray:
    """Values of the words that ``pack`` made, all words of a selector at once."""
    words = np.ascontiguousarray(words, dtype=np.uint64)
    marker = np.uint64((15 << 60) | ESCAPE)
    plain = np.zeros(len(words), dtype=bool)
    at = 0
    for place in np.flatnonzero(words == marker).tolist():
        if place >= at:  # the word after a marker is a value, even if it looks like a marker
            plain[place + 1] = True
            at = place + 2
    marked = np.append(plain[1:], False) if len(words) else plain
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.where(marked, 0, np.where(plain, 1, COUNTS[selector]))
    start = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    out[start[plain]] = words[plain]
    for kind in np.unique(selector):
        width = int(WIDTHS[kind])
        mine = np.flatnonzero((selector == kind) & ~plain & ~marked)
        if width:
            each, mask = np.arange(int(COUNTS[kind])), np.uint64((1 << width) - 1)
            out[start[mine][:, None] + each] = words[mine][:, None] >> (each * width).astype(np.uint64) & mask
    return out


class Writer:
    """Writes documents' ids to a binary stream, block by block."""

    def __init__(self, stream):
        self.stream, self.place, self.total = stream, len(MAGIC), 0
        self.places, self.firsts, self.docs, self.starts = [], [], [], []
        self.open: list[np.ndarray] = []
        self.size = 0
        stream.write(MAGIC)

    def add(self, doc: int, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.starts.append(self.total + self.size)
        self.open.append(ids)
        self.size += len(ids)
        if self.size >= 16 * BLOCK:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([np.zeros(0, dtype=np.uint32), *self.open])
        done = len(ids) if last else len(ids) // BLOCK * BLOCK
        ids, rest = ids[:done].astype(np.uint64), ids[done:]
        plain = done and ids.max() < LOW60
        blocks = pack_blocks(ids, BLOCK) if plain else [pack(ids[k : k + BLOCK]) for k in range(0, done, BLOCK)]
        for k, words in enumerate(blocks):
            self.places.append(self.place)
            self.firsts.append(self.total)
            self.stream.write(words.tobytes())
            self.place += words.nbytes
            self.total += min(BLOCK, done - k * BLOCK)
        self.open, self.size = [rest] if len(rest) else [], len(rest)

    def close(self) -> int:
        """Writes the rest and the footer; gives the number of values."""
        self._flush(last=True)
        places = [*self.places, self.place]
        firsts = [*self.firsts, self.total]
        arrays = [np.array(x, dtype="<i8") for x in (places, firsts, self.docs, self.starts)]
        footer = struct.pack("<4q", *map(len, arrays)) + b"".join(x.tobytes() for x in arrays)
        self.stream.write(footer + struct.pack("<q", len(footer)) + MAGIC)
        return self.total


class Reader:
    """Reads a file through a seekable stream of which ``size`` bytes are known."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - 16)
        (length,) = struct.unpack("<q", stream.read(8))
        if stream.read(8) != MAGIC:
            raise ValueError("not a file of token ids, or cut short")
        stream.seek(size - 16 - length)
        footer = stream.read(length)
        counts, at, arrays = struct.unpack("<4q", footer[:32]), 32, []
        for count in counts:
            arrays.append(np.frombuffer(footer, dtype="<i8", count=count, offset=at))
            at += 8 * count
        self.places, self.firsts, self.docs, self.starts = arrays

    @property
    def total(self) -> int:
        return int(self.firsts[-1])

    def block(self, k: int) -> np.ndarray:
        self.stream.seek(int(self.places[k]))
        return unpack(np.frombuffer(self.stream.read(int(self.places[k + 1] - self.places[k])), dtype="<u8"))

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """``(document, values before it in the file, its values)`` in order; holds a document and a block."""
        ends = [*self.starts[1:].tolist(), self.total]
        held, first, k = np.zeros(0, dtype=np.uint64), 0, 0
        for doc, start, end in zip(self.docs.tolist(), self.starts.tolist(), ends):
            parts = [held[start - first :]]
            have = first + len(held)
            while have < end:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            held, first = np.concatenate(parts), start
            yield doc, start, held[: end - start]

    def slice(self, start: int, end: int) -> np.ndarray:
        """Values ``start`` to ``end`` of the file, from the blocks that hold them."""
        low = int(np.searchsorted(self.firsts, start, "right")) - 1
        high = int(np.searchsorted(self.firsts, end, "left"))
        parts = [self.block(k) for k in range(max(low, 0), min(high, len(self.places) - 1))]
        values = np.concatenate([np.zeros(0, dtype=np.uint64), *parts])
        return values[start - int(self.firsts[max(low, 0)]) :][: max(end - start, 0)]
