"""Token files in patched frame of reference blocks.

Values are cut into blocks of ``BLOCK``.  A block stores its minimum, the differences packed at a
width that covers ``percentile`` of them, and the rest as exceptions: place and high bits.  The
index holds the byte where each block starts, so any range of values can be read alone; the
document table holds the ids and lengths of the documents in the file's order.

Layout, little-endian::

    magic "PFR1" | u32 block size | u64 values | u64 documents | u64 blocks | u64 bytes of blocks
    i64 id of each document, u8 whether it is null, u64 length of each document
    u64 start of each block, then an end
    blocks: u32 minimum, u8 width, u8 exceptions, packed differences,
            u8 place and u32 high bits of each exception
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, BLOCK = b"PFR1", 128
_HEAD = struct.Struct("<4sIQQQQ")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as rows of BLOCK * width / 8 bytes."""
    out = np.zeros((BLOCK * width // 8 + 4, len(values)), np.uint8)
    columns = np.ascontiguousarray(values.T).astype(np.uint64)
    for j in range(BLOCK):
        at, shift = divmod(j * width, 8)
        x = columns[j] << np.uint64(shift)
        for k in range((shift + width + 7) // 8):
            out[at + k] |= (x >> np.uint64(8 * k)).astype(np.uint8)
    return np.ascontiguousarray(out[: BLOCK * width // 8].T)


def _unpack(rows: np.ndarray, width: int) -> np.ndarray:
    if width > 25:  # a value may lie in five bytes
        bits = np.unpackbits(rows, axis=1, bitorder="little").reshape(len(rows), BLOCK, width)
        return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(2, dtype=np.uint32)
    at = np.arange(BLOCK) * width
    wide = np.zeros((len(rows), rows.shape[1] + 3), np.uint32)
    wide[:, : rows.shape[1]] = rows
    # the 32 bits that start at each byte, then those of each value
    word = wide[:, :-3] | wide[:, 1:-2] << np.uint32(8) | wide[:, 2:-1] << np.uint32(16) | wide[:, 3:] << np.uint32(24)
    return (word[:, at >> 3] >> (at & 7).astype(np.uint32)) & np.uint32((1 << width) - 1)


def write(values: np.ndarray, ids: np.ndarray, is_null: np.ndarray, lengths: np.ndarray, percentile: float = 90.0) -> bytes:
    """The bytes of a file of these documents; ``values`` are all their tokens in order."""
    n = -(-len(values) // BLOCK)
    body: list[bytes] = [b""] * n
    if n:
        full = np.empty(n * BLOCK, np.uint32)
        full[: len(values)] = values
        full[len(values) :] = values[-1]
        full = full.reshape(n, BLOCK)
        low = full.min(1)
        diff = full - low[:, None]
        at = min(BLOCK - 1, int(np.ceil(percentile / 100 * BLOCK)) - 1)
        cover = np.partition(diff, at, axis=1)[:, at]
        width = np.ceil(np.log2(cover.astype(np.float64) + 1)).astype(np.int64)
        for w in np.unique(width):
            w = int(w)
            mine = np.flatnonzero(width == w)
            for part in np.array_split(mine, max(1, len(mine) // 4096)):
                d = diff[part]
                packed = _pack(d & np.uint32((1 << w) - 1), w) if w else np.zeros((len(part), 0), np.uint8)
                high = d >> np.uint32(w) if w < 32 else np.zeros_like(d)
                for k, i in enumerate(part):
                    odd = np.flatnonzero(high[k])
                    body[i] = struct.pack("<IBB", low[i], w, len(odd)) + packed[k].tobytes() + odd.astype(np.uint8).tobytes() + high[k, odd].astype("<u4").tobytes()
    starts = np.cumsum([0, *map(len, body)]).astype("<u8")
    head = _HEAD.pack(MAGIC, BLOCK, len(values), len(ids), n, int(starts[-1]))
    return b"".join([head, ids.astype("<i8").tobytes(), is_null.astype(np.uint8).tobytes(), lengths.astype("<u8").tobytes(), starts.tobytes(), *body])


class Reader:
    """Random access to the bytes of one file."""

    def __init__(self, data: bytes):
        magic, block, self.n_values, self.n_docs, self.n_blocks, size = _HEAD.unpack_from(data)
        if magic != MAGIC or block != BLOCK:
            raise ValueError("not a token file of this format")
        at = _HEAD.size
        self.ids = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.is_null = np.frombuffer(data, np.uint8, self.n_docs, at).astype(bool)
        at += self.n_docs
        self.lengths = np.frombuffer(data, "<u8", self.n_docs, at).astype(np.int64)
        at += 8 * self.n_docs
        self.starts = np.frombuffer(data, "<u8", self.n_blocks + 1, at).astype(np.int64)
        at += 8 * (self.n_blocks + 1)
        self.body = np.frombuffer(data, np.uint8, size, at)
        if len(self.body) != size or at + size != len(data):
            raise ValueError("the token file is cut short")

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Values of blocks first..last-1."""
        at, body = self.starts[first:last], self.body
        low = (body[at[:, None] + np.arange(4)].astype(np.uint32) << np.array([0, 8, 16, 24], np.uint32)).sum(1, dtype=np.uint32) if len(at) else np.zeros(0, np.uint32)
        width, odd = body[at + 4], body[at + 5]
        out = np.zeros((len(at), BLOCK), np.uint32)
        for w in np.unique(width):
            w = int(w)
            mine = np.flatnonzero(width == w)
            if w:
                for part in np.array_split(mine, max(1, len(mine) // 4096)):
                    out[part] = _unpack(body[at[part][:, None] + 6 + np.arange(BLOCK * w // 8)], w)
        for i in np.flatnonzero(odd):
            w, k = int(width[i]), int(odd[i])
            p = int(at[i]) + 6 + BLOCK * w // 8
            high = np.frombuffer(body[p + k : p + 5 * k].tobytes(), "<u4").astype(np.uint32)
            out[i, body[p : p + k]] |= high << np.uint32(w)
        return out + low[:, None]

    def values(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Tokens start..end-1; reads only the blocks that hold them."""
        end = self.n_values if end is None else min(end, self.n_values)
        if end <= start:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, -(-end // BLOCK)
        return self.blocks(a, b).ravel()[start - a * BLOCK : end - a * BLOCK]

    def document(self, i: int) -> np.ndarray:
        start = int(self.lengths[:i].sum())
        return self.values(start, start + int(self.lengths[i]))
