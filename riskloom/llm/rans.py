"""A static range asymmetric numeral system (rANS) over interleaved lanes, in numpy.

The state of a lane is an unsigned 64-bit number in [2^31, 2^63) and gives or takes 32-bit
words. Token i of a block belongs to lane i mod lanes; all lanes step together. Every block is
independent: it has its own states, words and checksum and shares the frequency table only.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE_BITS = 20
LANES = 1024
BLOCK = 1 << 18
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_SCALE = np.uint64(SCALE_BITS)
_HEAD = struct.Struct("<IIII")  # tokens, lanes, words, crc32 of states and words


class Table:
    """Frequencies scaled to 2^SCALE_BITS, at least 1 for every symbol that occurs."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint32)
        self.cum = np.concatenate(([0], np.cumsum(self.freq, dtype=np.uint64)[:-1])).astype(np.uint32)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), self.freq)

    @staticmethod
    def of_counts(counts: np.ndarray) -> Table:
        total, size = int(counts.sum()), 1 << SCALE_BITS
        if not total:
            return Table(np.append(np.uint32(size), np.zeros(max(0, len(counts) - 1), np.uint32)))
        present = counts > 0
        if present.sum() > size:
            raise ValueError("more symbols than slots")
        freq = np.where(present, np.maximum(1, np.floor(counts * (size / total))), 0).astype(np.int64)
        order = np.argsort(-counts, kind="stable")
        over = int(freq.sum()) - size
        if over < 0:
            freq[order[0]] -= over
        for i in order:  # the most frequent symbols pay for those that were raised to 1
            if over <= 0:
                break
            take = min(over, int(freq[i]) // 2)
            freq[i] -= take
            over -= take
        return Table(freq)

    def to_bytes(self) -> bytes:
        raw = self.freq.astype("<u4").tobytes()
        return struct.pack("<4sBII", b"RTB1", SCALE_BITS, len(self.freq), zlib.crc32(raw)) + raw

    @staticmethod
    def from_bytes(data: bytes) -> Table:
        magic, bits, n, crc = struct.unpack_from("<4sBII", data)
        raw = data[13 : 13 + 4 * n]
        if magic != b"RTB1" or bits != SCALE_BITS or zlib.crc32(raw) != crc:
            raise ValueError("damaged frequency table")
        return Table(np.frombuffer(raw, "<u4"))


def encode_block(tokens: np.ndarray, table: Table, lanes: int = LANES) -> bytes:
    n = len(tokens)
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    x = np.full(lanes, _LOW, np.uint64)
    freq, start = table.freq[tokens].astype(np.uint64), table.cum[tokens].astype(np.uint64)
    most = freq << np.uint64(63 - SCALE_BITS)
    words: list[np.ndarray] = []
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        f, y = freq[a:b], x[: b - a]
        full = y >= most[a:b]
        if full.any():
            words.append((y[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            y = np.where(full, y >> _WORD, y)
        q = y // f
        x[: b - a] = (q << _SCALE) + (y - q * f) + start[a:b]
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    body = x.astype("<u8").tobytes() + stream.tobytes()
    return _HEAD.pack(n, lanes, len(stream), zlib.crc32(body)) + body


def block_size(data: bytes, at: int = 0) -> int:
    _, lanes, words, _ = _HEAD.unpack_from(data, at)
    return _HEAD.size + 8 * lanes + 4 * words


def decode_block(data: bytes, table: Table, at: int = 0) -> np.ndarray:
    n, lanes, count, crc = _HEAD.unpack_from(data, at)
    body = memoryview(data)[at + _HEAD.size : at + block_size(data, at)]
    if zlib.crc32(body) != crc:
        raise ValueError("damaged block")
    x = np.frombuffer(body[: 8 * lanes], "<u8").astype(np.uint64)
    stream = np.frombuffer(body[8 * lanes :], "<u4").astype(np.uint64)
    freq, cum = table.freq.astype(np.uint64), table.cum.astype(np.uint64)
    mask, out, used = np.uint64((1 << SCALE_BITS) - 1), np.empty(n, np.uint32), 0
    for a in range(0, n, lanes):
        b = min(n, a + lanes)
        y = x[: b - a]
        slot = y & mask
        s = table.symbol[slot]
        out[a:b] = s
        y = freq[s] * (y >> _SCALE) + slot - cum[s]
        low = y < _LOW
        k = int(np.count_nonzero(low))
        if k:
            y[low] = (y[low] << _WORD) | stream[used : used + k]
            used += k
        x[: b - a] = y
    return out
