"""Elias-Fano coding of a non-decreasing sequence, with select.

n values below u take about n (2 + log2(u / n)) bits: the low bits of each value in a packed
array, the high bits in unary. ``select`` and ``select_range`` find any values from 32-bit samples
of the unary part (one in every 256 values), so no table of 64-bit offsets is kept.

Layout, little-endian: magic ``EF01``, low-bit width (uint8), 3 zero bytes, n (uint64), first
value (int64), bytes of the low, high and sample parts (3 uint64), then the parts.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<4sB3xQqQQQ")
SAMPLE = 256
#: Values whose low bits are spread out at a time.
_BLOCK = 1 << 16


def encode(values: np.ndarray) -> bytes:
    """values: non-decreasing int64."""
    v = np.asarray(values, dtype=np.int64)
    n = len(v)
    if n and (np.diff(v) < 0).any():
        raise ValueError("values must not decrease")
    first = int(v[0]) if n else 0
    rest = (v - first).astype(np.uint64) if n else np.zeros(0, dtype=np.uint64)
    span = int(rest[-1]) + 1 if n else 0
    width = max(0, (span // n).bit_length() - 1) if n else 0
    shifts = np.arange(width, dtype=np.uint64)
    bits = [((rest[i : i + _BLOCK, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel() for i in range(0, n, _BLOCK)]
    low = np.packbits(np.concatenate(bits) if bits else np.zeros(0, np.uint8), bitorder="little")
    places = (rest >> np.uint64(width)).astype(np.int64) + np.arange(n)
    if n and places[-1] >= 1 << 32:
        raise ValueError("too many values for 32-bit samples; write more shards")
    unary = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
    unary[places] = 1
    high = np.packbits(unary, bitorder="little")
    samples = places[::SAMPLE].astype("<u4")
    return _HEAD.pack(b"EF01", width, n, first, len(low), len(high), samples.nbytes) + low.tobytes() + high.tobytes() + samples.tobytes()


class EliasFano:
    """Reads what encode() wrote."""

    def __init__(self, data: bytes):
        magic, self.width, self.n, self.first, n_low, n_high, n_samples = _HEAD.unpack_from(data)
        if magic != b"EF01":
            raise ValueError("not an Elias-Fano part")
        at = _HEAD.size
        self.low = np.frombuffer(data, np.uint8, n_low, at)
        self.high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        self.samples = np.frombuffer(data, "<u4", n_samples // 4, at + n_low + n_high)
        self.nbytes = at + n_low + n_high + n_samples

    def __len__(self) -> int:
        return self.n

    def _low(self, i: int) -> int:
        begin, end = i * self.width, (i + 1) * self.width
        window = int.from_bytes(self.low[begin >> 3 : (end + 7) >> 3].tobytes(), "little")
        return window >> (begin & 7) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        """Value i, from its sample and a scan of the unary part that follows it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, need = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place >> 3
        word = int(self.high[byte]) >> (place & 7) << (place & 7)
        while need >= (ones := word.bit_count()):
            need -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(need):
            word &= word - 1
        place = (byte << 3) + (word & -word).bit_length() - 1
        return self.first + ((place - i) << self.width | self._low(i))

    def select_range(self, begin: int, end: int) -> np.ndarray:
        """Values begin .. end - 1, from the sample before them and the parts that hold them; nothing else is decoded."""
        if not 0 <= begin <= end <= self.n:
            raise IndexError((begin, end))
        if begin == end:
            return np.zeros(0, dtype=np.int64)
        place, after = int(self.samples[begin // SAMPLE]), -(-end // SAMPLE)
        stop = (int(self.samples[after]) >> 3) + 1 if after < len(self.samples) else len(self.high)
        places = np.flatnonzero(np.unpackbits(self.high[place >> 3 : stop], bitorder="little")) + (place >> 3 << 3)
        skipped = int(np.searchsorted(places, place)) + begin % SAMPLE
        places = places[skipped : skipped + end - begin]
        low = 0
        if self.width:
            first = begin * self.width
            bits = np.unpackbits(self.low[first >> 3 : (end * self.width + 7) >> 3], bitorder="little")[first & 7 :][: (end - begin) * self.width]
            low = (bits.reshape(-1, self.width).astype(np.int64) << np.arange(self.width, dtype=np.int64)).sum(axis=1)
        return self.first + ((places - np.arange(begin, end)) << self.width | low)

    def values(self) -> np.ndarray:
        """All values at once."""
        return self.select_range(0, self.n)
