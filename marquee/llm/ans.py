"""Static range asymmetric numeral system over token ids, in numpy.

One frequency table (scaled to ``1 << SCALE_BITS``) is shared by all blocks. A block interleaves
``LANES`` coder states: token i belongs to lane i % LANES, and each step codes one token per lane.
Words that a lane gives off at a step lie in lane order, so the decoder reads them with one slice.

A block's bytes (little-endian):
    magic "MQA1", crc32 of what follows, number of tokens, lanes, steps between checkpoints,
    number of 32-bit words, number of checkpoints,
    checkpoints: (step, word offset) and the lane states before that step; the first is at step 0,
    the words.
Decoding may start at any checkpoint.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE_BITS = 20
LANES = 2048
CHECKPOINT_STEPS = 64
_LOW = np.uint64(1 << 31)
_HEAD, _HEAD_BYTES = "<4sIIIIII", 28
_MAGIC = b"MQA1"


class Table:
    """Scaled frequencies of the symbols 0..n-1; a symbol with a count keeps at least one slot."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, dtype=np.int64)
        total, size = int(counts.sum()), 1 << SCALE_BITS
        used = np.flatnonzero(counts)
        if len(used) > size:
            raise ValueError("more symbols than slots")
        freq = np.zeros(len(counts), dtype=np.int64)
        if len(used):
            # one slot each, the rest in proportion, what rounding leaves to the most frequent
            spare = size - len(used)
            freq[used] = 1 + (counts[used].astype(np.float64) * (spare / total)).astype(np.int64)
            freq[used[np.argmax(counts[used])]] += size - int(freq.sum())
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self._symbol = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    bits, low32 = np.uint64(SCALE_BITS), np.uint64(32)
    state = np.full(lanes, _LOW, dtype=np.uint64)
    words, saved = [], []
    back = 0  # words given off so far, counted from the end of the block
    for s in range(steps - 1, -1, -1):
        sym = ids[s * lanes:(s + 1) * lanes].astype(np.int64)
        k = len(sym)
        f, x = table.freq.take(sym), state[:k]
        over = x >= (f << np.uint64(43))  # (2^31 / 2^20) * 2^32 * f
        if over.any():
            out = x[over].astype(np.uint32)
            words.append(out)
            back += len(out)
            x = np.where(over, x >> low32, x)
        q = x // f
        state[:k] = (q << bits) + (x - q * f) + table.start.take(sym)
        if s % every == 0:
            saved.append((s, back, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    parts = [struct.pack("<II", s, len(stream) - b) + st.astype("<u8").tobytes() for s, b, st in reversed(saved)]
    body = b"".join(parts) + stream.astype("<u4").tobytes()
    rest = struct.pack("<IIIII", n, lanes, every, len(stream), len(saved)) + body
    return _MAGIC + struct.pack("<I", zlib.crc32(rest)) + rest


def decode(block: bytes, table: Table, checkpoint: int = 0, checkpoints: int | None = None) -> np.ndarray:
    """Ids of ``checkpoints`` sections from section ``checkpoint`` on (default: all the rest).

    Raises ValueError on a wrong magic or checksum."""
    magic, crc, n, lanes, every, n_words, n_saved = struct.unpack_from(_HEAD, block)
    if magic != _MAGIC or zlib.crc32(memoryview(block)[8:]) != crc:
        raise ValueError("damaged block")
    if not n:
        return np.zeros(0, np.uint32)
    one = 8 + 8 * lanes
    base = _HEAD_BYTES + checkpoint * one
    first, at = struct.unpack_from("<II", block, base)
    state = np.frombuffer(block, "<u8", lanes, base + 8).astype(np.uint64)
    words = np.frombuffer(block, "<u4", n_words, _HEAD_BYTES + n_saved * one).astype(np.uint64)
    steps = -(-n // lanes)
    last = steps if checkpoints is None else min(steps, first + checkpoints * every)
    out = np.empty(min(n, last * lanes) - first * lanes, dtype=np.uint32)
    bits, low32, mask = np.uint64(SCALE_BITS), np.uint64(32), np.uint64((1 << SCALE_BITS) - 1)
    symbol, freq, start = table.symbol, table.freq, table.start
    for s in range(first, last):
        k = min(lanes, n - s * lanes)
        x = state[:k]
        slot = x & mask
        sym = symbol.take(slot.view(np.int64)).astype(np.int64)
        out[(s - first) * lanes:(s - first) * lanes + k] = sym
        x = freq.take(sym) * (x >> bits) + slot - start.take(sym)
        under = x < _LOW
        m = int(np.count_nonzero(under))
        if m:
            x[under] = (x[under] << low32) | words[at:at + m]
            at += m
        state[:k] = x
    return out
