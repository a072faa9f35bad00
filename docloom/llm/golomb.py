"""Golomb-Rice coding of sorted 64-bit integers with numpy."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<IBQ")


def encode(values: np.ndarray) -> bytes:
    """Code sorted distinct unsigned integers as gaps: unary quotient, ``k`` low bits.

    ``k`` follows from the mean gap. An empty array gives a header alone.
    """
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return _HEAD.pack(0, 0, 0)
    gaps = np.diff(values)
    first = int(values[0])
    if n == 1:
        return _HEAD.pack(1, 0, first)
    mean = max(1, int((int(values[-1]) - first) // (n - 1)))
    k = max(0, mean.bit_length() - 1)
    high = (gaps >> np.uint64(k)).astype(np.int64)
    ones = np.cumsum(high + 1) - 1  # place of each stop bit
    unary = np.zeros(int(ones[-1]) + 1, np.uint8)
    unary[ones] = 1
    head = _HEAD.pack(n, k, first)
    unary = np.packbits(unary).tobytes()
    low = b""
    if k:
        parts = []
        for at in range(0, len(gaps), 1 << 16):
            octets = gaps[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
            parts.append(np.packbits(np.unpackbits(octets, axis=1)[:, 64 - k :]).tobytes())  # 2**16 * k bits fill whole bytes
        low = b"".join(parts)
    return head + struct.pack("<I", len(unary)) + unary + low


def decode(blob: bytes) -> np.ndarray:
    """The integers that ``encode`` was given."""
    n, k, first = _HEAD.unpack_from(blob)
    if not n:
        return np.zeros(0, np.uint64)
    if n == 1:
        return np.array([first], np.uint64)
    at = _HEAD.size
    (size,) = struct.unpack_from("<I", blob, at)
    at += 4
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size, at)))[: n - 1]
    high = (np.diff(ones, prepend=-1) - 1).astype(np.uint64)
    at += size
    gaps = high << np.uint64(k)
    if k:
        step = 1 << 16  # gaps at a time: bounds the memory of their bits
        for low in range(0, n - 1, step):
            m = min(step, n - 1 - low)
            bits = np.unpackbits(np.frombuffer(blob, np.uint8, (m * k + 7) // 8, at + low * k // 8))[: m * k].reshape(m, k)
            octets = np.zeros((m, 64), np.uint8)
            octets[:, 64 - k :] = bits
            gaps[low : low + m] |= np.packbits(octets, axis=1).view(">u8").ravel().astype(np.uint64)
    out = np.empty(n, np.uint64)
    out[0] = first
    np.cumsum(gaps, dtype=np.uint64, out=out[1:])
    out[1:] += np.uint64(first)
    return out


def bitmap(flags: np.ndarray) -> bytes:
    return np.packbits(np.asarray(flags, bool)).tobytes()


def unbitmap(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8))[:n].astype(bool)
