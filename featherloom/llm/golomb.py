"""Golomb-Rice coding of sorted 64-bit fingerprints, vectorised with numpy."""

from __future__ import annotations

import numpy as np

STEP = 1 << 16


def encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Code ascending unsigned 64-bit ``values``: (rice bits, unary stream, remainder stream).

    The first value and the gaps between neighbours are coded; an empty array gives
    empty streams.
    """
    if not len(values):
        return 0, b"", b""
    values = values.astype(np.uint64)
    gaps = np.empty_like(values)
    gaps[0] = values[0]
    gaps[1:] = values[1:] - values[:-1]
    # the gaps sum to the last value, so the unary stream has fewer than 3 bits for each
    mean = float(values[-1]) / len(values)
    rice = int(np.log2(mean)) if mean >= 1 else 0
    high = (gaps >> np.uint64(rice)).astype(np.int64)
    ends = np.cumsum(high + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    rest = []
    if rice:
        shifts = np.arange(rice, dtype=np.uint64)
        # STEP is a multiple of 8, so blocks join on whole bytes
        for at in range(0, len(gaps), STEP):
            bits = (gaps[at : at + STEP, None] >> shifts) & np.uint64(1)
            rest.append(np.packbits(bits.astype(np.uint8).ravel()).tobytes())
    return rice, np.packbits(unary).tobytes(), b"".join(rest)


def decode(n: int, rice: int, unary: bytes, rest: bytes) -> np.ndarray:
    """The ``n`` values that ``encode`` has coded."""
    if not n:
        return np.empty(0, np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    high = np.diff(ends, prepend=-1) - 1
    gaps = high.astype(np.uint64) << np.uint64(rice)
    if rice:
        raw, weights = np.frombuffer(rest, np.uint8), np.uint64(1) << np.arange(rice, dtype=np.uint64)
        for at in range(0, n, STEP):
            k = min(STEP, n - at)
            first = at * rice // 8
            bits = np.unpackbits(raw[first : first + (k * rice + 7) // 8])[: k * rice]
            gaps[at : at + k] += bits.reshape(k, rice).astype(np.uint64) @ weights
    return np.cumsum(gaps, dtype=np.uint64)
