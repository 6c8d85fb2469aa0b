"""CRC-32C of many byte strings at once, in numpy, and the mask that record files use."""

from __future__ import annotations

from functools import cache

import numpy as np

POLYNOMIAL = 0x82F63B78  # reflected Castagnoli
MASK_DELTA = 0xA282EAD8
_BLOCK = 256  # bytes


@cache
def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


def _advance(state: np.ndarray, zeros: int) -> np.ndarray:
    t = _byte_table()
    for _ in range(zeros):
        state = (state >> np.uint32(8)) ^ t[state & np.uint32(0xFF)]
    return state


@cache
def _shift_tables(zeros: int) -> tuple[np.ndarray, np.ndarray]:
    """What zeros zero bytes make of each lower and of each upper half of a state (a power of two at least 4)."""
    half = np.arange(1 << 16, dtype=np.uint32)
    if zeros <= 4:
        return _advance(half, zeros), _advance(half << np.uint32(16), zeros)
    return _shift(_shift(half, zeros // 2), zeros // 2), _shift(_shift(half << np.uint32(16), zeros // 2), zeros // 2)


def _shift(state: np.ndarray, zeros: int) -> np.ndarray:
    lo, hi = _shift_tables(zeros)
    return lo[state & np.uint32(0xFFFF)] ^ hi[state >> np.uint32(16)]


def _shift_any(state: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each state after its own number of zero bytes."""
    for k in range(int(zeros.max(initial=0)).bit_length()):
        on = np.flatnonzero(zeros >> k & 1)
        state[on] = _advance(state[on], 1 << k) if k < 2 else _shift(state[on], 1 << k)
    return state


def crc32c(parts: list[bytes]) -> np.ndarray:
    """The checksum of each part. A part is led by zero bytes, which leave a zero state alone, to whole blocks;
    blocks are folded by halves, then joined; the usual start value is shifted in by the part's length."""
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    blocks = -(-n // _BLOCK)
    data = np.frombuffer(b"".join([b"\0" * int(k) + p for p, k in zip(parts, (blocks * _BLOCK - n).tolist(), strict=True)]), "<u4")
    x = _shift(data, 4)
    size = 4
    while size < _BLOCK:
        x = _shift(x[0::2], size) ^ x[1::2]
        size *= 2
    state, first = np.zeros(len(parts), np.uint32), np.cumsum(blocks) - blocks
    order = np.argsort(-blocks, kind="stable")
    live = np.searchsorted(-blocks[order], -np.arange(int(blocks.max(initial=0))), side="left")
    for k, m in enumerate(live.tolist()):
        some = order[:m]
        state[some] = _shift(state[some], _BLOCK) ^ x[first[some] + k]
    return state ^ _shift_any(np.full(len(parts), 0xFFFFFFFF, np.uint32), n) ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)
