"""CRC32C (Castagnoli) of many byte ranges at once with numpy.

All ranges advance together, a byte a step, through one look-up table. Ranges longer than ``PIECE`` are cut into pieces that
advance together too; the checksum is linear, so a piece's register is moved past what follows by a table of its own.
"""

from __future__ import annotations

import numpy as np

PIECE = 4096
STEP = 50  # bytes that go one at a time while all ranges advance by one


def _byte_table() -> np.ndarray:
    """Remainders of one byte, from the reflected Castagnoli polynomial."""
    reg = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        reg = np.where(reg & 1, reg >> 1 ^ np.uint32(0x82F63B78), reg >> 1)
    return reg


_TABLE = _byte_table()


def _zeros_table(n: int) -> np.ndarray:
    """4 x 256: where each byte of a register is after ``n`` zero bytes."""
    reg = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    for _ in range(n):
        reg = _TABLE[reg & 255] ^ reg >> 8
    return reg.reshape(4, 256)


_PAST = _zeros_table(PIECE)


def _advance(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, reg: np.ndarray) -> np.ndarray:
    """Registers after the bytes of each range, the longest ranges last to end."""
    order = np.argsort(ends - starts, kind="stable")[::-1]
    at, left, out = starts[order], (ends - starts)[order], reg[order]
    for step in range(int(left.max(initial=0))):
        n = int(np.searchsorted(-left, -step, "left"))  # ranges with a byte at this step
        out[:n] = _TABLE[(out[:n] ^ data[at[:n] + step]) & 255] ^ out[:n] >> 8
    back = np.empty_like(out)
    back[order] = out
    return back


def crc32c_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC32C of the bytes ``starts[i]`` to ``ends[i]`` (not with it) of a byte array."""
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    sizes = ends - starts
    if int(sizes.sum()) < STEP * int(sizes.max(initial=0)) and sizes.max() <= PIECE:  # few ranges: a byte at a time is faster
        return np.array([crc32c(data[a:b].tobytes()) for a, b in zip(starts, ends)], np.uint32)
    pieces = (ends - starts) // PIECE
    first = ends - pieces * PIECE  # the odd bytes come first
    reg = _advance(data, starts, first, np.full(len(starts), 0xFFFFFFFF, np.uint32))
    owner = np.repeat(np.arange(len(starts)), pieces)
    if len(owner):
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = first[owner] + number * PIECE
        parts = _advance(data, begin, begin + PIECE, np.zeros(len(owner), np.uint32))
        for k in range(int(pieces.max())):
            here = np.flatnonzero(number == k)
            r = reg[owner[here]]
            reg[owner[here]] = _PAST[0][r & 255] ^ _PAST[1][r >> 8 & 255] ^ _PAST[2][r >> 16 & 255] ^ _PAST[3][r >> 24] ^ parts[here]
    return reg ^ np.uint32(0xFFFFFFFF)


_BYTES = _TABLE.tolist()


def crc32c(data: bytes) -> int:
    """Of one value: a short one byte by byte, which is faster than many small array steps."""
    if len(data) <= PIECE:
        reg = 0xFFFFFFFF
        for b in data:
            reg = _BYTES[(reg ^ b) & 255] ^ reg >> 8
        return reg ^ 0xFFFFFFFF
    return int(crc32c_ranges(np.frombuffer(data, np.uint8), np.zeros(1), np.full(1, len(data)))[0])


def _past(step: list[int], reg: int) -> int:
    out = 0
    for i in range(32):
        if reg >> i & 1:
            out ^= step[i]
    return out


def crc32c_joined(a: int, b: int, size: int) -> int:
    """CRC32C of two byte ranges in a row from their own, the second of ``size`` bytes."""
    step = [_BYTES[r & 255] ^ r >> 8 for r in (1 << i for i in range(32))]  # past one zero byte, then two, four, ...
    while size:
        if size & 1:
            a = _past(step, a)
        step, size = [_past(step, r) for r in step], size >> 1
    return a ^ b
