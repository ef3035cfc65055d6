"""Binary layouts, declared as fields and packed or read by one routine. All numbers are little-endian.

A field is (name, kind): ``u8``, ``u32``, ``u64``; ``bool`` (u8, 1 is true); ``bytes`` (u32 length, then as many); ``rest`` (what
is left); ``sized:<name>`` (as many as the earlier ``size:<name>`` says); or a list of fields, which repeats after a u32 count or,
where an earlier ``count:<name>`` is declared, as often as that says.
"""

from __future__ import annotations

import struct

from .checksum import crc32c

_NUMBERS = {"u8": struct.Struct("<B"), "u32": struct.Struct("<I"), "u64": struct.Struct("<Q")}
FRAME = struct.Struct("<II")

Layout = list[tuple[str, "str | Layout"]]


class DecodeFailed(ValueError):
    """``args[0]`` is the error class that the format names."""


def pack(layout: Layout, record: dict) -> bytes:
    out = []
    counted = {kind[6:] for _, kind in layout if isinstance(kind, str) and kind.startswith("count:")}
    for name, kind in layout:
        if isinstance(kind, list):
            rows = record[name]
            out += ([] if name in counted else [_NUMBERS["u32"].pack(len(rows))]) + [pack(kind, row) for row in rows]
        elif kind in _NUMBERS:
            out.append(_NUMBERS[kind].pack(record[name]))
        elif kind == "bool":
            out.append(bytes([bool(record[name])]))
        elif kind == "bytes":
            out += [_NUMBERS["u32"].pack(len(record[name])), record[name]]
        elif kind.startswith(("size:", "count:")):
            out.append(_NUMBERS["u32"].pack(len(record[kind.partition(":")[2]])))
        else:  # rest, sized
            out.append(record[name])
    return b"".join(out)


def unpack(layout: Layout, data: bytes, at: int = 0, short: str = "Malformed") -> tuple[dict, int]:
    """The record at ``at`` and where it ends; raises DecodeFailed(``short``) if there are too few bytes."""
    out: dict = {}
    said: dict[str, int] = {}

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise DecodeFailed(short)
        at += n
        return data[at - n : at]

    def number(kind: str) -> int:
        return _NUMBERS[kind].unpack(take(_NUMBERS[kind].size))[0]

    for name, kind in layout:
        if isinstance(kind, list):
            rows = out[name] = []
            for _ in range(said[name] if name in said else number("u32")):
                row, at = unpack(kind, data, at, short)
                rows.append(row)
        elif kind in _NUMBERS:
            out[name] = number(kind)
        elif kind == "bool":
            out[name] = take(1) == b"\1"
        elif kind == "bytes":
            out[name] = take(number("u32"))
        elif kind.startswith(("size:", "count:")):
            said[kind.partition(":")[2]] = number("u32")
        elif kind.startswith("sized:"):
            out[name] = take(said[kind[6:]])
        else:
            out[name] = take(len(data) - at)
    return out, at


def frame(payload: bytes) -> bytes:
    """CRC32C of what follows, length, payload."""
    body = FRAME.pack(0, len(payload))[4:] + payload
    return FRAME.pack(crc32c(body), 0)[:4] + body


def unframe(data: bytes, at: int = 0, least: int = 0) -> tuple[bytes, int]:
    """The payload of the frame at ``at`` and where the frame ends: Incomplete if it is cut, CrcMismatch if it is damaged."""
    if at + FRAME.size > len(data):
        raise DecodeFailed("Incomplete")
    crc, size = FRAME.unpack_from(data, at)
    end = at + FRAME.size + size
    if end > len(data) or size < least:
        raise DecodeFailed("Incomplete")
    if crc32c(data[at + 4 : end]) != crc:
        raise DecodeFailed("CrcMismatch")
    return data[at + FRAME.size : end], end
