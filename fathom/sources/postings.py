"""Posting lists of existing indexes: ascending ids as gaps, seven bits a byte, lowest first."""

from __future__ import annotations

from collections.abc import Iterable


def encode_gaps(ids: Iterable[int]) -> bytes:
    """The first number is its id plus one; the others are gaps."""
    out, before = bytearray(), -1
    for i in ids:
        gap, before = i - before, i
        while gap >= 0x80:
            out.append(gap & 0x7F | 0x80)
            gap >>= 7
        out.append(gap)
    return bytes(out)


def decode_gaps(data: bytes) -> list[int]:
    """ValueError for a list that is cut off or a number of more than 64 bits."""
    out, last, value, shift = [], -1, 0, 0
    for b in data:
        value |= (b & 0x7F) << shift
        if b & 0x80:
            shift += 7
            if shift >= 64:
                raise ValueError("a gap of more than 64 bits")
            continue
        last += value
        out.append(last)
        value = shift = 0
    if shift:
        raise ValueError("the list is cut off")
    return out
