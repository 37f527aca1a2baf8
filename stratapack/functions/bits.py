"""Variable-length integers and bit strings, for whole arrays at once."""

from __future__ import annotations

import numpy as np


class FormatError(ValueError):
    """Bytes that no encoder of the format writes."""


def varint(n: int) -> bytes:
    """Little-endian base 128: seven bits a byte, the top bit says that more follow."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, position behind it)."""
    value = 0
    for k in range(10):
        if at + k >= len(data):
            raise FormatError("a length is cut off")
        value |= (data[at + k] & 127) << 7 * k
        if data[at + k] < 128:
            if value >> 64:
                break
            return value, at + k + 1
    raise FormatError("a length has more than 64 bits")


def _sum_bytes(byte: np.ndarray, parts, n: int) -> bytes:
    """n bytes: `parts` are bytes of the values for places that follow each other from `byte` on.  Values don't share bits, so their bytes can be added up."""
    out = np.zeros(n + 8, np.uint8)
    for k, part in enumerate(parts):
        out += np.bincount(byte + k, part.astype(np.uint8), n + 8).astype(np.uint8)
    return out[:n].tobytes()


def pack(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Values of the given widths (56 at most), the most significant bit first, filled up with 0 bits."""
    widths = np.broadcast_to(np.asarray(widths, np.int64), np.shape(values))
    if not len(widths):
        return b""
    ends = np.cumsum(widths)
    start = ends - widths
    moved = np.asarray(values, np.uint64) << (64 - widths - (start & 7)).astype(np.uint64)  # the first byte is the highest
    reach = int(widths.max() + 14) >> 3
    return _sum_bytes(start >> 3, (moved >> np.uint64(56 - 8 * k) for k in range(reach)), int(ends[-1]) + 7 >> 3)


def pack_low_first(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Values of the given widths (56 at most), the least significant bit first, from the lowest bit of each byte on."""
    if not len(widths):
        return b""
    ends = np.cumsum(widths)
    start = ends - widths
    moved = np.asarray(values, np.uint64) << (start & 7).astype(np.uint64)
    return _sum_bytes(start >> 3, (moved >> np.uint64(8 * k) for k in range(int(widths.max() + 14) >> 3)), int(ends[-1]) + 7 >> 3)


def window_values(data: bytes, width: int = 16) -> np.ndarray:
    """For every bit position of `data` the value of the `width` (at most 24) bits from there; 0 bits follow the end."""
    b = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    four = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    return (four[:-1, None] << np.arange(8, dtype=np.uint32) >> np.uint32(32 - width)).reshape(-1)
