"""Checksums and ciphers: combinable CRC-32, incremental digests, HMAC-SHA256, PBKDF2 and ChaCha20 (RFC 8439)."""

from __future__ import annotations

import hashlib
import hmac
import zlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

KDF_ITERATIONS, KDF_MOST = 200_000, 10_000_000


def crc32(data: bytes, seed: int = 0) -> int:
    return zlib.crc32(data, seed)


def crc32_hex(crc: int) -> str:
    return f"{crc & 0xFFFFFFFF:08x}"


@lru_cache(64)
def _zeros(k: int) -> tuple[int, ...]:
    """The linear map (32 columns) that 2**k zero bytes apply to a CRC register."""
    if k:
        half = _zeros(k - 1)
        return tuple(_times(half, c) for c in half)
    step = [0xEDB88320, *(1 << j for j in range(31))]  # one zero bit
    for _ in range(3):
        step = [_times(step, c) for c in step]
    return tuple(step)


def _times(columns, v: int) -> int:
    out, k = 0, 0
    while v:
        if v & 1:
            out ^= columns[k]
        v >>= 1
        k += 1
    return out


def crc32_combine(first: int, second: int, second_size: int) -> int:
    """CRC of a concatenation, of the parts' CRCs and the second one's length."""
    for k in range(second_size.bit_length()):
        if second_size >> k & 1:
            first = _times(_zeros(k), first)
    return first ^ second


def crc32_fold(parts: Iterable[tuple[int, int]]) -> int:
    """CRC of a whole, of the (CRC, length) of its parts in order."""
    out = 0
    for crc, size in parts:
        out = crc32_combine(out, crc, size)
    return out


def hmac_sha256(key: bytes, *parts: bytes) -> bytes:
    h = hmac.new(key, digestmod=hashlib.sha256)
    for p in parts:
        h.update(p)
    return h.digest()


def derive_keys(password: str | bytes, salt: bytes, iterations: int = KDF_ITERATIONS, version: int = 2) -> tuple[bytes, bytes]:
    """(cipher key, MAC key); the MAC key is empty in version 1."""
    if not 1 <= iterations <= KDF_MOST:
        raise ValueError(f"key derivation takes 1 to {KDF_MOST} rounds")
    word = password.encode() if isinstance(password, str) else password
    out = hashlib.pbkdf2_hmac("sha256", word, salt, iterations, 64 if version >= 2 else 32)
    return out[:32], out[32:]


def chunk_nonce(nonce: bytes, chunk: int) -> bytes:
    """The file's nonce with the chunk's number (little-endian) in its last four bytes."""
    return nonce[:8] + (chunk & 0xFFFFFFFF).to_bytes(4, "little")


def _quarter(s, a, b, c, d):
    for x, y, z, turn in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
        s[x] += s[y]
        s[z] ^= s[x]
        s[z] = s[z] << np.uint32(turn) | s[z] >> np.uint32(32 - turn)


#: Blocks of key stream that are computed side by side.
_SIDE = 1 << 15


def chacha20_all(key: bytes, nonces: list[bytes], texts: list[bytes], counter: int = 1) -> list[bytes]:
    """Each text under the key stream of its own nonce; the blocks of all texts are computed side by side."""
    blocks = np.array([-(-len(t) // 64) for t in texts], np.int64)
    if len(key) != 32 or any(len(n) != 12 for n in nonces):
        raise ValueError("a key has 32 bytes and a nonce 12")
    if counter + int(blocks.max(initial=0)) > 1 << 32:
        raise ValueError("too much data for one nonce")
    if not blocks.sum():
        return [b""] * len(texts)
    head = np.frombuffer(b"expand 32-byte k" + key, "<u4")
    words = np.frombuffer(b"".join(nonces), "<u4").reshape(-1, 3)
    owner = np.repeat(np.arange(len(texts)), blocks)
    count = (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks) + counter).astype(np.uint32)
    stream = np.empty((len(owner), 16), "<u4")
    for k in range(0, len(owner), _SIDE):
        own = owner[k : k + _SIDE]
        start = [np.full(len(own), w, np.uint32) for w in head] + [count[k : k + _SIDE]] + [words[own, j] for j in range(3)]
        s = [w.copy() for w in start]
        for _ in range(10):
            for q in range(4):
                _quarter(s, q, q + 4, q + 8, q + 12)
            for q in range(4):
                _quarter(s, q, (q + 1) % 4 + 4, (q + 2) % 4 + 8, (q + 3) % 4 + 12)
        for j in range(16):
            stream[k : k + _SIDE, j] = s[j] + start[j]
    flat, out, at = stream.view(np.uint8).reshape(-1), [], 0
    for t, n in zip(texts, blocks.tolist(), strict=True):
        out.append((np.frombuffer(t, np.uint8) ^ flat[at : at + len(t)]).tobytes())
        at += 64 * n
    return out


def chacha20(key: bytes, nonce: bytes, data: bytes, counter: int = 1) -> bytes:
    """`data` under the key stream."""
    return chacha20_all(key, [nonce], [data], counter)[0]


class Digest:
    """CRC-32, SHA-256 and, with a key, HMAC-SHA256 of bytes that come piece by piece."""

    def __init__(self, key: bytes | None = None):
        self.size, self.crc, self._sha = 0, 0, hashlib.sha256()
        self._mac = None if key is None else hmac.new(key, digestmod=hashlib.sha256)

    def update(self, data: bytes) -> Digest:
        self.size += len(data)
        self.crc = zlib.crc32(data, self.crc)
        self._sha.update(data)
        if self._mac is not None:
            self._mac.update(data)
        return self

    def sha256(self) -> bytes:
        return self._sha.digest()

    def mac(self) -> bytes | None:
        return None if self._mac is None else self._mac.digest()


def same(a: bytes, b: bytes) -> bool:
    """Comparison in constant time."""
    return hmac.compare_digest(a, b)
