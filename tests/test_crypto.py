"""Published vectors and identities of checksums and ciphers."""

import hashlib
import zlib

import pytest

from stratapack.functions import crypto as c


def test_crc():
    assert c.crc32_hex(c.crc32(b"123456789")) == "cbf43926" and c.crc32_hex(0) == "00000000"
    data = bytes(range(256)) * 40
    for cuts in ([0], [1], [5, 5, 900], [4096, 8192]):
        edges = [0, *cuts, len(data)]
        parts = [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        assert c.crc32_fold((zlib.crc32(p), len(p)) for p in parts) == zlib.crc32(data)


def test_hmac_rfc4231():
    assert c.hmac_sha256(b"\x0b" * 20, b"Hi ", b"There").hex() == "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"


def test_pbkdf2():
    assert hashlib.pbkdf2_hmac("sha256", b"password", b"salt", 1).hex() == "120fb6cffcf8b32c43e7225256c4f837a86548c92ccc35480805987cb70be17b"
    enc, mac = c.derive_keys("password", b"salt", 1)
    assert enc.hex() == "120fb6cffcf8b32c43e7225256c4f837a86548c92ccc35480805987cb70be17b" and len(mac) == 32
    assert c.derive_keys("password", b"salt", 1, version=1)[1] == b""
    for rounds in (0, c.KDF_MOST + 1):
        with pytest.raises(ValueError):
            c.derive_keys("x", b"s", rounds)


def test_chacha20_rfc8439():
    text = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    key, nonce = bytes(range(32)), bytes.fromhex("000000000000004a00000000")
    out = c.chacha20(key, nonce, text)
    assert out.hex().startswith("6e2e359a2568f98041ba0728dd0d6981e97e7aec1d4360c20a27afccfd9fae0b")
    assert c.chacha20(key, nonce, out) == text and c.chacha20(key, nonce, b"") == b""
    with pytest.raises(ValueError):
        c.chacha20(key, nonce, b"x" * 65, counter=(1 << 32) - 1)


def test_nonces():
    assert c.chunk_nonce(b"abcdefghijkl", 258) == b"abcdefgh\x02\x01\0\0"


def test_digest_by_pieces():
    data = bytes(range(256)) * 30
    d = c.Digest(b"key")
    for k in range(0, len(data), 777):
        d.update(data[k : k + 777])
    assert (d.size, d.crc, d.sha256(), d.mac()) == (len(data), zlib.crc32(data), hashlib.sha256(data).digest(), c.hmac_sha256(b"key", data))
    assert c.Digest().update(b"").mac() is None


def test_many_key_streams_at_once():
    key, texts = bytes(range(32)), [b"", b"a", b"x" * 64, b"y" * 1000, b"z" * 63]
    nonces = [bytes([k]) * 12 for k in range(len(texts))]
    assert c.chacha20_all(key, nonces, texts) == [c.chacha20(key, n, t) for n, t in zip(nonces, texts, strict=True)]
