"""Codecs: round trips over shapes and levels, size bounds, known blocks, and that damage is noticed."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratapack.functions.bits import FormatError, pack, read_varint, varint
from stratapack.functions.codecs import CODECS, best_stride, canonical_codes, code_lengths, huffman_decode, lz77_encode


def noise(n, seed):
    return np.random.RandomState(seed).randint(0, 2**32, n, dtype=np.uint32).astype(np.uint8).tobytes()


def wordy(n):
    rng = random.Random(1234)
    bag = [b"archive ", b"chunk ", b"entropy ", b"window ", b"symbol ", b"stream ", b"match ", b"table ", b"length ", b"code "]
    return b"".join(rng.choice(bag) for _ in range(n // 5))[:n]


def sentence(n):
    return (b"Every chunk of a file is packed on its own, so that many workers can share one file. " * (n // 80 + 1))[:n]


def smooth(n):
    return (1000 + np.cumsum(np.arange(n // 2) % 200 < 4)).astype("<u2").tobytes()


def flat(n):
    return np.repeat(np.arange(n // 200 + 1) % 256, 200).astype(np.uint8)[:n].tobytes()


SHAPES = {"empty": b"", "one": b"\x42", "banana": b"banana", "flat": flat(65536), "wordy": wordy(65536), "sentence": sentence(98304), "smooth": smooth(65536), "noise": noise(65536, 7), "noise2": noise(70000, 11), "prime": sentence(100003)}


@pytest.mark.parametrize("name", CODECS)
def test_round_trips(name):
    codec = CODECS[name]
    for shape, data in SHAPES.items():
        for level in (1, 6, 9) if name == "lz77" else (6,):
            assert codec.decode(codec.encode(data, level), len(data)) == data, (shape, level)


@given(st.binary(max_size=600), st.sampled_from(sorted(CODECS)))
@settings(max_examples=150, deadline=None)
def test_any_bytes(data, name):
    assert CODECS[name].decode(CODECS[name].encode(data, 6), len(data)) == data


@given(st.lists(st.tuples(st.integers(0, 255), st.integers(1, 900)), max_size=12), st.sampled_from(sorted(CODECS)))
@settings(max_examples=60, deadline=None)
def test_any_runs(runs, name):
    data = b"".join(bytes([v]) * n for v, n in runs)
    assert CODECS[name].decode(CODECS[name].encode(data, 6), len(data)) == data


def test_size_bounds():
    n = 65536
    size = lambda name, data: len(CODECS[name].encode(data, 6))
    rep = sentence(n)
    assert size("store", rep) == n
    assert size("rle", flat(n)) < n / 20
    assert size("huffman", rep) < 3 * n / 4
    assert size("lz77", rep) < n / 4
    assert size("lzw", rep) < n / 3
    assert size("bwt-mtf-ari", rep) < n / 4
    assert size("delta-rle", smooth(n)) < n / 3
    assert size("lz77", noise(n, 3)) > 9 * n / 10
    assert size("huffman", b"\xab" * 100000) < 100000 / 8 + 512


def test_levels_do_not_get_worse():
    sizes = [len(lz77_encode(wordy(200000), level)) for level in (1, 3, 6, 9)]
    assert sizes == sorted(sizes, reverse=True)


def test_known_blocks():
    e = lambda name, data: CODECS[name].encode(data, 6)
    assert e("rle", b"aaab") == b"\x04\x03a\x01b"
    assert e("rle", b"a" * 256) == b"\x80\x02\xffa\x01a"
    assert e("delta-rle", b"\x01\x02\x03\x04") == b"\x04\x01\x04\x01"
    assert e("huffman", b"") == b"\0" * 257
    assert e("huffman", b"ab")[257:] == b"\x40"
    assert e("lz77", b"abcabcabc") == b"\x09\x08abc\x03\x00\x03"
    assert e("lzw", b"aa") == b"\x02" + pack(np.array([97, 97, 257]), np.array([9, 9, 9]))
    assert e("bwt-mtf-ari", b"banana")[:5] == b"\x06\x03\0\0\0"
    for name in ("lz77", "lzw", "bwt-mtf-ari", "rle"):
        assert e(name, b"") == b"\0"


@pytest.mark.parametrize("name,data", [("lzw", wordy(300000)), ("lzw", noise(300000, 42)), ("bwt-mtf-ari", b"abcabcabcabc" * 2000), ("bwt-mtf-ari", b"\0" * 5000), ("bwt-mtf-ari", b"\0\xff" * 5000)])
def test_special_inputs(name, data):
    assert CODECS[name].decode(CODECS[name].encode(data, 6), len(data)) == data


def test_stride():
    assert best_stride(np.frombuffer(smooth(65536), np.uint8)) in (1, 2, 4)
    assert best_stride(np.frombuffer(np.arange(5000, dtype="<u4").tobytes(), np.uint8)) == 4


@pytest.mark.parametrize("name", CODECS)
def test_damage_is_noticed(name):
    codec, data = CODECS[name], wordy(4096)
    out = codec.encode(data, 6)
    with pytest.raises(FormatError):
        codec.decode(out[: len(out) // 2], len(data))
    with pytest.raises(FormatError):
        codec.decode(out, len(data) + 1)
    rng = random.Random(5)
    for _ in range(40):  # a flipped bit is refused or changes the content, which the checksum shows
        bad = bytearray(out)
        bad[rng.randrange(2 if name != "store" else 0, len(bad))] ^= 1 << rng.randrange(8)
        try:
            assert codec.decode(bytes(bad), len(data)) != data or name in ("huffman", "lzw", "bwt-mtf-ari")  # these have spare bits at the end
        except FormatError:
            pass


def test_hostile_huffman_tables():
    for lengths in ({0: 255}, {0: 33}, {0: 1, 1: 1, 2: 1}):
        table = np.zeros(256, np.uint8)
        for s, n in lengths.items():
            table[s] = n
        with pytest.raises(FormatError):
            huffman_decode(varint(4) + table.tobytes() + b"\xff" * 8, 4)
    table = np.zeros(256, np.uint8)
    table[5] = 32
    assert huffman_decode(varint(1) + table.tobytes() + b"\0" * 4, 1) == b"\x05"


def test_deep_trees_are_bounded():
    counts = np.zeros(256, np.int64)
    a, b = 1, 1
    for k in range(60):
        counts[k], a, b = a, b, a + b
    lengths = code_lengths(counts)
    assert lengths.max() <= 32
    canonical_codes(lengths)


def test_varints():
    for n in (0, 1, 127, 128, 300, 2**31, 2**64 - 1):
        assert read_varint(varint(n)) == (n, len(varint(n)))
    for bad in (b"", b"\x80", b"\xff" * 10):
        with pytest.raises(FormatError):
            read_varint(bad)
