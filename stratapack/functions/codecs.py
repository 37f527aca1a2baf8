"""The seven lossless codecs, as kernels over bytes.

Each block stands alone.  All but `store` begin with the length of the original as a varint, which the decoder compares with the length that
it is told.  A decoder raises FormatError for anything an encoder can't have written.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .bits import FormatError, pack, pack_low_first, read_varint, varint, window_values


@dataclass(frozen=True)
class Codec:
    """A codec and its planning figures: typical ratio and MB/s, memory, largest sensible block, dictionary bytes."""

    index: int
    name: str
    encode: Callable[[bytes, int], bytes]
    decode: Callable[[bytes, int], bytes]
    typical_ratio: float
    typical_speed_mbps: float
    memory_bytes: int
    block_cap: int
    dictionary_size: int
    types: tuple[str, ...]


def _body(data: bytes, size: int) -> int:
    declared, at = read_varint(data)
    if declared != size:
        raise FormatError("the block was made of another length")
    return at


# --- store and run lengths ----------------------------------------------------------------------


def store_encode(data: bytes, level: int = 6) -> bytes:
    return bytes(data)


def store_decode(data: bytes, size: int) -> bytes:
    if len(data) != size:
        raise FormatError("a stored block has another length")
    return bytes(data)


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, length) of the runs of equal bytes."""
    edge = np.flatnonzero(np.diff(data)) + 1
    starts = np.concatenate([[0], edge]) if len(data) else edge
    return data[starts], np.diff(np.append(starts, len(data)))


def _pairs(data: np.ndarray) -> bytes:
    value, n = runs(data)
    parts = -(-n // 255)
    out = np.empty((int(parts.sum()), 2), np.uint8)
    out[:, 0], out[:, 1] = 255, np.repeat(value, parts)
    last = np.cumsum(parts) - 1
    out[last, 0] = n - 255 * (parts - 1)
    return out.tobytes()


def _unpair(data: bytes, at: int, size: int) -> np.ndarray:
    if (len(data) - at) % 2:
        raise FormatError("half a run")
    pairs = np.frombuffer(data, np.uint8, offset=at).reshape(-1, 2)
    if len(pairs) and not pairs[:, 0].all():
        raise FormatError("a run of length 0")
    if int(pairs[:, 0].sum(dtype=np.int64)) != size:
        raise FormatError("runs of another length")
    return np.repeat(pairs[:, 1], pairs[:, 0])


def rle_encode(data: bytes, level: int = 6) -> bytes:
    return varint(len(data)) + _pairs(np.frombuffer(data, np.uint8))


def rle_decode(data: bytes, size: int) -> bytes:
    return _unpair(data, _body(data, size), size).tobytes()


# --- delta and run lengths ----------------------------------------------------------------------

STRIDES = (1, 2, 4)


def deltas(data: np.ndarray, stride: int) -> np.ndarray:
    """Differences modulo 256 with the byte `stride` places before; 0 stands before the start."""
    out = data.copy()
    out[stride:] -= data[:-stride]
    return out


def entropy(data: np.ndarray) -> float:
    """Bits a byte; 0 for no bytes."""
    if not len(data):
        return 0.0
    p = np.bincount(data, minlength=256) / len(data)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum()) + 0.0


def best_stride(data: np.ndarray) -> int:
    """The stride of least entropy; of equals the smallest."""
    return min(STRIDES, key=lambda s: entropy(deltas(data, s)))


def delta_rle_encode(data: bytes, level: int = 6) -> bytes:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return varint(0)
    stride = best_stride(raw)
    return varint(len(data)) + bytes([stride]) + _pairs(deltas(raw, stride))


def delta_rle_decode(data: bytes, size: int) -> bytes:
    at = _body(data, size)
    if not size:
        return b""
    if at >= len(data) or data[at] not in STRIDES:
        raise FormatError("no such stride")
    stride = data[at]
    d = _unpair(data, at + 1, size)
    padded = np.zeros(-(-size // stride) * stride, np.uint8)
    padded[:size] = d
    return np.cumsum(padded.reshape(-1, stride), axis=0, dtype=np.uint8).reshape(-1)[:size].tobytes()


# --- Huffman ------------------------------------------------------------------------------------

LONGEST = 32


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of each byte value's code; 0 for values without a code.

    The tree merges the two rarest nodes, of equally rare ones those made first.  Deeper trees than 32 are rebuilt from halved counts.
    """
    counts = [int(c) for c in counts]
    while True:
        heap = [(c, s) for s, c in enumerate(counts) if c]
        lengths = np.zeros(256, np.int64)
        if len(heap) < 2:
            for _, s in heap:
                lengths[s] = 1
            return lengths
        heapq.heapify(heap)
        parent: dict[int, int] = {}
        made = 256
        while len(heap) > 1:
            (c1, a), (c2, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[a] = parent[b] = made
            heapq.heappush(heap, (c1 + c2, made))
            made += 1
        depth = {made - 1: 0}
        for node in range(made - 2, 255, -1):  # parents are made after their children
            depth[node] = depth[parent[node]] + 1
        for s, c in enumerate(counts):
            if c:
                lengths[s] = depth[parent[s]] + 1
        if lengths.max() <= LONGEST:
            return lengths
        counts = [(c + 1) // 2 for c in counts]


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by length and then value; raises for lengths that no prefix code has."""
    if lengths.max(initial=0) > LONGEST:
        raise FormatError("a code of more than 32 bits")
    codes, code, width = np.zeros(256, np.uint64), 0, 0
    for s in np.lexsort((np.arange(256), lengths)).tolist():
        if lengths[s]:
            code <<= int(lengths[s]) - width
            width = int(lengths[s])
            if code >> width:
                raise FormatError("more codes than a prefix code can have")
            codes[s] = code
            code += 1
    return codes


def huffman_encode(data: bytes, level: int = 6) -> bytes:
    raw = np.frombuffer(data, np.uint8)
    lengths = code_lengths(np.bincount(raw, minlength=256))
    return varint(len(data)) + lengths.astype(np.uint8).tobytes() + pack(canonical_codes(lengths)[raw], lengths[raw])


def huffman_decode(data: bytes, size: int) -> bytes:
    at = _body(data, size)
    if len(data) < at + 256:
        raise FormatError("the table of lengths is cut off")
    lengths = np.frombuffer(data, np.uint8, 256, at).astype(np.int64)
    codes = canonical_codes(lengths)
    bits = data[at + 256 :]
    if not size:
        return b""
    wide = size > 1 << 14 or lengths.max() > 16  # a table of 16 bits costs as much as some 16,000 symbols
    width = 16 if wide else int(max(lengths.max(), 1))
    symbol, step = np.zeros(1 << width, np.uint8), np.zeros(1 << width, np.uint8)
    for s in np.flatnonzero((lengths > 0) & (lengths <= width)).tolist():
        a, b = int(codes[s]) << (width - lengths[s]), int(codes[s] + 1) << (width - lengths[s])
        symbol[a:b], step[a:b] = s, lengths[s]
    longer = {(int(lengths[s]), int(codes[s])): s for s in np.flatnonzero(lengths > width).tolist()}
    symbols, count, used = _several(symbol, step) if wide else (symbol[:, None], (step > 0).astype(np.uint8), step)
    end, out, left, p = len(bits) * 8, [], size, 0
    while left > 0 and p < end:  # in stretches of bytes
        first = (p >> 3) * 8
        seen = window_values(bits[p >> 3 : (p >> 3) + _STRETCH + 4], width)[: min(_STRETCH * 8, end - first)]
        steps = used.take(seen).tobytes()
        while left > 0 and p < first + len(seen):
            places = _chain(steps, p - first)
            found = seen[places[:-1]]
            out.append(symbols[found][np.arange(symbols.shape[1]) < count[found][:, None]])
            left -= len(out[-1])
            p = places[-1] + first
            if left > 0 and p < first + len(seen):
                s, n = _long_code(bits, p, width, longer)
                out.append(np.array([s], np.uint8))
                left, p = left - 1, p + n
    if left > 0:
        raise FormatError("the codes end early")
    made = np.concatenate(out)[:size]
    if int(lengths[made].sum()) > end:
        raise FormatError("the codes end early")
    return made.tobytes()


_STRETCH = 1 << 16


def _long_code(bits: bytes, p: int, width: int, longer: dict) -> tuple[int, int]:
    """(symbol, bits) of a code that the table doesn't have."""
    value = int.from_bytes(bits[p >> 3 : (p >> 3) + 5].ljust(5, b"\0"), "big") << (p & 7) & (1 << 40) - 1
    for n in range(width + 1, LONGEST + 1):
        if (s := longer.get((n, value >> (40 - n)))) is not None:
            return s, n
    raise FormatError("no such code")


def _several(symbol: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the next 16 bits: the symbols whose codes lie in them, how many, and the bits that they take; none where no code begins."""
    every = np.arange(1 << 16, dtype=np.uint32)
    symbols, count, used = np.zeros((1 << 16, 8), np.uint8), np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    alive = np.ones(1 << 16, bool)
    for k in range(8):
        rest = (every << used & 0xFFFF).astype(np.int64)
        more = step[rest]
        alive &= (more > 0) & (used + more <= 16)
        symbols[alive, k] = symbol[rest[alive]]
        used[alive] += more[alive]
        count += alive
    return symbols, count, used


def _huffman_long(bits: bytes, lengths: np.ndarray, codes: np.ndarray, size: int) -> bytes:
    """Bit by bit, for the rare tables with codes of more than 16 bits."""
    by_code = {(int(lengths[s]), int(codes[s])): s for s in np.flatnonzero(lengths).tolist()}
    out, code, n = bytearray(), 0, 0
    for bit in np.unpackbits(np.frombuffer(bits, np.uint8)).tolist():
        code, n = code << 1 | bit, n + 1
        if (s := by_code.get((n, code))) is not None:
            out.append(s)
            code = n = 0
            if len(out) == size:
                return bytes(out)
        elif n > LONGEST:
            raise FormatError("no such code")
    raise FormatError("the codes end early")


# --- LZ77 ---------------------------------------------------------------------------------------
#
# The tokens of this format are those of a deflate stream: distances up to 32768, lengths of 3 to 258, and literals.  So zlib's matcher finds them, and its
# decoder copies them, at the speed of compiled code; what remains here is to translate between the two codings, for whole arrays of tokens.
# Deflate's fixed codes are used: each token's bits follow from its own values, and its size can be read at its first bits.

WINDOW, MIN_MATCH, MAX_MATCH = 32768, 3, 258


def _reversed_bits(values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Values with their bits in the other order."""
    out = np.zeros_like(values)
    for k in range(int(widths.max())):
        out |= np.where(k < widths, (values >> k & 1) << np.maximum(widths - 1 - k, 0), 0)
    return out


def _fixed_codes() -> tuple[np.ndarray, np.ndarray]:
    """(code as it stands in the stream, width) of the literals and lengths by deflate's rule: 8 bits, 9 from 144 on, 7 from 256 on, 8 from 280 on."""
    s = np.arange(288)
    width = np.select([s < 144, s < 256, s < 280], [8, 9, 7], 8)
    code = np.select([s < 144, s < 256, s < 280], [0x30 + s, 0x190 + s - 144, s - 256], 0xC0 + s - 280)
    return _reversed_bits(code, width), width


def _classes(n: int, step: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(least value, further bits) of deflate's n classes of lengths or distances: after the first ones each `step` classes have one bit more."""
    extra = np.maximum(np.arange(n) // step - 1, 0)
    return first + np.concatenate([[0], np.cumsum(1 << extra)[:-1]]), extra


_CODE, _WIDTH = _fixed_codes()
_LEAST_LENGTH, _LENGTH_BITS = _classes(29, 4, MIN_MATCH)
_LEAST_LENGTH[28], _LENGTH_BITS[28] = MAX_MATCH, 0  # the longest match has a class of its own
_LEAST_DISTANCE, _DISTANCE_BITS = _classes(30, 2, 1)
_LENGTH_CLASS = np.searchsorted(_LEAST_LENGTH, np.arange(MAX_MATCH + 1), side="right") - 1
_DISTANCE_CODE = _reversed_bits(np.arange(30), np.full(30, 5))


def _token_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the next 9 bits of a stream the symbol, its width, and the further bits of a length; for 5 bits the class of a distance; for the next 18 bits the size of the token, 0 for a block's end."""
    symbol = np.zeros(512, np.int64)
    for s in range(288):
        symbol[np.arange(_CODE[s], 512, 1 << _WIDTH[s])] = s
    extra = np.where((symbol > 256) & (symbol < 286), _LENGTH_BITS[np.clip(symbol - 257, 0, 28)], 0)
    distance = np.zeros(32, np.int64)
    distance[_DISTANCE_CODE] = np.arange(30)
    every = np.arange(1 << 18)
    nine = every & 511
    size = _WIDTH[symbol[nine]] + extra[nine]
    size = np.where(symbol[nine] > 256, size + 5 + _DISTANCE_BITS[distance[every >> size & 31]], np.where(symbol[nine] == 256, 0, size))
    return symbol, _WIDTH[symbol], extra, distance, size.astype(np.uint8)


_SYMBOL, _SYMBOL_WIDTH, _SYMBOL_EXTRA, _DISTANCE_OF, _TOKEN_SIZE = _token_tables()


def _bits_from(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 32 bits or more that begin at each bit position, the first one lowest; zeros follow the end."""
    byte = at >> 3
    out = np.zeros(len(at), np.uint64)
    for k in range(5):
        out |= data[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return out >> (at & 7).astype(np.uint64)


def _chain(step: bytes, start: int = 0) -> list[int]:
    """start, start + step[start], and so on until a step is 0 or leads to the end."""
    out, p, end = [], start, len(step)
    while p < end and (n := step[p]):
        out.append(p)
        p += n
    return [*out, p]


#: zlib's level for each of ours: the least that gives matches as long as hash chains of 16 + 32 * level places.
_MATCHER = (5, 5, 6, 6, 7, 7, 9, 9, 9)


def _tokens(data: bytes, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(length, value) of the tokens of a text: a literal has length 0 and its byte, a match its distance."""
    # zlib takes place 0 for no place, so a byte that the text doesn't have is put before it
    other = np.flatnonzero(np.bincount(np.frombuffer(data, np.uint8), minlength=256) == 0)
    packer = zlib.compressobj(_MATCHER[level - 1], zlib.DEFLATED, -15, 9, zlib.Z_FIXED, *([bytes([other[0]])] if len(other) else []))
    raw = np.frombuffer(packer.compress(data) + packer.flush() + bytes(8), np.uint8)
    lengths, values = [], []
    at, end = 0, (len(raw) - 8) * 8
    while at < end:
        last = raw[at >> 3] >> (at & 7) & 1
        at += 3  # of a block with fixed codes, the only kind that is asked for; zlib still stores what doesn't shrink
        if (int(raw[(at - 2) >> 3]) | int(raw[((at - 2) >> 3) + 1]) << 8) >> ((at - 2) & 7) & 3 == 0:
            byte = (at + 7) >> 3
            n = int(raw[byte]) | int(raw[byte + 1]) << 8
            lengths.append(np.zeros(n, np.int64))
            values.append(raw[byte + 4 : byte + 4 + n].astype(np.int64))
            at = (byte + 4 + n) * 8
        else:
            places, at = _block(raw, at, end)
            bits = _bits_from(raw, places)
            nine = (bits & np.uint64(511)).astype(np.int64)
            symbol, extra = _SYMBOL[nine], _SYMBOL_EXTRA[nine]
            match = symbol > 256
            length = np.zeros(len(places), np.int64)
            value = symbol.copy()
            rest = (bits[match] >> _SYMBOL_WIDTH[nine[match]].astype(np.uint64)).astype(np.int64)
            kind = symbol[match] - 257
            length[match] = _LEAST_LENGTH[kind] + (rest & (1 << extra[match]) - 1)
            rest >>= extra[match]
            far = _DISTANCE_OF[rest & 31]
            value[match] = _LEAST_DISTANCE[far] + (rest >> 5 & (1 << _DISTANCE_BITS[far]) - 1)
            lengths.append(length)
            values.append(value)
        if last:
            break
    return np.concatenate(lengths), np.concatenate(values)


def _block(raw: np.ndarray, at: int, end: int) -> tuple[np.ndarray, int]:
    """(bit positions of the tokens of a block, position behind it): the size of a token is looked up for every position, and then the tokens are walked through.

    A block may go on to the stream's end, so it is read in stretches.
    """
    out, stretch = [], 1 << 16
    while True:
        byte = at >> 3
        some = raw[byte : byte + stretch + 8].astype(np.uint32)
        words = some[:-3] | some[1:-2] << 8 | some[2:-1] << 16 | some[3:] << 24
        seen = words[:, None] >> np.arange(8, dtype=np.uint32) & np.uint32((1 << 18) - 1)
        places = _chain(_TOKEN_SIZE.take(seen.reshape(-1)).tobytes(), at & 7)
        ended = places[-1] < seen.size
        out.append(np.array(places[:-1], np.int64) + (byte << 3))
        at = places[-1] + (byte << 3)
        if ended or at >= end:
            return np.concatenate(out), at + 7


def lz77_encode(data: bytes, level: int = 6) -> bytes:
    if not data:
        return varint(0)
    length, value = _tokens(data, clamp_level(level))
    match = length > 0
    size = np.where(match, 3, 1)
    n = len(size)
    group = np.arange(n) // 8
    to = np.cumsum(size) - size + group + 1  # a byte of flags stands before each eight tokens
    out = np.zeros(int(size.sum()) + int(group[-1]) + 1, np.uint8)
    out[to] = np.where(match, value & 255, value)
    out[to[match] + 1] = value[match] >> 8
    out[to[match] + 2] = length[match] - MIN_MATCH
    out[to[::8] - 1] = np.packbits(match, bitorder="little")
    return varint(len(data)) + out.tobytes()


def lz77_decode(data: bytes, size: int) -> bytes:
    at = _body(data, size)
    if not size:
        return b""
    raw = np.frombuffer(data + bytes(32), np.uint8)
    end = len(data)
    heads = np.array(_chain((9 + 2 * np.bitwise_count(raw[at:end])).tobytes())[:-1], np.int64) + at
    if not len(heads):
        raise FormatError("the tokens end early")
    match = np.unpackbits(raw[heads], bitorder="little").astype(bool)
    step = np.where(match, 3, 1).reshape(-1, 8)
    place = (heads[:, None] + 1 + np.cumsum(step, axis=1) - step).reshape(-1)
    made = np.cumsum(np.where(match, raw[np.minimum(place + 2, end + 2)].astype(np.int64) + MIN_MATCH, 1))
    n = int(np.searchsorted(made, size)) + 1  # tokens behind the declared length are not read
    if n > len(place) or place[n - 1] + (3 if match[n - 1] else 1) > end:
        raise FormatError("the tokens end early")
    if made[n - 1] != size:
        raise FormatError("a match ends behind the block")
    place, match, made = place[:n], match[:n], made[:n]
    at = place[match]
    distance = raw[at].astype(np.int64) | raw[at + 1].astype(np.int64) << 8
    length = raw[at + 2].astype(np.int64) + MIN_MATCH
    if (distance == 0).any() or (distance > made[match] - length).any():
        raise FormatError("a match begins before the block")
    if (distance > WINDOW).any():
        return _copy(raw, place, match, size)
    # literals are one code; a match is the code of its length with further bits, and that of its distance with further bits
    codes, widths = _CODE[raw[place]].astype(np.uint64), _WIDTH[raw[place]]
    near, far = _LENGTH_CLASS[length], np.searchsorted(_LEAST_DISTANCE, distance, side="right") - 1
    parts = [(_CODE[near + 257], _WIDTH[near + 257]), (length - _LEAST_LENGTH[near], _LENGTH_BITS[near]), (_DISTANCE_CODE[far], np.full(len(far), 5)), (distance - _LEAST_DISTANCE[far], _DISTANCE_BITS[far])]
    value, width = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
    for v, w in parts:
        value |= v.astype(np.uint64) << width.astype(np.uint64)
        width += w
    codes[match], widths[match] = value, width
    codes, widths = np.concatenate([np.array([3], np.uint64), codes, np.zeros(1, np.uint64)]), np.concatenate([[3], widths, [7]])  # the head of a last block, and its end
    try:
        return zlib.decompress(pack_low_first(codes, widths), -15, size)
    except zlib.error as e:
        raise FormatError(str(e)) from None


def _copy(raw: np.ndarray, place: np.ndarray, match: np.ndarray, size: int) -> bytes:
    """Token by token, for distances beyond the window, which no encoder of ours writes."""
    out = bytearray()
    for p, m in zip(place.tolist(), match.tolist(), strict=True):
        if not m:
            out.append(raw[p])
            continue
        d, n = int(raw[p]) | int(raw[p + 1]) << 8, int(raw[p + 2]) + MIN_MATCH
        part = bytes(out[len(out) - d : len(out) - d + n])
        out += part if d >= n else (part * (n // d + 1))[:n]
    return bytes(out)


# --- LZW ----------------------------------------------------------------------------------------

CLEAR, END, FREE, LAST_CODE = 256, 257, 258, 4096


#: Codes between two clears: after so many the dictionary is full.
_FULL = LAST_CODE - FREE


def _widths(n: int) -> np.ndarray:
    """Bits of the n codes that follow a clear: each code makes an entry, and an entry more than a width can tell makes the next code wider."""
    known = FREE + np.arange(n)
    return 9 + (known >= 512).astype(np.int64) + (known >= 1024) + (known >= 2048)


def lzw_encode(data: bytes, level: int = 6) -> bytes:
    if not data:
        return varint(0)
    codes: list[int] = []
    counts = []  # codes between clears
    roots = [{} for _ in range(256)]  # a node is (code, what follows it)
    nodes = list(enumerate(roots))
    free, began = FREE, 0
    put, (code, after) = codes.append, nodes[data[0]]
    for c in memoryview(data)[1:]:
        if (node := after.get(c)) is not None:
            code, after = node
            continue
        put(code)
        after[c] = (free, {})
        free += 1
        if free == LAST_CODE:
            counts.append(len(codes) - began)
            put(CLEAR)
            began, free = len(codes), FREE
            roots = [{} for _ in range(256)]
            nodes = list(enumerate(roots))
        code, after = nodes[c]
    put(code)
    put(END)
    counts.append(len(codes) - began)
    widths = []
    for n in counts[:-1]:
        widths += [_widths(n), [12]]  # the clear stands where the dictionary is full
    n = counts[-1]
    last = _widths(n)
    last[-1] = last[-2] if n > 1 else 9  # no entry is made of the last phrase, so the end is as wide as it
    return varint(len(data)) + pack(np.array(codes), np.concatenate([*widths, last]))


def lzw_decode(data: bytes, size: int) -> bytes:
    at = _body(data, size)
    if not size:
        return b""
    raw = np.frombuffer(data[at:] + bytes(4), np.uint8).astype(np.uint32)
    end, place, out, total = (len(data) - at) * 8, 0, [], 0
    roots = [bytes((i,)) for i in range(256)] + [b"", b""]
    widths = _widths(_FULL + 2)
    ends = np.cumsum(widths)
    while total < size:
        # the widths after a clear are known, so the codes up to the next one are read at once
        starts = place + ends - widths
        starts = starts[starts + widths[: len(starts)] <= end]
        byte = starts >> 3
        seen = raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]
        codes = (seen >> (24 - widths[: len(starts)] - (starts & 7)).astype(np.uint32) & (1 << widths[: len(starts)]) - 1).tolist()
        known, before, n = roots[:], None, 0
        learn, put = known.append, out.append
        for n, code in enumerate(codes, 1):
            if code == CLEAR or code == END:
                break
            if before is None:
                if code > 255:
                    raise FormatError("the first code is no byte")
                entry = known[code]
            else:
                if code < len(known):
                    entry = known[code]
                elif code == len(known):
                    entry = before + before[:1]
                else:
                    raise FormatError("a code that is not there yet")
                if len(known) < LAST_CODE:
                    learn(before + entry[:1])
            put(entry)
            total += len(entry)
            before = entry
            if total >= size:
                break
        else:
            if len(starts) < _FULL + 2:
                raise FormatError("the codes end early")
            raise FormatError("no clear where the dictionary is full")
        place = int(starts[n - 1]) + int(widths[n - 1])
        if code == END and total < size:
            break
    if total != size:
        raise FormatError("codes of another length")
    return b"".join(out)


# --- Burrows-Wheeler, move-to-front, range coder ------------------------------------------------


def bwt(data: np.ndarray) -> tuple[np.ndarray, int]:
    """Last column of the sorted rotations, and the row of the text itself; ranks of 7 bytes at first, which double their reach until all differ."""
    n = len(data)
    rank, reach = np.zeros(n, np.uint64), 7
    twice = np.resize(data, n + reach)
    for k in range(reach):
        rank = rank << np.uint64(8) | twice[k : k + n]
    key = rank
    while True:
        order = np.argsort(key)
        ranked = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)]).astype(np.uint64)
        rank = np.empty(n, np.uint64)
        rank[order] = ranked
        if int(ranked[-1]) == n - 1 or reach >= n:
            break
        key = rank * np.uint64(int(ranked[-1]) + 1) + np.roll(rank, -reach)
        reach *= 2
    order = np.argsort(rank, kind="stable")  # equal rotations in the order of their places
    return data[order - 1], int(np.flatnonzero(order == 0)[0])


def unbwt(last: np.ndarray, row: int) -> np.ndarray:
    """The text, read backwards through the rows that precede each other."""
    n = len(last)
    back = np.empty(n, np.int64)
    back[np.argsort(last, kind="stable")] = np.arange(n)
    back = back.tolist()
    rows = [0] * n
    for k in range(n - 1, -1, -1):
        rows[k] = row
        row = back[row]
    return last[rows]


_WORD, _TOP = 0xFFFFFFFF, 1 << 24
#: The adaptive byte frequencies start at 1 each; when their sum passes this all are halved, upwards.
_MOST = 1 << 15
_PART = 64


def _moved(last: np.ndarray) -> np.ndarray:
    """Move-to-front: each byte's place in the list of recent ones.  A byte equal to the one before has place 0, so only the others are looked up."""
    out = np.zeros(len(last), np.int64)
    changes = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
    table, places = bytearray(range(256)), []
    for b in last[changes].tolist():
        s = table.index(b)
        places.append(s)
        if s:
            del table[s]
            table.insert(0, b)
    out[changes] = places
    return out


def _slices(symbols: np.ndarray):
    """(start, width, total) of each symbol's slice of the adaptive frequencies, for stretches between halvings.

    Counts before each part of 64 symbols come from the parts' histograms, those within it from comparing its symbols with each other.
    """
    freq = np.ones(256, np.int64)
    earlier = np.tri(_PART, k=-1, dtype=bool)
    at = 0
    while at < len(symbols):
        total = int(freq.sum())
        part = symbols[at : at + _MOST - total + 1]
        n = len(part)
        rows = -(-n // _PART)
        padded = np.full(rows * _PART, 256)
        padded[:n] = part
        padded = padded.reshape(rows, _PART)
        counts = np.bincount((np.arange(rows)[:, None] * 257 + padded).reshape(-1), minlength=rows * 257).reshape(rows, 257)[:, :256]
        before = freq + np.cumsum(counts, axis=0) - counts
        below = np.cumsum(before, axis=1) - before
        row, own = np.arange(n) // _PART, part
        small = padded.astype(np.uint16)
        less = ((small[:, None, :] < small[:, :, None]) & earlier).sum(2, dtype=np.int64).reshape(-1)[:n]
        equal = ((small[:, None, :] == small[:, :, None]) & earlier).sum(2, dtype=np.int64).reshape(-1)[:n]
        yield below[row, own] + less, before[row, own] + equal, total + np.arange(n)
        freq += np.bincount(part, minlength=256)
        if freq.sum() > _MOST:
            freq = (freq + 1) >> 1
        at += n


def bwt_encode(data: bytes, level: int = 6) -> bytes:
    if not data:
        return varint(0)
    last, row = bwt(np.frombuffer(data, np.uint8))
    # The code is one long number.  A carry goes into digits that are written already, so they are kept as a list and propagated at once.
    low, span, digits = 0, _WORD, []
    for starts, widths, totals in _slices(_moved(last)):
        for start, width, total in zip(starts.tolist(), widths.tolist(), totals.tolist(), strict=True):
            span //= total
            low += start * span
            span *= width
            if low > _WORD:
                low &= _WORD
                k = len(digits) - 1
                while digits[k] == 255:
                    digits[k] = 0
                    k -= 1
                digits[k] += 1
            while span < _TOP:
                digits.append(low >> 24)
                low = low << 8 & _WORD
                span <<= 8
    out = bytes([0, *digits]) + low.to_bytes(4, "big")  # the first digit is always 0: nothing can carry out of the number
    return varint(len(data)) + row.to_bytes(4, "little") + out


def bwt_decode(data: bytes, size: int) -> bytes:
    at = _body(data, size)
    if not size:
        return b""
    if at + 4 > len(data):
        raise FormatError("the row is cut off")
    row = int.from_bytes(data[at : at + 4], "little")
    if row >= size:
        raise FormatError("no such row")
    at += 4
    code, span, end = int.from_bytes(data[at : at + 5].ljust(5, b"\0"), "big") & _WORD, _WORD, len(data)
    at += 5
    digits = data + bytes(8)
    freq, total, table, out, first = [1] * 256, 256, list(range(256)), bytearray(size), 0
    for k in range(size):
        span //= total
        f = freq[0]
        if code < f * span:  # the most frequent place by far
            span *= f
            freq[0] = f + 1
        else:
            want = code // span
            if want >= total:
                raise FormatError("no such code")
            start, s = f, 1
            while start + (f := freq[s]) <= want:
                start += f
                s += 1
            code -= start * span
            span *= f
            freq[s] = f + 1
            first = table.pop(s)
            table.insert(0, first)
        while span < _TOP:
            code = (code << 8 | digits[at]) & _WORD
            at += 1
            if at > end + 4:
                raise FormatError("the code ends early")
            span <<= 8
        total += 1
        if total > _MOST:
            freq = [(f + 1) >> 1 for f in freq]
            total = sum(freq)
        out[k] = first
    if at > end:
        raise FormatError("the code ends early")
    return unbwt(np.frombuffer(bytes(out), np.uint8), row).tobytes()


# --- the registry -------------------------------------------------------------------------------

KIB, MIB = 1 << 10, 1 << 20
_ALL = ("Text", "Image", "Audio", "Video", "Executable", "Archive", "Binary", "Unknown")
#: The index of a codec in containers, and its planning figures.
CODECS = {
    c.name: c
    for c in (
        Codec(0, "store", store_encode, store_decode, 1.0, 3000, 0, 1 << 30, 0, _ALL),
        Codec(1, "rle", rle_encode, rle_decode, 0.55, 900, 0, 16 * MIB, 0, ("Image", "Binary", "Text")),
        Codec(2, "huffman", huffman_encode, huffman_decode, 0.62, 180, 1 * MIB, 16 * MIB, 0, ("Text", "Binary", "Executable")),
        Codec(3, "lz77", lz77_encode, lz77_decode, 0.42, 60, 8 * MIB, 16 * MIB, 32768, ("Text", "Binary", "Executable")),
        Codec(4, "lzw", lzw_encode, lzw_decode, 0.5, 90, 2 * MIB, 16 * MIB, 4096, ("Text", "Binary", "Image")),
        Codec(5, "bwt-mtf-ari", bwt_encode, bwt_decode, 0.30, 6, 16 * MIB, 256 * KIB, 0, ("Text",)),
        Codec(6, "delta-rle", delta_rle_encode, delta_rle_decode, 0.35, 400, 4 * MIB, 4 * MIB, 0, ("Audio", "Image", "Binary")),
    )
}
BY_INDEX = {c.index: c for c in CODECS.values()}


def clamp_level(level: int) -> int:
    return min(9, max(1, level))
