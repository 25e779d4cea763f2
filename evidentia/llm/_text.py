"""Vectorised text primitives for Arrow batches: words, rolling hashes and hash mixing.

Everything works on the value buffer of an Arrow string column, so a batch of
texts is hashed with a handful of numpy passes and no per-word Python code.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Modulus of range_hash, a prime, and its base, drawn from a fixed seed. Unequal runs of n values are
#: equal with a probability of n / PRIME over the choice of the base, whatever the values are.
PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
_BASE = int(np.random.default_rng(20240602).integers(1 << 60, PRIME, dtype=np.uint64))
_LOW30, _LOW31 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_30, _31, _61 = np.uint64(30), np.uint64(31), np.uint64(61)
#: Values that are summed up before the sum is reduced.
_CHUNK = 1 << 17
#: Bytes of a word that is hashed modulo PRIME.
LONG_WORD = 256
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)

#: Bytes that separate words: the space and tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Translation that lower-cases A-Z and nothing else.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: One 64-bit value for each byte, drawn from a fixed seed.
BYTE_VALUES = np.random.default_rng(20240601).integers(0, 2**64, 256, dtype=np.uint64)

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)
_prime_powers = np.ones(1, dtype=np.uint64)
_prime_inverses = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values (new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, in place."""
    high = x >> _61
    x &= _P
    x += high
    x -= _P * (x >= _P)
    return x


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of values below PRIME: the halves are multiplied apart."""
    a_high, a_low, b_high, b_low = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = a_low * b_high
    middle += a_high * b_low
    out = a_high * b_high
    out <<= np.uint64(1)
    out += middle >> _30
    middle &= _LOW30
    middle <<= _31
    out += middle
    a_low *= b_low
    return _reduced(_reduced(out) + a_low)


def _prime_geometric(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo PRIME and of its inverse, kept between calls."""
    global _prime_powers, _prime_inverses
    while len(_prime_powers) < n:
        k = len(_prime_powers)
        step, back = (np.full(k, pow(x, k, PRIME), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, PRIME)))
        _prime_powers = np.concatenate([_prime_powers, _product(_prime_powers, step)])
        _prime_inverses = np.concatenate([_prime_inverses, _product(_prime_inverses, back)])
    return _prime_powers[:n], _prime_inverses[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base**i modulo PRIME, with a leading 0; values are bytes or 64 bits."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    powers, _ = _prime_geometric(len(values))
    carry = np.uint64(0)
    for low in range(0, len(values), _CHUNK):
        part, power = values[low : low + _CHUNK], powers[low : low + _CHUNK]
        if values.dtype == np.uint8:  # a byte times half a power stays far below 64 bits
            part = part.astype(np.uint64) + np.uint64(1)
            high, rest = np.cumsum(part * (power >> _30)), np.cumsum(part * (power & _LOW30))
        else:
            term = _product(_reduced(part.copy()), power)
            high, rest = np.cumsum(term >> _30), np.cumsum(term & _LOW30)
        # high * 2**30 modulo PRIME is a rotation of 61 bits
        high = _reduced(high)
        total = (high & _LOW31) << _30
        total += high >> _31
        total = _reduced(total)
        total += _reduced(rest)
        total += carry
        out[low + 1 : low + 1 + len(part)] = _reduced(total)
        carry = out[low + len(part)]
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of values[starts:ends], equal for equal runs of values wherever they stand."""
    _, inverses = _prime_geometric(len(prefix))
    return mix(_product(_reduced(prefix[ends] + _P - prefix[starts]), inverses[starts]))


def run_hash(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of the given (small) width, mixed value by value."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = mix(out * MULTIPLIER + values[k : k + n])
    return out


def _geometric(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of MULTIPLIER and of its inverse modulo 2**64, kept between calls."""
    global _powers, _inverses
    while len(_powers) < n:
        step, back = np.uint64(pow(int(MULTIPLIER), len(_powers), 1 << 64)), np.uint64(pow(int(_INVERSE), len(_inverses), 1 << 64))
        _powers, _inverses = np.concatenate([_powers, _powers * step]), np.concatenate([_inverses, _inverses * back])
    return _powers[:n], _inverses[:n]


def rolling_grams(values: np.ndarray, width: int) -> np.ndarray:
    """Mixed rolling hashes (modulo 2**64) of all runs of the given width. Fast, but structured texts can
    make unequal runs equal: they choose positions and buckets, and never say that texts are equal."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    powers, inverses = _geometric(len(values) + 1)
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers[: len(values)], out=prefix[1:])
    return mix((prefix[width:] - prefix[:n]) * inverses[:n])


def flat(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and the offsets of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or buffers[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    raw = memoryview(buffers[2])[offsets[0] : offsets[-1]]
    data = np.frombuffer(bytes(raw).translate(LOWER_ASCII) if lower else raw, dtype=np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of texts that hold at most so many bytes together (one text may hold more)."""
    out, first = [], 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        out.append((first, last))
        first = last
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in data, and the index of the first word of each text (one more at the end)."""
    solid = np.ones(len(data) + 2, dtype=bool)
    solid[0] = solid[-1] = False
    np.logical_not(SPACE[data], out=solid[1:-1])
    edge = solid[1:] & ~solid[:-1]
    edge_end = solid[:-1] & ~solid[1:]
    # a word also ends where its text ends
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    cut = inner[solid[inner] & solid[inner + 1]]
    edge[cut] = True
    edge_end[cut] = True
    starts, ends = np.flatnonzero(edge), np.flatnonzero(edge_end)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words: eight bytes after eight are mixed in, of all words that still have some. Words
    longer than LONG_WORD are hashed modulo PRIME instead, which takes no step for each eight bytes."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * MULTIPLIER)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    rows, at = np.flatnonzero(size <= LONG_WORD), 0
    while len(rows):
        chunk = eight[starts[rows] + at] & _FIRST[np.minimum(size[rows] - at, 8)]
        out[rows] = mix((out[rows] ^ chunk) * MULTIPLIER)
        at += 8
        rows = rows[size[rows] > at]
    rows = np.flatnonzero(size > LONG_WORD)
    if len(rows):
        out[rows] = long_word_hashes(data, starts[rows], ends[rows])
    return out


def long_word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """range_hash() of the words, a piece of the data at a time; a word longer than a piece is hashed in parts."""
    out, i = [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + piece, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        if high - low <= piece:
            out.append(range_hash(prefix_hash(data[low:high]), starts[i:j] - low, ends[i:j] - low))
        else:
            total = 0
            for at in range(low, high, piece):
                total += int(prefix_hash(data[at : min(high, at + piece)])[-1]) * pow(_BASE, at - low, PRIME)
            out.append(mix(np.array([total % PRIME], dtype=np.uint64)))
        i = j
    return np.concatenate(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of the given width, from prefix and suffix minima of blocks."""
    n = len(x)
    if n < width:
        return x[:0]
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])
