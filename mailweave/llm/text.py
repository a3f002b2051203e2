"""Vectorised word and byte-window fingerprints shared by the corpus operators.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``. Fingerprints are
64-bit polynomial hashes modulo 2**64 over a table of pseudo-random byte codes,
taken from prefix sums, so that a whole buffer costs a few numpy passes.
"""

from __future__ import annotations

import ctypes
import hashlib
import struct
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK = 1 << 20
#: Integers that passes over an array take at a time, so that they stay in a core's cache.
CACHED = 1 << 14

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    out = x.astype(U64, copy=True)
    for i in range(0, len(out), CACHED):
        x = out[i : i + CACHED]
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return out


CODES = mix(np.arange(1, 257, dtype=U64) * U64(BASE)) | U64(1)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, BLOCK + 1)
        up, down = np.full(m, BASE, U64), np.full(m, INVERSE, U64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        if n > 8 * BLOCK:
            return up, down
        _POWERS[:] = [up, down]
    return _POWERS[0], _POWERS[1]


def prefix(a: np.ndarray) -> np.ndarray:
    """Prefix sums of code * BASE**i, one longer than ``a``."""
    out = np.zeros(len(a) + 1, U64)
    np.cumsum(CODES[a] * powers(len(a) + 1)[0][: len(a)], out=out[1:])
    return out


def word_hashes(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, start and end of every word of ``buf``, in order."""
    a = np.frombuffer(buf, np.uint8)
    hashes, starts, ends = [], [], []
    i, n = 0, len(a)
    while i < n:
        j = min(n, i + BLOCK)
        if j < n:
            cut = np.flatnonzero(WHITE[a[i:j]])
            if len(cut):
                j = i + int(cut[-1]) + 1
            else:
                while j < n and not WHITE[a[j]]:
                    j += 1
        x = a[i:j]
        solid = np.zeros(len(x) + 2, np.int8)
        solid[1:-1] = ~WHITE[x]
        edge = np.diff(solid)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        p = prefix(x)
        hashes.append(mix((p[e] - p[s]) * powers(len(x) + 1)[1][s]))
        starts.append(s + i)
        ends.append(e + i)
        i = j
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


#: 1 for the bytes of words; and masks of the lowest bytes of an integer.
_IN_WORD = bytes(b not in b"\x20\t\n\x0b\x0c\r" for b in range(256))
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Words of more bytes are hashed one at a time.
LONG_WORD = 64


def word_keys(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`word_hashes`, with another hash that reads words by 8 bytes; for words that are only compared with one another."""
    solid = np.frombuffer(b"\0" + buf.translate(_IN_WORD) + b"\0", bool)
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    s, e = edge[::2], edge[1::2]
    a = np.frombuffer(buf + bytes(16 - len(buf) % 8), "<u8")
    n = e - s

    def load(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        i, shift = at >> 3, (at.astype(U64) & U64(7)) << U64(3)
        return ((a[i] >> shift) | ((a[i + 1] << (U64(63) - shift)) << U64(1))) & _LOWEST[np.minimum(size, 8)]

    h = mix(load(s, n) * U64(BASE) + n.astype(U64))
    rest = np.flatnonzero((n > 8) & (n <= LONG_WORD))
    at = 8
    while len(rest):
        h[rest] = mix(h[rest] * U64(BASE) + load(s[rest] + at, n[rest] - at))
        at += 8
        rest = rest[n[rest] > at]
    for i in np.flatnonzero(n > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[s[i] : e[i]], digest_size=8).digest(), "little")
    return h, s, e


def ranked(keys: np.ndarray, bits: int = 64) -> np.ndarray:
    """The stable order of unsigned ``keys`` below 2**bits: sorted as integers that hold their places in the lowest bits."""
    width = max(len(keys) - 1, 1).bit_length()
    drop = U64(max(bits + width - 64, 0))
    order = np.sort(((keys >> drop) << U64(width)) | np.arange(len(keys), dtype=U64))
    order = (order & U64((1 << width) - 1)).view(np.int64)
    if drop:
        found = keys[order]
        if (found[1:] < found[:-1]).any():  # two that differ in the dropped bits alone
            return np.argsort(keys, kind="stable")
    return order


_GIVEN_BACK = [0.0]


def give_back(every: float = 0.0) -> None:
    """Return freed memory to the system, at most once in so many seconds: a worker that idles beside others keeps what it once held."""
    if time.monotonic() - _GIVEN_BACK[0] >= every:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
        _GIVEN_BACK[0] = time.monotonic()


def join_texts(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """All texts with a newline after each, and the offset at which each begins (one more at the end)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return b"\n".join(texts) + b"\n" if texts else b"", at


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word fingerprints of all texts in order, and where each text's words begin (one more at the end)."""
    buf, at = join_texts(texts)
    h, s, _ = word_hashes(buf)
    return h, np.searchsorted(s, at)


def window_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A fingerprint of every k consecutive words; empty when there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, (seed * BASE + k) & 0xFFFFFFFFFFFFFFFF, U64)
    for i in range(k):
        out = out * U64(BASE) + h[i : i + n]
    return mix(out)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd-compressed block; each is stored by byte planes, which compress well."""
    import zstandard

    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
        out.append(struct.pack("<3sxQ", a.dtype.str[-2:].encode().ljust(3), len(a)) + raw)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack_arrays(block: bytes) -> list[np.ndarray]:
    """The arrays of :func:`pack_arrays`."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(block)
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        kind, size = struct.unpack_from("<3sxQ", raw, at)
        at += 12
        t = np.dtype(kind.decode().strip())
        planes = np.frombuffer(raw, np.uint8, size * t.itemsize, at).reshape(t.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(t))
        at += size * t.itemsize
    return out


def delta(keys: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, its first value first."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def small(a: np.ndarray) -> np.ndarray:
    """The same non-negative integers in the narrowest unsigned type."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_slices(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts have about ``limit`` bytes together; a longer text stands alone."""
    i = size = 0
    for j, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield i, j
            i, size = j, 0
        size += len(t) + 1
    if i < len(texts):
        yield i, len(texts)
