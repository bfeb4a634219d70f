"""Word shingles as 64-bit hashes, for whole Arrow columns at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of anything but ASCII white space) of all texts, and the n + 1 bounds of each text's words."""
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    if lower:
        texts = pc.ascii_lower(texts)
    words = pc.ascii_split_whitespace(texts)
    coded = words.flatten().dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    bounds = words.offsets.to_numpy().astype(np.int64)
    hashes = table[coded.indices.to_numpy()] if len(table) else np.empty(0, np.uint64)
    hashes, bounds = hashes[bounds[0] : bounds[-1]], bounds - bounds[0]
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)  # split() gives these one empty word
    if empty.any():
        keep = np.ones(len(hashes), bool)
        keep[bounds[:-1][empty]] = False
        hashes = hashes[keep]
        bounds = np.append(0, np.cumsum(np.diff(bounds) - empty))
    return hashes, bounds


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; runs across texts are the caller's to skip."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, width):
        out *= PRIME
        out += hashes[j : j + n]
    return mixed_bits(out)


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct shingles of lower-cased words; the whole text is one if it is shorter, none if it has no words."""
    hashes, bounds = word_hashes(texts, True)
    runs = rolled(hashes, width)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(runs[a : b - width + 1])
            fresh = np.empty(len(own), bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            out.append(own[fresh])
        elif b > a:
            out.append(rolled(np.append(hashes[a:b], np.uint64(b - a)), b - a + 1))
        else:
            out.append(hashes[:0])
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
