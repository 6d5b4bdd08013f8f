"""Vectorised hashing of the words of many texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

_RANDOM = np.random.default_rng(20240229)
FACTORS = _RANDOM.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
#: whether a byte belongs to a word: all but ASCII white space; or ASCII letters, digits and all beyond ASCII
NOT_SPACE = ~np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
ALPHANUMERIC = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_TAILS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)      # masks of the first k bytes
LONG = 256              # words of more bytes are hashed one by one


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts, in order, and where each
    text's words begin (one more number than texts).

    A word is taken eight bytes at a time and the hash is mixed after each
    piece, so words of up to eight bytes and equal length never collide and
    the order of the bytes leaves no algebraic trace."""
    joined = b" ".join(texts) + b" " + bytes(8)
    eight = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))
    word = np.r_[False, in_word[np.frombuffer(joined, np.uint8, len(joined) - 8)]]
    starts = np.flatnonzero(word[1:] & ~word[:-1])
    ends = np.flatnonzero(word[:-1] & ~word[1:])
    sizes = ends - starts
    hashes = mix(sizes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    longest = min(int(sizes.max(initial=0)), LONG)
    for at in range(0, longest, 8):
        live = np.flatnonzero((sizes > at) & (sizes <= LONG))
        piece = eight[starts[live] + at] & _TAILS[np.minimum(sizes[live] - at, 8)]
        hashes[live] = mix(hashes[live] ^ piece)
    for i in np.flatnonzero(sizes > LONG):
        hashes[i] = xxhash.xxh3_64_intdigest(joined[starts[i]:ends[i]])
    return hashes, np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))


def blocks(texts: Iterable[bytes], size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Texts in lists of about ``size`` bytes (a longer text by itself)."""
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > size:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t) + 1
    if held:
        yield held
