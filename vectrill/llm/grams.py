"""Words and word sequences of UTF-8 texts in whole arrays.

Words are told apart by their bytes: Arrow's dictionary compares them in full. Their hashes
are XXH3, so no arithmetic of the letters makes two words meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text worked on at a time; one longer text is worked on alone.
BLOCK = 1_000_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all of them, one to one."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def blocks(texts: list[bytes], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `size` bytes."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (n == 0 or n + len(texts[j]) < size):
            n += len(texts[j]) + 1
            j += 1
        yield i, j
        i = j


def word_ids(texts: list[bytes], inside: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(a number for each word of all texts, the words by number, where each text's words begin and one more).

    inside: for each byte whether it belongs to words. A-Z are lower-cased.
    """
    buf = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    within = inside[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], within]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    at = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buf[within])])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist(), at


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def sequence_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive word hashes."""
    s = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(k):
            s = mix(s * _ODD + h[n : n + len(s)])
    return s


def sequence_ids(ids: np.ndarray, k: int) -> np.ndarray:
    """Numbers for each k consecutive ids: equal where the ids are, with no hash in between."""
    if k == 1:
        return ids
    a, b = sequence_ids(ids, k - k // 2), sequence_ids(ids, k // 2)
    n = max(len(ids) - k + 1, 0)
    a, b = a[:n], b[k - k // 2 : k - k // 2 + n]
    if not n:
        return a
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]
