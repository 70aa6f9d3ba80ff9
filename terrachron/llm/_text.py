"""Words and word shingles of texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_INSIDE = ~np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


class WordHashes(dict):
    """Hash of each word seen; forgets when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words(text: str | None) -> list[bytes]:
    """Words of [^\\x20\\x09-\\x0D]+, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _spans(texts: pa.Array):
    """UTF-8 bytes of all texts, nulls as empty, and where each begins and the last ends."""
    texts = texts.fill_null("" if pa.types.is_string(texts.type) else b"").cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    x = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return x[at[0] : at[-1]], at - at[0]


def portions(batch: pa.RecordBatch, most: int = 2_000_000):
    """Parts of a batch with at most so many bytes of column text, or one row."""
    at, a = _spans(batch["text"])[1] if len(batch) else None, 0
    while a < len(batch):
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def encoded(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(place, distinct, size): of all texts' words as in words(), each text closed by the empty word, the place among the distinct
    ones, and how many each text has."""
    x, at = _spans(texts)
    inside, edge = _INSIDE.take(x), np.ones(len(x) + 1, bool)
    edge[1:-1] = ~inside[:-1]
    edge[at] = True
    start = np.flatnonzero(inside & edge[:-1])
    edge[:-1] = ~inside
    edge[at] = True
    length = np.flatnonzero(inside & edge[1:]) + 1 - start
    size = np.diff(np.searchsorted(start, at)) + 1
    every = np.zeros(size.sum(), np.int32)
    every[np.arange(len(start)) + np.repeat(np.arange(len(size)), size - 1)] = length
    ends = np.concatenate([[0], np.cumsum(every, dtype=np.int64)]).astype(np.int32)
    got = pa.Array.from_buffers(pa.binary(), len(every), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER.take(x[inside]))]).dictionary_encode()
    return got.indices.to_numpy().astype(np.int64), got.dictionary, size


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of binary values."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_numpy(zero_copy_only=False)), np.uint64, len(words))


def slices_of(x: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes of consecutive slices of so many elements each."""
    ends = np.concatenate([[0], np.cumsum(size * x.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, k: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words, of the whole sequence; without words, empty."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))
    n = max(1, len(w) - k + 1)
    s = np.full(n, len(w) if len(w) < k else k, np.uint64)
    for i in range(min(k, len(w))):
        s = mixed(s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(s)
