"""Whole texts as numpy arrays: words through Arrow's kernels, 64-bit word and shingle hashes, spans per document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M1, _M2, _R = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def hash_strings(values: pa.StringArray) -> np.ndarray:
    """64-bit hashes of the strings' bytes, vectorised: sums of byte weights times powers of an odd multiplier."""
    values = values.cast(pa.large_binary())
    if not len(values):
        return np.zeros(0, np.uint64)
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    sizes = np.diff(ends)
    starts = ends[:-1] - ends[0]
    powers = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, _R))
    out = sizes.astype(np.uint64) * _M2
    some = np.flatnonzero(sizes)
    if len(some):
        at = np.arange(len(raw)) - np.repeat(starts, sizes)
        out[some] += np.add.reduceat(_TABLE[raw] * powers[at], starts[some])
    return mix(out)


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxhash64(*columns: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64() gives for long columns, as unsigned values."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of XXH64
    h: np.ndarray = np.full(len(columns[0]), 42, np.uint64)
    for x in columns:
        h = (h + p5 + np.uint64(8)) ^ (_rotl(x * p2, 31) * p1)
        h = _rotl(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h ^= h >> np.uint64(32)
    return h


class Words:
    """The words of a batch of texts.

    code: per word its index in vocabulary (distinct words, as an Arrow array); starts: first word of each
    document, with the total at the end.  Null texts have no words.
    """

    def __init__(self, texts: pa.Array, lower: bool):
        texts = pc.fill_null(texts, "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        # take() makes the offsets begin at 0, which ascii_lower relies on
        texts = texts.cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        offsets = split.offsets.to_numpy().astype(np.int64)
        flat = split.values.slice(offsets[0], offsets[-1] - offsets[0])
        coded = flat.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        vocabulary = coded.dictionary
        blank = pc.index(vocabulary, pa.scalar("", vocabulary.type)).as_py()
        starts = offsets - offsets[0]
        if blank >= 0:  # texts that begin or end with white space, and empty ones
            real = code != blank
            starts = np.concatenate([[0], np.cumsum(real)])[starts]
            code = code[real]
        self.code, self.vocabulary, self.starts = code, vocabulary, starts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def doc(self) -> np.ndarray:
        """Per word the index of its document."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """Per word its 64-bit hash."""
        return hash_strings(self.vocabulary)[self.code]


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k neighbours, for every start that has them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _R + h[j : n + j]
    return mix(out)


def inside(starts: np.ndarray, k: int) -> np.ndarray:
    """The starts of the k-word windows that lie inside one document, in order."""
    n = int(starts[-1])
    if n < k:
        return np.zeros(0, np.int64)
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(n)
    return np.flatnonzero(left >= k)


def shingles(words: Words, k: int, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each k-word window; a shorter document that has words gives one of its whole sequence."""
    h = words.hashes() if h is None else h
    doc = words.doc()
    at = inside(words.starts, k)
    values, docs = (rolling(h, k)[at] if len(at) else np.zeros(0, np.uint64)), doc[at]
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        sums = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short):
            x = np.uint64(int(counts[d]))
            for v in h[words.starts[d] : words.starts[d + 1]]:
                x = mix(np.array([x * _R + v], np.uint64))[0]
            sums[i] = x
        values, docs = np.concatenate([values, sums]), np.concatenate([docs, short])
        order = np.argsort(docs, kind="stable")
        values, docs = values[order], docs[order]
    return docs, values
