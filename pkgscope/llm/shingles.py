"""Hashes of words and of word runs, computed with numpy inside tasks."""

from __future__ import annotations

import re

import numpy as np

WORDS = re.compile(r"\w+")
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


LANE, LONG = 8, 256
MASKS = np.array([(1 << 8 * n) - 1 for n in range(LANE + 1)], np.uint64)


class WordHashes(dict):
    """word to 64-bit hash, kept while the cache is small."""

    def __missing__(self, word):
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list) -> np.ndarray:
        if len(self) > 200_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(texts):
    """The words of an Arrow array of texts in one Arrow array, and how many each text has; null texts have none."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    # White space at an end of a text leaves an empty word there.
    full = pc.greater(pc.binary_length(words), 0)
    if full.false_count:
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[full.to_numpy(zero_copy_only=False)], minlength=len(sizes))
        words = words.filter(full)
    return words, sizes


def word_hashes(words) -> np.ndarray:
    """64-bit hashes of an Arrow array of large strings: 8 bytes of all words at a time, words over LONG bytes one by one."""
    import xxhash

    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    if not len(words) or ends[0] == ends[-1]:
        return mix(np.zeros(len(words), np.uint64))
    size, start, length = int(ends[-1] - ends[0]), ends[:-1] - ends[0], np.diff(ends)
    data = np.zeros(size + LANE, np.uint8)
    data[:size] = np.frombuffer(words.buffers()[2], np.uint8, size, int(ends[0]))
    # The 8 bytes from each byte on.
    lanes = np.ndarray(size + 1, np.dtype("<u8"), data, strides=(1,))
    out = mix(mix(length.astype(np.uint64)) * B + (lanes[start] & MASKS[np.minimum(length, LANE)]))
    at, done = np.flatnonzero((length > LANE) & (length <= LONG)), LANE
    while len(at):
        out[at] = mix(out[at] * B + (lanes[start[at] + done] & MASKS[np.minimum(length[at] - done, LANE)]))
        done += LANE
        at = at[length[at] > done]
    for i in np.flatnonzero(length > LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + length[i]])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * A
    x = (x ^ (x >> np.uint64(29))) * B
    return x ^ (x >> np.uint64(32))


def runs(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words at each start, by doubling."""
    if n == 1:
        return w
    if len(w) < n:
        return w[:0]
    half = 1 << ((n - 1).bit_length() - 1)
    left = runs(w, half)
    right = left if n == 2 * half else runs(w, n - half)
    keep = len(w) - n + 1
    return mix(left[:keep] * B + right[half : half + keep] + np.uint64(n))


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n neighbours, by doubling."""
    if len(x) < n:
        return x[:0]
    step = 1
    out = x
    while step * 2 <= n:
        out = np.minimum(out[: len(out) - step], out[step:])
        step *= 2
    keep = len(x) - n + 1
    return np.minimum(out[:keep], out[n - step : n - step + keep])


def shingle_set(hashes: WordHashes, text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles; a text of fewer words is one shingle."""
    words = WORDS.findall((text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(runs(hashes.of(words), min(n, len(words))))


def least_at(x: np.ndarray, n: int) -> np.ndarray:
    """Place of the minimum of each n neighbours, the leftmost of equal ones, by doubling."""
    if len(x) < n:
        return np.empty(0, np.int64)
    at, step = np.arange(len(x)), 1

    def lower(left, right):
        return np.where(x[right] < x[left], right, left)

    while step * 2 <= n:
        at = lower(at[: len(at) - step], at[step:])
        step *= 2
    keep = len(x) - n + 1
    return lower(at[:keep], at[n - step : n - step + keep])
