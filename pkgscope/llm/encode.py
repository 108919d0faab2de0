"""Exact token ids by a public tokenizer, encoded once per distinct word of a slice of texts."""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np

CACHE_WORDS = 250_000
SLICE_BYTES = 2_000_000
# Classes of bytes, fixed values: the vocabulary's own word pattern, restated for lower-cased ASCII and Latin-1 letters.
SPACE, LETTER, DIGIT, MARK, LEAD, ODD = range(6)
CLASS = np.full(256, ODD, np.uint8)
CLASS[[0x20, 0x0A]], CLASS[0x21:0x7F], CLASS[0x30:0x3A], CLASS[0xC3] = SPACE, MARK, DIGIT, LEAD
LOW = np.arange(256, dtype=np.uint8)
for first in (0x41, 0x61):
    CLASS[first : first + 26] = LETTER
LOW[0x41:0x5B] += 32


class WordEncoder:
    """Encodes Arrow arrays of texts with ``tokenizers`` through a bounded cache of words.

    The vocabulary drops white space before it merges, so a text's ids are those of its chunks
    between spaces and newlines, one after the other. Plain chunks (ASCII and Latin-1 letters, which
    normalisation only lower-cases) are split into words here, by the classes of their bytes, and meet
    the merges alone; all others go through the whole tokenizer.
    """

    def __init__(self, vocabulary: str):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        parts = json.loads(self.whole.to_str())
        parts |= {"normalizer": None, "added_tokens": [], "post_processor": None}
        parts["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.merges = Tokenizer.from_str(json.dumps(parts))
        self.cache: dict[str, bytes] = {}

    def _encode(self, tokenizer, strings: list[str], into: dict[str, bytes]) -> None:
        for at in range(0, len(strings), 4096):
            part = strings[at : at + 4096]
            for s, found in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                into[s] = array("I", found.ids).tobytes()

    def _ids_of(self, words: list[str], odd: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of distinct words; the odd ones among them go through the whole tokenizer."""
        if len(self.cache) > CACHE_WORDS:
            # What these texts share with earlier ones stays; words of one place go.
            self.cache = {w: self.cache[w] for w in words if w in self.cache}
        cache, more = self.cache, {}
        self._encode(self.whole, odd, more)
        self._encode(self.merges, [w for w in words if w not in cache and w not in more], cache)
        return [more[w] if w in more else cache[w] for w in words] if more else [cache[w] for w in words]

    def slices(self, texts):
        """(ids, ends) of neighbouring texts at a time: all their ids as one array, and where each text's ids end. Null texts count as empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            low = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, low + SLICE_BYTES, "right")))
            # Texts lie end to end, with a space after each.
            joined = pc.binary_join_element_wise(texts[at:to], *(pa.scalar(x, pa.large_string()) for x in ("", " ")))
            text_ends = size[at:to] - low + np.arange(1, to - at + 1)
            raw = np.frombuffer(joined.buffers()[2], np.uint8)[: text_ends[-1]]
            data, starts, odd, first_of = split_words(raw, text_ends)
            offsets = pa.py_buffer(np.append(starts, len(data)))
            words = pa.LargeStringArray.from_buffers(len(starts), offsets, pa.py_buffer(data)).dictionary_encode()
            which = words.indices.to_numpy()
            strings = words.dictionary.to_pylist()
            found = self._ids_of(strings, [strings[i] for i in np.unique(which[odd]).tolist()])
            flat, lengths = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
            first = np.cumsum(lengths) - lengths
            each = lengths[which]
            after = np.cumsum(each)
            # 32 bits: a slice holds one text or SLICE_BYTES, and a text of 2 GB does not fit a row.
            ids = flat[np.repeat((first[which] - (after - each)).astype(np.int32), each) + np.arange(after[-1] if len(after) else 0, dtype=np.int32)]
            yield ids, np.concatenate([[0], after])[first_of]
            at = to


def split_words(raw: np.ndarray, text_ends: np.ndarray):
    """(bytes of the words of UTF-8 texts, where each begins, numbers of odd chunks, words before each text's end).

    A word is a contraction, a run of letters, one digit or a run of other marks, in lower case; an odd chunk stays whole and as it is.
    """
    kind, n = CLASS[raw], len(raw)
    low = LOW[raw]
    lead = np.flatnonzero(kind == LEAD)
    # A lead byte of Latin-1 letters and the byte after it, which valid UTF-8 always has.
    if len(lead):
        second = raw[lead + 1]
        kind[lead] = kind[lead + 1] = np.where((second == 0x97) | (second == 0xB7), MARK, LETTER)
        low[lead + 1] = np.where((second < 0x9F) & (second != 0x97), second + 32, second)
    bad = kind == ODD
    bad[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
    new = np.empty(n, bool)
    new[:1], new[1:] = True, (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    quote = np.flatnonzero((raw == 0x27) & new)
    if len(quote):
        end = np.append(low, np.zeros(3, np.uint8))
        one, two = end[quote + 1], end[quote + 2]
        long = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        short = quote[np.isin(one, (0x73, 0x74, 0x6D, 0x64))]
        new[np.concatenate([short, quote[long]]) + 1] = False
        for after in (short + 2, quote[long] + 3):
            new[after[after < n]] = True
    space = kind == SPACE
    if bad.any():
        begins = np.flatnonzero(~space & np.append(True, space[:-1]))
        chunk = np.cumsum(~space & np.append(True, space[:-1])) - 1
        own = np.zeros(len(begins), bool)
        own[chunk[bad]] = True
        inside = ~space & own[np.maximum(chunk, 0)]
        low[inside], new[inside] = raw[inside], False
        new[begins[own]] = True
        marks = begins[own]
    else:
        marks = np.empty(0, np.int64)
    new &= ~space
    # Places in the bytes without the spaces.
    place = np.cumsum(~space, dtype=np.int64)
    count = np.concatenate([[0], np.cumsum(new, dtype=np.int64)])
    return low[~space], place[new] - 1, count[marks], count[np.minimum(text_ends, n)]


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> WordEncoder:
    """The worker's encoder, kept from task to task."""
    return WordEncoder(vocabulary)
