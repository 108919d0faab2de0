"""Words are split as the vocabulary splits them, and each distinct one is met once."""

import random

import numpy as np
import pyarrow as pa

from pkgscope.llm import encode, queries


def test_encoder_meets_each_distinct_word_once(monkeypatch):
    own = encode.WordEncoder(queries.vocabulary())
    seen, of = [], own._ids_of
    monkeypatch.setattr(own, "_ids_of", lambda words, *more: seen.extend(words) or of(words, *more))
    list(own.slices(pa.array(["Word, word. WORD! word; (word) word's"])))
    # Chunks like `word,` are no entries of their own.
    assert sorted(seen) == sorted({"word", ",", ".", "!", ";", "(", ")", "'s"})


def test_encoder_on_random_characters():
    rng = random.Random(1)
    marks = list("aAbsSdDtTmrRevVlLE'''''  \n09-<|>,.éÉß×÷ÀÿþÐ µİ中K’\t\x7f\x00́\r\U0001f600")
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(30))) for _ in range(5000)] + [None, "", "'", "x'", "<", "|"]
    own = encode.encoder(queries.vocabulary())
    got = [x.tolist() for ids, ends in own.slices(pa.array(texts)) for x in np.split(ids, ends[:-1])]
    assert got == [x.ids for x in own.whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]
