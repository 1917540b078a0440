import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from paperloom.llm import words
from paperloom.llm.words import buffers, words_of

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def found(texts):
    data, offsets = buffers(pa.array(texts, pa.string()))
    w = words_of(data, offsets)
    raw = [lowered(data[s : s + n].tobytes().decode()) for s, n in zip(w.start, w.length, strict=True)]
    return w, [raw[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAzZ09 .\né–_`{", max_size=30)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    w, got = found(texts)
    assert got == [WORD.findall(lowered(t or "")) for t in texts]
    flat = [x for t in got for x in t]
    by_hash = dict(zip(w.hash.tolist(), flat, strict=True))
    assert [by_hash[h] for h in w.hash.tolist()] == flat and len(by_hash) == len(set(flat))


def test_words_across_pieces(monkeypatch):
    text = "ab cde " * 50 + "x" * 100 + " é" * 40
    whole, _ = found([text, "tail", text])
    monkeypatch.setattr(words, "PIECE", 16)
    cut, got = found([text, "tail", text])
    assert np.array_equal(whole.hash, cut.hash) and got == [WORD.findall(text), ["tail"], WORD.findall(text)]


def test_sliced_buffers():
    data, offsets = buffers(pa.array(["zero", "one two", None, "three"])[1:])
    assert words_of(data, offsets).count.tolist() == [2, 0, 1]
