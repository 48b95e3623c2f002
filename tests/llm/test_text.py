import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import vectext as V

FOLD = bytes(V.FOLD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" abAB\n\té\x0b.", max_size=30)), max_size=20))
def test_words_are_the_pattern_s_words(texts):
    data, offsets = V.utf8(pa.array(texts, pa.string()))
    h, start, end, row = V.words(data, offsets)
    got = [[] for _ in texts]
    for x, a, b, r in zip(h, start, end, row, strict=True):
        got[r].append((bytes(data[a:b]).translate(FOLD), int(x)))
    names: dict = {}
    for text, found in zip(texts, got, strict=True):
        want = [w.translate(FOLD) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
        assert [w for w, _ in found] == want
        for w, x in found:
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


def test_long_texts_are_cut_at_separators(monkeypatch):
    monkeypatch.setattr(V, "SLICE", 16)
    text = " ".join("w%d" % i for i in range(200)) + " " + "x" * 500
    data, offsets = V.utf8(pa.array([text, "end"]))
    h, _, _, row = V.words(data, offsets)
    assert len(h) == 202 and row[-1] == 1 and len(set(h.tolist())) == 202


@pytest.mark.parametrize("n", [1, 2, 5])
def test_ngrams_stay_inside_texts(n):
    rng = random.Random(n)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    data, offsets = V.utf8(pa.array(texts))
    g, row = V.ngrams(data, offsets, n, 20)
    seen: dict = {}
    want = [(i, t[k : k + n]) for i, t in enumerate(texts) for k in range(len(t) - n + 1)]
    assert row.tolist() == [i for i, _ in want]
    for x, (_, gram) in zip(g.tolist(), want, strict=True):
        assert seen.setdefault(gram, x) == x


def test_no_rows():
    data, offsets = V.utf8(pa.array([], pa.string()))
    assert len(V.words(data, offsets)[0]) == 0 and list(V.slices(offsets)) == []
    assert np.all(V.utf8(pa.chunked_array([], pa.string()))[1] == 0)
