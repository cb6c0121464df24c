"""Word hashing against plain Python."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from candlespark.llm import common
from candlespark.llm.common import runs, shingles, tables, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \t\n\x0b\xa0 .", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from([1, 5, 1 << 20]))
def test_words_and_shingles(texts, limit):
    t, seen = tables(), {}
    for a, b, data, bounds in runs(pa.array(texts, pa.string()), limit):
        w = words(data, bounds, t)
        hashes, cut = shingles(w, 3)
        for k in range(b - a):
            own = slice(w.first[k], w.first[k + 1])
            want = (texts[a + k] or "").encode().split()
            assert [bytes(data[x:y]) for x, y in zip(w.start[own], w.end[own], strict=True)] == want
            low = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in want]
            sets = [tuple(low[i : i + 3]) for i in range(len(low) - 2)] or ([tuple(low)] if low else [])
            assert cut[k + 1] - cut[k] == len(sets)
            for x, h in zip(sets, hashes[cut[k] : cut[k + 1]].tolist(), strict=True):
                assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("sweep", [64, 1 << 20])
def test_long_words_cross_sweeps(monkeypatch, sweep):
    """A word longer than a sweep, and equal words in different sweeps, hash alike."""
    monkeypatch.setattr(common, "SWEEP", sweep)
    text = "a" * 500 + " b " + "x" * 70 + " b " + "a" * 500
    data = np.frombuffer(text.encode(), np.uint8)
    h = words(data, np.array([0, len(data)]), tables()).hash
    assert h[0] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 3
