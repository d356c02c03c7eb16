"""The fragments of a text that weigh most, against a plain account of them."""

import numpy as np
import pyarrow as pa

from mailsift.operators import models


def test_the_heaviest_fragments_of_a_text():
    n = 1 << 10
    idf, w = np.random.default_rng(3).random((2, n))
    idf[:100], w = 0.0, w - 0.5
    text = "Verify your account now, verify it"
    at: dict[int, str] = {}
    for k, found in zip(models.FRAGMENTS, models._places(text.lower(), n), strict=True):
        for i, p in enumerate(found):
            at[int(p)] = min(at.get(int(p), text.lower()[i : i + k]), text.lower()[i : i + k])
    length = sum(idf[p] ** 2 for p in at) ** 0.5
    want = sorted((-abs(w[p] * idf[p] / length), t) for p, t in at.items() if idf[p] > 0)
    for k in (1, 5, 10_000):
        got = models._heaviest(text, idf, w, k)
        assert [(x["term"], x["place"]) for x in got] == [(t, i) for i, (_, t) in enumerate(want[:k], 1)]
        assert np.allclose([-abs(x["contribution"]) for x in got], [s for s, _ in want[:k]])
    assert models._heaviest(None, idf, w, 3) == [] == models._heaviest("ab", idf, w, 3)
    assert pa.array([got[:2]], models._SHARES).to_pylist() == [got[:2]]


def test_short_and_long_texts_have_their_distinct_places_in_order():
    for n in (1 << 10, 1000):
        for text in ("ab", "", "verify it, verify it", "your account now " * 40, None):
            got = models._vectors(pa.array([text, "abcd"], pa.string()), pa.array([n, n], pa.int32()))[0].as_py()
            assert got["indices"] == sorted({int(p) for found in models._places(text or "", n) for p in found}) and got["values"] == [1.0] * len(got["indices"])


def test_places_are_remainders_whatever_the_number_of_features():
    whole = models._places("verify", 1 << 31)
    for n in (1 << 18, 1 << 10):
        assert all((a.astype(np.int64) % n == b).all() for a, b in zip(whole, models._places("verify", n), strict=True))
