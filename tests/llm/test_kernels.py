"""Array kernels against plain versions."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.llm import near, substrings
from framewright.llm.common import WordHash, gram_hashes, mix64
from framewright.llm.quality import covered, repeats


@given(st.lists(st.integers(0, 3), max_size=40))
@settings(max_examples=150, deadline=None)
def test_repeats(w):
    twice, best = repeats(np.array(w, np.int64))
    n = len(w)
    for i in range(n):
        longest = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            longest = max(longest, k)
        assert best[i] == (longest if longest >= 3 else 0) and twice[i] == (longest >= 3)


def test_repeats_of_many_numbers():
    w = np.concatenate([np.arange(2**21 + 5), np.arange(100)])
    _, best = repeats(w)
    assert best[0] == 100 and best[-100] == 100 and best[200] == 0


def test_covered():
    assert covered(np.array([0, 1, 5]), np.array([2, 2, 1]), 7).tolist() == [True, True, True, False, False, True, False]


def test_gram_hashes():
    x = np.random.default_rng(0).integers(0, 2**63, 120).astype(np.uint64)
    for n in (1, 5, 9, 13, 50):
        want = [sum(int(x[i + k]) * 0x9E3779B97F4A7C15 ** (n - 1 - k) for k in range(n)) % 2**64 for i in range(120 - n + 1)]
        assert (gram_hashes(x, n) == mix64(np.array(want, np.uint64))).all()
    assert not len(gram_hashes(x[:3], 5))


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 100, 60)
    for n in (1, 2, 7, 38):
        assert substrings.sliding_min(x, n).tolist() == [x[i : i + n].min() for i in range(60 - n + 1)]


def test_signatures_estimate_similarity():
    r = np.random.default_rng(2)
    a = r.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:700], r.integers(0, 2**63, 300).astype(np.uint64)])
    s = near.signatures(np.concatenate([a, b]), np.array([0, 1000]), 512)
    assert abs((s[0] == s[1]).mean() - 700 / 1300) < 0.08
    same = near.band_keys(near.signatures(np.concatenate([a, a[::-1]]), np.array([0, 1000]), 20), 4, 5)
    assert (same[0] == same[1]).all()


def test_shingles():
    known = WordHash()
    assert not len(near.shingles(None, known)) and not len(near.shingles(b" \n", known))
    assert len(near.shingles(b"a b c", known)) == 1
    assert near.shingles(b"a b c", known) != near.shingles(b"c b a", known)
    assert (near.shingles(b"A b C d E f", known) == near.shingles(b"a B c D e F", known)).all()
