"""Words are compared in small steps and in full only where enough letters match."""
import random

import numpy as np
import pyarrow as pa

from kinweave.functions.strings import WordTable, jaro_winkler
from kinweave.operators import similarity as S


def test_a_pair_with_too_few_matches_is_not_compared_in_full():
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abcdefgh", k=rng.randint(1, 12))) for _ in range(200)} | {"x" * 64, "ab" * 32})
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    want = np.round(jaro_winkler([words[k] for k in i], [words[k] for k in j]), 9)
    for t in (0.0, 0.6, 0.75, 0.9):
        got = np.round(WordTable(words).similarity(i, j, t), 9)
        assert np.array_equal(got[want >= t], want[want >= t]) and (got[want < t] < t).all()
        assert t < 0.6 or (got == -1).mean() > 0.5


def test_steps_do_not_change_edges(monkeypatch):
    rng = random.Random(3)
    sides = [pa.array([["".join(rng.choices("abcde", k=rng.randint(1, 7))) for _ in range(n)] for n in (0, 300, 5, 120)]) for _ in range(2)]
    whole = S.word_edges(*sides, 0.6, jaro_winkler)
    monkeypatch.setattr(S, "STEP_CELLS", 1000)
    small = S.word_edges(*sides, 0.6, jaro_winkler, cells=50_000)
    for c in ("row", "k", "l", "r"):
        assert np.array_equal(getattr(whole, c), getattr(small, c))
