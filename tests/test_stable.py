import itertools
import random

import pytest

from kinweave.operators.align import deferred_acceptance, stable_pairs

# fixed values: the preference lists of the original test, three words against five
A = [[0, 2, 1, 3, 4], [4, 2, 1, 0, 3], [1, 4, 2, 3, 0]]
B = [[1, 0, 2], [1, 2, 0], [0, 1, 2], [0, 2, 1], [2, 0, 1]]


def is_stable(pairs, left, right):
    of_l, of_r = dict(pairs), {r: l for l, r in pairs}
    for l, order in enumerate(left):
        for r in order:
            if l not in right[r]:
                continue
            better_l = l not in of_l or order.index(r) < order.index(of_l[l])
            better_r = r not in of_r or right[r].index(l) < right[r].index(of_r[r])
            if better_l and better_r:
                return False
    return True


def test_three_against_five():
    pairs = deferred_acceptance(A, B)
    assert len(pairs) == 3 and is_stable(pairs, A, B)
    assert sorted((l, r) for r, l in deferred_acceptance(B, A)) == pairs  # the shorter side asks either way


@pytest.mark.parametrize("partial", [False, True])
def test_no_blocking_pair_and_best_for_the_askers(partial):
    rng = random.Random(1)
    for _ in range(150):
        n, m = rng.randint(0, 4), rng.randint(0, 5)
        left = [rng.sample(range(m), rng.randint(0, m) if partial else m) for _ in range(n)]
        right = [rng.sample(range(n), rng.randint(0, n) if partial else n) for _ in range(m)]
        pairs = deferred_acceptance(left, right)
        assert is_stable(pairs, left, right)
        assert len({l for l, _ in pairs}) == len(pairs) == len({r for _, r in pairs})
        if partial or n > m:
            continue
        of = dict(pairs)
        for chosen in itertools.permutations(range(m), n):  # no stable matching gives an asker a better partner
            other = list(enumerate(chosen))
            if is_stable(other, left, right):
                assert all(left[l].index(of[l]) <= left[l].index(r) for l, r in other)


def test_rows(spark):
    df = spark.createDataFrame([(1, A, B), (2, None, B), (3, [], []), (4, [[0]], [[]])], "id long, l_pref array<array<int>>, r_pref array<array<int>>")
    got = sorted(tuple(r) for r in stable_pairs(df).collect())
    assert got == [(1, *p) for p in deferred_acceptance(A, B)]
