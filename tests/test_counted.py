import numpy as np
from pyspark.sql import functions as F

from checks import queries as Q
from kinweave.operators import network as W
from kinweave.operators import scoring as N
from kinweave.operators.network import Network
from kinweave.operators.scale import durable


def test_copies_have_the_gradient_of_repeated_rows():
    rng = np.random.default_rng(0)
    net = Network.start(6, (5, 4, 3), seed=2)
    x, y, copies = rng.normal(size=(7, 6)), rng.random(7), np.array([1, 4, 2, 1, 9, 1, 3])
    every = np.repeat(np.arange(7), copies)
    drop = lambda size: (rng.random((len(every), size)) > 0.4) / 0.6
    for masks in ((), (None, drop(4), drop(3)), (drop(5),), (None, None, drop(3))):
        got, want = net.gradient(x, y, masks, copies), net.gradient(x[every], y[every], masks)
        assert abs(got[0] - want[0]) < 1e-9 and np.allclose(got[1], want[1])
    numbers = W.copy_numbers(np.array([5, -3]), np.array([3000, 2000]))
    assert len(set(numbers.tolist())) == 5000 and np.array_equal(numbers[:10], W.copy_numbers(np.array([5]), np.array([10])))


def test_equal_rows_are_stored_once_and_dealt_evenly(spark):
    rows = spark.createDataFrame([([1.0, 2.0], 0.5, 3), ([1.0, 2.0], 0.5, 20_000), ([1.0, 2.0], 1.0, 2), ([0.0, 0.0], 0.5, 1)],
                                 "x array<double>, y double, copies long")
    found = W.counted_rows(rows, 4).collect()
    batches = {}
    for r in found:
        assert 0 < r.copies <= W.BLOCK
        batches.setdefault((tuple(r.x), r.y), {}).setdefault(r.batch, []).append(r.copies)
    assert sorted(sum(batches[(1.0, 2.0), 0.5][b]) for b in range(4)) == [5000, 5001, 5001, 5001]
    assert sum(sum(c) for c in batches[(1.0, 2.0), 1.0].values()) == 2 == len(batches[(1.0, 2.0), 1.0])
    assert sum(sum(c) for c in batches[(0.0, 0.0), 0.5].values()) == 1
    assert len({r.row for r in found}) == len(found)
    one = lambda x, y, row, n: (float(n.sum()), np.array([float((n * y).sum())]))
    n, total, g = W._sums(W.counted_rows(rows, 4), one)
    assert n == total == 20_006 and g[0] == 10_004


def test_training_units_are_one_row_a_kind_with_the_labels_of_all_units(spark, sf_dir):
    kinds = Q.labelled_units(spark, sf_dir).cache()
    every = N.soft_labels(durable(Q.vector_units(spark, sf_dir)), vectors=True)
    keys = ["left_word", "right_word", "label", "label_corrected", "label_corrected_mean", (F.pmod("id", F.lit(5)) == 3).alias("valid")]
    want = {tuple(r)[:-1]: r.n for r in every.select(*keys).groupBy(*[k if isinstance(k, str) else "valid" for k in keys]).agg(F.count("*").alias("n")).collect()}
    got = {tuple(r)[:-1]: r.n for r in kinds.groupBy("left_word", "right_word", "label", "label_corrected", "label_corrected_mean", "valid").agg(
        F.sum("copies").alias("n")).collect()}
    assert got == want and kinds.count() < sum(want.values()) / 2
