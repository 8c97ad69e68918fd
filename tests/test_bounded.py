import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from checks import queries as Q
from kinweave.functions.strings import jaro_winkler
from kinweave.operators import contributions as K
from kinweave.operators import embedding as E
from kinweave.operators import features as A
from kinweave.operators import similarity as S
from kinweave.operators.align import Passes, Thresholds, _schema, matched_slots
from kinweave.operators.segments import Options
from kinweave.plans.datasets import document_pairs


def records(seed, n, words):
    rng = np.random.default_rng(seed)
    return pa.array([[f"w{int(x)}" + "ab" * int(x % 3) for x in rng.zipf(1.4, rng.integers(0, words)) % 40] for _ in range(n)], pa.list_(pa.string()))


def attributes(lists):
    return pa.array([["a" if i % 3 else "b" for i in range(len(x))] for x in lists.to_pylist()], pa.list_(pa.string()))


def test_edges_come_in_bands_and_match_the_same():
    left, right = records(1, 30, 60), records(2, 30, 60)
    la, ra = attributes(left), attributes(right)
    whole, small = S.word_pairs(left, right, 0.6, jaro_winkler), S.word_pairs(left, right, 0.6, jaro_winkler, cells=50)
    ties = np.bincount(np.unique(np.round(whole.k, 9), return_inverse=True)[1], weights=whole.uses).max()
    none = [np.zeros(len(side.place), bool) for side in (small.left, small.right)]
    bands = [len(row) for row, *_ in small.bands(-np.inf, np.inf, None, None, *none)]
    assert len(bands) > 20 and max(bands) <= 50 + ties and sum(bands) == len(whole.edges().k)
    place_by_place = whole.edges()
    for passes in (_schema(Thresholds()), Passes(many=0.75, first=0.6), Passes(many=0.85)):
        want = matched_slots(place_by_place, la, ra, passes)
        assert matched_slots(whole, la, ra, passes) == want and matched_slots(small, la, ra, passes) == want


def test_rows_worked_on_together_are_bounded():
    left, right = records(3, 200, 30), records(4, 200, 30)
    size = S.bounds(left)[1] * S.bounds(right)[1]
    blocks = list(S.row_blocks(left, right, 500))
    assert [b.start for b in blocks[1:]] == [b.stop for b in blocks[:-1]] and blocks[0].start == 0 and blocks[-1].stop == 200
    assert all(b.stop - b.start == 1 or np.maximum(size[b], 1).sum() <= 500 for b in blocks)


def test_values_of_a_batch_leave_in_small_parts():
    n = 30_000
    codes = pa.array([[0, 1, 2]] * (n // 3), pa.list_(pa.int32()))
    preds = pa.array([[0.5, 0.2, 0.9]] * (n // 3), pa.list_(pa.float64()))
    made = [len(batch.row) for _, batch in A._batches(codes, preds, 0, Options())]
    assert sum(made) == n and max(made) <= 8192 + 3


def test_only_wanted_shares_are_made(spark, sf_dir):
    packed = Q.scored_pairs(spark, sf_dir).limit(40).localCheckpoint()
    every = K.contributions_long(packed, Q.ATTRS)
    for pattern in ("_diff", "_perc", "_unpaired_(min|max)_allattr$", "^mean_diff_both_allattr$"):
        some = K.contributions_long(packed, Q.ATTRS, features=[x for x in Q.NAMES if re.search(pattern, x)])
        want = sorted(every.filter(F.col("feature").rlike(pattern)).collect())
        assert want and sorted(some.collect()) == want
    assert K.contributions_long(packed, Q.ATTRS, features=[]).count() == 0


def test_an_arrow_batch_is_bounded_in_bytes(spark, sf_dir):
    from kinweave.plans import settings
    settings.apply(spark)

    @F.arrow_udf("int")
    def rows(x: pa.Array) -> pa.Array:
        return pa.array([len(x)] * len(x), pa.int32())

    long = spark.range(2000, numPartitions=1).select(F.repeat(F.lit("word "), 4000).alias("x"))
    assert long.select(F.max(rows("x"))).first()[0] < 500


def test_document_texts_are_exchanged_once_for_both_sides(spark, sf_dir):
    plan = document_pairs(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    scans = [s for s in re.findall(r"FileScan parquet \[(.*?)\]", plan)]
    assert sum("text" in s for s in scans) == 1


def test_a_small_vocabulary_goes_to_the_tasks_and_a_large_one_is_joined(spark, sf_dir, monkeypatch):
    toks, vocab = Q.tokens(spark, sf_dir), Q.vocabulary(spark, sf_dir).filter("word != 'green'").localCheckpoint()
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    inside = E.attach_vectors(toks, vocab, Q.VECTOR_SIZE)
    assert exchanges(inside) == exchanges(toks)
    monkeypatch.setattr(E, "TASK_VOCABULARY", 500)
    joined = E.attach_vectors(toks, vocab, Q.VECTOR_SIZE)
    assert exchanges(joined) > exchanges(toks) and joined.schema.simpleString() == inside.schema.simpleString()
    assert sorted(map(str, inside.collect())) == sorted(map(str, joined.collect()))


def test_cosines_of_short_rows_are_taken_together(monkeypatch):
    rng = np.random.default_rng(5)
    left, right = ([[rng.normal(size=4).tolist() for _ in range(rng.integers(0, 9))] for _ in range(50)] for _ in range(2))
    left, right = (pa.array(x, pa.list_(pa.list_(pa.float32()))) for x in (left, right))
    together = S.vector_edges(left, right, 0.2)
    monkeypatch.setattr(S, "SHORT_CELLS", 0)
    alone = S.vector_edges(left, right, 0.2)
    assert len(alone.k) > 100 and np.allclose(together.k, alone.k, atol=1e-9)
    for c in ("row", "l", "r"):
        assert np.array_equal(getattr(together, c), getattr(alone, c))


def test_perturbed_rows_do_not_carry_the_words_of_their_pair(spark, sf_dir):
    units = Q.X.unit_impact(Q.scored_units(spark, sf_dir).withColumn("token_contribution", F.col("pred")))
    toks = Q.tokens(spark, sf_dir)
    made = Q.X.perturb_pairs(toks, Q.X.perturbation_plan(units, 2, 1, packed=True), units, Q.ATTRS)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    top = plan[:plan.index("ArrowEvalPython")]
    assert "Generate" in top and "l_toks" not in top and "array_contains" not in top
    some = made.filter("pair_id % 40 = 1").select("id", "comb_name", F.round("expected_delta", 9), *[f"{s}_{a}" for s in ("left", "right") for a in Q.ATTRS])
    plain = Q.X.perturb_pairs(toks, Q.X.perturbation_plan(units, 2, 1), units, Q.ATTRS).filter("pair_id % 40 = 1")
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, plain.select(
        "id", "comb_name", F.round("expected_delta", 9), *[f"{s}_{a}" for s in ("left", "right") for a in Q.ATTRS]).collect()))
