import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import UNP, features
from kinweave.operators import contributions as K
from kinweave.operators import features as A
from kinweave.operators import scoring as N
from kinweave.operators.align import align_pairs, align_tokens
from kinweave.operators.matcher import LinearMatcher
from kinweave.operators.segments import Options, UnitBatch, block_numbers, feature_names
from kinweave.operators.tokens import pair_tokens
from kinweave.plans.pipeline import explained_units, predict, predict_from_units

ATTRS = ["a", "b"]
NAMES = feature_names(ATTRS)
SCHEMA = "id long, unit_no int, left_word string, right_word string, left_attribute string, right_attribute string, pred double, label int"


def units(rng, n=30, values=None):
    rows = []
    for i in range(n):
        for u in range(rng.choice([1, 2, 5, 9])):
            kind = rng.choice(["both", "both", "left", "right"])
            pred = rng.choice(values) if values else round(rng.random(), 2)
            rows.append((i, u, UNP if kind == "right" else "x", UNP if kind == "left" else "y", UNP if kind == "right" else rng.choice("abc"),
                         UNP if kind == "left" else rng.choice("ab"), pred, 0))
    return rows


def by_pair(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r)))
    return out


@pytest.mark.parametrize("size", [1, 7, A.BATCH_UNITS])
def test_batches_of_any_size(spark, monkeypatch, size):
    """An attribute that is not asked for counts in the overall scope only."""
    monkeypatch.setattr(A, "BATCH_UNITS", size)
    rows = units(random.Random(2))
    got = {r.id: r.features for r in A.feature_vectors(spark.createDataFrame(rows, SCHEMA), ATTRS).collect()}
    for i, mine in by_pair(rows).items():
        want = features([u for u in mine], ATTRS + ["c"])
        for n, x in zip(NAMES, got[i], strict=True):
            assert math.isclose(x, want[n], abs_tol=1e-9), (i, n)


def test_null_and_nan_scores(spark):
    rows = [(1, 0, "x", "y", "a", "a", None, 0), (1, 1, "x", UNP, "a", UNP, 0.2, 0), (2, 0, "x", "y", "a", "b", float("nan"), 0),
            (3, 0, "x", "y", "a", "a", 0.9, 0)]
    model = LinearMatcher.fixed(NAMES, {n: 0.1 for n in NAMES}, 0.0)
    out = predict_from_units(spark.createDataFrame(rows, SCHEMA), model, ATTRS)
    score = {r.id: r.match_score for r in out.scores.collect()}
    assert score[1] is None and math.isnan(score[2]) and 0 < score[3] < 1
    told = {(r.id, r.unit_no): r.token_contribution for r in out.units.collect()}
    assert told[1, 0] is None and told[1, 1] is None and math.isnan(told[2, 0]) and told[3, 0] > 0
    found = {r.id: r.features for r in out.features.collect()}
    assert found[1][NAMES.index("count_all_allattr")] == 1.0 and found[1][NAMES.index("mean_unpaired_exclusive_allattr")] == 0.6
    assert found[1][NAMES.index("mean_unpaired_both_allattr")] == 0.0


@pytest.mark.parametrize("mode", ["proportional", "softmax", "index"])
def test_shares_equal_the_window_version(spark, mode):
    """Same shares as the rows' windows, with ties and zeros."""
    df = spark.createDataFrame(units(random.Random(7), values=[0.0, 0.25, 0.5, 0.5, 0.75, 1.0]), SCHEMA)
    sh = K.shares(A.memberships(df, ATTRS), mode=mode).filter("grp not in ('left', 'right')")
    want = {}
    for r in sh.collect():
        for i, s in enumerate(A.STATS):
            if r[f"sh_{i}"]:
                want[r.id, r.unit_no, f"{s}_{r.grp}_{r.scope}"] = r[f"sh_{i}"]
    got = {(r.id, r.unit_no, r.feature): r.value for r in K.contributions_long(df, ATTRS, mode=mode, derived=False).collect()
           if "unpaired_min" not in r.feature and "unpaired_max" not in r.feature}
    for k in set(want) | set(got):
        assert math.isclose(want.get(k, 0.0), got.get(k, 0.0), abs_tol=1e-9), k


def test_large_pair_and_empty_batch():
    n = 50_000
    rng = np.random.default_rng(1)
    code = rng.integers(0, 3, n)
    b = UnitBatch(np.array([0, n, 0]), code, rng.random(n), np.ones(n, bool), 0, Options())
    x = b.features()
    assert x.shape == (3, 119) and x[1, 2] == n and not x[0].any()
    assert np.isfinite(b.contributions({(0, "diff_min"): np.ones(7)})).all()
    empty = UnitBatch(np.zeros(2, np.int64), code[:0], np.zeros(0), np.zeros(0, bool), 2, Options())
    assert not empty.features().any() and len(empty.contributions({})) == 0 and len(empty.long_shares(block_numbers(ATTRS, A.STATS, True))[0]) == 0


def pairs(spark, n=40):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choices(["red", "reed", "green", "gren", "blue", "x1", UNP], k=rng.randint(0, 5)))
    return spark.createDataFrame([(i, text(), text(), text(), text(), i % 2) for i in range(n)],
                                 "id long, left_a string, left_b string, right_a string, right_b string, label int")


def test_packed_pairs_equal_unit_rows(spark):
    toks = pair_tokens(pairs(spark), ATTRS)
    model = LinearMatcher.fixed(NAMES, {n: ((i * 7) % 5 - 2) / 10 for i, n in enumerate(NAMES)}, 0.25)
    a = predict_from_units(N.similarity_score(align_pairs(toks)), model, ATTRS)
    b = predict_from_units(N.similarity_score(align_tokens(toks)), model, ATTRS)
    key = lambda r: (r.id, getattr(r, "unit_no", 0))
    some = ["id", "unit_no", "pass_no", "left_word", "right_word", "pred", "label", "token_contribution"]
    assert sorted(a.units.select(*some).collect(), key=key) == sorted(b.units.select(*some).collect(), key=key)
    kept = {r.id: r.match_score for r in b.scores.collect()}
    for r in a.scores.collect():
        assert r.match_score == kept.get(r.id, 0.5)  # a pair without units has no unit rows
    own = predict(pairs(spark), model, ATTRS, scorer=lambda u: u.withColumn("pred", F.col("cos_sim") + 0.0), clean=False)
    assert {r.id: r.match_score for r in own.scores.collect()} == {r.id: r.match_score for r in a.scores.collect()}


def test_no_exchange_between_pairs_and_sink(spark):
    model = LinearMatcher.fixed(NAMES, {n: 0.1 for n in NAMES}, 0.0)
    out = predict(pairs(spark), model, ATTRS)
    for df in (explained_units(out), out.scores, out.units, out.features):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
