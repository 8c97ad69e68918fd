import math
import random

import pytest
from pyspark.sql import functions as F

from brute import features
from kinweave.operators import contributions as K
from kinweave.operators import features as A
from kinweave.operators.matcher import LinearMatcher
from kinweave.plans.pipeline import predict, predict_from_units

ATTRS = ["a", "b"]
NAMES = A.feature_names(ATTRS)


def scored(spark, n=40, seed=4, one_sided_max=0.5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        for u in range(rng.randint(1, 7)):
            kind = rng.choice(["both", "both", "left", "right"])
            pred = round(rng.random() * (1 if kind == "both" else one_sided_max), 3)
            rows.append((i, u, "[UNP]" if kind == "right" else "x", "[UNP]" if kind == "left" else "y",
                         "[UNP]" if kind == "right" else rng.choice(ATTRS), "[UNP]" if kind == "left" else rng.choice(ATTRS), pred, 0))
    return spark.createDataFrame(
        rows, "id long, unit_no int, left_word string, right_word string, left_attribute string, right_attribute string, pred double, label int")


def test_counts():
    assert len(NAMES) == 56 * 2 + 119 == len(set(NAMES))


@pytest.mark.parametrize("fill_first", [False, True])
def test_features_equal_brute_force(spark, fill_first):
    df = scored(spark)
    got = {r.id: dict(zip(NAMES, r.features)) for r in A.feature_vectors(df, ATTRS, fill_first=fill_first).collect()}
    by_id = {}
    for r in df.collect():
        by_id.setdefault(r.id, []).append(r.asDict())
    assert set(got) == set(by_id)
    for i, units in by_id.items():
        want = features(units, ATTRS, fill_first)
        assert set(want) == set(NAMES)
        for n in NAMES:
            assert math.isclose(got[i][n], want[n], abs_tol=1e-9), (i, n)


def test_shares_sum_to_the_feature(spark):
    df = scored(spark)
    sums = K.contributions_long(df, ATTRS).groupBy("id", "feature").agg(F.sum("value").alias("got"))
    want = A.features_long(A.feature_vectors(df, ATTRS, fill_first=True), NAMES)
    both = want.join(sums, ["id", "feature"], "left").fillna(0.0, ["got"])
    off = both.filter(F.abs(F.col("value") - F.col("got")) > F.when(F.col("feature").contains("perc"), 1e-4).otherwise(1e-6))
    # a ratio whose parts cancel has no stable share
    assert [r for r in off.collect() if not r.feature.startswith(("median_perc", "min_perc"))] == []


@pytest.mark.parametrize("mode", ["proportional", "softmax", "index"])
def test_extremes_are_spread_completely(spark, mode):
    df = scored(spark, 20)
    members = A.memberships(df, ATTRS)
    sh = K.shares(members, mode=mode).groupBy("id", "scope", "grp").agg(
        F.sum("sh_3").alias("lo"), F.sum("sh_4").alias("hi"), F.sum("sh_6").alias("mid"))
    want = A.group_statistics(members)
    both = want.join(sh, ["id", "scope", "grp"])
    assert both.filter((F.abs(F.col("lo") - F.col("stats")[3]) > 1e-9) | (F.abs(F.col("hi") - F.col("stats")[4]) > 1e-9)).count() == 0
    if mode != "index":
        assert both.filter(F.abs(F.col("mid") - F.col("stats")[6]) > 1e-9).count() == 0


def model(names=NAMES):
    return LinearMatcher.fixed(names, {n: ((i * 7) % 5 - 2) / 10 for i, n in enumerate(names) if "perc" not in n}, 0.25)


def test_contributions_and_intercept_give_the_score(spark):
    out = predict_from_units(scored(spark), model(), ATTRS, fill_first=True)
    total = out.units.groupBy("id").agg(F.sum("token_contribution").alias("c"))
    for r in total.join(out.scores, "id").collect():
        assert math.isclose(1 / (1 + math.exp(-(r.c + 0.25))), r.match_score, abs_tol=1e-6)


def test_folded_contributions_equal_the_long_ones(spark):
    df = scored(spark, one_sided_max=1.0)
    m = LinearMatcher.fixed(NAMES, {n: ((i * 7) % 5 - 2) / 10 for i, n in enumerate(NAMES)}, 0.0)
    coef = spark.createDataFrame(list(m.as_map().items()), "feature string, coef double")
    long = K.contributions_long(df, ATTRS).join(coef, "feature").groupBy("id", "unit_no").agg(F.sum(F.expr("value * coef")).alias("want"))
    got = K.token_contributions(df, m.as_map(), ATTRS).join(long, ["id", "unit_no"], "left").fillna(0.0, ["want"])
    assert got.filter(F.abs(F.col("want") - F.col("token_contribution")) > 1e-9).count() == 0
    assert got.count() == df.count()


def test_additive_only(spark):
    names = A.feature_names(ATTRS, A.ADDITIVE_STATS, derived=False)
    out = predict_from_units(scored(spark), model(names), ATTRS, additive_only=True)
    total = out.units.groupBy("id").agg(F.sum("token_contribution").alias("c"))
    for r in total.join(out.scores, "id").collect():
        assert math.isclose(1 / (1 + math.exp(-(r.c + 0.25))), r.match_score, abs_tol=1e-6)


def test_pair_without_words_scores_one_half(spark):
    pairs = spark.createDataFrame([(1, None, ""), (2, "red", "red")], "id long, left_a string, right_a string")
    names = A.feature_names(["a"])
    out = predict(pairs, LinearMatcher.fixed(names, {}, 2.0))
    scores = {r.id: r.match_score for r in out.scores.collect()}
    assert scores[1] == 0.5 and scores[2] > 0.8


def test_clip_keeps_one_sided_values_positive(spark):
    df = scored(spark, one_sided_max=1.0)
    low = A.memberships(df, ATTRS, clip_exclusive=True).filter("grp = 'unpaired_exclusive' and v < 0")
    assert low.count() == 0
