"""Scores without feature vectors, and perturbations that are scored once a text."""
from pyspark.sql import functions as F

from checks import queries as Q
from kinweave.functions.strings import words_of
from kinweave.operators import evaluation as X
from kinweave.operators.scoring import binary_score, similarity_score
from kinweave.plans.pipeline import predict


def test_scores_equal_those_from_feature_vectors(spark, sf_dir):
    odd = spark.createDataFrame([(-1, 1, "[UNP]", "a b  a", "a", "[UNP] b"), (-2, 0, None, "", "", None), (-3, 0, "x", "", None, " ")],
                                "id long, label int, left_brand string, left_name string, right_brand string, right_name string")
    pairs = Q.pairs(spark, sf_dir).select(*odd.columns).unionByName(odd)
    for scorer in (similarity_score, binary_score):
        for options in ({}, {"use_schema": False, "fill_first": True}):
            out = predict(pairs, Q.MODEL, Q.ATTRS, scorer, explain=False, clean=False, **options)
            want = {r.id: r.match_score for r in out.pairs.select("id", "match_score").collect()}
            assert {r.id: r.match_score for r in out.scores.collect()} == want and want[-2] == 0.5
            plan = out.scores._jdf.queryExecution().optimizedPlan().toString()
            assert "features" not in plan and "l_toks" not in plan
    explained = predict(pairs, Q.MODEL, Q.ATTRS, clean=False)
    assert "features" not in explained.units._jdf.queryExecution().optimizedPlan().toString()


def test_perturbations_with_equal_texts_are_scored_once(spark, sf_dir):
    pairs = Q.pairs(spark, sf_dir).filter("id % 16 = 1").cache()
    tokens, impacts = Q.tokens(spark, sf_dir), Q.impacts(spark, sf_dir).cache()
    start = Q.prediction(spark, sf_dir, explain=False).scores
    asked = []

    def rescore(df):
        asked.append(df.count())
        return Q.rescore(df)

    for kind in ("AOPC", "sufficiency"):
        one, each = (X.evaluate_pairs(pairs, tokens, impacts, start, Q.ATTRS, rescore, 5, 3, kind, keeps_rows=k) for k in (True, False))
        rows = [sorted(map(tuple, x.select("id", "comb_name", "label", *[F.round(c, 9) for c in ("start_pred", "new_pred", "expected_delta", "error")]).collect()))
                for x in (one, each)]
        assert rows[0] == rows[1] and len(rows[0]) == 20 * pairs.count() == asked[-1]
        assert asked[-2] < 0.8 * asked[-1]


def test_words_do_not_depend_on_the_kind_of_space(spark):
    df = spark.createDataFrame([(" a\t\tb  c\x1cd ",), ("",), (None,), ("　",), ("one",)], "t string")
    assert [r.w for r in df.select(words_of(F.col("t")).alias("w")).collect()] == [["a", "b", "c", "d"], [], [], [], ["one"]]
