import random

import pytest
from pyspark.sql import functions as F

from brute import align
from kinweave.operators.align import Thresholds, align_tokens, align_units, most_similar, unit_rows
from kinweave.operators.similarity import with_edges
from kinweave.operators.tokens import pair_tokens, tokens_long

VOCAB = ["red", "read", "ready", "blue", "blues", "glue", "widget", "widgets", "gadget", "ring", "rings", "spring", "7", "42"]


def random_pairs(spark, n=60, words=7, seed=3):
    rng = random.Random(seed)

    def text():
        k = rng.randint(0, words)
        return " ".join(rng.choice(VOCAB) for _ in range(k)) if k else rng.choice([None, ""])

    rows = [(i, rng.randint(0, 1), text(), text(), text(), text()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label int, left_a string, left_b string, right_a string, right_b string")


def side(row, prefix):
    return [(a, w) for a in ("a", "b") for w in (row[f"{prefix}_{a}"] or "").split()]


def test_given_similarity_matrix(spark):
    matrix = {(f"l{i}", f"r{j}"): v for i, row in enumerate(
        [[.2, .3, .6], [.5, .2, .7], [.2, .1, .15], [.5, .6, .3]]) for j, v in enumerate(row)}

    def lookup(left, right):
        import numpy as np

        return np.array([matrix[p] for p in zip(left, right)])

    lookup.by_list = True
    pair = spark.createDataFrame([(1, "l0 l1 l2 l3", "r0 r1 r2")], "id long, left_x string, right_x string")
    edged = with_edges(pair_tokens(pair), 0.6, lookup)
    got = {(r.left_pos, r.right_pos) for r in unit_rows(most_similar(edged, 0.6, None)).collect()}
    assert got == {(1, 2), (3, 1), (0, -1), (2, -1), (-1, 0)}


def test_all_passes_equal_brute_force(spark):
    df = random_pairs(spark)
    got = {}
    for r in align_units(df).collect():
        got.setdefault(r.id, []).append((r.pass_no, r.left_pos, r.right_pos, r.cos_sim))
    for row in df.collect():
        want = align(side(row, "left"), side(row, "right"))
        assert sorted(got.get(row.id, [])) == want, row
    assert {p for rows in got.values() for p, *_ in rows} == {1, 2, 3, 4}


def same_word(a, b):
    return F.when(a == b, F.lit(1.0)).otherwise(F.when(F.substring(a, 1, 2) == F.substring(b, 1, 2), F.lit(0.7)).otherwise(F.lit(0.0)))


def same_word_list():
    def similarity(left, right):  # local, so that the workers get it by value
        import numpy as np

        return np.array([1.0 if a == b else 0.7 if a[:2] == b[:2] else 0.0 for a, b in zip(left, right)])

    similarity.by_list = True
    return similarity


@pytest.mark.parametrize("use_schema", [True, False])
def test_units_do_not_depend_on_the_block_size(spark, use_schema):
    toks = pair_tokens(random_pairs(spark, 40, 9, 5))
    units = sorted(map(repr, align_tokens(toks, use_schema=use_schema).collect()))
    assert units
    for cells in (1, 7, 40):
        assert sorted(map(repr, align_tokens(toks, use_schema=use_schema, cells=cells).collect())) == units


@pytest.mark.parametrize("use_schema", [True, False])
def test_column_and_list_similarities_give_equal_units(spark, use_schema):
    toks = pair_tokens(random_pairs(spark, 40, 9, 6))
    by_column = align_tokens(toks, similarity=same_word, use_schema=use_schema).collect()
    by_list = align_tokens(toks, similarity=same_word_list(), use_schema=use_schema, cells=9).collect()
    assert by_column and sorted(map(repr, by_column)) == sorted(map(repr, by_list))


def test_long_records_of_equal_words(spark):
    """Matching is linear in the edges; a column and a list similarity agree beyond any block."""
    words = " ".join(["same"] * 700)
    toks = pair_tokens(spark.createDataFrame([(1, words, words)], "id long, left_x string, right_x string"))
    for options in ({}, {"similarity": same_word}, {"similarity": same_word_list(), "cells": 10_000}):
        rows = align_tokens(toks, **options).collect()
        assert len(rows) == 700 and all(r.left_pos == r.right_pos and r.left_word == "same" for r in rows)


def test_every_word_has_a_unit_and_early_passes_use_it_once(spark):
    df = random_pairs(spark, 30, 6, 8)
    toks = pair_tokens(df)
    units = align_tokens(toks)
    words = tokens_long(toks).select("id", "side", "pos")
    for s in ("left", "right"):
        mine = units.select("id", F.lit(s).alias("side"), F.col(f"{s}_pos").alias("pos"), "pass_no")
        assert words.filter(F.col("side") == s).join(mine, ["id", "side", "pos"], "left_anti").count() == 0
        twice = mine.filter("pass_no <= 2").groupBy("id", "pos").count().filter("count > 1")
        assert twice.count() == 0


def test_cosine_on_vectors_with_zero_and_unknown_words(spark):
    from kinweave.operators.embedding import attach_vectors

    vocab = spark.createDataFrame([("red", [1.0, 0.0]), ("crimson", [0.9, 0.1]), ("ring", [0.0, 1.0])], "word string, vec array<double>")
    pair = spark.createDataFrame([(1, "red ring odd", "crimson odd"), (2, None, "red")], "id long, left_x string, right_x string")
    units = align_tokens(attach_vectors(pair_tokens(pair), vocab, 2), Thresholds(), "cosine", with_vectors=2)
    got = {(r.id, r.left_word, r.right_word) for r in units.collect()}
    # words without a vector are similar to nothing, not even to themselves
    assert got == {(1, "red", "crimson"), (1, "ring", "[UNP]"), (1, "odd", "[UNP]"), (1, "[UNP]", "odd"), (2, "[UNP]", "red")}
    large = align_tokens(attach_vectors(pair_tokens(pair), vocab, 2), Thresholds(), "cosine", with_vectors=2, cells=1)
    assert sorted(map(repr, units.collect())) == sorted(map(repr, large.select(units.columns).collect()))
