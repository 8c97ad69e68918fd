import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.functions.strings import WordTable, _jaro_long, jaro, jaro_winkler, words_of
from kinweave.operators import text as P


def some_words(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_vectorised_jaro_equals_sql_and_plain_loop():
    a, b = some_words(800), some_words(800, 2)
    con = duckdb.connect()
    got = jaro(a, b)
    want = [con.execute("select jaro_similarity(?, ?)", [x, y]).fetchone()[0] for x, y in zip(a, b)]
    assert np.allclose(got, want)
    assert np.allclose(got, [_jaro_long(x, y) for x, y in zip(a, b)])


def test_jaro_of_odd_words():
    long = "x" * 50 + "abc"
    assert np.allclose(jaro(["a", long, "", "ab\0", "é"], ["a", long, "b", "ab\0", "e"]), [1, 1, 0, 1, 0])


def test_jaro_of_any_length():
    rng = random.Random(9)
    words = lambda: ["".join(rng.choices("abcd/.", k=n)) for n in [*range(1, 140), 300, 1000, 1025, 1100]]
    a, b = words(), words()
    rng.shuffle(b)
    assert np.allclose(jaro(a, b), [_jaro_long(x, y) for x, y in zip(a, b)])


@pytest.mark.parametrize("table", [WordTable.TABLE, 0])
def test_no_similar_words_are_left_out(monkeypatch, table):
    """The bound is exact in one direction at every threshold, and leaves most of unlike words out."""
    rng = random.Random(4)
    words = some_words(150) + ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 9))) for _ in range(150)]
    words += ["x" * 40, "x" * 64, "xy" * 32, "x" * 70 + "ab", "ab" * 40, "żółć", "zolc", "日本", "日本語", "a", "aa", "b\0c", "ABC", "abc"]
    monkeypatch.setattr(WordTable, "TABLE", table)
    bound = WordTable(words)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    sim = np.round(jaro_winkler([words[k] for k in i], [words[k] for k in j]), 9)
    assert (np.round(bound.similarity(i, j), 9) == sim).all()
    for t in (-0.1, 0.0, 0.05, 0.3, 0.6, 0.75, 0.9, 1.0):
        reaches = bound.reaches(i, j, t)
        assert not (~reaches & (sim >= t)).any()
        if t >= 0.6:
            assert reaches.sum() < 3 * (sim >= t).sum() + 100


def test_prefix_bonus_counts_at_every_similarity():
    base = jaro(["abxxxx", "martha"], ["abyyyy", "marhta"])
    assert np.allclose(jaro_winkler(["abxxxx", "martha"], ["abyyyy", "marhta"]), base + np.array([2, 3]) * 0.1 * (1 - base))


def test_words_split_on_any_whitespace(spark):
    df = spark.createDataFrame([(" a\tb c  \n",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(words_of(F.col("t"))).collect()] == [["a", "b", "c"], [], []]


def test_cleaning_decomposes_accents_and_drops_lone_characters(spark):
    df = spark.createDataFrame([("Café – Noir ! ! x-Y a\\b",), ("nan",), ("None",), (None,)], "t string")
    got = [r[0] for r in P.clean_special_chars(df, ["t"]).collect()]
    # the dash is not ASCII and goes first; of two marks in a row one pass takes only one
    assert got == ["cafe noir ! x y a b", None, "none", None]


def test_repair_text(spark):
    mojibake = "café".encode().decode("latin-1")
    df = spark.createDataFrame([(mojibake + " 1/2",), ("naïve",), ("日本",)], "t string")
    got = [r[0] for r in P.repair_text(df, ["t"], [("1/2", "x")], redecode=["t"]).collect()]
    assert got == ["café x", "naïve", "日本"]


def test_mirror_and_attributes(spark):
    df = spark.createDataFrame([(1, "a", "b", "c", "d")], "id long, left_x string, left_y string, right_x string, right_y string")
    assert P.attributes(df) == ["x", "y"]
    rows = {r.mirror_side: (r.left_x, r.left_y, r.right_x, r.right_y) for r in P.mirror_pairs(df).collect()}
    assert rows == {"left_": ("a", "b", "a", "b"), "right_": ("c", "d", "c", "d")}


def test_lone_characters_go_as_in_single_replacements(spark):
    rng = random.Random(6)

    def plain(text):
        for ch in P.LONE_CHARS:
            text = text.replace(f" {ch} ", " ")
        return text

    texts = ["".join(rng.choices(["!", "#", "-", "/", " ", " ", "a", "é", "\t", "~", "\\"], k=30)) for _ in range(400)]
    for t in texts:
        assert P.without_lone_chars(t) == plain(t)
    ascii_only = [t.replace("é", "e") for t in texts]
    df = spark.createDataFrame([(t, t) for t in ascii_only], "a string, b string")
    got = P.clean_special_chars(P.clean_special_chars(df, ["a"]), ["b"], decompose=False)
    assert got.filter("not a <=> b").count() == 0
    odd = spark.createDataFrame([("ﬁne ² Ｆｕｌｌ ß 日本",)], "t string")
    assert P.clean_special_chars(odd, ["t"]).first()[0] == "fine 2 full"
