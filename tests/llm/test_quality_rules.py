from plain import quality
from pyspark.sql import functions as F

from kinweave.llm import quality_rules as Q

TEXTS = [
    None, "", " \t\n", "one", "a b c d e a b c d e", "a b c d e f a b c d e x a b c d e", "x " * 40, "w\n\nw\n w\nw",
    "é ü ß # * $ % & | < >", " lead and trail ", "a\x0bb\x0cc\rd", "# " * 30, "UPPER CASE WORDS ONLY HERE AND MORE OF THEM NOW YES",
    "word" * 50_000, " ".join(f"w{i}" for i in range(30_000)), "one two three four five six seven eight nine ten",
]


def check(rows):
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality(r.text), (r.text or "")[:60]
        assert not (r.base_failed and r.kept)


def test_features_and_edge_cases(spark):
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, kept string")
    rows = Q.with_verdict(df).collect()
    assert len(rows) == 2 * len(TEXTS)
    check(rows)
    kept = {r.doc_id for r in rows if r.kept}
    assert kept == {14, 15}
    assert sorted(r.doc_id for r in Q.keep_good(df).collect()) == [14, 14, 15, 15]
    assert Q.keep_good(df).columns == df.columns


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = Q.with_verdict(df).collect()
    assert len(rows) == df.count()
    check(rows)
    assert {r.doc_id for r in rows if r.kept} == {r.doc_id for r in Q.keep_good(df).collect()}


def test_order_does_not_change_the_verdict(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    get = lambda n: Q.FEATURES[n](F.col("text"))
    a = df.select("doc_id", Q.verdict(Q.RULES, get).alias("k")).collect()
    b = df.select("doc_id", Q.verdict(Q.RULES[::-1], get).alias("k")).collect()
    assert sorted(a) == sorted(b)
    assert {r.name for r in Q.measured_order(df)} == {r.name for r in Q.RULES}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert Q.with_verdict(df).count() == 0 and Q.keep_good(df).count() == 0
