import random
import statistics

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinweave.operators.sampling import balanced_pairs, dense_ids, label_shares, per_class_sample, reduced_training_sets, stratified_sample
from kinweave.operators.scale import (
    distributed_rank, durable, exact_median, hash_order, hash_rank, hot_keys, salted_lookup, spread_lookup,
)


def hot_rows(spark, n=600):
    """One key holds two thirds of the rows."""
    return spark.range(n).withColumn("k", F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 20))


def test_ranks_equal_a_window(spark):
    df = hot_rows(spark)
    got = distributed_rank(df, ["k"], F.floor(F.col("id") / 50), ["id"], "rn")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("id")).cast("long"))
    assert got.select("id", "k", "rn").exceptAll(want).count() == 0 == want.exceptAll(got.select("id", "k", "rn")).count()


def test_hash_rank_follows_the_hash(spark):
    df = hot_rows(spark)
    w = Window.partitionBy("k").orderBy(hash_order(F.lit("7"), F.col("id").cast("string")), "id")
    want = df.withColumn("rank", F.row_number().over(w).cast("long"))
    assert hash_rank(df, ["k"], "id", 7).select(want.columns).exceptAll(want).count() == 0


def test_salted_lookups_equal_a_join(spark):
    facts = hot_rows(spark)
    dim = spark.range(15).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    for how in ("left", "inner"):
        want = facts.join(dim, "k", how).select("id", "k", "v")
        for hot in (None, 50, 10_000):
            got = salted_lookup(facts, dim, "k", ["id"], how, 5, hot).select("id", "k", "v")
            assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_exact_median(spark):
    rng = random.Random(5)
    rows = [("hot", rng.choice([0.0, 0.0, rng.uniform(-1, 1)])) for _ in range(501)]
    rows += [("few", x) for x in (-3.0, 0.25, 0.5, 9.0)] + [("one", 0.125), ("one", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r["median"] for r in exact_median(df, ["g"], "v", -1.0, 1.0, 16).collect()}
    for g in ("hot", "few", "one"):
        assert got[g] == statistics.median([v for k, v in rows if k == g and v is not None])


def test_samples(spark):
    pairs = spark.range(1000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    assert {r.label: r["count"] for r in stratified_sample(pairs, 105).groupBy("label").count().collect()} == {0: 94, 1: 10}
    assert {r.label: r["count"] for r in per_class_sample(pairs, 150).groupBy("label").count().collect()} == {0: 150, 1: 100}
    w = Window.partitionBy("label").orderBy(hash_order(F.lit("0"), F.col("id").cast("string")))
    want = pairs.withColumn("r", F.row_number().over(w)).filter("r <= 150").select("id")
    assert per_class_sample(pairs, 150).select("id").exceptAll(want).count() == 0
    reduced = reduced_training_sets(pairs, (50,), 3)
    first, second = (reduced.filter(F.col("rep") == i).select("id") for i in (0, 1))
    assert first.exceptAll(second).count() > 0
    assert balanced_pairs(pairs).groupBy("label").count().filter("count = 100").count() == 2
    assert abs(sum(r.share for r in label_shares(pairs).collect()) - 1) < 1e-12


def test_dense_ids(spark):
    got = dense_ids(spark.range(300).withColumnRenamed("id", "key"), "key")
    assert sorted(r.id for r in got.collect()) == list(range(300))


def test_durable_uses_the_session_folder(spark):
    durable(spark.range(3))
    assert spark.conf.get("spark.checkpoint.dir") in spark.sparkContext.getCheckpointDir()


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, None), (4, None), (5, 1)], "id long, label int")
    got = distributed_rank(df, ["label"], F.floor(F.col("id") / 2), ["id"], "rn")
    assert sorted((r.id, r.rn) for r in got.collect()) == [(1, 1), (2, 2), (3, 1), (4, 2), (5, 1)]
    assert {r.id for r in hash_rank(df, ["label"], "id").collect()} == {1, 2, 3, 4, 5}
    medians = {r.label: r["median"] for r in exact_median(df.withColumn("v", F.col("id").cast("double")), ["label"], "v", 0, 10).collect()}
    assert medians == {0: 1.5, None: 3.5, 1: 5.0}
    assert sorted(r.label if r.label is not None else -1 for r in per_class_sample(df, 1).collect()) == [-1, 0, 1]
    assert stratified_sample(df, 5).count() == 5
    assert reduced_training_sets(df, (5,), 1).count() == 5


def test_hot_keys_of_several_columns_in_one_pass(spark):
    df = spark.range(300).select("id", F.when(F.col("id") < 100, 7).when(F.col("id") < 250, F.col("id") % 90).alias("a"), (F.col("id") % 3).alias("b"))
    hot = hot_keys(df, ["a", "b"], 100)
    assert hot == {"a": ["7"], "b": ["0", "1", "2"]}
    dim = spark.range(80).select(F.col("id").cast("int").alias("a"), F.concat(F.lit("x"), "id").alias("name"))
    for how in ("left", "inner"):
        want = df.join(dim, "a", how)
        for keys in ([], hot["a"]):
            got = spread_lookup(df, dim, "a", ["id"], keys, how)
            assert got.count() == want.count() and got.select(want.columns).exceptAll(want).isEmpty()
