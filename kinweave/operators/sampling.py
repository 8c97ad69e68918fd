"""Label shares, stratified samples and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.scale import hash_order, hash_rank, null_safe_join


def label_shares(pairs: DataFrame, label: str = "label") -> DataFrame:
    counts = pairs.groupBy(label).agg(F.count("*").alias("n"))
    # the window runs over one row per label
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def _smallest(pairs: DataFrame, size: int, seed: Column, group: Sequence[str]) -> DataFrame:
    """At most ``size`` rows per group in hash order, with their rank.

    Bucket counts first tell how far into the hash order a group has to go,
    so only about ``size`` rows per group are ordered, however many there are.
    """
    rows = pairs.withColumn("_h", hash_order(seed.cast("string"), F.col("id").cast("string"))).withColumn(
        "_b", F.substring("_h", 1, 4))
    running = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        rows.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
        .withColumn("_sum", F.sum("_n").over(running))
        .groupBy(*group).agg(F.coalesce(F.min(F.when(F.col("_sum") >= size, F.col("_b"))), F.lit("ffff")).alias("_last"))
    )
    # one row per label, or per label and repetition
    near = null_safe_join(rows, F.broadcast(last), list(group)).filter(F.col("_b") <= F.col("_last"))
    order = Window.partitionBy(*group).orderBy("_h", "id")
    return near.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= size).select(
        *pairs.columns, "_rank")


def per_class_sample(pairs: DataFrame, per_class: int, seed: int = 0, label: str = "label") -> DataFrame:
    return _smallest(pairs, per_class, F.lit(seed), [label]).drop("_rank")


def stratified_sample(pairs: DataFrame, size: int, seed: int = 0, label: str = "label") -> DataFrame:
    """``floor(size * share of the label)`` rows of each label."""
    wanted = label_shares(pairs, label).select(label, F.floor(F.lit(size) * F.col("share")).alias("_size"))
    ranked = _smallest(pairs, size, F.lit(seed), [label])
    return null_safe_join(ranked, F.broadcast(wanted), [label]).filter(F.col("_rank") <= F.col("_size")).select(*pairs.columns)


def reduced_training_sets(pairs: DataFrame, sizes: Sequence[int] = (500, 1000, 2000), repetitions: int = 3) -> DataFrame:
    """All reduced training sets in one table with ``train_size`` and ``rep``; each repetition has its own seed.

    A smaller set of a repetition is the start of the larger one, so each
    repetition is ranked once, up to the largest size.
    """
    wanted = label_shares(pairs).select("label", F.explode(F.lit(list(sizes))).alias("train_size"), "share").select(
        "label", "train_size", F.floor(F.col("train_size") * F.col("share")).alias("_size"))
    repeated = pairs.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
    ranked = _smallest(repeated, max(sizes), F.col("rep"), ["rep", "label"])
    # one row per label and size
    return null_safe_join(ranked, F.broadcast(wanted), ["label"]).filter(F.col("_rank") <= F.col("_size")).select(
        *pairs.columns, "train_size", "rep")


def dense_ids(df: DataFrame, key: str, name: str = "id") -> DataFrame:
    """Dense 0..n-1 ids in hash order of a unique key."""
    return hash_rank(df, [], key, rank="_rank").withColumn(name, F.col("_rank") - 1).drop("_rank")


def balanced_pairs(pairs: DataFrame, seed: int = 0) -> DataFrame:
    """All matches and as many non-matches, in hash order."""
    ranked = hash_rank(pairs, ["label"], "id", seed, "_rank")
    matches = pairs.filter("label = 1").agg(F.count("*").alias("_n")).withColumn("label", F.lit(0))
    return ranked.join(F.broadcast(matches), "label", "left").filter(
        (F.col("label") == 1) | (F.col("_rank") <= F.col("_n"))).select(*pairs.columns)
