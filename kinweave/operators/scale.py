"""Building blocks that keep wide operators balanced when one key is hot.

Nothing here samples or drops rows: every helper returns what the plain
join, row_number or median would return.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_KEYS = 1000  # a key outside the 1000 largest holds less than 0.1 % of the rows


def shared_folder(spark) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only with a local master and no setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="kinweave-")
    return f"{folder}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a table to the shared folder and read it back; a filter on ``partition_by`` then reads its part only."""
    path = shared_folder(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder of the session and cut the lineage."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="kinweave-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where a null key equals a null key, as it does in a group or a window."""
    mine = right.select(*[F.col(c).alias(f"_right_{c}") if c in on else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on]
    return left.join(mine, same, how).drop(*[f"_right_{c}" for c in on])


def hash_order(*cols: str | Column) -> Column:
    """Reproducible pseudo-random order key that any SQL engine can recompute."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]))


def distributed_rank(
    df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column | str], rank: str = "rank",
) -> DataFrame:
    """``row_number() over (partition by group order by bucket, order)`` in two phases.

    A plain window would put a whole group into one task.  Rows are ranked
    inside ``(group, bucket)`` and shifted by the number of rows in earlier
    buckets, so a group spreads over as many tasks as it has buckets.  The
    bucket must not decrease along the order.
    """
    rows = df.withColumn("_bucket", bucket)
    keys = [*group, "_bucket"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys).agg(F.count("*").alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        rows.withColumn("_inside", inside)
        .transform(null_safe_join, offsets, keys)
        .withColumn(rank, (F.col("_offset") + F.col("_inside")).cast("long"))
        .drop("_bucket", "_inside", "_offset")
    )


def hash_rank(df: DataFrame, group: Sequence[str], key: str, seed: int = 0, rank: str = "rank") -> DataFrame:
    """Rank rows of each group in seeded hash order; 4096 buckets per group."""
    h = hash_order(F.lit(seed).cast("string"), F.col(key).cast("string"))
    ranked = distributed_rank(df.withColumn("_h", h), group, F.substring("_h", 1, 3), ["_h", key], rank)
    return ranked.drop("_h")


def salted_lookup(
    facts: DataFrame, dim: DataFrame, on: str | Sequence[str], spread: Sequence[str],
    how: str = "left", salts: int = 16, hot_rows: int | None = None,
) -> DataFrame:
    """Join many facts to a table with unique keys when some keys are hot.

    ``hot_rows=None`` spreads every key over ``salts`` tasks by repeating the
    lookup table; right when that table is small next to the facts.  With
    ``hot_rows`` only keys holding at least that many facts are spread; this
    costs one pass over the key columns.  The list of hot keys has at most
    ``HOT_KEYS`` rows, which bounds its broadcast.
    """
    on = [on] if isinstance(on, str) else list(on)
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    if hot_rows is None:
        left = facts.withColumn("_salt", salt)
        right = dim.withColumn("_salt", every)
    else:
        hot = (
            facts.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") >= hot_rows)
            .orderBy(F.desc("_n")).limit(HOT_KEYS).select(*on, F.lit(True).alias("_hot"))
        )
        is_hot = F.coalesce(F.col("_hot"), F.lit(False))
        left = (
            facts.join(F.broadcast(hot), on, "left")
            .withColumn("_salt", F.when(is_hot, salt).otherwise(F.lit(0))).drop("_hot")
        )
        copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        right = dim.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def hot_keys(facts: DataFrame, columns: Sequence[str], hot_rows: int) -> dict[str, list]:
    """Values of each column that hold at least ``hot_rows`` rows, from one pass over all columns.

    At most ``HOT_KEYS`` of a column, so what reaches the driver is bounded.
    """
    sides = F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).cast("string").alias("key")) for c in columns])
    counts = facts.select(F.explode(sides).alias("x")).groupBy("x.side", "x.key").agg(F.count("*").alias("n"))
    found = counts.filter((F.col("n") >= hot_rows) & F.col("key").isNotNull()).orderBy(F.desc("n"), "side", "key")
    rows = found.limit(HOT_KEYS * len(columns)).collect()
    return {c: [r.key for r in rows if r.side == c][:HOT_KEYS] for c in columns}


def spread_lookup(
    facts: DataFrame, dim: DataFrame, on: str, spread: Sequence[str], hot: Sequence[str], how: str = "left", salts: int = 16,
) -> DataFrame:
    """Join many facts to a table with unique keys; the keys in ``hot`` (see ``hot_keys``) are spread over ``salts`` tasks."""
    if not hot:
        return facts.join(dim, on, how)
    is_hot = F.coalesce(F.col(on).cast("string").isin(list(hot)), F.lit(False))
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    left = facts.withColumn("_salt", F.when(is_hot, salt).otherwise(F.lit(0)))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return left.join(dim.withColumn("_salt", F.explode(copies)), [on, "_salt"], how).drop("_salt")


def exact_median(df: DataFrame, group: Sequence[str], value: str, low: float, high: float,
                 buckets: int = 1024, name: str = "median") -> DataFrame:
    """Exact median per group (null is a group) without holding a group in one task.

    Equal values are counted first, so a frequent value is one row.  The
    bucket holding the middle ranks is found from the bucket sizes and only
    the distinct values of that bucket are ordered.  Values outside
    ``[low, high]`` fall into the edge buckets.
    """
    slot = F.floor((F.col("_v") - low) / (high - low) * buckets)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
        .withColumn("_bucket", F.greatest(F.lit(0), F.least(F.lit(buckets), slot)))
    )
    running = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    sizes = (
        counts.groupBy(*group, "_bucket").agg(F.sum("_n").alias("_bn"))
        .withColumn("_end", F.sum("_bn").over(running))
        .withColumn("_total", F.sum("_bn").over(Window.partitionBy(*group)))
        .withColumn("_lo", F.floor((F.col("_total") + 1) / 2))
        .withColumn("_hi", F.floor(F.col("_total") / 2) + 1)
        .withColumn("_start", F.col("_end") - F.col("_bn"))
        .filter((F.col("_hi") > F.col("_start")) & (F.col("_lo") <= F.col("_end")))
        .select(*group, "_bucket", "_start", "_lo", "_hi")
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        null_safe_join(counts, sizes, [*group, "_bucket"])
        .withColumn("_last", F.col("_start") + F.sum("_n").over(inside))
        .withColumn("_first", F.col("_last") - F.col("_n") + 1)
    )

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("_first") <= F.col(rank)) & (F.col("_last") >= F.col(rank)), F.col("_v")))

    return placed.groupBy(*group).agg(((at("_lo") + at("_hi")) / 2).alias(name))
