"""Random order over shards by a two-pass external shuffle.

Pass one scatters rows into buckets by a seeded hash of the whole row; the number of buckets
follows from the bytes of the table, so that a bucket fits in memory.  Pass
two brings each bucket into one array, puts it into an order that depends on
the rows alone, applies Spark's Fisher-Yates ``shuffle`` and writes it.  The
rows before a bucket plus the place in it is a row's place in the whole;
shards are equal stretches of places, so their counts differ by one at most,
and a bucket is written to one or two shards.

``shuffle`` draws one stream of random numbers per partition.  The partitions
of pass two are fixed by the table's bytes, buckets meet their partition by hash and are
sorted in it, so a bucket's draws depend on seed and rows only: another
cluster, another ``spark.sql.shuffle.partitions`` or a lost executor deals alike.

Rows that are equal in all columns have one hash.  Where they are more than
``HOT_SHARE`` of a bucket they travel as one row with a count, and get numbers
and with them buckets of their own afterwards.

Defined results: a null text counts as no bytes; a null id is a value like any
other.  Repeated rows get places of their own.  An empty table
gives no shard.  Extra columns travel along, columns named ``shard`` or
``slot`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.common import fresh, shared_folder, stored

BUCKET_BYTES = 8 << 20
ROW_BYTES = 16
MAX_PARTS = 20_000  # partitions of pass two: one per bucket up to here
HOT_SHARE = 8  # equal rows of more than a bucket's eighth are spread
CHUNK_COPIES = 10_000  # copies of a row that one task makes in one go
STRETCH = 4096


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def _bytes(df: DataFrame) -> Column:
    """Bytes of a row: strings and binaries as they are, nested values as JSON, all else ``ROW_BYTES`` together."""
    total = F.lit(ROW_BYTES).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            c = F.to_json(F.struct(c))
        elif not isinstance(f.dataType, T.StringType | T.BinaryType):
            continue
        total = total + F.coalesce(F.octet_length(c), F.lit(0))
    return total


def _hash(df: DataFrame, seed: int, *more: Column) -> Column:
    """Seeded hash of a row; maps, which have no order, take no part."""
    cols = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(F.lit(seed), *cols, *more)


def _spread(df: DataFrame, h: str, seed: int, hot_bytes: int) -> DataFrame:
    """``df`` with its hash ``h``; equal rows of more than ``hot_bytes`` together have different hashes."""
    rows = df.withColumn(h, _hash(df, seed))
    heavy = rows.groupBy(h).agg(F.count("*").alias("n"), F.sum(_bytes(df)).alias("size"))
    heavy = stored(heavy.filter((F.col("n") > 1) & (F.col("size") > hot_bytes)).select(h))
    if heavy.isEmpty():
        return rows
    rest = rows.join(heavy, h, "left_anti")
    n, chunk, i = (fresh(rows, x) for x in ("copies", "chunk", "number"))
    # grouped by the row itself, so different rows of one hash stay apart; counted before the exchange
    groups = rows.join(heavy, h, "left_semi").groupBy(*[f"`{c}`" for c in df.columns]).agg(F.count("*").alias(n))
    chunks = groups.withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {CHUNK_COPIES}"))))
    dealt = chunks.repartition(F.col(chunk), _hash(df, seed))
    last = F.least(F.col(n), (F.col(chunk) + 1) * CHUNK_COPIES) - 1
    copies = dealt.withColumn(i, F.explode(F.sequence(F.col(chunk) * CHUNK_COPIES, last)))
    return rest.unionByName(copies.withColumn(h, _hash(df, seed, F.col(i))).drop(n, chunk, i))


def _starts(sizes: DataFrame, b: str) -> DataFrame:
    """Rows before every bucket: running sums inside stretches of ``STRETCH`` buckets, and over the stretches."""
    rows = sizes.withColumn("part", F.expr(f"{b} div {STRETCH}"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per stretch
    parts = rows.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return rows.join(parts, "part").select(b, (F.col("first") + F.col("inside")).alias("start"))


def shuffled_shards(df: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", seed: int = 0,
                    bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows of ``df`` with ``shard`` (from 0) and ``slot`` (from 0 without gaps) in shuffled order.

    ``key`` and ``text`` name columns that must be there; all columns count.
    """
    df = df.drop("shard", "slot")
    names = df.columns
    if not {key, text} <= set(names):
        raise ValueError(f"no column {key} or {text}")
    total = df.agg(F.coalesce(F.sum(_bytes(df)), F.lit(0)), F.count("*")).first()
    n_bytes, n_rows = int(total[0]), int(total[1])
    n_buckets = max(1, -(-n_bytes // bucket_bytes))
    n_parts = min(n_buckets, MAX_PARTS)
    b, h = fresh(df, "bucket"), fresh(df, "scatter")
    rows = _spread(df, h, seed, max(bucket_bytes // HOT_SHARE, 1))
    rows = rows.withColumn(b, F.pmod(F.col(h), F.lit(n_buckets)))
    starts = _starts(rows.groupBy(b).agg(F.count("*").alias("n")), b)
    record = F.struct(F.col(h).alias("_h"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    dealt = (
        rows.repartition(n_parts, b).groupBy(b).agg(F.sort_array(F.collect_list(record)).alias("records"))
        .sortWithinPartitions(b).select(b, F.shuffle("records", seed).alias("records"))
    )
    full = (
        dealt.join(starts, b).select("start", F.posexplode("records").alias("i", "r"))
        .withColumn("place", F.col("start") + F.col("i"))
        .withColumn("shard", F.expr(f"place * {n_shards} div {max(n_rows, 1)}"))
    )
    first = F.expr(f"(shard * {n_rows} + {n_shards - 1}) div {n_shards}")  # place of the shard's slot 0
    return full.select(
        *[F.col(f"r.c{i}").alias(c) for i, c in enumerate(names)], F.col("shard").cast("int").alias("shard"),
        (F.col("place") - first).cast("long").alias("slot"))


def write_shards(df: DataFrame, n_shards: int, path: str | None = None, key: str = "doc_id", text: str = "text",
                 seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write the shuffled rows below ``path`` in one folder per shard and return the written table."""
    spark = df.sparkSession
    out = shuffled_shards(df, n_shards, key, text, seed, bucket_bytes)
    path = path or f"{shared_folder(spark)}/shards"
    out.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)
