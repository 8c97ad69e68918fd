"""Reading and writing of pair splits, entity tables, units, vectors, metrics and explanations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from kinweave.operators.scale import hot_keys, spread_lookup, stored
from kinweave.operators.text import LEFT, RIGHT, prefixed

HOT_ENTITY_ROWS = 1_000_000

UNIT_SCHEMA = StructType([
    StructField("id", LongType()), StructField("unit_no", IntegerType()), StructField("left_word", StringType()),
    StructField("right_word", StringType()), StructField("cos_sim", DoubleType()),
    StructField("left_attribute", StringType()), StructField("right_attribute", StringType()),
    StructField("label", IntegerType()),
])


def pair_schema(attrs: Sequence[str]) -> StructType:
    keys = [StructField("id", LongType()), StructField("left_id", LongType()), StructField("right_id", LongType()),
            StructField("label", IntegerType())]
    return StructType(keys + [StructField(p + a, StringType()) for p in (LEFT, RIGHT) for a in attrs])


def entity_schema(attrs: Sequence[str]) -> StructType:
    return StructType([StructField("id", LongType()), *[StructField(a, StringType()) for a in attrs]])


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted CSV value runs over a line end.

    A quote toggles between inside and outside, so the line on which such a
    value begins has an odd number of quotes.  One scan over the lines tells.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, schema: StructType, multi_line: bool | None = None, **options: str) -> DataFrame:
    """CSV whose columns are found by their header and cast, so their order in the file does not matter.

    With ``multi_line=None`` the lines are looked through first: values with
    line breaks keep them, at the price that a file is one task's work, and
    files without any are split.
    """
    if multi_line is None:
        multi_line = spans_lines(spark, path)
    raw = spark.read.options(header="true", multiLine=str(multi_line).lower(), escape='"', **options).csv(path)
    return raw.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def _read(spark: SparkSession, path: str, schema: StructType, kind: str | None = None, multi_line: bool | None = None) -> DataFrame:
    """``kind`` is ``csv`` or ``parquet``; without it the suffix ``.csv`` tells."""
    if (kind or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")) == "parquet":
        return spark.read.schema(schema).parquet(path)
    return read_csv(spark, path, schema, multi_line)


def read_pairs(spark: SparkSession, path: str, attrs: Sequence[str], **options) -> DataFrame:
    """A labelled pair split from CSV or parquet; the schema is given, never inferred from data."""
    return _read(spark, path, pair_schema(attrs), **options)


def read_entities(spark: SparkSession, path: str, attrs: Sequence[str], drop: Sequence[str] = (), **options) -> DataFrame:
    return _read(spark, path, entity_schema(attrs), **options).drop(*drop)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_units(units: DataFrame, path: str) -> None:
    """Units as parquet: words such as ``NA`` or ``null`` stay words."""
    write_table(units, path)


def read_units(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


CSV_WRITE = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_units_csv(units: DataFrame, path: str) -> None:
    units.write.mode("overwrite").options(nullValue="\x00", **CSV_WRITE).csv(path)


def read_units_csv(spark: SparkSession, path: str, schema: StructType = UNIT_SCHEMA, multi_line: bool | None = None) -> DataFrame:
    return read_csv(spark, path, schema, multi_line, nullValue="\x00")


def write_metrics(df: DataFrame, path: str) -> None:
    """Metric tables have a row per model, split or perturbation kind, so one file is enough."""
    df.coalesce(1).write.mode("overwrite").options(**CSV_WRITE).csv(path)


def read_metrics(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return read_csv(spark, path, schema)


EXPLANATION_SCHEMA = StructType([
    StructField("id", LongType()), StructField("attribute", StringType()), StructField("pos", IntegerType()),
    StructField("word", StringType()), StructField("impact", DoubleType()),
])


def load_explanations(spark: SparkSession, positive: str, negative: str, schema: StructType = EXPLANATION_SCHEMA, **options) -> DataFrame:
    """Word impacts of another explainer for matches and non-matches, from CSV or parquet, marked by ``polarity``.

    CSV columns are those of ``schema``; parquet brings its own.
    """
    def read(path: str) -> DataFrame:
        is_csv = options.get("kind", "csv" if path.rstrip("/").endswith(".csv") else "parquet") == "csv"
        return read_csv(spark, path, schema, options.get("multi_line")) if is_csv else spark.read.parquet(path)

    return read(positive).withColumn("polarity", F.lit("positive")).unionByName(read(negative).withColumn("polarity", F.lit("negative")))


def used_entities(entities: DataFrame, splits: Sequence[DataFrame], side: str) -> DataFrame:
    """Entities that occur in at least one split."""
    ids = None
    for s in splits:
        part = s.select(F.col(f"{side}_id").alias("id"))
        ids = part if ids is None else ids.unionByName(part)
    # ids are made distinct first, so a frequent entity is one row in the join
    return entities.join(ids.distinct(), "id", "left_semi")


def assemble_pairs(links: DataFrame, left: DataFrame, right: DataFrame, hot_rows: int = HOT_ENTITY_ROWS) -> DataFrame:
    """Merge a split with both entity tables; a link without both entities is dropped.

    The links are written once; their hot entities are counted for both sides
    in one pass, and only those are spread over several tasks.
    """
    keys = stored(links.select("id", "left_id", "right_id", "label"))
    hot = hot_keys(keys, ["left_id", "right_id"], hot_rows)
    first = spread_lookup(keys, prefixed(left, LEFT), "left_id", ["id"], hot["left_id"], "inner")
    both = spread_lookup(first, prefixed(right, RIGHT), "right_id", ["id"], hot["right_id"], "inner")
    rest = [c for c in both.columns if c not in keys.columns]
    return both.select(*keys.columns, *rest)
