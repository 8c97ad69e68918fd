"""Helpers shared by the text operators: shared folder, written tables, worker code, expressions."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIEVE_LONGS = 1 << 20  # rows of 16 bytes at most

_shipped: set[str] = set()
_local: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, as ``--py-files`` would; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="kinweave-ship-"), "kinweave_llm_ship.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only with a local master and no setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="kinweave-"))
    return f"{folder}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: executors may be lost, and the lineage ends here."""
    spark = df.sparkSession
    path = shared_folder(spark)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda variable is bound to a computed value, while an alias used inside
    a lambda is inlined into it and evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bit(x: Column) -> Column:
    """The bit that the last six bits of a long name."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))


def sieve(df: DataFrame, value: str, keys: DataFrame, key: str, hit: bool = True) -> DataFrame:
    """Rows whose ``value`` may be a ``key`` of ``keys``, or, without ``hit``, those whose value is none; both are hashes.

    The keys' bitmap of ``64 * SIEVE_LONGS`` bits is broadcast, a table of
    bounded size however many keys there are.  With many keys more rows pass that
    are no key; what uses the rows joins them to the keys.
    """
    w, b = fresh(df, "sieve_word"), fresh(df, "sieve_bits")
    word = lambda x: F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(SIEVE_LONGS - 1))
    bits = keys.groupBy(word(F.col(f"`{key}`")).alias(w)).agg(F.bit_or(bit(F.col(f"`{key}`"))).alias(b))
    x = F.col(f"`{value}`")
    found = df.join(F.broadcast(bits), word(x) == F.col(w), "inner" if hit else "left")
    is_hit = F.coalesce(F.col(b), F.lit(0).cast("long")).bitwiseAND(bit(x)) != 0
    return found.filter(is_hit if hit else ~is_hit).drop(w, b)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
