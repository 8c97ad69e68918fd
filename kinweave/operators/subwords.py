"""Word vectors from hashed character n-grams, so that a word no vocabulary knows has a vector, too.

A word in marks (``<word>``) has all its n-grams of ``SHORTEST`` to ``LONGEST``
letters.  Each falls into one of ``BUCKETS`` by hash.  A bucket's vector is the
mean over the vocabulary words that have an n-gram there; a bucket without any
has a small vector by a rule.  A word's vector is the mean of its n-grams'.
The table has a fixed number of rows, which bounds what tasks hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.vectors import zeros

SHORTEST, LONGEST = 3, 6
BUCKETS = 1 << 14
MERGE_GROUPS = 16


def buckets_of(word: str, cache: dict[str, int]) -> np.ndarray:
    """Bucket of every n-gram, repeats included."""
    marked = f"<{word}>"
    grams = [marked[i:i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - n + 1)]
    out = []
    for g in grams:
        b = cache.get(g)
        if b is None:
            if len(cache) > 1 << 20:
                cache.clear()
            b = cache[g] = int(hashlib.md5(g.encode()).hexdigest()[:4], 16) % BUCKETS
        out.append(b)
    return np.array(out, np.int64)


def rule_vectors(size: int) -> np.ndarray:
    """Vectors of buckets that no vocabulary word reaches."""
    return ((np.arange(BUCKETS)[:, None] * 37 + np.arange(size) * 101) % 201 - 100) / 1000


def bucket_table(vocab: DataFrame) -> DataFrame:
    """``bucket, vec`` of the reached buckets from ``word, vec``; partial sums leave the tasks, one row per bucket is returned.

    A word counts once in a bucket, whatever the number of its n-grams there.
    """
    sums = "part int, bucket int, n long, vec array<double>"

    def rows(part: np.ndarray, bucket: np.ndarray, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        at = pa.array(np.arange(len(bucket) + 1, dtype=np.int32) * total.shape[1])
        return pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(at, pa.array(total.ravel()))],
            names=["part", "bucket", "n", "vec"])

    def reached(bucket: np.ndarray, n: np.ndarray, vec: np.ndarray) -> tuple[np.ndarray, ...]:
        found, back = np.unique(bucket, return_inverse=True)
        total = np.zeros((len(found), vec.shape[1]))
        np.add.at(total, back, vec)
        return found, np.bincount(back, weights=n, minlength=len(found)), total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            words = batch.column(0).to_pylist()
            if not words:
                continue
            vec = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(words), -1)
            own = [np.unique(buckets_of(w, cache)) for w in words]
            bucket = np.concatenate(own)
            found, n, total = reached(bucket, np.ones(len(bucket)), vec[np.repeat(np.arange(len(own)), [len(b) for b in own])])
            yield rows(found % MERGE_GROUPS, found, n, total)

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        vec = group.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
        found, n, total = reached(group.column("bucket").to_numpy(), group.column("n").to_numpy(), vec)
        return pa.Table.from_batches([rows(np.full(len(found), key[0].as_py()), found, n, total / n[:, None])])

    some = vocab.filter("word is not null and vec is not null").select("word", "vec")
    merged = some.mapInArrow(run, sums).groupBy("part").applyInArrow(merge, sums)
    return merged.select("bucket", "vec")


def subword_vectors(words: DataFrame, table: DataFrame, size: int, word: str = "word") -> DataFrame:
    """``words`` with ``vec``; a null or empty word has zeros.  The table's rows are at most ``BUCKETS``."""
    matrix = rule_vectors(size)
    for r in table.select("bucket", "vec").collect():
        matrix[r.bucket] = r.vec
    shared = words.sparkSession.sparkContext.broadcast(matrix)

    @F.arrow_udf("array<double>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict[str, int] = {}
        for batch in batches:
            found = [shared.value[buckets_of(w, cache)].mean(axis=0) if w else np.zeros(size) for w in batch.to_pylist()]
            at = pa.array(np.arange(len(found) + 1, dtype=np.int32) * size)
            yield pa.ListArray.from_arrays(at, pa.array(np.concatenate(found) if found else np.zeros(0)))

    return words.withColumn("vec", vectors(F.col(word)))


def with_unknown_words(vocab: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """``word, vec`` of all ``words``: the vocabulary's vector where it has one, the n-grams' otherwise."""
    known = vocab.select("word", F.col("vec").cast("array<float>").alias("known"))
    every = subword_vectors(words.select("word").distinct(), bucket_table(vocab), size)
    return every.join(known, "word", "left").select("word", F.coalesce("known", F.col("vec").cast("array<float>"), zeros(size).cast("array<float>")).alias("vec"))
