"""Repeated passages by a sparse suffix array.

A passage is repeated if ``PASSAGE`` consecutive words of it occur at another
place, in another text or in the same one.

1.  Equal texts become one; the smallest id stands for them, and every
    further copy of at least ``PASSAGE`` words is one repeated passage.
2.  Of every window of ``PASSAGE`` words the smallest hash of ``GRAM`` words is
    taken (the leftmost of equal ones).  These minimisers select the sparse
    suffixes; as content alone selects them, equal passages select the same.
3.  Suffixes are sorted by their first ``GRAM`` words; where no neighbour agrees
    on them, no passage through this place repeats.
4.  The others are extended to the left and right: each window whose minimiser
    the place is, is one more suffix, sorted by its ``PASSAGE`` words.  Windows
    with an equal neighbour repeat, and adjoining ones are one maximal passage.

Sorting by a hash of the words brings equal prefixes together as sorting by
the words would; only equality of neighbours is asked.  Counts are taken
before rows are joined, so that a frequent passage is no hot group.

Defined results: words are what white space separates, lower-cased in A-Z.
Null, empty and shorter texts have no passage.  Rows of equal id and text are
one document.  A null id stands for a text only where it has no other.
An empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import ship, stored

PASSAGE = 50
GRAM = 16
BASE = 0x9E3779B97F4A7C15 | 1  # odd, so that it has an inverse modulo 2^64
CACHE = 500_000
_cache: dict[bytes, int] = {}
_powers: list[np.ndarray] = []


def _word_hashes(text: bytes | None) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if len(_cache) > CACHE:
        _cache.clear()
    try:
        return np.fromiter(map(_cache.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in set(words):
            if w not in _cache:
                _cache[w] = xxh64_intdigest(w)
        return np.fromiter(map(_cache.__getitem__, words), np.uint64, len(words))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse modulo 2^64, at least ``n`` of them."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 15, 1 << (n - 1).bit_length())
        inverse, tables = pow(BASE, -1, 1 << 64), []
        for b in (BASE, inverse):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words, by differences of running sums."""
    n = len(words)
    if n < size:
        return np.empty(0, np.uint64)
    power, inverse = _power_tables(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[:n], dtype=np.uint64)))
    h = (sums[size:] - sums[:-size]) * inverse[:n - size + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` grams the place of its smallest, the leftmost of equal ones."""
    if len(grams) < width:
        return np.empty(0, np.int64)
    out = []
    step = 1 << 15
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    for i in range(0, len(views), step):
        part = views[i:i + step]
        out.append(part.argmin(axis=1) + np.arange(i, i + len(part)))
    return np.concatenate(out)


def _longs(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.int64) if a.dtype != np.uint64 else a.view(np.int64))


def passages(df: DataFrame, key: str = "doc_id", text: str = "text", passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """``key, start, length, copy_of``: maximal repeated passages in words.

    ``copy_of`` is the smallest id of an equal text for a whole-text copy, else
    null.  A text's own row is not a copy; its passages shared with other
    texts are listed like any others.
    """
    ship(df.sparkSession)
    width = passage - gram + 1
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    hashed = rows.select("id", F.xxhash64("text").alias("h"), F.hash("text").alias("h2"))
    first = stored(hashed.groupBy("h", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n")))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, h2, spots, grams = [], [], [], []
            for x, y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                g = window_hashes(_word_hashes(t), gram)
                at = np.unique(minimisers(g, width))
                h.append(np.full(len(at), x, np.int64))
                h2.append(np.full(len(at), y, np.int64))
                spots.append(at)
                grams.append(g[at])
            if h:
                yield pa.RecordBatch.from_arrays(
                    [_longs(np.concatenate(h)), pa.array(np.concatenate(h2).astype(np.int32)), pa.array(np.concatenate(spots).astype(np.int32)), _longs(np.concatenate(grams))],
                    names=["h", "h2", "at", "g"])

    # copies of a text select the same suffixes: one of each text and place counts
    suffixes = stored(rows.select(F.xxhash64("text").alias("h"), F.hash("text").alias("h2"), "text")
                      .mapInArrow(sparse, "h long, h2 int, at int, g long"))
    places = suffixes.distinct()
    shared = stored(places.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g"))
    spots = places.join(shared, "g").groupBy("h", "h2").agg(F.collect_list("at").alias("spots"))
    texts = rows.select(F.xxhash64("text").alias("h"), F.hash("text").alias("h2"), "text").join(stored(spots), ["h", "h2"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for x, y, t, spots in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = _word_hashes(t)
                chosen = np.flatnonzero(np.isin(minimisers(window_hashes(words, gram), width), np.asarray(spots)))
                out[0].append(np.full(len(chosen), x, np.int64))
                out[1].append(np.full(len(chosen), y, np.int64))
                out[2].append(chosen)
                out[3].append(window_hashes(words, passage)[chosen])
            if out[0]:
                h, h2, at, w = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays([_longs(h), pa.array(h2.astype(np.int32)), pa.array(at.astype(np.int32)), _longs(w)], names=["h", "h2", "at", "w"])

    windows = stored(texts.select("h", "h2", "text", "spots").mapInArrow(extend, "h long, h2 int, at int, w long").distinct())
    twice = stored(windows.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").select("w"))
    starts = windows.join(twice, "w").groupBy("h", "h2").agg(F.array_sort(F.collect_list("at")).alias("starts"))
    # a start more than ``passage`` after the one before begins a new passage
    begins = F.filter("starts", lambda s, i: F.coalesce(F.get("starts", i - 1) + passage < s, F.lit(True)) | (i == 0))
    ends = F.filter("starts", lambda s, i: F.coalesce(s + passage < F.get("starts", i + 1), F.lit(True)))
    spans = stored(starts.select("h", "h2", F.arrays_zip(begins.alias("b"), ends.alias("e")).alias("spans")))
    named = spans.join(first, ["h", "h2"]).select(
        F.col("first").alias("id"), F.explode("spans").alias("s")).select(
        "id", F.col("s.b").cast("long").alias("start"), (F.col("s.e") - F.col("s.b") + passage).cast("long").alias("length"),
        F.lit(None).cast("long").alias("copy_of"))
    n_words = F.size(F.array_remove(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+"), ""))
    copied = rows.withColumn("h", F.xxhash64("text")).withColumn("h2", F.hash("text")).join(first.filter("n > 1"), ["h", "h2"])
    copies = copied.filter(~F.col("id").eqNullSafe(F.col("first"))).select(
        "id", F.lit(0).cast("long").alias("start"), n_words.cast("long").alias("length"), F.col("first").alias("copy_of"))
    copies = copies.filter(F.col("length") >= passage).distinct()
    return named.union(copies).withColumnRenamed("id", key)
