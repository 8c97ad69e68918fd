"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits; a bit is 1 if it is set in more than half of the
XXH64 hashes of the word shingles.  Fingerprints link at ``MAX_BITS`` or fewer
differing bits.  The bits are split into six blocks: four differing bits leave
at least two blocks equal, so linked fingerprints share one of 15 pairs of
blocks.  Distinct fingerprints are dealt by pair and value, sorted, and
compared inside a value; each verified link that joins two parts found so far
is returned, which leaves the reachable sets as they are and is at most one row
per fingerprint and value, not one per pair.

A value with more than ``HOT_VALUE`` fingerprints is cut into chunks by hash and
every pair of chunks compared by its own task.

Defined results: null, empty and blank texts have fingerprint 0 and link like
any other.  Rows of equal text share a fingerprint, and so a component.  A component's id is
its smallest id that is not null (null if all are).  An empty table gives an
empty result.  Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import fresh, ship, sieve, stored
from kinweave.llm.graph import components

SEED = 42
MAX_BITS = 4
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # first bit, number of bits
HOT_VALUE = 20_000
PART = 1 << 16
LONG_RUN = 48


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """Fingerprint of one text given as UTF-8, as a signed 64-bit number."""
    from xxhash import xxh64_intdigest

    tokens = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(tokens) - words + 1
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if n <= 1:
        return int(np.uint64(xxh64_intdigest(joined, seed=SEED)).astype(np.int64))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = partial(xxh64_intdigest, seed=SEED)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, PART):
        j = min(n, i + PART)
        pieces = map(joined.__getitem__, map(slice, starts[i:j].tolist(), ends[i + words - 1:j + words - 1].tolist()))
        h = np.fromiter(map(digest, pieces), np.uint64, j - i)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", words: int = 4, name: str = "fingerprint") -> DataFrame:
    """``df`` without its text, with the fingerprint as a long."""
    ship(df.sparkSession)
    t = fresh(df, "bytes")
    df = df.drop(name)
    keep = [c for c in df.columns if c != text]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("binary").alias(t))
    schema = rows.drop(t).withColumn(name, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([fingerprint(x, words) for x in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fp], names=[*keep, name])

    return rows.mapInArrow(run, schema)


def block_values(fp: Column) -> Column:
    """The 15 pairs of blocks, each a long made of the pair's number and both blocks' bits."""
    out = []
    for k, ((a, m), (b, n)) in enumerate(combinations(BLOCKS, 2)):
        first = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << m) - 1))
        second = F.shiftrightunsigned(fp, b).bitwiseAND(F.lit((1 << n) - 1))
        out.append(F.lit(k << 32).cast("long") + F.shiftleft(first, n) + second)
    return F.array(*out)


def _links_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one long run, by breadth-first search over what is left."""
    left, right, todo, rest = [], [], [], fps
    while todo or len(rest):
        if not todo:
            todo.append(rest[0])
            rest = rest[1:]
        u = todo.pop()
        near = np.bitwise_count(rest ^ u) <= MAX_BITS
        if near.any():
            found = rest[near]
            left.append(np.full(len(found), u))
            right.append(found)
            todo.extend(found)
            rest = rest[~near]
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _compare(g: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal ``g``."""
    if len(g) < 2:
        return f[:0], f[:0]
    starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    sizes = np.diff(np.append(starts, len(g)))
    left, right = [f[:0]], [f[:0]]
    for s, n in zip(starts[sizes > LONG_RUN], sizes[sizes > LONG_RUN], strict=True):
        a, b = _links_of(f[s:s + n])
        left.append(a)
        right.append(b)
    small = np.repeat(sizes <= LONG_RUN, sizes)
    g, f = g[small], f[small]
    for d in range(1, LONG_RUN):
        same = np.flatnonzero(g[d:] == g[:-d]) if len(g) > d else []
        if not len(same):
            break
        a, b = f[same], f[same + d]
        near = np.bitwise_count(a ^ b) <= MAX_BITS
        left.append(a[near])
        right.append(b[near])
    return np.concatenate(left), np.concatenate(right)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare fingerprints of equal value; rows come sorted by value, and the last run waits for the next batch."""
    g, f = np.empty(0, np.int64), np.empty(0, np.uint64)

    def out(g, f):
        a, b = _compare(g, f)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        g = np.concatenate((g, batch.column(0).to_numpy(zero_copy_only=False)))
        f = np.concatenate((f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
        if len(g) and g[0] != g[-1]:
            cut = int(np.searchsorted(g, g[-1]))
            yield out(g[:cut], f[:cut])
            g, f = g[cut:], f[cut:]
    yield out(g, f)


def dealt(index: DataFrame, hot_value: int = HOT_VALUE) -> DataFrame:
    """``index`` with the values ``g`` of more than ``hot_value`` rows cut into pairs of chunks of ``f``."""
    hot = stored(index.groupBy("g").count().filter(F.col("count") > hot_value)
                 .select("g", F.ceil(F.col("count") / hot_value).alias("k")))
    if not hot.isEmpty():
        parts = index.join(hot, "g", "left").withColumn("k", F.coalesce("k", F.lit(1)))
        mine = F.pmod(F.xxhash64("f"), F.col("k"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))
        parts = parts.withColumn("c", mine).withColumn("o", other)
        rest = [c for c in index.columns if c not in ("g", "f")]
        index = parts.select(
            F.when(F.col("k") == 1, F.col("g"))
            .otherwise(F.xxhash64("g", F.least("c", "o"), F.greatest("c", "o"))).alias("g"), "f", *rest)
    return index


def links(distinct: DataFrame, fp: str = "fingerprint", hot_value: int = HOT_VALUE) -> DataFrame:
    """Links ``a, b`` that connect what ``MAX_BITS`` or fewer bits connect; ``distinct`` has a row per fingerprint."""
    ship(distinct.sparkSession)
    index = distinct.select(F.explode(block_values(F.col(fp))).alias("g"), F.col(fp).alias("f"))
    index = dealt(index, hot_value)
    sorted_rows = index.repartition("g").sortWithinPartitions("g", "f")
    found = sorted_rows.mapInArrow(_verify, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _grouped(fps: DataFrame, hot_value: int = HOT_VALUE, found: DataFrame | None = None) -> DataFrame:
    """``fingerprint, component_id, keep`` for a written table of ``doc_id, h, fingerprint``.

    ``keep`` names the row of the component that stays: smallest id, nulls
    last, then smallest row hash ``h``.  ``found`` has the links, if they are known.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    classes = stored(fps.groupBy("fingerprint").agg(F.min(order).alias("first")))
    roots = components(links(classes.select("fingerprint"), hot_value=hot_value) if found is None else found)
    linked = classes.join(roots, F.col("fingerprint") == F.col("node"), "left")
    rooted = stored(linked.select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("keep"))
    return stored(rooted.join(smallest, "root").select("fingerprint", F.col("keep.doc_id").alias("component_id"), "keep"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4,
                    hot_value: int = HOT_VALUE) -> DataFrame:
    """``key, fingerprint`` (long) and ``component_id`` for every row of ``df``."""
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.lit(0).cast("long").alias("h"))
    fps = stored(with_fingerprint(rows, "text", words))
    named = _grouped(fps, hot_value).select("fingerprint", "component_id")
    return fps.join(named, "fingerprint").select(F.col("doc_id").alias(key), "fingerprint", "component_id")


def first_of_group(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4,
                   hot_value: int = HOT_VALUE) -> DataFrame:
    """One row of each component, with the columns of ``df``."""
    h = fresh(df, "row_hash")
    hashed = df.withColumn(h, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    fps = stored(with_fingerprint(
        hashed.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(h).alias("h")), "text", words))
    return first_rows(df, hashed, h, key, fps, None, hot_value)


def first_rows(df: DataFrame, hashed: DataFrame, h: str, key: str, fps: DataFrame, found: DataFrame | None,
               hot_value: int = HOT_VALUE) -> DataFrame:
    """The rows of ``df`` that stay; ``hashed`` is ``df`` with its row hash ``h``, ``fps`` has ``doc_id, h, fingerprint``."""
    keep = stored(_grouped(fps, hot_value, found).select("keep.doc_id", "keep.h").distinct())
    copies = fps.groupBy("doc_id", "h").count().filter("count > 1")
    repeated = not copies.isEmpty()  # rows equal in every column
    i, k = fresh(hashed, "kept_id"), fresh(hashed, "kept_hash")
    stays = keep.select(F.col("doc_id").alias(i), F.col("h").alias(k))
    gone = fps.alias("x").join(keep.alias("y"), (F.col("x.h") == F.col("y.h")) & F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")), "left_anti")
    gone = stored(gone.select("h"))
    columns = [f"`{c}`" for c in df.columns]
    some = sieve(hashed, h, gone, "h")  # all others stay, and their texts stay where they are
    out = some.join(stays, (F.col(h) == F.col(k)) & F.col(f"`{key}`").eqNullSafe(F.col(i))).select(*columns)
    out = out.union(sieve(hashed, h, gone, "h", hit=False).select(*columns))
    return out.dropDuplicates() if repeated else out
