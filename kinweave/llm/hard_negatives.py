"""Hard negatives by angular triangle filtering and integer scores.

Components become integers, so scores are exact.  The index stores for every
row its norm and the angles to reference directions, each taken in what the
directions before it leave over.  The triangle inequality of angles on the
sphere bounds the angle of two rows by the angles that both have to a
direction; nested over the directions, this gives an interval of their cosine.
Multiplied by both norms, widened by more than the rounding error and taken to
whole numbers, it is an interval that holds the score.  Only rows whose
interval meets the window that is asked for are scored.

Anchors are a query set against all rows.  They are dealt into chunks of at
most ``CHUNK_BYTES``; a chunk is broadcast and every task goes over its part of
the index in blocks, first for the positives, then for the negatives in the
windows that the positives' scores set.  A task gives the best ``k`` of its part,
and a window over these few rows gives the best of all.  Every bound only
leaves out rows that can not be among them, so the result is exact.

The reference directions are the principal ones of a sample of ``SAMPLE`` rows,
those first by a hash of their id; they decide how many rows are scored and
never what is returned.

Defined results: a row with a null id, label or vector, or with a component
that is null, NaN or infinite, takes no part.  Shorter vectors count as
filled up with zeros.  Repeated rows and ids each stand for themselves: a row
is never its own positive, its copies may be.  Ties go by id.  An empty table
gives an empty result; extra columns are not looked at.  A score that does not
fit a long is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm.common import ship, stored

SCALE = 256
SAMPLE = 4096
DIRECTIONS = 56
CHUNK_BYTES = 16 << 20
BLOCK_ANCHORS, BLOCK_ROWS = 256, 2048
SLACK = 1e-9  # of the product of norms; the rounding error of an interval is below 1e-12 of it
EXACT = 2 ** 62
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
INDEX = "row long, vec_id long, label long, norm double, q binary, angles binary"
FOUND = "anchor long, part int, score long, vec_id long, row long"


def integers(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * values.astype(np.float64))


def angles_to(points: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and the angle to every direction inside what the directions before it leave over."""
    norm = np.sqrt((points * points).sum(axis=1))
    along = points @ directions.T
    left = np.sqrt(np.maximum(norm[:, None] ** 2 - np.cumsum(along * along, axis=1), 0.0))  # after each direction
    before = np.concatenate([norm[:, None], left[:, :-1]], axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        cosine = np.where(before > 0, along / before, 1.0)
    return norm, np.arccos(np.clip(cosine, -1.0, 1.0))


@dataclass
class Rows:
    """Rows of the index as arrays; ``along`` and ``rest`` are rebuilt from norms and angles."""

    row: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    q: np.ndarray
    along: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(columns, width: int, directions: int) -> Rows:
        row, vec_id, label, norm, q, angles = columns
        angles = np.frombuffer(b"".join(angles), "<f8").reshape(-1, directions)
        norm = np.asarray(norm, np.float64)
        sines = norm[:, None] * np.cumprod(np.sin(angles), axis=1)
        before = np.concatenate([norm[:, None], sines[:, :-1]], axis=1)
        return Rows(np.asarray(row, np.int64), np.asarray(vec_id, np.int64), np.asarray(label, np.int64),
                    np.frombuffer(b"".join(q), "<f8").reshape(-1, width), before * np.cos(angles), sines[:, -1] if directions else norm)

    def slice(self, lo: int, hi: int) -> Rows:
        return Rows(*(getattr(self, f)[lo:hi] for f in ("row", "vec_id", "label", "q", "along", "rest")))

    def __len__(self) -> int:
        return len(self.row)


def bounds(anchors: Rows, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole number that the score of every (anchor, row) can be.

    The nested cosine interval times both norms is a sum over the directions,
    plus or minus the product of what they leave over.
    """
    middle = anchors.along @ rows.along.T
    norms = np.sqrt((anchors.along ** 2).sum(axis=1) + anchors.rest ** 2)[:, None] * np.sqrt((rows.along ** 2).sum(axis=1) + rows.rest ** 2)
    reach = np.outer(anchors.rest, rows.rest) + SLACK * (norms + 1.0)
    return np.ceil(middle - reach), np.floor(middle + reach)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of two matrices of whole numbers."""
    most = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(anchors.shape[1], 1)
    if most < 2.0 ** 53:
        return np.einsum("ij,ij->i", anchors, rows).astype(np.int64)
    if most < EXACT:
        return np.einsum("ij,ij->i", anchors.astype(np.int64), rows.astype(np.int64))
    exact = [sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for a, b in zip(anchors, rows, strict=True)]
    return np.array(exact, np.int64)  # raises where a score is no long


class Best:
    """The ``k`` best rows of every key so far: highest score, then lowest id, then lowest row."""

    def __init__(self, keys: int, k: int):
        self.k = k
        self.found = tuple(np.zeros(0, np.int64) for _ in range(4))  # key, score, vec_id, row
        self.least = np.full(keys, LOWEST)  # score of the k-th; below it nothing comes in

    def add(self, key: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        key, score, vec_id, row = (np.concatenate(x) for x in zip(self.found, (key, score, vec_id, row), strict=True))
        order = np.lexsort((row, vec_id, -score, key))
        key, score, vec_id, row = key[order], score[order], vec_id[order], row[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        rank = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
        full = rank == self.k - 1
        self.least[key[full]] = score[full]
        keep = rank < self.k
        self.found = key[keep], score[keep], vec_id[keep], row[keep]


def search(anchors: Rows, rows: Rows, best: Best, low: np.ndarray, high: np.ndarray, same: bool) -> int:
    """Add the rows of every anchor's windows ``low .. high`` (anchors x parts) to ``best``; the number of scored pairs.

    ``same`` asks for rows with the anchor's label, otherwise for the others.
    """
    parts, scored = low.shape[1], 0
    for a in range(0, len(anchors), BLOCK_ANCHORS):
        mine = anchors.slice(a, a + BLOCK_ANCHORS)
        key = (np.arange(a, a + len(mine))[:, None] * parts + np.arange(parts)).ravel()
        for b in range(0, len(rows), BLOCK_ROWS):
            theirs = rows.slice(b, b + BLOCK_ROWS)
            floor = np.maximum(low[a:a + len(mine)], best.least[key].reshape(-1, parts))
            least, most = bounds(mine, theirs)
            asked = (mine.label[:, None] == theirs.label) == same
            asked &= mine.row[:, None] != theirs.row
            near = np.zeros_like(asked)
            for p in range(parts):  # an interval that meets one of the windows
                near |= (most >= floor[:, p, None]) & (least <= high[a:a + len(mine), p, None])
            i, j = np.nonzero(asked & near)
            if not len(i):
                continue
            scored += len(i)
            score = scores(mine.q[i], theirs.q[j])
            within = (score[:, None] >= floor[i]) & (score[:, None] <= high[a:a + len(mine)][i])
            at, p = np.nonzero(within)
            best.add((i[at] + a) * parts + p, score[at], theirs.vec_id[j[at]], theirs.row[j[at]])
    return scored


@dataclass
class Index:
    """The stored rows, with the width of vectors and the number of directions."""

    rows: DataFrame
    width: int
    directions: int
    bytes: int


def build_index(df: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding",
                directions: int = DIRECTIONS, sample: int = SAMPLE) -> Index | None:
    """Integers, norm and angles of every row that takes part, written; None if there is none."""
    spark = df.sparkSession
    ship(spark)
    finite = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.withColumn("v", F.transform("v", lambda v: v.cast("double")))
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return None
    width = max(width, 1)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()  # bounded by the parameter
    points = np.zeros((len(picked), width))
    for i, r in enumerate(picked):
        points[i, :len(r.v)] = r.v
    points = integers(points)
    points /= np.maximum(np.sqrt((points * points).sum(axis=1)), 1.0)[:, None]
    basis = np.linalg.svd(points, full_matrices=False)[2][:max(1, min(directions, width, len(points)))]
    n = len(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False)
            q = np.zeros((batch.num_rows, width))
            at = np.repeat(np.arange(batch.num_rows), sizes)
            q[at, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = integers(values)
            norm, angles = angles_to(q, basis)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(norm), _binary(q), _binary(angles)],
                names=["vec_id", "label", "norm", "q", "angles"])

    made = rows.mapInArrow(run, "vec_id long, label long, norm double, q binary, angles binary")
    made = made.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "norm", "q", "angles")
    return Index(stored(made), width, n, 8 * (width + n + 4))


def _binary(matrix: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(matrix, "<f8")
    step = data.shape[1] * 8
    offsets = np.arange(len(data) + 1, dtype=np.int32) * step
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


COLUMNS = ["row", "vec_id", "label", "norm", "q", "angles"]


def _pass(spark: SparkSession, index: Index, anchors: Rows, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> DataFrame:
    """The ``k`` best rows of every task for every anchor and window."""
    held = spark.sparkContext.broadcast((anchors, low, high))
    width, directions, parts = index.width, index.directions, low.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, lo, hi = held.value
        best = Best(len(mine) * parts, k)
        for batch in batches:
            search(mine, Rows.of([batch.column(c).to_pylist() for c in COLUMNS], width, directions), best, lo, hi, same)
        key, score, vec_id, row = best.found
        yield pa.RecordBatch.from_arrays(
            [pa.array(mine.row[key // parts]), pa.array((key % parts).astype(np.int32)), pa.array(score), pa.array(vec_id), pa.array(row)],
            names=["anchor", "part", "score", "vec_id", "row"])

    found = index.rows.select(*COLUMNS).mapInArrow(run, FOUND)
    order = Window.partitionBy("anchor", "part").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(df: DataFrame, is_anchor: Column, k_positive: int = 5, k_negative: int = 5, low: int = 80, high: int = 100,
         vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor's positives are its best rows of the same label; a positive's
    negatives are the best rows of other labels whose score is ``low`` to
    ``high`` percent of the positive's.  ``is_anchor`` is a condition on ``vec_id``.
    """
    spark = df.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    index = build_index(df, vec_id, label, vector)
    if index is None:
        return spark.createDataFrame([], out)
    queries = index.rows.filter(is_anchor)
    chunks = max(1, -(-queries.count() * index.bytes // chunk_bytes))
    chunk = F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int")
    queries = stored(queries.withColumn("chunk", chunk), "chunk")
    found = None
    for c in range(chunks):
        part = queries.filter(F.col("chunk") == c).select(*COLUMNS).toArrow()  # about chunk_bytes
        if not part.num_rows:
            continue
        anchors = Rows.of([part.column(x).to_pylist() for x in COLUMNS], index.width, index.directions)
        n = len(anchors)
        positives = stored(_pass(spark, index, anchors, np.full((n, 1), LOWEST), np.full((n, 1), HIGHEST), True, k_positive))
        got = positives.select("anchor", "rank", "score").toArrow()  # at most k_positive rows an anchor
        place = {r: i for i, r in enumerate(anchors.row.tolist())}
        lows, highs = np.full((n, k_positive), HIGHEST), np.full((n, k_positive), LOWEST)
        for a, r, s in zip(*(got.column(x).to_pylist() for x in ("anchor", "rank", "score")), strict=True):
            lows[place[a], r - 1], highs[place[a], r - 1] = -(-low * s // 100), high * s // 100
        negatives = _pass(spark, index, anchors, lows, highs, False, k_negative)
        ids = spark.createDataFrame(pa.table({"anchor": anchors.row, "anchor_id": anchors.vec_id}))
        rows = negatives.join(positives.select(
            "anchor", (F.col("rank") - 1).alias("part"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
            ["anchor", "part"]).join(ids, "anchor").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"))
        rows = stored(rows)  # a chunk's lineage ends here
        found = rows if found is None else found.unionByName(rows)
    return spark.createDataFrame([], out) if found is None else found
