"""Fixed-size features per record pair from its scored units.

A pair's units lie in one array (``units``, with their scores in ``preds``), as
the alignment leaves them.  ``with_pair_values`` turns the arrays of a batch of
pairs into features, and into the units' contributions to a linear score, by
reductions over segments inside the task: no row leaves its place.  Unit rows
are packed by pair first, which is their one exchange.

``memberships`` and ``group_statistics`` give the same groups as rows, for
other statistics than those of the feature vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.strings import words_of
from kinweave.operators.align import UNPAIRED, Thresholds, slot_maker
from kinweave.operators.segments import ADDITIVE_STATS, ALL, STATS, Options, UnitBatch, block_numbers, feature_names, scopes  # noqa: F401
from kinweave.operators.similarity import CELLS, bounds, list_array
from kinweave.operators.text import LEFT, RIGHT
from kinweave.operators.tokens import computed_once, exploded

BATCH_UNITS = 8192  # units worked on at a time inside a task; a pair that has more is one batch


def by_pair(df: DataFrame) -> DataFrame:
    """Move rows to their pair's partition.

    The number of partitions is given, because adaptive execution would
    otherwise merge them by bytes, and units are small but costly to work on.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")


def is_paired(threshold: float = 0.5) -> Column:
    real = (F.col("left_word") != UNPAIRED) & (F.col("right_word") != UNPAIRED)
    return real & (F.col("pred") >= threshold)


def is_exclusive() -> Column:
    return (F.col("left_word") == UNPAIRED) | (F.col("right_word") == UNPAIRED)


def memberships(
    units: DataFrame, attrs: Sequence[str], threshold: float = 0.5, complementary: bool = True,
    scaled: bool = True, clip_exclusive: bool = False,
) -> DataFrame:
    """``id, unit_no, scope, grp, v``: the groups of every unit and its value there.

    ``scope`` is ``allattr`` or ``{side}_{attr}``.  ``clip_exclusive`` caps
    the score of one-sided units at 0.5, which keeps their values positive.
    """
    raw = F.col("pred").cast("double")
    if clip_exclusive:
        raw = F.when(is_exclusive(), F.least(raw, F.lit(0.5))).otherwise(raw)
    double = raw * 2 if scaled else raw
    paired = is_paired(threshold)
    value = F.when(paired, (raw - 0.5) * 2 if scaled else raw).otherwise(1 - double if complementary else double)
    kind = F.when(paired, "paired").otherwise("unpaired")

    def member(scope: Column, grp: Column, v: Column) -> Column:
        return F.struct(scope.alias("scope"), grp.alias("grp"), v.alias("v"))

    every = F.lit(ALL)
    one_sided = ~paired & is_exclusive()
    groups = [
        member(every, F.lit("all"), raw),
        member(every, kind, value),
        F.when(~paired, member(every, F.when(is_exclusive(), "unpaired_exclusive").otherwise("unpaired_both"), value)),
        F.when(one_sided, member(every, F.when(F.col("left_word") == UNPAIRED, "left").otherwise("right"), value)),
    ]
    for side in ("left", "right"):
        attr = F.col(f"{side}_attribute")
        groups.append(F.when(attr.isin(list(attrs)), member(F.concat(F.lit(f"{side}_"), attr), kind, value)))
    packed = F.array_compact(F.array(*groups))
    return exploded(units, ["id", "unit_no"], packed, "m").select("id", "unit_no", "m.*")


def _stat_columns(stats: Sequence[str]) -> list[Column]:
    known = {
        "mean": F.avg("v"), "sum": F.sum("v"), "count": F.count("v").cast("double"), "min": F.min("v"),
        "max": F.max("v"), "M-m": F.max("v") - F.min("v"), "median": F.median("v"),
    }
    return [known[s] for s in stats]


def group_statistics(members: DataFrame, stats: Sequence[str] = STATS) -> DataFrame:
    """``id, scope, grp, stats`` with one array of statistics per group."""
    return members.groupBy("id", "scope", "grp").agg(F.array(*_stat_columns(stats)).alias("stats"))


# ---- pairs with their units in an array -----------------------------------------------------------

def is_packed(df: DataFrame) -> bool:
    return "units" in df.columns


def packed_units(units: DataFrame) -> DataFrame:
    """``id, units, preds`` from unit rows; a pair's units keep the order of ``unit_no``."""
    rest = [c for c in units.columns if c not in ("id", "unit_no")]
    one = by_pair(units).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("unit_no", *rest))).alias("units"))
    return one.withColumn("preds", F.col("units.pred"))


def unit_table(packed: DataFrame, **values: str) -> DataFrame:
    """Unit rows of packed pairs, with ``pred`` and further ``values`` (name -> array column next to ``units``)."""
    fields = packed.schema["units"].dataType.elementType.names
    own = [c for c in packed.columns if c not in ("units", "preds", *values.values())]
    arrays = {**({} if "pred" in fields else {"pred": "preds"}), **values}
    rows = exploded(packed, [*own, *arrays.values()], F.col("units"), "u", "_no")
    unit_no = F.col("u.unit_no") if "unit_no" in fields else F.col("_no")
    order = ["id", unit_no.alias("unit_no"), *[F.col(f"u.{f}") for f in fields if f != "unit_no"], *[c for c in own if c != "id"]]
    return rows.select(*order, *[F.get(a, F.col("_no")).alias(n) for n, a in arrays.items()])


def _codes(attrs: Sequence[str]) -> Column:
    """Per unit: which side is missing, and the numbers of both attributes."""
    def number(u: Column, side: str) -> Column:
        known = F.array_position(F.lit(list(attrs)), u[f"{side}_attribute"]) if attrs else F.lit(0)
        return F.coalesce(known, F.lit(0)).cast("int")

    def code(u: Column) -> Column:
        alone = [F.when(u[f"{side}_word"] == UNPAIRED, flag).otherwise(0) for side, flag in (("left", 1), ("right", 2))]
        return alone[0] + alone[1] + 4 * (number(u, "left") + (len(attrs) + 1) * number(u, "right"))

    return F.transform("units", code)


def _batches(codes: pa.Array, preds: pa.Array, k: int, options: Options):
    """Unit batches of bounded size, with the sizes of their pairs."""
    (starts, sizes), (_, scored) = bounds(codes), bounds(preds)
    if not np.array_equal(sizes, scored):
        raise ValueError("a pair has not as many scores as units")
    code = codes.flatten().to_numpy(zero_copy_only=False)
    flat = preds.flatten()
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    pred = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + BATCH_UNITS)))
        at = slice(int(starts[lo]), int(starts[hi - 1] + sizes[hi - 1]))
        yield sizes[lo:hi], UnitBatch(sizes[lo:hi], code[at].astype(np.int64), pred[at], known[at], k, options)
        lo = hi


def _lists(sizes: np.ndarray, values: np.ndarray, null_values: np.ndarray | None = None, null_rows: np.ndarray | None = None) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    rows = None if null_rows is None else pa.array(null_rows)
    return pa.ListArray.from_arrays(offsets, pa.array(values, mask=null_values), mask=rows)


def with_pair_values(packed: DataFrame, attrs: Sequence[str], options: Options = Options(), coef: Mapping[str, float] | None = None,
                     features: bool = True, linear: tuple[Sequence[float], float] | None = None) -> DataFrame:
    """Add ``features``, and with coefficients on unscaled features ``contributions``, one number per unit.

    A pair without units has null features.  A null score makes what is
    derived from it null, and all contributions of its pair.  With ``linear``,
    coefficients in the order of the features and an intercept, the pair's
    ``logit`` is added; without ``features`` its vector does not leave the task.
    """
    attrs = list(attrs)
    weights = None
    if coef is not None:
        names, n = feature_names(attrs, options.stats, options.derived), len(options.stats)
        weights = {block: np.array([float(coef.get(x, 0.0)) for x in names[at:at + n]])
                   for block, at in block_numbers(attrs, options.stats, options.derived).items()}
        weights = {block: w for block, w in weights.items() if w.any()}
    kinds = {"features": ("array<double>", features), "contributions": ("array<double>", coef is not None), "logit": ("double", linear is not None)}
    made = ", ".join(f"{name} {kind}" for name, (kind, wanted) in kinds.items() if wanted)
    line = None if linear is None else (np.asarray(linear[0], float), float(linear[1]))

    @F.arrow_udf(made)
    def values(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        # a batch's values leave the task function before the next batch is made
        for codes, preds in columns:
            for sizes, batch in _batches(codes, preds, len(attrs), options):
                out = {}
                if features:
                    x = batch.features()
                    null = np.isnan(x) & batch.unknown[:, None] if batch.unknown.any() else None
                    out["features"] = _lists(np.full(len(x), x.shape[1]), x.ravel(), None if null is None else null.ravel(), sizes == 0)
                if weights is not None:
                    out["contributions"] = _lists(sizes, batch.contributions(weights), batch.unknown[batch.row])
                if line is not None:
                    value, null = batch.logit(*line)
                    out["logit"] = pa.array(value, mask=null | (sizes == 0))
                yield pa.StructArray.from_arrays(list(out.values()), names=list(out))

    # a task function does not take an argument that holds a lambda
    coded = computed_once(packed.withColumn("_codes", _codes(attrs)), "_codes", "units", "preds")
    keep = [c for c in coded.columns if c != "_codes"]
    done = coded.select(*keep, values("_codes", "preds").alias("_made"))
    return done.select(*keep, "_made.*")


def _side_by_side(lists: Sequence[pa.Array], attrs: Sequence[str]) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Words of all attributes of a row in one list, their attributes in another, and the attributes' numbers, from 1."""
    n, sizes = len(lists[0]), [bounds(x)[1] for x in lists]
    row = np.concatenate([np.repeat(np.arange(n), s) for s in sizes])
    order = np.argsort(row, kind="stable")
    number = np.repeat(np.arange(len(lists)), [s.sum() for s in sizes])[order]
    words = pa.concat_arrays([x.flatten().cast(pa.string()) for x in lists]).take(pa.array(order))
    return list_array(row[order], words, n), list_array(row[order], pa.array(attrs, pa.string()).take(pa.array(number)), n), number + 1


def pair_logits(
    pairs: DataFrame, attrs: Sequence[str], score: Callable[[np.ndarray], np.ndarray], linear: tuple[Sequence[float], float], options: Options = Options(),
    thresholds: Thresholds = Thresholds(), similarity="jaro_winkler", use_schema: bool = True, cells: int = CELLS,
) -> DataFrame:
    """``id, logit``: words are aligned, units scored (``score``, of their similarities) and the features added up in one task function.

    The same steps as ``pair_tokens``, ``align_pairs``, a scorer and ``with_pair_values``, without their arrays in between.
    A pair without units has a null logit.
    """
    attrs, line = list(attrs), (np.asarray(linear[0], float), float(linear[1]))
    _, slots = slot_maker(thresholds, similarity, use_schema, cells)

    def side(words: pa.Array, number: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a unit has no word on this side, and the number of its attribute."""
        starts, _ = bounds(words)
        missing = pc.equal(words.flatten(), UNPAIRED).to_numpy(zero_copy_only=False)
        there = np.flatnonzero(place >= 0)
        at = starts[row[there]] + place[there]
        alone, attr = np.ones(len(place), bool), np.zeros(len(place), np.int64)
        alone[there], attr[there] = missing[at], number[at]
        return alone, attr

    @F.arrow_udf("double")
    def logit(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in columns:
            (left, l_attrs, l_no), (right, r_attrs, r_no) = (_side_by_side(x, attrs) for x in (batch[:len(attrs)], batch[len(attrs):]))
            l_at, r_at = 0, 0
            for (a, b, *_), (row, _, l, r, sim) in slots(left, right, l_attrs, r_attrs):
                n_left, n_right = (int(bounds(x)[1].sum()) for x in (a, b))
                no_left, left_attr = side(a, l_no[l_at:l_at + n_left], row, l)
                no_right, right_attr = side(b, r_no[r_at:r_at + n_right], row, r)
                l_at, r_at = l_at + n_left, r_at + n_right
                code = np.where(no_left, 1, 0) + np.where(no_right, 2, 0) + 4 * (left_attr + (len(attrs) + 1) * right_attr)
                sizes = np.bincount(row, minlength=len(a))
                starts, pred, lo = np.cumsum(sizes) - sizes, score(sim), 0
                while lo < len(sizes):
                    hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + BATCH_UNITS)))
                    at = slice(int(starts[lo]), int(starts[hi - 1] + sizes[hi - 1]))
                    value, _ = UnitBatch(sizes[lo:hi], code[at], pred[at], np.ones(at.stop - at.start, bool), len(attrs), options).logit(*line)
                    yield pa.array(value, mask=sizes[lo:hi] == 0)
                    lo = hi

    return pairs.select("id", logit(*[words_of(F.col(prefix + a)) for prefix in (LEFT, RIGHT) for a in attrs]).alias("logit"))


def feature_vectors(
    units: DataFrame, attrs: Sequence[str], stats: Sequence[str] = STATS, derived: bool = True,
    fill_first: bool = False, **options,
) -> DataFrame:
    """``id, features``: one array per pair with units, in the order of ``feature_names``.

    ``units`` are unit rows or packed pairs.  Side scopes always fill a
    missing class with 0 before deriving; the overall scope does so only
    with ``fill_first``.
    """
    packed = units if is_packed(units) else packed_units(units)
    made = with_pair_values(packed, attrs, Options(tuple(stats), derived, fill_first, **options))
    return made.filter("features is not null").select("id", "features")


def features_long(vectors: DataFrame, names: Sequence[str]) -> DataFrame:
    """``id, feature, value`` rows of feature vectors."""
    rows = exploded(vectors, ["id"], F.col("features"), "value", "at")
    return rows.select("id", F.element_at(F.lit(list(names)), F.col("at") + 1).alias("feature"), "value")


def minimal_features(units: DataFrame, **options) -> DataFrame:
    """Mean and count of all, paired and unpaired units only."""
    members = memberships(units, (), **options)
    grouped = group_statistics(members.filter(F.col("grp").isin("all", "paired", "unpaired")), ("mean", "count"))
    maps = grouped.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("grp", "stats"))).alias("g"))
    return maps.select("id", *[
        F.coalesce(F.col("g")[grp][i], F.lit(0.0)).alias(f"{s}_{grp}")
        for grp in ("paired", "unpaired", "all") for i, s in enumerate(("mean", "count"))
    ])
