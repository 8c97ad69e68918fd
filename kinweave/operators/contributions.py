"""Shares of every feature value per unit, and token contributions.

A share says how much of a feature's value comes from one unit; the shares
of a feature sum to its value.  ``contributions_long``, ``unit_shares`` and
``token_contributions`` take them from the unit arrays of a pair in the task
that holds the pair.  ``shares`` gives those of membership rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.numbers import rounded_values
from kinweave.operators.features import _batches, _codes, is_packed, packed_units, unit_table, with_pair_values
from kinweave.operators.segments import SHARPNESS, STATS, Options, UnitBatch, block_numbers, feature_names, group_names

KEYS = ("id", "scope", "grp")


def _softmax(x: Column, w) -> Column:
    e = F.exp(x - F.max(x).over(w))
    return e / F.sum(e).over(w)


def median_row(value: str, w_keys: Sequence[str], tie: str = "unit_no") -> Column:
    """True on the row whose percentile rank (ties averaged) is nearest one half."""
    group = Window.partitionBy(*w_keys)
    first = F.rank().over(group.orderBy(value))
    same = F.count("*").over(Window.partitionBy(*w_keys, value))
    distance = F.abs((first + (same - 1) / 2) / F.count("*").over(group) - 0.5)
    return F.row_number().over(group.orderBy(F.round(distance, 12), tie)) == 1


def shares(members: DataFrame, stats: Sequence[str] = STATS, mode: str | Sequence[str] = "proportional",
           attrs: Sequence[str] | None = None) -> DataFrame:
    """One share column ``sh_{i}`` per statistic for every member of a group, from membership rows or packed pairs.

    Packed pairs need ``attrs``; their groups are made where the pair is, and
    several modes in one pass, with a column ``mode`` (see ``unit_shares``).
    Rows are sorted once for every order that a share asks for.

    ``mode``: ``proportional`` weights units by a softmax of their size
    relative to the extreme, ``softmax`` by a softmax of the raw value, and
    ``index`` gives the whole extreme to the unit that holds it.
    """
    if is_packed(members):
        made = unit_shares(members, attrs, stats, [mode] if isinstance(mode, str) else mode)
        return made.drop("mode") if isinstance(mode, str) else made
    w = Window.partitionBy(*KEYS)
    v = F.col("v")
    high, low, mid = F.max("v").over(w), F.min("v").over(w), F.median("v").over(w)
    df = members.withColumns({"_n": F.count("*").over(w), "_max": high, "_min": low, "_mid": mid})

    if mode == "index":
        def extreme(order) -> Column:
            return F.when(F.row_number().over(w.orderBy(order, "unit_no")) == 1, v).otherwise(0.0)

        df = df.withColumn("_is_mid", median_row("v", KEYS))
        top, bottom = extreme(F.desc("v")), extreme(F.asc("v"))
        middle = F.when(F.col("_is_mid"), v).otherwise(0.0)
    else:
        def share(extreme: str, x: Column) -> Column:
            # no extreme to spread when it is zero
            return F.when(F.col(extreme) == 0, 0.0).otherwise(F.col(extreme) * _softmax(x, w))

        relative = mode == "proportional"
        df = df.withColumns({
            "_xmax": F.when(F.col("_max") == 0, 0.0).otherwise(v / F.col("_max")) * SHARPNESS if relative else v * SHARPNESS,
            "_xmin": F.when(F.col("_min") == 0, 0.0).otherwise(v / F.col("_min")) * -SHARPNESS if relative else v * -SHARPNESS,
            "_xmid": F.abs(v - F.col("_mid")) * -SHARPNESS,
        })
        top, bottom, middle = (share(a, F.col(b)) for a, b in (("_max", "_xmax"), ("_min", "_xmin"), ("_mid", "_xmid")))
    df = df.withColumns({"_top": top, "_bottom": bottom, "_middle": middle})
    known = {
        "mean": v / F.col("_n"), "sum": v, "count": F.lit(1.0), "min": F.col("_bottom"), "max": F.col("_top"),
        "M-m": F.col("_top") - F.col("_bottom"), "median": F.col("_middle"),
    }
    return df.select(
        "id", "unit_no", "scope", "grp", *[known[s].alias(f"sh_{i}") for i, s in enumerate(stats)])


def contributions_long(
    units: DataFrame, attrs: Sequence[str], stats: Sequence[str] = STATS, mode: str = "proportional", derived: bool = True,
    features: Sequence[str] | None = None, digits: int | None = None, **options,
) -> DataFrame:
    """``id, unit_no, feature, value`` for every share that is not zero; ``units`` are unit rows or packed pairs.

    With ``features`` only shares of these are made.  With ``digits`` values
    are rounded, and those that come out as 0 are left out in the task.
    """
    attrs, names = list(attrs), feature_names(attrs, stats, derived)
    settings = Options(tuple(stats), derived, mode=mode, **options)
    first, some = block_numbers(attrs, stats, derived), set(names if features is None else features)
    wanted = {block: np.array([i for i in range(len(stats)) if names[at + i] in some], np.int64) for block, at in first.items()}
    wanted = {block: numbers for block, numbers in wanted.items() if len(numbers)}

    def parts(batch: UnitBatch):
        for unit, feature, value in batch.share_parts(first, wanted):
            if digits is not None:
                value = rounded_values(value, digits)
                kept = np.flatnonzero(value)
                unit, feature, value = unit[kept], feature[kept], value[kept]
            yield unit, [pa.array(feature.astype(np.int32)), pa.array(value)]

    rows = _unit_parts(units, attrs, [settings], lambda batch, _: parts(batch), "feature int, value double")
    return rows.select("id", "unit_no", F.element_at(F.lit(names), F.col("feature") + 1).alias("feature"), "value")


def _unit_parts(units: DataFrame, attrs: list[str], settings: Sequence[Options], make, columns: str) -> DataFrame:
    """Rows ``id, unit_no`` and ``columns`` that ``make`` gives for a batch of units, as unit positions and Arrow columns.

    ``make`` takes a batch and the number of its settings.  Rows leave the
    task function as they are made, never as arrays that are taken apart again.
    """
    packed = units if is_packed(units) else packed_units(units)
    fields = packed.schema["units"].dataType.elementType
    numbered = "unit_no" in fields.names
    kind = fields["unit_no"].dataType.simpleString() if numbered else "int"
    sent = packed.select("id", "preds", _codes(attrs).alias("codes"), *([F.col("units.unit_no").alias("numbers")] if numbered else []))
    names = ["id", "unit_no", *[c.split()[0] for c in columns.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for k, one in enumerate(settings):
                pair = unit = 0  # pairs and units before a part
                for sizes, batch in _batches(given.column("codes"), given.column("preds"), len(attrs), one):
                    ids = given.column("id").slice(pair, len(sizes))
                    numbers = given.column("numbers").flatten().slice(unit, len(batch.row)) if numbered else pa.array(
                        (np.arange(len(batch.row)) - (np.cumsum(sizes) - sizes)[batch.row]).astype(np.int32))
                    for at, made in make(batch, k):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(batch.row[at])), numbers.take(pa.array(at)), *made], names=names)
                    pair, unit = pair + len(sizes), unit + len(batch.row)

    return sent.mapInArrow(run, f"id {packed.schema['id'].dataType.simpleString()}, unit_no {kind}, {columns}")


def unit_shares(units: DataFrame, attrs: Sequence[str], stats: Sequence[str] = STATS, modes: Sequence[str] = ("proportional",), **options) -> DataFrame:
    """``id, unit_no, mode, scope, grp`` and a share column ``sh_{i}`` per statistic, as ``shares`` has them, for every mode.

    ``units`` are unit rows or packed pairs.  All groups of a pair are made
    where the pair is, from one sort of its members, and in one pass for all modes.
    """
    attrs, groups = list(attrs), group_names(list(attrs))
    settings = [Options(tuple(stats), False, mode=m, **options) for m in modes]

    def parts(batch: UnitBatch, k: int):
        unit, group, share = batch.member_shares()
        yield unit, [pa.array(np.full(len(unit), k, np.int32)), pa.array(group.astype(np.int32)),
                     *[pa.array(np.ascontiguousarray(share[:, i]), from_pandas=True) for i in range(len(stats))]]

    columns = ", ".join(["mode int", "grp int", *[f"sh_{i} double" for i in range(len(stats))]])
    rows = _unit_parts(units, attrs, settings, parts, columns)

    def name(texts: Sequence[str], number: str) -> Column:
        return F.element_at(F.lit(list(texts)), F.col(number) + 1)

    return rows.select("id", "unit_no", name(modes, "mode").alias("mode"), name([s for s, _ in groups], "grp").alias("scope"),
                       name([g for _, g in groups], "grp").alias("grp"), *[f"sh_{i}" for i in range(len(stats))])


def token_contributions(
    units: DataFrame, coef: Mapping[str, float], attrs: Sequence[str], stats: Sequence[str] = STATS,
    mode: str = "proportional", derived: bool = True, **options,
) -> DataFrame:
    """Unit rows with ``token_contribution``, the unit's share of the linear score.

    ``coef`` maps feature names to coefficients on unscaled features; ``units``
    are unit rows or packed pairs.
    """
    packed = units if is_packed(units) else packed_units(units)
    made = with_pair_values(packed, attrs, Options(tuple(stats), derived, mode=mode, **options), coef)
    return unit_table(made.drop("features"), token_contribution="contributions")
