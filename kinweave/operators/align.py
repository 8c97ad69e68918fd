"""Alignment of the words of both sides into decision units.

Both sides rank partners by the same similarity, so with a strict order on
edges the stable matching is unique and equals taking edges best-first.
Edges and matching stay in one task function: it makes a batch's edges in
blocks of bounded size, goes once over them with a flag per word, and returns
only the matched slots.  Every pair takes this way, long or short, and the
alignment needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.vectors import zeros
from kinweave.operators.similarity import (
    CELLS, Edges, WordPairs, bounds, edge_maker, list_array, listed_edges, row_blocks, with_edges,
)
from kinweave.operators.tokens import computed_once, exploded, pair_tokens

UNPAIRED = "[UNP]"
SLOT = "array<struct<pass_no:int,l:int,r:int,sim:double>>"


@dataclass(frozen=True)
class Thresholds:
    """Least similarity of a pair inside an attribute, across attributes, and of a repeated use of a word."""

    unpair: float = 0.60
    cross: float = 0.65
    duplicate: float = 0.75

    @property
    def least(self) -> float:
        return min(self.unpair, self.cross, self.duplicate)


@dataclass(frozen=True)
class Passes:
    """Which edges may pair in which pass; similarities are compared as ``k = -similarity``.

    ``many``: edges above it are all taken.  ``first``: one-to-one from it up,
    inside an attribute if ``same_attribute``.  ``second``: one-to-one among the
    words left.  ``again``: a word still alone takes any opposite word.
    """

    many: float | None = None
    first: float | None = None
    same_attribute: bool = False
    second: float | None = None
    again: float | None = None

    @property
    def alone(self) -> tuple[int, int]:
        """Pass numbers of single left and right words."""
        return (4, 3) if self.again is not None else (1, 1)


def _free_edges(left: np.ndarray, right: np.ndarray, used_left: np.ndarray, used_right: np.ndarray) -> np.ndarray:
    """Of edges in order those whose two words are still free; their words are taken."""
    free_left, free_right = bytearray(~used_left), bytearray(~used_right)
    taken = []
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        if free_left[a] and free_right[b]:
            free_left[a] = free_right[b] = 0
            taken.append(i)
    taken = np.asarray(taken, np.int64)
    used_left[left[taken]] = True
    used_right[right[taken]] = True
    return taken


def slot_values(edges: Edges | WordPairs, l_attrs: pa.Array, r_attrs: pa.Array, p: Passes) -> tuple[np.ndarray, ...]:
    """Slots ``row, pass number, left place, right place, similarity`` in order: pairs of the passes, then the words that
    stay alone with position -1 on the other side."""
    (ls, ln), (rs, rn) = bounds(l_attrs), bounds(r_attrs)
    used_l, used_r = np.zeros(int(ln.sum()), bool), np.zeros(int(rn.sum()), bool)
    parts = []
    if p.same_attribute:
        coded = pa.concat_arrays([l_attrs.flatten().cast(pa.string()), r_attrs.flatten().cast(pa.string())]).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)

    def one_to_one(number: int, least: float, most: float, over_l: np.ndarray, over_r: np.ndarray, same: bool = False) -> None:
        for row, k, l, r in edges.bands(least, most, ls, rs, over_l, over_r):
            left, right = ls[row] + l, rs[row] + r
            if same:
                ok = np.flatnonzero(code[left] == code[len(used_l) + right])
                row, k, l, r, left, right = (x[ok] for x in (row, k, l, r, left, right))
            i = _free_edges(left, right, over_l, over_r)
            parts.append((row[i], np.full(len(i), number), l[i], r[i], -k[i]))

    least = -np.inf
    if p.many is not None:
        none = np.zeros_like(used_l), np.zeros_like(used_r)
        for row, k, l, r in edges.bands(-np.inf, np.nextafter(-p.many, -np.inf), ls, rs, *none):
            used_l[ls[row] + l] = True
            used_r[rs[row] + r] = True
            parts.append((row, np.full(len(row), 1), l, r, -k))
        least = -p.many
    if p.first is not None:
        one_to_one(1, least, -p.first, used_l, used_r, p.same_attribute)
    if p.second is not None:
        one_to_one(2, -np.inf, -p.second, used_l, used_r)
    alone_l, alone_r = ~used_l, ~used_r
    if p.again is not None:
        # the two turns do not see each other
        over_l, over_r = used_l.copy(), used_r.copy()
        one_to_one(3, -np.inf, -p.again, np.zeros_like(used_l), over_r)
        one_to_one(4, -np.inf, -p.again, over_l, np.zeros_like(used_r))
        alone_l, alone_r = ~over_l, ~over_r
    left_pass, right_pass = p.alone
    for alone, starts, sizes, number, is_left in ((alone_l, ls, ln, left_pass, True), (alone_r, rs, rn, right_pass, False)):
        at = np.flatnonzero(alone)
        row = np.repeat(np.arange(len(sizes)), sizes)[at]
        place, none = at - starts[row], np.full(len(at), -1)
        parts.append((row, np.full(len(at), number), place if is_left else none, none if is_left else place, np.zeros(len(at))))
    row, number, l, r, sim = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((r, l, number, row))
    return row[order], number[order], l[order], r[order], sim[order] + 0.0


def matched_slots(edges: Edges | WordPairs, l_attrs: pa.Array, r_attrs: pa.Array, p: Passes) -> pa.Array:
    """Slots of every row as lists (see ``slot_values``)."""
    row, number, l, r, sim = slot_values(edges, l_attrs, r_attrs, p)
    int_ = lambda x: pa.array(x.astype(np.int32))
    items = pa.StructArray.from_arrays([int_(number), int_(l), int_(r), pa.array(sim)], ["pass_no", "l", "r", "sim"])
    return list_array(row, items, len(l_attrs))


def _with_slots(edged: DataFrame, p: Passes) -> DataFrame:
    """``slots`` for a table that has its edges as a column."""
    @F.arrow_udf(SLOT)
    def slots(edges: pa.Array, l_attrs: pa.Array, r_attrs: pa.Array) -> pa.Array:
        return matched_slots(listed_edges(edges), l_attrs, r_attrs, p)

    # a task function does not take an argument that holds a lambda
    return computed_once(edged, "edges").withColumn("slots", slots("edges", F.col("l_toks.attr"), F.col("r_toks.attr")))


def most_similar(edged: DataFrame, unpair: float, duplicate: float | None) -> DataFrame:
    """Pairs over ``duplicate`` many-to-many, the rest one-to-one from ``unpair`` up, then single words."""
    return _with_slots(edged, Passes(many=duplicate, first=unpair))


def above_threshold(edged: DataFrame, duplicate: float) -> DataFrame:
    """Every pair over the threshold, then the words that have none."""
    return _with_slots(edged, Passes(many=duplicate))


def schema_passes(edged: DataFrame, t: Thresholds) -> DataFrame:
    """Inside attributes, across attributes, then each leftover word against all opposite words."""
    return _with_slots(edged, _schema(t))


def _schema(t: Thresholds) -> Passes:
    return Passes(first=t.unpair, same_attribute=True, second=t.cross, again=t.duplicate)


def unit_arrays(matched: DataFrame, with_vectors: int | None = None) -> DataFrame:
    """``id, label, units``: the units of a pair in the order of ``(pass_no, l, r)``.

    ``with_vectors`` is the vector width when units should carry both
    vectors (zeros on a missing side).
    """
    def unit(s: Column) -> Column:
        left, right = F.get("l_toks", s["l"]), F.get("r_toks", s["r"])
        fields = [
            s["pass_no"].alias("pass_no"), s["l"].alias("left_pos"), s["r"].alias("right_pos"),
            F.coalesce(left["word"], F.lit(UNPAIRED)).alias("left_word"),
            F.coalesce(right["word"], F.lit(UNPAIRED)).alias("right_word"),
            s["sim"].alias("cos_sim"),
            F.coalesce(left["attr"], F.lit(UNPAIRED)).alias("left_attribute"),
            F.coalesce(right["attr"], F.lit(UNPAIRED)).alias("right_attribute"),
        ]
        if with_vectors is not None:
            empty = zeros(with_vectors).cast("array<float>")
            fields += [F.coalesce(left["vec"], empty).alias("left_vec"),
                       F.coalesce(right["vec"], empty).alias("right_vec")]
        return F.struct(*fields)

    return matched.select("id", "label", F.transform("slots", unit).alias("units"))


def _rows(packed: DataFrame) -> DataFrame:
    return exploded(packed, ["id", "label"], F.col("units"), "u", "unit_no").select("id", "unit_no", "u.*", "label")


def unit_rows(matched: DataFrame, with_vectors: int | None = None) -> DataFrame:
    """Explode ``slots`` into units; ``unit_no`` numbers them."""
    return _rows(unit_arrays(matched, with_vectors))


def _passes(t: Thresholds, use_schema: bool) -> tuple[Passes, float]:
    """The passes, and the least similarity that they look at."""
    return (_schema(t), t.least) if use_schema else (Passes(many=t.duplicate, first=t.unpair), min(t.unpair, t.duplicate))


def slot_maker(thresholds: Thresholds = Thresholds(), similarity="jaro_winkler", use_schema: bool = True, cells: int = CELLS):
    """The token field that is compared, and a function that cuts a batch's columns (that field and the attributes of
    both sides) into bounded blocks of rows and gives each with its slots; None for a Column similarity."""
    passes, least = _passes(thresholds, use_schema)
    made = edge_maker(least, similarity, cells)
    if made is None:
        return None
    field, make = made

    def slots(*columns: pa.Array) -> Iterator[tuple[list[pa.Array], tuple[np.ndarray, ...]]]:
        for at in row_blocks(columns[0], columns[1], 8 * cells):
            block = [c.slice(at.start, at.stop - at.start) for c in columns]
            yield block, slot_values(make(*block[:2]), *block[2:], passes)

    return field, slots


def _aligned(
    tokens: DataFrame, thresholds: Thresholds = Thresholds(), similarity="jaro_winkler", use_schema: bool = True,
    with_vectors: int | None = None, cells: int = CELLS,
) -> DataFrame:
    passes, least = _passes(thresholds, use_schema)
    made = edge_maker(least, similarity, cells)
    if made is None:
        return unit_arrays(_with_slots(with_edges(tokens, least, similarity), passes), with_vectors)
    field, make = made

    @F.arrow_udf(SLOT)
    def slots(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right, l_attrs, r_attrs in columns:
            for at in row_blocks(left, right, 8 * cells):
                a, b, x, y = (c.slice(at.start, at.stop - at.start) for c in (left, right, l_attrs, r_attrs))
                yield matched_slots(make(a, b), x, y, passes)

    of = lambda side, x: F.col(f"{side}_toks.{x}")
    matched = tokens.withColumn("slots", slots(of("l", field), of("r", field), of("l", "attr"), of("r", "attr")))
    return unit_arrays(matched, with_vectors)


def align_pairs(tokens: DataFrame, *args, **options) -> DataFrame:
    """``id, label, units``: a row per pair of ``tokens`` (see ``pair_tokens``), with its decision units in an array.

    ``cells`` bounds the similarities a task holds at a time.  A Column
    similarity makes its edges in the JVM; the matching is the same.
    """
    return computed_once(_aligned(tokens, *args, **options), "units")


def align_tokens(tokens: DataFrame, *args, **options) -> DataFrame:
    """Decision units as rows; takes what ``align_pairs`` takes."""
    return _rows(_aligned(tokens, *args, **options))


def align_units(pairs: DataFrame, attrs: Sequence[str] | None = None, **options) -> DataFrame:
    """Decision units of record pairs by word similarity."""
    return align_tokens(pair_tokens(pairs, attrs), **options)


# ---- two preference lists ------------------------------------------------------------------------

def deferred_acceptance(left: list[list[int]], right: list[list[int]]) -> list[tuple[int, int]]:
    """Stable pairs where each side has its own order of partners, best first.

    The shorter side proposes, the left one if both are as long, and gets the
    best partners that any stable matching gives it.  A partner that a list
    leaves out is not accepted; who has no partner left stays alone.
    """
    turned = len(left) > len(right)
    ask, choose = (right, left) if turned else (left, right)
    rank = [{a: i for i, a in reversed(list(enumerate(order)))} for order in choose]
    turn, taken = [0] * len(ask), {}
    free = list(range(len(ask)))
    while free:
        a = free.pop()
        while turn[a] < len(ask[a]):
            b = ask[a][turn[a]]
            turn[a] += 1
            if not 0 <= b < len(rank) or a not in rank[b]:
                continue
            held = taken.get(b)
            if held is None or rank[b][a] < rank[b][held]:
                taken[b] = a
                if held is not None:
                    free.append(held)
                break
    return sorted((b, a) if turned else (a, b) for b, a in taken.items())


def preference_lists(tokens: DataFrame, left_cost: Callable[[Column, Column], Column], right_cost: Callable[[Column, Column], Column]) -> DataFrame:
    """``l_pref, r_pref`` next to the tokens: for every word the opposite positions, lowest cost first, ties by position.

    A cost is a Column of a word and its opposite; a null cost leaves the partner out.
    """
    def lists(own: str, other: str, cost: Callable[[Column, Column], Column]) -> Column:
        def of(x: Column) -> Column:
            some = F.filter(F.transform(other, lambda y: F.struct(cost(x["word"], y["word"]).alias("c"), y["pos"].alias("p"))), lambda s: s["c"].isNotNull())
            return F.transform(F.sort_array(some), lambda s: s["p"])

        return F.transform(own, of)

    return tokens.withColumns({"l_pref": lists("l_toks", "r_toks", left_cost), "r_pref": lists("r_toks", "l_toks", right_cost)})


def stable_pairs(df: DataFrame, left: str = "l_pref", right: str = "r_pref") -> DataFrame:
    """``id, left_pos, right_pos``: one-to-one pairs that no two words would both leave, from two preference lists a pair."""
    @F.arrow_udf("array<struct<l:int,r:int>>")
    def matched(lefts: pa.Array, rights: pa.Array) -> pa.Array:
        found = [deferred_acceptance(a or [], b or []) for a, b in zip(lefts.to_pylist(), rights.to_pylist(), strict=True)]
        return pa.array([[{"l": l, "r": r} for l, r in pairs] for pairs in found], pa.list_(pa.struct([("l", pa.int32()), ("r", pa.int32())])))

    once = computed_once(df.select("id", left, right), left, right).withColumn("_pairs", matched(left, right))
    return exploded(once, ["id"], F.col("_pairs"), "p").select("id", F.col("p.l").alias("left_pos"), F.col("p.r").alias("right_pos"))
