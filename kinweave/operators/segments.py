"""Statistics of a pair's units and their shares, over the unit arrays of a batch of pairs.

A batch's units lie one after the other.  Every unit is a member of a few
groups of its pair; sorted by (pair, group, value) a group is a segment, whose
sums, extremes and median are reductions over its ends.  Nothing leaves the
task, so features and contributions need no exchange.
"""

from __future__ import annotations

from collections.abc import Container, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np

# Names of statistics and groups, in the order of the feature vector.
STATS = ("mean", "sum", "count", "min", "max", "M-m", "median")
ADDITIVE_STATS = STATS[:3]
ALL = "allattr"
ALL_GROUPS = ("all", "paired", "unpaired", "unpaired_both", "unpaired_exclusive", "unpaired_min", "unpaired_max")
SIDE_GROUPS = ("paired", "unpaired")
ALL_UNPAIRED = ("_exclusive", "", "_both", "_min", "_max")
EPS = 1e-9
SHARPNESS = 10.0
OVER_ALL = ("all", "paired", "unpaired", "unpaired_both", "unpaired_exclusive", "left", "right")
LEFT_ALONE, RIGHT_ALONE = 1, 2  # flags of a unit's code


def scopes(attrs: Sequence[str]) -> list[str]:
    return [f"{side}_{a}" for side in ("left", "right") for a in attrs] + [ALL]


def layout(scope: str, stats: Sequence[str], derived: bool) -> list[str]:
    groups, unpaired = (ALL_GROUPS, ALL_UNPAIRED) if scope == ALL else (SIDE_GROUPS, ("",))
    names = [f"{s}_{g}" for g in groups for s in stats]
    if derived:
        names += [f"{s}_{kind}{x}" for x in unpaired for kind in ("perc", "diff") for s in stats]
    return names


def feature_names(attrs: Sequence[str], stats: Sequence[str] = STATS, derived: bool = True) -> list[str]:
    """Names in vector order; ``56 k + 119`` of them for ``k`` attributes."""
    return [f"{n}_{scope}" for scope in scopes(attrs) for n in layout(scope, stats, derived)]


@dataclass(frozen=True)
class Options:
    """How units become values.

    ``fill_first`` fills a missing class of the overall scope with 0 before
    features are derived; side scopes always do.  ``clip_exclusive`` caps the
    score of one-sided units at 0.5.
    """

    stats: Sequence[str] = STATS
    derived: bool = True
    fill_first: bool = False
    mode: str = "proportional"
    threshold: float = 0.5
    complementary: bool = True
    scaled: bool = True
    clip_exclusive: bool = False


def _add(target: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Sum rows of ``values`` into ``target`` at ``at``."""
    for i in range(values.shape[1]):
        target[:, i] += np.bincount(at, weights=values[:, i], minlength=len(target))


def _totals(n: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros((n, values.shape[1]))
    _add(out, at, values)
    return out


class UnitBatch:
    """Units of a batch of pairs: ``row`` is a unit's pair, ``code`` its missing sides and attributes, ``pred`` its score.

    A null score (``known`` is False) keeps its unit's groups but counts in no
    statistic, and what is derived from it is null.
    """

    def __init__(self, sizes: np.ndarray, code: np.ndarray, pred: np.ndarray, known: np.ndarray, k: int, options: Options):
        self.n, self.k, self.o = len(sizes), k, options
        self.groups = len(OVER_ALL) + 4 * k
        self.row = np.repeat(np.arange(self.n), sizes)
        alone = code & 3
        attr = code >> 2
        left, right = attr % (k + 1) - 1, attr // (k + 1) - 1
        exclusive = alone != 0
        with np.errstate(invalid="ignore"):
            # NaN is the largest number, as in SQL
            paired = ~exclusive & known & ((pred >= options.threshold) | np.isnan(pred))
        raw = np.where(exclusive, np.fmin(pred, 0.5), pred) if options.clip_exclusive else pred
        double = raw * 2 if options.scaled else raw
        value = np.where(paired, (raw - 0.5) * 2 if options.scaled else raw, 1 - double if options.complementary else double)
        every = np.arange(len(pred))
        kind = np.where(paired, 1, 2)
        single = np.flatnonzero(~paired & (exclusive | known))
        sided = np.flatnonzero(exclusive)
        members = [(every, np.zeros(len(pred), np.int64), raw), (every, kind, value),
                   (single, np.where(exclusive[single], 4, 3), value[single]),
                   (sided, np.where(alone[sided] & LEFT_ALONE, 5, 6), value[sided])]
        for side, shift in ((left, 0), (right, k)):
            at = np.flatnonzero(side >= 0)
            members.append((at, len(OVER_ALL) + 2 * (shift + side[at]) + (kind[at] - 1), value[at]))
        unit, group, v = (np.concatenate(x) for x in zip(*members, strict=True))
        segment = self.row[unit] * self.groups + group
        self.present = np.zeros(self.n * self.groups, bool)
        self.present[segment] = True
        self.unknown = np.bincount(self.row[~known], minlength=self.n) > 0
        counted = known[unit]
        self.uncounted = unit[~counted], segment[~counted]
        unit, segment, v = unit[counted], segment[counted], v[counted]
        order = np.lexsort((unit, v, segment))
        self.unit, self.segment, self.v = unit[order], segment[order], v[order]
        self.starts = np.flatnonzero(np.diff(self.segment, prepend=-1))
        self.ends = np.append(self.starts[1:], len(self.segment))
        self.size = self.ends - self.starts
        self.of = np.repeat(np.arange(len(self.starts)), self.size)  # segment number of a member
        self.low = self.v[self.starts] if len(self.v) else np.zeros(0)
        self.high = self.v[self.ends - 1] if len(self.v) else np.zeros(0)
        middle = self.starts + (self.size - 1) // 2, self.starts + self.size // 2
        self.mid = (self.v[middle[0]] + self.v[middle[1]]) / 2 if len(self.v) else np.zeros(0)

    # ---- features ---------------------------------------------------------------------------------

    @cached_property
    def statistics(self) -> np.ndarray:
        """``pairs x groups x statistics``; NaN where a group has no value."""
        total = np.add.reduceat(self.v, self.starts) if len(self.v) else np.zeros(0)
        known = {"mean": total / np.maximum(self.size, 1), "sum": total, "count": self.size.astype(float), "min": self.low,
                 "max": self.high, "M-m": self.high - self.low, "median": self.mid}
        out = np.full((self.n * self.groups, len(self.o.stats)), np.nan)
        if "count" in self.o.stats:
            out[:, self.o.stats.index("count")] = 0.0
        out[self.segment[self.starts]] = np.stack([known[s] for s in self.o.stats], axis=1)
        return out.reshape(self.n, self.groups, -1)

    def _scope_blocks(self, scope: int) -> Iterator[np.ndarray]:
        present = self.present.reshape(self.n, self.groups)
        last = scope == 2 * self.k
        fill = self.o.fill_first or not last

        def group(g: int, *parents: int) -> tuple[np.ndarray, np.ndarray]:
            """Statistics with 0 for an absent group, and whether they count: an absent class counts as long as its parent exists."""
            there = present[:, g]
            counts = np.ones(self.n, bool) if fill else present[:, list(parents) or [g]].any(axis=1)
            return np.where(there[:, None], self.statistics[:, g], 0.0), counts

        first = len(OVER_ALL) + 2 * scope
        if not last:
            paired, unpaired = group(first), {"": group(first + 1)}
            base = [paired, unpaired[""]]
        else:
            left, right = group(5, 5, 6), group(6, 5, 6)
            paired = group(1)
            unpaired = {"_exclusive": group(4, 2), "": group(2), "_both": group(3, 2),
                        "_min": (np.fmin(left[0], right[0]), left[1]), "_max": (np.maximum(left[0], right[0]), left[1])}
            base = [group(0), paired, *(unpaired[x] for x in ("", "_both", "_exclusive", "_min", "_max"))]
        for values, counts in base:
            yield np.where(counts[:, None], values, 0.0)
        if self.o.derived:
            p, known = paired
            for u, counts in unpaired.values():
                both = (known & counts)[:, None]
                with np.errstate(invalid="ignore", divide="ignore"):
                    yield np.where(both, p / (EPS + p + u), 0.0)
                yield np.where(both, p - u, 0.0)

    def features(self) -> np.ndarray:
        """``pairs x features`` in the order of ``feature_names``."""
        return np.concatenate([b for scope in range(2 * self.k + 1) for b in self._scope_blocks(scope)], axis=1)

    def logit(self, coef: np.ndarray, intercept: float) -> tuple[np.ndarray, np.ndarray]:
        """``features() @ coef + intercept``, added up feature by feature as ``vectors.dot`` does, and where it is null.

        Blocks are dropped as soon as they are added, so no vector of a pair is made.
        """
        out, null, at = np.zeros(self.n), np.zeros(self.n, bool), 0
        for scope in range(2 * self.k + 1):
            for block in self._scope_blocks(scope):
                if self.unknown.any():
                    null |= self.unknown & np.isnan(block).any(axis=1)
                for column in block.T:
                    out += column * coef[at]
                    at += 1
        return out + intercept, null

    # ---- shares -----------------------------------------------------------------------------------

    def _softmax(self, x: np.ndarray) -> np.ndarray:
        e = np.exp(x - np.maximum.reduceat(x, self.starts)[self.of])
        return e / np.add.reduceat(e, self.starts)[self.of]

    @cached_property
    def shares(self) -> np.ndarray:
        """``members x statistics``: the member's part of its group's statistics."""
        if not len(self.v):
            return np.zeros((0, len(self.o.stats)))
        v, n = self.v, self.size[self.of]
        if {"min", "max", "M-m", "median"} & set(self.o.stats):
            top, bottom, middle = self._index_shares() if self.o.mode == "index" else self._soft_shares()
        else:
            top = bottom = middle = v
        known = {"mean": v / n, "sum": v, "count": np.ones(len(v)), "min": bottom, "max": top, "M-m": top - bottom, "median": middle}
        return np.stack([known[s] for s in self.o.stats], axis=1)

    def _soft_shares(self) -> list[np.ndarray]:
        """Extremes spread by a softmax of the values, relative to the extreme or as they are."""
        relative, out = self.o.mode == "proportional", []
        for extreme, sign in ((self.high, 1.0), (self.low, -1.0), (self.mid, None)):
            e = extreme[self.of]
            if sign is None:
                x = np.abs(self.v - e) * -SHARPNESS
            elif relative:
                x = np.divide(self.v, e, out=np.zeros(len(e)), where=e != 0) * (sign * SHARPNESS)
            else:
                x = self.v * (sign * SHARPNESS)
            out.append(np.where(e == 0, 0.0, e * self._softmax(x)))
        return out

    def _index_shares(self) -> list[np.ndarray]:
        """The whole extreme for the member that holds it; ties go to the first unit."""
        def first(order: np.ndarray) -> np.ndarray:
            chosen = order[self.starts]
            out = np.zeros(len(self.v))
            out[chosen] = self.v[chosen]
            return out

        ranks = np.arange(len(self.v)) - self.starts[self.of]
        run = np.flatnonzero(np.concatenate([[True], (self.of[1:] != self.of[:-1]) | (self.v[1:] != self.v[:-1])]))
        length = np.diff(np.append(run, len(self.v)))
        # the percentile rank of equal values is that of their middle
        mean_rank = np.repeat(ranks[run] + 1 + (length - 1) / 2, length)
        distance = np.round(np.abs(mean_rank / self.size[self.of] - 0.5), 12)
        return [first(np.lexsort((self.unit, -self.v, self.of))), first(np.arange(len(self.v))),
                first(np.lexsort((self.unit, distance, self.of)))]

    def share_blocks(self, wanted: Container[tuple[int, str]]) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
        """``scope number, block name, units, shares`` for every wanted group, and for every derived one."""
        group = self.segment % self.groups
        pair = self.row[self.unit]
        at = [np.flatnonzero(group == g) for g in range(self.groups)]
        for scope in range(2 * self.k + 1):
            if scope < 2 * self.k:
                p, u = at[len(OVER_ALL) + 2 * scope], at[len(OVER_ALL) + 2 * scope + 1]
                rows = {"paired": (p, self.shares[p]), "unpaired": (u, self.shares[u])}
            else:
                rows = {g: (at[i], self.shares[at[i]]) for i, g in enumerate(OVER_ALL[:5])}
                # per pair and statistic the side with the smaller total is the minimum
                sides = np.concatenate([at[5], at[6]])
                is_left = np.arange(len(sides)) < len(at[5])
                less = (_totals(self.n, pair[at[5]], self.shares[at[5]]) < _totals(self.n, pair[at[6]], self.shares[at[6]]))[pair[sides]]
                smaller = is_left[:, None] == less
                rows["unpaired_min"] = sides, np.where(smaller, self.shares[sides], 0.0)
                rows["unpaired_max"] = sides, np.where(smaller, 0.0, self.shares[sides])
            for name, (members, share) in rows.items():
                if (scope, name) in wanted:
                    yield scope, name, self.unit[members], share
            if self.o.derived:
                for x in ALL_UNPAIRED if scope == 2 * self.k else ("",):
                    if (scope, f"diff{x}") not in wanted and (scope, f"perc{x}") not in wanted:
                        continue
                    members = np.concatenate([rows["paired"][0], rows[f"unpaired{x}"][0]])
                    diff = np.concatenate([rows["paired"][1], -rows[f"unpaired{x}"][1]])
                    n_paired = len(rows["paired"][0])
                    if (scope, f"diff{x}") in wanted:
                        yield scope, f"diff{x}", self.unit[members], diff
                    if (scope, f"perc{x}") in wanted:
                        yield scope, f"perc{x}", self.unit[members], self._ratio_shares(pair[members], diff, n_paired)

    def _ratio_shares(self, pair: np.ndarray, diff: np.ndarray, n_paired: int) -> np.ndarray:
        a = _totals(self.n, pair[:n_paired], diff[:n_paired])
        b = -_totals(self.n, pair[n_paired:], diff[n_paired:])
        positive, negative = _totals(self.n, pair, np.maximum(diff, 0.0)), -_totals(self.n, pair, np.minimum(diff, 0.0))
        with np.errstate(invalid="ignore", divide="ignore"):
            whole = (a + b) * (a + b) + EPS
            up = (a * a + a * b + b * b) / whole / (positive + EPS)
            down = b * b / whole / (negative + EPS)
        # without any paired share the feature is 0 and nothing is spread
        return np.where(np.abs(a)[pair] < 1e-12, 0.0, diff * np.where(diff > 0, up[pair], np.where(diff < 0, down[pair], 0.0)))

    def contributions(self, weights: Mapping[tuple[int, str], np.ndarray]) -> np.ndarray:
        """Weighted sum of every unit's shares; NaN in pairs with a null score."""
        out = np.zeros(len(self.row))
        for scope, name, units, share in self.share_blocks(weights):
            if len(units):
                out += np.bincount(units, weights=share @ weights[scope, name], minlength=len(out))
        out[self.unknown[self.row]] = np.nan
        return out

    def share_parts(self, first: Mapping[tuple[int, str], int],
                    wanted: Mapping[tuple[int, str], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What ``long_shares`` gives, a block at a time and in no order."""
        for scope, name, units, share in self.share_blocks(first if wanted is None else wanted):
            stats = np.arange(share.shape[1]) if wanted is None else wanted[scope, name]
            # a transposed copy: every statistic's values lie together
            columns = share.T[stats]
            j, i = np.nonzero(columns)
            yield units[i], first[scope, name] + stats[j], columns[j, i]

    def member_shares(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``unit, group number, shares`` of every member of a group; a null score has null (NaN) shares."""
        unit, segment = (np.concatenate(x) for x in zip((self.unit, self.segment), self.uncounted, strict=True))
        none = np.full((len(self.uncounted[0]), len(self.o.stats)), np.nan)
        return unit, segment % self.groups, np.concatenate([self.shares, none])

    def long_shares(self, first: Mapping[tuple[int, str], int], wanted: Mapping[tuple[int, str], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``unit, feature number, value`` of every share that is not 0, by unit; ``first`` numbers a block's first feature.

        ``wanted`` has the numbers of the statistics to take from a block; other blocks are not made.
        """
        unit, feature, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for u, f, v in self.share_parts(first, wanted):
            unit.append(u)
            feature.append(f)
            value.append(v)
        unit, feature, value = (np.concatenate(x) for x in (unit, feature, value))
        order = np.argsort(unit * (feature.max(initial=0) + 1) + feature, kind="stable")
        return unit[order], feature[order], value[order]


def group_names(attrs: Sequence[str]) -> list[tuple[str, str]]:
    """Scope and name of every group number."""
    return [(ALL, g) for g in OVER_ALL] + [(scope, g) for scope in scopes(attrs)[:-1] for g in SIDE_GROUPS]


def block_numbers(attrs: Sequence[str], stats: Sequence[str], derived: bool) -> dict[tuple[int, str], int]:
    """Number of the first feature of every (scope, block)."""
    out, at = {}, 0
    for i, scope in enumerate(scopes(attrs)):
        for n in layout(scope, stats, derived)[::len(stats)]:
            out[i, n[len(stats[0]) + 1:]] = at
            at += len(stats)
    return out
