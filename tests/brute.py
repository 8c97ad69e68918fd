"""Plain Python versions of the alignment, the features and the shares, for small fixtures."""

import math
import statistics

from kinweave.functions.strings import jaro_winkler

UNP = "[UNP]"


def best_first(edges):
    used_l, used_r, out = set(), set(), []
    for s, l, r in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        if l not in used_l and r not in used_r:
            used_l.add(l)
            used_r.add(r)
            out.append((l, r, s))
    return out


def align(left, right, unpair=0.6, cross=0.65, dup=0.75):
    """``left`` and ``right``: lists of (attr, word).  Returns sorted (pass_no, l, r, sim)."""
    sim = {(i, j): round(float(jaro_winkler([a[1]], [b[1]])[0]), 9) for i, a in enumerate(left) for j, b in enumerate(right)}

    def edges(ok):
        return [(s, i, j) for (i, j), s in sim.items() if ok(i, j, s)]

    out = []
    one = best_first(edges(lambda i, j, s: left[i][0] == right[j][0] and s >= unpair))
    out += [(1, *e) for e in one]
    free_l = set(range(len(left))) - {l for l, _, _ in one}
    free_r = set(range(len(right))) - {r for _, r, _ in one}
    two = best_first(edges(lambda i, j, s: i in free_l and j in free_r and s >= cross))
    out += [(2, *e) for e in two]
    free_l -= {l for l, _, _ in two}
    free_r -= {r for _, r, _ in two}
    three = best_first(edges(lambda i, j, s: j in free_r and s >= dup))
    four = best_first(edges(lambda i, j, s: i in free_l and s >= dup))
    out += [(3, *e) for e in three] + [(3, -1, r, 0.0) for r in free_r - {r for _, r, _ in three}]
    out += [(4, *e) for e in four] + [(4, l, -1, 0.0) for l in free_l - {l for l, _, _ in four}]
    return sorted(out)


def stats(values):
    return {"mean": statistics.fmean(values), "sum": sum(values), "count": len(values), "min": min(values),
            "max": max(values), "M-m": max(values) - min(values), "median": statistics.median(values)}


def group_values(units):
    """``units``: dicts of one pair.  Returns (scope, grp) -> list of values."""
    out = {}
    for u in units:
        excl = UNP in (u["left_word"], u["right_word"])
        paired = not excl and u["pred"] >= 0.5
        v = (u["pred"] - 0.5) * 2 if paired else 1 - 2 * u["pred"]
        kind = "paired" if paired else "unpaired"
        groups = [("allattr", "all", u["pred"]), ("allattr", kind, v)]
        if not paired:
            groups.append(("allattr", "unpaired_exclusive" if excl else "unpaired_both", v))
            if excl:
                groups.append(("allattr", "left" if u["left_word"] == UNP else "right", v))
        for side in ("left", "right"):
            if u[f"{side}_attribute"] != UNP:
                groups.append((f"{side}_{u[f'{side}_attribute']}", kind, v))
        for scope, grp, x in groups:
            out.setdefault((scope, grp), []).append(x)
    return out


def features(units, attrs, fill_first=False):
    values = group_values(units)
    st = {k: stats(v) for k, v in values.items()}
    out = {}
    scopes = [f"{s}_{a}" for s in ("left", "right") for a in attrs] + ["allattr"]
    for scope in scopes:
        fill = fill_first or scope != "allattr"
        for s in ("mean", "sum", "count", "min", "max", "M-m", "median"):
            def get(grp, implied=False):
                got = st.get((scope, grp), {}).get(s)
                return 0.0 if got is None and (fill or implied) else got

            some_unpaired = (scope, "unpaired") in st
            some_side = (scope, "left") in st or (scope, "right") in st
            base = {"paired": get("paired"), "unpaired": get("unpaired")}
            if scope == "allattr":
                base["all"] = get("all")
                base["unpaired_both"] = get("unpaired_both", some_unpaired)
                base["unpaired_exclusive"] = get("unpaired_exclusive", some_unpaired)
                l, r = get("left", some_side), get("right", some_side)
                base["unpaired_min"] = None if l is None else min(l, r)
                base["unpaired_max"] = None if l is None else max(l, r)
            for g, v in base.items():
                out[f"{s}_{g}_{scope}"] = v or 0.0
                if g.startswith("unpaired"):
                    x = g[len("unpaired"):]
                    p = base["paired"]
                    known = p is not None and v is not None
                    out[f"{s}_perc{x}_{scope}"] = p / (1e-9 + p + v) if known else 0.0
                    out[f"{s}_diff{x}_{scope}"] = p - v if known else 0.0
    return out


def softmax(xs):
    e = [math.exp(x - max(xs)) for x in xs]
    return [x / sum(e) for x in e]
