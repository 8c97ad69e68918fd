"""Plain Python versions of the text operators, for small inputs."""

import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile("[^ \t-\r]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), s)


def quality(text):
    t = text or ""
    words = WORD.findall(t)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside),
            len(words) < 10 or 100 * len(inside) > 20 * len(words))


def fingerprint(text, size=4):
    from xxhash import xxh64_intdigest

    words = WORD.findall(lower(text or ""))
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """Smallest reachable node of each; ``linked(i, j)`` over positions."""
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    best = {}
    for i, n in enumerate(nodes):
        r = find(i)
        if n is not None:
            best[r] = min(best.get(r, n), n)
    return [best.get(find(i)) for i in range(len(nodes))]


def pieces(ids, capacity=1024):
    out, end = [], len(ids)
    while end > 0:
        out.append((max(0, end - capacity), end))
        end -= capacity
    return [(s, e - s, zlib.crc32(np.asarray(ids[s:e], "<u4").tobytes())) for s, e in reversed(out)]


def removed_lines(docs, num=4, den=5):
    """(id, line number) of every line with an earlier similar line; ``docs`` are (id, text) in order of id."""
    seen, gone = [], set()
    for i, text in docs:
        for no, line in enumerate((text or "").split("\n")):
            words = set(WORD.findall(line))
            if not words:
                continue
            for other in seen:
                if num * max(len(words), len(other)) > den * min(len(words), len(other)):
                    continue
                both = len(words & other)
                if both * den >= (len(words) + len(other) - both) * num:
                    gone.add((i, no))
                    break
            seen.append(words)
    return gone


def licenses(text, rules):
    """Base places and kept detections of one text, straight from the rule table."""
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    base, found = [], []
    for at, w in enumerate(words):
        for rule, label, priority, weight, keyword, before, after in rules:
            if keyword == w:
                left = re.search(before, " " + "".join(x + " " for x in words[max(0, at - 16):at]))
                right = re.search(after, " " + "".join(x + " " for x in words[at + 1:at + 17]))
                if left and right:
                    span = (at - len(left[0].split()), at + 1 + len(right[0].split()))
                    (base if priority == 0 else found).append((*span, priority, rule, label, weight))
    kept = [
        d for d in found
        if not any(e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] and ((e[0], e[1]) != (d[0], d[1]) or e[2] > d[2] or e[3] < d[3]) for e in found)
    ]
    labels = sorted({d[4] for d in base + kept})
    starts = [d[0] for d in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({d[4] for d in base})),
            ",".join(labels), max((d[5] for d in base + kept), default=0.0))


def repeated_passages(docs, passage=50):
    """Maximal repeated passages of the distinct texts, and whole-text copies; ``docs`` are (id, text)."""
    first, copies = {}, set()
    for i, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        if text is not None and text in first and i != first[text]:
            n = len(WORD.findall(text))
            if n >= passage:
                copies.add((i, 0, n, first[text]))
        first.setdefault(text, i)
    words = {i: WORD.findall(lower(t or "")) for t, i in first.items()}
    where = {}
    for i, w in words.items():
        for s in range(len(w) - passage + 1):
            where.setdefault(tuple(w[s:s + passage]), []).append((i, s))
    covered = {}
    for places in where.values():
        if len(places) > 1:
            for i, s in places:
                covered.setdefault(i, []).append(s)
    out = set(copies)
    for i, starts in covered.items():
        starts.sort()
        begin = last = starts[0]
        for s in [*starts[1:], None]:
            if s is None or s > last + passage:
                out.add((i, begin, last - begin + passage, None))
                begin = s
            last = s
    return out


UNITS = set("km m cm mm mi mile miles ft feet foot inch inches yd yard yards kg g mg lb lbs oz pound pounds ton tons l ml liter liters "
            "litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months "
            "year years usd eur dollar dollars euro euros cent cents percent mph kmh".split())


def leaks(docs, items, window=8, near=4):
    """(doc, item, start, covered words) of consistent alignments covering half an item, the best of each pair."""
    import regex

    cap = r"\p{Lu}\p{Ll}[\p{L}\p{M}\p{N}]*+"
    name = rf"(?<=[\p{{L}}\p{{M}}\p{{N}},;)]) {cap}(?:[ '-]{cap}){{0,7}}"
    word = regex.compile(rf"{name}|\p{{N}}+(?:[.,]\p{{N}}+)+|[\p{{L}}\p{{M}}\p{{N}}]+")

    def kind(w):
        if w[0] == " ":
            return "<name>"
        if regex.match(r"\p{N}", w):
            return "<number>"
        return "<unit>" if w.lower() in UNITS else w.lower()

    def read(text):
        words = word.findall(text or "")
        return [w.strip().lower() for w in words], [kind(w) for w in words]

    def consistent(cover, ivalues, ikinds, values):
        slots = {}
        for p, shift in cover.items():
            if ikinds[p][0] == "<":
                slots.setdefault((ikinds[p], ivalues[p]), set()).add(values[p + shift])
        return all(len(v) == 1 for v in slots.values())

    read_items = []
    for i, t in items:
        t = (t or "").strip(" ")
        for r, form in enumerate((t, ", " + t, t.lower())):
            read_items.append((i, r, *read(form)))
    best, first = {}, {}
    for d, text in docs:
        values, kinds = read(text)
        places = {}
        for size in range(1, window + 1):
            for s in range(len(kinds) - size + 1):
                places.setdefault(tuple(kinds[s:s + size]), []).append(s)
        for i, r, ivalues, ikinds in read_items:
            size = min(window, len(ikinds))
            shifts = {}
            for s in range(len(ikinds) - size + 1 if size else 0):
                for at in places.get(tuple(ikinds[s:s + size]), []):
                    shifts.setdefault(at - s, set()).add(s)
            if not shifts:
                continue
            covers = {shift: {s + k for s in starts for k in range(size)} for shift, starts in shifts.items()}
            rank = lambda shift: (-len(covers[shift]), shift)
            top = min(covers, key=rank)
            tried = [(True, [shift]) for shift in covers] + [(False, [x for x in covers if abs(x - top) <= near])]
            for single, chosen in tried:
                by_start, cover = {}, {}
                for shift in sorted(chosen, key=rank):
                    for s in shifts[shift]:
                        by_start.setdefault(s, shift)
                if not single and len(set(by_start.values())) < 2:
                    continue
                for s, shift in sorted(by_start.items(), key=lambda x: rank(x[1])):
                    for k in range(size):
                        cover.setdefault(s + k, shift)
                if 2 * len(cover) < len(ikinds) or first.setdefault((d, i), r) < r:
                    continue
                if consistent(cover, ivalues, ikinds, values):
                    at = min(s + shift for s, shift in by_start.items())
                    best[d, i] = max(best.get((d, i), ()), (single, len(cover), -at))
    return {(d, i, -b[2], b[1]) for (d, i), b in best.items()}


def kneser_ney(train, texts, encode, size, mark):
    """Perplexity of every text under a bigram model of ``train``; ``encode`` gives a list of ids."""
    import math

    def read(t):
        ids = [mark, *encode(t or ""), mark]
        return list(zip(ids, ids[1:]))

    def discount(counts):
        n = Counter(counts)
        n1, n2, n3, n4 = n[1], n[2], n[3], n[4]
        if not n1 or not n2:
            d = [0.5, 0.5, 0.5]
        else:
            y = n1 / (n1 + 2 * n2)
            d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
            d = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]
        return lambda c: d[min(c, 3) - 1]

    c2 = Counter(b for t in train for b in read(t))
    c1 = Counter(w for _, w in c2)
    d2, d1 = discount(c2.values()), discount(c1.values())
    types = sum(c1.values())
    spare = sum(map(d1, c1.values())) / types if types else 1.0
    p1 = lambda w: ((c1[w] - d1(c1[w])) / types if c1[w] else 0) + spare / size
    all_, back = Counter(), Counter()
    for (v, _), c in c2.items():
        all_[v] += c
        back[v] += d2(c)

    def p2(v, w):
        if not all_[v]:
            return p1(w)
        c = c2[v, w]
        return (c - d2(c) if c else 0) / all_[v] + back[v] / all_[v] * p1(w)

    return [math.exp(-sum(math.log(p2(*b)) for b in read(t)) / len(read(t))) for t in texts]
