"""String expressions and the string-similarity helpers used inside tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_WORD = 1024  # words up to this length are compared in vectorised steps
STEP_LETTERS = 1_600_000  # pairs times letters of a step

# Fixed value: the characters a whitespace split breaks on.
WHITESPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def words_of(col: Column) -> Column:
    """Whitespace tokens of a text column; NULL and blank text give an empty array.

    A split compiles its pattern for every row unless it is one plain character; a replacement keeps the pattern.
    """
    tokens = F.split(F.regexp_replace(col.cast("string"), f"[{WHITESPACE}]+", " "), " ")
    return F.coalesce(F.array_remove(tokens, ""), F.array().cast("array<string>"))


def collapse_spaces(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, f"[{WHITESPACE}]+", " "))


def strip_non_ascii(col: Column) -> Column:
    return F.regexp_replace(col, r"[^\x00-\x7F]", "")


def _jaro_long(a: str, b: str) -> float:
    window = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    matched_a = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                matched_a.append(ch)
                break
    if not matched_a:
        return 0.0
    matched_b = [b[j] for j, hit in enumerate(taken) if hit]
    swaps = sum(x != y for x, y in zip(matched_a, matched_b)) // 2
    m = len(matched_a)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3.0


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    width = max(int(lengths.max()), 1)
    chars = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
    return chars, lengths


def _compact(chars: np.ndarray, hit: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(chars), width), dtype=np.uint32)
    rows, cols = np.nonzero(hit)
    out[rows, (np.cumsum(hit, axis=1) - 1)[rows, cols]] = chars[rows, cols]
    return out


def jaro(left: list[str], right: list[str]) -> np.ndarray:
    """Jaro similarity of two equally long word lists, element by element.

    Pairs are taken by length, so a step is as wide as its own words; only
    words over ``LONG_WORD`` letters, or with a NUL, are compared one by one.
    """
    out = np.zeros(len(left))
    if not left:
        return out
    size = np.fromiter((max(len(x), len(y)) for x, y in zip(left, right)), np.int64, len(left))
    empty = np.fromiter((not x or not y for x, y in zip(left, right)), bool, len(left))
    odd = (size > LONG_WORD) | np.fromiter(("\0" in x or "\0" in y for x, y in zip(left, right)), bool, len(left))
    for i in np.flatnonzero(odd & ~empty):
        out[i] = _jaro_long(left[i], right[i])
    keep = np.flatnonzero(~odd & ~empty)
    keep = keep[np.argsort(size[keep], kind="stable")]
    lo = 0
    while lo < len(keep):
        # so many pairs that the widest of them fills the step
        hi = lo + int(np.searchsorted(np.arange(1, len(keep) - lo + 1) * size[keep[lo:]], STEP_LETTERS, side="right"))
        part = keep[lo:max(hi, lo + 1)]
        out[part] = _jaro_step([left[i] for i in part], [right[i] for i in part])
        lo += len(part)
    return out


def _jaro_step(left: list[str], right: list[str]) -> np.ndarray:
    a, la = _codes(left)
    b, lb = _codes(right)
    rows = np.arange(len(left))
    window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    cols = np.arange(b.shape[1])
    free = cols[None, :] < lb[:, None]
    hit_a = np.zeros(a.shape, dtype=bool)
    for i in range(a.shape[1]):
        near = np.abs(cols[None, :] - i) <= window[:, None]
        cand = free & near & (b == a[:, i:i + 1]) & (i < la)[:, None]
        first = cand.argmax(axis=1)
        found = cand[rows, first]
        hit_a[:, i] = found
        free[rows[found], first[found]] = False
    hit_b = (cols[None, :] < lb[:, None]) & ~free
    m = hit_a.sum(axis=1)
    width = max(a.shape[1], b.shape[1])
    swaps = (_compact(a, hit_a, width) != _compact(b, hit_b, width)).sum(axis=1) // 2
    safe = np.maximum(m, 1)
    return np.where(m > 0, (m / la + m / lb + (m - swaps) / safe) / 3.0, 0.0)


def jaro_winkler(left: list[str], right: list[str]) -> np.ndarray:
    """Jaro plus a bonus of 0.1 per shared leading character, at most 4 of them."""
    base = jaro(left, right)
    shared = np.zeros(len(left))
    for i, (x, y) in enumerate(zip(left, right)):
        n = 0
        for p, q in zip(x[:4], y[:4]):
            if p != q:
                break
            n += 1
        shared[i] = n
    return base + shared * 0.1 * (1.0 - base)


class WordTable:
    """Jaro-Winkler of words given by their number in a list, and an upper bound that costs far less.

    A match needs an equal letter, so there are at most as many as the two
    bags of letters share.  A bag is a bitmap: a letter's bucket sets one bit
    per use, up to ``USES``; letters over that are counted apart and all taken
    to match.  For words of at most 64 letters a second bound asks, for each
    letter of one word, for an equal one of the other within the window that
    matches are looked for in.

    The similarity of such words is computed on bits: a word has a bitmap of
    its places for every letter, and a step takes one letter of all words.
    Lists with too many words and letters for that table keep the bounds,
    with letters in ``BUCKETS``, and compare letter by letter.
    """

    BUCKETS, USES, PLACES = 32, 4, 64
    TABLE = 1 << 22  # bitmaps held at most
    STEP = 1 << 14  # pairs compared at a time

    def __init__(self, words: list[str]):
        self.words = words
        n = len(words)
        self.length = np.fromiter(map(len, words), np.int64, n)
        row = np.repeat(np.arange(n), self.length)
        place = np.arange(len(row)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        bucket = letters % self.BUCKETS  # a to z have one each
        uses = np.bincount(row * self.BUCKETS + bucket, minlength=n * self.BUCKETS).reshape(n, self.BUCKETS)
        self.excess = np.maximum(uses - self.USES, 0).sum(axis=1)
        unary = (np.uint64(1) << np.minimum(uses, self.USES).astype(np.uint64)) - np.uint64(1)
        half = self.BUCKETS // 2
        shift = (np.arange(half) * self.USES).astype(np.uint64)
        self.bag = [np.bitwise_or.reduce(unary[:, h * half:(h + 1) * half] << shift, axis=1) for h in (0, 1)]
        self.first = np.zeros((4, n), np.int64)
        early = place < 4
        self.first[place[early], row[early]] = letters[early] + 1
        alphabet, known = np.unique(letters, return_inverse=True)
        self.exact = n * len(alphabet) <= self.TABLE
        self.width, letter = (max(len(alphabet), 1), known) if self.exact else (self.BUCKETS, bucket)
        short = (self.length <= self.PLACES)[row]
        self.places = np.zeros(n * self.width, np.uint64)
        np.bitwise_or.at(self.places, (row * self.width + letter)[short], np.uint64(1) << place[short].astype(np.uint64))
        self.letter = np.zeros((min(int(self.length.max(initial=1)), self.PLACES), n), np.int64)
        self.letter[place[short], row[short]] = letter[short]
        self._lengths = np.minimum(self.length, self.PLACES + 1)

    @staticmethod
    def _matches(least: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
        """Matches that words of these lengths need for a Jaro similarity of ``least``."""
        by_length = (3 * least - 1) * (np.maximum(la, 1) * np.maximum(lb, 1) / np.maximum(la + lb, 1))
        return np.maximum(by_length, np.minimum(1.0, 10 * np.maximum(least, 0.0))) - 1e-6

    def _shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Most letters that words ``i`` and ``j`` can match."""
        shared = np.bitwise_count(self.bag[0][i] & self.bag[0][j]).astype(np.int64) + np.bitwise_count(self.bag[1][i] & self.bag[1][j])
        return shared + np.minimum(self.excess[i], self.excess[j]) if self.excess.any() else shared

    def near(self, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
        """The first and cheapest part of ``reaches``: where lengths and shared letters, or an equal first letter, allow it."""
        # words with other first letters get no bonus; what they need hangs on their lengths only
        k = np.arange(self.PLACES + 2)
        needed = self._matches(np.float64(threshold - 1e-6), k[:, None], k)
        needed[-1], needed[:, -1] = 0.0, 0.0
        return (self._shared(i, j) >= needed.ravel()[self._lengths[i] * len(k) + self._lengths[j]]) | (self.first[0][i] == self.first[0][j])

    def reaches(self, i: np.ndarray, j: np.ndarray, threshold: float, near: bool = False, by_place: bool = True) -> np.ndarray:
        """Where words ``i`` and ``j`` can be as similar as ``threshold``; ``near`` says that all are (see ``near``).

        Without ``by_place`` only bags of letters are looked at: a comparison on bits costs no more than the second bound.
        """
        out = np.zeros(len(i), bool)
        at = np.arange(len(i)) if near else np.flatnonzero(self.near(i, j, threshold))
        x, y = i[at], j[at]
        need = self._needed(x, y, threshold)
        ok = self._shared(x, y) >= need
        small = np.flatnonzero(ok & (self.length[x] <= self.PLACES) & (self.length[y] <= self.PLACES)) if by_place else at[:0]
        if len(small):
            x, y, need = x[small], y[small], need[small]
            ok[small] = self._near(x, y) >= need
            left = small[ok[small]]
            x, y, need = x[ok[small]], y[ok[small]], need[ok[small]]
            ok[left] = self._near(y, x) >= need
        out[at[ok]] = True
        return out

    def _reach(self, i: np.ndarray, j: np.ndarray):
        """Function of a place ``k``: for the pairs from ``lo`` on the places of ``j`` in reach of it, as bits."""
        window = np.maximum(np.maximum(self.length[i], self.length[j]) // 2 - 1, 0).astype(np.uint64)
        bits = (np.uint64(2) << (window * np.uint64(2))) - np.uint64(1)  # 2 window + 1 places

        def at(k: int, lo: int) -> np.ndarray:
            inside = np.minimum(window[lo:], np.uint64(k))
            return (bits[lo:] >> (window[lo:] - inside)) << (np.uint64(k) - inside)

        return at

    def _near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Letters of ``i`` that have an equal one (or one of its bucket) of ``j`` in reach."""
        order = np.argsort(self.length[i], kind="stable")
        i, j = i[order], j[order]
        longer = np.searchsorted(self.length[i], np.arange(int(self.length[i].max(initial=0))), side="right")
        reach, count = self._reach(i, j), np.zeros(len(i), np.int64)
        base = j * self.width
        for k, lo in enumerate(longer.tolist()):
            count[lo:] += (self.places[base[lo:] + self.letter[k][i[lo:]]] & reach(k, lo)) != 0
        out = np.empty(len(i), np.int64)
        out[order] = count
        return out

    def _needed(self, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
        """Matches that words ``i`` and ``j`` need for a similarity of ``threshold``."""
        k, p = np.arange(self.PLACES + 2), np.arange(5)[:, None, None]
        # by the letters that they begin with, and their lengths; words that are too long for the table are worked out
        table = self._matches((threshold - 1e-6 - 0.1 * p) / (1 - 0.1 * p), k[:, None], k).ravel()
        prefix, la, lb = self._prefix(i, j), self._lengths[i], self._lengths[j]
        need = table[(prefix * len(k) + la) * len(k) + lb]
        long = np.flatnonzero((la > self.PLACES) | (lb > self.PLACES))
        if len(long):
            least = (threshold - 1e-6 - 0.1 * prefix[long]) / (1 - 0.1 * prefix[long])
            need[long] = self._matches(least, self.length[i[long]], self.length[j[long]])
        return need

    def _prefix(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        prefix = np.zeros(len(i), np.int64)
        same = np.arange(len(i))
        for first in self.first:  # fewer and fewer words begin alike
            x = first[i[same]]
            same = same[(x > 0) & (x == first[j[same]])]
            prefix[same] += 1
        return prefix

    def similarity(self, i: np.ndarray, j: np.ndarray, threshold: float | None = None) -> np.ndarray:
        """Exact Jaro-Winkler similarity of words ``i`` and ``j``; -1 where too few letters match for ``threshold``."""
        out = np.zeros(len(i))
        bits = (self.length[i] <= self.PLACES) & (self.length[j] <= self.PLACES) if self.exact else np.zeros(len(i), bool)
        other = np.flatnonzero(~bits)
        if len(other):
            out[other] = jaro_winkler([self.words[k] for k in i[other]], [self.words[k] for k in j[other]])
        at = np.flatnonzero(bits)
        # a step's words are about as long, and its numbers few enough to stay near the processor
        at = at[np.argsort(self._lengths[i[at]].astype(np.uint8), kind="stable")]
        for lo in range(0, len(at), self.STEP):
            part = at[lo:lo + self.STEP]
            out[part] = self._by_bits(i[part], j[part], threshold)
        return out

    def _by_bits(self, i: np.ndarray, j: np.ndarray, threshold: float | None) -> np.ndarray:
        """Similarity of words in order of the lengths of ``i``."""
        la, lb = self.length[i], self.length[j]
        base, one = j * self.width, np.uint64(1)
        reach = self._reach(i, j)
        hit_a, free_b = np.zeros(len(i), np.uint64), np.full(len(i), ~np.uint64(0))
        longer = np.searchsorted(la, np.arange(int(la.max(initial=0))), side="right")  # the first word with more than k letters
        for k, lo in enumerate(longer.tolist()):
            free = self.places[base[lo:] + self.letter[k][i[lo:]]] & reach(k, lo) & free_b[lo:]
            free_b[lo:] ^= free & (~free + one)  # the first one that is free
            hit_a[lo:] |= (free != 0).astype(np.uint64) << np.uint64(k)
        m = np.bitwise_count(hit_a).astype(np.int64)
        hit_b = ~free_b
        prefix = self._prefix(i, j) * 0.1
        # swaps only lower a similarity
        enough = np.ones(len(i), bool) if threshold is None else m >= self._needed(i, j, threshold)
        some = np.flatnonzero((m > 0) & enough)
        swaps, order = np.zeros(len(i), np.int64), np.argsort(-m[some].astype(np.int16), kind="stable")
        some = some[order]
        x, y, a, b, most = i[some], j[some], hit_a[some], hit_b[some], m[some]
        count, more = np.zeros(len(some), np.int64), np.searchsorted(-most, -np.arange(int(most.max(initial=0))), side="left")
        for n in more.tolist():  # words with more than so many matches
            first_a, first_b = a[:n] & (~a[:n] + one), b[:n] & (~b[:n] + one)
            a[:n] ^= first_a
            b[:n] ^= first_b
            count[:n] += self.letter[np.bitwise_count(first_a - one), x[:n]] != self.letter[np.bitwise_count(first_b - one), y[:n]]
        swaps[some] = count // 2
        with np.errstate(invalid="ignore", divide="ignore"):
            jaro_ = np.where(m > 0, (m / la + m / lb + (m - swaps) / np.maximum(m, 1)) / 3.0, 0.0)
        return np.where(enough, jaro_ + prefix * (1.0 - jaro_), -1.0)


jaro_winkler.table = WordTable


def edit_ratio(left: Column, right: Column) -> Column:
    """JVM-side alternative: 1 - edit distance / longer length."""
    longer = F.greatest(F.length(left), F.length(right), F.lit(1))
    return F.lit(1.0) - F.levenshtein(left, right) / longer
