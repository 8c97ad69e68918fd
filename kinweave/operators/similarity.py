"""Word similarity inside each pair.

``with_edges`` adds ``edges``, the word pairs at or above a threshold as an
array of ``(k, l, r)`` with ``k = -similarity`` and token positions ``l``,
``r``, ordered by ``(k, l, r)``.  The similarity matrix of a pair lives only
inside the task that reads the row; pairs under the threshold never become
rows.  Similarities are rounded to 9 digits, so equal ones stay equal on
every engine and the order of edges is total.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.strings import jaro_winkler
from kinweave.functions.vectors import EPS
from kinweave.operators.tokens import exploded

EDGE = "array<struct<k:double,l:int,r:int>>"
CELLS = 1_000_000  # similarity cells worked on at a time inside a task
STEP_CELLS = 1 << 16  # word pairs that are looked at in a step, few enough to stay near the processor
ROW_CELLS = 8 * CELLS  # word pairs by place of the rows that are worked on together; a larger row goes alone
SHORT_CELLS = 1024  # word pairs of a row whose cosines are taken together with other rows
DIGITS = 9


class Edges:
    """Similar word pairs of a batch of rows: ``row``, ``k = -similarity``, positions ``l`` and ``r``, in that order."""

    def __init__(self, found: list[tuple[np.ndarray, ...]]):
        none = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        row, k, l, r = (np.concatenate(part) for part in zip(none, *found))
        order = np.lexsort((r, l, k, row))
        self.row, self.k, self.l, self.r = row[order], k[order], l[order], r[order]

    def bands(self, least: float, most: float, first_left: np.ndarray, first_right: np.ndarray, used_left: np.ndarray, used_right: np.ndarray):
        """As ``WordPairs.bands``; places count through the batch, from ``first_left`` and ``first_right`` of their row."""
        left, right = first_left[self.row] + self.l, first_right[self.row] + self.r
        at = np.flatnonzero((self.k >= least) & (self.k <= most) & ~used_left[left] & ~used_right[right])
        yield self.row[at], self.k[at], self.l[at], self.r[at]

    def lists(self, n_rows: int) -> pa.Array:
        items = pa.StructArray.from_arrays(
            [pa.array(self.k), pa.array(self.l.astype(np.int32)), pa.array(self.r.astype(np.int32))], ["k", "l", "r"])
        return list_array(self.row, items, n_rows)


def list_array(rows: np.ndarray, items: pa.Array, n_rows: int) -> pa.Array:
    """Lists of ``items``, which come in order of their row."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), items)


def bounds(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Start of every row's items in the flattened array, and their number."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(sizes) - sizes, sizes


def _blocks(left: np.ndarray, right: np.ndarray, cells: int):
    """Blocks ``rows from, to, left words from, to`` of about ``cells`` word pairs; a large row is cut along its left words."""
    size = left * right
    before = np.cumsum(size) - size
    lo = 0
    while lo < len(size):
        if size[lo] > cells:
            step = max(1, int(cells // right[lo]))
            for a in range(0, int(left[lo]), step):
                yield lo, lo + 1, a, min(a + step, int(left[lo]))
            lo += 1
            continue
        hi = lo + max(1, int(np.searchsorted(before[lo:] + size[lo:] - before[lo], cells, side="right")))
        yield lo, hi, 0, None
        lo = hi


class RowWords:
    """Distinct words of every row of a batch, with the places where each stands."""

    def __init__(self, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray):
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(codes)) - np.repeat(starts, sizes)
        order = np.lexsort((codes, row))
        row, codes, self.place = row[order], codes[order], place[order]
        new = np.ones(len(codes), bool)
        new[1:] = (row[1:] != row[:-1]) | (codes[1:] != codes[:-1])
        self.at = np.flatnonzero(new)  # where a word's places begin
        self.uses = np.diff(np.append(self.at, len(codes)))
        self.code = codes[self.at]
        self.sizes = np.bincount(row[self.at], minlength=len(sizes))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.spot = starts[row] + self.place  # the place counted through the batch

    def free(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of every word that are not used: where they begin, how many, and the places."""
        there = ~used[self.spot]
        n = np.add.reduceat(there.astype(np.int64), self.at) if len(self.at) else np.zeros(0, np.int64)
        return np.cumsum(n) - n, n, self.place[there]


def _candidates(left: RowWords, right: RowWords, cells: int):
    """Blocks of distinct word pairs of one row: ``row, left word, right word``, words as numbers in ``RowWords``."""
    for lo, hi, first, last in _blocks(left.sizes, right.sizes, cells):
        mine = left.sizes[lo:hi] if last is None else np.array([last - first])
        size = mine * right.sizes[lo:hi]
        row = np.repeat(np.arange(lo, hi), size)
        cell = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        width = np.maximum(right.sizes[row], 1)
        yield row, left.starts[row] + cell // width + first, right.starts[row] + cell % width


def _coded(left: pa.Array, right: pa.Array) -> tuple[list[str], RowWords, RowWords]:
    (ls, ln), (rs, rn) = bounds(left), bounds(right)
    lw, rw = left.flatten(), right.flatten()
    coded = pa.concat_arrays([lw.cast(pa.string()), rw.cast(pa.string())]).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary.to_pylist(), RowWords(ls, ln, code[:len(lw)]), RowWords(rs, rn, code[len(lw):])


class WordPairs:
    """Similar pairs of distinct words of a batch of rows, most similar first.

    Their places become edges a band of similarities at a time, so a long
    row's edges are never held together.
    """

    def __init__(self, left: RowWords, right: RowWords, row: np.ndarray, gl: np.ndarray, gr: np.ndarray, k: np.ndarray, cells: int):
        order = np.argsort(k, kind="stable")
        self.left, self.right, self.cells = left, right, cells
        self.row, self.gl, self.gr, self.k = row[order], gl[order], gr[order], k[order]

    @property
    def uses(self) -> np.ndarray:
        """Edges of every pair."""
        return self.left.uses[self.gl] * self.right.uses[self.gr]

    def bands(self, least: float, most: float, first_left: np.ndarray, first_right: np.ndarray, used_left: np.ndarray, used_right: np.ndarray):
        """Edges ``row, k, l, r`` with ``least <= k <= most`` of words that are free when their band begins, in order of ``(k, row, l, r)``.

        A band has about ``cells`` edges, and all that are equally similar.
        """
        lo, end = np.searchsorted(self.k, least, side="left"), np.searchsorted(self.k, most, side="right")
        while lo < end:
            ahead = slice(lo, min(lo + self.cells, end))
            (sl, nl, pl), (sr, nr, pr) = self.left.free(used_left), self.right.free(used_right)
            n = nl[self.gl[ahead]] * nr[self.gr[ahead]]
            hi = lo + max(1, int(np.searchsorted(np.cumsum(n), self.cells, side="right")))
            hi = int(np.searchsorted(self.k, self.k[min(hi, end) - 1], side="right"))
            n = nl[self.gl[lo:hi]] * nr[self.gr[lo:hi]]
            pair = np.repeat(np.arange(lo, hi), n)
            i = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            gl, gr = self.gl[pair], self.gr[pair]
            l, r = pl[sl[gl] + i // nr[gr]], pr[sr[gr] + i % nr[gr]]
            row, k = self.row[pair], self.k[pair]
            # pairs come by (k, row): their edges are put in order inside runs of these
            run = np.cumsum(np.concatenate([[False], (k[1:] != k[:-1]) | (row[1:] != row[:-1])]))
            wide, high = int(r.max(initial=0)) + 1, int(l.max(initial=0)) + 1
            order = np.argsort((run * high + l) * wide + r, kind="stable") if (int(run[-1]) + 1 if len(run) else 1) * high * wide < 2 ** 62 else np.lexsort((r, l, run))
            yield row[order], k[order], l[order], r[order]
            lo = hi

    def edges(self) -> Edges:
        none = [np.zeros(len(side.place), bool) for side in (self.left, self.right)]
        return Edges([(row, k, l, r) for row, k, l, r in self.bands(-np.inf, np.inf, None, None, *none)])


def word_pairs(left: pa.Array, right: pa.Array, threshold: float, similarity: Callable, cells: int = CELLS,
               scored: np.ndarray | None = None) -> WordPairs:
    """Similar words by a function of two word lists.

    Only distinct words of a row are paired.  Where the function has a table of
    words (``similarity.table``), its upper bound leaves pairs out that can not
    reach the threshold; each distinct pair of the others is compared once per
    block.  ``scored`` takes the number of pairs of a row that are left to compare.
    """
    words, lg, rg = _coded(left, right)
    v = max(len(words), 1)
    table = similarity.table(words) if hasattr(similarity, "table") else None
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def compared(kinds: np.ndarray) -> np.ndarray:
        i, j = kinds // v, kinds % v
        # a similarity that rounds up to the threshold counts
        sim = table.similarity(i, j, threshold - 10.0 ** -DIGITS) if table is not None else similarity([words[x] for x in i], [words[x] for x in j])
        return np.round(sim, DIGITS)

    found = [none]
    few = v * v <= cells
    for row, gl, gr in _candidates(lg, rg, cells if few else min(cells, STEP_CELLS)):
        i, j = lg.code[gl], rg.code[gr]
        if few:  # few words: mark the pairs that occur
            kind = i * v + j
            reach = np.zeros(v * v, dtype=bool)
            reach[kind] = True
            kinds = np.flatnonzero(reach)
            if table is not None:
                ok = table.reaches(kinds // v, kinds % v, threshold, by_place=not table.exact)
                reach[kinds[~ok]] = False
                kinds = kinds[ok]
            value = np.full(v * v, -np.inf)
            value[kinds] = compared(kinds)
            keep = np.flatnonzero(reach[kind])
            sim = value[kind[keep]]
        else:
            if table is None:
                kinds, back = np.unique(i * v + j, return_inverse=True)
                keep, sim = np.arange(len(i)), compared(kinds)[back]
            else:  # rows with so many words share few pairs: to find those costs more than to compare them again
                keep = np.flatnonzero(table.near(i, j, threshold))
                keep = keep[table.reaches(i[keep], j[keep], threshold, near=True, by_place=not table.exact)]
                sim = np.round(table.similarity(i[keep], j[keep], threshold - 10.0 ** -DIGITS), DIGITS)
        if scored is not None:
            scored += np.bincount(row[keep[sim >= 0]], minlength=len(scored))
        keep, sim = keep[sim >= threshold], sim[sim >= threshold]
        found.append((row[keep], gl[keep], gr[keep], -sim))
    return WordPairs(lg, rg, *(np.concatenate(x) for x in zip(*found)), cells)


def word_edges(left: pa.Array, right: pa.Array, threshold: float, similarity: Callable, cells: int = CELLS) -> Edges:
    """Edges by a function of two word lists, in full (see ``word_pairs``)."""
    return word_pairs(left, right, threshold, similarity, cells).edges()


def row_blocks(left: pa.Array, right: pa.Array, cells: int = ROW_CELLS):
    """Ranges of rows with at most ``cells`` word pairs by place; a larger row stands alone."""
    size = np.maximum(bounds(left)[1] * bounds(right)[1], 1)
    before = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + cells, side="right")) - 1)
        yield slice(lo, hi)
        lo = hi


def vector_edges(left: pa.Array, right: pa.Array, threshold: float, cells: int = CELLS) -> Edges:
    """Edges by the cosine of word vectors."""
    (ls, ln), (rs, rn) = bounds(left), bounds(right)

    def matrix(lists: pa.Array) -> np.ndarray:
        vectors = lists.flatten()
        values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return values.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))

    a, b = matrix(left), matrix(right)
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    found = []
    short = ln * rn <= SHORT_CELLS  # many short rows at a time, a longer one alone
    few = max(SHORT_CELLS, cells // max(a.shape[1], 1))
    for lo, hi, _, _ in _blocks(np.where(short, ln, 0), np.where(short, rn, 0), few):
        size = np.where(short[lo:hi], ln[lo:hi] * rn[lo:hi], 0)
        row = np.repeat(np.arange(lo, hi), size)
        cell = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        l, r = cell // rn[row], cell % rn[row]
        x, y = ls[row] + l, rs[row] + r
        sim = np.round(np.einsum("ij,ij->i", a[x], b[y]) / np.maximum(na[x] * nb[y], EPS), DIGITS)
        keep = np.flatnonzero(sim >= threshold)
        found.append((row[keep], -sim[keep], l[keep], r[keep]))
    for i in np.flatnonzero(~short):
        y = slice(rs[i], rs[i] + rn[i])
        step = max(1, int(cells // rn[i]))
        for first in range(0, int(ln[i]), step):
            x = slice(ls[i] + first, ls[i] + min(first + step, ln[i]))
            sim = np.round(a[x] @ b[y].T / np.maximum(np.outer(na[x], nb[y]), EPS), DIGITS)
            l, r = np.nonzero(sim >= threshold)
            found.append((np.full(len(l), i), -sim[l, r], l + first, r))
    return Edges(found)


def listed_edges(lists: pa.Array) -> Edges:
    """Edges that were made elsewhere, as an array column."""
    _, sizes = bounds(lists)
    items = lists.flatten()
    k, l, r = (items.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    return Edges([(np.repeat(np.arange(len(sizes)), sizes), k, l.astype(np.int64), r.astype(np.int64))])


def edge_maker(threshold: float, similarity="jaro_winkler", cells: int = CELLS):
    """The token field that edges come from and the function that makes them in a task; None for a Column function."""
    if similarity == "cosine":
        return "vec", lambda a, b: vector_edges(a, b, threshold, cells)
    if similarity == "jaro_winkler" or getattr(similarity, "by_list", False):
        by_list = jaro_winkler if similarity == "jaro_winkler" else similarity
        return "word", lambda a, b: word_pairs(a, b, threshold, by_list, cells)
    return None


def _column_edges(threshold: float, similarity: Callable[[Column, Column], Column]) -> Column:
    grid = F.flatten(F.transform("l_toks", lambda x: F.transform("r_toks", lambda y: F.struct(
        (-F.round(similarity(x["word"], y["word"]), DIGITS)).alias("k"), x["pos"].alias("l"), y["pos"].alias("r")))))
    return F.sort_array(F.filter(grid, lambda e: e["k"] <= -threshold)).cast(EDGE)


def edge_column(threshold: float, similarity="jaro_winkler") -> Column:
    """``similarity``: ``"jaro_winkler"``, ``"cosine"`` (tokens carry ``vec``), a
    Column function of two words, or a Python function of two word lists
    marked with ``by_list = True``."""
    made = edge_maker(threshold, similarity)
    if made is None:
        return _column_edges(threshold, similarity)
    field, make = made

    @F.arrow_udf(EDGE)
    def edges(left: pa.Array, right: pa.Array) -> pa.Array:
        made = make(left, right)
        return (made.edges() if isinstance(made, WordPairs) else made).lists(len(left))

    return edges(F.col(f"l_toks.{field}"), F.col(f"r_toks.{field}"))


def cell_counts(tokens: DataFrame, threshold: float, similarity="jaro_winkler") -> DataFrame:
    """``id, n_cells, n_pairs, n_scored, n_edges, sim_sum`` per pair.

    Word pairs by place, distinct word pairs, those of them that have letters
    enough in common to be compared in full, and the edges with the sum of
    their similarities.
    """
    by_list = jaro_winkler if similarity == "jaro_winkler" else similarity

    @F.arrow_udf("n_cells long, n_pairs long, n_scored long, n_edges long, sim_sum double")
    def counted(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for at in row_blocks(left, right):
            a, b = (x.slice(at.start, at.stop - at.start) for x in (left, right))
            n, scored = len(a), np.zeros(len(a), np.int64)
            pairs = word_pairs(a, b, threshold, by_list, scored=scored)
            edges, sums = (np.bincount(pairs.row, weights=w, minlength=n) for w in (pairs.uses, -pairs.k * pairs.uses))
            made = [bounds(a)[1] * bounds(b)[1], pairs.left.sizes * pairs.right.sizes, scored, edges]
            out.append(pa.StructArray.from_arrays([*[pa.array(x.astype(np.int64)) for x in made], pa.array(sums)],
                                                  ["n_cells", "n_pairs", "n_scored", "n_edges", "sim_sum"]))
        kind = pa.struct([*[(c, pa.int64()) for c in ("n_cells", "n_pairs", "n_scored", "n_edges")], ("sim_sum", pa.float64())])
        return pa.chunked_array(out, kind).combine_chunks()

    return tokens.select("id", counted(F.col("l_toks.word"), F.col("r_toks.word")).alias("n")).select("id", "n.*")


def with_edges(tokens: DataFrame, threshold: float, similarity="jaro_winkler") -> DataFrame:
    return tokens.withColumn("edges", edge_column(threshold, similarity))


def edges_long(with_edges_df: DataFrame) -> DataFrame:
    """Similar word pairs as rows, for inspection and for other matchers."""
    e = with_edges_df.select("id", "l_toks", "r_toks", F.col("edges")).withColumn(
        "edges",
        F.transform("edges", lambda e: F.struct(
            e["l"].alias("left_pos"), e["r"].alias("right_pos"),
            F.get("l_toks", e["l"])["word"].alias("left_word"), F.get("r_toks", e["r"])["word"].alias("right_word"),
            (-e["k"]).alias("sim"))),
    )
    return exploded(e, ["id"], F.col("edges"), "e").select("id", "e.*")
