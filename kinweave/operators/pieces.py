"""Word pieces: words cut longest match first, piece vectors looked up by piece, words as the mean of theirs."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.vectors import mean_vector
from kinweave.operators.embedding import look_up_vectors
from kinweave.operators.tokens import exploded

MARK = "##"  # fixed value: a piece that continues its word begins with it
UNKNOWN = "[UNK]"
MOST_PIECES = 1_000_000  # a piece vocabulary has a fixed size; more is an error, not cut


class PieceTrie:
    """Nodes by letter; a node under the end key is a piece.  Continuing pieces have a trie of their own."""

    END = ""

    def __init__(self, pieces: Iterable[str]):
        self.first, self.rest = {}, {}
        for piece in pieces:
            node, letters = (self.rest, piece[len(MARK):]) if piece.startswith(MARK) and len(piece) > len(MARK) else (self.first, piece)
            for ch in letters:
                node = node.setdefault(ch, {})
            node[self.END] = piece

    def cut(self, word: str) -> list[tuple[str, int, int]]:
        """``piece, start, end`` of the word's pieces; one unknown piece if some part of it has none."""
        out, at = [], 0
        while at < len(word):
            node, best = (self.rest if at else self.first), None
            for end in range(at, len(word)):
                node = node.get(word[end])
                if node is None:
                    break
                if self.END in node:
                    best = node[self.END], at, end + 1
            if best is None:
                return [(UNKNOWN, 0, len(word))]
            out.append(best)
            at = best[2]
        return out


def word_pieces(words: DataFrame, pieces: DataFrame, word: str = "word") -> DataFrame:
    """A row per piece: the columns of ``words``, ``piece_no``, ``piece``, ``start`` and ``end``; an empty word has none."""
    found = [r[0] for r in pieces.select("piece").distinct().limit(MOST_PIECES + 1).collect() if r[0]]
    if len(found) > MOST_PIECES:
        raise ValueError(f"more than {MOST_PIECES} pieces")
    shared = words.sparkSession.sparkContext.broadcast(found)
    tries: list[PieceTrie] = []

    @F.arrow_udf("array<struct<piece:string,start:int,end:int>>")
    def cut(values: pa.Array) -> pa.Array:
        if not tries:
            tries.append(PieceTrie(shared.value))
        seen: dict[str, list] = {}
        out = []
        for w in values.to_pylist():
            if w not in seen:
                seen[w] = [{"piece": p, "start": s, "end": e} for p, s, e in tries[0].cut(w or "")]
            out.append(seen[w])
        return pa.array(out, pa.list_(pa.struct([("piece", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    rows = exploded(words.withColumn("_cut", cut(F.col(word))), words.columns, F.col("_cut"), "x", "piece_no")
    return rows.select(*words.columns, "piece_no", "x.piece", "x.start", "x.end")


def piece_word_vectors(words: DataFrame, pieces: DataFrame, size: int, keys: tuple[str, ...] = ("id", "pos"), word: str = "word") -> DataFrame:
    """``keys, word, n_pieces, vec``: the mean of a word's piece vectors; ``pieces`` has ``piece, vec``.

    Pieces of frequent words are frequent, so the piece table is repeated per salt.
    """
    cut = word_pieces(words.select(*keys, word), pieces, word)
    vocab = pieces.select(F.col("piece").alias("word"), "vec")
    found = look_up_vectors(cut.withColumnRenamed(word, "_word").withColumnRenamed("piece", "word"), vocab, size, [*keys, "piece_no"])
    grouped = found.groupBy(*keys, F.col("_word").alias(word)).agg(F.count("*").alias("n_pieces"), F.collect_list("vec").alias("vecs"))
    return grouped.select(*keys, word, "n_pieces", mean_vector(F.col("vecs"), size).alias("vec"))
