"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each
character; dynamic programming keeps the best score and the number of tokens on
that path, and no token list.  Ties go as in the exact tokenizer: of paths
with equal score the one whose last piece is longest stays, and a character
without a piece of its own costs ten below the lowest score and counts its
UTF-8 bytes.  Words start at a space; each is solved once per worker and kept
in a bounded cache.

The vocabulary is read from a SentencePiece file; its place is a parameter.
Scores come from the file, or from Zipf's law over the pieces' rank, which is
the default because the public file at hand holds ranks and no probabilities.

Defined results: a null or empty text has no tokens and score 0.  Repeated rows
are counted each, an empty table stays empty, extra columns pass through, and
columns named ``n_tokens`` or ``log_score`` are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import fresh, ship

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 400_000
CACHED_LENGTH = 64
_counters: dict[tuple, TokenCounter] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str | None = None, scores: str = "zipf") -> list[tuple[str, float]]:
    """Pieces with their scores in the order of ids; control and byte pieces have score 0 under ``zipf``."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or default_vocabulary())
    out, rank = [], 0
    for i in range(sp.vocab_size()):
        special = sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
        rank += not special
        out.append((sp.id_to_piece(i), sp.get_score(i) if scores == "file" else 0.0 if special else -math.log(rank)))
    return out


class TokenCounter(dict):
    """Maps a word (without its leading space) to its number of tokens and best score."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY

    def __missing__(self, word: str) -> tuple[int, float]:
        found = self.solve(SPACE + word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found

    def solve(self, text: str) -> tuple[int, float]:
        n = len(text)
        best, count, own = [-math.inf] * (n + 1), [0] * (n + 1), bytearray(n + 1)
        best[0] = 0.0
        at = 0  # positions up to here are final

        def close(at: int) -> None:  # the way over an unknown character, which loses ties
            if not own[at]:
                score = best[at - 1] + self.unknown
                if score > best[at]:
                    best[at], count[at] = score, count[at - 1] + len(text[at - 1].encode())

        for last, (length, piece_score) in self.automaton.iter(text):  # by end, longest first
            end = last + 1
            while at < end - 1:
                at += 1
                close(at)
            score = best[end - length] + piece_score
            if score > best[end]:
                best[end], count[end] = score, count[end - length] + 1
            if length == 1:
                own[end] = 1
        while at < n:
            at += 1
            close(at)
        return count[n], best[n]

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = text.replace(" ", SPACE)
        words = (text[1:] if text[0] == SPACE else text).split(SPACE)
        found = list(map(self.__getitem__, words))
        return sum(n for n, _ in found), math.fsum(s for _, s in found)


def counter(path: str | None, scores: str) -> TokenCounter:
    if (path, scores) not in _counters:
        _counters[path, scores] = TokenCounter(vocabulary(path, scores))
    return _counters[path, scores]


def with_token_counts(df: DataFrame, text: str = "text", path: str | None = None, scores: str = "zipf") -> DataFrame:
    """``df`` with ``n_tokens`` and ``log_score``, the best path's score."""
    ship(df.sparkSession)

    @F.arrow_udf("n_tokens long, log_score double")
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = counter(path, scores)
        for batch in texts:
            found = [c.count(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays(
                [pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())],
                names=["n_tokens", "log_score"])

    keep = [c for c in df.columns if c.lower() not in ("n_tokens", "log_score")]
    t = fresh(df, "tokens")
    made = df.select(*[F.col(f"`{c}`") for c in keep], count(F.col(text)).alias(t))
    return made.select(*[F.col(f"`{c}`") for c in keep], f"{t}.n_tokens", f"{t}.log_score")
