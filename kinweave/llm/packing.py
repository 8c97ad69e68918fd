"""Best-fit packing of token sequences with certified bounds.

Texts are tokenized and cut into pieces of at most ``capacity`` tokens; pieces
(with their ids) are written once.  Pieces that fill a sequence need no
packing.  The others are dealt into groups of about ``GROUP_PIECES`` pieces, and
each group is packed by best-fit decreasing in one task.  Dual feasible
functions give a lower bound on each group's number of sequences.  A group
that meets its bound is final.  Of the others, the pieces in sequences that
are not full are exchanged: dealt anew into fewer groups and packed again,
for ``ROUNDS`` rounds; a round's result is taken only if it needs fewer
sequences.

Defined results: a null or empty text is the closing id alone.  Pieces carry a
number of their own, so repeated ids and repeated rows are packed one by one.
An empty table gives an empty result.  Extra columns are not carried; join them by id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import ship, stored

CAPACITY = 1024
END_ID = 2
GROUP_PIECES = 50_000
ROUNDS = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
OTHER = r"[^\n\t -~¡-ɏ]"  # texts with other characters, or with a special token's string, go to the tokenizer itself
_encoders: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of the tokenizer in ``path`` as packed unsigned 32-bit numbers.

    The default tokenizer's vocabulary also exists as ranks for a second
    library, which gives the same ids several times faster.
    """

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.other = re.compile(OTHER).search
        self.fast = self._ranked() if path == default_tokenizer() else None

    @staticmethod
    def _ranked():
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return encoding.encode_ordinary

    def __call__(self, text: str) -> bytes:
        if self.fast is None or self.other(text) or any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast(text)
        return np.asarray(ids, "<u4").tobytes()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens; only the first may be shorter than ``capacity``."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                 tokenizer: str | None = None) -> DataFrame:
    """A row per piece with its ids (packed little-endian unsigned 32-bit) and a number of its own, written."""
    ship(df.sparkSession)
    path = tokenizer
    end = np.asarray([END_ID], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or default_tokenizer())
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = []
                part = batch.slice(i, 256)
                for doc, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encode(t or "") + end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        mine = ids[4 * start:4 * (start + length)]
                        rows.append((doc, k, start, length, zlib.crc32(mine), mine))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = df.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, PIECES)
    return stored(rows.withColumn("piece_no", F.monotonically_increasing_id()))  # fixed once written


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of several dual feasible functions: no packing needs fewer sequences."""
    if not len(lengths):
        return 0
    x = np.asarray(lengths, np.int64)
    best = -(-int(x.sum()) // capacity)
    for t in np.union1d([0], x[x <= capacity // 2]):
        # above capacity - t: a whole sequence; below t: nothing
        big, mid = int((x > capacity - t).sum()), x[(x >= t) & (x <= capacity - t)]
        best = max(best, big + -(-int(mid.sum()) // capacity))
        # more than a half each: one sequence, and what is left of them holds the rest of at least t
        half = mid[mid > capacity // 2]
        room = int((capacity - half).sum())
        best = max(best, big + len(half) + max(0, -(-(int(mid[mid <= capacity // 2].sum()) - room) // capacity)))
    for k in range(2, 33):  # rounding down to k equal parts of a sequence
        y = x * (k + 1)
        exact = y % capacity == 0
        scaled = np.where(exact, x * k, (y // capacity) * capacity)
        best = max(best, -(-int(scaled.sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of every item, and how full each bin is."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: some bin has r places left
    fill: list[int] = []
    for i in order.tolist():
        n = int(lengths[i])
        fits = open_ >> n
        if fits:
            r = n + ((fits & -fits).bit_length() - 1)
            b = room[r].pop()
            if not room[r]:
                open_ &= ~(1 << r)
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if r > n:
            room[r - n].append(b)
            open_ |= 1 << (r - n)
    return bins, offsets, np.asarray(fill, np.int64)


PACKED = "piece_no long, length long, grp long, bin long, offset long, n_bins long, bound long, full boolean"


def _pack_group(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("piece_no", "ascending")])
        lengths = table.column("length").to_numpy()
        bins, offsets, fill = best_fit(lengths, capacity)
        n = len(lengths)
        return pa.table({
            "piece_no": table.column("piece_no"), "length": lengths, "grp": table.column("grp"),
            "bin": bins, "offset": offsets, "n_bins": np.full(n, len(fill)),
            "bound": np.full(n, lower_bound(lengths, capacity)), "full": fill[bins] == capacity,
        })

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``piece_no, sequence_id, offset`` for rows of ``piece_no, length``."""
    ship(pieces.sparkSession)
    items = pieces.filter(F.col("length") < capacity).select("piece_no", "length")
    whole = pieces.filter(F.col("length") == capacity)
    done = whole.select("piece_no", (-1 - F.col("piece_no")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def packed(rows: DataFrame, groups: int, seed: int) -> DataFrame:
        dealt = rows.withColumn("grp", F.pmod(F.xxhash64("piece_no", F.lit(seed)), F.lit(groups)).cast("long"))
        return stored(dealt.groupBy("grp").applyInArrow(_pack_group(capacity), PACKED))

    def final(rows: DataFrame, round_: int) -> DataFrame:
        # groups and bins are below 2^24 and 2^32; rounds tell equal numbers apart
        number = (F.lit(round_).cast("long") * (1 << 56)) + F.col("grp") * (1 << 32) + F.col("bin")
        return rows.select("piece_no", number.alias("sequence_id"), "offset")

    n = items.count()
    if not n:
        return done
    groups = max(1, -(-n // group_pieces))
    state = packed(items, groups, 0)
    for r in range(1, rounds + 1):
        gap = F.col("n_bins") > F.col("bound")
        loose = state.filter(gap & ~F.col("full"))
        # what is to be packed again, and how many sequences it takes now
        n, before = loose.agg(F.count("*"), F.countDistinct("grp", "bin")).first()
        if not n:
            break
        fewer = max(1, -(-n // group_pieces))
        again = packed(loose.select("piece_no", "length"), fewer, r)
        after = again.agg(F.countDistinct("grp", "bin")).first()[0]
        if after >= before:
            break
        done = done.union(final(state.filter(~gap | F.col("full")), r))
        state = again
    return done.union(final(state, rounds + 1))


def packed_documents(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                     tokenizer: str | None = None, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Every piece with its ids, checksum, sequence and place there."""
    pieces = token_pieces(df, key, text, capacity, tokenizer)
    places = stored(pack(pieces.select("piece_no", "length"), capacity, group_pieces))
    return pieces.join(places, "piece_no").drop("piece_no").withColumnRenamed("doc_id", key)
