"""Byte-pair encoding and decoding, with tree concatenation for long unsplit text.

``encode`` gives the ids of the tokenizer in ``path`` and ``decode`` its text of
ids.  Texts whose longest run without white space is shorter than ``leaf`` are
encoded in one pass: words of plain Latin text are solved once per worker and
kept in a bounded cache, all other text goes to the library in segments cut at
white space.

A longer run may be a single word, for which the merges of the model can not
be split beforehand.  Such a word is cut into leaves of ``leaf`` symbols, which
are rows of their own and are encoded in parallel.  Neighbours are then joined
in a tree, ``FAN`` at a time.  A join encodes a window of tokens around it
again, and doubles the window until its first and last token are those that
both sides had there.  Every pair of neighbouring tokens is then one that the
merges leave alone, which holds for one sequence of tokens only: the word's own.

Defined results: a null or empty text has no ids and an empty decoded text.
Repeated rows are encoded each, an empty table stays empty, extra columns pass
through, and columns that have an output's name are replaced.  Ids are packed
little-endian unsigned 32-bit; a null column of ids decodes to an empty text,
and ids outside the vocabulary are skipped.  Strings of special tokens in a
text are special tokens, as the library reads them.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinweave.llm.common import fresh, ship, stored

LEAF = 4096  # symbols of a word that are encoded in one piece
FAN = 16  # neighbours joined in one task and level of the tree
WINDOW = 4  # tokens on either side of a join that are encoded first
SEGMENT = 65_536  # characters that the library gets at once
CACHE_WORDS = 200_000
SLICE = 256  # rows worked on at a time
CACHED_LENGTH = 64
PLAIN_END = 0x180  # below it characters are their own normal form; I with a dot has a lower form of two
SPACES = " \t\n\r"
PARTS = "row long, part long, kind string, word long, node long, final boolean, payload string"
_codecs: dict[str, Codec] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


class Cache(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        found = self.make(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found


class Codec:
    """The tokenizer of a file, its model for parts of words, and a cache of whole words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.suffix = self.tokenizer.model.end_of_word_suffix or ""
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.symbols = [t.removesuffix(self.suffix) if self.suffix else t for t in self.tokens]
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        kind = {k: "".join(re.escape(chr(c)) for c in range(PLAIN_END) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        spaces = re.escape(SPACES)
        # fixed value: how the tokenizer splits text into words
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{kind['L']}]+|[{kind['N']}]|[^{spaces}{kind['L']}{kind['N']}]+").findall
        plain = f"\t\n\r -~¡-{chr(PLAIN_END - 1)}".replace("İ", "")
        self.other = re.compile(f"[^{plain}]|İ").search
        self.cache = Cache(lambda word: packed(self.word_ids(self.letters(word), True)))

    @cached_property
    def inner(self):
        """The model for parts that do not end their word."""
        from tokenizers import models

        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        return models.BPE(vocab=model["vocab"], merges=merges)

    def letters(self, word: str) -> str:
        """The word's bytes as the symbols of the model."""
        return "".join(s for s, _ in self._bytes.pre_tokenize_str(word))

    @property
    def _bytes(self):
        from tokenizers import pre_tokenizers

        return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def word_ids(self, symbols: str, final: bool) -> list[int]:
        return [t.id for t in (self.tokenizer.model if final else self.inner).tokenize(symbols)]

    def ids(self, text: str) -> bytes:
        """Packed ids of a text."""
        if not self.other(text) and not self.special.search(text):
            return b"".join(map(self.cache.__getitem__, self.words(text.lower())))
        return b"".join(packed(self.tokenizer.encode(s, add_special_tokens=False).ids) for s in segments(text))

    def text(self, ids: bytes) -> str:
        """As the library decodes them: it has no decoder for this file, so tokens stand next to each other."""
        n = len(self.tokens)
        return " ".join([self.tokens[i] for i in np.frombuffer(ids, "<u4").tolist() if i < n])

    # ---- parts of long text -----------------------------------------------------------------------

    def parts(self, text: str, leaf: int) -> Iterator[tuple[str, int, int, bool, str]]:
        """``kind, word, node, final, payload``: text, short words, and the leaves of long words, in order."""
        number = 0
        for s in segments(text):
            if max(map(len, s.split()), default=0) < leaf:
                yield "text", number, 0, True, s
                number += 1
                continue
            at = 0
            for m in [*self.special.finditer(s), None]:
                run = s[at:m.start() if m else len(s)]
                short: list[str] = []
                size = 0
                # the library's own normal form and split; both work alike on either side of white space
                for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(run)):
                    if size + len(word) > SEGMENT or (short and len(word) > leaf):
                        yield "words", number, 0, True, " ".join(short)
                        short, size, number = [], 0, number + 1
                    if len(word) <= leaf:
                        short.append(word)
                        size += len(word)
                        continue
                    first = number
                    for k, lo in enumerate(range(0, len(word), leaf)):
                        yield "leaf", first, k, lo + leaf >= len(word), word[lo:lo + leaf]
                    number += 1
                if short:
                    yield "words", number, 0, True, " ".join(short)
                    number += 1
                if m:
                    yield "text", number, 0, True, m[0]
                    number += 1
                    at = m.end()

    def part_ids(self, kind: str, final: bool, payload: str) -> bytes:
        if kind == "text":
            return self.ids(payload)
        if kind == "words":
            return packed([i for word in payload.split(" ") for i in self.word_ids(word, True)])
        return packed(self.word_ids(payload, final))

    def joined(self, left: list[int], right: list[int], final: bool, window: int = WINDOW) -> list[int]:
        """Ids of two neighbouring parts of a word; ``final`` tells that the right one ends it."""
        while True:
            i, j = min(window, len(left)), min(window, len(right))
            a, b = left[len(left) - i:], right[:j]
            symbols = "".join([self.symbols[t] for t in a + b])
            middle = self.word_ids(symbols, final and j == len(right))
            if (i == len(left) or middle[0] == a[0]) and (j == len(right) or middle[-1] == b[-1]):
                return left[:len(left) - i] + middle + right[j:]
            window *= 2

    def tree(self, parts: list[list[int]], final: bool) -> list[int]:
        """Parts of a word joined two by two until one is left."""
        while len(parts) > 1:
            last = len(parts) - 2
            joined = [self.joined(parts[k], parts[k + 1], final and k == last) for k in range(0, len(parts) - 1, 2)]
            parts = joined + ([parts[-1]] if len(parts) % 2 else [])
        return parts[0]


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """The text cut before white space, at least ``size`` characters each but the last."""
    at = 0
    space = re.compile(f"[{SPACES}]").search
    while at < len(text):
        m = space(text, at + size)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def codec(path: str | None) -> Codec:
    path = path or default_tokenizer()
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _added(df: DataFrame, keep: Sequence[str], column: str, fields: str, make: Callable[[list], list[pa.Array]]) -> DataFrame:
    """``keep`` and ``fields`` made from ``column``, a few rows at a time: texts and ids are large."""
    kept = df.select(*[f"`{c}`" for c in keep])
    given = fresh(kept, "given")
    rows = df.select(*[f"`{c}`" for c in keep], F.col(f"`{column}`").alias(given))
    schema = StructType([*kept.schema.fields, *StructType.fromDDL(fields).fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *make(part.columns[-1].to_pylist())], names=names)

    return rows.mapInArrow(run, schema)


def _long_ids(rows: DataFrame, row: str, text: str, path: str | None, leaf: int) -> DataFrame:
    """``row, n_tokens, ids`` of texts that hold a long run; every leaf is a row and a task's small part."""
    part_schema = pa.schema([("row", pa.int64()), ("part", pa.int64()), ("kind", pa.string()), ("word", pa.int64()),
                             ("node", pa.int64()), ("final", pa.bool_()), ("payload", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                held, size = [], 0
                for part, (kind, word, node, final, payload) in enumerate(c.parts(t.as_py(), leaf)):
                    held.append((key, part, kind, word, node, final, payload))
                    size += len(payload)
                    if size > 1 << 22:
                        yield _batch(held, part_schema)
                        held, size = [], 0
                if held:
                    yield _batch(held, part_schema)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            kind, final, payload = (batch.column(n).to_pylist() for n in ("kind", "final", "payload"))
            ids = pa.array([c.part_ids(*x) for x in zip(kind, final, payload, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("row", "word", "node", "final")), ids], names=names)

    def join(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        parts = [np.frombuffer(x, "<u4").tolist() for x in group.column("ids").to_pylist()]
        final = group.column("final").to_pylist()[-1]
        ids = packed(codec(path).tree(parts, final))
        return pa.table({"row": [key[0].as_py()], "word": [key[1].as_py()], "node": [key[2].as_py()], "final": [final],
                         "ids": pa.array([ids], pa.binary())})

    def whole(key: tuple, group: pa.Table) -> pa.Table:
        ids = b"".join(group.sort_by("word").column("ids").to_pylist())
        return pa.table({"row": [key[0].as_py()], "n_tokens": [len(ids) // 4], "ids": pa.array([ids], pa.binary())})

    names = ["row", "word", "node", "final", "ids"]
    solved = "row long, word long, node long, final boolean, ids binary"
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = stored(rows.select(F.col(row), F.col(text)).mapInArrow(cut, PARTS))
    top = parts.agg(F.max("node")).first()[0]
    spread = parts.repartition(tasks, "row", "part")
    parts = stored(spread.mapInArrow(solve, solved))
    while top:
        one = parts.groupBy("row", "word", F.floor(F.col("node") / FAN).alias("up"))
        parts, top = one.applyInArrow(join, solved), top // FAN
    return parts.groupBy("row").applyInArrow(whole, "row long, n_tokens long, ids binary")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def encode(df: DataFrame, text: str = "text", path: str | None = None, leaf: int = LEAF, decoded: bool = False) -> DataFrame:
    """``df`` with ``n_tokens`` and ``ids``, and with ``decoded`` also the text of the ids."""
    spark = df.sparkSession
    ship(spark)
    fields = "n_tokens long, ids binary" + ", decoded string" * decoded
    keep = [c for c in df.columns if c.lower() not in ("n_tokens", "ids", *["decoded"] * decoded)]
    row = fresh(df, "row")
    long = F.coalesce((F.length(f"`{text}`") >= leaf) & F.regexp_like(F.col(f"`{text}`"), F.lit(f"[^{SPACES}]{{{leaf}}}")), F.lit(False))

    def make(texts: list) -> list[pa.Array]:
        c = codec(path)
        found = [c.ids(t or "") for t in texts]
        out = [pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(found, pa.binary())]
        return [*out, pa.array(map(c.text, found), pa.string())] if decoded else out

    plain = _added(df.filter(~long), keep, text, fields, make)
    if df.filter(long).isEmpty():
        return plain
    rows = stored(df.filter(long).withColumn(row, F.monotonically_increasing_id()))  # fixed once written
    found = _long_ids(rows, row, f"`{text}`", path, leaf)
    found = decode(found, path=path) if decoded else found
    new = [n for n in found.columns if n != "row"]
    found = found.select(F.col("row").alias(row), F.struct(*new).alias(f"{row}s"))
    return plain.unionByName(rows.join(found, row).select(*[f"`{c}`" for c in keep], *[f"{row}s.{n}" for n in new]))


def decode(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with ``decoded``, the text of its packed ids."""
    ship(df.sparkSession)

    def make(values: list) -> list[pa.Array]:
        return [pa.array([codec(path).text(v or b"") for v in values], pa.string())]

    return _added(df, [c for c in df.columns if c.lower() != "decoded"], ids, "decoded string", make)
