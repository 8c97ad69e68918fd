"""Quality by perplexity under an interpolated modified Kneser-Ney model.

The model is a bigram model over the ids of a public tokenizer and is trained
on all trusted text: documents labelled good and not toxic, but for a held-out
share.  Ids come from a fixed vocabulary of ``V`` entries, so unigram
probabilities and back-off weights are arrays of that size; bigrams grow with
the corpus and stay distributed.

1.  Tasks count the bigrams of their trusted documents and hand packed, sorted
    counts to shards by bigram; a shard adds them up.
2.  Counts of counts give the three discounts of either order; continuation
    counts give the unigrams, contexts their back-off weights.
3.  The log probability of a document is a sum: every place adds its back-off
    score, and a bigram that the model has adds what it differs by.  The
    ``HEAD`` most frequent bigrams, a fixed number, go to every task; the others
    of a document are packed by shard and meet their shard's counts
    there.  A shard streams over them and keeps only its own bigrams.
4.  Perplexities above the ``QUANTILE`` of held-out trusted documents of the same
    language, times ``MARGIN``, are rejected.  With n such documents the logarithm of a language's own quantile has
    the weight n and that of all languages together the weight ``SHRINK``, at every size.  Quantiles are
    read off counts in steps of 1/``STEPS`` of the logarithm, so no partitioning moves them.

Defined results: a null or empty text is the end mark alone.  Every row is
scored for itself, repeated ids included; labels of repeated ids count as
trusted if any does.  A null language is a language of its own.  Without trusted text every id is
equally likely and nothing is rejected.  Empty tables give an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.common import ship, stored
from kinweave.llm.packing import default_tokenizer, encoder

V = 50_257
MARK = 50_256  # begins and ends a document
HEAD = 1 << 18
HEAD_SLOTS = 1 << 21
SHARD_BIGRAMS = 1_000_000
CHUNK_IDS = 1_000_000
HELD_OUT = 10  # one in so many trusted documents, by hash of its text, sets thresholds instead of training
QUANTILE, MARGIN, SHRINK, STEPS = 0.95, 1.0, 2, 1000
BROADCAST_ROWS = 1_000_000  # ids of trusted documents; beyond this the join shuffles


def bigrams(text: str | None, encode) -> np.ndarray:
    """Bigrams of a text between marks, each as first id times ``V`` plus second."""
    ids = np.frombuffer(encode(text or ""), "<u4").astype(np.int64)
    ids = np.concatenate(([MARK], ids, [MARK]))
    return ids[:-1] * V + ids[1:]


def _packed(keys: np.ndarray, shard: np.ndarray, n_shards: int, *columns: np.ndarray) -> Iterator[tuple]:
    """Shard number and bytes of the keys and columns of each shard that has any; keys are sorted."""
    order = np.lexsort((keys, shard))
    keys, shard, columns = keys[order], shard[order], [c[order] for c in columns]
    cuts = np.searchsorted(shard, np.arange(n_shards + 1))
    for s in range(n_shards):
        a, b = cuts[s], cuts[s + 1]
        if b > a:
            yield (s, _squeezed(keys[a:b]), *(c[a:b].tobytes() for c in columns))


def _squeezed(keys: np.ndarray) -> bytes:
    """Differences of sorted keys below 2^32."""
    return np.diff(keys, prepend=0).astype("<u4").tobytes()


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<u4").astype(np.int64))


def _shard(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % n


def bigram_counts(docs: DataFrame, text: str, tokenizer: str | None, n_shards: int) -> DataFrame:
    """``v, w, c``: every bigram of ``docs`` with its count."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer or default_tokenizer())
        held, size = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            rows = list(_packed(keys, _shard(keys, n_shards), n_shards, n.astype("<u4")))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "k", "n"])

        for batch in batches:
            for t in batch.column(0):
                held.append(bigrams(t.as_py(), encode))
                size += len(held[-1])
                if size >= CHUNK_IDS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def add(table: pa.Table) -> pa.Table:
        keys = np.concatenate([_keys(x.as_py()) for x in table.column("k")])
        n = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("n")]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return pa.table({"v": (keys[starts] // V).astype(np.int32), "w": (keys[starts] % V).astype(np.int32), "c": np.add.reduceat(n, starts)})

    packed = docs.select(F.col(text)).mapInArrow(count, "shard int, k binary, n binary")
    return stored(packed.groupBy("shard").applyInArrow(add, "v int, w int, c long"))


def discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """Discounts for counts 1, 2 and from 3 on, by the counts of counts 1 to 4."""
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))


class Model:
    """Arrays of the vocabulary's size, and the bigrams as a table ``shard, k, d``: key and added log probability."""

    def __init__(self, counts: DataFrame, n_shards: int, head: int = HEAD):
        spark = counts.sparkSession
        self.n_shards, self.spark = n_shards, spark
        low = {r["c"]: r["n"] for r in counts.filter("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
        ends = counts.groupBy("w").agg(F.count("*").alias("n")).collect()  # at most V rows, as the next
        some = lambda c: F.count(F.when(c, 1))
        begins = counts.groupBy("v").agg(F.sum("c").alias("all"), some(F.col("c") == 1).alias("one"), some(F.col("c") == 2).alias("two"), some(F.col("c") > 2).alias("more")).collect()
        self.d2 = discounts(low)
        follow = np.zeros(V)
        for r in ends:
            follow[r["w"]] = r["n"]
        values, times = np.unique(follow[follow > 0].astype(np.int64), return_counts=True)
        d1 = np.asarray([0.0, *discounts(dict(zip(values.tolist(), times.tolist(), strict=True)))])
        total = follow.sum()
        cut = d1[np.minimum(follow, 3).astype(np.int64)]
        uniform = np.full(V, 1.0 / V)
        self.p1 = (follow - cut) / total + cut.sum() / total * uniform if total else uniform
        self.total, self.back = np.ones(V), np.ones(V)
        for r in begins:
            self.total[r["v"]] = r["all"]
            self.back[r["v"]] = (self.d2[0] * r["one"] + self.d2[1] * r["two"] + self.d2[2] * r["more"]) / r["all"]
        self.log_p1, self.log_back = np.log(self.p1), np.log(self.back)
        self.counts = counts
        top = counts.orderBy(F.desc("c"), "v", "w").limit(head).toArrow()  # at most ``head`` rows
        self._place_head(top)

    def added(self, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log p(w|v) of a bigram of the model, less its back-off score."""
        cut = np.asarray([0.0, *self.d2])[np.minimum(c, 3)]
        p = (c - cut) / self.total[v] + self.back[v] * self.p1[w]
        return np.log(p) - self.log_back[v] - self.log_p1[w]

    def _place_head(self, top: pa.Table) -> None:
        """A table with one place per key; a key whose place is taken stays out and goes the shards' way."""
        v, w, c = (top.column(x).to_numpy().astype(np.int64) for x in ("v", "w", "c"))
        keys = v * V + w
        self.head_keys, self.head_values = np.full(HEAD_SLOTS, -1, np.int64), np.zeros(HEAD_SLOTS, np.float32)
        slots, first = np.unique(head_slot(keys), return_index=True)
        self.head_keys[slots] = keys[first]
        self.head_values[slots] = self.added(v, w, c)[first]

    def shards(self) -> DataFrame:
        arrays = self.spark.sparkContext.broadcast((self.d2, self.total, self.back, self.p1, self.log_back, self.log_p1))
        n_shards, cls = self.n_shards, Model

        def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = cls.__new__(cls)
            m.d2, m.total, m.back, m.p1, m.log_back, m.log_p1 = arrays.value
            for b in batches:
                v, w, c = (b.column(i).to_numpy().astype(np.int64) for i in range(3))
                keys = v * V + w
                rows = list(_packed(keys, _shard(keys, n_shards), n_shards, m.added(v, w, c).astype("<f4")))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "k", "d"])

        return self.counts.select("v", "w", "c").mapInArrow(values, "shard int, k binary, d binary")


def head_slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(43)).astype(np.int64)


def log_probabilities(docs: DataFrame, model: Model, text: str, tokenizer: str | None) -> DataFrame:
    """``docs`` without the text, with ``n_ids`` and ``log_p`` (natural logarithm)."""
    keep = [c for c in docs.columns if c != text]
    n_shards = model.n_shards
    shared = model.spark.sparkContext.broadcast((model.log_p1, model.log_back, model.head_keys, model.head_values))
    # kind 0: a document (chunk, place in the chunk, score so far); kind 1: the rest of a chunk's bigrams for one shard
    schema = docs.drop(text).schema
    packed = "kind int, chunk string, at int, n_ids long, log_p double, shard int, k binary, d binary"
    full = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias(text))
    row = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    out_schema = T.StructType([T.StructField("row", row, True), *T.StructType.fromDDL(packed)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer or default_tokenizer())
        log_p1, log_back, head_keys, head_values = shared.value
        task, chunk = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = pa.StructArray.from_arrays(batch.columns[:-1], names=keep)
            texts = batch.column(batch.num_columns - 1)
            i = 0
            while i < batch.num_rows:
                found, size, j = [], 0, i
                while j < batch.num_rows and size < CHUNK_IDS and j - i < 60_000:
                    found.append(bigrams(texts[j].as_py(), encode))
                    size += len(found[-1])
                    j += 1
                n = np.asarray([len(x) for x in found])
                keys, at = np.concatenate(found), np.repeat(np.arange(j - i), n)
                v, w = keys // V, keys % V
                value = log_back[v] + log_p1[w]
                slot = head_slot(keys)
                hit = head_keys[slot] == keys
                value[hit] += head_values[slot[hit]]
                sums = np.bincount(at, value, minlength=j - i)
                name = f"{task}-{chunk}"
                chunk += 1
                size = j - i
                yield _rows(rows.slice(i, size), size, kind=0, chunk=name, at=np.arange(size), n_ids=n, log_p=sums)
                keys, at = keys[~hit], at[~hit]
                blobs = list(_packed(keys, _shard(keys, n_shards), n_shards, at.astype("<u2")))
                if blobs:
                    yield _rows(None, len(blobs), kind=1, chunk=name, shard=[b[0] for b in blobs], k=[b[1] for b in blobs], d=[b[2] for b in blobs])
                i = j

    row_type = None

    def _rows(rows, size, kind, chunk, at=None, n_ids=None, log_p=None, shard=None, k=None, d=None):
        nonlocal row_type
        if rows is not None:
            row_type = rows.type
        fill = lambda x, t: pa.nulls(size, t) if x is None else pa.array(x, t)
        return pa.RecordBatch.from_arrays([
            pa.nulls(size, row_type) if rows is None else rows, pa.array([kind] * size, pa.int32()), pa.array([chunk] * size, pa.string()),
            fill(at, pa.int32()), fill(n_ids, pa.int64()), fill(log_p, pa.float64()), fill(shard, pa.int32()), fill(k, pa.binary()), fill(d, pa.binary())],
            names=["row", "kind", "chunk", "at", "n_ids", "log_p", "shard", "k", "d"])

    written = stored(full.mapInArrow(score, out_schema))
    rest = written.filter("kind = 1").select("shard", F.lit(1).alias("part"), "chunk", "k", "d")
    mine = model.shards().select("shard", F.lit(0).alias("part"), F.lit("").alias("chunk"), "k", "d")
    dealt = mine.union(rest).repartition(n_shards, "shard").sortWithinPartitions("shard", "part")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, keys, values = None, [], np.empty(0, np.int64), np.empty(0, np.float32)
        for batch in batches:
            chunks, places, sums = [], [], []
            for s, part, chunk, k, d in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if s != shard:
                    shard, parts, keys, values = s, [], np.empty(0, np.int64), np.empty(0, np.float32)
                if part == 0:
                    parts.append((_keys(k), np.frombuffer(d, "<f4")))
                    continue
                if parts:
                    keys, values = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    order = np.argsort(keys, kind="stable")
                    keys, values, parts = keys[order], values[order], []
                if not len(keys):
                    continue
                wanted, at = _keys(k), np.frombuffer(d, "<u2")
                spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = keys[spot] == wanted
                total = np.bincount(at[hit], values[spot[hit]])
                some = np.flatnonzero(total)
                chunks += [chunk] * len(some)
                places.append(some)
                sums.append(total[some])
            if places:
                yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.string()), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(sums))], names=["chunk", "at", "log_p"])

    more = dealt.mapInArrow(meet, "chunk string, at int, log_p double")
    rows = written.filter("kind = 0").select("row", "chunk", "at", "n_ids", "log_p")
    none = F.lit(None).cast(rows.schema["row"].dataType)
    both = rows.union(more.select(none.alias("row"), "chunk", "at", F.lit(None).cast("long"), "log_p"))
    summed = both.groupBy("chunk", "at").agg(F.first("row", ignorenulls=True).alias("row"), F.max("n_ids").alias("n_ids"), F.sum("log_p").alias("log_p"))
    return summed.select(*[F.col(f"row.`{c}`") for c in schema.names], "n_ids", "log_p")


def log_quantiles(sets: DataFrame, group: list[str], quantile: float) -> DataFrame:
    """``group, cut, n``: the quantile of the log perplexities of each group, rounded up to the step, and their number.

    The counts per step are few: perplexities lie between 1 and a small multiple of ``V``.
    """
    steps = sets.groupBy(*group, F.floor(F.log("perplexity") * STEPS).alias("step")).agg(F.count("*").alias("c"))
    of = Window.partitionBy(*group)
    below = F.sum("c").over(of.orderBy("step"))
    found = steps.withColumn("below", below).withColumn("n", F.sum("c").over(of))
    found = found.filter(F.col("below") >= F.ceil(F.col("n") * F.lit(quantile)))
    return found.groupBy(*group).agg(((F.min("step") + 1) / STEPS).alias("cut"), F.max("n").alias("n"))


def with_thresholds(out: DataFrame, quantile: float, margin: float, shrink: float) -> DataFrame:
    """``out`` with ``threshold``, from its rows marked ``sets``; null without such rows."""
    sets = out.filter("sets")
    pool = log_quantiles(sets, [], quantile).first()
    whole = None if pool is None else pool["cut"]
    by_lang = log_quantiles(sets, ["lang"], quantile).select(F.col("lang").alias("_lang"), "cut", "n")
    rows = out.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    n, pooled = F.coalesce("n", F.lit(0)), F.lit(whole).cast("double")
    cut = (n * F.coalesce("cut", F.lit(0.0)) + shrink * pooled) / (n + shrink)
    return rows.withColumn("threshold", F.exp(cut) * margin).drop("_lang", "cut", "n")


def scored(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
           tokenizer: str | None = None, quantile: float = QUANTILE, margin: float = MARGIN, shrink: float = SHRINK, head: int = HEAD) -> DataFrame:
    """``key, lang, n_ids, perplexity, threshold, kept`` for every row of ``df``."""
    ship(df.sparkSession)
    good = stored(labels.filter("quality = 1 and toxic = 0").select(F.col(key).alias("_id")).distinct())
    side = F.broadcast(good) if good.count() <= BROADCAST_ROWS else good
    held = F.pmod(F.xxhash64(F.lit("held out"), "text"), F.lit(HELD_OUT)) == 0
    rows = df.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    train = rows.filter(~held).join(side, F.col("id") == F.col("_id"), "left_semi")
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    n_shards = max(8, int(size) // (16 << 20))
    counts = bigram_counts(train, "text", tokenizer, n_shards)
    model = Model(counts, n_shards, head)
    marked = rows.join(side.withColumn("good", F.lit(True)), F.col("id") == F.col("_id"), "left")
    marked = marked.select("id", "lang", (held & F.coalesce("good", F.lit(False))).alias("sets"), "text")
    out = stored(log_probabilities(marked, model, "text", tokenizer).withColumn("perplexity", F.exp(-F.col("log_p") / F.col("n_ids"))))
    out = with_thresholds(out, quantile, margin, shrink)
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select(F.col("id").alias(key), F.col("lang").alias(lang), "n_ids", "perplexity", "threshold", kept.alias("kept"))
