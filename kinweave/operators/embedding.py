"""Word vectors for token arrays.

Vectors come from a vocabulary table or from an encoder that runs in the
Python workers.  Either way each entity is embedded once and pairs look the
result up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.vectors import mean_vector, zeros
from kinweave.operators.scale import hot_keys, salted_lookup, spread_lookup, stored
from kinweave.operators.similarity import bounds, list_array
from kinweave.operators.tokens import computed_once, entity_tokens, exploded, token_array

HOT_ENTITY_ROWS = 1_000_000
TASK_VOCABULARY = 16 << 20  # bytes of a vocabulary that tasks hold; a larger one is joined
LOOKUP_ROWS = 2048  # records whose vectors leave a task function together


def look_up_vectors(words: DataFrame, vocab: DataFrame, size: int, spread: Sequence[str], salts: int = 16) -> DataFrame:
    """Add ``vec`` per token row; an unknown word has the zero vector.

    A few words make up most of any text, so the vocabulary is repeated per
    salt and every word's rows spread over that many tasks.
    """
    found = salted_lookup(words, vocab.select("word", F.col("vec").cast("array<float>").alias("vec")), "word", spread,
                          "left", salts)
    return found.withColumn("vec", F.coalesce("vec", zeros(size).cast("array<float>")))


def _in_order(col: str):
    return F.sort_array(F.collect_list(col))


def _few_vectors(vocab: DataFrame, size: int) -> tuple[list[str], np.ndarray] | None:
    """Words and vectors of a vocabulary of at most ``TASK_VOCABULARY`` bytes; None for a larger one."""
    most = TASK_VOCABULARY // (4 * size + 32)
    known = vocab.filter(F.col("word").isNotNull() & F.col("vec").isNotNull()).select("word", F.col("vec").cast("array<float>").alias("vec"))
    found = known.limit(most + 1).toArrow()  # no more than the bound is collected
    if found.num_rows > most:
        return None
    word, vec = (found.column(c).combine_chunks() for c in ("word", "vec"))
    if pc.any(pc.not_equal(pc.list_value_length(vec), size)).as_py() or vec.flatten().null_count or pc.count_distinct(word).as_py() < len(word):
        return None  # what a join makes of such rows, the join makes
    return word.to_pylist(), vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float32)


def _looked_up(tokens: DataFrame, words: list[str], vectors: np.ndarray) -> DataFrame:
    """Every token with its vector, from a vocabulary that each task has: a pair's row stays where it is."""
    shared = tokens.sparkSession.sparkContext.broadcast((words, np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)])))

    @F.arrow_udf("array<array<float>>")
    def vectors_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, matrix = shared.value
        known = pa.array(known, pa.string())
        for lists in columns:
            for lo in range(0, len(lists), LOOKUP_ROWS):
                part = lists.slice(lo, LOOKUP_ROWS)
                at = pc.fill_null(pc.index_in(part.flatten().cast(pa.string()), known), len(known)).to_numpy(zero_copy_only=False)
                width = matrix.shape[1]
                inner = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(at) + 1) * width, width, dtype=np.int32)), pa.array(matrix[at].ravel()))
                yield list_array(np.repeat(np.arange(len(part)), bounds(part)[1]), inner, len(part))

    found = tokens.withColumns({f"_{s}_vecs": vectors_of(F.col(f"{s}_toks.word")) for s in ("l", "r")})

    def with_vector(side: str) -> Column:
        return F.transform(f"{side}_toks", lambda t, i: F.struct(
            *[t[c].alias(c) for c in ("pos", "attr", "attr_pos", "word")], F.get(f"_{side}_vecs", i).alias("vec")))

    return computed_once(found.select("id", "label", with_vector("l").alias("l_toks"), with_vector("r").alias("r_toks")), "l_toks", "r_toks")


def attach_vectors(tokens: DataFrame, vocab: DataFrame, size: int, salts: int = 16) -> DataFrame:
    """Give every token of ``pair_tokens`` its vector.

    A vocabulary of at most ``TASK_VOCABULARY`` bytes goes to the tasks, and no
    vector is exchanged; with a larger one the tokens are joined to it.
    """
    few = _few_vectors(vocab, size)
    if few is not None:
        return _looked_up(tokens, *few)
    both = F.concat(
        F.transform("l_toks", lambda t: F.struct(F.lit("l").alias("side"), t.alias("t"))),
        F.transform("r_toks", lambda t: F.struct(F.lit("r").alias("side"), t.alias("t"))))
    rows = exploded(tokens, ["id"], both, "x").select("id", "x.side", "x.t.*")
    found = look_up_vectors(rows, vocab, size, ["id", "side", "pos"], salts)
    packed = found.groupBy("id").agg(*[
        F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("pos", "attr", "attr_pos", "word", "vec")))).alias(
            f"{s}_toks") for s in ("l", "r")])
    # a pair without any word has no token rows
    kind = packed.schema["l_toks"].dataType.simpleString()
    out = tokens.select("id", "label").join(packed, "id", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.array().cast(kind)) for c in ("l_toks", "r_toks")})


def entity_vectors(entities: DataFrame, attrs: Sequence[str], vocab: DataFrame, size: int, salts: int = 16) -> DataFrame:
    """``id, toks``: every entity's tokens with vectors, each entity embedded once."""
    found = look_up_vectors(entity_tokens(entities, attrs), vocab, size, ["id", "pos"], salts)
    return found.groupBy("id").agg(_in_order(F.struct("pos", "attr", "attr_pos", "word", "vec")).alias("toks"))


def pairs_of_entities(links: DataFrame, left: DataFrame, right: DataFrame, hot_rows: int = HOT_ENTITY_ROWS) -> DataFrame:
    """Token arrays per pair from embedded entities; a side without words has an empty array."""
    kind = left.schema["toks"].dataType.simpleString()
    keys = stored(links.select("id", "left_id", "right_id", F.col("label").cast("int").alias("label")))
    hot = hot_keys(keys, ["left_id", "right_id"], hot_rows)
    first = spread_lookup(keys, left.select(F.col("id").alias("left_id"), F.col("toks").alias("l_toks")), "left_id", ["id"], hot["left_id"])
    both = spread_lookup(first, right.select(F.col("id").alias("right_id"), F.col("toks").alias("r_toks")), "right_id", ["id"], hot["right_id"])
    return both.select("id", "label", *[F.coalesce(c, F.array().cast(kind)).alias(c) for c in ("l_toks", "r_toks")])


def encode_entities(
    entities: DataFrame, attrs: Sequence[str], make_encoder: Callable[[], Callable[[list[list[str]]], list]], chunk: int = 256,
) -> DataFrame:
    """``id, toks`` from an encoder that sees whole records.

    ``make_encoder`` is called once per task and returns a function from a
    list of word lists to a list of ``[n_words, size]`` matrices.
    """
    tokens = computed_once(entities.select("id", token_array(attrs).alias("toks")), "toks")
    id_type = entities.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for batch in batches:
            for lo in range(0, len(batch), chunk):
                part = batch.iloc[lo:lo + chunk]
                vectors = encoder([[t["word"] for t in toks] for toks in part["toks"]])
                yield pd.DataFrame({
                    "id": part["id"].to_numpy(),
                    "vecs": [[[float(x) for x in v] for v in m] for m in vectors],
                })

    vecs = tokens.mapInPandas(run, f"id {id_type}, vecs array<array<float>>")
    return tokens.join(vecs, "id").select("id", F.transform("toks", lambda t, i: F.struct(
        t["pos"].alias("pos"), t["attr"].alias("attr"), t["attr_pos"].alias("attr_pos"), t["word"].alias("word"),
        F.get("vecs", i).alias("vec"))).alias("toks"))


def pieces_to_words(pieces: DataFrame) -> DataFrame:
    """Average word-piece vectors back to words.

    ``pieces``: ``id, piece_no, piece, vec``; a piece starting with ``##``
    continues the word before it.  Returns ``id, pos, word, vec``.
    """
    starts = (~F.col("piece").startswith("##")).cast("int")
    order = Window.partitionBy("id").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, 0)
    words = pieces.withColumn("pos", (F.sum(starts).over(order) - 1).cast("int"))
    grouped = words.groupBy("id", "pos").agg(
        F.sort_array(F.collect_list(F.struct("piece_no", F.regexp_replace("piece", "^##", "").alias("p"), "vec"))).alias("x"))
    return grouped.select("id", "pos", F.array_join("x.p", "").alias("word"), _mean_of(F.col("x.vec")).alias("vec"))


def _mean_of(vectors):
    width = F.size(F.get(vectors, 0))
    total = F.aggregate(vectors, F.array_repeat(F.lit(0.0), width),
                        lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(vectors))


def sentence_vectors(tokens: DataFrame, size: int, col: str = "toks") -> DataFrame:
    return tokens.select("id", mean_vector(F.col(f"{col}.vec"), size).alias("sentence"))


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest power of two that at most ``most`` words of ``word, n`` are used as often as."""
    least = 1
    while counts.filter(F.col("n") >= least).count() > most:
        least *= 2
    return least


def trained_vocabulary(tokens: DataFrame, size: int = 64, min_count: int | None = None, seed: int = 0, partitions: int | None = None,
                       most_words: int = 1_000_000, records_per_task: int = 100_000) -> DataFrame:
    """``word, vec`` trained on the token arrays of records (column ``words``).

    Training runs in one task per ``records_per_task`` records unless
    ``partitions`` is given; more than one averages the vectors of the tasks.
    Words live on the driver during training, so rare ones are left out until
    at most ``most_words`` stay, unless ``min_count`` is given;
    ``subwords.with_unknown_words`` gives the others a vector.
    """
    partitions = partitions or max(1, tokens.count() // records_per_task)
    if min_count is None:
        min_count = least_count(stored(tokens.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))), most_words)
    model = Word2Vec(vectorSize=size, minCount=min_count, seed=seed, numPartitions=partitions, inputCol="words", outputCol="v").fit(tokens)
    return model.getVectors().select("word", vector_to_array("vector", "float32").alias("vec"))
