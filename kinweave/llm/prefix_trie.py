"""Trie of the prefixes that conversations share, by ROLLUP over positional turn columns.

``sequences`` makes one row per conversation with an array of turn ids; a turn
id is half of the SHA-256 of role and text, followed by the text's number of
code points, so no text is shuffled.  ``nodes`` spreads the ids over columns
``t1 .. tK``.  ``GROUP BY block, parent, ROLLUP (t1 .. tK)`` then aggregates all
prefixes together, and ``grouping_id`` tells a prefix's length.  A longer
conversation goes on in further blocks of columns, whose rows are keyed by the
node that its prior block ends in (a digest of that prefix), so one job covers
every length.

Sums over subtrees need no walk over the tree.  A node belongs to its smallest
member; that conversation carries the weight of its own nodes from every depth
on, and a second ROLLUP, over one conversation per distinct sequence, adds
these up for every prefix.

Defined results: turns go by ``turn``, null first, ties by the turn id, and a
repeated row is a turn of its own.  A null role or text is empty.  Rows without
a conversation id are no conversation.  An empty table has no nodes, extra
columns are not looked at.  A conversation is one row of 24 bytes a turn,
however long its texts are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import ship, stored

WIDTH = 8  # turn columns of a block
ENDS_CHUNK = 4096  # ids joined in one task before a node's chunks are hashed in order


def _root() -> Column:
    return F.unhex(F.lit("00" * 16))


def _half(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 32)


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes of the digest of role and text, 8 bytes for the number of code points."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.concat(_half(said.cast("binary")), F.lpad(F.hex(F.length(text).cast("long")), 16, "0")))


def _size(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, 17, 8)), 16, 10).cast("long")


def _step(node: Column, turns: Column) -> Column:
    """Digest of the node that ``turns`` lead to from ``node``."""
    return F.unhex(_half(F.aggregate(turns, node, lambda k, t: F.concat(k, t))))


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns``: the turn ids of every conversation in order."""
    made = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
                        turn_id(F.col(role), F.col(text)).alias("id")).filter("conv_id is not null")
    # a null sorts first in a struct
    return made.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "id"))), lambda x: x["id"]).alias("turns"))


def with_heads(sequences: DataFrame, base: Column, n: Column, most: int) -> DataFrame:
    """Conversations that begin with the first ``n`` turns of conversation ``base`` in place of their own first ``n``.

    ``most`` bounds ``n``.  A base that is missing or shorter gives what it has.
    """
    heads = sequences.select(F.col("conv_id").alias("base_id"), F.slice("turns", 1, most).alias("head"))
    asked = sequences.withColumns({"base_id": base, "n": n.cast("int")})
    own = F.slice("turns", F.col("n") + 1, F.greatest(F.size("turns") - F.col("n"), F.lit(0)))
    head = F.slice(F.coalesce("head", F.array().cast("array<binary>")), F.lit(1), F.col("n"))
    joined = asked.join(heads.filter(F.col("base_id").isNotNull()), "base_id", "left")
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


def _blocks(sequences: DataFrame, width: int, *more: str) -> DataFrame:
    """``conv_id, block, parent, t1 .. tK``; ``parent`` is the node that the block starts from.  ``end`` is the last one's end."""
    last = F.greatest(F.floor((F.size("turns") - 1) / width), F.lit(0))
    cut = F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda b: F.slice("turns", b.cast("int") * width + 1, F.lit(width)))
    rows = sequences.select("conv_id", *more, F.inline(F.array(F.struct(cut.alias("cut")))))
    keys = F.aggregate("cut", F.array(_root()), lambda acc, b: F.concat(acc, F.array(_step(F.element_at(acc, -1), b))))
    rows = rows.select("conv_id", *more, F.inline(F.array(F.struct("cut", keys.alias("keys")))))
    end = F.when(F.size(F.element_at("cut", -1)) == 0, _root()).otherwise(F.element_at("keys", -1))
    exploded = rows.select("conv_id", *more, end.alias("end"), "keys", F.posexplode("cut").alias("block", "b"))
    return exploded.select("conv_id", *more, "end", "block", F.get("keys", F.col("block")).alias("parent"),
                           *[F.get("b", F.lit(i)).alias(f"t{i + 1}") for i in range(width)])


def _rolled(blocks: DataFrame, width: int, measures: str) -> DataFrame:
    """All prefixes of all blocks: ``block, parent, t1 .. tK, level`` and the measures.

    A prefix that is longer than its conversation has a null as its last turn
    and is no node.  Level 0 is kept for the first block only, as the root.
    """
    spark = blocks.sparkSession
    columns = ", ".join(f"t{i + 1}" for i in range(width))
    rolled = spark.sql(
        f"SELECT block, parent, {columns}, {width} - bit_count(grouping_id()) AS level, {measures} "
        f"FROM {{blocks}} GROUP BY block, parent, ROLLUP ({columns})", blocks=blocks)
    last = F.get(F.array(*[f"t{i + 1}" for i in range(width)]), F.col("level") - 1)
    return rolled.filter(F.when(F.col("level") == 0, F.col("block") == 0).otherwise(last.isNotNull()))


def _named(rolled: DataFrame, width: int) -> DataFrame:
    """``node``, ``above`` (its parent node), ``depth`` and ``size`` (code points of the last text) for rolled up rows."""
    t = F.array(*[f"t{i + 1}" for i in range(width)])
    level = F.col("level")
    node = F.when(level == 0, F.col("parent")).otherwise(_step(F.col("parent"), F.slice(t, F.lit(1), level)))
    above = F.when(level == 0, F.lit(None)).when(level == 1, F.col("parent")).otherwise(
        _step(F.col("parent"), F.slice(t, F.lit(1), F.greatest(level - 1, F.lit(1)))))
    size = F.when(level == 0, F.lit(0).cast("long")).otherwise(_size(F.get(t, level - 1)))
    return rolled.withColumns({
        "node": node, "above": above, "depth": F.col("block").cast("long") * width + level, "size": size,
    }).drop("block", "parent", *[f"t{i + 1}" for i in range(width)])


def nodes(sequences: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per prefix: ``node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens``.

    ``conv_id`` is the smallest conversation that begins with the prefix;
    together with ``depth`` it names a node.  ``saved_tokens`` counts code
    points that need not be read again below and at the node.
    """
    sequences = stored(sequences)
    first = _rolled(_blocks(sequences, width), width, "min(conv_id) AS conv_id, count(*) AS n_convs")
    found = stored(_named(first, width).drop("level"))
    # a hot parent has many children: the side with one row per node is the unique one, and its rows are counted before
    children = found.filter("above is not null").groupBy("above").agg(F.count("*").alias("n_children"))
    parents = found.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    kept = stored(
        found.join(children.withColumnRenamed("above", "node"), "node", "left").fillna(0, ["n_children"])
        .join(parents, "above", "left").drop("above"))

    # the owner's weight from each of its own depths on; above them it carries all of it
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    weight = (F.col("n_convs") - 1) * F.col("size")
    own = kept.select("conv_id", "depth", F.sum(weight).over(below).alias("s"), (F.col("n_children") == 0).alias("leaf"))
    own = own.groupBy("conv_id").agg(
        F.min("depth").alias("d0"), F.transform(F.sort_array(F.collect_list(F.struct("depth", "s"))), lambda x: x["s"]).alias("s"),
        F.max_by("leaf", "depth").cast("long").alias("leaf"))
    blocks = _blocks(sequences.join(own, "conv_id"), width, "d0", "s", "leaf").drop("end")

    def carried(i: int) -> Column:
        at = F.col("block") * width + i - F.col("d0")
        return F.get("s", F.greatest(at, F.lit(0)).cast("int"))

    blocks = blocks.select("block", "parent", "leaf", *[f"t{i + 1}" for i in range(width)],
                           *[carried(i).alias(f"s{i}") for i in range(width + 1)])
    sums = ", ".join(f"sum(s{i})" for i in range(width + 1))
    second = _named(_rolled(blocks, width, f"sum(leaf) AS n_leaves, array({sums}) AS sums"), width)
    summed = second.select("node", "n_leaves", F.get("sums", F.col("level")).alias("saved_tokens"))
    return kept.join(summed, "node").select(
        "node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def ends(sequences: DataFrame, width: int = WIDTH) -> DataFrame:
    """``conv_id, node``: the node that each conversation ends in."""
    return _blocks(sequences, width).filter("block = 0").select("conv_id", F.col("end").alias("node"))


def end_digests(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of the decimal ids, ascending and joined by commas.

    A digest is made in order, so a node's ids end up in one task; they are
    sorted and joined in chunks of neighbouring ids before, and that task
    reads one chunk at a time.
    """
    ship(ends.sparkSession)
    chunk = F.floor(F.col("conv_id") / ENDS_CHUNK)
    chunks = ends.groupBy("node", chunk.alias("chunk")).agg(F.array_join(
        F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    tasks = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, None, []
        for batch in batches:
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield _digests(out)
                out = []
        if now is not None:
            yield _digests([(now, digest.hexdigest())])

    ordered = chunks.repartition(tasks, "node").sortWithinPartitions("node", "chunk").select("node", "ids")
    return ordered.mapInArrow(run, "node binary, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    node, digest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(digest, pa.string())], names=["node", "ends_sha256"])
