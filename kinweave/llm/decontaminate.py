"""Benchmark decontamination by template canonicalisation.

Texts are split into words of letters and digits; a run of capitalised words inside a sentence is
one name and a number with its decimal parts one number, so that "New York"
takes the place of "Albany".  Numbers, names and units become typed placeholders,
all else is lower-cased; what a placeholder replaced is its slot's value.
Items are read three times: as written, as they would stand inside a sentence, and all in
lower case, as in copies that lost their capitals.  The first reading that covers enough of an item decides.
Windows of ``WINDOW`` canonical words are hashed and joined with those of the
benchmark (items shorter than a window are one window of their own length).
Matching windows on one diagonal, that is with equal distance between their
places in document and item, belong to one alignment.  Where words were put in or left out, the
diagonals within ``NEAR`` words of the one that covers most are one more alignment, in which a word belongs to
the diagonal that covers most.  An alignment counts if it
covers ``COVER`` of the item's words and its slots are consistent: one value
in the item has one value in the document, so that a re-parameterised question is
caught and a chance meeting of placeholders is not.

The benchmark's windows are broadcast if they are at most ``BROADCAST_ROWS``
rows and joined by shuffle otherwise.

Defined results: null and empty texts have no windows and leak nothing, and
an item without words matches nothing.  Rows that share an id count as one
document, and a null id is an id.  Of a pair's alignments one diagonal goes before several, then more covered
words, the first place, the first reading.  Empty tables give an empty result; only id
and text are read, and ``clean`` passes extra columns through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import fresh, let, stored

WINDOW = 8
COVER = 1, 2  # the share of an item's words that must be covered
BROADCAST_ROWS = 500_000  # rows of about 40 bytes
NEAR = 4
CAPITALISED = r"\p{Lu}\p{Ll}[\p{L}\p{M}\p{N}]*+"
# a name keeps the space before it, which a word that begins a sentence or follows a colon has not
NAME = rf"(?<=[\p{{L}}\p{{M}}\p{{N}},;)]) {CAPITALISED}(?:[ '-]{CAPITALISED}){{0,7}}+"
WORD = rf"({NAME}|\p{{N}}+(?:[.,]\p{{N}}+)++|[\p{{L}}\p{{M}}\p{{N}}]+)"
UNITS = ("km m cm mm mi mile miles ft feet foot inch inches yd yard yards kg g mg lb lbs oz pound pounds ton tons l ml liter liters "
         "litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months "
         "year years usd eur dollar dollars euro euros cent cents percent mph kmh").split()
SLOTS = ("<name>", "<number>", "<unit>")


def words_of(text: Column) -> Column:
    """Words in their own case, names with a space in front; a name of several words or a number with its parts is one word."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(1))


def canonical(word: Column) -> Column:
    low = F.lower(word)
    return (F.when(F.ascii(word) == 32, F.lit(SLOTS[0])).when(word.rlike(r"^\p{N}"), F.lit(SLOTS[1]))
            .when(low.isin(UNITS), F.lit(SLOTS[2])).otherwise(low))


def readings(items: DataFrame, item: str, text: str) -> DataFrame:
    """``item, r, text`` for the three readings of every item; a reading equal to the first is left out."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    kinds = F.array(t, F.concat(F.lit(", "), t), F.lower(t))
    rows = items.select(F.col(item).alias("item"), t.alias("_first"), F.posexplode(kinds).alias("r", "text"))
    return rows.filter((F.col("r") == 0) | (F.col("text") != F.col("_first"))).drop("_first")


def _windows(c: Column, size: int) -> Column:
    places = F.sequence(F.lit(0), F.size(c) - size)
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(c, i + k) for k in range(size)], F.lit(size)))
    return F.when(F.size(c) < size, F.array().cast("array<bigint>")).otherwise(hashes)


def _words(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.transform(words_of(F.col(text)), canonical).alias("c"))


def _slots(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id, at, kind, value`` of every placeholder."""
    def pick(w):
        kinds = F.transform(w, lambda x, i: F.struct(i.alias("at"), canonical(x).alias("kind"), F.lower(F.trim(x)).alias("value")))
        return F.filter(kinds, lambda s: s["kind"].isin(*SLOTS))

    # texts without a digit, a name or a unit keep an empty array
    rows = df.select(F.col(key).alias("id"), F.explode(let(words_of(F.col(text)), pick)).alias("s"))
    return rows.select("id", F.col("s.at").alias("at"), F.col("s.kind").alias("kind"), F.col("s.value").alias("value"))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """``item, r, n, size, i, w``: every window of every reading; short items are one window."""
    c = F.transform(words_of(F.col("text")), canonical)
    rows = items.select("item", "r", c.alias("c"), F.size(c).alias("n")).filter("n > 0")
    long = rows.filter(F.col("n") >= window).select("item", "r", "n", F.lit(window).alias("size"), F.posexplode(_windows(F.col("c"), window)).alias("i", "w"))
    for size in range(1, window):
        short = rows.filter(F.col("n") == size)
        long = long.union(short.select("item", "r", "n", F.lit(size), F.posexplode(_windows(F.col("c"), size)).alias("i", "w")))
    return long


def _covered(starts: Column) -> Column:
    """Words under windows of ``size`` words that begin at the sorted ``starts``."""
    gaps = F.transform(starts, lambda s, k: F.least(F.col("size"), F.coalesce(F.get(starts, k + 1) - s, F.col("size"))))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("long")


def alignments(found: DataFrame, cover: tuple[int, int], near: int) -> DataFrame:
    """``id, item, r, n, size, single, a, covered, places`` of alignments that cover enough.

    ``places`` has ``less`` (the covered words of the diagonal, negated), ``shift`` and ``start`` of every window.
    """
    pair = ["id", "item", "r", "n", "size"]
    enough = F.col("covered") * cover[1] >= F.col("n") * cover[0]
    lines = found.groupBy(*pair, "shift").agg(F.sort_array(F.collect_set("i")).alias("starts"))
    lines = stored(lines.withColumn("covered", _covered(F.col("starts"))))
    less = (-F.col("covered")).alias("less")
    single = lines.filter(enough).select(
        *pair, F.lit(True).alias("single"), F.col("shift").alias("a"), "covered",
        F.transform("starts", lambda s: F.struct(less, F.col("shift").alias("shift"), s.alias("start"))).alias("places"))
    # pairs whose diagonals can reach the share together
    of = Window.partitionBy(*pair)
    most = F.max(F.struct("covered", -F.col("shift"))).over(of)
    close = lines.withColumn("all", F.sum("covered").over(of)).withColumn("top", -most["col2"])
    close = close.filter((F.col("all") * cover[1] >= F.col("n") * cover[0]) & (F.abs(F.col("shift") - F.col("top")) <= near))
    starts = close.select(*pair, "shift", less, F.explode("starts").alias("start"))
    starts = starts.groupBy(*pair, "start").agg(F.min(F.struct("less", "shift")).alias("b"))
    several = starts.groupBy(*pair).agg(F.sort_array(F.collect_list(F.struct("start", "b.less", "b.shift"))).alias("x"))
    several = several.filter(F.size(F.array_distinct("x.shift")) > 1).withColumn("covered", _covered(F.col("x.start"))).filter(enough)
    return single.unionByName(several.select(
        *pair, F.lit(False).alias("single"), F.lit(0).alias("a"), "covered",
        F.transform("x", lambda p: F.struct(p["less"].alias("less"), p["shift"].alias("shift"), p["start"].alias("start"))).alias("places")))


def leaks(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
          item_text: str = "text", window: int = WINDOW, cover: tuple[int, int] = COVER, near: int = NEAR) -> DataFrame:
    """``key, item, at, n_windows, covered, n_slots``: the best alignment of every document and item that leaks."""
    spark = df.sparkSession
    types = df.schema[key].dataType, items.schema[item].dataType
    named = {"id": key, "item": item}
    # own names from here on, whatever the columns are called
    df = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    items = items.select(F.col(f"`{item}`").alias("_key"), F.col(f"`{item_text}`").alias("_text"))
    key, text = "_key", "_text"
    read = readings(items, key, text)
    wanted = stored(item_windows(read, window))
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect())  # at most ``window`` values
    few = wanted.count() <= BROADCAST_ROWS
    docs = _words(df, key, text)
    arrays = [F.transform(_windows(F.col("c"), s), lambda w, i: F.struct(i.alias("at"), w.alias("w"))) for s in sizes]
    if not arrays:
        none = "id long, item long, at int, n_windows long, covered long, n_slots long"
        return _named(spark.createDataFrame([], none), named, types)
    rows = docs.select("id", F.explode(F.concat(*arrays) if len(arrays) > 1 else arrays[0]).alias("x")).select("id", "x.*")
    side = F.broadcast(wanted) if few else wanted
    found = rows.join(side, "w").withColumn("shift", F.col("at") - F.col("i"))
    aligned = alignments(found, cover, near).withColumn("_least", F.min("r").over(Window.partitionBy("id", "item")))
    aligned = stored(aligned.filter("r = _least").drop("_least"))
    ids = aligned.select("id").distinct()
    few_ids = ids.count() <= BROADCAST_ROWS
    mine = df.join(F.broadcast(ids) if few_ids else ids, F.col(key).eqNullSafe(F.col("id")), "left_semi")
    doc_slots = _slots(mine, key, text).select(F.col("id").alias("doc"), F.col("at").alias("doc_at"), "kind", F.col("value").alias("doc_value"))
    keyed = read.select(F.struct("item", "r").alias("_key"), F.col("text").alias("_text"))
    item_slots = _slots(keyed, key, text).select(
        F.col("id.item").alias("of"), F.col("id.r").alias("of_r"), F.col("at").alias("item_at"), F.col("kind").alias("item_kind"), F.col("value").alias("item_value"))
    over = F.filter("places", lambda p: (F.col("item_at") >= p["start"]) & (F.col("item_at") < p["start"] + F.col("size")))
    which = ["id", "item", "r", "single", "a"]
    slots = (
        aligned.join(item_slots, (F.col("item") == F.col("of")) & (F.col("r") == F.col("of_r")))
        .select(*which, "item_at", "item_kind", "item_value", F.array_min(over)["shift"].alias("shift")).filter("shift is not null")
    )
    met = slots.join(doc_slots, F.col("id").eqNullSafe(F.col("doc")) & (F.col("doc_at") == F.col("item_at") + F.col("shift")) & (F.col("kind") == F.col("item_kind")))
    values = met.groupBy(*which, "kind", "item_value").agg(
        F.countDistinct("doc_value").alias("n_values"), F.countDistinct("item_at").alias("slots"))
    checked = values.groupBy(*which).agg(F.max("n_values").alias("most"), F.sum("slots").alias("n_slots"))
    checked = checked.select(*[F.col(c).alias(f"_{c}") for c in which], "most", "n_slots")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c == "id" else F.col(c) == F.col(f"_{c}") for c in which]
    joined = aligned.join(checked, same, "left")
    good = joined.filter(F.coalesce(F.col("most"), F.lit(1)) == 1).select(
        "id", "item", "single", "r", F.array_min(F.transform("places", lambda p: p["start"] + p["shift"])).alias("at"),
        F.size("places").cast("long").alias("n_windows"), "covered", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"))
    best = good.groupBy("id", "item").agg(
        F.max_by(F.struct("at", "n_windows", "covered", "n_slots"), F.struct("single", "covered", -F.col("at"), -F.col("r"))).alias("b"))
    return _named(best.select("id", "item", "b.*"), named, types)


def _named(out: DataFrame, named: dict, types: tuple) -> DataFrame:
    return out.select(*[F.col(c).cast(t).alias(n) for (c, n), t in zip(named.items(), types, strict=True)],
                      "at", "n_windows", "covered", "n_slots")


def clean(df: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Rows of ``df`` whose document leaks no item."""
    i = fresh(df, "leaked")
    bad = stored(leaks(df, items, key, **options).select(F.col(f"`{key}`").alias(i)).distinct())
    side = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return df.join(side, F.col(f"`{key}`").eqNullSafe(F.col(i)), "left_anti")
