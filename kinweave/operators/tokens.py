"""Tokenisation of record pairs.

The working layout is one row per pair with two token arrays.  Both sides of
a pair arrive on the same row, so tokenising and aligning need no shuffle;
long token tables are exploded from it only where an operator asks for rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.strings import words_of
from kinweave.operators.text import LEFT, RIGHT, attributes


def token_array(attrs: Sequence[str], prefix: str = "") -> Column:
    """Array of ``(pos, attr, attr_pos, word)``; ``pos`` runs over all attributes in order."""
    def of(a: str) -> Column:
        return F.transform(
            words_of(F.col(prefix + a)),
            lambda w, i: F.struct(F.lit(a).alias("attr"), i.alias("attr_pos"), w.alias("word")),
        )

    return F.transform(
        F.flatten(F.array(*[of(a) for a in attrs])),
        lambda t, i: F.struct(
            i.alias("pos"), t["attr"].alias("attr"), t["attr_pos"].alias("attr_pos"), t["word"].alias("word")
        ),
    )


def computed_once(df: DataFrame, *arrays: str) -> DataFrame:
    """Keep array columns from being inlined into the lambdas that read them.

    Catalyst merges neighbouring projections, which would tokenise a record
    again for every element of an array.  A generator between the two stops
    that and costs nothing.
    """
    rest = [c for c in df.columns if c not in arrays]
    return df.select(*rest, F.inline(F.array(F.struct(*arrays))))


def exploded(df: DataFrame, keep: Sequence[str], items: Column, name: str, pos: str | None = None) -> DataFrame:
    """Explode a computed array.

    A plain ``explode`` makes Catalyst add a filter on the array's size and
    push it down, which computes the array twice.  The outer form does not.
    """
    if pos is None:
        return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())
    return df.select(*keep, F.posexplode_outer(items).alias(pos, name)).filter(F.col(pos).isNotNull())


def pair_tokens(pairs: DataFrame, attrs: Sequence[str] | None = None) -> DataFrame:
    """``id, label, l_toks, r_toks``; a missing label column counts as label 0."""
    attrs = attributes(pairs) if attrs is None else list(attrs)
    label = F.col("label").cast("int") if "label" in pairs.columns else F.lit(0)
    return computed_once(pairs.select(
        "id", label.alias("label"), token_array(attrs, LEFT).alias("l_toks"), token_array(attrs, RIGHT).alias("r_toks"),
    ), "l_toks", "r_toks")


def tokens_long(tokens: DataFrame) -> DataFrame:
    """One row per word: ``id, side, attr, attr_pos, pos, word``."""
    def tagged(col: str, side: str) -> Column:
        return F.transform(col, lambda t: F.struct(F.lit(side).alias("side"), t.alias("t")))

    both = F.concat(tagged("l_toks", "left"), tagged("r_toks", "right"))
    return exploded(tokens, ["id"], both, "x").select(
        "id", "x.side", "x.t.attr", "x.t.attr_pos", "x.t.pos", "x.t.word"
    )


def entity_tokens(entities: DataFrame, attrs: Sequence[str], key: str = "id") -> DataFrame:
    """One row per word of an entity table: ``id, attr, attr_pos, pos, word``."""
    return exploded(entities, [key], token_array(attrs), "t").select(
        key, "t.attr", "t.attr_pos", "t.pos", "t.word"
    )


def attribute_words(entities: DataFrame, attrs: Sequence[str], key: str = "id") -> DataFrame:
    """Word map per record: attribute -> word array."""
    items = [x for a in attrs for x in (F.lit(a), words_of(F.col(a)))]
    return entities.select(key, F.create_map(*items).alias("words"))
