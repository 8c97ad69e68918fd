"""Column discovery, cleaning and reshaping of record-pair tables.

Everything is a projection: no operator in this module moves rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinweave.functions.strings import collapse_spaces, strip_non_ascii

LEFT, RIGHT = "left_", "right_"
KEYS = ("id", "left_id", "right_id", "label")

# Characters dropped when they stand alone between two spaces,
# applied one after the other in this order, and characters that always
# become a space.
LONE_CHARS = ("!", '"', "#", "%", "&", "'", "(", ")", "*", "+", ",", "-", "/", ":", ";", "<", "=", ">", "?", "@",
              "[", "\\", "]", "^", "_", "`", "{", "|", "}", "~", "–", "´")
SPACE_CHARS = "-/\\"


def pair_columns(df: DataFrame, exclude: Sequence[str] = KEYS) -> list[str]:
    """Columns that describe the records, sorted by name."""
    return sorted(c for c in set(df.columns) if c not in exclude)


def attributes(df: DataFrame, exclude: Sequence[str] = KEYS, prefix: str = LEFT) -> list[str]:
    """Attribute names found from the columns with the left prefix."""
    return [c[len(prefix):] for c in pair_columns(df, exclude) if c.startswith(prefix)]


def split_x_y(df: DataFrame, label: str = "label", exclude: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    return df.select(*pair_columns(df, exclude)), df.select(label)


def _text_columns(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    if cols is not None:
        return list(cols)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def drop_non_ascii(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Remove non-ASCII characters and lowercase; other column types stay as they are."""
    return df.withColumns({c: F.lower(strip_non_ascii(F.col(c))) for c in _text_columns(df, cols)})


def clean_special_chars(df: DataFrame, cols: Sequence[str], decompose: bool = True) -> DataFrame:
    """Normalise entity attributes to plain lowercase ASCII words.

    ``decompose=False`` stays in the JVM, leaves accented letters out instead
    of decomposing them, and gives the same where the text is ASCII already.
    """
    def clean(c: str) -> Column:
        text = F.col(c).cast("string")
        if decompose:
            return plain_words(text)
        spaced = text = F.concat(strip_non_ascii(text), F.lit(" "))
        for ch in LONE_CHARS:
            spaced = F.replace(spaced, F.lit(f" {ch} "), F.lit(" "))
        # one look decides whether the row needs the replacements at all
        text = F.when(text.rlike(" [" + "".join("\\" + ch for ch in LONE_CHARS) + "] "), spaced).otherwise(text)
        text = F.translate(text, SPACE_CHARS, " " * len(SPACE_CHARS))
        return F.lower(collapse_spaces(text))

    return null_literals(df.withColumns({c: clean(c) for c in cols}), cols)


def without_lone_chars(text: str) -> str:
    """The text after each character that stands alone between two spaces is taken out, one character after the other.

    Of a run of the same lone character every second one has no space of its
    own left and stays, as in the replacements one by one.  Only characters
    that stand alone anywhere are looked for.
    """
    lone = set(_lone(text))
    for ch in LONE_CHARS:
        if ch in lone:
            text = text.replace(f" {ch} ", " ")
    return text


# a look-ahead, so that neighbours share a space
_lone = re.compile(" ([" + "".join(map(re.escape, LONE_CHARS)) + "])(?= )").findall


@F.arrow_udf(StringType())
def plain_words(values: pa.Array) -> pa.Array:
    """Accents decomposed, other characters dropped, lone characters taken out, spaces collapsed, lower case."""
    spaces = str.maketrans(SPACE_CHARS, " " * len(SPACE_CHARS))

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        if not text.isascii():
            text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
        return " ".join(without_lone_chars(text + " ").translate(spaces).split()).lower()

    return pa.array(map(clean, values.to_pylist()), pa.string())


def repair_text(
    df: DataFrame, cols: Sequence[str], replacements: Sequence[tuple[str, str]] = (), redecode: Sequence[str] = (),
) -> DataFrame:
    """Ordered regex replacements, then undo UTF-8 text that was read as Latin-1.

    Java group references work in the replacement, so ``("Ã(.) ", "Ã$1")``
    takes the place of a replacement callback.  A value that is not valid
    UTF-8 after re-encoding is kept as it is.
    """
    def replaced(c: str) -> Column:
        text = F.col(c)
        for pattern, new in replacements:
            text = F.regexp_replace(text, pattern, new)
        return text

    def redecoded(c: str) -> Column:
        single_byte = F.col(c).rlike(r"^[\x00-\xFF]*$")
        again = F.encode(F.when(single_byte, F.col(c)), "ISO-8859-1").cast("string")
        return F.when(F.is_valid_utf8(again), again).otherwise(F.col(c))

    return df.withColumns({c: replaced(c) for c in cols}).withColumns({c: redecoded(c) for c in redecode})


def null_literals(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The words ``None`` and ``nan`` standing alone mean NULL."""
    return df.withColumns({c: F.when(~F.col(c).isin("None", "nan"), F.col(c)) for c in cols})


def side_sentence(df: DataFrame, attrs: Sequence[str], prefix: str) -> Column:
    """All non-NULL attributes of one side as one text; NULL when there is none."""
    return F.nullif(collapse_spaces(F.concat_ws(" ", *[F.col(prefix + a).cast("string") for a in attrs])), F.lit(""))


def training_sentences(df: DataFrame, attrs: Sequence[str], label: str = "label") -> DataFrame:
    """``(left, right, label)`` texts; a NULL value is written as ``nan``."""
    def side(prefix: str) -> Column:
        return F.concat_ws(" ", *[F.coalesce(F.col(prefix + a).cast("string"), F.lit("nan")) for a in attrs])

    return df.select(side(LEFT).alias("left"), side(RIGHT).alias("right"), F.col(label).alias("label"))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in df.columns])


def typed_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({"id": F.col("id").cast("bigint"), "label": F.col("label").cast("tinyint")})


def blank_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.fill("", _text_columns(df, cols))


def mirror_pairs(df: DataFrame) -> DataFrame:
    """Two copies of each pair in which one side is written over the other."""
    out = []
    for source, target in ((LEFT, RIGHT), (RIGHT, LEFT)):
        names = [c[len(source):] for c in df.columns if c.startswith(source)]
        out.append(
            df.withColumns({target + n: F.col(source + n) for n in names}).withColumn("mirror_side", F.lit(source))
        )
    return out[0].unionByName(out[1])


def contribution_report(units: DataFrame, score: str = "token_contribution", cut: float = 0.1) -> DataFrame:
    """The table behind a contribution chart: units over the cut, with a colour per sign."""
    return units.filter(F.abs(score) >= cut).select(
        "id", "left_word", "right_word", F.col(score).alias("score"),
        F.when(F.col(score) >= 0, "green").otherwise("red").alias("colour"),
    )
