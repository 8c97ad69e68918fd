"""Quality rules as a short-circuit cascade.

Every rule is a native expression over the text.  The cascade measures cost
and selectivity of each rule on a sample of ``SAMPLE_ROWS`` rows and puts the
rules in order of rejections per second; ``And`` then stops at the first rule
that rejects a row, so costly rules see only what cheap ones left.  The order
never changes a verdict.

Defined results: a null text has no words, an empty or blank one neither, and
both are rejected for too few words.  Repeated rows each get their own
verdict, an empty table stays empty, extra columns pass through, and a column
of the name of an output is replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import fresh, let

SAMPLE_ROWS = 200  # the sample orders the rules; it takes no part in a verdict
SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 5


def words_of(text: Column) -> Column:
    """Words between ASCII white space; no empty ones."""
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE)),
               lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACES)))


def n_symbols(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")).cast("long")


def n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    return let(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")


def n_upper(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words inside windows of five words that occur at least twice, the first occurrence included.

    Windows are compared by 64-bit hashes.  Only a text with an equal pair of
    hashes sorts them; equal neighbours give the places of repeated windows,
    and places less than five apart share words.
    """
    n = F.size(words)
    places = F.sequence(F.lit(0), n - WINDOW)
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def repeated(s: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(s) - 1)
        same = lambda j, k: F.get(s, j)["h"] == F.get(s, k)["h"]
        hit = lambda j: F.coalesce(same(j, j + 1), F.lit(False)) | F.when(j > 0, same(j, j - 1)).otherwise(False)
        return F.sort_array(F.transform(F.filter(at, hit), lambda j: F.get(s, j)["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(let(order, repeated), covered))

    return F.when(n < WINDOW, F.lit(0)).otherwise(let(hashes, count)).cast("long")


FEATURES: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: F.size(words_of(t)).cast("long"),
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_lines": n_lines,
    "n_dup_lines": n_dup_lines,
    "n_upper": n_upper,
    "n_repeat_words": lambda t: let(words_of(t), n_repeat_words),
}


def features(text: Column) -> Column:
    """All features of a text in one struct, its words split once."""
    return let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), word_chars(text).alias("word_chars"),
        n_symbols(text).alias("n_symbols"), n_lines(text).alias("n_lines"),
        n_dup_lines(text).alias("n_dup_lines"), n_upper(text).alias("n_upper"),
        n_repeat_words(w).alias("n_repeat_words")))


@dataclass(frozen=True)
class Rule:
    """``rejects(get)`` is true for a row to drop; ``get(name)`` gives a feature."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


BASE = (
    Rule("few_words", lambda get: get("n_words") < 10),
    Rule("repeats", lambda get: 100 * get("n_repeat_words") > 20 * get("n_words")),
)
RULES = (
    *BASE,
    Rule("symbols", lambda get: 10 * get("n_symbols") > 3 * get("n_words")),
    Rule("upper_case", lambda get: 2 * get("n_upper") > get("word_chars")),
    Rule("repeated_lines", lambda get: 2 * get("n_dup_lines") > get("n_lines")),
    Rule("word_length", lambda get: (get("word_chars") > 25 * get("n_words")) | (2 * get("word_chars") < 3 * get("n_words"))),
)


def measured_order(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text",
                   sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on the first ``sample_rows`` rows, best first.

    The rows are few and come to the driver once; each rule runs over them as
    a Spark job.  With an empty sample the given order stays.
    """
    rows = df.select(F.col(text).alias("t")).take(sample_rows)  # reads as many partitions as that takes, not all
    if not rows:
        return list(rules)
    sample = df.sparkSession.createDataFrame(rows, "t string")
    get = lambda name: FEATURES[name](F.col("t"))
    rates = []
    for rule in rules:
        began = time.perf_counter()
        rejected = sample.filter(rule.rejects(get)).count()
        rates.append((rejected / len(rows)) / max(time.perf_counter() - began, 1e-3))
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-rates[i], i))]


def verdict(rules: Sequence[Rule], get: Callable[[str], Column]) -> Column:
    """True where no rule rejects; later rules are not evaluated for a rejected row."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(rule.rejects(get), F.lit(False)).otherwise(out)
    return out


def keep_good(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text",
              sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows that no rule rejects, with the columns of ``df``."""
    order = measured_order(df, rules, text, sample_rows)

    def passes(words: Column) -> Column:  # one split for all rules that need words
        own = {"n_words": F.size(words).cast("long"), "n_repeat_words": n_repeat_words(words)}
        return verdict(order, lambda name: own[name] if name in own else FEATURES[name](F.col(text)))

    return df.filter(let(words_of(F.col(text)), passes))


def with_verdict(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text",
                 sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every row with its features, ``base_failed`` and ``kept``."""
    order = measured_order(df, rules, text, sample_rows)
    made = [*FEATURES, "base_failed", "kept"]
    f = fresh(df, "features")
    keep = [c for c in df.columns if c.lower() not in made]
    rows = df.select(*[F.col(f"`{c}`") for c in keep if c != text], F.col(text), features(F.col(text)).alias(f))
    get = lambda name: F.col(f)[name]
    return rows.select(
        *[F.col(f"`{c}`") for c in keep], *[get(n).alias(n) for n in FEATURES],
        (~verdict(BASE, get)).alias("base_failed"), verdict(order, get).alias("kept"))
