"""License scan: ordered signature rules behind a keyword prefilter.

A text is lower-cased and split into words of letters, digits and characters
beyond ASCII.  Only texts with a rule's keyword go further: each place of a
keyword becomes a row with the words around it and meets the rules of that
keyword, whose two patterns must match what ends before and what starts after
the keyword.  A match is an interval of words.  An interval inside one of a
rule with the same or a higher priority is suppressed; of equal intervals
with equal priority the first rule's stays.

The rule table has a fixed number of rows (names times phrasings), which is
what bounds its broadcast.  Base phrases are rules too, but count at every
place and take no part in suppression.

``score`` is the largest weight of a kept detection, ``BASE_WEIGHT`` where only
base phrases were found, else 0.

Defined results: null and empty texts have no words and no labels (an empty
string).  Rows of equal id and text get equal results, one row each.  An empty
table gives an empty result; only id and text are read.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import let

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
REACH = 16  # words on either side of a keyword that a rule may look at
BASE_WEIGHT = 0.5
PRIORITIES = (1, 2, 3, 4)

BASE = [  # label, keyword, words before and after it: fixed values
    ("mit", "mit", "", " license"),
    ("apache", "apache", "", " license"),
    ("gpl", "general", "", " public license"),
]
_V = "(?: version| v)?"
_PUBLIC = " public licen[cs]e"
NAMES = [  # label, what may stand before the keyword, keyword, the rest of the name, whether it names a version
    ("mit", "", "mit", "", False),
    ("mit-0", "", "mit", " 0", True),
    ("apache-1.1", "", "apache", f"(?: software)?(?: licen[cs]e)?{_V} 1 1", True),
    ("apache-2.0", "", "apache", f"(?: software)?(?: licen[cs]e)?{_V} 2(?: 0)?", True),
    ("apache", "", "apache", "(?: software)?", False),
    *[(f"{x}gpl-{v}", f"(?: gnu)?{word}", "general", f"{_PUBLIC}(?: as published by the free software foundation)?(?: either)?{_V} {v.replace('.', '(?: ')}{')?' if '.' in v else ''}", True)
      for (x, word), vs in ((("", ""), ("1.0", "2.0", "3.0")), (("l", "(?: lesser| library)"), ("2.0", "2.1", "3.0")), (("a", " affero"), ("1.0", "3.0"))) for v in vs],
    *[(f"{x}gpl-{v}.0", "(?: gnu)?", f"{x}gpl", f"{_V} ?v?{v}(?: 0)?", True) for x, vs in (("", "123"), ("l", "23"), ("a", "13")) for v in vs],
    *[(f"{x}gpl-{v}.0", "(?: gnu)?", f"{x}gplv{v}", "", True) for x, vs in (("", "123"), ("l", "23"), ("a", "3")) for v in vs],
    ("lgpl", " lesser", "general", _PUBLIC, False),
    ("agpl", " affero", "general", _PUBLIC, False),
    ("mpl-1.1", "", "mozilla", f"{_PUBLIC}{_V} 1 1", True),
    ("mpl-2.0", "", "mozilla", f"{_PUBLIC}{_V} 2(?: 0)?", True),
    ("mpl-2.0", "", "mpl", f"{_V} 2(?: 0)?", True),
    ("epl-1.0", "", "eclipse", f"{_PUBLIC}{_V} 1(?: 0)?", True),
    ("epl-2.0", "", "eclipse", f"{_PUBLIC}{_V} 2(?: 0)?", True),
    ("cddl-1.0", "", "cddl", f"{_V} 1(?: 0)?", True),
    ("bsd-2-clause", "(?: 2 clause| two clause| simplified)", "bsd", "", True),
    ("bsd-3-clause", "(?: 3 clause| three clause| new| revised| modified)", "bsd", "", True),
    ("bsd-2-clause", "", "bsd", " 2 clause", True),
    ("bsd-3-clause", "", "bsd", " 3 clause", True),
    ("bsd", "", "bsd", "", False),
    ("isc", "", "isc", "", False),
    ("unlicense", "", "unlicense", "", False),
    ("zlib", "", "zlib", "(?: libpng)?", False),
    ("bsl-1.0", "", "boost", f" software licen[cs]e{_V} 1(?: 0)?", True),
    ("artistic-2.0", "", "artistic", f"(?: licen[cs]e)?{_V} 2(?: 0)?", True),
    ("ofl-1.1", " sil(?: open font licen[cs]e)?", "ofl", f"{_V} 1 1", True),
    ("eupl-1.2", "", "eupl", f"{_V} 1 2", True),
    ("odbl-1.0", "", "odbl", f"{_V}(?: 1(?: 0)?)?", True),
    ("wtfpl", "", "wtfpl", "", True),
    ("cc0-1.0", "", "cc0", f"{_V}(?: 1(?: 0)?)?", True),
    *[(f"cc-{k}-{v}", "", word, f"{rest}(?: international| unported)?{_V} {v.replace('.', ' ')}", True)
      for k, long in (("by", ""), ("by-sa", " share ?alike"), ("by-nc", " non ?commercial"), ("by-nd", " no derivatives?"),
                      ("by-nc-sa", " non ?commercial share ?alike"), ("by-nc-nd", " non ?commercial no derivatives?"))
      for v in ("2.0", "3.0", "4.0")
      for word, rest in (("cc", " " + k.replace("-", " ")), ("creative", f" commons attribution{long}"))],
]
PHRASINGS = [  # name, before, after, priority, weight, only for names with a version
    ("identifier", " spdx licen[cs]e identifier", "", 4, 1.0, False),
    ("grant", " (?:licen[cs]ed|released|distributed|available|provided|published)(?: to you)? under(?: the)?(?: terms of(?: the)?)?", "(?: licen[cs]es?)?(?: agreement)?", 3, 0.9, False),
    ("terms", " (?:terms|conditions) of(?: the)?", "(?: licen[cs]e)?", 3, 0.8, False),
    ("named", "", " licen[cs]es?", 2, 0.7, False),
    ("field", " licen[cs]e(?: is)?(?: the)?", "", 2, 0.6, False),
    ("version", "", "", 1, 0.55, True),
]


def rules() -> list[tuple]:
    """``rule, label, priority, weight, keyword, before, after``; a few hundred, in order of the lists above."""
    out = []
    for (label, pre, keyword, rest, versioned), (_, before, after, priority, weight, only) in product(NAMES, PHRASINGS):
        if versioned or not only:
            out.append((label, priority, weight, keyword, f"{before}{pre} $", f"^{rest}{after} "))
    out.append(("proprietary", 2, 0.6, "reserved", " all rights $", "^ "))
    base = [(label, 0, BASE_WEIGHT, keyword, f"{before} $", f"^{after} ") for label, keyword, before, after in BASE]
    return [(i, *r) for i, r in enumerate([*base, *out])]


RULES = "rule int, label string, priority int, weight double, keyword string, before string, after string"


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_base, first_word, last_word, base_labels, labels, score`` and the kept ``spans``, a row per row."""
    table = rules()
    words_of = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SEPARATORS), "")
    keywords = sorted({r[4] for r in table})

    def hits(w):
        def side(first, n):
            return F.concat(F.lit(" "), F.array_join(F.slice(w, first, n), " "), F.lit(" "))

        def hit(i):
            n = F.least(F.lit(REACH), i)
            left = F.when(i == 0, F.lit(" ")).otherwise(side(i - n + 1, n))
            right = F.when(i == F.size(w) - 1, F.lit(" ")).otherwise(side(i + 2, F.lit(REACH)))
            return F.struct(i.alias("at"), F.get(w, i).alias("keyword"), left.alias("left"), right.alias("right"))

        places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(keywords))
        none = F.array(F.struct(F.lit(-1).alias("at"), F.lit("").alias("keyword"), F.lit("").alias("left"), F.lit("").alias("right")))
        found = F.when(F.arrays_overlap(w, F.array(*map(F.lit, keywords))), F.concat(none, F.transform(places, hit))).otherwise(none)
        return F.struct(F.size(w).cast("long").alias("n_words"), found.alias("hits"))

    docs = df.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("h"), let(words_of, hits).alias("x"))
    rows = docs.select("id", "h", "x.n_words", F.explode("x.hits").alias("hit")).select("id", "h", "n_words", "hit.*")
    ruled = rows.join(F.broadcast(df.sparkSession.createDataFrame(table, RULES)), "keyword", "left")
    ruled = (
        ruled.withColumn("l", F.expr("regexp_extract(left, before, 0)"))
        .withColumn("r", F.expr("regexp_extract(right, after, 0)"))
        .filter("at = -1 or (l <> '' and r <> '')")
        .withColumn("base", F.col("priority") == 0)
        .withColumn("start", F.col("at") - (F.length("l") - F.length(F.replace("l", F.lit(" "))) - 1))
        .withColumn("end", F.col("at") + F.length("r") - F.length(F.replace("r", F.lit(" "))))
        .select("id", "h", "n_words", "at", "rule", "label", "priority", "weight", "base", "start", "end")
    )
    order = Window.partitionBy("id", "h").orderBy("start", F.desc("end"), F.desc("priority"), "rule")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.lit(None).cast("int")
    for p in reversed(PRIORITIES):  # the furthest end so far of rules of at least the row's priority
        far = F.max(F.when(F.col("priority") >= p, F.col("end"))).over(earlier)
        reach = F.when(F.col("priority") == p, far).otherwise(reach)
    method = F.col("priority") > 0
    seen = ruled.withColumn("kept", method & F.coalesce(reach < F.col("end"), F.lit(True)))
    base, kept = F.col("base"), F.col("kept")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    copies = F.sum((F.col("at") == -1).cast("long"))
    span = F.struct("start", "end", "label", "rule")
    out = seen.groupBy("id", "h").agg(
        copies.alias("copies"), F.max("n_words").alias("n_words"),
        F.expr("cast(count_if(base) div count_if(at = -1) as bigint)").alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(base | kept).alias("labels"),
        F.coalesce(F.max(F.when(base | kept, F.col("weight"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(kept, span))).alias("spans"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        F.col("id").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
