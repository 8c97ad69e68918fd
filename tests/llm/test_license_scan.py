import random

from plain import licenses

from kinweave.llm import license_scan as L

TEXTS = [
    None, "", "...", "MIT License", "the MIT-license, and mit license MIT LICENSE!", "mit", "license mit license",
    "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: MIT", "SPDX-License-Identifier: GPL-3.0 or Apache-2.0",
    "GNU Lesser General Public License v2.1", "Creative Commons Attribution-ShareAlike 4.0", "all rights reserved", "BSD 3-Clause License and bsd license",
    "émit license mité license", "word " * 3000 + "MIT License", "MIT license " * 500, "general public license general public license",
]


def test_rules_are_a_bounded_table():
    assert 200 < len(L.rules()) < 1000 and {r[2] for r in L.rules()} == {0, *L.PRIORITIES}


def test_against_plain_python(spark, sf_dir):
    rng = random.Random(4)
    parts = "mit apache general public license licence gnu version 2 0 3 v2 under the terms of licensed bsd clause cc by nc 4 spdx identifier , . x".split()
    texts = TEXTS + [" ".join(rng.choices(parts, k=rng.randint(5, 60))) for _ in range(150)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    rules = L.rules()
    got = {r.doc_id: tuple(r)[1:8] for r in L.scan(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == licenses(t, rules), (i, (t or "")[:80])
    assert all(0 <= r[-1] <= 1 for r in got.values())


def test_repeated_rows_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "mit license"), (1, "mit license"), (None, None), (None, None), (1, "x")], "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r.n_words, r.n_base, r.labels) for r in L.scan(df).collect())
    assert rows == [(0, 0, 0, ""), (0, 0, 0, ""), (1, 1, 0, ""), (1, 2, 1, "mit"), (1, 2, 1, "mit")]
    assert L.scan(df.limit(0)).count() == 0
