import random

from plain import repeated_passages

from kinweave.llm import suffix_dedup as S


def result(df, **options):
    rows = S.passages(df, **options).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == repeated_passages(rows)


def test_passages_at_all_places(spark):
    """Passages cut from each other, nested, adjoining and repeated inside one text, over few words."""
    rng = random.Random(3)
    source = [rng.choice("abcdefgh") for _ in range(400)]
    docs = []
    for i in range(120):
        s = rng.randrange(0, 340)
        part = source[s:s + rng.choice([10, 19, 20, 21, 25, 40, 60])]
        own = [f"u{i}_{k}" for k in range(rng.randint(0, 30))]
        k = rng.randint(0, len(own))
        docs.append((i, " ".join(own[:k] + part + own[k:] + (part if rng.random() < 0.2 else []))))
    docs += [(200, "x " * 300), (201, "y " * 21), (202, "Y " * 21)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for gram in (4, 7, 20):
        assert result(df, passage=20, gram=gram) == repeated_passages(docs, 20)


def test_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = [(None, text), (5, text), (3, text), (3, text), (7, None), (8, ""), (9, "short " * 3), (None, None), (10, text + " end"), (11, "z" * 100_000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, start int")
    assert result(df) == {(None, 0, 60, 3), (5, 0, 60, 3), (3, 0, 60, None), (10, 0, 60, None)}
    assert S.passages(df.limit(0)).count() == 0
