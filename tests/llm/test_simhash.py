import random

from plain import components, fingerprint
from pyspark.sql import functions as F

from kinweave.llm import simhash as H

TEXTS = [None, "", " \n", "one", "one two", "one two three four", "ONE two\tthree  four", "É é ß x", "a b " * 100_000]


def near(a, b):
    return bin(a ^ b).count("1") <= 4


def check(rows, texts):
    fps = [fingerprint(texts[i]) for i in range(len(texts))]
    assert {r.doc_id: r.fingerprint % 2**64 for r in rows} == dict(enumerate(fps))
    want = components(list(range(len(fps))), lambda i, j: near(fps[i], fps[j]))
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(want))


def test_documents_and_edge_cases(spark, sf_dir):
    texts = [*TEXTS, *[r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(H.near_duplicates(df).collect(), texts)
    kept = H.first_of_group(df)
    assert kept.columns == df.columns
    fps = [fingerprint(t) for t in texts]
    want = components(list(range(len(fps))), lambda i, j: near(fps[i], fps[j]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_clusters_and_chains(spark):
    """Random fingerprints with dense clusters and chains; also with every value cut into chunks."""
    rng = random.Random(5)
    fps = []
    for _ in range(30):
        x = rng.getrandbits(64)
        fps.append(x)
        for _ in range(rng.choice([0, 1, 5, 80])):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.append(x)
    hub = rng.getrandbits(64)
    fps += [hub ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a)]
    fps = sorted({f - 2**64 if f >= 2**63 else f for f in fps})
    df = spark.createDataFrame([(f,) for f in fps], "fingerprint long")
    want = components(fps, lambda i, j: near(fps[i] % 2**64, fps[j] % 2**64))
    for hot in (H.HOT_VALUE, 20):
        pairs = H.links(df, hot_value=hot).collect()
        assert all(near(r.a % 2**64, r.b % 2**64) and r.a < r.b for r in pairs)
        linked = {(r.a, r.b) for r in pairs}
        got = components(fps, lambda i, j: (fps[j], fps[i]) in linked)
        assert got == want


def test_repeated_rows_nulls_and_empty_tables(spark):
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (3, "other words are here now"), (None, None), (None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in H.near_duplicates(df).collect())
    assert got == [(-1, -1), (-1, -1), (-1, 7), (3, 3), (7, 7), (7, 7)]
    kept = H.first_of_group(df).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == [(-1, ""), (3, "other words are here now"), (7, "a b c d e")]
    assert H.near_duplicates(df.filter(F.lit(False))).count() == 0
    assert H.first_of_group(df.filter(F.lit(False))).count() == 0
