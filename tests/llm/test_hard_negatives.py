import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import hard_negatives as H
from kinweave.llm.oracles import ORACLES
from kinweave.llm.queries import op12_hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>, row int, q string"


def plain(rows, anchor=lambda v: v % 10 == 0, k=5):
    """The contract row by row; ``rows`` hold the final label."""
    ok = []
    for v, label, x, *_ in rows:
        if v is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            ok.append((v, label, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    for i, (a, label, x) in enumerate(ok):
        if not anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), v, j, other == label) for j, (v, other, y) in enumerate(ok) if j != i)
        for s, v, _, _ in [p for p in scored if p[3]][:k]:
            inside = [n for n in scored if not n[3] and -80 * s <= -100 * n[0] <= -100 * s][:k]
            out += [(a, v, r, n[1], -s, -n[0]) for r, n in enumerate(inside, 1)]
    return sorted(out)


def got(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


def cases(seed, n=400, d=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, d))
    rows = []
    for i in range(n):
        c = int(rng.integers(4))
        x = centres[c] + rng.normal(size=d) * 0.4
        rows.append((i, c if rng.random() < 0.8 else int(rng.integers(4)), [float(v) for v in x], 1, "x"))
    hot = [0.5] * d
    rows += [(1000 + i, i % 3, hot, 1, "x") for i in range(200)]  # one vector, many rows
    rows += [(2000, 1, None, 1, "x"), (2010, None, hot, 1, "x"), (None, 1, hot, 1, "x"), (2020, 1, [None] * d, 1, "x"),
             (2030, 1, [float("nan")] * d, 1, "x"), (2040, 2, [float("inf")] * d, 1, "x"), (2050, 2, [], 1, "x"),
             (2060, 3, [0.0] * d, 1, "x"), (2070, 3, [-9.0] * d, 1, "x"), (2080, 3, hot[:3], 1, "x"), (30, 0, hot, 1, "x"), (1050, 50 % 3, hot, 1, "x"),
             (2090, 2, [3e4] * d, 1, "x"), (2100, 1, [2.9e4] * d, 1, "x")]
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk_bytes", [H.CHUNK_BYTES, 4000])
def test_edge_cases(spark, chunk_bytes):
    rows = cases(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(H.mine(df, F.col("vec_id") % 10 == 0, chunk_bytes=chunk_bytes)) == plain(rows)


def test_empty(spark):
    df = spark.createDataFrame(cases(2)[:1], SCHEMA)
    assert got(H.mine(df.limit(0), F.col("vec_id") % 10 == 0)) == []
    assert got(H.mine(df.withColumn("embedding", F.lit(None).cast("array<float>")), F.col("vec_id") % 10 == 0)) == []


def test_intervals_hold_the_scores_and_leave_rows_out():
    rng = np.random.default_rng(4)
    basis = np.linalg.qr(rng.normal(size=(16, 16)))[0][:5]
    for scale in (1.0, 1e3, 1e6):
        q = np.floor(rng.normal(size=(300, 16)) * scale * np.r_[np.full(5, 20.0), np.full(11, 2.0)] @ np.eye(16))
        norm, angles = H.angles_to(q, np.eye(16)[:5])
        rows = H.Rows.of([range(300), range(300), [0] * 300, norm, [x.tobytes() for x in q], [x.tobytes() for x in angles]], 16, 5)
        least, most = H.bounds(rows, rows)
        true = q @ q.T
        assert (least <= true).all() and (true <= most).all()
        assert (most - least).mean() < 0.2 * np.abs(np.outer(norm, norm)).mean()
        norm, angles = H.angles_to(q, basis)
        rows = H.Rows.of([range(300), range(300), [0] * 300, norm, [x.tobytes() for x in q], [x.tobytes() for x in angles]], 16, 5)
        least, most = H.bounds(rows, rows)
        assert (least <= true).all() and (true <= most).all()
    rows.label[:] = np.arange(300) % 2
    best = H.Best(300, 5)
    scored = H.search(rows, rows, best, np.full((300, 1), H.LOWEST), np.full((300, 1), H.HIGHEST), True)
    assert 0 < scored < 300 * 150
    for a in range(0, 300, 37):
        mine = best.found[0] == a
        want = sorted((-int(true[a, j]), j) for j in range(300) if j != a and j % 2 == a % 2)[:5]
        assert [(-s, v) for s, v in zip(best.found[1][mine].tolist(), best.found[2][mine].tolist())] == want


def test_large_integers():
    a = np.array([[3e9, 3e9]]), np.array([[2e9, 1.0]])
    assert H.scores(*a).tolist() == [6 * 10 ** 18 + 3 * 10 ** 9]
    with pytest.raises(OverflowError):
        H.scores(np.array([[3e9, 3e9]]), np.array([[3e9, 3e9]]))


def test_query_against_sql_and_plain(spark, sf_dir):
    rows = got(op12_hard_negatives(spark, sf_dir))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    table = con.execute("SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END, embedding FROM embeddings").fetchall()
    assert rows == plain(table, lambda v: v % 100 == 0)
    cur = con.execute(ORACLES["op12_hard_negatives"])
    assert [c[0] for c in cur.description] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert rows == sorted(cur.fetchall())
