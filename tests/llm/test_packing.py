import random
from collections import defaultdict

import numpy as np
import pytest
from plain import pieces

from kinweave.llm import packing as P

T = pytest.importorskip("tokenizers")


def check(rows, texts, capacity=1024):
    t = T.Tokenizer.from_file(P.default_tokenizer())
    want = []
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want += [(i, k, *p) for k, p in enumerate(pieces(ids, capacity))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(s[-1]) <= capacity
    return len(seqs)


def test_documents_and_edge_cases(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    texts += [None, "", " ", "a\x85b c  d\t\n e", "日本語 テキスト", "emoji 🙂 ok", "it's we'll 123 4.5\r\n x", "<|endoftext|> in a text", "word " * 5000, "x" * 20_000, "ǅ ɐ ͅ"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for group in (P.GROUP_PIECES, 40):
        out = P.packed_documents(df, group_pieces=group)
        rows = out.collect()
        n = check(rows, texts)
        lengths = np.asarray([r.length for r in rows])
        assert n <= P.lower_bound(lengths, 1024) * 1.02 + (1 if group > 40 else 12)
    assert all(len(r.ids) == 4 * r.length for r in rows)


def test_exchange_rounds_help(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([30, 90, 200, 350, 600])) for i in range(2000)]
    df = spark.createDataFrame(rows, "piece_no long, length long")
    counts = [P.pack(df, group_pieces=50, rounds=r).select("sequence_id").distinct().count() for r in (0, 2)]
    bound = P.lower_bound(np.asarray([n for _, n in rows]), 1024)
    assert bound <= counts[1] <= counts[0]


def test_bounds_hold():
    rng = random.Random(1)
    for _ in range(200):
        x = np.asarray([rng.randint(1, 20) for _ in range(rng.randint(0, 30))], np.int64)
        bins, offsets, fill = P.best_fit(x, 20)
        assert P.lower_bound(x, 20) <= len(fill)
        assert (fill <= 20).all() and all(fill[b] == x[bins == b].sum() for b in range(len(fill)))
    assert P.lower_bound(np.asarray([11] * 7 + [9] * 7), 20) == 7
    assert P.lower_bound(np.asarray([11] * 7 + [10] * 3), 20) >= 9


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "x y", 5), (1, "x y", 5), (None, None, 5)], "doc_id long, text string, offset int")
    rows = P.packed_documents(df).collect()
    assert len(rows) == 3 and len({r.offset for r in rows}) == 3
    assert P.packed_documents(df.limit(0)).count() == 0
