import random

import pytest

from kinweave.llm import token_counts as C

T = pytest.importorskip("tokenizers")


def exact(pieces, byte_fallback=True):
    t = T.Tokenizer(T.models.Unigram(pieces, 0, byte_fallback))
    t.pre_tokenizer = T.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    return t


TEXTS = [None, "", " ", "  two  spaces ", "tab\tand\nline", "日本語", "emoji 🙂🙂 x", "▁own ▁ sign", "a" * 5000, "word " * 20_000, "<s> <0x41>", "é́"]


def test_documents_and_edge_cases(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    texts = TEXTS + [r.text for r in rows]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    for scores in ("zipf", "file"):
        t = exact(C.vocabulary(None, scores))
        out = C.with_token_counts(df, scores=scores)
        assert out.columns == ["doc_id", "text", "n_tokens", "log_score"]
        got = {r.doc_id: r.n_tokens for r in out.collect()}
        assert got == {i: len(t.encode(x or "").ids) for i, x in enumerate(texts)}
    assert C.with_token_counts(df.limit(0)).count() == 0


def test_ties():
    """Few pieces with few scores: many equal paths."""
    rng = random.Random(2)
    for _ in range(200):
        names = {"".join(rng.choices("ab▁", k=rng.randint(1, 4))) for _ in range(12)}
        pieces = [("<unk>", 0.0), *[(f"<0x{i:02X}>", -9.0) for i in range(256)], *[(x, -float(rng.randint(1, 3))) for x in sorted(names)]]
        t, c = exact(pieces), C.TokenCounter(pieces)
        for _ in range(20):
            text = "".join(rng.choices("abcé ", k=rng.randint(0, 25)))
            assert c.count(text)[0] == len(t.encode(text).ids), (text, pieces[257:])
