import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import bpe_codec as B

T = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def exact():
    return T.Tokenizer.from_file(B.default_tokenizer())


def ids_of(exact, text):
    return exact.encode(text or "", add_special_tokens=False).ids


rng = random.Random(5)
LONG = "".join(rng.choices("abcdeéßthn", k=3000))
TEXTS = [
    None, "", " ", "  two  spaces ", "tab\tand\nline\r\n", "don't I'LL we've 'S 12³½", "日本語のテキスト。長い", "emoji 🙂🙂 x",
    "İstanbul ΑΣ ΣΑΣ ſ", "é é́ å", "a<|endoftext|>b <|startoftext|> <|endoftext", "\x00\x1c\x1f\x85 x y",
    "a" * 500, LONG, f"see {LONG} and {LONG[:900]}, ok", "1" * 700, "=" * 900 + "x" * 900, "<|endoftext|>".join(["b" * 300] * 4),
    "ẞ" * 200 + "́" * 90 + " end", "日本" * 300, "word " * 3000,
]


def test_edge_cases_through_leaves(spark, exact):
    """A small leaf sends most texts through the tree, the normal one none."""
    df = spark.createDataFrame([(i % 7, t, "x", b"?") for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, row string, ids binary")
    for leaf in (16, B.LEAF):
        out = B.decode(B.encode(df, leaf=leaf))
        assert out.columns == ["doc_id", "text", "row", "n_tokens", "ids", "decoded"]
        both = B.encode(df, leaf=leaf, decoded=True)
        assert both.columns == out.columns and both.exceptAll(out).isEmpty() and out.exceptAll(both).isEmpty()
        got = out.collect()
        assert len(got) == 2 * len(TEXTS)
        for r in got:
            want = ids_of(exact, r.text)
            assert (r.n_tokens, bytes(r.ids)) == (len(want), B.packed(want)), r.text[:40]
            assert r.decoded == exact.decode(want, skip_special_tokens=False)
    assert B.encode(df.limit(0)).count() == 0 == B.decode(B.encode(df.limit(0), leaf=16)).count()


def test_documents(spark, sf_dir, exact):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: bytes(r.ids) for r in B.encode(docs).collect()}
    assert got == {r.doc_id: B.packed(ids_of(exact, r.text)) for r in docs.collect()}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdehinorst", min_size=2, max_size=120), st.integers(1, 9), st.integers(1, 3))
def test_tree_equals_the_whole_word(word, leaf, window):
    c = B.codec(None)
    cuts = [word[k:k + leaf] for k in range(0, len(word), leaf)]
    parts = [c.word_ids(s, k == len(cuts) - 1) for k, s in enumerate(cuts)]
    whole = c.word_ids(word, True)
    assert c.tree(parts, True) == whole
    joined = parts[0]
    for k, p in enumerate(parts[1:], 2):
        joined = c.joined(joined, p, k == len(parts), window)
    assert joined == whole
    assert c.tree([c.word_ids(s, False) for s in cuts], False) == c.word_ids(word, False)


def test_plain_latin_equals_the_library(exact):
    c = B.codec(None)
    alphabet = [chr(i) for i in range(0x20, 0x180) if not 0x7F <= i <= 0xA0] + list(" \t\n''") * 5
    for _ in range(300):
        text = "".join(rng.choices(alphabet, k=60))
        assert c.ids(text) == B.packed(ids_of(exact, text)), text


def test_ids_outside_the_vocabulary_and_null_ids(spark, exact):
    df = spark.createDataFrame([(1, None), (2, B.packed([1, 99999, 320]))], "k long, ids binary")
    got = {r.k: r.decoded for r in B.decode(df).collect()}
    assert got == {1: "", 2: exact.decode([1, 99999, 320], skip_special_tokens=False)}
