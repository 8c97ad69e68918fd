import numpy as np

from kinweave.operators import subwords as W


def test_table_and_vectors_equal_plain_numpy(spark):
    rng = np.random.default_rng(2)
    words = ["red", "redder", "green", "x", "日本語", "a" * 300, "red" * 20]
    vec = {w: rng.normal(size=5).astype(np.float32) for w in words}
    vocab = spark.createDataFrame([(w, [float(x) for x in v]) for w, v in vec.items()] + [(None, [0.0] * 5), ("null", None)], "word string, vec array<float>").repartition(4)
    table = W.bucket_table(vocab)
    got = {r.bucket: r.vec for r in table.collect()}
    want: dict = {}
    for w, v in vec.items():
        for b in set(W.buckets_of(w, {}).tolist()):
            want.setdefault(b, []).append(v.astype(float))
    assert got.keys() == want.keys() and all(np.allclose(got[b], np.mean(v, axis=0), atol=1e-6) for b, v in want.items())
    matrix = W.rule_vectors(5)
    for b, v in want.items():
        matrix[b] = np.mean(v, axis=0)
    asked = spark.createDataFrame([("red",), ("reds",), ("zzz",), ("",), (None,)], "word string")
    for r in W.subword_vectors(asked, table, 5).collect():
        mean = matrix[W.buckets_of(r.word, {})].mean(axis=0) if r.word else np.zeros(5)
        assert np.allclose(r.vec, mean, atol=1e-6) and (not r.word or np.any(mean))
    known = {r.word: r.vec for r in W.with_unknown_words(vocab, asked, 5).collect()}
    assert np.allclose(known["red"], vec["red"]) and np.any(known["zzz"]) and known[None] == [0.0] * 5


def test_empty_vocabulary(spark):
    none = spark.createDataFrame([], "word string, vec array<float>")
    one = spark.createDataFrame([("word",)], "word string")
    assert W.bucket_table(none).count() == 0
    got = W.subword_vectors(one, W.bucket_table(none), 4).first().vec
    assert np.allclose(got, W.rule_vectors(4)[W.buckets_of("word", {})].mean(axis=0), atol=1e-6)
