import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brute import align
from checks import queries as Q
from kinweave.functions.strings import jaro_winkler
from kinweave.operators import similarity as S
from kinweave.operators.align import align_tokens
from kinweave.operators.tokens import pair_tokens
from kinweave.plans.datasets import document_pairs


def words(rows, side):
    return pa.array([[t.word for t in r[f"{side}_toks"]] for r in rows])


def test_whole_documents_have_the_same_edges_with_and_without_the_bound(spark, sf_dir):
    rows = Q.document_tokens(spark, sf_dir).orderBy("id").limit(8).collect()
    left, right = words(rows, "l"), words(rows, "r")
    plain = lambda a, b: jaro_winkler(a, b)  # noqa: E731  no table of words
    want, got = (S.word_edges(left, right, 0.6, f) for f in (plain, jaro_winkler))
    for a, b in zip((want.row, want.k, want.l, want.r), (got.row, got.k, got.l, got.r), strict=True):
        assert np.array_equal(a, b)
    small = S.word_edges(left, right, 0.6, jaro_winkler, cells=5000)
    assert np.array_equal(small.k, got.k) and np.array_equal(small.l, got.l)


def test_few_cells_are_compared(spark, sf_dir):
    n = S.cell_counts(Q.document_tokens(spark, sf_dir), 0.6).agg(*[F.sum(c).alias(c) for c in ("n_cells", "n_pairs", "n_scored", "n_edges")]).first()
    assert n.n_cells > 20_000_000 and n.n_cells >= 5 * n.n_scored
    at_75 = S.cell_counts(Q.document_tokens(spark, sf_dir), 0.75).agg(F.sum("n_pairs"), F.sum("n_scored")).first()
    assert at_75[0] > 20 * at_75[1]


def test_records_with_nulls_accents_and_blank_texts_align_like_plain_python(spark, sf_dir):
    docs = document_pairs(spark, sf_dir).filter("length(left_text) < 900 and length(right_text) < 900").orderBy("id").limit(6)
    odd = spark.createDataFrame(
        [(-1, 0, None, "Ünï code façade", "de", None), (-2, 0, "", "  ", "", ""), (-3, 1, "en", "a a a b " * 20, "en", "b a a " * 15),
         (-4, 0, "x", "http://ex.ample/" + "q" * 90 + " z", "x", "http://ex.ample/" + "q" * 88 + " zz")],
        "id long, label int, left_lang string, left_text string, right_lang string, right_text string")
    pairs = docs.select(odd.columns).unionByName(odd)
    toks = pair_tokens(Q.P.drop_non_ascii(pairs), Q.DOC_ATTRS)
    got = {}
    for r in align_tokens(toks).select("id", "pass_no", "left_pos", "right_pos", "cos_sim").collect():
        got.setdefault(r.id, []).append(tuple(r)[1:])
    for r in toks.collect():
        want = align(*[[(t.attr, t.word) for t in side] for side in (r.l_toks, r.r_toks)])
        assert sorted(got.get(r.id, [])) == want, r.id


def test_document_pairs_follow_their_source(spark, tmp_path):
    rows = [(5, "a", "en", "x"), (2, "a", None, "x"), (9, "a", "de", None), (4, None, "en", "y"), (1, None, "en", "y"), (7, "", "en", "z")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.id, r.label, r.left_text, r.right_text) for r in document_pairs(spark, str(tmp_path)).collect())
    assert got == [(1, 1, "y", "y"), (2, 1, "x", "x"), (5, 0, "x", None)]
