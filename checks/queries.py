"""One query per operator over the whole given tables; names are the operator ids of the survey."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinweave.functions.numbers import rounded_column
from kinweave.functions.strings import edit_ratio
from kinweave.operators import contributions as K
from kinweave.operators import embedding as E
from kinweave.operators import evaluation as X
from kinweave.operators import features as A
from kinweave.operators import matcher as C
from kinweave.operators import sampling as W
from kinweave.operators import scoring as N
from kinweave.operators import text as P
from kinweave.operators.align import (
    Thresholds, above_threshold, align_pairs, align_tokens, align_units, most_similar, preference_lists, stable_pairs, unit_rows,
)
from kinweave.operators.network import Network, fit_network, packed_network_score
from kinweave.operators.scale import durable, stored
from kinweave.operators.pieces import piece_word_vectors
from kinweave.operators.similarity import cell_counts, edges_long, with_edges
from kinweave.operators.subwords import bucket_table, subword_vectors
from kinweave.operators.tokens import attribute_words, entity_tokens, exploded, pair_tokens, tokens_long
from kinweave.plans.datasets import document_pairs, part_links, part_pairs, parts, table
from kinweave.plans.pipeline import MatcherPipeline, explained_units, predict, predict_from_units
from kinweave.plans.reuse import StagedMatcher
from kinweave.sources import tables as S
from kinweave.sources.stages import StageStore

ATTRS = ["brand", "name"]
VECTOR_SIZE = 64
INTERCEPT = -1.0
T = Thresholds()
Query = Callable[[SparkSession, str], DataFrame]


def fixed_coefficients(names: list[str]) -> dict[str, float]:
    """Coefficients by a rule, so that score and contributions can be checked in SQL."""
    return {n: ((i * 37) % 11 - 5) / 10 for i, n in enumerate(names)}


NAMES = A.feature_names(ATTRS)
COEF = fixed_coefficients(NAMES)
MODEL = C.LinearMatcher.fixed(NAMES, COEF, INTERCEPT)


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


# ---- shared inputs -------------------------------------------------------------------------------

def pairs(spark, d) -> DataFrame:
    return part_pairs(spark, d)


def clean_pairs(spark, d) -> DataFrame:
    return P.drop_non_ascii(pairs(spark, d))


def tokens(spark, d) -> DataFrame:
    return pair_tokens(clean_pairs(spark, d), ATTRS)


def units(spark, d) -> DataFrame:
    return align_tokens(tokens(spark, d))


def scored_units(spark, d) -> DataFrame:
    return A.by_pair(N.similarity_score(units(spark, d)))


def scored_pairs(spark, d) -> DataFrame:
    """Pairs with their scored units in an array."""
    return N.similarity_score(align_pairs(tokens(spark, d)))


def prediction(spark, d, **options):
    return predict(pairs(spark, d), MODEL, ATTRS, **options)


def vocabulary(spark, d) -> DataFrame:
    """Every word of the part table that has a vector: dense rank of the word in hash order."""
    words = entity_tokens(P.drop_non_ascii(parts(spark, d)), ATTRS).select("word").distinct()
    ranked = W.dense_ids(words, "word", "vec_id")
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return ranked.join(vectors, "vec_id").select("word", "vec")


def vector_tokens(spark, d) -> DataFrame:
    return E.attach_vectors(tokens(spark, d), vocabulary(spark, d), VECTOR_SIZE)


def vector_units(spark, d) -> DataFrame:
    return align_tokens(vector_tokens(spark, d), similarity="cosine", with_vectors=VECTOR_SIZE)


def split_of() -> Column:
    k = F.pmod(F.col("id"), F.lit(5))
    return F.when(k <= 2, "train").when(k == 3, "valid").otherwise("test")


def split_rows(spark, d) -> dict[str, DataFrame]:
    """Stored feature rows per split, for the queries that fit models."""
    p = pairs(spark, d)
    feats = A.feature_vectors(scored_pairs(spark, d), ATTRS, fill_first=True)
    rows = C.kept_rows(C.training_rows(feats, p).withColumn("split", split_of()))
    return {s: rows.filter(F.col("split") == s).drop("split") for s in ("train", "valid", "test")}


def scratch(spark) -> str:
    """A new folder in the session's shared folder; a local one only where none is set, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared}/query-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="kinweave-query-")


# ---- sources and sinks --------------------------------------------------------------------------

def s1(spark, d):
    path = f"{scratch(spark)}/pairs.parquet"
    S.write_table(pairs(spark, d), path)
    return S.read_pairs(spark, path, ATTRS)


def s2(spark, d):
    path = f"{scratch(spark)}/entities.csv"
    parts(spark, d).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    return S.read_entities(spark, path, ATTRS, drop=["brand"])


UNIT_COLUMNS = ["id", "unit_no", "left_word", "right_word", "cos_sim", "left_attribute", "right_attribute", "label"]


def s3(spark, d):
    path = f"{scratch(spark)}/units"
    S.write_units_csv(units(spark, d).select(*UNIT_COLUMNS), path)
    return S.read_units_csv(spark, path)


def s3_stages(spark, d):
    """Units of the second of two runs over one store, which reads them."""
    base = scratch(spark)
    S.write_table(pairs(spark, d), f"{base}/pairs")
    for _ in range(2):
        store = StageStore(spark, f"{base}/store")
        found = StagedMatcher(store, MatcherPipeline(ATTRS)).units(store.source("pairs", f"{base}/pairs"))
    return A.unit_table(found.df.withColumn("preds", F.array())).select(*UNIT_COLUMNS, F.lit(found.reused).alias("reused"))


def s4(spark, d):
    path = f"{scratch(spark)}/vectors"
    found = E.entity_vectors(P.drop_non_ascii(parts(spark, d)), ATTRS, vocabulary(spark, d), VECTOR_SIZE)
    S.write_table(found, path)
    rows = exploded(spark.read.parquet(path), ["id"], F.col("toks"), "t")
    return rows.select("id", "t.pos", "t.attr", "t.word", r6(F.aggregate(
        "t.vec", F.lit(0.0), lambda s, x: s + x.cast("double"))).alias("vec_sum"))


def s5(spark, d):
    path = f"{scratch(spark)}/model"
    model = MatcherPipeline(ATTRS).fit(pairs(spark, d))
    model.save(spark, path)
    again = MatcherPipeline.load(spark, path)
    return again.predict(pairs(spark, d), explain=False).scores


def s6(spark, d):
    path = f"{scratch(spark)}/metrics"
    S.write_metrics(a15(spark, d), path)
    return S.read_metrics(spark, path, StructType.fromDDL(
        "split string, tp bigint, fp bigint, fn bigint, precision double, recall double, f1 double"))


def s7(spark, d):
    base = scratch(spark)
    words = X.units_to_tokens(prediction(spark, d).units).select("id", "attribute", "pos", "word", "label",
                                                                 F.col("token_contribution").alias("impact"))
    S.write_table(words.filter("label = 1").drop("label"), f"{base}/positive")
    S.write_table(words.filter("label = 0").drop("label"), f"{base}/negative")
    return rounded(S.load_explanations(spark, f"{base}/positive", f"{base}/negative").groupBy("id", "attribute", "pos", "word", "polarity").agg(F.sum("impact").alias("impact")), "impact")


def s8(spark, d):
    path = f"{scratch(spark)}/reduced"
    S.write_table(W.reduced_training_sets(pairs(spark, d)), path, ["train_size", "rep"])
    return spark.read.parquet(path).select("id", "label", "train_size", "rep")


# ---- projections -----------------------------------------------------------------------------------

def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang")


def p1(spark, d):
    p = pairs(spark, d)
    return p.select("id", *P.pair_columns(p))


def p2(spark, d):
    x, y = P.split_x_y(pairs(spark, d))
    features = ["left_brand", "left_name", "right_brand", "right_name"]
    counts = x.groupBy(*features).agg(F.count("*").alias("n"))
    return counts.withColumn("kind", F.lit("x")).unionByName(
        y.groupBy("label").agg(F.count("*").alias("n")).select(
            F.col("label").cast("string").alias("left_brand"), *[F.lit("").alias(c) for c in features[1:]], "n", F.lit("y").alias("kind")))


def p3(spark, d):
    return P.drop_non_ascii(documents(spark, d), ["text"])


def p4(spark, d):
    return P.clean_special_chars(documents(spark, d), ["text"])


REPLACEMENTS = [(" _", ""), (r"\. \.", "."), ("1/2", "½"), ("Ã(.) ", "Ã$1"), ("é(.) ", "e$1")]


def p5(spark, d):
    return P.repair_text(documents(spark, d), ["text"], REPLACEMENTS, redecode=["text"])


def p6(spark, d):
    docs = documents(spark, d).withColumn("lang", F.when(F.col("lang") == "en", "nan").when(
        F.col("lang") == "fr", "None").otherwise(F.col("lang")))
    return P.null_literals(docs, ["lang"]).select("doc_id", "lang")


def p7(spark, d):
    p = pairs(spark, d).withColumn("left_brand", F.when(F.col("label") == 0, F.col("left_brand")))
    return p.select("id", P.side_sentence(p, ATTRS, "left_").alias("left"), P.side_sentence(p, ATTRS, "right_").alias("right"))


def p8(spark, d):
    p = pairs(spark, d).withColumn("left_brand", F.when(F.col("label") == 0, F.col("left_brand")))
    return P.training_sentences(p, ATTRS).groupBy("left", "right", "label").agg(F.count("*").alias("n"))


def p9(spark, d):
    return entity_tokens(documents(spark, d), ["text"], "doc_id").groupBy("doc_id", "attr").agg(
        F.count("*").alias("n_words"), F.max("pos").alias("last_pos"), F.count_distinct("word").alias("n_distinct"))


def p10(spark, d):
    return tokens_long(tokens(spark, d))


def p11(spark, d):
    return W.dense_ids(documents(spark, d), "doc_id", "id").select("id", "doc_id")


def p12(spark, d):
    return P.typed_keys(P.prefixed(parts(spark, d), "left_").withColumns({"id": F.col("left_id"), "label": F.lit(1)})).select(
        "id", F.col("label").cast("int").alias("label"), "left_id", "left_name", "left_brand")


def p13(spark, d):
    p = pairs(spark, d).withColumn("left_brand", F.when(F.col("label") == 0, F.col("left_brand")))
    return P.blank_nulls(p, ["left_brand"]).select("id", "left_brand")


def p14(spark, d):
    return P.mirror_pairs(pairs(spark, d).drop("left_id", "right_id"))


def p15(spark, d):
    return rounded(X.units_to_tokens(prediction(spark, d).units), "token_contribution")


def p16(spark, d):
    return rounded(P.contribution_report(prediction(spark, d).units).groupBy("left_word", "right_word", "colour").agg(
        F.count("*").alias("n"), F.sum("score").alias("score")), "score")


# ---- filters -----------------------------------------------------------------------------------------

def f1(spark, d):
    links = part_links(spark, d)
    return S.used_entities(parts(spark, d), [links.filter("label = 1")], "left")


def f2(spark, d):
    return scored_units(spark, d).select("id", "unit_no", A.is_paired().alias("is_paired"))


def f3(spark, d):
    return scored_units(spark, d).filter(~A.is_paired()).select(
        "id", "unit_no", F.when(A.is_exclusive(), "exclusive").otherwise("both").alias("side"))


def f4(spark, d):
    members = A.memberships(scored_units(spark, d), ATTRS)
    return members.filter(F.col("scope") != A.ALL).groupBy("scope", "grp").agg(F.count("*").alias("n"))


def f5(spark, d):
    scored = prediction(spark, d, explain=False).scores.join(pairs(spark, d).select("id", "label"), "id")
    return rounded(scored.filter((F.col("label") > 0.5) | (F.col("match_score") >= 0.01)).select(
        "id", "label", "match_score"), "match_score")


def f6(spark, d):
    chosen = W.per_class_sample(pairs(spark, d), 100).select("id")
    return units(spark, d).join(chosen, "id", "left_semi").select("id", "unit_no", "left_word", "right_word")


def f7(spark, d):
    u = units(spark, d)
    return u.filter(F.col("right_word") != "[UNP]").groupBy("right_word").agg(F.count("*").alias("n"))


# ---- joins ----------------------------------------------------------------------------------------------

def j1(spark, d):
    e = parts(spark, d)
    return S.assemble_pairs(part_links(spark, d), e, e)


def j2(spark, d):
    return edges_long(with_edges(tokens(spark, d), T.unpair))


DOC_ATTRS = ["lang", "text"]


def document_tokens(spark, d) -> DataFrame:
    """Whole documents as records: hundreds of words a side, some thousands, accents and empty texts."""
    return pair_tokens(P.drop_non_ascii(document_pairs(spark, d)), DOC_ATTRS)


def j2_documents(spark, d):
    counts = cell_counts(document_tokens(spark, d), T.unpair)
    return counts.select("id", "n_cells", "n_pairs", "n_edges", F.round("sim_sum", 4).alias("sim_sum"))


def j3(spark, d):
    long = tokens_long(tokens(spark, d)).select("id", "side", "pos", "word")
    used = edges_long(with_edges(tokens(spark, d), T.duplicate))
    seen = used.select("id", F.lit("left").alias("side"), F.col("left_pos").alias("pos")).unionByName(
        used.select("id", F.lit("right").alias("side"), F.col("right_pos").alias("pos")))
    return long.join(seen, ["id", "side", "pos"], "left_anti")


def j4(spark, d):
    u = N.soft_labels(durable(units(spark, d)))
    return rounded(u.select("id", "unit_no", "left_word", "right_word", "label_corrected_mean"), "label_corrected_mean")


def j5(spark, d):
    stats = A.group_statistics(A.memberships(scored_units(spark, d), ATTRS), ("mean", "sum", "count")).filter(
        F.col("scope") == A.ALL)
    left = stats.filter("grp = 'paired'").select("id", F.col("stats")[0].alias("mean_paired"))
    right = stats.filter("grp = 'unpaired'").select("id", F.col("stats")[0].alias("mean_unpaired"))
    return rounded(left.join(right, "id", "full_outer"), "mean_paired", "mean_unpaired")


def j6(spark, d):
    return rounded(prediction(spark, d).units.select("id", "unit_no", "pred", "token_contribution"), "token_contribution")


def j7(spark, d):
    found = E.look_up_vectors(entity_tokens(P.drop_non_ascii(parts(spark, d)), ATTRS), vocabulary(spark, d), VECTOR_SIZE, ["id", "pos"])
    return found.select("id", "pos", "word", r6(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))).alias("vec_sum"))


def coefficients(spark) -> DataFrame:
    return spark.createDataFrame(list(COEF.items()), "feature string, coef double")


def j8(spark, d):
    long = A.features_long(A.feature_vectors(scored_pairs(spark, d), ATTRS), NAMES)
    return rounded(long.join(F.broadcast(coefficients(spark)), "feature").groupBy("id").agg(
        F.sum(F.col("value") * F.col("coef")).alias("logit")), "logit")


def j9(spark, d):
    scores = prediction(spark, d, explain=False).scores
    some = scores.join(pairs(spark, d).filter("label = 1").select("id"), "id", "left_semi")
    return rounded(C.with_default_score(pairs(spark, d).select("id"), some), "match_score")


def j10(spark, d):
    toks = E.entity_vectors(P.drop_non_ascii(parts(spark, d)), ATTRS, vocabulary(spark, d), VECTOR_SIZE)
    joined = E.pairs_of_entities(part_links(spark, d), toks, toks)
    return joined.select("id", "label", F.array_join("l_toks.word", " ").alias("left_words"), F.array_join("r_toks.word", " ").alias("right_words"))


# ---- alignment ----------------------------------------------------------------------------------------

UNIT_VIEW = ["id", "unit_no", "pass_no", "left_pos", "right_pos", "left_word", "right_word", "cos_sim",
             "left_attribute", "right_attribute", "label"]


def m1(spark, d):
    return edges_long(with_edges(vector_tokens(spark, d), T.unpair, "cosine"))


def m2(spark, d):
    jw = edges_long(with_edges(tokens(spark, d), 0.8)).withColumn("kind", F.lit("jaro_winkler"))
    edit = edges_long(with_edges(tokens(spark, d), 0.5, edit_ratio)).withColumn("kind", F.lit("edit"))
    return jw.unionByName(edit)


def _view(df: DataFrame) -> DataFrame:
    return df.select(*UNIT_VIEW)


def m3(spark, d):
    matched = unit_rows(most_similar(with_edges(tokens(spark, d), T.unpair), T.unpair, None))
    return matched.filter((F.col("left_pos") >= 0) & (F.col("right_pos") >= 0)).select("id", "left_pos", "right_pos", "cos_sim")


def m3_preferences(spark, d):
    """Left words ask for the fewest edits, right words for the nearest length."""
    lists = preference_lists(tokens(spark, d), lambda x, y: F.levenshtein(x, y), lambda x, y: F.abs(F.length(x) - F.length(y)))
    return stable_pairs(lists)


def m4(spark, d):
    return unit_rows(most_similar(with_edges(tokens(spark, d), T.unpair), T.unpair, T.duplicate)).select(
        "id", "left_pos", "right_pos", "cos_sim")


def m5(spark, d):
    return unit_rows(above_threshold(with_edges(tokens(spark, d), 0.85), 0.85)).select("id", "left_pos", "right_pos", "cos_sim")


def m6(spark, d):
    return unit_rows(most_similar(with_edges(tokens(spark, d), T.unpair), T.unpair, T.duplicate)).select(
        "id", "left_word", "right_word", "cos_sim")


def m7(spark, d):
    return units(spark, d).filter("pass_no = 1").select(*[c for c in UNIT_VIEW if c != "unit_no"])


def m8(spark, d):
    low = Thresholds(unpair=0.9, cross=0.65)
    u = align_tokens(tokens(spark, d), low)
    return u.filter("pass_no = 2").select(*[c for c in UNIT_VIEW if c != "unit_no"])


def m9(spark, d):
    return units(spark, d).filter("pass_no >= 3").select(*[c for c in UNIT_VIEW if c != "unit_no"])


def m10(spark, d):
    return _view(units(spark, d))


def m10_documents(spark, d):
    return _view(align_tokens(document_tokens(spark, d)))


def m11(spark, d):
    return _view(align_tokens(tokens(spark, d), use_schema=False))


def m12(spark, d):
    return vector_units(spark, d).select(*UNIT_VIEW)


def m13(spark, d):
    return _view(align_units(P.drop_non_ascii(pairs(spark, d)).drop("label"), ATTRS, thresholds=Thresholds(0.7, 0.8, 0.9)))


def m14(spark, d):
    toks = vector_tokens(spark, d)
    u = align_tokens(toks, similarity="cosine")
    return N.attach_sentence(u.select("id", "unit_no"), N.sentence_means(toks, VECTOR_SIZE)).select(
        "id", "unit_no", r6(F.aggregate("sentence", F.lit(0.0), lambda s, x: s + x)).alias("sentence_sum"))


# ---- vectors and scores ----------------------------------------------------------------------------------

def hashed_encoder():
    """Stand-in for a language model: a vector per word from its characters and its place in the record."""
    def encode(records):
        out = []
        for words in records:
            m = np.zeros((len(words), 8))
            for i, w in enumerate(words):
                for j, ch in enumerate(w):
                    m[i, (ord(ch) + j) % 8] += 1.0
                m[i] += 0.01 * i
            out.append(m)
        return out

    return encode


def e1(spark, d):
    toks = E.encode_entities(P.drop_non_ascii(parts(spark, d)), ATTRS, hashed_encoder)
    return E.pairs_of_entities(part_links(spark, d), toks, toks).transform(
        lambda t: align_tokens(t, similarity="cosine")).select(*UNIT_VIEW)


def pieces(spark, d) -> DataFrame:
    """Words of each part cut after three letters, with the vectors of the vocabulary table by length."""
    words = entity_tokens(P.drop_non_ascii(parts(spark, d)), ATTRS)
    cut = words.select("id", "pos", F.array_compact(F.array(
        F.substring("word", 1, 3),
        F.when(F.length("word") > 3, F.concat(F.lit("##"), F.substring("word", 4, 100))))).alias("p"))
    rows = cut.select("id", "pos", F.posexplode("p").alias("i", "piece")).withColumn(
        "piece_no", F.col("pos") * 2 + F.col("i"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").alias("vec"))
    # a piece has at most 102 letters, so at most as many rows are broadcast; left to itself the optimizer may take the pieces
    vectors = F.broadcast(vectors.filter(F.col("n").between(1, 102)))
    return rows.withColumn("n", F.length("piece").cast("bigint")).join(vectors, "n").select("id", "piece_no", "piece", "vec")


def e2(spark, d):
    return E.pieces_to_words(pieces(spark, d)).select(
        "id", "pos", "word", r6(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)).alias("vec_sum"))


def piece_vocabulary(spark, d) -> DataFrame:
    """Letters, and half of the runs of two to four letters of the part table's words; vectors in turn from the embeddings."""
    words = entity_tokens(P.drop_non_ascii(parts(spark, d)), ATTRS).select("word").distinct()
    runs = words.select("word", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("n"), F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    runs = runs.filter(F.col("i") + F.col("n") - 1 <= F.length("word")).select(
        F.concat(F.when(F.col("i") > 1, "##").otherwise(""), F.substring("word", F.col("i"), F.col("n"))).alias("piece"), "n").distinct()
    kept = runs.filter((F.col("n") == 1) | (F.substring(F.md5(F.col("piece").cast("binary")), 1, 1) < "8"))
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    turn = F.conv(F.substring(F.md5(F.col("piece").cast("binary")), 1, 8), 16, 10).cast("bigint") % F.lit(vectors.count())
    return kept.select("piece", turn.alias("vec_id")).join(vectors, "vec_id").select("piece", "vec")


def e2_pieces(spark, d):
    words = entity_tokens(P.drop_non_ascii(parts(spark, d)), ATTRS).select("id", "pos", "word")
    return piece_word_vectors(words, piece_vocabulary(spark, d), VECTOR_SIZE).select(
        "id", "pos", "word", "n_pieces", r6(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)).alias("vec_sum"))


def e3(spark, d):
    words = P.drop_non_ascii(parts(spark, d)).select("id", F.split(F.concat_ws(" ", *ATTRS), " ").alias("words"))
    vocab = E.trained_vocabulary(words, 16)
    return align_tokens(E.attach_vectors(tokens(spark, d), vocab, 16), similarity="cosine").select(*UNIT_VIEW)


def e3_subwords(spark, d):
    """A vector for every word of parts and documents, from the n-grams of the words that have one."""
    part_words = entity_tokens(P.drop_non_ascii(parts(spark, d)), ATTRS).select("word")
    text_words = entity_tokens(P.drop_non_ascii(documents(spark, d), ["text"]), ["text"], "doc_id").select("word")
    found = subword_vectors(part_words.union(text_words).distinct(), bucket_table(vocabulary(spark, d)), VECTOR_SIZE)
    return found.select("word", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("vec_sum"))


def e4(spark, d):
    found = E.entity_vectors(P.drop_non_ascii(parts(spark, d)), ATTRS, vocabulary(spark, d), VECTOR_SIZE)
    return E.sentence_vectors(found, VECTOR_SIZE).select(
        "id", F.transform("sentence", lambda x: F.round(x, 6)).alias("s")).select(
        "id", F.col("s")[0].alias("first"), F.col("s")[63].alias("last"))


def n1(spark, d):
    u = vector_units(spark, d).withColumn("v", N.unit_vector())
    return u.select("id", "unit_no", r6(F.aggregate(F.slice("v", 1, 64), F.lit(0.0), lambda s, x: s + x)).alias("mean_sum"),
                    r6(F.aggregate(F.slice("v", 65, 64), F.lit(0.0), lambda s, x: s + x)).alias("diff_sum"))


def n2(spark, d):
    u = N.soft_labels(durable(vector_units(spark, d)), vectors=True)
    return rounded(u.select("id", "unit_no", "label_corrected", "label_corrected_mean"), "label_corrected_mean")


def labelled_units(spark, d) -> DataFrame:
    """Units with features and soft labels; ``copies`` of them are equal in words, vectors, label and fold."""
    u = vector_units(spark, d).withColumn("valid", F.pmod(F.col("id"), F.lit(5)) == 3)
    kinds = durable(N.distinct_units(u, ["left_word", "right_word", "left_vec", "right_vec", "cos_sim", "label", "valid"]))
    return N.soft_labels(kinds.withColumn("unit_features", N.unit_vector()), vectors=True, copies="copies")


def n3(spark, d):
    """Training of the relevance network, with the operator's epochs, patience and batches: loss and validation error of every epoch, and which one was kept."""
    u = labelled_units(spark, d)
    done = fit_network(u.filter("not valid"), u.filter("valid"), copies="copies")
    rows = [(e, loss, error, e == done.best_epoch) for e, loss, error in done.history]  # one row per epoch
    return spark.createDataFrame(rows, "epoch int, train_loss double, valid_error double, kept boolean")


def fixed_network() -> Network:
    """Two hidden units with weights by a rule, so that scores can be checked in SQL."""
    first = [[((i * 37 + k * 5) % 11 - 5) / 10 for k in range(2)] for i in range(2 * VECTOR_SIZE)]
    return Network((np.array(first), np.array([[0.7], [-0.4]])), (np.array([0.1, -0.2]), np.array([0.05])))


def n4(spark, d):
    packed = align_pairs(vector_tokens(spark, d), similarity="cosine", with_vectors=VECTOR_SIZE)
    return rounded(A.unit_table(packed_network_score(packed, fixed_network())).select("id", "unit_no", "pred"), "pred")


def n5(spark, d):
    return N.similarity_score(units(spark, d)).select("id", "unit_no", "pred")


def n6(spark, d):
    return N.binary_score(units(spark, d)).select("id", "unit_no", "pred")


def n7(spark, d):
    scaled = N.tanh_scaled(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 1.0, "scaled")
    return scaled.select("vec_id", r6(F.col("scaled")[0]).alias("first"), r6(F.col("scaled")[63]).alias("last"))


# ---- features -----------------------------------------------------------------------------------------------

def _long(df: DataFrame, names: list[str]) -> DataFrame:
    return A.features_long(df, names).withColumn("value", rounded_column(F.col("value"), 6))


def _all_features(spark, d, **options) -> DataFrame:
    return _long(A.feature_vectors(scored_pairs(spark, d), ATTRS, **options), NAMES)


def _scope_stats(spark, d, *groups: str, **options) -> DataFrame:
    stats = A.group_statistics(A.memberships(scored_units(spark, d), ATTRS, **options)).filter(
        (F.col("scope") == A.ALL) & F.col("grp").isin(*groups))
    return stats.select("id", "grp", *[r6(F.col("stats")[i]).alias(s.replace("-", "_")) for i, s in enumerate(A.STATS)])


def a1(spark, d):
    return _scope_stats(spark, d, "all")


def a2(spark, d):
    return _scope_stats(spark, d, "paired")


def a3(spark, d):
    plain = _scope_stats(spark, d, "unpaired").withColumn("complementary", F.lit(True))
    return plain.unionByName(_scope_stats(spark, d, "unpaired", complementary=False).withColumn("complementary", F.lit(False)))


def a4(spark, d):
    return _scope_stats(spark, d, "unpaired_exclusive", "unpaired_both")


def a5(spark, d):
    return _scope_stats(spark, d, "left", "right")


def a6(spark, d):
    return _all_features(spark, d).filter(F.col("feature").rlike("_unpaired_(min|max)_allattr$"))


def a7(spark, d):
    return _all_features(spark, d).filter(F.col("feature").rlike("_(perc|diff).*_allattr$"))


def a8(spark, d):
    return _all_features(spark, d).filter(~F.col("feature").endswith("_allattr"))


def a9(spark, d):
    return _all_features(spark, d).filter(F.col("feature").endswith("_allattr"))


def a10(spark, d):
    return _all_features(spark, d)


def a11(spark, d):
    m = A.minimal_features(scored_units(spark, d))
    return rounded(m, *[c for c in m.columns if c != "id"])


def a12(spark, d):
    names = A.feature_names(ATTRS, A.ADDITIVE_STATS, derived=False)
    return _long(A.feature_vectors(scored_pairs(spark, d), ATTRS, A.ADDITIVE_STATS, derived=False), names)


def a13(spark, d):
    u = units(spark, d).withColumn("label_corrected", N.corrected_label(F.col("cos_sim"), F.col("label")))
    return rounded(N.word_pair_means(u), "label", "cos_sim", "label_corrected")


def a14(spark, d):
    return rounded(W.label_shares(pairs(spark, d)), "share")


def a15(spark, d):
    scored = prediction(spark, d, explain=False).scores.join(pairs(spark, d).select("id", "label"), "id")
    return rounded(C.binary_metrics(scored.withColumn("split", split_of()), ["split"]), "precision", "recall", "f1")


def rescore(df: DataFrame) -> DataFrame:
    return predict(df, MODEL, ATTRS, explain=False, clean=False).scores


def impacts(spark, d) -> DataFrame:
    return stored(X.unit_impact(prediction(spark, d).units))


STEPS, ROUNDS = 5, 3  # perturbations of a pair by relevance, and random orders next to them


def results(spark, d, kind="AOPC", k=STEPS, rounds=ROUNDS) -> DataFrame:
    """Perturbation of every pair, scored again with the fixed model; store it where it is read more than once."""
    start = prediction(spark, d, explain=False).scores
    return X.evaluate_pairs(pairs(spark, d), tokens(spark, d), impacts(spark, d), start, ATTRS, rescore, k, rounds, kind, keeps_rows=True)


def a16(spark, d):
    return rounded(X.aopc(results(spark, d)), "aopc")


def a17(spark, d):
    return rounded(X.sufficiency(results(spark, d, "sufficiency")), "sufficiency")


def a18(spark, d):
    r = stored(results(spark, d))
    return rounded(X.delta_statistics(r).join(X.concordance(r), "comb_name"), "mean", "min", "max", "median", "concorde")


def a19(spark, d):
    u = units(spark, d)
    return u.agg(F.count_distinct("id").alias("n_ids"), F.count("*").alias("n_units"))


def a20(spark, d):
    return rounded(results(spark, d).select("id", "comb_name", "expected_delta", "error"), "expected_delta", "error")


def a21(spark, d):
    return rounded(X.conciseness(prediction(spark, d).units), "share")


# ---- windows -------------------------------------------------------------------------------------------------

def members(spark, d) -> DataFrame:
    return A.memberships(scored_units(spark, d), ATTRS)


def _shares(spark, d, stats: list[str], mode="proportional") -> DataFrame:
    sh = K.shares(scored_pairs(spark, d), stats, mode, ATTRS)
    return sh.select("id", "unit_no", "scope", "grp", *[rounded_column(F.col(f"sh_{i}"), 6).alias(s.replace("-", "_")) for i, s in enumerate(stats)],
                     *[c for c in sh.columns if c == "mode"])


def w1(spark, d):
    return _shares(spark, d, ["mean", "sum", "count"])


def w2(spark, d):
    return _shares(spark, d, ["min", "max", "median"])


def w3(spark, d):
    return _shares(spark, d, ["M-m"])


def w4(spark, d):
    return _shares(spark, d, ["min", "max", "median"], ("softmax", "index"))


def w5(spark, d):
    m = members(spark, d).withColumn("is_median", K.median_row("v", ["id", "scope", "grp"]))
    return m.filter("is_median").select("id", "scope", "grp", "unit_no")


def _contributions(spark, d, pattern: str) -> DataFrame:
    # values under the rounding are left out on both sides
    return K.contributions_long(scored_pairs(spark, d), ATTRS, features=[n for n in NAMES if re.search(pattern, n)], digits=6)


def w6(spark, d):
    return _contributions(spark, d, "_unpaired_(min|max)_allattr$")


def w7(spark, d):
    return _contributions(spark, d, "_diff")


def w8(spark, d):
    return _contributions(spark, d, "_perc")


def w9(spark, d):
    return _contributions(spark, d, ".")


def w10(spark, d):
    return rounded(prediction(spark, d).units.select("id", "unit_no", "left_word", "right_word", "token_contribution"), "token_contribution")


def w11(spark, d):
    return rounded(X.pareto_curve(prediction(spark, d).units, by_sign=True), "share")


def w12(spark, d):
    return W.stratified_sample(pairs(spark, d), 500, 0).select("id", "label")


# ---- order, limits, sets -----------------------------------------------------------------------------------------

def o1(spark, d):
    e = with_edges(tokens(spark, d), T.unpair)
    return e.select("id", F.posexplode_outer("edges").alias("rank", "e")).filter(F.col("rank").isNotNull()).select(
        "id", "rank", F.col("e.l").alias("l"), F.col("e.r").alias("r"))


def o2(spark, d):
    return pairs(spark, d).select("id", "label").orderBy("id")


def o3(spark, d):
    m = a15(spark, d).withColumn("model_name", F.col("split"))
    return C.best_model(m.withColumn("split", F.lit("valid"))).select("model_name", "f1")


def o4(spark, d):
    scores = prediction(spark, d, explain=False).scores.join(pairs(spark, d).select("id", "label"), "id")
    cuts = scores.select("label", "match_score", F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(9)), lambda i: i / 10)).alias("q"))
    hit = (F.col("match_score") > F.col("q")).cast("double")
    sweep = C.binary_metrics(cuts.withColumn("hit", hit), ["q"], score="hit")
    return rounded(C.best_cutoff(sweep), "best_f1")


def o5(spark, d):
    top = X.top_units(X.unit_impact(prediction(spark, d).units, "pred"), 5)
    return rounded(top.select("id", "rank", "unit_no", "impact"), "impact")


def u1(spark, d):
    u = units(spark, d)
    one = [u.filter(F.col("pass_no") == i).select("id", "left_word", "right_word", "pass_no") for i in (1, 2, 3, 4)]
    return one[0].unionByName(one[1]).unionByName(one[2]).unionByName(one[3])


def u2(spark, d):
    return units(spark, d).select("left_word", "right_word").distinct()


def u3(spark, d):
    long = tokens_long(tokens(spark, d))
    left = long.filter("side = 'left'").select("word").distinct()
    right = long.filter("side = 'right' and attr = 'name'").select("word").distinct()
    return left.join(right, "word", "left_anti")


# ---- matchers -------------------------------------------------------------------------------------------------------

def _fitted(spark, d, name: str, spec) -> DataFrame:
    rows = split_rows(spark, d)
    model = C.fit_candidate(name, spec, rows["train"], NAMES)
    return C.compare_models([model], rows)


def c1(spark, d):
    return _fitted(spark, d, "LR", "minmax")


def c2(spark, d):
    return _fitted(spark, d, "LR_std", "standard")


def c3(spark, d):
    return _fitted(spark, d, "LR_raw", "unscaled")


def c4(spark, d):
    rows = split_rows(spark, d)
    specs = {n: s for n, s in C.candidate_models().items() if n in ("CART", "NB", "SVM", "GBM", "RF")}
    return C.compare_models([C.fit_candidate(n, s, rows["train"], NAMES) for n, s in specs.items()], rows)


def c5(spark, d):
    return _fitted(spark, d, "LDA", "discriminant")


def c6(spark, d):
    return _fitted(spark, d, "dummy", "stratified")


def c7(spark, d):
    feats = A.feature_vectors(scored_pairs(spark, d), ATTRS)
    return rounded(MODEL.score(feats).select("id", "match_score"), "match_score")


def c8(spark, d):
    return rounded(explained_units(prediction(spark, d)).select(
        "id", "unit_no", "left_word", "right_word", "pred", "token_contribution", "match_score"), "token_contribution", "match_score")


def c8_documents(spark, d):
    names = A.feature_names(DOC_ATTRS)
    model = C.LinearMatcher.fixed(names, fixed_coefficients(names), INTERCEPT)
    scored = explained_units(predict(document_pairs(spark, d), model, DOC_ATTRS))
    return rounded(scored.select("id", "unit_no", "left_word", "right_word", "pred", "token_contribution", "match_score"), "token_contribution", "match_score")


def c9(spark, d):
    out = predict_from_units(N.binary_score(align_pairs(tokens(spark, d))), MODEL, ATTRS, explain=False)
    return rounded(out.scores, "match_score")


def c10(spark, d):
    rows = split_rows(spark, d)
    fitted = [C.fit_candidate(n, spec, rows["train"], NAMES) for n, spec in C.candidate_models().items()]
    metrics = durable(C.compare_models(fitted, rows))
    best = C.best_model(metrics).select("model_name", F.lit(True).alias("best"))
    return metrics.join(F.broadcast(best), "model_name", "left").fillna(False, ["best"])


def c11(spark, d):
    rows = split_rows(spark, d)
    return C.selection_table(rows["train"], rows["valid"], NAMES, sweep_models=C.EXTRA_TREES)


# ---- evaluation -----------------------------------------------------------------------------------------------------

def x1(spark, d):
    u = X.unit_impact(prediction(spark, d).units, "pred")
    return rounded(u.select("id", "unit_no", "impact"), "impact")


def x2(spark, d):
    return X.word_keys(tokens_long(tokens(spark, d))).select("id", "word_key", "word")


def x3(spark, d):
    u = impacts(spark, d)
    plan = X.perturbation_plan(u, STEPS, ROUNDS, packed=True)
    return X.perturb_pairs(tokens(spark, d), plan, u, ATTRS).select(
        "id", "comb_name", "left_brand", "left_name", "right_brand", "right_name")


def x4(spark, d):
    return rounded(results(spark, d), "start_pred", "new_pred", "expected_delta", "detected_delta", "error")


def x5(spark, d):
    return rounded(X.removal_performance(stored(results(spark, d))), "start_f1", "new_f1", "delta_f1")


def other_impacts(spark, d) -> DataFrame:
    """Word impacts of another explanation: the units' similarity."""
    tokens_ = X.units_to_tokens(N.similarity_score(units(spark, d)).withColumn("token_contribution", F.col("pred")))
    return tokens_.withColumn("impact", F.col("token_contribution"))


def x6(spark, d):
    ours = X.units_to_tokens(prediction(spark, d).units).withColumn("impact", F.col("token_contribution"))
    return rounded(X.explanation_correlation(ours, other_impacts(spark, d)), "correlation")


def x7(spark, d):
    return rounded(X.evaluation_tables(stored(results(spark, d)), impacts(spark, d), other_impacts(spark, d)), "value")


def all_queries() -> dict[str, Query]:
    found = {n[:1].upper() + n[1:]: f for n, f in globals().items()
             if re.fullmatch(r"[a-z]\d+(_(documents|pieces|preferences|stages|subwords))?", n) and callable(f) and n != "r6"}
    order = "SPFJMENAWOUCX"
    return dict(sorted(found.items(), key=lambda kv: (order.index(kv[0][0]), int(re.findall(r"\d+", kv[0])[0]), kv[0])))
