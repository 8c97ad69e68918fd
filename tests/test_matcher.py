import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from kinweave.operators import matcher as C

NAMES = ("a", "b", "c")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    x = np.column_stack([y * 2 + rng.normal(size=300), rng.normal(size=300) * 5, np.full(300, 4.0)])
    rows = [(i, [float(v) for v in x[i]], float(y[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label double").withColumn("vec", array_to_vector("features"))
    return x, y, df


@pytest.mark.parametrize("scaler", ["minmax", "standard", None])
def test_logistic_is_the_penalised_optimum(data, scaler):
    x, y, df = data
    m = C.fit_logistic(df, NAMES, scaler)
    lo, hi, sd = x.min(0), x.max(0), x.std(0)
    scale = {"minmax": hi - lo, "standard": sd, None: np.ones(3)}[scaler][:2]
    w, b = np.array(m.coef)[:2] * scale, m.intercept
    shift = {"minmax": lo, "standard": x.mean(0), None: np.zeros(3)}[scaler][:2]
    z = (x[:, :2] - shift) / scale
    b = b + (np.array(m.coef)[:2] * shift).sum()
    p = 1 / (1 + np.exp(-(z @ w + b)))
    assert m.coef[2] == 0.0
    assert np.abs(z.T @ (p - y) + w).max() < 0.05 and abs((p - y).sum()) < 0.05


def test_discriminant_equals_closed_form(data):
    x, y, df = data
    m = C.fit_discriminant(df, NAMES)
    m0, m1 = x[y == 0].mean(0), x[y == 1].mean(0)
    within = sum((x[y == c] - mu).T @ (x[y == c] - mu) for c, mu in ((0, m0), (1, m1))) / len(x)
    assert np.allclose(m.coef, np.linalg.pinv(within, rcond=1e-8, hermitian=True) @ (m1 - m0), atol=1e-6)


def test_metrics_and_default(spark):
    df = spark.createDataFrame([("x", 1, 0.9), ("x", 1, 0.2), ("x", 0, 0.8), ("y", 0, 0.1)], "g string, label int, match_score double")
    got = {r.g: (r.precision, r.recall, r.f1) for r in C.binary_metrics(df, ["g"]).collect()}
    assert got == {"x": (0.5, 0.5, 0.5), "y": (0.0, 0.0, 0.0)}


def test_models_save_load_and_choice(spark, data, tmp_path):
    _, _, df = data
    m = C.fit_logistic(df, NAMES)
    m.save(spark, str(tmp_path / "m"))
    assert C.LinearMatcher.load(spark, str(tmp_path / "m")) == m
    specs = C.candidate_models()
    fitted = [C.fit_candidate(n, specs[n], df, NAMES) for n in ("LR", "LDA", "CART", "NB", "SVM", "dummy")]
    metrics = C.compare_models(fitted, {"train": df, "valid": df}).cache()
    f1 = {r.model_name: r.f1 for r in metrics.filter("split = 'valid'").collect()}
    assert f1["LR"] > 0.8 and f1["CART"] >= f1["LDA"] > f1["dummy"]
    assert C.best_model(metrics).first().model_name == max(f1, key=lambda k: (f1[k], [-ord(c) for c in k]))


def test_cutoff_takes_the_last_best(spark):
    df = spark.createDataFrame([(0.1, 0.5), (0.2, 0.7), (0.3, 0.7), (0.4, 0.6)], "q double, f1 double")
    assert C.best_cutoff(df).first().best_q == 0.3


def test_importance_finds_the_useful_feature(spark, data):
    _, _, df = data
    imp = C.feature_importance(df, df, NAMES).cache()
    got = {r.feature: r.score for r in imp.collect()}
    assert got["a"] > 0.1 and abs(got["c"]) < 0.05 and got["a"] > got["b"]
    from pyspark.ml.classification import RandomForestClassifier

    forest = RandomForestClassifier(numTrees=5, maxDepth=3, seed=0, featuresCol="vec", labelCol="label")
    sweep, kept = C.select_features(df, df, NAMES, imp, forest)
    assert "a" in kept and len(sweep) == len(set(got.values()))


def test_moments_do_not_cancel(spark):
    """Values far from zero, over many partitions."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)) * [1, 1e-3, 5, 1] + [1e7, 1e4, -1e6, 0]
    y = rng.integers(0, 2, 400)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], float(y[i])) for i in range(400)], "id long, features array<double>, label double")
    m = C.class_moments(df.repartition(13))
    within = sum((x[y == c] - x[y == c].mean(0)).T @ (x[y == c] - x[y == c].mean(0)) for c in (0, 1)) / 400
    assert np.allclose(m.counts, [(y == 0).sum(), (y == 1).sum()]) and np.allclose(m.means[1], x[y == 1].mean(0), rtol=1e-12)
    scale = np.sqrt(np.outer(np.diag(within), np.diag(within)))
    assert np.abs((m.within - within) / scale).max() < 1e-6
    with pytest.raises(ValueError, match="class 1"):
        C.class_moments(df.filter("label = 0"))


def plain_model(x, y, keep):
    """Discriminant on some features, from scratch."""
    means = [x[y == c][:, keep].mean(0) for c in (0, 1)]
    within = sum((x[y == c][:, keep] - means[c]).T @ (x[y == c][:, keep] - means[c]) for c in (0, 1)) / len(x)
    sd = np.sqrt(np.diag(within))
    w = np.linalg.solve(within / np.outer(sd, sd) + 1e-6 * np.eye(len(keep)), (means[1] - means[0]) / sd) / sd
    return w, -0.5 * (means[0] + means[1]) @ w + np.log((y == 1).sum() / (y == 0).sum())


def f1(y, hit):
    tp = (hit & (y == 1)).sum()
    return 2 * tp / max(2 * tp + (hit & (y == 0)).sum() + (~hit & (y == 1)).sum(), 1)


def test_selection_equals_refits_from_scratch(spark):
    rng = np.random.default_rng(5)
    n, d = 600, 7
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, d)) + np.outer(y, [1.5, 0.8, 0, 0.3, 0, 0, 0])
    x[:, 5] = x[:, 0] - x[:, 1]  # depends on others
    names = [f"f{i}" for i in range(d)]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], float(y[i])) for i in range(n)], "id long, features array<double>, label double")
    train, test = df.filter("id < 400"), df.filter("id >= 400")
    xt, yt, xv, yv = x[:400], y[:400], x[400:], y[400:]
    models = C.SubsetDiscriminants(C.class_moments(train))
    w, b = models.without_each()
    for j in range(d):
        keep = [i for i in range(d) if i != j]
        want, shift = plain_model(xt, yt, keep)
        assert np.allclose(xv @ w[:, j] + b[j], xv[:, keep] @ want + shift, atol=1e-6), j
    got = {r.feature: r for r in C.selection_table(train, test, names).collect()}
    folds = {r.id: r.fold for r in C.stratified_folds(test).collect()}
    fold = np.array([folds[i] for i in range(400, n)])
    full, shift = plain_model(xt, yt, list(range(d)))
    base = f1(yv, xv @ full + shift > 0)
    for j, name in enumerate(names):
        keep = [i for i in range(d) if i != j]
        want, shift = plain_model(xt, yt, keep)
        hit = xv[:, keep] @ want + shift > 0
        assert abs(got[name].drop_importance - (base - np.mean([f1(yv[fold == f], hit[fold == f]) for f in range(10)]))) < 1e-9
    best = max(r.cutoff_f1 for r in got.values())
    last = max(r.score for r in got.values() if r.cutoff_f1 == best)
    for r in got.values():
        keep = [i for i, f in enumerate(names) if got[f].score >= r.score]
        want, shift = plain_model(xt, yt, keep)
        assert abs(r.cutoff_f1 - f1(yv, xv[:, keep] @ want + shift > 0)) < 1e-9
        assert r.chosen == (r.score >= last)
    kept = C.chosen_features(train, test, names)
    assert set(kept) <= set(names) and "f0" in kept


def test_bad_scores_are_not_hidden(spark):
    from kinweave.operators.matcher import LinearMatcher, with_default_score

    pairs = spark.range(4).select("id")
    scores = spark.createDataFrame([(0, 0.9), (1, None), (2, float("nan"))], "id long, match_score double")
    got = {r.id: r.match_score for r in with_default_score(pairs, scores).collect()}
    assert got[0] == 0.9 and got[1] is None and got[2] != got[2] and got[3] == 0.5
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id long, features array<double>")
    with pytest.raises(Exception, match="the model has 2 features, a row has 3"):
        LinearMatcher(("a", "b"), (1.0, 1.0), 0.0).score(rows).collect()


def test_feature_vectors_are_not_broadcast_to_their_labels(spark):
    vectors = spark.range(50).select("id", F.array(F.col("id").cast("double"), F.lit(2.0)).alias("features"))
    labels = spark.range(40).select("id", (F.col("id") % 2).cast("int").alias("label"))
    rows = C.training_rows(vectors, labels)
    kept = C.kept_rows(rows)
    got = {r.id: (r.features, r.label, list(r.vec)) for r in kept.collect()}
    assert got == {i: ([float(i), 2.0], float(i % 2), [float(i), 2.0]) for i in range(40)}
    assert "ShuffledHashJoin" in rows._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [fold" in C._permuted(kept.withColumn("fold", (F.col("id") % 2).cast("int")), 0)._jdf.queryExecution().sparkPlan().toString()
