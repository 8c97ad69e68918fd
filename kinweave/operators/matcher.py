"""Match classifiers on feature vectors.

Fits run as Spark ML jobs; what reaches the driver has the size of the
model (coefficients, means, covariances), never the size of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import MinMaxScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.vectors import dot, sigmoid
from kinweave.operators.extra_trees import sweep_f1
from kinweave.operators.scale import durable, hash_rank, stored

DEFAULT_SCORE = 0.5


# ---- linear models in the space of unscaled features ---------------------------------------------

@dataclass(frozen=True)
class LinearMatcher:
    """Coefficients on unscaled features; any scaler used in the fit is folded in."""

    names: tuple[str, ...]
    coef: tuple[float, ...]
    intercept: float

    def logit(self, features: str | Column = "features") -> Column:
        col = F.col(features) if isinstance(features, str) else features
        wide = F.raise_error(F.concat(F.lit(f"the model has {len(self.coef)} features, a row has "), F.size(col).cast("string")))
        col = F.when(F.size(col) == len(self.coef), col).when(col.isNotNull(), wide)
        return dot(col, F.lit([float(c) for c in self.coef])) + F.lit(float(self.intercept))

    def score(self, vectors: DataFrame) -> DataFrame:
        return vectors.withColumn("match_score", sigmoid(self.logit()))

    def as_map(self) -> dict[str, float]:
        return dict(zip(self.names, self.coef))

    def save(self, spark, path: str) -> None:
        rows = [("", float(self.intercept), -1)] + [(n, float(c), i) for i, (n, c) in enumerate(zip(self.names, self.coef))]
        spark.createDataFrame(rows, "feature string, coef double, pos int").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> LinearMatcher:
        rows = spark.read.parquet(path).orderBy("pos").collect()  # as many rows as the model has features
        return LinearMatcher(tuple(r.feature for r in rows[1:]), tuple(r.coef for r in rows[1:]), rows[0].coef)

    @staticmethod
    def fixed(names: Sequence[str], coef: Mapping[str, float], intercept: float) -> LinearMatcher:
        return LinearMatcher(tuple(names), tuple(float(coef.get(n, 0.0)) for n in names), float(intercept))


def _summary(df: DataFrame, *metrics: str):
    return df.select(Summarizer.metrics(*metrics).summary(F.col("vec")).alias("s")).select(
        *[F.col(f"s.{m}").alias(m) for m in metrics]).first()


def training_rows(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """``id, vec, features, label`` for the ML estimators.

    The hint keeps the vectors out of a broadcast: their estimated size counts one number per array.
    """
    known = labels.select("id", F.col("label").cast("double").alias("label")).hint("shuffle_hash")
    return vectors.join(known, "id").withColumn("vec", array_to_vector(F.col("features")))


def kept_rows(rows: DataFrame) -> DataFrame:
    """Training rows in the shared folder, for fits that read them many times; ``vec`` is made from ``features`` when read."""
    return stored(rows.drop("vec")).withColumn("vec", array_to_vector(F.col("features")))


def fit_logistic(rows: DataFrame, names: Sequence[str], scaler: str | None = "minmax", max_iter: int = 200) -> LinearMatcher:
    """L2 logistic regression; ``scaler`` is ``minmax``, ``standard`` or None.

    The penalty of strength 1 on the summed loss is ``1/n`` on the mean
    loss.  A constant feature is left out.
    """
    stats = _summary(rows, "count", "min", "max", "mean", "variance")
    n = stats["count"]
    low, high, mean = (np.array(stats[m]) for m in ("min", "max", "mean"))
    if scaler == "minmax":
        shift, scale = low, high - low
    elif scaler == "standard":
        shift, scale = mean, np.sqrt(np.array(stats["variance"]) * (n - 1) / n)
    else:
        shift, scale = np.zeros(len(low)), np.ones(len(low))
    varies = high > low
    inverse = np.where(varies, 1.0 / np.where(varies, scale, 1.0), 0.0)
    scaled = F.zip_with(
        F.zip_with("features", F.lit([float(x) for x in shift]), lambda x, m: x - m),
        F.lit([float(x) for x in inverse]), lambda x, i: x * i)
    data = rows.select(array_to_vector(scaled).alias("vec"), "label")
    model = LogisticRegression(featuresCol="vec", maxIter=max_iter, regParam=1.0 / n, standardization=False).fit(data)
    coef = model.coefficients.toArray() * inverse
    return LinearMatcher(tuple(names), tuple(coef), float(model.intercept - (coef * shift).sum()))


@dataclass(frozen=True)
class ClassMoments:
    """Class counts, class means and the pooled within-class covariance."""

    counts: np.ndarray
    means: np.ndarray
    within: np.ndarray

    def discriminant(self, keep: np.ndarray) -> tuple[np.ndarray, float]:
        m0, m1 = self.means[:, keep]
        w = np.linalg.pinv(self.within[np.ix_(keep, keep)], rcond=1e-8, hermitian=True) @ (m1 - m0)
        return w, float(-0.5 * (m1 + m0) @ w + np.log(self.counts[1] / self.counts[0]))

    def intercepts(self, weights: np.ndarray) -> np.ndarray:
        """Intercept of every column of ``features x models``."""
        return -0.5 * self.means.sum(axis=0) @ weights + np.log(self.counts[1] / self.counts[0])


def _merged(n: np.ndarray, means: np.ndarray, scatters: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, mean and centred cross products of several parts together; nothing is subtracted that nearly cancels."""
    total = n.sum()
    mean = (n[:, None] * means).sum(axis=0) / max(total, 1)
    off = (means - mean) * np.sqrt(n)[:, None]
    return total, mean, scatters.sum(axis=0) + off.T @ off


def _part(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, mean, scatter = row
    mean = np.frombuffer(mean)
    return n, mean, np.frombuffer(scatter).reshape(len(mean), len(mean))


MOMENTS = "label double, part int, n double, mean binary, scatter binary"
MERGE_GROUPS = 8  # groups of task results that are merged in Spark before the driver's


def class_moments(rows: DataFrame) -> ClassMoments:
    """One pass: every task sums the centred cross products of each class, and parts are merged pairwise stably.

    What leaves a task, and what reaches the driver, has the size of the model squared.
    """
    def packed(label: float, part: int, found: tuple) -> tuple:
        n, mean, scatter = found
        return label, part, float(n), mean.tobytes(), scatter.tobytes()

    def table(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.float64(), pa.int32(), pa.float64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)],
                                          names=["label", "part", "n", "mean", "scatter"])

    def run(batches):
        held = {}
        part = TaskContext.get().partitionId() % MERGE_GROUPS
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            x = values.reshape(len(label), -1) if len(label) else np.zeros((0, 0))
            for c in np.unique(label):
                mine = x[label == c]
                mean = mine.mean(axis=0)
                found = (float(len(mine)), mean, (mine - mean).T @ (mine - mean))
                held[c] = found if c not in held else _merged(*(np.stack(y) for y in zip(held[c], found, strict=True)))
        if held:
            yield table([packed(float(c), part, f) for c, f in held.items()])

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        parts = [_part(r) for r in zip(*(group.column(c).to_pylist() for c in ("n", "mean", "scatter")), strict=True)]
        found = _merged(*(np.stack([np.asarray(p[i]) for p in parts]) for i in range(3)))
        return pa.Table.from_batches([table([packed(key[0].as_py(), key[1].as_py(), found)])])

    merged = rows.select("features", "label").mapInArrow(run, MOMENTS).groupBy("label", "part").applyInArrow(merge, MOMENTS)
    got = merged.collect()  # at most MERGE_GROUPS rows a class
    classes = []
    for c in (0.0, 1.0):
        parts = [_part((r.n, r.mean, r.scatter)) for r in got if r.label == c]
        if not parts:
            raise ValueError(f"no rows of class {c:g}")
        classes.append(_merged(*(np.stack([np.asarray(p[i]) for p in parts]) for i in range(3))))
    counts = np.array([n for n, _, _ in classes])
    return ClassMoments(counts, np.stack([m for _, m, _ in classes]), sum(s for _, _, s in classes) / counts.sum())


@dataclass
class SubsetDiscriminants:
    """Linear discriminants on subsets of features from one matrix.

    Features are brought to unit deviation inside the classes; a little on the
    diagonal (``RIDGE``) makes the matrix invertible when features depend on
    each other.  Leaving a feature out is a rank-one downdate of the inverse.
    A feature that is constant inside the classes is in no model.
    """

    RIDGE = 1e-6
    moments: ClassMoments

    def __post_init__(self):
        m = self.moments
        sd = np.sqrt(np.diag(m.within))
        self.varies = sd > 1e-12 * np.maximum(1.0, np.abs(m.means).max(axis=0))
        self.scale = np.where(self.varies, 1.0 / np.where(self.varies, sd, 1.0), 0.0)
        corr = m.within * np.outer(self.scale, self.scale)
        np.fill_diagonal(corr, 1.0)
        self.inverse = np.linalg.inv(corr + self.RIDGE * np.eye(len(sd)))
        self.gap = (m.means[1] - m.means[0]) * self.scale

    def full(self) -> tuple[np.ndarray, np.ndarray]:
        w = (self.inverse @ self.gap * self.scale)[:, None]
        return w, self.moments.intercepts(w)

    def without_each(self) -> tuple[np.ndarray, np.ndarray]:
        """Column ``j`` is the model without feature ``j``."""
        w = self.inverse @ self.gap
        out = (w[:, None] - self.inverse * (w / np.diag(self.inverse))) * self.scale[:, None]
        np.fill_diagonal(out, 0.0)
        return out, self.moments.intercepts(out)

    def nested(self, order: np.ndarray, sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """Models after the first ``sizes[k]`` features of ``order`` are gone."""
        inverse, gone, out = self.inverse.copy(), np.zeros(len(self.gap), bool), []
        done = 0
        for size in sizes:
            for j in order[done:size]:
                inverse -= np.outer(inverse[:, j], inverse[j]) / inverse[j, j]
                gone[j] = True
                inverse[j], inverse[:, j] = 0.0, 0.0
            done = size
            out.append(np.where(gone, 0.0, inverse @ np.where(gone, 0.0, self.gap) * self.scale))
        w = np.stack(out, axis=1)
        return w, self.moments.intercepts(w)


def fit_discriminant(rows: DataFrame, names: Sequence[str]) -> LinearMatcher:
    """Linear discriminant in closed form; scaling the features first gives the same scores."""
    w, b = class_moments(rows).discriminant(np.arange(len(names)))
    return LinearMatcher(tuple(names), tuple(w), b)


# ---- other candidates ------------------------------------------------------------------------------

@dataclass
class FittedModel:
    """A fitted candidate with one way to predict: adds ``match_score``.

    ``picked`` are the places of the features that a Spark model was fitted on, if not all.
    """

    name: str
    model: object
    linear: LinearMatcher | None = None
    picked: tuple[int, ...] | None = None

    def score(self, vectors: DataFrame) -> DataFrame:
        if self.linear is not None:
            return self.linear.score(vectors)
        if isinstance(self.model, StratifiedDraw):
            return self.model.score(vectors)
        features = F.col("features") if self.picked is None else picked_features(self.picked)
        out = self.model.transform(vectors.withColumn("vec", array_to_vector(features)))
        if "probability" in out.columns:
            score = vector_to_array("probability")[1]
        else:
            score = sigmoid(vector_to_array("rawPrediction")[1])
        return out.withColumn("match_score", score).select(*vectors.columns, "match_score")


def picked_features(at: Sequence[int]) -> Column:
    return F.transform(F.lit([int(i) for i in at]), lambda i: F.get("features", i))


def on_all_features(model: FittedModel, kept: Sequence[str], names: Sequence[str]) -> FittedModel:
    """A model that was fitted on ``kept`` features, for vectors of all ``names``."""
    if model.linear is not None:
        linear = LinearMatcher.fixed(names, model.linear.as_map(), model.linear.intercept)
        return FittedModel(model.name, linear, linear)
    return FittedModel(model.name, model.model, None, tuple(list(names).index(f) for f in kept))


@dataclass(frozen=True)
class StratifiedDraw:
    """Baseline that predicts a match as often as the training labels do."""

    share: float
    seed: int = 0

    def score(self, vectors: DataFrame) -> DataFrame:
        u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(self.seed)), F.col("id").cast("string"))), 1, 8), 16, 10)
        return vectors.withColumn(
            "match_score", F.when(u.cast("double") / 4294967296.0 < self.share, 1.0).otherwise(0.0))


def candidate_models(seed: int = 0) -> dict[str, object]:
    """Names of the candidates with the estimator each one fits."""
    common = {"featuresCol": "vec", "labelCol": "label"}
    # fixed values: iterations, trees and depths as the original's candidates have them by default; trees grow as deep as Spark lets them
    return {
        "LR": "minmax", "LR_std": "standard", "LDA": "discriminant",
        "CART": DecisionTreeClassifier(maxDepth=30, seed=seed, **common),
        "NB": NaiveBayes(modelType="gaussian", **common),
        "SVM": Scaled(LinearSVC(maxIter=100, regParam=1e-3, **common)),
        "GBM": GBTClassifier(maxIter=100, maxDepth=3, seed=seed, **common),
        "RF": RandomForestClassifier(numTrees=100, maxDepth=30, seed=seed, **common),
        "dummy": "stratified",
    }


@dataclass
class Scaled:
    """An estimator on min-max scaled features."""

    estimator: object

    def fit(self, rows: DataFrame):
        return Pipeline(stages=[
            MinMaxScaler(inputCol="vec", outputCol="_scaled"), self.estimator.copy({self.estimator.featuresCol: "_scaled"})]).fit(rows)


def fit_candidate(name: str, spec, rows: DataFrame, names: Sequence[str]) -> FittedModel:
    if spec in ("minmax", "standard"):
        m = fit_logistic(rows, names, spec)
        return FittedModel(name, m, m)
    if spec == "unscaled":
        m = fit_logistic(rows, names, None)
        return FittedModel(name, m, m)
    if spec == "discriminant":
        m = fit_discriminant(rows, names)
        return FittedModel(name, m, m)
    if spec == "stratified":
        return FittedModel(name, StratifiedDraw(float(rows.agg(F.avg("label")).first()[0])))
    return FittedModel(name, spec.fit(rows))


# ---- scores, metrics, model choice --------------------------------------------------------------

def with_default_score(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Every pair with its score; a pair without units scores 0.5, and a score that is null or NaN stays so."""
    scored = scores.select("id", "match_score", F.lit(True).alias("_scored"))
    score = F.when(F.col("_scored").isNull(), F.lit(DEFAULT_SCORE)).otherwise(F.col("match_score"))
    return pairs.join(scored, "id", "left").withColumn("match_score", score).drop("_scored")


def binary_metrics(scored: DataFrame, by: Sequence[str], label: str = "label", score: str = "match_score",
                   cut: float = 0.5) -> DataFrame:
    """Precision, recall and F1 per group from exact counts; 0 where undefined."""
    hit = (F.col(score) > cut).cast("int")
    y = (F.col(label) > 0.5).cast("int")
    counts = scored.groupBy(*by).agg(
        F.sum(hit * y).alias("tp"), F.sum(hit * (1 - y)).alias("fp"), F.sum((1 - hit) * y).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *by, "tp", "fp", "fn",
        F.coalesce(tp / F.nullif(tp + fp, F.lit(0)), F.lit(0.0)).alias("precision"),
        F.coalesce(tp / F.nullif(tp + fn, F.lit(0)), F.lit(0.0)).alias("recall"),
        F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0)).alias("f1"),
    )


def compare_models(fitted: Sequence[FittedModel], splits: Mapping[str, DataFrame]) -> DataFrame:
    """Metrics per model and split; ``splits`` holds ``id, features, label``."""
    scored = None
    for split, rows in splits.items():
        base = rows.select("id", "features", "label")
        for m in fitted:
            part = m.score(base).select(F.lit(m.name).alias("model_name"), F.lit(split).alias("split"), "label", "match_score")
            scored = part if scored is None else scored.unionByName(part)
    return binary_metrics(scored, ["model_name", "split"])


def best_model(metrics: DataFrame, split: str = "valid") -> DataFrame:
    return metrics.filter(F.col("split") == split).orderBy(F.desc("f1"), "model_name").limit(1)


def best_cutoff(sweep: DataFrame, q: str = "q", f1: str = "f1") -> DataFrame:
    """The largest cutoff among those with the highest F1."""
    return sweep.agg(F.max_by(q, F.struct(f1, q)).alias("best_q"), F.max(f1).alias("best_f1"))


# ---- feature importance ---------------------------------------------------------------------------

def stratified_folds(rows: DataFrame, folds: int = 10, seed: int = 0) -> DataFrame:
    """Fold number per row, balanced inside each label."""
    return hash_rank(rows, ["label"], "id", seed, "_rank").withColumn(
        "fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")


def _permuted(rows: DataFrame, seed: int) -> DataFrame:
    """Every row with the features of another row of its fold (``donor``)."""
    first = hash_rank(rows, ["fold"], "id", seed + 1, "_at")
    second = hash_rank(rows.select("id", "fold", "features"), ["fold"], "id", seed + 2, "_at")
    donors = second.select("fold", "_at", F.col("features").alias("donor")).hint("merge")  # vectors are no table to broadcast
    return first.join(donors, ["fold", "_at"]).drop("_at")


COUNTS = "model int, fold int, tp long, fp long, fn long"


def _fold_counts(rows: DataFrame, models: int, hits: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """True and false positives and false negatives per model and fold, counted inside the tasks.

    ``hits`` gives ``rows x models`` booleans for a batch that has ``label`` and ``fold``.
    """
    def run(batches):
        held = {}
        for batch in batches:
            hit, y = hits(batch), batch.column("label").to_numpy(zero_copy_only=False) > 0.5
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for f in np.unique(fold):
                at = fold == f
                h, t = hit[at], y[at]
                tp = h[t].sum(axis=0)
                held[f] = held.get(f, 0) + np.stack([tp, h[~t].sum(axis=0), t.sum() - tp])
        for f, c in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(models, dtype=np.int32)), pa.array(np.full(models, f, np.int32)), *(pa.array(x.astype(np.int64)) for x in c)],
                names=["model", "fold", "tp", "fp", "fn"])

    counted = rows.mapInArrow(run, COUNTS).groupBy("model", "fold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    return counted.select("model", "fold", f1.alias("f1"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def feature_importance(train: DataFrame, test: DataFrame, names: Sequence[str], folds: int = 10, seed: int = 0,
                       models: SubsetDiscriminants | None = None) -> DataFrame:
    """``feature, drop_importance, score``: F1 lost when a feature is dropped or permuted, mean over stratified folds.

    All models without one feature come from one pass over the training rows
    and one inverse; all predictions are made and counted in one pass over
    the test rows.
    """
    n = len(names)
    models = models or SubsetDiscriminants(class_moments(train))
    (w, b), (drop_w, drop_b) = models.full(), models.without_each()

    def hits(batch: pa.RecordBatch) -> np.ndarray:
        x, d = _matrix(batch.column("features")), _matrix(batch.column("donor"))
        base = x @ w[:, 0] + b[0]
        return np.concatenate([x @ drop_w + drop_b > 0, base[:, None] + (d - x) * w[:, 0] > 0, base[:, None] > 0], axis=1)

    rows = _permuted(stratified_folds(test, folds, seed), seed).select("label", "fold", "features", "donor")
    per_fold = _fold_counts(rows, 2 * n + 1, hits)
    base_f1 = binary_metrics(LinearMatcher(tuple(names), tuple(w[:, 0]), float(b[0])).score(test).withColumn("all", F.lit(1)), ["all"])
    mean = per_fold.filter(F.col("model") < 2 * n).groupBy((F.col("model") % n).alias("j")).agg(
        F.avg(F.when(F.col("model") < n, F.col("f1"))).alias("_drop"), F.avg(F.when(F.col("model") >= n, F.col("f1"))).alias("_perm"))
    # the base score is one row
    one = mean.withColumn("all", F.lit(1)).join(F.broadcast(base_f1.select("all", F.col("f1").alias("base_f1"))), "all")
    feature = F.element_at(F.lit(list(names)), F.col("j").cast("int") + 1)
    return one.select(feature.alias("feature"), (F.col("base_f1") - F.col("_drop")).alias("drop_importance"),
                      (F.col("base_f1") - F.col("_perm")).alias("score"))


EXTRA_TREES = "extra_trees"  # the original's models of the sweep


def cutoff_sweep(train: DataFrame, test: DataFrame, names: Sequence[str], score: Mapping[str, float],
                 models: SubsetDiscriminants | str | None = None, seed: int = 0) -> list[tuple[float, float]]:
    """``cutoff, F1`` of the model on the features at or above every distinct score.

    With ``models=EXTRA_TREES`` the models are extra trees, fitted anew at every
    cutoff.  Else they are nested discriminants, so each is a few downdates from
    the one before; one pass over the test rows counts them all.
    """
    values = np.array([score[f] for f in names])
    cutoffs = np.unique(values)
    if isinstance(models, str) and models == EXTRA_TREES:
        found = sweep_f1(train, test, [np.flatnonzero(values >= q) for q in cutoffs], seed)
        return [(float(q), f) for q, f in zip(cutoffs, found, strict=True)]
    models = models or SubsetDiscriminants(class_moments(train))
    w, b = models.nested(np.argsort(values, kind="stable"), [int((values < q).sum()) for q in cutoffs])
    rows = test.select("label", F.lit(0).alias("fold"), "features")
    counted = _fold_counts(rows, len(cutoffs), lambda batch: _matrix(batch.column("features")) @ w + b > 0)
    f1 = {r.model: r.f1 for r in counted.select("model", "f1").collect()}  # one row per cutoff
    return [(float(q), f1[i]) for i, q in enumerate(cutoffs)]


def _best_of(sweep: Sequence[tuple[float, float]]) -> float:
    """The last cutoff with the best F1."""
    top = max(f for _, f in sweep)
    return max(q for q, f in sweep if f == top)


def selection_table(train: DataFrame, test: DataFrame, names: Sequence[str], folds: int = 10, seed: int = 0, sweep_models: str | None = None) -> DataFrame:
    """``feature, drop_importance, score, cutoff_f1, chosen``: importances, the F1 of the model that keeps features from
    this one's score up, and whether the best cutoff keeps the feature.  ``sweep_models`` as ``models`` of ``cutoff_sweep``."""
    spark = train.sparkSession
    models = SubsetDiscriminants(class_moments(train))
    importance = durable(feature_importance(train, test, names, folds, seed, models))
    score = {r.feature: r.score for r in importance.select("feature", "score").collect()}  # one row per feature
    sweep = cutoff_sweep(train, test, names, score, sweep_models or models, seed)
    cuts = spark.createDataFrame(sweep, "score double, cutoff_f1 double")
    # as many rows as distinct importances
    return importance.join(F.broadcast(cuts), "score").select(
        "feature", "drop_importance", "score", "cutoff_f1", (F.col("score") >= F.lit(_best_of(sweep))).alias("chosen"))


def select_features(
    train: DataFrame, test: DataFrame, names: Sequence[str], importance: DataFrame, estimator=None,
) -> tuple[list[tuple[float, float]], list[str]]:
    """Cutoff sweep over the importances and the features that its last best cutoff keeps.

    Without an ``estimator`` the models are discriminants, all from one pass;
    a Spark ML estimator is fitted once per cutoff.
    """
    score = {r.feature: r.score for r in importance.select("feature", "score").collect()}  # one row per feature
    if estimator is None:
        sweep = cutoff_sweep(train, test, names, score)
    else:
        sweep = []
        for q in sorted(set(score.values())):
            kept = [i for i, f in enumerate(names) if score[f] >= q]
            pick = picked_features(kept)
            fitted = FittedModel("sweep", estimator.fit(train.select("label", array_to_vector(pick).alias("vec"))))
            scored = fitted.score(test.select("label", pick.alias("features")))
            sweep.append((q, binary_metrics(scored.withColumn("all", F.lit(1)), ["all"]).first()["f1"]))
    best = _best_of(sweep)
    return sweep, [f for f in names if score[f] >= best]


def chosen_features(train: DataFrame, test: DataFrame, names: Sequence[str], rounds: int = 3) -> list[str]:
    """Select again among the features kept, until none goes or ``rounds`` are over."""
    kept = list(names)
    for _ in range(rounds):
        pick = picked_features([list(names).index(f) for f in kept]).alias("features")
        part = [durable(df.select("id", "label", pick)) for df in (train, test)]
        importance = feature_importance(*part, kept)
        _, found = select_features(*part, kept, importance)
        if len(found) == len(kept):
            break
        kept = found
    return kept


def save_names(spark, names: Sequence[str], path: str) -> None:
    spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, feature string").coalesce(1).write.mode(
        "overwrite").parquet(path)


def load_names(spark, path: str) -> list[str]:
    return [r.feature for r in spark.read.parquet(path).orderBy("pos").collect()]  # one row per feature
