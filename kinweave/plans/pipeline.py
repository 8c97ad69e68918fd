"""Fit and predict: from record pairs to scores and explained units.

``predict`` is one lazy plan.  A pair is one row from its words to its score;
its units, features and contributions stay in arrays on that row, so there is
no exchange between the alignment and the sink.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.vectors import sigmoid
from kinweave.operators import matcher as M
from kinweave.operators.align import UNPAIRED, Thresholds, align_pairs, slot_maker
from kinweave.operators.embedding import attach_vectors
from kinweave.operators.features import (
    ADDITIVE_STATS,
    STATS,
    Options,
    feature_names,
    feature_vectors,
    is_packed,
    packed_units,
    pair_logits,
    unit_table,
    with_pair_values,
)
from kinweave.operators.matcher import DEFAULT_SCORE, LinearMatcher, with_default_score
from kinweave.operators.network import Network, fit_network, packed_network_score
from kinweave.operators.scale import durable
from kinweave.operators.scoring import (
    PACKED,
    as_network,
    binary_score,
    fit_scorer,
    model_score,
    similarity_score,
    soft_labels,
    unit_vector,
)
from kinweave.operators.text import attributes, drop_non_ascii
from kinweave.operators.tokens import computed_once, pair_tokens


@dataclass
class Prediction:
    """``pairs``: a row per pair with ``units``, ``preds``, ``features``, ``match_score`` and, with a linear
    model, ``contributions``.  The parts are views of it; write ``pairs`` once where several are needed.

    With a linear model ``only_scores`` (``id, match_score``) and ``only_units`` are the same values from plans that
    make no feature vectors as columns; ``scores`` and ``units`` take them."""

    pairs: DataFrame
    ids: DataFrame | None = None
    only_scores: DataFrame | None = None
    only_units: DataFrame | None = None

    @property
    def scores(self) -> DataFrame:
        """``id, match_score`` of every pair; pairs that were given but have no row score 0.5."""
        found = (self.pairs if self.only_scores is None else self.only_scores).select("id", "match_score")
        return found if self.ids is None else with_default_score(self.ids, found)

    @property
    def features(self) -> DataFrame:
        return self.pairs.filter("features is not null").select("id", "features")

    @property
    def units(self) -> DataFrame:
        """Unit rows with ``pred`` and, with a linear model, ``token_contribution``."""
        explained = {"token_contribution": "contributions"} if "contributions" in self.pairs.columns else {}
        return unit_table(self.pairs.drop("features", "match_score") if self.only_units is None else self.only_units, **explained)


def predict_from_units(
    units: DataFrame, model, attrs: Sequence[str], explain: bool = True, additive_only: bool = False,
    fill_first: bool = False, mode: str = "proportional", **options,
) -> Prediction:
    """Score pairs from units that carry ``pred``, or from packed pairs with ``preds``."""
    stats, derived = (ADDITIVE_STATS, False) if additive_only else (STATS, True)
    packed = units if is_packed(units) else packed_units(units)
    coef = model.as_map() if explain and isinstance(model, LinearMatcher) else None
    how = Options(stats, derived, fill_first, mode, **options)
    made = with_pair_values(packed, attrs, how, coef)
    scored = model.score(made)
    without = F.coalesce(F.size("units"), F.lit(0)) <= 0

    def known(score: Column) -> Column:
        return F.when(without, DEFAULT_SCORE).otherwise(score).alias("match_score")

    out = Prediction(scored.withColumn("match_score", known(F.col("match_score"))))
    line = _line(model, attrs, how)
    if line is not None:
        values = with_pair_values(packed, attrs, how, features=False, linear=line)
        out.only_scores = values.select("id", known(sigmoid(F.col("logit"))))
    if coef is not None:
        out.only_units = with_pair_values(packed, attrs, how, coef, features=False)
    return out


def _line(model, attrs: Sequence[str], options: Options) -> tuple[tuple[float, ...], float] | None:
    """Coefficients in the order of the features, and intercept, of a linear model that fits the features."""
    fits = isinstance(model, LinearMatcher) and len(model.coef) == len(feature_names(attrs, options.stats, options.derived))
    return (model.coef, model.intercept) if fits else None


def _scores_of_words(
    pairs: DataFrame, model, attrs: Sequence[str], scorer, thresholds: Thresholds, similarity, use_schema: bool,
    explain: bool = True, additive_only: bool = False, fill_first: bool = False, mode: str = "proportional", **options,
) -> DataFrame | None:
    """``id, match_score`` in one task function, for a linear model and words that are compared as words."""
    stats, derived = (ADDITIVE_STATS, False) if additive_only else (STATS, True)
    how = Options(stats, derived, fill_first, mode, **options)
    line, maker = _line(model, attrs, how), slot_maker(thresholds, similarity, use_schema)
    if line is None or maker is None or maker[0] != "word" or not attrs or UNPAIRED in attrs:
        return None
    score = {similarity_score: lambda sim: sim, binary_score: lambda sim: (sim > 0).astype(float)}[scorer]
    found = pair_logits(pairs, attrs, score, line, how, thresholds, similarity, use_schema)
    return found.select("id", F.coalesce(sigmoid(F.col("logit")), F.lit(DEFAULT_SCORE)).alias("match_score"))


def predict(
    pairs: DataFrame, model, attrs: Sequence[str] | None = None, scorer: Callable[[DataFrame], DataFrame] = similarity_score,
    similarity="jaro_winkler", thresholds: Thresholds = Thresholds(), use_schema: bool = True, clean: bool = True,
    tokens: Callable[[DataFrame], DataFrame] | None = None, vector_size: int | None = None, **options,
) -> Prediction:
    """Clean, tokenise, align, score and explain record pairs.

    ``scorer`` turns units into units with ``pred``; ``tokens`` replaces the
    default tokeniser, for tokens that carry vectors.
    """
    attrs = attributes(pairs) if attrs is None else list(attrs)
    ready = drop_non_ascii(pairs) if clean else pairs
    toks = tokens(ready) if tokens else pair_tokens(ready, attrs)
    packed = align_pairs(toks, thresholds, similarity, use_schema, vector_size)
    if scorer in PACKED:
        out = predict_from_units(scorer(packed), model, attrs, **options)
        found = None if tokens else _scores_of_words(ready, model, attrs, scorer, thresholds, similarity, use_schema, **options)
        out.only_scores = out.only_scores if found is None else found
        return out
    out = predict_from_units(scorer(unit_table(packed.withColumn("preds", F.array())).drop("pred")), model, attrs, **options)
    out.ids = pairs.select("id")
    return out


def explained_units(prediction: Prediction) -> DataFrame:
    """Units with their pair's score."""
    return unit_table(prediction.pairs.drop("features"), token_contribution="contributions")


@dataclass
class MatcherPipeline:
    """Fit on labelled pairs, then predict and explain.

    ``vocab`` (``word, vec``) switches to vector similarity and a learned
    unit scorer, a regression or, with settings in ``network``, the relevance
    network; without it units are scored by string similarity.  ``select``
    also fits the candidates on selected features, and takes those models where
    the best of them is better on the validation pairs.
    """

    attrs: Sequence[str] | None = None
    vocab: DataFrame | None = None
    vector_size: int | None = None
    thresholds: Thresholds = Thresholds()
    use_schema: bool = True
    additive_only: bool = False
    fill_first: bool = True
    binary: bool = False
    network: dict | None = None
    select: bool = False
    candidates: dict[str, object] | None = None
    best: M.FittedModel | None = None
    linear: LinearMatcher | None = None
    scorer_model: object | None = None
    names: list[str] = field(default_factory=list)
    metrics: DataFrame | None = None

    def words(self, pairs: DataFrame) -> DataFrame:
        """Pairs with the words of both records."""
        return pair_tokens(drop_non_ascii(pairs), self.attrs)

    def with_vectors(self, toks: DataFrame) -> DataFrame:
        return toks if self.vocab is None else attach_vectors(toks, self.vocab, self.vector_size)

    def aligned(self, toks: DataFrame) -> DataFrame:
        """Packed pairs from their words, which carry vectors if there is a vocabulary."""
        if self.vocab is None:
            return align_pairs(toks, self.thresholds, "jaro_winkler", self.use_schema)
        return align_pairs(toks, self.thresholds, "cosine", self.use_schema, self.vector_size)

    def _units(self, pairs: DataFrame) -> DataFrame:
        """Packed pairs."""
        return self.aligned(self.with_vectors(self.words(pairs)))

    def _labelled(self, units: DataFrame) -> DataFrame:
        """Unit rows with feature vectors and soft labels."""
        return soft_labels(self._rows(units).withColumn("unit_features", unit_vector()), vectors=True)

    def _rows(self, packed: DataFrame) -> DataFrame:
        return unit_table(packed.withColumn("preds", F.array())).drop("pred")

    def _scored(self, packed: DataFrame) -> DataFrame:
        if self.scorer_model is None:
            return (binary_score if self.binary else similarity_score)(packed)
        net = as_network(self.scorer_model)
        if net is not None:
            scored = packed_network_score(packed, net)
            lean = F.transform("units", lambda u: u.dropFields("left_vec", "right_vec"))
            return computed_once(scored.withColumn("units", lean), "units", "preds")
        scored = model_score(self._rows(packed).withColumn("unit_features", unit_vector()), self.scorer_model)
        return scored.drop("unit_features", "left_vec", "right_vec")

    def _features(self, scored: DataFrame) -> DataFrame:
        stats, derived = (ADDITIVE_STATS, False) if self.additive_only else (STATS, True)
        return feature_vectors(scored, self.attrs, stats, derived, self.fill_first)

    def fit(self, train: DataFrame, valid: DataFrame | None = None, units: Sequence[DataFrame] | None = None) -> MatcherPipeline:
        """Without validation pairs the training pairs are used in their place.

        ``units`` are packed pairs made before, of ``train`` and then of ``valid``.
        """
        self.attrs = attributes(train) if self.attrs is None else list(self.attrs)
        stats, derived = (ADDITIVE_STATS, False) if self.additive_only else (STATS, True)
        self.names = feature_names(self.attrs, stats, derived)
        ready = units is not None
        made = list(units) if ready else [self._units(p) for p in (train, valid) if p is not None]
        units = made[0]
        if self.vocab is not None:
            units = units if ready else durable(units)
            labelled = self._labelled(units)
            if self.network is None:
                self.scorer_model = fit_scorer(labelled)
            else:
                checked = None if valid is None else self._labelled(made[1] if ready else durable(made[1]))
                self.scorer_model = fit_network(labelled, checked, **self.network).network
        # every fit below reads the feature rows many times
        rows = M.kept_rows(M.training_rows(self._features(self._scored(units)), train))
        splits = {"train": rows, "valid": rows}
        if valid is not None:
            splits["valid"] = M.kept_rows(M.training_rows(self._features(self._scored(made[1])), valid))
        specs = self.candidates or {"LR": "minmax", "LR_std": "standard"}
        fitted = [M.fit_candidate(name, spec, rows, self.names) for name, spec in specs.items()]
        self.metrics, order = self._compared(fitted, splits)
        if self.select:
            kept = M.chosen_features(rows, splits["valid"], self.names)
            at = [self.names.index(f) for f in kept]
            part = durable(rows.select("id", "label", M.picked_features(at).alias("features")).withColumn("vec", array_to_vector("features")))
            again = [M.on_all_features(M.fit_candidate(name, spec, part, kept), kept, self.names) for name, spec in specs.items()]
            metrics, second = self._compared(again, splits)
            if second[0].f1 > order[0].f1:
                fitted, order, self.metrics = again, second, metrics
        order = [r.model_name for r in order]
        by_name = {m.name: m for m in fitted}
        self.best = by_name[order[0]]
        linear = [by_name[n] for n in order if by_name[n].linear is not None]
        self.linear = linear[0].linear if linear else M.fit_logistic(rows, self.names, None)
        return self

    def _compared(self, fitted: list, splits: dict):
        """Metrics, and the candidates by their F1 on the validation pairs."""
        metrics = durable(M.compare_models(fitted, splits))
        best = metrics.filter("split = 'valid'").orderBy(F.desc("f1"), "model_name")
        return metrics, best.select("model_name", "f1").collect()  # one row per candidate

    def predict(self, pairs: DataFrame, linear: bool = True, explain: bool = True, units: DataFrame | None = None) -> Prediction:
        """``units`` are packed pairs made before."""
        model = self.linear if linear else self.best
        out = predict_from_units(
            self._scored(self._units(pairs) if units is None else units), model, self.attrs, explain=explain and linear,
            additive_only=self.additive_only, fill_first=self.fill_first)
        if self.scorer_model is not None and as_network(self.scorer_model) is None:  # unit rows have lost pairs without units
            out.ids = pairs.select("id")
        return out

    def _settings(self) -> dict:
        kept = ("vector_size", "use_schema", "additive_only", "fill_first", "binary")
        return {**{k: getattr(self, k) for k in kept}, "thresholds": asdict(self.thresholds)}

    def save(self, spark: SparkSession, path: str) -> None:
        """Settings, linear matcher, feature names and, if present, the unit scorer and the best model."""
        self.linear.save(spark, f"{path}/linear")
        M.save_names(spark, self.names, f"{path}/names")
        best = "linear" if self.best.linear is not None else "draw" if isinstance(self.best.model, M.StratifiedDraw) else "spark"
        state = {"settings": self._settings(), "best": best, "name": self.best.name, "share": getattr(self.best.model, "share", None),
                 "picked": self.best.picked}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")
        spark.createDataFrame([(a,) for a in self.attrs], "attr string").coalesce(1).write.mode("overwrite").parquet(f"{path}/attrs")
        if isinstance(self.scorer_model, Network):
            self.scorer_model.save(spark, f"{path}/scorer")
        elif self.scorer_model is not None:
            self.scorer_model.write().overwrite().save(f"{path}/scorer")
        if best == "linear":
            self.best.linear.save(spark, f"{path}/best_linear")
        elif best == "spark":
            self.best.model.write().overwrite().save(f"{path}/best")

    @staticmethod
    def load(spark: SparkSession, path: str, scorer_class=None, best_class=None, **settings) -> MatcherPipeline:
        """Settings are those that were saved, unless given here.

        ``scorer_class`` and ``best_class`` are the Spark ML model classes
        that were saved, if any.
        """
        state = json.loads(spark.read.parquet(f"{path}/state").first().state)
        saved = dict(state["settings"], thresholds=Thresholds(**state["settings"]["thresholds"]))
        out = MatcherPipeline(**{**saved, **settings})
        out.attrs = sorted(r.attr for r in spark.read.parquet(f"{path}/attrs").collect())
        out.names = M.load_names(spark, f"{path}/names")
        out.linear = LinearMatcher.load(spark, f"{path}/linear")
        if scorer_class is Network:
            out.scorer_model = Network.load(spark, f"{path}/scorer")
        elif scorer_class is not None:
            out.scorer_model = scorer_class.load(f"{path}/scorer")
        if state["best"] == "linear":
            linear = LinearMatcher.load(spark, f"{path}/best_linear")
            out.best = M.FittedModel(state["name"], linear, linear)
        elif state["best"] == "draw":
            out.best = M.FittedModel(state["name"], M.StratifiedDraw(state["share"]))
        elif best_class is not None:
            out.best = M.FittedModel(state["name"], best_class.load(f"{path}/best"), None, state.get("picked"))
        return out
