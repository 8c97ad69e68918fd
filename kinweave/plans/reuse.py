"""Fit and predict over stored stages: words, vectors, units and models of an earlier run are found again."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml.regression import GeneralizedLinearRegressionModel

from kinweave.operators.network import Network
from kinweave.operators.text import attributes
from kinweave.plans.pipeline import MatcherPipeline, Prediction
from kinweave.sources.stages import Stage, StageStore


@dataclass
class StagedMatcher:
    """A ``MatcherPipeline`` whose steps are stages of a store.

    Pairs are given as stages (``store.source`` for files).  ``vocab`` takes
    the place of the matcher's own, so that the vectors' files are part of the fingerprints.
    """

    store: StageStore
    matcher: MatcherPipeline
    vocab: Stage | None = None

    def __post_init__(self):
        if self.vocab is None and self.matcher.vocab is not None:
            raise ValueError("give the vocabulary as a stage")
        if self.vocab is not None:
            self.matcher = replace(self.matcher, vocab=self.vocab.df)

    def _attrs(self, pairs: Stage) -> list[str]:
        if self.matcher.attrs is None:
            self.matcher.attrs = attributes(pairs.df)
        return list(self.matcher.attrs)

    def words(self, pairs: Stage) -> Stage:
        attrs = self._attrs(pairs)
        return self.store.table("words", lambda: self.matcher.words(pairs.df), [pairs], {"attrs": attrs})

    def vectors(self, pairs: Stage) -> Stage:
        words = self.words(pairs)
        if self.vocab is None:
            return words
        settings = {"vector_size": self.matcher.vector_size}
        return self.store.table("vectors", lambda: self.matcher.with_vectors(words.df), [words, self.vocab], settings)

    def units(self, pairs: Stage) -> Stage:
        """Packed pairs."""
        toks, m = self.vectors(pairs), self.matcher
        settings = {"thresholds": m.thresholds, "use_schema": m.use_schema, "vectors": m.vocab is not None, "vector_size": m.vector_size}
        return self.store.table("units", lambda: m.aligned(toks.df), [toks], settings)

    def fit(self, train: Stage, valid: Stage | None = None) -> Stage:
        """The fitted models' folder; afterwards ``matcher`` is fitted, by this run or an earlier one."""
        given = [s for s in (train, valid) if s is not None]
        units = [self.units(s) for s in given]
        m = self.matcher
        settings = {**m._settings(), "attrs": list(m.attrs), "network": m.network, "select": m.select, "candidates": m.candidates,
                    "valid": valid is not None}

        def write(path: str) -> None:
            m.fit(train.df, None if valid is None else valid.df, units=[u.df for u in units]).save(self.store.spark, path)

        saved = self.store.folder_of("model", write, [*given, *units], settings)
        scorer = None if m.vocab is None else GeneralizedLinearRegressionModel if m.network is None else Network
        self.matcher = MatcherPipeline.load(
            self.store.spark, saved.path, scorer_class=scorer, vocab=m.vocab, network=m.network, select=m.select, candidates=m.candidates)
        return saved

    def predict(self, pairs: Stage, **options) -> Prediction:
        """The linear model's prediction from the stored units."""
        return self.matcher.predict(pairs.df, units=self.units(pairs).df, **options)
