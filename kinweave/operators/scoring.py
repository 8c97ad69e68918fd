"""Relevance of units: soft labels, unit features and scorers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, GeneralizedLinearRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.vectors import abs_difference, cosine, mean_of_two, mean_vector
from kinweave.operators.network import Network, network_score
from kinweave.operators.scale import durable, salted_lookup

MIN_SIM_PAIR = 0.7
MAX_SIM_UNPAIR = 0.5


def similarity_score(units: DataFrame) -> DataFrame:
    """The similarity as score: ``pred`` of unit rows, or ``preds`` of packed pairs."""
    if "units" in units.columns:
        return units.withColumn("preds", F.col("units.cos_sim").cast("array<double>"))
    return units.withColumn("pred", F.col("cos_sim").cast("double"))


def binary_score(units: DataFrame) -> DataFrame:
    """1 for units with any similarity; unit rows or packed pairs."""
    def one(sim: Column) -> Column:
        return F.when(sim > 0, 1.0).otherwise(0.0)

    if "units" in units.columns:
        return units.withColumn("preds", F.transform("units.cos_sim", one))
    return units.withColumn("pred", one(F.col("cos_sim")))


#: Scorers that take packed pairs; others get unit rows, which are packed again with one exchange.
PACKED = (similarity_score, binary_score)


def unit_vector(left: str = "left_vec", right: str = "right_vec", sentence: str | None = None) -> Column:
    """Mean of both word vectors, their absolute difference and, optionally, the mean sentence vector."""
    parts = [mean_of_two(F.col(left), F.col(right)), abs_difference(F.col(left), F.col(right))]
    if sentence is not None:
        parts.append(F.transform(sentence, lambda x: x.cast("double")))
    return F.concat(*parts)


def sentence_means(tokens: DataFrame, size: int) -> DataFrame:
    """Mean of both sides' sentence vectors per pair, where a sentence is the mean of its word vectors."""
    return tokens.select("id", mean_of_two(
        mean_vector(F.col("l_toks.vec"), size), mean_vector(F.col("r_toks.vec"), size)).alias("sentence"))


def attach_sentence(units: DataFrame, sentences: DataFrame) -> DataFrame:
    return units.join(sentences, "id")


def corrected_label(sim: Column, label: Column) -> Column:
    """Doubtful labels become 0.5: similar words of a non-match, dissimilar words of a match."""
    return (
        F.when((label == 0) & (sim >= MIN_SIM_PAIR), 0.5)
        .when((label == 1) & (sim < MAX_SIM_UNPAIR), 0.5)
        .otherwise(label.cast("double"))
    )


def distinct_units(units: DataFrame, columns: Sequence[str], copies: str = "copies") -> DataFrame:
    """Units that are equal in ``columns`` as one row, with their number; a frequent word pair is a few rows."""
    return units.groupBy(*columns).agg(F.count("*").alias(copies))


def word_pair_means(units: DataFrame, copies: str | None = None) -> DataFrame:
    """Mean label, similarity and corrected label per word pair; partial sums keep frequent pairs cheap."""
    if copies is not None:
        def mean(c: str) -> Column:
            known = F.when(F.col(c).isNotNull(), F.col(copies))
            return (F.sum(F.col(c).cast("double") * F.col(copies)) / F.sum(known)).alias(c)

        return units.groupBy("left_word", "right_word").agg(mean("label"), mean("cos_sim"), mean("label_corrected"))
    return units.groupBy("left_word", "right_word").agg(
        F.avg(F.col("label").cast("double")).alias("label"), F.avg("cos_sim").alias("cos_sim"),
        F.avg("label_corrected").alias("label_corrected"),
    )


def soft_labels(units: DataFrame, vectors: bool = False, salts: int = 16, hot_rows: int = 1_000_000, copies: str | None = None) -> DataFrame:
    """Corrected labels and their mean over all units with the same word pair.

    The mean is aggregated first and joined back, with word pairs of at
    least ``hot_rows`` units spread over ``salts`` tasks: a window over the
    word pair would hold all units of a frequent pair in one task.  The
    units are read several times, so pass a stored table.  With ``copies``
    they are those of ``distinct_units``, and a row counts that often.
    """
    sim = cosine(F.col("left_vec"), F.col("right_vec")) if vectors else F.col("cos_sim")
    marked = units.withColumn("label_corrected", corrected_label(sim, F.col("label")))
    means = word_pair_means(marked, copies).select(
        "left_word", "right_word", F.col("label_corrected").alias("label_corrected_mean"))
    spread = ["id", "unit_no"] if copies is None else [c for c in units.columns if c not in ("left_word", "right_word")]
    return salted_lookup(marked, means, ["left_word", "right_word"], spread, "inner", salts, hot_rows)


def fit_scorer(units: DataFrame, max_iter: int = 25, reg: float = 1e-4):
    """Binomial regression of the soft label on unit vectors (column ``unit_features``).

    Every iteration reads the rows again, so they are checkpointed first.
    """
    data = durable(units.select(
        array_to_vector(F.col("unit_features")).alias("features"), F.col("label_corrected_mean").alias("label")))
    return GeneralizedLinearRegression(
        family="binomial", link="logit", maxIter=max_iter, regParam=reg, predictionCol="pred").fit(data)


def fit_perceptron_scorer(units: DataFrame, width: int, layers: Sequence[int] = (300, 64, 32), max_iter: int = 40,
                          seed: int = 0):
    """Multilayer perceptron on the units whose label is not doubtful."""
    data = durable(units.filter(F.col("label_corrected") != 0.5).select(
        array_to_vector(F.col("unit_features")).alias("features"), F.col("label_corrected").alias("label")))
    return MultilayerPerceptronClassifier(
        layers=[width, *layers, 2], maxIter=max_iter, seed=seed, blockSize=256).fit(data)


def as_network(model) -> Network | None:
    """A fitted regression is a network without hidden layers; None for other models."""
    if isinstance(model, Network):
        return model
    if isinstance(model, GeneralizedLinearRegressionModel):
        return Network.linear(model.coefficients.toArray(), model.intercept)
    return None


def model_score(units: DataFrame, model) -> DataFrame:
    """Add ``pred`` with a fitted scorer."""
    if isinstance(model, Network):
        return network_score(units, model)
    with_vector = units.withColumn("features", array_to_vector(F.col("unit_features")))
    scored = model.transform(with_vector).drop("features")
    if "probability" in scored.columns:
        return scored.withColumn("pred", vector_to_array("probability")[1]).drop(
            "probability", "rawPrediction", "prediction")
    return scored


def tanh_scaled(df: DataFrame, col: str, factor: float = 1.0, out: str | None = None) -> DataFrame:
    """Standardise a vector column over the table, then squash it into (0, 1)."""
    stats = df.select(Summarizer.metrics("mean", "std", "count").summary(array_to_vector(F.col(col))).alias("s")).select(
        "s.mean", "s.std", "s.count").first()
    n = stats["count"]
    population = [s * ((n - 1) / n) ** 0.5 if n > 1 else 0.0 for s in stats["std"]]
    mean = F.lit([float(x) for x in stats["mean"]])
    inverse = F.lit([1.0 / x if x > 0 else 1.0 for x in population])
    centred = F.zip_with(col, mean, lambda x, m: x.cast("double") - m)
    return df.withColumn(out or col, F.transform(
        F.zip_with(centred, inverse, lambda x, i: x * i), lambda z: (F.tanh(z * factor) + 1) * 0.5))
