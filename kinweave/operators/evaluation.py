"""Evaluation of explanations: perturbations, their metrics and conciseness.

Conventions: ``detected_delta`` is the score before minus the score after
removing words; ``expected_delta`` is the summed impact of the removed units;
``sufficiency`` keeps only the chosen units and asks whether the class stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.align import UNPAIRED
from kinweave.operators.features import by_pair
from kinweave.operators.matcher import binary_metrics
from kinweave.operators.sampling import per_class_sample
from kinweave.operators.scale import exact_median
from kinweave.operators.similarity import bounds, list_array
from kinweave.operators.text import LEFT, RIGHT
from kinweave.operators.tokens import exploded

PERCENTAGES = (1, 3, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100)  # fixed values of the conciseness curve
PLAN_ROWS = 512  # pairs whose perturbations are made together in a task


# ---- impacts ------------------------------------------------------------------------------------

def unit_impact(units: DataFrame, score: str = "token_contribution") -> DataFrame:
    """Impact of a unit: relevance over one half, or the contribution itself."""
    return units.withColumn("impact", F.col(score) - 0.5 if score == "pred" else F.col(score))


def units_to_tokens(units: DataFrame) -> DataFrame:
    """One row per real word; the contribution of a paired unit is split evenly."""
    both = (F.col("left_word") != UNPAIRED) & (F.col("right_word") != UNPAIRED)
    share = F.when(both, F.col("token_contribution") / 2).otherwise(F.col("token_contribution"))

    def side(prefix: str) -> Column:
        return F.when(F.col(f"{prefix}word") != UNPAIRED, F.struct(
            F.concat(F.lit(prefix), f"{prefix}attribute").alias("attribute"), F.col(f"{prefix}pos").alias("pos"),
            F.col(f"{prefix}word").alias("word")))

    rows = units.select("id", "unit_no", "label", share.alias("token_contribution"),
                        F.array_compact(F.array(side(LEFT), side(RIGHT))).alias("sides"))
    return exploded(rows, ["id", "unit_no", "label", "token_contribution"], F.col("sides"), "s").select(
        "id", "unit_no", "label", "token_contribution", "s.*")


def word_keys(tokens_long: DataFrame) -> DataFrame:
    """Key of a word inside its record: ``{side}_{attr}__{position}``."""
    return tokens_long.withColumn("word_key", F.concat("side", F.lit("_"), "attr", F.lit("__"), F.col("attr_pos").cast("string")))


# ---- perturbation --------------------------------------------------------------------------------

def _by_impact() -> list[Column]:
    """Highest impact first; impacts equal to 9 digits count as equal and go by unit number."""
    return [F.desc(F.round("impact", 9)), F.asc("unit_no")]


def _rank(order: Sequence[Column]) -> Column:
    return F.row_number().over(Window.partitionBy("id").orderBy(*order))


def top_units(impacts: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` units of each pair with the highest impact."""
    ranked = impacts.withColumn("rank", _rank(_by_impact()))
    return ranked.filter(F.col("rank") <= k)


def perturbation_plan(impacts: DataFrame, k: int = 5, rounds: int = 3, kind: str = "AOPC", seed: int = 0, packed: bool = False) -> DataFrame:
    """Which units each perturbation touches: ``id, comb_no, comb_name, unit_no, impact``.

    ``AOPC`` removes the 1..k most relevant units of a match (least relevant
    first for a non-match is the caller's sign) and, for comparison, 1..k
    random ones in ``rounds`` draws.  ``sufficiency`` chooses the top 1..k and
    random units the same way, to be kept.  ``packed`` gives a row per pair instead,
    with its units' impacts, places and what they are ordered by in an array, for ``perturb_pairs``.
    """
    name = "MoRF" if kind == "AOPC" else "top"
    draws = [F.md5(F.concat_ws("|", F.lit(str(seed + i)), F.col("id").cast("string"), F.col("unit_no").cast("string"))) for i in range(1, rounds + 1)]
    if packed:
        # ranks are taken where the perturbations are made: one exchange, and no sort by each order
        impact = F.col("impact").cast("double")
        member = F.struct("unit_no", impact.alias("impact"), F.round(impact, 9).alias("key"), "left_pos", "right_pos",
                          F.array(*draws).cast("array<string>").alias("draws"))
        return by_pair(impacts).groupBy("id").agg(F.collect_list(member).alias("members")).withColumns(
            {"k": F.lit(k), "rounds": F.lit(rounds), "name": F.lit(name)})
    ranks = [("_r0", _rank(_by_impact())), *[(f"_r{i}", _rank([draw, F.asc("unit_no")])) for i, draw in enumerate(draws, 1)]]
    ranked = impacts.select("id", "unit_no", "impact", *[r.alias(n) for n, r in ranks])

    def combs(i: int) -> Column:
        label = name if i == 0 else f"random{i}"
        return F.transform(F.sequence(F.lit(1), F.lit(k)), lambda s: F.when(F.col(f"_r{i}") <= s, F.struct(
            (s + i * k).alias("comb_no"), F.concat(F.lit(f"{label}_"), s.cast("string")).alias("comb_name"))))

    every = F.array_compact(F.concat(*[combs(i) for i in range(rounds + 1)]))
    return exploded(ranked, ["id", "unit_no", "impact"], every, "c").select("id", "c.*", "unit_no", "impact")


def _touched(plan: DataFrame, units: DataFrame) -> DataFrame:
    places = units.select("id", "unit_no", "left_pos", "right_pos")
    return plan.join(places, ["id", "unit_no"]).groupBy("id", "comb_no", "comb_name").agg(
        F.sum("impact").alias("expected_delta"),
        F.collect_set(F.when(F.col("left_pos") >= 0, F.col("left_pos"))).alias("l"),
        F.collect_set(F.when(F.col("right_pos") >= 0, F.col("right_pos"))).alias("r"),
        F.collect_set("unit_no").alias("unit_nos"))


def _lowest(size: int, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Least rank per round of the units at each of ``size`` words; a word of no unit has the largest number."""
    out = np.full((size, rank.shape[1]), np.iinfo(np.int32).max, np.int32)
    if len(at):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        out[at[order][first]] = np.minimum.reduceat(rank[order], first, axis=0)
    return out


def _kept_texts(chosen: np.ndarray, row: np.ndarray, n_rows: int, words: pa.Array) -> pa.Array:
    """A text per row and perturbation: of the row's words those that ``chosen`` (words x perturbations) keeps, in order."""
    word, comb = np.nonzero(chosen)
    group = row[word] * chosen.shape[1] + comb
    order = np.argsort(group, kind="stable")
    return pc.binary_join(list_array(group[order], words.take(pa.array(word[order])), n_rows * chosen.shape[1]), " ")


def _ranks(row: np.ndarray, unit_no: pa.Array, key: pa.Array, draws: pa.Array, turns: int) -> np.ndarray:
    """Place of every unit in its row by impact (null last, NaN first), then by every random draw; ties go by unit number."""
    no = unit_no.to_numpy(zero_copy_only=False)
    value = key.fill_null(0.0).to_numpy(zero_copy_only=False)
    place = np.where(~key.is_valid().to_numpy(zero_copy_only=False), 2, np.where(np.isnan(value), 0, 1))
    drawn = np.array(draws.to_pylist(), dtype="S32").reshape(-1, turns - 1)
    start = np.flatnonzero(np.diff(row, prepend=-1))
    inside = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
    out = np.empty((len(row), turns), np.int32)
    for i in range(turns):
        order = np.lexsort((no, drawn[:, i - 1], row) if i else (no, -np.nan_to_num(value), place, row))
        out[order, i] = inside + 1
    return out


def _same_texts(row: np.ndarray, texts: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The first of the perturbations of a row that leave the same texts, and the number of every one's first; ``row`` ascends."""
    key, bound = row, int(row.max(initial=0)) + 1
    for t in texts:
        code = t.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = int(code.max(initial=0)) + 1
        if bound * size >= 2 ** 62:
            key = np.unique(key, return_inverse=True)[1]
            bound = len(key) + 1
        key, bound = key * size + code, bound * size
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    return first, number


def _perturb_rows(attrs: Sequence[str], keep: bool, shared: bool, k: pa.Array, rounds: pa.Array, unit_no: pa.Array, impact: pa.Array, by: pa.Array,
                  draws: pa.Array, *sides: pa.Array) -> pa.Array:
    """Every row's perturbations: number, expected delta and the texts of each attribute, left then right.

    ``sides`` has for each side the units' places, then the words, attributes and places of its tokens.
    With ``shared`` perturbations of a row that leave the same texts are one item with a list of theirs.
    """
    n, steps, turns = len(impact), np.arange(1, k[0].as_py() + 1), rounds[0].as_py() + 1
    combs = turns * len(steps)
    unit_row = np.repeat(np.arange(n), bounds(impact)[1])
    rank = _ranks(unit_row, unit_no.flatten(), by.flatten(), draws.flatten(), turns)
    impacts = impact.flatten()
    known = impacts.is_valid().to_numpy(zero_copy_only=False)
    unit, comb = np.nonzero(((rank[:, :, None] <= steps) & known[:, None, None]).reshape(len(rank), combs))
    group = unit_row[unit] * combs + comb
    total = np.bincount(group, weights=impacts.fill_null(0.0).to_numpy(zero_copy_only=False)[unit], minlength=n * combs)
    texts = []
    for at in (0, 4):
        places, words, of, tokens = sides[at:at + 4]
        row = np.repeat(np.arange(n), bounds(words)[1])
        place = places.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        pos = tokens.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        width = int(max(place.max(initial=0), pos.max(initial=0))) + 1
        key = row * width + pos
        order = np.argsort(key, kind="stable")
        there = np.flatnonzero(place >= 0)
        wanted = unit_row[there] * width + place[there]
        found = np.searchsorted(key[order], wanted)
        hit = np.flatnonzero(key[order][np.minimum(found, len(key) - 1)] == wanted) if len(key) else np.zeros(0, np.int64)
        low = _lowest(len(key), order[found[hit]], rank[there[hit]])
        chosen = ((low[:, :, None] <= steps) == keep).reshape(len(key), combs)
        flat, attr = words.flatten(), of.flatten()
        for a in attrs:
            mine = pc.fill_null(pc.equal(attr, a), False).to_numpy(zero_copy_only=False)
            texts.append(_kept_texts(chosen & mine[:, None], row, n, flat))
    number = pa.array(np.tile(np.arange(1, combs + 1, dtype=np.int32), n))
    delta = pa.array(total, mask=np.bincount(group, minlength=n * combs) == 0)
    row, fields = np.repeat(np.arange(n), combs), [f"t{i}" for i in range(len(texts))]
    if not shared:
        return list_array(row, pa.StructArray.from_arrays([number, delta, *texts], ["comb_no", "expected_delta", *fields]), n)
    first, of = _same_texts(row, texts)
    order = np.argsort(of, kind="stable")
    theirs = list_array(of[order], pa.StructArray.from_arrays([number, delta], ["comb_no", "expected_delta"]).take(pa.array(order)), len(first))
    return list_array(row[first], pa.StructArray.from_arrays([theirs, *[t.take(pa.array(first)) for t in texts]], ["combs", *fields]), n)


COMB = "comb_no:int,expected_delta:double"


def _perturbed_packed(packed: DataFrame, attrs: Sequence[str], keep: bool, shared: bool = False) -> DataFrame:
    """Perturbations of pairs with their words and a packed plan; no row leaves its place.

    The other columns of ``packed``, then ``comb_no, expected_delta`` and the texts.  With ``shared`` a row per distinct texts
    of a pair, with the perturbations that leave them in ``combs``.
    """
    attrs = list(attrs)
    names = [side + a for side in (LEFT, RIGHT) for a in attrs]
    head = [f"combs:array<struct<{COMB}>>"] if shared else [COMB]

    @F.arrow_udf("array<struct<" + ",".join([*head, *[f"t{i}:string" for i in range(len(names))]]) + ">>")
    def made(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in columns:
            for lo in range(0, len(batch[0]), PLAN_ROWS):
                yield _perturb_rows(attrs, keep, shared, *[c.slice(lo, PLAN_ROWS) for c in batch])

    units = [F.col(f"members.{x}") for x in ("unit_no", "impact", "key")]
    sides = [c for side in ("left", "right") for c in (f"members.{side}_pos", *[f"{side[0]}_toks.{x}" for x in ("word", "attr", "pos")])]
    own = [c for c in packed.columns if c not in ("members", "rounds", "l_toks", "r_toks")]
    done = packed.select(*own, made(F.col("k"), F.col("rounds"), *units, F.flatten("members.draws"), *[F.col(c) for c in sides]).alias("_made"))
    rows = exploded(done, own, F.col("_made"), "c").select(*own, "c.*")
    return rows.withColumnsRenamed({f"t{i}": n for i, n in enumerate(names)})


def _comb_name(number: Column, k: Column, name: Column) -> Column:
    at = F.floor((number - 1) / k).cast("int")
    kind = F.when(at == 0, name).otherwise(F.concat(F.lit("random"), at.cast("string")))
    return F.concat(kind, F.lit("_"), ((number - 1) % k + 1).cast("string"))


def perturbed_id() -> Column:
    """Id of a perturbed pair, for any type of id and any number of perturbations."""
    return F.concat(F.col("id").cast("string"), F.lit("#"), F.col("comb_no").cast("string"))


def perturb_pairs(tokens: DataFrame, plan: DataFrame, units: DataFrame, attrs: Sequence[str], keep: bool = False) -> DataFrame:
    """Rebuilt record texts, one row per perturbation, ready to be scored again.

    ``tokens`` is the output of ``pair_tokens`` on the same pairs.  With a packed plan a pair's
    perturbations are made next to its words, so only pairs are joined.
    """
    words = tokens.select("id", "label", "l_toks", "r_toks")
    if "members" in plan.columns:
        # sizes of arrays are estimated as one element's: no broadcast
        rows = _perturbed_packed(plan.join(words.hint("merge"), "id"), attrs, keep)
        return rows.select(
            perturbed_id().alias("id"), F.col("id").alias("pair_id"), "comb_no",
            _comb_name(F.col("comb_no"), F.col("k"), F.col("name")).alias("comb_name"), "expected_delta", "label", *[side + a for side in (LEFT, RIGHT) for a in attrs])
    touched = _touched(plan, units).join(words, "id")

    def text(toks: str, places: str, attr: str) -> Column:
        def stays(t: Column) -> Column:
            hit = F.array_contains(places, t["pos"])
            return (t["attr"] == attr) & (hit if keep else ~hit)

        return F.array_join(F.transform(F.filter(toks, stays), lambda t: t["word"]), " ")

    return touched.select(
        perturbed_id().alias("id"), F.col("id").alias("pair_id"), "comb_no", "comb_name", "expected_delta", "label",
        *[text("l_toks", "l", a).alias(LEFT + a) for a in attrs], *[text("r_toks", "r", a).alias(RIGHT + a) for a in attrs])


def perturb_units(units: DataFrame, plan: DataFrame, keep: bool = False) -> DataFrame:
    """Units that stay per perturbation, for a predictor that starts from units."""
    combs = _touched(plan, units).select("id", "comb_no", "unit_nos")
    hit = F.array_contains("unit_nos", F.col("unit_no"))
    return units.join(combs, "id").filter(hit if keep else ~hit).withColumn("id", perturbed_id()).drop("comb_no", "unit_nos")


def perturbation_results(perturbed: DataFrame, new_scores: DataFrame, start_scores: DataFrame) -> DataFrame:
    """``id, comb_name, start_pred, new_pred, expected_delta, detected_delta, error``.

    A perturbation that leaves no unit scores 0.5.
    """
    new = new_scores.select("id", F.col("match_score").alias("new_pred"))
    start = start_scores.select(F.col("id").alias("pair_id"), F.col("match_score").alias("start_pred"))
    return _compared(perturbed.join(new, "id", "left").join(start, "pair_id"))


def _compared(joined: DataFrame) -> DataFrame:
    new_pred = F.coalesce("new_pred", F.lit(0.5))
    delta = F.col("start_pred") - new_pred
    return joined.select(
        F.col("pair_id").alias("id"), "comb_name", "label", "start_pred", new_pred.alias("new_pred"), "expected_delta",
        delta.alias("detected_delta"), (F.col("expected_delta") - delta).alias("error"))


def evaluate_pairs(
    pairs: DataFrame, tokens: DataFrame, impacts: DataFrame, start_scores: DataFrame, attrs: Sequence[str],
    rescore: Callable[[DataFrame], DataFrame], k: int = 5, rounds: int = 3, kind: str = "AOPC", seed: int = 0,
    keeps_rows: bool = False,
) -> DataFrame:
    """Perturb, score again with ``rescore`` (pairs -> ``id, match_score``) and compare.

    ``keeps_rows`` says that ``rescore`` gives every pair it gets, once, with the id as it came, and that its score is of
    the texts.  The id is then a struct that carries the pair's first score and its perturbations, so the new scores need
    not be joined back, and perturbations of a pair that leave the same texts are scored once.
    """
    wanted = tokens.join(pairs.select("id"), "id", "left_semi")
    plan = perturbation_plan(impacts.join(pairs.select("id"), "id", "left_semi"), k, rounds, kind, seed, packed=True)
    if keeps_rows:
        start = start_scores.select("id", F.col("match_score").alias("start_pred"))
        words = wanted.select("id", "label", "l_toks", "r_toks")
        # sizes of arrays are estimated as one element's: no broadcast
        packed = plan.join(words.hint("merge"), "id").join(start.hint("merge"), "id")
        made = _perturbed_packed(packed, attrs, kind == "sufficiency", shared=True)
        carried = [F.col("id").alias("pair_id"), "label", "start_pred", "combs"]
        scores = rescore(made.select(F.struct(*carried).alias("id"), "label", *[side + a for side in (LEFT, RIGHT) for a in attrs]))
        rest = ["pair_id", "label", "start_pred", "new_pred"]
        every = exploded(scores.select("id.*", F.col("match_score").alias("new_pred")), rest, F.col("combs"), "c").select(*rest, "c.*")
        names = [f"{'MoRF' if kind == 'AOPC' else 'top'}_{s}" for s in range(1, k + 1)] + [f"random{i}_{s}" for i in range(1, rounds + 1) for s in range(1, k + 1)]
        return _compared(every.withColumn("comb_name", F.get(F.lit(names), F.col("comb_no") - 1)))
    perturbed = perturb_pairs(wanted, plan, impacts, attrs, keep=kind == "sufficiency")
    scores = rescore(perturbed.drop("pair_id", "comb_no", "comb_name", "expected_delta"))
    return perturbation_results(perturbed, scores, start_scores)


def evaluation_tables(results: DataFrame, units: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """All summary measures of an evaluation as ``measure, key, value``.

    ``other`` holds another explainer's word impacts (``id, attribute, pos, impact``); with it the
    mean correlation with the units' contributions is given, over the pairs that have one.
    """
    def rows(df: DataFrame, measure, key: str, value: str) -> DataFrame:
        name = F.lit(measure) if isinstance(measure, str) else measure
        return df.select(name.alias("measure"), F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))

    deltas, curve = delta_statistics(results), conciseness(units)
    parts = [
        rows(aopc(results), "aopc", "comb", "aopc"), rows(concordance(results), "concordance", "comb_name", "concorde"),
        rows(removal_performance(results), "delta_f1", "comb_name", "delta_f1"),
        rows(curve, F.concat(F.lit("pareto_"), F.lower("sign")), "pct", "share"),
        *[rows(deltas, f"delta_{s}", "comb_name", s) for s in ("size", "mean", "min", "max", "median")],
    ]
    if other is not None:
        ours = units_to_tokens(units).withColumn("impact", F.col("token_contribution"))
        found = explanation_correlation(ours, other).agg(F.avg("correlation").alias("mean"), F.count("correlation").alias("pairs"))
        both = found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in ("mean", "pairs")])).alias("x"))
        parts.append(rows(both.select("x.*"), "correlation", "key", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evaluation(
    pairs: DataFrame, tokens: DataFrame, units: DataFrame, start_scores: DataFrame, attrs: Sequence[str],
    rescore: Callable[[DataFrame], DataFrame], per_class: int | None = 100, k: int = 5, rounds: int = 3, seed: int = 0,
    other: DataFrame | None = None,
) -> DataFrame:
    """Perturb the pairs (``per_class`` of each label, all where it is None) and summarise.

    ``units`` carry ``impact`` and ``token_contribution``; ``other`` is as for ``evaluation_tables``.
    """
    chosen = pairs if per_class is None else per_class_sample(pairs, per_class, seed)
    mine = units.join(chosen.select("id"), "id", "left_semi")
    return evaluation_tables(evaluate_pairs(chosen, tokens, mine, start_scores, attrs, rescore, k, rounds, "AOPC", seed), mine, other)


# ---- metrics over perturbations ----------------------------------------------------------------

def aopc(results: DataFrame) -> DataFrame:
    """Mean over pairs of the mean score drop, for relevance order and for random order."""
    comb = F.when(F.col("comb_name").startswith("MoRF"), "MoRF").otherwise("random")
    per_pair = results.groupBy("id", comb.alias("comb")).agg((F.sum("detected_delta") / F.count("*")).alias("v"))
    return per_pair.groupBy("comb").agg(F.avg("v").alias("aopc"))


def sufficiency(results: DataFrame) -> DataFrame:
    """Mean over pairs of the share of perturbations that keep the class."""
    comb = F.when(F.col("comb_name").startswith("top"), "top").otherwise("random")
    same = ((F.col("start_pred") > 0.5) == (F.col("new_pred") > 0.5)).cast("double")
    per_pair = results.groupBy("id", comb.alias("comb")).agg(F.avg(same).alias("v"))
    return per_pair.groupBy("comb").agg(F.avg("v").alias("sufficiency"))


def concordance(results: DataFrame) -> DataFrame:
    """Share of perturbations whose score moved in the expected direction."""
    agree = ((F.col("detected_delta") > 0) == (F.col("expected_delta") > 0)).cast("double")
    return results.groupBy("comb_name").agg(F.avg(agree).alias("concorde"))


def delta_statistics(results: DataFrame) -> DataFrame:
    """Size, mean, median, least and greatest detected delta; a score delta lies in [-1, 1]."""
    plain = results.groupBy("comb_name").agg(
        F.count("*").alias("size"), F.avg("detected_delta").alias("mean"),
        F.min("detected_delta").alias("min"), F.max("detected_delta").alias("max"))
    return plain.join(exact_median(results, ["comb_name"], "detected_delta", -1.0, 1.0), "comb_name")


def removal_performance(results: DataFrame) -> DataFrame:
    """F1 before and after each kind of removal, and the loss."""
    before = binary_metrics(results, ["comb_name"], score="start_pred").select("comb_name", F.col("f1").alias("start_f1"))
    after = binary_metrics(results, ["comb_name"], score="new_pred").select("comb_name", F.col("f1").alias("new_f1"))
    return before.join(after, "comb_name").withColumn("delta_f1", F.col("start_f1") - F.col("new_f1"))


def explanation_correlation(ours: DataFrame, other: DataFrame, keys: Sequence[str] = ("id", "attribute", "pos")) -> DataFrame:
    """Correlation per pair between two sets of word impacts; NULL where one of them is constant.

    Impacts are rounded first, so that rounding noise does not count as variation.
    """
    a = ours.groupBy(*keys).agg(F.round(F.sum("impact"), 9).alias("x"))
    b = other.groupBy(*keys).agg(F.round(F.sum("impact"), 9).alias("y"))
    spread = F.nullif(F.stddev_pop("x") * F.stddev_pop("y"), F.lit(0.0))
    return a.join(b, list(keys)).groupBy("id").agg(
        (F.covar_pop("x", "y") / spread).alias("correlation"), F.count("*").alias("n_words"))


def pareto_curve(units: DataFrame, by_sign: bool = False, value: str = "token_contribution") -> DataFrame:
    """Per pair: share of the total absolute contribution held by the top k % of units."""
    keys = ["id", "sign"] if by_sign else ["id"]
    x = units.withColumn("x", F.abs(value))
    if by_sign:
        x = x.withColumn("sign", F.when(F.col(value) > 0, "Positive").otherwise("Negative"))
    order = Window.partitionBy(*keys).orderBy(F.desc("x"), "unit_no")
    whole = Window.partitionBy(*keys)
    ranked = x.select(
        *keys, F.row_number().over(order).alias("rn"), F.count("*").over(whole).alias("n"),
        F.sum("x").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.sum("x").over(whole).alias("total"))
    hits = F.filter(F.lit(list(PERCENTAGES)), lambda k: F.ceil(k * F.col("n") / 100) == F.col("rn"))
    return exploded(ranked, [*keys, "cum", "total"], hits, "pct").select(
        *keys, "pct", (F.col("cum") / F.nullif(F.col("total"), F.lit(0.0))).alias("share"))


def mean_curve(curve: DataFrame) -> DataFrame:
    keys = ["sign", "pct"] if "sign" in curve.columns else ["pct"]
    return curve.groupBy(*keys).agg(F.avg("share").alias("share"))


def conciseness(units: DataFrame) -> DataFrame:
    """Mean curves for positive and negative units and over all units."""
    total = mean_curve(pareto_curve(units)).select(F.lit("total").alias("sign"), "pct", "share")
    return mean_curve(pareto_curve(units, by_sign=True)).unionByName(total)
