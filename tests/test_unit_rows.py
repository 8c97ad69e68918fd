import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import queries as Q
from kinweave.functions.numbers import rounded_column, rounded_values
from kinweave.operators import contributions as K
from kinweave.operators import features as A
from kinweave.operators import scoring as N


def values() -> np.ndarray:
    rng = np.random.default_rng(0)
    ties = rng.integers(-10_000_000, 10_000_000, 3000) / 1e6 + 5e-7
    return np.concatenate([rng.normal(size=3000), ties, np.nextafter(ties, 9), np.nextafter(ties, -9), rng.normal(size=500) * 1e-6,
                           rng.normal(size=500) * 1e13, [0.0, -0.0, -1e-9, 5e-7, -5e-7, 1.0000005, 2.5e-6, np.nan, np.inf, -np.inf, 1e300]])


def test_rounding_is_that_of_sql(spark):
    x = values()
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select(
        "x", F.round("x", 6).alias("sql"), rounded_column(F.col("x"), 6).alias("fast")).toPandas()
    for have in (got["fast"].to_numpy(), rounded_values(got["x"].to_numpy(), 6)):
        assert np.array_equal(have, got["sql"].to_numpy(), equal_nan=True)
        assert not np.signbit(have[have == 0]).any()
    assert spark.range(1).select(rounded_column(F.lit(None).cast("double"), 6).alias("x")).first().x is None


@pytest.mark.parametrize("mode", ["proportional", "softmax", "index"])
def test_shares_of_packed_pairs_are_those_of_membership_rows(spark, sf_dir, mode):
    keys = ["id", "unit_no", "scope", "grp"]
    rows = {tuple(r)[:4]: tuple(r)[4:] for r in K.shares(Q.members(spark, sf_dir), A.STATS, mode).select(*keys, *[f"sh_{i}" for i in range(7)]).collect()}
    made = K.shares(Q.scored_pairs(spark, sf_dir), A.STATS, [mode], Q.ATTRS)
    got = [tuple(r) for r in made.filter(F.col("mode") == mode).select(*keys, *[f"sh_{i}" for i in range(7)]).collect()]
    assert len(got) == len(rows) and all(np.allclose(r[4:], rows[r[:4]], atol=1e-12) for r in got)


def test_shares_and_contributions_leave_the_task_as_rows(spark, sf_dir):
    for query in (Q.w4, Q.w8, Q.w9):
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Window [" not in plan.split("MapInArrow")[0] and "Generate" not in plan.split("MapInArrow")[0]


def test_parts_keep_ids_numbers_and_null_scores(spark):
    units = [(f"p{i}", 10 * j + 3, "[UNP]" if j % 3 == 2 else "a", "[UNP]" if j % 3 == 1 else "b", "[UNP]" if j % 3 == 2 else "x",
              "[UNP]" if j % 3 == 1 else "x", None if (i, j) == (4, 1) else 0.1 + 0.07 * ((i + 3 * j) % 11)) for i in range(9) for j in range(i % 5 + 1)]
    rows = spark.createDataFrame(units, "id string, unit_no long, left_word string, right_word string, left_attribute string, right_attribute string, pred double")
    packed = A.packed_units(rows)
    known = {(u[0], u[1]): u[6] for u in units}
    made = K.shares(packed, ["sum"], "index", ["x"]).filter("scope = 'allattr' and grp = 'all'").collect()
    assert {(r.id, r.unit_no): r.sh_0 for r in made} == known
    every = {tuple(r)[:3]: r.value for r in K.contributions_long(rows, ["x"]).collect()}
    some = {tuple(r)[:3]: r.value for r in K.contributions_long(rows, ["x"], digits=1).collect()}
    assert some == {k: v for k, v in zip(every, rounded_values(np.array(list(every.values())), 1)) if v != 0} and len(some) < len(every)
