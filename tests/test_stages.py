import json

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from kinweave.operators.align import Thresholds
from kinweave.plans.datasets import part_pairs
from kinweave.plans.pipeline import MatcherPipeline
from kinweave.plans.reuse import StagedMatcher
from kinweave.sources.stages import MANIFEST, StageStore, described


def manifest(stage):
    return f"{stage.path.rsplit('/', 1)[0]}/{MANIFEST}"


def numbers(spark, made):
    made.append(1)
    return spark.range(20).withColumn("x", F.col("id") * 2)


def test_second_run_reads_and_changes_compute_again(spark, tmp_path):
    made = []
    spark.range(5).write.parquet(str(tmp_path / "in"))

    def run(settings, version="1"):
        store = StageStore(spark, str(tmp_path / "store"), version)
        src = store.source("in", str(tmp_path / "in"))
        return store.table("numbers", lambda: numbers(spark, made), [src], settings)

    first, second = run({"a": 1}), run({"a": 1})
    assert (first.reused, second.reused, len(made)) == (False, True, 1)
    assert sorted(first.df.collect()) == sorted(second.df.collect()) and second.df.count() == 20
    assert not run({"a": 2}).reused and not run({"a": 1}, "2").reused and len(made) == 3
    spark.range(6).write.mode("append").parquet(str(tmp_path / "in"))
    assert not run({"a": 1}).reused and len(made) == 4


@pytest.mark.parametrize("tear", ["no manifest", "half a manifest", "lost file", "short file"])
def test_torn_writes_are_made_again(spark, tmp_path, tear):
    made = []
    store = StageStore(spark, str(tmp_path))
    run = lambda: store.table("numbers", lambda: numbers(spark, made))
    first = run()
    at = tmp_path / "numbers" / first.fingerprint / MANIFEST
    part = next(p for p in (tmp_path / "numbers").rglob("*.parquet"))
    if tear == "no manifest":
        at.rename(tmp_path / "aside")
    elif tear == "half a manifest":
        at.write_text(at.read_text()[:40])
        at.with_name(f".{MANIFEST}.crc").unlink(missing_ok=True)
    elif tear == "lost file":
        part.rename(tmp_path / "aside")
    else:
        part.write_bytes(part.read_bytes()[:-3])
    again = run()
    assert (again.reused, len(made), again.df.count()) == (False, 2, 20)
    assert run().reused and json.loads(at.read_text())["data"] == again.path


def test_the_first_of_two_writers_is_read(spark, tmp_path):
    store, other = StageStore(spark, str(tmp_path)), StageStore(spark, str(tmp_path))

    def slow():
        other.table("t", lambda: spark.range(3).withColumn("by", F.lit("other")))
        return spark.range(3).withColumn("by", F.lit("self"))

    assert {r.by for r in store.table("t", slow).df.collect()} == {"other"}


def test_empty_table_prune_and_settings(spark, tmp_path):
    store = StageStore(spark, str(tmp_path))
    run = lambda n: store.table("t", lambda: spark.range(n).filter("id < 0"), settings=n)
    assert run(1).df.count() == 0 and run(1).reused
    run(2)
    later = StageStore(spark, str(tmp_path))
    later.table("t", lambda: spark.range(1), settings=2)
    assert len(later.prune()) == 1 and not run(1).reused and run(2).reused
    with pytest.raises(FileNotFoundError):
        store.source("none", str(tmp_path / "none"))
    with pytest.raises(TypeError):
        described(object())
    assert described(LogisticRegression(maxIter=3)) == described(LogisticRegression(maxIter=3)) != described(LogisticRegression())
    assert described(Thresholds()) != described({})


def test_matcher_finds_its_stages(spark, sf_dir, tmp_path):
    pairs = part_pairs(spark, sf_dir)
    vocab = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vec"))
    for name, df in {"train": pairs.filter("id % 2 = 0"), "test": pairs.filter("id % 2 = 1"), "vocab": vocab}.items():
        df.write.parquet(str(tmp_path / name))

    def run(**settings):
        store = StageStore(spark, str(tmp_path / "store"))
        train, test = (store.source(n, str(tmp_path / n)) for n in ("train", "test"))
        m = StagedMatcher(store, MatcherPipeline(**settings))
        model = m.fit(train)
        scores = {r.id: round(r.match_score, 9) for r in m.predict(test).scores.collect()}
        return [m.words(train), m.units(train), m.units(test), model], scores

    first, scores = run()
    again, same = run()
    assert [s.reused for s in first][-1] is False and all(s.reused for s in again) and same == scores
    plain = MatcherPipeline().fit(spark.read.parquet(str(tmp_path / "train")))
    direct = plain.predict(spark.read.parquet(str(tmp_path / "test"))).scores.collect()
    assert {r.id: round(r.match_score, 9) for r in direct} == scores
    changed, _ = run(thresholds=Thresholds(0.8, 0.8, 0.8))
    assert changed[0].fingerprint == first[0].fingerprint  # words do not hang on the thresholds
    assert not changed[3].reused and {s.fingerprint for s in changed[1:]}.isdisjoint(s.fingerprint for s in first[1:])


def test_vectors_and_scorer_are_found_again(spark, sf_dir, tmp_path):
    from checks.queries import pairs, vocabulary

    pairs(spark, sf_dir).write.parquet(str(tmp_path / "pairs"))
    vocabulary(spark, sf_dir).write.parquet(str(tmp_path / "vocab"))

    def run():
        store = StageStore(spark, str(tmp_path / "store"))
        src, vocab = store.source("pairs", str(tmp_path / "pairs")), store.source("vocab", str(tmp_path / "vocab"))
        m = StagedMatcher(store, MatcherPipeline(vector_size=64), vocab)
        model = m.fit(src)
        return m.vectors(src), model, {r.id: round(r.match_score, 6) for r in m.predict(src).scores.collect()}

    (_, _, a), (vectors, model, b) = run(), run()
    assert vectors.reused and model.reused and a == b and len(a) > 100
