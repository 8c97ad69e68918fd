from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinweave.sources import tables as S


def test_unit_words_survive_csv(spark, tmp_path):
    words = ["NA", "null", "None", "", 'say "x"', "a,b", "nan"]
    units = spark.createDataFrame([(i, i, w, "[UNP]", 0.5, "name", "[UNP]", 1) for i, w in enumerate(words)], S.UNIT_SCHEMA)
    S.write_units_csv(units, str(tmp_path / "u"))
    assert sorted(r.left_word for r in S.read_units_csv(spark, str(tmp_path / "u")).collect()) == sorted(words)
    S.write_units(units, str(tmp_path / "p"))
    assert S.read_units(spark, str(tmp_path / "p")).count() == len(words)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    spark.createDataFrame([("x", 1, "b\nc")], "name string, id long, brand string").write.option("header", "true").csv(path)
    got = S.read_entities(spark, path, ["brand", "name"]).collect()[0]
    assert (got.id, got.brand, got["name"]) == (1, "b\nc", "x")


def test_line_breaks_are_kept(spark, tmp_path):
    values = ["plain", "b\nc", 'quote " and\nbreak', "carriage\rreturn", 'even ""', "last\n"]
    rows = [(i, i, v, "[UNP]", 0.5, "name", "[UNP]", 1) for i, v in enumerate(values)]
    units = spark.createDataFrame(rows, S.UNIT_SCHEMA)
    S.write_units_csv(units, str(tmp_path / "u"))
    assert S.spans_lines(spark, str(tmp_path / "u"))
    assert sorted(r.left_word for r in S.read_units_csv(spark, str(tmp_path / "u")).collect()) == sorted(values)
    flat = units.filter("left_word = 'plain'")
    S.write_units_csv(flat, str(tmp_path / "f"))
    assert not S.spans_lines(spark, str(tmp_path / "f"))
    S.write_metrics(units.select("id", "left_word"), str(tmp_path / "m"))
    got = S.read_metrics(spark, str(tmp_path / "m"), StructType.fromDDL("left_word string, id long"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((v, i) for i, v in enumerate(values))


def test_assembly_with_hot_entities(spark):
    entities = spark.range(10).select("id", F.concat(F.lit("e"), "id").alias("name"))
    links = spark.range(200).select("id", F.lit(3).cast("long").alias("left_id"), (F.col("id") % 12).alias("right_id"), F.lit(0).alias("label"))
    plain = S.assemble_pairs(links, entities, entities)
    hot = S.assemble_pairs(links, entities, entities, hot_rows=20)
    assert plain.exceptAll(hot).count() == 0 and plain.count() == hot.count() == links.filter("right_id < 10").count()
    used = S.used_entities(entities, [links.limit(4), links.filter("id = 7")], "right")
    assert sorted(r.id for r in used.collect()) == [0, 1, 2, 3, 7]


def test_explanations_are_marked(spark, tmp_path):
    one = spark.createDataFrame([(1, "w", 0.5)], "id long, word string, impact double")
    one.write.parquet(str(tmp_path / "p"))
    one.write.parquet(str(tmp_path / "n"))
    got = S.load_explanations(spark, str(tmp_path / "p"), str(tmp_path / "n"))
    assert sorted(r.polarity for r in got.collect()) == ["negative", "positive"]
    words = spark.createDataFrame([(1, "left_name", 0, 'w "x"\ny', 0.5)], S.EXPLANATION_SCHEMA)
    for side in ("p.csv", "n.csv"):
        words.write.options(**S.CSV_WRITE).csv(str(tmp_path / side))
    got = S.load_explanations(spark, str(tmp_path / "p.csv"), str(tmp_path / "n.csv"))
    assert sorted((r.id, r.word, r.impact, r.polarity) for r in got.collect()) == [(1, 'w "x"\ny', 0.5, "negative"), (1, 'w "x"\ny', 0.5, "positive")]
