from plain import leaks
from pyspark.sql import functions as F

from kinweave.llm import decontaminate as B

ITEMS = [
    (1, "A train leaves the big station at 9 and travels 120 km before it meets Peter who waits with 9 bags."),
    (2, "Short one here."), (3, ""), (4, None), (5, "1 2 3 4 5 6 7 8 9 10 11 12"),
    (6, "Here Anna has 5 apples and gives 2 apples to Bert how many apples does Anna have now"),
]
DOCS = [
    (1, "Intro words. A train leaves the big station at 7 and travels 80 miles before it meets Maria who waits with 7 bags. End."),
    (2, "A train leaves the big station at 7 and travels 80 km before it meets Maria who waits with 8 bags."),
    (3, "nothing to see"), (4, None), (5, ""), (6, "so SHORT one, here"), (7, "short one there"),
    (8, "9 8 7 6 5 4 3 2 1 0 9 8 7 6"), (9, "20 21 22 23 24 25 26 27 28 29 30 31 and"),
    (10, "Here Clara has 7 apples and gives 3 apples to Dora how many apples does Clara have now"),
    (11, "Here Clara has 7 apples and gives 3 apples to Dora how many apples does Edith have now"),
    (12, "word " * 30_000), (None, "short one here"),
]


def result(df, items):
    return {(r.doc_id, r.item_id, r.at, r.covered) for r in B.leaks(df, items).collect()}


def test_reparameterised_questions(spark, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, item string")
    got = result(df, items)
    assert got == leaks(DOCS, ITEMS)
    pairs = {g[:2] for g in got}
    assert {(1, 1), (6, 2), (10, 6), (9, 5)} <= pairs and (2, 1) not in pairs and (11, 6) not in pairs
    kept = B.clean(df, items)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in DOCS} - {d for d, _ in pairs}
    monkeypatch.setattr(B, "BROADCAST_ROWS", -1)  # the way by shuffle
    assert result(df, items) == got


QUESTION = ("Maria takes a train from Boston to Albany and pays 1,200 dollars for 3 seats before Maria travels on from Albany "
            "to Buffalo with 45 other people")
CHANGED = [
    (1, QUESTION), (2, QUESTION.lower()), (3, QUESTION.upper()), (4, "We ask: " + QUESTION[0].lower() + QUESTION[1:]),
    (5, QUESTION.replace("Albany", "New York")), (6, QUESTION.replace("Boston", "Los Angeles")), (7, QUESTION.replace("Maria", "Anna Lee")),
    (8, QUESTION.replace("1,200", "12.5").replace("Maria", "Anna-Lee")),
    (9, QUESTION.replace("before Maria", "some time before Maria")),
    (10, "ask what is the capital of France"), (11, "Now What is the capital of Peru? I do not know"),
    (12, QUESTION.replace("Albany", "Troy", 1)), (13, "Some other people take a train to Albany with Maria and pay 3 dollars for it"),
]


def test_names_of_several_words_lower_case_and_inserted_words(spark):
    items = [(1, QUESTION), (2, "What is the capital of France?")]
    df = spark.createDataFrame(CHANGED, "doc_id long, text string")
    got = result(df, spark.createDataFrame(items, "item_id long, text string"))
    assert got == leaks(CHANGED, items)
    assert {g[0] for g in got if g[1] == 1} >= {1, 2, 3, 4, 5, 6, 7, 8, 9}
    assert {g[0] for g in got if g[1] == 2} == {10, 11} and not {13} & {g[0] for g in got}


def test_long_runs_of_names(spark):
    df = spark.createDataFrame([(1, "Names " + "Name " * 20_000), (2, "1." * 20_000)], "doc_id long, text string")
    rows = df.select(F.size(B.words_of(F.col("text")))).collect()
    assert [r[0] for r in rows] == [2501, 1]


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = result(docs, items)
    assert got == leaks([tuple(r) for r in docs.collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert got


def test_repeated_rows_and_empty(spark):
    items = spark.createDataFrame(ITEMS * 2, "item_id long, text string")
    df = spark.createDataFrame(DOCS * 2, "doc_id long, text string")
    assert result(df, items) == leaks(DOCS, ITEMS)
    assert B.leaks(df.limit(0), items).count() == 0
    assert B.leaks(df, items.limit(0)).count() == 0
    assert B.clean(df, items.limit(0)).count() == df.count()
