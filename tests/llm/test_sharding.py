from collections import Counter, defaultdict

from kinweave.llm import sharding as S


def check(rows, df_rows, n_shards):
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in df_rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(slots.get(s, [])) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert set(slots) <= set(range(n_shards))


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = S.write_shards(df, 7, bucket_bytes=50_000)
    assert set(out.columns) == {*df.columns, "shard", "slot"}
    rows = out.collect()
    check(rows, df.collect(), 7)
    again = S.shuffled_shards(df, 7, bucket_bytes=50_000).collect()
    place = {r.doc_id: (r.shard, r.slot) for r in rows}
    assert place == {r.doc_id: (r.shard, r.slot) for r in again}  # a retried run deals alike
    ids = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert sum(b == a + 1 for a, b in zip(ids, ids[1:])) < len(ids) / 10


def test_places_do_not_hang_on_the_layout(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    places = []
    for parts, adaptive, split in (("8", "true", 1), ("64", "false", 9)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
        rows = S.shuffled_shards(df.repartition(split), 7, bucket_bytes=20_000).collect()
        places.append({r.doc_id: (r.shard, r.slot) for r in rows})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert places[0] == places[1] and len(places[0]) == df.count()
    other = S.shuffled_shards(df, 7, seed=1, bucket_bytes=20_000).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in other} != places[0]


def test_a_repeated_row_is_spread(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_COPIES", 100)
    rows = [(1, "same")] * 3000 + [(i, f"text {i}") for i in range(2, 3000)] + [(None, None)] * 700
    df = spark.createDataFrame(rows, "doc_id long, text string")
    h = S._spread(df, "h", 0, 1000).groupBy("doc_id", "text").agg({"h": "count", "*": "count"})
    assert h.filter("doc_id = 1").first()[2] == 3000
    spread = S._spread(df, "h", 0, 1000).filter("doc_id = 1 or doc_id is null")
    assert spread.select("h").distinct().count() == 3700
    out = S.shuffled_shards(df, 9, bucket_bytes=8000).collect()
    check(out, df.collect(), 9)


def test_nested_columns_and_bytes(spark):
    df = spark.createDataFrame([(1, None, [1, 2], {"a": 1}), (2, "xy", None, None)], "doc_id long, text string, l array<int>, m map<string,int>")
    assert [r[0] for r in df.select(S._bytes(df)).collect()] == [16 + len('{"l":[1,2]}') + len('{"m":{"a":1}}') , 16 + 2 + 2 + 2]
    out = S.shuffled_shards(df.drop("m"), 2).collect()
    assert {(r.doc_id, tuple(r.l or ())) for r in out} == {(1, (1, 2)), (2, ())}


def test_edge_cases(spark):
    rows = [(None, None), (None, "x"), (1, ""), (1, "same"), (1, "same"), (2, "y" * 300_000), (3, None)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, slot int")
    out = S.shuffled_shards(df, 4)
    assert out.columns == ["doc_id", "text", "shard", "slot"]
    check(out.collect(), df.collect(), 4)
    assert S.write_shards(df.limit(0), 4).count() == 0
