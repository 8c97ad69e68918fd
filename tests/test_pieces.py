import random

from kinweave.operators import pieces as P


def plain(word, pieces):
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            p = ("##" if at else "") + word[at:end]
            if p in pieces:
                out.append((p, at, end))
                at = end
                break
        else:
            return [("[UNK]", 0, len(word))]
    return out


def test_longest_match_first():
    rng = random.Random(1)
    for _ in range(60):
        pieces = {rng.choice(["", "##"]) + "".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(20)}
        trie = P.PieceTrie(pieces)
        for _ in range(30):
            w = "".join(rng.choices("abc", k=rng.randint(0, 12)))
            assert trie.cut(w) == plain(w, pieces)
    assert P.PieceTrie(["##", "a"]).cut("##") == [("##", 0, 2)]


def test_word_vectors(spark):
    pieces = spark.createDataFrame([("un", [1.0, 0.0]), ("##like", [0.0, 1.0]), ("##ly", [3.0, 3.0]), ("like", [9.0, 9.0])], "piece string, vec array<float>")
    words = spark.createDataFrame([(1, 0, "unlike"), (1, 1, "unlikely"), (1, 2, "xyz"), (2, 0, "like"), (2, 1, ""), (2, 2, None)], "id long, pos int, word string")
    rows = {(r.id, r.pos, r.piece_no): (r.piece, r.start, r.end) for r in P.word_pieces(words, pieces).collect()}
    assert rows[1, 1, 2] == ("##ly", 6, 8) and rows[1, 2, 0] == ("[UNK]", 0, 3) and len(rows) == 7
    got = {(r.id, r.pos): (r.n_pieces, r.vec) for r in P.piece_word_vectors(words, pieces, 2).collect()}
    assert got == {(1, 0): (2, [0.5, 0.5]), (1, 1): (3, [4 / 3, 4 / 3]), (1, 2): (1, [0.0, 0.0]), (2, 0): (1, [9.0, 9.0])}


def test_pieces_are_not_the_broadcast_side(spark, tmp_path):
    """The part table is the smaller file here, but its pieces are the many rows."""
    from checks.queries import pieces

    spark.createDataFrame([(i, "red bolt", "Brand#1") for i in range(20)], "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(2000).selectExpr("id as vec_id", "array(cast(id as float), rand(1), rand(2), rand(3)) as embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = pieces(spark, str(tmp_path))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert {(r.piece, r.vec[0]) for r in found.collect()} == {("red", 3.0), ("bol", 3.0), ("##t", 3.0), ("bra", 3.0), ("##nd#1", 6.0)}
