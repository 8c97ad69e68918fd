import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from kinweave.llm import prefix_trie as T
from kinweave.llm.oracles import ORACLES
from kinweave.llm.queries import conversation_trie, op13_conversation_prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The contract in plain Python: rows of ``conv_id, turn, role, text``."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))  # the remainder has the sign of the id, as in SQL
        seqs[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, finished = defaultdict(list), defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        finished[s].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(finished[p]))).encode()).hexdigest())
                  for p, m in members.items())


SCHEMA = "conv_id long, turn long, role string, text string, node string, block int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def got(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def shared(n, seed, deep=9):
    """Conversations over few texts, so that many prefixes are shared; some are longer than two blocks."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for k in range(rng.choice([1, 2, 3, 5, 8, deep])):
            rows.append((c * 7 % 601, k, rng.choice(["user", None]), rng.choice(["a", "", None, "žluť", "🙂x"]) if k > 2 else "start"))
    return rows


@pytest.mark.parametrize("width", [2, 8])
def test_shared_prefixes(spark, width):
    rows = shared(150, 3, 21)
    rows += [(900 + c, k, "user", f"t{k}") for c in range(40) for k in range(19)]  # copies
    rows += [(700, None, "user", "null turn"), (700, 0, "user", "x"), (None, 1, "user", "no id"), (-5, 0, None, None)]
    assert got(conversation_trie(frame(spark, rows), width)) == plain(rows)


def test_turnless_and_empty(spark):
    one = [(c, 0, "user", "only") for c in range(101, 160)]  # no base, and turns that the head takes away
    assert got(conversation_trie(frame(spark, one))) == plain(one)
    assert conversation_trie(frame(spark, one).limit(0)).count() == 0


def test_repeats_are_turns_and_very_long_text(spark):
    rows = [(3, 1, "user", "same")] * 3 + [(4, 1, "user", "same")] * 2 + [(5, 1, "user", "y" * 300_000)]
    assert got(conversation_trie(frame(spark, rows))) == plain(rows)


def test_query_against_sql_and_plain(spark, sf_dir):
    out = op13_conversation_prefix_trie(spark, sf_dir)
    rows = got(out)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    assert rows == plain(con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall())
    cur = con.execute(ORACLES["op13_conversation_prefix_trie"])
    assert [c[0] for c in cur.description] == COLUMNS
    assert rows == sorted(cur.fetchall())


def test_chunks_of_ends(spark):
    ids = list(range(0, 30_000, 3))
    df = spark.createDataFrame([(i, b"n") for i in reversed(ids)] + [(-7, b"m")], "conv_id long, node binary")
    found = {bytes(r.node): r.ends_sha256 for r in T.end_digests(df).collect()}
    assert found == {b"n": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"m": hashlib.sha256(b"-7").hexdigest()}
