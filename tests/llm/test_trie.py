import hashlib
import math
import random
import zlib

import duckdb
import pytest

from quayside.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def by_conversation(rows):
    """Turns (role, text) of each conversation in their order."""
    told = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            told.setdefault(c, []).append(((t is not None, t or 0), hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), (r, x)))
    return {c: [s for *_, s in sorted(v)] for c, v in told.items()}


def rebuilt(told):
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in told}
    return {c: told.get(c - int(math.fmod(c, 20)), [])[: h[c]] + own[h[c] :] for c, own in told.items()}


def words(text):
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return sum(map(bool, text.split(" ")))


def slow(told):
    """All nodes by looking at every prefix of every conversation."""
    members = {}
    for c, s in told.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members)]
        children = sum(len(q) == len(p) + 1 for q in below)
        saved = sum((len(members[q]) - 1) * (words(q[-1][1]) if q else 0) for q in below)
        ends = ",".join(str(c) for c in sorted(own) if len(told[c]) == len(p))
        out.append(str((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())))
    return sorted(out)


def got(df):
    columns = ["conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(str(tuple(r[c] for c in columns)) for r in df.collect())


def conversations(seed, n=60, deep=40):
    """Few distinct turns, so that prefixes are shared; copies, a deep pair, conversations of no turns of their own."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(400), n):
        for t in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "", None, "é 漢\x0bz", "a b"])))
    for c in (1001, 1002):
        rows += [(c, t, "user", f"{t} {'x' if c == 1001 or t < deep - 5 else 'y'}") for t in range(deep)]
    rows += [(c, t, "user", "same thing") for c in range(500, 540) for t in range(3)]
    rows += [(None, 1, "user", "nobody's"), (7001, None, "b", "x"), (7001, None, "a", "x"), (7001, 0, "a", "x"), (7001, 0, "a", "x"), (-45, 3, "u", "v"), (-40, 3, "u", "v")]
    rng.shuffle(rows)
    return rows


CLASHING = ["*", "1 AS conv", "2 AS place", "'d' AS digest", "3 AS words", "4 AS h", "5 AS base", "6 AS path", "7 AS key", "8 AS depth"]


@pytest.mark.parametrize(("least", "most"), [(4096, 500_000), (50, 60), (1, 1)])
def test_against_all_prefixes(spark, least, most):
    """In one band, in several, and level by level: the same nodes."""
    rows = conversations(4)
    turns = trie.families(trie.ordered_turns(spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr(*CLASHING)))
    if most == 1:
        turns = turns.where("conv < 1000")
        told = {c: s for c, s in rebuilt(by_conversation(rows)).items() if c < 1000}
    else:
        told = rebuilt(by_conversation(rows))
    assert got(trie.prefix_trie(turns, least, most)) == slow(told)


def test_without_families(spark):
    rows = conversations(8, 30, 12)
    assert got(trie.prefix_trie(trie.ordered_turns(spark.createDataFrame(rows, SCHEMA)))) == slow(by_conversation(rows))


def test_many_copies_end_at_one_node(spark):
    """More ids than one piece holds are hashed in numerical order."""
    df = spark.range(3000).selectExpr("id * 7 - 5000 AS conv_id", "0 AS turn", "'user' AS role", "'hi' AS text")
    top = trie.prefix_trie(trie.ordered_turns(df)).where("depth = 1").first()
    assert top["n_ends"] == 3000
    assert top["ends_sha256"] == hashlib.sha256(",".join(str(i * 7 - 5000) for i in range(3000)).encode()).hexdigest()


def test_a_very_long_conversation(spark):
    """30,000 turns take as many rounds as a few."""
    df = spark.range(30_000).selectExpr("1 AS conv_id", "id AS turn", "'user' AS role", "'hi' AS text").union(spark.range(3).selectExpr("2", "id", "'user'", "'hi'"))
    nodes = trie.prefix_trie(trie.ordered_turns(df))
    assert nodes.count() == 30_001
    assert tuple(nodes.where("depth = 0").selectExpr("conv", "n_convs", "n_leaves", "saved_tokens").first()) == (1, 2, 1, 3)


def test_bands_follow_the_turns_not_the_depth():
    assert trie.bands({}) == []
    assert trie.bands({0: 5}) == []
    assert trie.bands({3: 10}) == [(0, 3)]
    assert trie.bands({3: 10, 5: 5}, 1, 1) == [(4, 5), (3, 4), (2, 3), (1, 2), (0, 1)]
    deep = trie.bands({8: 1_000_000, 100_000: 2})
    assert len(deep) < 20 and deep[-1][0] == 0
    assert all(a[0] == b[1] for a, b in zip(deep, deep[1:], strict=False))


def test_empty_table(spark):
    assert trie.prefix_trie(trie.families(trie.ordered_turns(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    found = con.sql(trie.ORACLE_SQL)
    got = trie.op11_conversation_trie(spark, sf_dir).select(*found.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, found.fetchall()))
