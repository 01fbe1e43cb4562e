import zlib
from collections import Counter

from quayside.llm import sharding

from . import cases


def test_slots_are_gapless_and_sizes_right(spark):
    docs = cases.documents(spark)
    placed = sharding.records(docs)
    entries = sharding.first_map(sharding.slot_sizes(placed), 5)
    got = sharding.assign(placed, entries).collect()
    rows = docs.select("doc_id", "text").collect()
    expected = sorted(str((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode()))) for r in rows)
    assert sorted(str((r["id"], r["size"], r["text_crc32"])) for r in got) == expected
    for shard in {r["shard"] for r in got}:
        own = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert own == list(range(len(own)))


def test_near_equal_bytes_and_growth(spark, tmp_path):
    sizes = [(100 + 7 * (i % 13), 2) for i in range(sharding.SLOTS)]
    before = sharding.first_map(sizes, 40)
    loads = [sum(e[3] for e in before if e[2] == s) for s in range(40)]
    assert max(loads) - min(loads) <= max(s for s, _ in sizes)
    after = sharding.grown_map(before)
    moved = [(b[2], a[2]) for b, a in zip(before, after) if a[2] != b[2]]
    assert moved and {a for _, a in moved} == {40}
    grown = [sum(e[3] for e in after if e[2] == s) for s in range(41)]
    assert max(grown) - min(grown) <= 3 * max(s for s, _ in sizes)
    path = str(tmp_path / "map")
    sharding.save_map(spark, before, path)
    sharding.save_map(spark, after, path)
    assert sharding.load_map(spark, path) == after and sharding.load_map(spark, path, 0) == before


def test_empty_table(spark):
    placed = sharding.records(cases.nothing(spark))
    assert sharding.assign(placed, sharding.first_map(sharding.slot_sizes(placed))).count() == 0


def test_query_places_every_document_once(spark, sf_dir):
    """The query's rows against sizes, checksums and the law by plain Python, and its two maps against each other."""
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = sharding.op4_virtual_slot_shards(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {d: (len(t) + 16, zlib.crc32(t)) for d, t in docs.items()}
    assert len(got) == len(docs) and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}

    own, loads = {}, Counter()
    for r in got:
        own.setdefault(r["virtual_slot"], []).append(r)
        loads[r["shard"]] += r["size"]
    assert all(len({(r["shard"], r["grown_slot_shard"]) for r in rows}) == 1 for rows in own.values())
    # slots by falling bytes, each where least is so far
    filled, expected = Counter({s: 0 for s in range(40)}), {}
    for slot in sorted(own, key=lambda v: (-sum(r["size"] for r in own[v]), v)):
        expected[slot] = min(filled, key=lambda s: (filled[s], s))
        filled[expected[slot]] += sum(r["size"] for r in own[slot])
    assert {v: rows[0]["shard"] for v, rows in own.items()} == expected and filled == loads
    for shard in range(40):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    moved = [r for r in got if r["grown_slot_shard"] != r["shard"]]
    assert moved and {r["grown_slot_shard"] for r in moved} == {40} and sum(r["size"] for r in moved) <= sum(loads.values()) / 41
