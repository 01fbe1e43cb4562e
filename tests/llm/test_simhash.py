import random

import numpy as np
import pytest
import xxhash

from quayside.llm import graph, simhash

from . import cases


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, radius):
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= radius:
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_fingerprints_and_components(spark):
    docs = cases.documents(spark)
    got = {}
    for r in simhash.near_duplicates(docs).collect():
        got.setdefault(r["id"], set()).add((r["fp"] % 2**64, r["component"]))
    rows = [(r["doc_id"], slow_fingerprint(r["text"])) for r in docs.select("doc_id", "text").collect()]
    roots = slow_components({f for _, f in rows}, 4)
    least = {}
    for i, f in rows:
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    expected = {}
    for i, f in rows:
        expected.setdefault(i, set()).add((f, least[roots[f]]))
    assert got == expected
    assert simhash.near_duplicates(docs).count() == len(rows)


def test_words_split_as_in_the_contract():
    import re

    for text in cases.texts():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert [w.decode() for w in (text or "").encode().split()] == words


def test_long_texts_count_in_pieces():
    text = cases.prose(random.Random(1), 3000)
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("bucket", [2048, 16])
@pytest.mark.parametrize("rows", [100, 10**7])
def test_no_link_is_lost(spark, monkeypatch, bucket, rows):
    """Random fingerprints with dense clusters; with small buckets the hot ones are split into blocks."""
    monkeypatch.setattr(graph, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(graph, "CHUNK_SQUARE", 8)
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(4):
        f = rng.getrandbits(64)
        for _ in range(90):
            g = f
            for _ in range(rng.randint(0, 3)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
            if rng.random() < 0.1:
                f = g
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    pivots = simhash.Pivots(4, rows)
    edges = graph.near_forest(spark.createDataFrame(signed, "fp bigint"), pivots.keys, pivots.linked)
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in graph.components(edges).collect()}
    expected = slow_components(fps, 4)
    groups = lambda of: {frozenset(f for f in fps if of.get(f, f) == r) for r in {of.get(f, f) for f in fps}}
    assert groups(roots) == groups(expected)


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 500, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)
    pivots = simhash.Pivots(4, 10**6)
    n = len(a)
    assert pivots.linked(np.append(a, b))(np.arange(n), np.arange(n) + n).all()
    assert (pivots.keys(a) == pivots.keys(b)).any(axis=1).all()


def test_a_chain_has_one_root(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    roots = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert roots == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def shingles_of(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b)


def slow_kept(rows):
    """(doc_id, text) of the rows that stay, by shingle similarity of all pairs."""
    texts = list({t if t and t.split() else "" for _, t in rows})
    sets = [shingles_of(t) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= 0.8:
                up[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for d, t in rows:
        groups.setdefault(find(texts.index(t if t and t.split() else "")), set()).add((d is None, d, t))
    return groups


def test_stage_keeps_one_of_each_group(spark):
    docs = cases.documents(spark, clash=False)
    kept = simhash.dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [(r["doc_id"] is None, r["doc_id"], r["text"]) for r in kept.collect()]
    groups = slow_kept(rows)
    assert len(got) == len(groups)
    for group in groups.values():
        least = min((unnamed, d or 0) for unnamed, d, _ in group)
        assert [(g[0], g[1] or 0) for g in got if g in group] == [least]


def test_stage_tells_documents_of_one_id_apart(spark):
    rng = random.Random(4)
    a, b, c = (cases.prose(rng, 90) for _ in range(3))
    for rows, expected in (
        ([(1, a), (5, b), (5, a)], {(1, a), (5, b)}),
        ([(None, a), (None, c), (1, a)], {(1, a), (None, c)}),
        ([(2, a), (2, a), (3, a + " more")], {(2, a)}),
    ):
        docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], cases.SCHEMA)
        got = [(r["doc_id"], r["text"]) for r in simhash.dedup_stage(spark, docs, "").collect()]
        assert len(got) == len(set(got)) and set(got) == expected


def test_near_copies_by_shingle_similarity_alone(spark):
    """Recall against similarity alone, for texts of 30 to 600 words with words changed, put in, left out or cut off."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows, pairs = [], []
    for k in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([30, 60, 120, 240, 600]))]
        other = list(words)
        for _ in range(rng.randint(1, max(1, len(words) // 45))):
            at, kind = rng.randrange(len(other)), rng.random()
            if kind < 0.5:
                other[at] = rng.choice(vocabulary)
            elif kind < 0.7:
                other.insert(at, rng.choice(vocabulary))
            elif kind < 0.9:
                del other[at]
            else:
                other = other[: -max(1, len(other) // 20)]
        x, y = " ".join(words), " ".join(other)
        rows += [(2 * k, x, "en", "s", 0), (2 * k + 1, y, "en", "s", 0)]
        if similarity(shingles_of(x), shingles_of(y)) >= 0.8:
            pairs.append(k)
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    got = {r["doc_id"] for r in simhash.dedup_stage(spark, docs, "").collect()}
    assert {r[0] for r in rows} - got <= {2 * k + 1 for k in pairs}
    found = sum(2 * k + 1 not in got for k in pairs)
    assert len(pairs) > 150 and found >= 0.95 * len(pairs), (found, len(pairs))


def edited(rng, words, vocabulary):
    """A list of words with one word changed, put in or left out, at either end or within."""
    at, kind = rng.choice([0, rng.randrange(len(words)), len(words) - 1]), rng.random()
    return words[:at] + ([rng.choice(vocabulary)] if kind < 0.7 else []) + words[at + (0.3 < kind) :]


@pytest.mark.parametrize("bucket", [2048, 8])
def test_short_texts_are_grouped_as_by_brute_force(spark, monkeypatch, bucket):
    """Every pair of short texts with the similarity is found, also where many share an opening and buckets are split."""
    monkeypatch.setattr(graph, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(simhash, "GROUP_ROWS", bucket)
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    opening, texts = [rng.choice(vocabulary) for _ in range(9)], []
    for k in range(400):
        words = (opening if k % 10 == 0 else []) + [rng.choice(vocabulary) for _ in range(rng.randint(1, 34))]
        texts += [words, edited(rng, words, vocabulary)]
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 0) for k, t in enumerate(texts)], cases.SCHEMA)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    groups = slow_kept(rows)
    assert len(groups) < 700
    assert {r["doc_id"] for r in simhash.dedup_stage(spark, docs, "").collect()} == {min(g)[1] for g in groups.values()}


def test_short_keys_share_one_and_sketches_differ_little():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(500)]
    met = 0
    for _ in range(2000):
        a = [rng.choice(vocabulary) for _ in range(rng.randint(1, simhash.SHORT_WORDS - 1))]
        b = edited(rng, a, vocabulary)
        x, y = (shingles_of(" ".join(t)) for t in (a, b))
        if x and y and similarity(x, y) >= 0.8:
            (k, s, n), (l, t, m) = (simhash.short_keys(" ".join(w), 5, 0.8) for w in (a, b))
            met += 1
            assert (n, m) == (len(x), len(y)) and set(k) & set(l) and 9 * (s ^ t).bit_count() <= n + m
    assert met > 200
    assert simhash.short_keys("", 5, 0.8) == simhash.short_keys("w " * 45, 5, 0.8) == ([], 0, 0)
    assert simhash.short_keys("w " * 44, 5, 0.8)[2] == 1


def test_query_is_that_of_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: slow_fingerprint(r["text"]) for r in rows}
    roots = slow_components(set(prints.values()), 4)
    least = {}
    for d, f in prints.items():
        least[roots[f]] = min(d, least.get(roots[f], d))
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.op2_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == {(d, f"{f:016x}", least[roots[f]]) for d, f in prints.items()}


def test_empty_table(spark):
    assert simhash.near_duplicates(cases.nothing(spark)).count() == 0
    assert simhash.dedup_stage(spark, cases.nothing(spark), "").count() == 0


@pytest.mark.parametrize("most", [1, 3, 65_536])
@pytest.mark.parametrize("kind", ["bigint", "binary"])
def test_components_in_chunks_of_any_size(spark, monkeypatch, most, kind):
    monkeypatch.setattr(graph, "TASK_EDGES", most)
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-60, 60, (70, 2))] + [(200 + i, 200 + i + 1) for i in range(12)]
    node = (lambda x: x) if kind == "bigint" else (lambda x: bytes([x % 256, x // 256 % 256]))
    edges = [(node(a), node(b)) for a, b in pairs]
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, f"a {kind}, b {kind}").repartition(3)).collect()}
    assert {k if kind == "bigint" else bytes(k): v if kind == "bigint" else bytes(v) for k, v in got.items()} == {x: r for x, r in up.items() if any(a != b and x in (a, b) for a, b in edges)}


def test_a_graph_of_one_chunk_takes_no_rounds(spark, monkeypatch):
    """A chain of 300 in 5 tasks takes several rounds of shuffles otherwise, which cost most of a run on many partitions."""
    names, keep = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: names.append(name) or keep(df, name))
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b").repartition(5)
    assert graph.components(edges).where("root = 0").count() == 301 and names == ["edges", "small"]


def test_pairs_of_equal_keys(monkeypatch):
    monkeypatch.setattr(graph, "SQUARE_PAIRS", 200)
    rng = np.random.default_rng(2)
    keys = np.sort(np.concatenate([rng.integers(0, 40, 150), np.full(33, 50), np.full(31, 51), np.full(90, 52)]))
    values = rng.integers(0, 5, len(keys))
    found = [p for i, j in graph.same_key_pairs(keys, lambda i, j: values[i] == values[j]) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert sorted(found) == [(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if keys[i] == keys[j] and values[i] == values[j]]
    assert list(graph.same_key_pairs(keys[:0], lambda i, j: values[i] == values[j])) == []
