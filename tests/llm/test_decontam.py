import random
from collections import Counter

import numpy as np
import pytest

from quayside.llm import decontam

from . import cases

BENCH = "item_id bigint, text string"


def slow_prints(words, size):
    hashes = decontam.WordHashes().of(words).tolist()
    return [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes[i : i + size]) > size) for i in range(len(words) - size + 1)]


@pytest.mark.parametrize("size", [1, 3, 5, 7, 20, 28, 300])
def test_window_prints(size):
    words = decontam.words_of(cases.prose(random.Random(1), 330))
    begins = np.arange(len(words) - size + 1)
    got = decontam.window_prints(decontam.bit_sums(decontam.WordHashes().of(words)), begins, begins + size)
    assert got.tolist() == slow_prints(words, size)


def test_blocks_lose_nothing_within_the_radius():
    rng = np.random.default_rng(2)
    items = [(i, cases.prose(random.Random(i), 22)) for i in range(50)]
    index = decontam.Index(items)
    anchors = index.anchors[22][0]
    prints = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    prints[:400] = anchors[rng.integers(0, len(anchors), 400)]
    for _ in range(decontam.RADIUS):
        prints[:400] ^= np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)
    got = set(zip(*(x.tolist() for x in index.near(22, prints))))
    assert got == {(i, j) for i, p in enumerate(prints.tolist()) for j, a in enumerate(anchors.tolist()) if (p ^ a).bit_count() <= decontam.RADIUS}


def slow_held(item, passage):
    k = min(5, len(item))
    own = Counter(tuple(item[i : i + k]) for i in range(len(item) - k + 1))
    there = Counter(tuple(passage[i : i + k]) for i in range(len(passage) - k + 1))
    weight = lambda s: sum(map(len, s))
    return sum(weight(s) * min(n, there[s]) for s, n in own.items()) / sum(weight(s) * n for s, n in own.items())


def test_planted_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    items = [(i, cases.prose(rng, n, vocabulary)) for i, n in enumerate([3, 5, 9, 14, 27, 40, 59, 150])]
    plain = [cases.prose(rng, 200, vocabulary) for _ in range(20)]
    rows, planted = [(i, t, "en", "s", 0) for i, t in enumerate(plain)], set()
    for i, text in items:
        words = text.upper().split()
        doc = cases.prose(rng, 30, vocabulary) + "\n" + ", ".join(words) + ". " + cases.prose(rng, 40, vocabulary)
        rows.append((100 + i, doc, "en", "s", 0))
        planted.add((100 + i, i))
    for i in (5, 6, 7):  # a word of the middle changed
        words = items[i][1].split()
        words[len(words) // 2] = "changed"
        rows.append((200 + i, plain[0] + " " + " ".join(words), "en", "s", 0))
        planted.add((200 + i, i))
    docs, bench = spark.createDataFrame(rows, cases.SCHEMA), spark.createDataFrame(items + [(90, None), (91, ""), (92, "...")], BENCH)
    got = {(r["id"], r["item_id"]): r for r in decontam.contaminated(docs, bench).collect()}
    assert set(got) == planted
    texts = {r[0]: decontam.words_of(r[1]) for r in rows}
    for (d, i), r in got.items():
        item, at = decontam.words_of(items[i][1]), r["first_word"]
        slack = decontam.SLACK if len(item) >= 5 else 0
        assert r["similarity"] == pytest.approx(slow_held(item, texts[d][max(at - slack, 0) : at + len(item) + slack]))


def test_long_texts_are_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 100)
    rng = random.Random(6)
    item = cases.prose(rng, 40)
    for at in (0, 61, 95, 99, 100, 180, 500):
        words = cases.prose(rng, 600).split()
        text = " ".join(words[:at] + item.split() + words[at:])
        found = decontam.search([text, "", text], decontam.Index([(1, item)]), decontam.WordHashes())
        assert [(f[0], f[1], f[2], f[3]) for f in found] == [(0, 1, 1.0, at), (2, 1, 1.0, at)]


def test_slices_and_odd_tables(spark):
    docs = cases.documents(spark)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(cases.texts()[:4])], BENCH)
    whole = sorted(map(str, decontam.contaminated(docs, bench).collect()))
    parts = []
    for shared in decontam.indexes(bench, slice_items=1):
        parts.append(len(shared.value.items))
    assert sum(parts) == 4 and len(parts) > 1
    assert len(whole) > 4
    assert decontam.contaminated(cases.nothing(spark), bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("n", [16, 22, 30, 42, 58, 81, 113])
def test_no_passage_that_holds_enough_is_lost(n):
    """Against brute force over all windows: items cut short, at the end of a text, and with scattered edits."""
    rng = random.Random(n)
    due = 0
    for k in range(40):
        item = cases.prose(rng, n)
        words = item.split()
        if k % 2:
            words = words[: n - rng.randint(0, n // 6)]
        else:
            for _ in range(rng.randint(0, max(n // 30, 1))):
                words[rng.randrange(n)] = "changed"
        if k % 5 == 0:
            words.insert(n // 3, "added")
        after = [] if k % 4 == 1 else cases.prose(rng, 50).split()
        text = " ".join(cases.prose(rng, 50).split() + words + after)
        own, there = decontam.words_of(item), decontam.words_of(text)
        size = len(own) + 2 * decontam.SLACK
        most = max(slow_held(own, there[at : at + size]) for at in range(max(len(there) - decontam.SHINGLE_WORDS + 1, 1)))
        found = decontam.search([text], decontam.Index([(1, item)]), decontam.WordHashes())
        assert bool(found) == (most >= decontam.LEAST_SIMILARITY), (k, most)
        due += most >= decontam.LEAST_SIMILARITY
    assert due > 12


def edited(rng, words, n):
    """A passage less some words at its ends, with words changed, put in or left out: near the least similarity."""
    kind = rng.randrange(4)
    words = list(words)
    if kind == 0:
        words = words[: n - rng.randint(0, n // 5)]
    elif kind == 1:
        words = words[rng.randint(0, n // 5) :]
    for _ in range(rng.randint(0, max(n // 25, 1)) if kind > 1 else 0):
        at = rng.randrange(len(words))
        if kind == 2:
            words[at] = "changed"
        elif rng.random() < 0.5:
            words.insert(at, "added")
        elif len(words) > 3:
            del words[at]
    return words


def test_recall_of_every_length():
    """Against brute force over all windows; the figure stands in the README."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    due, found, wrong = 0, 0, 0
    for n in range(5, 61):
        items = [cases.prose(rng, n, vocabulary) for _ in range(10)]
        texts = []
        for item in items:
            around = [cases.prose(rng, k, vocabulary).split() for k in (40, rng.choice([0, 40]))]
            texts.append(" ".join(around[0] + edited(rng, item.split(), n) + around[1]))
        got = {(t, i) for t, i, _, _ in decontam.search(texts, decontam.Index(list(enumerate(items))), decontam.WordHashes())}
        for t, text in enumerate(texts):
            there, own = decontam.words_of(text), decontam.words_of(items[t])
            size = n + 2 * decontam.SLACK
            holds = max(slow_held(own, there[at : at + size]) for at in range(max(len(there) - 4, 1))) >= decontam.LEAST_SIMILARITY
            due, found = due + holds, found + (holds and (t, t) in got)
            wrong += ((t, t) in got) > holds
        assert all(t == i for t, i in got)
    print(due, found)
    assert due > 250 and found >= 0.97 * due and wrong == 0, (due, found, wrong)


def test_stage_on_odd_tables(spark, tmp_path):
    docs = cases.documents(spark)
    bench = spark.createDataFrame([(1, cases.texts()[0]), (2, None), (None, cases.texts()[10])], BENCH)
    for rows, name in ((bench, "some"), (bench.limit(0), "none")):
        rows.write.parquet(str(tmp_path / name / "benchmark.parquet"))
    ids = [r["doc_id"] for r in docs.collect()]
    kept = decontam.decontamination_stage(spark, docs, str(tmp_path / "some"))
    hit = {r["id"] for r in decontam.contaminated(docs, bench).collect()}
    assert kept.columns == docs.columns and {0, 1, 10, 11} <= hit
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(str, got)) == sorted(str(i) for i in ids if i is not None and i not in hit) + ["None"]  # the null text
    assert decontam.decontamination_stage(spark, docs, str(tmp_path / "none")).count() == len(ids)
    assert decontam.decontamination_stage(spark, cases.nothing(spark), str(tmp_path / "some")).count() == 0
