import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quayside.llm import graph, lines

from . import cases


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abé ", max_size=25), st.text("abé ", max_size=25))
def test_edit_distance(a, b):
    d = levenshtein(a, b)
    assert lines.edit_distance(a, b) == d
    assert all((lines.edit_distance(a, b, most) <= most) == (d <= most) for most in (0, 2, 5, 10))


def slow_word(word):
    h = int(lines.mixed(np.array([sum(int(lines._BYTES[c]) * lines._STEP**i for i, c in enumerate(word)) % 2**64], dtype=np.uint64))[0])
    return h | 1 if len(word) >= lines.VOTING_BYTES else h & ~1


def slow_print(words):
    voting = [w for w in set(words) if len(w) >= lines.VOTING_BYTES] or list(set(words))
    own = [int(lines.mixed(np.array([slow_word(w)], dtype=np.uint64))[0]) for w in voting]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))


@pytest.mark.parametrize("block", [1_000_000, 50])
def test_lines_of_many_texts_at_once(monkeypatch, block):
    monkeypatch.setattr(lines, "BLOCK_BYTES", block)
    texts = [t or "" for t in cases.texts() if len(t or "") < 5000] + ["a b c d\x01 e\n\n f g h i j k", "of an it is on", "\n", ""]
    by_line, n = {}, 0
    by_end = {}
    for t, k, h, fp, ends, size in zip(*lines.lines_of(texts)):
        words = tuple(lines.normal(texts[t]).split(b"\n")[k].split())
        assert len(words) == size > 0 and int(fp) % 2**64 == slow_print(list(words))
        assert by_line.setdefault(words, tuple(h)) == tuple(h)
        own = slow_ends(words)
        assert len(own) == (ends != 0).sum() and all(by_end.setdefault(e, set()) is not None for e in own)
        for e, key in zip(own, ends[ends != 0].tolist()):
            by_end[e].add(key)
        n += 1
    assert all(len({h[c] for h in by_line.values()}) == len(by_line) for c in (0, 1))
    assert all(len(x) == 1 for x in by_end.values()) and len({min(x) for x in by_end.values()}) == len(by_end) > 4
    assert n == sum(len(x.split()) > 0 for t in texts for x in lines.normal(t).split(b"\n"))
    assert all(len(x) == 0 for x in lines.lines_of(["", " .", "\n"]))


def slow_ends(words):
    """The words at the beginning and at the end of a line, as many as a step, and as the step below just above one."""
    steps = [k for k in lines.END_WORDS if 2 * k <= len(words)]
    chosen = steps[-1:] + [k for k in steps[-2:-1] if 4 * len(words) < 10 * steps[-1]]
    return [(side, words[:k] if side == 0 else words[-k:]) for k in chosen for side in (0, 1)]


def slow_groups(docs, radius=lines.RADIUS, wide=lines.WIDE_RADIUS):
    """Occurrences of lines, and the groups of their normalised forms, by comparing all with all."""
    places = {}
    for doc_id, key, text in docs:
        for k, words in enumerate(x.split() for x in lines.normal(text or "").split(b"\n")):
            if words:
                places.setdefault(b" ".join(words).decode(), []).append((doc_id, key, k))
    forms = list(places)
    prints = [slow_print(f.encode().split()) for f in forms]
    ends = [set(slow_ends(tuple(f.encode().split()))) for f in forms]
    up = list(range(len(forms)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    def near(i, j):
        apart = (prints[i] ^ prints[j]).bit_count()
        return min(len(forms[k].split()) for k in (i, j)) >= lines.LEAST_WORDS and (apart <= radius or apart <= wide and ends[i] & ends[j])

    for i in range(len(forms)):
        for j in range(i):
            if near(i, j) and lines.numbers(forms[i]) == lines.numbers(forms[j]) and levenshtein(forms[i], forms[j]) <= 0.2 * max(len(forms[i]), len(forms[j])) + 1e-9:
                up[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, f in enumerate(forms):
        groups.setdefault(find(i), set()).update(places[f])
    return list(groups.values())


def corpus(rng):
    vocabulary = [a + b for a in ("there", "onward", "ingot", "reading", "ly") for b in ("an", "the", "ed", "x", "")]
    pool = [cases.prose(rng, rng.choice([3, 6, 20, 60]), vocabulary) for _ in range(25)]
    for k in range(15):
        words = pool[rng.randrange(25)].split()
        words[rng.randrange(len(words))] = "changed"
        pool.append(" ".join(words) + "!" * k)
    return [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))) for i in range(40)]


@pytest.mark.parametrize("bucket", [2048, 4])
def test_drops_are_those_of_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(graph, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(lines, "GROUP_ROWS", bucket)
    monkeypatch.setattr(graph, "CHUNK_SQUARE", 2)
    rows = corpus(random.Random(8)) + [(90, None), (91, ""), (92, "\n\n")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], cases.SCHEMA)
    keys = {r["doc_id"]: r["k"] for r in docs.select("doc_id", F.xxhash64("text").alias("k")).collect()}
    groups = slow_groups([(i, keys[i], t) for i, t in rows])
    expected = {(p[0], p[2], min(g)[0], min(g)[2]) for g in groups for p in g if p != min(g)}
    got = {(r["id"], r["line"], r["kept_id"], r["kept_line"]) for r in lines.repeated_lines(docs).collect()}
    assert len(expected) > 20 and got == expected


def test_texts_without_their_repeats(spark):
    line, other = "one line of many plain words", "another line of quite different sounding text"
    rows = [(1, f"{line}\nshort\n{other}", "en", "s", 99), (2, f"{line}\nown words are kept right here\nShort.", "en", "s", 99), (3, f"{line.upper()}.\n{other}", "en", "s", 99), (4, "brief\n--\nbrief\n--", "en", "s", 14), (5, None, None, None, None)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    assert lines.dedup_lines(docs).columns == docs.columns
    assert set(got) == {1, 2, 4, 5}
    assert got[1]["text"] == rows[0][1] and got[1]["n_chars"] == 99
    assert got[2]["text"] == "own words are kept right here" and got[2]["n_chars"] == len(got[2]["text"])
    assert got[4]["text"] == "brief\n--\n--" and got[4]["n_chars"] == 11 and got[5]["text"] is None


def test_odd_tables(spark):
    docs = cases.documents(spark)
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    ids = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert {None, 4, 5, 6, 7, 8, 10, 18, 19} <= ids and not {0, 1} & ids  # a null id comes first
    assert lines.dedup_lines(cases.nothing(spark)).count() == 0


def test_query_counts(spark, sf_dir):
    got = {r["doc_id"]: r for r in lines.op9_fuzzy_line_dedup(spark, sf_dir).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert set(got) == set(docs)
    assert all(r["n_lines"] == docs[d].count("\n") + 1 and r["n_dropped"] == len([x for x in r["dropped_lines"].split(",") if x]) for d, r in got.items())


def test_lines_that_differ_in_numbers_stay(spark):
    said = ["Revenue in {} was {} million dollars", "{} {} 17 20 35 41 58", "the yearly count of ships at this quay in {} came to {} in all"]
    rows = [(k, "\n".join(s.format(2010 + k, 100 + 7 * k) for s in said), "en", "s", 0) for k in range(6)]
    rows += [(9, rows[2][1].upper().replace("COUNT OF", "count  of"), "en", "s", 0)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    got = {(r["id"], r["line"], r["kept_id"], r["kept_line"]) for r in lines.repeated_lines(docs).collect()}
    assert got == {(9, k, 2, k) for k in range(3)}
    assert {r["doc_id"] for r in lines.dedup_lines(docs).collect()} == set(range(6))


@pytest.mark.parametrize("line", ["今天的天气非常好我们去公园散步", "この記事を共有してください。", "สวัสดีครับยินดีต้อนรับ", "five\u00a0words\u3000of\u2009one\u00a0line"])
def test_lines_of_scripts_without_spaces_take_part(line):
    text, _, own, *_ = lines.lines_of([line, "other words are said right here", f"  {line}!"])
    own = list(map(tuple, own.tolist()))
    assert text.tolist() == [0, 1, 2] and own[0] == own[2] != own[1]
    assert lines.normal(line, apart=False).decode().replace(" ", "") == lines.normal(line).decode().replace(" ", "")


def edited(rng, words, vocabulary):
    words = list(words)
    for _ in range(rng.choice([1, 1, 1, 2])):
        at = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.5:
            words[at] = rng.choice(vocabulary)
        elif kind < 0.75:
            words.insert(at, rng.choice(vocabulary))
        elif len(words) > 5:
            del words[at]
    return words


def test_near_copies_by_edit_similarity_alone(spark):
    """Recall against edit similarity alone, for copies with a word or two changed, put in or left out."""
    rng = random.Random(11)
    vocabulary = cases.prose(rng, 4000).split() + ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    pairs = []
    for _ in range(400):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(12, 60))]
        other = edited(rng, own, vocabulary)
        if lines.similar(" ".join(own), " ".join(other)):
            pairs.append((" ".join(own), " ".join(other)))
    rows = [(2 * k + side, pair[side], "en", "s", 0) for k, pair in enumerate(pairs) for side in (0, 1)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    got = {(r["id"], r["kept_id"]) for r in lines.repeated_lines(docs).collect()}
    assert all(a // 2 == b // 2 for a, b in got)
    found = sum((2 * k + 1, 2 * k) in got or pairs[k][0] == pairs[k][1] for k in range(len(pairs)))
    assert len(pairs) > 350 and found >= 0.9 * len(pairs), found / len(pairs)


def test_texts_of_very_many_lines(spark):
    """200,000 lines, most of them repeated, and as many near lines in a second text: each text is split once, not once for each line."""
    import time

    whole = "\n".join(f"row {i % 1000} of the ledger" if i % 4 else "" for i in range(200_000))
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    near = [" ".join(rng.choice(words) for _ in range(14)) for _ in range(6000)]
    changed = [x.rsplit(" ", 1)[0] + " other" for x in near]
    rows = [(1, whole, "en", "s", len(whole)), (2, "\n".join(near), "en", "s", 0), (3, "\n".join(changed), "en", "s", 0)]
    started = time.monotonic()
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, cases.SCHEMA)).collect()}
    assert time.monotonic() - started < 120
    firsts, seen = [], set()
    for x in whole.split("\n"):
        if not x or x not in seen:
            firsts.append(x)
            seen.add(x)
    assert got[1] == "\n".join(firsts)
    assert got[2] == "\n".join(near)
    assert 3 not in got or len(got[3].split("\n")) < 600


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["ab", "c", "défg", "", "hij"]), max_size=12), st.lists(st.sampled_from(["ab", "c", "défg", "", "hij"]), max_size=12))
def test_edits_of_words_are_no_fewer_than_of_characters(x, y):
    a, b = " ".join(x), " ".join(y)
    edits, d = lines.words_apart(a, b), levenshtein(a, b)
    assert edits >= d and (edits == 0) == (a == b)
    for most in (0, 2, 5, 10):
        assert (lines.words_apart(a, b, most) <= most) == (edits <= most)
        assert lines.similar(a, b) == (d <= 0.2 * max(len(a), len(b)) + 1e-9)


def test_words_that_are_changed_put_in_or_left_out_are_told_at_once(monkeypatch):
    """Most lines that are alike need no edit distance; one that does would fail here."""
    monkeypatch.setattr(lines, "edit_distance", None)
    words = [f"word{i}" for i in range(40)]
    line = " ".join(words)
    for changed in (words[:3] + ["other"] + words[4:30] + ["else"] + words[31:], words[:5] + words[6:], words[:5] + ["more"] + words[5:20] + words[21:], words[1:], [*words, "end"]):
        assert lines.similar(line, " ".join(changed))
