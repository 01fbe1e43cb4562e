import re
from collections import Counter

from quayside.llm import quality

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def test_measures_and_bits(spark):
    docs = cases.documents(spark)
    expected = sorted(str((r["doc_id"], *slow(r["text"] or ""))) for r in docs.select("doc_id", "text").collect())
    entries = quality.ledger(docs)
    assert sorted(str(tuple(r)[:-1]) for r in entries.collect()) == expected
    for r in entries.collect():
        few = r["n_words"] < 20
        assert bool(r["failure_bits"] & 1) == few
        assert bool(r["failure_bits"] & 2) == (100 * r["n_repeat_words"] > 30 * r["n_words"])
    assert quality.ledger(cases.nothing(spark)).count() == 0


def test_repeats_and_symbols():
    text = ("a b c d e f g h i " * 3 + "é# $x\n") * 2 + "\n \nline\nline\n"
    assert quality.measure(text) == slow(text)


def test_policies_and_ablation(spark):
    entries = spark.createDataFrame([(i, b) for i, b in enumerate([0, 0, 1, 2, 3, 4, 5, 8])], "id bigint, failure_bits bigint")
    assert entries.where(quality.passes(1)).count() == 4 and entries.where(quality.passes(2)).count() == 2
    got = {r["rule"]: r for r in quality.ablation(entries, 2).collect()}
    for rule in quality.POLICIES[2]:
        bit, mask = quality.mask_of((rule,)), quality.mask_of(quality.POLICIES[2])
        bits = [r["failure_bits"] for r in entries.collect()]
        assert got[rule]["failed"] == sum(bool(b & bit) for b in bits)
        assert got[rule]["failed_alone"] == sum(b & mask == bit for b in bits)
        assert got[rule]["kept_without"] == sum(b & mask & ~bit == 0 for b in bits)
    assert {r["failed"] for r in quality.ablation(entries.limit(0)).collect()} == {0}


def test_labelled_good_documents_stay(spark, sf_dir):
    kept = {r["doc_id"]: r for r in quality.op8_quality_rules(spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    good = [r["doc_id"] for r in labels if r["quality"] == 1 and not kept[r["doc_id"]]["base_failed"]]
    bad = [r["doc_id"] for r in labels if r["quality"] == 0]
    assert all(kept[d]["kept"] for d in good)
    assert sum(not kept[d]["kept"] for d in bad) >= 0.9 * len(bad)


def test_query_applies_every_policy_and_ablation(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    bit = lambda r: quality.mask_of((r,))
    for r in quality.op8_quality_rules(spark, sf_dir).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == slow(texts[r["doc_id"]])[:5]
        for version, rules in quality.POLICIES.items():
            assert r[f"kept_v{version}"] == (not any(r["failure_bits"] & bit(x) for x in rules))
        failed = [x for x in quality.POLICIES[quality.CURRENT] if r["failure_bits"] & bit(x)]
        assert r["due_to"] == (failed[0] if len(failed) == 1 else None)
