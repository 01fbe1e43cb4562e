"""The pipeline against its stages in plain Python."""

import corpus_pipeline
from quayside.llm import bpe, decontam, language

from .test_lines import slow_groups
from .test_simhash import slow_kept


def test_pipeline_meets_brute_force(spark, sf_dir):
    from pyspark.sql import functions as F

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = {r["doc_id"]: r["text"] for r in table.collect()}
    model = language.train(table)
    docs = {d: t for d, t in docs.items() if model.predict(t or "")[1] >= language.LEAST_SCORE}

    keys = {r["doc_id"]: r["k"] for r in table.select("doc_id", F.xxhash64("text").alias("k")).collect()}
    groups = slow_groups([(d, keys[d], t) for d, t in docs.items()])
    gone = {(p[0], p[2]) for g in groups for p in g if p != min(g)}
    for d, t in list(docs.items()):
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)
        if left != t and not left.split():
            del docs[d]
        else:
            docs[d] = left

    docs = {min(g)[1]: min(g)[2] for g in slow_kept(list(docs.items())).values()}

    items = [decontam.words_of(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    held = lambda item, words: sum(set(item[i : i + 5]) <= set(words) and any(item[i : i + 5] == words[j : j + 5] for j in range(len(words))) for i in range(len(item) - 4)) / (len(item) - 4)
    dirty = {d for d, t in docs.items() if any(held(i, decontam.words_of(t)) >= 0.8 for i in items)}
    docs = {d: t for d, t in docs.items() if d not in dirty}

    path, pattern = bpe._public()
    codec = bpe.Codec(bpe.PerfectHash(bpe.read_ranks(path)), pattern)
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {d: len(codec.encode(t)) // 4 for d, t in docs.items()}


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_level_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_guard_leaves_the_rest(monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "quayside.llm.registry", None)
    assert "mp_dispatch" in entry.queries() and not any(n.startswith("op1_") or n == "pipeline" for n in entry.queries())
