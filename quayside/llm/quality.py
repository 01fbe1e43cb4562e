"""Quality rules as a ledger of failure bits: measured once, judged by any versioned policy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, texts_of, written

WINDOW_WORDS = 8
#: The rules in the order of their bits. Each is a condition on the measurements under which a text fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
#: Rules of the base verdict; every policy holds them.
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules that reject.
POLICIES: dict[int, tuple[str, ...]] = {
    1: BASE,
    2: (*BASE, "symbols", "repeated_lines"),
    3: (*BASE, "symbols", "repeated_lines", "short_words", "long_words"),
}
CURRENT = 3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

_SPACE, _WORD, _SYMBOL = 0, 1, 2
_KIND = np.full(256, _WORD, dtype=np.uint8)
_KIND[[0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)]] = _SPACE  # and bytes within a code point
_KIND[list(b"#*$%&|<>")] = _SYMBOL


def repeated_words(words: list[bytes], window: int = WINDOW_WORDS) -> int:
    """Words that lie in a window of so many words found twice or more, the first finding included."""
    n, m = len(words), len(words) - window + 1
    if m < 2:
        return 0
    own = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    with np.errstate(over="ignore"):
        rolled = np.zeros(m, dtype=np.uint64)
        for k in range(window):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + own[k : k + m]
            rolled ^= rolled >> np.uint64(29)
    order = np.argsort(rolled)
    equal = rolled[order[1:]] == rolled[order[:-1]]
    if not equal.any():
        return 0
    found = np.zeros(n + 1, dtype=np.int64)
    twice = np.zeros(m, dtype=bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    found[:m] += twice
    found[window : window + m] -= twice
    return int((np.cumsum(found)[:n] > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The values of MEASURES for one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    kinds = np.bincount(_KIND[np.frombuffer(raw, dtype=np.uint8)], minlength=3)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), int(kinds[_WORD] + kinds[_SYMBOL]), int(kinds[_SYMBOL]), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def mask_of(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, MEASURES, failure_bits) for every row: each rule evaluated once, bit k set if rule k fails.

    Null and empty texts have no words. Repeated rows keep their rows; other columns are not looked at.
    """

    def run(batches):
        for batch in batches:
            found = np.array([measure(t) for t in texts_of(batch.column("text"))], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c) for c in found.T)], names=["id", *MEASURES])

    kind = docs.schema[id_col].dataType.simpleString()
    measured = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = sum((F.when(F.expr(rule), 1 << k).otherwise(0) for k, rule in enumerate(RULES.values())), F.lit(0)).cast("long")
    return measured.withColumn("failure_bits", bits)


def passes(version: int, bits: Column | str = "failure_bits") -> Column:
    """Whether a policy keeps a text, from its ledger entry alone."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(mask_of(POLICIES[version])).cast("long")) == 0


def ablation(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: texts that fail it, that fail it alone, and that are kept without it.

    The ledger is counted once by its bits; with r rules there are at most 2**r counts, and the rest is
    bit arithmetic on those. A policy of an empty ledger gives its rules with zeros.
    """
    counts = entries.groupBy("failure_bits").agg(F.count(F.lit(1)).alias("texts"))
    rules = entries.sparkSession.createDataFrame([(r, mask_of((r,)), mask_of(POLICIES[version])) for r in POLICIES[version]], "rule string, bit long, mask long")
    held = F.col("failure_bits").bitwiseAND(F.col("mask"))
    total = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("texts"))), F.lit(0)).alias(name)
    joined = rules.join(counts, F.col("failure_bits").isNotNull(), "left")
    return joined.groupBy("rule").agg(
        total(held.bitwiseAND(F.col("bit")) != 0, "failed"),
        total(held == F.col("bit"), "failed_alone"),
        total(held.bitwiseAND(F.bitwise_not("bit")) == 0, "kept_without"),
    )


def without(rule: str, version: int = CURRENT) -> Column:
    """Whether a policy less one rule keeps a text."""
    return F.col("failure_bits").bitwiseAND(F.lit(mask_of(tuple(r for r in POLICIES[version] if r != rule))).cast("long")) == 0


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The stored ledger of documents under every policy. due_to names the rule without which the current policy would keep a text."""
    entries = written(ledger(table(spark, sf_dir, "documents")), "ledger")
    base_failed = F.col("failure_bits").bitwiseAND(F.lit(mask_of(BASE)).cast("long")) != 0
    due_to = F.when(~passes(CURRENT), F.coalesce(*(F.when(without(r), F.lit(r)) for r in POLICIES[CURRENT])))
    return entries.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & passes(CURRENT)).alias("kept"), "failure_bits", F.lit(CURRENT).alias("policy"),
        *(passes(v).alias(f"kept_v{v}") for v in POLICIES), due_to.alias("due_to"),
    )
