"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties, then calibrated by a temperature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, texts_of

#: Buckets of hashed n-grams.
BUCKETS = 1 << 16
#: Labelled texts that the weights are fitted on, expected for each language; the idf is of all of them.
FIT_TEXTS = 600
#: Of the fitted sample, one text in so many is kept for the temperature.
CALIBRATE_EVERY = 5
EPOCHS = 3
UNKNOWN = "und"
#: A letter of any script: class L alone, not the digits, fractions and numerals that Python's own classes count.
_LETTER = regex.compile(r"\p{L}").search


def grams(text: str) -> np.ndarray:
    """Buckets of all character 2- and 3-grams of a text in lower case, with a space before and after."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    pairs = points[:-1] * np.uint32(0x9E3779B1) + points[1:]
    triples = (pairs[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + points[2:]
    both = np.concatenate([pairs, triples])
    both ^= both >> np.uint32(15)
    both *= np.uint32(0x2C1B3C6D)
    return both >> np.uint32(16)


def labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, text, lang) of what may be learnt from: a language, and crc32 of the id as text not 2 modulo 4."""
    return docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS + 1, languages), times idf; the last row is the bias
    temperature: float

    def predict(self, text: str) -> tuple[str, float]:
        if not _LETTER(text):
            return UNKNOWN, 0.0
        own = grams(text)
        if len(own) < BUCKETS:
            mean = self.weights[own].mean(axis=0, dtype=np.float64)
        else:
            mean = np.bincount(own, minlength=BUCKETS) @ self.weights[:-1].astype(np.float64) / len(own)
        logits = (mean + self.weights[-1]) / self.temperature
        p = np.exp(logits - logits.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that hold each bucket, over all of train, and the number of texts.

    Each task adds up its own texts; what is shuffled and sent on has the size of the table of buckets.
    """

    def run(batches):
        df, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for text in texts_of(batch.column("text")):
                own = np.zeros(BUCKETS, dtype=bool)
                own[grams(text)] = True
                df += own
                n += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, BUCKETS)), pa.array(np.append(df[held], n))], names=["bucket", "texts"])

    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    for bucket, n in train.select("text").mapInArrow(run, "bucket long, texts long").groupBy("bucket").agg(F.sum("texts")).collect():
        out[bucket] = n
    return out[:-1], int(out[-1])


def _sample(train: DataFrame, per_language: int) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(lang, hash, buckets, shares) of about per_language texts of each language, chosen by a hash of id and text.

    The sample, like the model, has the size of the set of languages, not of the documents.
    """
    counts = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not counts:
        return []
    rate = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n)))), F.col("lang"))
    order = F.xxhash64("id", "text")
    chosen = train.withColumn("order", order).where(F.pmod(F.col("order"), F.lit(1 << 30)) < rate * (1 << 30))

    def run(batches):
        for batch in batches:
            found = [np.unique(grams(t), return_counts=True) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("order"), pa.array([b.astype(np.int32) for b, _ in found], pa.list_(pa.int32())), pa.array([(c / c.sum()).astype(np.float32) for _, c in found], pa.list_(pa.float32()))],
                names=["lang", "order", "buckets", "shares"],
            )

    rows = chosen.select("lang", "order", "text").mapInArrow(run, "lang string, order long, buckets array<int>, shares array<float>").toArrow()
    out = [(a.as_py(), k.as_py(), b.values.to_numpy(), s.values.to_numpy()) for a, k, b, s in zip(*(rows.column(c) for c in rows.column_names), strict=True)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-5, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (BUCKETS + 1, classes) by follow-the-regularised-leader with a rate for each coordinate."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for label, buckets, values in rows:
            at, x = np.append(buckets, BUCKETS), np.append(values, 1.0)
            w = weights(at)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1.0
            g = x[:, None] * p[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    return weights(np.arange(BUCKETS + 1))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search of its logarithm between 1/50 and 50."""

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())

    low, high, g = -np.log(50), np.log(50), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = FIT_TEXTS) -> Model | None:
    """A model learnt from all labelled rows (idf) and a bounded sample of them (weights); None without any."""
    rows = labelled(docs, id_col, text_col, lang_col)
    sample = _sample(rows, per_language)
    if not sample:
        return None
    df, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    languages = sorted({s[0] for s in sample})
    index = {lang: k for k, lang in enumerate(languages)}
    scale = 100.0  # shares of single n-grams are small
    points = [(index[lang], b, scale * s * idf[b]) for lang, _, b, s in sample]
    fitted = [x for k, x in enumerate(points) if k % CALIBRATE_EVERY] or points
    weights = fit_ftrl(fitted, len(languages))
    kept = [x for k, x in enumerate(points) if k % CALIBRATE_EVERY == 0]
    logits = np.stack([v @ weights[b] + weights[-1] for _, b, v in kept])
    temperature = fit_temperature(logits, np.array([x[0] for x in kept])) if len(languages) > 1 else 1.0
    weights[:-1] *= scale * idf[:, None]
    return Model(languages, weights.astype(np.float32), temperature)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' (id, lang_pred, score) for every row. und with score 0 where a text is null or has no letter, or there is no model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            found = [model.predict(t) if model else (UNKNOWN, 0.0) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


#: The pipeline rejects a document whose language has a lower score.
LEAST_SCORE = 0.5


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those of no language (no letter, no text) or of one with a score under LEAST_SCORE."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(train(docs))

    @F.pandas_udf("boolean")
    def known(texts):
        import pandas as pd

        model = shared.value
        return pd.Series([model is not None and model.predict(t or "")[1] >= LEAST_SCORE for t in texts], dtype=bool)

    return docs.where(known(F.col("text")))
