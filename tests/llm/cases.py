"""Small tables with everything that can be odd about documents."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = "id bigint, fp bigint, key bigint, root string, row int, lines string, hash int, spans int, of_id int, start int, kind string, component int, rows int, size int, term string, item_id string, score string, path string, line int, best int"


def prose(rng, words, vocabulary=None):
    vocabulary = vocabulary or [a + b + c for a in ("ther", "on", "ing", "re") for b in ("an", "th", "ed", "") for c in ("er", "s", "ly", "ation")]
    return " ".join(rng.choice(vocabulary) for _ in range(words))


def texts():
    rng = random.Random(5)
    long = prose(rng, 30_000)
    base = prose(rng, 80)
    words = base.split()
    return [
        base, base, " ".join(words[:40] + ["changed"] + words[41:]), " ".join(words[:10] + ["x", "y"] + words[10:]),
        None, "", " \t\n", "one", "two words", "One Two three", long, long[:-4] + "end", "é" * 50 + " ü ñ 漢字 😀\x85\x1c\x1d  ok",
        "\n".join([prose(rng, 12)] * 3), base + "\n" + prose(rng, 9), "a" * 20_000, "\x00 zero", "...!!!", prose(rng, 60), prose(rng, 61),
    ]


def documents(spark, clash=True):
    langs = ["en", "en", None, "de", "en"]
    rows = [(i, t, langs[i % 5], f"src{i % 3}" if i % 7 else None, len(t) if t is not None else None) for i, t in enumerate(texts())]
    rows += [rows[0], rows[0], (None, texts()[0], "en", "src0", 5), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if clash:
        from pyspark.sql import functions as F

        for c in CLASHING.split(", "):
            name, kind = c.split()
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
