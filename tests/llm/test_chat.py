import duckdb

from quayside.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def slow(rows, part_turns):
    turns = [(c, t or 0, s if s is not None else "unknown", x or "") for c, t, s, x in rows]
    out = []
    for conv in {t[0] for t in turns}:
        own = [t for t in turns if t[0] == conv]
        for me in {t[2] for t in own} - {"system"}:
            for part in {t[1] // part_turns for t in own}:
                text, mask = "", []
                said = sorted(t[1:] for t in own if t[1] // part_turns == part)
                for _, who, x in said:
                    text += "<|assistant|>\n" if who == me else "<|system|>\n" if who == "system" else f"<|user name={who}|>\n"
                    start = len(text)
                    text += x + "<|end|>\n"
                    if who == me:
                        mask.append((start, len(text) - 1))
                out.append(str((conv, part, me, len(said), text, mask)))
    return sorted(out)


ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hé 😀"), (1, 2, "bob", "yo"), (1, 3, "ann", None), (1, 3, "cid", "<|end|>\n"),
    (2, 0, "system", "alone"), (3, None, None, "who"), (3, 5, "user", ""), (None, 1, "x", "a"), (None, 2, "y", "b"), (1, 1, "ann", "hé 😀"),
]


def test_rotation(spark):
    turns = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS part", "'z' AS me", "'q' AS said", "0 AS conv", "'w' AS speaker", "0 AS mask")
    for part_turns in (512, 2):
        got = [str((r["conv"], r["part"], r["me"], r["n_turns"], r["rendered"], [(m["start"], m["end"]) for m in r["mask"]])) for r in chat.rotate(turns, part_turns=part_turns).collect()]
        assert sorted(got) == slow(ROWS, part_turns)


def test_masked_spans_hold_only_my_words(spark):
    for r in chat.rotate(spark.createDataFrame(ROWS, SCHEMA)).collect():
        for m in r["mask"]:
            assert r["rendered"][: m["start"]].endswith("<|assistant|>\n")
            assert r["rendered"][: m["end"]].endswith("<|end|>")


def test_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    expected = con.sql(chat.ORACLE_SQL).fetchall()
    columns = con.sql(chat.ORACLE_SQL).columns
    got = chat.op10_perspective_rotation(spark, sf_dir).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_empty_table(spark):
    assert chat.rotate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = chat.rotate(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
