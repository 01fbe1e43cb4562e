import hashlib
import json
from collections import defaultdict

import public_tokenizers
import pytest

from quayside.llm import alignment

from .cases import documents, nothing, prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def tokenizers():
    """For a text its A and B tokens (id, bytes), by the libraries on the whole text; None where the bytes do not come back."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    entry = {v: k for k, v in json.load(open(A))["model"]["vocab"].items()}
    plain = [c for c in range(256) if chr(c).isprintable() and c not in (32, 0xAD)]
    character = {c: chr(c) for c in plain} | {c: chr(256 + k) for k, c in enumerate(sorted(set(range(256)) - set(plain)))}
    byte = {v: k for k, v in character.items()}

    def tokens(text):
        if not text:
            return None
        of_a = [(i, bytes(byte[c] for c in entry[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        of_b = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            of_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (of_a, of_b) if b"".join(x for _, x in of_a) == whole == b"".join(x for _, x in of_b) else None

    return tokens


def spans(tokens):
    out, at = [], 0
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def slow(rows, tokens):
    """The rows of the alignment, from ends that both have and from all overlaps."""
    docs, counts = [], defaultdict(int)
    for i, text in rows:
        found = tokens(text)
        if found is None:
            docs.append((i, None))
            continue
        a, b = map(spans, found)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, links = [], []
        start, ka, kb = 0, 0, 0
        for cut in cuts:
            own_a = [x for x in a[ka:] if x[2] <= cut] if len(a) < 400 else _till(a, ka, cut)
            own_b = [x for x in b[kb:] if x[2] <= cut] if len(b) < 400 else _till(b, kb, cut)
            ka, kb = ka + len(own_a), kb + len(own_b)
            groups.append(",".join(str(x[0]) for x in own_a) + "|" + ",".join(str(x[0]) for x in own_b))
            links += [(x[0], y[0]) for x in own_a for y in own_b if x[1] < y[2] and y[1] < x[2]]
            start = cut
        assert start == a[-1][2]
        for p in set(links):
            counts[p] += 1
        docs.append((i, (len(a), len(b), groups, links)))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for i, found in docs:
        if found is None:
            out.append(str((i, 0, 0, 0, 0, 0, 0, "")))
        else:
            n_a, n_b, groups, links = found
            out.append(str((i, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest())))
    return sorted(out)


def _till(tokens, at, cut):
    end = at
    while end < len(tokens) and tokens[end][2] <= cut:
        end += 1
    return tokens[at:end]


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\ta\t", "one two three", "One two\nthree  four", "<|endoftext|> <s> </s> <0x41> <unk>", "▁a ▁", "漢字かな交じり文 テスト", "é́ ﬁ ½",
    "😀 x\u0085y z 　", "\x00\x01 \x1c \x1f", "it's they're ''s", "12345 1 23", "x" * 700, "日本語" * 200, "a b " * 50, "one two three", "internationalization antidisestablishmentarianism",
]


@pytest.mark.parametrize(("hot", "run"), [(alignment.HOT_PAIRS, alignment.RUN_CHARS), (10, 40), (1, 1)])
def test_against_whole_texts(spark, tokenizers, monkeypatch, hot, run):
    """Words one by one, in stretches of any length, and with any share of the pairs in a join: the same rows."""
    monkeypatch.setattr(alignment, "RUN_CHARS", run)
    rows = [*enumerate(TEXTS), (3, "one two three"), (None, "one two three"), (None, None)]
    texts = [t for _, t in rows]
    pair = alignment.TokenPair(open(A, "rb").read(), open(B, "rb").read())
    for t, (n_a, n_b, *_rest) in zip(texts, alignment._documents(pair, [t or "" for t in texts], False), strict=True):
        found = tokenizers(t)
        assert (n_a, n_b) == ((len(found[0]), len(found[1])) if found else (0, 0)), t
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 AS id", "2 AS row", "3 AS pairs", "4 AS n_a", "5 AS pair", "6 AS n")
    assert got(alignment.alignment(df, A, B, hot_pairs=hot)) == slow(rows, tokenizers)


def test_odd_documents(spark, tokenizers):
    df = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert got(alignment.alignment(df, A, B)) == slow(rows, tokenizers)


def test_groups_and_a_very_long_text(spark, tokenizers):
    """A text of several stretches, with odd spaces and a bad word in the last one of its copy."""
    import random

    text = prose(random.Random(2), 150_000) + "  tail"
    rows = [(1, text), (2, text + " ▁")]
    found = {r["id"]: r for r in alignment.aligned_tokens(spark.createDataFrame(rows, SCHEMA), A, B, with_groups=True).collect()}
    a, b = map(spans, tokenizers(text))
    assert (found[1]["n_a"], found[1]["n_b"]) == (len(a), len(b))
    groups = [g.split("|") for g in found[1]["groups"].split(";")]
    assert [int(x) for g in groups for x in g[0].split(",")] == [x[0] for x in a]
    assert [int(x) for g in groups for x in g[1].split(",")] == [x[0] for x in b]
    assert len(groups) == found[1]["n_groups"] == len({e for *_, e in a} & {e for *_, e in b})
    assert found[1]["groups_sha256"] == hashlib.sha256(found[1]["groups"].encode()).hexdigest()
    assert tuple(found[2])[1:] == (0, 0, 0, 0, "", b"", b"", "")


def test_pair_counts_in_pieces(spark):
    df = alignment.aligned_tokens(spark.createDataFrame([*enumerate(TEXTS)], SCHEMA).repartition(4), A, B)
    assert got(alignment.pair_counts(df, 3)) == got(alignment.pair_counts(df))


def test_empty_table(spark):
    assert alignment.alignment(nothing(spark), A, B).count() == 0


def test_query(spark, sf_dir, tokenizers):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got(alignment.op13_cross_tokenizer_alignment(spark, sf_dir).select(*columns)) == slow(rows, tokenizers)
