import hashlib
import random
from array import array

import pytest

from quayside.llm import bpe

from . import cases

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    path, pattern = bpe._public()
    tokens = bpe.read_ranks(path)
    own = bpe.Codec(bpe.PerfectHash(tokens), pattern)
    return own, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_perfect_hash_is_minimal_and_exact(both):
    perfect = both[0].perfect
    assert sorted(perfect.slot_id) == list(range(perfect.n))
    assert all(perfect.find(t) == i for i, t in enumerate(perfect.tokens))
    assert perfect.find(b"surely not a token of it") == -1


def test_encodes_as_tiktoken(both):
    own, theirs = both
    rng = random.Random(2)
    alphabet = "aAéñßあ漢字²Ⅷ٣_ '\n\t\r\x0b\x1c\x85\xa0　’!#1290́😀ªµºǅzs"
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text in [*odd, *(t for t in cases.texts() if t), "a" * 3000, "ab" * 3000, " " * 500 + "x", "it's we'll I'd"]:
        ids = own.encode(text)
        assert ids == array("I", theirs.encode_ordinary(text)).tobytes()
        assert own.decode(ids) == text.encode()


def test_memo_limit_changes_nothing(both, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    both[0].clear()
    assert both[0].encode(cases.texts()[0]) == array("I", both[1].encode_ordinary(cases.texts()[0])).tobytes()


def test_operator(spark, both):
    docs = cases.documents(spark)
    got = sorted(map(str, bpe.encode_decode(docs, *bpe._public(), with_ids=True).collect()))
    expected = []
    for r in docs.select("doc_id", "text").collect():
        ids = both[1].encode_ordinary(r["text"] or "")
        raw = array("I", ids).tobytes()
        expected.append((r["doc_id"], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest(), ids))
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    from pyspark.sql import Row

    assert got == sorted(str(Row(**dict(zip(names, e)))) for e in expected)
    assert bpe.encode_decode(cases.nothing(spark), *bpe._public()).count() == 0
