import math
from collections import Counter

import pytest

from quayside.llm import licenses

from . import cases

MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
PROSE = "nothing to see here but many plain words of no licence kind at all in this text"
FILES = [
    ("a/LICENSE", MIT), ("a/x.txt", PROSE), ("a/b/y.txt", PROSE), ("a/b/c/LICENSE.md", f"{PROSE}\n{GPL}"), ("a/b/c/d/z.txt", PROSE),
    ("a/b/c/own.txt", f"{PROSE}\n{MIT}\n{PROSE}"), ("top.txt", PROSE), ("e/short.txt", GPL), ("e/other.txt", PROSE), ("e/f/g.txt", None),
    (None, PROSE), ("ab/x.txt", PROSE), ("a/b/LICENSE", PROSE), ("e/zz.txt", MIT),
]


def frame(spark):
    rows = [(i, t, p) for i, (p, t) in enumerate(FILES)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, path string").selectExpr("*", "1 AS row", "'x' AS folder", "'y' AS license", "0 AS cosine", "2 AS size", "3 AS best")


def slow_cosines(texts):
    n = len(texts)
    vocabulary = {t for _, x in licenses.TEMPLATES for t in licenses.terms(x)}
    df = Counter(t for x in texts for t in set(licenses.terms(x or "")) & vocabulary)
    idf = lambda t: math.log((1 + n) / (1 + df[t])) + 1 if t in vocabulary else math.log(1 + n) + 1
    vector = lambda x: {t: c * idf(t) for t, c in Counter(licenses.terms(x)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))

    def best(line):
        own = vector(line)
        marks = {t for t in own if t.isdigit() or t in licenses.MARKS}
        fits = lambda x: set(licenses.marks(x)) <= marks and (marks & set(licenses.MARKS)) <= set(licenses.marks(x))
        return max(((round(sum(own.get(t, 0) * x for t, x in v.items()) / norm(own) / norm(v), 9), name) for name, v in ((k, vector(x)) for k, x in licenses.TEMPLATES if fits(x))), default=(0, None))

    return best


def test_notices_and_inheritance(spark):
    got = {r["id"]: r for r in licenses.scan(frame(spark), "path").collect()}
    best = slow_cosines([t for _, t in FILES])
    assert got[0]["own_license"] == "MIT" and got[0]["cosine"] == pytest.approx(best(MIT)[0]) == pytest.approx(1)
    assert got[3]["own_license"] == "GPL-3.0" and got[3]["license_file"]
    assert got[5]["own_license"] == "MIT" and not got[5]["license_file"]
    expect = {1: "MIT", 2: "MIT", 4: "GPL-3.0", 6: None, 8: "GPL-3.0", 9: "GPL-3.0", 10: None, 11: None}
    assert {i: got[i]["license"] for i in expect} == expect
    assert got[4]["inherited_from"] == "a/b/c" and got[5]["license"] == "MIT" and got[5]["inherited_license"] == "GPL-3.0"
    assert not got[12]["license_file"]
    assert len(got) == len(FILES)


def test_query_against_brute_force(spark, sf_dir):
    import re

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    best = slow_cosines([r["text"] for r in docs.values()])
    got = {r["doc_id"]: r for r in licenses.op1_license_scan(spark, sf_dir).collect()}
    assert set(got) == set(docs)
    for d, r in docs.items():
        found = [(best(x)[0], -k, best(x)[1]) for k, x in enumerate(r["text"].split("\n")) if re.search(licenses.CUE, x)]
        found = max((x for x in found if x[0] >= licenses.LEAST_COSINE), default=None)
        assert got[d]["own_license"] == (found[2] if found else None)
        if found:
            assert got[d]["cosine"] == pytest.approx(found[0], abs=1e-8)


def test_odd_tables(spark):
    docs = cases.documents(spark)
    assert licenses.scan(docs, "path").count() == docs.count()
    assert licenses.scan(cases.nothing(spark).selectExpr("*", "'' AS path"), "path").count() == 0


def test_versions_and_variants_are_told_apart(spark):
    said = {
        "Licensed under the GNU General Public License, version 2": "GPL-2.0",
        "Licensed under the GNU Affero General Public License, version 3": "AGPL-3.0",
        "Licensed under the GNU Lesser General Public License, version 2.1": "LGPL-2.1",
        "Released under the BSD License, two clauses": "BSD-2-Clause",
        "Licensed under CC BY-ND 4.0": "CC-BY-ND-4.0",
        "Licensed under CC BY 3.0": "CC-BY-3.0",
        "Licensed under the Eclipse Public License 2.0": "EPL-2.0",
        "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
        "Licensed under the Apache License, Version 1.1": None,
    }
    docs = spark.createDataFrame([(i, f"{PROSE}\n{x}", f"d{i}/x.py") for i, x in enumerate(said)], "doc_id bigint, text string, path string")
    got = {r["id"]: r["own_license"] for r in licenses.scan(docs, "path").collect()}
    assert got == dict(enumerate(said.values()))
