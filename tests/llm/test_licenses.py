"""op9: against a plain Python scan, notices beside other words and over paragraphs, competing licenses, odd input."""

from __future__ import annotations

import re

import pytest

from textloom.llm import licenses


def grams(words):
    return set(zip(words, words[1:]))


KNOWN = [(name, id_, words, grams(words)) for name, id_, text in licenses.TEMPLATES if (words := licenses.words_of(text))]


def plain(text):
    """Every unit, and every window that begins as a template does, against every template."""
    normal = re.sub(r"[^\w\n]+|_", " ", (text or "").lower())
    units = [*normal.split("\n"), *(p.replace("\n", " ") for p in re.split("\n *\n", normal) if "\n" in p)]
    sets = [[(grams(u.split()), t) for t in KNOWN] for u in dict.fromkeys(" ".join(u.split()) for u in units)]
    flat = normal.split()
    for i in range(len(flat)):
        sets.append([(grams(flat[i : i + len(t[2])]), t) for t in KNOWN if flat[i : i + 3] == t[2][:3]])
    found = []
    for candidates in sets:
        good = sorted((-2 * len(g & t[3]) / (len(g) + len(t[3])), t[0], t[1]) for g, t in candidates if 200 * len(g & t[3]) >= 80 * (len(g) + len(t[3])))
        found += good[:1]
    found.sort()
    return (found[0][1], found[0][2], round(-found[0][0], 6)) if found else (None, None, 0.0), ",".join(sorted({f[2] for f in found}))


def check(docs):
    want = sorted(((r.doc_id, *plain(r.text)) for r in docs.select("doc_id", "text").collect()), key=str)
    got = sorted(((r.doc_id, (r.template, r.license, r.score), r.licenses) for r in licenses.scan(docs).collect()), key=str)
    assert got == want
    return {g[0]: g for g in got}


def test_documents(documents):
    check(documents)


def test_odd(odd):
    check(odd)


def test_empty_and_clashing(empty, clashing):
    assert licenses.scan(empty).collect() == []
    assert licenses.scan(clashing).count() == 8


CASES = {
    "Copyright 2020 Foo. All rights reserved.": "LicenseRef-Proprietary",
    "The tool is small and fast. Released under the MIT License.": "MIT",
    "Some words. " + licenses.TEMPLATES[0][2] + "\nmore": "LicenseRef-Proprietary",
    "Intro\n\n" + licenses._BSD_2.replace(" 1. ", "\n\n 1. ").replace(" 2. ", "\n\n 2. ") + "\n\nend": "BSD-2-Clause",
    "Copyright\n\n" + licenses._MIT.replace(" The above", "\n\nThe above").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS"): "MIT",
}


def test_notices_beside_other_words_and_over_paragraphs(spark):
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    found = check(docs)
    assert [found[i][1][1] for i in range(len(CASES))] == list(CASES.values())


@pytest.mark.parametrize("name", ["agpl-3-notice", "gpl-2-notice", "lgpl-2.1-notice", "lgpl-3-notice", "gpl-3-full"])
def test_only_the_best_of_similar_licenses(spark, name):
    text, license_ = next((t, i) for n, i, t in licenses.TEMPLATES if n == name)
    found = check(spark.createDataFrame([(1, f"words before it {text} and after it"), (2, text)], "doc_id long, text string"))
    assert found[1][2] == found[2][2] == license_


def test_repeated_and_long(spark):
    long = "licensed under " * 20_000 + "the MIT license and all rights reserved"
    docs = spark.createDataFrame([(1, long), (1, long), (2, "x" * 300_000)], "doc_id long, text string")
    rows = licenses.scan(docs).collect()
    assert len({tuple(r) for r in rows if r.doc_id == 1}) == 1 and rows[0].doc_id is not None
