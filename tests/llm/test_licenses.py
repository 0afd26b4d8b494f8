import re

import pytest

from samplewright.llm import licenses, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "text,canonical,names,duty",
    [
        ("MIT", "MIT", {"mit"}, 0),
        ("MIT OR GPL-3.0-only AND BSD-3-Clause", "MIT OR GPL-3.0-only AND BSD-3-Clause", {"mit", "gpl", "bsd"}, 0),
        ("(MIT or GPL-3.0-only) and BSD-3-Clause", "(MIT OR GPL-3.0-only) AND BSD-3-Clause", {"mit", "gpl", "bsd"}, 0),
        ("MIT AND GPL-2.0-only WITH Classpath-exception-2.0", "MIT AND GPL-2.0-only WITH Classpath-exception-2.0", {"mit", "gpl"}, 1),
        ("MIT AND (Apache-2.0 AND GPL-2.0+)", "MIT AND Apache-2.0 AND GPL-2.0+", {"mit", "apache", "gpl"}, 2),
        ("((MIT))", "MIT", {"mit"}, 0),
        ("MIT. Then prose", "MIT", {"mit"}, 0),
        ("MIT AND, then prose", "MIT", {"mit"}, 0),
        ("(MIT OR Apache-2.0", None, None, None),
        ("LicenseRef-own OR MPL-2.0", "LicenseRef-own OR MPL-2.0", {"licenseref-own", "mpl"}, 1),
        ("AND MIT", None, None, None),
        ("", None, None, None),
        (") MIT", None, None, None),
        ("MIT)", "MIT", {"mit"}, 0),
    ],
)
def test_expressions(text, canonical, names, duty):
    got = licenses.parse(text)
    assert (got and (got.text, set(got.licences), got.duty)) == (canonical and (canonical, names, duty))


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def slow(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


@pytest.mark.parametrize(
    "text",
    [
        None, "", "MIT License", "mit license mit-license", "the Apache\nLicense; apache license apache license",
        "GNU general, PUBLIC license", "xmit license", "mit licenses", "cc by", "cc by by cc by", "é MIT license", "0cc by 1",
    ],
)
def test_base_phrases(text):
    assert licenses.Scanner()(text)[:5] == slow(text)


def test_many_matches_are_counted_once_each():
    text = "cc by mit license gnu general public license apache license " * 40_000
    found = licenses.Scanner()(text)
    assert found[:4] == (400_000, 160_000, 0, 399_998)
    assert licenses.Scanner()(text[:6000])[:5] == slow(text[:6000])


def test_tags_and_notices():
    got = licenses.Scanner()("// SPDX-License-Identifier: (Apache-2.0 OR MIT)\nAll rights reserved.\nspdx-license-identifier: GPL-2.0-only")
    assert got[4] == "" and got[5] == "apache,gpl,mit,proprietary" and got[8] == 2
    assert got[7] == ["Apache-2.0 OR MIT", "GPL-2.0-only"] and 0.9 < got[6] <= 1
    assert licenses.Scanner()("nothing here")[5:] == ("", 0.0, [], None)


def test_query_against_brute_force(spark, documents):
    got = {r.doc_id: tuple(r)[1:6] for r in queries.op10_licenses(spark, SF_DIR).collect()}
    assert got == {r["doc_id"]: slow(r["text"]) for r in documents[1]}


def test_messy_rows_and_empty_tables(messy, empty):
    docs = messy(["the mit license", "the mit license", "x"])
    rows = licenses.scan(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r for r in rows}
    assert got[0].labels == got[1].labels == "mit" and got[0].first_word == 1
    assert got[100].n_words == 0 and got[100].first_word is None and got[100].base_labels == ""
    assert licenses.scan(empty).count() == 0
