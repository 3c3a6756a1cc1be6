import textwrap

import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses
from tessera.llm.licence_texts import MORE_TEXTS, TEXTS

from .conftest import frame

CLAIM = "Copyright (c) 2019-2021, A. Name <a@example.org>. All rights reserved.\n\n"


def wrapped(text: str, width: int) -> str:
    return "\n\n".join(textwrap.fill(p, width, break_on_hyphens=False) for p in text.split("\n\n"))


@pytest.mark.parametrize("claim", ["", CLAIM, "Copyright The Authors\nCopyright 2020 B. Name\n(c) C. Name\n\n"])
def test_a_licence_is_known_in_any_wrapping(spark, claim):
    texts = [(i.split(" with ")[0], t) for i, t in TEXTS.items()] + [(i, t) for i, _, t in MORE_TEXTS]
    rows, expected = [], {}
    for name, text in texts:
        for width in (*range(30, 100, 7), 10000):
            expected[len(rows)] = name
            rows.append((len(rows), claim + wrapped(text, width), "a"))
    rows.append((len(rows), claim + wrapped(texts[0][1], 80) + "\n\nBut not for software of others.", "a"))
    expected[len(rows) - 1] = None
    got = {r.doc_id: r.license for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert {k: (v, got[k]) for k, v in expected.items() if got[k] != v} == {}


def test_given_texts_need_no_word_of_a_licence(spark):
    known = {licenses.hashlib.sha256(b"take it all").hexdigest(): "Own"}
    got = licenses.scan_licenses(frame(spark, [(1, "Head\nTake it, all!\nTail", "a")]), known=known)
    assert [(r.n_license_lines, r.line_licenses) for r in got.collect()] == [(1, "Own")]


def test_words_of_the_filters_are_in_all_known_texts():
    import re
    from itertools import product

    from tessera.llm.licence_texts import NAMES, NOTICES
    notices = [n.format(name) for names in NAMES.values() for name, n in product(names, NOTICES)]
    assert all(re.search(licenses.NOTICE_WORDS, licenses.canonical_text(t)) for t in [*notices, *TEXTS.values()])
    assert all(licenses.BODY_WORD in licenses.canonical_text(t, licenses.CLAIM_LINE) for t in [*TEXTS.values(), *(t for _, _, t in MORE_TEXTS)])
