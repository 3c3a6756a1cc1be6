import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import divergence

from .conftest import prose

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_force(rows, min_docs, top):
    """rows: (lang, text, source)."""
    df, own, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, text, source in rows:
        found = TERM.findall(folded(text))
        df[lang or ""].update(set(found))
        own[lang or "", source or ""].update(found)
        total[lang or ""].update(found)
    out = set()
    kept = {lang: sorted(t for t, n in c.items() if n >= min_docs) for lang, c in df.items()}
    for lang, source in own:
        terms = kept[lang]

        def shares(c):
            n = sum(c[t] for t in terms)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(terms)) for t in terms}

        p, q = shares(own[lang, source]), shares(total[lang])
        pairs = [(sum(abs(p[t] - o[t]) for t in terms), s) for (one, s), c in own.items() if one == lang and s != source for o in [shares(c)]]
        more = [(p[t] - q[t], t) for t in terms if own[lang, source][t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", more, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(found[:most], 1)}
    return out


def rows_of(odd_rows):
    rows = [(("en", "fr", None)[i % 3], prose(500 + i % 7, 30 + 5 * i) + f" É{i} Mixed CASE's İ ß \U0001f600x a1b", ("a", "b", "c", None)[i % 4]) for i in range(40)]
    return rows + [("de", "alone here", "a"), ("xx", "", "a"), ("xx", None, "b"), (None, None, None)] + [("en", t, s) for _, t, s in odd_rows]


def run(spark, rows, **more):
    table = spark.createDataFrame([(lang, text, source, 1, "x", 2, "y") for lang, text, source in rows],
                                  "lang string, text string, source string, n long, term string, p long, terms string")
    got = [tuple(r) for r in divergence.divergence(table, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("fit_terms", [2_000_000, 40])
def test_shares_match_brute_force(spark, odd_rows, fit_terms):
    rows = rows_of(odd_rows)
    assert run(spark, rows, min_docs=3, top_terms=4, fit_terms=fit_terms) == brute_force(rows, 3, 4)


def test_nothing_kept_and_empty_table(spark, odd, none):
    rows = [("en", "one two", "a"), ("en", "three", "b"), ("fr", None, None)]
    assert run(spark, rows) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert divergence.divergence(none).count() == 0
    assert divergence.divergence(odd, min_docs=1).where("part = 'pair'").count() == 12      # four sources, null among them


def test_occurrences_are_summed_before_they_are_counted(spark):
    """A group's repeats of a term reach the transform as few rows, not one by one."""
    rows = [("en", "one one two " * 20, "a"), ("fr", "One", "a")] * 50
    got = divergence.with_terms(spark.createDataFrame(rows, "lang string, text string, source string").coalesce(1)).collect()
    assert sorted((r.lang, *sorted(r.terms)) for r in got if r.weight is None) == [("en", "en\x00one", "en\x00two")] * 50 + [("fr", "fr\x00one")] * 50
    total = Counter()
    for r in got:
        if r.weight is not None:
            assert len(set(r.terms)) == len(r.terms)
            total.update({t: r.weight for t in r.terms})
    assert total == {"en\x00one": 2000, "en\x00two": 1000, "fr\x00one": 50}
    assert sum(len(r.terms) for r in got if r.weight is not None) <= 3 * 11


def test_documents_are_summed_before_the_fit(spark):
    """A term that many documents hold reaches the fit in as many rows as minDF asks for, a rarer one in a row a document."""
    rows = [("en", "one one two", "a")] * 50 + [("en", "Two rare", None), ("fr", "One", "a"), ("fr", "", "b"), ("fr", " 7 ", None)]
    got = divergence.with_terms(spark.createDataFrame(rows, "lang string, text string, source string").coalesce(1), summed=True).collect()
    docs = {t: n for r in got if r.weight is None for t, n in zip(r.terms, r.docs)}
    assert docs == {"en\x00one": 50, "en\x00two": 51, "en\x00rare": 1, "fr\x00one": 1}
    fit = divergence.with_documents(spark.createDataFrame(list(docs.items()), "term string, docs long").coalesce(1), 30).collect()
    assert len(fit) == 30 and all(len(set(r.terms)) == len(r.terms) for r in fit)
    assert Counter(t for r in fit for t in r.terms) == {t: min(n, 30) for t, n in docs.items()}


def test_tasks_that_hand_on_often_give_the_same(spark, odd_rows, monkeypatch):
    rows = rows_of(odd_rows)
    monkeypatch.setattr(divergence, "FLUSH", 5)
    monkeypatch.setattr(divergence, "ROW_TERMS", 3)
    table = spark.createDataFrame([(x, t or "", s) for x, t, s in rows], "lang string, text string, source string").coalesce(2)
    found = Counter()
    for r in divergence.with_terms(table.fillna(""), summed=True).collect():
        for t in r.terms:
            found[r.lang, r.source, t] += r.weight or 0
    assert {k: n for k, n in found.items() if n} == Counter(
        (x or "", s or "", f"{x or ''}\x00{t}") for x, text, s in rows for t in TERM.findall(folded(text)))
