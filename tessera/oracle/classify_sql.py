"""DuckDB mirror of tessera.functions.classify (oracle only)."""

from __future__ import annotations

from ..functions import classify_rules as R
from ..functions.rules import WORD_TRIM_CHARS
from .sqltext import fields, lit_list, q


def _any(fn, values):
    return "(" + " OR ".join(fn(v) for v in values) + ")"


def _count(fn, values):
    return "(" + " + ".join(f"(CASE WHEN {fn(v)} THEN 1 ELSE 0 END)" for v in values) + ")"


def clean(w):
    return f"trim({w}, {q(WORD_TRIM_CHARS)})"


def has_symbol_pattern(w):
    c = clean(w)
    return (f"(strlen({c}) >= 3 AND (regexp_matches(substr({c}, 2), '[A-Z]') OR contains({c}, '_') "
            f"OR contains({c}, '-') OR (strlen({c}) BETWEEN 2 AND 8 AND regexp_matches({c}, '^[A-Z]+$'))))")


def class_points_sql(text: str) -> dict:
    t = f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"
    lower = f"lower({t})"
    words = fields(lower)
    raw = fields(t)
    cleaned = f"list_transform({raw}, lambda cw: {clean('cw')})"
    ascii_cap = f"(len(list_filter({raw}, lambda rw: strlen({clean('rw')}) >= 2 AND regexp_matches({clean('rw')}, '^[A-Z]'))) > 0)"

    def pattern_score(patterns, actions):
        s = (f"((CASE WHEN {_any(lambda p: f'contains({lower}, {q(p)})', patterns)} THEN 60 ELSE 0 END) "
             f"+ 30 * {_count(lambda a: f'contains({lower}, {q(a)})', actions)})")
        return f"({s} + (CASE WHEN {s} > 0 AND {ascii_cap} THEN 30 ELSE 0 END))"

    call = pattern_score(R.CALL_PATTERNS, R.CALL_ACTION_WORDS)
    ref = pattern_score(R.REF_PATTERNS, R.REF_ACTION_WORDS)
    n_pascal = (f"len(list_filter({cleaned}, lambda w: strlen(w) >= 2 AND regexp_matches(w, '^\\p{{Lu}}') "
                f"AND regexp_matches(substr(w, 2), '\\p{{Lu}}')))")
    n_snake = f"len(list_filter({cleaned}, lambda w: contains(w, '_') AND strlen(w) >= 3))"
    n_caps = f"len(list_filter({cleaned}, lambda w: strlen(w) BETWEEN 2 AND 8 AND regexp_matches(w, '^\\p{{Lu}}+$')))"
    n_camel = (f"len(list_filter({cleaned}, lambda w: strlen(w) >= 3 AND regexp_matches(w, '^\\p{{Ll}}') "
               f"AND regexp_matches(substr(w, 2), '\\p{{Lu}}')))")
    first = f"lower({raw}[1])"
    lookup = (f"(len({raw}) >= 2 AND coalesce({first} IN ('where', 'find', 'show'), false) AND "
              f"len(list_filter(({cleaned})[2:], lambda w: strlen(w) >= 2 AND regexp_matches(w, '^\\p{{Lu}}'))) > 0)")
    anyshape = f"({n_pascal} + {n_snake} + {n_caps} + {n_camel}) > 0"
    sym = (f"((CASE WHEN {n_pascal} > 0 THEN least(30 + 15 * ({n_pascal} - 1), 70) ELSE 0 END)"
           f" + (CASE WHEN {n_snake} > 0 THEN 30 + 10 * ({n_snake} - 1) ELSE 0 END)"
           f" + 20 * {n_caps} + 20 * {n_camel}"
           f" + 15 * {_count(lambda i: f'contains({lower}, {q(i)})', R.SYMBOL_INDICATORS)}"
           f" + (CASE WHEN len({raw}) <= 3 AND {anyshape} THEN 20 ELSE 0 END)"
           f" + (CASE WHEN {lookup} THEN 25 ELSE 0 END))")
    txt = (f"(30 * {_count(lambda x: f'list_contains({words}, {q(x)})', R.TEXT_QUESTION_WORDS)}"
           f" + 15 * {_count(lambda a: f'contains({lower}, {q(a)})', R.TEXT_ACTION_WORDS)}"
           f" + (CASE WHEN len({words}) >= 4 THEN 10 ELSE 0 END))")

    def contains_phrase(p):
        a, b = p.split(" ")
        i = f"coalesce(list_position({words}, {q(a)}), 0)"
        return f"({i} > 0 AND len(list_filter({words}, lambda w, k: k > {i} AND w = {q(b)})) > 0)"

    rep = (f"(30 * {_count(lambda i: f'contains({lower}, {q(i)})', R.REPO_INDICATORS)}"
           f" + 40 * {_count(contains_phrase, R.REPO_PHRASE_PATTERNS)}"
           f" + 20 * {_count(lambda w: f'list_contains({words}, {q(w)})', R.REPO_WORD_INDICATORS)}"
           f" + (CASE WHEN contains({lower}, 'what is this') OR contains({lower}, 'what''s this') THEN 50 ELSE 0 END)"
           f" + (CASE WHEN len({words}) <= 2 THEN 20 * {_count(lambda i: f'list_contains({words}, {q(i)})', R.REPO_INDICATORS)} ELSE 0 END))")
    has_arch = _any(lambda i: f"contains({lower}, {q(i)})", R.ARCH_INDICATORS)
    has_explain = f"(contains({lower}, 'explain') OR contains({lower}, 'describe'))"
    any_sym = f"(len(list_filter({raw}, lambda sw: {has_symbol_pattern('sw')})) > 0)"
    arch = (f"(CASE WHEN contains({lower}, 'project architecture') OR contains({lower}, 'repository architecture') THEN 0 "
            f"WHEN NOT {has_arch} THEN 0 WHEN {has_explain} THEN 40 + (CASE WHEN {any_sym} THEN 50 ELSE 20 END) + 30 "
            f"WHEN {sym} > 0 THEN 40 ELSE 0 END)")
    fl0 = (f"((CASE WHEN contains({lower}, 'trace') OR contains({lower}, 'flow of') THEN 50 ELSE 0 END)"
           f" + (CASE WHEN contains({lower}, 'startup sequence') OR contains({lower}, 'startup flow') THEN 60 ELSE 0 END)"
           f" + (CASE WHEN contains({lower}, 'lifecycle') OR contains({lower}, 'request lifecycle') THEN 50 ELSE 0 END)"
           f" + (CASE WHEN contains({lower}, 'pipeline') THEN 40 ELSE 0 END))")
    fl = f"({fl0} + (CASE WHEN {fl0} > 0 AND {any_sym} THEN 30 ELSE 0 END))"
    return {"call": call, "reference": ref, "symbol": sym, "text": txt, "repository": rep,
            "architecture": arch, "flow": fl, "n_words": f"len({words})"}


def answer_type_sql(text: str):
    lower = f"lower(regexp_replace({text}, '^\\s+|\\s+$', '', 'g'))"
    words = fields(lower)
    n = f"len({words})"
    first = f"({words})[1]"
    yes_no = (f"({_any(lambda p: f'starts_with({lower}, {q(p)})', R.YES_NO_PATTERNS)} OR "
              f"(coalesce({first} IN ({', '.join(q(w) for w in R.YES_NO_FIRST_WORDS)}), false) AND NOT "
              f"{_any(lambda p: f'starts_with({lower}, {q(p)})', R.YES_NO_NOT_PREFIXES)}))")
    typ = [f"WHEN {n} <= 6 AND {yes_no} THEN 'yes_no'"]
    conf = [f"WHEN {n} <= 6 AND {yes_no} THEN 0.85"]
    for patterns, label, c in R.ANSWER_RULES:
        hit = _any(lambda p: f"starts_with({lower}, {q(p)})", patterns)
        typ.append(f"WHEN {hit} THEN '{label}'")
        conf.append(f"WHEN {hit} THEN {c}")
    imp = _any(lambda w: f"contains({lower}, {q(w)})", R.IMPROVE_WORDS)
    typ += [f"WHEN {imp} THEN 'improvement'", f"WHEN contains({lower}, '?') THEN 'explanation'",
            f"WHEN {n} <= 2 THEN 'location'"]
    conf += [f"WHEN {imp} THEN 0.65", f"WHEN contains({lower}, '?') THEN 0.6", f"WHEN {n} <= 2 THEN 0.65"]
    return ("(CASE " + " ".join(typ) + " ELSE 'explanation' END)",
            "(CASE " + " ".join(conf) + " ELSE 0.5 END)")
