"""SQL fragments (DuckDB dialect) mirroring tessera.functions.text."""

from __future__ import annotations

from ..functions.rules import FULLTEXT_STOP_WORDS, KEYWORD_STOP_WORDS, WORD_TRIM_CHARS

NON_ALNUM = r"[^\p{L}\p{N}]+"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lit_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def fields(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda f: f <> '')"


def trim_word(x: str, extra: str = "") -> str:
    return f"trim({x}, {q(WORD_TRIM_CHARS + extra)})"


def stem(w: str) -> str:
    def cut(k):
        return f"left({w}, length({w}) - {k})"
    return (f"(CASE WHEN suffix({w}, 'tion') THEN {cut(4)} || 't' "
            f"WHEN suffix({w}, 'ations') THEN {cut(6)} "
            f"WHEN suffix({w}, 'ation') THEN {cut(5)} "
            f"WHEN suffix({w}, 'ments') THEN {cut(1)} "
            f"WHEN suffix({w}, 'ment') THEN {w} "
            f"WHEN suffix({w}, 'ing') THEN {cut(3)} "
            f"WHEN suffix({w}, 'ings') THEN {cut(4)} "
            f"WHEN suffix({w}, 'ed') THEN {cut(2)} "
            f"WHEN suffix({w}, 'es') THEN {cut(2)} "
            f"WHEN suffix({w}, 's') AND strlen({w}) > 3 THEN {cut(1)} "
            f"ELSE {w} END)")


def query_words(x: str) -> str:
    return (f"list_filter(list_transform({fields(f'lower({x})')}, lambda qw: {trim_word('qw')}), "
            f"lambda qw: qw <> '')")


def fulltext_words(x: str) -> str:
    return (f"list_filter(list_transform({fields(x)}, lambda fw: lower({trim_word('fw')})), "
            f"lambda fw: strlen(fw) >= 2 AND NOT list_contains({lit_list(FULLTEXT_STOP_WORDS)}, fw))")


def tokenize(x: str) -> str:
    return (f"list_transform(list_filter(regexp_split_to_array(lower({x}), {q(NON_ALNUM)}), "
            f"lambda tk: tk <> ''), lambda tk: {stem('tk')})")


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def keywords(x: str) -> str:
    """T01 (order-preserving distinct done by the caller via unnest)."""
    words = (f"list_filter(list_transform({fields(f'lower({x})')}, lambda kw: {trim_word('kw')}), "
             f"lambda kw: strlen(kw) >= 2 AND NOT list_contains({lit_list(KEYWORD_STOP_WORDS)}, kw))")
    return f"flatten(list_transform({words}, lambda kw: [kw, {stem('kw')}]))"


def distinct_in_order(lst: str) -> str:
    """Order-preserving distinct for short lists."""
    return f"list_filter({lst}, lambda dx, di: list_position({lst}, dx) = di)"


CORPUS_DOCUMENTS = ("SELECT lang AS repo, source || '/doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS path, "
                    "text AS content, doc_id FROM documents")
