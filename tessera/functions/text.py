"""Text functions as native Spark column expressions.

All functions take and return ``Column`` objects so they compose inside
``select``/``transform``/``filter`` and stay in the JVM (no Python UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import FULLTEXT_STOP_WORDS, KEYWORD_STOP_WORDS, WORD_TRIM_CHARS

# Token boundary of the full-text tokenizer: anything that is not a
# Unicode letter or digit.
NON_ALNUM = r"[^\p{L}\p{N}]+"


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def fields(text: Column) -> Column:
    """Whitespace split with empty pieces removed (Go ``strings.Fields``)."""
    return F.filter(F.split(text, r"\s+", -1), lambda w: w != "")


def trim_word(w: Column) -> Column:
    return F.btrim(w, F.lit(WORD_TRIM_CHARS))


def stem(w: Column) -> Column:
    """T02 suffix stemmer; the first matching rule wins."""
    n = F.length(w)

    def cut(k: int) -> Column:
        return w.substr(F.lit(1), n - k)

    return (
        F.when(w.endswith("tion"), F.concat(cut(4), F.lit("t")))
        .when(w.endswith("ations"), cut(6))
        .when(w.endswith("ation"), cut(5))
        .when(w.endswith("ments"), cut(1))
        .when(w.endswith("ment"), w)
        .when(w.endswith("ing"), cut(3))
        .when(w.endswith("ings"), cut(4))
        .when(w.endswith("ed"), cut(2))
        .when(w.endswith("es"), cut(2))
        .when(w.endswith("s") & (F.octet_length(w) > 3), cut(1))
        .otherwise(w)
    )


def stem_word(w: str) -> str:
    """T02 of one word, for tasks that stem each distinct word once."""
    for end, n, instead in (("tion", 4, "t"), ("ations", 6, ""), ("ation", 5, ""), ("ments", 1, ""), ("ment", 0, ""), ("ing", 3, ""), ("ings", 4, ""),
                            ("ed", 2, ""), ("es", 2, "")):
        if w.endswith(end):
            return w[:len(w) - n] + instead
    return w[:-1] if w.endswith("s") and len(w.encode()) > 3 else w


def query_words(text: Column) -> Column:
    """Lower-cased whitespace words with punctuation trimmed; empties kept
    out.  This is the word list used for line matching and boosts."""
    return F.filter(F.transform(fields(F.lower(text)), trim_word), lambda w: w != "")


def keywords(text: Column) -> Column:
    """T01 keyword extraction: words (lower, trimmed, >= 2 bytes, not a
    stop word), each followed by its stem, order-preserving distinct."""
    stops = _lit_array(KEYWORD_STOP_WORDS)
    words = F.filter(
        F.transform(fields(F.lower(text)), trim_word),
        lambda w: (F.octet_length(w) >= 2) & ~F.array_contains(stops, w),
    )
    pairs = F.flatten(F.transform(words, lambda w: F.array(w, stem(w))))
    return F.array_distinct(pairs)


def fulltext_words(text: Column) -> Column:
    """Words of the full-text query (trim, lower, >= 2 bytes, minus
    the full-text stop words)."""
    stops = _lit_array(FULLTEXT_STOP_WORDS)
    return F.filter(
        F.transform(fields(text), lambda w: F.lower(trim_word(w))),
        lambda w: (F.octet_length(w) >= 2) & ~F.array_contains(stops, w),
    )


def tokenize(text: Column) -> Column:
    """Full-text tokenizer: lower-case, split on non letter/digit, drop
    empties, stem each token.  Used for documents and queries alike."""
    return F.transform(
        F.filter(F.split(F.lower(text), NON_ALNUM, -1), lambda t: t != ""), stem)


def camel_split(s: Column) -> Column:
    """Break before every ASCII upper-case letter (not at the start)."""
    return F.split(s, "(?<!^)(?=[A-Z])", -1)


def alnum_words(s: Column, stops=None, min_len: int = 2) -> Column:
    """Lower, split on non [a-z0-9], drop stop words and short words."""
    parts = F.split(F.lower(s), "[^a-z0-9]+", -1)
    stop_arr = _lit_array(stops or [])
    return F.filter(parts, lambda w: (F.length(w) >= min_len) & ~F.array_contains(stop_arr, w))


def short_path(path: Column) -> Column:
    """From the first '/internal/' (else '/cmd/', else '/pkg/') onward
    without the leading slash, else the basename."""
    out = F.element_at(F.split(path, "/"), -1)
    for seg in reversed(["/internal/", "/cmd/", "/pkg/"]):
        idx = F.instr(path, seg)
        out = F.when(idx > 0, path.substr(idx + 1, F.length(path))).otherwise(out)
    return out


def byte_tokens(text: Column) -> Column:
    """T11 packing estimate: bytes / 4 (integer division)."""
    return (F.octet_length(text) / 4).cast("long")


def word_tokens(text: Column) -> Column:
    """T11 whitespace word count."""
    return F.size(fields(text)).cast("long")


def lines_of(content: Column) -> Column:
    return F.split(content, "\n", -1)
