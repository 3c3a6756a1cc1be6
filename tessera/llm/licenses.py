"""License scans (1): digests of canonical texts against known ones.

A text is brought to a canonical form (lower case, no copyright lines, no
punctuation, one spelling of words that have several, single spaces) and its
SHA-256 is joined to the digests of known licences and notices, a fixed table
of a few hundred rows.  Whole texts and, since a notice is a text of one
line, the lines of a text are looked up the same way.

Which lines begin with "copyright" depends on where a text is wrapped.  A text
without a known digest is therefore looked up again, by a second canonical
form that loses only lines which claim copyright, so that every wrapping of a
known text has one form.  The SQL has the first form alone.

Native.  Defined results: a null, empty or punctuation-only text has the
digest of the empty string and no licence; repeated rows stay."""

from __future__ import annotations

import hashlib
import re
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_rows
from .licence_texts import MORE_TEXTS, NAMES, NOTICES, SPELLINGS, TEXTS

# A line that only claims copyright says nothing about the licence.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
# The same without the words which a licence's own lines may begin with.
CLAIM_LINE = r"(^|\n)[^a-z0-9\n]*(copyright(?![^a-z0-9]+(holder|notice|owner)s?([^a-z0-9]|$))|\(c\)|©|all rights reserved)[^\n]*"
# Words of which each known notice or text has one, and a word of each whole text.
NOTICE_WORDS = "licen|unlicense|spdx|released|distributed|permission|provided"
BODY_WORD = "software"
# Runs of ASCII other than letters, digits and line ends, and of common marks.
GAPS = "[\\x00-\\x09\\x0b-\\x2f\\x3a-\\x60\\x7b-\\x7f\u00a0\u00a9\u00ab\u00bb\u2013\u2014\u2018\u2019\u201c\u201d]+"


def canonical(text, dropped: str = COPYRIGHT_LINE):
    """Canonical form of a text column, line ends kept."""
    plain = F.regexp_replace(F.lower(text), dropped, "$1")
    plain = F.regexp_replace(plain, GAPS, " ")
    for old, new in SPELLINGS:
        plain = F.regexp_replace(plain, old, new.replace("\\", "$"))
    return plain


def _squeezed(text):
    return F.trim(F.regexp_replace(text, r"[ \n]+", " "))


def canonical_text(text: str, dropped: str = COPYRIGHT_LINE) -> str:
    """The same for one string of the fixed table."""
    plain = re.sub(dropped, r"\1", text.lower())
    plain = re.sub(GAPS, " ", plain)
    for old, new in SPELLINGS:
        plain = re.sub(old, new, plain)
    return re.sub(r"[ \n]+", " ", plain).strip(" ")


def known_digests() -> dict[str, str]:
    texts = [(i.split(" with ")[0], t) for i, t in TEXTS.items()]
    texts += [(i, notice.format(name)) for i, names in NAMES.items() for name, notice in product(names, NOTICES)]
    # "version 3" and "version 3.0" name one version
    texts += [(i, f"{t}.0") for i, t in texts if t.endswith(("version 2", "version 3"))]
    return {hashlib.sha256(canonical_text(t).encode()).hexdigest(): i for i, t in texts}


def body_digests() -> dict[str, str]:
    """Digests of whole texts in the form that no wrapping changes."""
    texts = [(i.split(" with ")[0], t) for i, t in TEXTS.items()]
    texts += [(i, t) for i, title, text in MORE_TEXTS for t in (text, f"{title}\n\n{text}")]
    return {hashlib.sha256(canonical_text(t, CLAIM_LINE).encode()).hexdigest(): i for i, t in texts}


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  known: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, digest of the whole canonical text,
    license (id of a known text that it equals, else null), n_license_lines
    and line_licenses (ids of the lines that equal known ones, sorted,
    comma-joined)."""
    bodies = body_digests() if known is None else {}
    filtered = known is None
    known = known_digests() if known is None else known
    spark = docs.sparkSession
    table = spark.createDataFrame(list(known.items()) or [("", "")], "known_digest string, license string")
    rows = text_rows(docs, id_col, text_col).withColumn("canonical", canonical(F.col("text"))) \
        .select("doc_id", "text", F.sha2(_squeezed(F.col("canonical")), 256).alias("digest"), F.split("canonical", "\n").alias("lines"))
    # a line can only match if it is no longer than the longest known text
    by_digest = F.map_from_arrays(F.array(*[F.lit(k) for k in known]), F.array(*[F.lit(v) for v in known.values()])) if known \
        else F.map_from_arrays(F.array(F.lit("")), F.array(F.lit("")))
    tagged = F.filter("lines", lambda x: x.rlike(NOTICE_WORDS)) if filtered else F.col("lines")
    ids = F.filter(F.transform(tagged, lambda x: F.element_at(by_digest, F.sha2(_squeezed(x), 256))), lambda x: x.isNotNull())
    body = F.lit(None).cast("string")
    if bodies:
        by_body = F.map_from_arrays(F.array(*[F.lit(k) for k in bodies]), F.array(*[F.lit(v) for v in bodies.values()]))
        body = F.when(F.lower("text").contains(BODY_WORD),
                      F.element_at(by_body, F.sha2(_squeezed(canonical(F.col("text"), CLAIM_LINE)), 256)))
    rows = rows.select("doc_id", "digest", ids.alias("ids"), body.alias("body"))
    return rows.join(F.broadcast(table), F.col("digest") == F.col("known_digest"), "left").select(
        "doc_id", "digest", F.coalesce("license", "body").alias("license"), F.size("ids").cast("long").alias("n_license_lines"),
        F.array_join(F.array_sort(F.array_distinct("ids")), ",").alias("line_licenses"))


def _sql() -> str:
    plain = f"regexp_replace(lower(coalesce(text, '')), '{COPYRIGHT_LINE}', '\\1', 'g')"
    plain = f"regexp_replace({plain}, '{GAPS}', ' ', 'g')"
    for old, new in SPELLINGS:
        plain = f"regexp_replace({plain}, '{old}', '{new}', 'g')"
    known = ", ".join(f"('{d}', '{i}')" for d, i in known_digests().items())
    squeezed = "trim(regexp_replace({}, '[ \\n]+', ' ', 'g'), ' ')"
    return f"""
with known(known_digest, license) as (values {known}),
d as (select row_number() over () as r, doc_id, {plain} as c from documents),
l as (select r, unnest(string_split(c, chr(10))) as line from d),
m as (select r, count(*) as n, string_agg(distinct license, ',' order by license) as ids
      from l join known on sha256({squeezed.format('line')}) = known_digest group by r)
select d.doc_id, sha256({squeezed.format('d.c')}) as digest, k.license, coalesce(m.n, 0) as n_license_lines,
       coalesce(m.ids, '') as line_licenses
from d left join known k on sha256({squeezed.format('d.c')}) = k.known_digest left join m using (r)"""


ORACLE_SQL = _sql()
