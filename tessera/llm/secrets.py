"""Secret scans (3): spans by pattern, judged by who owns copies of them.

Native throughout.  A pattern's matches get their places from one
``regexp_replace`` which puts a mark around each match and one ``split`` at
the marks: the lengths of the parts add up to code-point offsets.  Every
candidate value is then counted over the corpus by hash, distinct
repositories and distinct owners.  A value that many owners have is a copied
example; one that a single owner has looks live.  Candidates of the general
shape (long runs of letters and digits) become spans unless they are copied
examples or overlap a span of a listed kind.

Defined results: a null text is empty and has no span; a null repository or
owner counts as one more value; repeated documents keep their own rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

# Fixed values of the contract: kinds in their order, with the group that
# holds the secret itself and its least length.
ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6)
ACCESS = (r"AKIA[A-Z0-9]+", 0, 20)
HEX = (r"[0-9a-f]{24,}", 0, 24)
# The method's own kind: a run of 20 or more with digits and letters mixed.
GENERAL = (r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+", 0, 20)
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "general": GENERAL}
BASE = ("assign", "access", "hex")

COPIED_OWNERS = 3     # a value of at least so many owners is an example

_MARK, _STAND_IN = "\ue000", "\ue001"


def _parts(text, pattern: str):
    """Lengths of the parts of a text between marks, with the matched string
    where the part is a match; null without a match.  The mark itself stands
    in no pattern, so another character may take its place in the text."""
    marked = F.regexp_replace(F.translate(text, _MARK, _STAND_IN), F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}"))
    part = F.transform(F.split(marked, _MARK), lambda p, i: F.struct(
        F.length(p).alias("n"), F.when(i % 2 == 1, p).alias("hit")))
    return F.when(text.rlike(pattern), part)


def _mixed(value):
    """Letters and at least three digits: no plain word, number or rule."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return (digits >= 3) & value.rlike("[A-Za-z]") & (F.length(value) - digits >= 3)


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repo_cols=("source", "lang"),
                 owner_col: str = "source", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """One row per document: doc_id, digest (md5 of the text), and spans, an
    array of (start, kind, end, value_sha256, n_repos, n_owners, standing) in
    order of start and kind; standing is copied, shared or live."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    repo = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in repo_cols])
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), repo.alias("repo"),
                       F.coalesce(F.col(owner_col).cast("string"), F.lit("\x1e")).alias("owner"))
    # one pass over the texts; what it leaves is narrow and kept, ids included
    scanned = written(rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.md5("text").alias("digest"), "repo", "owner",
        *[_parts(F.col("text"), p).alias(k) for k, (p, _, _) in KINDS.items()]), "secrets-scan")

    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).alias("parts")) for i, k in enumerate(KINDS)])
    some = F.coalesce(*[F.col(k) for k in KINDS]).isNotNull()
    parts = scanned.where(some).select("row", "repo", "owner", F.explode(kinds).alias("k")) \
        .select("row", "repo", "owner", "k.kind", F.posexplode("k.parts").alias("at", "part"))
    before = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    hits = parts.withColumn("start", F.coalesce(F.sum("part.n").over(before), F.lit(0))) \
        .where("part.hit is not null") \
        .select("row", "repo", "owner", "kind", "start", (F.col("start") + F.col("part.n")).alias("end"),
                F.col("part.hit").alias("hit"))
    value, least = F.col("hit"), F.lit(0)
    for i, (pattern, group, n) in enumerate(KINDS.values()):
        least = F.when(F.col("kind") == i, n).otherwise(least)
        if group:
            value = F.when(F.col("kind") == i, F.regexp_extract("hit", pattern, group)).otherwise(value)
    general = list(KINDS).index("general")
    hits = hits.withColumn("value", value).where(F.length("value") >= least) \
        .where((F.col("kind") != general) | _mixed(F.col("value")))
    # a general candidate gives way to a listed kind that it overlaps
    by_start = Window.partitionBy("row").orderBy("start", "kind", "end")
    listed_end, listed_start = F.when(F.col("kind") != general, F.col("end")), F.when(F.col("kind") != general, F.col("start"))
    hits = hits.withColumn("past", F.max(listed_end).over(by_start.rowsBetween(Window.unboundedPreceding, -1))) \
        .withColumn("next", F.min(listed_start).over(by_start.rowsBetween(1, Window.unboundedFollowing))) \
        .where((F.col("kind") != general) | ((F.coalesce("past", F.lit(0)) <= F.col("start"))
                                             & (F.coalesce("next", F.col("end")) >= F.col("end"))))
    hits = written(hits.select("row", "repo", "owner", "kind", "start", "end", F.sha2("value", 256).alias("value_sha256")),
                   "secrets-hits")

    # one row per value, repository and owner first: a hot value is summed where it is read
    owned = hits.groupBy("value_sha256", "repo", "owner").agg(F.count("*").alias("n"))
    spread = owned.groupBy("value_sha256").agg(F.sum("n").alias("n"), F.count_distinct("repo").alias("n_repos"),
                                               F.count_distinct("owner").alias("n_owners"))
    standing = F.when(F.col("n_owners") >= copied_owners, "copied").when(F.col("n_owners") > 1, "shared").otherwise("live")
    judged = hits.join(written(spread.withColumn("standing", standing), "secrets-values"), "value_sha256") \
        .where((F.col("kind") != general) | (F.col("standing") != "copied"))
    per_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        "start", "kind", "end", "value_sha256", "n_repos", "n_owners", "standing"))).alias("spans"))
    none = F.array().cast(per_row.schema["spans"].dataType)
    return scanned.select("row", "doc_id", "digest").join(per_row, "row", "left") \
        .select("doc_id", "digest", F.coalesce("spans", none).alias("spans"))


def span_names(spans):
    """kind:start:end of an array of spans, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(spans):
    return F.filter(spans, lambda s: s["kind"] < len(BASE))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repo_cols=("source", "lang"),
           owner_col: str = "source", copied_owners: int = COPIED_OWNERS, mask: str = "<secret>") -> DataFrame:
    """The documents with every span that is no copied example replaced by
    ``mask``.  Only texts in which a pattern occurs take part in the join."""
    any_kind = "|".join(f"(?:{p})" for p, _, _ in KINDS.values())
    has = F.coalesce(F.col(text_col).rlike(any_kind), F.lit(False))
    found = find_secrets(docs, id_col=id_col, text_col=text_col, repo_cols=repo_cols, owner_col=owner_col,
                         copied_owners=copied_owners)
    spans = F.filter("spans", lambda s: s["standing"] != "copied")
    found = found.select(F.col("doc_id").alias("s_id"), F.col("digest").alias("s_digest"), spans.alias("s_spans")) \
        .where(F.size("s_spans") > 0).dropDuplicates(["s_id", "s_digest"])
    touched = docs.where(has)
    same = F.col(id_col).eqNullSafe(F.col("s_id")) & (F.md5(F.col(text_col)) == F.col("s_digest"))
    # overlapping spans become one; then the text is put together from what lies between
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")
    joined = F.aggregate("s_spans", empty, lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= s["start"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], s["end"]).alias("b")))))
        .otherwise(F.concat(acc, F.array(F.struct(s["start"].cast("long").alias("a"), s["end"].cast("long").alias("b"))))))
    cut = touched.join(found, same, "left").withColumn("s_cuts", joined)
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("s_cuts", lambda c: c["b"]))
    ends = F.concat(F.transform("s_cuts", lambda c: c["a"]), F.array(F.length(text_col).cast("long")))
    clean = F.array_join(F.zip_with(begins, ends, lambda b, e: F.substring(F.col(text_col), (b + 1).cast("int"), (e - b).cast("int"))), mask)
    redacted = cut.withColumn(text_col, F.when(F.col("s_cuts").isNull(), F.col(text_col)).otherwise(clean)).select(*docs.columns)
    return docs.where(~has).unionByName(redacted)
