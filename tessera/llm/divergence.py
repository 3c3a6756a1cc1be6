"""Source divergence audit (11): how the sources of a language differ.

One ``CountVectorizer`` fit holds the vocabularies of all languages, since a
term carries its language: minDF then counts documents of that language, and
vocabSize is the largest integer, so that no term is cut.  Its exact sparse
vectors of the terms of (lang, source), which tasks sum over documents first,
are added up, as (term, count) rows with partial sums; no dense vector is made.  Shares are whole billionths, all
arithmetic is on integers.

Two sources are compared sparsely.  Terms that neither has differ by the same
amount, so that their number is enough; a term that only one has differs from
the other's least share, so that one row per share is enough; only terms that
both have meet in a join.  That join has one row per source, language and term.

``CountVectorizer`` keeps its vocabulary on the driver and sends it to the
executors.  Terms are counted before, and dealt by hash to so many fits that
none keeps more than about ``FIT_TERMS``.  The fit asks in how many documents a
term is, up to minDF: documents are summed by term first, and every term then
stands in as many rows as documents hold it, at most in minDF.

Defined results: null lang, source and text count as ''; repeated rows are
documents of their own; a language without kept terms has pairs of value 0 and
no term rows; a source alone in its language has no pair rows; an empty table
gives no rows."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, added, ranges, slices, united, word_table, words_of, written

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
# Distinct terms that one fit is given, about, of which it keeps some on the driver.
FIT_TERMS = 4_000_000
FLUSH = 4_000_000           # numbers of terms that a task holds before it hands them on
ROW_TERMS = 4096
_LARGEST = 2**31 - 1
_TABLE = word_table(string.ascii_lowercase.encode())
_BETWEEN = "\x00"           # no term holds it
OUT = ["lang", "source", "part", "item", "value", "rank"]


def _named(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))


class _Numbers(dict):
    """Numbers things in the order in which they come."""

    def __missing__(self, thing) -> int:
        self[thing] = number = len(self)
        return number

    def of(self, things: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, things), np.int64, len(things))


def with_terms(rows: DataFrame, summed: bool = False) -> DataFrame:
    """(lang, source, terms, weight, docs).  A row without ``weight`` is a
    document, with its distinct terms, each behind its language; with
    ``summed``, it holds terms of documents of a task, and ``docs`` in how many
    each is found.  The others hold the occurrences, summed over documents of a
    task: a term found five times stands in a row of weight 4 and in one of
    weight 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, langs_of = _Numbers(), _Numbers()           # of (lang, source) and lang
        distinct: list[pa.Array] = []                       # words of each slice
        found_in: dict[str, list] = {"groups": [], "docs": []}      # (number << 32 | word, how often) of each slice

        def batch(found, docs):
            """``found``: (lang, source, weight, terms, docs); terms are cut into rows."""
            langs, sources, weights, terms, n = zip(*found)
            cut = [np.append(np.arange(0, len(t), ROW_TERMS), len(t)) if docs is not None else np.array([0, len(t)]) for t in terms]
            rows = np.array([len(c) - 1 for c in cut])
            ends = pa.array(np.append(0, np.cumsum(np.concatenate([np.diff(c) for c in cut]))), pa.int32())
            held = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(n), pa.int64())) if docs else pa.nulls(rows.sum(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays(
                [*(pa.array(x, t).take(pa.array(np.repeat(np.arange(len(rows)), rows))) for x, t in
                   ((langs, pa.string()), (sources, pa.string()))),
                 pa.ListArray.from_arrays(ends, pa.concat_arrays(terms).cast(pa.string())),
                 pa.array(weights, pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), rows))), held],
                ["lang", "source", "terms", "weight", "docs"])

        def tagged(words, lang):
            return pc.binary_join_element_wise(pa.scalar((lang + _BETWEEN).encode(), pa.binary()), words, pa.scalar(b"", pa.binary()))

        def sums():
            if not distinct:
                return
            words, places = united(distinct)
            for kind, names in (("groups", list(groups)), ("docs", [(lang, None) for lang in langs_of])):
                keys, n = added([(keys & ~WORD | at[keys & WORD], n) for at, (keys, n) in zip(places, found_in[kind])])
                cuts, found = np.searchsorted(keys, np.arange(len(names) + 1) << 32), []
                for (lang, source), a, b in zip(names, cuts, cuts[1:]):
                    terms, counts, weight = tagged(words.take(pa.array(keys[a:b] & WORD)), lang), n[a:b], 1
                    if kind == "docs":
                        found.append((lang, source, None, terms, counts))
                        continue
                    while len(counts):
                        odd = counts & 1 == 1
                        found.append((lang, source, weight, terms.filter(pa.array(odd)), counts))
                        terms, counts, weight = terms.filter(pa.array(counts > 1)), counts[counts > 1] >> 1, weight * 2
                found = [x for x in found if len(x[3])]
                if found:
                    yield batch(found, kind == "docs")
                found_in[kind].clear()
            for held in (distinct, groups, langs_of):
                held.clear()

        for part in slices(batches):
            langs, sources = part.column("lang").to_pylist(), part.column("source").to_pylist()
            group, lang = groups.of(list(zip(langs, sources))), langs_of.of(langs)
            words, ids, n = words_of(part.column("text"), _TABLE)
            distinct.append(words)
            ids, doc = ids.astype(np.int64), np.repeat(np.arange(len(n)), n)
            found_in["groups"].append(added([(group[doc] << 32 | ids, None)]))
            once, _ = added([(doc << 32 | ids, None)])
            if summed:
                found_in["docs"].append(added([(lang[once >> 32] << 32 | once & WORD, None)]))
            else:
                cuts = np.searchsorted(once, np.arange(len(n) + 1) << 32)
                terms = [tagged(words.take(pa.array(once[a:b] & WORD)), x) for x, a, b in zip(langs, cuts, cuts[1:])]
                yield batch([*zip(langs, sources, [None] * len(langs), terms, terms)], None)
            if sum(len(keys) for found in found_in.values() for keys, _ in found) > FLUSH:
                yield from sums()
        yield from sums()

    return rows.mapInArrow(run, "lang string, source string, terms array<string>, weight long, docs array<long>")


def with_documents(found: DataFrame, most: int) -> DataFrame:
    """Rows of ``terms``, in as many of which a (term, docs) of ``found`` stands
    as documents hold it, in ``most`` if they are more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            docs = np.minimum(np.asarray(part.column("docs")), most)
            order = np.argsort(-docs, kind="stable")
            n = np.searchsorted(-docs[order], -np.arange(1, docs.max(initial=0) + 1), side="right")
            at = order[ranges(np.zeros(len(n), np.int64), n)]
            ends = pa.array(np.cumsum(np.append(0, n)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, part.column("term").take(pa.array(at)).cast(pa.string()))], ["terms"])

    return found.select("term", "docs").mapInArrow(run, "terms array<string>")


def term_counts(rows: DataFrame, min_docs: int, fit_terms: int) -> DataFrame:
    """(lang, source, term, n): occurrences of the kept terms, a row per source
    that has the term."""
    spark = rows.sparkSession
    read = written(with_terms(rows, summed=True), "divergence-terms")
    found = written(read.where("weight is null").select(F.inline(F.arrays_zip(F.col("terms").alias("term"), "docs")))
                    .groupBy("term").agg(F.sum("docs").alias("docs")), "divergence-documents")
    shards = math.ceil(max(found.count(), 1) / fit_terms)
    out = None
    for shard in range(shards):
        def mine(term: Column) -> Column:
            return F.pmod(F.xxhash64(term), F.lit(shards)) == shard

        documents = with_documents(found if shards == 1 else found.where(mine(F.col("term"))), min_docs)
        # a term of its own in enough rows, so that a fit on no kept term stands
        guard = spark.range(min_docs).select(F.array(F.lit(_BETWEEN * 2)).alias("terms"))
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=_LARGEST) \
            .fit(documents.unionByName(guard))
        langs, _, terms = zip(*(name.rpartition(_BETWEEN) for name in model.vocabulary))
        names = pa.table({"index": pa.array(range(len(terms)), pa.int32()), "lang": pa.array(langs, pa.string()), "term": pa.array(terms, pa.string())})
        occurring = read.where("weight is not null")
        if shards > 1:
            occurring = occurring.withColumn("terms", F.filter("terms", mine))
        # a term has one language
        counted = model.transform(occurring).select("source", "weight", F.unwrap_udt("vector").alias("v")) \
            .select("source", "weight", F.inline(F.arrays_zip(F.col("v.indices").alias("index"), F.col("v.values").alias("n")))) \
            .groupBy("source", "index").agg(F.sum(F.col("n").cast("long") * F.col("weight")).alias("n"))
        named = counted.join(spark.createDataFrame(names), "index").select("lang", "source", "term", "n")
        named = written(named, "divergence-counts")
        out = named if out is None else out.unionByName(named)
    return out


def _share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * size)), in
    integers of any size; null where no term is kept."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTHING).cast("decimal(20,0)")
    below = F.nullif(total + SMOOTHING * size, F.lit(0)).cast("decimal(20,0)")
    return F.call_function("div", above, below) + 1


def divergence(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
               min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, fit_terms: int = FIT_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank.  Part ``pair``: the summed
    difference from each other source of the language; part ``term``: the
    terms which the source has more of than its language, the first
    ``top_terms``."""
    rows = _named(docs, lang_col, source_col, text_col)
    counts = term_counts(rows, min_docs, fit_terms)
    by_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"))
    sizes = by_lang.groupBy("lang").agg(F.count("*").alias("size"), F.sum("all_n").alias("all_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left") \
        .select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "own", "size", "all_total")))
    groups = written(groups.withColumn("least", _share(F.lit(0), F.col("total"), F.col("size"))), "divergence-groups")
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("size")))
    shares = written(shares.select("lang", "source", "term", "p", "least", "size", "all_total"), "divergence-shares")
    return _pairs(groups, shares).unionByName(_terms(shares, by_lang, top_terms))


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    def gap(a: str, b: str) -> Column:
        return F.abs(F.col(a) - F.col(b))

    other = groups.select("lang", F.col("source").alias("item"), F.col("least").alias("item_least"))
    met = groups.join(other, "lang").where("source <> item")
    # terms of one source: a row per share; the other's least share stands for "has it not"
    one = shares.groupBy("lang", "source", "p", "least").agg(F.count("*").alias("n")).join(other, "lang").where("source <> item") \
        .groupBy("lang", "source", "item").agg(F.sum(F.col("n") * (gap("p", "item_least") - gap("least", "item_least"))).alias("value"))
    turned = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    # terms of both: what the two sums above got wrong
    right = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("item_p"), F.col("least").alias("item_least"))
    wrong = gap("p", "item_p") - gap("p", "item_least") - gap("least", "item_p") + gap("least", "item_least")
    both = shares.join(right, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(wrong).alias("value"))
    back = both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    none = met.select("lang", "source", "item", F.coalesce(F.col("size") * gap("least", "item_least"), F.lit(0)).alias("value"))
    value = none.unionByName(one).unionByName(turned).unionByName(both).unionByName(back) \
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return _ranked(value.withColumn("part", F.lit("pair")))


def _terms(shares: DataFrame, by_lang: DataFrame, top_terms: int) -> DataFrame:
    more = shares.join(by_lang, ["lang", "term"]) \
        .withColumn("value", F.col("p") - _share(F.col("all_n"), F.col("all_total"), F.col("size"))).where("value > 0") \
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    return _ranked(more).where(F.col("rank") <= top_terms)


def _ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order)).select(*OUT)


ORACLE_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT lang, source, id, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n::HUGEINT AS all_n
          FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n,
        1 + 1000000000 * (n + 5) // (sum(n) OVER s + 5 * count(*) OVER s) AS p,
        1 + 1000000000 * (all_n + 5) // (sum(all_n) OVER s + 5 * count(*) OVER s) AS q
      FROM dense WINDOW s AS (PARTITION BY lang, source)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
           coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term)
                     WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
      FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
