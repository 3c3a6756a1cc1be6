"""Odd input: bad urls, special characters, comment-only files, deep graphs,
snapshots on any storage, equal paths in two repositories."""

import tempfile

from pyspark.sql import functions as F


def test_reachability_follows_long_chains(spark):
    from tessera.operators.graph import reachability
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)], "src long, dst long")
    got = reachability(chain)
    assert got.count() == 70 * 71 // 2 and got.agg(F.max("depth")).first()[0] == 70
    assert reachability(chain, max_depth=2).count() == 70 + 69


def test_malformed_url(spark):
    from tessera.sources.tables import corpus_from_pages
    d = tempfile.mkdtemp(prefix="pages-", dir="/tmp")
    spark.createDataFrame([(1, "http://a.example/x", "<p>"), (2, "http://[bad", "<p>"), (3, None, None)],
                          "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    assert [r.repo for r in corpus_from_pages(spark, d).orderBy("page_id").collect()] == ["a.example", None, None]


def test_comment_only_file(spark):
    from tessera.operators.extract import description_of
    df = spark.createDataFrame([("a.py", "# one\n# two"), ("b.go", "// x"), ("c.py", "")], "p string, c string")
    assert [r[0] for r in df.select(description_of(F.col("p"), F.col("c"))).collect()] == ["one two", "x", ""]


def test_entity_with_special_characters(spark):
    from tessera.operators.memory import PRONOUN_RE
    df = spark.createDataFrame([(r"$1\d",)], "e string")
    quoted = F.replace(F.replace(F.col("e"), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    assert df.select(F.regexp_replace(F.lit("where is it now"), PRONOUN_RE, quoted)).first()[0] == r"where is $1\d now"


def test_log_with_text_instead_of_numbers(spark):
    from tessera.operators.evaluate import benchmark_log
    e = spark.createDataFrame([(1, "a", 3, 2.0, '{"k": "many"}'), (2, "a", 4, 2.0, None)],
                              "event_id long, event_type string, user_id long, value double, props string") \
        .withColumn("ts", F.current_timestamp())
    assert [r.tokens for r in benchmark_log(e).collect()] == [None, None]


def test_snapshot_reads_through_the_file_system(spark):
    from tessera.operators.misc import KNOWLEDGE_SCHEMA, knowledge_snapshot_read, knowledge_snapshot_write
    path = "file:" + tempfile.mkdtemp(prefix="snap-", dir="/tmp") + "/k"
    assert knowledge_snapshot_read(spark, path).count() == 0
    knowledge_snapshot_write(spark.createDataFrame([("t", "k", "v", "f", 0.5, 3)], KNOWLEDGE_SCHEMA), path)
    assert [tuple(r) for r in knowledge_snapshot_read(spark, path).collect()] == [("t", "k", "v", "f", 0.5, 1)]


def test_repeated_symbol_ids_are_one_symbol(spark):
    from tessera.sources.tables import symbols_from_part
    d = tempfile.mkdtemp(prefix="part-", dir="/tmp")
    spark.createDataFrame([(1, "n", "b", "t", 3), (2, "n", "b", "t", 3), (3, "n", "b", "t", 4)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{d}/part.parquet")
    s = symbols_from_part(spark, d)
    assert s.count() == 2 and s.select("id").distinct().count() == 2 and s.agg(F.min("part_key")).first()[0] == 1


def test_broadcast_is_checked_by_bytes(spark):
    from tessera.session import bounded_broadcast
    df = spark.createDataFrame([("x" * 1000, ["y" * 100])], "a string, b array<string>")

    def hinted(d):
        return "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()

    assert hinted(bounded_broadcast(df)) and not hinted(bounded_broadcast(df, max_bytes=500)) and not hinted(bounded_broadcast(df, max_rows=0))
