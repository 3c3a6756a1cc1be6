"""Hand-worked micro-fixtures (FIXTURES §4) for exact semantics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F


def one(spark, expr_fn, values, col="x", typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"{col} {typ}")
    return [r[0] for r in df.select(expr_fn(F.col(col))).collect()]


def test_t02_stem(spark):
    from tessera.functions.text import stem
    words = ["implementation", "operations", "settings", "documents", "cached", "calls", "bus", "class"]
    assert one(spark, stem, words) == ["implementat", "oper", "sett", "document", "cach", "call", "bus", "clas"]


def test_t03_camel(spark):
    from tessera.functions.text import camel_split
    assert one(spark, camel_split, ["getRepoMap", "HTTPServer"]) == [["get", "Repo", "Map"], ["H", "T", "T", "P", "Server"]]


def test_t01_keywords(spark):
    from tessera.functions.text import keywords
    out = one(spark, keywords, ["Explain the caching of settings, please"])
    assert out == [["caching", "cach", "settings", "sett"]]


def test_r02_base_score(spark):
    from tessera.operators.symbol import base_score
    df = spark.createDataFrame([(q,) for q in ["RepoMap", "Repo", "map", "epo", "MapTree"]], "q string")
    got = [round(r[0], 6) for r in df.select(base_score(F.col("q"), F.lit("RepoMap"))).collect()]
    assert got == [1.0, 1.0, 1.0, 0.8, 0.35]


def test_t06_call_target(spark):
    from tessera.operators.calls import call_target
    assert one(spark, call_target, ["who calls send_chat", "Who calls RepoMap", "where is Foo used"]) == \
        ["send_chat", "RepoMap", "Foo"]


def test_w05_snippet(spark):
    from tessera.operators.windows import with_snippet
    lines = [f"l{i}" for i in range(1, 11)]
    flags = [i == 4 for i in range(10)]
    df = spark.createDataFrame([(lines, flags)], "lines array<string>, flags array<boolean>")
    got = with_snippet(df, "lines", "flags", 1, None).select("snippet").first()[0]
    assert got.split("\n") == ["...", " 4: l4", ">5: l5", " 6: l6"]


def test_c01_greedy_pack(spark):
    from tessera.operators.context import greedy_pack
    rows = [(1, 1, "a", 0.9, 5), (1, 2, "b", 0.8, 9), (1, 3, "c", 0.7, 3), (1, 4, "d", 0.6, 4)]
    df = spark.createDataFrame(rows, "query_id int, rank int, file string, score double, tokens long")
    r = greedy_pack(df, 12).first()
    assert (r["tokens"], r["selected"], r["dropped"], r["kept_files"]) == (12, 3, 1, "a|c|d")


def test_p05_is_test(spark):
    from tessera.operators.corpus import is_test_file
    paths = ["x/foo_test.go", "test_foo.py", "foo_spec.rb", "FooTest.java", "main.go"]
    assert one(spark, is_test_file, paths) == [True, True, True, True, False]


def test_i01_i02_manifest(spark):
    from tessera.operators.incremental import index_state, index_update_counts, manifest_diff
    old = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", "3")], "repo string, path string, file_hash string")
    new = spark.createDataFrame([("r", "a", "1"), ("r", "b", "9"), ("r", "d", "4")], "repo string, path string, file_hash string")
    d = manifest_diff(old, new)
    c = index_update_counts(d).first()
    assert (c["changed"], c["skipped"], c["deleted"], c["total"], c["added"]) == (2, 1, 1, 3, 1)
    s = index_state(d).first()
    assert (s["state"], s["changed"], s["deleted"]) == ("stale", 1, 1)


def test_m04_lru(spark):
    from tessera.operators.memory import lru_replay
    acc = spark.createDataFrame([(0, k, dt.datetime(2024, 1, 1, 0, 0, i), i) for i, k in enumerate("ABACB")],
                                "cache int, key string, ts timestamp_ntz, ord int")
    r = lru_replay(acc, 2).first()
    assert (r["hits"], r["misses"], round(r["hit_rate"], 6)) == (1, 4, 0.2)


def test_m02_knowledge_hits(spark):
    from tessera.operators.memory import knowledge_state
    t0 = dt.datetime(2024, 1, 1)
    rows = [("k", "store", t0, 0, "v", 1.0)] + [("k", "lookup", t0 + dt.timedelta(seconds=i), i, None, None) for i in (1, 2, 3)]
    log = spark.createDataFrame(rows, "key string, kind string, ts timestamp_ntz, ord int, value string, confidence double")
    assert knowledge_state(log).first()["hit_count"] == 4


def test_m06_ttl(spark):
    from tessera.operators.memory import asof_discovery
    t0 = dt.datetime(2024, 1, 1)
    s = spark.createDataFrame([(1, t0, 0, 0.9), (2, t0, 1, 0.9)], "key int, ts timestamp_ntz, ord int, confidence double")
    lk = spark.createDataFrame([(1, t0 + dt.timedelta(seconds=3600), 2), (2, t0 + dt.timedelta(seconds=3601), 3)],
                               "key int, ts timestamp_ntz, ord int")
    got = {r["key"]: r["hit"] for r in asof_discovery(s, lk, 3600).collect()}
    assert got == {1: True, 2: False}


def test_m10_pronouns(spark):
    from tessera.operators.memory import resolve_pronouns
    turns = spark.createDataFrame([(1, 0, "user", "Where is RepoMap?"), (1, 1, "user", "who uses it")],
                                  "conv_id int, turn int, role string, text string")
    got = {r["turn"]: r["resolved"] for r in resolve_pronouns(turns).collect()}
    assert got[1] == "who uses RepoMap"


def test_e03_research_score(spark):
    from tessera.operators.evaluate import research_score
    df = spark.createDataFrame([(0.236, 0.893, 509.2, 0.0135, 1.0)], "a double, c double, t double, l double, p double")
    v = df.select(research_score(F.col("a"), F.col("c"), F.col("t"), F.col("l"), F.col("p"))).first()[0]
    assert v == pytest.approx(39.42, abs=0.08)


def test_e05_stddev(spark):
    df = spark.createDataFrame([(x,) for x in [0.2357, 0.1857, 0.2071, 0.2786, 0.2071]], "a double")
    assert df.agg(F.stddev_pop("a")).first()[0] == pytest.approx(0.0321, abs=1e-4)


def test_e12_improvements(spark):
    from tessera.operators.evaluate import improvement_ranking
    items = spark.createDataFrame([(0, 0, "High", "Low", 1.0), (0, 1, "Low", "High", 1.0), (0, 2, "High", "Low", 0.3)],
                                  "grp int, ord int, impact string, effort string, confidence double")
    got = [round(r["priority"], 6) for r in improvement_ranking(items).orderBy("ord").collect()]
    assert got == [7.0, 0.0, 2.1]


def test_g03_flow_confidence(spark):
    from tessera.operators.graph import flow_confidence
    df = spark.createDataFrame([(n,) for n in [0, 3, 4, 8]], "n int")
    assert [r[0] for r in df.select(flow_confidence(F.col("n"))).collect()] == [0.0, 0.3, 0.5, 0.7]


def test_r19_module_confidence(spark):
    from tessera.operators.graph import module_confidence
    df = spark.createDataFrame([(x,) for x in [0.05, 0.30, 0.50, 0.80]], "s double")
    assert [r[0] for r in df.select(module_confidence(F.col("s"))).collect()] == [0.2, 0.65, 0.8, 0.95]


def test_t12_t17_classes(spark):
    from tessera.functions.classify import answer_type, query_class
    qs = ["who calls send_chat", "Who calls RepoMap", "", "where is RepoMap", "is there a cache"]
    df = spark.createDataFrame([(q,) for q in qs], "text string")
    lab, conf = query_class(F.col("text"))
    typ, tconf = answer_type(F.col("text"))
    rows = df.select(lab, conf, typ, tconf).collect()
    assert [(r[0], round(r[1], 6)) for r in rows[:3]] == [("call", 0.9), ("call", 0.95), ("repository", 0.5)]
    assert (rows[3][2], rows[3][3]) == ("location", 0.9)
    assert (rows[4][2], rows[4][3]) == ("yes_no", 0.85)
    plan = df.select(answer_type(F.col("text"), F.lit("plan"))[0]).first()[0]
    assert plan == "plan"


def test_p08_quality_gate(spark):
    from tessera.plans.routing import quality_gate
    res = spark.createDataFrame([("a", "f1", 0.12), ("b", "f1", 0.3), ("c", "f1", 0.9), ("c", "f2", 0.5)],
                                "query_id string, file string, score double")
    qs = spark.createDataFrame([("a", "explanation"), ("b", "location"), ("c", "improvement")],
                               "query_id string, answer_type string")
    got = {r["query_id"]: r["passed"] for r in quality_gate(res, qs).collect()}
    assert got == {"a": False, "b": True, "c": False}


def test_p03_result_filter(spark):
    from tessera.plans.routing import result_filter
    res = spark.createDataFrame([("q", "src/a.py", 0.9), ("q", "mytmp/b.py", 0.8), ("q", "x/run.log", 0.7),
                                 ("q", "src/c.py", 0.1), ("q", "src/d.py", 0.5), ("q", "src/e.py", 0.4)],
                                "query_id string, file string, score double")
    res = res.withColumn("cap", F.lit(2))
    got = [r["file"] for r in result_filter(res, 0.15, "cap").orderBy("filtered_rank").collect()]
    assert got == ["src/a.py", "src/d.py"]


def test_p09_needs_compression(spark):
    from tessera.plans.routing import needs_compression
    df = spark.createDataFrame([(21, 10), (20, 10), (999, 0)], "o int, m int")
    assert [r[0] for r in df.select(needs_compression(F.col("o"), F.col("m"))).collect()] == [True, False, False]


def test_c06_location_and_caller(spark):
    from tessera.operators.compress import compress
    rows = [("q", i, f"/repo/internal/pkg{i}/f{i}.go", "", i * 10, i * 10 + 5) for i in range(1, 6)]
    res = spark.createDataFrame(rows, "query_id string, rank int, file string, snippet string, line_from int, line_to int")
    qs = spark.createDataFrame([("q", "location", 200)], "query_id string, answer_type string, budget int")
    ctx = compress(res, qs).first()["context"]
    assert ctx.splitlines() == ["internal/pkg1/f1.go:10-15", "internal/pkg2/f2.go:20-25", "internal/pkg3/f3.go:30-35"]
    res2 = spark.createDataFrame([("q", 1, "a.go", "  x()\n  y()", 0, 0), ("q", 2, "b.go", "x()\n", 0, 0)],
                                 "query_id string, rank int, file string, snippet string, line_from int, line_to int")
    qs2 = spark.createDataFrame([("q", "caller", 500)], "query_id string, answer_type string, budget int")
    assert compress(res2, qs2).first()["context"] == "Callers:\n  x()\n  y()\n"


def test_c09_clean_snippet(spark):
    from tessera.operators.compress import clean_snippet
    text = "\n".join(["// Code generated by x", "a", "", "", "import (", "  \"a\"", "  \"b\"", "  \"c\"", ")", "b"])
    got = one(spark, clean_snippet, [text])[0].split("\n")
    assert got == ["a", "", "import (", "  \"a\"", "  \"b\"", "  // ... imports truncated ...", ")", "b"]


def test_t09_short_path(spark):
    from tessera.functions.text import short_path
    assert one(spark, short_path, ["/r/internal/retrieval/fts.go", "/r/x/cmd/root.go", "/r/a/b.py", "myinternal/x.go"]) == \
        ["internal/retrieval/fts.go", "cmd/root.go", "b.py", "x.go"]


def test_m04_lru_bounded_matches_brute_force(spark):
    """Random access logs: the bounded LRU replay equals a brute-force LRU."""
    import random
    from collections import OrderedDict
    from tessera.operators.memory import lru_accesses
    rnd = random.Random(3)
    rows, expect = [], {}
    for cache in range(4):
        keys = [rnd.choice("ABCDEFG" if cache % 2 else "AB") for _ in range(60)]
        lru = OrderedDict()
        for i, k in enumerate(keys):
            hit = k in lru
            if hit:
                lru.move_to_end(k)
            else:
                lru[k] = True
                if len(lru) > 3:
                    lru.popitem(last=False)
            expect[(cache, i)] = hit
            rows.append((cache, k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i))
    df = spark.createDataFrame(rows, "cache int, key string, ts timestamp_ntz, ord int")
    got = {(r["cache"], r["ord"]): r["hit"] for r in lru_accesses(df, 3, window=4).collect()}
    assert got == expect


def test_m10_two_level_matches_brute_force(spark, monkeypatch):
    import random
    from tessera.operators import memory as M
    monkeypatch.setattr(M, "TURN_BUCKET", 2)
    rnd = random.Random(5)
    rows, expect = [], {}
    for conv in range(3):
        last = None
        for turn in range(12):
            name = rnd.choice([None, None, "RepoMap", "TokenCache", "SessionStore"])
            text = (f"look at {name} now" if name else "what about it") if rnd.random() < 0.9 else "it"
            rows.append((conv, turn, "user", text))
            expect[(conv, turn)] = last
            if name and text.startswith("look"):
                last = name
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["last_resolved"] for r in M.resolve_pronouns(df).collect()}
    assert got == expect
