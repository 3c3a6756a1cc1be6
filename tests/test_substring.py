"""The rarest-piece join against a nested loop."""

import random

import pytest

from tessera.operators.substring import containing


@pytest.mark.parametrize("n", [3, 2])
def test_pairs_match_a_nested_loop(spark, n):
    rng = random.Random(n)
    letters = "ab%_.é\n"
    strings = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(120)] + [None, "", "aaa", "\U0001f600ab"]
    sought = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 5))) for _ in range(80)] + [None, "", "zzz", "aaaz", "\U0001f600a", "\U0001f600"]
    got = [tuple(r) for r in containing(spark.createDataFrame([(s, 1) for s in strings + strings[:9]], "name string, n int"),
                                        spark.createDataFrame([(s,) for s in sought + sought[:9]], "q string"), n).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(q, s) for q in sought for s in strings if q and s and q in s}


def test_nothing_sought(spark):
    none = spark.createDataFrame([], "q string")
    some = spark.createDataFrame([("abc",)], "q string")
    assert containing(some, none).count() == 0 == containing(none, some).count()


def test_callers_by_part_of_a_name(spark):
    from tessera.operators.calls import find_callers
    edges = spark.createDataFrame([("main", "m.py", "sendChat", "m.py", 3), ("run", "r.py", "resendChat", "r.py", 9), ("x", "x.py", "post", "x.py", 1)],
                                  "caller_name string, caller_file string, callee_name string, file string, line int")
    q = spark.createDataFrame([(1, "who calls SENDCHAT?"), (2, "who calls post"), (3, "who calls nothing_like_it"), (4, "")], "query_id int, text string")
    got = sorted((r.query_id, r.callee_name) for r in find_callers(q, edges).collect())
    assert got == [(1, "resendChat"), (1, "sendChat"), (2, "post")]
    plan = find_callers(q, edges)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_short_passages_have_their_files(spark):
    from tessera.operators.evaluate import passage_ground_truth
    corpus = spark.createDataFrame([("r", "a", "one xtwo three four"), ("r", "b", "two  three"), ("r", "c", "none")], "repo string, path string, content string")
    passages = [(1, "two three"), (2, "wo"), (3, "one xtwo three"), (4, " "), (5, "xtwo three four"), (6, "three")]
    got = passage_ground_truth(corpus, spark.createDataFrame(passages, "query_id int, text string"))
    assert sorted((r.query_id, r.path) for r in got.collect()) == [(1, "a"), (2, "a"), (2, "b"), (3, "a"), (5, "a"), (6, "a"), (6, "b")]
