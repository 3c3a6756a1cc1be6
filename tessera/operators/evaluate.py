"""Evaluation, leaderboards, calibration — aggregations and
windows over a benchmark log ``(repository, retriever, category,
correct, tokens, latency_ms, confidence, ...)``.

Every statistic is a grouped aggregate (partial + final, one shuffle on
small keys) followed by windows over the (tiny) per-group result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast, cut_lineage
from .substring import containing

# FIXED VALUES: research-score weights (E03) and the $ price per million
# tokens used for cost efficiency.
W_ACC, W_COV, W_TOKEN, W_LAT, W_PASS = 0.40, 0.25, 0.20, 0.10, 0.05
USD_PER_MTOK = 5.0
CATEGORIES = ["definition", "caller", "reference", "architecture", "flow", "concept", "repository"]


def benchmark_log(events: DataFrame) -> DataFrame:
    """Benchmark log derived from the ``events`` table (FIXTURES §3):
    retriever = event_type, repository = user_id % 5, latency = value*10,
    tokens = props.k * 10, correct = event_id % 3 == 0; category =
    user_id % 7 over the seven ground-truth categories; confidence =
    min(1, value / 50); coverage hit = props.k >= 50."""
    cats = F.array(*[F.lit(c) for c in CATEGORIES])
    k = F.get_json_object("props", "$.k").try_cast("int")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("retriever"),
        F.concat(F.lit("repo"), (F.col("user_id") % 5).cast("string")).alias("repository"),
        F.element_at(cats, (F.col("user_id") % 7 + 1).cast("int")).alias("category"),
        (F.col("value") * 10).cast("long").alias("latency_ms"),
        (k * 10).alias("tokens"),
        (F.col("event_id") % 3 == 0).alias("correct"),
        (k >= 50).alias("covered"),
        F.least(F.lit(1.0), F.col("value") / 50.0).alias("confidence"),
        F.col("ts").alias("timestamp"),
    )


def research_score(acc: Column, coverage: Column, avg_tokens: Column, latency_s: Column,
                   pass_rate: Column) -> Column:
    """100·(.40 acc + .25 cov + .20 acc·100/tokens + .10 min(1, acc/lat_s/100) + .05 pass)."""
    return 100 * (W_ACC * acc + W_COV * coverage + W_TOKEN * acc * 100 / avg_tokens
                  + W_LAT * F.least(F.lit(1.0), acc / latency_s / 100) + W_PASS * pass_rate)


def per_repo_retriever(log: DataFrame) -> DataFrame:
    """E03 rows: one per (repository, retriever)."""
    g = log.groupBy("repository", "retriever").agg(
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg(F.col("covered").cast("double")).alias("coverage"),
        F.avg("tokens").alias("avg_tokens"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.avg(F.col("tokens").isNotNull().cast("double")).alias("pass_rate"),
        F.count(F.lit(1)).alias("n"))
    return g.withColumn("score", research_score(F.col("accuracy"), F.col("coverage"), F.col("avg_tokens"),
                                                F.col("avg_latency_ms") / 1000.0, F.col("pass_rate")))


def global_leaderboard(rows: DataFrame) -> DataFrame:
    """Mean over repositories per retriever; E05 accuracy std-dev;
    ranked by score."""
    g = rows.groupBy("retriever").agg(
        F.avg("score").alias("score"), F.avg("accuracy").alias("accuracy"),
        F.avg("avg_tokens").alias("avg_tokens"), F.avg("avg_latency_ms").alias("avg_latency_ms"),
        F.avg("coverage").alias("coverage"), F.stddev_pop("accuracy").alias("accuracy_std"))
    return g.withColumn("rank", F.rank().over(Window.orderBy(F.desc("score"))))


def efficiency(rows: DataFrame) -> DataFrame:
    """Means of per-repository ratios (not ratios of means)."""
    eff = F.col("accuracy") * 100 / (F.col("avg_tokens") / 100)
    return rows.groupBy("retriever").agg(
        F.avg(eff).alias("acc_per_100_tokens"),
        F.avg(F.col("accuracy") / (F.col("avg_tokens") * USD_PER_MTOK / 1e6)).alias("correct_per_dollar"),
        F.avg(F.col("accuracy") / (F.col("avg_latency_ms") / 1000.0)).alias("correct_per_second"))


def repository_breakdown(rows: DataFrame) -> DataFrame:
    """Per repository best/worst retriever, best accuracy, min
    tokens, min latency (ties broken by retriever name)."""
    return rows.groupBy("repository").agg(
        F.max_by("retriever", F.struct(F.col("score"), F.col("retriever"))).alias("best_retriever"),
        F.min_by("retriever", F.struct(F.col("score"), F.col("retriever"))).alias("worst_retriever"),
        F.max("accuracy").alias("best_accuracy"),
        F.min("avg_tokens").alias("min_tokens"),
        F.min("avg_latency_ms").alias("min_latency_ms"))


def category_leaderboard(log: DataFrame) -> DataFrame:
    """Accuracy per (category, retriever) plus the cube totals."""
    return (log.cube("category", "retriever")
            .agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")))


def router_audit(log: DataFrame) -> DataFrame:
    """Oracle accuracy (best retriever per (category, repository),
    averaged) vs the best single static retriever; gap between them."""
    cell = log.groupBy("category", "repository", "retriever").agg(
        F.avg(F.col("correct").cast("double")).alias("acc"))
    oracle = cell.groupBy("category", "repository").agg(F.max("acc").alias("best")).agg(
        F.avg("best").alias("oracle_accuracy"))
    static = log.groupBy("retriever").agg(F.avg(F.col("correct").cast("double")).alias("acc")).agg(
        F.max("acc").alias("best_static_accuracy"))
    both = (oracle.select(F.lit("oracle").alias("kind"), F.col("oracle_accuracy").alias("v"))
            .unionByName(static.select(F.lit("static").alias("kind"), F.col("best_static_accuracy").alias("v"))))
    out = both.agg(F.max(F.when(F.col("kind") == "oracle", F.col("v"))).alias("oracle_accuracy"),
                   F.max(F.when(F.col("kind") == "static", F.col("v"))).alias("best_static_accuracy"))
    return out.withColumn("oracle_gap", F.col("oracle_accuracy") - F.col("best_static_accuracy"))


def failure_analysis(log: DataFrame) -> DataFrame:
    """Count and share per failure reason."""
    reason = (F.when(F.col("correct"), "ok")
              .when(F.col("tokens") == 0, "no_result")
              .when(F.col("latency_ms") >= 400, "slow")
              .when(~F.col("covered"), "wrong_routing")
              .otherwise("wrong_file"))
    g = log.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def calibration(log: DataFrame) -> DataFrame:
    """E11 calibration error |avg confidence − accuracy| and E13 utility."""
    g = log.groupBy("retriever").agg(
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("tokens").alias("avg_tokens"), F.avg("latency_ms").alias("avg_latency_ms"))
    g = g.withColumn("calibration_error", F.abs(F.col("avg_confidence") - F.col("accuracy")))
    return g.withColumn("utility", 0.5 * F.col("accuracy") + 0.2 * (1 - F.col("avg_tokens") / 3000)
                        + 0.15 * (1 - F.col("avg_latency_ms") / 1000) + 0.15 * (1 - F.col("calibration_error")))


def winner_pick(log: DataFrame) -> DataFrame:
    """E11 per-query winner: max of .50 correct + .20 efficiency + .15
    confidence + .10 latency + .05 matches among correct rows; a query
    with no correct retriever has no winner.  Query = (user, minute)."""
    q = log.withColumn("query", F.concat_ws(":", F.col("repository"),
                                            F.date_format("timestamp", "yyyyMMddHHmm")))
    util = (0.5 * F.col("correct").cast("double")
            + 0.2 * (1 - F.least(F.lit(1.0), F.col("tokens") / 3000.0))
            + 0.15 * F.col("confidence")
            + 0.1 * (1 - F.least(F.lit(1.0), F.col("latency_ms") / 1000.0))
            + 0.05 * F.col("covered").cast("double"))
    w = Window.partitionBy("query").orderBy(F.desc("util"), F.asc("id"))
    return (q.where("correct").withColumn("util", util)
            .withColumn("rn", F.row_number().over(w)).where("rn = 1")
            .select("query", F.col("retriever").alias("winner"), "util"))


IMPACT = {"Low": 0, "Medium": 1, "High": 2}


def improvement_ranking(items: DataFrame, k: int = 5) -> DataFrame:
    """(2·impact + 1.5·(2 − effort))·confidence, stable descending
    (ties keep input order), top ``k`` per group."""
    lvl = lambda c: F.when(c == "High", 2).when(c == "Medium", 1).otherwise(0)
    s = (2 * lvl(F.col("impact")) + 1.5 * (2 - lvl(F.col("effort")))) * F.col("confidence")
    w = Window.partitionBy("grp").orderBy(F.desc("priority"), F.asc("ord"))
    return items.withColumn("priority", s).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def passage_ground_truth(corpus: DataFrame, passages: DataFrame) -> DataFrame:
    """S22/J11 ground truth: the files whose content contains each passage
    verbatim.  Files are probed by a word of the passage (equi-join) and
    verified with ``contains``: its longest interior word, which stands alone
    between white space wherever the passage occurs, or, in a passage of one or
    two words, every word of the files that holds its longest one.  A blank
    passage has no files."""
    words = F.filter(F.split("text", r"\s+", -1), lambda w: w != "")
    n = F.size(words)
    inner = F.when(n >= 3, F.slice(words, 2, F.greatest(n - 2, F.lit(0)))).otherwise(words)
    key = F.aggregate(inner, F.lit(""), lambda acc, w: F.when(F.length(w) > F.length(acc), w).otherwise(acc))
    p = cut_lineage(passages.select("query_id", F.col("text").alias("t"), key.alias("key"), (n >= 3).alias("alone")).where("key <> ''"))
    toks = corpus.select("repo", "path", F.explode(F.array_distinct(F.split("content", r"\s+", -1))).alias("tok"))
    asked = p.where("alone").select("query_id", "t", F.col("key").alias("tok"))
    short = p.where("not alone").select("query_id", "t", "key")
    if not short.isEmpty():
        held = containing(toks.select("tok"), short.select("key"))
        asked = asked.unionByName(short.join(held, F.col("key") == F.col("sought")).select("query_id", "t", F.col("string").alias("tok")))
    # only words meet; the text comes back for the files that hold one
    files = bounded_broadcast(cut_lineage(toks.join(bounded_broadcast(asked), "tok").select("query_id", "t", "repo", "path").distinct()))
    return corpus.select("repo", "path", "content").join(files, ["repo", "path"]) \
        .where(F.col("content").contains(F.col("t"))).select("query_id", "repo", "path").distinct()


def retrieval_evidence(results: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """Per question with ground truth — hit (any expected file in the
    top k of all repositories together), first relevant rank, precision@k,
    recall@k (strict path equality)."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "rank", "repo", "file")
    r = results.select("query_id", F.row_number().over(w).alias("rank"), F.col("file").alias("path")).where(F.col("rank") <= k)
    exp = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expected"))
    hits = r.join(truth.select("query_id", "path").distinct(), ["query_id", "path"])
    hq = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hit"), F.min("rank").alias("first_rank"))
    nr = r.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_results"))
    j = exp.join(nr, "query_id", "left").join(hq, "query_id", "left").fillna({"n_results": 0, "n_hit": 0})
    return j.select("query_id", "n_expected", "n_results", "n_hit", (F.col("n_hit") > 0).alias("hit"),
                    F.when(F.col("first_rank").isNotNull(), 1.0 / F.col("first_rank")).otherwise(0.0).alias("rr"),
                    F.when(F.col("n_results") > 0, F.col("n_hit") / F.col("n_results")).otherwise(0.0).alias("precision"),
                    (F.col("n_hit") / F.col("n_expected")).alias("recall"))


def dataset_report(truth: DataFrame, questions: DataFrame, category_col: str, approx: bool = False) -> DataFrame:
    """Cases and distinct expected files per category plus a total
    row (rollup); ``approx`` adds a HyperLogLog distinct count."""
    q = questions.join(truth, "query_id", "left")
    aggs = [F.countDistinct("query_id").alias("cases"),
            F.countDistinct(F.when(F.col("path").isNotNull(), F.col("query_id"))).alias("with_expected"),
            F.countDistinct("path").alias("distinct_files")]
    if approx:
        aggs.append(F.approx_count_distinct("path").alias("approx_files"))
    return q.rollup(category_col).agg(*aggs)
