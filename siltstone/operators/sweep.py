"""Jobs of a sweep: producers beside the shards that they can work on, and why others are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.ranking import placed
from siltstone.operators.stores import written

#: Languages of web and of native code.
WEB = ("Java", "Kotlin", "Scala", "JavaScript", "TypeScript", "Python", "Ruby", "PHP", "Go")
NATIVE = ("C", "C++", "Rust", "Objective-C", "Go")
#: Fixed values, in their order: producer, scope, languages (none: any), what it requires, whether it uses the network, runs code, is for deep sweeps only, and is on by default.
PRODUCERS = (
    ("threat-hunt", "repo", (), ("threat-model",), False, False, False, True),
    ("deep-scan", "shard", (), (), False, False, True, False),
    ("deep-hunt", "shard", (), (), False, False, True, False),
    ("taint-analysis", "shard", (), (), False, False, False, True),
    ("authz", "shard", WEB, (), False, False, False, True),
    ("logic-hunt", "shard", WEB, (), False, False, False, True),
    ("crypto-review", "shard", (), (), False, False, False, True),
    ("sharp-edges", "shard", (), (), False, False, False, True),
    ("systems-hunt", "shard", NATIVE, (), False, False, False, True),
    ("binary-recon", "repo", (), ("binaries",), False, False, False, True),
    ("iac", "repo", (), (), False, False, False, True),
    ("sast", "shard", (), ("semgrep",), False, False, False, True),
    ("supply-chain", "repo", (), (), True, False, False, True),
    ("fuzz-discover", "repo", NATIVE, (), False, True, False, False),
)
_SCHEMA = "ord long, producer string, scope string, langs array<string>, requires array<string>, network boolean, executes boolean, deep_only boolean, by_default boolean"
#: Producers are configuration, sent to every task; more of them are an error.
MOST = 1000


def registry(spark: SparkSession, own=()) -> DataFrame:
    """The producers' table; producers of one's own come last, or replace those of their name."""
    rows = {p[0]: p for p in (*PRODUCERS, *own)}
    return spark.createDataFrame([(i, n, s, list(a), list(r), *flags) for i, (n, s, a, r, *flags) in enumerate(rows.values(), 1)], _SCHEMA)


def jobs(producers: DataFrame, shards: DataFrame, there: DataFrame, *, offline: bool = False, deep: bool = False, requested: list[str] | None = None) -> DataFrame:
    """``repo, producer, scope, shard_id, job_id, budget, reason``: a sweep's jobs, and the producers that it skips.

    ``shards(repo, shard_id, languages, n_files)``, ``there(repo, thing)`` what a repo
    has.  Producers are those requested or, without a request, the default ones and in
    deep sweeps the deep ones.  One is skipped that would use the network or run
    code offline, that requires something the repo lacks (the first such thing by
    name is told), or of whose languages there is no shard.  Jobs are numbered in
    each repo by producer and shard; skipped producers have a reason instead.
    """
    if producers.limit(MOST + 1).count() > MOST:
        raise ValueError(f"more than {MOST} producers")
    wanted = F.col("producer").isin(requested) if requested else F.when(F.col("deep_only"), F.lit(deep)).otherwise(F.col("by_default"))
    chosen = F.broadcast(producers.filter(wanted))
    shards, there = written(shards, "shards"), written(there.distinct(), "there")
    repos = shards.select("repo").union(there.select("repo")).distinct()
    # every repo has a row for every producer, a job or a reason
    plan = written(repos.crossJoin(chosen), "plan")
    # required things without those that are there: none left is fit
    required = plan.select("repo", "producer", F.explode("requires").alias("thing"))
    lacks = required.join(there, ["repo", "thing"], "left_anti").groupBy("repo", "producer").agg(F.min("thing").alias("lacks"))
    unfit = (
        F.when(F.lit(offline) & F.col("network"), "offline: may use the network")
        .when(F.lit(offline) & F.col("executes"), "offline: runs code of the target")
        .when(F.col("lacks").isNotNull(), F.concat(F.lit("requirement not met: "), "lacks"))
    )
    judged = written(plan.join(lacks, ["repo", "producer"], "left").withColumn("reason", unfit), "judged")
    none = F.lit(None)
    able = judged.filter("reason is null")
    whole = able.filter("scope = 'repo'").select("repo", "ord", "producer", "scope", none.cast("string").alias("shard_id"), none.cast("int").alias("budget"))
    spoken = shards.select("repo", "shard_id", "n_files", F.filter("languages", lambda x: x != "Other").alias("languages"))
    speaks = (F.size("langs") == 0) | F.arrays_overlap("langs", "languages")
    budget = F.least(F.lit(24), F.greatest(F.lit(4), F.ceil(F.col("n_files") / 3))).cast("int")
    parts = spoken.join(able.filter("scope = 'shard'"), "repo").filter(speaks).select("repo", "ord", "producer", "scope", "shard_id", budget.alias("budget"))
    made = written(whole.union(parts), "jobs")
    idle = able.filter("scope = 'shard'").join(made.select("repo", "producer"), ["repo", "producer"], "left_anti").withColumn("reason", F.lit("no shard of its languages"))
    left = judged.filter("reason is not null").select("repo", "producer", "scope", "reason").union(idle.select("repo", "producer", "scope", "reason"))
    numbered = placed(made, ["repo"], [("ord", False)], "shard_id", prefix=12)
    done = numbered.select("repo", "producer", "scope", "shard_id", F.concat(F.lit("j"), F.col("place").cast("string")).alias("job_id"), "budget", none.cast("string").alias("reason"))
    return done.union(left.select("repo", "producer", "scope", none.cast("string"), none.cast("string"), none.cast("int"), "reason"))
