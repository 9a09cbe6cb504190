"""Queries of one column each, of expressions that other queries combine."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import scores, text
from siltstone.operators import proofs
from siltstone.plans import findings as of_findings
from siltstone.plans import names, scans
from siltstone.plans.derived import CRASHES, FILES, FINDINGS, read, sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _single(name: str, query, oracle: str) -> None:
    query.__name__ = name
    QUERIES[name], ORACLE_SQL[name] = query, oracle


def _of(module, whole: str, key: str, column: str, name: str | None = None) -> None:
    name = name or column
    _single(name, lambda spark, sf_dir: module.QUERIES[whole](spark, sf_dir).select(key, F.col(column).alias(name)), f"SELECT {key}, {column} AS {name} FROM ({module.ORACLE_SQL[whole]})")


for _c in ("reach_score", "reach_boost", "blast_bonus", "severity_rank"):
    _of(names, "bounded_scores", "fingerprint", _c)
for _c, _n in (("likelihood", "likelihood"), ("impact", "norm_impact")):
    _of(names, "norm_stride", "event_id", _c, _n)
_of(of_findings, "rank_findings", "fingerprint", "score", "risk_score")
_of(scans, "fuzz_telemetry", "run_id", "signal", "coverage_signal")

_single(
    "norm_language",
    lambda spark, sf_dir: read(spark, sf_dir, FILES).select("doc_id", text.norm_language(text.language_of(F.col("path"))).alias("language")),
    sql("SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'c' WHEN 1 THEN 'python' WHEN 2 THEN 'typescript' WHEN 3 THEN 'go' WHEN 4 THEN 'c' WHEN 6 THEN 'rust' WHEN 7 THEN 'javascript' WHEN 8 THEN 'java' END AS language FROM f", f=FILES),
)
_single("clip", lambda spark, sf_dir: read(spark, sf_dir, FINDINGS).select("fingerprint", text.one_line(F.col("title"), 20).alias("clip")), sql("SELECT fingerprint, CASE WHEN length(t) > 20 THEN substr(t, 1, 19) || '…' ELSE t END AS clip FROM (SELECT fingerprint, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t FROM f)", f=FINDINGS))
_single(
    "command_name",
    lambda spark, sf_dir: read(spark, sf_dir, FINDINGS).select("fingerprint", text.command_name(F.when(F.col("ord") % 3 == 0, F.concat("source", F.lit("Command"))).when(F.col("ord") % 3 == 1, F.concat(F.lit("cmd_"), "ref_id")).otherwise(F.concat(F.lit("handle_"), "source", F.lit("_handler")))).alias("command")),
    sql("SELECT fingerprint, lower(CASE ord % 3 WHEN 1 THEN ref_id ELSE source END) AS command FROM f", f=FINDINGS),
)
_single(
    "artifact_labels",
    lambda spark, sf_dir: read(spark, sf_dir, FINDINGS).select("fingerprint", F.array_join(F.array_compact(F.array(F.when(F.col("poc_verdict") == "exploited", "PoC"), F.when(F.col("fix_verdict") == "validated", "patch"), F.when(F.col("verify_verdict") == "confirmed-exploitable", "PoC-ready"))), ",").alias("labels")),
    sql("SELECT fingerprint, concat_ws(',', CASE WHEN poc_verdict = 'exploited' THEN 'PoC' END, CASE WHEN fix_verdict = 'validated' THEN 'patch' END, CASE WHEN verify_verdict = 'confirmed-exploitable' THEN 'PoC-ready' END) AS labels FROM f", f=FINDINGS),
)
_single(
    "finding_hits",
    lambda spark, sf_dir: of_findings.anchor_hits_file(spark, sf_dir).withColumn("any_anchor", F.lit(True)).join(of_findings.match_ground_truth(spark, sf_dir).select("case_id", "id", F.lit(True).alias("first_anchor")), ["case_id", "id"], "full").select("case_id", "id", F.coalesce("first_anchor", F.lit(False)).alias("first_anchor"), F.coalesce("any_anchor", F.lit(False)).alias("any_anchor")),
    f"SELECT coalesce(a.case_id, m.case_id) AS case_id, coalesce(a.id, m.id) AS id, m.id IS NOT NULL AS first_anchor, a.id IS NOT NULL AS any_anchor FROM ({of_findings.ORACLE_SQL['anchor_hits_file']}) a FULL JOIN ({of_findings.ORACLE_SQL['match_ground_truth']}) m ON a.case_id = m.case_id AND a.id = m.id",
)
_single(
    "priority_feedback",
    lambda spark, sf_dir: read(spark, sf_dir, FINDINGS).filter(F.col("source").isin("deep-scan", "variant-hunt") & F.col("status").isin("open", "confirmed", "proven")).groupBy("repo", "file_path").agg((F.least(F.lit(5), F.count("*")) + scores.reach_boost(F.max("caller_count"))).cast("int").alias("boost")),
    sql("SELECT repo, file_path, CAST(least(5, count(*)) + least(4, CAST(round(log2(max(caller_count) + 1)) AS INTEGER)) AS INTEGER) AS boost FROM f WHERE source IN ('deep-scan', 'variant-hunt') AND status IN ('open', 'confirmed', 'proven') GROUP BY ALL", f=FINDINGS),
)
_single(
    "crash_key",
    lambda spark, sf_dir: read(spark, sf_dir, CRASHES).select("fingerprint", proofs.crash_key(F.when(F.length("fingerprint") % 5 > 0, F.col("source")), F.when(F.length("crash_key") % 2 == 0, F.concat(F.col("cwe"), F.lit(".c"))), F.length("fingerprint"), F.when(F.length("crash_key") % 3 == 0, F.col("crash_key")), F.col("cwe")).alias("key")),
    sql("SELECT fingerprint, CASE WHEN length(fingerprint) % 5 = 0 THEN 'none:' || cwe WHEN length(crash_key) % 2 = 0 THEN source || ':' || cwe || '.c:' || length(fingerprint) WHEN length(crash_key) % 3 = 0 THEN source || ':' || crash_key ELSE source || ':' || cwe END AS key FROM c", c=CRASHES),
)
_single(
    "severity_basis",
    lambda spark, sf_dir: of_findings.derive_severity(spark, sf_dir).select("fingerprint", F.col("derived_severity").alias("severity"), F.when(F.col("derived"), F.concat_ws(";", F.lit("derived"), F.concat(F.lit("claim "), F.col("judged").cast("string")))).alias("basis")),
    f"SELECT fingerprint, derived_severity AS severity, CASE WHEN derived THEN concat_ws(';', 'derived', 'claim ' || judged) END AS basis FROM ({of_findings.ORACLE_SQL['derive_severity']})",
)
_single(
    "remediation_display",
    lambda spark, sf_dir: read(spark, sf_dir, FINDINGS).select("fingerprint", F.coalesce(F.nullif(F.trim(F.when(F.col("start_line") % 4 == 0, "bound it").when(F.col("start_line") % 4 == 1, " ")), F.lit("")), F.when(F.col("fix_verdict") == "validated", F.concat(F.lit("patch: "), "file_path")), F.get(F.when(F.col("start_line") % 3 > 0, F.array(F.concat(F.lit("check "), "ref_id"), F.lit("then run"))), 0)).alias("shown")),
    sql("SELECT fingerprint, CASE WHEN start_line % 4 = 0 THEN 'bound it' WHEN fix_verdict = 'validated' THEN 'patch: ' || file_path WHEN start_line % 3 > 0 THEN 'check ' || ref_id END AS shown FROM f", f=FINDINGS),
)
