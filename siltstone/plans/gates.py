"""Queries of gates over derived findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import gates
from siltstone.plans.derived import FINDINGS, SYMBOLS, read, sql

_NUMBER = "TRY_CAST(nullif(regexp_extract(cwe, '\\d+', 0), '') AS BIGINT)"


def gate_taint(spark, sf_dir):
    f = read(spark, sf_dir, FINDINGS).withColumn("evidence_level", F.when(F.col("start_line") % 4 == 0, "candidate").when(F.col("start_line") % 4 == 1, "linked").when(F.col("start_line") % 4 == 2, "path"))
    return f.select("fingerprint", gates.evidence_gate().alias("g")).select("fingerprint", "g.verdict", "g.gated_from")


def gate_fix(spark, sf_dir):
    f = read(spark, sf_dir, FINDINGS)
    rows = f.select("fingerprint", F.col("fix_verdict").alias("verdict"), (F.col("start_line") % 2 == 0).alias("poc_blocked"), (F.col("start_line") % 3 > 0).alias("tests_pass"), F.lit(True).alias("builds"), F.col("entry_reachable").alias("semantic"))
    return rows.filter("verdict is not null").select("fingerprint", gates.fix_ok().alias("ok"))


def gate_crash(spark, sf_dir):
    f = read(spark, sf_dir, FINDINGS)
    frames = F.when(F.col("start_line") % 5 == 0, F.array()).otherwise(F.array(F.concat(F.lit("vendor/"), "file_path"), F.when(F.col("start_line") % 2 == 0, F.lit("tests/x.c")).otherwise(F.col("file_path"))))
    return f.select("fingerprint", frames.cast("array<string>").alias("frames"), F.when(F.col("start_line") % 7 == 0, "memory-leak").otherwise("segv").alias("error_class")).select("fingerprint", gates.crash_gate().alias("gate"))


def gate_supply_chain(spark, sf_dir):
    f = read(spark, sf_dir, FINDINGS)
    return gates.supply_chain(f.select("fingerprint", F.col("severity").alias("tier"), F.col("fn_key").alias("manifest"))).select("fingerprint", "tier", "status")


def promote(spark, sf_dir):
    return gates.promoted(read(spark, sf_dir, FINDINGS))


def lead_to_candidate(spark, sf_dir):
    leads = read(spark, sf_dir, SYMBOLS).select("repo", F.concat_ws(":", "name", F.col("line").cast("string"), "file_path").alias("lead"), F.substring_index("file_path", "/", -2).alias("file_path"))
    candidates = read(spark, sf_dir, FINDINGS).filter("status = 'open'")
    return gates.leads_of(candidates, leads.distinct())


QUERIES = {q.__name__: q for q in (gate_taint, gate_fix, gate_crash, gate_supply_chain, promote, lead_to_candidate)}

ORACLE_SQL = {
    "gate_taint": sql("SELECT fingerprint, CASE WHEN down THEN 'candidate' ELSE verdict END AS verdict, CASE WHEN down THEN verdict END AS gated_from FROM (SELECT *, verdict = 'finding' AND start_line % 4 IN (0, 3) AS down FROM f)", f=FINDINGS),
    "gate_fix": sql("SELECT fingerprint, fix_verdict <> 'validated' OR (start_line % 2 = 0 AND start_line % 3 > 0 AND coalesce(entry_reachable, true)) AS ok FROM f WHERE fix_verdict IS NOT NULL", f=FINDINGS),
    "gate_crash": sql("SELECT fingerprint, CASE WHEN start_line % 5 > 0 AND start_line % 2 = 0 THEN 'off-target' WHEN start_line % 7 = 0 THEN 'weak' ELSE 'promote' END AS gate FROM f", f=FINDINGS),
    "gate_supply_chain": sql("SELECT fingerprint, severity AS tier, CASE severity WHEN 'high' THEN 'open' ELSE 'needs-evidence' END AS status FROM f WHERE severity IN ('high', 'medium') AND fn_key IS NOT NULL", f=FINDINGS),
    "promote": sql(f"SELECT fingerprint, source, ref_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, 'CWE-' || {_NUMBER} AS cwe, CASE verdict WHEN 'exploitable' THEN 'open' WHEN 'finding' THEN 'open' WHEN 'candidate' THEN 'needs-evidence' WHEN 'rejected' THEN 'reviewed' ELSE 'noise' END AS status FROM f", f=FINDINGS),
    "lead_to_candidate": sql(
        """WITH l AS (SELECT DISTINCT repo, name || ':' || line || ':' || file_path AS lead, split_part(file_path, '/', 2) || '/' || split_part(file_path, '/', 3) AS q FROM s)
SELECT fingerprint, lead, CAST(n AS INTEGER) AS n FROM (SELECT f.fingerprint, lead, row_number() OVER (PARTITION BY f.fingerprint ORDER BY lead) AS n FROM f JOIN l ON f.repo = l.repo AND ends_with(f.file_path, '/' || q) WHERE f.status = 'open') WHERE n <= 10""", f=FINDINGS, s=SYMBOLS
    ),
}
