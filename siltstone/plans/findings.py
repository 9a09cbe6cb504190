"""Queries over findings, votes, proofs and ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import scores, text, verdicts
from siltstone.functions.literals import once
from siltstone.operators import benchmarks, findings, proofs, surface, voting
from siltstone.plans.derived import ACTUAL, CRASHES, FINDINGS, RUNS, TRUTH, VOTES, read, sql


def _case(column: str, table: dict, other: str = "NULL") -> str:
    value = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {value(v)}" for k, v in table.items()) + f" ELSE {other} END"


_CWE = "TRY_CAST(nullif(regexp_extract(cwe, '\\d+', 0), '') AS BIGINT)"
_ACTIVE = "status IN ('open', 'needs-evidence', 'needs-trace', 'confirmed', 'proven')"
_RISK = f"""CAST(least(100, greatest(0, {_case("coalesce(severity, 'medium')", scores.RISK_SEVERITY, "15")} + {_case("proof_state", scores.RISK_PROOF, "0")}
 + CASE verify_verdict WHEN 'confirmed-exploitable' THEN 4 WHEN 'not-exploitable' THEN -20 ELSE 0 END + CASE WHEN poc_verdict = 'exploited' THEN 6 ELSE 0 END
 + least(15, CAST(round(log10(greatest(caller_count, 0) + 1) * 5) AS INTEGER)) + CASE WHEN chain IS NOT NULL THEN 5 ELSE 0 END)) AS INTEGER)"""
_SEVERITY_RANK = _case("severity", {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1, "none": 0}, "2")
_PRIORITY = f"""({_case("severity", scores.PRIORITY_SEVERITY, "15")} + {_case("proof_state", scores.PRIORITY_PROOF, "2")} + {_case("exposure", scores.PRIORITY_EXPOSURE, "8")}
 + CASE WHEN entry_reachable THEN 15 WHEN NOT entry_reachable THEN 0 ELSE least(12, CAST(round(log2(greatest(caller_count, 0) + 1) * 3) AS INTEGER)) END)"""
_YES, _NO, _OPEN = verdicts.VERIFY_VERDICTS


def upsert_findings(spark, sf_dir):
    f = read(spark, sf_dir, FINDINGS).withColumn("key", F.concat_ws("|", "repo", "ref_id", "source"))
    return findings.upsert(f, ["key"], [F.col("batch"), F.col("ord")]).select("key", "fingerprint", "status", "batch")


def patch_findings(spark, sf_dir):
    f = read(spark, sf_dir, FINDINGS)
    new = f.filter("poc_verdict is not null").select("fingerprint", verdicts.poc_status(F.col("poc_verdict")).alias("status"))
    return findings.patch(f, new, "fingerprint", ["status"]).select("fingerprint", "status", "severity")


def semantic_collapse(spark, sf_dir):
    return findings.semantic_collapse(read(spark, sf_dir, FINDINGS))


def rank_findings(spark, sf_dir):
    return findings.ranked(read(spark, sf_dir, FINDINGS))


def priority_score(spark, sf_dir):
    return findings.prioritised(read(spark, sf_dir, FINDINGS))


def findings_summary(spark, sf_dir):
    return findings.summary(read(spark, sf_dir, FINDINGS))


def report_counts(spark, sf_dir):
    return findings.report_counts(read(spark, sf_dir, FINDINGS))


def posture(spark, sf_dir):
    return findings.posture(read(spark, sf_dir, FINDINGS))


def fix_queue(spark, sf_dir):
    return findings.fix_queue(read(spark, sf_dir, FINDINGS))


def sibling_findings(spark, sf_dir):
    return findings.siblings(read(spark, sf_dir, FINDINGS))


#: Findings with anchors and, some of them, with the blocks of a verification, a proof and a fix.
_BLOCKS = """SELECT fingerprint, source, nullif(ref_id, 'REF-7') AS ref_id, CASE WHEN ord % 17 = 0 THEN ' ' ELSE title END AS title, severity, status, proof_state, {evidence} AS evidence,
 CASE WHEN ord % 2 = 0 THEN {verification} END AS verification, CASE WHEN ord % 3 = 0 THEN {poc} END AS poc, CASE WHEN ord % 5 = 0 THEN {fix} END AS fix FROM {f}"""
_FIELDS = {
    "verification": "verify_verdict AS verdict, CASE WHEN ord % 7 = 0 THEN NULL ELSE CAST(ord % 13 AS DOUBLE) / 10 END AS confidence, CASE WHEN ord % 11 = 0 THEN '' ELSE 'now' END AS verified_at",
    "poc": "CAST(ord % 7 AS INT) AS proof_level, poc_verdict AS proof_verdict, CASE WHEN ord % 11 = 0 THEN NULL ELSE 'local' END AS backend, 'now' AS proven_at",
    "fix": "fix_verdict AS verdict, CASE WHEN ord % 7 = 0 THEN '' ELSE 'p.diff' END AS patch_path, CASE WHEN ord % 3 > 0 THEN ord % 3 = 1 END AS applied, ord % 4 > 0 AS exploit_passed, CASE WHEN ord % 6 > 0 THEN true END AS functional_passed, CASE WHEN ord % 8 > 3 THEN ord % 8 > 4 END AS semantic_passed, ord % 9 > 0 AS poc_plus_passed",
}


def validate_finding(spark, sf_dir):
    made = {name: "struct(" + fields + ")" for name, fields in _FIELDS.items()}
    anchor = "struct(CASE WHEN ord % 19 = 0 THEN '' ELSE file_path END AS file_path, start_line - 2 AS start_line, CASE WHEN ord % 23 = 0 THEN CAST(0 AS BIGINT) END AS end_line)"
    evidence = f"CASE WHEN ord % 29 > 0 THEN CASE WHEN ord % 4 = 0 THEN array({anchor}, {anchor}) ELSE array({anchor}) END END"
    f = spark.sql(_BLOCKS.format(evidence=evidence, f="{f}", **made), f=read(spark, sf_dir, FINDINGS))
    return findings.errors(f)


def sarif_export(spark, sf_dir):
    return findings.sarif_results(read(spark, sf_dir, FINDINGS))


def sarif_rules(spark, sf_dir):
    return findings.sarif_rules(read(spark, sf_dir, FINDINGS))


def worklist_flags(spark, sf_dir):
    return findings.worklist(read(spark, sf_dir, FINDINGS))


def verdict_maps(spark, sf_dir):
    f = read(spark, sf_dir, FINDINGS)
    number = text.cwe_number(F.col("cwe"))
    return f.select(
        "fingerprint",
        verdicts.draft_status(F.col("verdict")).alias("verdict_to_status"),
        F.coalesce(verdicts.verify_status(F.col("verify_verdict")), "status").alias("verify_to_status"),
        F.coalesce(verdicts.poc_status(F.col("poc_verdict")), "status").alias("poc_to_status"),
        F.coalesce(verdicts.fix_status(F.col("fix_verdict")), "status").alias("fix_to_status"),
        verdicts.proof_state(F.col("status")).alias("proof_state"),
        verdicts.gate(F.col("verify_verdict")).alias("gate_verdict"),
        verdicts.sarif_level(F.col("severity")).alias("sarif_level"),
        text.norm_cwe(F.col("cwe")).alias("norm_cwe"),
        verdicts.is_memory(F.col("source"), number).alias("is_memory_finding"),
        verdicts.proof_lane(F.col("source"), number).alias("proof_lane"),
    )


def fingerprint(spark, sf_dir):
    f = read(spark, sf_dir, FINDINGS)
    return f.select(F.col("fingerprint").alias("key"), text.fingerprint(F.col("source"), F.col("ref_id"), text.norm_path(F.col("file_path")), F.col("start_line")).alias("fingerprint"))


def derive_severity(spark, sf_dir):
    f = read(spark, sf_dir, FINDINGS)
    conditions = F.when(F.col("caller_count") % 5 < 4, F.filter(F.array(F.when(F.col("caller_count") % 2 == 0, F.lit("login")), F.when(F.col("caller_count") % 3 == 0, F.lit(" ")), F.when(F.col("caller_count") > 20, F.lit("race")), F.when(F.col("caller_count") > 30, F.lit("flag"))), lambda x: x.isNotNull()))
    d = scores.derive_severity(conditions, F.col("exposure"), F.col("entry_reachable"), F.col("severity"))
    return once(f.select("fingerprint", "severity", d.alias("d")), "d", F.col("d")).select("fingerprint", F.col("d.severity").alias("derived_severity"), F.col("d.derived").alias("derived"), scores.judge_claimed(F.col("severity"), F.col("d.severity")).alias("judged"))


def vote_majority(spark, sf_dir):
    return voting.majority(read(spark, sf_dir, VOTES))


def panel_consensus(spark, sf_dir):
    return voting.consensus(read(spark, sf_dir, VOTES), "ask")


def proof_classify(spark, sf_dir):
    return proofs.classified(read(spark, sf_dir, RUNS), "nonzero")


def proof_differential(spark, sf_dir):
    return proofs.differential(read(spark, sf_dir, RUNS))


def proof_reproducibility(spark, sf_dir):
    return proofs.reproducibility(read(spark, sf_dir, RUNS))


def crash_triage(spark, sf_dir):
    return proofs.triaged(read(spark, sf_dir, CRASHES))


def match_ground_truth(spark, sf_dir):
    return benchmarks.matches(read(spark, sf_dir, TRUTH), read(spark, sf_dir, ACTUAL))


def score_findings(spark, sf_dir):
    return benchmarks.score(read(spark, sf_dir, TRUTH), read(spark, sf_dir, ACTUAL), strict=True)


def corpus_aggregate(spark, sf_dir):
    return benchmarks.aggregate(score_findings(spark, sf_dir))


def _lane(spark, sf_dir):
    return read(spark, sf_dir, ACTUAL).select("case_id", "file_path", F.when(F.col("line") % 4 > 0, F.col("line")).alias("line"))


def anchor_hits_file(spark, sf_dir):
    return benchmarks.anchor_hits(read(spark, sf_dir, TRUTH), _lane(spark, sf_dir), site=False)


def anchor_hits_site(spark, sf_dir):
    return benchmarks.anchor_hits(read(spark, sf_dir, TRUTH), _lane(spark, sf_dir), site=True)


def recall_scoreboard(spark, sf_dir):
    truth = read(spark, sf_dir, TRUTH)
    return benchmarks.scoreboard(truth, {"file_recall": anchor_hits_file(spark, sf_dir), "site_recall": anchor_hits_site(spark, sf_dir)})


def chain_build(spark, sf_dir):
    f = read(spark, sf_dir, FINDINGS).filter("chain is not null")
    n = F.substring("chain", 2, 12).cast("long")
    claimed = f.select("chain", F.when(n % 3 == 0, "low").alias("claimed"), F.when(n % 7 == 0, "composition").alias("kind"), F.when(n % 4 == 0, "login").when(n % 4 == 1, " ").alias("entry_point"), F.when(n % 5 == 0, "keys").alias("asset")).distinct()
    return surface.chains(f.select("chain", "fingerprint"), f, claimed)


_FIRST_RUN = f"""WITH c AS (SELECT finding, role, run_no,
 CASE WHEN skipped OR timed_out THEN 1 WHEN signal = 'SIGSEGV' OR exit_code > 128 THEN 4 WHEN regexp_matches(coalesce(output, ''), '{proofs.BUILD_TEXT}') THEN 1 WHEN regexp_matches(coalesce(output, ''), '{proofs.CRASH_TEXT}') THEN 3 NONZERO ELSE 2 END AS level,
 CASE WHEN skipped THEN 'error' WHEN timed_out THEN 'timeout' WHEN signal = 'SIGSEGV' OR exit_code > 128 THEN 'exploited' WHEN regexp_matches(coalesce(output, ''), '{proofs.BUILD_TEXT}') THEN 'harness-failed-build' WHEN regexp_matches(coalesce(output, ''), '{proofs.CRASH_TEXT}') THEN 'exploited' VERDICT ELSE 'not-reproduced' END AS verdict FROM runs)"""
_RUNS = _FIRST_RUN.replace("NONZERO", "").replace("VERDICT", "")
_RUNS_NONZERO = _FIRST_RUN.replace("NONZERO", "WHEN exit_code <> 0 THEN 3").replace("VERDICT", "WHEN exit_code <> 0 THEN 'exploited'")

_PATHS = "(e_path = f_path OR ends_with(f_path, '/' || e_path) OR ends_with(e_path, '/' || f_path))"
_MATCH = f"""m AS (SELECT t.case_id, t.id, a.fingerprint, a.status FROM (SELECT *, file_path AS e_path FROM truth) t JOIN (SELECT *, file_path AS f_path FROM actual) a
 ON t.case_id = a.case_id AND {_PATHS} AND (coalesce(t.line, 0) <= 0 OR abs(t.line - a.line) <= 5)
 AND coalesce(TRY_CAST(nullif(regexp_extract(t.cwe, '\\d+', 0), '') AS BIGINT) = TRY_CAST(nullif(regexp_extract(a.cwe, '\\d+', 0), '') AS BIGINT), true)
 WHERE a.status NOT IN ('reviewed', 'noise', 'rejected'))"""
_SCORE = f"""WITH {_MATCH},
e AS (SELECT t.case_id, t.id, t.kind, count(m.id) > 0 AS hit, count(*) FILTER (m.status = 'proven') AS np FROM truth t LEFT JOIN m ON t.case_id = m.case_id AND t.id = m.id GROUP BY ALL),
u AS (SELECT case_id, count(*) AS unmatched FROM actual WHERE status NOT IN ('reviewed', 'noise', 'rejected') AND (case_id, fingerprint) NOT IN (SELECT (case_id, fingerprint) FROM m) GROUP BY case_id),
p AS (SELECT case_id, count(*) AS proven FROM actual WHERE status = 'proven' GROUP BY case_id),
g AS (SELECT case_id, count(*) FILTER (kind = 'vuln') AS expected, count(*) FILTER (kind = 'vuln' AND hit) AS tp, count(*) FILTER (kind = 'vuln' AND NOT hit) AS fn, count(*) FILTER (kind <> 'vuln' AND hit) AS decoys, count(*) FILTER (kind <> 'vuln' AND np > 0) AS false_proofs FROM e GROUP BY case_id),
s AS (SELECT case_id, expected, tp, fn, decoys + coalesce(unmatched, 0) AS fp, false_proofs, coalesce(unmatched, 0) AS unmatched, coalesce(proven, 0) AS proven FROM g LEFT JOIN u USING (case_id) LEFT JOIN p USING (case_id))"""
_RATES = "round(tp / nullif(expected, 0), 4) AS recall, round(tp / nullif(tp + fp, 0), 4) AS precision, round(false_proofs / nullif(proven, 0), 4) AS false_proof_rate"
_HITS = f"""t AS (SELECT *, file_path AS e_path FROM truth), a AS (SELECT case_id, file_path AS f_path, CASE WHEN line % 4 > 0 THEN line END AS a_line FROM actual),
hf AS (SELECT DISTINCT t.case_id, t.id FROM t JOIN a ON t.case_id = a.case_id AND {_PATHS} AND (a_line IS NULL OR coalesce(t.line, 0) <= 0 OR abs(t.line - a_line) <= 6)),
hs AS (SELECT DISTINCT t.case_id, t.id FROM t JOIN a ON t.case_id = a.case_id AND {_PATHS} AND a_line IS NOT NULL AND (coalesce(t.line, 0) <= 0 OR abs(t.line - a_line) <= 6))"""
_VALID = f"verdict IN ('{_YES}', '{_NO}', '{_OPEN}')"

QUERIES = {
    f.__name__: f
    for f in (
        upsert_findings, patch_findings, semantic_collapse, rank_findings, priority_score, findings_summary, report_counts, posture, fix_queue, sibling_findings, validate_finding, sarif_export, sarif_rules, worklist_flags, verdict_maps,
        fingerprint, derive_severity, vote_majority, panel_consensus, proof_classify, proof_differential, proof_reproducibility, crash_triage, match_ground_truth, score_findings, corpus_aggregate, anchor_hits_file, anchor_hits_site, recall_scoreboard, chain_build,
    )
}



def _say(*rules: tuple[str, str]) -> str:
    return ", ".join(f"CASE WHEN {bad} THEN '{path}' END" for bad, path in rules)


def _blank(c: str) -> str:
    return f"trim(coalesce({c}, ''), ' ') = ''"


_ON = {"verification": "ord % 2 = 0", "poc": "ord % 3 = 0", "fix": "ord % 5 = 0"}
_SOUND = "fix_verdict = 'validated' AND "
_VALID_FINDINGS = f"""WITH g AS (SELECT *, nullif(ref_id, 'REF-7') AS ref, CASE WHEN ord % 17 = 0 THEN '' ELSE title END AS name, CASE WHEN ord % 29 = 0 THEN 0 WHEN ord % 4 = 0 THEN 2 ELSE 1 END AS anchors FROM f),
a AS (SELECT *, list_concat([{_say((_blank("fingerprint"), "fingerprint"), (_blank("source"), "source"), (_blank("ref"), "ref_id"), (_blank("name"), "title"), (_blank("severity"), "severity"), (_blank("status"), "status"), (_blank("proof_state"), "proof_state"), (f"status NOT IN {verdicts.STATUSES}", "status: unknown"), (f"proof_state NOT IN {verdicts.PROOF_STATES}", "proof_state: unknown"), ("anchors = 0", "evidence"))}],
 flatten(list_transform(range(anchors), lambda i: [CASE WHEN ord % 19 = 0 THEN concat('evidence[', i, '].file_path') END, CASE WHEN start_line - 2 < 1 THEN concat('evidence[', i, '].start_line') END, CASE WHEN ord % 23 = 0 THEN concat('evidence[', i, '].end_line') END])),
 CASE WHEN {_ON["verification"]} THEN [{_say((f"coalesce(verify_verdict NOT IN {verdicts.VERIFY_VERDICTS}, true)", "verification.verdict"), ("ord % 7 = 0 OR ord % 13 > 10", "verification.confidence"), ("ord % 11 = 0", "verification.verified_at"))}] ELSE [] END,
 CASE WHEN {_ON["poc"]} THEN [{_say(("ord % 7 NOT BETWEEN 1 AND 5", "poc.proof_level"), (f"coalesce(poc_verdict NOT IN {verdicts.POC_VERDICTS}, true)", "poc.proof_verdict"), ("ord % 11 = 0", "poc.backend"))}] ELSE [] END,
 CASE WHEN {_ON["fix"]} THEN [{_say((f"coalesce(fix_verdict NOT IN {verdicts.FIX_VERDICTS}, true)", "fix.verdict"), ("ord % 7 = 0", "fix.patch_path"), ("ord % 3 = 0", "fix.applied"), (_SOUND + "ord % 4 = 0", "fix.exploit_passed"), (_SOUND + "ord % 6 = 0", "fix.functional_passed"), (_SOUND + "ord % 8 = 4", "fix.semantic_passed"), (_SOUND + "ord % 9 = 0", "fix.poc_plus_passed"))}] ELSE [] END) AS e FROM g),
b AS (SELECT fingerprint, list_filter(e, lambda x: x IS NOT NULL) AS e FROM a)
SELECT fingerprint, CAST(len(e) AS INTEGER) AS n_errors, array_to_string(e, ',') AS errors FROM b"""

ORACLE_SQL = {
    "upsert_findings": sql("SELECT key, fingerprint, status, batch FROM (SELECT *, concat_ws('|', repo, ref_id, source) AS key FROM f) QUALIFY row_number() OVER (PARTITION BY key ORDER BY batch DESC, ord DESC) = 1", f=FINDINGS),
    "patch_findings": sql(f"SELECT fingerprint, coalesce({_case('poc_verdict', verdicts.POC_STATUS)}, status) AS status, severity FROM f", f=FINDINGS),
    "semantic_collapse": sql(
        "SELECT repo, min(fingerprint) AS fingerprint, count(*) AS n_findings, count(DISTINCT (file_path, start_line)) AS n_anchors, array_to_string(list_transform(list_sort(list(DISTINCT {'p': file_path, 'l': start_line})), lambda x: x.p || ':' || x.l), ',') AS anchors FROM f GROUP BY repo, CASE WHEN status = 'proven' OR fn_key IS NULL THEN fingerprint ELSE concat_ws('|', source, fn_key) END", f=FINDINGS
    ),
    "rank_findings": sql(f"SELECT repo, fingerprint, {_RISK} AS score, CAST(row_number() OVER (PARTITION BY repo ORDER BY {_RISK} DESC, {_SEVERITY_RANK} DESC, fingerprint) AS INTEGER) AS rank FROM f", f=FINDINGS),
    "priority_score": sql(f"SELECT repo, fingerprint, CAST(p AS INTEGER) AS score, CASE WHEN p >= 75 THEN 'P0' WHEN p >= 55 THEN 'P1' WHEN p >= 35 THEN 'P2' ELSE 'P3' END AS tier FROM (SELECT *, {_PRIORITY} AS p FROM f)", f=FINDINGS),
    "findings_summary": sql("SELECT repo, 'total' AS facet, 'all' AS value, count(*) AS n FROM f GROUP BY repo UNION ALL SELECT repo, 'status', status, count(*) FROM f GROUP BY repo, status UNION ALL SELECT repo, 'verdict', verdict, count(*) FROM f GROUP BY repo, verdict", f=FINDINGS),
    "report_counts": sql(
        "SELECT repo, count(*) AS total, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS severity_{s}" for s in ("critical", "high", "medium", "low", "info")) + ", " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("proven", "confirmed", "open", "patched", "remediated", "reviewed")) + f", count(*) FILTER ({_ACTIVE}) AS actionable FROM f GROUP BY repo", f=FINDINGS
    ),
    "posture": sql(
        f"""SELECT repo, concat_ws(', ', n || ' actionable', CASE WHEN p > 0 THEN p || ' proven' END, CASE WHEN c > 0 THEN c || ' confirmed' END) AS headline, worst
 FROM (SELECT repo, count(*) AS n, count(*) FILTER (status = 'proven') AS p, count(*) FILTER (status = 'confirmed') AS c, CAST(max({_case("coalesce(severity, 'none')", {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1, "none": 0}, "2")}) AS INTEGER) AS worst FROM f WHERE {_ACTIVE} GROUP BY repo)""", f=FINDINGS
    ),
    "fix_queue": sql("SELECT repo, fingerprint, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY coalesce(poc_verdict = 'exploited', false) DESC, fingerprint) AS place FROM f WHERE status IN ('proven', 'confirmed') AND coalesce(fix_verdict, '') <> 'validated') WHERE place <= 20", f=FINDINGS),
    "sibling_findings": sql("SELECT a.fingerprint, count(*) AS n_siblings, min(b.fingerprint) AS first_sibling FROM f a JOIN f b ON a.repo = b.repo AND a.fn_key = b.fn_key AND a.fingerprint <> b.fingerprint AND b.poc_verdict = 'exploited' WHERE a.status = 'confirmed' GROUP BY a.fingerprint", f=FINDINGS),
    "validate_finding": sql(_VALID_FINDINGS, f=FINDINGS),
    "sarif_export": sql(
        f"""SELECT fingerprint, coalesce('CWE-' || {_CWE}, source) AS rule_id, {_case('severity', verdicts.SARIF_LEVELS, "'note'")} AS level, substr(trim(regexp_replace(title, '\\s+', ' ', 'g')), 1, 600) AS message,
 '{{"uri":"' || file_path || '","startLine":' || greatest(1, start_line) || '}}' AS location FROM f WHERE {_ACTIVE}""".replace("{{", "{").replace("}}", "}"), f=FINDINGS
    ),
    "sarif_rules": sql(f"SELECT coalesce('CWE-' || {_CWE}, source) AS rule_id, min(source) AS source, count(*) AS n_results FROM f WHERE {_ACTIVE} GROUP BY 1", f=FINDINGS),
    "worklist_flags": sql(
        f"""SELECT *, CASE WHEN to_verify THEN 'verify' WHEN to_prove THEN 'poc' WHEN to_fix THEN 'fix' WHEN to_chain THEN 'chain' ELSE 'report' END AS next_step FROM (SELECT repo, bool_or(status IN ('open', 'needs-trace')) AS to_verify,
 bool_or(status = 'confirmed' AND coalesce(poc_verdict, '') <> 'exploited') AS to_prove, bool_or(status IN ('confirmed', 'proven')) AS to_fix, count(*) FILTER ({_ACTIVE}) >= 2 AS to_chain FROM f GROUP BY repo)""", f=FINDINGS
    ),
    "verdict_maps": sql(
        f"""SELECT fingerprint, {_case('verdict', verdicts.DRAFT_STATUS)} AS verdict_to_status, coalesce({_case('verify_verdict', verdicts.VERIFY_STATUS)}, status) AS verify_to_status, coalesce({_case('poc_verdict', verdicts.POC_STATUS)}, status) AS poc_to_status,
 coalesce({_case('fix_verdict', verdicts.FIX_STATUS)}, status) AS fix_to_status, {_case('status', verdicts.STATUS_PROOF, "'lead'")} AS proof_state, {_case('verify_verdict', verdicts.GATES)} AS gate_verdict, {_case('severity', verdicts.SARIF_LEVELS, "'note'")} AS sarif_level,
 'CWE-' || {_CWE} AS norm_cwe, source IN {verdicts.MEMORY_SOURCES} OR coalesce({_CWE} IN {verdicts.MEMORY_CWES}, false) AS is_memory_finding,
 CASE WHEN source IN {verdicts.MEMORY_SOURCES} OR coalesce({_CWE} IN {verdicts.MEMORY_CWES}, false) THEN 'sanitizer' ELSE 'poc' END AS proof_lane FROM f""", f=FINDINGS
    ),
    "fingerprint": sql("SELECT fingerprint AS key, left(sha256(concat_ws('|', source, ref_id, file_path, start_line)), 16) AS fingerprint FROM f", f=FINDINGS),
    "derive_severity": sql(
        f"""WITH p AS (SELECT *, CASE WHEN caller_count % 5 < 4 THEN (caller_count % 2 = 0)::INT + (caller_count > 20)::INT + (caller_count > 30)::INT END AS n, {_case('exposure', {k: {'high': 3, 'medium': 2, 'low': 1}[v] for k, v in scores.ACCESS.items()})} AS a FROM f),
q AS (SELECT *, least(CASE WHEN n <= 0 THEN 3 WHEN n <= 2 THEN 2 WHEN n IS NOT NULL THEN 1 END, a) AS low FROM p),
r AS (SELECT *, CASE least(3, low + CASE WHEN entry_reachable THEN 1 ELSE 0 END) WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' END AS d FROM q),
s AS (SELECT fingerprint, severity, low IS NOT NULL AS derived, CASE WHEN low IS NOT NULL THEN d WHEN severity IN ('info', 'low', 'medium', 'high', 'critical') THEN severity ELSE 'medium' END AS derived_severity FROM r),
v AS (SELECT *, list_position(['info', 'low', 'medium', 'high', 'critical'], severity) - list_position(['info', 'low', 'medium', 'high', 'critical'], derived_severity) AS step FROM s)
SELECT fingerprint, derived_severity, derived, CASE WHEN step <= -1 THEN 5 WHEN step = 0 THEN 4 WHEN step = 1 THEN 0 WHEN step = 2 THEN -3 WHEN step >= 3 THEN -5 ELSE 0 END AS judged FROM v""", f=FINDINGS
    ),
    "vote_majority": sql(
        f"""WITH c AS (SELECT repo, fingerprint, count(*) FILTER ({_VALID}) AS n, count(*) FILTER (verdict = '{_YES}') AS y, count(*) FILTER (verdict = '{_NO}') AS x, count(*) FILTER (verdict = '{_OPEN}') AS o FROM v GROUP BY repo, fingerprint)
SELECT repo, fingerprint, CASE WHEN y * 2 > n THEN '{_YES}' WHEN x * 2 > n THEN '{_NO}' ELSE '{_OPEN}' END AS verdict, CASE WHEN n = 0 THEN 0.0 ELSE round(CASE WHEN y * 2 > n THEN y WHEN x * 2 > n THEN x ELSE o END / n, 3) END AS agreement, n AS n_votes, concat_ws(',', CASE WHEN y > 0 THEN '{_YES}:' || y END, CASE WHEN x > 0 THEN '{_NO}:' || x END, CASE WHEN o > 0 THEN '{_OPEN}:' || o END) AS tally FROM c""", v=VOTES
    ),
    "panel_consensus": sql(
        f"""WITH w AS (SELECT *, coalesce(least(1.0, greatest(0.0, confidence)), 0.0) AS conf FROM v WHERE {_VALID}),
c AS (SELECT repo, fingerprint, count(*) AS n, count(*) FILTER (verdict = '{_YES}') AS y, count(*) FILTER (verdict = '{_NO}') AS x, count(*) FILTER (verdict = '{_OPEN}') AS o, bool_or(has_trigger) AS t,
 avg(conf) FILTER (verdict = '{_YES}') AS my, avg(conf) FILTER (verdict = '{_NO}') AS mx, avg(conf) FILTER (verdict = '{_OPEN}') AS mo, avg(conf) AS ma, coalesce(string_agg(DISTINCT refute_reason, ',' ORDER BY refute_reason) FILTER (verdict = '{_NO}'), '') AS refute_reasons FROM w GROUP BY repo, fingerprint),
r AS (SELECT repo, fingerprint, exclusion_rule FROM (SELECT repo, fingerprint, exclusion_rule, count(*) AS k, min(ord) AS seen FROM w WHERE trim(exclusion_rule) <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY repo, fingerprint ORDER BY k DESC, seen) = 1),
s AS (SELECT *, CASE WHEN y * 2 > n THEN '{_YES}' WHEN x * 2 > n THEN '{_NO}' ELSE '{_OPEN}' END AS side FROM c)
SELECT s.repo, s.fingerprint, CASE WHEN side = '{_YES}' AND NOT t THEN '{_OPEN}' ELSE side END AS verdict, side = '{_YES}' AND NOT t AS downgraded, NOT (y * 2 > n) AND NOT (x * 2 > n) AS flagged,
 floor(coalesce(CASE side WHEN '{_YES}' THEN my WHEN '{_NO}' THEN mx ELSE mo END, ma) * 100 + 0.5) / 100 AS confidence, round(greatest(y, x, o) / n, 3) AS agreement, exclusion_rule, refute_reasons FROM s LEFT JOIN r USING (repo, fingerprint)""", v=VOTES
    ),
    "proof_classify": sql(_RUNS_NONZERO + " SELECT * FROM c", runs=RUNS),
    "proof_differential": sql(
        _RUNS + """, f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY finding, role ORDER BY run_no) = 1)
SELECT a.finding, CASE WHEN a.verdict = 'exploited' AND b.verdict = 'exploited' THEN 2 WHEN a.verdict = 'exploited' AND b.verdict = 'not-reproduced' THEN 5 ELSE a.level END AS level, CASE WHEN a.verdict = 'exploited' AND b.verdict = 'exploited' THEN 'non-discriminating' ELSE a.verdict END AS verdict
FROM f a LEFT JOIN f b ON a.finding = b.finding AND b.role = 'benign' WHERE a.role = 'attack'""", runs=RUNS
    ),
    "proof_reproducibility": sql(
        _RUNS + """, g AS (SELECT finding, count(*) FILTER (role = 'attack' AND verdict = 'exploited') AS fired, count(*) FILTER (role = 'attack') AS total, count(*) FILTER (role = 'benign') > 0 AND count(*) FILTER (role = 'benign' AND verdict <> 'not-reproduced') = 0 AS clean,
 max(level) FILTER (role = 'attack' AND verdict = 'exploited') AS top, max(level) FILTER (role = 'attack') AS best, arg_max(verdict, level * 1000000000000 + run_no) FILTER (role = 'attack') AS best_verdict FROM c GROUP BY finding HAVING count(*) FILTER (role = 'attack') > 0)
SELECT finding, CASE WHEN fired = 0 THEN best WHEN fired = total AND clean THEN 5 ELSE least(4, top) END AS level, CASE WHEN fired = 0 THEN best_verdict ELSE 'exploited' END AS verdict, fired, total, round(fired / total, 3) AS rate FROM g""", runs=RUNS
    ),
    "crash_triage": sql("SELECT crash_key, count(*) AS n, min(fingerprint) AS first_fingerprint, count(DISTINCT cwe) AS n_cwes FROM c GROUP BY crash_key", c=CRASHES),
    "match_ground_truth": sql(f"WITH {_MATCH} SELECT case_id, id, CAST(count(*) AS BIGINT) AS n, min(fingerprint) AS first FROM m GROUP BY ALL", truth=TRUTH, actual=ACTUAL),
    "score_findings": sql(f"{_SCORE} SELECT case_id, expected, tp, fn, fp, false_proofs, unmatched, proven, {_RATES} FROM s", truth=TRUTH, actual=ACTUAL),
    "corpus_aggregate": sql(f"{_SCORE}, z AS (SELECT CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(false_proofs) AS BIGINT) AS false_proofs, CAST(sum(proven) AS BIGINT) AS proven FROM s) SELECT *, {_RATES} FROM z", truth=TRUTH, actual=ACTUAL),
    "anchor_hits_file": sql(f"WITH {_HITS} SELECT * FROM hf", truth=TRUTH, actual=ACTUAL),
    "anchor_hits_site": sql(f"WITH {_HITS} SELECT * FROM hs", truth=TRUTH, actual=ACTUAL),
    "recall_scoreboard": sql(
        f"WITH {_HITS}, r AS (SELECT t.case_id, t.id, hf.id IS NOT NULL AS f, hs.id IS NOT NULL AS s FROM t LEFT JOIN hf ON t.case_id = hf.case_id AND t.id = hf.id LEFT JOIN hs ON t.case_id = hs.case_id AND t.id = hs.id WHERE kind = 'vuln') SELECT case_id, count(*) AS expected, round(count(*) FILTER (f) / count(*), 4) AS file_recall, round(count(*) FILTER (s) / count(*), 4) AS site_recall FROM r GROUP BY ROLLUP (case_id)", truth=TRUTH, actual=ACTUAL
    ),
    "chain_build": sql(
        f"SELECT chain, min(repo) AS repo, 'chain-' || left(sha256(string_agg(fingerprint, '|' ORDER BY fingerprint)), 12) AS chain_id, CAST(count(*) AS INTEGER) AS n_members, CASE WHEN CAST(substr(chain, 2) AS BIGINT) % 7 = 0 THEN 'composition' WHEN CAST(substr(chain, 2) AS BIGINT) % 4 = 0 OR CAST(substr(chain, 2) AS BIGINT) % 5 = 0 THEN 'attack-path' ELSE 'composition' END AS kind, ['info', 'low', 'medium', 'high', 'critical'][greatest(CASE WHEN CAST(substr(chain, 2) AS BIGINT) % 3 = 0 THEN 1 ELSE 3 END, max({_case('severity', {k: i for i, k in enumerate(scores.LEVELS)}, '0')})) + 1] AS severity FROM f WHERE chain IS NOT NULL GROUP BY chain HAVING count(*) >= 2", f=FINDINGS
    ),
}
