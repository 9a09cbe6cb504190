"""Queries of pattern packs, obligations, logs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.literals import once
from siltstone.operators import proofs, scan
from siltstone.plans.derived import read, sql
from siltstone.plans.lines import CODE, code_lines, code_sql

#: Log lines of fuzzing runs, one an event.
LOGS = """
SELECT concat('run', CAST(user_id % 400 AS STRING)) AS run_id, event_id AS line,
 CASE event_id % 9 WHEN 0 THEN concat('#', CAST(event_id * 64 AS STRING), ' NEW    cov: ', CAST(user_id AS STRING), ' ft: ', CAST(event_id % 500 AS STRING), ' exec/s: ', CAST(event_id % 77 AS STRING))
 WHEN 1 THEN concat('#', CAST(event_id * 64 AS STRING), ' REDUCE cov: ', CAST(user_id AS STRING)) WHEN 2 THEN concat('#', CAST(event_id * 64 AS STRING), ' pulse  exec/s: ', CAST(event_id % 50 AS STRING))
 WHEN 3 THEN CASE event_id % 5 WHEN 0 THEN '==7==ERROR: AddressSanitizer: heap-use-after-free on address 0x60' WHEN 1 THEN 'a.c:4:2: runtime error: division by zero' WHEN 2 THEN 'SUMMARY: AddressSanitizer: BUS a.c:9 in f' ELSE 'INFO: seed' END
 WHEN 4 THEN 'Done 12 runs' WHEN 5 THEN CASE event_id % 4 WHEN 0 THEN concat('#', CAST(event_id * 64 AS STRING), ' DONE cov: 7 ft: 9') WHEN 1 THEN concat('workers: 8, corpus: ', CAST(event_id AS STRING), ' (3m ago), crashers: ', CAST(event_id % 3 AS STRING), ', restarts: 1') ELSE concat('artifact_prefix; Test unit written to ./crash-', CAST(event_id AS STRING)) END
 ELSE 'INFO: nothing' END AS text
FROM {events}
"""


#: Packs whose queries aren't named scan_<pack>.
_NAMES = {"route_patterns": "route_pattern_hits", "logic": "logic_probes"}


def _pack(name: str):
    def query(spark, sf_dir):
        return scan.pattern_scan(code_lines(spark, sf_dir), scan.PACKS[name])

    query.__name__ = _NAMES.get(name, f"scan_{name}")
    return query


def _pack_sql(pack: scan.Pack) -> str:
    quoted = lambda p: p.replace("'", "''")
    only = {i: f" AND regexp_matches(path, '{quoted(p)}')" for i, p in pack.files}
    parts = " UNION ALL ".join(f"SELECT *, {o} AS ord, '{i}' AS pattern FROM code WHERE regexp_matches(text, '{quoted(p)}'){only.get(i, '')}" for o, (i, p) in enumerate(pack.regexes()))
    score = " + ".join(f"CASE WHEN regexp_matches({side}, '{p}') THEN {w} ELSE 0 END" for side, p, w in scan.RANKERS[pack.ranker])
    budget = "score DESC, ord, m" if pack.by_score else "ord, m"
    return code_sql(
        f"""WITH h AS ({parts}), f AS (SELECT *, {score} AS score FROM h QUALIFY row_number() OVER (PARTITION BY repo, ord, path ORDER BY line) <= {pack.per_file}),
m AS (SELECT *, row_number() OVER (PARTITION BY repo, ord ORDER BY score DESC, path, line) AS m FROM f QUALIFY m <= {pack.per_pattern}),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY {budget}) AS INTEGER) AS place FROM m) SELECT repo, pattern, path, line, score, place FROM p WHERE place <= {pack.budget}"""
    )


def scan_obligations(spark, sf_dir):
    return scan.obligations(code_lines(spark, sf_dir))


def fuzz_telemetry(spark, sf_dir):
    return scan.telemetry(read(spark, sf_dir, LOGS))


def crash_classify(spark, sf_dir):
    c = once(once(read(spark, sf_dir, LOGS), "text", F.col("text")), "c", proofs.classify_log(F.col("text")))
    return c.filter("c is not null").select("run_id", "line", "c.tool", "c.error_class", "c.cwe")


def _rules(rules) -> str:
    return "CASE " + " ".join("WHEN regexp_matches(text, '" + p.replace("'", "''") + f"') THEN '{k}'" for k, p in rules) + " END"


QUERIES = {q.__name__: q for q in (*[_pack(n) for n in scan.PACKS], scan_obligations, fuzz_telemetry, crash_classify)}

ORACLE_SQL = {_NAMES.get(n, f"scan_{n}"): _pack_sql(p) for n, p in scan.PACKS.items()} | {
    "scan_obligations": code_sql(
        f"""SELECT repo, path, line, kind FROM (SELECT *, CASE WHEN regexp_matches(path, '{scan.NATIVE_FILES}') THEN {_rules(scan.NATIVE_RULES)} WHEN regexp_matches(path, '{scan.BOTH_FILES}') THEN {_rules(scan.NATIVE_RULES + scan.WEB_RULES)}
 WHEN regexp_matches(path, '{scan.WEB_FILES}') THEN {_rules(scan.WEB_RULES)} END AS kind FROM code WHERE trim(text) <> '' AND length(text) <= 400 AND NOT regexp_matches(text, '{scan.COMMENT}')) WHERE kind IS NOT NULL"""
    ),
    "fuzz_telemetry": sql(
        """WITH x AS (SELECT *, TRY_CAST(nullif(regexp_extract(text, '^#(\\d+)', 1), '') AS BIGINT) AS e, TRY_CAST(nullif(regexp_extract(text, 'cov:\\s*(\\d+)', 1), '') AS BIGINT) AS c, TRY_CAST(nullif(regexp_extract(text, 'ft:\\s*(\\d+)', 1), '') AS BIGINT) AS f, TRY_CAST(nullif(regexp_extract(text, 'exec/s:\\s*(\\d+)', 1), '') AS BIGINT) AS s FROM logs),
y AS (SELECT *, TRY_CAST(nullif(regexp_extract(text, 'corpus: (\\d+).*crashers: (\\d+)', 1), '') AS BIGINT) AS gc, TRY_CAST(nullif(regexp_extract(text, 'corpus: (\\d+).*crashers: (\\d+)', 2), '') AS BIGINT) AS gr, nullif(regexp_extract(text, 'written to (\\S+)', 1), '') AS ar, nullif(regexp_extract(text, 'SUMMARY: AddressSanitizer: (.+)', 1), '') AS su, nullif(regexp_extract(text, '^#\\d+ (NEW|DONE) +cov: \\d+ ft: ', 1), '') AS st FROM x),
g AS (SELECT run_id, arg_max(e, line) FILTER (e IS NOT NULL) AS execs, arg_max(c, line) FILTER (c IS NOT NULL) AS cov, arg_max(f, line) FILTER (f IS NOT NULL) AS features, arg_max(s, line) FILTER (s IS NOT NULL) AS execs_per_second, count(*) FILTER (regexp_matches(text, '^#\\d+\\s+NEW')) AS new_inputs, count(*) FILTER (regexp_matches(text, '^#\\d+\\s+REDUCE')) AS reduced,
 count(*) FILTER (regexp_matches(text, 'ERROR: .*Sanitizer|deadly signal')) AS crashes, bool_or(starts_with(text, 'Done ')) AS done, arg_max(gc, line) FILTER (gc IS NOT NULL) AS corpus, arg_max(gr, line) FILTER (gr IS NOT NULL) AS crashers, arg_min(ar, line) FILTER (ar IS NOT NULL) AS artifact, arg_min(su, line) FILTER (su IS NOT NULL) AS summary, arg_max(st, line) FILTER (st IS NOT NULL) AS st FROM y GROUP BY run_id)
SELECT * EXCLUDE (st), CASE WHEN summary IS NOT NULL OR coalesce(crashers, 0) > 0 THEN 'crash' WHEN st = 'DONE' THEN 'done' ELSE 'unknown' END AS ended_with, CASE WHEN crashes > 0 THEN 'crashed' WHEN cov IS NULL THEN 'no-coverage-data' WHEN new_inputs = 0 THEN 'saturating' WHEN done THEN 'completed' ELSE 'interrupted' END AS signal FROM g""", logs=LOGS
    ),
    "crash_classify": sql(
        """SELECT run_id, line, CASE WHEN contains(text, 'runtime error') THEN 'UndefinedBehaviorSanitizer' ELSE 'AddressSanitizer' END AS tool, CASE WHEN contains(text, 'ERROR: ') THEN 'heap-use-after-free' WHEN contains(text, 'runtime error') THEN 'div-by-zero' ELSE 'bus-error' END AS error_class,
 CASE WHEN contains(text, 'ERROR: ') THEN 'CWE-416' WHEN contains(text, 'runtime error') THEN 'CWE-369' ELSE 'CWE-119' END AS cwe FROM logs WHERE contains(text, 'Sanitizer') OR contains(text, 'runtime error')""", logs=LOGS
    ),
}
