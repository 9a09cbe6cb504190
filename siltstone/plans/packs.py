"""Queries of scans over all source lines: anchors, handlers, harnesses, flows and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import catalog, dispatch, flows, scan, worklists
from siltstone.plans.derived import FINDINGS, read
from siltstone.plans.lines import code_lines, code_sql
from siltstone.plans.register import registry
from siltstone.plans.scans import ORACLE_SQL as SCANS_SQL
from siltstone.plans.structure import inside_sql, spans_sql
from siltstone.plans.threats import INVARIANTS, LEADS, THREATS

QUERIES, ORACLE_SQL, register = registry()


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _has(pattern: str, of: str = "text") -> str:
    return f"regexp_matches({of}, {_q(pattern)})"


def _anchors(pattern: str) -> str:
    return code_sql(f"WITH h AS (SELECT repo, path, line, min(text) AS text FROM code WHERE {_has(scan.flagged(pattern, 'smart'))} GROUP BY ALL) SELECT repo, path, line, substr(trim(text, ' '), 1, 160) AS signal FROM h QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY line) <= 8")


@register("scan_source_anchors", _anchors(scan.SOURCES))
def scan_source_anchors(spark, sf_dir):
    return scan.anchors(code_lines(spark, sf_dir), scan.SOURCES)


@register("scan_sink_anchors", _anchors(scan.SINKS))
def scan_sink_anchors(spark, sf_dir):
    return scan.anchors(code_lines(spark, sf_dir), scan.SINKS)


@register("scan_entry_defs", code_sql(f"SELECT repo, path, count(*) AS n FROM code WHERE {_has(scan.ENTRY_DEFS)} GROUP BY ALL"))
def scan_entry_defs(spark, sf_dir):
    return scan.entry_defs(code_lines(spark, sf_dir))


_SIGNALS = [s for _, _, _, signals in catalog.CATALOG for s in signals.split("|")]


@register("scan_any_fixed", code_sql("SELECT repo, path FROM (SELECT DISTINCT repo, path FROM code WHERE " + " OR ".join(f"contains(text, {_q(x)})" for x in [x for x in _SIGNALS if len(x) >= 3][:120]) + ") QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path) <= 80"))
def scan_any_fixed(spark, sf_dir):
    return scan.any_fixed(code_lines(spark, sf_dir), _SIGNALS)


@register("hit_rank", code_sql("SELECT repo, path, line, " + " + ".join(f"CASE WHEN regexp_matches({s}, '{p}') THEN {w} ELSE 0 END" for s, p, w in scan.RANKERS["systems"]) + " AS systems, " + " + ".join(f"CASE WHEN regexp_matches({s}, '{p}') THEN {w} ELSE 0 END" for s, p, w in scan.RANKERS["payment"]) + " AS payment FROM code"))
def hit_rank(spark, sf_dir):
    p, t = F.col("path"), F.col("text")
    return code_lines(spark, sf_dir).select("repo", "path", "line", scan.rank(p, t, "systems").alias("systems"), scan.rank(p, t, "payment").alias("payment"))


@register("classify_program_kind", code_sql("WITH n AS (SELECT repo, " + ", ".join(f"CAST(sum(len(regexp_extract_all(text, {_q(p)}))) AS BIGINT) AS {i}" for i, p in scan.PROGRAM) + " FROM code GROUP BY repo) SELECT *, CASE WHEN web >= 2 THEN 'web-service' WHEN main > 0 AND socket > 0 THEN 'daemon' WHEN main > 0 AND argv > 0 THEN 'cli' WHEN main = 0 THEN 'library' ELSE 'unknown' END AS kind, CASE WHEN web >= 2 THEN 'high' WHEN main > 0 AND socket > 0 THEN CASE WHEN socket >= 2 THEN 'high' ELSE 'medium' END WHEN main > 0 AND argv > 0 THEN 'medium' WHEN main = 0 THEN 'medium' ELSE 'low' END AS confidence FROM n"))
def classify_program_kind(spark, sf_dir):
    return scan.program_kind(code_lines(spark, sf_dir))


_ENGINES = " UNION ALL ".join(f"SELECT repo, path, line, {o} AS ord, '{i}' AS engine FROM code WHERE {_has(p)}" for o, (i, p) in enumerate(scan.HARNESSES))


@register("scan_harnesses", code_sql(f"WITH h AS ({_ENGINES}), m AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY ord, line) = 1), b AS (SELECT repo, bool_or({_has('(^|/)build[.]sh$', 'path')}) AS built FROM code GROUP BY repo) SELECT m.repo, path, engine, line, CASE WHEN built OR engine = 'cargo-fuzz' THEN 'high' ELSE 'medium' END AS confidence FROM m JOIN b ON m.repo = b.repo"))
def scan_harnesses(spark, sf_dir):
    return scan.harnesses(code_lines(spark, sf_dir))


@register("scan_build_hardening", code_sql("SELECT repo, count(DISTINCT path) AS build_files, " + ", ".join(f"min(CASE WHEN {_has(p)} THEN path END) AS {i}" for i, p in scan.HARDENING) + f" FROM code WHERE {_has(scan.BUILD_FILES, 'path')} GROUP BY repo"))
def scan_build_hardening(spark, sf_dir):
    return scan.hardening(code_lines(spark, sf_dir))


def _taint(table) -> str:
    language = "CASE " + " ".join(f"WHEN {_has(files, 'path')} THEN '{i}'" for i, files, _ in table) + " END"
    here = " OR ".join(f"({_has(files, 'path')} AND {_has(names)})" for _, files, names in table)
    return code_sql(f"SELECT repo, path, line, {language} AS language FROM code WHERE {here} QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY line) <= 200")


@register("scan_taint_sources", _taint(scan.TAINT_SOURCES))
def scan_taint_sources(spark, sf_dir):
    return scan.taint_names(code_lines(spark, sf_dir), scan.TAINT_SOURCES)


@register("scan_taint_sinks", _taint(scan.TAINT_SINKS))
def scan_taint_sinks(spark, sf_dir):
    return scan.taint_names(code_lines(spark, sf_dir), scan.TAINT_SINKS)


_PROBES = SCANS_SQL["logic_probes"]
_FEW_INVARIANTS = "SELECT repo, id, CAST(row_number() OVER (PARTITION BY repo ORDER BY ord, id) AS INTEGER) AS place FROM i QUALIFY place <= 8"


@register("scan_logic", code_sql(f"WITH f AS ({_FEW_INVARIANTS}), h AS (SELECT repo, max(place) AS held FROM f GROUP BY repo), p AS ({_PROBES}) SELECT repo, place, 'invariant' AS kind, id FROM f UNION ALL SELECT p.repo, CAST(p.place + coalesce(held, 0) AS INTEGER) AS place, 'probe', concat_ws(':', pattern, path, line) FROM p LEFT JOIN h ON p.repo = h.repo WHERE p.place + coalesce(held, 0) <= 16", i=INVARIANTS))
def scan_logic(spark, sf_dir):
    return scan.logic_candidates(code_lines(spark, sf_dir), read(spark, sf_dir, INVARIANTS))


_LANGUAGE = "CASE WHEN regexp_matches(path, '\\.(c|h)$') THEN 'c' WHEN regexp_matches(path, '\\.py$') THEN 'python' WHEN regexp_matches(path, '\\.js$') THEN 'javascript' WHEN regexp_matches(path, '\\.java$') THEN 'java' WHEN regexp_matches(path, '\\.go$') THEN 'go' WHEN regexp_matches(path, '\\.rb$') THEN 'ruby' ELSE 'other' END"


@register("scan_invariant_files", code_sql(f"WITH s AS (SELECT DISTINCT signal FROM i), h AS (SELECT DISTINCT repo, path, {_LANGUAGE} AS language, signal FROM code JOIN s ON contains(text, signal)), m AS (SELECT DISTINCT i.repo, id, path FROM i JOIN h ON i.repo = h.repo AND i.signal = h.signal AND (i.language IS NULL OR i.language = h.language)) SELECT repo, id, path, CAST(row_number() OVER (PARTITION BY repo, id ORDER BY path) AS INTEGER) AS place FROM m QUALIFY place <= 25", i=INVARIANTS))
def scan_invariant_files(spark, sf_dir):
    return worklists.invariant_files(code_lines(spark, sf_dir), read(spark, sf_dir, INVARIANTS))


_CATALOG_SIGNALS = " UNION ALL ".join(f"SELECT {c} AS cwe, {_q(x)} AS signal" for c, _, _, signals in catalog.CATALOG for x in signals.split("|") if len(x) >= 3)
_GENERIC = " + ".join(f"CASE WHEN regexp_matches({s}, '{p}') THEN {w} ELSE 0 END" for s, p, w in scan.RANKERS["generic"])
_SEEDS = "SELECT repo, fingerprint, file_path, TRY_CAST(nullif(regexp_extract(cwe, '\\d+', 0), '') AS BIGINT) AS cwe FROM (SELECT concat('r', CAST(substr(repo, 2) AS BIGINT) % 3) AS repo, fingerprint, file_path, cwe, status FROM f) WHERE status IN ('confirmed', 'proven') QUALIFY row_number() OVER (PARTITION BY repo ORDER BY fingerprint) <= 8"


@register("scan_variant_files", code_sql(f"WITH c AS ({_CATALOG_SIGNALS}), sd AS ({_SEEDS}), s AS (SELECT DISTINCT signal FROM c JOIN sd ON c.cwe = sd.cwe), h AS (SELECT repo, path, line, signal, {_GENERIC} AS score FROM code JOIN s ON CASE WHEN signal = lower(signal) THEN contains(lower(text), signal) ELSE contains(text, signal) END QUALIFY row_number() OVER (PARTITION BY repo, path, signal ORDER BY line) <= 3), b AS (SELECT sd.repo, fingerprint, path, max(score) AS score FROM sd JOIN c ON sd.cwe = c.cwe JOIN h ON h.repo = sd.repo AND h.signal = c.signal AND h.path <> sd.file_path GROUP BY ALL) SELECT repo, fingerprint, path, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY repo, fingerprint ORDER BY score DESC, path) AS INTEGER) AS place FROM b QUALIFY place <= 40", f=FINDINGS))
def scan_variant_files(spark, sf_dir):
    f = read(spark, sf_dir, FINDINGS).withColumn("repo", F.concat(F.lit("r"), (F.substring("repo", 2, 9).cast("long") % 3).cast("string")))
    return worklists.variant_files(worklists.variant_seeds(f), catalog.catalog(spark), code_lines(spark, sf_dir))


@register("systems_candidates", code_sql(f"WITH p AS ({SCANS_SQL['scan_systems']}) SELECT repo, 'scan' AS origin, concat_ws(':', pattern, path, line) AS id FROM p UNION ALL SELECT repo, 'threat', id FROM (SELECT repo, id FROM t QUALIFY row_number() OVER (PARTITION BY repo ORDER BY id) <= 20) UNION ALL SELECT repo, 'lead', id FROM (SELECT repo, id FROM l QUALIFY row_number() OVER (PARTITION BY repo ORDER BY id) <= 20)", t=THREATS, l=LEADS))
def systems_candidates(spark, sf_dir):
    found = scan.pattern_scan(code_lines(spark, sf_dir), scan.PACKS["systems"]).select("repo", F.concat_ws(":", "pattern", "path", F.col("line").cast("string")).alias("id"))
    return worklists.candidates({"scan": (found, None), "threat": (read(spark, sf_dir, THREATS), 20), "lead": (read(spark, sf_dir, LEADS), 20)})


_D = dispatch
_IDS = f"list_filter(regexp_extract_all(regexp_replace(text, {_q(_D.CALL)}, '(', 'g'), {_q(_D.SYMBOL)}, 1), lambda x: x NOT IN ({', '.join(_q(k) for k in _D.KEYWORDS)}) AND NOT {_has(_D.CONSTANT, 'x')})"
_HANDLERS = f"""WITH nm AS (SELECT repo, path, line, coalesce(nullif(regexp_extract(text, {_q(_D.KEYWORD_DEF)}, 1), ''), CASE WHEN NOT regexp_matches(text, ';\\s*$') THEN nullif(regexp_extract(text, {_q(_D.CALL)}, 1), '') END) AS name FROM code WHERE {_has(_D.DEFINITION)}),
df AS (SELECT repo, name, path, line FROM nm WHERE name IS NOT NULL AND name NOT IN ({', '.join(_q(k) for k in _D.KEYWORDS)}) QUALIFY row_number() OVER (PARTITION BY repo, name ORDER BY {_has(_D.HEADER, 'path')}, path, line) = 1),
e1 AS (SELECT repo, 1 AS part, 'handler-table-decl' AS kind, CAST(NULL AS VARCHAR) AS name, concat('table@', path, ':', line) AS handler, path, line, path AS def_path, line AS def_line FROM code WHERE {_has(_D.TABLE)}),
e2 AS (SELECT repo, 2, 'convention-def', lower(regexp_replace(regexp_replace(regexp_replace(name, '(?:Command|Handler|Cmd|Callback)$', ''), '^(?:on_|handle_|cmd_)', ''), '_(?:handler|cmd|command|callback)$', '')), name, path, line, path, line FROM df WHERE {_has(_D.BY_CONVENTION, 'name')}),
rw AS (SELECT repo, path, line, nullif(regexp_extract(text, '["'']([^"'']{{1,64}})["'']', 1), '') AS name, CASE WHEN regexp_matches(text, '\\{{\\s*["'']') THEN 'pointer-table' WHEN regexp_matches(text, '\\b[A-Z][A-Z0-9_]{{2,}}\\s*\\(') THEN 'macro-table' ELSE 'registration-call' END AS kind,
 {_IDS} AS ids, nullif(regexp_extract(text, {_q(_D.BESIDE_NAME)}, 1), '') AS beside FROM code WHERE {_has(_D.ENTRY)}),
hd AS (SELECT *, coalesce(list_filter(ids, lambda x: {_has(_D.HANDLER, 'x')})[-1], beside) AS handler FROM rw WHERE len(ids) > 0),
e3 AS (SELECT hd.repo, 3, kind, hd.name, handler, hd.path, hd.line, coalesce(df.path, hd.path), coalesce(df.line, hd.line) FROM hd LEFT JOIN df ON df.repo = hd.repo AND df.name = handler WHERE handler IS NOT NULL AND (df.path IS NOT NULL OR {_has(_D.HANDLER, 'handler')})),
ev AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3),
on_ AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY repo, def_path, handler ORDER BY part, path, line, kind, name NULLS FIRST) = 1),
ds AS (SELECT repo, kind, name, handler, path, line, def_path, def_line, CAST(row_number() OVER (PARTITION BY repo ORDER BY part, path, line, handler) AS INTEGER) AS place FROM on_ QUALIFY place <= {{most}})"""


@register("dispatch_handlers", code_sql(_HANDLERS.replace("{most}", "400") + " SELECT * FROM ds"))
def dispatch_handlers(spark, sf_dir):
    return dispatch.handlers(code_lines(spark, sf_dir))


@register("dispatch_files", code_sql(_HANDLERS.replace("{most}", "400") + " SELECT DISTINCT repo, def_path FROM ds"))
def dispatch_files(spark, sf_dir):
    return dispatch.handlers(code_lines(spark, sf_dir)).select("repo", "def_path").distinct()


@register("dispatch_vocabulary", code_sql(_HANDLERS.replace("{most}", "600") + f", vc AS (SELECT repo, name, handler, place AS slot FROM ds WHERE {_has(_D.TOKEN, 'name')} QUALIFY row_number() OVER (PARTITION BY repo, name ORDER BY place) = 1) SELECT repo, name, handler, CAST(row_number() OVER (PARTITION BY repo ORDER BY slot) AS INTEGER) AS place FROM vc QUALIFY place <= 200"))
def dispatch_vocabulary(spark, sf_dir):
    return dispatch.vocabulary(dispatch.handlers(code_lines(spark, sf_dir), 600))


_RULE_HITS = " UNION ALL ".join(f"SELECT repo, path, line, '{c}' AS cwe, '{k}' AS kind FROM code WHERE {_has(p)}" for c, a, b in flows.RULES for k, p in (("source", a), ("sink", b)))


@register("flow_rules", code_sql(f"SELECT repo, cwe, kind, count(*) AS hits, count(DISTINCT path) AS files FROM ({_RULE_HITS}) GROUP BY ALL"))
def flow_rules(spark, sf_dir):
    return flows.rule_hits(code_lines(spark, sf_dir)).groupBy("repo", "cwe", "kind").agg(F.count("*").alias("hits"), F.countDistinct("path").alias("files"))


@register("flow_link", code_sql(f"WITH h AS ({_RULE_HITS}), w AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY repo, cwe, kind ORDER BY path, line) <= 200), t AS (SELECT code.* FROM code WHERE (repo, path) IN (SELECT (repo, path) FROM w)), {spans_sql('t')}, i AS ({inside_sql('w', 'repo, path, line, cwe, kind')}), b AS (SELECT repo, path, line, cwe, kind, CASE WHEN stop IS NOT NULL THEN start END AS block_start, CASE WHEN stop IS NOT NULL THEN block END AS block FROM i), l AS (SELECT s.repo, s.cwe, s.path, s.block_start, s.block, max(x.line) AS source_line, s.line AS sink_line FROM b s JOIN b x ON s.repo = x.repo AND s.path = x.path AND s.cwe = x.cwe AND s.block_start IS NOT DISTINCT FROM x.block_start AND x.kind = 'source' AND x.line < s.line WHERE s.kind = 'sink' GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY repo, cwe ORDER BY path, sink_line) AS INTEGER) AS place FROM l QUALIFY place <= 25"))
def flow_link(spark, sf_dir):
    lines = code_lines(spark, sf_dir)
    return flows.linked(flows.rule_hits(lines), lines)
