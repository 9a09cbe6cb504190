"""Queries of single expressions, small joins, ledgers and sets, each under its own name."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import scores, text, verdicts
from siltstone.operators import benchmarks, code, evals, findings, overlaps, ranking, surface, worklists
from siltstone.plans import findings as of_findings
from siltstone.plans import surface as of_surface
from siltstone.plans.derived import ACTUAL, ANCHORS, FILES, FINDINGS, SYMBOLS, TRUTH, read, sql
from siltstone.plans.readers import APIS, DECLARED
from siltstone.plans.threats import LEADS, THREATS
from siltstone.sources import documents

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, oracle: str):
    """Name a query and its SQL."""

    def keep(query):
        query.__name__ = name
        QUERIES[name], ORACLE_SQL[name] = query, oracle
        return query

    return keep


def _column(module, whole: str, key: str, column: str):
    register(column, f"SELECT {key}, {column} FROM ({module.ORACLE_SQL[whole]})")(lambda spark, sf_dir: module.QUERIES[whole](spark, sf_dir).select(key, column))


for _c in ("norm_path", "language_of", "component_of", "subsystem_key", "slug", "one_line"):
    _column(of_surface, "path_names", "doc_id", _c)
for _c in ("verdict_to_status", "verify_to_status", "poc_to_status", "fix_to_status", "proof_state", "gate_verdict", "sarif_level", "norm_cwe", "is_memory_finding", "proof_lane"):
    _column(of_findings, "verdict_maps", "fingerprint", _c)
_column(of_findings, "derive_severity", "fingerprint", "judged")
QUERIES["judge_claimed"], ORACLE_SQL["judge_claimed"] = QUERIES.pop("judged"), ORACLE_SQL.pop("judged")

_NUMBER = "TRY_CAST(nullif(regexp_extract(cwe, '\\d+', 0), '') AS BIGINT)"
_ACTIVE = "status IN ('open', 'needs-evidence', 'needs-trace', 'confirmed', 'proven')"


@register("bounded_scores", sql("SELECT fingerprint, least(8, CAST(round(log2(caller_count + 1) * 1.6) AS INTEGER)) AS reach_score, least(4, CAST(round(log2(caller_count + 1)) AS INTEGER)) AS reach_boost, least(15, CAST(round(log10(caller_count + 1) * 5) AS INTEGER)) AS blast_bonus, CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 WHEN 'none' THEN 0 ELSE 2 END AS severity_rank FROM f", f=FINDINGS))
def bounded_scores(spark, sf_dir):
    n = F.col("caller_count")
    return read(spark, sf_dir, FINDINGS).select("fingerprint", scores.reach_score(n).alias("reach_score"), scores.reach_boost(n).alias("reach_boost"), scores.blast_bonus(n).alias("blast_bonus"), scores.severity_rank(F.col("severity")).alias("severity_rank"))


@register("path_suffix_eq", sql("SELECT t.id, count(*) AS n, min(a.fingerprint) AS first FROM t JOIN a ON t.case_id = a.case_id AND (t.file_path = a.file_path OR ends_with(a.file_path, '/' || t.file_path)) GROUP BY t.id", t=TRUTH, a=ACTUAL))
def path_suffix_eq(spark, sf_dir):
    """Expectations with the number of findings in a file of the same path, and the first; findings are counted by path first."""
    t = read(spark, sf_dir, TRUTH).select("case_id", "id", F.col("file_path").alias("p"))
    a = read(spark, sf_dir, ACTUAL).groupBy("case_id", F.col("file_path").alias("q")).agg(F.count("*").alias("n"), F.min("fingerprint").alias("first"))
    paths = t.select("case_id", "p").distinct().withColumn("base", text.basename(F.col("p"))).join(a.withColumn("base", text.basename(F.col("q"))), ["case_id", "base"])
    met = paths.filter(text.same_path(F.col("p"), F.col("q"))).groupBy("case_id", "p").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return t.join(met, ["case_id", "p"]).select("id", "n", "first")


@register("clamp_confidence", "SELECT l_orderkey, l_linenumber, l_partkey, greatest(0.0, least(1.0, l_tax * 20 - 0.3)) AS confidence FROM lineitem")
def clamp_confidence(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", text.clamp_confidence((F.col("l_tax") * 20 - 0.3).cast("string")).alias("confidence"))


@register("norm_stride", "SELECT event_id, CASE event_type WHEN 'click' THEN 'information-disclosure' WHEN 'view' THEN 'spoofing' END AS stride, CASE WHEN value >= 70 THEN 'high' WHEN value >= 40 THEN 'medium' ELSE 'low' END AS likelihood, CASE user_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'low' ELSE 'medium' END AS impact FROM events")
def norm_stride(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = F.when(F.col("event_type") == "click", " Information_Disclosure").when(F.col("event_type") == "view", "SPOOFING").otherwise("other")
    said = F.when(F.col("user_id") % 5 == 0, "Critical!").when(F.col("user_id") % 5 == 1, "very HIGH").when(F.col("user_id") % 5 == 2, "low, then high").otherwise("unclear")
    return e.select("event_id", verdicts.stride(raw).alias("stride"), verdicts.likelihood(F.col("value") / 100).alias("likelihood"), verdicts.impact(said).alias("impact"))


@register("obligation_id", sql("SELECT concat('OB:', lpad(CAST(start_line AS VARCHAR), 4, '0'), ':', file_path, ':', batch, ':', source) AS id FROM f", f=FINDINGS))
def obligation_id(spark, sf_dir):
    return read(spark, sf_dir, FINDINGS).select(text.obligation_id("OB", F.col("start_line"), F.col("file_path"), F.col("batch"), F.col("source")).alias("id"))


@register("chain_id", f"SELECT chain_id FROM ({of_findings.ORACLE_SQL['chain_build']})")
def chain_id(spark, sf_dir):
    return of_findings.chain_build(spark, sf_dir).select("chain_id")


@register("chain_backref", sql("SELECT fingerprint, string_agg(DISTINCT chain, ',' ORDER BY chain) AS chains FROM f WHERE chain IS NOT NULL GROUP BY fingerprint", f=FINDINGS))
def chain_backref(spark, sf_dir):
    f = read(spark, sf_dir, FINDINGS).filter("chain is not null")
    return f.groupBy("fingerprint").agg(F.array_join(F.array_sort(F.collect_set("chain")), ",").alias("chains"))


@register("chain_candidates", sql(f"SELECT repo, count(*) AS n FROM f WHERE {_ACTIVE} GROUP BY repo HAVING count(*) >= 2", f=FINDINGS))
def chain_candidates(spark, sf_dir):
    return read(spark, sf_dir, FINDINGS).filter(F.col("status").isin(*findings.ACTIONABLE)).groupBy("repo").agg(F.count("*").alias("n")).filter("n >= 2")


@register("chain_members", sql("SELECT chain, fingerprint FROM f WHERE chain IS NOT NULL AND chain IN (SELECT chain FROM f GROUP BY chain HAVING count(DISTINCT fingerprint) >= 2)", f=FINDINGS))
def chain_members(spark, sf_dir):
    f = read(spark, sf_dir, FINDINGS)
    m = f.filter("chain is not null").select("chain", "fingerprint").distinct()
    known = m.join(f.select("fingerprint"), "fingerprint", "left_semi")
    return known.join(known.groupBy("chain").agg(F.count("*").alias("n")).filter("n >= 2"), "chain").select("chain", "fingerprint")


@register("distinct_sets", sql("SELECT repo, string_agg(DISTINCT source, ',' ORDER BY source) AS producers, count(DISTINCT file_path) AS n_files FROM f GROUP BY repo", f=FINDINGS))
def distinct_sets(spark, sf_dir):
    return read(spark, sf_dir, FINDINGS).groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("producers"), F.countDistinct("file_path").alias("n_files"))


@register("dedupe_first_wins", sql("SELECT repo, ref_id, fingerprint FROM f QUALIFY row_number() OVER (PARTITION BY repo, ref_id ORDER BY batch, ord) = 1", f=FINDINGS))
def dedupe_first_wins(spark, sf_dir):
    return findings.first_wins(read(spark, sf_dir, FINDINGS), ["repo", "ref_id"], [F.col("batch"), F.col("ord")]).select("repo", "ref_id", "fingerprint")


@register("first_def_wins", sql("SELECT repo, name, file_path, line FROM s QUALIFY row_number() OVER (PARTITION BY repo, name ORDER BY line, file_path) = 1", s=SYMBOLS))
def first_def_wins(spark, sf_dir):
    return findings.first_wins(read(spark, sf_dir, SYMBOLS), ["repo", "name"], [F.col("line"), F.col("file_path")]).select("repo", "name", "file_path", "line")


@register("dedup_keep_slot", sql("WITH k AS (SELECT repo, file_path, ord AS pos, CASE WHEN start_line % 3 = 0 THEN 'file' ELSE source END AS kind, title AS signal FROM f), b AS (SELECT *, min(pos) OVER (PARTITION BY repo, file_path) AS slot FROM k QUALIFY row_number() OVER (PARTITION BY repo, file_path ORDER BY kind = 'file', pos, kind, signal) = 1) SELECT repo, file_path, slot, kind, signal FROM b", f=FINDINGS))
def dedup_keep_slot(spark, sf_dir):
    f = read(spark, sf_dir, FINDINGS).select("repo", "file_path", F.col("ord").alias("pos"), F.when(F.col("start_line") % 3 == 0, "file").otherwise(F.col("source")).alias("kind"), F.col("title").alias("signal"))
    return evals.keep_slot(f, ["repo", "file_path"])


@register("tier_counts", sql(f"SELECT repo, CASE WHEN p >= 75 THEN 'P0' WHEN p >= 55 THEN 'P1' WHEN p >= 35 THEN 'P2' ELSE 'P3' END AS tier, count(*) AS n FROM (SELECT *, {of_findings._PRIORITY} AS p FROM f) GROUP BY ALL", f=FINDINGS))
def tier_counts(spark, sf_dir):
    return findings.prioritised(read(spark, sf_dir, FINDINGS)).groupBy("repo", "tier").agg(F.count("*").alias("n"))


@register("verdict_counts", sql("SELECT source, verdict, count(*) AS n FROM f GROUP BY ALL", f=FINDINGS))
def verdict_counts(spark, sf_dir):
    return read(spark, sf_dir, FINDINGS).groupBy("source", "verdict").agg(F.count("*").alias("n"))


@register("related_cwes", sql(f"SELECT repo, count(DISTINCT {_NUMBER}) AS n_cwes, string_agg(DISTINCT 'CWE-' || {_NUMBER}, ',' ORDER BY 'CWE-' || {_NUMBER}) AS cwes FROM f GROUP BY repo", f=FINDINGS))
def related_cwes(spark, sf_dir):
    f = read(spark, sf_dir, FINDINGS).withColumn("c", text.norm_cwe(F.col("cwe")))
    return f.groupBy("repo").agg(F.countDistinct("c").alias("n_cwes"), F.array_join(F.slice(F.array_sort(F.collect_set("c")), 1, 30), ",").alias("cwes"))


@register("intel_for_threats", sql(f"WITH t AS (SELECT DISTINCT repo, 'CWE-' || {_NUMBER} AS x FROM f WHERE {_NUMBER} IS NOT NULL), i AS (SELECT DISTINCT source AS id, 'CWE-' || {_NUMBER} AS x FROM f WHERE severity = 'critical' AND {_NUMBER} IS NOT NULL) SELECT repo, count(DISTINCT id) AS n, min(id) AS first FROM t JOIN i USING (x) GROUP BY repo", f=FINDINGS))
def intel_for_threats(spark, sf_dir):
    f = read(spark, sf_dir, FINDINGS).withColumn("c", text.norm_cwe(F.col("cwe")))
    threats = f.groupBy("repo").agg(F.collect_set("c").alias("cwes"))
    leads = f.filter("severity = 'critical'").groupBy(F.col("source").alias("id")).agg(F.collect_set("c").alias("cwes"))
    return overlaps.overlap(threats, leads, "cwes", "repo")


@register("symbol_lookup", sql("SELECT repo, name, file_path, line FROM s QUALIFY row_number() OVER (PARTITION BY repo, name ORDER BY file_path, line) <= 50", s=SYMBOLS))
def symbol_lookup(spark, sf_dir):
    s = read(spark, sf_dir, SYMBOLS)
    return code.definitions(s, s.select("repo", "name").distinct(), 50).select("repo", "name", "file_path", "line")


@register("top_symbols", sql("SELECT repo, name, file_path, caller_count, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY caller_count DESC, name, file_path, line) AS n FROM s) WHERE n <= 20", s=SYMBOLS))
def top_symbols(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("repo").orderBy(F.desc("caller_count"), "name", "file_path", "line")
    return read(spark, sf_dir, SYMBOLS).withColumn("n", F.row_number().over(order)).filter("n <= 20").select("repo", "name", "file_path", "caller_count", "n")


@register("cross_file_callers", sql("WITH calls AS (SELECT repo, concat('fn', line * 3 % 97) AS name, file_path, line FROM a), d AS (SELECT DISTINCT repo, name, file_path FROM s) SELECT repo, name, file_path, line FROM (SELECT * FROM calls c WHERE EXISTS (SELECT 1 FROM d WHERE d.repo = c.repo AND d.name = c.name) AND NOT EXISTS (SELECT 1 FROM d WHERE d.repo = c.repo AND d.name = c.name AND d.file_path = c.file_path)) GROUP BY ALL", a=ANCHORS, s=SYMBOLS))
def cross_file_callers(spark, sf_dir):
    calls = read(spark, sf_dir, ANCHORS).select("repo", F.concat(F.lit("fn"), (F.col("line") * 3 % 97).cast("string")).alias("name"), "file_path", "line")
    defs = read(spark, sf_dir, SYMBOLS).select("repo", "name", "file_path").distinct()
    return calls.join(defs.select("repo", "name").distinct(), ["repo", "name"], "left_semi").join(defs, ["repo", "name", "file_path"], "left_anti").distinct()


@register("overlay_exclude", sql("WITH t AS (SELECT repo, file_path FROM (SELECT repo, file_path, max(caller_count) AS m FROM f GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY m DESC, file_path) <= 10) SELECT fingerprint FROM f WHERE (repo, file_path) NOT IN (SELECT (repo, file_path) FROM t)", f=FINDINGS))
def overlay_exclude(spark, sf_dir):
    from pyspark.sql import Window

    f = read(spark, sf_dir, FINDINGS)
    top = f.groupBy("repo", "file_path").agg(F.max("caller_count").alias("m")).withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("m"), "file_path"))).filter("n <= 10")
    return f.join(top, ["repo", "file_path"], "left_anti").select("fingerprint")


@register("false_proof_stats", sql(of_findings._SCORE + " SELECT case_id, false_proofs, proven FROM s", truth=TRUTH, actual=ACTUAL))
def false_proof_stats(spark, sf_dir):
    return of_findings.score_findings(spark, sf_dir).select("case_id", "false_proofs", "proven")


#: Evaluation runs, one an order.
RUNS = """
SELECT o_orderkey % 2 = 0 AS routed, o_orderkey % 3 = 0 AS found, o_orderkey % 6 = 0 AS confirmed, o_orderkey % 12 = 0 AS proven, o_custkey % 4 = 0 AS cross_file, o_custkey % 5 < 3 AS in_context,
 CASE o_custkey % 7 WHEN 0 THEN NULL ELSE o_custkey % 2 = 0 END AS site_in_context, o_orderkey % 4 AS false_proofs, o_orderkey % 9 AS proven_total, CAST(o_custkey % 100 AS DOUBLE) AS cost
FROM {orders}
"""


@register(
    "eval_aggregate",
    sql(
        "SELECT count(*) AS cases, " + ", ".join(f"count(*) FILTER ({c}) AS n_{c}, round(count(*) FILTER ({c}) / count(*), 4) AS {c}_rate" for c in ("routed", "found", "confirmed", "proven", "cross_file", "in_context")) + ", round(count(*) FILTER (site_in_context) / count(site_in_context), 4) AS site_context_rate, round(count(*) FILTER (found AND in_context) / count(*) FILTER (in_context), 4) AS found_given_context, round(count(*) FILTER (found AND site_in_context) / count(*) FILTER (site_in_context), 4) AS found_given_site, round(sum(false_proofs) / sum(proven_total), 4) AS false_proof_rate, round(sum(cost) / count(*) FILTER (found), 4) AS cost_per_found FROM r", r=RUNS
    ),
)
def eval_aggregate(spark, sf_dir):
    return evals.eval_aggregate(read(spark, sf_dir, RUNS))


@register(
    "eval_gate",
    sql("WITH m AS (SELECT round(count(*) FILTER (found) / count(*), 4) AS found, round(count(*) FILTER (proven) / count(*), 4) AS proven FROM r) SELECT 'min-found' AS flag, 'found_rate' AS metric, found AS value, found >= 0.3 AS passed FROM m UNION ALL SELECT 'max-proven', 'proven_rate', proven, proven <= 0.05 FROM m UNION ALL SELECT 'min-missing', 'missing', NULL, false", r=RUNS),
)
def eval_gate(spark, sf_dir):
    row = eval_aggregate(spark, sf_dir)
    metrics = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("found_rate", "proven_rate")])).alias("m")).select("m.*")
    limits = spark.sql("select * from values ('min-found', 'found_rate', 'min', '30%'), ('max-proven', 'proven_rate', 'max', '0.05'), ('min-missing', 'missing', 'min', '0') as t(flag, metric, comparator, threshold)")
    return benchmarks.gate(metrics, limits)


@register(
    "rule_grade",
    sql("WITH r AS (SELECT concat('rule', l_suppkey % 40) AS rule_id, concat('file', l_partkey) AS file, l_suppkey % 40 <> 3 AS ok, l_suppkey % 5 < 4 AS seed FROM lineitem), g AS (SELECT rule_id, count(*) AS n_matches, count(DISTINCT file) AS n_match_files, bool_and(ok) AS ok, bool_or(seed) AS seed FROM r GROUP BY rule_id) SELECT rule_id, n_matches, n_match_files, CASE WHEN NOT ok THEN 'does-not-compile' WHEN NOT seed THEN 'misses-seed' WHEN n_matches > 200 THEN 'too-many-matches' WHEN n_match_files > (SELECT count(*) FROM part) * 0.25 THEN 'too-many-files' ELSE 'accepted' END AS grade FROM g", r0="SELECT 1 AS one"),
)
def rule_grade(spark, sf_dir):
    li, part = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    rules = li.select(F.concat(F.lit("rule"), (F.col("l_suppkey") % 40).cast("string")).alias("rule_id"), F.concat(F.lit("file"), F.col("l_partkey").cast("string")).alias("file"), (F.col("l_suppkey") % 40 != 3).alias("compile_ok"), (F.col("l_suppkey") % 5 < 4).alias("seed_matched"))
    return benchmarks.rule_grades(rules, part.agg(F.count("*").alias("n")))


#: Paths of hops, one a conversation.
HOPS = """
SELECT conv_id AS path_id, turn AS hop, concat(role, CAST(turn % 3 AS STRING)) AS node, concat('f', CAST((conv_id + turn) % 4 AS STRING)) AS file_path FROM {conversations}
"""


@register("evidence_graph", sql("SELECT path_id, node AS src, nxt AS dst, hop FROM (SELECT *, lead(node) OVER (PARTITION BY path_id ORDER BY hop) AS nxt FROM h) WHERE nxt IS NOT NULL", h=HOPS))
def evidence_graph(spark, sf_dir):
    return evals.evidence_edges(read(spark, sf_dir, HOPS))


@register("cross_file_flow", sql("SELECT path_id, count(*) AS n_hops, count(DISTINCT file_path) AS n_files FROM h GROUP BY path_id HAVING count(*) >= 2 AND count(DISTINCT file_path) >= 2", h=HOPS))
def cross_file_flow(spark, sf_dir):
    return evals.cross_file(read(spark, sf_dir, HOPS))


@register("entry_point_counts", sql("SELECT repo, kind, count(*) AS n, CASE WHEN count(*) >= 20 THEN 'WATCH' ELSE 'ok' END AS state FROM (SELECT repo, 'k' || (bytes % 3) AS kind FROM f) GROUP BY ALL", f=FILES))
def entry_point_counts(spark, sf_dir):
    f = read(spark, sf_dir, FILES).withColumn("kind", F.concat(F.lit("k"), (F.col("bytes") % 3).cast("string")))
    return f.groupBy("repo", "kind").agg(F.count("*").alias("n")).withColumn("state", F.when(F.col("n") >= 20, "WATCH").otherwise("ok"))


@register("sort_by_priority", sql(f"SELECT repo, fingerprint, CAST(row_number() OVER (PARTITION BY repo ORDER BY {of_findings._PRIORITY} DESC, fingerprint) AS INTEGER) AS place FROM f", f=FINDINGS))
def sort_by_priority(spark, sf_dir):
    return ranking.placed(findings.prioritised(read(spark, sf_dir, FINDINGS)), ["repo"], [("score", True)], "fingerprint").select("repo", "fingerprint", "place")


@register("chain_labels", sql("WITH b AS (" + of_findings.ORACLE_SQL["chain_build"].split(") SELECT chain", 1)[1].join(["SELECT chain", ""]) + "), l AS (SELECT chain, repo, row_number() OVER (PARTITION BY repo ORDER BY list_position(['info', 'low', 'medium', 'high', 'critical'], severity) DESC, chain_id) AS place FROM b) SELECT l.repo, m.fingerprint, string_agg('C-' || place, ',' ORDER BY place) AS labels FROM (SELECT DISTINCT chain, fingerprint FROM f WHERE chain IS NOT NULL) m JOIN l ON m.chain = l.chain GROUP BY ALL", f=FINDINGS))
def chain_labels(spark, sf_dir):
    members = read(spark, sf_dir, FINDINGS).filter("chain is not null").select("chain", "fingerprint")
    return surface.chain_labels(of_findings.chain_build(spark, sf_dir), members)


@register("resume_anti", sql(f"WITH {of_surface._SHARDS} SELECT repo, shard_id FROM s WHERE (repo, shard_id) NOT IN (SELECT (repo, shard_id) FROM s WHERE n_files % 2 = 0)", files=FILES))
def resume_anti(spark, sf_dir):
    """Shards that aren't in the table of those done, here those of an even number of files."""
    shards = of_surface.shard_plan(spark, sf_dir)
    return shards.select("repo", "shard_id").join(shards.filter("n_files % 2 = 0").select("repo", "shard_id"), ["repo", "shard_id"], "left_anti")


@register("dataflow_reach_files", sql(f"WITH s AS (SELECT repo, file_path, concat('lib/g', start_line, '.c') AS node FROM f WHERE source IN ('deep-scan', 'variant-hunt', 'sast') AND (status IS NULL OR {_ACTIVE} OR status = 'candidate')) SELECT DISTINCT repo, path FROM (SELECT repo, file_path AS path FROM s UNION ALL SELECT repo, node FROM s)", f=FINDINGS))
def dataflow_reach_files(spark, sf_dir):
    """Files of the evidence and of the graph nodes of live findings of the flow producers."""
    f = read(spark, sf_dir, FINDINGS).filter(F.col("source").isin("deep-scan", "variant-hunt", "sast") & (F.col("status").isNull() | F.col("status").isin(*findings.ACTIONABLE, "candidate")))
    nodes = F.array(F.col("file_path"), F.concat(F.lit("lib/g"), F.col("start_line").cast("string"), F.lit(".c")))
    return f.select("repo", F.explode(nodes).alias("path")).distinct()


@register("union_candidates", sql("SELECT repo, 'threat' AS origin, id FROM t UNION ALL SELECT repo, 'lead', id FROM l UNION ALL SELECT repo, 'route-code', path || '#' || line FROM d WHERE text <> 'nothing' AND contains(text, '/') UNION ALL SELECT 'r' || (id % 3), 'route-spec', '/a/' || id FROM p UNION ALL SELECT repo, 'finding', fingerprint FROM f UNION ALL SELECT repo, 'anchor', file_path || '#' || line FROM a GROUP BY repo, file_path, line", t=THREATS, l=LEADS, d=DECLARED, p=APIS, f=FINDINGS, a=ANCHORS))
def union_candidates(spark, sf_dir):
    """Candidates of a review: threats and leads, routes of the code and of specifications, findings and anchors."""
    site = lambda path, line: F.concat(F.col(path), F.lit("#"), F.col(line).cast("string"))
    spec = documents.openapi_routes(read(spark, sf_dir, APIS), "id").filter(F.col("path").startswith("/a/")).select(F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("repo"), F.col("path").alias("id"))
    parts = {
        "threat": (read(spark, sf_dir, THREATS), None), "lead": (read(spark, sf_dir, LEADS), None), "route-code": (read(spark, sf_dir, DECLARED).filter("text <> 'nothing' and contains(text, '/')").withColumn("id", site("path", "line")), None),
        "route-spec": (spec, None), "finding": (read(spark, sf_dir, FINDINGS).withColumn("id", F.col("fingerprint")), None), "anchor": (read(spark, sf_dir, ANCHORS).select("repo", site("file_path", "line").alias("id")).distinct(), None),
    }
    return worklists.candidates(parts)


@register("stamp_provenance", sql("SELECT repo, left(sha256('siltstone 1'), 16) AS toolchain, left(sha256(concat_ws('|', repo, count(*), CAST(sum(bytes) AS BIGINT))), 16) AS files, left(sha256(string_agg(DISTINCT split_part(path, '.', -1), ',' ORDER BY split_part(path, '.', -1))), 16) AS scope, left(sha256('default'), 16) AS policy FROM f GROUP BY repo", f=FILES))
def stamp_provenance(spark, sf_dir):
    """Digests of the tools, of a repository's files, of the kinds of files in scope, and of the policy."""
    digest = lambda x: F.left(F.sha2(x, 256), F.lit(16))
    files = read(spark, sf_dir, FILES).withColumn("kind", F.substring_index("path", ".", -1))
    kinds = files.select("repo", "kind").distinct().groupBy("repo").agg(F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds"))
    agg = files.groupBy("repo").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).join(kinds, "repo")
    return agg.select("repo", digest(F.lit("siltstone 1")).alias("toolchain"), digest(F.concat_ws("|", "repo", F.col("n").cast("string"), F.col("b").cast("string"))).alias("files"), digest(F.col("kinds")).alias("scope"), digest(F.lit("default")).alias("policy"))


@register("change_set", sql("SELECT repo, path, CASE doc_id % 5 WHEN 1 THEN 'A' ELSE 'M' END AS status, substr(content, 1, 8000) AS diff FROM f WHERE doc_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path) <= 40", f=FILES))
def change_set(spark, sf_dir):
    """Each repository's first 40 changed files that aren't deleted, with the beginning of their change."""
    state = F.when(F.col("doc_id") % 5 == 0, "D").when(F.col("doc_id") % 5 == 1, "A").otherwise("M")
    changed = read(spark, sf_dir, FILES).withColumn("status", state).filter("status <> 'D'")
    few = changed.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy("path"))).filter("n <= 40")
    return few.select("repo", "path", "status", F.substring("content", 1, 8000).alias("diff"))


@register("read_ground_truth", sql("SELECT case_id, id, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 2 = 0 THEN 'vuln' ELSE kind END AS kind, cwe, file_path, CAST(line AS BIGINT) AS line FROM t", t=TRUTH))
def read_ground_truth(spark, sf_dir):
    """Manifests of two shapes: expectations that are all vulnerable, and those that name their kind."""
    t = read(spark, sf_dir, TRUTH).withColumn("n", F.substring("id", 2, 12).cast("long"))
    row = F.struct("id", "kind", "cwe", F.col("file_path").alias("file"), "line")
    docs = t.select("case_id", F.when(F.col("n") % 2 == 0, F.to_json(F.struct(F.array(row).alias("expected")))).otherwise(F.to_json(F.struct(F.array(row).alias("expectations")))).alias("json"))
    return documents.ground_truth(docs, "case_id")
