"""Queries over files, symbols, shards, traffic and call edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import code, paths, surface, sweep, traffic
from siltstone.plans.derived import ANCHORS, CRASHES, FILES, FINDINGS, REQUESTS, SYMBOLS, read, sql
from siltstone.sources.files import numbered_lines


def inventory(spark, sf_dir):
    return surface.inventory(read(spark, sf_dir, FILES))


def shard_plan(spark, sf_dir):
    return surface.shards(read(spark, sf_dir, FILES))


def _shard_jobs(spark, sf_dir):
    """One or two producers for some shards, and two for each whole repository."""
    some = shard_plan(spark, sf_dir).filter(F.length("first_path") % 2 == 0)
    own = F.explode(F.array_compact(F.array(F.lit("sast"), F.when(F.col("n_files") % 2 == 0, F.lit("authz")))))
    return some.select("repo", "shard_id", F.lit("shard").alias("scope"), own.alias("producer")).union(some.select("repo", F.lit(None).cast("string"), F.lit("repo"), F.explode(F.array(F.lit("iac"), F.lit("binary-recon")))))


def coverage_map(spark, sf_dir):
    return surface.coverage(shard_plan(spark, sf_dir), _shard_jobs(spark, sf_dir))


def coverage_shards(spark, sf_dir):
    return surface.shard_coverage(read(spark, sf_dir, FILES), _shard_jobs(spark, sf_dir))


def uncovered_shards(spark, sf_dir):
    return surface.uncovered(shard_plan(spark, sf_dir), _shard_jobs(spark, sf_dir)).select("repo", "shard_id")


def partition_entry_points(spark, sf_dir):
    f = read(spark, sf_dir, FILES).withColumn("kind", F.concat(F.lit("k"), (F.col("bytes") % 3).cast("string")))
    return surface.partitions(f)


def path_names(spark, sf_dir):
    p = F.col("path")
    return read(spark, sf_dir, FILES).select(
        "doc_id", text.norm_path(p).alias("norm_path"), text.language_of(p).alias("language_of"), text.component_of(p).alias("component_of"), text.subsystem_key(p).alias("subsystem_key"), text.slug(p).alias("slug"), text.one_line(F.col("content"), 80).alias("one_line")
    )


def endpoint_dedupe(spark, sf_dir):
    return surface.endpoints(read(spark, sf_dir, REQUESTS))


def url_parts(spark, sf_dir):
    return read(spark, sf_dir, REQUESTS).select("url", text.url_path(F.col("url")).alias("path"), F.array_join(text.query_names(F.col("url")), ",").alias("names"))


#: Some endpoints as declared routes: with parameters of several spellings, as they are, or under another method.
_TEMPLATES = "CASE n % 4 WHEN 0 THEN regexp_replace(path, '/u[0-9]+', '/:user') WHEN 1 THEN regexp_replace(path, '/u[0-9]+', '/{id}') WHEN 2 THEN path ELSE regexp_replace(path, '/u[0-9]+/x', '/<int:u>/:rest') END"


def traffic_correlate(spark, sf_dir):
    seen = surface.endpoints(read(spark, sf_dir, REQUESTS))
    routes = seen.filter("n > 1").select("repo", F.when(F.col("has_cookies"), F.lit("DELETE")).otherwise(F.col("method")).alias("method"), F.expr(_TEMPLATES).alias("path"))
    return traffic.correlate(seen, routes)


def blast_radius(spark, sf_dir):
    return code.blast_radius(read(spark, sf_dir, ANCHORS), read(spark, sf_dir, SYMBOLS))


def caller_weight(spark, sf_dir):
    return code.caller_weight(read(spark, sf_dir, SYMBOLS))


def diff_blast_radius(spark, sf_dir):
    return code.top_symbols(read(spark, sf_dir, SYMBOLS))


def _calls(spark, sf_dir):
    return read(spark, sf_dir, ANCHORS).select("repo", F.concat(F.lit("fn"), (F.col("line") * 3 % 97).cast("string")).alias("name"), "file_path").withColumn("n", F.lit(1))


def code_graph(spark, sf_dir):
    return code.code_graph(read(spark, sf_dir, SYMBOLS), _calls(spark, sf_dir))


def resolve_callees(spark, sf_dir):
    return code.definitions(read(spark, sf_dir, SYMBOLS), _calls(spark, sf_dir).select("repo", "name").distinct()).select("repo", "name", "file_path", "line", "n")


def called_elsewhere(spark, sf_dir):
    return code.called_elsewhere(read(spark, sf_dir, SYMBOLS), _calls(spark, sf_dir)).select("repo", "name", "file_path", "line")


def k_hop_reach(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    edges = li.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("p"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 5000).cast("string")).alias("dst")).distinct()
    starts = read(spark, sf_dir, FINDINGS).filter("entry_reachable and exposure = 'unauth' and severity = 'critical'").select(F.substring_index(F.substring_index("file_path", "/", -1), ".", 1).alias("node"))
    return code.k_hop(edges, starts, 4)


def k_hop_paths(spark, sf_dir):
    """The pairs of a source and a sink that are joined within four hops, and where the two searches meet."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    edges = li.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("p"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 5000).cast("string")).alias("dst"))
    part = F.substring_index(F.substring_index("file_path", "/", -1), ".", 1).alias("node")
    f = read(spark, sf_dir, FINDINGS).filter("entry_reachable and severity = 'critical'")
    return paths.witness_meetings(edges, f.filter("exposure = 'unauth'").select(part), f.filter("exposure in ('local', 'internal', 'adjacent')").select(part), 4)


def excerpt_radius(spark, sf_dir):
    f = read(spark, sf_dir, FILES)
    anchors = f.select("repo", "path", (F.col("bytes") % 30 + 1).alias("at"))
    return code.excerpts(anchors, numbered_lines(f))


def per_file_cap(spark, sf_dir):
    lines = numbered_lines(read(spark, sf_dir, FILES)).filter("text like '%the%'").select("repo", "path", "line")
    return code.per_file_cap(lines, 3)


def even_sample(spark, sf_dir):
    lines = numbered_lines(read(spark, sf_dir, FILES)).filter("trim(text) <> ''").select("repo", "path", "line")
    return code.even_sample(lines, ["repo", "path"], [F.col("line")], 4)


def interleave_anchors(spark, sf_dir):
    rows = read(spark, sf_dir, FINDINGS).select("repo", "fingerprint", F.when(F.col("start_line") % 3 == 0, "source").when(F.col("start_line") % 3 == 1, "sink").otherwise("other").alias("kind"), "caller_count")
    return code.interleave(rows, ("source", "sink"), [("caller_count", True)], "fingerprint").select("repo", "fingerprint", "kind", "slot")


def risk_rank_files(spark, sf_dir):
    s = read(spark, sf_dir, SYMBOLS)
    files = s.select("repo", F.col("file_path").alias("path")).distinct()
    a = read(spark, sf_dir, ANCHORS).groupBy("repo", F.col("file_path").alias("path")).agg(F.count_if(F.col("line") > 45).alias("entry_defs"), F.bool_or(F.col("line") == 1).alias("entry"), F.bool_or(F.col("line") == 2).alias("route"), F.bool_or(F.col("line") == 3).alias("boundary"), F.bool_or(F.col("line") == 4).alias("churn"), F.bool_or(F.col("line") == 5).alias("dispatch"), F.bool_or(F.col("line") == 6).alias("dataflow"))
    weight = code.caller_weight(s).select("repo", F.col("file_path").alias("path"), F.col("weight").alias("calls"))
    return surface.file_risk(files, weight.join(a, ["repo", "path"], "full"), 50)


def _reachable(spark, sf_dir):
    return read(spark, sf_dir, FINDINGS).select("repo", F.col("file_path").alias("path"), F.col("caller_count").alias("score"), F.coalesce("entry_reachable", F.lit(False)).alias("reachable"), F.col("exposure").alias("reason"))


def attack_subsystems(spark, sf_dir):
    return surface.subsystems(_reachable(spark, sf_dir))


def attack_subsystems_native(spark, sf_dir):
    """The native sources of the same subsystems."""
    return surface.subsystems(_reachable(spark, sf_dir), native=True)


def rank_obligations(spark, sf_dir):
    f = read(spark, sf_dir, FINDINGS)
    kinds = F.array(*[F.lit(k) for k in [*surface.CLASS_WEIGHTS, "unnamed"]])
    rows = f.select("repo", F.col("file_path").alias("path"), F.col("start_line").alias("line"), F.get(kinds, (F.col("batch") % 17).cast("int")).alias("kind")).distinct()
    scores = f.groupBy("repo", F.col("file_path").alias("path")).agg(F.max("caller_count").alias("score"))
    return surface.obligations_ranked(rows, scores)


#: Producers of one's own: one that runs code, one of a language that no shard has.
OWN = (("own-runner", "repo", (), (), False, True, False, True), ("own-cobol", "shard", ("COBOL",), (), False, False, False, True), ("own-index", "shard", (), ("semgrep", "symbols"), False, False, False, True))
#: What each repository has.
_THERE = "SELECT repo, CASE doc_id % 91 WHEN 0 THEN 'binaries' WHEN 1 THEN 'semgrep' WHEN 2 THEN 'threat-model' ELSE 'symbols' END AS thing FROM files WHERE doc_id % 91 < 4"


def _sweep(spark, sf_dir, **how):
    f = read(spark, sf_dir, FILES).withColumn("language", text.language_of(F.col("path"))).withColumn("shard_id", text.slug(text.component_of(F.col("path"))))
    shards = f.groupBy("repo", "shard_id").agg(F.collect_set("language").alias("languages"), F.count("*").alias("n_files"))
    return sweep.jobs(sweep.registry(spark, OWN), shards, spark.sql(_THERE.replace("FROM files", "FROM {files}"), files=f), **how)


def producer_shard_jobs(spark, sf_dir):
    return _sweep(spark, sf_dir, offline=True, deep=True)


def register_producer(spark, sf_dir):
    """The jobs of one's own producers, and why others have none."""
    return _sweep(spark, sf_dir, requested=[p[0] for p in OWN]).groupBy("producer", "scope", "reason").agg(F.count("job_id").alias("jobs"), F.countDistinct("repo").alias("repos"))


def diff_risk(spark, sf_dir):
    r = read(spark, sf_dir, FILES).select("doc_id", surface.diff_risk(F.col("path"), F.col("content")).alias("d"))
    return r.select("doc_id", F.col("d.score").alias("score"), F.col("d.tags").alias("tags"))


def latest_run(spark, sf_dir):
    return read(spark, sf_dir, CRASHES).groupBy("source").agg(F.max_by(F.col("fingerprint"), F.struct("seen_at", "fingerprint")).alias("fingerprint"), F.max("seen_at").alias("seen_at"))


def recent_churn(spark, sf_dir):
    """Parts that the newest 60 order dates touch, the 80 most recent."""
    from pyspark.sql import Window

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    days = li.select("l_shipdate").distinct().orderBy(F.desc("l_shipdate")).limit(60).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("l_shipdate"))))
    return li.join(F.broadcast(days), "l_shipdate").groupBy("l_partkey").agg(F.min("pos").alias("pos")).orderBy("pos", "l_partkey").limit(80).select(F.col("l_partkey").alias("file"), "pos")


_NORM = "regexp_replace(path, '^(\\./)+', '')"
_LANG = "CASE " + " ".join(f"WHEN regexp_matches({{p}}, '{p}') THEN '{name}'" for p, name in text.LANGUAGES) + " ELSE 'Other' END"
_SHARDS = f"""p AS (SELECT DISTINCT repo, {_NORM} AS path FROM files), d AS (SELECT *, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '(root)' END AS dir FROM p),
k AS (SELECT *, CAST(ceil(row_number() OVER (PARTITION BY repo, dir ORDER BY path) / 60.0) AS BIGINT) AS k, count(*) OVER (PARTITION BY repo, dir) AS n FROM d),
s AS (SELECT repo, CASE WHEN dir = '(root)' THEN 'root' ELSE dir END || CASE WHEN n > 60 THEN '__' || k ELSE '' END AS shard_id, dir, count(*) AS n_files, min(path) AS first_path, list_slice(list_sort(list(path)), 1, 5) AS few FROM k GROUP BY ALL),
sl AS (SELECT repo, CASE WHEN dir = '(root)' THEN 'root' ELSE dir END || CASE WHEN n > 60 THEN '__' || k ELSE '' END AS shard_id, {_LANG.format(p="path")} AS language, count(*) AS c FROM k GROUP BY ALL), sb AS (SELECT repo, shard_id, string_agg(language || ':' || c, ',' ORDER BY language) AS by_language FROM sl GROUP BY ALL)"""
_COMPONENT = f"coalesce(list_filter(string_split({_NORM}, '/')[1:-2], lambda x: x <> '' AND lower(x) NOT IN {text.PLAIN_ROOTS})[1], '(root)')"
_URL = "regexp_replace(url, '^https://[^/?#]*', '')"
_NAMES = "list_sort(list_distinct(list_filter(list_transform(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: split_part(x, '=', 1)), lambda x: x <> '')))"
_ENDPOINTS = f"""r AS (SELECT repo, upper(method) AS method, regexp_extract({_URL}, '^[^?#]*', 0) AS path, {_NAMES} AS q, has_cookies FROM requests),
n AS (SELECT repo, method, path, count(*) AS n, bool_or(has_cookies) AS has_cookies FROM r GROUP BY ALL), u AS (SELECT repo, method, path, string_agg(DISTINCT x, ',' ORDER BY x) AS params FROM (SELECT repo, method, path, unnest(q) AS x FROM r) GROUP BY ALL),
e AS (SELECT n.*, coalesce(params, '') AS params FROM n LEFT JOIN u USING (repo, method, path))"""
_CALLS = "calls AS (SELECT repo, concat('fn', line * 3 % 97) AS name, file_path FROM anchors)"
_LINES = "lines AS (SELECT repo, path, unnest(regexp_split_to_array(content, '\\r?\\n')) AS text, unnest(range(1, len(regexp_split_to_array(content, '\\r?\\n')) + 1)) AS line FROM files)"
_WEIGHT = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in surface.CLASS_WEIGHTS.items()) + " ELSE 5 END"
_KINDS = "[" + ", ".join(f"'{k}'" for k in [*surface.CLASS_WEIGHTS, "unnamed"]) + "]"
_DIFF = [
    ("(auth|login|session|token|passwd|password|jwt|oauth|saml)", 5, "auth"),
    ("(crypto|cipher|encrypt|decrypt|hash|hmac|signature|tls|ssl)", 5, "crypto"),
    ("(payment|billing|charge|refund|wallet|transfer|balance|ledger)", 5, "value-transfer"),
    ("(exec|spawn|shell|subprocess|eval|deserialize|pickle|unmarshal|yaml\\.load)", 4, "exec/deser"),
    ("(sql|query|db|database|orm)", 3, "data-access"),
    ("(upload|file|path|fs\\.|os\\.)", 2, "fs"),
    ("(cors|csrf|origin|header|cookie|middleware)", 3, "web-guard"),
]
_HAY = "concat_ws(chr(10), path, content)"

QUERIES = {
    f.__name__: f
    for f in (
        inventory, shard_plan, coverage_map, coverage_shards, uncovered_shards, partition_entry_points, path_names, endpoint_dedupe, url_parts, traffic_correlate, blast_radius, caller_weight, diff_blast_radius, code_graph, resolve_callees, called_elsewhere, k_hop_reach, k_hop_paths, excerpt_radius, per_file_cap, even_sample,
        interleave_anchors, risk_rank_files, attack_subsystems, attack_subsystems_native, rank_obligations, producer_shard_jobs, register_producer, diff_risk, latest_run, recent_churn,
    )
}



def _jobs(chosen: str, offline: bool) -> str:
    rows = {p[0]: p for p in (*sweep.PRODUCERS, *OWN)}
    listed = lambda xs: "CAST([" + ", ".join(f"'{x}'" for x in xs) + "] AS VARCHAR[])"
    values = ", ".join(f"({i}, '{n}', '{s}', {listed(a)}, {listed(r)}, {', '.join(map(str, flags))})" for i, (n, s, a, r, *flags) in enumerate(rows.values(), 1))
    off = "CASE WHEN network THEN 'offline: may use the network' WHEN executes THEN 'offline: runs code of the target' END" if offline else "NULL"
    return f"""w_p AS (SELECT * FROM (VALUES {values}) t(ord, producer, scope, langs, requires, network, executes, deep_only, by_default) WHERE {chosen}),
w_f AS (SELECT repo, regexp_replace(regexp_replace({_COMPONENT}, '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS shard_id, {_LANG.format(p="path")} AS language FROM files),
w_s AS (SELECT repo, shard_id, list(DISTINCT language) FILTER (language <> 'Other') AS languages, count(*) AS n_files FROM w_f GROUP BY ALL),
w_t AS (SELECT DISTINCT * FROM ({_THERE})),
w_r AS (SELECT repo FROM w_s UNION SELECT repo FROM w_t),
w_m AS (SELECT w_r.repo, w_p.*, list_sort(list_filter(requires, lambda x: NOT list_contains(coalesce(h.have, []), x)))[1] AS lacks FROM w_r CROSS JOIN w_p LEFT JOIN (SELECT repo, list(thing) AS have FROM w_t GROUP BY repo) h ON h.repo = w_r.repo),
w_j AS (SELECT *, coalesce({off}, 'requirement not met: ' || lacks) AS bad FROM w_m),
w_g AS (SELECT repo, ord, producer, scope, CAST(NULL AS VARCHAR) AS shard_id, CAST(NULL AS INTEGER) AS budget FROM w_j WHERE bad IS NULL AND scope = 'repo' UNION ALL
 SELECT j.repo, ord, producer, scope, s.shard_id, CAST(least(24, greatest(4, ceil(n_files / 3))) AS INTEGER) FROM w_j j JOIN w_s s ON s.repo = j.repo WHERE bad IS NULL AND scope = 'shard' AND (len(langs) = 0 OR list_has_any(langs, coalesce(languages, [])))),
sweep_rows AS (SELECT repo, producer, scope, shard_id, concat('j', row_number() OVER (PARTITION BY repo ORDER BY ord, shard_id NULLS FIRST)) AS job_id, budget, CAST(NULL AS VARCHAR) AS reason FROM w_g
 UNION ALL SELECT repo, producer, scope, NULL, NULL, NULL, bad FROM w_j WHERE bad IS NOT NULL
 UNION ALL SELECT repo, producer, scope, NULL, NULL, NULL, 'no shard of its languages' FROM w_j WHERE bad IS NULL AND scope = 'shard' AND (repo, producer) NOT IN (SELECT (repo, producer) FROM w_g))"""


#: a route's parameters, anywhere in it
_PARAMETER = traffic.PARAMETER[1:-1]

ORACLE_SQL = {
    "inventory": sql(f"SELECT repo, language, count(*) AS n_files, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT repo, {_NORM} AS path, {_LANG.format(p=_NORM)} AS language, bytes FROM files) WHERE NOT regexp_matches(path, '{surface.EXCLUDED}') AND language <> 'Other' GROUP BY repo, language", files=FILES),
    "shard_plan": sql(f"WITH {_SHARDS} SELECT s.* EXCLUDE (few), by_language FROM s JOIN sb USING (repo, shard_id)", files=FILES),
    "coverage_map": sql(
        f"WITH {_SHARDS}, c AS (SELECT repo, CAST(sum(n_files) AS BIGINT) AS files, CAST(coalesce(sum(n_files) FILTER (length(first_path) % 2 = 0), 0) AS BIGINT) AS covered FROM s GROUP BY repo) SELECT repo, files, covered, files - covered AS uncovered, round(covered * 100 / files, 1) AS pct, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.repo = c.repo AND length(first_path) % 2 = 0) THEN 'binary-recon,iac' ELSE '' END AS repo_producers FROM c", files=FILES
    ),
    "coverage_shards": sql(f"WITH {_SHARDS} SELECT repo, shard_id, n_files, length(first_path) % 2 = 0 AS covered, CASE WHEN length(first_path) % 2 > 0 THEN '' WHEN n_files % 2 = 0 THEN 'authz,sast' ELSE 'sast' END AS producers, CASE WHEN length(first_path) % 2 = 0 THEN '' ELSE array_to_string(few, ',') END AS sample_files FROM s", files=FILES),
    "uncovered_shards": sql(f"WITH {_SHARDS} SELECT repo, shard_id FROM s WHERE (repo, shard_id) NOT IN (SELECT (repo, shard_id) FROM s WHERE length(first_path) % 2 = 0)", files=FILES),
    "partition_entry_points": sql(
        f"""WITH r AS (SELECT repo, {_COMPONENT} AS component, 'k' || (bytes % 3) AS kind FROM files), z AS (SELECT repo, component, count(*) AS size FROM r GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY size DESC, component) AS place, count(*) OVER (PARTITION BY repo) AS n FROM z)
SELECT r.repo, CASE WHEN n > 6 AND place > 5 THEN 'other' ELSE r.component END AS label, count(*) AS size, count(DISTINCT kind) AS n_kinds FROM r JOIN q ON r.repo = q.repo AND r.component = q.component GROUP BY 1, 2""", files=FILES
    ),
    "path_names": sql(
        f"""SELECT doc_id, {_NORM} AS norm_path, {_LANG.format(p="path")} AS language_of, {_COMPONENT} AS component_of, CASE WHEN contains({_NORM}, '/') THEN split_part({_NORM}, '/', 1) ELSE '.' END || '/' || split_part(string_split(path, '/')[-1], '.', 1) AS subsystem_key,
 regexp_replace(regexp_replace(path, '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CASE WHEN length(o) > 80 THEN substr(o, 1, 79) || '…' ELSE o END AS one_line FROM (SELECT *, trim(regexp_replace(coalesce(content, ''), '\\s+', ' ', 'g')) AS o FROM files)""", files=FILES
    ),
    "endpoint_dedupe": sql(f"WITH {_ENDPOINTS} SELECT repo, method, path, n, params, has_cookies FROM e", requests=REQUESTS),
    "url_parts": sql(f"SELECT url, regexp_extract({_URL}, '^[^?#]*', 0) AS path, array_to_string({_NAMES}, ',') AS names FROM requests", requests=REQUESTS),
    "traffic_correlate": sql(
        f"""WITH {_ENDPOINTS}, t AS (SELECT DISTINCT repo, CASE WHEN has_cookies THEN 'DELETE' ELSE method END AS method, {_TEMPLATES} AS template FROM e WHERE n > 1),
tu AS (SELECT *, regexp_replace(template, '{_PARAMETER}', '[^/]+', 'g') AS pattern, list_transform(string_split(trim(template, '/'), '/'), lambda x: CASE WHEN regexp_full_match(x, '{_PARAMETER}') THEN 'b' ELSE 'a' END) AS mask FROM t),
tm AS (SELECT e.repo, e.method, e.path, template FROM e JOIN tu ON e.repo = tu.repo AND e.method = tu.method AND regexp_full_match(e.path, pattern) QUALIFY row_number() OVER (PARTITION BY e.repo, e.method, e.path ORDER BY len(list_filter(mask, lambda x: x = 'a')) DESC, array_to_string(mask, ''), template) = 1)
SELECT e.repo, e.method, e.path, n, template, CASE WHEN template IS NULL THEN 'shadow' ELSE 'mapped' END AS state FROM e LEFT JOIN tm m ON e.repo = m.repo AND e.method = m.method AND e.path = m.path
UNION ALL SELECT repo, method, template, 0, template, 'no-traffic' FROM t WHERE (repo, method, template) NOT IN (SELECT (repo, method, template) FROM tm)""", requests=REQUESTS
    ),
    "blast_radius": sql(
        """WITH m AS (SELECT repo, file_path, line, max(caller_count) AS c FROM symbols GROUP BY ALL), z AS (SELECT repo, file_path, max(caller_count) AS most FROM symbols GROUP BY ALL)
SELECT a.repo, a.fingerprint, coalesce(m.c, z.most, 0) AS blast FROM anchors a ASOF LEFT JOIN m ON a.repo = m.repo AND a.file_path = m.file_path AND a.line >= m.line LEFT JOIN z ON a.repo = z.repo AND a.file_path = z.file_path""", anchors=ANCHORS, symbols=SYMBOLS
    ),
    "caller_weight": sql("SELECT repo, file_path, CAST(sum(caller_count) AS BIGINT) AS weight FROM symbols GROUP BY ALL", symbols=SYMBOLS),
    "diff_blast_radius": sql("SELECT repo, file_path, string_agg(name, ',' ORDER BY n) AS symbols, max(caller_count) AS most_callers FROM (SELECT *, row_number() OVER (PARTITION BY repo, file_path ORDER BY caller_count DESC, name, line) AS n FROM symbols) WHERE n <= 12 GROUP BY repo, file_path", symbols=SYMBOLS),
    "code_graph": sql(
        f"""WITH {_CALLS}, d AS (SELECT repo, name, min((file_path, line)) AS f, count(*) AS def_count FROM symbols GROUP BY repo, name), c AS (SELECT repo, name, count(*) AS n FROM calls GROUP BY repo, name),
g AS (SELECT d.repo, d.name, f[1] AS file_path, f[2] AS line, def_count, greatest(0, coalesce(n, 0) - def_count) AS caller_count FROM d LEFT JOIN c USING (repo, name))
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY caller_count DESC, name) AS INTEGER) AS place FROM g) WHERE place <= 400""", symbols=SYMBOLS, anchors=ANCHORS
    ),
    "resolve_callees": sql(f"WITH {_CALLS}, n AS (SELECT DISTINCT repo, name FROM calls), d AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo, name ORDER BY file_path, line) AS INTEGER) AS n FROM symbols) SELECT d.repo, d.name, file_path, line, n FROM d SEMI JOIN n USING (repo, name) WHERE n <= 5", symbols=SYMBOLS, anchors=ANCHORS),
    "called_elsewhere": sql(f"WITH {_CALLS} SELECT repo, name, file_path, line FROM symbols s WHERE EXISTS (SELECT 1 FROM calls c WHERE c.repo = s.repo AND c.name = s.name AND c.file_path <> s.file_path)", symbols=SYMBOLS, anchors=ANCHORS),
    "k_hop_reach": sql("""RECURSIVE WITH e AS (SELECT DISTINCT concat('p', l_partkey) AS src, concat('p', (l_partkey * 7 + l_suppkey) % 5000) AS dst FROM lineitem),
r AS (SELECT DISTINCT split_part(string_split(file_path, '/')[-1], '.', 1) AS node, 0 AS hop FROM f WHERE entry_reachable AND exposure = 'unauth' AND severity = 'critical' UNION SELECT dst, hop + 1 FROM r JOIN e ON node = src WHERE hop < 4) SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY node""", f=FINDINGS),
    "k_hop_paths": sql("""RECURSIVE WITH e AS (SELECT DISTINCT concat('p', l_partkey) AS src, concat('p', (l_partkey * 7 + l_suppkey) % 5000) AS dst FROM lineitem),
g AS (SELECT split_part(string_split(file_path, '/')[-1], '.', 1) AS node, exposure, status FROM f WHERE entry_reachable AND severity = 'critical'),
a AS (SELECT DISTINCT node AS origin, node, 0 AS hop FROM g WHERE exposure = 'unauth' UNION SELECT origin, dst, hop + 1 FROM a JOIN e ON node = src WHERE hop < 2),
b AS (SELECT DISTINCT node AS origin, node, 0 AS hop FROM g WHERE exposure IN ('local', 'internal', 'adjacent') UNION SELECT origin, src, hop + 1 FROM b JOIN e ON node = dst WHERE hop < 2),
x AS (SELECT origin, node, min(hop) AS hop FROM a GROUP BY ALL), y AS (SELECT origin, node, min(hop) AS hop FROM b GROUP BY ALL)
SELECT x.origin AS source, y.origin AS sink, CAST(min(x.hop + y.hop) AS INTEGER) AS hops, arg_min(x.node, (x.hop + y.hop, x.node)) AS meeting FROM x JOIN y ON x.node = y.node WHERE x.hop - y.hop IN (0, 1) GROUP BY ALL""", f=FINDINGS),
    "excerpt_radius": sql(
        f"""WITH {_LINES}, a AS (SELECT repo, path, bytes % 30 + 1 AS at FROM files) SELECT a.repo, a.path, a.at, count(l.line) AS n_lines, CAST(min(l.line) AS BIGINT) AS first_line, CAST(coalesce(sum(length(l.text)), 0) AS BIGINT) AS n_chars
 FROM a LEFT JOIN lines l ON a.repo = l.repo AND a.path = l.path AND l.line BETWEEN a.at - 10 AND a.at + 10 GROUP BY a.repo, a.path, a.at""", files=FILES
    ),
    "per_file_cap": sql(f"WITH {_LINES} SELECT repo, path, CAST(line AS INTEGER) AS line FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY line) AS n FROM lines WHERE contains(text, 'the')) WHERE n <= 3", files=FILES),
    "even_sample": sql(
        f"""WITH {_LINES}, i AS (SELECT repo, path, line, row_number() OVER (PARTITION BY repo, path ORDER BY line) - 1 AS i, count(*) OVER (PARTITION BY repo, path) AS n FROM lines WHERE trim(text) <> '')
SELECT repo, path, CAST(line AS INTEGER) AS line FROM i WHERE n <= 4 OR i IN (0, n // 4, 2 * n // 4, 3 * n // 4)""", files=FILES
    ),
    "interleave_anchors": sql(
        """WITH k AS (SELECT repo, fingerprint, caller_count, CASE start_line % 3 WHEN 0 THEN 'source' WHEN 1 THEN 'sink' END AS kind FROM f), o AS (SELECT *, row_number() OVER (PARTITION BY repo, kind ORDER BY caller_count DESC, fingerprint) AS o FROM k WHERE kind IS NOT NULL)
SELECT repo, fingerprint, kind, CAST(row_number() OVER (PARTITION BY repo ORDER BY o, CASE kind WHEN 'source' THEN 0 ELSE 1 END) AS INTEGER) AS slot FROM o""", f=FINDINGS
    ),
    "risk_rank_files": sql(
        f"""WITH p AS (SELECT DISTINCT repo, file_path FROM symbols), w AS (SELECT repo, file_path, sum(caller_count) AS calls FROM symbols GROUP BY ALL),
a AS (SELECT repo, file_path, count(*) FILTER (line > 45) AS d, bool_or(line = 1) AS e, bool_or(line = 2) AS r, bool_or(line = 3) AS b, bool_or(line = 4) AS c, bool_or(line = 5) AS q, bool_or(line = 6) AS y FROM anchors GROUP BY ALL),
s AS (SELECT p.repo, p.file_path AS path, CASE WHEN d > 0 THEN least(7, d + 3) ELSE 0 END AS x1, least(8, CAST(round(log2(coalesce(calls, 0) + 1) * 1.6) AS INTEGER)) AS x2, CASE WHEN e THEN 4 ELSE 0 END AS x3, CASE WHEN r THEN 4 ELSE 0 END AS x4, CASE WHEN b THEN 3 ELSE 0 END AS x5, CASE WHEN c THEN 2 ELSE 0 END AS x6, CASE WHEN q THEN 6 ELSE 0 END AS x7, CASE WHEN y THEN 5 ELSE 0 END AS x8
 FROM p LEFT JOIN w ON p.repo = w.repo AND p.file_path = w.file_path LEFT JOIN a ON p.repo = a.repo AND p.file_path = a.file_path),
t AS (SELECT repo, path, CAST(x1 + x2 + x3 + x4 + x5 + x6 + x7 + x8 AS INTEGER) AS score, concat_ws(',', CASE WHEN x1 > 0 THEN 'entry-defs' END, CASE WHEN x2 > 0 THEN 'reach' END, CASE WHEN x3 > 0 THEN 'entry-point' END, CASE WHEN x4 > 0 THEN 'route' END, CASE WHEN x7 > 0 THEN 'dispatch-entry' END, CASE WHEN x5 > 0 THEN 'trust-boundary' END, CASE WHEN x8 > 0 THEN 'dataflow-reach' END, CASE WHEN x6 > 0 THEN 'churn' END) AS reasons FROM s)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY score DESC, path) AS INTEGER) AS place FROM t) WHERE place <= 50""", symbols=SYMBOLS, anchors=ANCHORS
    ),
    "attack_subsystems": sql(
        """WITH k AS (SELECT *, split_part(file_path, '/', 1) || '/' || split_part(split_part(file_path, '/', 3), '.', 1) AS subsystem FROM f WHERE entry_reachable),
g AS (SELECT repo, subsystem, CAST(sum(caller_count) AS BIGINT) AS score, coalesce(string_agg(DISTINCT exposure, ',' ORDER BY exposure), '') AS reasons, count(DISTINCT file_path) AS n_files FROM k GROUP BY ALL),
p AS (SELECT repo, subsystem, string_agg(file_path, ',' ORDER BY file_path) AS paths FROM (SELECT DISTINCT repo, subsystem, file_path FROM k QUALIFY dense_rank() OVER (PARTITION BY repo, subsystem ORDER BY file_path) <= 60) GROUP BY ALL),
o AS (SELECT g.*, paths, CAST(row_number() OVER (PARTITION BY g.repo ORDER BY score DESC, g.subsystem) AS INTEGER) AS place, greatest(0, count(*) OVER (PARTITION BY g.repo) - 15) AS tail FROM g JOIN p ON g.repo = p.repo AND g.subsystem = p.subsystem)
SELECT repo, subsystem, score, reasons, n_files, paths, place, tail FROM o WHERE place <= 15""", f=FINDINGS
    ),
    "attack_subsystems_native": sql(
        """WITH k AS (SELECT *, split_part(file_path, '/', 1) || '/' || split_part(split_part(file_path, '/', 3), '.', 1) AS subsystem FROM f WHERE entry_reachable),
g AS (SELECT repo, subsystem, CAST(sum(caller_count) AS BIGINT) AS score, coalesce(string_agg(DISTINCT exposure, ',' ORDER BY exposure), '') AS reasons, 0 AS unused FROM k GROUP BY ALL),
p AS (SELECT repo, subsystem, string_agg(file_path, ',' ORDER BY file_path) AS paths, count(*) AS n_files FROM (SELECT DISTINCT repo, subsystem, file_path FROM k QUALIFY dense_rank() OVER (PARTITION BY repo, subsystem ORDER BY file_path) <= 60) WHERE regexp_matches(file_path, '\\.(c|rs)$') GROUP BY ALL),
z AS (SELECT g.*, CAST(row_number() OVER (PARTITION BY g.repo ORDER BY score DESC, g.subsystem) AS INTEGER) AS place, greatest(0, count(*) OVER (PARTITION BY g.repo) - 15) AS tail FROM g), o AS (SELECT z.*, paths, n_files FROM z JOIN p ON z.repo = p.repo AND z.subsystem = p.subsystem)
SELECT repo, subsystem, score, reasons, n_files, paths, place, tail FROM o WHERE place <= 15""", f=FINDINGS
    ),
    "rank_obligations": sql(
        f"""WITH o AS (SELECT DISTINCT repo, file_path AS path, start_line AS line, {_KINDS}[batch % 17 + 1] AS kind FROM f), s AS (SELECT repo, file_path AS path, max(caller_count) AS score FROM f GROUP BY ALL),
p AS (SELECT repo, path, line, kind, CAST({_WEIGHT} + least(4, CAST(round(log2(score + 1)) AS INTEGER)) AS INTEGER) AS priority FROM o JOIN s USING (repo, path))
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY priority DESC, path, line, kind) AS INTEGER) AS place FROM p) WHERE place <= 120""", f=FINDINGS
    ),
    "producer_shard_jobs": sql(f"WITH {_jobs('NOT deep_only AND by_default OR deep_only', True)} SELECT * FROM sweep_rows", files=FILES),
    "register_producer": sql(f"WITH {_jobs('producer IN (' + ', '.join(repr(p[0]) for p in OWN) + ')', False)} SELECT producer, scope, reason, count(job_id) AS jobs, count(DISTINCT repo) AS repos FROM sweep_rows GROUP BY ALL", files=FILES),
    "diff_risk": sql("SELECT doc_id, " + " + ".join(f"CASE WHEN regexp_matches({_HAY}, '(?i){p}') THEN {w} ELSE 0 END" for p, w, _ in _DIFF) + " AS score, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches({_HAY}, '(?i){p}') THEN '{t}' END" for p, _, t in _DIFF) + ") AS tags FROM files", files=FILES),
    "latest_run": sql("SELECT source, arg_max(fingerprint, (seen_at, fingerprint)) AS fingerprint, max(seen_at) AS seen_at FROM c GROUP BY source", c=CRASHES),
    "recent_churn": """WITH d AS (SELECT l_shipdate, row_number() OVER (ORDER BY l_shipdate DESC) AS pos FROM (SELECT DISTINCT l_shipdate FROM lineitem ORDER BY l_shipdate DESC LIMIT 60))
SELECT l_partkey AS file, CAST(min(pos) AS INTEGER) AS pos FROM lineitem JOIN d USING (l_shipdate) GROUP BY l_partkey ORDER BY pos, file LIMIT 80""",
}
