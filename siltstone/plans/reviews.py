"""Queries of threat models, intelligence, the catalog and the gates of review drafts."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.text import cwe_number
from siltstone.operators import benchmarks, catalog, gates, scan, surface, threats
from siltstone.plans.derived import ANCHORS, CRASHES, FINDINGS, SYMBOLS, TRUTH, read, sql
from siltstone.plans.lines import code_lines, code_sql
from siltstone.plans.packs import ORACLE_SQL as PACKS_SQL
from siltstone.plans.register import registry
from siltstone.plans.scans import ORACLE_SQL as SCANS_SQL
from siltstone.plans.structure import enclosing_sql, spans_sql
from siltstone.plans.threats import DRAFTS, INVARIANTS, LEADS, THREATS

QUERIES, ORACLE_SQL, register = registry()
_NUMBER = "TRY_CAST(nullif(regexp_extract(cwe, '\\d+', 0), '') AS BIGINT)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


# normalising

@register("alias_coalesce", sql("SELECT id, coalesce(nullif(trim(own_id, ' '), ''), nullif(trim(cve, ' '), ''), nullif(trim(title, ' '), '')) AS name, array_to_string(list_filter([trim(cve, ' '), trim(own_id, ' ')], lambda x: x <> ''), ',') AS listed FROM l", l=LEADS))
def alias_coalesce(spark, sf_dir):
    return read(spark, sf_dir, LEADS).select("id", threats.first_of("own_id", "cve", "title").alias("name"), F.array_join(threats.as_list(F.col("title"), F.array("cve", "own_id")), ",").alias("listed"))


_IMPACT = "coalesce(nullif(regexp_extract(lower(impact), '\\b(critical|high|medium|low)\\b', 1), ''), 'medium')"
_STRIDE_SET = ("spoofing", "tampering", "repudiation", "information-disclosure", "denial-of-service", "elevation-of-privilege")
_STRIDE = f"CASE WHEN regexp_replace(trim(lower(stride), ' '), '[\\s_]+', '-', 'g') IN {_list(_STRIDE_SET)} THEN regexp_replace(trim(lower(stride), ' '), '[\\s_]+', '-', 'g') END"


@register("dfd_type", sql("SELECT id, CASE WHEN lower(k) IN ('automated', 'downstream-service', 'internal-service') THEN 'process' ELSE 'external-entity' END AS actor, CASE WHEN contains(lower(k), 'database') OR contains(lower(k), 'store') THEN 'data-store' WHEN contains(lower(k), 'flow') THEN 'data-flow' ELSE 'process' END AS component, CASE WHEN lower(replace(k, '_', '-')) IN ('external-entity', 'externalentity', 'external') THEN 'external-entity' WHEN lower(replace(k, '_', '-')) IN ('data-store', 'datastore') THEN 'data-store' WHEN lower(replace(k, '_', '-')) IN ('data-flow', 'dataflow') THEN 'data-flow' ELSE 'process' END AS element FROM (SELECT id, CASE CAST(substr(id, 2) AS BIGINT) % 7 WHEN 0 THEN 'Automated' WHEN 1 THEN 'User Database' WHEN 2 THEN 'data_store' WHEN 3 THEN 'Data-Flow' WHEN 4 THEN 'external' WHEN 5 THEN 'internal-service' ELSE title END AS k FROM t)", t=THREATS))
def dfd_type(spark, sf_dir):
    n = F.substring("id", 2, 12).cast("long") % 7
    k = F.when(n == 0, "Automated").when(n == 1, "User Database").when(n == 2, "data_store").when(n == 3, "Data-Flow").when(n == 4, "external").when(n == 5, "internal-service").otherwise(F.col("title"))
    return read(spark, sf_dir, THREATS).select("id", threats.actor_type(k).alias("actor"), threats.component_type(k).alias("component"), threats.element_type(k).alias("element"))


_INVARIANT = "CASE WHEN replace(lower(trim(coalesce(verdict, ''), ' ')), 'needs_review', 'needs-review') IN ('hold', 'violated') THEN replace(lower(trim(verdict, ' ')), 'needs_review', 'needs-review') ELSE 'needs-review' END"


@register("norm_invariant_verdict", sql(f"SELECT id, {_INVARIANT} AS verdict FROM i", i=INVARIANTS))
def norm_invariant_verdict(spark, sf_dir):
    return read(spark, sf_dir, INVARIANTS).select("id", threats.invariant_verdict(F.col("verdict")).alias("verdict"))


@register("invariant_summary", sql(f"SELECT repo, count(*) AS total, count(*) FILTER (v = 'violated') AS violated, count(*) FILTER (v = 'needs-review') AS needs_review, count(*) FILTER (v = 'hold') AS hold FROM (SELECT repo, {_INVARIANT} AS v FROM i) GROUP BY repo", i=INVARIANTS))
def invariant_summary(spark, sf_dir):
    return threats.invariant_summary(read(spark, sf_dir, INVARIANTS))


_LEADS = "SELECT repo, coalesce(nullif(trim(own_id, ' '), ''), nullif(trim(cve, ' '), ''), title) AS lead, lower(trim(severity, ' ')) AS severity, trim(cwe, ' ') AS cwe, origin FROM l WHERE lower(trim(severity, ' ')) IN ('critical', 'high')"


@register("norm_intel_lead", sql(_LEADS, l=LEADS))
def norm_intel_lead(spark, sf_dir):
    return threats.leads(read(spark, sf_dir, LEADS))


@register("intel_summary", sql(f"SELECT repo, cwe, count(*) FILTER (origin = 'stack') AS stack, count(*) FILTER (origin = 'similar-app') AS similar FROM ({_LEADS}) WHERE cwe <> '' GROUP BY ALL", l=LEADS))
def intel_summary(spark, sf_dir):
    return threats.lead_summary(threats.leads(read(spark, sf_dir, LEADS)))


@register("threat_summary", sql(f"SELECT repo, {_IMPACT} AS impact, {_STRIDE} AS stride, CASE WHEN probability >= 0.7 THEN 'high' WHEN probability >= 0.4 THEN 'medium' ELSE 'low' END AS likelihood, count(*) AS n FROM t WHERE {_STRIDE} IS NOT NULL GROUP BY ALL", t=THREATS))
def threat_summary(spark, sf_dir):
    return threats.threat_summary(read(spark, sf_dir, THREATS))


# the catalog

_REMEDIES = "CASE " + _NUMBER + " " + " ".join(f"WHEN {k} THEN {_q(v)}" for k, v in catalog.REMEDIES.items()) + f" ELSE {_q(catalog.GENERAL_REMEDY)} END"


@register("remediation_floor", sql(f"SELECT fingerprint, coalesce(nullif(trim(fix_verdict, ' '), ''), {_REMEDIES}) AS remedy FROM f", f=FINDINGS))
def remediation_floor(spark, sf_dir):
    return read(spark, sf_dir, FINDINGS).select("fingerprint", catalog.remedy(F.col("cwe"), F.col("fix_verdict")).alias("remedy"))


_ORACLE = "CASE " + " ".join(f"WHEN {_NUMBER} IN ({', '.join(map(str, c))}) THEN '{n}'" for n, c in catalog.ORACLES) + " END"


@register("oracle_lookup", sql(f"SELECT fingerprint, {_ORACLE} AS oracle FROM f", f=FINDINGS))
def oracle_lookup(spark, sf_dir):
    return read(spark, sf_dir, FINDINGS).select("fingerprint", catalog.oracle(F.col("cwe")).alias("oracle"))


_CATALOG = "(VALUES " + ", ".join(f"({c}, '{k}', [{', '.join(_q(x) for x in langs.split())}], [{', '.join(_q(x) for x in s.split('|'))}])" for c, k, langs, s in catalog.CATALOG) + ") AS c(number, class, langs, signals)"


@register("catalog_lookup", sql(f"SELECT fingerprint, {_NUMBER} AS cwe, class FROM f LEFT JOIN {_CATALOG} ON {_NUMBER} = number", f=FINDINGS))
def catalog_lookup(spark, sf_dir):
    return catalog.looked_up(read(spark, sf_dir, FINDINGS), catalog.catalog(spark))


#: Signals that findings tell of: who found a class, what fixed it and in which kind of file.
_LEARNT = f"SELECT DISTINCT {_NUMBER} AS number, role, pattern FROM (SELECT cwe, unnest(['source', 'sanitizer', 'structural']) AS role, unnest([source, fix_verdict, ' .' || string_split(file_path, '.')[-1]]) AS pattern FROM f) WHERE pattern IS NOT NULL"
_WHOLE = f"(SELECT c.number, class, langs, coalesce(sources, []) AS sources, signals, coalesce(sanitizers, []) AS sanitizers, coalesce(structural, []) AS structural FROM {_CATALOG} LEFT JOIN (SELECT number, list_sort(list(pattern) FILTER (role = 'source')) AS sources, list_sort(list(pattern) FILTER (role = 'sanitizer')) AS sanitizers, list_sort(list(pattern) FILTER (role = 'structural')) AS structural FROM ({_LEARNT}) GROUP BY number) l ON l.number = c.number)"


def _whole_catalog(spark, sf_dir):
    f = read(spark, sf_dir, FINDINGS)
    kinds = {"source": F.col("source"), "sanitizer": F.col("fix_verdict"), "structural": F.concat(F.lit(" ."), F.substring_index("file_path", ".", -1))}
    told = f.select(cwe_number(F.col("cwe")).alias("cwe"), F.explode(F.array(*[F.struct(F.lit(k).alias("role"), c.alias("pattern")) for k, c in kinds.items()])).alias("s")).select("cwe", "s.role", "s.pattern")
    return catalog.with_signals(catalog.catalog(spark), told.filter("pattern is not null").distinct())


_ROLES = " UNION ALL ".join(f"SELECT number, {i} AS part, '{role}' AS role, trim(unnest({c}), ' ') AS pattern, unnest(range(len({c}))) AS pos FROM c" for i, (role, c) in enumerate(catalog.ROLES))


@register("structural_queries", sql(f"WITH c AS {_WHOLE}, p AS (SELECT * FROM ({_ROLES}) WHERE pattern <> ''), k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY number, role, lower(pattern) ORDER BY pos) = 1), n AS (SELECT number AS cwe, role, pattern, CAST(row_number() OVER (PARTITION BY number ORDER BY part, pos) AS INTEGER) AS n FROM k), s AS (SELECT {_NUMBER} AS number, count(*) AS findings FROM f GROUP BY ALL) SELECT n.cwe, role, pattern, n, coalesce(findings, 0) AS findings FROM n LEFT JOIN s ON n.cwe = s.number", f=FINDINGS))
def structural_queries(spark, sf_dir):
    """The catalog's seeds of all four roles, each with the number of findings of its CWE."""
    n = read(spark, sf_dir, FINDINGS).groupBy(cwe_number(F.col("cwe")).alias("cwe")).agg(F.count("*").alias("findings"))
    return catalog.seeds(_whole_catalog(spark, sf_dir)).join(n, "cwe", "left").select("cwe", "role", "pattern", "n", F.coalesce("findings", F.lit(0)).alias("findings"))


#: Contexts of repositories, one a supplier.
CONTEXT = """
SELECT concat('s', CAST(s_suppkey AS STRING)) AS repo, CASE s_nationkey % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'java' WHEN 3 THEN 'c' WHEN 4 THEN 'go' END AS language,
 CASE s_suppkey % 3 WHEN 0 THEN 'flask' END AS framework, CASE s_suppkey % 4 WHEN 0 THEN 'PostgreSQL' WHEN 1 THEN 'mongo' END AS db, CASE s_suppkey % 5 WHEN 0 THEN 'main' END AS entry,
 CASE s_nationkey % 4 WHEN 0 THEN 79 WHEN 1 THEN 89 END AS threat, CASE s_suppkey % 6 WHEN 0 THEN 787 WHEN 1 THEN 22 END AS intel,
 lower(concat(s_name, CASE s_suppkey % 7 WHEN 0 THEN ' render query redirect sast .py' WHEN 1 THEN ' exec spawn system' WHEN 2 THEN ' RegExp logger' ELSE '' END)) AS corpus
FROM {supplier}
"""
_HITS = "len(list_filter(list_prepend(class, list_concat(sources, signals, structural)), lambda t: length(t) >= 3 AND contains(corpus, lower(t))))"
_FIT = f"""(CASE WHEN threat = number THEN 100 ELSE 0 END + CASE WHEN intel = number THEN 60 ELSE 0 END + CASE WHEN language IS NOT NULL AND (list_contains(langs, language) OR list_contains(langs, 'any')) THEN 25 ELSE 0 END + CASE WHEN list_contains(langs, 'any') THEN 5 ELSE 0 END
 + CASE WHEN regexp_matches(coalesce(db, ''), '(?i)sql|postgres|mysql|sqlite|oracle') AND regexp_matches(class, '(?i)sql|nosql|second-order') THEN 35 ELSE 0 END + CASE WHEN (framework IS NOT NULL OR entry IS NOT NULL) AND class IN {_list(catalog.WEB)} THEN 20 ELSE 0 END
 + CASE WHEN language = 'python' AND (framework IS NOT NULL)::INT + (db IS NOT NULL)::INT + (entry IS NOT NULL)::INT < 2 AND class IN {_list(catalog.SPARSE_PYTHON)} THEN 18 ELSE 0 END + least(30, 5 * {_HITS}))"""


@register("rank_catalog", sql(f"SELECT repo, CAST(number AS BIGINT) AS cwe, CAST({_FIT} AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY repo ORDER BY {_FIT} DESC, number) AS INTEGER) AS place FROM x, {_WHOLE} w QUALIFY place <= 20", x=CONTEXT, f=FINDINGS))
def rank_catalog(spark, sf_dir):
    one = lambda c: F.array_compact(F.array(c))
    x = read(spark, sf_dir, CONTEXT).select("repo", one("language").alias("languages"), one("framework").alias("frameworks"), one("db").alias("databases"), one("entry").alias("entry_points"), one(F.col("threat").cast("long")).alias("threat_cwes"), one(F.col("intel").cast("long")).alias("intel_cwes"), "corpus")
    return catalog.ranked(x, _whole_catalog(spark, sf_dir))


# joins

_INTEL = f"n AS (SELECT repo, cwe, 'lead' AS kind, lead AS id FROM ({_LEADS}) UNION ALL SELECT repo, cwe, 'invariant', id FROM i)"


@register("intel_for_findings", sql(f"WITH {_INTEL}, b AS (SELECT repo, cwe, count(*) FILTER (kind = 'lead') AS a, count(*) FILTER (kind = 'invariant') AS v, min(CASE WHEN kind = 'lead' THEN id END) AS first_lead FROM n WHERE cwe <> '' GROUP BY ALL) SELECT fingerprint, coalesce(a, 0) AS n_leads, coalesce(v, 0) AS n_invariants, first_lead FROM f LEFT JOIN b ON f.repo = b.repo AND f.cwe = b.cwe", f=FINDINGS, l=LEADS, i=INVARIANTS))
def intel_for_findings(spark, sf_dir):
    leads = threats.leads(read(spark, sf_dir, LEADS)).select("repo", "cwe", F.lit("lead").alias("kind"), F.col("lead").alias("id"))
    intel = leads.unionByName(read(spark, sf_dir, INVARIANTS).select("repo", "cwe", F.lit("invariant").alias("kind"), "id"))
    return threats.intel_of(read(spark, sf_dir, FINDINGS), intel)


@register("threat_lookup", sql(f"WITH d AS (SELECT concat('r', CAST(substr(id, 2) AS BIGINT) % 3) AS repo, id, concat('t', CAST(substr(id, 2) AS BIGINT)) AS threat FROM x), m AS (SELECT repo, id AS threat, title, {_IMPACT} AS impact, {_NUMBER} AS cwe FROM t) SELECT id, title, impact, cwe FROM d LEFT JOIN m USING (repo, threat)", x=DRAFTS, t=THREATS))
def threat_lookup(spark, sf_dir):
    n = F.substring("id", 2, 12).cast("long")
    d = read(spark, sf_dir, DRAFTS).select(F.concat(F.lit("r"), (n % 3).cast("string")).alias("repo"), "id", F.concat(F.lit("t"), n.cast("string")).alias("threat"))
    return threats.threats_of(d, read(spark, sf_dir, THREATS))


#: Places that a review was shown: obligations of the files that it was given, those of an overlay, and leads with one end or both.
_SEEN = "SELECT DISTINCT string_split(file_path, '/')[-1] AS file_path, line, line % 3 AS part FROM a"


@register("context_hits", sql(f"WITH s AS ({_SEEN}), g AS (SELECT DISTINCT file_path FROM s WHERE part = 0 AND line > 20), c AS (SELECT file_path, CASE WHEN line % 11 = 0 AND part = 1 THEN NULL ELSE line END AS line FROM s UNION ALL SELECT file_path, line - 9 FROM s WHERE part = 2 AND line % 2 = 0), m AS (SELECT t.case_id, t.id, coalesce(bool_or(t.line IS NULL OR t.line <= 0 OR c.line IS NULL OR abs(c.line - t.line) <= 6) FILTER (c.file_path IS NOT NULL), false) AS site_seen FROM t LEFT JOIN c ON c.file_path = t.file_path GROUP BY ALL) SELECT m.case_id, m.id, t.file_path IN (SELECT file_path FROM g) AS file_seen, site_seen FROM m JOIN t ON t.case_id = m.case_id AND t.id = m.id", t=TRUTH, a=ANCHORS))
def context_hits(spark, sf_dir):
    """Whether a review was shown an expected finding's file, and its site within six lines."""
    t = read(spark, sf_dir, TRUTH)
    a = read(spark, sf_dir, ANCHORS).select(F.substring_index("file_path", "/", -1).alias("file_path"), F.col("line").cast("long").alias("line")).distinct()
    # every case was shown the same places
    shown = t.select("case_id", "file_path").distinct().join(a, "file_path")
    part = lambda k: shown.filter(F.col("line") % 3 == k)
    overlay = part(1).withColumn("line", F.when(F.col("line") % 11 != 0, F.col("line")))
    leads = part(2).select("case_id", "file_path", F.col("line").alias("sink_line"), F.when(F.col("line") % 2 == 0, F.col("line") - 9).alias("source_line"))
    return benchmarks.context(t, part(0).filter("line > 20"), part(0), overlay, leads)


@register("boundary_crossings", sql("WITH b AS (SELECT repo, id AS boundary, [concat('w', CAST(substr(id, 2) AS BIGINT) % 5), 'w9'] AS own FROM t), w AS (SELECT repo, id AS flow, [concat('t', CAST(substr(id, 2) AS BIGINT) + 3), concat('t', CAST(substr(id, 2) AS BIGINT) * 2)] AS bs FROM t), e AS (SELECT repo, boundary, unnest(own) AS flow FROM b UNION SELECT x.repo, x.boundary, x.flow FROM (SELECT repo, flow, unnest(bs) AS boundary FROM w) x SEMI JOIN b ON b.repo = x.repo AND b.boundary = x.boundary) SELECT repo, boundary, string_agg(flow, ',' ORDER BY flow) AS crossing FROM e GROUP BY ALL", t=THREATS))
def boundary_crossings(spark, sf_dir):
    t = read(spark, sf_dir, THREATS).withColumn("n", F.substring("id", 2, 12).cast("long"))
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    boundaries = t.select("repo", F.col("id").alias("boundary"), F.array(name("w", F.col("n") % 5), F.lit("w9")).alias("own"))
    return threats.boundary_crossings(boundaries, t.select("repo", F.col("id").alias("flow"), F.array(name("t", F.col("n") + 3), name("t", F.col("n") * 2)).alias("boundaries")))


#: Elements of data-flow diagrams, two a part.
ELEMENTS = """
SELECT concat('r', CAST(p_partkey % 3 AS STRING)) AS repo, p_partkey AS ord, CASE p_partkey % 5 WHEN 0 THEN 'actors' WHEN 1 THEN 'services' WHEN 2 THEN 'databases' WHEN 3 THEN 'components' ELSE 'elements' END AS bucket,
 CASE p_partkey % 11 WHEN 0 THEN ' ' ELSE concat('e', CAST(p_partkey % 60 AS STRING)) END AS id, CASE p_size % 6 WHEN 0 THEN 'automated' WHEN 1 THEN 'session store' WHEN 2 THEN 'Data_Flow' WHEN 3 THEN 'flows' WHEN 4 THEN 'external' END AS kind,
 CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Ledger' ELSE p_name END AS name, CASE p_size % 3 WHEN 0 THEN 'dmz' WHEN 1 THEN '' END AS zone
FROM {part}
"""
_NODES = """y AS (SELECT repo, ord, nullif(trim(id, ' '), '') AS id, CASE bucket WHEN 'actors' THEN CASE WHEN lower(kind) IN ('automated', 'downstream-service', 'internal-service') THEN 'process' ELSE 'external-entity' END WHEN 'services' THEN 'process' WHEN 'databases' THEN 'data-store'
 WHEN 'components' THEN CASE WHEN contains(lower(coalesce(kind, '')), 'database') OR contains(lower(coalesce(kind, '')), 'store') THEN 'data-store' WHEN contains(lower(coalesce(kind, '')), 'flow') THEN 'data-flow' ELSE 'process' END
 ELSE CASE WHEN replace(lower(kind), '_', '-') IN ('external-entity', 'externalentity', 'external') THEN 'external-entity' WHEN replace(lower(kind), '_', '-') IN ('data-store', 'datastore') THEN 'data-store' WHEN replace(lower(kind), '_', '-') IN ('data-flow', 'dataflow') THEN 'data-flow' ELSE 'process' END END AS type,
 nullif(trim(name, ' '), '') AS name, coalesce(nullif(trim(zone, ' '), ''), CASE bucket WHEN 'actors' THEN 'external' WHEN 'elements' THEN 'unknown' ELSE 'internal' END) AS zone FROM e),
nodes AS (SELECT repo, id, type, coalesce(name, id) AS name, zone FROM y WHERE id IS NOT NULL AND type <> 'data-flow' QUALIFY row_number() OVER (PARTITION BY repo, id ORDER BY ord) = 1)"""


@register("dfd_tables", sql(f"WITH {_NODES} SELECT * FROM nodes", e=ELEMENTS))
def dfd_tables(spark, sf_dir):
    return threats.dfd_nodes(read(spark, sf_dir, ELEMENTS))


@register("chain_context", code_sql(f"WITH {_NODES}, x AS ({PACKS_SQL['dispatch_handlers']}), g AS ({SCANS_SQL['scan_entry_points']}), a AS (SELECT repo, min(name) AS name FROM nodes WHERE type = 'data-store' OR regexp_matches(name, {_q(threats.ASSET)}) GROUP BY repo, lower(name) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY lower(name)) <= 25), u AS (SELECT repo, path, kind, 'graph' AS origin, 0 AS o FROM x UNION ALL SELECT repo, path, pattern, 'scan', 1 FROM g), o AS (SELECT repo, path, kind, origin, o FROM u QUALIFY row_number() OVER (PARTITION BY repo, path, kind ORDER BY o) = 1), p AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY o, path, kind) AS place FROM o QUALIFY place <= 40) SELECT repo, 'asset' AS part, name AS what, 'model' AS origin FROM a UNION ALL SELECT repo, 'entry-point', path || '|' || kind, origin FROM p", e=ELEMENTS))
def chain_context(spark, sf_dir):
    """Assets and entry points that chains of findings may connect."""
    from siltstone.operators import dispatch

    lines = code_lines(spark, sf_dir)
    found = {"graph": dispatch.handlers(lines).select("repo", "path", "kind"), "scan": scan.pattern_scan(lines, scan.PACKS["entry_points"]).select("repo", "path", F.col("pattern").alias("kind"))}
    a = threats.assets(threats.dfd_nodes(read(spark, sf_dir, ELEMENTS))).select("repo", F.lit("asset").alias("part"), F.col("name").alias("what"), F.lit("model").alias("origin"))
    return a.unionByName(threats.entry_points(found).select("repo", F.lit("entry-point").alias("part"), F.concat_ws("|", "path", "kind").alias("what"), "origin"))


# ledgers and worklists

@register("ledger_summary", sql("WITH r AS (SELECT repo, CASE start_line % 3 WHEN 0 THEN 'file-read-budget' WHEN 1 THEN 'obligation-overlay' ELSE 'scoped-cpg' END AS lane, CASE start_line % 4 WHEN 0 THEN 'routed' WHEN 1 THEN 'discharged' ELSE 'open' END AS state FROM f), d AS (SELECT repo, count(*) - 20 AS n FROM f GROUP BY repo) SELECT repo, lane, state, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT repo, 'obligation-overlay', 'deferred', n FROM d WHERE n > 0", f=FINDINGS))
def ledger_summary(spark, sf_dir):
    line = F.col("start_line")
    f = read(spark, sf_dir, FINDINGS)
    r = f.select("repo", F.when(line % 3 == 0, "file-read-budget").when(line % 3 == 1, "obligation-overlay").otherwise("scoped-cpg").alias("lane"), F.when(line % 4 == 0, "routed").when(line % 4 == 1, "discharged").otherwise("open").alias("state"))
    return threats.ledger_summary(r, f.groupBy("repo").agg((F.count("*") - 20).alias("n")))


#: Lenses of discovery and the kinds of obligations that they own.
LENSES = {
    "memory": ("fixed-size-buffer", "raw-copy", "alloc-arith", "gc-rooting"), "lifetime": ("lifetime-free", "gc-rooting"), "arithmetic": ("int-overflow-size", "alloc-arith"),
    "injection": ("command-exec", "sql-sink", "dynamic-eval", "deserialization", "path-fs", "ssrf", "template-xss"), "authz": ("object-authz", "authz-decision", "open-redirect"), "concurrency": (),
}
_LENS = " UNION ALL ".join(f"SELECT '{n}' AS lens, '{k}' AS kind" for n, kinds in LENSES.items() for k in kinds)


@register("lens_filter", code_sql(f"WITH o AS ({SCANS_SQL['scan_obligations']}), z AS ({_LENS}) SELECT repo, lens, o.kind, count(*) AS n FROM o JOIN z ON o.kind = z.kind GROUP BY ALL"))
def lens_filter(spark, sf_dir):
    """Obligations that each lens looks at."""
    of = F.create_map(*[x for k in sorted({k for kinds in LENSES.values() for k in kinds}) for x in (F.lit(k), F.array(*[F.lit(n) for n, kinds in LENSES.items() if k in kinds]))])
    o = scan.obligations(code_lines(spark, sf_dir)).withColumn("lens", F.explode(F.try_element_at(of, F.col("kind"))))
    return o.groupBy("repo", "lens", "kind").agg(F.count("*").alias("n"))


@register("memory_dirs", code_sql(f"WITH o AS ({SCANS_SQL['scan_obligations']}), s AS (SELECT repo, path, count(*) AS score FROM o GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, path) AS rn, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir FROM s), d AS (SELECT repo, dir, count(*) AS files, count(*) FILTER (rn > 25 AND regexp_matches(path, {_q(surface.INPUT_PATH)})) AS input, count(*) FILTER (rn > 25 AND NOT regexp_matches(path, {_q(surface.INPUT_PATH)}) AND regexp_matches(path, {_q(scan.NATIVE_FILES)})) AS native FROM r GROUP BY ALL) SELECT repo, dir, input, native, CAST(row_number() OVER (PARTITION BY repo ORDER BY input DESC, native DESC, dir) AS INTEGER) AS place FROM d WHERE files <= 150 AND input + native > 0 QUALIFY place <= 10"))
def memory_dirs(spark, sf_dir):
    scored = scan.obligations(code_lines(spark, sf_dir)).groupBy("repo", "path").agg(F.count("*").alias("score"))
    return surface.memory_dirs(scored)


_NUMBERED = "n AS (SELECT repo, path, line AS ln, text, row_number() OVER (PARTITION BY repo, path ORDER BY line) AS line FROM code WHERE (repo, path) IN (SELECT (repo, path) FROM o))"


@register("obligation_slices", code_sql(f"WITH o AS ({SCANS_SQL['scan_obligations']}), {_NUMBERED}, {spans_sql('n')}, a AS (SELECT repo, path, line AS own, min(kind) AS kind FROM o GROUP BY ALL), p AS (SELECT a.repo, a.path, n.line, own, kind FROM a JOIN n ON a.repo = n.repo AND a.path = n.path AND own = n.ln), {enclosing_sql('p', 'repo, path, line, own, kind', 'n')}, y AS (SELECT *, last - first + 1 > 80 AS truncated, least(greatest(first, line - 40), last - 79) AS cut FROM x) SELECT repo, path, own AS line, kind, CAST(CASE WHEN truncated THEN cut ELSE first END AS INTEGER) AS first, CAST(CASE WHEN truncated THEN cut + 79 ELSE last END AS INTEGER) AS last, truncated FROM y"))
def obligation_slices(spark, sf_dir):
    lines = code_lines(spark, sf_dir)
    return surface.slices(lines, scan.obligations(lines))


@register("mitigation_effective", code_sql(f"WITH h AS ({PACKS_SQL['scan_build_hardening']}), b AS (SELECT repo, min(path) AS path, CASE count(*) % 3 WHEN 0 THEN 'full' END AS relro, CASE count(*) % 2 WHEN 0 THEN 'false' END AS pie FROM code WHERE regexp_matches(path, '[.]c$') GROUP BY repo) SELECT coalesce(h.repo, b.repo) AS repo, CASE WHEN no_exec_stack IS NOT NULL THEN 'true' END AS nx, coalesce(b.pie, CASE WHEN h.pie IS NOT NULL THEN 'true' END) AS pie, CASE WHEN stack_protector IS NOT NULL THEN 'true' END AS canary, coalesce(b.relro, CASE WHEN h.relro IS NOT NULL THEN 'partial' END) AS relro, CASE WHEN fortify IS NOT NULL THEN 'true' END AS fortify, CASE WHEN cfg IS NOT NULL THEN 'true' END AS cfg FROM h FULL JOIN b ON h.repo = b.repo"))
def mitigation_effective(spark, sf_dir):
    lines = code_lines(spark, sf_dir)
    none = F.lit(None).cast("string")
    n = F.count("*")
    b = lines.filter(F.col("path").rlike("[.]c$")).groupBy("repo").agg(F.min("path").alias("path"), F.when(n % 3 == 0, "full").alias("relro"), F.when(n % 2 == 0, "false").alias("pie"))
    return threats.mitigations(scan.hardening(lines), b.select("repo", "path", none.alias("nx"), "pie", none.alias("canary"), "relro", none.alias("fortify"), none.alias("cfg")))


@register("discovery_severity", sql(f"SELECT fingerprint, CASE WHEN x IN {_list(threats.CRITICAL_CRASHES)} THEN 'critical' ELSE 'high' END AS severity FROM (SELECT fingerprint, CASE length(fingerprint) % 4 WHEN 0 THEN 'heap-use-after-free' WHEN 1 THEN 'segv' WHEN 2 THEN 'double-free' END AS x FROM c)", c=CRASHES))
def discovery_severity(spark, sf_dir):
    n = F.length("fingerprint") % 4
    return read(spark, sf_dir, CRASHES).select("fingerprint", threats.discovered_severity(F.when(n == 0, "heap-use-after-free").when(n == 1, "segv").when(n == 2, "double-free")).alias("severity"))


@register("crash_promote", sql("WITH r AS (SELECT DISTINCT fingerprint FROM f WHERE poc_verdict = 'exploited'), g AS (SELECT fingerprint, min('h' || (caller_count % 17)) AS crash_hash FROM f WHERE start_line % 3 > 0 GROUP BY ALL), m AS (SELECT 'h' || (caller_count % 17) AS crash_hash, min('in/' || start_line) AS input FROM f WHERE caller_count % 17 < 9 GROUP BY ALL) SELECT r.fingerprint, 'proven' AS status, g.crash_hash, input FROM r LEFT JOIN g ON r.fingerprint = g.fingerprint LEFT JOIN m ON g.crash_hash = m.crash_hash", f=FINDINGS))
def crash_promote(spark, sf_dir):
    f = read(spark, sf_dir, FINDINGS)
    hashed = f.withColumn("crash_hash", F.concat(F.lit("h"), (F.col("caller_count") % 17).cast("string")))
    small = hashed.filter("caller_count % 17 < 9").select("crash_hash", F.concat(F.lit("in/"), F.col("start_line").cast("string")).alias("input"))
    return threats.promoted_crashes(f.select("fingerprint", F.col("poc_verdict").alias("verdict")), hashed.filter("start_line % 3 > 0"), small)


# gates

_R = "coalesce(rationale, '')"
_NO_VERDICT = lambda values: f"WHEN coalesce(verdict, '') NOT IN {_list(values)} THEN 'verdict'"


def _review(guard: str) -> str:
    return f"SELECT id, CASE {_NO_VERDICT(gates.REVIEW_VERDICTS)} WHEN length({_R}) < 200 THEN 'rationale' WHEN verdict IN {_list(gates.ANCHORED)} AND anchors = 0 THEN 'anchors' WHEN verdict = 'reviewed-no-impact' AND NOT regexp_matches({_R}, {_q(guard)}) THEN 'guard' END AS reason FROM d"


@register("gate_threat_hunt", sql(_review(gates.THREAT_GUARD), d=DRAFTS))
def gate_threat_hunt(spark, sf_dir):
    return read(spark, sf_dir, DRAFTS).select("id", gates.review_reason(gates.THREAT_GUARD).alias("reason"))


@register("gate_diff_review", sql(_review(gates.CHANGE_GUARD), d=DRAFTS))
def gate_diff_review(spark, sf_dir):
    return read(spark, sf_dir, DRAFTS).select("id", gates.review_reason(gates.CHANGE_GUARD).alias("reason"))


_BLANK_CWE, _SHORT_CHECK = "trim(coalesce(cwe, ''), ' ') = ''", "length(coalesce(self_check, '')) < 40"


@register("gate_deep_scan", sql(f"SELECT id, CASE {_NO_VERDICT(('finding', 'candidate', 'rejected'))} WHEN length({_R}) < 150 THEN 'rationale' WHEN verdict = 'finding' AND anchors = 0 THEN 'anchors' WHEN verdict = 'finding' AND {_BLANK_CWE} THEN 'cwe' WHEN verdict = 'finding' AND {_SHORT_CHECK} THEN 'self-check' END AS reason FROM d", d=DRAFTS))
def gate_deep_scan(spark, sf_dir):
    return read(spark, sf_dir, DRAFTS).select("id", gates.deep_scan_reason().alias("reason"))


@register("gate_deep_hunt", sql(f"SELECT id, CASE {_NO_VERDICT(('finding', 'candidate', 'rejected'))} WHEN length({_R}) < 150 THEN 'rationale' WHEN verdict = 'finding' AND {_BLANK_CWE} THEN 'cwe' WHEN verdict = 'finding' AND hops < 2 THEN 'path' WHEN verdict = 'finding' AND files < 2 THEN 'one-file' WHEN verdict = 'finding' AND {_SHORT_CHECK} THEN 'self-check' END AS reason FROM d", d=DRAFTS))
def gate_deep_hunt(spark, sf_dir):
    return read(spark, sf_dir, DRAFTS).select("id", gates.deep_hunt_reason().alias("reason"))


@register("gate_verify", sql(f"SELECT id, CASE {_NO_VERDICT(('confirmed-exploitable', 'not-exploitable', 'inconclusive'))} WHEN length({_R}) < 150 THEN 'rationale' WHEN length(coalesce(advocate, '')) < 60 THEN 'advocate' WHEN verdict = 'confirmed-exploitable' AND NOT sketch THEN 'sketch' WHEN verdict = 'confirmed-exploitable' AND anchors = 0 THEN 'anchors' WHEN verdict = 'confirmed-exploitable' AND length(coalesce(remedy, '')) < 20 THEN 'negative-case' WHEN verdict = 'not-exploitable' AND NOT regexp_matches({_R}, {_q(gates.GUARDS)}) THEN 'guard' END AS reason FROM d", d=DRAFTS))
def gate_verify(spark, sf_dir):
    return read(spark, sf_dir, DRAFTS).withColumn("negative", F.col("remedy")).select("id", gates.verification_reason().alias("reason"))


def _producers() -> str:
    out = []
    for source, verdicts, kinds, least, anchored in gates.PRODUCERS:
        kind = f"WHEN kind NOT IN {_list(kinds)} THEN 'kind' " if kinds else ""
        guard = f" WHEN verdict = 'rejected' AND NOT regexp_matches({_R}, {_q(gates.AUTHZ_GUARD)}) THEN 'guard'" if source == "authz" else ""
        out.append(f"WHEN '{source}' THEN CASE {_NO_VERDICT(verdicts)} {kind}WHEN length({_R}) < {least} THEN 'rationale' WHEN verdict = '{anchored}' AND anchors = 0 THEN 'anchors'{guard} END")
    return "SELECT id, source, CASE source " + " ".join(out) + " ELSE 'producer' END AS reason FROM d"


@register("gate_producers", sql(_producers(), d=DRAFTS))
def gate_producers(spark, sf_dir):
    return read(spark, sf_dir, DRAFTS).select("id", "source", gates.producer_reason().alias("reason"))


@register("gate_mem_tier", sql(f"SELECT id, CASE WHEN tier NOT IN {_list(gates.TIERS)} THEN 'tier' WHEN length({_R}) < 200 THEN 'rationale' WHEN tier <> 'needs-more-evidence' AND anchors = 0 THEN 'anchors' WHEN tier IN {_list(gates.CONTROLLED)} AND NOT sketch THEN 'control-offset' WHEN length(trim(coalesce(remedy, ''), ' ')) < 20 THEN 'remedy' END AS reason FROM d", d=DRAFTS))
def gate_mem_tier(spark, sf_dir):
    return read(spark, sf_dir, DRAFTS).select("id", gates.tier_reason().alias("reason"))


@register("gate_context", sql(f"SELECT id, CASE WHEN kind IS NULL THEN 'forbidden-key' WHEN anchors < 1 THEN 'modules' WHEN hops < 1 THEN 'invariants' WHEN length(trim({_R}, ' ')) < 80 THEN 'overview' END AS reason FROM d", d=DRAFTS))
def gate_context(spark, sf_dir):
    keys = F.array(F.lit("modules"), F.coalesce("kind", F.lit("CWE")))
    return read(spark, sf_dir, DRAFTS).select("id", gates.context_reason(keys, F.col("anchors"), F.col("hops"), F.col("rationale")).alias("reason"))


_MEMORY = "source IN ('systems-hunt', 'binary-recon')"


@register("candidate_filters", sql(f"WITH g AS (SELECT fingerprint, coalesce(status, '') AS s, coalesce(verdict, '') AS v, verify_verdict AS y, poc_verdict AS p, {_MEMORY} AS memory FROM f) SELECT fingerprint, s = 'open' OR v = 'needs-active-agent-trace' AS verify, coalesce(y = 'inconclusive', false) OR s = 'needs-trace' OR v = 'needs-active-agent-trace' AS path_solve, s IN ('confirmed', 'proven') AS seed, s IN {_list(gates.CHAINABLE)} AS chainable, coalesce(y IN ('confirmed-exploitable', 'inconclusive'), false) AS poc_ready, memory AND coalesce(p <> 'exploited', true) AS unproven_memory, s IN ('open', 'confirmed', 'proven') OR v IN ('exploitable', 'finding') AS sarif, s NOT IN ('reviewed', 'noise', 'remediated') AS report, s NOT IN ('reviewed', 'noise', 'rejected') AS bench FROM g", f=FINDINGS))
def candidate_filters(spark, sf_dir):
    return gates.live(read(spark, sf_dir, FINDINGS).withColumn("memory", F.col("source").isin("systems-hunt", "binary-recon")))


# extension

@register("register_pack", code_sql("SELECT repo, 'todo' AS pattern, path, line FROM (SELECT repo, path, line FROM code WHERE regexp_matches(text, 'node|lambda') QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY line) <= 2) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path, line) <= 9"))
def register_pack(spark, sf_dir):
    """A pack that isn't built in."""
    pack = scan.Pack("own", (("todo", "node|lambda"),), 2, 9, 9, "exact", "none")
    return scan.pattern_scan(code_lines(spark, sf_dir), pack).select("repo", "pattern", "path", "line")


@register("register_ranker", code_sql("SELECT repo, path, line, length(path) % 7 AS score FROM (SELECT repo, path, line FROM code WHERE regexp_matches(text, 'node|lambda') QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY line) <= 2) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY length(path) % 7 DESC, path, line) <= 9"))
def register_ranker(spark, sf_dir):
    """A ranker of one's own: an expression of path and text."""
    pack = scan.Pack("own", (("todo", "node|lambda"),), 2, 9, 9, "exact", "own")
    return scan.pattern_scan(code_lines(spark, sf_dir), pack, ranker=lambda path, text: F.length(path) % 7).select("repo", "path", "line", "score")


@register("score_hook", sql("SELECT f.repo, fingerprint, coalesce(w, 0) AS blast FROM f LEFT JOIN (SELECT repo, max(caller_count) AS w FROM s GROUP BY repo) x ON f.repo = x.repo", f=FINDINGS, s=SYMBOLS))
def score_hook(spark, sf_dir):
    """Blast radius from a table that the caller gives, here the greatest of the repo."""
    blast = read(spark, sf_dir, SYMBOLS).groupBy("repo").agg(F.max("caller_count").alias("blast"))
    return read(spark, sf_dir, FINDINGS).select("repo", "fingerprint").join(blast, "repo", "left").select("repo", "fingerprint", F.coalesce("blast", F.lit(0)).alias("blast"))
