"""Queries of readers of whole documents, of writers, and of streams into tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import findings, merged, sarif, stores, surface
from siltstone.plans.derived import CRASHES, FILES, FINDINGS, RUNS, VOTES, read, sql
from siltstone.plans.findings import _ACTIVE, _RISK, _SEVERITY_RANK
from siltstone.plans.register import registry
from siltstone.plans.surface import _SHARDS
from siltstone.sources import documents
from siltstone.streaming import crashes

QUERIES, ORACLE_SQL, register = registry()


@register("read_findings", sql("SELECT fingerprint, source, title, severity, status FROM f WHERE batch % 11 > 0", f=FINDINGS))
def read_findings(spark, sf_dir):
    """Findings documents, one an order, some of them torn."""
    row = F.struct("fingerprint", "source", "title", "severity", "status")
    docs = read(spark, sf_dir, FINDINGS).groupBy("batch").agg(F.to_json(F.struct(F.collect_list(row).alias("findings"))).alias("json"))
    torn = F.when(F.col("batch") % 11 == 0, F.concat(F.lit("{"), "json")).otherwise(F.col("json"))
    return documents.findings_document(docs.select(torn.alias("json")))


#: Items of a proxy's export, one a page.
ITEMS = """
SELECT page_id, concat('<item><url><![CDATA[https://h.example/api/u', CAST(page_id % 20 AS STRING), '/x?a=', CAST(page_id AS STRING), '&b=2]]></url>', CASE page_id % 3 WHEN 0 THEN '<method>post</method>' WHEN 1 THEN '<method>GET</method>' ELSE '' END,
 CASE page_id % 4 WHEN 0 THEN concat('<request base64="true">', base64(CAST(concat('POST / HTTP/1.1', chr(10), 'Cookie: s=1', chr(10), chr(10), 'p=1&q=', CAST(page_id AS STRING)) AS BINARY)), '</request>')
 WHEN 1 THEN concat('<request base64="false"><![CDATA[GET / HTTP/1.1', chr(10), chr(10), '{{"a": "b=c"}}]]></request>') WHEN 2 THEN concat('<request base64="false"><![CDATA[PUT / HTTP/1.1', chr(10), 'cookie: t', chr(10), chr(10), 'z=9]]></request>') ELSE '' END, '</item>') AS xml
FROM {pages}
"""


@register("read_proxy_xml", "SELECT CASE page_id % 3 WHEN 0 THEN 'POST' ELSE 'GET' END AS method, concat('/api/u', page_id % 20, '/x') AS path, 'a,b' AS params, CASE page_id % 4 WHEN 0 THEN 'p,q' WHEN 2 THEN 'z' ELSE '' END AS body_params, page_id % 4 IN (0, 2) AS has_cookies FROM pages")
def read_proxy_xml(spark, sf_dir):
    return documents.proxy_export(read(spark, sf_dir, ITEMS))


#: OpenAPI documents in YAML, one a page.
YAML = """
SELECT page_id AS id, concat('openapi: 3.0', chr(10), 'paths:', chr(10), '  /p', CAST(page_id AS STRING), ':', chr(10), '    get:', chr(10), '      post: no', chr(10), '    parameters:', chr(10), CASE page_id % 2 WHEN 0 THEN concat('    post: # yes', chr(10)) ELSE '' END,
 chr(10), '  /q: # second', chr(10), CASE page_id % 3 WHEN 0 THEN concat('    delete:', chr(10)) ELSE concat('#   put:', chr(10)) END, 'components:', chr(10), '  /no:', chr(10), '    get:') AS content
FROM {pages}
"""
_YAML_LINES = "l AS (SELECT id, unnest(range(1, len(a) + 1)) AS line, regexp_replace(unnest(a), '#.*$', '') AS t FROM (SELECT id, string_split(content, chr(10)) AS a FROM y))"


@register("openapi_yaml_routes", sql(f"WITH {_YAML_LINES}, i AS (SELECT id, line, trim(t, ' ') AS t, length(t) - length(ltrim(t, ' ')) AS ind FROM l WHERE trim(t, ' ') <> ''), b AS (SELECT *, last_value(CASE WHEN ind = 0 THEN starts_with(t, 'paths:') END IGNORE NULLS) OVER (PARTITION BY id ORDER BY line) AS inside FROM i), p AS (SELECT *, last_value(CASE WHEN ind = 2 THEN nullif(regexp_extract(t, '^(/\\S*)\\s*:', 1), '') END IGNORE NULLS) OVER (PARTITION BY id ORDER BY line) AS path FROM b WHERE inside AND ind > 0) SELECT id, upper(regexp_extract(t, '^([a-z]+)\\s*:', 1)) AS method, path FROM p WHERE ind > 2 AND regexp_extract(t, '^([a-z]+)\\s*:', 1) IN ('get', 'put', 'post', 'delete', 'options', 'head', 'patch', 'trace')", y=YAML))
def openapi_yaml_routes(spark, sf_dir):
    lines = read(spark, sf_dir, YAML).select("id", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    return documents.yaml_routes(lines, "id")


_MAGIC = {0: "7F454C46", 1: "4D5A9000", 2: "FEEDFACE", 3: "CAFEBABE"}


@register("binary_inventory", "SELECT source AS repo, concat('bin/d', doc_id) AS path, CASE doc_id % 7 WHEN 0 THEN 'elf' WHEN 1 THEN 'pe' ELSE 'macho' END AS format, CAST(4 + octet_length(encode(text)) AS BIGINT) AS bytes FROM documents WHERE doc_id % 7 < 4 AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY concat('bin/d', doc_id)) <= 200")
def binary_inventory(spark, sf_dir):
    """Documents as programs: some begin with the bytes of one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null")
    magic = F.lit("00000000")
    for k, v in _MAGIC.items():
        magic = F.when(F.col("doc_id") % 7 == k, F.lit(v)).otherwise(magic)
    return documents.binaries(docs.select(F.col("source").alias("repo"), F.concat(F.lit("bin/d"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.unhex(magic), F.encode("text", "utf-8")).alias("content")))


@register("read_votes", sql("SELECT fingerprint, CASE WHEN ord % 2 = 0 THEN lens ELSE 'draft-' || lens END AS lens, verdict, confidence FROM v WHERE verdict <> 'bogus' AND 10 + ord % 30 >= 20", v=VOTES))
def read_votes(spark, sf_dir):
    """Drafts of votes, one a finding and lens; without a lens of their own they have their file's name."""
    v = read(spark, sf_dir, VOTES)
    one = F.struct("fingerprint", "verdict", F.repeat(F.lit("x"), (10 + F.col("ord") % 30).cast("int")).alias("rationale"), "confidence")
    docs = v.select(F.concat(F.lit("draft-"), "lens").alias("file"), F.to_json(F.struct(F.when(F.col("ord") % 2 == 0, F.col("lens")).alias("lens"), F.array(one).alias("candidates"))).alias("json"))
    return documents.votes(docs)


#: Documents that name files at several depths, one a document.
PREPS = """
SELECT doc_id AS id, concat('{{"a":{{"filePath":"./src/f', CAST(doc_id AS STRING), '.c","line":', CAST(doc_id % 50 AS STRING), '}},"files":["x', CAST(doc_id % 9 AS STRING), '.py","./y.js",3],"deep":[{{"candidateFiles":["z.go"],"in":{{"filePath":"w', CAST(doc_id % 7 AS STRING), '","startLine":7}}}},[{{"filePath":"./v"}}]],"other":["no"]}}') AS json FROM {documents}
"""


@register("harvest_anchors", "SELECT doc_id AS id, concat('src/f', doc_id, '.c') AS path, CAST(doc_id % 50 AS BIGINT) AS line FROM documents UNION ALL SELECT doc_id, concat('x', doc_id % 9, '.py'), NULL FROM documents UNION ALL SELECT doc_id, 'y.js', NULL FROM documents UNION ALL SELECT doc_id, 'z.go', NULL FROM documents UNION ALL SELECT doc_id, concat('w', doc_id % 7), 7 FROM documents UNION ALL SELECT doc_id, 'v', NULL FROM documents")
def harvest_anchors(spark, sf_dir):
    return documents.harvested(read(spark, sf_dir, PREPS), "id", deepest=6)


@register("write_findings", sql("SELECT repo, status, count(*) AS n FROM f WHERE severity IS NOT NULL GROUP BY ALL", f=FINDINGS))
def write_findings(spark, sf_dir):
    """Findings written twice, the second time without those of no severity, and the last version read."""
    f = read(spark, sf_dir, FINDINGS)
    table = stores.Versions(spark, stores.shared(spark, "findings"))
    table.replace(f)
    table.replace(f.filter("severity is not null"))
    return table.read(f.schema).groupBy("repo", "status").agg(F.count("*").alias("n"))


@register("write_jsonl", sql("SELECT fingerprint, cwe, source FROM c", c=CRASHES))
def write_jsonl(spark, sf_dir):
    """Crash records appended to a log in two steps, and read back."""
    c = read(spark, sf_dir, CRASHES).select("fingerprint", "cwe", "source")
    path = stores.shared(spark, "log")
    stores.appended(c.filter("cwe < 'CWE-124'"), path)
    stores.appended(c.filter("cwe >= 'CWE-124'"), path)
    return spark.read.schema(c.schema).option("mode", "DROPMALFORMED").json(path)


_BY = " UNION ALL ".join(f"SELECT repo, '{s}' AS section, coalesce({c}, '(none)') AS name, count(*) AS n FROM f GROUP BY ALL" for s, c in (("severity", "severity"), ("status", "status"), ("producer", "source")))


_FIRST = f"SELECT repo, 'fix-first' AS section, fingerprint AS name, row_number() OVER (PARTITION BY repo ORDER BY {_RISK} DESC, {_SEVERITY_RANK} DESC, fingerprint) AS n FROM f WHERE {_ACTIVE} QUALIFY n <= 10"
_CHAINS = "SELECT min(repo) AS repo, 'chain' AS section, chain AS name, count(DISTINCT fingerprint) AS n FROM f WHERE chain IS NOT NULL GROUP BY chain HAVING count(DISTINCT fingerprint) > 1"
_COVERED = f"SELECT repo, 'coverage' AS section, unnest(['files', 'covered', 'uncovered']) AS name, unnest([files, covered, files - covered]) AS n FROM (SELECT repo, CAST(sum(n_files) AS BIGINT) AS files, CAST(coalesce(sum(n_files) FILTER (length(first_path) % 2 = 0), 0) AS BIGINT) AS covered FROM s GROUP BY repo)"
_UNTOUCHED = "SELECT repo, 'uncovered' AS section, path AS name, row_number() OVER (PARTITION BY repo ORDER BY path) AS n FROM (SELECT k.repo, path FROM k JOIN s ON s.repo = k.repo AND s.dir = k.dir AND s.shard_id = CASE WHEN k.dir = '(root)' THEN 'root' ELSE k.dir END || CASE WHEN k.n > 60 THEN '__' || k.k ELSE '' END WHERE length(first_path) % 2 > 0) QUALIFY n <= 25"


@register("report_tables", sql(f"WITH {_SHARDS}, t AS (SELECT repo, count(*) AS n FROM f GROUP BY repo) {_BY} UNION ALL SELECT repo, 'table', 'shown', least(200, n) FROM t UNION ALL SELECT repo, 'table', 'left out', greatest(0, n - 200) FROM t UNION ALL SELECT repo, 'resolved', 'all', count(*) FROM f WHERE status IN ('reviewed', 'noise', 'remediated') GROUP BY repo UNION ALL {_FIRST} UNION ALL {_CHAINS} UNION ALL {_COVERED} UNION ALL {_UNTOUCHED}", f=FINDINGS, files=FILES))
def report_tables(spark, sf_dir):
    """A report's counts, what to fix first, its chains, and what the sweep of the files covered."""
    f, files = read(spark, sf_dir, FINDINGS), read(spark, sf_dir, FILES)
    chains = f.filter("chain is not null").groupBy(F.col("chain").alias("label")).agg(F.min("repo").alias("repo"), F.countDistinct("fingerprint").alias("n")).filter("n > 1")
    shards = surface.shards(files)
    jobs = shards.filter(F.length("first_path") % 2 == 0).select("repo", "shard_id", F.lit("shard").alias("scope"), F.lit("sast").alias("producer"))
    untouched = surface.shard_files(files).join(jobs, ["repo", "shard_id"], "left_anti")
    return stores.full_report(f, None, chains, surface.coverage(shards, jobs), untouched)


@register("rule_digest_check", "SELECT concat('rules/d', doc_id) AS path, CASE WHEN doc_id % 4 = 0 THEN 'unlisted' WHEN doc_id % 3 = 0 THEN 'not-compiled' WHEN doc_id % 5 = 0 THEN 'altered' ELSE 'runnable' END AS state FROM documents")
def rule_digest_check(spark, sf_dir):
    """Documents as rules: some unlisted, some not compiled, some changed since they were listed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit("rules/d"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    listed = docs.filter("doc_id % 4 > 0").select("path", (F.col("doc_id") % 3 > 0).alias("compiled"), F.concat(F.lit("sha256:"), F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")), 256)).alias("digest"))
    return stores.runnable(docs, listed)


_UPSERT = "SELECT finding, role, run_no, exit_code FROM (SELECT finding, role, run_no, exit_code FROM r) QUALIFY row_number() OVER (PARTITION BY finding, role ORDER BY run_no DESC, exit_code DESC NULLS LAST) = 1"


@register("findings_stream_upsert", sql(_UPSERT, r=RUNS))
def findings_stream_upsert(spark, sf_dir):
    """Proof runs as a stream, folded into a table that holds the last of each finding and role."""
    source = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    stream = spark.sql(RUNS, lineitem=spark.readStream.schema(source.schema).parquet(f"{sf_dir}/lineitem.parquet*")).select("finding", "role", "run_no", "exit_code")
    base = stores.shared(spark, "stream")
    table = merged.MergedTable(spark, f"{base}/table", stream.schema, ["finding", "role"], [F.col("run_no"), F.col("exit_code")], buckets=8)
    merged.upsert_stream(stream, table, f"{base}/progress")
    return table.read()


@register("crash_stream_dedup", "SELECT concat('c', user_id, ':', event_type) AS crash_key, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS duplicate FROM events")
def crash_stream_dedup(spark, sf_dir):
    """Every crash of the event stream, and whether its key was seen before."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    rows = stream.select(F.concat(F.lit("c"), F.col("user_id").cast("string"), F.lit(":"), F.col("event_type")).alias("crash_key"), "event_id", F.col("ts").alias("seen_at"))
    base = stores.shared(spark, "stream")
    return crashes.flagged(rows, f"{base}/rows", f"{base}/progress").select("crash_key", "event_id", "duplicate")


@register("crash_stream_first", "SELECT DISTINCT concat('c', user_id, ':', event_type) AS crash_key FROM events")
def crash_stream_first(spark, sf_dir):
    """Crash keys of the event stream, each once."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    rows = stream.select(F.concat(F.lit("c"), F.col("user_id").cast("string"), F.lit(":"), F.col("event_type")).alias("crash_key"), F.col("ts").cast("timestamp").alias("seen_at"))
    base = stores.shared(spark, "stream")
    return crashes.run_once(crashes.first_crashes(rows, "3650 days").select("crash_key"), f"{base}/rows", f"{base}/progress")


#: Findings with several anchors or none, a rationale of untidy blanks, and a CWE as written.
_EVIDENCE = "SELECT *, concat(title, '  is\t', coalesce(verdict, ''), ' ', repeat('because ', CAST(start_line AS INT) * 3)) AS rationale, CASE ord % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS n FROM {f}"


@register("sarif_document", sql(r"""WITH k AS (SELECT *, coalesce(upper(nullif(trim(cwe, ' '), '')), source) AS rule, ord % 3 AS anchors FROM f WHERE status IN ('open', 'confirmed', 'proven') OR verdict IN ('exploitable', 'finding')),
p AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY fingerprint) AS place FROM k), r AS (SELECT repo, rule, row_number() OVER (PARTITION BY repo ORDER BY min(place)) - 1 AS rule_index FROM p GROUP BY repo, rule),
w AS (SELECT *, trim(regexp_replace(concat(title, '  is' || chr(9), coalesce(verdict, ''), ' ', repeat('because ', start_line * 3)), '\s+', ' ', 'g'), ' ') AS why FROM p)
SELECT w.repo, fingerprint, w.rule AS rule_id, rule_index, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, title || ' — ' || substr(why, 1, 600) AS message,
 CASE anchors WHEN 0 THEN '.:1' WHEN 1 THEN file_path || ':' || start_line ELSE file_path || ':' || start_line || ' other.c:1' END AS locations, status, coalesce(verify_verdict, '') AS verified FROM w JOIN r ON r.repo = w.repo AND r.rule = w.rule""", f=FINDINGS))
def sarif_document(spark, sf_dir):
    """Documents written to shared storage and read back: a row a result."""
    f = spark.sql(_EVIDENCE, f=read(spark, sf_dir, FINDINGS))
    one, other = F.struct("file_path", F.col("start_line").cast("long").alias("start_line")), F.struct(F.lit("./other.c").alias("file_path"), F.lit(0).cast("long").alias("start_line"))
    evidence = F.when(F.col("n") == 1, F.array(one)).when(F.col("n") == 2, F.array(one, other))
    path = stores.shared(spark, "sarif")
    sarif.write(sarif.document(f.withColumn("evidence", evidence), "siltstone", "1"), path, "gzip", in_order=True)
    r = F.col("result")
    at = F.array_join(F.transform(r["locations"], lambda x: F.concat(x["physicalLocation"]["artifactLocation"]["uri"], F.lit(":"), x["physicalLocation"]["region"]["startLine"].cast("string"))), " ")
    properties = r["properties"]
    return sarif.read(spark, path).select("repo", r["partialFingerprints"]["primary"].alias("fingerprint"), r["ruleId"].alias("rule_id"), r["ruleIndex"].alias("rule_index"), r["level"].alias("level"), r["message"]["text"].alias("message"), at.alias("locations"), properties["status"].alias("status"), F.coalesce(properties["verificationVerdict"], F.lit("")).alias("verified"))
