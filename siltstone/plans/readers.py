"""Queries of readers: documents and lines made of the given tables' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import manifests
from siltstone.plans.derived import read, sql
from siltstone.sources import documents

#: Scanner documents, one an event.
SCANS = """
SELECT concat('{{"results":[{{"check_id":"', event_type, '","path":"f', CAST(user_id AS STRING), '.c","start":{{"line":', CAST(event_id % 90 + 1 AS STRING), '}}', CASE event_id % 2 WHEN 0 THEN ',"extra":{{"severity":"ERROR","message":"m"}}' ELSE '' END, '}},{{"check_id":"x","path":"y.c","start":{{"line":3}},"end":{{"line":4}}}}]}}') AS json FROM {events}
"""
#: Records of a log, one an event; some torn.
LOG = """
SELECT concat('{{"crashKey":"c', CAST(user_id AS STRING), '","n":', CAST(event_id AS STRING), CASE event_id % 10 WHEN 3 THEN '' ELSE '}}' END) AS line FROM {events}
"""
#: HTTP archives, one a page.
ARCHIVES = """
SELECT concat('{{"log":{{"entries":[{{"request":{{"method":"', CASE page_id % 2 WHEN 0 THEN 'get' ELSE 'POST' END, '","url":"https://h.example/p', CAST(page_id AS STRING), '?b=1&a=2","headers":[{{"name":"', CASE page_id % 3 WHEN 0 THEN 'Cookie' ELSE 'Accept' END, '","value":"v"}}]',
 CASE page_id % 4 WHEN 1 THEN ',"postData":{{"text":"u=1&t=2&u=3"}}' WHEN 3 THEN ',"postData":{{"text":"[1]"}}' ELSE '' END, '}}}}]}}}}') AS json FROM {pages}
"""
#: OpenAPI documents, one a part.
APIS = """
SELECT p_partkey AS id, concat('{{"paths":{{"/a/', CAST(p_partkey AS STRING), '":{{"get":{{}},"parameters":[],"x-y":1}},"/b":{{"', CASE p_partkey % 2 WHEN 0 THEN 'post' ELSE 'PUT' END, '":{{"k":1}}}}}}}}') AS json FROM {part}
"""
#: Answers of a model, one an event.
ANSWERS = """
SELECT event_id, concat(CASE event_id % 3 WHEN 0 THEN 'Here it is ```json ' WHEN 1 THEN 'So: ' ELSE 'none' END, CASE event_id % 3 WHEN 2 THEN '' ELSE concat('{{"v":', CAST(event_id AS STRING), '}}') END, CASE event_id % 3 WHEN 0 THEN ' ``` as asked' ELSE '' END) AS text FROM {events}
"""
#: Lines of manifests, one a part.
MANIFESTS = """
SELECT concat('r', CAST(p_partkey % 50 AS STRING)) AS repo, CASE p_size % 7 WHEN 0 THEN 'go.mod' WHEN 1 THEN 'x/requirements-dev.txt' WHEN 2 THEN 'y/Cargo.toml' WHEN 3 THEN 'package.json' WHEN 4 THEN 'Gemfile' WHEN 5 THEN 'z/pom.xml' ELSE 'README' END AS path, p_partkey AS line,
 CASE p_size % 7 WHEN 0 THEN CASE p_partkey % 9 WHEN 0 THEN 'require (' WHEN 1 THEN ')' WHEN 2 THEN concat('require h.example/m', CAST(p_partkey % 70 AS STRING), ' v1.0') ELSE concat('  h.example/d', CAST(p_partkey % 70 AS STRING), ' v2') END
 WHEN 1 THEN CASE p_partkey % 9 WHEN 0 THEN '# no' WHEN 1 THEN '-r other' ELSE concat('lib', CAST(p_partkey % 70 AS STRING), CASE p_partkey % 2 WHEN 0 THEN '>=1' ELSE '[x]' END) END
 WHEN 2 THEN CASE p_partkey % 9 WHEN 0 THEN '[dependencies]' WHEN 1 THEN '[package]' WHEN 2 THEN '[target.x.dependencies]' ELSE concat('dep', CAST(p_partkey % 70 AS STRING), ' = 1') END
 WHEN 3 THEN CASE p_partkey % 9 WHEN 0 THEN '"dependencies": {{' WHEN 1 THEN '}},' WHEN 2 THEN '"devDependencies": {{' ELSE concat('  "pkg', CAST(p_partkey % 70 AS STRING), '": "^1",') END
 WHEN 4 THEN CASE p_partkey % 3 WHEN 0 THEN 'source "x"' ELSE concat('  gem "g', CAST(p_partkey % 70 AS STRING), '", "1"') END
 ELSE CASE p_partkey % 3 WHEN 0 THEN '<version>1</version>' ELSE concat('<artifactId>a', CAST(p_partkey % 70 AS STRING), '</artifactId>') END END AS text
FROM {part}
"""
#: Lines that declare routes, one an order.
DECLARED = """
SELECT concat('r', CAST(o_custkey % 3 AS STRING)) AS repo, concat('f', CAST(o_custkey % 60 AS STRING)) AS path, o_orderkey AS line,
 CASE o_orderkey % 6 WHEN 0 THEN concat('app.get("/o', CAST(o_orderkey AS STRING), '", h)') WHEN 1 THEN concat('@bp.route("/r', CAST(o_orderkey AS STRING), CASE o_custkey % 2 WHEN 0 THEN '", methods=["PUT"])' ELSE '")' END) WHEN 2 THEN concat('@PostMapping("/s', CAST(o_orderkey AS STRING), '")') WHEN 3 THEN concat('g.DELETE("/g', CAST(o_orderkey AS STRING), '", h)') WHEN 4 THEN 'router.use("/u", h)' ELSE CASE o_custkey % 4 WHEN 0 THEN 'path("", v)' WHEN 1 THEN 'get "x" => "c"' WHEN 2 THEN 'm.HandleFunc("/h", h)' ELSE 'nothing' END END AS text
FROM {orders}
"""


def read_scanner_json(spark, sf_dir):
    return documents.scanner_results(read(spark, sf_dir, SCANS)).groupBy("rule_id", "severity", "message", "file_path", "start_line", "end_line").agg(F.count("*").alias("n"))


def read_jsonl_tolerant(spark, sf_dir):
    return documents.tolerant_records(read(spark, sf_dir, LOG), "crashKey string, n long")


def read_http_archive(spark, sf_dir):
    return documents.http_archive(read(spark, sf_dir, ARCHIVES))


def openapi_json_routes(spark, sf_dir):
    return documents.openapi_routes(read(spark, sf_dir, APIS), "id")


def clean_model_json(spark, sf_dir):
    found = documents.model_json(F.col("text"))
    return read(spark, sf_dir, ANSWERS).select("event_id", F.from_json(found, "v long")["v"].alias("v"))


def dependency_scan(spark, sf_dir):
    return manifests.dependencies(read(spark, sf_dir, MANIFESTS))


def route_scan(spark, sf_dir):
    return manifests.routes(read(spark, sf_dir, DECLARED))


QUERIES = {q.__name__: q for q in (read_scanner_json, read_jsonl_tolerant, read_http_archive, openapi_json_routes, clean_model_json, dependency_scan, route_scan)}

ORACLE_SQL = {
    "read_scanner_json": """WITH r AS (SELECT event_type AS rule_id, CASE event_id % 2 WHEN 0 THEN 'ERROR' ELSE 'INFO' END AS severity, CASE event_id % 2 WHEN 0 THEN 'm' ELSE '' END AS message, concat('f', user_id, '.c') AS file_path, event_id % 90 + 1 AS start_line, event_id % 90 + 1 AS end_line FROM events UNION ALL SELECT 'x', 'INFO', '', 'y.c', 3, 4 FROM events)
SELECT *, count(*) AS n FROM r GROUP BY ALL""",
    "read_jsonl_tolerant": "SELECT concat('c', user_id) AS crashKey, event_id AS n FROM events WHERE event_id % 10 <> 3",
    "read_http_archive": "SELECT CASE page_id % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS method, concat('/p', page_id) AS path, 'a,b' AS params, CASE page_id % 4 WHEN 1 THEN 't,u' WHEN 3 THEN '[1]' ELSE '' END AS body_params, page_id % 3 = 0 AS has_cookies FROM pages",
    "openapi_json_routes": "SELECT p_partkey AS id, 'GET' AS method, concat('/a/', p_partkey) AS path FROM part UNION ALL SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'POST' ELSE 'PUT' END, '/b' FROM part",
    "clean_model_json": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN event_id END AS v FROM events",
    "dependency_scan": sql(
        """WITH e AS (SELECT *, trim(text, ' ') AS t, CASE path WHEN 'package.json' THEN 'npm' WHEN 'go.mod' THEN 'go' WHEN 'x/requirements-dev.txt' THEN 'pypi' WHEN 'y/Cargo.toml' THEN 'crates' WHEN 'Gemfile' THEN 'rubygems' WHEN 'z/pom.xml' THEN 'maven' END AS ecosystem FROM m WHERE path <> 'README'),
h AS (SELECT *, CASE ecosystem WHEN 'npm' THEN CASE WHEN starts_with(t, '"dependencies"') THEN 'on' WHEN starts_with(t, '"devDependencies"') THEN 'dev' WHEN starts_with(t, '}') THEN 'off' END WHEN 'go' THEN CASE t WHEN 'require (' THEN 'on' WHEN ')' THEN 'off' END WHEN 'crates' THEN CASE WHEN ends_with(t, 'dependencies]') THEN 'on' WHEN starts_with(t, '[') THEN 'off' END END AS h FROM e),
s AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY repo, path ORDER BY line ROWS UNBOUNDED PRECEDING) AS state FROM h), i AS (SELECT *, coalesce(state IN ('on', 'dev'), false) AND h IS NULL AS inside FROM s),
n AS (SELECT *, CASE ecosystem WHEN 'npm' THEN CASE WHEN inside THEN regexp_extract(t, '^"([^"]+)"', 1) END WHEN 'pypi' THEN CASE WHEN starts_with(t, 'lib') THEN regexp_extract(t, '^(lib\\d+)', 1) END WHEN 'go' THEN CASE WHEN starts_with(t, 'require h') THEN split_part(t, ' ', 2) WHEN inside AND NOT starts_with(t, 'require') THEN split_part(t, ' ', 1) END
 WHEN 'crates' THEN CASE WHEN inside THEN split_part(t, ' ', 1) END WHEN 'rubygems' THEN regexp_extract(t, '^gem "([^"]+)"', 1) ELSE regexp_extract(t, '<artifactId>([^<]+)<', 1) END AS name FROM i),
k AS (SELECT * FROM n WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY line) <= 120), o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY repo, ecosystem, name ORDER BY path, line) = 1)
SELECT repo, ecosystem, name, path, line, coalesce(state = 'dev', false) AS dev FROM o QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path, line) <= 40""", m=MANIFESTS
    ),
    "route_scan": sql(
        """WITH r AS (SELECT repo, CASE WHEN line % 6 IN (0, 3, 4) THEN 'http' WHEN line % 6 = 1 THEN 'flask' WHEN line % 6 = 2 THEN 'spring' WHEN starts_with(text, 'path') THEN 'django' WHEN starts_with(text, 'get') THEN 'rails' ELSE 'go-http' END AS framework,
 CASE line % 6 WHEN 0 THEN 'GET' WHEN 1 THEN CASE WHEN contains(text, 'PUT') THEN 'PUT' ELSE 'GET' END WHEN 2 THEN 'POST' WHEN 3 THEN 'DELETE' WHEN 4 THEN 'ANY' ELSE CASE WHEN starts_with(text, 'get') THEN 'GET' ELSE 'ANY' END END AS method, coalesce(nullif(regexp_extract(text, '"([^"]*)"', 1), ''), '/') AS route, path, line FROM d WHERE text <> 'nothing')
SELECT * FROM (SELECT DISTINCT * FROM r) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path, line, method, route) <= 300""", d=DECLARED
    ),
}
