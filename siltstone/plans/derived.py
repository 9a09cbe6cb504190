"""Tables of findings, votes, symbols and the like, derived from the given tables.

Each is one SELECT that Spark and DuckDB both understand, so that a query and its
SQL start from the same rows.  ``{name}`` stands for a given table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: One finding a line item.
FINDINGS = """
SELECT concat('r', CAST(l_suppkey % 5 AS STRING)) AS repo,
 concat('f', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING)) AS fingerprint,
 CASE l_linenumber % 6 WHEN 0 THEN 'deep-scan' WHEN 1 THEN 'sast' WHEN 2 THEN 'variant-hunt' WHEN 3 THEN 'systems-hunt' WHEN 4 THEN 'logic-hunt' ELSE 'binary-recon' END AS source,
 concat('REF-', CAST(l_partkey AS STRING)) AS ref_id,
 concat('  finding  ', CAST(l_orderkey AS STRING), '  in part ', CAST(l_partkey AS STRING)) AS title,
 CASE CAST(l_quantity AS BIGINT) % 8 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'info' WHEN 5 THEN 'none' WHEN 6 THEN 'odd' END AS severity,
 CASE l_partkey % 5 WHEN 0 THEN 'CWE-79' WHEN 1 THEN '89' WHEN 2 THEN 'CWE-787: write' WHEN 3 THEN '' ELSE 'cwe_416' END AS cwe,
 CASE l_suppkey % 5 WHEN 0 THEN 'exploitable' WHEN 1 THEN 'finding' WHEN 2 THEN 'candidate' WHEN 3 THEN 'rejected' ELSE 'likely-library-noise' END AS verdict,
 CASE CAST(l_quantity AS BIGINT) % 11 WHEN 0 THEN 'lead' WHEN 1 THEN 'candidate' WHEN 2 THEN 'open' WHEN 3 THEN 'needs-evidence' WHEN 4 THEN 'needs-trace' WHEN 5 THEN 'confirmed' WHEN 6 THEN 'proven' WHEN 7 THEN 'patched' WHEN 8 THEN 'remediated' WHEN 9 THEN 'reviewed' ELSE 'noise' END AS status,
 CASE (CAST(l_quantity AS BIGINT) + l_linenumber) % 10 WHEN 0 THEN 'lead' WHEN 1 THEN 'candidate' WHEN 2 THEN 'open' WHEN 3 THEN 'reachable' WHEN 4 THEN 'trigger-built' WHEN 5 THEN 'confirmed' WHEN 6 THEN 'proven' WHEN 7 THEN 'patch-planned' WHEN 8 THEN 'patch-validated' END AS proof_state,
 CASE l_partkey % 11 WHEN 0 THEN 'unauth' WHEN 1 THEN 'pre-auth' WHEN 2 THEN 'public' WHEN 3 THEN 'cross-tenant' WHEN 4 THEN 'tenant' WHEN 5 THEN 'authenticated' WHEN 6 THEN 'adjacent' WHEN 7 THEN 'local' WHEN 8 THEN 'internal' WHEN 9 THEN 'unknown' END AS exposure,
 concat('src/m', CAST(l_partkey % 7 AS STRING), '/p', CAST(l_partkey AS STRING), CASE l_partkey % 4 WHEN 0 THEN '.c' WHEN 1 THEN '.py' WHEN 2 THEN '.js' ELSE '.rs' END) AS file_path,
 CAST(l_quantity AS BIGINT) AS start_line,
 CASE l_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS entry_reachable,
 l_orderkey % 40 AS caller_count,
 CASE l_suppkey % 4 WHEN 0 THEN 'confirmed-exploitable' WHEN 1 THEN 'not-exploitable' WHEN 2 THEN 'inconclusive' END AS verify_verdict,
 CASE l_orderkey % 3 WHEN 0 THEN 'exploited' WHEN 1 THEN 'not-reproduced' END AS poc_verdict,
 CASE l_orderkey % 4 WHEN 0 THEN 'validated' WHEN 1 THEN 'failed' END AS fix_verdict,
 CASE WHEN l_linenumber <= 2 THEN concat('C', CAST(l_orderkey AS STRING)) END AS chain,
 CASE l_partkey % 6 WHEN 0 THEN NULL ELSE concat('p', CAST(l_partkey AS STRING), '#fn', CAST(l_linenumber % 3 AS STRING)) END AS fn_key,
 l_orderkey AS batch, l_linenumber * 100000000 + l_partkey * 1000 + CAST(l_quantity AS BIGINT) AS ord
FROM {lineitem}
"""

#: One vote a line item, several an order.
VOTES = """
SELECT concat('r', CAST(l_orderkey % 5 AS STRING)) AS repo, concat('v', CAST(l_orderkey AS STRING)) AS fingerprint,
 concat('lens', CAST(l_linenumber AS STRING)) AS lens, l_partkey * 1000 + CAST(l_quantity AS BIGINT) * 10 + l_linenumber AS ord,
 CASE CAST(l_quantity AS BIGINT) % 5 WHEN 0 THEN 'confirmed-exploitable' WHEN 1 THEN 'confirmed-exploitable' WHEN 2 THEN 'not-exploitable' WHEN 3 THEN 'inconclusive' ELSE 'bogus' END AS verdict,
 CASE WHEN l_linenumber % 7 = 6 THEN NULL ELSE CAST(floor(l_tax * 100 + 0.5) AS DOUBLE) / 8 END AS confidence,
 l_suppkey % 3 = 0 AS has_trigger,
 CASE l_partkey % 4 WHEN 0 THEN 'test-only' WHEN 1 THEN 'self-inflicted' WHEN 2 THEN ' ' END AS exclusion_rule,
 CASE l_partkey % 3 WHEN 0 THEN 'unreachable' WHEN 1 THEN 'sanitized' END AS refute_reason
FROM {lineitem}
"""

#: One symbol a part.
SYMBOLS = """
SELECT concat('r', CAST(p_partkey % 5 AS STRING)) AS repo, concat('fn', CAST(p_partkey % 97 AS STRING)) AS name,
 concat('src/m', CAST(p_partkey % 7 AS STRING), '/p', CAST(p_partkey % 60 AS STRING), '.c') AS file_path,
 CAST(p_size AS BIGINT) AS line, CAST(floor(p_retailprice) AS BIGINT) % 50 AS caller_count
FROM {part}
"""

#: One anchor a line item, in the files of SYMBOLS.
ANCHORS = """
SELECT concat('r', CAST(l_partkey % 5 AS STRING)) AS repo, concat('f', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING)) AS fingerprint,
 concat('src/m', CAST(l_partkey % 7 AS STRING), '/p', CAST(l_partkey % 60 AS STRING), CASE WHEN l_linenumber = 7 THEN '.h' ELSE '.c' END) AS file_path,
 CAST(l_quantity AS BIGINT) AS line
FROM {lineitem}
"""

#: Expected findings of a benchmark, vulnerable and safe.
TRUTH = """
SELECT concat('case', CAST(o_orderkey % 9 AS STRING)) AS case_id, concat('e', CAST(o_orderkey AS STRING)) AS id,
 CASE WHEN o_orderstatus = 'O' THEN 'vuln' WHEN o_orderkey % 3 = 0 THEN 'safe' ELSE 'vuln' END AS kind,
 CASE o_orderkey % 3 WHEN 0 THEN 'CWE-79' WHEN 1 THEN '89' END AS cwe,
 concat('p', CAST(o_custkey % 500 AS STRING), '.c') AS file_path,
 CASE o_orderkey % 5 WHEN 0 THEN 0 ELSE o_custkey % 300 END AS line
FROM {orders}
"""

#: What a review found of TRUTH.
ACTUAL = """
SELECT concat('case', CAST(l_orderkey % 9 AS STRING)) AS case_id, concat('f', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING)) AS fingerprint,
 CASE CAST(l_quantity AS BIGINT) % 6 WHEN 0 THEN 'proven' WHEN 1 THEN 'noise' WHEN 2 THEN 'reviewed' WHEN 3 THEN 'remediated' ELSE 'open' END AS status,
 CASE l_partkey % 4 WHEN 0 THEN 'CWE-79' WHEN 1 THEN 'CWE-89' WHEN 2 THEN '' END AS cwe,
 concat(CASE l_linenumber % 2 WHEN 0 THEN '/work/target/src/' ELSE '' END, 'p', CAST(l_partkey % 500 AS STRING), '.c') AS file_path,
 l_suppkey * 7 % 300 AS line
FROM {lineitem}
"""

#: One proof run a line item.
RUNS = """
SELECT concat('f', CAST(l_orderkey AS STRING)) AS finding, CASE WHEN l_linenumber % 4 = 0 THEN 'benign' ELSE 'attack' END AS role, l_partkey * 1000 + CAST(l_quantity AS BIGINT) * 10 + l_linenumber AS run_no,
 CASE CAST(l_quantity AS BIGINT) % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 139 WHEN 3 THEN 134 WHEN 4 THEN 2 END AS exit_code,
 CASE l_partkey % 13 WHEN 0 THEN 'SIGSEGV' END AS signal, l_partkey % 17 = 0 AS timed_out, l_suppkey % 9 = 8 AS skipped,
 CASE l_partkey % 5 WHEN 0 THEN 'ERROR: AddressSanitizer: heap-buffer-overflow' WHEN 1 THEN 'error: undefined reference to main' WHEN 2 THEN 'all good' WHEN 3 THEN '' END AS output
FROM {lineitem}
"""

#: Crash records, one an event.
CRASHES = """
SELECT concat('c', CAST(user_id AS STRING), ':', event_type) AS crash_key, concat('f', CAST(event_id AS STRING)) AS fingerprint, concat('CWE-', CAST(user_id % 7 + 120 AS STRING)) AS cwe, event_type AS source, ts AS seen_at
FROM {events}
"""

#: Source files, one a document.
FILES = """
SELECT source AS repo,
 concat(CASE doc_id % 3 WHEN 0 THEN './' ELSE '' END, CASE doc_id % 4 WHEN 0 THEN 'src/' WHEN 1 THEN 'packages/lib/' WHEN 2 THEN '' ELSE 'app/' END, lang, '/d', CAST(doc_id % 50 AS STRING), '/f', CAST(doc_id AS STRING),
  CASE doc_id % 9 WHEN 0 THEN '.c' WHEN 1 THEN '.py' WHEN 2 THEN '.ts' WHEN 3 THEN '.go' WHEN 4 THEN '.h' WHEN 5 THEN '.md' WHEN 6 THEN '.rs' WHEN 7 THEN '.min.js' ELSE '.java' END) AS path,
 text AS content, n_chars AS bytes, doc_id
FROM {documents}
"""

#: HTTP requests, one a page.
REQUESTS = """
SELECT concat('r', CAST(page_id % 4 AS STRING)) AS repo, CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'post' ELSE 'PUT' END AS method,
 concat(CASE page_id % 2 WHEN 0 THEN 'https://h.example' ELSE '' END, '/api/u', CAST(page_id % 20 AS STRING), '/x?a=', CAST(page_id AS STRING), CASE page_id % 5 WHEN 0 THEN '' ELSE '&b=2' END) AS url,
 page_id % 7 = 0 AS has_cookies
FROM {pages}
"""


def given(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def read(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The derived table's rows."""
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in given(text)})


def sql(body: str, **tables: str) -> str:
    """``body`` over derived tables, for an engine in which the given tables have their names."""
    parts = [f"{name} AS ({text.format(**{t: t for t in given(text)})})" for name, text in tables.items()]
    lead = "WITH RECURSIVE " if body.lstrip().startswith("RECURSIVE") else "WITH "
    body = body.lstrip().removeprefix("RECURSIVE")
    if body.lstrip().startswith("WITH "):
        return lead + ", ".join(parts) + ", " + body.lstrip()[5:]
    return lead + ", ".join(parts) + " " + body
