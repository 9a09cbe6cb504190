"""Derived threats, leads, invariants and review drafts."""

#: Threats, one a part.
THREATS = """
SELECT concat('r', CAST(p_partkey % 3 AS STRING)) AS repo, concat('t', CAST(p_partkey AS STRING)) AS id, p_name AS title,
 CASE p_size % 5 WHEN 0 THEN 'CRITICAL: full takeover' WHEN 1 THEN 'medium-high risk' WHEN 2 THEN 'Low' WHEN 3 THEN 'a HIGH loss' ELSE 'unclear' END AS impact,
 CASE p_partkey % 8 WHEN 0 THEN 'Spoofing' WHEN 1 THEN 'tampering ' WHEN 2 THEN 'REPUDIATION' WHEN 3 THEN 'Information Disclosure' WHEN 4 THEN 'denial_of_service' WHEN 5 THEN 'elevation of_privilege' WHEN 6 THEN 'other' END AS stride,
 CASE p_size % 7 WHEN 0 THEN 'CWE-79' WHEN 1 THEN 'cwe_89' WHEN 2 THEN '787' WHEN 3 THEN 'CWE-22' WHEN 4 THEN '' END AS cwe, CAST(p_size AS DOUBLE) / 50 AS probability
FROM {part}
"""

#: Leads of known weaknesses, one a supplier.
LEADS = """
SELECT concat('r', CAST(s_suppkey % 3 AS STRING)) AS repo, CASE s_suppkey % 4 WHEN 0 THEN ' ' ELSE concat('L', CAST(s_suppkey AS STRING)) END AS own_id, CASE s_suppkey % 3 WHEN 0 THEN '' ELSE concat('CVE-', CAST(s_suppkey AS STRING)) END AS cve, s_name AS title,
 concat('x', CAST(s_suppkey AS STRING)) AS id, CASE s_suppkey % 5 WHEN 0 THEN ' Critical' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'medium' WHEN 3 THEN 'high ' END AS severity,
 CASE s_nationkey % 4 WHEN 0 THEN 'CWE-79' WHEN 1 THEN 'CWE-89' WHEN 2 THEN '' ELSE 'CWE-787' END AS cwe, CASE s_nationkey % 2 WHEN 0 THEN 'stack' ELSE 'similar-app' END AS origin
FROM {supplier}
"""

#: Invariants of the code, one a part.
INVARIANTS = """
SELECT concat('r', CAST(p_partkey % 3 AS STRING)) AS repo, concat('inv', CAST(p_partkey AS STRING)) AS id, p_size % 7 AS ord,
 CASE p_size % 5 WHEN 0 THEN ' HOLD' WHEN 1 THEN 'violated' WHEN 2 THEN 'needs_review' WHEN 3 THEN 'maybe' END AS verdict,
 CASE p_partkey % 6 WHEN 0 THEN 'memcpy(' WHEN 1 THEN 'system(' WHEN 2 THEN 'cursor.execute' WHEN 3 THEN 'free(' WHEN 4 THEN 'params[' ELSE 'request.args' END AS signal,
 CASE p_partkey % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'python' WHEN 2 THEN 'javascript' END AS language,
 CASE p_partkey % 3 WHEN 0 THEN 'CWE-79' WHEN 1 THEN 'CWE-89' ELSE 'CWE-787' END AS cwe
FROM {part}
"""

#: Drafts of reviews, one a document, whose rationale is its text.
DRAFTS = """
SELECT source AS repo, concat('d', CAST(doc_id AS STRING)) AS id, text AS rationale,
 CASE doc_id % 12 WHEN 0 THEN 'exploitable' WHEN 1 THEN 'likely-library-noise' WHEN 2 THEN 'reviewed-no-impact' WHEN 3 THEN 'needs-more-evidence' WHEN 4 THEN 'needs-active-agent-trace' WHEN 5 THEN 'finding' WHEN 6 THEN 'candidate' WHEN 7 THEN 'rejected'
 WHEN 8 THEN 'confirmed-exploitable' WHEN 9 THEN 'not-exploitable' WHEN 10 THEN 'violation' END AS verdict,
 CASE doc_id % 8 WHEN 0 THEN 'sast' WHEN 1 THEN 'iac' WHEN 2 THEN 'crypto-review' WHEN 3 THEN 'sharp-edges' WHEN 4 THEN 'authz' WHEN 5 THEN 'binary-recon' WHEN 6 THEN 'logic-hunt' ELSE 'traffic-map' END AS source,
 CASE doc_id % 7 WHEN 0 THEN 'secrets' WHEN 1 THEN 'weak-crypto-rng' WHEN 2 THEN 'idor' WHEN 3 THEN 'hardening-gap' WHEN 4 THEN 'atomicity' WHEN 5 THEN 'algorithm-selection' END AS kind,
 CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('CWE-', CAST(doc_id % 900 AS STRING)) END AS cwe,
 CASE doc_id % 4 WHEN 0 THEN 'crash-only' WHEN 1 THEN 'likely-code-exec' WHEN 2 THEN 'info-leak' ELSE 'needs-more-evidence' END AS tier,
 substr(text, 1, CAST(doc_id % 97 AS INT)) AS self_check, substr(text, 2, CAST(doc_id % 41 AS INT)) AS remedy, substr(text, 3, CAST(doc_id % 83 AS INT)) AS advocate,
 CAST(doc_id % 3 AS INT) AS anchors, CAST(doc_id % 4 AS INT) AS hops, CAST(doc_id % 3 + 1 AS INT) AS files, doc_id % 2 = 0 AS sketch
FROM {documents}
"""
