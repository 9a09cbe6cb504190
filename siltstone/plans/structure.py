"""Queries of code structure and of streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import code, spans, stores, surface
from siltstone.plans.derived import read, sql
from siltstone.streaming import crashes

#: Fourteen lines an order, in a file a customer: nested functions in braces or by indentation, and calls after them.
NESTED = """
SELECT concat('r', CAST(o_custkey % 3 AS STRING)) AS repo, concat('c', CAST(o_custkey AS STRING), CASE o_custkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.rb' WHEN 2 THEN '.c' ELSE '.js' END) AS path, o_orderkey * 20 + i AS line,
 CASE WHEN o_custkey % 4 < 2 THEN
  CASE i WHEN 0 THEN concat('class C', CAST(o_custkey % 50 AS STRING), ':') WHEN 1 THEN concat('    def m', CAST(o_orderkey % 5 AS STRING), '(self, a):') WHEN 2 THEN concat('        gg(a, m', CAST(o_orderkey % 3 AS STRING), '(a))') WHEN 4 THEN '        def inner(b):' WHEN 5 THEN '            hh(b)'
  WHEN 6 THEN '        late(a)' WHEN 7 THEN '    async def wait(self):' WHEN 8 THEN '        kk()' WHEN 9 THEN '    attr = ff()' WHEN 10 THEN 'top(a)' WHEN 11 THEN concat('def flat', CAST(o_orderkey % 7 AS STRING), '(a):') WHEN 12 THEN '    return tail(a)' ELSE '' END
 ELSE CASE i WHEN 0 THEN concat('int f', CAST(o_custkey % 50 AS STRING), '(int a)', CASE o_orderkey % 3 WHEN 0 THEN '' ELSE ' {{' END) WHEN 1 THEN CASE o_orderkey % 3 WHEN 0 THEN '{{' ELSE '' END WHEN 2 THEN '  if (a) {{' WHEN 3 THEN concat('    gg(a, f', CAST((o_custkey * 3 + o_orderkey) % 50 AS STRING), '(a));') WHEN 4 THEN '    function inner(b) {{'
  WHEN 5 THEN '      hh(b);' WHEN 6 THEN CASE o_orderkey % 5 WHEN 0 THEN '      gg(b); }} else {{' ELSE '    }}' END WHEN 7 THEN '    late(a);' WHEN 8 THEN CASE o_orderkey % 5 WHEN 0 THEN '  }} }}' ELSE '  }}' END WHEN 9 THEN '  while (hh()) {{ kk(); }}' WHEN 10 THEN CASE o_orderkey % 11 WHEN 0 THEN '' ELSE '}}' END WHEN 11 THEN 'top(a);' ELSE '' END END AS text
FROM {orders} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9 UNION ALL SELECT 10 UNION ALL SELECT 11 UNION ALL SELECT 12 UNION ALL SELECT 13) n
"""

#: Marker files, one a part.
MARKED = """
SELECT concat('r', CAST(p_partkey % 3 AS STRING)) AS repo, concat('m', CAST(p_partkey % 40 AS STRING), '/', CASE p_size % 5 WHEN 0 THEN 'package.json' WHEN 1 THEN 'go.mod' WHEN 2 THEN 'Dockerfile' WHEN 3 THEN 'notes.md' ELSE 'pom.xml' END) AS path
FROM {part}
"""


def enclosing_block(spark, sf_dir):
    """The enclosing block of every line that calls something."""
    lines = read(spark, sf_dir, NESTED)
    return spans.enclosing(lines.filter(F.col("text").contains("(")).select("repo", "path", "line"), lines)


def block_callees(spark, sf_dir):
    return code.block_calls(read(spark, sf_dir, NESTED))


def call_edges(spark, sf_dir):
    lines = read(spark, sf_dir, NESTED)
    blocks = stores.written(spans.all_spans(lines), "blocks")
    return code.call_edges(code.block_calls(lines, spans=blocks), blocks.select("repo", "path", F.col("start").alias("line"), F.col("block").alias("name")))


def component_markers(spark, sf_dir):
    return surface.component_markers(read(spark, sf_dir, MARKED))


def dropped_ledger_stream(spark, sf_dir):
    """The event log as a ledger of dropped candidates, read as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    rows = stream.select(F.when(F.col("user_id") % 2 == 0, F.col("event_type")).alias("source"), F.lit(" ").alias("stage"), F.col("event_id").cast("string").alias("id"), F.lit(None).cast("string").alias("verdict"), F.when(F.col("user_id") % 3 == 0, F.lit("old")).alias("reason"))
    base = stores.shared(spark, "stream")
    return crashes.run_once(crashes.dropped_ledger(rows), f"{base}/rows", f"{base}/progress")


QUERIES = {q.__name__: q for q in (enclosing_block, block_callees, call_edges, component_markers, dropped_ledger_stream)}



def _has(pattern: str, of: str) -> str:
    return f"regexp_matches({of}, '{pattern}')"


#: Blocks ``s_all`` (repo, path, start, end, block) of the lines of a table, each found by itself, without an order of the lines.
_SPANS = f"""s_n AS (SELECT repo, path, line, text, lag(line) OVER w AS pl, lag(text) OVER w AS pt, length(replace(text, '}}', '')) - length(replace(text, '{{', '')) AS own FROM SRC WHERE {_has(spans.BRACE_FILES, "path")} WINDOW w AS (PARTITION BY repo, path ORDER BY line)),
s_a AS (SELECT *, sum(own) OVER (PARTITION BY repo, path ORDER BY line) AS after FROM s_n),
s_l AS (SELECT *, trim(text, ' ') = '{{' AND coalesce({_has(chr(92) + ")" + chr(92) + "s*$", "pt")}, false) AS led FROM s_a WHERE own > 0),
s_h AS (SELECT repo, path, line, CASE WHEN led THEN pl ELSE line END AS start, after - own AS depth, CASE WHEN led THEN pt ELSE text END AS header FROM s_l),
s_b AS (SELECT h.repo, h.path, h.start, min(a.line) AS stop, h.header FROM s_h h LEFT JOIN s_a a ON a.repo = h.repo AND a.path = h.path AND a.line > h.line AND a.after <= h.depth WHERE {_has(spans.HEADER, "h.header")} AND NOT {_has(spans.CONTROL, "h.header")} GROUP BY ALL),
s_i AS (SELECT repo, path, line, text, length(regexp_extract(text, '^[ \\t]*')) AS ind FROM SRC WHERE {_has(spans.INDENT_FILES, "path")}),
s_j AS (SELECT h.repo, h.path, h.line AS start, h.text AS header, min(n.line) AS next FROM s_i h LEFT JOIN s_i n ON n.repo = h.repo AND n.path = h.path AND n.line > h.line AND n.ind <= h.ind AND trim(n.text, ' ') <> '' WHERE {_has(spans.INDENT_HEADER, "h.text")} GROUP BY ALL),
s_k AS (SELECT j.repo, j.path, j.start, max(n.line) AS stop, j.header FROM s_j j JOIN s_i n ON n.repo = j.repo AND n.path = j.path AND (j.next IS NULL OR n.line < j.next) GROUP BY ALL),
s_all AS (SELECT repo, path, start, stop, coalesce(nullif(regexp_extract(header, '\\b(?:function|func|def|fn|sub|class|interface|impl|trait|struct|enum)\\s+([A-Za-z_]\\w*)', 1), ''), regexp_extract(header, '([A-Za-z_]\\w*)\\s*\\(', 1)) AS block FROM (SELECT * FROM s_b UNION ALL SELECT * FROM s_k))"""


def spans_sql(table: str) -> str:
    return _SPANS.replace("SRC", table)


def inside_sql(points: str, columns: str) -> str:
    """The points beside their innermost block's start, stop and name."""
    named = ", ".join(f"p.{c}" for c in columns.split(", "))
    return f"SELECT {columns}, o.start AS start, o.stop AS stop, o.block AS block FROM (SELECT {named}, arg_max({{'start': s.start, 'stop': s.stop, 'block': s.block}}, s.start) FILTER (s.start IS NOT NULL) AS o FROM {points} p LEFT JOIN s_all s ON s.repo = p.repo AND s.path = p.path AND s.start <= p.line AND (s.stop IS NULL OR s.stop >= p.line) GROUP BY ALL)"


def enclosing_sql(points: str, columns: str, table: str) -> str:
    """The points' first and last line of the enclosing block, or of what lies around."""
    m, r = spans.MOST, spans.AROUND
    return f"""x_i AS ({inside_sql(points, columns)}), x_f AS (SELECT repo, path, min(line) AS low, max(line) AS high FROM {table} GROUP BY ALL),
x_g AS (SELECT *, coalesce(stop IS NOT NULL AND line - start <= {m} AND (NOT {_has(spans.BRACE_FILES, "path")} OR stop - start <= {m}), false) AS found, least(stop, start + {m}) AS fin FROM x_i JOIN x_f USING (repo, path)),
x_h AS (SELECT *, CASE WHEN NOT found THEN greatest(low, line - {r}) WHEN fin - start + 1 > {m} THEN greatest(start, line - {m // 4}) ELSE start END AS first FROM x_g),
x AS (SELECT {columns}, first, CASE WHEN NOT found THEN least(high, line + {r}) WHEN fin - start + 1 > {m} THEN least(high, first + {m - 1}) ELSE fin END AS last, found FROM x_h)"""


_CALLS = f"""{spans_sql("f")},
c_s AS (SELECT repo, path, line, unnest(list_distinct(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]+)\\s*\\(', 1))) AS name FROM f WHERE contains(text, '(')),
c_n AS (SELECT * FROM c_s WHERE name NOT IN ('if', 'for', 'while', 'switch', 'return', 'catch', 'function', 'sizeof', 'def', 'class')),
c_i AS ({inside_sql("c_n", "repo, path, line, name")}),
c AS (SELECT repo, path, start, block, name, min(line) AS first, count(DISTINCT line) AS n FROM c_i WHERE stop IS NOT NULL AND name <> block GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo, path, start ORDER BY first, name) AS INTEGER) AS place FROM c QUALIFY place <= 40)"""

ORACLE_SQL = {
    "block_callees": sql(f"WITH {_CALLS} SELECT * FROM k", f=NESTED),
    "call_edges": sql(f"WITH {_CALLS}, d AS (SELECT repo, block AS name, path, start AS line FROM s_all QUALIFY row_number() OVER (PARTITION BY repo, block ORDER BY path, start) = 1), e AS (SELECT DISTINCT repo, block AS src, name FROM k) SELECT e.repo, src, e.name AS dst, d.path, d.line FROM e LEFT JOIN d ON e.repo = d.repo AND e.name = d.name", f=NESTED),
    "enclosing_block": sql(f"WITH {spans_sql('f')}, a AS (SELECT repo, path, line FROM f WHERE contains(text, '(')), {enclosing_sql('a', 'repo, path, line', 'f')} SELECT * FROM x", f=NESTED),
    "component_markers": sql(
        """WITH d AS (SELECT DISTINCT repo, path, split_part(path, '/', 2) AS marker FROM m WHERE NOT ends_with(path, '.md')), k AS (SELECT *, row_number() OVER (PARTITION BY repo, marker ORDER BY path) AS k FROM d)
SELECT repo, marker, CASE marker WHEN 'package.json' THEN 'node' WHEN 'go.mod' THEN 'go' WHEN 'Dockerfile' THEN 'container' ELSE 'java' END AS role, count(*) AS n, string_agg(path, ',' ORDER BY path) FILTER (k <= 5) AS first_paths FROM k GROUP BY ALL""", m=MARKED
    ),
    "dropped_ledger_stream": "SELECT CASE user_id % 2 WHEN 0 THEN event_type ELSE 'unknown' END AS source, 'finalize' AS stage, CAST(event_id AS VARCHAR) AS id, 'dropped' AS verdict, CASE user_id % 3 WHEN 0 THEN 'old' ELSE 'unspecified' END AS reason FROM events",
}
