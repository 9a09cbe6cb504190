"""Lines of source files: statements of many kinds from the line items, and the lines of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.derived import read, sql
from siltstone.sources.files import numbered_lines

#: Source lines, one a line item: a file an order, with statements of many kinds.
CODE = """
SELECT concat('r', CAST(l_orderkey % 3 AS STRING)) AS repo,
 concat(CASE l_orderkey % 6 WHEN 0 THEN 'src/test/' ELSE 'src/' END, 'o', CAST(l_orderkey AS STRING), CASE l_orderkey % 4 WHEN 0 THEN '.c' WHEN 1 THEN '.py' WHEN 2 THEN '.go' ELSE '.js' END) AS path,
 l_partkey * 1000 + CAST(l_quantity AS BIGINT) * 10 + l_linenumber AS line,
 concat(CASE l_partkey % 7 WHEN 0 THEN '  ' WHEN 1 THEN '// ' ELSE '' END, CASE l_suppkey * 31 % 29 + CAST(l_quantity AS BIGINT) % 3
 WHEN 0 THEN 'memcpy(dst, src, n);' WHEN 1 THEN 'if (token == secret) return;' WHEN 2 THEN 'char buf [LIMIT];' WHEN 3 THEN 'p = malloc(n * size);' WHEN 4 THEN 'free(p);' WHEN 5 THEN 'os.system(cmd)'
 WHEN 6 THEN 'cursor.execute(sql)' WHEN 7 THEN 'requests.get(url)' WHEN 8 THEN 'x = findById(req.params.id)' WHEN 9 THEN 'import os' WHEN 10 THEN '@app.route(x)' WHEN 11 THEN 'h = MD5(data)'
 WHEN 12 THEN 'verify = False' WHEN 13 THEN 'balance = Amount - refund' WHEN 14 THEN 'status = paid' WHEN 15 THEN 'commit' WHEN 16 THEN 'if (user_id != owner) stop' WHEN 17 THEN 'if (!exists) create' WHEN 18 THEN 'nonce once'
 WHEN 19 THEN 'memset(key, 0)' WHEN 20 THEN 'salt = rand ()' WHEN 21 THEN 'Runtime.exec(x)' WHEN 22 THEN 'private native  int f();' WHEN 23 THEN 'pickle.loads(b)' WHEN 24 THEN 'res.redirect(u)' WHEN 25 THEN 'MEMCMP (a, b)' WHEN 26 THEN '' ELSE 'x = y + 1' END) AS text
FROM {lineitem}
"""

#: More source lines, one a line item: handlers, configuration, build files, harnesses and tables of handlers.
MORE = """
SELECT concat('r', CAST(l_orderkey % 3 AS STRING)) AS repo,
 CASE l_orderkey % 12 WHEN 0 THEN concat('lib/o', CAST(l_orderkey AS STRING), '/Makefile') WHEN 1 THEN concat('lib/o', CAST(l_orderkey AS STRING), '/Dockerfile') WHEN 2 THEN concat('lib/o', CAST(l_orderkey AS STRING), '.yml') WHEN 3 THEN concat('lib/o', CAST(l_orderkey AS STRING), '.tf')
 ELSE concat(CASE l_orderkey % 5 WHEN 0 THEN 'lib/services/paypal/o' WHEN 1 THEN 'lib/test/o' WHEN 2 THEN 'lib/parser/o' ELSE 'lib/o' END, CAST(l_orderkey AS STRING), CASE l_orderkey % 12 WHEN 4 THEN '.c' WHEN 5 THEN '.h' WHEN 6 THEN '.py' WHEN 7 THEN '.go' WHEN 8 THEN '.rb' WHEN 9 THEN '.java' WHEN 10 THEN '.ts' ELSE '.js' END) END AS path,
 l_partkey * 1000 + CAST(l_quantity AS BIGINT) * 10 + l_linenumber AS line,
 CASE (l_partkey * 7 + l_suppkey + l_linenumber) % 62
 WHEN 0 THEN 'public class Pay extends Activity {{' WHEN 1 THEN 'view.loadUrl(redirectUri)' WHEN 2 THEN 'val c = OkHttpClient()' WHEN 3 THEN 'System.loadLibrary(x)' WHEN 4 THEN 'class UserController < Base' WHEN 5 THEN 'app.get("/users/:id", show)'
 WHEN 6 THEN '@Get("list")' WHEN 7 THEN '@bp.route("/x")' WHEN 8 THEN '@router.post("/items")' WHEN 9 THEN '@GetMapping("/all")' WHEN 10 THEN 'mux.HandleFunc("/x", serve)' WHEN 11 THEN 'resources :orders' WHEN 12 THEN '[HttpGet("id")]' WHEN 13 THEN '@app.get("/fast")'
 WHEN 14 THEN 'privileged: true' WHEN 15 THEN 'USER root' WHEN 16 THEN 'FROM base:latest' WHEN 17 THEN 'password: "hunter22"' WHEN 18 THEN 'cidr = "0.0.0.0/0"' WHEN 19 THEN 'acl = "public-read"' WHEN 20 THEN 'sslmode=disable' WHEN 21 THEN 'force_destroy = true'
 WHEN 22 THEN 'CFLAGS += -fstack-protector-strong -fPIE' WHEN 23 THEN 'LDFLAGS += -Wl,-z,relro' WHEN 24 THEN 'CFLAGS += -D_FORTIFY_SOURCE=2' WHEN 25 THEN 'link /guard:cf' WHEN 26 THEN 'LDFLAGS += -z noexecstack' WHEN 27 THEN 'all: build'
 WHEN 28 THEN 'int LLVMFuzzerTestOneInput(const uint8_t *d, size_t n) {{' WHEN 29 THEN 'fuzz_target! (|data: &[u8]| {{' WHEN 30 THEN 'func FuzzParse(f *testing.F) {{' WHEN 31 THEN '@FuzzTest' WHEN 32 THEN 'int main(int argc, char **argv) {{' WHEN 33 THEN 'fd = accept(s, 0, 0);'
 WHEN 34 THEN 'http.ListenAndServe(addr, nil)' WHEN 35 THEN 'data = req.body.name' WHEN 36 THEN 'q = request.args' WHEN 37 THEN 'h := r.Header' WHEN 38 THEN 'x = params[id]' WHEN 39 THEN 's = request.getParameter(n)' WHEN 40 THEN 'child_process.exec(cmd)' WHEN 41 THEN 'subprocess.run(args)'
 WHEN 42 THEN 'exec.Command(name)' WHEN 43 THEN 'system(cmd)' WHEN 44 THEN 'ProcessBuilder.start(x)' WHEN 45 THEN 'csrf = false' WHEN 46 THEN 'except: pass' WHEN 47 THEN 'if user.role == "admin"' WHEN 48 THEN 'luaL_Reg funcs[] = {{' WHEN 49 THEN '{{ "get", getCommand }},'
 WHEN 50 THEN 'register_handler("set", setCommand)' WHEN 51 THEN 'MAKE_CMD("del", 2, delCommand, 0)' WHEN 52 THEN 'void getCommand(client *c) {{' WHEN 53 THEN 'void setCommand(client *c) {{' WHEN 54 THEN 'def handle_login(user):' WHEN 55 THEN 'free(node);' WHEN 56 THEN 'node = node + 1;'
 WHEN 57 THEN 'n = atoi(argv)' WHEN 58 THEN 'buf = malloc(n)' WHEN 59 THEN 'w = len - 2 * sep' WHEN 60 THEN 'lua_newtable(L);' ELSE 'return 0;' END AS text
FROM {lineitem}
"""

_SQL = """RECURSIVE WITH doc_lines AS (SELECT source AS repo, concat('docs/d', doc_id, CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.rb' ELSE '.c' END) AS path, unnest(range(1, len(a) + 1)) AS line, unnest(a) AS text
 FROM (SELECT source, doc_id, regexp_split_to_array(text, '\\r?\\n') AS a FROM documents WHERE text IS NOT NULL)),
code AS (SELECT repo, path, line, text FROM code1 UNION ALL SELECT repo, path, line, text FROM code2 UNION ALL SELECT repo, path, line, text FROM doc_lines)"""


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, path, line, text``: CODE, MORE and the documents' lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kind = F.when(F.col("doc_id") % 4 == 0, ".py").when(F.col("doc_id") % 4 == 1, ".js").when(F.col("doc_id") % 4 == 2, ".rb").otherwise(".c")
    files = docs.select(F.col("source").alias("repo"), F.concat(F.lit("docs/d"), F.col("doc_id").cast("string"), kind).alias("path"), F.col("text").alias("content"))
    return read(spark, sf_dir, CODE).union(read(spark, sf_dir, MORE)).union(numbered_lines(files).select("repo", "path", F.col("line").cast("long"), "text"))


def code_sql(body: str, **tables: str) -> str:
    """SQL over those lines, as the table ``code``, and over derived tables."""
    body = body.lstrip()
    rest = ", " + body[5:] if body.startswith("WITH ") else " " + body
    return sql(_SQL + rest, code1=CODE, code2=MORE, **tables)
