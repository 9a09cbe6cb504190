"""Handlers, flows, gates, readers and stores on small fixtures."""

import uuid

import pytest
from pyspark.sql import functions as F

from siltstone.operators import benchmarks, code, dispatch, flows, gates, ranking, scan, stores, surface, threats
from siltstone.sources import documents
from siltstone.streaming import crashes

LINES = "repo string, path string, line long, text string"


def lines(spark, files):
    return spark.createDataFrame([("r", p, i + 1, t) for p, text in files.items() for i, t in enumerate(text.split("\n"))], LINES)


def test_handlers_of_tables_conventions_and_registrations(spark):
    files = {
        "t.c": 'struct cmd table[] = {\n  { "get", getCommand, 2 },\n  { "string", OBJ_ENCODING },\n  { "odd", luaB_odd },\n};',
        "impl.c": "void getCommand(client *c) {\nint luaB_odd(lua_State *L) {\nvoid plain(int a);",
        "impl.h": "void getCommand(client *c) {",
        "m.py": "def handle_login(user):\napp.add_command('x', run_it)\nregister_handler('go', goHandler)",
        "lua.c": "static const luaL_Reg funcs[] = {",
    }
    got = {(r["kind"], r["name"], r["handler"], r["def_path"]) for r in dispatch.handlers(lines(spark, files)).collect()}
    assert ("convention-def", "get", "getCommand", "impl.c") in got
    assert ("pointer-table", "odd", "luaB_odd", "impl.c") in got
    assert ("registration-call", "go", "goHandler", "m.py") in got
    assert ("convention-def", "login", "handle_login", "m.py") in got
    assert ("handler-table-decl", None, "table@lua.c:1", "lua.c") in got
    assert not any(h in ("OBJ_ENCODING", "run_it", "plain") for _, _, h, _ in got)
    words = [r["name"] for r in dispatch.vocabulary(dispatch.handlers(lines(spark, files))).collect()]
    assert sorted(words) == ["get", "go", "login", "odd"]


def test_flows_need_a_source_before_the_sink(spark):
    files = {"a.js": "x = req.body\ny = 1\ndb.execute(x)", "b.js": "db.execute(z)\nq = req.query", "c.js": "cp.exec(a)"}
    got = [(r["cwe"], r["path"], r["source_line"], r["sink_line"]) for r in flows.linked(flows.rule_hits(lines(spark, files)), lines(spark, files)).collect()]
    assert ("CWE-89", "a.js", 1, 3) in got and not any(p == "b.js" and c == "CWE-89" for c, p, _, _ in got)


def test_packs_look_into_their_files_only(spark):
    files = {"a.yml": "privileged: true", "a.py": "privileged: true", "Dockerfile": "USER root\nFROM x:latest", "x.tf": "acl = 'public-read'"}
    got = {(r["pattern"], r["path"]) for r in scan.pattern_scan(lines(spark, files), scan.PACKS["iac"]).collect()}
    assert got == {("container-privileged", "a.yml"), ("container-root", "Dockerfile"), ("image-unpinned", "Dockerfile"), ("storage-public", "x.tf")}


def test_obligations_take_the_first_rule(spark):
    files = {"a.c": "p = malloc(n * 2);\nw = buf[i * 4];\nluaS_newlstr(L);\nfree(p);\n// memcpy(a, b, c);", "b.py": "pickle.loads(x)\neval(y)\nopen(z)"}
    got = [(r["path"], r["line"], r["kind"]) for r in scan.obligations(lines(spark, files)).orderBy("path", "line").collect()]
    assert got == [("a.c", 1, "alloc-arith"), ("a.c", 2, "int-overflow-size"), ("a.c", 3, "gc-rooting"), ("a.c", 4, "lifetime-free"), ("b.py", 1, "deserialization"), ("b.py", 2, "dynamic-eval")]


@pytest.mark.parametrize(("draft", "reason"), [
    ({}, None), ({"verdict": "odd"}, "verdict"), ({"rationale": "short"}, "rationale"), ({"rationale": None}, "rationale"), ({"cwe": " "}, "cwe"), ({"hops": 1}, "path"), ({"files": 1}, "one-file"), ({"self_check": "x" * 39}, "self-check"),
    ({"verdict": "candidate", "cwe": None, "hops": 0}, None),
])
def test_deep_hunts_need_a_path_of_two_files(spark, draft, reason):
    row = {"verdict": "finding", "rationale": "r" * 150, "cwe": "CWE-1", "hops": 2, "files": 2, "self_check": "x" * 40} | draft
    d = spark.createDataFrame([tuple(row.values())], "verdict string, rationale string, cwe string, hops int, files int, self_check string")
    assert d.select(gates.deep_hunt_reason()).first()[0] == reason


def test_producers_have_their_own_rules(spark):
    rows = [
        ("authz", "rejected", None, "x" * 150, 1, "guard"), ("authz", "rejected", None, "tenant check " + "x" * 150, 1, None), ("iac", "finding", "odd", "x" * 200, 1, "kind"), ("iac", "finding", None, "x" * 200, 0, "anchors"),
        ("logic-hunt", "violation", "replay", "x" * 199, 1, "rationale"), ("logic-hunt", "finding", None, "x" * 300, 1, "verdict"), ("other", "finding", None, "x" * 300, 1, "producer"),
    ]
    d = spark.createDataFrame(rows, "source string, verdict string, kind string, rationale string, anchors int, want string")
    assert all(r[0] == r[1] for r in d.select("want", gates.producer_reason()).collect())


def test_yaml_routes_end_with_their_block(spark):
    text = "paths:\n  /a:\n    get:\n      post: no\n    x: y\n  # /c:\n  /b:\n    delete: # gone\ncomponents:\n  /no:\n    get:"
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(text.split("\n"))], "id int, line int, text string")
    got = sorted((r["method"], r["path"]) for r in documents.yaml_routes(rows, "id").collect())
    assert got == [("DELETE", "/b"), ("GET", "/a"), ("POST", "/a")]


def test_harvest_finds_files_at_any_depth(spark):
    docs = spark.createDataFrame([(1, '{"x":[{"filePath":"./a","startLine":3}],"files":["b",{"filePath":"c"}]}'), (2, "torn{"), (3, "[]")], "id int, json string")
    assert sorted(map(tuple, documents.harvested(docs, "id", deepest=5).collect()), key=repr) == [(1, "a", 3), (1, "b", None), (1, "c", None)]
    with pytest.raises(Exception, match="nested too deep"):
        documents.harvested(docs, "id", deepest=1).collect()


def test_places_are_those_of_one_sort(spark):
    rows = [("r" if i % 3 else "s", i * 7 % 5, f"k{i * 31 % 97:03d}") for i in range(97)]
    got = ranking.placed(spark.createDataFrame(rows, "repo string, score int, key string"), ["repo"], [("score", True)], "key", prefix=2).collect()
    for repo in "rs":
        own = sorted((-s, k) for g, s, k in rows if g == repo)
        assert {(r["score"], r["key"]): r["place"] for r in got if r["repo"] == repo} == {(-s, k): n + 1 for n, (s, k) in enumerate(own)}


def test_crashes_are_flagged_across_batches(spark, tmp_path):
    schema, name = "crash_key string, seen_at long", uuid.uuid4().hex

    def arrive(*rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        return sorted(map(tuple, crashes.flagged(stream, f"file://{tmp_path}/{name}", f"{tmp_path}/progress").collect()))

    assert arrive(("a", 1), ("a", 2)) == [("a", 1, False), ("a", 2, True)]
    assert arrive(("a", 3), ("b", 9)) == [("a", 1, False), ("a", 2, True), ("a", 3, True), ("b", 9, False)]


def test_matching_counts_without_pairs(spark):
    truth = spark.createDataFrame([("c", "e1", "vuln", "CWE-79", "a.c", 10), ("c", "e2", "vuln", None, "b.c", 0), ("c", "e3", "safe", "89", "a.c", 30)], "case_id string, id string, kind string, cwe string, file_path string, line long")
    rows = [("c", "f1", "open", "CWE-79", "x/a.c", 14), ("c", "f2", "proven", "", "a.c", 6), ("c", "f3", "open", "CWE-79", "a.c", 16), ("c", "f4", "open", "CWE-1", "b.c", 99), ("c", "f5", "noise", None, "b.c", 1), ("c", "f6", "proven", "CWE-89", "a.c", 31)]
    actual = spark.createDataFrame(rows, "case_id string, fingerprint string, status string, cwe string, file_path string, line long")
    assert sorted(map(tuple, benchmarks.matches(truth, actual).collect())) == [("c", "e1", 2, "f1"), ("c", "e2", 1, "f4"), ("c", "e3", 1, "f6")]
    s = benchmarks.score(truth, actual, strict=True).first()
    assert (s["tp"], s["fn"], s["fp"], s["unmatched"], s["false_proofs"], s["proven"]) == (2, 0, 2, 1, 1, 2)


def test_calls_belong_to_their_block(spark):
    files = {"a.c": "int ff(int a) {\n  if (a) {\n    gg(a);\n  }\n  ff(a); hh(a);\n}\nkk();\nint gg(int a) {\n  hh(a);\n}"}
    called = code.block_calls(lines(spark, files))
    assert sorted((r["block"], r["name"], r["first"]) for r in called.collect()) == [("ff", "gg", 3), ("ff", "hh", 5), ("gg", "hh", 9)]


def test_first_definition_of_a_node_counts(spark):
    rows = [("r", 2, "components", "a", "flow", "later", None), ("r", 1, "actors", "a", "automated", None, None), ("r", 3, "elements", "b", "data_flow", "x", None), ("r", 4, "elements", " ", "x", "x", None)]
    got = threats.dfd_nodes(spark.createDataFrame(rows, "repo string, ord long, bucket string, id string, kind string, name string, zone string")).collect()
    assert [(r["id"], r["type"], r["name"], r["zone"]) for r in got] == [("a", "process", "a", "external")]
