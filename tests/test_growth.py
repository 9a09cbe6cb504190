"""What keeps queries in proportion to their input: plans, and results that a cheaper form must keep."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from siltstone.functions import scores
from siltstone.operators import catalog, findings, scan, spans, surface
from siltstone.plans import findings as of_findings
from siltstone.plans import names, singles
from siltstone.plans import surface as of_surface
from tests.conftest import against_duckdb


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_derived_severity_is_put_in_a_few_times_only(spark, small):
    for query in (singles.QUERIES["severity_basis"], names.QUERIES["judge_claimed"]):
        assert query(spark, small)._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 2
    rows = spark.createDataFrame([(["a", " ", None], "Local", None, "high"), ([], "  PUBLIC ", True, None), (None, None, True, "odd"), (None, "tenant", True, "low"), (["a", "b", "c"], None, False, "critical")], "pre array<string>, access string, model boolean, claimed string")
    d = rows.select("claimed", scores.derive_severity(F.col("pre"), F.col("access"), F.col("model"), F.col("claimed")).alias("d")).select("d.severity", "d.derived", scores.judge_claimed(F.col("claimed"), F.col("d.severity")).alias("j"))
    assert [tuple(r) for r in d.collect()] == [("low", True, -3), ("high", True, 0), ("medium", False, 0), ("high", True, 5), ("low", True, -5)]


def test_catalog_lookup_leaves_findings_where_they_are(spark):
    found = spark.createDataFrame([(f"f{i}", "CWE-79" if i % 3 else None) for i in range(9)], "fingerprint string, cwe string")
    looked = catalog.looked_up(found, catalog.catalog(spark))
    assert "BroadcastHashJoin" in plan_of(looked) and "SortMergeJoin" not in plan_of(looked)
    assert {(r["fingerprint"], r["cwe"], r["class"]) for r in looked.collect()} == {(f"f{i}", 79 if i % 3 else None, "xss" if i % 3 else None) for i in range(9)}


def test_words_of_a_change_are_found_as_in_its_sql(spark):
    texts = ["nothing", "a ſql b", "SQL and Hash", "fsx os.x", "yamlxload", "YAML.LOAD", "Key of a cooKie", None, ""]
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(surface.diff_risk(F.lit("p"), F.col("t")).alias("d")).select("d.score", "d.tags").collect()]
    assert got == [(0, ""), (3, "data-access"), (8, "crypto,data-access"), (2, "fs"), (0, ""), (4, "exec/deser"), (3, "web-guard"), (0, ""), (0, "")]


def test_words_of_a_change_are_looked_for_in_whole_texts(spark, tmp_path):
    texts = ["x " * 3998 + "password", "x " * 60000 + "Cookie", "é" * 8001 + "\nSQL", None, "x " * 4000]
    n = len(texts)
    pq.write_table(pa.table({"doc_id": range(n), "text": texts, "lang": ["en"] * n, "source": ["s"] * n, "n_chars": [len(t or "") for t in texts]}), f"{tmp_path}/documents.parquet")
    risk = of_surface.QUERIES["diff_risk"](spark, str(tmp_path))
    assert {r["doc_id"]: (r["score"], r["tags"]) for r in risk.collect()} == {0: (5, "auth"), 1: (3, "web-guard"), 2: (3, "data-access"), 3: (0, ""), 4: (0, "")}
    against_duckdb(risk, of_surface.ORACLE_SQL["diff_risk"], str(tmp_path), ("documents",))


def test_ends_of_blocks_need_no_frame_of_all_that_follows(spark):
    body = "\n".join(f"int f{i}(int a)\n{{\n  g(a);\n}}" for i in range(50))
    files = spark.createDataFrame([("r", "a.c", i, t) for i, t in enumerate(body.split("\n"), 1)] + [("r", "b.py", i, t) for i, t in enumerate(["def a(x):", "  b()", "", "  def c(y):", "    d()", "e()", "def f(z):"], 1)], "repo string, path string, line long, text string")
    found = spans.all_spans(files)
    assert "unboundedfollowing" not in plan_of(found).lower()
    got = {(r["path"], r["block"], r["start"], r["end"]) for r in found.collect()}
    assert got == {("a.c", f"f{i}", 4 * i + 1, 4 * i + 4) for i in range(50)} | {("b.py", "a", 1, 5), ("b.py", "c", 4, 5), ("b.py", "f", 7, 7)}


def test_collapsed_findings_are_shuffled_once(spark):
    rows = [("r", "f1", "sast", "open", "k", "a.c", 3), ("r", "f0", "sast", "open", "k", "a.c", 3), ("r", "f2", "sast", "open", "k", None, 4), ("r", "f3", "sast", "open", "k", "a.c", None), ("r", "f4", "sast", "proven", "k", "b.c", 1)]
    some = findings.semantic_collapse(spark.createDataFrame(rows, "repo string, fingerprint string, source string, status string, fn_key string, file_path string, start_line long"))
    assert plan_of(some).count("Exchange") == 1
    assert {tuple(r) for r in some.collect()} == {("r", "f0", 4, 1, "a.c:3"), ("r", "f4", 1, 1, "b.c:1")}


def test_reports_without_ranks_sort_the_first_findings_only(spark):
    rows = [("r", f"f{i}", "open" if i % 2 else "noise", ("critical", "low", "high")[i % 3], "sast", None, None, None, i, None) for i in range(9)]
    found = spark.createDataFrame(rows, "repo string, fingerprint string, status string, severity string, source string, proof_state string, verify_verdict string, poc_verdict string, caller_count long, chain string")
    want = [r["fingerprint"] for r in findings.ranked(found).orderBy("rank").collect() if int(r["fingerprint"][1:]) % 2]
    few = findings.leading(found, 3)
    assert "WindowGroupLimit" in plan_of(few) and [r["fingerprint"] for r in few.orderBy("rank").collect()] == want[:3]


def test_broken_rules_are_joined_as_texts(spark, small):
    checked = of_findings.QUERIES["validate_finding"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(isnotnull" not in checked and checked.count("explode(array(struct") == 1


def test_kinds_of_programs_need_no_pattern_on_most_lines(spark):
    text = [("a", "x = 1"), ("a", None), ("b", "int main (int argc, char **argv) { getopt(a); getopt_long (b); }"), ("b", "listen(s); accept (s)"), ("c", "import flask"), ("c", "from flask import flask"), ("n", None)]
    lines = spark.createDataFrame([(r, "p", i, t) for i, (r, t) in enumerate(text)], "repo string, path string, line long, text string")
    kinds = scan.program_kind(lines)
    assert "Contains(low" in kinds._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in kinds.collect()} == {("a", 0, 0, 0, 0, "library", "medium"), ("b", 0, 1, 2, 4, "daemon", "high"), ("c", 3, 0, 0, 0, "web-service", "high"), ("n", None, None, None, None, "unknown", "low")}
