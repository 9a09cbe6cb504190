"""Cases that the given tables don't hold."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import scores, text, verdicts
from siltstone.operators import benchmarks, code, findings, proofs, surface, voting
from siltstone.sources.files import numbered_lines


def value(spark, column, **given):
    """The column's value over one row of literals."""
    frame = spark.range(1).select(*[F.expr(v).alias(k) for k, v in given.items()])
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("src/a.c", "a.c", True), ("./src/a.c", "src/a.c", True), ("/w/src/a.c", "src/a.c", True), ("ba.c", "a.c", False), ("", "a.c", False), (None, "a.c", False), ("a\\b.c", "b.c", True)],
)
def test_paths_match_by_suffix(spark, a, b, same):
    frame = spark.createDataFrame([(a, b)], "a string, b string")
    assert frame.select(text.same_path(F.col("a"), F.col("b"))).first()[0] is same
    assert frame.select(text.same_path(F.col("b"), F.col("a"))).first()[0] is same


def test_names(spark):
    frame = spark.createDataFrame([("/root/t/src/auth/x.c",), ("x.c",), ("src/lib/x.py",), (None,)], "p string")
    assert [r[0] for r in frame.select(text.norm_path(F.col("p"), "/root/t")).collect()] == ["src/auth/x.c", "x.c", "src/lib/x.py", None]
    assert [r[0] for r in frame.select(text.component_of(text.norm_path(F.col("p"), "/root/t"))).collect()] == ["auth", "(root)", "(root)", "(root)"]
    languages = spark.createDataFrame([("a.h", "C"), ("a.hpp", "C++"), ("a.tsx", "TypeScript"), ("a.mjs", "JavaScript"), ("Makefile", "Other")], "p string, want string")
    assert all(r[0] == r[1] for r in languages.select(text.language_of(F.col("p")), "want").collect())
    commands = spark.createDataFrame([("getCommand", "get"), ("cmd_set", "set"), ("do_Quit", "quit")], "s string, want string")
    assert all(r[0] == r[1] for r in commands.select(text.command_name(F.col("s")), "want").collect())
    confidence = spark.createDataFrame([("0.5", 0.5), ("7", 1.0), ("-1", 0.0), ("NaN", 0.0), ("x", 0.0), (None, 0.0), ("Infinity", 0.0)], "s string, want double")
    assert all(r[0] == r[1] for r in confidence.select(text.clamp_confidence(F.col("s")), "want").collect())


def test_severity_takes_the_lower_column(spark):
    schema = "pre array<string>, access string, match boolean, claimed string, severity string, derived boolean"
    rows = [
        ([], None, False, "low", "high", True),
        (["a"], "remote", False, None, "medium", True),
        (["a", " ", ""], "Unauthenticated  Remote", False, None, "medium", True),
        ([], "local only", False, None, "low", True),
        ([], "local only", True, None, "medium", True),
        ([], "public", True, None, "high", True),
        (None, None, True, "critical", "critical", False),
        (None, "somewhere", False, "odd", "medium", False),
        (["a", "b", "c"], "anonymous", False, None, "low", True),
    ]
    frame = spark.createDataFrame(rows, schema)
    got = frame.select(scores.derive_severity(F.col("pre"), F.col("access"), F.col("match"), F.col("claimed")).alias("d"), "severity", "derived").collect()
    assert [(r["d"]["severity"], r["d"]["derived"]) for r in got] == [(r["severity"], r["derived"]) for r in got]


def test_votes(spark):
    schema = "repo string, fingerprint string, lens string, ord int, verdict string, confidence double, has_trigger boolean, exclusion_rule string, refute_reason string"
    yes, no, _ = verdicts.VERIFY_VERDICTS
    rows = [("r", "a", f"l{i}", i, yes, 0.6 + i / 10, i == 0, None, None) for i in range(3)]
    rows += [("r", "b", f"l{i}", i, yes, 0.9, False, None, None) for i in range(3)]
    rows += [("r", "c", "l0", 0, yes, 0.5, True, "x", None), ("r", "c", "l1", 1, no, 0.7, False, "y", "why")]
    rows += [("r", "d", "l0", 0, "bogus", 0.5, True, None, None)]
    frame = spark.createDataFrame(rows, schema)
    majority = {r["fingerprint"]: (r["verdict"], r["agreement"], r["n_votes"]) for r in voting.majority(frame).collect()}
    assert majority == {"a": (yes, 1.0, 3), "b": (yes, 1.0, 3), "c": ("inconclusive", 0.0, 2), "d": ("inconclusive", 0.0, 0)}
    for tolerance, verdict, flagged in (("ask", "inconclusive", True), ("recall", "inconclusive", False), ("precision", no, False)):
        got = {r["fingerprint"]: r for r in voting.consensus(frame, tolerance).collect()}
        assert set(got) == {"a", "b", "c"}
        assert (got["a"]["verdict"], got["a"]["confidence"], got["a"]["downgraded"]) == (yes, 0.7, False)
        assert (got["b"]["verdict"], got["b"]["downgraded"]) == ("inconclusive", True)
        assert (got["c"]["verdict"], got["c"]["flagged"], got["c"]["exclusion_rule"]) == (verdict, flagged, "x")


def test_crash_logs(spark):
    logs = [
        ("==1==ERROR: AddressSanitizer: heap-use-after-free on address 0x1", ("AddressSanitizer", "heap-use-after-free", "CWE-416")),
        ("a.c:3: runtime error: signed integer overflow: 1 + 2", ("UndefinedBehaviorSanitizer", "integer-overflow", "CWE-190")),
        ("AddressSanitizer:DEADLYSIGNAL\nThe signal is caused by a WRITE memory access.\nSUMMARY: AddressSanitizer: SEGV x.c in f", ("AddressSanitizer", "oob-write", "CWE-787")),
        ("AddressSanitizer:DEADLYSIGNAL SEGV on unknown address 0x000000000000 caused by a READ memory access.", ("AddressSanitizer", "segv", "CWE-476")),
        ("all is well", None),
        (None, None),
    ]
    got = spark.createDataFrame([(t,) for t, _ in logs], "t string").select(proofs.classify_log(F.col("t")).alias("c")).collect()
    assert [tuple(r["c"]) if r["c"] else None for r in got] == [w for _, w in logs]


def test_runs(spark):
    schema = "finding string, role string, run_no int, exit_code int, signal string, timed_out boolean, skipped boolean, output string"
    rows = [
        ("a", "attack", 1, 139, None, False, False, ""), ("a", "attack", 2, 0, "SIGSEGV", False, False, ""), ("a", "benign", 1, 0, None, False, False, "ok"),
        ("b", "attack", 1, 139, None, False, False, ""), ("b", "attack", 2, 0, None, False, False, "ok"), ("b", "benign", 1, 139, None, False, False, ""),
        ("c", "attack", 1, 1, None, False, False, "SyntaxError: panic"), ("c", "attack", 2, None, None, True, False, None),
        ("d", "benign", 1, 0, None, False, False, "ok"),
    ]
    frame = spark.createDataFrame(rows, schema)
    assert {tuple(r) for r in proofs.differential(frame).collect()} == {("a", 5, "exploited"), ("b", 2, "non-discriminating"), ("c", 1, "harness-failed-build")}
    assert {tuple(r) for r in proofs.reproducibility(frame).collect()} == {("a", 5, "exploited", 2, 2, 1.0), ("b", 4, "exploited", 1, 2, 0.5), ("c", 1, "timeout", 0, 2, 0.0)}


def test_matches_at_the_edge_of_the_tolerance(spark):
    truth = spark.createDataFrame([("c", f"e{i}", "vuln", "CWE-1", "x/a.c", i) for i in range(1, 60)] + [("c", "any", "vuln", None, "a.c", 0)], "case_id string, id string, kind string, cwe string, file_path string, line int")
    actual = spark.createDataFrame([("c", "f", "open", "1", "/t/x/a.c", 30), ("c", "g", "noise", "1", "x/a.c", 3)], "case_id string, fingerprint string, status string, cwe string, file_path string, line int")
    got = {r["id"] for r in benchmarks.matches(truth, actual, 5).collect()}
    assert got == {"any", *[f"e{i}" for i in range(25, 36)]}
    assert benchmarks.score(truth.limit(0), actual).count() == 0


def test_gate_reads_percentages(spark):
    metrics = spark.createDataFrame([("recall", 0.8), ("false", 0.1)], "metric string, value double")
    limits = spark.createDataFrame([("a", "recall", "min", "80%"), ("b", "recall", "min", "0.81"), ("c", "false", "max", "10 %"), ("d", "none", "min", "0"), ("e", "false", "max", "x")], "flag string, metric string, comparator string, threshold string")
    assert {(r["flag"], r["passed"]) for r in benchmarks.gate(metrics, limits).collect()} == {("a", True), ("b", False), ("c", True), ("d", False), ("e", False)}


def test_rule_grades(spark):
    rows = [("ok", "f1", True, True), ("bad", "f1", False, True), ("seedless", "f1", True, False)] + [("wide", f"f{i}", True, True) for i in range(6)] + [("many", "f1", True, True)] * 201
    n = spark.createDataFrame([(20,)], "n long")
    got = {r["rule_id"]: r["grade"] for r in benchmarks.rule_grades(spark.createDataFrame(rows, "rule_id string, file string, compile_ok boolean, seed_matched boolean"), n).collect()}
    assert got == {"ok": "accepted", "bad": "does-not-compile", "seedless": "misses-seed", "wide": "too-many-files", "many": "too-many-matches"}


SOURCE = """int helper(int a) {
  return a;
}

int run(char *p) {
  if (p) {
    helper(1);
  }
  while (x()) { y(); }
}
int open_ended(void) {
"""


def test_blocks_balance_braces(spark):
    files = spark.createDataFrame([("r", "a.c", SOURCE)], "repo string, path string, content string")
    lines = numbered_lines(files)
    assert {(r["start"], r["end"]) for r in code.blocks(lines).collect()} == {(1, 3), (5, 10), (11, None)}
    calls = {(r["line"], r["name"]) for r in code.call_sites(lines).collect()}
    assert (7, "helper") in calls and not any(n in ("if", "while") for _, n in calls)


def test_lines_of_either_ending(spark):
    files = spark.createDataFrame([("r", "a", "x\r\ny\n"), ("r", "b", ""), ("r", "c", None)], "repo string, path string, content string")
    assert sorted(tuple(r) for r in numbered_lines(files).collect()) == [("r", "a", 1, "x"), ("r", "a", 2, "y"), ("r", "a", 3, ""), ("r", "b", 1, "")]


def test_blast_radius_before_the_first_symbol(spark):
    symbols = spark.createDataFrame([("r", "f", "a", 10, 3), ("r", "g", "a", 20, 9), ("r", "h", "a", 20, 4)], "repo string, name string, file_path string, line long, caller_count long")
    anchors = spark.createDataFrame([("r", "1", "a", 5), ("r", "2", "a", 10), ("r", "3", "a", 25), ("r", "4", "b", 1)], "repo string, fingerprint string, file_path string, line long")
    assert {r["fingerprint"]: r["blast"] for r in code.blast_radius(anchors, symbols).collect()} == {"1": 9, "2": 3, "3": 9, "4": 0}


def test_even_sample_keeps_the_stated_places(spark):
    for n in (1, 3, 4, 5, 7, 10, 33):
        rows = spark.range(n).select(F.lit("g").alias("g"), "id")
        got = sorted(r["id"] for r in code.even_sample(rows, ["g"], [F.col("id")], 4).collect())
        assert got == (list(range(n)) if n <= 4 else [k * n // 4 for k in range(4)])


def test_shards_of_sixty_files(spark):
    rows = [("r", f"{d}/f{i:03}.c") for d, n in (("a", 60), ("b", 61), ("c", 121)) for i in range(n)] + [("r", "./top.c")]
    got = {r["shard_id"]: r["n_files"] for r in surface.shards(spark.createDataFrame(rows, "repo string, path string")).collect()}
    assert got == {"a": 60, "b__1": 60, "b__2": 1, "c__1": 60, "c__2": 60, "c__3": 1, "root": 1}


def test_patches_of_unknown_findings_are_reported(spark):
    old = spark.createDataFrame([("a", "open")], "fingerprint string, status string")
    new = spark.createDataFrame([("a", None), ("b", "proven")], "fingerprint string, status string")
    assert findings.patch(old, new, "fingerprint", ["status"]).collect() == [("a", "open")]
    assert [r["fingerprint"] for r in findings.unknown_keys(old, new, "fingerprint").collect()] == ["b"]
    assert value(spark, verdicts.fix_status(F.col("v")), v="'failed'") is None
