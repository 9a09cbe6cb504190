"""Pattern packs, telemetry and streams on literal rows."""

import uuid

import pytest
from pyspark.sql import functions as F

from siltstone.operators import flows, scan
from siltstone.streaming import crashes


@pytest.mark.parametrize(("pattern", "case", "want"), [("abc", "smart", "(?i)abc"), ("aBc", "smart", "aBc"), (r"\Wa\S", "smart", r"(?i)\Wa\S"), ("aBc", "ignore", "(?i)aBc"), ("abc", "exact", "abc")])
def test_smart_case(pattern, case, want):
    assert scan.flagged(pattern, case) == want


def test_pack_limits(spark):
    rows = [("r", f"f{i}.c", n, "memcpy(a)") for i in range(4) for n in range(1, 8)] + [("r", "f0.c", 100, "rand () % secret")]
    pack = scan.Pack("p", (("copy", r"memcpy\("), ("rng", r"rand \(")), 2, 5, 6)
    got = scan.pattern_scan(spark.createDataFrame(rows, "repo string, path string, line long, text string"), pack).collect()
    assert sorted((r["pattern"], r["path"], r["line"], r["place"]) for r in got) == [("copy", "f0.c", 1, 1), ("copy", "f0.c", 2, 2), ("copy", "f1.c", 1, 3), ("copy", "f1.c", 2, 4), ("copy", "f2.c", 1, 5), ("rng", "f0.c", 100, 6)]


def test_obligations_take_the_first_rule(spark):
    rows = [("a.c", "p = realloc(n * size); free(p);", "alloc-arith"), ("a.c", "// free(p)", None), ("a.py", "free(p)", None), ("a.go", "free(p)", "lifetime-free"), ("a.c", "free(p)" + " " * 400, None), ("a.md", "free(p)", None)]
    lines = spark.createDataFrame([("r", p, i, t) for i, (p, t, _) in enumerate(rows)], "repo string, path string, line long, text string")
    got = {r["line"]: r["kind"] for r in scan.obligations(lines).collect()}
    assert got == {i: k for i, (_, _, k) in enumerate(rows) if k}


def test_telemetry(spark):
    rows = [("a", 1, "#10 NEW cov: 5 ft: 7 exec/s: 3"), ("a", 2, "#20 REDUCE cov: 6"), ("a", 3, "Done 20"), ("b", 1, "INFO"), ("c", 1, "#1 NEW cov: 1"), ("c", 2, "==1==ERROR: AddressSanitizer: x"), ("d", 1, "#9 pulse cov: 3")]
    got = {r["run_id"]: r for r in scan.telemetry(spark.createDataFrame(rows, "run_id string, line long, text string")).collect()}
    assert (got["a"]["execs"], got["a"]["cov"], got["a"]["features"], got["a"]["new_inputs"], got["a"]["reduced"]) == (20, 6, 7, 1, 1)
    assert {k: r["signal"] for k, r in got.items()} == {"a": "completed", "b": "no-coverage-data", "c": "crashed", "d": "saturating"}


def test_crashes_are_promoted_once(spark, tmp_path):
    source = tmp_path / "in"
    schema = "crash_key string, seen_at timestamp"

    def arrive(*keys):
        rows = [(k, f"2024-01-0{d} 00:00:00") for k, d in keys]
        spark.createDataFrame(rows, "crash_key string, t string").select("crash_key", F.to_timestamp("t").alias("seen_at")).coalesce(1).write.parquet(f"{source}/{uuid.uuid4().hex}")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{source}/*")
        return sorted(r["crash_key"] for r in crashes.run_once(crashes.first_crashes(stream), f"{tmp_path}/out", f"{tmp_path}/progress").collect())

    arrive(("a", 1), ("a", 1), ("b", 1))
    assert run() == ["a", "b"]
    arrive(("b", 2), ("c", 2))
    assert run() == ["a", "b", "c"]
    assert run() == ["a", "b", "c"]


def test_ledger_fills_defaults(spark):
    rows = [(None, " ", "1", None, "why"), ("s", "t", "2", "rejected", "")]
    got = crashes.dropped_ledger(spark.createDataFrame(rows, "source string, stage string, id string, verdict string, reason string"))
    assert sorted(map(tuple, got.collect())) == [("s", "t", "2", "rejected", "unspecified"), ("unknown", "finalize", "1", "dropped", "why")]


def test_flows_link_the_nearest_source_before(spark):
    rows = [("r", "a", 1, "C", "source"), ("r", "a", 5, "C", "source"), ("r", "a", 9, "C", "sink"), ("r", "a", 0, "C", "sink"), ("r", "b", 9, "C", "sink"), ("r", "a", 7, "D", "sink")]
    none = spark.createDataFrame([], "repo string, path string, line long, text string")
    got = flows.linked(spark.createDataFrame(rows, "repo string, path string, line long, cwe string, kind string"), none).collect()
    assert [(r["path"], r["source_line"], r["sink_line"]) for r in got] == [("a", 5, 9)]
