"""Jobs of sweeps, and documents that are written in parts."""

import json
from pathlib import Path

import pytest

from siltstone.operators import findings, sarif, scan, surface, sweep


def planned(spark, own=(), **how):
    shards = spark.createDataFrame([("r", "core", ["C", "Other"], 90), ("r", "web", ["Python", "Go"], 10), ("r", "docs", ["Other"], 3), ("s", "web", ["Ruby"], 200)], "repo string, shard_id string, languages array<string>, n_files long")
    there = spark.createDataFrame([("r", "semgrep"), ("r", "binaries"), ("s", "threat-model"), ("s", "threat-model")], "repo string, thing string")
    got = sweep.jobs(sweep.registry(spark, own), shards, there, **how).collect()
    jobs = {(r["repo"], r["producer"], r["shard_id"]): (r["job_id"], r["budget"]) for r in got if r["job_id"]}
    skipped = {(r["repo"], r["producer"]): r["reason"] for r in got if r["reason"]}
    assert len(jobs) + len(skipped) == len(got)
    return jobs, skipped


def test_requirements_and_languages(spark):
    jobs, skipped = planned(spark)
    assert ("s", "threat-hunt", None) in jobs and skipped["r", "threat-hunt"] == "requirement not met: threat-model"
    assert ("r", "binary-recon", None) in jobs and skipped["s", "binary-recon"] == "requirement not met: binaries"
    assert {s for r, p, s in jobs if (r, p) == ("r", "authz")} == {"web"} and {s for r, p, s in jobs if (r, p) == ("r", "systems-hunt")} == {"core", "web"}
    assert skipped["s", "systems-hunt"] == "no shard of its languages"
    assert {s for r, p, s in jobs if (r, p) == ("r", "sast")} == {"core", "docs", "web"} and skipped["s", "sast"] == "requirement not met: semgrep"
    assert jobs["r", "crypto-review", "core"][1] == 24 and jobs["r", "crypto-review", "web"][1] == 4 and jobs["r", "iac", None][1] is None
    assert not any(p in ("deep-scan", "fuzz-discover") for _, p, _ in jobs) and not any(p == "deep-hunt" for _, p in skipped)


def test_jobs_are_numbered_by_producer_and_shard(spark):
    jobs, _ = planned(spark, requested=["taint-analysis", "threat-hunt", "authz"])
    assert {k: v[0] for k, v in jobs.items() if k[0] == "r"} == {("r", "taint-analysis", "core"): "j1", ("r", "taint-analysis", "docs"): "j2", ("r", "taint-analysis", "web"): "j3", ("r", "authz", "web"): "j4"}
    assert jobs["s", "threat-hunt", None][0] == "j1" and jobs["s", "authz", "web"][0] == "j3"


def test_offline_and_deep_sweeps(spark):
    jobs, skipped = planned(spark, own=[("runner", "shard", (), ("binaries", "symbols"), False, True, False, True), ("two", "repo", (), ("zoo", "apes"), False, False, False, True)], offline=True, deep=True)
    assert skipped["r", "supply-chain"].startswith("offline: may use") and skipped["r", "runner"].startswith("offline: runs")
    assert skipped["r", "two"] == "requirement not met: apes" and ("r", "deep-scan", "docs") in jobs
    jobs, skipped = planned(spark, requested=["supply-chain", "fuzz-discover"])
    assert ("r", "supply-chain", None) in jobs and ("s", "fuzz-discover", None) in jobs and not skipped
    jobs, _ = planned(spark, own=[("iac", "shard", ("Ruby",), (), False, False, False, True)], requested=["iac"])
    assert set(jobs) == {("s", "iac", "web")}


def test_producers_are_a_small_table(spark):
    with pytest.raises(ValueError, match="producers"):
        planned(spark, own=[(f"p{i}", "repo", (), (), False, False, False, True) for i in range(1001)])


FINDING = "repo string, fingerprint string, source string, title string, rationale string, severity string, cwe string, verdict string, status string, proof_state string, ref_id string, verify_verdict string, poc_verdict string, fix_verdict string, evidence array<struct<file_path:string,start_line:bigint>>"


def finding(repo, fp, **how):
    base = dict.fromkeys([c.split()[0] for c in FINDING.split(", ")]) | {"repo": repo, "fingerprint": fp, "source": "sast", "title": f"t {fp}", "status": "open", "severity": "high"} | how
    return tuple(base.values())


def test_documents_are_valid_and_read_back(spark, tmp_path):
    rows = [finding("r", f"f{i:03d}", cwe=["CWE-79", "cwe-89 ", "", None][i % 4], rationale="why \n\t not " * (i % 80), evidence=[[("./a.c", 0), (None, 3)], [], None, [("b.py", 7), ("c.py", None)]][i % 4]) for i in range(300)]
    rows += [finding("r", "gone", status="noise", verdict="rejected"), finding("r", "x\"quo\\te", status="noise", verdict="finding", title='say "hi"\n\\o/ é', severity=None, cwe="CWE-1"), finding("s", "only", source=None, title=None), finding("t", "none", status="reviewed")]
    found = spark.createDataFrame(rows, FINDING)
    sarif.write(sarif.document(found, "siltstone", "1.0").repartition(7), f"{tmp_path}/d")
    folders = {p.name.split("=")[1]: p for p in Path(f"{tmp_path}/d").glob("repo=*")}
    assert set(folders) == {"r", "s"}
    documents = {k: json.loads("".join(f.read_text() for f in sorted(p.glob("part-*")))) for k, p in folders.items()}
    run = documents["r"]["runs"][0]
    assert documents["r"]["version"] == "2.1.0" and len(run["results"]) == 301
    rules = run["tool"]["driver"]["rules"]
    assert [r["id"] for r in rules] == ["CWE-79", "CWE-89", "sast", "CWE-1"] and rules[0]["properties"]["tags"] == ["security", "external/cwe/cwe-79"]
    assert all(rules[r["ruleIndex"]]["id"] == r["ruleId"] for r in run["results"])
    assert [r["partialFingerprints"]["primary"] for r in run["results"]] == [f"f{i:03d}" for i in range(300)] + ["x\"quo\\te"]
    at = [[(p["physicalLocation"]["artifactLocation"]["uri"], p["physicalLocation"]["region"]["startLine"]) for p in r["locations"]] for r in run["results"][:4]]
    assert at == [[("a.c", 1)], [(".", 1)], [(".", 1)], [("b.py", 7), ("c.py", 1)]]
    last = run["results"][-1]
    assert last["message"]["text"] == 'say "hi"\n\\o/ é' and last["level"] == "note" and last["properties"] == {"source": "sast", "verdict": "finding", "status": "noise"}
    assert len(run["results"][79]["message"]["text"]) == len("t f079 — ") + 600 and documents["s"]["runs"][0]["results"][0]["message"]["text"] == "finding"
    back = {r["result"]["partialFingerprints"]["primary"]: r["result"]["ruleId"] for r in sarif.read(spark, f"{tmp_path}/d").collect()}
    assert back == {r["partialFingerprints"]["primary"]: r["ruleId"] for d in documents.values() for r in d["runs"][0]["results"]}


def test_a_document_of_many_parts(spark, tmp_path):
    found = spark.createDataFrame([finding("r", f"f{i:05d}") for i in range(3000)], FINDING)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sarif.write(sarif.document(found, "siltstone", "1.0"), f"{tmp_path}/d")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(Path(f"{tmp_path}/d/repo=r").glob("part-*"))
    assert len(parts) > 1
    assert len(json.loads("".join(p.read_text() for p in parts))["runs"][0]["results"]) == 3000


VALID = "fingerprint string, source string, ref_id string, title string, severity string, status string, proof_state string, evidence array<struct<file_path:string,start_line:bigint,end_line:bigint>>, verification struct<verdict:string,confidence:double,verified_at:string>, poc struct<proof_level:int,proof_verdict:string,backend:string,proven_at:string>, fix struct<verdict:string,patch_path:string,applied:boolean,exploit_passed:boolean,functional_passed:boolean,semantic_passed:boolean,poc_plus_passed:boolean>"


@pytest.mark.parametrize(("given", "want"), [
    ({}, []),
    ({"title": " ", "status": "odd", "proof_state": None}, ["title", "proof_state", "status: unknown"]),
    ({"evidence": None}, ["evidence"]),
    ({"evidence": [("a", 0, None), ("", 1, 0), ("c", None, 3)]}, ["evidence[0].start_line", "evidence[1].file_path", "evidence[1].end_line"]),
    ({"verification": ("maybe", 1.5, None)}, ["verification.verdict", "verification.confidence", "verification.verified_at"]),
    ({"poc": (6, None, "", "t")}, ["poc.proof_level", "poc.proof_verdict", "poc.backend"]),
    ({"fix": ("validated", "p", True, True, True, None, True)}, []),
    ({"fix": ("validated", "", None, False, None, False, True)}, ["fix.patch_path", "fix.applied", "fix.exploit_passed", "fix.functional_passed", "fix.semantic_passed"]),
    ({"fix": ("build-failed", "p", False, None, None, False, None)}, []),
])
def test_nested_blocks_are_checked(spark, given, want):
    base = {"fingerprint": "f", "source": "s", "ref_id": "r", "title": "t", "severity": "high", "status": "open", "proof_state": "open", "evidence": [("a.c", 1, None)], "verification": None, "poc": None, "fix": None}
    got = findings.errors(spark.createDataFrame([tuple((base | given).values())], VALID)).first()
    assert (got["n_errors"], got["errors"]) == (len(want), ",".join(want))


def test_shards_hold_languages_and_uncovered_files(spark):
    files = spark.createDataFrame([("r", f"{d}/f{i:03}.{'c' if i % 2 else 'py'}") for d, n in (("a", 61), ("b", 7)) for i in range(n)] + [("r", "a/f000.py")], "repo string, path string")
    assert {r["shard_id"]: (r["n_files"], r["by_language"]) for r in surface.shards(files).collect()} == {"a__1": (60, "C:30,Python:30"), "a__2": (1, "Python:1"), "b": (7, "C:3,Python:4")}
    jobs = spark.createDataFrame([("r", "b", "shard", "sast"), ("r", "b", "shard", "authz"), ("r", "a__2", "shard", "sast"), ("r", None, "repo", "iac")], "repo string, shard_id string, scope string, producer string")
    got = {r["shard_id"]: (r["covered"], r["producers"], r["sample_files"]) for r in surface.shard_coverage(files, jobs).collect()}
    assert got == {"a__1": (False, "", "a/f000.py,a/f001.c,a/f002.py,a/f003.c,a/f004.py"), "a__2": (True, "sast", ""), "b": (True, "authz,sast", "")}
    assert [tuple(r) for r in surface.coverage(surface.shards(files), jobs).collect()] == [("r", 68, 8, 60, 11.8, "iac")]


def test_telemetry_tells_how_a_run_ended(spark):
    rows = [
        ("done", ["#1 NEW cov: 1 ft: 2", "#9 DONE   cov: 3 ft: 4"]), ("crash", ["#1 NEW cov: 1 ft: 2", "Test unit written to ./crash-1", "SUMMARY: AddressSanitizer: SEGV x ", "Test unit written to ./other"]),
        ("go", ["workers: 8, corpus: 10 (3m ago), crashers: 0, restarts", "workers: 8, corpus: 12 (3m ago), crashers: 1, restarts"]), ("open", ["#9 DONE cov: 3 ft: 4", "#10 pulse cov: 3 ft: 4"]),
    ]
    lines = spark.createDataFrame([(k, i, t) for k, ts in rows for i, t in enumerate(ts)], "run_id string, line long, text string")
    got = {r["run_id"]: (r["ended_with"], r["artifact"], r["summary"], r["corpus"], r["crashers"]) for r in scan.telemetry(lines).collect()}
    assert got == {"done": ("done", None, None, None, None), "crash": ("crash", "./crash-1", "SEGV x", None, None), "go": ("crash", None, None, 12, 1), "open": ("unknown", None, None, None, None)}


def test_documents_may_be_compressed(spark, tmp_path):
    lines = spark.createDataFrame([("r", 3, i, '{"ruleId":"A","level":"note"},') for i in range(2000)], "repo string, part int, place long, text string")
    sarif.write(lines, f"{tmp_path}/z", "gzip")
    parts = list(Path(f"{tmp_path}/z/repo=r").glob("part-*"))
    assert all(p.name.endswith(".gz") for p in parts) and sum(p.stat().st_size for p in parts) < 6000
    assert sarif.read(spark, f"{tmp_path}/z").count() == 2000


def test_findings_are_shuffled_once_on_their_way_to_a_document(spark, monkeypatch):
    found = spark.createDataFrame([finding("r", f"f{i:05d}", cwe=f"CWE-{i % 3}") for i in range(500)], FINDING)
    monkeypatch.setattr(sarif, "LINES", 40, raising=False)
    kept, before = [], sarif.written
    monkeypatch.setattr(sarif, "written", lambda df, name: (kept.append(df.count()), before(df, name))[1])
    plan = sarif.document(found, "siltstone", "1.0")._jdf.queryExecution().executedPlan().toString()
    assert sum(kept) <= 3 and plan.count("rangepartitioning(") == 1
    # others are of one row a rule, below the shuffle
    above = plan[: plan.index("rangepartitioning(")]
    assert above.count("Exchange") == 1 and "SortMergeJoin" not in plan


def test_documents_in_order_are_written_as_they_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sarif, "LINES", 40)
    rows = [finding("r", f"f{i:03d}", cwe=f"CWE-{(7 - i) % 8}", rationale=[None, " \t", "a  b"][i % 3]) for i in range(300)] + [finding("r", fp, cwe=cwe) for fp in ("f299", "f007", "f299") for cwe in ("CWE-1", "CWE-9")]
    rows += [finding("s", "same", title="s")] * 3 + [finding("t", None)]
    limit = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    sarif.write(sarif.document(spark.createDataFrame(rows, FINDING).repartition(5), "siltstone", "1.0"), f"{tmp_path}/d", in_order=True)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == limit
    parts = {p.name.split("=")[1]: sorted(p.glob("part-*")) for p in Path(f"{tmp_path}/d").glob("repo=*")}
    runs = {k: json.loads("".join(f.read_text() for f in ps))["runs"][0] for k, ps in parts.items()}
    assert set(runs) == {"r", "s", "t"} and len(parts["r"]) > 3
    order = [r["partialFingerprints"].get("primary") for r in runs["r"]["results"]]
    assert order == sorted(order) and len(order) == 306 and order[-3:] == ["f299"] * 3 and [len(runs[k]["results"]) for k in "st"] == [3, 1]
    rules = runs["r"]["tool"]["driver"]["rules"]
    assert [r["id"] for r in rules] == ["CWE-7", "CWE-6", "CWE-5", "CWE-4", "CWE-3", "CWE-2", "CWE-1", "CWE-0", "CWE-9"]
    assert all(rules[r["ruleIndex"]]["id"] == r["ruleId"] for r in runs["r"]["results"])
    assert [r["message"]["text"] for r in runs["r"]["results"][:3]] == ["t f000", "t f001", "t f002 — a b"]
