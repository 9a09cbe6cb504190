"""Places that meet by file and line without pairs, leads by path, and reports."""

import itertools
import json
import random

from siltstone.operators import benchmarks, catalog, code, findings, gates, stores, surface

TRUTH = "case_id string, id string, kind string, cwe string, file_path string, line long"


def suffix(a, b):
    return a == b or a.endswith("/" + b) or b.endswith("/" + a)


def some_places(seed):
    rnd = random.Random(seed)
    paths = ["a.c", "x/a.c", "y/x/a.c", "b.c", "./b.c", "z/b.c"]
    truth = [(rnd.choice("pq"), f"e{i}", "vuln", None, rnd.choice(paths), rnd.choice([0, None, 3, 10, 20, 33])) for i in range(60)]
    places = [(rnd.choice("pq"), rnd.choice(paths), rnd.choice([None, 1, 5, 14, 27, 39, 90])) for _ in range(14)]
    return truth, places


def test_anchors_meet_expectations_as_pairs_would(spark):
    for seed in range(3):
        truth, places = some_places(seed)
        norm = lambda p: p.removeprefix("./")
        for site in (False, True):
            want = set()
            for c, i, _, _, p, n in truth:
                for d, q, m in places:
                    near = m is not None and ((n or 0) <= 0 or abs(n - m) <= 6)
                    if c == d and suffix(norm(p), norm(q)) and (near if site else m is None or near):
                        want.add((c, i))
            got = benchmarks.anchor_hits(spark.createDataFrame(truth, TRUTH), spark.createDataFrame(places, "case_id string, file_path string, line long"), site=site)
            assert set(map(tuple, got.collect())) == want


def test_context_is_the_union_of_what_was_shown(spark):
    truth = spark.createDataFrame([("c", f"e{i}", "vuln", None, p, n) for i, (p, n) in enumerate([("a.c", 10), ("b.c", 10), ("d.c", 100), ("d.c", 50), ("g.c", 5), ("h.c", None), ("none.c", 1)])], TRUTH)
    at = lambda *rows: spark.createDataFrame([("c", *r) for r in rows], "case_id string, file_path string, line long")
    leads = spark.createDataFrame([("c", "src/d.c", 97, 51), ("c", "h.c", 9, None)], "case_id string, file_path string, sink_line long, source_line long")
    got = benchmarks.context(truth, at(("src/a.c", None), ("b.c", None)), at(("src/a.c", 16)), at(("b.c", 17), ("g.c", None)), leads)
    assert {r["id"]: (r["file_seen"], r["site_seen"]) for r in got.collect()} == {"e0": (True, True), "e1": (True, False), "e2": (False, True), "e3": (False, True), "e4": (False, True), "e5": (False, True), "e6": (False, False)}


def test_leads_meet_by_the_ends_of_paths(spark):
    rnd = random.Random(3)
    paths = ["index.js", "a/index.js", "b/a/index.js", "c/index.js", "b/c/index.js", "other.js"]
    mine, theirs = [("r", f"f{i}", rnd.choice(paths)) for i in range(15)], [("r", f"l{i:02d}", rnd.choice(paths)) for i in range(40)]
    got = {}
    for r in gates.leads_of(spark.createDataFrame(mine, "repo string, fingerprint string, file_path string"), spark.createDataFrame(theirs, "repo string, lead string, file_path string"), most=4).collect():
        got.setdefault(r["fingerprint"], {})[r["n"]] = r["lead"]
    want = {f: dict(enumerate(sorted(x for _, x, q in theirs if suffix(p, q))[:4], 1)) for _, f, p in mine}
    assert got == {f: x for f, x in want.items() if x}


def test_reports_lead_with_what_to_fix(spark):
    found = spark.createDataFrame([("r", f"f{i}", "open" if i % 2 else "noise", "high", "sast") for i in range(8)], "repo string, fingerprint string, status string, severity string, source string")
    ranks = spark.createDataFrame([("r", f"f{i}", 9 - i) for i in range(8)], "repo string, fingerprint string, rank int")
    chains = spark.createDataFrame([("r", "C1", 3)], "repo string, label string, n long")
    covered = spark.createDataFrame([("r", 9, 6, 3)], "repo string, files long, covered long, uncovered long")
    untouched = spark.createDataFrame([("r", f"p{i}") for i in range(3)] * 2, "repo string, path string")
    rows = {(r["section"], r["name"]): r["n"] for r in stores.full_report(found, ranks, chains, covered, untouched, first=3, sample=2).collect()}
    assert {k[1]: n for k, n in rows.items() if k[0] == "fix-first"} == {"f7": 1, "f5": 2, "f3": 3}
    assert rows["chain", "C1"] == 3 and rows["coverage", "uncovered"] == 3 and rows["uncovered", "p1"] == 2 and ("uncovered", "p2") not in rows
    assert rows["resolved", "all"] == 4 and rows["producer", "sast"] == 8
    assert findings.ACTIONABLE[0] == "open"


def test_kinds_take_turns(spark):
    for a, b in ((3, 3), (5, 2), (1, 4), (0, 3)):
        rows = [("r", f"s{i}", "source", 9 - i) for i in range(a)] + [("r", f"t{i}", "sink", i) for i in range(b)] + [("r", "other", "x", 1)]
        got = code.interleave(spark.createDataFrame(rows, "repo string, fingerprint string, kind string, weight int"), ("source", "sink"), [("weight", True)], "fingerprint").collect()
        one, two = [f"s{i}" for i in range(a)], [f"t{i}" for i in reversed(range(b))]
        want = [x for pair in itertools.zip_longest(one, two) for x in pair if x]
        assert [r["fingerprint"] for r in sorted(got, key=lambda r: r["slot"])] == want and sorted(r["slot"] for r in got) == list(range(1, a + b + 1))


def test_chains_by_what_they_name(spark):
    found = spark.createDataFrame([("r", "a", "low"), ("r", "b", "critical"), ("r", "c", None)], "repo string, fingerprint string, severity string")
    members = spark.createDataFrame([("1", "a"), ("1", "b"), ("1", "a"), ("2", "a"), ("2", "c"), ("3", "a"), ("4", "a"), ("4", "gone"), ("4", "b"), ("5", "a"), ("5", "c")], "chain string, fingerprint string")
    claimed = spark.createDataFrame([("1", "low", None, None, "keys"), ("2", None, None, " ", ""), ("5", "medium", "own", "login", None)], "chain string, claimed string, kind string, entry_point string, asset string")
    got = {r["chain"]: (r["n_members"], r["kind"], r["severity"]) for r in surface.chains(members, found, claimed).collect()}
    assert got == {"1": (2, "attack-path", "critical"), "2": (2, "composition", "high"), "5": (2, "own", "medium")}


def test_native_sources_of_subsystems(spark):
    rows = [("r", f"src/net/f{i}.{'c' if i % 2 else 'py'}", 5, True, "entry") for i in range(4)] + [("r", "src/web/a.js", 90, True, "route"), ("r", "src/off/z.c", 50, False, "entry")]
    scored = spark.createDataFrame(rows, "repo string, path string, score int, reachable boolean, reason string")
    every = {r["subsystem"]: (r["n_files"], r["place"]) for r in surface.subsystems(scored).collect()}
    native = {r["subsystem"]: r["paths"] for r in surface.subsystems(scored, native=True).collect()}
    assert len(every) >= 2 and not any("off" in k for k in every)
    assert all(x.endswith(".c") for p in native.values() for x in p.split(",")) and sum(len(p.split(",")) for p in native.values()) == 2


def test_catalogs_of_four_roles(spark, tmp_path):
    entries = [{"cwe": "CWE-79", "taintClass": "xss", "languages": ["any"], "sourceSignals": ["query", " Query ", ""], "sinkSignals": ["html"], "sanitizerSignals": ["escape"], "structuralQueries": ["innerHTML"]}, {"cwe": "89", "taintClass": "sql"}, {"taintClass": "none"}]
    (tmp_path / "catalog.json").write_text(json.dumps({"version": 1, "entries": entries}, indent=1))
    read = catalog.read_catalog(spark, f"{tmp_path}/catalog.json")
    own = spark.createDataFrame([(89, "sink", "execute"), (79, "sanitizer", "encode"), (79, "sanitizer", "Escape"), (1, "sink", "lost")], "cwe long, role string, pattern string")
    got = [(r["cwe"], r["role"], r["pattern"], r["n"]) for r in catalog.seeds(catalog.with_signals(read, own)).orderBy("cwe", "n").collect()]
    assert got == [(79, "source", "query", 1), (79, "sink", "html", 2), (79, "sanitizer", "escape", 3), (79, "sanitizer", "encode", 4), (79, "structural", "innerHTML", 5), (89, "sink", "execute", 1)]
