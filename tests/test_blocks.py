"""Nested blocks, links inside them, literals of patterns and fixed strings by grams."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.functions.literals import candidates, matches, required
from siltstone.operators import code, dispatch, flows, scan, spans, surface, worklists
from siltstone.operators.grams import lines_with
from siltstone.sources.files import numbered_lines


def lines(spark, files):
    return numbered_lines(spark.createDataFrame([("r", p, t) for p, t in files.items()], "repo string, path string, content string"))


NESTED_JS = """function outer(a) {
  if (a) {
    early(a);
    items.map(function (b) {
      inner(b);
    });
  }
  late(a);
}
top(a);
int brace_below(int a)
{
  below(a);
}
void never_closed(int a) {
  lost(a);
"""

NESTED_PY = """import os

class Box:
    def put(self, a):
        early(a)

        def helper(b):
            inner(b)
        late(a)

    async def take(self):
        other()
    size = count()
top()
def last(a):
    return tail(a)
"""


def test_calls_after_a_nested_block_are_the_outer_ones(spark):
    got = {(r["block"], r["name"]) for r in code.block_calls(lines(spark, {"a.js": NESTED_JS, "b.py": NESTED_PY})).collect()}
    assert {("outer", "early"), ("outer", "late"), ("map", "inner"), ("brace_below", "below")} <= got
    assert {("put", "early"), ("put", "late"), ("helper", "inner"), ("take", "other"), ("Box", "count"), ("last", "tail")} <= got
    assert not any(name in ("top", "lost") for _, name in got) and ("outer", "inner") not in got and ("put", "inner") not in got


def test_spans_by_braces_and_indentation(spark):
    found = {(r["path"], r["block"], r["start"], r["end"]) for r in spans.all_spans(lines(spark, {"a.js": NESTED_JS, "b.py": NESTED_PY, "c.txt": NESTED_JS})).collect()}
    assert ("a.js", "outer", 1, 9) in found and ("a.js", "map", 4, 6) in found and ("a.js", "brace_below", 11, 14) in found and ("a.js", "never_closed", 15, None) in found
    assert ("b.py", "Box", 3, 13) in found and ("b.py", "put", 4, 10) in found and ("b.py", "helper", 7, 8) in found and ("b.py", "take", 11, 12) in found and ("b.py", "last", 15, 17) in found
    assert not any(p == "c.txt" for p, *_ in found)


def test_enclosing_blocks_and_what_lies_around(spark):
    long = "def big(a):\n" + "\n".join(f"    x{i} = {i}" for i in range(600)) + "\ny = 1"
    wide = "int big(int a) {\n" + "\n".join("  x();" for _ in range(500)) + "\n}"
    src = lines(spark, {"a.js": NESTED_JS, "b.py": NESTED_PY, "c.txt": "\n".join("z" for _ in range(100)), "d.py": long, "e.c": wide})
    at = [("a.js", 3), ("a.js", 5), ("a.js", 8), ("a.js", 10), ("a.js", 16), ("b.py", 8), ("b.py", 9), ("b.py", 14), ("c.txt", 60), ("d.py", 200), ("d.py", 500), ("e.c", 50)]
    points = spark.createDataFrame([("r", p, n) for p, n in at], "repo string, path string, line long")
    got = {(r["path"], r["line"]): (r["first"], r["last"], r["found"]) for r in spans.enclosing(points, src).collect()}
    assert got["a.js", 3] == (1, 9, True) and got["a.js", 5] == (4, 6, True) and got["a.js", 8] == (1, 9, True)
    assert got["a.js", 10] == (1, 17, False) and got["a.js", 16] == (1, 17, False)
    assert got["b.py", 8] == (7, 8, True) and got["b.py", 9] == (4, 10, True) and got["b.py", 14] == (1, 17, False)
    assert got["c.txt", 60] == (35, 85, False)
    assert got["d.py", 200] == (100, 499, True) and got["d.py", 500] == (475, 525, False)  # 401 lines are cut about the place
    assert got["e.c", 50] == (25, 75, False)


def plain_innermost(rows, line):
    inside = [s for s in rows if s[0] <= line and (s[1] is None or line <= s[1])]
    return max(inside, default=None)


@pytest.mark.parametrize("seed", range(3))
def test_innermost_spans_of_random_nesting(spark, seed):
    rnd = random.Random(seed)
    text, open_ = [], 0
    for _ in range(300):
        pick = rnd.random()
        if pick < 0.25:
            text.append(f"void f{len(text)}(int a) {{")
            open_ += 1
        elif pick < 0.5 and open_:
            n = rnd.randint(1, min(2, open_))
            text.append("} " * n)
            open_ -= n
        else:
            text.append("x();")
    src = lines(spark, {"a.c": "\n".join(text)})
    stack, rows = [], []
    for i, t in enumerate(text, 1):
        if t.endswith("{"):
            stack.append(i)
        for _ in range(t.count("}")):
            rows.append((stack.pop(), i))
    rows += [(s, None) for s in stack]
    points = src.select("repo", "path", "line")
    got = {r["line"]: (r["span"]["start"], r["span"]["end"]) if r["span"] else None for r in spans.innermost(points, spans.all_spans(src)).collect()}
    assert got == {i: plain_innermost(rows, i) for i in range(1, len(text) + 1)}


def test_links_stay_inside_a_block(spark):
    files = {
        "a.js": "function one(a) {\n  x = req.body\n  go(function () {\n    db.execute(z)\n  })\n  db.execute(x)\n}\nfunction two(a) {\n  db.execute(a)\n}",
        "b.py": "def one(a):\n    x = request.args\n    def two(b):\n        y = req.query\n    cursor.execute(x)\ncursor.execute(y)",
    }
    src = lines(spark, files)
    got = {(r["path"], r["block"], r["source_line"], r["sink_line"]) for r in flows.linked(flows.rule_hits(src), src).collect() if r["cwe"] == "CWE-89"}
    assert got == {("a.js", "one", 2, 6), ("b.py", "one", 2, 5)}


def test_slices_are_cut_from_the_block(spark):
    body = "int f(int a) {\n" + "\n".join(f"  x{i}();" for i in range(200)) + "\n}"
    src = lines(spark, {"a.c": body, "b.py": "\n".join(f"x{i}" for i in range(200)), "c.c": "y", "d.c": "int g(int a) {\n  h(a);\n}\nz"})
    o = spark.createDataFrame([("r", p, n, "k") for p, n in (("a.c", 5), ("a.c", 100), ("a.c", 199), ("b.py", 100), ("c.c", 1), ("d.c", 2))], "repo string, path string, line long, kind string")
    got = sorted((r["path"], r["line"], r["first"], r["last"], r["truncated"]) for r in surface.slices(src, o).collect())
    assert got == [("a.c", 5, 1, 80, True), ("a.c", 100, 60, 139, True), ("a.c", 199, 123, 202, True), ("b.py", 100, 75, 125, False), ("c.c", 1, 1, 1, False), ("d.c", 2, 1, 3, False)]


# -- literals -------------------------------------------------------------------------------------

EVERY = sorted({p for a in flows.RULES for p in a[1:]} | {p for pack in scan.PACKS.values() for _, p in pack.regexes()} | {p for _, p in scan.NATIVE_RULES + scan.WEB_RULES + scan.HARNESSES} | {dispatch.TABLE, dispatch.DEFINITION, dispatch.ENTRY, scan.flagged(scan.SOURCES, "smart"), scan.flagged(scan.SINKS, "smart")})


def test_required_literals():
    assert required(r"(?i)\bfree\s*\(") == ("free",)
    assert required(r"a?b*") == () and required(r"\w+\s*") == ()
    assert required(r"->|\b\w+\s*\[") == ("->", "[")
    assert required(r"(Get|Post)Mapping") == ("mapping",)
    assert required(r"(abc|x)+y{0,2}") == ("abc", "x")
    assert all(required(p) for p in EVERY)


def test_matches_hold_a_literal():
    """Texts that patterns match hold a literal of theirs: pieces of the patterns, put together at random."""
    rnd = random.Random(3)
    pieces = sorted({x for p in EVERY for x in re.findall(r"[A-Za-z_@.$]{2,}", p.replace("\\", ""))}) + ["(", " (", "[", "] ", "=", "== ", "'", '"', " ", "->", "*", ": ", "true", "{ ", "<<", "- 2 * n"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(2, 7))) for _ in range(4000)]
    hits = 0
    for p in EVERY:
        compiled, need = re.compile(p), required(p)
        for t in texts:
            if compiled.search(t):
                hits += 1
                assert any(x in t.lower() for x in need), (p, t)
    assert hits > 3000


def test_candidates_lose_no_match(spark):
    rnd = random.Random(4)
    pieces = ["req.body", "EXEC(", "Free (", "MALLOC(n)", "x[i]", "->", "eval(", "Ünï", "İ", " ", "y = 1", "", "DROP"]
    src = lines(spark, {f"{i}.js": "\n".join("".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 4))) for _ in range(40)) for i in range(5)})
    pats = [p for r in flows.RULES for p in r[1:]]
    low = candidates(src, pats)
    for p in pats[:8]:
        assert low.filter(matches(p)).count() == src.filter(src["text"].rlike(p)).count()


# -- fixed strings --------------------------------------------------------------------------------


def test_strings_are_found_by_their_rarest_gram(spark):
    rnd = random.Random(5)
    letters = "abAB ()."
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14))) for _ in range(300)] + ["日本語 text", "x"]
    src = lines(spark, {"a.c": "\n".join(texts)})
    strings = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 5))) for _ in range(80)] + ["日本", "x", None, ""]
    wanted = spark.createDataFrame([(s,) for s in strings], "signal string")
    for any_case in (False, True):
        want = sorted({(i, s) for i, t in enumerate(texts, 1) for s in strings if s and (s in t or any_case and s == s.lower() and s in t.lower())})
        assert sorted((r["line"], r["signal"]) for r in lines_with(src, wanted, any_case=any_case).collect()) == want
    assert lines_with(src, wanted.filter("signal is null")).count() == 0


def test_more_signals_than_a_bound(spark):
    src = lines(spark, {"b.c": "call_2999(x)\ncall_7(x)", "a.c": "call_7(x)"})
    wanted = spark.createDataFrame([("r", f"i{i}", f"call_{i}(", None) for i in range(3000)], "repo string, id string, signal string, language string")
    got = sorted((r["id"], r["path"], r["place"]) for r in worklists.invariant_files(src, wanted).collect())
    assert got == [("i2999", "b.c", 1), ("i7", "a.c", 1), ("i7", "b.c", 2)]


@pytest.mark.parametrize("few", [0, 256])
def test_lines_stay_in_their_tasks_when_fixed_strings_are_looked_for(spark, few):
    src = spark.createDataFrame([("a", 1, "Free(x); memcpy(y)"), ("a", 2, "free it's"), ("b", 1, None), ("b", 2, "")], "path string, line long, text string")
    wanted = spark.createDataFrame([("free",), ("Free",), ("memcpy(",), ("'",), (None,), ("",)], "signal string")
    for any_case, want in ((False, [("a", 1, "Free"), ("a", 1, "memcpy("), ("a", 2, "'"), ("a", 2, "free")]), (True, [("a", 1, "Free"), ("a", 1, "free"), ("a", 1, "memcpy("), ("a", 2, "'"), ("a", 2, "free")])):
        found = lines_with(src, wanted, any_case=any_case, few=few)
        assert sorted(tuple(r)[:2] + (r["signal"],) for r in found.collect()) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan if not few else "Join" not in plan


def test_lines_are_made_once_for_all_patterns_of_a_pack(spark):
    src = spark.createDataFrame([("r", "a.c", 1, "n")], "repo string, path string, line long, text string").withColumn("text", F.concat(F.lit("free("), "text", F.lit(");")))
    found = scan.obligations(src)
    assert [tuple(r) for r in found.collect()] == [("r", "a.c", 1, "lifetime-free")]
    # the text's expression is nowhere but below the search for literals
    assert found._jdf.queryExecution().optimizedPlan().toString().count("concat(free(") == 1
    from siltstone.functions.literals import needed

    assert ("*", "<<") in needed(dict(scan.NATIVE_RULES)["int-overflow-size"])
