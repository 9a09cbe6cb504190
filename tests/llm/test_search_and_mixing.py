"""Top-k search, source mixing and token counts."""

import math
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.llm import source_mixing, token_counts, topk_search
from siltstone.llm.queries import ORACLE_SQL, QUERIES
from siltstone.llm.workspace import fresh_path
from tests.conftest import against_duckdb
from tests.llm import plain


def brute(rows, k, every):
    valid = []
    for i, v in rows:
        if i is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        valid.append((i, tuple(math.floor(64 * c) for c in v)))
    out = []
    for at, (q, x) in enumerate(valid):
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for j, (i, y) in enumerate(valid) if j != at)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def vectors(n, dim, seed, spread=1.0):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [float(c + spread * rnd.gauss(0, 1)) for c in rnd.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_top_k_is_exact(spark, spread):
    rows = vectors(700, 8, 3, spread)
    same = rows[5][1]
    rows += [(1000 + i, same) for i in range(150)]
    rows += [(2000, None), (2020, [1.0, None] * 4), (2040, [math.nan] * 8), (2060, [math.inf] + [0.0] * 7), (None, same), (2080, [0.0] * 8), (2100, [])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = topk_search.top_k(table, 20, 20, roots=5, sample_rows=64, fan=3, subtree_rows=100, block_rows=16, page_rows=8)
    assert sorted(map(tuple, got.collect())) == brute(rows, 20, 20)


@pytest.mark.parametrize("size", [1e4, 1e6, 3e6])
def test_large_components_are_exact(spark, size):
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-size, size) for _ in range(4)]) for i in range(200)]
    rows += [(i, [size + i, size, size, size]) for i in range(200, 240)]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 20, subtree_rows=50, page_rows=8)
    assert sorted(map(tuple, got.collect())) == brute(rows, 20, 20)


def test_scores_beyond_a_long_are_an_error(spark):
    with pytest.raises(ValueError, match="fit a long"):
        topk_search.top_k(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>"))


def test_bounds_spare_products():
    """In clustered vectors, most products are ruled out by radii and stored distances."""
    rng = np.random.default_rng(1)
    x = np.floor(64 * (rng.normal(0, 1, (40, 16))[rng.integers(0, 40, 4000)] + rng.normal(0, 0.05, (4000, 16)))).astype(np.int64)
    top = float((x * x).sum(axis=1).max())
    anchors = topk_search._lifted(topk_search._routing(x[:500], 40), top)
    node = topk_search._distances(topk_search._lifted(x, top), anchors).argmin(axis=1)
    pages = []
    for n in np.unique(node):
        at = np.flatnonzero(node == n)
        pages.append(topk_search._build(pd.DataFrame({"uid": at, "vec_id": at, "v": [r.tobytes() for r in x[at]], "root": 0, "node": n}), 16, top, 32))
    subtrees = topk_search._subtrees(pd.concat(pages), 16, np.float64)
    found, products = [], 0
    for q in range(0, 4000, 200):
        counted = {}
        _, ids, score = topk_search._search(x[q : q + 1], np.array([q]), np.array([-1]), np.array([-(2**62)]), subtrees, top, 10, counted)
        products += counted["products"]
        every = x @ x[q]
        every[q] = -(2**62)
        assert score.tolist() == sorted(every.tolist(), reverse=True)[:10]
        found += ids.tolist()
    assert len(found) == 200 and products < 0.3 * 20 * 4000


def test_top_k_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk_search.top_k(spark.createDataFrame([], schema)).count() == 0
    assert topk_search.top_k(spark.createDataFrame([(1, [1.0])], schema)).count() == 0
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [3.0, -1.0]), (7, [2.0, 2.0])]
    got = topk_search.top_k(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect())) == brute(rows, 20, 20)


@pytest.mark.parametrize("name", ["op4_topk_search", "op10_token_counts"])
def test_queries_equal_their_sql(spark, small, name):
    against_duckdb(QUERIES[name](spark, small), ORACLE_SQL[name], small)


def check_mix(rows, got, tolerance=0.02):
    sizes, taken, goal = defaultdict(int), defaultdict(int), {}
    for d, t, s in rows:
        sizes[s] += len(plain.words(t))
    want = plain.targets(dict(sizes))
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    assert len(got) == len(rows)
    for s, t in goal.items():
        assert abs(taken[s] - t) <= max(2, tolerance * t), (s, taken[s], t)


def test_mix_reaches_targets(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    first = QUERIES["op3_source_mixing"](spark, small).collect()
    check_mix(rows, first)
    again = source_mixing.mix(docs.repartition(7).orderBy(F.desc("doc_id"))).collect()
    assert {(r["doc_id"], r["taken"]) for r in first} == {(r["doc_id"], r["taken"]) for r in again}


def test_mix_of_odd_rows(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join("w" * (1 + rnd.randrange(3)) for _ in range(rnd.randrange(40))), rnd.choice(["a", "a", "a", "b", "c", None, "Z"])) for i in range(400)]
    rows += [(500, None, "a"), (501, "", "b"), (502, "x y", None), (502, "x y", None), (None, "x y z", "a"), (503, "w " * 5000, "d"), (504, "", "empty")]
    table = spark.createDataFrame([(*r, "1") for r in rows], "doc_id long, text string, source string, size string")
    check_mix(rows, source_mixing.mix(table).collect(), 0.03)
    assert source_mixing.mix(table.limit(0)).count() == 0
    assert source_mixing.mixed_documents(table).columns == table.columns


def test_small_sources_reach_their_targets(spark):
    big = spark.range(1000).selectExpr("id as doc_id", "repeat('w ', 4000) as text", "'big' as source")
    tiny = spark.range(5000, 5020).selectExpr("id as doc_id", "repeat('v ', 60) as text", "concat('tiny', id) as source")
    docs = big.union(tiny)
    for r in source_mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert r["target"] > 0 and r["taken"] == int(r["target"])
    assert source_mixing.mixed_documents(docs).filter("source <> 'big'").select("source").distinct().count() == 20


def test_equal_texts_of_two_sources_are_two_documents(spark):
    rows = [(i, " ".join(["w"] * 30), s) for i in range(20) for s in ("a", "b")] + [(100 + i, " ".join(["v"] * 40), "a") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check_mix(rows, source_mixing.mix(docs).collect())
    named = docs.selectExpr("*", "'x' as tag", "'y' as times", "'z' as row", "'u' as d_", "1 as size")
    mixed = source_mixing.mixed_documents(named)
    assert mixed.columns == named.columns
    assert set(map(tuple, mixed.select("tag", "times", "row", "d_", "size").collect())) == {("x", "y", "z", "u", 1)}


def test_slots_decide_what_is_taken(spark, monkeypatch):
    """The beginning of the mix holds the shares, and without slots the targets aren't reached."""
    docs = spark.range(6000).selectExpr("id as doc_id", "concat(id, repeat(' w', 20)) as text", "case when id % 6 = 0 then 'a' when id % 6 < 3 then 'b' else 'c' end as source")
    got = source_mixing.mix(docs).collect()
    total = {r["source"]: r["target"] for r in got}
    slots = max(r["first_slot"] for r in got if r["first_slot"] is not None)
    for part in (8, 4, 2):
        # in that part of the schedule each document is met for the first time
        seen = {s: sum(r["size"] for r in got if r["source"] == s and r["first_slot"] is not None and r["first_slot"] < slots / part) for s in total}
        held = [seen[s] / total[s] for s in total]
        assert max(held) < 1.03 * min(held) and max(held) < 1.0 / part
    schedule = source_mixing.schedule
    monkeypatch.setattr(source_mixing, "schedule", lambda shares, slots: schedule(shares, slots).filter("false"))
    none = source_mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(r["taken"] < 0.05 * r["target"] for r in none)


def test_slots_spread_evenly(spark):
    shares = spark.createDataFrame([("a", 60.0), ("b", 30.0), (None, 10.0)], "source string, target double")
    rows = sorted(source_mixing.schedule(shares, 1000).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(1000))
    for source, share in (("a", 0.6), ("b", 0.3), (None, 0.1)):
        ranks = [r["rank"] for r in rows if r["source"] == source]
        assert ranks == list(range(len(ranks)))
        for upto in (100, 500, 1000):
            assert abs(sum(r["source"] == source for r in rows[:upto]) - share * upto) < 5


def test_rollup_compacts_itself(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "COMPACT_AFTER", 3)
    r = token_counts.Rollup(spark, fresh_path(spark, "compacting"))
    want, most = {}, 0
    for i in range(8):
        rows = [(i % 3, "t", "revise", "a", "en", 10 + i, 0), (100 + i, "t", "insert", "b", None, i, 0)]
        assert r.apply(f"batch {i}", spark.createDataFrame(rows, token_counts.EVENT))
        want |= {(d, s): n for d, _, _, s, _, n, _ in rows}
        most = max(most, len(r._since_base()))
    assert most <= 4 and [b for _, b in r.commits()] == [f"batch {i}" for i in range(8)]
    assert not r.apply("batch 1", spark.createDataFrame([(0, "t", "delete", "a", "en", 0, 0)], token_counts.EVENT))
    assert {(x["source"], x["docs"], x["tokens"]) for x in r.totals().collect()} == {("a", 3, sum(n for (_, s), n in want.items() if s == "a")), ("b", 8, sum(range(8)))}
    assert {(x["doc_id"], x["source"]): x["tokens"] for x in r.state().collect()} == want


def test_rollup_commits_once(spark):
    r = token_counts.Rollup(spark, fresh_path(spark, "test"))
    e = lambda rows: spark.createDataFrame(rows, token_counts.EVENT)
    assert r.totals().count() == 0
    load = e([(1, "t", "insert", "a", "en", 10, 0), (2, "t", "insert", "a", None, 5, 0), (3, "u", "insert", None, "en", 7, 0), (None, "t", "insert", "a", "en", 99, 0), (4, "t", "drop", "a", "en", 99, 0)])
    assert r.apply("one", load)
    assert not r.apply("one", load)
    assert r.apply("two", e([(1, "t", "revise", "b", "en", 12, 0), (2, "t", "delete", None, None, None, 0), (9, "t", "delete", "a", "en", 4, 0), (3, "u", "revise", None, "en", 1, 0), (3, "u", "revise", None, "en", 8, 1)]))
    assert r.apply("empty", e([]))
    got = {(x["source"], x["lang"], x["tokenizer"]): (x["docs"], x["tokens"], x["inserts"], x["deletes"], x["revisions"]) for x in r.totals().collect()}
    assert got == {("a", "en", "t"): (0, 0, 1, 0, 0), ("a", None, "t"): (0, 0, 1, 1, 0), ("b", "en", "t"): (1, 12, 0, 0, 1), (None, "en", "u"): (1, 8, 1, 0, 1)}
    assert [b for _, b in r.commits()] == ["one", "two", "empty"]


def test_of_two_writers_one_goes_on(spark):
    """Another writer takes the number just before a commit: the batch is counted on top of it."""
    path = fresh_path(spark, "test")
    r, other = token_counts.Rollup(spark, path), token_counts.Rollup(spark, path)
    e = lambda rows: spark.createDataFrame(rows, token_counts.EVENT)
    commit, first = r._commit, []

    def late(number, batch, attempt, base=False):
        if not first:
            first.append(other.apply("b", e([(1, "t", "insert", "a", "en", 10, 0)])))
        return commit(number, batch, attempt, base)

    r._commit = late
    assert r.apply("a", e([(1, "t", "insert", "a", "en", 4, 0)])) and first == [True]
    assert [(x["docs"], x["tokens"], x["inserts"], x["revisions"]) for x in r.totals().collect()] == [(1, 4, 1, 1)]
    assert r.commits() == [(1, "b"), (2, "a")]


def test_rollup_equals_a_recount(spark):
    rnd = random.Random(4)
    r = token_counts.Rollup(spark, fresh_path(spark, "test"))
    held = {}
    for b in range(4):
        rows = []
        for s in range(60):
            k, op = (rnd.randrange(30), rnd.choice("tu")), rnd.choice(["insert", "revise", "delete"])
            value = (rnd.choice("ab"), rnd.choice("xy"), rnd.randrange(50))
            rows.append((k[0], k[1], op, *value, s))
            held.pop(k, None)
            if op != "delete":
                held[k] = value
        r.apply(str(b), spark.createDataFrame(rows, token_counts.EVENT))
        if b == 1:
            assert r.compact() and not r.apply("0", spark.createDataFrame(rows, token_counts.EVENT))
    want = defaultdict(lambda: [0, 0])
    for (_, t), (s, g, n) in held.items():
        want[s, g, t][0] += 1
        want[s, g, t][1] += n
    got = {(x["source"], x["lang"], x["tokenizer"]): [x["docs"], x["tokens"]] for x in r.totals().collect() if x["docs"]}
    assert got == want
