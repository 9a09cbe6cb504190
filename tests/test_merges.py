"""Merged tables, keyed streams, path templates, overlaps and paths from both ends."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from siltstone.operators import merged, overlaps, paths, stores, traffic
from siltstone.streaming import crashes


def test_versions_are_numbered(spark, tmp_path):
    table = stores.Versions(spark, f"file://{tmp_path}/t")
    assert table.latest() == 0 and table.read("key string, n long").count() == 0
    assert table.replace(spark.createDataFrame([("a", 1)], "key string, n long")) == 1 and table.latest() == 1


SCHEMA = "key string, n long, other string"


def frame(spark, rows):
    return spark.createDataFrame([(k, n, f"{k}{n}") for k, n in rows], SCHEMA)


def table_at(spark, path, buckets=4):
    return merged.MergedTable(spark, f"file://{path}", frame(spark, []).schema, ["key"], [F.col("n")], buckets)


def held(table):
    return {r["key"]: (r["n"], r["other"]) for r in table.read().collect()}


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    table = table_at(spark, tmp_path / "t", 16)
    assert held(table) == {}
    table.upsert(frame(spark, [(f"k{i}", 1) for i in range(200)]))
    table.upsert(frame(spark, [("k3", 5), ("k3", 4), (None, 2)]))
    first, second = table.log.entries()
    assert len(first["buckets"]) == 16 and len(second["buckets"]) <= 2
    assert held(table)["k3"] == (5, "k35") and held(table)["k4"] == (1, "k41") and held(table)[None] == (2, "None2") and len(held(table)) == 201


def test_batches_are_committed_once_and_old_rows_do_not_win(spark, tmp_path):
    table = table_at(spark, tmp_path / "t")
    assert table.upsert(frame(spark, [("a", 3)]), "one") and not table.upsert(frame(spark, [("a", 9)]), "one")
    assert table.upsert(frame(spark, [("a", 2), ("b", 1)]), "two")
    assert held(table) == {"a": (3, "a3"), "b": (1, "b1")}


def test_two_writers_lose_nothing(spark, tmp_path):
    one, two = table_at(spark, tmp_path / "t"), table_at(spark, tmp_path / "t")
    # the second writer reads the log before the first one commits
    entries, stale = two.log.entries, [two.log.entries()]
    two.log.entries = lambda: stale.pop() if stale else entries()
    assert one.upsert(frame(spark, [("a", 1), ("b", 7)]))
    assert two.upsert(frame(spark, [("a", 2), ("c", 1)]))
    assert [e["number"] for e in one.log.entries()] == [1, 2]
    assert held(one) == {"a": (2, "a2"), "b": (7, "b7"), "c": (1, "c1")}


def test_compaction_keeps_rows_and_what_comes_meanwhile(spark, tmp_path):
    rnd = random.Random(2)
    table, want = table_at(spark, tmp_path / "t"), {}
    for i in range(5):
        rows = [(f"k{rnd.randrange(12)}", rnd.randrange(100)) for _ in range(9)]
        table.upsert(frame(spark, rows))
        for k, n in rows:
            want[k] = max(want.get(k, -1), n)
        if i == 2:
            # another writer commits while this one compacts
            write, other = table._write, table_at(spark, tmp_path / "t")

            def slow(rows, attempt, write=write, other=other):
                other.upsert(frame(spark, [("k1", 1000), ("new", 1)]))
                return write(rows, attempt)

            table._write = slow
            assert table.compact(1)
            table._write = write
            want |= {"k1": 1000, "new": 1}
    before = {k: v[0] for k, v in held(table).items()}
    assert before == want
    table.compact(0)
    assert {k: v[0] for k, v in held(table).items()} == want
    assert table.vacuum() > 0 and table.vacuum() == 0
    assert {k: v[0] for k, v in held(table).items()} == want and all(len(p) == 1 for p in table._parts().values())


def test_streams_are_folded_in(spark, tmp_path):
    table = table_at(spark, tmp_path / "t")

    def arrive(*rows):
        frame(spark, rows).write.mode("append").parquet(f"{tmp_path}/in")
        merged.upsert_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), table, f"{tmp_path}/progress", 1)
        return {k: v[0] for k, v in held(table).items()}

    assert arrive(("a", 1), ("b", 5), ("a", 3)) == {"a": 3, "b": 5}
    assert arrive(("a", 2), ("c", 1)) == {"a": 3, "b": 5, "c": 1}
    assert arrive(("c", 0), ("b", 6)) == {"a": 3, "b": 6, "c": 1}


def test_crash_flags_come_from_state(spark, tmp_path):
    """Restarted twice; rows of a batch in any order, equal times, nulls and other columns."""
    schema, name = "crash_key string, seen_at timestamp, note string", uuid.uuid4().hex

    def arrive(*rows):
        spark.createDataFrame(rows, "crash_key string, t string, note string").select("crash_key", F.to_timestamp("t").alias("seen_at"), "note").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        got = crashes.flagged(stream, f"file://{tmp_path}/{name}", f"{tmp_path}/progress").collect()
        assert len({(r["crash_key"], r["note"]) for r in got}) == len(got)
        return {(r["crash_key"], r["note"]): r["duplicate"] for r in got}

    one = arrive(("a", "2024-01-02", "x"), ("a", "2024-01-01", "y"), ("b", "2024-01-05", None), ("b", "2024-01-05", "z"), (None, "2024-01-09", "n"))
    want = {("a", "x"): True, ("a", "y"): False, ("b", None): False, ("b", "z"): True, (None, "n"): False}
    assert one == want
    want |= {("a", "late"): True, ("c", "c1"): False}
    assert arrive(("a", "2023-01-01", "late"), ("c", "2024-02-01", "c1")) == want
    want |= {("c", "c2"): True, (None, "n2"): True}
    assert arrive(("c", "2024-02-02", "c2"), (None, "2024-02-02", "n2")) == want


@pytest.mark.parametrize(("path", "template"), [
    ("/users/7", "/users/:id"), ("/users/me", "/users/me"), ("/users/7/posts", "/users/{id}/posts"), ("/users/7/likes", "/users/{id}/<str:kind>"), ("/a/b", "/a/:x"), ("/c/b", "/:x/b"), ("/z/y", "/*/[slug]"), ("/users/7/posts/1", None), ("/", None), ("/users//", None),
])
def test_paths_meet_their_most_specific_template(spark, path, template):
    routes = ["/users/:id", "/users/me", "/users/{id}/posts", "/users/{id}/<str:kind>", "/a/:x", "/:x/b", "/*/[slug]", "/idle/one"]
    seen = spark.createDataFrame([("r", "get", path, 3), ("r", "POST", path, 1), ("s", "GET", path, 1)], "repo string, method string, path string, n long")
    got = traffic.correlate(seen, spark.createDataFrame([("r", "GET", t) for t in routes], "repo string, method string, path string")).collect()
    mine = [(r["template"], r["state"], r["n"]) for r in got if r["repo"] == "r" and r["method"] == "GET" and r["path"] == path and r["n"]]
    if path == "/users//":
        assert mine == [(None, "shadow", 3)] or mine[0][1] == "shadow"
    else:
        assert mine == [(template, "mapped" if template else "shadow", 3)]
    assert sum(r["state"] == "no-traffic" for r in got) == len(routes) - bool(template)
    assert sum(r["state"] == "shadow" for r in got) == 2 + (template is None)


def test_overlaps_are_counted_without_pairs(spark):
    rnd = random.Random(4)
    pick = lambda: [rnd.choice(["a", "b", "c", "d", None]) for _ in range(rnd.randrange(4))]
    left, right = [(f"k{i % 15}", pick()) for i in range(20)], [(f"i{i}", pick()) for i in range(60)]
    got = {r["key"]: (r["n"], r["first"]) for r in overlaps.overlap(spark.createDataFrame(left, "key string, xs array<string>"), spark.createDataFrame(right, "id string, xs array<string>"), "xs", "key").collect()}
    want = {}
    for k in {k for k, _ in left}:
        mine = {x for j, xs in left if j == k for x in xs if x}
        met = sorted({i for i, xs in right if mine & set(xs)})
        if met:
            want[k] = (len(met), met[0])
    assert got == want
    numbers = sorted(r["number"] for r in overlaps.numbered(spark.range(70_000).select(F.col("id").cast("string").alias("id"))).collect())
    assert numbers == list(range(1, 70_001))


@pytest.mark.parametrize("hops", [1, 2, 3, 4, 5])
def test_witness_paths_are_shortest(spark, hops):
    rnd = random.Random(hops)
    nodes = [f"n{i:02d}" for i in range(40)]
    edges = {(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(70)}
    sources, sinks = nodes[:5] + [None], nodes[3:9]
    got = paths.witness_paths(spark.createDataFrame([*edges, (None, "n01")], "src string, dst string"), spark.createDataFrame([(x,) for x in sources], "node string"), spark.createDataFrame([(x,) for x in sinks], "node string"), hops).collect()
    want = {}
    for s in sources[:-1]:
        level, seen = {s}, {s: 0}
        for h in range(1, hops + 1):
            level = {b for a, b in edges if a in level} - set(seen)
            seen |= dict.fromkeys(level, h)
        want |= {(s, t): seen[t] for t in sinks if t in seen}
    assert {(r["source"], r["sink"]): r["hops"] for r in got} == want
    for r in got:
        p = r["path"]
        assert p[0] == r["source"] and p[-1] == r["sink"] and len(p) == r["hops"] + 1 and p[(r["hops"] + 1) // 2] == r["meeting"]
        assert all(x in edges for x in zip(p, p[1:]))


def test_meetings_of_many_trails_are_the_least_and_each_pair_comes_once(spark):
    layer = lambda name, n: [f"{name}{i:02d}" for i in range(n)]
    layers = [layer("s", 4), layer("c", 20), layer("b", 20), layer("d", 20), layer("t", 70)]
    edges = [(x, y) for one, two in zip(layers, layers[1:]) for x in one for y in two] + [("s00", "t03"), ("s01", "c19"), ("c19", "t04")]
    node = lambda xs: spark.createDataFrame([(x,) for x in xs], "node string")
    got = paths.witness_meetings(spark.createDataFrame(edges, "src string, dst string"), node(layers[0]), node([*layers[4], "s02"]), 4).collect()
    want = {(s, t): (4, "b00") for s in layers[0] for t in layers[4]}
    want |= {(s, "t04"): (2, "c19") for s in layers[0]} | {("s00", "t03"): (1, "t03"), ("s02", "s02"): (0, "s02")}
    assert len(got) == len(want) and {(r["source"], r["sink"]): (r["hops"], r["meeting"]) for r in got} == want
