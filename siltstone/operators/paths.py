"""Shortest paths from sources to sinks, each by its middle node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.ranking import placed
from siltstone.operators.stores import written


def _steps(edges: DataFrame, starts: DataFrame, src: str, dst: str, hops: int) -> DataFrame:
    """``origin, node, hop, trail``: what each start reaches within ``hops``, with one shortest trail to it.

    A step joins the newest nodes only; of equally short trails the least one stays,
    and a node that its origin has reached before is left out.
    """
    front = written(starts.select(F.col("node").alias("origin"), "node").distinct().withColumn("hop", F.lit(0)).withColumn("trail", F.array("node")), "front")
    seen = front
    for i in range(1, hops + 1):
        new = front.join(edges, F.col("node") == F.col(src)).select("origin", F.col(dst).alias("node"), "trail")
        new = new.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").groupBy("origin", "node").agg(F.min(F.concat("trail", F.array("node"))).alias("trail"))
        front = written(new.select("origin", "node", F.lit(i).alias("hop"), "trail"), "front")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def _bit(t: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (t % 64).cast("int"))


def _reached(edges: DataFrame, first: DataFrame, hops: int) -> DataFrame:
    """``node``: what walks from the sources come to on their way, within one hop less than ``hops``."""
    seen = front = written(first.select("node").distinct(), "reached")
    for _ in range(hops - 2):
        new = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = written(new, "reached")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def witness_meetings(edges: DataFrame, sources: DataFrame, sinks: DataFrame, hops: int = 4) -> DataFrame:
    """``source, sink, hops, meeting``: each pair that is joined within ``hops``, and the least node in the middle of a shortest path.

    ``edges(src, dst)``, ``sources(node)``, ``sinks(node)``.  Pairs are found hop by
    hop.  A pair that no fewer hops join is joined by shortest paths only, so any walk
    counts.  What lies behind the first step is the same for all sources: for each
    node there and each sink the least middle node is found once, and a source takes
    the least of its neighbours'.  Sinks are bits of words, by which pairs of fewer
    hops are left out before anything is joined for them; so rows grow with the
    pairs and the sources' edges, not with the trails between them.  A node that is source and sink
    is a pair of 0 hops; nulls lead nowhere.
    """
    edges = written(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "edges")
    sources = written(sources.select("node").filter("node is not null").distinct(), "sources")
    sinks = written(sinks.select("node").filter("node is not null").distinct(), "sinks")
    same = sources.join(sinks, "node").select(F.col("node").alias("source"), F.col("node").alias("sink"), F.lit(0).alias("hops"), F.col("node").alias("meeting"))
    if hops < 1:
        return same
    begins = written(placed(sources, [], [], "node", "s"), "begins")
    first = written(begins.join(edges, F.col("node") == F.col("src")).select("s", F.col("dst").alias("node")), "first")
    reached = _reached(edges, first, hops)
    nodes = written(placed(reached, [], [], "node", "a"), "nodes")
    inner = written(edges.join(reached, F.col("src") == F.col("node"), "left_semi"), "inner")
    hit = first.select("node").union(inner.select(F.col("dst").alias("node"))).distinct()
    ends = written(placed(sinks.join(hit, "node", "left_semi"), [], [], "node", "t"), "ends")

    def numbered(rows: DataFrame, column: str, by: DataFrame, number: str, name: str, how: str = "inner") -> DataFrame:
        return rows.join(by.select(F.col("node").alias(column), F.col(number).alias(name)), column, how)

    starts = written(numbered(first, "node", nodes, "a", "a").select("s", "a"), "starts")
    steps = numbered(numbered(numbered(inner, "src", nodes, "a", "a"), "dst", nodes, "a", "b", "left"), "dst", ends, "t", "t", "left")
    steps = written(steps.select("a", "b", "t"), "steps")
    onward = steps.filter("b is not null").select(F.col("a").alias("_from"), F.col("b").alias("a"))
    # the sinks that walks of just so many hops lead to
    tails = [nodes.join(ends, "node").select("a", "t"), steps.filter("t is not null").select("a", "t")]
    for _ in range(2, hops // 2 + 1):
        tails.append(written(onward.join(tails[-1], "a").select(F.col("_from").alias("a"), "t").distinct(), "tails"))
    done = written(numbered(numbered(same, "source", begins, "s", "s"), "sink", ends, "t", "t").select("s", F.expr("t div 64").alias("word"), _bit(F.col("t")).alias("new")), "found")
    out = None
    for h in range(1, hops + 1):
        best = tails[h // 2].withColumn("m", F.col("a"))
        for _ in range((h + 1) // 2 - 1):
            best = onward.join(best, "a").groupBy(F.col("_from").alias("a"), "t").agg(F.min("m").alias("m"))
        best = written(best.groupBy("a", F.expr("t div 64").alias("word")).agg(F.bit_or(_bit(F.col("t"))).alias("bits"), F.collect_list(F.struct("t", "m")).alias("best")), "best")
        known = done.groupBy("s", "word").agg(F.bit_or("new").alias("known"))
        any_ = starts.join(best.select("a", "word", "bits"), "a").groupBy("s", "word").agg(F.bit_or("bits").alias("bits"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long"))))
        new = written(any_.join(known, ["s", "word"], "left").select("s", "word", fresh.alias("new")).filter("new <> 0"), "found")
        wanted = starts.join(new, "s").join(best, ["a", "word"]).filter(F.col("bits").bitwiseAND(F.col("new")) != 0)
        each = F.explode(F.filter("best", lambda x: F.col("new").bitwiseAND(_bit(x["t"])) != 0)).alias("x")
        pairs = wanted.select("s", each).select("s", "x.t", "x.m").groupBy("s", "t").agg(F.min("m").alias("m")).withColumn("hops", F.lit(h))
        out = pairs if out is None else out.union(pairs)
        done = done.union(new)
    named = out.join(begins.select("s", F.col("node").alias("source")), "s").join(ends.select("t", F.col("node").alias("sink")), "t").join(nodes.select(F.col("a").alias("m"), F.col("node").alias("meeting")), "m")
    return same.union(named.select("source", "sink", "hops", "meeting"))


def witness_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, hops: int = 4) -> DataFrame:
    """``source, sink, hops, meeting, path``: :func:`witness_meetings` with one shortest path through each meeting node.

    A path is the least trail from its source to the meeting node and the least one
    from its sink back to it, so every trail has at most half of the hops.
    """
    edges = written(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "edges")
    met = written(witness_meetings(edges, sources, sinks, hops), "met")
    there = _steps(edges, met.select(F.col("source").alias("node")), "src", "dst", (hops + 1) // 2)
    back = _steps(edges, met.select(F.col("sink").alias("node")), "dst", "src", hops // 2)
    a = there.select(F.col("origin").alias("source"), F.col("node").alias("meeting"), F.col("trail").alias("head"))
    b = back.select(F.col("origin").alias("sink"), F.col("node").alias("meeting"), F.col("trail").alias("tail"))
    # a meeting node is as far from its ends as the shortest trails are long
    joined = met.join(a, ["source", "meeting"]).join(b, ["sink", "meeting"])
    return joined.select("source", "sink", "hops", "meeting", F.concat("head", F.expr("slice(reverse(tail), 2, size(tail))")).alias("path"))
