"""Symbols, calls, routes and the surroundings of anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.literals import once
from siltstone.operators.ranking import placed
from siltstone.operators.spans import all_spans, innermost
from siltstone.operators.stores import written


def blast_radius(anchors: DataFrame, symbols: DataFrame) -> DataFrame:
    """``repo, fingerprint, blast``: callers of the symbol around each anchor, an as-of join.

    The symbol is the last one of the file that starts at or before the anchor's
    line, of equal lines the one with most callers; before the first symbol it is
    the greatest count of the file, without symbols 0.  Both tables are laid
    on one line order a file, so that nothing is joined in pairs.
    """
    points = anchors.select("repo", "file_path", "line", F.lit(1).alias("side"), "fingerprint", F.lit(None).cast("long").alias("callers"))
    marks = symbols.groupBy("repo", "file_path", "line").agg(F.max("caller_count").alias("callers")).select("repo", "file_path", "line", F.lit(0).alias("side"), F.lit(None).cast("string").alias("fingerprint"), "callers")
    order = Window.partitionBy("repo", "file_path").orderBy("line", "side")
    seen = points.unionByName(marks).withColumn("as_of", F.last("callers", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("side = 1")
    most = symbols.groupBy("repo", "file_path").agg(F.max("caller_count").alias("most"))
    return seen.join(most, ["repo", "file_path"], "left").select("repo", "fingerprint", F.coalesce("as_of", "most", F.lit(0)).alias("blast"))


def caller_weight(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("repo", "file_path").agg(F.sum("caller_count").alias("weight"))


def top_symbols(symbols: DataFrame, limit: int = 12) -> DataFrame:
    """Each file's ``limit`` most called symbols as one text, and the greatest count."""
    order = Window.partitionBy("repo", "file_path").orderBy(F.desc("caller_count"), "name", "line")
    top = symbols.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)
    return top.groupBy("repo", "file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), ",").alias("symbols"), F.max("caller_count").alias("most_callers"))


def definitions(symbols: DataFrame, names: DataFrame, limit: int = 5) -> DataFrame:
    """At most ``limit`` definitions of each called name, by file and line."""
    order = Window.partitionBy("repo", "name").orderBy("file_path", "line")
    defs = symbols.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)
    return names.join(defs, ["repo", "name"])


def call_sites(lines: DataFrame, stop_words=("if", "for", "while", "switch", "return", "catch", "function", "sizeof", "def", "class")) -> DataFrame:
    """``repo, path, line, name``: names that an opening bracket follows, with their lines."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]+)\s*\("), 1))
    calling = once(lines.select("repo", "path", "line", "text"), "text", F.col("text")).filter(F.col("text").contains("("))
    return once(calling, "names", names).select("repo", "path", "line", F.explode("names").alias("name")).filter(~F.col("name").isin(*stop_words))


def code_graph(defs: DataFrame, calls: DataFrame, limit: int = 400) -> DataFrame:
    """``repo, name, file, line, def_count, caller_count``: each repo's ``limit`` most called names.

    Every definition is a call token as well, so the number of callers is that of
    tokens beyond the definitions.
    """
    d = defs.filter(F.length("name") > 1).groupBy("repo", "name").agg(F.min(F.struct("file_path", "line")).alias("first"), F.count("*").alias("def_count"))
    c = calls.groupBy("repo", "name").agg(F.sum("n").alias("n"))
    met = d.join(c, ["repo", "name"], "left").select("repo", "name", F.col("first.file_path").alias("file_path"), F.col("first.line").alias("line"), "def_count", F.greatest(F.lit(0), F.coalesce("n", F.lit(0)) - F.col("def_count")).alias("caller_count"))
    return met.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("caller_count"), "name"))).filter(F.col("place") <= limit)


def called_elsewhere(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Symbols that another file calls."""
    s, c = symbols.alias("s"), calls.select("repo", "name", F.col("file_path").alias("from_path")).distinct().alias("c")
    return s.join(c, (F.col("s.repo") == F.col("c.repo")) & (F.col("s.name") == F.col("c.name")) & (F.col("s.file_path") != F.col("c.from_path")), "left_semi")


def k_hop(edges: DataFrame, starts: DataFrame, hops: int = 4) -> DataFrame:
    """``node, hop``: what ``edges(src, dst)`` reach from ``starts(node)`` within ``hops``, and the least number of hops.

    Each step joins the newest nodes only, leaves out those already reached, and is
    written, so that no later step derives it again.
    """
    edges = written(edges.select("src", "dst").distinct(), "edges")
    seen = front = written(starts.select("node").distinct().withColumn("hop", F.lit(0)), "hop")
    for i in range(1, hops + 1):
        new = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(i))
        front = written(new, "hop")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def excerpts(anchors: DataFrame, lines: DataFrame, radius: int = 10) -> DataFrame:
    """Lines around each anchor: ``repo, path, at, n_lines, first_line, n_chars``; an anchor beyond its file has none.

    Anchors are blown up to the lines they cover, so that the join is one of equal keys.
    """
    cover = F.explode(F.sequence(F.greatest(F.lit(1), F.col("at") - radius), F.col("at") + radius)).alias("line")
    wanted = anchors.select("repo", "path", "at", cover)
    met = wanted.join(lines, ["repo", "path", "line"], "left")
    return met.groupBy("repo", "path", "at").agg(F.count("text").alias("n_lines"), F.min(F.when(F.col("text").isNotNull(), F.col("line"))).alias("first_line"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"))


def per_file_cap(hits: DataFrame, k: int) -> DataFrame:
    return hits.withColumn("n", F.row_number().over(Window.partitionBy("repo", "path").orderBy("line"))).filter(F.col("n") <= k).drop("n")


def even_sample(rows: DataFrame, group: list[str], order: list[Column], cap: int) -> DataFrame:
    """Of a group of n > cap rows those at floor(k * n / cap), k from 0 to cap - 1; smaller groups whole."""
    n = F.count("*").over(Window.partitionBy(*group))
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    # row i is the k-th pick if floor(k n / cap) = i for k = ceil(i cap / n)
    k = F.ceil(F.col("_i") * cap / F.col("_n"))
    picked = (F.col("_n") <= cap) | ((F.floor(k * F.col("_n") / cap) == F.col("_i")) & (k < cap))
    return rows.withColumn("_n", n).withColumn("_i", at).filter(picked).drop("_n", "_i")


def interleave(rows: DataFrame, kinds: tuple[str, str], order: list[tuple[str, bool]], tie: str) -> DataFrame:
    """Rows of two kinds ranked each on its own and put in turn, the first kind first: ``slot`` from 1.

    A row's slot follows from its own rank and the number of rows of the other kind, so
    that no task has a repository's rows in one order.
    """
    own = written(placed(rows.filter(F.col("kind").isin(*kinds)), ["repo", "kind"], order, tie, "_own", prefix=6), "ranked")
    counts = own.groupBy("repo").agg(*[F.count_if(F.col("kind") == k).alias(f"_n{i}") for i, k in enumerate(kinds)])
    slot = F.when(F.col("kind") == kinds[0], F.col("_own") + F.least(F.col("_own") - 1, "_n1")).otherwise(F.col("_own") + F.least("_own", "_n0"))
    return own.join(counts, "repo").withColumn("slot", slot.cast("int")).drop("_own", "_n0", "_n1")


def blocks(lines: DataFrame, header: str = r"\)\s*\{\s*$", control: str = r"^\s*(if|for|while|switch|else|do|catch)\b") -> DataFrame:
    """``repo, path, start, end``: spans of functions by brace balance.

    The depth of a line is the running balance of braces up to it.  A header opens a
    block; its end is the first later line at which the balance is back.  Control
    statements aren't headers.
    """
    order = Window.partitionBy("repo", "path").orderBy("line")
    ups = F.length("text") - F.length(F.replace(F.col("text"), F.lit("{"), F.lit("")))
    downs = F.length("text") - F.length(F.replace(F.col("text"), F.lit("}"), F.lit("")))
    deep = lines.withColumn("after", F.sum(ups - downs).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("after") - (ups - downs))
    is_head = F.col("text").rlike(header) & ~F.col("text").rlike(control) & (F.col("after") > F.col("before"))
    heads = deep.filter(is_head).select("repo", "path", F.col("line").alias("start"), F.col("before").alias("depth"))
    # a line closes every depth from its balance up to that before it
    closes = deep.filter(F.col("after") < F.col("before")).select("repo", "path", F.col("line").alias("close"), F.explode(F.sequence(F.col("after"), F.col("before") - 1)).alias("depth"))
    marks = heads.select("repo", "path", "depth", F.col("start").alias("line"), F.lit(0).alias("side")).union(closes.select("repo", "path", "depth", F.col("close").alias("line"), F.lit(1).alias("side")))
    later = Window.partitionBy("repo", "path", "depth").orderBy("line", "side").rowsBetween(1, Window.unboundedFollowing)
    ended = marks.withColumn("end", F.first(F.when(F.col("side") == 1, F.col("line")), ignorenulls=True).over(later))
    return ended.filter("side = 0").select("repo", "path", F.col("line").alias("start"), "end")


def block_calls(lines: DataFrame, most: int = 40, spans: DataFrame | None = None) -> DataFrame:
    """``repo, path, start, block, name, first, n, place``: the first ``most`` names that each block calls, in order of their first line.

    A call belongs to the innermost block around it, so those after a nested block
    are the outer one's again; calls of the block itself don't count.
    ``spans`` are the lines' blocks, if they are known.
    """
    inside = innermost(call_sites(lines), all_spans(lines) if spans is None else spans).filter("span.end is not null and name <> span.block")
    each = inside.groupBy("repo", "path", F.col("span.start").alias("start"), F.col("span.block").alias("block"), "name").agg(F.min("line").alias("first"), F.countDistinct("line").alias("n"))
    return each.withColumn("place", F.row_number().over(Window.partitionBy("repo", "path", "start").orderBy("first", "name"))).filter(F.col("place") <= most)


def call_edges(called: DataFrame, symbols: DataFrame) -> DataFrame:
    """``repo, src, dst, path, line``: blocks and the names that they call, beside the name's first definition, if it has one."""
    first = symbols.groupBy("repo", "name").agg(F.min(F.struct("path", "line")).alias("d"))
    edges = called.select("repo", F.col("block").alias("src"), "name").distinct()
    return edges.join(first, ["repo", "name"], "left").select("repo", "src", F.col("name").alias("dst"), "d.path", "d.line")
