"""Mixing sources to target weights by a low-discrepancy schedule.

Targets fill up by weight to a limit a source (:func:`targets`).  A schedule of
slots is laid out: golden-ratio point ``frac(i * phi)`` of slot i falls into one
source's share of the unit interval, so that every stretch of the schedule holds
each source in proportion.  A source's slots are ranked, and rank r takes block r
of the source: its documents in hashed order, laid end to end and cut every
``block_words`` words, begun again after the last.  Ranks that a source lacks up to its target follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.workspace import written

#: The golden ratio's fractional part, the step between schedule points.
GOLDEN = 0.6180339887498949
#: Slots that a source can lack at most: of N golden-ratio points an interval of length p holds
#: N p within 3 + 2.1 ln N, under 64 for N below 10^12.
LACK = 64
WEIGHTS = (3, 1, 2)


def words(text: Column) -> Column:
    """Number of runs of non-blank characters; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """``source, weight, source_size, target``, one row a source.

    Sources in order of code point, null last, take the weights in turn.  They
    share ``share`` times all sizes by weight; one that would pass ``limit`` times
    its size stops there, and the excess is shared again.  The fixed point is found
    at once: in order of limit to weight, a source is full exactly if the level
    that all sources from it on would reach is at least its own ratio.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    ranked = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * limit).withColumn("ratio", F.col("most") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0))
    before = Window.orderBy("ratio", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("open", F.col("level") < F.col("ratio"))
    # sources are full up to the first open one, whose level all later ones share
    first = F.min(F.when(F.col("open"), F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level"))).over(everything)
    ranked = ranked.withColumn("first", first)
    full = F.col("first").isNull() | (F.col("ratio") < F.col("first.ratio")) & ~F.col("open")
    return ranked.select("source", "weight", "source_size", F.when(full, F.col("most")).otherwise(F.least(F.col("most"), F.col("weight") * F.col("first.level"))).alias("target"))


def schedule(shares: DataFrame, slots: int) -> DataFrame:
    """``slot, source, rank``: ``slots`` golden-ratio points dealt to sources and ranked in each.

    ``shares``: source and target.  Ranks are found by ranges of slots, so that no
    source's slots meet in one task.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    total = Window.partitionBy(F.lit(0))
    upto = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("target").over(total)
    bounds = shares.filter("target > 0").withColumn("high", upto)
    bounds = bounds.withColumn("low", F.lag("high", 1, 0.0).over(order)).withColumn("high", F.when(F.lead("high").over(order).isNull(), 2.0).otherwise(F.col("high")))
    # a source's share is cut into cells of the unit interval, so that points meet it by an equal key
    cells = 4096
    cell = lambda x: F.least(F.lit(cells - 1), F.floor(x * cells)).cast("int")
    pieces = bounds.select("source", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    points = shares.sparkSession.range(slots).select(F.col("id").alias("slot"), ((F.col("id") * F.lit(GOLDEN)) % 1.0).alias("u")).withColumn("cell", cell(F.col("u")))
    drawn = points.join(pieces, (points["cell"] == pieces["cell"]) & (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("slot", "source")
    return _ranked(drawn, "slot", F.floor(F.col("slot") / 8192), "rank")


def _ranked(rows: DataFrame, by: str, piece: Column, name: str) -> DataFrame:
    """``rows`` with their rank from 0 by ``by`` within source, by pieces of each source."""
    rows = rows.withColumn("piece", piece)
    before = rows.groupBy("source", "piece").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("source", "piece").orderBy(by)) - 1
    found = rows.withColumn("own", own).alias("a").join(before.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.piece") == F.col("b.piece")))
    return found.select(*[F.col(f"a.{c}") for c in rows.columns if c != "piece"], (F.col("a.own") + F.col("b.before")).cast("long").alias(name))


def laid_out(sized: DataFrame, pieces: int = 1024) -> DataFrame:
    """``sized`` with ``begin``: words of the source before the document, in hashed order.

    Prefix sums run over pieces of the hash range first and inside a piece then.
    """
    mixed = F.xxhash64(F.lit("mix"), "doc_id", "tag")
    rows = sized.withColumn("mixed", mixed).withColumn("piece", F.pmod(F.shiftrightunsigned(F.col("mixed"), 54), F.lit(pieces)).cast("int"))
    before = rows.groupBy("source", "piece").agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("source", "piece").orderBy("mixed", "doc_id", "tag").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("a")
    found = summed.join(before.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.piece") == F.col("b.piece")))
    return found.select(*[F.col(f"a.{c}") for c in sized.columns], (F.col("a.inside") + F.col("b.before")).alias("begin"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights=WEIGHTS, share: float = 1.5, limit: float = 2.0, block_words: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, tag, source, size, source_size, target, taken, first_slot``.

    ``size`` counts words, 0 for a null text.  The mix takes ``taken`` words of a
    document, repeats counted: the blocks that the schedule gives its source, the
    last of them only as far as the target.  No document is taken more than
    ``limit`` times, a limit of at most 2.  ``first_slot`` is the first slot of the schedule that
    takes words of it, null without any: in order of it the mix's beginning holds the sources
    in their shares.  ``tag`` is a hash of the text that tells
    rows of one id apart.

    Null sources are one source, null ids a value like any other.  Rows that repeat
    an id, a text and a source lie side by side and share what is taken; equal texts
    of two sources are two documents.  Very long texts are cut by blocks like
    others.  Sources of equal ratio fill up in order of code point, documents of
    equal hash in order of id.  Empty documents and an empty table take nothing;
    other columns are ignored.
    ``block_words`` is 1/20,000 of the mix by default, between 1 and 4,096.
    """
    text = F.col(text_col).cast("string")
    sized = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), F.col(source_col).cast("string").alias("source"), words(text).alias("size")), "sizes")
    goals = written(targets(sized, weights, share, limit), "targets")
    total = goals.agg(F.sum("target")).first()[0] or 0.0
    block = block_words or max(1, min(4096, int(total // 20_000)))
    slots = int(total // block) + 64
    used = written(schedule(goals.select("source", "target"), slots), "slots")
    # a source may have a few points too few, a small one none: these ranks, LACK at most, follow the schedule
    had = used.groupBy("source").agg(F.count("*").alias("n"))
    short = goals.alias("a").join(had.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.source", F.coalesce("n", F.lit(0)).alias("n"), F.ceil(F.floor("target") / block).alias("need"))
    rest = short.filter("n < need").select("source", F.explode(F.sequence(F.col("n").cast("long"), F.least(F.col("need").cast("long"), F.col("n") + LACK) - 1)).alias("rank"))
    used = used.select("source", "rank", "slot").union(rest.select("source", "rank", F.lit(slots) + F.col("rank")))
    # rank r of a source takes the words [r * block, (r + 1) * block) of its line, up to its target
    blocks = used.alias("a").join(goals.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "rank", "slot", "source_size", F.floor("target").cast("long").alias("upto"))
    blocks = blocks.withColumn("low", F.col("rank") * block).filter(F.col("low") < F.col("upto")).withColumn("high", F.least(F.col("low") + block, "upto"))
    # where a block runs over the end of the line, it goes on at its beginning
    turns = F.explode(F.sequence(F.floor(F.col("low") / F.col("source_size")), F.floor((F.col("high") - 1) / F.col("source_size"))))
    turned = blocks.withColumn("turn", turns).select("source", "turn", "slot", F.greatest(F.lit(0), F.col("low") - F.col("turn") * F.col("source_size")).alias("low"), F.least(F.col("source_size"), F.col("high") - F.col("turn") * F.col("source_size")).alias("high"))
    cut = turned.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))))
    line = laid_out(sized).filter("size > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))))
    x, y = line.alias("x"), cut.alias("y")
    overlap = F.least(F.col("x.begin") + F.col("x.size"), F.col("y.high"), (F.col("x.cell") + 1) * block) - F.greatest(F.col("x.begin"), F.col("y.low"), F.col("x.cell") * block)
    met = x.join(y, (F.col("x.cell") == F.col("y.cell")) & F.col("x.source").eqNullSafe(F.col("y.source"))).select(F.col("x.doc_id").alias("d"), F.col("x.tag").alias("t"), F.col("x.source").alias("s"), F.greatest(F.lit(0), overlap).alias("n"), "y.slot")
    taken = met.groupBy("d", "t", "s").agg(F.sum("n").alias("taken"), F.min(F.when(F.col("n") > 0, F.col("slot"))).alias("first_slot"))
    # rows that repeat an id, a text and a source share what was taken of them
    copies = sized.groupBy("doc_id", "tag", "source", "size").agg(F.count("*").alias("copies"))
    full = copies.join(taken, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("tag").eqNullSafe(F.col("t")) & F.col("source").eqNullSafe(F.col("s")), "left")
    full = full.alias("f").join(goals.alias("g"), F.col("f.source").eqNullSafe(F.col("g.source")))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    part = lambda i: F.floor(F.col("all") / F.col("copies")) + F.when(i < F.col("all") % F.col("copies"), 1).otherwise(0)
    out = full.select("doc_id", "tag", F.col("f.source").alias("source"), "size", "source_size", "target", "copies", "first_slot", F.coalesce("taken", F.lit(0)).alias("all")).withColumn("i", each)
    return out.select("doc_id", "tag", "source", "size", "source_size", "target", part(F.col("i")).cast("long").alias("taken"), F.col("first_slot").cast("long").alias("first_slot"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, in whole texts.

    A document is repeated ``round(taken / size)`` times, half counting up, so some
    are left out and some are there twice; empty documents stay as they are.  The
    columns are those of ``docs``, whatever their names.
    """
    drawn = mix(docs, id_col, text_col, source_col, **options)
    share = F.avg(F.col("taken") / F.greatest(F.lit(1), "size"))
    times = drawn.groupBy("doc_id", "tag", "source").agg(F.when(F.max("size") == 0, 1).otherwise(F.floor(share + 0.5)).cast("int").alias("times")).filter("times > 0")
    # the row in one column, so that no name of its columns clashes
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    of = lambda c, kind: F.col("row").getField(c).cast(kind)
    met = rows.join(times, of(id_col, "long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(of(text_col, "string")) == F.col("tag")) & of(source_col, "string").eqNullSafe(F.col("source")))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
