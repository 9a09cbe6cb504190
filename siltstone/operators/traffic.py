"""Observed requests beside declared routes with path templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Segments that stand for any one: :id, {id}, <int:id>, [id] and *.
PARAMETER = r"^(:[A-Za-z_]\w*\??|\{[^{}]*\}|<[^<>]*>|\[[^\[\]]*\]|\*)$"
_SITE = ("repo", "method", "segments")


def _segments(path: Column) -> Column:
    """A path's segments, without its slashes at either end."""
    return F.split(F.regexp_replace(path, "^/+|/+$", ""), "/", -1)


def _masked(parts: str, mask: str) -> Column:
    """The segments at which the mask has an x, and * at the others, as one text."""
    return F.array_join(F.transform(parts, lambda s, i: F.when(F.substring(F.col(mask), i + 1, F.lit(1)) == "x", s).otherwise("*")), "/")


def correlate(observed: DataFrame, routes: DataFrame) -> DataFrame:
    """``repo, method, path, n, template, state``: observed endpoints beside the routes that serve them.

    A route serves a path of as many segments if its literal segments are the path's;
    of several the one with most literals, then with earlier ones, then the first
    by text.  An endpoint is mapped or, without a route, a shadow; a route that no
    endpoint is mapped to has no traffic.  Methods match in any case, nulls nothing.

    Routes of a size are told apart by which segments are literal, of which there are
    few; a path looks each of them up by its own segments there.
    """
    method = F.upper("method").alias("method")
    parts = _segments(F.col("path"))
    literal = F.array_join(F.transform("parts", lambda s: F.when(s.rlike(PARAMETER), "-").otherwise("x")), "")
    declared = routes.select("repo", method, F.col("path").alias("template"), parts.alias("parts")).distinct().withColumn("segments", F.size("parts")).withColumn("mask", literal).withColumn("key", _masked("parts", "mask"))
    seen = observed.select("repo", method, "path", "n", parts.alias("parts")).withColumn("segments", F.size("parts"))
    masks = declared.select(*_SITE, "mask").distinct()
    looked = seen.join(masks, list(_SITE)).withColumn("key", _masked("parts", "mask"))
    # most literals first, then earlier ones: x sorts after -
    order = F.struct((-F.length(F.replace(F.col("mask"), F.lit("-"), F.lit("")))).alias("literals"), F.translate("mask", "x-", "ab").alias("early"), "template")
    best = looked.join(declared.select(*_SITE, "mask", "key", "template"), [*_SITE, "mask", "key"]).groupBy("repo", "method", "path").agg(F.min(order)["template"].alias("template"))
    mapped = seen.join(best, ["repo", "method", "path"], "left").select("repo", "method", "path", "n", "template", F.when(F.col("template").isNull(), "shadow").otherwise("mapped").alias("state"))
    idle = declared.join(best.select("repo", "method", "template").distinct(), ["repo", "method", "template"], "left_anti")
    return mapped.union(idle.select("repo", "method", F.col("template").alias("path"), F.lit(0).cast("long"), "template", F.lit("no-traffic")))
