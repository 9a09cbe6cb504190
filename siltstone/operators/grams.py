"""Fixed strings in lines, by one projection or, if they are many, by an index of character grams.

A few strings are literals of a projection, so that no line leaves its task.  Of many,
each is looked for by its rarest gram of three characters (itself, if it is shorter); a
line meets the strings of the grams that it has, and only there is it searched.  So a
line's cost doesn't grow with the number of strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.literals import once
from siltstone.operators.stores import written

SIZE = 3
#: One line in so many tells how rare a gram is; that decides on the cost only.
SAMPLED = 64
#: Strings that one projection looks for, and indexed ones that each task holds; that decides on the cost only.
FEW, HELD = 256, 100_000


def _grams(low: str, size: int) -> Column:
    n = F.length(low) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(low, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def _indexed(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """``rows`` once for each gram of their text in lower case."""
    low = rows.withColumn("low", F.explode(F.array(F.lower("text"))))
    every = F.array_distinct(F.concat(*[_grams("low", n) for n in sizes]))
    # by an array of one, else the grams would be made twice
    return low.withColumn("_g", F.explode(F.array(every))).withColumn("gram", F.explode("_g")).drop("_g")


def _held(lines: DataFrame, strings: list[tuple[str, bool]], column: str) -> DataFrame:
    """``lines`` once for each of a few strings that they hold; those with a mark in any case."""
    low = any(loose for _, loose in strings)
    rows = once(lines, "_low", F.lower("text")) if low else lines
    here = lambda x, loose: (F.contains("text", F.lit(x)) | F.contains("_low", F.lit(x))) if loose else F.contains("text", F.lit(x))
    found = once(rows, "_found", F.array_compact(F.array(*[F.when(here(x, loose), F.lit(x)) for x, loose in strings])))
    return found.filter(F.size("_found") > 0).select(*[F.col(f"`{c}`") for c in lines.columns], F.explode("_found").alias(column))


def lines_with(lines: DataFrame, strings: DataFrame, column: str = "signal", any_case: bool = False, few: int = FEW) -> DataFrame:
    """``lines`` once for each of the strings that they hold.

    With ``any_case`` a string without capitals matches in any case.  Null and empty
    strings are held by no line.
    """
    wanted = written(strings.select(F.col(column).alias("_s")).filter("_s is not null and _s <> ''").distinct(), "strings")
    n = wanted.count()
    if n == 0:
        return lines.withColumn(column, F.lit(None).cast("string")).filter("false")
    if n <= few:
        loose = (F.col("_s") == F.lower("_s")) if any_case else F.lit(False)
        listed = [(r["_s"], r["loose"]) for r in wanted.select("_s", loose.alias("loose")).orderBy("_s").collect()]
        return _held(lines, listed, column)
    wanted = wanted.withColumn("low", F.lower("_s")).withColumn("_n", F.least(F.length("low"), F.lit(SIZE)))
    sizes = sorted(r[0] for r in wanted.select("_n").distinct().collect())  # at most SIZE
    of = F.lit(None).cast("array<string>")
    for n in sizes:
        of = F.when(F.col("_n") == n, _grams("low", n)).otherwise(of)
    grams = wanted.select("_s", "low", F.explode(F.array_distinct(of)).alias("gram"))
    some = _indexed(lines.filter(F.pmod(F.xxhash64("path", "line"), F.lit(SAMPLED)) == 0).select("text"), sizes).groupBy("gram").agg(F.count("*").alias("n"))
    rarest = grams.join(some, "gram", "left").groupBy("_s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    here = F.contains("text", F.col("_s"))
    if any_case:
        here = here | ((F.col("_s") == F.lower("_s")) & F.contains("low", F.col("_s")))
    # lines stay in their tasks unless the strings are too many for each of these
    rarest = F.broadcast(rarest) if n <= HELD else rarest
    met = _indexed(lines, sizes).join(rarest, "gram").filter(here)
    return met.select(*[F.col(f"`{c}`") for c in lines.columns], F.col("_s").alias(column))
