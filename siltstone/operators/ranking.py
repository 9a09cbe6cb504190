"""Places in a total order, found by pieces of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def placed(rows: DataFrame, group: list[str], order: list[tuple[str, bool]], tie: str, name: str = "place", prefix: int = 4) -> DataFrame:
    """``rows`` with their place from 1 in each group, by columns (name, whether down), then by the text ``tie``.

    Rows are counted by piece, a value of the columns and the first characters of
    the tie; a place is the number of rows in the pieces before and the place in the
    own piece.  So a group of any size is ranked by many tasks.
    """
    rows = rows.withColumn("_piece", F.left(F.coalesce(tie, F.lit("")), F.lit(prefix)))
    keys = [c for c, _ in order]
    key = [*group, *keys, "_piece"]
    by = [F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c, down in order]
    counts = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy(*by, "_piece").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("_before", F.coalesce(before, F.lit(0)))
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*key).orderBy(tie)))
    a, b = own.alias("a"), offsets.alias("b")
    on = F.lit(True)
    for c in key:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, on).select(*[F.col(f"a.{c}") for c in rows.columns if c != "_piece"], (F.col("_before") + F.col("_own")).cast("int").alias(name))
