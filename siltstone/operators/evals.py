"""Aggregates of evaluation runs, ledgers and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def eval_aggregate(runs: DataFrame) -> DataFrame:
    """Counters and rates over evaluation runs in one row; a rate without a base is null, that of false proofs 0."""
    rate = lambda a, b: F.round(F.try_divide(a, b), 4)
    n = F.count("*")
    yes = {c: F.count_if(F.col(c)) for c in ("routed", "found", "confirmed", "proven", "cross_file", "in_context")}
    sites = F.count_if(F.col("site_in_context").isNotNull())
    return runs.agg(
        n.alias("cases"),
        *[c.alias(f"n_{k}") for k, c in yes.items()],
        *[rate(c, n).alias(f"{k}_rate") for k, c in yes.items()],
        rate(F.count_if(F.col("site_in_context")), sites).alias("site_context_rate"),
        rate(F.count_if(F.col("found") & F.col("in_context")), yes["in_context"]).alias("found_given_context"),
        rate(F.count_if(F.col("found") & F.col("site_in_context")), F.count_if(F.col("site_in_context"))).alias("found_given_site"),
        F.coalesce(rate(F.sum("false_proofs"), F.sum("proven_total")), F.lit(0.0)).alias("false_proof_rate"),
        F.round(F.try_divide(F.sum("cost"), yes["found"]), 4).alias("cost_per_found"),
    )


def keep_slot(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of rows with one key: the position of the first, the kind and signal of the first that isn't of kind file."""
    best = F.min(F.struct((F.col("kind") == "file").alias("plain"), "pos", "kind", "signal"))
    return rows.groupBy(*key).agg(F.min("pos").alias("slot"), best.alias("b")).select(*key, "slot", F.col("b.kind").alias("kind"), F.col("b.signal").alias("signal"))


def evidence_edges(hops: DataFrame) -> DataFrame:
    """Consecutive hops of each path as edges: ``path_id, src, dst, hop``."""
    order = Window.partitionBy("path_id").orderBy("hop")
    nxt = hops.select("path_id", "hop", F.col("node").alias("src"), F.lead("node").over(order).alias("dst"))
    return nxt.filter("dst is not null").select("path_id", "src", "dst", "hop")


def cross_file(hops: DataFrame) -> DataFrame:
    """Paths of at least two hops in at least two files."""
    agg = hops.groupBy("path_id").agg(F.count("*").alias("n_hops"), F.countDistinct("file_path").alias("n_files"))
    return agg.filter("n_hops >= 2 and n_files >= 2")
