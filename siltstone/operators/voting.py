"""Verdicts of independent votes on a finding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import clamp_confidence
from siltstone.functions.verdicts import VERIFY_VERDICTS

YES, NO, OPEN = VERIFY_VERDICTS


def majority(votes: DataFrame) -> DataFrame:
    """``repo, fingerprint, verdict, agreement, n_votes, tally``: a strict majority confirms or clears.

    Votes outside the vocabulary don't count; findings without a valid vote are
    inconclusive.  ``agreement`` is the share of the votes for the verdict itself, so 0
    where a split leaves it open and no vote does; ``tally`` counts the verdicts voted for.
    """
    valid = F.col("verdict").isin(*VERIFY_VERDICTS)
    n = F.count_if(valid)
    by = {v: F.count_if(F.col("verdict") == v) for v in VERIFY_VERDICTS}
    verdict = F.when(by[YES] * 2 > n, YES).when(by[NO] * 2 > n, NO).otherwise(OPEN)
    backing = F.when(by[YES] * 2 > n, by[YES]).when(by[NO] * 2 > n, by[NO]).otherwise(by[OPEN])
    agreement = F.when(n == 0, 0.0).otherwise(F.round(backing / n, 3))
    tally = F.concat_ws(",", *[F.when(by[v] > 0, F.concat(F.lit(f"{v}:"), by[v].cast("string"))) for v in VERIFY_VERDICTS])
    return votes.groupBy("repo", "fingerprint").agg(verdict.alias("verdict"), agreement.alias("agreement"), n.alias("n_votes"), tally.alias("tally"))


def consensus(votes: DataFrame, tolerance: str = "ask") -> DataFrame:
    """A panel's verdict with confidence, agreement, the modal exclusion rule and the reasons of refusals.

    Without a majority the tolerance decides: ``precision`` clears, ``recall`` and
    ``ask`` leave open, ``ask`` flags.  A confirmation that no vote backs with a
    trigger is left open and marked as downgraded.  Confidence is the mean of the
    votes that agree with the verdict before that, of all where none does.  Of equally frequent
    exclusion rules the first seen counts.
    """
    valid = votes.filter(F.col("verdict").isin(*VERIFY_VERDICTS)).withColumn("confidence", clamp_confidence(F.col("confidence")))
    key = ["repo", "fingerprint"]
    by = {v: F.count_if(F.col("verdict") == v) for v in VERIFY_VERDICTS}
    n = F.count("*")
    split = ~(by[YES] * 2 > n) & ~(by[NO] * 2 > n)
    fallback = NO if tolerance == "precision" else OPEN
    verdict = F.when(by[YES] * 2 > n, YES).when(by[NO] * 2 > n, NO).otherwise(fallback)
    mean = {v: F.avg(F.when(F.col("verdict") == v, F.col("confidence"))) for v in VERIFY_VERDICTS}
    agg = valid.groupBy(*key).agg(
        n.alias("n_votes"), verdict.alias("side"), split.alias("split"), F.bool_or(F.col("has_trigger")).alias("trigger"), F.greatest(*by.values()).alias("most"),
        *[m.alias(f"mean_{i}") for i, m in enumerate(mean.values())], F.avg("confidence").alias("mean_all"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("verdict") == NO, F.col("refute_reason")))), ",").alias("refute_reasons"),
    )
    rules = valid.filter(F.trim("exclusion_rule") != "").groupBy(*key, "exclusion_rule").agg(F.count("*").alias("k"), F.min("ord").alias("seen"))
    modal = rules.groupBy(*key).agg(F.min(F.struct((-F.col("k")).alias("k"), "seen", "exclusion_rule")).alias("m")).select(*key, F.col("m.exclusion_rule").alias("exclusion_rule"))
    down = (F.col("side") == YES) & ~F.col("trigger")
    own = F.when(F.col("side") == YES, F.col("mean_0")).when(F.col("side") == NO, F.col("mean_1")).otherwise(F.col("mean_2"))
    return agg.join(modal, key, "left").select(
        *key,
        F.when(down, OPEN).otherwise(F.col("side")).alias("verdict"),
        F.coalesce(down, F.lit(False)).alias("downgraded"),
        (F.col("split") & F.lit(tolerance == "ask")).alias("flagged"),
        (F.floor(F.coalesce(own, "mean_all") * 100 + 0.5) / 100).alias("confidence"),
        F.round(F.col("most") / F.col("n_votes"), 3).alias("agreement"),
        "exclusion_rule",
        "refute_reasons",
    )


def lens_ranks(votes: DataFrame) -> DataFrame:
    """Votes in order of lens within a finding."""
    return votes.withColumn("place", F.row_number().over(Window.partitionBy("repo", "fingerprint").orderBy("lens")))
