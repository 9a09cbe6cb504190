"""Scores of findings and files, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.verdicts import lookup

#: Fixed values of the risk score.
RISK_SEVERITY = {"critical": 40, "high": 30, "medium": 18, "low": 8, "info": 4, "none": 4}
RISK_PROOF = {"proven": 35, "patch-validated": 33, "confirmed": 28, "patch-planned": 20, "trigger-built": 18, "reachable": 12, "open": 8, "candidate": 3}
#: Fixed values of the priority score.
PRIORITY_SEVERITY = {"critical": 40, "high": 30, "medium": 15, "low": 5, "info": 0, "none": 0}
PRIORITY_PROOF = {"proven": 25, "confirmed": 18, "trigger-built": 12, "reachable": 8, "patch-planned": 6, "open": 5, "candidate": 2, "lead": 1, "patch-validated": 0, "remediated": 0, "reviewed": 0, "noise": 0}
PRIORITY_EXPOSURE = {"unauth": 20, "pre-auth": 20, "public": 18, "cross-tenant": 16, "tenant": 12, "authenticated": 10, "adjacent": 6, "local": 5, "internal": 3}
#: Severity by the least access that an attack needs.
ACCESS = {w: "high" for w in ("unauthenticated-remote", "unauthenticated", "unauth", "remote", "remote-unauth", "network", "anonymous", "public")}
ACCESS |= {w: "medium" for w in ("authenticated", "authenticated-remote", "authed", "user", "tenant", "adjacent", "adjacent-network")}
ACCESS |= {w: "low" for w in ("local", "local-only", "localhost", "physical", "admin", "operator", "privileged")}
LEVELS = ("info", "low", "medium", "high", "critical")


def severity_rank(severity: Column) -> Column:
    """5 for critical down to 0 for none, 2 for an unknown one."""
    return lookup(severity, {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1, "none": 0}, 2)


def level(severity: Column) -> Column:
    """0 for info up to 4 for critical; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in zip(LEVELS, range(len(LEVELS)), strict=True) for x in pair]), severity)


def level_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in LEVELS]), rank)


def blast_bonus(callers: Column) -> Column:
    n = F.greatest(F.coalesce(callers, F.lit(0)), F.lit(0))
    return F.least(F.lit(15), F.round(F.log10(n + 1) * 5).cast("int"))


def reach_score(calls: Column) -> Column:
    n = F.greatest(F.coalesce(calls, F.lit(0)), F.lit(0))
    return F.least(F.lit(8), F.round(F.log2(n + 1) * 1.6).cast("int"))


def reach_boost(score: Column) -> Column:
    n = F.greatest(F.coalesce(score, F.lit(0)), F.lit(0))
    return F.least(F.lit(4), F.round(F.log2(n + 1)).cast("int"))


def risk_score(severity: Column, proof: Column, verify: Column, poc: Column, blast: Column, in_chain: Column) -> Column:
    """0 to 100: severity, proof, verdicts, blast radius and chains added up."""
    total = lookup(F.coalesce(severity, F.lit("medium")), RISK_SEVERITY, 15) + lookup(proof, RISK_PROOF, 0)
    total = total + F.when(verify == "confirmed-exploitable", 4).when(verify == "not-exploitable", -20).otherwise(0)
    total = total + F.when(poc == "exploited", 6).otherwise(0) + blast_bonus(blast) + F.when(in_chain, 5).otherwise(0)
    return F.least(F.lit(100), F.greatest(F.lit(0), total)).cast("int")


def priority(severity: Column, proof: Column, exposure: Column, entry_reachable: Column, callers: Column) -> Column:
    """struct(score, tier): what to look at first."""
    n = F.greatest(F.coalesce(callers, F.lit(0)), F.lit(0))
    reach = F.when(entry_reachable, 15).when(~entry_reachable, 0).otherwise(F.least(F.lit(12), F.round(F.log2(n + 1) * 3).cast("int")))
    score = lookup(severity, PRIORITY_SEVERITY, 15) + lookup(proof, PRIORITY_PROOF, 2) + lookup(exposure, PRIORITY_EXPOSURE, 8) + reach
    tier = F.when(score >= 75, "P0").when(score >= 55, "P1").when(score >= 35, "P2").otherwise("P3")
    return F.struct(score.cast("int").alias("score"), tier.alias("tier"))


def derive_severity(preconditions: Column, access: Column, model_match: Column, claimed: Column) -> Column:
    """struct(severity, derived): the lower of what preconditions and access allow.

    No preconditions give high, one or two medium, more low; blank ones don't count,
    and an absent list says nothing.  A match of the threat model adds a step, up to
    high.  Without either column the claimed severity, or medium, is not derived.

    Each column is put in once: an expression with copies of its parts in copies grows past
    what the JVM compiles.
    """
    n = F.aggregate(preconditions, F.lit(0), lambda n, x: n + F.when(F.trim(x) != "", 1).otherwise(0))
    by_count = F.get(F.array(*[F.lit(x) for x in (3, 2, 2, 1)]), F.when(preconditions.isNotNull(), F.least(n, F.lit(3))))
    ranks = {k: LEVELS.index(v) for k, v in ACCESS.items()}
    by_access = F.try_element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), F.regexp_replace(F.trim(F.lower(access)), r"\s+", "-"))
    low = F.least(by_count, by_access)  # nulls are skipped; 1 to 3
    raised = F.get(F.array(*[F.lit(x) for x in (*LEVELS[:4], LEVELS[3])]), low + F.when(model_match, 1).otherwise(0))
    known = F.when(claimed.isin(*LEVELS), claimed)
    return F.struct(F.coalesce(raised, known, F.lit("medium")).alias("severity"), low.isNotNull().alias("derived"))


def judge_claimed(claimed: Column, derived: Column) -> Column:
    """How far a claim can be trusted: 5 understated, 4 accurate, then 0, -3, -5 by steps too high; 0 where either is unknown."""
    steps = level(claimed) - level(derived)
    place = F.when(steps.isNotNull(), F.least(F.greatest(steps, F.lit(-1)), F.lit(3)) + 1)
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in (5, 4, 0, -3, -5)]), place), F.lit(0))
