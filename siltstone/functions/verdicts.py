"""Vocabularies of verdicts, statuses and severities, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(value: Column, table: dict, default=None) -> Column:
    out = F.lit(default)
    for key, result in reversed(list(table.items())):
        out = F.when(value == key, F.lit(result)).otherwise(out)
    return out


#: Fixed values of the vocabularies.
STATUSES = ("lead", "candidate", "open", "needs-evidence", "needs-trace", "confirmed", "proven", "patched", "remediated", "reviewed", "noise")
PROOF_STATES = ("lead", "candidate", "open", "reachable", "trigger-built", "confirmed", "proven", "patch-planned", "patch-validated", "remediated", "reviewed", "noise")
VERIFY_VERDICTS = ("confirmed-exploitable", "not-exploitable", "inconclusive")
POC_VERDICTS = ("exploited", "not-reproduced", "non-discriminating", "harness-failed-build", "timeout", "error")
FIX_VERDICTS = ("validated", "unvalidated-no-harness", "build-failed", "needs-more-evidence", "exploit-still-fires", "stops-exploit-breaks-function", "validated-pending-reattack")
DRAFT_STATUS = {"exploitable": "open", "finding": "open", "candidate": "needs-evidence", "rejected": "reviewed", "reviewed-no-impact": "reviewed", "likely-library-noise": "noise", "needs-more-evidence": "needs-evidence", "needs-active-agent-trace": "needs-trace"}
VERIFY_STATUS = {"confirmed-exploitable": "confirmed", "not-exploitable": "reviewed"}
POC_STATUS = {"exploited": "proven", "not-reproduced": "reviewed"}
FIX_STATUS = {"validated": "patched"}
GATES = {"confirmed-exploitable": "true-positive", "not-exploitable": "false-positive", "inconclusive": "needs-runtime"}
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning"}
STATUS_PROOF = {"patched": "patch-validated", "needs-evidence": "candidate", "needs-trace": "candidate"} | {s: s for s in ("lead", "candidate", "open", "confirmed", "proven", "remediated", "reviewed", "noise")}
MEMORY_CWES = (119, 120, 121, 122, 124, 125, 126, 127, 131, 190, 191, 401, 415, 416, 476, 562, 787, 824)
MEMORY_SOURCES = ("systems-hunt", "binary-recon")
STRIDE = ("spoofing", "tampering", "repudiation", "information-disclosure", "denial-of-service", "elevation-of-privilege")


def draft_status(verdict: Column) -> Column:
    return lookup(verdict, DRAFT_STATUS)


def verify_status(verdict: Column) -> Column:
    """The new status, or null where the old one stays."""
    return lookup(verdict, VERIFY_STATUS)


def poc_status(verdict: Column) -> Column:
    return lookup(verdict, POC_STATUS)


def fix_status(verdict: Column) -> Column:
    return lookup(verdict, FIX_STATUS)


def gate(verdict: Column) -> Column:
    return lookup(verdict, GATES)


def sarif_level(severity: Column) -> Column:
    return lookup(severity, SARIF_LEVELS, "note")


def proof_state(status: Column) -> Column:
    return lookup(status, STATUS_PROOF, "lead")


def is_memory(source: Column, cwe_number: Column) -> Column:
    return F.coalesce(source.isin(*MEMORY_SOURCES), F.lit(False)) | F.coalesce(cwe_number.isin(*MEMORY_CWES), F.lit(False))


def proof_lane(source: Column, cwe_number: Column) -> Column:
    return F.when(is_memory(source, cwe_number), "sanitizer").otherwise("poc")


def stride(category: Column) -> Column:
    key = F.regexp_replace(F.trim(F.lower(category)), r"[\s_]+", "-")
    return F.when(key.isin(*STRIDE), key)


def impact(text: Column) -> Column:
    word = F.regexp_extract(F.lower(text), "critical|high|medium|low", 0)
    return F.coalesce(F.nullif(word, F.lit("")), F.lit("medium"))


def likelihood(probability: Column) -> Column:
    return F.when(probability >= 0.7, "high").when(probability >= 0.4, "medium").otherwise("low")
