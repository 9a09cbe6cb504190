"""Rules that drafts of findings must pass: each gives a reason, a level or a new row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import basename, norm_cwe, same_path
from siltstone.functions.verdicts import draft_status

#: Levels of evidence in order, words of a guard, frames outside the target, classes that are never promoted.
EVIDENCE_LEVELS = ("candidate", "linked", "path")
GUARDS = r"(?i)\b(guard|check|validat|sanitiz|escap|bound|auth|permission|allowlist|encod)"
OFF_TARGET = r"(?i)(^|/)(third_party|vendor|deps|test|tests|fuzz|harness)/"
WEAK_CLASSES = ("memory-leak", "timeout", "out-of-memory", "undefined-behavior")


def evidence_gate(least: str = "linked") -> Column:
    """struct(verdict, gated_from): a finding whose evidence is under ``least`` becomes a candidate."""
    rank = F.lit(-1)
    for i, name in enumerate(EVIDENCE_LEVELS):
        rank = F.when(F.col("evidence_level") == name, i).otherwise(rank)
    down = (F.col("verdict") == "finding") & (rank < EVIDENCE_LEVELS.index(least))
    return F.struct(F.when(down, "candidate").otherwise(F.col("verdict")).alias("verdict"), F.when(down, F.col("verdict")).alias("gated_from"))


def fix_ok() -> Column:
    """Whether a validated fix has its three passing flags and no failed semantic check."""
    flags = F.coalesce(F.col("poc_blocked") & F.col("tests_pass") & F.col("builds"), F.lit(False))
    return (F.col("verdict") != "validated") | (flags & F.coalesce(F.col("semantic"), F.lit(True)))


def crash_gate() -> Column:
    """off-target if all frames lie outside the target, weak for classes that aren't promoted, else promote; ``frames`` may be empty."""
    off = (F.size("frames") > 0) & F.forall("frames", lambda f: f.rlike(OFF_TARGET))
    return F.when(off, "off-target").when(F.col("error_class").isin(*WEAK_CLASSES), "weak").otherwise("promote")


def supply_chain(deps: DataFrame) -> DataFrame:
    """High risks become open findings, medium ones need evidence, low ones go; others need a manifest."""
    status = F.when(F.col("tier") == "high", "open").when(F.col("tier") == "medium", "needs-evidence")
    return deps.filter(F.col("tier").isin("high", "medium") & F.col("manifest").isNotNull()).withColumn("status", status)


def promoted(drafts: DataFrame) -> DataFrame:
    """Drafts as findings: defaults of reference and title, first CWE, status by verdict."""
    ref = F.coalesce(F.nullif(F.trim("ref_id"), F.lit("")), F.concat(F.lit("draft-"), F.col("ord").cast("string")))
    title = F.coalesce(F.nullif(F.trim(F.regexp_replace("title", r"\s+", " ")), F.lit("")), ref)
    return drafts.select("fingerprint", "source", ref.alias("ref_id"), title.alias("title"), norm_cwe(F.col("cwe")).alias("cwe"), draft_status(F.col("verdict")).alias("status"))


def _ends(path: Column) -> Column:
    """A path and all its ends that begin after a slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def leads_of(candidates: DataFrame, leads: DataFrame, most: int = 10) -> DataFrame:
    """``fingerprint, lead, n``: at most ``most`` leads whose path ends the candidate's, or the other way round.

    Distinct paths meet on their ends, and each lead's path brings its first leads
    only, so files of one name in many folders don't meet in pairs.
    """
    n = F.row_number().over(Window.partitionBy("repo", "q").orderBy("lead"))
    first = leads.select("repo", "lead", F.col("file_path").alias("q")).distinct().withColumn("n", n).filter(F.col("n") <= most).drop("n")
    mine, theirs = candidates.select("repo", F.col("file_path").alias("p")).distinct(), first.select("repo", "q").distinct()
    longer = mine.withColumn("q", F.explode(_ends(F.col("p")))).join(theirs, ["repo", "q"])
    shorter = theirs.withColumn("p", F.explode(_ends(F.col("q")))).join(mine, ["repo", "p"])
    paths = longer.select("repo", "p", "q").union(shorter.select("repo", "p", "q")).distinct()
    place = F.row_number().over(Window.partitionBy("repo", "p").orderBy("lead"))
    met = paths.join(first, ["repo", "q"]).select("repo", "p", "lead").distinct().withColumn("n", place).filter(F.col("n") <= most)
    return candidates.select("repo", "fingerprint", F.col("file_path").alias("p")).join(met, ["repo", "p"]).select("fingerprint", "lead", "n")


#: Verdicts of the two reviews of threats and changes, those that need an anchor, and the guard words that a clearance must hold.
REVIEW_VERDICTS = ("exploitable", "likely-library-noise", "reviewed-no-impact", "needs-more-evidence", "needs-active-agent-trace")
ANCHORED = ("exploitable", "reviewed-no-impact", "needs-active-agent-trace")
THREAT_GUARD, CHANGE_GUARD = "(?i)guard", "(?i)guard|check|valid|sanitiz|escap|param|author"
#: Producer, its verdicts, its kinds (none: any), least length of a rationale, verdict that needs anchors.
_THREE = ("finding", "candidate", "rejected")
PRODUCERS = (
    ("sast", _THREE, (), 120, "finding"),
    ("iac", _THREE, ("container", "secrets", "network", "cloud", "transport", "orchestration"), 120, "finding"),
    ("crypto-review", _THREE, ("timing-side-channel", "missing-zeroization", "weak-crypto-rng"), 150, "finding"),
    ("sharp-edges", _THREE, ("algorithm-selection", "dangerous-defaults", "primitive-vs-semantic", "configuration-cliff", "silent-failures", "stringly-typed-security"), 150, "finding"),
    ("authz", _THREE, ("missing-authz", "idor", "privilege-escalation", "broken-ownership"), 150, "finding"),
    ("binary-recon", _THREE, ("dangerous-import", "rwx-segment", "suspicious-string", "hardening-gap", "embedded-secret"), 120, "finding"),
    ("logic-hunt", ("violation", "holds", "not-an-invariant", "needs-more-evidence"), ("atomicity", "ordering", "state-machine", "authz-omission", "business-rule", "replay", "invariant"), 200, "violation"),
    ("traffic-map", _THREE, (), 120, "finding"),
)
AUTHZ_GUARD = "(?i)authz|authoriz|ownership|current_user|guard|check|role|permission|tenant|scope"
#: Tiers of what a memory error allows, and those that need a control offset.
TIERS = ("crash-only", "dos", "info-leak", "control-flow-hijack-plausible", "likely-code-exec", "needs-more-evidence")
CONTROLLED = ("control-flow-hijack-plausible", "likely-code-exec")
#: Keys that a description of context must not have.
FORBIDDEN_KEYS = ("findings", "vulnerabilities", "severity", "verdict", "exploit", "cwe")
CHAINABLE = ("lead", "candidate", "open", "confirmed", "proven", "needs-evidence", "needs-trace", "patched")


def _short(column: str, least: int) -> Column:
    """Whether a text has fewer characters; a null has none."""
    return F.coalesce(F.length(column), F.lit(0)) < least


def _in(column: str, values) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def review_reason(guard: str, least: int = 200) -> Column:
    """Why a review of a threat or a change is refused, the first rule that it breaks, or null; ``anchors`` counts its anchors."""
    return (
        F.when(~_in("verdict", REVIEW_VERDICTS), "verdict")
        .when(_short("rationale", least), "rationale")
        .when(_in("verdict", ANCHORED) & (F.coalesce("anchors", F.lit(0)) == 0), "anchors")
        .when((F.col("verdict") == "reviewed-no-impact") & ~F.coalesce(F.col("rationale").rlike(guard), F.lit(False)), "guard")
    )


def deep_scan_reason() -> Column:
    """Why a draft of a deep scan is dropped; a finding needs anchors, a CWE and a self-check of 40 characters."""
    finding = F.col("verdict") == "finding"
    return (
        F.when(~_in("verdict", _THREE), "verdict").when(_short("rationale", 150), "rationale").when(finding & (F.coalesce("anchors", F.lit(0)) == 0), "anchors")
        .when(finding & (F.coalesce(F.trim("cwe"), F.lit("")) == ""), "cwe").when(finding & _short("self_check", 40), "self-check")
    )


def deep_hunt_reason() -> Column:
    """Why a draft of a deep hunt is dropped; a finding needs a path of two hops in two files, a CWE and a self-check."""
    finding = F.col("verdict") == "finding"
    return (
        F.when(~_in("verdict", _THREE), "verdict").when(_short("rationale", 150), "rationale").when(finding & (F.coalesce(F.trim("cwe"), F.lit("")) == ""), "cwe")
        .when(finding & (F.coalesce("hops", F.lit(0)) < 2), "path").when(finding & (F.coalesce("files", F.lit(0)) < 2), "one-file").when(finding & _short("self_check", 40), "self-check")
    )


def verification_reason() -> Column:
    """Why a verification is refused: verdict, rationale of 150, devil's advocate of 60; a confirmation needs sketch, anchors and a negative case of 20, a clearance a guard."""
    yes = F.col("verdict") == "confirmed-exploitable"
    return (
        F.when(~_in("verdict", ("confirmed-exploitable", "not-exploitable", "inconclusive")), "verdict").when(_short("rationale", 150), "rationale").when(_short("advocate", 60), "advocate")
        .when(yes & ~F.coalesce("sketch", F.lit(False)), "sketch").when(yes & (F.coalesce("anchors", F.lit(0)) == 0), "anchors").when(yes & _short("negative", 20), "negative-case")
        .when((F.col("verdict") == "not-exploitable") & ~F.coalesce(F.col("rationale").rlike(GUARDS), F.lit(False)), "guard")
    )


def producer_reason(producers=PRODUCERS) -> Column:
    """Why a producer's draft is refused, by the producer's row of the table; one of an unknown producer is refused for it."""
    out = F.lit("producer")
    for source, verdicts, kinds, least, anchored in producers:
        own = F.when(~_in("verdict", verdicts), "verdict")
        if kinds:
            own = own.when(F.col("kind").isNotNull() & ~F.col("kind").isin(*kinds), "kind")
        own = own.when(_short("rationale", least), "rationale").when((F.col("verdict") == anchored) & (F.coalesce("anchors", F.lit(0)) == 0), "anchors")
        if source == "authz":
            own = own.when((F.col("verdict") == "rejected") & ~F.coalesce(F.col("rationale").rlike(AUTHZ_GUARD), F.lit(False)), "guard")
        out = F.when(F.col("source") == source, own).otherwise(out)
    return out


def tier_reason() -> Column:
    """Why a memory error's tier is refused; all but an open one need anchors, the top two a control offset, each a remedy of 20 characters."""
    return (
        F.when(~_in("tier", TIERS), "tier").when(_short("rationale", 200), "rationale").when((F.col("tier") != "needs-more-evidence") & (F.coalesce("anchors", F.lit(0)) == 0), "anchors")
        .when(_in("tier", CONTROLLED) & ~F.coalesce("sketch", F.lit(False)), "control-offset").when(F.coalesce(F.length(F.trim("remedy")), F.lit(0)) < 20, "remedy")
    )


def context_reason(keys: Column, modules: Column, invariants: Column, overview: Column) -> Column:
    """Why a description of context is refused: a forbidden key, no module or invariant, an overview under 80 characters."""
    return (
        F.when(F.exists(keys, lambda k: F.lower(k).isin(*FORBIDDEN_KEYS)), "forbidden-key").when(F.coalesce(modules, F.lit(0)) < 1, "modules").when(F.coalesce(invariants, F.lit(0)) < 1, "invariants")
        .when(F.coalesce(F.length(F.trim(overview)), F.lit(0)) < 80, "overview")
    )


def live(findings: DataFrame) -> DataFrame:
    """``fingerprint`` and nine views of whether a finding is live: each step of a review has its own."""
    status, verdict = F.coalesce("status", F.lit("")), F.coalesce("verdict", F.lit(""))
    views = {
        "verify": (status == "open") | (verdict == "needs-active-agent-trace"),
        "path_solve": F.coalesce(F.col("verify_verdict") == "inconclusive", F.lit(False)) | (status == "needs-trace") | (verdict == "needs-active-agent-trace"),
        "seed": status.isin("confirmed", "proven"),
        "chainable": status.isin(*CHAINABLE),
        "poc_ready": F.coalesce(F.col("verify_verdict").isin("confirmed-exploitable", "inconclusive"), F.lit(False)),
        "unproven_memory": F.col("memory") & F.coalesce(F.col("poc_verdict") != "exploited", F.lit(True)),
        "sarif": status.isin("open", "confirmed", "proven") | verdict.isin("exploitable", "finding"),
        "report": ~status.isin("reviewed", "noise", "remediated"),
        "bench": ~status.isin("reviewed", "noise", "rejected"),
    }
    return findings.select("fingerprint", *[v.alias(k) for k, v in views.items()])
