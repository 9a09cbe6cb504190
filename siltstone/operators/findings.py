"""Findings: upsert, patch, collapse, rank and count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import scores, verdicts
from siltstone.functions.literals import once
from siltstone.functions.text import cwe_number, norm_path
from siltstone.operators.ranking import placed

ACTIONABLE = ("open", "needs-evidence", "needs-trace", "confirmed", "proven")


def upsert(findings: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of rows with one key, the last by ``order``."""
    last = F.row_number().over(Window.partitionBy(*key).orderBy(*[c.desc() for c in order]))
    return findings.withColumn("_n", last).filter("_n = 1").drop("_n")


def first_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of rows with one key, the first by ``order``."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def patch(findings: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of ``patches`` over those of ``findings`` where they aren't null; keys of ``patches`` are distinct."""
    new = patches.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns])
    met = findings.join(new, key, "left")
    return met.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in findings.columns])


def unknown_keys(findings: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Patches of findings that aren't there: an error in strict use."""
    return patches.join(findings, key, "left_anti")


def semantic_collapse(findings: DataFrame) -> DataFrame:
    """One row a (repo, source, function) with all its anchors, named by the first finding.

    Proven findings and those without a function key stay as they are.
    """
    alone = (F.col("status") == "proven") | F.col("fn_key").isNull()
    group = F.when(alone, F.col("fingerprint")).otherwise(F.concat_ws("|", "source", "fn_key"))
    rows = findings.withColumn("_g", group).withColumn("_a", alone)
    # anchors are counted in their set: a distinct count beside it would shuffle the rows a second time
    groups = rows.groupBy("repo", "_a", "_g").agg(F.min("fingerprint").alias("fingerprint"), F.count("*").alias("n_findings"), F.collect_set(F.struct("file_path", "start_line")).alias("s"))
    whole = F.filter("s", lambda x: x["file_path"].isNotNull() & x["start_line"].isNotNull())
    shown = F.transform(F.array_sort("s"), lambda x: F.concat(x["file_path"], F.lit(":"), x["start_line"].cast("string")))
    return groups.select("repo", "fingerprint", "n_findings", F.size(whole).cast("long").alias("n_anchors"), F.array_join(shown, ",").alias("anchors"))


def ranked(findings: DataFrame, blast: str = "caller_count") -> DataFrame:
    """``repo, fingerprint, score, rank``: by risk score, then severity, then fingerprint."""
    score = scores.risk_score(F.col("severity"), F.col("proof_state"), F.col("verify_verdict"), F.col("poc_verdict"), F.col(blast), F.col("chain").isNotNull())
    rows = findings.select("repo", "fingerprint", scores.severity_rank(F.col("severity")).alias("level"), score.alias("score"))
    return placed(rows, ["repo"], [("score", True), ("level", True)], "fingerprint", "rank").select("repo", "fingerprint", "score", "rank")


def leading(findings: DataFrame, most: int, blast: str = "caller_count") -> DataFrame:
    """``repo, fingerprint, rank``: the first ``most`` actionable findings of each repo, ranked as by :func:`ranked` among themselves; the others are never sorted."""
    score = scores.risk_score(F.col("severity"), F.col("proof_state"), F.col("verify_verdict"), F.col("poc_verdict"), F.col(blast), F.col("chain").isNotNull())
    live = findings.filter(F.col("status").isin(*ACTIONABLE)).select("repo", "fingerprint", scores.severity_rank(F.col("severity")).alias("level"), score.alias("score"))
    order = Window.partitionBy("repo").orderBy(F.desc("score"), F.desc("level"), "fingerprint")
    return live.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("repo", "fingerprint", "rank")


def prioritised(findings: DataFrame) -> DataFrame:
    p = scores.priority(F.col("severity"), F.col("proof_state"), F.col("exposure"), F.col("entry_reachable"), F.col("caller_count"))
    return findings.select("repo", "fingerprint", p.alias("p")).select("repo", "fingerprint", F.col("p.score").alias("score"), F.col("p.tier").alias("tier"))


def summary(findings: DataFrame) -> DataFrame:
    """``repo, facet, value, n``: totals and counts by status and verdict."""
    total = findings.groupBy("repo").agg(F.count("*").alias("n")).select("repo", F.lit("total").alias("facet"), F.lit("all").alias("value"), "n")
    by = lambda c: findings.groupBy("repo", c).agg(F.count("*").alias("n")).select("repo", F.lit(c).alias("facet"), F.col(c).alias("value"), "n")
    return total.union(by("status")).union(by("verdict"))


def report_counts(findings: DataFrame) -> DataFrame:
    """One row a repo: counts by severity, the status counters and what is actionable."""
    one = lambda cond, name: F.count_if(cond).alias(name)
    return findings.groupBy("repo").agg(
        F.count("*").alias("total"),
        *[one(F.col("severity") == s, f"severity_{s}") for s in ("critical", "high", "medium", "low", "info")],
        *[one(F.col("status") == s, s) for s in ("proven", "confirmed", "open", "patched", "remediated", "reviewed")],
        one(F.col("status").isin(*ACTIONABLE), "actionable"),
    )


def posture(findings: DataFrame) -> DataFrame:
    """One sentence a repo: how many actionable findings, which states, the worst severity."""
    live = findings.filter(F.col("status").isin(*ACTIONABLE))
    agg = live.groupBy("repo").agg(
        F.count("*").alias("actionable"), F.count_if(F.col("status") == "proven").alias("proven"), F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.max(scores.severity_rank(F.coalesce("severity", F.lit("none")))).alias("worst")
    )
    part = lambda c: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {c}")))
    text = F.concat_ws(", ", F.concat(F.col("actionable").cast("string"), F.lit(" actionable")), part("proven"), part("confirmed"))
    return agg.select("repo", text.alias("headline"), "worst")


def fix_queue(findings: DataFrame, limit: int = 20) -> DataFrame:
    """Proven and confirmed findings that aren't patched, those with an exploit first, ``limit`` a repo."""
    rows = findings.filter(F.col("status").isin("proven", "confirmed") & ~F.coalesce(F.col("fix_verdict") == "validated", F.lit(False)))
    order = Window.partitionBy("repo").orderBy(F.coalesce(F.col("poc_verdict") == "exploited", F.lit(False)).desc(), "fingerprint")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("repo", "fingerprint", "place")


def siblings(findings: DataFrame) -> DataFrame:
    """``fingerprint, n_siblings, first_sibling``: confirmed findings beside the others of their function that have an exploit to run.

    Functions are reduced to the number of such findings and their two least
    fingerprints, so that no finding meets another.
    """
    key = ["repo", "fn_key"]
    with_poc = findings.filter("poc_verdict = 'exploited' and fn_key is not null").groupBy(*key, "fingerprint").agg(F.count("*").alias("own"))
    least = with_poc.groupBy(*key).agg(F.sum("own").alias("n"), F.min("fingerprint").alias("first"))
    second = with_poc.join(least, key).filter("fingerprint <> first").groupBy(*key).agg(F.min("fingerprint").alias("second"))
    met = findings.filter("status = 'confirmed'").select(*key, "fingerprint").join(least, key).join(second, key, "left").join(with_poc, [*key, "fingerprint"], "left")
    rows = met.select("fingerprint", (F.col("n") - F.coalesce("own", F.lit(0))).alias("k"), F.when(F.col("first") == F.col("fingerprint"), F.col("second")).otherwise(F.col("first")).alias("s"))
    return rows.filter("k > 0").groupBy("fingerprint").agg(F.sum("k").alias("n_siblings"), F.min("s").alias("first_sibling"))


def errors(findings: DataFrame) -> DataFrame:
    """``fingerprint, n_errors, errors``: every rule of the finding schema that a row breaks, by the path of its value.

    Besides its texts a finding has ``evidence``, an array of file_path, start_line and
    end_line, and may have blocks ``verification`` (verdict, confidence, verified_at),
    ``poc`` (proof_level, proof_verdict, backend, proven_at) and ``fix`` (verdict, patch_path,
    applied, and the four results of its validation).  A block that is there is checked as
    a whole; a validated fix needs its results, of which the semantic one may be missing.
    """
    # rules read a value several times, so each is made once
    used = ("fingerprint", "source", "ref_id", "title", "severity", "status", "proof_state", "evidence", "verification", "poc", "fix")
    rows = once(findings, "row", F.struct(*used)).select("row.*")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    unlike = lambda c, known: F.coalesce(~c.isin(*known), F.lit(True))
    say = lambda bad, path: F.when(bad, F.lit(path))
    own = [say(blank(F.col(c)), c) for c in ("fingerprint", "source", "ref_id", "title", "severity", "status", "proof_state")]
    own += [say(~blank(F.col(c)) & ~F.col(c).isin(*known), f"{c}: unknown") for c, known in (("status", verdicts.STATUSES), ("proof_state", verdicts.PROOF_STATES))]
    own.append(say(F.col("evidence").isNull(), "evidence"))
    at = lambda i, name: F.concat(F.lit("evidence["), i.cast("string"), F.lit("]."), F.lit(name))
    below = lambda c: F.coalesce(c < 1, F.lit(False))
    anchors = F.flatten(
        F.transform(F.coalesce("evidence", F.array().cast("array<struct<file_path:string,start_line:bigint,end_line:bigint>>")), lambda a, i: F.array(F.when(blank(a["file_path"]), at(i, "file_path")), F.when(below(a["start_line"]), at(i, "start_line")), F.when(below(a["end_line"]), at(i, "end_line"))))
    )

    def block(name: str, rules: list[tuple[Column, str]]) -> list[Column]:
        return [say(F.col(name).isNotNull() & bad, f"{name}.{field}") for bad, field in rules]

    get = lambda c: F.col(c)
    checks = block("verification", [(unlike(get("verification.verdict"), verdicts.VERIFY_VERDICTS), "verdict"), (F.coalesce(~get("verification.confidence").between(0, 1), F.lit(True)), "confidence"), (blank(get("verification.verified_at")), "verified_at")])
    checks += block("poc", [(F.coalesce(~get("poc.proof_level").between(1, 5), F.lit(True)), "proof_level"), (unlike(get("poc.proof_verdict"), verdicts.POC_VERDICTS), "proof_verdict"), (blank(get("poc.backend")), "backend"), (blank(get("poc.proven_at")), "proven_at")])
    checks += block("fix", [(unlike(get("fix.verdict"), verdicts.FIX_VERDICTS), "verdict"), (blank(get("fix.patch_path")), "patch_path"), (get("fix.applied").isNull(), "applied")])
    sound = F.coalesce(get("fix.verdict") == "validated", F.lit(False))
    wanted = lambda c: sound & ~F.coalesce(get(f"fix.{c}"), F.lit(False))
    checks += block("fix", [(wanted("exploit_passed"), "exploit_passed"), (wanted("functional_passed"), "functional_passed"), (sound & ~F.coalesce(get("fix.semantic_passed"), F.lit(True)), "semantic_passed"), (wanted("poc_plus_passed"), "poc_plus_passed")])
    # no path has a comma
    broken = once(rows, "errors", F.concat_ws(",", *own, anchors, *checks))
    n = F.when(F.col("errors") == "", 0).otherwise(F.length("errors") - F.length(F.replace("errors", F.lit(","), F.lit(""))) + 1)
    return broken.select("fingerprint", n.alias("n_errors"), "errors")


def sarif_results(findings: DataFrame) -> DataFrame:
    """One row an actionable finding: rule, level and a JSON location."""
    rule = F.coalesce(F.concat(F.lit("CWE-"), cwe_number(F.col("cwe")).cast("string")), F.col("source"))
    text = F.substring(F.trim(F.regexp_replace("title", r"\s+", " ")), 1, 600)
    uri = F.coalesce(F.nullif(norm_path(F.col("file_path")), F.lit("")), F.lit("."))
    place = F.to_json(F.struct(uri.alias("uri"), F.greatest(F.lit(1), F.coalesce("start_line", F.lit(1))).alias("startLine")))
    return findings.filter(F.col("status").isin(*ACTIONABLE)).select("fingerprint", rule.alias("rule_id"), verdicts.sarif_level(F.col("severity")).alias("level"), text.alias("message"), place.alias("location"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One row a distinct rule of the exported results, with the first source that has it."""
    rule = F.coalesce(F.concat(F.lit("CWE-"), cwe_number(F.col("cwe")).cast("string")), F.col("source"))
    return findings.filter(F.col("status").isin(*ACTIONABLE)).groupBy(rule.alias("rule_id")).agg(F.min("source").alias("source"), F.count("*").alias("n_results"))


def worklist(findings: DataFrame) -> DataFrame:
    """One row a repo: what can be done next, and the step that comes first."""
    has = lambda cond, name: F.bool_or(F.coalesce(cond, F.lit(False))).alias(name)
    status = F.col("status")
    agg = findings.groupBy("repo").agg(
        has(status.isin("open", "needs-trace"), "to_verify"),
        has((status == "confirmed") & ~F.coalesce(F.col("poc_verdict") == "exploited", F.lit(False)), "to_prove"),
        has(status.isin("confirmed", "proven"), "to_fix"),
        (F.count_if(status.isin(*ACTIONABLE)) >= 2).alias("to_chain"),
    )
    step = F.when(F.col("to_verify"), "verify").when(F.col("to_prove"), "poc").when(F.col("to_fix"), "fix").when(F.col("to_chain"), "chain").otherwise("report")
    return agg.withColumn("next_step", step)
