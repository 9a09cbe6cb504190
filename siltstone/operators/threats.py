"""Threat models, leads and invariants: normalising, counting and looking up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import cwe_number
from siltstone.functions.verdicts import impact, likelihood, stride

#: Names of assets that a chain of findings may lead to.
ASSET = r"(?i)database|data[_\s-]?store|datastore|\bstore\b|\bqueue\b|secret|credential|vault|bucket|\bs3\b|keystore|wallet|ledger|account|session\s*store"
#: Crash classes that are critical at once.
CRITICAL_CRASHES = ("oob-write", "heap-buffer-overflow", "stack-buffer-overflow", "global-buffer-overflow", "dynamic-stack-buffer-overflow", "heap-use-after-free", "use-after-poison", "double-free")


def first_of(*names: str) -> Column:
    """The first of some columns that isn't null or blank, without surrounding blanks."""
    return F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names])


def as_list(scalar: Column, items: Column) -> Column:
    """An array's strings that aren't blank, or the scalar alone where there is no array; never null."""
    one = F.nullif(F.trim(scalar), F.lit(""))
    listed = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(listed, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def actor_type(kind: Column) -> Column:
    return F.when(F.lower(kind).isin("automated", "downstream-service", "internal-service"), "process").otherwise("external-entity")


def component_type(kind: Column) -> Column:
    low = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(F.contains(low, F.lit("database")) | F.contains(low, F.lit("store")), "data-store").when(F.contains(low, F.lit("flow")), "data-flow").otherwise("process")


def element_type(kind: Column) -> Column:
    low = F.replace(F.lower(F.coalesce(kind, F.lit(""))), F.lit("_"), F.lit("-"))
    return F.when(low.isin("external-entity", "externalentity", "external"), "external-entity").when(low.isin("data-store", "datastore"), "data-store").when(low.isin("data-flow", "dataflow"), "data-flow").otherwise("process")


def invariant_verdict(verdict: Column) -> Column:
    low = F.replace(F.lower(F.trim(F.coalesce(verdict, F.lit("")))), F.lit("needs_review"), F.lit("needs-review"))
    return F.when(low.isin("hold", "violated", "needs-review"), low).otherwise("needs-review")


def leads(raw: DataFrame) -> DataFrame:
    """``repo, lead, severity, cwe, origin``: leads of critical or high severity that have an id, a CVE or a title."""
    severity = F.lower(F.trim("severity"))
    kept = raw.select("repo", first_of("own_id", "cve", "title").alias("lead"), severity.alias("severity"), F.coalesce(F.trim("cwe"), F.lit("")).alias("cwe"), "origin")
    return kept.filter(F.col("severity").isin("critical", "high") & F.col("lead").isNotNull())


def lead_summary(normal: DataFrame) -> DataFrame:
    """``repo, cwe, stack, similar``: leads of each CWE by where they come from; those without a CWE are left out."""
    return normal.filter("cwe <> ''").groupBy("repo", "cwe").agg(F.count_if(F.col("origin") == "stack").alias("stack"), F.count_if(F.col("origin") == "similar-app").alias("similar"))


def threat_summary(threats: DataFrame) -> DataFrame:
    """``repo, impact, stride, likelihood, n``: threats by what they do; those without a known category are left out."""
    rows = threats.select("repo", impact(F.col("impact")).alias("impact"), stride(F.col("stride")).alias("stride"), likelihood(F.col("probability")).alias("likelihood"))
    return rows.filter("stride is not null").groupBy("repo", "impact", "stride", "likelihood").agg(F.count("*").alias("n"))


def invariant_summary(invariants: DataFrame) -> DataFrame:
    v = invariant_verdict(F.col("verdict"))
    return invariants.groupBy("repo").agg(F.count("*").alias("total"), F.count_if(v == "violated").alias("violated"), F.count_if(v == "needs-review").alias("needs_review"), F.count_if(v == "hold").alias("hold"))


def ledger_summary(records: DataFrame, deferred: DataFrame) -> DataFrame:
    """``repo, lane, state, n``: records of a ledger by lane and state, and what a budget left out as deferred."""
    counted = records.groupBy("repo", "lane", "state").agg(F.count("*").alias("n"))
    return counted.unionByName(deferred.filter("n > 0").select("repo", F.lit("obligation-overlay").alias("lane"), F.lit("deferred").alias("state"), "n"))


def intel_of(findings: DataFrame, intel: DataFrame) -> DataFrame:
    """``fingerprint, n_leads, n_invariants, first_lead``: intelligence of exactly a finding's CWE, counted by kind.

    ``intel(repo, cwe, kind, id)`` is reduced by CWE before it meets the findings.
    """
    by_cwe = intel.filter("cwe <> ''").groupBy("repo", "cwe").agg(F.count_if(F.col("kind") == "lead").alias("n_leads"), F.count_if(F.col("kind") == "invariant").alias("n_invariants"), F.min(F.when(F.col("kind") == "lead", F.col("id"))).alias("first_lead"))
    met = findings.select("repo", "fingerprint", "cwe").join(by_cwe, ["repo", "cwe"], "left")
    return met.select("fingerprint", F.coalesce("n_leads", F.lit(0)).alias("n_leads"), F.coalesce("n_invariants", F.lit(0)).alias("n_invariants"), "first_lead")


def threats_of(drafts: DataFrame, threats: DataFrame) -> DataFrame:
    """``id, title, impact, cwe``: drafts beside the threat that they name, if it is there; threat ids are distinct in a repo."""
    t = threats.select("repo", F.col("id").alias("threat"), "title", impact(F.col("impact")).alias("impact"), cwe_number(F.col("cwe")).alias("cwe"))
    return drafts.select("repo", "id", "threat").join(t, ["repo", "threat"], "left").select("id", "title", "impact", "cwe")


def boundary_crossings(boundaries: DataFrame, flows: DataFrame) -> DataFrame:
    """``repo, boundary, crossing``: the flows that a boundary lists or that name it, sorted.

    ``boundaries(repo, boundary, own array)``, ``flows(repo, flow, boundaries array)``;
    crossings are rows until the last step, which joins them into one text a boundary.
    """
    own = boundaries.select("repo", "boundary", F.explode("own").alias("flow"))
    named = flows.select("repo", "flow", F.explode("boundaries").alias("boundary")).join(boundaries.select("repo", "boundary"), ["repo", "boundary"], "left_semi").select("repo", "boundary", "flow")
    every = own.union(named).distinct().groupBy("repo", "boundary").agg(F.array_join(F.array_sort(F.collect_list("flow")), ",").alias("crossing"))
    return boundaries.select("repo", "boundary").join(every, ["repo", "boundary"], "left").select("repo", "boundary", F.coalesce("crossing", F.lit("")).alias("crossing"))


def dfd_nodes(elements: DataFrame) -> DataFrame:
    """``repo, id, type, name, zone``: nodes of a data-flow diagram, the first that defines an id; data flows are no nodes.

    ``elements(repo, ord, bucket, id, kind, name, zone)`` in order: a bucket of actors,
    services, databases, components or free elements.
    """
    typed = F.when(F.col("bucket") == "actors", actor_type(F.col("kind"))).when(F.col("bucket") == "services", "process").when(F.col("bucket") == "databases", "data-store").when(F.col("bucket") == "components", component_type(F.col("kind"))).otherwise(element_type(F.col("kind")))
    zone = F.when(F.col("bucket") == "actors", "external").when(F.col("bucket") == "elements", "unknown").otherwise("internal")
    rows = elements.select("repo", "ord", F.nullif(F.trim("id"), F.lit("")).alias("id"), typed.alias("type"), F.nullif(F.trim("name"), F.lit("")).alias("name"), F.coalesce(F.nullif(F.trim("zone"), F.lit("")), zone).alias("zone"))
    rows = rows.filter("id is not null and type <> 'data-flow'")
    first = rows.groupBy("repo", "id").agg(F.min(F.struct("ord", "type", "name", "zone")).alias("n"))
    return first.select("repo", "id", "n.type", F.coalesce("n.name", "id").alias("name"), "n.zone")


def assets(nodes: DataFrame, most: int = 25) -> DataFrame:
    """``repo, name, place``: nodes that are worth reaching, the first of names that differ in case only."""
    hit = nodes.filter((F.col("type") == "data-store") | F.col("name").rlike(ASSET))
    one = hit.groupBy("repo", F.lower("name").alias("k")).agg(F.min("name").alias("name"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy("k"))).filter(F.col("place") <= most).select("repo", "name", "place")


def entry_points(sources: dict[str, DataFrame], most: int = 40) -> DataFrame:
    """``repo, path, kind, origin, place``: entry points of several sources in order, one a file and kind."""
    rows = None
    for o, (origin, rows_of) in enumerate(sources.items()):
        own = rows_of.select("repo", "path", "kind", F.lit(origin).alias("origin"), F.lit(o).alias("ord"))
        rows = own if rows is None else rows.union(own)
    one = rows.filter("path is not null").groupBy("repo", "path", F.coalesce("kind", F.lit("")).alias("kind")).agg(F.min(F.struct("ord", "origin")).alias("m"))
    place = F.row_number().over(Window.partitionBy("repo").orderBy("m.ord", "path", "kind"))
    return one.withColumn("place", place).filter(F.col("place") <= most).select("repo", "path", "kind", "m.origin", "place")


def discovered_severity(error_class: Column) -> Column:
    return F.when(F.coalesce(error_class.isin(*CRITICAL_CRASHES), F.lit(False)), "critical").otherwise("high")


def promoted_crashes(results: DataFrame, crashes: DataFrame, minimised: DataFrame) -> DataFrame:
    """``fingerprint, status, crash_hash, input``: exploited results as proven, with their crash and its least input, if known.

    A finding's crash is the first of its hashes.
    """
    group = crashes.groupBy("fingerprint").agg(F.min("crash_hash").alias("crash_hash"))
    small = minimised.groupBy("crash_hash").agg(F.min("input").alias("input"))
    met = results.filter("verdict = 'exploited'").select("fingerprint").distinct().join(group, "fingerprint", "left").join(small, "crash_hash", "left")
    return met.select("fingerprint", F.lit("proven").alias("status"), "crash_hash", "input")


def mitigations(flags: DataFrame, binaries: DataFrame) -> DataFrame:
    """``repo, nx, pie, canary, relro, fortify, cfg``: what a binary shows, else what the build files say, else null.

    ``flags`` are those of the hardening scan, a path or null each; ``binaries`` hold a
    text a mitigation, null if unknown, of which the first binary by path counts.
    """
    first = binaries.groupBy("repo").agg(F.min(F.struct("path", "nx", "pie", "canary", "relro", "fortify", "cfg")).alias("b"))
    said = lambda c, value: F.when(F.col(c).isNotNull(), value)
    met = flags.join(first, "repo", "full")
    source = {"nx": said("no_exec_stack", "true"), "pie": said("pie", "true"), "canary": said("stack_protector", "true"), "relro": said("relro", "partial"), "fortify": said("fortify", "true"), "cfg": said("cfg", "true")}
    return met.select("repo", *[F.coalesce(F.col(f"b.{k}"), v).alias(k) for k, v in source.items()])
