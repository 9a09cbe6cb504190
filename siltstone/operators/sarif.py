"""Findings as SARIF 2.1.0 documents, one a repository, written and read in parts.

A document is rows of text: its head, a line a rule, a line a result, its foot.  Rows
are sorted by repository and place and written in that order, so a repository's files,
in order of their names, are its document, and no row or task holds more than lines.
Findings are shuffled once, as columns; their lines are made where they are written.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import verdicts
from siltstone.functions.text import norm_path
from siltstone.operators.stores import written

#: Fixed values of the format, and statuses and verdicts of findings that are exported.
SCHEMA, VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0"
STATUSES, VERDICTS = ("open", "confirmed", "proven"), ("exploitable", "finding")
_RESULT = "ruleId string, ruleIndex long, level string, message struct<text:string>, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint>>>>, partialFingerprints struct<primary:string>, properties map<string,string>"


#: A result's properties and the columns that hold them.
_PROPERTIES = {"source": "source", "verdict": "verdict", "status": "status", "proofState": "proof_state", "severity": "severity", "refId": "ref_id", "verificationVerdict": "verify_verdict", "proofVerdict": "poc_verdict", "fixVerdict": "fix_verdict"}
#: Lines that a task sorts and writes: about 100 MB of text.
LINES = 100_000


def exported(findings: DataFrame, everything: bool = False) -> DataFrame:
    """``repo, rule_id, fingerprint, title, rationale, evidence`` and the properties: the exported findings, with what their results are made of.

    ``findings`` have repo, fingerprint, source, title, rationale, severity, cwe,
    verdict, status, evidence (an array of file_path and start_line) and the verdicts of
    verification, proof and fix.  A rule is the CWE as written or, without one, the
    source.
    """
    kept = findings if everything else findings.filter(F.col("status").isin(*STATUSES) | F.col("verdict").isin(*VERDICTS))
    rule = F.coalesce(F.upper(F.nullif(F.trim("cwe"), F.lit(""))), "source", F.lit("finding"))
    return kept.select("repo", rule.alias("rule_id"), "fingerprint", "title", "rationale", "evidence", *_PROPERTIES.values())


def rules(of: DataFrame) -> DataFrame:
    """``repo, rule_id, rule_index, n_rules, last, n``: each repo's distinct rules in order of their first result, from 0; the repo's number of rules and last fingerprint, the rule's number of results."""
    each = of.groupBy("repo", "rule_id").agg(F.min(F.struct("fingerprint")).alias("first"), F.max("fingerprint").alias("last"), F.count("*").alias("n"))
    # one row a rule and repo, so a window a repo is small
    w = Window.partitionBy("repo")
    return each.select("repo", "rule_id", (F.row_number().over(w.orderBy("first", "rule_id")) - 1).cast("long").alias("rule_index"), F.count("*").over(w).alias("n_rules"), F.max("last").over(w).alias("last"), "n")


def _result() -> Column:
    """The line of an exported finding with its ``rule_index``.

    Anchors without a file are left out; without any the location is the first line of
    the folder.  Properties are there only where they have a value.
    """
    why = F.substring(F.trim(F.regexp_replace("rationale", r"\s+", " ")), 1, 600)
    said = F.concat(F.coalesce("title", "rule_id"), F.when(F.col("rationale").rlike(r"\S"), F.concat(F.lit(" — "), why)).otherwise(""))
    named = lambda a: F.coalesce(F.trim(a["file_path"]), F.lit("")) != ""
    folder = F.struct(F.lit(".").alias("file_path"), F.lit(1).cast("long").alias("start_line"))
    anchors = F.when(F.exists("evidence", named), F.filter("evidence", named)).otherwise(F.array(folder))
    uri = lambda a: F.struct(norm_path(a["file_path"]).alias("uri")).alias("artifactLocation")
    line = lambda a: F.struct(F.greatest(F.lit(1), F.coalesce(a["start_line"], F.lit(1))).cast("long").alias("startLine")).alias("region")
    places = F.transform(anchors, lambda a: F.struct(F.struct(uri(a), line(a)).alias("physicalLocation")))
    properties = F.map_filter(F.create_map(*[x for name, c in _PROPERTIES.items() for x in (F.lit(name), F.col(c))]), lambda _, v: v.isNotNull())
    return F.to_json(F.struct(F.col("rule_id").alias("ruleId"), verdicts.sarif_level(F.col("severity")).alias("level"), F.struct(said.alias("text")).alias("message"), places.alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"), properties.alias("properties"), F.col("rule_index").alias("ruleIndex")))


def document(findings: DataFrame, tool: str, version: str, everything: bool = False) -> DataFrame:
    """``repo, part, place, text``: the lines of each repository's document, in order; those of a part follow by place.

    A repository without a finding that is exported has no document.  Results follow by
    fingerprint; those of one fingerprint are numbered.
    """
    of = exported(findings, everything)
    named = written(rules(of), "rules")
    tasks = 1 + (named.agg(F.sum("n")).first()[0] or 0) // LINES
    lines = lambda df, part, key, text: df.select("repo", F.lit(part).alias("part"), key.alias("key"), text.alias("text"))
    repos, one = named.select("repo").distinct(), F.lit("")
    head = F.lit(f'{{"$schema":"{SCHEMA}","version":"{VERSION}","runs":[{{"tool":{{"driver":{{"name":"{tool}","version":"{version}","rules":[')
    number = F.regexp_extract("rule_id", r"^CWE-(\d+)$", 1)
    tags = F.when(number != "", F.array(F.lit("security"), F.concat(F.lit("external/cwe/cwe-"), number))).otherwise(F.array(F.lit("security")))
    short = F.when(F.col("rule_id").startswith("CWE-"), F.concat("rule_id", F.lit(" weakness"))).otherwise(F.concat("rule_id", F.lit(" finding")))
    rule = F.to_json(F.struct(F.col("rule_id").alias("id"), F.regexp_replace("rule_id", "[^A-Za-z0-9]+", "").alias("name"), F.struct(short.alias("text")).alias("shortDescription"), F.struct(tags.alias("tags")).alias("properties")))
    comma = lambda more: F.when(more, ",").otherwise("")
    indexed = of.join(named.select("repo", "rule_id", "rule_index", "last"), ["repo", "rule_id"]).withColumn("ends", F.col("fingerprint").eqNullSafe(F.col("last")))
    rows = (
        lines(repos, 0, one, head)
        .union(lines(named, 1, F.lpad(F.col("rule_index").cast("string"), 12, "0"), F.concat(rule, comma(F.col("rule_index") + 1 < F.col("n_rules")))))
        .union(lines(repos, 2, one, F.lit(']}},"results":[')))
        .union(lines(repos, 4, one, F.lit("]}]}")))
        .unionByName(indexed.drop("last").withColumns({"part": F.lit(3), "key": F.col("fingerprint")}), allowMissingColumns=True)
    )
    order = ["repo", "part", "key"]
    laid = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order, "rule_index")
    # a key's lines lie together already, so this needs no shuffle of its own
    same = Window.partitionBy(*order).orderBy("rule_index")
    laid = laid.withColumns({"n": F.row_number().over(same), "more": ~F.col("ends") | F.lead(F.lit(True)).over(same).isNotNull()})
    text = F.when(F.col("part") == 3, F.concat(_result(), comma(F.col("more")))).otherwise(F.col("text"))
    return laid.select("repo", "part", F.struct("key", "n").alias("place"), text.alias("text"))


def write(lines: DataFrame, path: str, compression: str = "none", in_order: bool = False) -> None:
    """The documents as text files under ``repo=...``, whose order by name is that of their lines; ``in_order`` are those that ``document`` returns."""
    order = ["repo", "part", "place"]
    lines = lines if in_order else lines.repartitionByRange(*order).sortWithinPartitions(*order)
    with _short_methods(lines.sparkSession):
        lines.select("repo", "text").write.partitionBy("repo").text(path, compression=compression)


@contextmanager
def _short_methods(spark: SparkSession):
    """Inside, rows of so many expressions that their one generated method is over the JVM's limit of compiled methods are made by several: it would be interpreted, five times slower."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``repo, result``: the results of written documents, each line parsed by itself."""
    text = spark.read.schema("value string, repo string").text(path)
    return text.filter(F.col("value").startswith('{"ruleId"')).select("repo", F.from_json(F.rtrim("value", F.lit(",")), _RESULT).alias("result"))
