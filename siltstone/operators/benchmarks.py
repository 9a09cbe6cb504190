"""Results of a review held against labelled ground truth."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import basename, cwe_number, norm_path, same_path
from siltstone.operators.stores import written

#: Statuses that take no part in matching.
INACTIVE = ("reviewed", "noise", "rejected")


def _rounded(a: Column, b: Column, places: int = 4) -> Column:
    """a / b, null where b is 0."""
    return F.round(F.try_divide(a, b), places)


def _met(truth: DataFrame, actual: DataFrame, tolerance: int) -> DataFrame:
    """Distinct places of expectations beside the distinct places of findings that meet them.

    A place is case, path, line and CWE; findings are reduced to counts by place, and
    to counts by file where an expectation has no line, before anything is joined.
    The join runs on case and file name, and on the bucket of the line for
    expectations with one, so that a file with many findings doesn't meet itself.
    """
    live = actual.filter(~F.col("status").isin(*INACTIVE))
    cells = live.groupBy("case_id", F.col("file_path").alias("f_path"), F.col("line").alias("f_line"), cwe_number(F.col("cwe")).alias("f_cwe")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "proven").alias("np"), F.min("fingerprint").alias("first"))
    cells = cells.withColumn("base", basename(norm_path(F.col("f_path"))))
    wanted = truth.select("case_id", F.col("file_path").alias("e_path"), F.col("line").alias("e_line"), cwe_number(F.col("cwe")).alias("e_cwe")).distinct().withColumn("base", basename(norm_path(F.col("e_path"))))
    ok = same_path(F.col("e_path"), F.col("f_path")) & F.coalesce(F.col("e_cwe") == F.col("f_cwe"), F.lit(True))
    width = 2 * tolerance + 1
    with_line = wanted.filter("e_line > 0").withColumn("bucket", F.explode(F.array_distinct(F.array(*[F.floor((F.col("e_line") + d) / width) for d in (-tolerance, tolerance)]))))
    sited = with_line.join(cells.withColumn("bucket", F.floor(F.col("f_line") / width)), ["case_id", "base", "bucket"]).filter(ok & (F.abs(F.col("e_line") - F.col("f_line")) <= tolerance))
    files = cells.groupBy("case_id", "base", "f_path", "f_cwe").agg(F.sum("n").alias("n"), F.sum("np").alias("np"), F.min("first").alias("first"))
    filed = wanted.filter("coalesce(e_line, 0) <= 0").join(files, ["case_id", "base"]).filter(ok).withColumn("f_line", F.lit(None).cast("long"))
    columns = ["case_id", "e_path", "e_line", "e_cwe", "f_path", "f_line", "f_cwe", "n", "np", "first"]
    return sited.select(*columns).union(filed.select(*columns))


def _by_expectation(truth: DataFrame, met: DataFrame) -> DataFrame:
    """``truth`` with the number of findings that meet each row, that of proven ones, and the first fingerprint."""
    per = met.groupBy("case_id", "e_path", "e_line", "e_cwe").agg(F.sum("n").alias("n"), F.sum("np").alias("np"), F.min("first").alias("first")).withColumnRenamed("case_id", "e_case")
    place = (F.col("case_id") == F.col("e_case")) & (F.col("file_path") == F.col("e_path")) & F.col("line").eqNullSafe(F.col("e_line")) & cwe_number(F.col("cwe")).eqNullSafe(F.col("e_cwe"))
    return truth.join(per, place, "left").drop("e_case", "e_path", "e_line", "e_cwe")


def matches(truth: DataFrame, actual: DataFrame, tolerance: int = 5) -> DataFrame:
    """``case_id, id, n, first``: expectations that active findings meet, how many and the least fingerprint.

    Paths match if one ends with the other, lines within ``tolerance`` where the
    expectation has one, CWEs where both have one.
    """
    return _by_expectation(truth, _met(truth, actual, tolerance)).filter("n > 0").select("case_id", "id", "n", "first")


def score(truth: DataFrame, actual: DataFrame, tolerance: int = 5, strict: bool = False) -> DataFrame:
    """One row a case: hits, misses, false alarms, false proofs and the three rates."""
    met = written(_met(truth, actual, tolerance), "met")
    each = _by_expectation(truth, met).withColumn("hit", F.coalesce(F.col("n") > 0, F.lit(False)))
    vuln = F.col("kind") == "vuln"
    by_case = each.groupBy("case_id").agg(
        F.count_if(vuln).alias("expected"), F.count_if(vuln & F.col("hit")).alias("tp"), F.count_if(vuln & ~F.col("hit")).alias("fn"), F.count_if(~vuln & F.col("hit")).alias("decoys_hit"), F.count_if(~vuln & (F.coalesce("np", F.lit(0)) > 0)).alias("false_proofs")
    )
    # a place that an expectation meets is matched with all its findings, a file and CWE with all its places
    keys = ["case_id", "f_path", "f_cwe"]
    places = met.filter("f_line is not null").select(*keys, "f_line").distinct().withColumn("here", F.lit(True)).alias("p")
    files = met.filter("f_line is null").select(*keys).distinct().withColumn("whole", F.lit(True)).alias("w")
    live = actual.filter(~F.col("status").isin(*INACTIVE)).groupBy("case_id", F.col("file_path").alias("f_path"), F.col("line").alias("f_line"), cwe_number(F.col("cwe")).alias("f_cwe")).agg(F.count("*").alias("n")).alias("a")
    same = lambda other, names: functools.reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"{other}.{c}")) for c in names])
    free = live.join(places, same("p", [*keys, "f_line"]), "left").join(files, same("w", keys), "left").filter("here is null and whole is null")
    active = free.groupBy("a.case_id").agg(F.sum("a.n").alias("unmatched"))
    proofs = actual.filter("status = 'proven'").groupBy("case_id").agg(F.count("*").alias("proven"))
    full = by_case.join(active, "case_id", "left").join(proofs, "case_id", "left").fillna(0, ["unmatched", "proven"])
    fp = F.col("decoys_hit") + (F.col("unmatched") if strict else F.lit(0))
    return full.select(
        "case_id", "expected", "tp", "fn", fp.alias("fp"), "false_proofs", "unmatched", "proven",
        _rounded(F.col("tp"), F.col("expected")).alias("recall"), _rounded(F.col("tp"), F.col("tp") + fp).alias("precision"), _rounded(F.col("false_proofs"), F.col("proven")).alias("false_proof_rate"),
    )


def aggregate(cases: DataFrame) -> DataFrame:
    """All cases of :func:`score` in one row; rates are those of the sums."""
    sums = cases.agg(*[F.sum(c).alias(c) for c in ("expected", "tp", "fn", "fp", "false_proofs", "proven")])
    return sums.select("*", _rounded(F.col("tp"), F.col("expected")).alias("recall"), _rounded(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _rounded(F.col("false_proofs"), F.col("proven")).alias("false_proof_rate"))


def _in_reach(truth: DataFrame, places: DataFrame, radius: int) -> DataFrame:
    """``case_id, file_path, line`` of the expectations with a line that a place of their file lies within ``radius`` lines of.

    Distinct places meet distinct expectations by file name and bucket of lines.
    """
    width = 2 * radius + 1
    near = F.explode(F.array_distinct(F.array(*[F.floor((F.col("line") + d) / width) for d in (-radius, radius)])))
    e = truth.filter("line > 0").select("case_id", "file_path", "line").distinct().withColumn("base", basename(norm_path(F.col("file_path")))).withColumn("bucket", near)
    a = places.filter("line is not null").select("case_id", F.col("file_path").alias("a_path"), F.col("line").alias("a_line")).distinct().withColumn("base", basename(norm_path(F.col("a_path")))).withColumn("bucket", F.floor(F.col("a_line") / width))
    met = e.join(a, ["case_id", "base", "bucket"]).filter(same_path(F.col("file_path"), F.col("a_path")) & (F.abs(F.col("line") - F.col("a_line")) <= radius))
    return met.select("case_id", "file_path", "line").distinct()


def _in_file(truth: DataFrame, files: DataFrame) -> DataFrame:
    """``case_id, file_path, line`` of the expectations whose file is among the files."""
    e = truth.select("case_id", "file_path").distinct().withColumn("base", basename(norm_path(F.col("file_path"))))
    a = files.select("case_id", F.col("file_path").alias("a_path")).distinct().withColumn("base", basename(norm_path(F.col("a_path"))))
    met = e.join(a, ["case_id", "base"]).filter(same_path(F.col("file_path"), F.col("a_path"))).select("case_id", "file_path").distinct()
    return truth.select("case_id", "file_path", "line").distinct().join(met, ["case_id", "file_path"])


def _named(truth: DataFrame, met: DataFrame) -> DataFrame:
    """``case_id, id`` of the expectations at these places."""
    m = met.distinct().select(F.col("case_id").alias("_c"), F.col("file_path").alias("_p"), F.col("line").alias("_l"))
    return truth.join(m, (F.col("case_id") == F.col("_c")) & (F.col("file_path") == F.col("_p")) & F.col("line").eqNullSafe(F.col("_l")), "left_semi").select("case_id", "id").distinct()


def anchor_hits(truth: DataFrame, anchors: DataFrame, site: bool, radius: int = 6) -> DataFrame:
    """``case_id, id`` of the expectations that an anchor meets: in the same file, within ``radius`` lines.

    At file level a missing line on either side is met by any; at site level the
    anchor needs one.  Anchors and expectations are reduced to places and files
    before they meet.
    """
    open_ended = truth.filter("coalesce(line, 0) <= 0")
    met = _in_reach(truth, anchors, radius)
    if site:
        return _named(truth, met.union(_in_file(open_ended, anchors.filter("line is not null"))))
    return _named(truth, met.union(_in_file(open_ended, anchors)).union(_in_file(truth, anchors.filter("line is null"))))


def context(truth: DataFrame, files: DataFrame, obligations: DataFrame, overlay: DataFrame, leads: DataFrame, tolerance: int = 6) -> DataFrame:
    """``case_id, id, file_seen, site_seen``: whether a review was shown an expectation's file, and its site.

    ``files(case_id, file_path)`` are those that it was given; sites are the places of
    obligations and of the overlay (case_id, file_path, line), and both ends of leads
    (case_id, file_path, sink_line, source_line).  A site is seen within ``tolerance``
    lines; without a line on either side any place of the file will do.
    """
    place = lambda rows, line: rows.select("case_id", "file_path", F.col(line).cast("long").alias("line"))
    sites = place(obligations, "line").union(place(overlay, "line")).union(place(leads, "sink_line")).union(place(leads, "source_line").filter("line is not null")).distinct()
    filed = _named(truth, _in_file(truth, files)).withColumn("f", F.lit(True))
    free = F.col("line").isNull()
    sited = _named(truth, _in_reach(truth, sites, tolerance).union(_in_file(truth.filter("coalesce(line, 0) <= 0"), sites)).union(_in_file(truth, sites.filter(free)))).withColumn("s", F.lit(True))
    met = truth.select("case_id", "id").join(filed, ["case_id", "id"], "left").join(sited, ["case_id", "id"], "left")
    return met.select("case_id", "id", F.coalesce("f", F.lit(False)).alias("file_seen"), F.coalesce("s", F.lit(False)).alias("site_seen"))


def scoreboard(truth: DataFrame, lanes: dict[str, DataFrame]) -> DataFrame:
    """Recall of each lane by case and over all, by ROLLUP; ``lanes``: name to met expectations."""
    rows = truth.filter("kind = 'vuln'").select("case_id", "id")
    for name, met in lanes.items():
        rows = rows.join(met.withColumn(name, F.lit(1)), ["case_id", "id"], "left")
    return rows.rollup("case_id").agg(F.count("*").alias("expected"), *[_rounded(F.coalesce(F.sum(name), F.lit(0)), F.count("*")).alias(name) for name in lanes])


def gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``flag, metric, value, passed``: named metrics against thresholds, numbers or per cent; a missing metric fails."""
    text = F.trim("threshold")
    limit = F.when(text.endswith("%"), F.regexp_replace(text, "%$", "").try_cast("double") / 100).otherwise(text.try_cast("double"))
    met = thresholds.withColumn("limit", limit).join(metrics, "metric", "left")
    ok = F.when(F.col("comparator") == "min", F.col("value") >= F.col("limit")).when(F.col("comparator") == "max", F.col("value") <= F.col("limit"))
    return met.select("flag", "metric", "value", F.coalesce(ok, F.lit(False)).alias("passed"))


def rule_grades(rule_matches: DataFrame, n_files: DataFrame, most: int = 200, share: float = 0.25) -> DataFrame:
    """``rule_id, grade``: the first stage that a rule fails, or accepted.

    ``n_files``: one row with ``n``.  A rule must compile, match its seed, match at
    most ``most`` times and in at most ``share`` of the files.
    """
    agg = rule_matches.groupBy("rule_id").agg(F.bool_and("compile_ok").alias("ok"), F.bool_or("seed_matched").alias("seed"), F.count("*").alias("n_matches"), F.countDistinct("file").alias("n_match_files"))
    met = agg.crossJoin(F.broadcast(n_files.select(F.col("n").alias("n_files"))))
    grade = F.when(~F.col("ok"), "does-not-compile").when(~F.col("seed"), "misses-seed").when(F.col("n_matches") > most, "too-many-matches").when(F.col("n_match_files") > F.col("n_files") * share, "too-many-files").otherwise("accepted")
    return met.select("rule_id", "n_matches", "n_match_files", grade.alias("grade"))
