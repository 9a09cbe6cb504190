"""Worklists: files and candidates that a review looks at next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import cwe_number
from siltstone.operators.grams import lines_with
from siltstone.operators.scan import rank

_LANGUAGES = (("c", r"\.(c|h)$"), ("python", r"\.py$"), ("javascript", r"\.js$"), ("java", r"\.java$"), ("go", r"\.go$"), ("ruby", r"\.rb$"))


def invariant_files(lines: DataFrame, invariants: DataFrame, most: int = 25) -> DataFrame:
    """``repo, id, path, place``: the first files by path, of an invariant's language if it names one, that hold its signal."""
    language = F.lit("other")
    for name, files in reversed(_LANGUAGES):
        language = F.when(F.col("path").rlike(files), name).otherwise(language)
    hits = lines_with(lines, invariants).select("repo", "path", "signal", language.alias("file_language")).distinct()
    # each signal's first files of each language are enough, so no invariant meets all files
    first = hits.withColumn("n", F.row_number().over(Window.partitionBy("repo", "signal", "file_language").orderBy("path"))).filter(F.col("n") <= most).drop("n")
    met = invariants.join(first, ["repo", "signal"]).filter("language is null or language = file_language").select("repo", "id", "path").distinct()
    return met.withColumn("place", F.row_number().over(Window.partitionBy("repo", "id").orderBy("path"))).filter(F.col("place") <= most)


def variant_seeds(findings: DataFrame, most: int = 8) -> DataFrame:
    """``repo, fingerprint, file_path, cwe``: the first confirmed or proven findings of each repo."""
    kept = findings.filter("status in ('confirmed', 'proven')")
    kept = kept.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy("fingerprint"))).filter(F.col("n") <= most)
    return kept.select("repo", "fingerprint", "file_path", cwe_number(F.col("cwe")).alias("cwe"))


def variant_files(seeds: DataFrame, entries: DataFrame, lines: DataFrame, most: int = 40, per_file: int = 3) -> DataFrame:
    """``repo, fingerprint, path, score, place``: other files that hold signals of a seed's CWE, by their best hit."""
    signals = entries.select("cwe", F.explode("signals").alias("signal")).filter(F.length("signal") >= 3)
    wanted = signals.join(seeds.select("cwe"), "cwe", "left_semi")
    hits = lines_with(lines, wanted, any_case=True).select("repo", "path", "line", "signal", rank(F.col("path"), F.col("text"), "generic").alias("score"))
    hits = hits.withColumn("n", F.row_number().over(Window.partitionBy("repo", "path", "signal").orderBy("line"))).filter(F.col("n") <= per_file)
    best = hits.groupBy("repo", "path", "signal").agg(F.max("score").alias("score"))
    met = seeds.join(signals, "cwe").join(best, ["repo", "signal"]).filter("path <> file_path").groupBy("repo", "fingerprint", "path").agg(F.max("score").alias("score"))
    return met.withColumn("place", F.row_number().over(Window.partitionBy("repo", "fingerprint").orderBy(F.desc("score"), "path"))).filter(F.col("place") <= most)


def candidates(parts: dict[str, tuple[DataFrame, int | None]]) -> DataFrame:
    """``repo, origin, id``: the union of several sources, each with the first rows by id up to its limit."""
    out = None
    for origin, (rows, most) in parts.items():
        own = rows.select("repo", F.lit(origin).alias("origin"), "id")
        if most is not None:
            own = own.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy("id"))).filter(F.col("n") <= most).drop("n")
        out = own if out is None else out.unionByName(own)
    return out
