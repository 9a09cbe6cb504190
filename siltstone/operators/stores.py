"""Findings and records on shared storage: versions, logs, reports and digests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators.findings import ACTIONABLE, leading


def shared(spark: SparkSession, name: str) -> str:
    """A new folder in the place that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/siltstone/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back."""
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Versions:
    """A small table of one writer of which every write is a new version; readers see the greatest whole one.

    Tables that grow, or with several writers, are :class:`siltstone.operators.merged.MergedTable`.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def latest(self) -> int:
        """The number of the greatest version whose write has ended; 0 without one."""
        root = self._hadoop.Path(self.path)
        if not self._fs.exists(root):
            return 0
        names = [x.getPath() for x in self._fs.listStatus(root) if x.getPath().getName().startswith("v=")]
        return max([int(p.getName()[2:]) for p in names if self._fs.exists(self._hadoop.Path(p, "_SUCCESS"))], default=0)

    def replace(self, rows: DataFrame, number: int | None = None) -> int:
        """Write the whole table anew; a number given again is written again, as a repeated batch must be."""
        number = self.latest() + 1 if number is None else number
        rows.write.mode("overwrite").parquet(f"{self.path}/v={number}")
        return number

    def read(self, schema, number: int | None = None) -> DataFrame:
        number = self.latest() if number is None else number
        return self.spark.read.schema(schema).parquet(f"{self.path}/v={number}") if number else self.spark.createDataFrame([], schema)


def appended(records: DataFrame, path: str) -> None:
    """Append records to a log of JSON lines."""
    records.write.mode("append").json(path)


def report(findings: DataFrame, most: int = 200) -> DataFrame:
    """``repo, section, name, n``: a report's counts by severity, status and producer, its table's size and what it leaves out."""
    # findings are counted once; what follows sums up those few counts
    counts = written(findings.groupBy("repo", "severity", "status", "source").agg(F.count("*").alias("n")), "counts")
    by = lambda section, column: counts.groupBy("repo", F.lit(section).alias("section"), F.coalesce(column, F.lit("(none)")).alias("name")).agg(F.sum("n").alias("n"))
    total = counts.groupBy("repo").agg(F.sum("n").alias("t"))
    shown = total.select("repo", F.lit("table").alias("section"), F.lit("shown").alias("name"), F.least(F.lit(most), F.col("t")).cast("long").alias("n"))
    rest = total.select("repo", F.lit("table").alias("section"), F.lit("left out").alias("name"), F.greatest(F.lit(0), F.col("t") - most).cast("long").alias("n"))
    done = counts.filter(F.col("status").isin("reviewed", "noise", "remediated")).groupBy("repo").agg(F.sum("n").alias("n")).select("repo", F.lit("resolved").alias("section"), F.lit("all").alias("name"), "n")
    return by("severity", "severity").unionByName(by("status", "status")).unionByName(by("producer", "source")).unionByName(shown).unionByName(rest).unionByName(done)


def full_report(findings: DataFrame, ranks: DataFrame | None, chains: DataFrame, covered: DataFrame, untouched: DataFrame, first: int = 10, most: int = 200, sample: int = 25) -> DataFrame:
    """``repo, section, name, n``: :func:`report` and what it leads with and ends with.

    ``fix-first`` names the ``first`` actionable findings of ``ranks(repo, fingerprint, rank)``
    with their place among those, by risk without ``ranks``, ``chain`` each chain of ``chains(repo, label, n)``,
    ``coverage`` the files, covered and uncovered ones of ``covered``, ``uncovered`` the first
    files of ``untouched(repo, path)`` by path, with their place.
    """
    live = leading(findings, first) if ranks is None else ranks.join(findings.filter(F.col("status").isin(*ACTIONABLE)).select("repo", "fingerprint").distinct(), ["repo", "fingerprint"], "left_semi")
    top = lambda rows, order, k: rows.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy(*order)).cast("long")).filter(F.col("n") <= k)
    part = lambda rows, section, name: rows.select("repo", F.lit(section).alias("section"), name.alias("name"), F.col("n").cast("long").alias("n"))
    counts = covered.select("repo", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in ("files", "covered", "uncovered")])).alias("c")).select("repo", "c.name", "c.n")
    return (
        report(findings, most)
        .unionByName(part(top(live, ["rank", "fingerprint"], first), "fix-first", F.col("fingerprint")))
        .unionByName(part(chains, "chain", F.col("label")))
        .unionByName(part(counts, "coverage", F.col("name")))
        .unionByName(part(top(untouched.select("repo", "path").distinct(), ["path"], sample), "uncovered", F.col("path")))
    )


def runnable(rules: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, state``: whether a rule may run: it is listed, was compiled, and its content has the listed digest.

    ``rules(path, content)``, ``manifest(path, compiled, digest)`` with ``sha256:`` before the digest.
    """
    own = rules.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("own"))
    met = own.join(manifest, "path", "left")
    state = F.when(F.col("digest").isNull(), "unlisted").when(~F.coalesce("compiled", F.lit(False)), "not-compiled").when(F.substring("digest", 8, 64) != F.col("own"), "altered").otherwise("runnable")
    return met.select("path", state.alias("state"))
