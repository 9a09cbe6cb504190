"""Token counts as delta-maintained rollups.

Change events of documents arrive in numbered batches: an insert, a delete or a
revised count of one document under one tokenizer version.  Each batch turns into
signed totals by source, language and tokenizer version, written under the batch's
number and then recorded as committed; a batch that is delivered again is ignored.
Totals are the sums of the committed batches, so nothing is counted anew.

Layout of a rollup's folder: ``changes/<attempt>`` the new and old counts of the
documents that a batch named, by buckets of the id, ``deltas/<attempt>`` its signed
totals, both Parquet, and ``commits/<n>``, one line that names the attempt.  That file is
put there only if no other is, so of two writers one goes on to the next number with
the other's changes in view; what a lost attempt has left is named by no commit.
:meth:`Rollup.compact` sums up the commits so far, so that looking up old counts costs
the documents that there are, not their history; a batch that finds ``COMPACT_AFTER``
commits since the last time does so itself.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.workspace import written

#: Commits since the last compaction after which a batch compacts: its own cost then stays that of the documents and so many batches.
COMPACT_AFTER = 16
KEYS = ("source", "lang", "tokenizer")
BUCKETS = 16
EVENT = "doc_id long, tokenizer string, op string, source string, lang string, tokens long, seq long"
_CHANGE = "doc_id long, tokenizer string, number long, live boolean, source string, lang string, tokens long, bucket int"
_OLD = ", old_source string, old_lang string, old_tokens long"
_DELTA = "source string, lang string, tokenizer string, docs long, tokens long, inserts long, deletes long, revisions long"
_SUMS = ("docs", "tokens", "inserts", "deletes", "revisions")
_COMMIT = "number long, batch string, attempt string, base boolean"

#: Fixed tokenizer versions: a pattern whose matches are the tokens.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "words-2": r"[A-Za-z0-9]+|[^\x00-\x7F]+|[!-/:-@\[-`{-~]"}


def count_tokens(text: Column, tokenizer: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


class Rollup:
    """Token totals in a folder that all executors and the driver share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at(self.path).getFileSystem(self._conf)

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _committed(self) -> DataFrame:
        """``number, batch, attempt, base``, one row a commit."""
        folder = f"{self.path}/commits"
        if not self._fs.exists(self._at(folder)):
            return self.spark.createDataFrame([], _COMMIT)
        return self.spark.read.schema(_COMMIT).json(folder)

    def commits(self) -> list[tuple[int, str]]:
        """(number, batch) of each batch, in order."""
        return [(r["number"], r["batch"]) for r in self._committed().filter("batch is not null").orderBy("number").collect()]

    def _commit(self, number: int, batch: str | None, attempt: str, base: bool = False) -> bool:
        """Put commit ``number`` there unless there is one."""
        named = self._at(f"{self.path}/commits/{number:012d}.json")
        if self._fs.exists(named):
            return False
        draft = self._at(f"{self.path}/commits/_{attempt}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"number": number, "batch": batch, "attempt": attempt, "base": base}).encode()))
        out.close()
        hadoop = self._jvm.org.apache.hadoop.fs
        rename = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        rename[0] = hadoop.Options.Rename.NONE
        try:
            hadoop.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, named, rename)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        return True

    def _since_base(self) -> list:
        """The last compaction, if any, and the commits after it: one small row each."""
        done = self._committed()
        last = done.filter("base").agg(F.max("number")).first()[0]
        return done.filter(F.lit(last is None) | (F.col("number") >= (last or 0))).orderBy("number").collect()

    def state(self) -> DataFrame:
        """``doc_id, tokenizer, source, lang, tokens`` of the documents that are there."""
        return self._latest(self._log([r["attempt"] for r in self._since_base()])).filter("live").drop("live")

    def _log(self, attempts: list[str]) -> DataFrame:
        """The changes of these attempts, in no order."""
        if not attempts:
            return self.spark.createDataFrame([], _CHANGE)
        parts = [self.spark.read.schema(_CHANGE).parquet(f"{self.path}/changes/{x}") for x in attempts]
        return reduce(DataFrame.union, parts)

    def _latest(self, log: DataFrame) -> DataFrame:
        last = log.groupBy("doc_id", "tokenizer").agg(F.max(F.struct("number", "live", "source", "lang", "tokens")).alias("o"))
        return last.select("doc_id", "tokenizer", "o.live", "o.source", "o.lang", "o.tokens")

    def apply(self, batch: str, events: DataFrame) -> bool:
        """Commit a batch of events; False if that batch has been committed before.

        An insert of a document that is there counts as a revision, a revision of
        one that isn't as an insert, and a delete of one that isn't as nothing.  Of
        several events for one document and tokenizer the last by ``seq`` (then by
        op, source, language and count) holds.  Null ids, ops and tokenizers are
        left out; null counts are 0, null sources and languages values of their own;
        other columns are ignored, and an empty batch is a commit without changes.

        Only documents that the batch names are looked up, in their buckets, and written.
        Of many commits the batch also makes one (:meth:`compact`); if another writer is
        first, a later batch will.
        """
        key = ["doc_id", "tokenizer"]
        events = events.select(*[F.col(c.split()[0]) for c in EVENT.split(", ")]).filter("doc_id is not null and tokenizer is not null and op in ('insert', 'delete', 'revise')")
        last = events.groupBy(*key).agg(F.max(F.struct("seq", "op", "source", "lang", F.coalesce("tokens", F.lit(0)).alias("tokens"))).alias("e")).select(*key, F.col("e.op").alias("op"), "e.source", "e.lang", "e.tokens")
        last = last.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))
        read = False
        while not (read and self._commit(number, batch, attempt)):
            if not self._committed().filter(F.col("batch") == batch).isEmpty():
                return False
            since = self._since_base()
            number, attempt, read = (since[-1]["number"] if since else 0) + 1, uuid.uuid4().hex, True
            if since:
                last = written(last, "events")
                named = [r["bucket"] for r in last.select("bucket").distinct().collect()]
                log = self._log([r["attempt"] for r in since]).filter(F.col("bucket").isin(named)).join(last.select(*key), key, "left_semi")
                old = self._latest(log).filter("live").select(*key, F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.col("tokens").alias("old_tokens"))
                met = last.join(old, key, "left")
            else:
                none = F.lit(None)
                met = last.select("*", none.cast("string").alias("old_source"), none.cast("string").alias("old_lang"), none.cast("long").alias("old_tokens"))
            self._write(met, number, attempt)
        if len(since) >= COMPACT_AFTER:
            self.compact()
        return True

    def _write(self, met: DataFrame, number: int, attempt: str) -> None:
        """A batch's events beside the old counts to its changes and signed totals."""
        was, live = F.col("old_tokens").isNotNull(), F.col("op") != "delete"
        change = met.filter(was | live).select("doc_id", "tokenizer", F.lit(number).cast("long").alias("number"), live.alias("live"), "source", "lang", "tokens", "old_source", "old_lang", "old_tokens", "bucket")
        _by_bucket(change, f"{self.path}/changes/{attempt}")
        changed = self.spark.read.schema(_CHANGE + _OLD).parquet(f"{self.path}/changes/{attempt}")
        off = changed.filter(was).select(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), "tokenizer", F.lit(-1).alias("sign"), F.col("old_tokens").alias("tokens"), F.lit(0).alias("i"), F.when(F.col("live"), 0).otherwise(1).alias("d"), F.lit(0).alias("r"))
        on = changed.filter("live").select("source", "lang", "tokenizer", F.lit(1).alias("sign"), "tokens", F.when(was, 0).otherwise(1).alias("i"), F.lit(0).alias("d"), F.when(was, 1).otherwise(0).alias("r"))
        total = lambda c, name: F.sum(c).cast("long").alias(name)
        delta = off.union(on).groupBy(*KEYS).agg(total("sign", "docs"), total(F.col("sign") * F.col("tokens"), "tokens"), total("i", "inserts"), total("d", "deletes"), total("r", "revisions"))
        delta.coalesce(1).write.parquet(f"{self.path}/deltas/{attempt}")

    def compact(self) -> bool:
        """Sum up the commits so far in one; False if another writer was first."""
        since, attempt = self._since_base(), uuid.uuid4().hex
        number = (since[-1]["number"] if since else 0) + 1
        live = self.state().select("doc_id", "tokenizer", F.lit(number).cast("long").alias("number"), F.lit(True).alias("live"), "source", "lang", "tokens", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        _by_bucket(live, f"{self.path}/changes/{attempt}")
        self.totals().coalesce(1).write.parquet(f"{self.path}/deltas/{attempt}")
        return self._commit(number, None, attempt, base=True)

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, docs, tokens, inserts, deletes, revisions`` over all commits."""
        attempts = [r["attempt"] for r in self._since_base()]
        if not attempts:
            return self.spark.createDataFrame([], _DELTA)
        deltas = self.spark.read.schema(_DELTA).parquet(*[f"{self.path}/deltas/{x}" for x in attempts])
        return deltas.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in _SUMS])


def _by_bucket(changes: DataFrame, path: str) -> None:
    """Write changes by bucket, several files for a large one; an empty table gets its folder all the same."""
    changes.repartition("bucket", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4))).write.partitionBy("bucket").parquet(path)


def events(docs: DataFrame, op: str, seq: int, text: Column, id_col: str = "doc_id", tokenizers=tuple(TOKENIZERS)) -> DataFrame:
    """One event a document and tokenizer version, with the count of the whole ``text``; 0 for a null or blank one."""
    counts = F.array(*[F.struct(F.lit(t).alias("tokenizer"), count_tokens(text, t).alias("tokens")) for t in tokenizers])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), "source", "lang", F.explode(counts).alias("c")).select("doc_id", "c.tokenizer", F.lit(op).alias("op"), "source", "lang", "c.tokens", F.lit(seq).cast("long").alias("seq"))
