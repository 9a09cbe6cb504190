"""A table on shared storage that grows by deltas and is merged as it is read.

A row's key says which bucket it is in.  An upsert writes its rows into their
buckets only and is then committed: a small file named by the next number, put there
only if no other is.  Of two writers one takes the next number, and as the last
row of a key is told by the rows' own order, their deltas can come in either order.
Readers take, for each bucket, the last merged part and the deltas after it.
:meth:`MergedTable.compact` merges the buckets that have many deltas; the others stay
as they are.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from siltstone.operators.findings import upsert

_COMMIT = "number long, attempt string, batch string, base boolean, upto long, buckets array<int>"


class CommitLog:
    """Numbered files of one line each, of which no two writers can write the same."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at(path).getFileSystem(self._conf)

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def entries(self) -> list[dict]:
        """The commits in order, one small row each."""
        if not self._fs.exists(self._at(self.path)):
            return []
        return [r.asDict() for r in self.spark.read.schema(_COMMIT).json(self.path).orderBy("number").collect()]

    def put(self, entry: dict) -> bool:
        """Commit the entry under its number; False if another has that number."""
        named, draft = self._at(f"{self.path}/{entry['number']:012d}.json"), self._at(f"{self.path}/_{uuid.uuid4().hex}")
        if self._fs.exists(named):
            return False
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        hadoop = self._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        none[0] = hadoop.Options.Rename.NONE
        try:
            hadoop.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, named, none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self._fs.delete(draft, False)
            return False
        return True

    def drop(self, path: str) -> bool:
        """Delete a folder; False if there is none."""
        return self._fs.delete(self._at(path), True)


class MergedTable:
    """Rows of ``schema`` of which the last by ``order`` of each ``key`` counts."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str], order: list[Column], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.order, self.buckets = spark, path.rstrip("/"), schema, key, order, buckets
        self.log = CommitLog(spark, f"{self.path}/commits")

    def _write(self, rows: DataFrame, attempt: str) -> list[int]:
        """The rows by bucket; returns the buckets that got any."""
        place = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        out = f"{self.path}/parts/{attempt}"
        rows.withColumn("_bucket", place).repartition("_bucket").write.partitionBy("_bucket").parquet(out)
        stored = StructType([*self.schema.fields, StructField("_bucket", IntegerType())])
        return sorted(r[0] for r in self.spark.read.schema(stored).parquet(out).select("_bucket").distinct().collect())

    def _commit(self, attempt: str, batch: str | None, buckets: list[int], upto: int | None = None) -> bool:
        while True:
            done = self.log.entries()
            if batch is not None and any(e["batch"] == batch for e in done):
                return False
            number = done[-1]["number"] + 1 if done else 1
            if self.log.put({"number": number, "attempt": attempt, "batch": batch, "base": upto is not None, "upto": upto, "buckets": buckets}):
                return True

    def upsert(self, rows: DataFrame, batch: str | None = None) -> bool:
        """Add rows; False if that batch has been committed before.  Only their buckets are written."""
        if batch is not None and any(e["batch"] == batch for e in self.log.entries()):
            return False
        attempt = uuid.uuid4().hex
        return self._commit(attempt, batch, self._write(upsert(rows, self.key, self.order), attempt))

    def _parts(self) -> dict[int, list[tuple[int, str]]]:
        """For each bucket (commit, attempt) of its last merged part and of the deltas after it."""
        out: dict[int, list[tuple[int, str]]] = {}
        for e in self.log.entries():
            for b in e["buckets"]:
                kept = out.get(b, [])
                out[b] = [p for p in kept if not e["base"] or p[0] > e["upto"]] + [(e["number"], e["attempt"])]
        return out

    def _read(self, parts: dict[int, list[tuple[int, str]]]) -> DataFrame:
        paths = [f"{self.path}/parts/{a}/_bucket={b}" for b, some in parts.items() for _, a in some]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return upsert(self.spark.read.schema(self.schema).parquet(*paths), self.key, self.order)

    def read(self) -> DataFrame:
        """The last row of each key as of now."""
        return self._read(self._parts())

    def compact(self, most: int = 8) -> list[int]:
        """Merge the buckets that have more than ``most`` parts; returns them."""
        done = self.log.entries()
        many = {b: p for b, p in self._parts().items() if len(p) > most}
        if not many:
            return []
        attempt = uuid.uuid4().hex
        self._write(self._read(many), attempt)
        self._commit(attempt, None, sorted(many), upto=done[-1]["number"])
        return sorted(many)

    def vacuum(self) -> int:
        """Delete the parts that merged ones have replaced, when no reader is at them; returns their number."""
        live = {(b, a) for b, some in self._parts().items() for _, a in some}
        gone = sorted({(b, e["attempt"]) for e in self.log.entries() for b in e["buckets"]} - live)
        return sum(self.log.drop(f"{self.path}/parts/{a}/_bucket={b}") for b, a in gone)


def upsert_stream(stream: DataFrame, table: MergedTable, checkpoint: str, most: int = 8) -> None:
    """Fold what is there now of a stream into the table, a commit a batch; a batch that is repeated is committed once."""

    def fold(batch: DataFrame, number: int) -> None:
        table.upsert(batch, f"{checkpoint}:{number}")
        table.compact(most)

    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
