"""Quality classifier by importance resampling.

Two bags of hashed n-grams are generative models: one of the target texts, one of
all raw texts.  A document's importance is the log ratio of its probabilities
under the two; adding independent Gumbel noise and keeping the greatest keys
draws documents without replacement in proportion to their importance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.features import hashed_grams

BITS = 14


def _counts(batches):
    """is_target, text to n-gram counts of each model; one set of rows a task."""
    raw, target = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS, dtype=np.int64)
    for batch in batches:
        chosen = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j, row, index in hashed_grams(batch.column(1), BITS, skips=False):
            raw += np.bincount(index, minlength=1 << BITS)
            mine = chosen[i:j][row]
            if mine.any():
                target += np.bincount(index[mine], minlength=1 << BITS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], ["gram", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, target_rows: int = 60_000) -> np.ndarray:
    """Log ratio of each n-gram's smoothed share in the target texts to that in all texts.

    The target texts are at most ``target_rows`` of the documents labelled 1,
    chosen by a hash of the id, a documented bound; the raw model counts every
    text.  Conflicting labels of an id count as 0, null ones not at all.
    """
    d = F.col(id_col).cast("long")
    good = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(d.alias("good")).agg(F.min(F.col(label_col).cast("int")).alias("q")).filter("q = 1").select("good")
    total = good.count()
    share = min(1.0, 0.97 * target_rows / total) if total else 0.0
    chosen = good.filter(F.pmod(F.xxhash64(F.lit("quality"), "good"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(d.alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("good"), "left")
    counted = rows.select(F.col("good").isNotNull().alias("is_target"), "text").mapInArrow(_counts, "gram int, raw long, target long")
    sums = counted.groupBy("gram").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.ones(1 << BITS), np.ones(1 << BITS)
    for row in sums:
        raw[row["gram"]] += row["raw"]
        target[row["gram"]] += row["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def importance(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_grams, log_weight`` for every row; null and blank texts weigh 0."""

    def task(batches):
        for batch in batches:
            total, size = np.zeros(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64)
            for i, j, row, index in hashed_grams(batch.column(1), BITS, skips=False):
                total[i:j] = np.bincount(row, weights=ratio[index], minlength=j - i)
                size[i:j] = np.bincount(row, minlength=j - i)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(total)], ["doc_id", "n_grams", "log_weight"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, "doc_id long, n_grams long, log_weight double")


def _cutoff(keyed: DataFrame, keep: int) -> tuple[float, int] | None:
    """The least (sort_key, tie) among the ``keep`` greatest, by narrowing a histogram of 1,024 bins."""
    low, high, above = keyed.agg(F.min("sort_key"), F.max("sort_key"), F.lit(0)).first()
    inside = keyed
    for _ in range(40):
        if low is None or low == high:
            break
        width = (high - low) / 1024
        bin_ = F.least(F.lit(1023), F.floor((F.col("sort_key") - low) / width)).cast("int") if width > 0 else F.lit(0)
        bins = sorted((r["b"], r["n"], r["lo"], r["hi"]) for r in inside.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min("sort_key").alias("lo"), F.max("sort_key").alias("hi")).collect())
        for _, n, lo, hi in reversed(bins):
            if above + n >= keep:
                low, high = lo, hi
                break
            above += n
        inside = keyed.filter(F.col("sort_key").between(low, high))
        if n <= 4096:
            break
    if low is None:
        return None
    need = keep - above
    last = inside.orderBy(F.desc("sort_key"), F.desc("tie")).limit(need).orderBy("sort_key", "tie").first() if low != high or need else None
    return (last["sort_key"], last["tie"]) if last else None


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, share: float = 0.8, salt: str = "gumbel", **fitting) -> DataFrame:
    """Every document with its importance and whether the sample holds it.

    Returns ``doc_id, n_grams, log_weight, sort_key, kept``.  Exactly
    ``round(share * rows)`` rows are kept: those with the greatest ``sort_key``,
    the weight plus Gumbel noise from a hash of the id, so reruns agree.  Equal
    keys are ranked by a hash of the id; rows that repeat an id and a text are
    kept or left together, so their number may then exceed the share.  Null and
    blank texts weigh 0, very long ones are read whole.  An empty table gives an
    empty result; a null id is a value like any other, and other columns are ignored.
    """
    from siltstone.llm.workspace import written

    ratio = fit(docs, labels, id_col, text_col, **fitting)
    weighed = importance(docs, ratio, id_col, text_col)
    u = (F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    keyed = written(weighed.withColumn("sort_key", F.col("log_weight") - F.log(-F.log(u))).withColumn("tie", F.xxhash64("doc_id", "log_weight")), "importance")
    keep = round(share * keyed.count())
    last = _cutoff(keyed, keep) if keep else None
    kept = F.lit(False) if last is None else (F.col("sort_key") > last[0]) | ((F.col("sort_key") == last[0]) & (F.col("tie") >= last[1]))
    return keyed.select("doc_id", "n_grams", "log_weight", "sort_key", kept.alias("kept"))
