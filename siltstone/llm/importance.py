"""Importance resampling towards a target distribution.

Features are runs of one to three words in buckets of a CRC.  Their counts over
all documents and over the target texts give each bucket a whole-numbered gain; a
document's weight is the sum of its features' gains, taken from one array, and
its score adds Gumbel noise of its id.  The sample is the given share of documents
with the highest scores: the cutoff is found by bisecting the score, and the id
among equal scores, with exact count jobs over the persisted scores, and only what
is drawn is sorted, in ranges, for ranks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.crc import run_crcs
from siltstone.llm.wordhash import LOWER, NOT_ALNUM, Words, steps, utf8
from siltstone.llm.workspace import written

#: Bounds that one count job tries: it halves the interval four times.
_TRIED = 15
_LAST = (1 << 63) - 1


def _features(column: pa.Array, words: int, buckets: int):
    """(i, j, words of each row, row and bucket of each feature) for ranges of rows."""
    data, bounds = utf8(column)
    for i, j in steps(bounds):
        found = Words(data, bounds, i, j, blanks=NOT_ALNUM, table=LOWER)
        n = np.diff(found.first)
        row = np.repeat(np.arange(j - i), n)
        rows, at = [], []
        for k, crc in run_crcs(LOWER[found.data], found.starts, found.ends, words):
            inside = row[: len(crc)] == row[k - 1 :]
            rows.append(row[: len(crc)][inside])
            at.append((crc % np.uint32(buckets)).astype(np.int64)[inside])
        yield i, j, n, np.concatenate(rows), np.concatenate(at)


def bucket_counts(texts: DataFrame, text_col: str, words: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts.  A task hands on one row a bucket, the driver gets ``buckets`` rows."""

    def task(batches):
        n = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for *_, at in _features(batch.column(0), words, buckets):
                n += np.bincount(at, minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["bucket", "n"])

    counted = texts.select(F.col(text_col).cast("string")).mapInArrow(task, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in counted.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in all texts."""
    s, t, n = raw.astype(float), target.astype(float), len(raw)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, words: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every document."""

    def task(batches):
        for batch in batches:
            size, count, total = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for i, j, n, row, at in _features(batch.column(1), words, len(gain)):
                size[i:j] = n
                count[i:j] = np.bincount(row, minlength=j - i)
                total[i:j] = np.bincount(row, weights=gain[at], minlength=j - i)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(count), pa.array(total)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, "doc_id long, n_words long, n_features long, weight long")


def _least_bound(rows: DataFrame, value: Column, need: int) -> tuple[int, int]:
    """The least b so that ``need`` rows or more have a value up to b, and the number of rows below b.

    Each job counts rows under bounds that cut what is left of the interval into equal parts.
    """
    low, high = rows.agg(F.min(value), F.max(value)).first()
    below = 0  # rows under low
    while low < high:
        tried = sorted({low + (high - low) * i // (_TRIED + 1) for i in range(1, _TRIED + 1)})
        tried = [b for b in tried if b < high] or [low]
        counts = rows.agg(*[F.count(F.when(value <= b, 1)) for b in tried]).first()
        for b, n in zip(tried, counts, strict=True):
            if n >= need:
                high = b
                break
            low, below = b + 1, n
    return low, below


def _drawn(scored: DataFrame, keep: int) -> Column:
    """Whether a row is among the ``keep`` first by score downward, id upward and row."""
    order = [-F.col("score"), F.coalesce("doc_id", F.lit(_LAST)), F.col("row")]
    rows, need, chosen, tied = scored, keep, F.lit(False), F.lit(True)
    for value in order:
        bound, below = _least_bound(rows, value, need)
        chosen = chosen | (tied & (value < bound))
        tied = tied & (value == bound)
        rows, need = rows.filter(value == bound), need - below
        if rows.count() == need:
            break
    return chosen | tied


def resample_towards(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", *, words: int = 3, buckets: int = 10_000, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """Every document's ``doc_id, n_features, weight, score, rank``; ``rank`` is null where it isn't drawn.

    Words are lower-cased (A-Z) runs of letters, digits and bytes above 127; features
    all runs of up to ``words`` of them.  Of the N documents of ``least_words`` words
    and more the floor(percent N / 100) highest scores are drawn, ties to the smaller id.

    Null and blank texts have no feature and weigh 0; very long ones are read whole.
    Rows that repeat an id are documents of their own; where they tie, any of them goes
    first.  A null id counts as the greatest and its noise is that of an empty one.  With
    no eligible document nothing is drawn, an empty table gives an empty result, an empty
    target is a uniform one; other columns are ignored.
    """
    gain = gains(bucket_counts(docs, text_col, words, buckets), bucket_counts(target, target_text, words, buckets))
    weighed = weights(docs, gain, id_col, text_col, words)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = written(weighed.withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()), "scores")
    eligible = scored.filter(F.col("n_words") >= least_words)
    keep = percent * eligible.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not keep:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= least_words) & _drawn(eligible.select("doc_id", "score", "row"), keep)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ranges = written(scored.filter(drawn).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "drawn")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))  # one row a partition
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ranked = ranges.withColumn("own", own).join(starts, "part").select(*columns, (F.col("before") + F.col("own")).cast("long").alias("rank"))
    return ranked.union(scored.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
