"""Toxicity: FTRL-proximal logistic regression over hashed words, stems, n-grams and skip-grams.

The model is fitted on at most ``max_rows`` labelled rows, a documented bound:
their ids are broadcast, their features hashed where the texts lie, and one task
runs the sequential updates.  Per-coordinate rates and the L1 term leave a few
thousand weights out of 2^BITS, which scoring tasks carry with them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.features import hashed_grams

BITS = 20
#: Fixed settings: rate, offset of the rate, L1 and L2 terms, passes, and bytes of stems; chosen by folds of rows that aren't held out.
ALPHA, BETA, L1, L2, PASSES, STEMS = 2.0, 1.0, 5.0, 0.0, 4, (5, 7)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _featurise(batches):
    for batch in batches:
        found: list[np.ndarray] = []
        for i, j, row, index in hashed_grams(batch.column(2), BITS, skips=True, stems=STEMS):
            key = np.unique(row << BITS | index)
            at = np.searchsorted(key, np.arange(j - i + 1) << BITS)
            index = (key & ((1 << BITS) - 1)).astype(np.int32)
            found += [index[at[r] : at[r + 1]] for r in range(j - i)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in found], pa.binary())], ["ord", "label", "grams"])


def ftrl(examples: list[tuple[int, np.ndarray]], passes: int = PASSES) -> tuple[float, np.ndarray, np.ndarray]:
    """(label, feature indices) in order to the bias, the indices with a weight, and their weights."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        w = (np.sign(own) * L1 - own) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(own) <= L1, 0.0, w)

    bias = np.array([size])
    for _ in range(passes):
        for label, grams in examples:
            at = np.concatenate((grams, bias))
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            if abs(g) < 1e-4:
                continue
            before = n[at]
            after = before + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
            n[at] = after
    w = weights(np.arange(size + 1))
    some = np.flatnonzero(w[:size])
    return float(w[size]), some.astype(np.int32), w[some].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, max_rows: int = 20_000, passes: int = PASSES):
    """The model (bias, indices, weights) from labelled rows that aren't held out.

    At most ``max_rows`` labelled ids are used, chosen by a hash of the id, each with
    one text, that of the least features where there are several; a doc_id with
    both labels counts as 1.  Null labels and ids are left out.  Without rows the
    model is a bias of 0.
    """
    d = F.col(id_col).cast("long")
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(d.alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    total = marked.count()
    share = min(1.0, 0.97 * max_rows / total) if total else 0.0
    order = F.xxhash64(F.lit("toxicity"), "id")
    chosen = marked.withColumn("ord", order).filter(F.pmod("ord", F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(d.alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("ord", "label", "text")
    featured = rows.mapInArrow(_featurise, "ord long, label int, grams binary").groupBy("ord", "label").agg(F.min("grams").alias("grams"))

    def train(batches):
        kept = [x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        kept.sort()
        bias, index, weight = ftrl([(label, np.frombuffer(grams, np.int32)) for _, label, grams in kept], passes)
        yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([index.tobytes()]), pa.array([weight.tobytes()])], ["bias", "at", "weight"])

    model = featured.repartition(1).mapInArrow(train, "bias double, at binary, weight binary")
    row = model.first()
    return (row["bias"], np.frombuffer(row["at"], np.int32), np.frombuffer(row["weight"], np.float32)) if row else (0.0, np.zeros(0, np.int32), np.zeros(0, np.float32))


def _scores(column: pa.Array, bias: float, dense: np.ndarray) -> np.ndarray:
    out = np.full(len(column), bias, dtype=np.float64)
    hot = dense != 0
    for i, j, row, index in hashed_grams(column, BITS, skips=True, stems=STEMS):
        some = hot[index]
        key = np.unique(row[some] << BITS | index[some])
        out[i:j] += np.bincount(key >> BITS, weights=dense[key & ((1 << BITS) - 1)], minlength=j - i)
    return 1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))


def _dense(at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << BITS, dtype=np.float64)
    out[at] = weight
    return out


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    Only the text is an input of the score, very long ones as a whole.  Null and empty
    texts score what the bias gives.  Repeated rows give repeated rows; an empty
    table an empty result; other columns are ignored.
    """
    bias, at, weight = model

    def task(batches):
        dense = _dense(at, weight)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), bias, dense))], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(task, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **fitting) -> DataFrame:
    """``docs`` without the rows whose text scores at least ``threshold``; columns stay."""
    bias, at, weight = fit(docs, labels, id_col, text_col, **fitting)
    schema, place = docs.schema, docs.columns.index(text_col)

    def task(batches):
        dense = _dense(at, weight)
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(place), bias, dense) < threshold))

    return docs.mapInArrow(task, schema)
