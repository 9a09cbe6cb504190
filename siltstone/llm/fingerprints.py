"""Document fingerprints: one-permutation MinHash with optimal densification.

A document's shingles are hashed once.  The high bits of a hash choose its bin,
the least hash of a bin is its value, and an empty bin takes the value of the
first non-empty bin in a pseudo-random order of its own that is the same for all
documents.  ``BITS`` low-order bits a bin are stored; the likeness of two
fingerprints is their share of agreeing bins, corrected for chance agreement.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.wordhash import U64, Words, mix, seeds, shingles, steps, utf8

BINS, BITS, SHINGLE_WORDS = 256, 4, 5
_BIN_BITS = U64(BINS.bit_length() - 1)
_NONE = U64(0xFFFFFFFFFFFFFFFF)
_OF_BIN = seeds(BINS, 31)


def _densify(values: np.ndarray) -> np.ndarray:
    """Fill the empty bins of (n, BINS) values; rows without any value stay empty."""
    full = values != _NONE
    out = values.copy()
    row, col = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        to = (mix(col.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(attempt)) % U64(BINS)).astype(np.int64)
        hit = full[row, to]
        out[row[hit], col[hit]] = values[row[hit], to[hit]]
        row, col = row[~hit], col[~hit]
    return out


def codes(column: pa.Array, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(n, BINS) low-order bits of each text's bins, and whether it has a shingle."""
    data, bounds = utf8(column)
    n = len(column)
    values = np.full((n, BINS), _NONE, dtype=U64)
    for i, j in steps(bounds):
        words = Words(data, bounds, i, j)
        found, at = shingles(words.hashes(), words.first, k)
        if not len(found):
            continue
        which = np.repeat(np.arange(j - i), np.diff(at)) * BINS + (found >> (U64(64) - _BIN_BITS)).astype(np.int64)
        order = np.argsort(which, kind="stable")
        which, found = which[order], found[order]
        new = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
        values[i:j].reshape(-1)[which[new]] = np.minimum.reduceat(found, new)
    some = (values != _NONE).any(axis=1)
    # bits of the value and the bin, as a value that fills many bins would agree by chance in all of them at once
    return (mix(_densify(values) + _OF_BIN) & U64((1 << BITS) - 1)).astype(np.uint8), some


def packed(code: np.ndarray, some: np.ndarray) -> list[str]:
    """Hexadecimal fingerprints; the empty string for a text without words."""
    pairs = (code[:, ::2] << 4) | code[:, 1::2]
    return [pairs[i].tobytes().hex() if some[i] else "" for i in range(len(code))]


def likeness(a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of shingle sets, 0 to 1; two empty ones are alike."""
    chance = 2.0**-BITS
    share = (a == b).mean(axis=1)
    value = np.clip((share - chance) / (1 - chance), 0.0, 1.0)
    return np.where(a_some & b_some, value, np.where(a_some | b_some, 0.0, 1.0))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` for every row; equal texts have equal fingerprints.

    Null and blank texts have the empty fingerprint; very long ones are read whole.
    Texts of 1 to 4 words have one shingle, the whole sequence.  Repeated rows give repeated rows, an empty
    table an empty result; other columns are ignored.
    """

    def task(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed(*codes(batch.column(1))), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, "doc_id long, fingerprint string")


def _follow(batches):
    """Rows in order of part, guests last; each with the row after it.  Guests only end a part."""
    part, text, code, some, key = None, None, None, None, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        parts = batch.column(0).to_pylist()
        guests = batch.column(1).to_pylist()
        texts = [t or "" for t in batch.column(3).to_pylist()]
        own, own_some = codes(batch.column(3))
        ids = batch.column(2).to_pylist()
        if text is not None:
            parts, guests, ids, texts = [part, *parts], [False, *guests], [key, *ids], [text, *texts]
            own, own_some = np.vstack([code[None], own]), np.append(some, own_some)
        yield from _paired(parts, guests, ids, texts, own, own_some, last=False)
        part, text, code, some, key = (parts[-1], texts[-1], own[-1], own_some[-1], ids[-1]) if not guests[-1] else (None,) * 5
    if text is not None:
        yield from _paired([part], [False], [key], [text], code[None], np.array([some]), last=True)


def _paired(parts, guests, ids, texts, own, own_some, last: bool):
    n = len(parts)
    at = [r for r in range(n if last else n - 1) if not guests[r]]
    if not at:
        return
    # without a row after it in its part, the document is alone in the table and follows itself
    after = [r + 1 if r + 1 < n and parts[r + 1] == parts[r] else r for r in at]
    edited = [texts[r][: len(texts[r]) - len(texts[r]) // 4] + texts[s][: len(texts[r]) // 4] for r, s in zip(at, after, strict=True)]
    column = pa.array(edited, pa.string())
    code, some = codes(column)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([ids[r] for r in at], pa.int64()),
            pa.array([len(texts[r]) for r in at], pa.int64()),
            column,
            pa.array(packed(own[at], own_some[at]), pa.string()),
            pa.array(packed(code, some), pa.string()),
            pa.array(likeness(own[at], own_some[at], code, some)),
            pa.array(likeness(own[at], own_some[at], own[after], own_some[after])),
        ],
        ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _rank(ids: np.ndarray, tags: np.ndarray, cut_ids: np.ndarray, cut_tags: np.ndarray) -> np.ndarray:
    """How many of the sorted cuts (id, tag) each row's (id, tag) has reached."""
    low, high = np.searchsorted(cut_ids, ids, "left"), np.searchsorted(cut_ids, ids, "right")
    out = low.copy()
    for at in np.unique(low[high > low]):
        mine = np.flatnonzero((low == at) & (high > low))
        out[mine] = at + np.searchsorted(cut_tags[at : high[mine[0]]], tags[mine], "right")
    return out.astype(np.int32)


def fingerprints_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    The next document is the one after it by (doc_id, text hash), the first one after
    the last; a null id counts as the least.  In the edited text, the last quarter of
    the code points is replaced by as many of the next document's first.

    The rows are dealt into ranges of (doc_id, text hash), one partition each, cut at
    the keys of a bounded sample, and read in order; each range is ended by a copy of
    the row that follows it, so no task needs more than one batch, and rows that
    repeat an id are split like others.  A document alone in the table is its own
    next one.  Null texts are empty; repeated rows follow each other; an empty table
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("tag"), "doc_id", "text")
    count = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a sample of some 100 keys a range
    total = rows.count()
    share = min(1.0, 100 * count / total) if total else 0.0
    sample = sorted(map(tuple, rows.select("key", "tag").filter(F.pmod(F.xxhash64("key", "tag"), F.lit(1 << 30)) < int(share * (1 << 30))).collect()))
    cuts = sorted({sample[i * len(sample) // count] for i in range(1, count)}) if sample else []
    cut_ids, cut_tags = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)

    def part_of(batch) -> np.ndarray:
        return _rank(batch.column(0).to_numpy(), batch.column(1).to_numpy(), cut_ids, cut_tags)

    def numbered(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(part_of(batch)), batch.column(0), batch.column(1)], ["part", "key", "tag"])

    # one line a range
    heads = rows.select("key", "tag").mapInArrow(numbered, "part int, key long, tag long").groupBy("part").agg(F.min(F.struct("key", "tag")).alias("head")).orderBy("part").collect()
    # each range's first rows also go, as guests, to the range before it
    guests = {b["part"]: heads[i - 1]["part"] for i, b in enumerate(heads)}
    firsts = {b["part"]: tuple(b["head"]) for b in heads}

    def deal(batches):
        for batch in batches:
            at = part_of(batch)
            keys = zip(at.tolist(), batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            lead = [r for r, (p, d, t) in enumerate(keys) if firsts[p] == (d, t)]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(len(at), bool)), *batch.columns], ["part", "guest", "key", "tag", "doc_id", "text"])
            if lead:
                take = pa.array(lead)
                yield pa.RecordBatch.from_arrays([pa.array([guests[int(at[r])] for r in lead], pa.int32()), pa.array(np.ones(len(lead), bool)), *(x.take(take) for x in batch.columns)], ["part", "guest", "key", "tag", "doc_id", "text"])

    dealt = rows.mapInArrow(deal, "part int, guest boolean, key long, tag long, doc_id long, text string")
    ordered = dealt.repartitionById(count, F.col("part")).sortWithinPartitions("part", "guest", "key", "tag", "text").select("part", "guest", "doc_id", "text")
    return ordered.mapInArrow(_follow, "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
