"""Substring dedup by seed and extend on winnowed anchors.

A window is ``window`` consecutive words of one document.  Winnowing picks in
every window its least ``anchor_words``-gram (the first of equals), so equal
windows always carry equal anchors at equal places.  Consecutive windows with one
anchor form a stretch.  Documents are joined on the anchors of their stretches:

* stretches of one anchor with the same words are one form, a repeat as a whole
  if it occurs twice;
* where an anchor has several forms, each is matched with the anchor's most
  frequent one: the match is extended word by word to the left and to the right of
  the anchor, and is a repeat if it is as long as a window;
* windows of the other forms that such a match leaves can only repeat among
  themselves: they are counted by anchor and words.

Repeats that touch merge to maximal ones.  An anchor costs one match a form and no
pairs of documents, so a passage that many documents hold costs one row a place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.wordhash import U64, Words, ranges, run_hashes, steps, utf8, window_hashes
from siltstone.llm.workspace import written

def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span, now = 1, values
    while 2 * span <= width:
        now = np.minimum(now[:-span], now[span:])
        span *= 2
    rest = width - span
    return np.minimum(now[: len(now) - rest], now[rest:]) if rest else now


def _stretches(words: np.ndarray, first: np.ndarray, window: int, k: int):
    """Row, first window start in the row, count of windows, place of the anchor, anchor and hash of each stretch."""
    n, width = np.diff(first), window - k + 1
    has = np.maximum(n - window + 1, 0)
    total = int(has.sum())
    if not total:
        return None
    row = np.repeat(np.arange(len(n)), has)
    begin = np.arange(total) - np.repeat(np.cumsum(has) - has, has) + first[row]
    grams = window_hashes(words, k)
    bits = U64(max(1, int(len(grams)).bit_length()))
    least = _sliding_min((grams >> bits << bits) | np.arange(len(grams), dtype=U64), width)
    pick = (least[begin] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    new = np.ones(total, dtype=bool)
    new[1:] = (pick[1:] != pick[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, total))
    start = begin[at]
    whole = run_hashes(words, start, start + count + window - 1)
    return row[at], start - first[row[at]], count, pick[at] - start, grams[pick[at]], whole


def _lay_out(batches, window: int, k: int):
    """doc_id, tag, text to one row a stretch."""
    for batch in batches:
        data, bounds = utf8(batch.column(2))
        for i, j in steps(bounds):
            words = Words(data, bounds, i, j)
            found = _stretches(words.hashes(), words.first, window, k)
            if found is None:
                continue
            row, start, count, seed, anchor, whole = found
            rows = pa.array(row + i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(seed.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64))],
                ["doc_id", "tag", "start", "count", "seed", "anchor", "whole"],
            )


def _word_hashes(batches, window: int):
    """doc_id, tag, text, forms to one row a form with the hashes of its words."""
    names = ("anchor", "whole", "weight", "start", "count", "seed")
    for batch in batches:
        data, bounds = utf8(batch.column(2))
        lists = batch.column(3)
        edge = lists.offsets.to_numpy().astype(np.int64)
        forms = {c: lists.values.field(c) for c in names}
        for i, j in steps(bounds):
            words = Words(data, bounds, i, j)
            own = words.hashes()
            take = np.arange(edge[i], edge[j])
            row = np.repeat(np.arange(j - i), np.diff(edge[i : j + 1]))
            size = forms["count"].to_numpy()[take].astype(np.int64) + window - 1
            flat = own[ranges(forms["start"].to_numpy()[take] + words.first[row], size)]
            packed = pa.Array.from_buffers(pa.binary(), len(take), [None, pa.py_buffer((np.concatenate(([0], np.cumsum(size))) * 8).astype(np.int32)), pa.py_buffer(flat)])
            rows = pa.array(row + i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *(forms[c].take(pa.array(take)) for c in names), packed], ["doc_id", "tag", *names, "words"])


def _hash_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of binary rows, end to end, and the bounds of the rows."""
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(U64), (at - at[0]) // 8


def _agree(mine, theirs, first: np.ndarray, second: np.ndarray, step: int, reach: int) -> np.ndarray:
    """How many neighbouring words agree from two places on, forward or backward, up to ``reach``."""
    (a, a_at), (b, b_at) = mine, theirs
    x, y = (at[:, None] + step * np.arange(reach) for at in (first, second))
    inside = (x >= a_at[:-1, None]) & (x < a_at[1:, None]) & (y >= b_at[:-1, None]) & (y < b_at[1:, None])
    same = inside & (a[np.clip(x, 0, len(a) - 1)] == b[np.clip(y, 0, len(b) - 1)])
    return np.logical_and.accumulate(same, axis=1).sum(axis=1)


def _extend(batches, window: int, k: int):
    """Forms beside their anchor's chief one to matches of both, without a hash, and the windows that are left, with one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
        mine, theirs = _hash_rows(column["words"]), _hash_rows(column["c_words"])
        seed, c_seed, count = (column[c].to_numpy().astype(np.int64) for c in ("seed", "c_seed", "count"))
        at, c_at = mine[1][:-1] + seed, theirs[1][:-1] + c_seed
        left = _agree(mine, theirs, at - 1, c_at - 1, -1, window - k)
        right = _agree(mine, theirs, at + k, c_at + k, 1, window - k)
        length = left + k + right
        hit = np.flatnonzero(length >= window)

        def rows(take, start, words, hashes, names=("doc_id", "tag", "start")):
            take_ = pa.array(take)
            begin = column[names[2]].to_numpy()[take] + start
            return pa.RecordBatch.from_arrays([column[names[0]].take(take_), column[names[1]].take(take_), pa.array(begin.astype(np.int32)), pa.array(words.astype(np.int32)), column["anchor"].take(take_), column["weight"].take(take_), hashes], ["doc_id", "tag", "start", "words", "anchor", "weight", "hash"])

        none = pa.nulls(len(hit), pa.int64())
        yield rows(hit, (seed - left)[hit], length[hit], none)
        yield rows(hit, (c_seed - left)[hit], length[hit], none, ("c_doc_id", "c_tag", "c_start"))
        crowd = np.flatnonzero(column["forms"].to_numpy() > 2)
        row = np.repeat(crowd, count[crowd])
        offset = ranges(np.zeros(len(crowd), np.int64), count[crowd])
        low = seed - left
        met = (length[row] >= window) & (offset >= low[row]) & (offset + window <= (low + length)[row])
        row, offset = row[~met], offset[~met]
        hashes = window_hashes(mine[0], window)[mine[1][row] + offset] if len(row) else np.zeros(0, U64)
        yield rows(row, offset, np.full(len(row), window), pa.array(hashes.view(np.int64)))


def _cut(batches):
    """doc_id, text, spans to doc_id, n_words, n_removed, repeats and kept_text."""
    for batch in batches:
        texts, spans = batch.column(1), batch.column(2).to_pylist()
        data, bounds = utf8(texts)
        n_words, n_removed, kept, repeats = [], [], [], []
        for i, j in steps(bounds):
            words = Words(data, bounds, i, j)
            raw = words.data.tobytes()
            for r in range(i, j):
                a, b = words.first[r - i], words.first[r - i + 1]
                n = int(b - a)
                gone = np.zeros(n + 1, dtype=np.int64)
                for s in spans[r] or ():
                    gone[s["start"]] += 1
                    gone[min(n, s["start"] + s["words"])] -= 1
                gone = np.cumsum(gone[:n]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                repeats.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                stay = np.flatnonzero(~gone) + a
                kept.append(b" ".join([raw[s:e] for s, e in zip(words.starts[stay].tolist(), words.ends[stay].tolist(), strict=True)]).decode("utf-8", "replace"))
                n_words.append(n)
                n_removed.append(int(gone.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(repeats, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())],
            ["doc_id", "n_words", "n_removed", "repeats", "kept_text"],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 35, anchor_words: int = 8) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, repeats, kept_text``.

    Words are maximal runs of non-blank bytes, unchanged.  A word is removed if a
    window that covers it also starts anywhere else, in the same document or
    another; windows are judged on the input.  ``repeats`` are the maximal covered
    spans ``[start, end)`` in words, ``kept_text`` the other words joined by one
    space.

    Null, blank and short texts hold no window and lose nothing; very long ones are
    read whole.  Repeated rows are copies of each other, so their windows count as
    starting elsewhere.  Rows with a null id are treated like others.  An empty
    table gives an empty result; other columns are ignored.  Of equal anchors in a
    window the first counts, of equally frequent forms that of the greatest hash.
    Words and windows are compared by 64-bit hashes, windows within one anchor.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("tag"), F.col(text_col).cast("string").alias("text"))
    places = written(rows.mapInArrow(lambda it: _lay_out(it, window, anchor_words), "doc_id long, tag long, start int, count int, seed int, anchor long, whole long"), "stretches")
    # written, so that the join has an exchange of its own in which Spark can split a frequent anchor
    shared = written(places.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("whole") == F.max("whole")).alias("alike")).filter("n > 1").select("anchor", "alike"), "anchors")
    live = written(places.join(shared, "anchor"), "shared")
    forms = written(
        live.filter("not alike").groupBy("anchor", "whole").agg(F.count("*").alias("weight"), F.min(F.struct("doc_id", "tag", "start", "count", "seed")).alias("at")),
        "forms",
    )
    wholly = live.filter("alike").select("doc_id", "tag", "start", "count").union(
        live.filter("not alike").join(forms.filter("weight > 1").select("anchor", "whole"), ["anchor", "whole"]).select("doc_id", "tag", "start", "count")
    ).select("doc_id", "tag", "start", (F.col("count") + (window - 1)).alias("words"))

    chief = forms.groupBy("anchor").agg(F.max(F.struct("weight", "whole"))["whole"].alias("chief"), F.count("*").alias("forms"))
    places_of = forms.groupBy(F.col("at.doc_id").alias("d"), F.col("at.tag").alias("t")).agg(F.collect_list(F.struct("anchor", "whole", "weight", F.col("at.start").alias("start"), F.col("at.count").alias("count"), F.col("at.seed").alias("seed"))).alias("forms"))
    # identical rows hold the same forms, so one of them is enough
    once = rows.join(places_of, rows["doc_id"].eqNullSafe(F.col("d")) & (rows["tag"] == F.col("t"))).select("doc_id", "tag", "text", "forms")
    place = "doc_id long, tag long, anchor long, whole long, weight long, start int, count int, seed int, words binary"
    hashed = written(once.mapInArrow(lambda it: _word_hashes(it, window), place).dropDuplicates(["anchor", "whole"]), "words")
    chiefs = hashed.join(chief, ["anchor"]).filter("whole = chief").select("anchor", "chief", "forms", *[F.col(c).alias(f"c_{c}") for c in ("doc_id", "tag", "start", "seed", "words")])
    beside = hashed.join(chiefs, "anchor").filter("whole <> chief")
    extended = written(beside.mapInArrow(lambda it: _extend(it, window, anchor_words), "doc_id long, tag long, start int, words int, anchor long, weight long, hash long"), "extended")
    matched = extended.filter("hash is null").select("doc_id", "tag", "start", "words").distinct()
    left = extended.filter("hash is not null")
    twice = left.groupBy("anchor", "hash").agg(F.sum("weight").alias("n")).filter("n > 1").select("anchor", "hash")
    partly = matched.union(left.filter("weight = 1").join(twice, ["anchor", "hash"]).select("doc_id", "tag", "start", "words"))

    spans = wholly.union(partly).groupBy(F.col("doc_id").alias("d"), F.col("tag").alias("t")).agg(F.collect_list(F.struct("start", "words")).alias("spans"))
    joined = rows.join(spans, rows["doc_id"].eqNullSafe(F.col("d")) & (rows["tag"] == F.col("t")), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, repeats array<struct<start:int,end:int>>, kept_text string")
