"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are all runs of ``window`` words; an item of fewer words is one
window.  A window is a set of word shingles with their places.  The documents'
counts of the benchmark's shingles order them by rarity.  As a window has to be
contained as a whole, its necessary prefix is its single rarest shingle, and a
window with a shingle that no document holds is done with.  Documents give the
places of prefix shingles, with the words about them, and meet the windows on the
shingle; bounds on place and length leave the windows that fit into the document,
and what is left is compared word by word.

Benchmark shingles go to the tasks as filters of bounded size.  A shingle place of
a document meets only the windows whose rarest shingle it is, and a document with
many items meets their ids once for every distinct combination of items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.filters import key_filter
from siltstone.llm.spelling import spelled
from siltstone.llm.wordhash import LOWER, NOT_ALNUM, U64, Words, mix, ranges, seeds, steps, utf8, window_hashes
from siltstone.llm.workspace import written


#: a number for each shingle length
_LENGTHS = seeds(64, 0xC0DE)


def _found(column: pa.Array):
    data, bounds = utf8(column)
    for i, j in steps(bounds):
        words = Words(data, bounds, i, j, blanks=NOT_ALNUM, table=LOWER)
        yield i, j, words, words.hashes(), np.diff(words.first)


def _keys(hashes: np.ndarray, k: int) -> np.ndarray:
    """A key of each k neighbouring words; runs of different lengths have different keys."""
    return mix(window_hashes(hashes, k) + _LENGTHS[k - 1])


def _windows(batches, window: int, shingle: int):
    """item_id, text to the windows of each item with their shingles' keys."""
    for batch in batches:
        for i, j, words, hashes, n in _found(batch.column(1)):
            count = np.where(n >= window, n - window + 1, (n > 0).astype(np.int64))
            size = np.repeat(np.minimum(n, window), count)
            begin = ranges(words.first[:-1], count)
            row = np.repeat(np.arange(j - i), count)
            if not len(row):
                continue
            part = np.minimum(size, shingle)
            many = size - part + 1
            keys = np.zeros(int(many.sum()), dtype=U64)
            which, at = np.repeat(np.arange(len(row)), many), ranges(begin, many)
            for k in range(1, shingle + 1):
                mine = part[which] == k
                if mine.any():
                    keys[mine] = _keys(hashes, k)[at[mine]]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32)), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + i)), spelled(words, begin, size), pa.array(size.astype(np.int32)), lists], ["item_id", "words", "size", "keys"])


def _tally(batches, sizes: tuple[int, ...], wanted):
    """text to how often each wanted shingle occurs in this task, batch by batch."""
    for batch in batches:
        for _, _, words, hashes, n in _found(batch.column(0)):
            row = np.repeat(np.arange(len(n)), n)
            got = []
            for k in sizes:
                if len(hashes) >= k:
                    keys = _keys(hashes, k)
                    got.append(keys[wanted.value.holds(keys) & (row[: len(keys)] == row[k - 1 :])])
            key, count = np.unique(np.concatenate(got) if got else np.zeros(0, U64), return_counts=True)
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count.astype(np.int64))], ["key", "n"])


_PLACE = "doc_id long, tag long, n_words long, key long, at long, low long, words string"


def _places(batches, sizes: tuple[int, ...], window: int, shingle: int, wanted):
    """doc_id, tag, text to one row a document and one row a place of a prefix shingle, with the words about it.

    A shingle that is shorter than ``shingle`` words is a whole window, so only its own words are needed.
    """
    names = [x.split()[0] for x in _PLACE.split(", ")]
    for batch in batches:
        for i, j, words, hashes, n in _found(batch.column(2)):
            docs, none = np.arange(i, j), pa.nulls(j - i, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n), none, none, none, pa.nulls(j - i, pa.string())], names)
            row = np.repeat(np.arange(j - i), n)
            for k in sizes:
                if len(hashes) < k:
                    continue
                keys = _keys(hashes, k)
                at = np.flatnonzero(wanted.value.holds(keys) & (row[: len(keys)] == row[k - 1 :]))
                if not len(at):
                    continue
                around = window - k if k == shingle else 0
                low = np.maximum(at - around, words.first[row[at]])
                high = np.minimum(at + k + around, words.first[row[at] + 1])
                rows, first = pa.array(docs[row[at]]), words.first[row[at]]
                columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.nulls(len(at), pa.int64()), pa.array(keys[at].view(np.int64)), pa.array(at - first), pa.array(low - first), spelled(words, low, high - low)]
                yield pa.RecordBatch.from_arrays(columns, names)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *, window: int = 10, shingle_words: int = 3) -> DataFrame:
    """``doc_id, n_words, n_hit, items, contaminated``, one row a document.

    Words are lower-cased (A-Z) runs of letters, digits and bytes above 127.  A
    document's word is hit if it lies in an occurrence of an item's window; ``items``
    are the ids, as texts in their order, of items with an occurring window.

    Null and blank texts hold nothing, of documents as of items; very long ones are
    read whole.  Repeated rows get a row each; repeated items count once, and an item
    with a null id hits words but isn't named.  An empty benchmark hits nothing, an
    empty table of documents gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    cut = written(items.mapInArrow(lambda it: _windows(it, window, shingle_words), "item_id string, words string, size int, keys array<long>"), "windows")
    of_items = cut.groupBy("words", "size").agg(F.min("keys").alias("keys"), F.array_sort(F.collect_set("item_id")).alias("ids"))
    windows = written(of_items.withColumn("ids_key", F.xxhash64("ids")), "item-windows")

    key = F.explode("keys").alias("key")
    shingles = windows.select(key).distinct()
    sizes = tuple(sorted(r[0] for r in windows.select(F.least("size", F.lit(shingle_words))).distinct().collect()))  # shingle_words rows at most
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("tag"), F.col(text_col).cast("string").alias("text"))
    wanted = spark.sparkContext.broadcast(key_filter(shingles))
    tally = rows.select("text").mapInArrow(lambda it: _tally(it, sizes, wanted), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    placed = windows.select("words", "size", "ids_key", F.posexplode("keys").alias("offset", "key"))
    rarity = placed.join(written(tally, "rarity"), "key", "left").groupBy("words", "size", "ids_key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "key")).alias("p"))
    prefixes = written(rarity.filter("p.n > 0").select("words", "size", "ids_key", "p.offset", "p.key"), "prefixes")

    chosen = spark.sparkContext.broadcast(key_filter(prefixes.select("key").distinct()))
    found = written(rows.mapInArrow(lambda it: _places(it, sizes, window, shingle_words, chosen), _PLACE), "places")
    places = found.filter("key is not null").select("doc_id", "tag", "key", "at", "low", F.col("words").alias("near"))
    met = places.join(prefixes, "key").withColumn("start", F.col("at") - F.col("offset"))
    near = F.split("near", " ")
    fits = (F.col("start") >= F.col("low")) & (F.col("start") + F.col("size") <= F.col("low") + F.size(near))
    same = F.array_join(F.slice(near, (F.col("start") - F.col("low") + 1).cast("int"), F.col("size")), " ") == F.col("words")
    hits = written(met.filter(fits).filter(same).select("doc_id", "tag", "start", (F.col("start") + F.col("size")).alias("end"), "ids_key").distinct(), "hits")

    spans = hits.groupBy("doc_id", "tag", "start").agg(F.max("end").alias("end"))
    reached = F.max("end").over(Window.partitionBy("doc_id", "tag").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("reached", F.lit(0))))
    n_hit = spans.withColumn("reached", reached).groupBy("doc_id", "tag").agg(F.sum(new).alias("n_hit"))
    combos = written(hits.select("doc_id", "tag", "ids_key").distinct().groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set("ids_key")).alias("combo")), "combinations")
    ids = windows.select("ids_key", "ids").dropDuplicates(["ids_key"])
    named = combos.select("combo").distinct().select("combo", F.explode("combo").alias("ids_key")).join(ids, "ids_key").groupBy("combo").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    of_doc = n_hit.join(combos, n_hit["doc_id"].eqNullSafe(combos["doc_id"]) & (n_hit["tag"] == combos["tag"])).select(n_hit["doc_id"].alias("d"), n_hit["tag"].alias("t"), "n_hit", "combo").join(named, "combo").select("d", "t", "n_hit", "items")
    whole = found.filter("key is null").select("doc_id", "tag", "n_words")
    done = whole.join(of_doc, whole["doc_id"].eqNullSafe(F.col("d")) & (whole["tag"] == F.col("t")), "left")
    count = F.coalesce("n_hit", F.lit(0)).cast("long")
    return done.select("doc_id", "n_words", count.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (count > 0).alias("contaminated"))
