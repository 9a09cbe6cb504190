"""Collocations by SON partitioning.

The documents of a language are dealt to a fixed number of shards.  A phrase that
occurs ``support`` times occurs in some shard at least in proportion to the
shard's share of the language's words.  So each shard is mined completely at its
proportionally lowered support, what is frequent in any shard is a candidate, and
all candidates are counted over all documents.

A shard is as large as the corpus divided by their number and is mined by all
tasks: level by level, as a phrase can be frequent in a shard only if its pairs
are, and those only if their words are.  What is frequent on a level goes to the
tasks as a filter of bounded size (:mod:`siltstone.llm.filters`), which lets
everything through that is frequent.  Counts are shuffled by shard and phrase, after
each task has summed up its own; no group of rows is ever gathered.

Phrases are mined by 64-bit hashes and finally counted as texts, so equal hashes of
different phrases could only matter within a part of some 900,000 words.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.filters import key_filter
from siltstone.llm.spelling import spelled
from siltstone.llm.wordhash import LOWER, U64, Words, steps, utf8, window_hashes
from siltstone.llm.workspace import written

#: Bytes that end a piece: . , ; : ! ? and the controls 10 to 13; space and tab only end words.
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".,;:!?"]] = _ENDS[10:14] = True
_BLANKS = _ENDS.copy()
_BLANKS[[9, 32]] = True
#: Words of which a task sums up the phrases before it hands them on.
_PART = 900_000


class _Part:
    """The words of some rows: hashes, the piece and the key of the row of each."""

    def __init__(self, data, bounds, i: int, j: int, keys: np.ndarray):
        self.words = Words(data, bounds, i, j, blanks=_BLANKS, table=LOWER)
        self.hashes = self.words.hashes()
        n = len(self.hashes)
        self.row = np.repeat(np.arange(j - i), np.diff(self.words.first))
        ends = np.concatenate(([0], np.cumsum(_ENDS[self.words.data])))[self.words.starts]
        new = np.ones(n, dtype=bool)
        new[1:] = (ends[1:] != ends[:-1]) | (self.row[1:] != self.row[:-1])
        self.piece = np.cumsum(new)
        self.key = keys[i:j][self.row]

    def free(self) -> None:
        """Keep what spelling a phrase needs."""
        self.row = self.row.astype(np.int32)
        self.hashes = self.piece = self.key = None

    def whole(self, k: int) -> np.ndarray:
        """Where k words of one piece begin."""
        n = len(self.piece) - k + 1
        return self.piece[:n] == self.piece[k - 1 :] if n > 0 else np.zeros(0, dtype=bool)

    def grams(self, k: int) -> np.ndarray:
        """Hash of each k words and its row's key in one number."""
        out = window_hashes(self.hashes, k)
        return out ^ self.key[: len(out)]


def _parts(column: pa.Array, keys: np.ndarray):
    data, bounds = utf8(column)
    for i, j in steps(bounds):
        yield i, j, _Part(data, bounds, i, j, keys)


def _mine(batches, level: int, most: int, frequent):
    """lang, cell, text to how often each phrase of the level occurs in this task, by cell.

    Level 1 counts words, level 2 pairs of frequent words, level 3 all longer phrases of frequent pairs.
    """
    held, size = [], 0

    def flush():
        found, at, n = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_counts=True)
        cell = np.concatenate([h[1] for h in held])[at]
        columns = [pa.array(cell.view(np.int64)), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))]
        if level > 1:
            return pa.RecordBatch.from_arrays(columns, ["cell", "key", "n"])
        base = np.cumsum([0, *(len(h[3]) for h in held)])
        row = np.concatenate([h[2] + low for h, low in zip(held, base, strict=False)])[at]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([h[3] for h in held]).take(pa.array(row)), *columns], ["lang", "cell", "key", "n"])

    for batch in batches:
        langs, cells = batch.column(0), batch.column(1).to_numpy().view(U64)
        for i, j, part in _parts(batch.column(2), cells):
            if level == 1:
                chosen = [(np.arange(len(part.hashes)), part.grams(1))]
            else:
                keys = part.grams(level - 1)
                ok = frequent.value.holds(keys) & part.whole(level - 1)
                chosen = []
                for k in range(2, 3) if level == 2 else range(3, most + 1):
                    n, steps_ = len(part.hashes) - k + 1, k - level + 2
                    if n <= 0:
                        break
                    all_ok = reduce(np.logical_and, [ok[s : s + n] for s in range(steps_)])
                    at = np.flatnonzero(all_ok & part.whole(k))
                    chosen.append((at, part.grams(k)[at]))
            for at, keys in chosen:
                if len(at):
                    held.append((keys, part.key[at], part.row[at], langs.slice(i, j - i)))
                    size += len(at)
            if size >= _PART:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _count(batches, most: int, candidates):
    """lang, key of the language, text to ``lang, phrase, n`` of all candidates."""
    held, size = [], 0

    def flush():
        for k in range(1, most + 1):
            mine = [h for h in held if h[0] == k]
            if not mine:
                continue
            found, at, n = np.unique(np.concatenate([h[1] for h in mine]), return_index=True, return_counts=True)
            begin = np.cumsum([0, *(len(h[1]) for h in mine)])
            edge = np.searchsorted(at_sorted := np.sort(at), begin)
            order = np.argsort(at)
            for x, (_, _, where, part, langs) in enumerate(mine):
                some = at_sorted[edge[x] : edge[x + 1]] - begin[x]
                if len(some):
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(part.row[where[some]])), spelled(part.words, where[some], np.full(len(some), k)), pa.array(n[order[edge[x] : edge[x + 1]]])], ["lang", "phrase", "n"])

    for batch in batches:
        langs, keys = batch.column(0), batch.column(1).to_numpy().view(U64)
        for i, j, part in _parts(batch.column(2), keys):
            for k in range(1, most + 1):
                grams = part.grams(k)
                at = np.flatnonzero(candidates.value.holds(grams) & part.whole(k))
                if len(at):
                    held.append((k, grams[at], at.astype(np.int32), part, langs.slice(i, j - i)))
            size += len(part.hashes)
            part.free()
            if size >= _PART:
                yield from flush()
                held, size = [], 0
    yield from flush()


def phrase_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, max_words: int = 4, support: int = 30, shards: int = 4) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, a)`` of every phrase of 1 to ``max_words`` words that occurs ``support`` times, and ``(lang, n)`` of all words.

    ``shards`` below ``support`` keeps the lowered support above one occurrence, at any size of the corpus.
    """
    spark = docs.sparkSession
    text, lang = F.col(text_col).cast("string"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    shard = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text), F.lit(shards))
    rows = docs.select(lang.alias("lang"), F.xxhash64(lang, shard).alias("cell"), text.alias("text"))

    def level(k: int, frequent=None) -> DataFrame:
        keys = ["lang", "cell", "key"] if k == 1 else ["cell", "key"]
        schema = ("lang string, " if k == 1 else "") + "cell long, key long, n long"
        return rows.mapInArrow(lambda it: _mine(it, k, max_words, frequent), schema).groupBy(*keys).agg(F.sum("n").alias("n"))

    words = written(level(1), "phrase-words")
    sizes = written(words.groupBy("lang", "cell").agg(F.sum("n").alias("m")), "phrase-cells")
    totals = sizes.groupBy("lang").agg(F.sum("m").alias("n"))
    share = F.ceil(F.lit(support).cast("decimal(20,0)") * F.col("m") / F.col("n")).cast("long")
    cells = written(sizes.join(totals, "lang").select("lang", "cell", F.greatest(F.lit(1), share).alias("least")), "phrase-supports")
    mined = [written(words.drop("lang").join(cells, "cell").filter("n >= least").select("lang", "cell", "key"), "phrase-level")]
    for k in range(2, min(3, max_words) + 1):
        frequent = spark.sparkContext.broadcast(key_filter(mined[-1]))
        mined.append(written(level(k, frequent).join(cells, "cell").filter("n >= least").select("lang", "cell", "key"), "phrase-level"))
    of_lang = F.xxhash64("lang")
    union = reduce(DataFrame.union, mined).select(F.col("key").bitwiseXOR(F.col("cell")).bitwiseXOR(of_lang).alias("key")).distinct()
    candidates = spark.sparkContext.broadcast(key_filter(written(union, "phrase-candidates")))
    counted = rows.select("lang", of_lang.alias("key"), "text").mapInArrow(lambda it: _count(it, max_words, candidates), "lang string, phrase string, n long")
    frequent = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).filter(F.col("a") >= support)
    return written(frequent, "phrases"), totals


def collocations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, max_words: int = 4, support: int = 30, shards: int = 4, percent: int = 80, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best ``top`` phrases of 2 to ``max_words`` words.

    Texts are cut at ``.,;:!?`` and line ends, words at spaces and tabs; A-Z are
    lower-cased.  ``a`` counts a phrase's occurrences, ``l`` and ``r`` those of its
    parts at the cut of the lowest score floor(2000000 a / (l + r)), the earliest
    such cut.  A phrase inside a longer frequent one with ``percent`` of its
    occurrences is dropped.  Ranks go by score and ``a`` downward, then by phrase.

    Null texts are empty, null languages ``und``.  Very long texts are read whole,
    repeated rows and ids count each.  A language without frequent phrases has no
    rows, an empty table none at all; other columns are ignored.
    """
    found, totals = phrase_counts(docs, id_col, text_col, lang_col, max_words=max_words, support=support, shards=shards)
    word = F.split("phrase", " ")
    phrases = found.select("lang", "phrase", "a", word.alias("w"), F.size(word).alias("k")).filter("k > 1")
    cut = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cut = cut.select("lang", "phrase", "a", "at", F.array_join(F.expr("slice(w, 1, at)"), " ").alias("left"), F.array_join(F.expr("slice(w, at + 1, k)"), " ").alias("right"))
    part = lambda side, count: found.select("lang", F.col("phrase").alias(side), F.col("a").alias(count))
    scored = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.cast("long").alias("score"), "at", "l", "r")).alias("b"))
    inner = F.expr("flatten(transform(sequence(2, k - 1), s -> transform(sequence(1, k - s + 1), i -> array_join(slice(w, i, s), ' '))))")
    around = phrases.filter("k > 2").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    stay = F.expr(f"longer is null or 100 * cast(longer as decimal(20, 0)) < {percent} * cast(a as decimal(20, 0))")
    left = written(best.join(around, ["lang", "phrase"], "left").filter(stay).select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.score").alias("score")), "phrase-scores")
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within salted parts of a language, so that no task sorts all of a frequent one
    some = left.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(256))).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*by))).filter(F.col("_rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
