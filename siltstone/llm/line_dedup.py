"""Line dedup by pairwise alignment.

A run is a piece of consecutive lines that holds the least length of a block: from
each line on, and up to each line, the shortest one.  A long line is a run of its
own; short and frequent lines make rarer runs together.  Every document is paired
with the first holder of each of its runs, so a run that many documents hold costs
one pair each, and no run is too frequent to be looked at.

A pair is aligned by patience diff on the line hashes, and blocks of aligned lines
are deleted from the later document.  Where a shared run is left out, since it has
moved across other lines or its lines repeat, what is left is aligned again
(:func:`aligned`).  So exactly those lines go that lie in a block which any earlier
document holds too, and all of them by an alignment.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.wordhash import U64, run_hashes
from siltstone.llm.workspace import written


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) with a[i] == b[j], ascending in both.

    Common prefixes and suffixes align first; between them the longest increasing
    run of elements that occur once on either side anchors the rest.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        al, ah, bl, bh = todo.pop()
        while al < ah and bl < bh and a[al] == b[bl]:
            out.append((al, bl))
            al, bl = al + 1, bl + 1
        while al < ah and bl < bh and a[ah - 1] == b[bh - 1]:
            ah, bh = ah - 1, bh - 1
            out.append((ah, bh))
        if al >= ah or bl >= bh:
            continue
        once: dict[int, int] = {}
        for j in range(bl, bh):
            once[b[j]] = -1 if b[j] in once else j
        mine: dict[int, int] = {}
        for i in range(al, ah):
            mine[a[i]] = -1 if a[i] in mine else i
        pairs = [(i, once[x]) for x, i in mine.items() if i >= 0 and once.get(x, -1) >= 0]
        if not pairs:
            continue
        pairs.sort()
        # longest increasing run of the b positions
        tails: list[int] = []
        at: list[int] = []
        back = [-1] * len(pairs)
        for p, (_, j) in enumerate(pairs):
            k = bisect_left(tails, j)
            if k == len(tails):
                tails.append(j)
                at.append(p)
            else:
                tails[k], at[k] = j, p
            back[p] = at[k - 1] if k else -1
        run, p = [], at[-1]
        while p >= 0:
            run.append(pairs[p])
            p = back[p]
        run.reverse()
        i0, j0 = al, bl
        for i, j in [*run, (ah, bh)]:
            todo.append((i0, i, j0, j))
            if i < ah:
                out.append((i, j))
            i0, j0 = i + 1, j + 1
    return sorted(out)


def blocks(pairs: list[tuple[int, int]], sizes: list[int], least: int) -> list[int]:
    """Lines of the first side in runs of aligned neighbours that hold ``least`` characters or more."""
    out: list[int] = []
    run: list[int] = []
    before = (-2, -2)
    for i, j in [*pairs, (-9, -9)]:
        if (i, j) != (before[0] + 1, before[1] + 1):
            if sum(sizes[x] for x in run) >= least:
                out += run
            run = []
        run.append(i)
        before = (i, j)
    return out


def aligned(a: np.ndarray, b: np.ndarray, size: list[int], runs: list[tuple[int, int]], least: int) -> tuple[set[int], set[int]]:
    """Lines of a in blocks that the two texts' alignment finds, and those in blocks that only a further one does.

    One alignment keeps the order of both texts, so it leaves out a shared run that has
    moved across other lines or whose lines repeat.  As long as such a run is left,
    what remains of a is aligned with b again; a run of lines that repeat, which has
    no anchor among them, is at last aligned by itself, with the place where b holds it.
    """

    def found(mine: np.ndarray, theirs: np.ndarray) -> set[int]:
        pairs = patience(a[mine].tolist(), b[theirs].tolist())
        return set(blocks([(int(mine[i]), int(theirs[j])) for i, j in pairs], size, least))

    # lines that the other document lacks align with nothing
    ours, theirs = np.flatnonzero(np.isin(a, b)), np.flatnonzero(np.isin(b, a))
    first = found(ours, theirs)
    again: set[int] = set()
    left = [r for r in runs if not first.issuperset(range(*r))]
    while left:
        new = found(np.array([i for i in ours.tolist() if i not in first and i not in again], dtype=np.int64), theirs) - again
        again |= new
        left = [r for r in left if not all(i in first or i in again for i in range(*r))]
        if not new:
            break
    if left:
        at: dict[int, list[int]] = {}
        for j, x in enumerate(b.tolist()):
            at.setdefault(x, []).append(j)
        for low, high in left:
            for j in at.get(int(a[low]), ()):
                if np.array_equal(a[low:high], b[j : j + high - low]):
                    again |= found(np.arange(low, high), np.arange(j, j + high - low))
                    break
    return first, again - first


def _align(batches, least: int):
    """One row a pair to the later document's deleted lines: those of its alignment, those of further ones."""
    for batch in batches:
        out, more = [], []
        for r in range(batch.num_rows):
            a, size, b = (batch.column(c)[r].values.to_numpy() for c in (2, 3, 5))
            runs = batch.column(4)[r].values
            first, again = aligned(a, b, size.tolist(), list(zip(runs.field("low").to_pylist(), runs.field("high").to_pylist(), strict=True)), least)
            out.append(sorted(first))
            more.append(sorted(again))
        lists = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, lists), pa.array(more, lists)], ["d", "t", "gone", "again"])


def _runs(batches, least: int):
    """d, t, line hashes and sizes to one row a run: d, t, its hash, first line and line after the last."""
    for batch in batches:
        count = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(count)
        start = end - count
        lines = batch.column(2).flatten().to_numpy(zero_copy_only=False).view(U64)
        upto = np.concatenate(([0], np.cumsum(batch.column(3).flatten().to_numpy(zero_copy_only=False), dtype=np.int64)))
        doc, at = np.repeat(np.arange(len(count)), count), np.arange(len(lines))
        high = np.searchsorted(upto, upto[at] + least)
        low = np.searchsorted(upto, upto[at + 1] - least, "right") - 1
        on, back = high <= end[doc], low >= start[doc]
        span = np.unique(np.concatenate((at[on], low[back])) * (len(lines) + 1) + np.concatenate((high[on], at[back] + 1)))
        low, high = span // (len(lines) + 1), span % (len(lines) + 1)
        own = doc[low] if len(low) else low
        take, shift = pa.array(own), start[own]
        columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(run_hashes(lines, low, high).view(np.int64)), pa.array((low - shift).astype(np.int32)), pa.array((high - shift).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["d", "t", "run", "low", "high"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_chars: int = 40) -> DataFrame:
    """``docs`` with a cleaned text, and ``n_lines``, ``n_removed``, ``removed_lines``, ``n_moved``.

    Lines end at a line feed; a line's surrounding blanks don't count in
    comparisons.  Of each pair, the document with the greater (doc_id, text hash)
    is the later one.  A line is deleted if it lies in a block of consecutive lines
    that an earlier document holds too and that has ``least_chars`` characters or
    more in total, so empty lines go only with their neighbours.  Blocks are found
    on the input; what repeats within one document only stays.  ``n_moved`` counts the
    deleted lines that no pair's first alignment holds, as they have moved or repeat.

    Null texts stay null with 0 lines; empty ones have one empty line; long ones are
    read whole.  Rows that repeat an id and a text are one document and get the same
    result.  A null id comes before all others.  An empty table gives an empty
    result; other columns stay, whatever their names, and columns named like the
    results are replaced.
    """
    base = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed_lines", "n_moved")]
    text = F.col("row").getField(text_col).cast("string")
    me = docs.select(F.struct(*[F.col(f"`{c}`") for c in base]).alias("row"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("t"))
    lines = F.split(text, "\n", -1)
    trimmed = me.filter(text.isNotNull()).select("d", "t", F.transform(lines, lambda x: F.trim(x)).alias("lines"))
    hashed = trimmed.select("d", "t", F.transform("lines", lambda x: F.when(x == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x))).alias("hashes"), F.transform("lines", lambda x: F.length(x)).alias("sizes"))
    listed = written(hashed, "lines")
    seeds = listed.mapInArrow(lambda it: _runs(it, max(1, least_chars)), "d long, t long, run long, low int, high int")
    # written, so that the join has an exchange of its own in which Spark can split a frequent run
    holders = written(seeds.groupBy("run").agg(F.min(F.struct("d", "t")).alias("first"), F.max(F.struct("d", "t")).alias("last")).filter("first <> last").select("run", "first"), "holders")
    later = seeds.join(holders, "run").filter(F.struct("d", "t") > F.col("first"))
    pairs = written(later.groupBy("d", "t", F.col("first.d").alias("early_d"), F.col("first.t").alias("early_t")).agg(F.collect_set(F.struct("low", "high")).alias("runs")), "pairs")
    # only documents with a partner are needed from here on
    partners = pairs.select("d", "t").union(pairs.select("early_d", "early_t")).distinct()
    arrays = written(listed.join(partners, ["d", "t"], "left_semi").dropDuplicates(["d", "t"]), "arrays")
    both = pairs.join(arrays, ["d", "t"]).join(arrays.select(F.col("d").alias("early_d"), F.col("t").alias("early_t"), F.col("hashes").alias("theirs")), ["early_d", "early_t"])
    found = both.select("d", "t", "hashes", "sizes", "runs", "theirs").mapInArrow(lambda it: _align(it, least_chars), "d long, t long, gone array<int>, again array<int>")
    marked = lambda c, again: F.transform(c, lambda x: F.struct(x.alias("line"), F.lit(again).alias("again")))
    lost = found.select("d", "t", F.explode(F.concat(marked("gone", False), marked("again", True))).alias("x")).groupBy("d", "t", "x.line").agg(F.min("x.again").alias("again"))
    gone = lost.groupBy("d", "t").agg(F.sort_array(F.collect_list("line")).alias("removed"), F.count_if("again").alias("moved"))
    met = me.join(gone, ["d", "t"], "left")
    cut = F.when(F.col("removed").isNull(), text).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("removed", i)), "\n"))
    return met.select(
        *[cut.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in base],
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed_lines"),
        F.coalesce("moved", F.lit(0)).cast("long").alias("n_moved"),
    )


def cleaned_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with cleaned texts, without those of which only blanks are left after a deletion."""
    done = line_dedup(docs, id_col, text_col, **options)
    return done.filter(~((F.col("n_removed") > 0) & (F.trim(F.col(text_col)) == ""))).select(*[F.col(f"`{c}`") for c in docs.columns])
