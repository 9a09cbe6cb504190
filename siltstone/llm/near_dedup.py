"""MinHash near-dedup by a chosen-path set similarity join.

Every document's shingle set is hashed once.  Documents with equal sets form a
class, and the join runs over classes.  A class enters the nodes of several
independent trees: at a node two minwise coordinates are chosen by a hash of the
path, and the class goes to the child named by its own minimum there.  A pair of
similarity s shares a child with probability 1 - (1 - s)^2, so its survival in a
tree settles near 1 - q, with q = (1 - s + s q)^2: 0.969 at s = 0.85.  As many
trees are grown as reach the wanted recall at the threshold, three for 0.9999
there; it is greater for pairs above it.

A node's members are first linked to one of them, a star, so a group of copies
costs as many comparisons as it has members.  A node whose members are then
connected is done.  In others, what lies outside the node's largest component is
compared exhaustively with all its members of other components, or, where that
is too much work, the node is branched on.  Pairs inside one component are never
compared again, which loses no component.  A bit sketch sorts candidates out
first, at 4.5 standard errors under the threshold; links are confirmed on the full
sets.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.components import components
from siltstone.llm.wordhash import LOWER, U64, Words, mix, seeds, shingles, steps, utf8
from siltstone.llm.workspace import written

#: Minwise coordinates for nodes below the first depths, in blocks of BLOCK that the depths take in turn.
DEEP, BLOCK = 60, 20
#: Chance that a pair at the threshold meets in some tree.
RECALL = 0.9999
_ROOTS = seeds(64, 13)
#: Bits of the sketch that candidates are compared by before their sets are.
WIDE = 512
_WIDE_XOR, _WIDE_TIMES = seeds(WIDE, 14), seeds(WIDE, 15) | U64(1)


def trees_for(similarity: float, recall: float = RECALL) -> int:
    """Independent trees that reach ``recall`` for a pair of that similarity, at any depth."""
    lost = 0.0
    for _ in range(200):
        lost = (1 - similarity * (1 - lost)) ** 2
    return 1 if lost <= 0 else max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def _row_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data, bounds = utf8(column)
    for i, j in steps(bounds):
        words = Words(data, bounds, i, j, table=LOWER)
        found, at = shingles(words.hashes(), words.first, k)
        for r in range(j - i):
            yield np.unique(found[at[r] : at[r + 1]])


def _digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def coordinates(trees: int, depth: int) -> int:
    """Minwise coordinates of a set: a pair for each node of each tree down to ``depth``, and those below."""
    return 2 * trees * ((1 << depth) - 1) + DEEP


@functools.cache
def _hashing(n: int) -> tuple[np.ndarray, np.ndarray]:
    return seeds(n, 11), seeds(n, 12) | U64(1)


def _sketch(items: np.ndarray, n: int) -> np.ndarray:
    xor, times = _hashing(n)
    out = np.empty(n, dtype=np.uint64)
    wide = max(1, (1 << 18) // max(1, len(items)))
    for c in range(0, n, wide):
        d = min(n, c + wide)
        out[c:d] = ((items ^ xor[c:d, None]) * times[c:d, None]).min(axis=1)
    return (out >> U64(32)).astype(np.uint32).view(np.int32)


def _branch(paths: np.ndarray, sketches: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(n,) paths, (n, coordinates) sketches and (n,) first coordinates to the (n, 2) paths of the chosen children."""
    rows = np.arange(len(paths))
    out = np.empty((len(paths), 2), dtype=U64)
    for b in (0, 1):
        value = sketches[rows, at + b].view(np.uint32).astype(U64)
        out[:, b] = mix(paths * U64(0x9E3779B97F4A7C15) + value * U64(0xC2B2AE3D27D4EB4F) + (at + b).astype(U64))
    return out


def _nodes(table: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """(n, coordinates) sketches to the (n, trees << depth) nodes; no two nodes of a set share a coordinate."""
    n = len(table)
    paths, which = np.tile(_ROOTS[:trees], n), np.repeat(np.arange(n), trees)
    for d in range(depth):
        at = 2 * (trees * ((1 << d) - 1) + np.tile(np.arange(trees << d), n))
        paths = _branch(paths, table[which], at).reshape(-1)
        which = np.repeat(which, 2)
    return paths.reshape(n, trees << depth)


def _describe(batches, k: int, trees: int, depth: int):
    """doc_id, tag, text to doc_id, tag, n_shingles, digest of the set, sketch and first nodes."""
    wide = coordinates(trees, depth)
    for batch in batches:
        sizes, digests, sketches = [], [], []
        for items in _row_sets(batch.column(2), k):
            sizes.append(len(items))
            digests.append(_digest(items))
            sketches.append(_sketch(items, wide) if len(items) else np.zeros(wide, np.int32))
        n = len(sizes)
        flat = np.concatenate(sketches).astype(np.int32) if n else np.zeros(0, np.int32)
        paths = _nodes(flat.reshape(n, wide), trees, depth).reshape(-1)
        width = trees << depth
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * wide), pa.array(flat)),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(paths.view(np.int64))),
            ],
            ["doc_id", "tag", "n", "cls", "sketch", "nodes"],
        )


def _lists(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, DEEP), np.int32)


def _children(batches, depth: int):
    """cls, n, node, sketch to cls, n and the two child nodes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        paths, sketches = batch.column(2).to_numpy().view(U64), _lists(batch.column(3))
        at = sketches.shape[1] - DEEP + (depth % (DEEP // BLOCK)) * BLOCK + 2 * (mix(paths + U64(depth + 1)) % U64(BLOCK // 2)).astype(np.int64)
        out = _branch(paths, sketches, at)
        twice = pa.array(np.repeat(np.arange(batch.num_rows), 2))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(twice), batch.column(1).take(twice), pa.array(out.reshape(-1).view(np.int64))], ["cls", "n", "node"])


def _bit_sketch(items: np.ndarray) -> bytes:
    """One bit of each of WIDE minwise values; bits of a pair agree with probability (1 + similarity) / 2."""
    out = np.empty(WIDE, dtype=np.uint8)
    step = max(1, (1 << 17) // max(1, len(items)))
    for c in range(0, WIDE, step):
        d = min(WIDE, c + step)
        out[c:d] = ((((items ^ _WIDE_XOR[c:d, None]) * _WIDE_TIMES[c:d, None]).min(axis=1) >> U64(40)) & U64(1)).astype(np.uint8)
    return np.packbits(out).tobytes()


def _words_of(column: list[bytes]) -> np.ndarray:
    """Binary values of equal length as rows of 64-bit words."""
    return np.frombuffer(b"".join(column), U64).reshape(len(column), -1) if column else np.zeros((0, 1), U64)


def _alike(batches, least: int):
    """Pairs with both bit sketches to the pairs that agree in at least ``least`` bits."""
    for batch in batches:
        a, b = _words_of(batch.column(2).to_pylist()), _words_of(batch.column(3).to_pylist())
        keep = pa.array(WIDE - np.bitwise_count(a ^ b).sum(axis=1) >= least)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])


def _whole_cells(batches, k: int = 0):
    """Batches in order of (node, i, j), cut so that no cell lies in two of them, each with its rows' sets.

    With ``k`` the last column is the text: it becomes sets of k-word shingles as it
    comes and is let go, so that no two batches' texts are ever held or put together.
    """
    held, sets = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        if k:
            sets.extend(_row_sets(batch.column(batch.num_columns - 1), k))
            batch = batch.select(batch.schema.names[:-1])
        rows = batch if held is None else pa.concat_batches([held, batch])
        key = np.stack([rows.column(c).to_numpy() for c in range(3)])
        new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        at = int(new[-1]) if len(new) else 0
        if at:
            yield rows.slice(0, at), sets[:at]
        held, sets = rows.slice(at), sets[at:]
    if held is not None:
        yield held, sets


def _candidates(rows: pa.RecordBatch, least: int, percent: int):
    """Yields, cell by cell, the pairs of a row of side 0 and one of side 1 that may be linked.

    The two lie in different components, are of like size, agree in their sketches
    and share no earlier node that is compared too.  Columns: node, i, j, path, side,
    cls, n, comp, bits, paths, and fit, the positions in paths of compared nodes.
    """
    if not rows.num_rows:
        return
    key = np.stack([rows.column(c).to_numpy() for c in range(3)])
    edge = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [rows.num_rows]))
    path, side, n = (rows.column(c).to_numpy() for c in (3, 4, 6))
    comp, bits, paths = (_words_of(rows.column(c).to_pylist()) for c in (7, 8, 9))
    fit = np.zeros(paths.shape, dtype=bool)
    fit[np.repeat(np.arange(len(fit)), [len(x) for x in rows.column(10)]), rows.column(10).flatten().to_numpy()] = True
    for low, high in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        own = side[low:high]
        left, right = np.flatnonzero(own == 0) + low, np.flatnonzero(own == 1) + low
        if not len(left) or not len(right):
            continue
        step = max(1, (1 << 16) // len(right))
        found_a, found_b = [], []
        for k in range(0, len(left), step):
            a = left[k : k + step]
            x, y = n[a][:, None], n[right]
            ok = (comp[a][:, None] != comp[right]).any(axis=2) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
            r, c = np.nonzero(ok)
            if not len(r):
                continue
            r, c = a[r], right[c]
            ok = WIDE - np.bitwise_count(bits[r] ^ bits[c]).sum(axis=1) >= least
            r, c = r[ok], c[ok]
            if path[low] > 0 and len(r):
                ok = ~((paths[r, : path[low]] == paths[c, : path[low]]) & fit[r, : path[low]]).any(axis=1)
                r, c = r[ok], c[ok]
            found_a.append(r)
            found_b.append(c)
        if found_a:
            yield np.concatenate(found_a), np.concatenate(found_b)


def _candidate_rows(batches, least: int, percent: int):
    """The rows of each cell that have a candidate in it."""
    for rows, _ in _whole_cells(batches):
        hit = np.zeros(rows.num_rows, dtype=bool)
        for a, b in _candidates(rows, least, percent):
            hit[a] = hit[b] = True
        yield rows.filter(pa.array(hit))


def _linked_rows(batches, least: int, percent: int, k: int):
    """Links of each cell, confirmed on the full sets: as many as join its components, no more."""
    for rows, sets in _whole_cells(batches, k):
        cls, comp = rows.column(5).to_pylist(), rows.column(7).to_pylist()
        u, v = [], []
        for left, right in _candidates(rows, least, percent):
            root: dict[bytes, bytes] = {}

            def find(x: bytes, root=root) -> bytes:
                while root.get(x, x) != x:
                    x = root[x]
                return x

            for a, b in zip(left.tolist(), right.tolist(), strict=True):
                x, y = find(comp[a]), find(comp[b])
                if x != y and _reaches(sets[a], sets[b], percent):
                    root[x] = y
                    u.append(max(cls[a], cls[b]))
                    v.append(min(cls[a], cls[b]))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])


def _reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _confirm(batches, k: int, percent: int):
    """Pairs with both texts to the pairs whose full sets reach the threshold."""
    for batch in batches:
        keep = [_reaches(a, b, percent) for a, b in zip(_row_sets(batch.column(2), k), _row_sets(batch.column(3), k), strict=True)]
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Words are maximal runs of non-blank bytes after lower-casing A-Z.  Documents
    are linked where ``100 * |A & B| >= percent * |A | B|`` on their sets of
    ``shingle_words``-word shingles, and a component is named by its least doc_id.

    Null or blank texts have an empty set and link with nothing; very long ones are
    read whole.  Repeated rows are separate rows of one class.  A component whose
    ids are all null, or a lone row with a null id, has a null component and is kept.
    An empty table gives an empty result; other columns are ignored.  ``options``
    are those of :func:`classes_of`.
    """
    classed = classes_of(docs, id_col, text_col, **options)
    named_by = classed.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    full = classed.filter("n > 0").join(named_by, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    blank = classed.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.union(blank).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle_words: int = 5, percent: int = 80, recall: float = RECALL, first_depth: int = 3, cell: int = 1024, cell_items: int = 1 << 22, work: int = 1 << 26, max_depth: int = 6) -> DataFrame:
    """One row per document: ``doc_id, tag, n, comp``: a hash of its text, the size of its set and its component's class.

    A node is compared exhaustively, in cells of some ``cell`` rows and ``cell_items``
    shingles (8 bytes each) a side, if that takes at most ``work`` comparisons or its depth is ``max_depth``; others are branched on.
    """
    trees = trees_for(percent / 100, recall)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = written(
        rows.select("doc_id", F.xxhash64("text"), "text").mapInArrow(lambda it: _describe(it, shingle_words, trees, first_depth), "doc_id long, tag long, n long, cls binary, sketch array<int>, nodes array<long>"),
        "sets",
    )
    # equal sets have equal sketches; one document of a class lends its text
    classes = written(
        described.filter("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"), F.first("nodes").alias("nodes")),
        "classes",
    )
    share = percent / 100
    agree = (1 + share) / 2
    least = int(WIDE * agree - 4.5 * (WIDE * agree * (1 - agree)) ** 0.5)

    def close(a: str, b: str):
        return F.least(a, b) * 100 >= F.greatest(a, b) * percent

    def populated(nodes: DataFrame) -> DataFrame:
        """Nodes with at least two classes, each row with the node's size and star centre."""
        # written, so that the join has an exchange of its own in which Spark can split a large node
        of = written(nodes.groupBy("node").agg(F.count("*").alias("size"), F.min(F.struct("cls", "n")).alias("centre")).filter("size > 1"), "populated")
        return written(nodes.join(of, "node"), "nodes")

    live = populated(classes.select("cls", "n", F.posexplode("nodes").alias("path", "node")))
    chosen = classes.join(live.select("cls").distinct(), "cls", "left_semi").select("cls", F.col("doc_id").alias("chosen_id"), "nodes")
    texts = written(_texts_of(rows, chosen, shingle_words), "texts")

    def side(name: str, *columns: str) -> DataFrame:
        return texts.select(F.col("cls").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    def stars(of: DataFrame) -> DataFrame:
        """Likely links of each row with its node's centre."""
        pairs = of.filter((F.col("cls") != F.col("centre.cls")) & close("n", "centre.n")).select(F.greatest("cls", "centre.cls").alias("u"), F.least("cls", "centre.cls").alias("v")).distinct()
        both = pairs.join(side("u", "bits"), "u").join(side("v", "bits"), "v")
        return both.select("u", "v", "bits_u", "bits_v").mapInArrow(lambda it: _alike(it, least), "u binary, v binary")

    def crossings(open_rows: DataFrame) -> DataFrame:
        """Links between components inside each node: what isn't in its largest component, against all.

        Both sides are cut into runs by rows and by size, so a task holds two runs.  A
        pair is looked at in the first of its common nodes that are compared.  Sketches are compared
        first; texts then go to the cells for the rows that have a candidate.
        """
        per = open_rows.groupBy("node", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("items"))
        main = per.groupBy("node").agg(F.max(F.struct("k", "comp", "items")).alias("m"), F.sum("items").alias("items")).select("node", F.col("m.comp").alias("main"), F.col("m.k").alias("held"), "items", (F.col("items") - F.col("m.items")).alias("few_items"))
        ranked = open_rows.join(main, "node").withColumn("minor", F.col("comp") != F.col("main"))
        runs = lambda n, items: F.ceil(F.greatest(n / cell, items / cell_items)).cast("int")
        spot = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "cls"), n).cast("int")
        few, all_ = runs(F.col("size") - F.col("held"), F.col("few_items")), runs(F.col("size"), F.col("items"))
        a = ranked.filter("minor").select("node", spot(0, few).alias("i"), F.explode(F.sequence(F.lit(0), all_ - 1)).alias("j"), "path", F.lit(0).alias("side"), "cls", "n", "comp")
        b = ranked.select("node", F.explode(F.sequence(F.lit(0), few - 1)).alias("i"), spot(1, all_).alias("j"), "path", F.lit(1).alias("side"), "cls", "n", "comp")
        fit = open_rows.groupBy("cls").agg(F.collect_set("path").alias("fit"))
        cells = a.union(b).join(texts.select("cls", "bits", "paths").join(fit, "cls"), "cls").select("node", "i", "j", "path", "side", "cls", "n", "comp", "bits", "paths", "fit")
        together = lambda rows: rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")
        hits = written(together(cells).mapInArrow(lambda it: _candidate_rows(it, least, percent), cells.schema), "candidates")
        with_text = hits.join(texts.select("cls", "text"), "cls").select(*hits.columns, "text")
        return written(together(with_text).mapInArrow(lambda it: _linked_rows(it, least, percent, shingle_words), "u binary, v binary"), "links")

    def confirmed(likely: DataFrame) -> DataFrame:
        """Candidates to links, on the full sets."""
        both = written(likely, "likely").join(side("u", "text"), "u").join(side("v", "text"), "v")
        return written(both.select("u", "v", "text_u", "text_v").mapInArrow(lambda it: _confirm(it, shingle_words, percent), "u binary, v binary"), "links")

    links = confirmed(stars(live))
    depth = first_depth
    while True:
        labels = components(links)
        named = live.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("node", "path", "cls", "n", "size", F.coalesce("component", "cls").alias("comp"))
        held = named.groupBy("node", "comp").agg(F.count("*").alias("k")).groupBy("node").agg(F.count("*").alias("parts"), (F.sum("k") - F.max("k")).alias("minors")).filter("parts > 1").select("node", "minors")
        open_rows = written(named.join(held, "node"), "open")
        if open_rows.isEmpty():
            break
        fits = F.lit(depth >= max_depth) | (F.col("minors") * F.col("size") <= work)
        links = links.union(crossings(open_rows.filter(fits)))
        below = open_rows.filter(~fits).join(classes.select("cls", "sketch"), "cls").select("cls", "n", "node", "sketch").mapInArrow(lambda it, d=depth: _children(it, d), "cls binary, n long, node long").withColumn("path", F.lit(0))
        live = populated(below)
        if live.isEmpty():
            labels = components(links)
            break
        links = links.union(confirmed(stars(live)))
        depth += 1
    return described.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("doc_id", "tag", "n", F.coalesce("component", "cls").alias("comp"))


def _texts_of(rows: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """cls, text, bit sketch and packed first nodes of each chosen class; texts that share an id are told apart by their sets."""

    def task(batches):
        for batch in batches:
            keep, bits = [], []
            for items, cls in zip(_row_sets(batch.column(1), k), batch.column(0).to_pylist(), strict=True):
                keep.append(_digest(items) == cls)
                if keep[-1]:
                    bits.append(_bit_sketch(items))
            keep = pa.array(keep, pa.bool_())
            own = batch.filter(keep)
            paths = [np.array(x, np.int64).tobytes() for x in own.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(bits, pa.binary()), pa.array(paths, pa.binary())], ["cls", "text", "bits", "paths"])

    near = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("chosen_id"))).select("cls", "text", "nodes")
    return near.mapInArrow(task, "cls binary, text string, bits binary, paths binary").dropDuplicates(["cls"])


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id, null ids last, then of the least text hash.

    Documents are told apart by id and text, so a document that shares the id of a
    copy stays; of rows that repeat both, one stays.  Null and blank texts all stay.
    """
    classed = classes_of(docs, id_col, text_col, **options).filter("n > 0")
    chief = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag"))
    kept = written(classed.groupBy("comp").agg(chief.alias("chief")).select("chief.doc_id", "chief.tag", F.lit(True).alias("kept")), "kept")
    known = classed.select("doc_id", "tag").distinct().alias("a").join(kept.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.tag") == F.col("b.tag")), "left").select("a.doc_id", "a.tag", F.coalesce("kept", F.lit(False)).alias("kept"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", F.col("row").getField(id_col).cast("long").alias("d"), F.xxhash64(F.col("row").getField(text_col).cast("string")).alias("t"))
    met = rows.join(known, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tag")), "left").filter("kept is null or kept")
    # rows that repeat a chief are one; blank texts, in no component, each are their own
    own = F.when(F.col("kept").isNull(), F.monotonically_increasing_id())
    return met.select("row", "d", "t", own.alias("own")).dropDuplicates(["d", "t", "own"]).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
