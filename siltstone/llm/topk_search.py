"""Exact top-k inner-product search with an M-tree of paged metric nodes.

Adding one component sqrt(M^2 - |x|^2) to every vector, M the greatest norm, turns
the greatest inner products into the least Euclidean distances, so that a metric
tree finds them.  Its upper nodes have routing objects, to whose nearest every
vector goes: a bounded set at the root, then, in nodes of more than
``subtree_rows`` vectors, objects of their own, level by level.  A node that is
small enough is a subtree, cut at two distant objects into leaf pages.  Subtrees and
pages are written once, each with its routing object, covering radius and distance
to its parent's object, and every entry with its distance to the page's.

A block of queries searches a part of the tree best-first: the node with the least
possible distance comes next, and nodes whose lower bound exceeds a query's k-th
best are skipped, pages by the stored parent distance before any distance is
computed and by their own distance then, and so are entries by their stored
distances.  Queries search their home subtree first; only where a root's ball can
still improve their result do they go on.  No bound is approximate: results are
exact.

Shuffle: a query goes to the roots it can't rule out, at most ``roots``.  Under a
root, blocks of queries meet parts of the tree of some ``4 * 2^20 / dimension`` rows a
side, so each vector that is sent takes part in as many products.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.wordhash import U64, mix, ranges
from siltstone.llm.workspace import written

#: Components of a block's or part's vectors that a task holds.
HELD = 1 << 22
#: Queries of a block that search together.
TOGETHER = 4096
#: Levels under the root at which nodes are split at routing objects; below, by a hash of the row.
DEEPEST = 12
_CELL = "uid long, query_id long, vec_id long, score long"
_PAGE = "root int, node long, object binary, radius double, page_object binary, page_radius double, parent double, uids binary, ids binary, entries binary, vectors binary"


def _pack(batches, scale: float):
    """vec_id, vector to vec_id, packed integer components and squared norm; invalid rows go."""
    for batch in batches:
        lists, n = batch.column(1), batch.num_rows
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        given = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        row = np.repeat(np.arange(n), size)
        wrong = np.bincount(row, weights=~np.isfinite(given), minlength=n) > 0
        ok = ~wrong & ~lists.is_null().to_numpy(zero_copy_only=False) & ~batch.column(0).is_null().to_numpy(zero_copy_only=False)
        mine = ok[row]
        with np.errstate(over="ignore"):
            x = np.floor(scale * given[mine])
            norm2 = np.bincount(row[mine], weights=x * x, minlength=n)
        whole = np.where(np.abs(x) < 2.0**62, x, 0.0).astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum(size[ok]))) * 8
        packed = pa.Array.from_buffers(pa.binary(), int(ok.sum()), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(whole)])
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), packed, pa.array(norm2[ok])], ["vec_id", "v", "norm2"])


def _matrix(packed, dim: int) -> np.ndarray:
    """Packed vectors as rows, shorter ones padded with zeros."""
    packed = list(packed)
    flat = np.frombuffer(b"".join(packed), np.int64)
    size = np.array([len(x) // 8 for x in packed], dtype=np.int64)
    if (size == dim).all():
        return flat.reshape(len(packed), dim)
    out = np.zeros((len(packed), dim), dtype=np.int64)
    out[np.repeat(np.arange(len(packed)), size), ranges(np.zeros(len(packed), np.int64), size)] = flat
    return out


def _lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    """One more component, so that all have the norm sqrt(top)."""
    x = vectors.astype(np.float64)
    return np.hstack((x, np.sqrt(np.maximum(0.0, top - (x * x).sum(axis=1)))[:, None]))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, d2))


class Page:
    """A leaf under construction: a routing object, its covering radius and parent distance, and its entries."""

    __slots__ = ("entry", "ids", "object", "parent", "radius", "rows")

    def __init__(self, rows: np.ndarray, lifted: np.ndarray, root: np.ndarray):
        middle = lifted[rows].mean(axis=0)
        self.rows = rows
        self.object = lifted[rows[_distances(lifted[rows], middle[None])[:, 0].argmin()]]
        self.entry = _distances(lifted[rows], self.object[None])[:, 0]
        self.radius = float(self.entry.max())
        self.parent = float(_distances(self.object[None], root[None])[0, 0])


def _pages(lifted: np.ndarray, root: np.ndarray, size: int) -> list[Page]:
    """Split at two promoted, distant objects until a page holds at most ``size`` entries."""
    out, todo = [], [np.arange(len(lifted))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(Page(rows, lifted, root))
            continue
        own = lifted[rows]
        a = own[_distances(own, own[:1])[:, 0].argmax()]
        to_a = _distances(own, a[None])[:, 0]
        side = to_a - _distances(own, own[to_a.argmax()][None])[:, 0]
        order = np.argsort(side, kind="stable")
        # the balanced half of a large node, so that equal vectors split as well
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def _build(subtree: pd.DataFrame, dim: int, top: float, page_rows: int) -> pd.DataFrame:
    """The rows of a subtree to its pages, one row each."""
    vectors = _matrix(subtree["v"], dim)
    lifted = _lifted(vectors, top)
    root = lifted[_distances(lifted, lifted.mean(axis=0)[None])[:, 0].argmin()]
    radius = float(_distances(lifted, root[None]).max())
    uids, ids = (subtree[c].to_numpy(np.int64) for c in ("uid", "vec_id"))
    blob = lambda x, kind: np.ascontiguousarray(x, kind).tobytes()
    out = []
    for p in _pages(lifted, root, page_rows):
        out.append((blob(root, np.float64), radius, blob(p.object, np.float64), p.radius, p.parent, blob(uids[p.rows], np.int64), blob(ids[p.rows], np.int64), blob(p.entry, np.float64), blob(vectors[p.rows], np.int64)))
    done = pd.DataFrame(out, columns=["object", "radius", "page_object", "page_radius", "parent", "uids", "ids", "entries", "vectors"])
    done.insert(0, "root", np.int32(subtree["root"].iloc[0]))
    done.insert(1, "node", np.int64(subtree["node"].iloc[0]))
    return done


class Leaf:
    """A stored page."""

    __slots__ = ("entry", "ids", "object", "parent", "radius", "uids", "vectors")

    def __init__(self, row, dim: int, kind):
        self.object = np.frombuffer(row.page_object, np.float64)
        self.radius, self.parent = row.page_radius, row.parent
        self.uids, self.ids = np.frombuffer(row.uids, np.int64), np.frombuffer(row.ids, np.int64)
        self.entry = np.frombuffer(row.entries, np.float64)
        self.vectors = np.frombuffer(row.vectors, np.int64).reshape(len(self.ids), dim).astype(kind)


def _subtrees(pages: pd.DataFrame, dim: int, kind) -> list[tuple[int, np.ndarray, float, list[Leaf]]]:
    """(node, object, radius, pages) of each subtree."""
    out: dict[int, tuple[int, np.ndarray, float, list[Leaf]]] = {}
    for row in pages.itertuples():
        out.setdefault(row.node, (row.node, np.frombuffer(row.object, np.float64), row.radius, []))[3].append(Leaf(row, dim, kind))
    return list(out.values())


def exact_in_floats(top: float) -> bool:
    """Whether scores of vectors whose squared norms are at most ``top`` are exact as 64-bit floats."""
    return top < 2.0**52


def _search(queries: np.ndarray, uids: np.ndarray, home: np.ndarray, floor: np.ndarray, subtrees, top: float, k: int, counted: dict | None = None):
    """The k best (query, vec_id, score) of each query that aren't under its floor.

    A query's own row and its home subtree, unless that is -1, are left out.  Scores are
    multiplied and ranked as floats where these are exact, else as integers.
    """
    kind = np.float64 if exact_in_floats(top) else np.int64
    none = kind(-np.inf) if kind is np.float64 else np.int64(-(2**63 - 1))
    own = queries.astype(kind)
    wide = np.hstack((queries.astype(np.float64), np.zeros((len(queries), 1))))
    q2 = (wide * wide).sum(axis=1)
    slack = 1e-9 * (1.0 + q2 + top)
    best = np.full((len(queries), k), none)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
    floor = np.maximum(floor, none)

    def reach(of) -> np.ndarray:
        """How far a row that still counts can be from each query."""
        least = np.maximum(best[of, -1], floor[of]).astype(np.float64)
        least[least <= float(none)] = -np.inf
        # finite, so that the infinite distance of a subtree left out is beyond it
        return np.minimum(np.sqrt(np.maximum(0.0, q2[of] + top - 2.0 * least) + slack[of]), np.finfo(np.float64).max)

    far = reach(slice(None))
    heap, order = [], itertools.count()

    def push(bound: np.ndarray, *item) -> None:
        if (bound <= far).any():
            heapq.heappush(heap, (float(bound.min()), next(order), *item))

    for node, point, radius, pages in subtrees:
        to = _distances(wide, point[None])[:, 0]
        to[home == node] = np.inf
        push(to - radius, 0, to, pages)
    while heap:
        _, _, stage, to, item = heapq.heappop(heap)
        if stage == 0:
            for page in item:
                # ruled out by the stored parent distance, or queued by it
                push(np.abs(to - page.parent) - page.radius, 1, to, page)
            continue
        page = item
        if stage == 1:
            live = np.flatnonzero(np.abs(to - page.parent) - page.radius <= far)
            near = np.full(len(queries), np.inf)
            near[live] = _distances(wide[live], page.object[None])[:, 0]
            push(near - page.radius, 2, near, page)
            continue
        live = np.flatnonzero(to - page.radius <= far)
        if not len(live):
            continue
        some = np.flatnonzero((page.entry >= (to[live] - far[live]).min()) & (page.entry <= (to[live] + far[live]).max()))
        if not len(some):
            continue
        if counted is not None:
            counted["products"] = counted.get("products", 0) + len(live) * len(some)
        score = own[live] @ page.vectors[some].T
        score[page.uids[some][None, :] == uids[live][:, None]] = none
        hit = np.flatnonzero((score >= np.maximum(best[live, -1], floor[live])[:, None]).any(axis=1) & (score > none).any(axis=1))
        if not len(hit):
            continue
        live = live[hit]
        all_score = np.hstack((best[live], score[hit]))
        all_id = np.hstack((best_id[live], np.broadcast_to(page.ids[some], (len(hit), len(some)))))
        chosen = np.lexsort((all_id, -all_score), axis=1)[:, :k]
        best[live] = np.take_along_axis(all_score, chosen, 1)
        best_id[live] = np.take_along_axis(all_id, chosen, 1)
        far[live] = reach(live)
    q, c = np.nonzero((best > none) & (best >= floor[:, None]))
    return q, best_id[q, c], best[q, c].astype(np.int64)


def _routing(sample: np.ndarray, count: int) -> np.ndarray:
    """Distinct, distant vectors of the sample, farthest first."""
    distinct = np.unique(sample, axis=0)
    x = distinct.astype(np.float64)
    pick, near = [0], _distances(x, x[:1])[:, 0]
    while len(pick) < min(count, len(x)) and near.max() > 0:
        pick.append(int(near.argmax()))
        near = np.minimum(near, _distances(x, x[pick[-1]][None])[:, 0])
    return distinct[pick]


def top_k(table: DataFrame, k: int = 20, every: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, roots: int = 32, sample_rows: int = 1024, fan: int = 16, subtree_rows: int = 4096, page_rows: int = 128, block_rows: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k greatest integer inner products of each query.

    Components become ``floor(scale * x)``.  Queries are the rows whose id is
    divisible by ``every``; candidates are all rows but the query's own; ties go to
    the smaller id.  The root's routing objects come from ``sample_rows`` rows, those
    of lower nodes from some 256 of theirs, all chosen by hashes; every row is indexed.

    Rows with a null id, a null vector, or null or non-finite components take no
    part.  Rows that repeat an id are rows of their own, as candidates and as queries,
    so a query id then has several results.  Shorter vectors count as padded with
    zeros.  An empty table gives an empty result; other columns are ignored.

    Scores are exact.  A squared norm of 2^62 or more, whose scores need not fit a
    long, is an error, as an overflow is in SQL.
    """
    spark = table.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    packed = rows.mapInArrow(lambda it: _pack(it, scale), "vec_id long, v binary, norm2 double")
    vectors = written(packed.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    size = vectors.agg(F.max(F.length("v")), F.max("norm2")).first()
    if size[0] is None:
        return spark.createDataFrame([], result)
    dim, top = size[0] // 8, size[1]
    if not top < 2.0**62:
        raise ValueError(f"scores of vectors with a squared norm of {top:g} need not fit a long")
    kind = np.float64 if exact_in_floats(top) else np.int64
    held = block_rows or max(TOGETHER, HELD // max(1, dim))
    sample = vectors.orderBy(F.xxhash64("uid")).limit(sample_rows).select("v").collect()
    anchors = _lifted(_routing(_matrix([r["v"] for r in sample], dim), roots), top)

    def place(batches):
        for batch in batches:
            own = _matrix(batch.column(2).to_pylist(), dim)
            d = _distances(_lifted(own, top), anchors)
            root = d.argmin(axis=1) if len(own) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(root.astype(np.int32)), pa.array(root), pa.array(d.min(axis=1, initial=np.inf))], ["uid", "vec_id", "v", "root", "node", "away"])

    placed = written(vectors.select("uid", "vec_id", "v").mapInArrow(place, "uid long, vec_id long, v binary, root int, node long, away double"), "placed")
    # one line a root, at most ``roots`` of them
    balls = {r["root"]: (r["n"], r["radius"]) for r in placed.groupBy("root").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    tree = placed.drop("away")

    def objects_of(batches):
        for batch in batches:
            found = [_routing(_matrix(sorted(x), dim), fan) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary())], ["node", "objects"])

    def descend(batches, depth: int):
        """Rows of a large node to its children: those of its routing objects, or of hashes where it has but one."""
        for batch in batches:
            node, uid = (batch.column(c).to_numpy().copy() for c in (3, 0))
            vectors_, many, objects = batch.column(2).to_pylist(), batch.column(4).to_pylist(), batch.column(5)
            for of in np.unique(node):
                at = np.flatnonzero(node == of)
                if many[at[0]] is None:
                    continue
                flat = np.frombuffer(objects[int(at[0])].as_py() or b"", np.int64)
                points = flat.reshape(-1, dim) if dim else flat[:0]
                if len(points) > 1 and depth <= DEEPEST:
                    child = _distances(_lifted(_matrix([vectors_[i] for i in at], dim), top), _lifted(points, top)).argmin(axis=1)
                else:
                    child = (mix(uid[at].astype(U64) + U64(depth)) % U64(-(-many[at[0]] // subtree_rows))).astype(np.int64)
                node[at] = mix(node[at].astype(U64) * U64(0x9E3779B97F4A7C15) + child.astype(U64) * U64(64) + U64(depth)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(node), batch.column(6)], ["uid", "vec_id", "v", "node", "root"])

    for depth in itertools.count(1):
        large = written(tree.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > subtree_rows), "large")
        if large.isEmpty():
            break
        drawn = tree.join(large, "node").filter(F.pmod(F.xxhash64(F.lit(depth), "uid"), "n") < 256)
        chosen = drawn.groupBy("node").agg(F.collect_set("v").alias("sample")).mapInArrow(objects_of, "node long, objects binary")
        objects = written(large.join(chosen, "node", "left"), "objects")
        beside = tree.join(objects, "node", "left").select("uid", "vec_id", "v", "node", "n", "objects", "root")
        tree = written(beside.mapInArrow(lambda it, d=depth: descend(it, d), "uid long, vec_id long, v binary, node long, root int"), "placed")
    pages = written(tree.groupBy("node").applyInPandas(lambda x: _build(x, dim, top, page_rows), _PAGE), "pages")
    queries = tree.filter(F.col("vec_id") % every == 0)

    def visit(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """A block of queries in the subtrees of a part."""
        if not len(index) or not len(asked):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("uid", "query_id", "vec_id", "score")})
        subtrees, out = _subtrees(index, dim, kind), []
        uids, ids, home, floor = (asked[c].to_numpy(np.int64) for c in ("uid", "vec_id", "home", "floor"))
        for at in range(0, len(asked), TOGETHER):
            now = slice(at, at + TOGETHER)
            q, found, score = _search(_matrix(asked["v"].iloc[now], dim), uids[now], home[now], floor[now], subtrees, top, k)
            out.append(pd.DataFrame({"uid": uids[now][q], "query_id": ids[now][q], "vec_id": found, "score": score}))
        return pd.concat(out)

    none = F.lit(-(2**63 - 1)).cast("long")
    at_home = queries.withColumn("home", F.lit(-1).cast("long")).withColumn("floor", none)
    first = written(pages.groupBy("node").cogroup(at_home.groupBy("node")).applyInPandas(visit, _CELL), "home")
    floors = first.groupBy("uid").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    known = queries.join(floors, "uid", "left").select("uid", "vec_id", "v", F.col("node").alias("home"), F.coalesce("floor", none).alias("floor"))
    listed = sorted(balls)
    radii = np.array([balls[x][1] for x in listed])

    def route(batches):
        """Each query beside the roots that can still hold a row for it."""
        for batch in batches:
            own = _matrix(batch.column(2).to_pylist(), dim)
            wide = np.hstack((own.astype(np.float64), np.zeros((len(own), 1))))
            q2 = (wide * wide).sum(axis=1)
            floor = batch.column(4).to_numpy().astype(np.float64)
            floor[floor <= -(2.0**63)] = -np.inf
            far = np.sqrt(np.maximum(0.0, q2 + top - 2.0 * floor) + 1e-9 * (1.0 + q2 + top))
            r, c = np.nonzero(_distances(wide, anchors[listed]) - radii <= far[:, None])
            yield pa.RecordBatch.from_arrays([*(x.take(pa.array(r)) for x in batch.columns), pa.array(np.array(listed, dtype=np.int32)[c])], ["uid", "vec_id", "v", "home", "floor", "root"])

    routed = written(known.mapInArrow(route, "uid long, vec_id long, v binary, home long, floor long, root int"), "routed")
    asked_of = {r["root"]: r["n"] for r in routed.groupBy("root").agg(F.count("*").alias("n")).collect()}
    if not asked_of:
        return spark.createDataFrame([], result)

    def pieces(of: dict[int, int]):
        return F.create_map(*[F.lit(x) for root in listed for x in (root, -(-of.get(root, 0) // held))])[F.col("root")]

    parts, blocks = pieces({x: n for x, (n, _) in balls.items()}), pieces(asked_of)
    index = pages.filter(F.col("root").isin(list(asked_of))).withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = routed.withColumn("block", F.pmod(F.xxhash64("uid"), blocks).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    away = index.groupBy("root", "part", "block").cogroup(dealt.groupBy("root", "part", "block")).applyInPandas(visit, _CELL)
    ranked = first.union(away).withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
