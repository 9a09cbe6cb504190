"""Line, substring and near-duplicate removal against plain versions."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import line_dedup, near_dedup, substring_dedup
from siltstone.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import against_duckdb
from tests.llm import plain

SCHEMA = "doc_id long, text string, lang string, n long, start int, component string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", 1, 2, "x") for d, t in rows], SCHEMA)


def passages(seed=1):
    """Documents with copies, near copies, shared passages and odd texts."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ä", "naïve", "日本", "THE"]
    make = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    shared = [make(n) for n in (34, 35, 36, 60, 90)]
    rows = []
    for i in range(60):
        w = make(rnd.choice([0, 1, 2, 5, 34, 40, 120]))
        for p in rnd.sample(shared, rnd.choice([0, 0, 1, 2])):
            at = rnd.randrange(len(w) + 1)
            w[at:at] = p
        rows.append((i, rnd.choice([" ", "\n", "  ", "\t"]).join(w)))
    base = make(200)
    rows += [(100 + i, " ".join(base)) for i in range(5)]
    for i in range(40):
        w = list(base)
        for _ in range(rnd.choice([1, 2, 4, 8, 12])):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        rows.append((200 + i, " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    same = " ".join(make(35))
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, same), (303, same), (304, " ".join(["a"] * 80)), (305, " ".join(["a", "b"] * 50)), (306, "a"), (307, "A"), (None, " ".join(base)), (308, " ".join(make(30_000)))]
    return rows


def test_repeats_are_those_of_all_windows(spark):
    rows = passages()
    got = substring_dedup.remove_repeats(frame(spark, rows), window=35).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert sorted(map(tuple, got.collect()), key=repr) == plain.remove_repeats(rows, 35)


@pytest.mark.parametrize("window", [8, 9, 15])
def test_repeats_of_other_lengths(spark, window):
    rows = passages(2)[:80]
    got = substring_dedup.remove_repeats(frame(spark, rows), window=window).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert sorted(map(tuple, got.collect()), key=repr) == plain.remove_repeats(rows, window)


def test_repeat_spans_are_maximal(spark):
    p = [f"p{i}" for i in range(50)]
    rows = [(1, " ".join(["x", *p, "y", "z", *p])), (2, "q " + " ".join(p[:40]))]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["repeats"]] for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == {1: [(1, 51), (53, 103)], 2: [(1, 41)]}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_are_those_of_all_pairs(spark, k, percent):
    rows = passages(3)
    got = near_dedup.near_duplicates(frame(spark, rows), shingle_words=k, percent=percent)
    want = plain.near_duplicates(rows, k, percent)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], bool(r["kept"])) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("work", [50, 1 << 26])
def test_large_groups_are_compared_or_branched_on(spark, work):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(3):
        base = [rnd.choice(vocabulary) for _ in range(120)]
        for i in range(60):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 3, 6])):
                w[rnd.randrange(120)] = rnd.choice(vocabulary)
            rows.append((100 * g + i, " ".join(w)))
    got = near_dedup.near_duplicates(frame(spark, rows), shingle_words=3, percent=85, cell=8, work=work)
    want = plain.near_duplicates(rows, 3, 85)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()), key=repr) == want


def test_a_cell_that_comes_in_many_batches_keeps_every_row():
    """Texts become sets batch by batch and are never put together, whatever their bytes."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    names = ["node", "i", "j", "path", "side", "cls", "n", "comp", "bits", "paths", "fit", "text"]
    batches, texts = [], []
    for b in range(12):
        rows = []
        for r in range(5):
            w = list(base)
            w[rnd.randrange(60)] = f"x{b}{r}"
            items = next(near_dedup._row_sets(pa.array([" ".join(w)]), 3))
            cls = near_dedup._digest(items)
            rows.append((7, 0, 0, -1, r % 2, cls, len(items), cls, near_dedup._bit_sketch(items), bytes(8), [], " ".join(w)))
            texts.append((5 * b + r, " ".join(w)))
        batches.append(pa.RecordBatch.from_arrays([pa.array(c) if n != "fit" else pa.array(c, pa.list_(pa.int32())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names))
    cells = list(near_dedup._whole_cells(iter(batches), 3))
    assert sum(rows.num_rows for rows, _ in cells) == 60 and sum(len(sets) for _, sets in cells) == 60
    links = [x for out in near_dedup._linked_rows(iter(batches), 300, 80, 3) for x in out.to_pylist()]
    assert len(links) == 59


@pytest.mark.parametrize("items", [1, 400])
def test_cells_bounded_by_size_lose_no_link(spark, items):
    rows = passages(4)
    got = near_dedup.near_duplicates(frame(spark, rows), shingle_words=3, percent=85, cell_items=items)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], bool(r["kept"])) for r in got.collect()), key=repr) == plain.near_duplicates(rows, 3, 85)


def test_trees_reach_the_recall():
    assert near_dedup.trees_for(0.85) == 3
    assert near_dedup.trees_for(0.80) == 4
    assert near_dedup.trees_for(1.0) == 1


def test_kept_documents_keep_columns(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words that are here now"), (4, None), (5, "")]
    kept = near_dedup.kept_documents(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "n", "start", "component"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5]


def test_pairs_at_the_threshold_survive_branching(spark):
    """Documents of one template under the threshold, with planted pairs just above it: the node is branched on."""
    rnd = random.Random(11)
    template = [f"t{i}" for i in range(70)]
    rows, pairs = [], []
    for i in range(150):
        w = template + [f"d{i}x{k}" for k in range(50)]
        v = list(w)
        v[rnd.randrange(75, 115)] = "edited"
        v[rnd.randrange(75, 115)] = "again"
        a, b = plain.shingle_set(" ".join(w), 3), plain.shingle_set(" ".join(v), 3)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        if 100 * len(a & b) >= 85 * len(a | b):
            pairs.append((2 * i, 2 * i + 1))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows), shingle_words=3, percent=85, work=3000, cell=64).collect()}
    found = sum(got[a] == got[b] for a, b in pairs)
    assert len(pairs) >= 100 and found >= len(pairs) - 1
    assert len(set(got.values())) >= 150


def test_kept_documents_are_rows(spark):
    one, two = "some words of a document that is copied", "quite another text under the same id here"
    rows = [(1, one), (2, one), (2, two), (3, two), (3, two), (4, None), (4, None), (None, one), (5, "lone text"), (5, "lone text")]
    kept = near_dedup.kept_documents(spark.createDataFrame([(d, t, "a", "b") for d, t in rows], "doc_id long, text string, kept string, own string"))
    assert kept.columns == ["doc_id", "text", "kept", "own"]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(1, one), (2, two), (4, None), (4, None), (5, "lone text")], key=repr)


@pytest.mark.parametrize("operator", [line_dedup.line_dedup, line_dedup.cleaned_documents, near_dedup.kept_documents])
def test_names_of_other_columns_do_not_clash(spark, operator):
    names = ["d", "t", "row", "removed", "line", "gone", "comp", "first"]
    text = "a line that is long enough to be a block of its own\nb"
    docs = spark.createDataFrame([(i, text, *names) for i in range(3)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    out = operator(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert {tuple(r[c] for c in names) for r in out.collect()} == {tuple(names)}


def regular(n):
    """Two texts of n letters whose polynomial hashes modulo 2^64 are equal for any odd base."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_regular_words_do_not_collide(spark, n):
    a, b = regular(n)
    shared = [f"s{i}" for i in range(34)]
    rows = [(1, " ".join([a, *shared])), (2, " ".join([b, *shared])), (3, a), (4, b)]
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows[2:])).collect()} == {3: 3, 4: 4}


@pytest.mark.parametrize("n", [32, 64, 1024])
def test_regular_runs_do_not_collide(spark, n):
    a, b = (t.replace("a", "xx ").replace("b", "yy ") for t in regular(n))
    rows = [(1, a), (2, b)]
    got = substring_dedup.remove_repeats(frame(spark, rows), window=n).select("doc_id", "n_removed").collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {1: 0, 2: 0}


def test_patience_aligns_in_order():
    rnd = random.Random(7)
    for _ in range(200):
        a, b = ([rnd.randrange(8) for _ in range(rnd.randrange(12))] for _ in (0, 1))
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert line_dedup.patience([1, 2, 3, 4], [1, 2, 3, 4]) == [(i, i) for i in range(4)]
    assert line_dedup.patience([9, 1, 2, 8, 3], [1, 2, 7, 3]) == [(1, 0), (2, 1), (4, 3)]
    assert line_dedup.patience([1, 2, 3], [3, 1, 2]) == [(0, 1), (1, 2)]
    assert line_dedup.patience([], [1]) == []


def test_alignments_decide_what_goes(spark, small, monkeypatch):
    """Without patience no line goes; moved and repeated blocks are told apart."""
    wide = [f"a line of its own, number {i}, of over forty characters" for i in range(6)]
    short = ["ab " * 5, "cd " * 5, "ab " * 5, "cd " * 5]
    rows = [(1, "\n".join([*wide, *short])), (2, "\n".join(["new", *wide[3:], *wide[:3]])), (3, "\n".join([*short, "x", *short])), (4, "\n".join(wide[2:4]))]
    got = {r["doc_id"]: (r["removed_lines"], r["n_moved"]) for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert got == {1: ([], 0), 2: ([1, 2, 3, 4, 5, 6], 3), 3: ([0, 1, 2, 3, 5, 6, 7, 8], 4), 4: ([0, 1], 0)}
    a, b = (np.array(x, dtype=np.int64) for x in ([1, 2, 3, 4], [3, 4, 1, 2]))
    assert line_dedup.aligned(a, b, [30] * 4, [(0, 2), (2, 4)], 40) in (({0, 1}, {2, 3}), ({2, 3}, {0, 1}))
    monkeypatch.setattr(line_dedup, "patience", lambda a, b: [])
    assert line_dedup.aligned(a, b, [30] * 4, [(0, 2), (2, 4)], 40) == (set(), set())


def test_lines_go_from_the_later_document(spark):
    rnd = random.Random(9)
    lines = [f"line {i} " + "x" * rnd.randrange(60) for i in range(40)] + [""]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(9)))) for i in range(120)] + [(200, None), (201, ""), (202, "\n\n"), (203, "é" * 50), (204, "é" * 50)]
    got = line_dedup.line_dedup(frame(spark, rows))
    assert got.columns == [*SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", "), "n_lines", "n_removed", "removed_lines", "n_moved"]
    want = plain.line_dedup(rows, 40)
    texts = dict(rows)
    for r in got.collect():
        gone = want.get(r["doc_id"], [])
        assert r["removed_lines"] == gone
        text = texts[r["doc_id"]]
        assert r["text"] == (None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone))


def test_copies_of_a_document_go_whole(spark):
    text = "\n".join(f"this is line number {i} of the text" for i in range(5))
    rows = [(i, text) for i in range(30)] + [(50, "clean words of its own that nothing else holds"), (51, text + "\none more line"), (52, text), (52, text)]
    kept = line_dedup.cleaned_documents(frame(spark, rows))
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {0: text, 50: rows[30][1], 51: "one more line"}


@pytest.mark.parametrize("operator", [line_dedup.line_dedup, near_dedup.near_duplicates, substring_dedup.remove_repeats])
def test_empty_tables_and_nulls(spark, operator):
    assert operator(frame(spark, [])).count() == 0
    rows = [(None, None), (None, ""), (None, "a b c"), (1, None), (1, None), (2, "  ")]
    assert operator(frame(spark, rows)).count() == len(rows)


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_substring_dedup", "op8_near_dedup"])
def test_queries_equal_their_sql(spark, small, name):
    against_duckdb(QUERIES[name](spark, small), ORACLE_SQL[name], small)


def test_line_query_equals_plain_version(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = plain.line_dedup(docs, 40)
    for r in QUERIES["op1_line_dedup"](spark, small).collect():
        gone = want[r["doc_id"]]
        assert r["removed_lines"] == ",".join(map(str, gone))
        kept = "\n".join(x for i, x in enumerate(dict(docs)[r["doc_id"]].split("\n")) if i not in gone)
        assert r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def repeated_lines(rnd):
    """Passages of short lines whose lines occur singly before, and long lines that their first holder has twice."""
    parts = [f"part {k} of it" for k in range(4)]
    rows = [(i, f"{x}\nonly {i}") for i, x in enumerate(parts)]
    rows += [(i, "\n".join([f"head {i}", *parts, f"tail {i}"])) for i in range(10, 17)]
    long = "a long line that many documents hold " + "y" * 20
    rows += [(20, f"x\n{long}\nz\n{long}\nu")] + [(i, f"own {i}\n{long}\nmore {i}") for i in range(21, 28)]
    lines = [f"l{i} " + "x" * rnd.randrange(45) for i in range(25)] + [""]
    return rows + [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(12)))) for i in range(100, 220)]


def test_lines_go_as_in_all_pairs(spark):
    for seed in (1, 2):
        rows = repeated_lines(random.Random(seed))
        want = plain.line_dedup(rows, 40)
        assert want[11] == [1, 2, 3, 4] and want[22] == [1]
        assert {r["doc_id"]: r["removed_lines"] for r in line_dedup.line_dedup(frame(spark, rows)).collect()} == want


def test_trees_are_independent():
    rng = np.random.default_rng(3)
    wide = near_dedup.coordinates(4, 3)
    a, b = [], []
    for _ in range(8000):
        items = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        a.append(near_dedup._sketch(items[:90], wide))
        b.append(near_dedup._sketch(items[10:], wide))
    met = (near_dedup._nodes(np.array(a), 4, 3) == near_dedup._nodes(np.array(b), 4, 3)).any(axis=1)
    assert (~met).sum() <= 3


@pytest.mark.parametrize(("fit", "found"), [([1], 1), ([0, 1], 0)])
def test_pairs_are_left_only_to_compared_nodes(fit, found):
    paths = np.array([7, 8], np.int64).tobytes()
    column = lambda *x: pa.array(x)
    rows = pa.RecordBatch.from_arrays(
        [*[column(0, 0)] * 3, column(1, 1), column(0, 1), column(b"a", b"b"), column(9, 9), column(b"a" * 16, b"b" * 16), *[column(bytes(64), bytes(64))], column(paths, paths), column(fit, fit)],
        ["node", "i", "j", "path", "side", "cls", "n", "comp", "bits", "paths", "fit"],
    )
    assert sum(len(a) for a, _ in near_dedup._candidates(rows, 400, 80)) == found
