"""Collocations, importance resampling and decontamination against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import crc, decontaminate, importance, phrases
from siltstone.llm.filters import key_filter
from siltstone.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import against_duckdb
from tests.llm.plain import lower

NEW = ["op11_collocations", "op12_importance_resampling", "op13_decontamination"]


@pytest.mark.parametrize("name", NEW)
def test_query_equals_its_sql(spark, small, name):
    against_duckdb(QUERIES[name](spark, small), ORACLE_SQL[name], small)


# -- collocations ---------------------------------------------------------------------------------


def plain_collocations(rows, support, most=4, top=2000, percent=80):
    """rows: (lang, text) to (lang, rank, phrase, a, l, r, n, score)."""
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, most + 1):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        some = {p: a for p, a in f.items() if a >= support and len(p) > 1}
        longer = Counter()
        for p, a in some.items():
            for q in {p[i:j] for i in range(len(p)) for j in range(i + 1, len(p) + 1)} - {p}:
                longer[q] = max(longer[q], a)
        found = []
        for p, a in some.items():
            score, cut = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if 100 * longer[p] < percent * a:
                found.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0]) for i, x in enumerate(sorted(found)[:top])]
    return sorted(out)


def collocated(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, lang, "x", 7) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int")
    return sorted(tuple(r) for r in phrases.collocations(docs, **how).collect())


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_collocations_equal_plain_counts(spark, monkeypatch, shards):
    rnd = random.Random(5)
    monkeypatch.setattr(phrases, "_PART", 700)
    word = ["a", "B", "ça", "日本", "x" * 90, "d.e", "F\tG", "h"]
    rows = [(rnd.choice(["en", "en", "de", None]), " ".join(rnd.choice(word) + rnd.choice(["", "", "", ",", "!\n"]) for _ in range(rnd.randrange(60)))) for _ in range(150)]
    rows += [("en", None), ("en", ""), ("fr", "solo"), ("en", "the same words again " * 400)] + [("de", "a copy of one text, a copy.")] * 40
    want = plain_collocations(rows, 12)
    assert len(want) > 50
    assert collocated(spark, rows, support=12, shards=shards) == want
    assert collocated(spark, rows, support=12, shards=shards, top=3) == [r for r in want if r[1] <= 3]


def test_support_found_in_one_shard_or_spread_over_all(spark):
    together = [("en", "rare pair " * 30)]
    spread = [("en", f"w{i} other pair v{i}") for i in range(30)]
    got = {r[2]: r[3] for r in collocated(spark, together + spread)}
    assert got["other pair"] == 30 and got["rare pair"] == 30


def test_no_collocations_in_empty_tables(spark):
    assert collocated(spark, []) == []
    assert collocated(spark, [(None, None), ("en", " ")]) == []


# -- importance resampling ------------------------------------------------------------------------


@pytest.mark.parametrize("joint", [32, 200])
def test_run_crcs(joint):
    rnd = random.Random(1)
    spans = [bytes(rnd.randrange(256) for _ in range(rnd.choice([1, 2, 5, 63, 64, 65, 200, 9000]))) for _ in range(80)]
    data, end = np.frombuffer(b"".join(spans), np.uint8), np.cumsum([len(s) for s in spans])
    start = end - np.array([len(s) for s in spans])
    for k, got in crc.run_crcs(data, start, end, 3, joint):
        assert got.tolist() == [zlib.crc32(bytes([joint]).join(spans[i : i + k])) for i in range(len(spans) - k + 1)]


LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_resample(rows, target, percent=5, least=20):
    def features(t):
        w = LETTERS.findall(lower(t))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    s = Counter(b for _, t in rows for b in features(t)[1])
    g = Counter(b for t in target for b in features(t)[1])
    big_s, big_t = sum(s.values()), sum(g.values())
    gain = lambda b: math.floor(1000 * math.log((g[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out = []
    for d, t in rows:
        n, f = features(t)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


def resampled(spark, rows, target, **how):
    docs = spark.createDataFrame([(d, t, 1, "w") for d, t in rows], "doc_id long, text string, score int, bucket string")
    aims = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    return [tuple(r) for r in importance.resample_towards(docs, aims, **how).collect()]


def some_texts(seed, n, short=0.2):
    rnd = random.Random(seed)
    word = [f"w{i}" for i in range(30)] + ["ÉT", "Up", "x" * 70, "-", "日本"]
    return [" ".join(rnd.choice(word) for _ in range(rnd.randrange(19) if rnd.random() < short else rnd.randrange(20, 60))) for _ in range(n)]


def test_resampling_equals_plain_version(spark):
    texts = some_texts(3, 260)
    rows = [(i * 37 - 400, t) for i, t in enumerate(texts)] + [(90_001, None), (90_002, ""), (90_003, "long text " * 30_000), (None, texts[0] + " and more words " * 9)]
    target = some_texts(4, 12) + [None, ""]
    for percent in (5, 37, 100):
        got = resampled(spark, rows, target, percent=percent)
        assert sorted(got, key=repr) == sorted(plain_resample(rows, target, percent), key=repr)


def test_rows_that_tie_are_drawn_exactly(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(7, text)] * 90 + [(8, text)] * 30
    got = resampled(spark, rows, ["w1 w2"], percent=50)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 61))
    first = 7 if dict((r[0], r[3]) for r in got)[7] >= dict((r[0], r[3]) for r in got)[8] else 8
    drawn = Counter(r[0] for r in got if r[4])
    assert drawn[first] == min(60, 90 if first == 7 else 30) and sum(drawn.values()) == 60


def test_equal_scores_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(i, 5, i) for i in range(100)] + [(None, 5, 200), (500, 9, 201)], "doc_id long, score long, row long")
    for keep in (1, 2, 40, 101, 102):
        got = sorted((r[0] for r in rows.filter(importance._drawn(rows, keep)).select("row").collect()))
        assert got == sorted([201, *range(100), 200][:keep])


def test_resampling_of_empty_tables(spark):
    assert resampled(spark, [], ["a b"]) == []
    assert [r[4] for r in resampled(spark, [(1, "a few words"), (2, None)], [])] == [None, None]


# -- decontamination ------------------------------------------------------------------------------


def plain_contamination(rows, items, window=10):
    cut = lambda t: LETTERS.findall(lower(t))
    of = defaultdict(set)
    for item, t in items:
        w = cut(t)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            of[tuple(w[i : i + window])].add(item)
    sizes = {len(x) for x in of}
    out = []
    for d, t in rows:
        w, hit, named = cut(t), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (x := tuple(w[i : i + size])) in of:
                    hit.update(range(i, i + size))
                    named |= of[x]
        out.append((d, len(w), len(hit), sorted(str(x) for x in named if x is not None), bool(hit)))
    return sorted(out, key=repr)


def contaminated(spark, rows, items, **how):
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, key string, items int")
    bench = spark.createDataFrame([(i, t, "w") for i, t in items], "item_id long, text string, words string")
    return sorted((tuple(r) for r in decontaminate.contamination(docs, bench, **how).collect()), key=repr)


@pytest.mark.parametrize("shingle", [1, 3, 5])
def test_contamination_equals_plain_search(spark, shingle):
    rnd = random.Random(8)
    word = [f"w{i}" for i in range(12)] + ["É", "日本", "y" * 80]
    text = lambda n: " ".join(rnd.choice(word) for _ in range(n))
    items = [(i, text(rnd.choice([1, 2, 3, 9, 10, 11, 30]))) for i in range(14)] + [(100, None), (101, ""), (102, " . "), (None, text(12))]
    items += [(200 + i, items[6][1]) for i in range(30)] + [(3, text(15))]
    rows = [(i, text(rnd.randrange(60))) for i in range(60)]
    rows += [(1000 + i, f"{text(5)} {rnd.choice(items)[1] or ''}, {text(4)}".upper()) for i in range(60)]
    rows += [(2000, None), (2001, ""), (None, items[6][1]), (1000, text(30)), (2002, (text(200) + " ") * 40)] + [rows[70]] * 20
    assert contaminated(spark, rows, items, shingle_words=shingle) == plain_contamination(rows, items)


def test_windows_at_both_ends_and_across_texts(spark):
    item = " ".join(f"b{i}" for i in range(10))
    rows = [(1, item), (2, f"x {item}"), (3, f"{item} y"), (4, "b0 b1 b2 b3 b4"), (5, "b5 b6 b7 b8 b9"), (6, item.replace("b5", "c5")), (7, f"{item} {item}")]
    got = {r[0]: r[2] for r in contaminated(spark, rows, [(1, item)])}
    assert got == {1: 10, 2: 10, 3: 10, 4: 0, 5: 0, 6: 0, 7: 20}


def test_contamination_of_empty_tables(spark):
    assert contaminated(spark, [], [(1, "a b")]) == []
    assert contaminated(spark, [(1, "a b"), (None, None)], []) == [(1, 2, 0, [], False), (None, 0, 0, [], False)]


def test_filter_holds_every_key(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    mine = np.array([r["key"] for r in keys.collect()], dtype=np.int64).view(np.uint64)
    other = np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2)
    found = key_filter(keys)
    assert found.holds(mine).all() and found.holds(other).mean() < 0.05
    tight = key_filter(keys, max_bits=15)
    assert tight.holds(mine).all()
    assert not key_filter(keys.limit(0)).holds(mine).any()
