"""Fingerprints, toxicity, quality and SentencePiece."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import fingerprints, line_dedup, quality, sentencepiece, token_counts, toxicity
from siltstone.llm.queries import MODEL_FILE, QUERIES
from tests.llm import plain

SCHEMA = "doc_id long, text string, score string, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "s", "i") for d, t in rows], SCHEMA)


def test_likeness_estimates_jaccard():
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(5000)}" for _ in range(600)]
    for share in (0.0, 0.02, 0.1, 0.5):
        other = [f"v{rnd.random()}" if rnd.random() < share else w for w in base]
        a, b = " ".join(base), " ".join(other)
        x, y = plain.shingle_set(a, 5, fold=False), plain.shingle_set(b, 5, fold=False)
        code, some = fingerprints.codes(pa.array([a, b]))
        got = fingerprints.likeness(code[:1], some[:1], code[1:], some[1:])[0]
        assert abs(got - len(x & y) / len(x | y)) < 0.12


def test_sparse_documents_are_densified():
    code, some = fingerprints.codes(pa.array(["one", "one", "two", "", None, "a b c d e f", "a b c d e f g"]))
    assert some.tolist() == [True, True, True, False, False, True, True]
    assert (code[0] == code[1]).all()
    like = fingerprints.likeness(code[[0, 0, 3, 0, 5]], some[[0, 0, 3, 0, 5]], code[[1, 2, 4, 3, 6]], some[[1, 2, 4, 3, 6]])
    assert like[0] == 1 and like[1] < 0.2 and like[2] == 1 and like[3] == 0 and abs(like[4] - 2 / 3) < 0.15


@pytest.mark.parametrize("partitions", ["1", "4", "23"])
def test_edited_text_takes_the_next_documents_head(spark, partitions):
    rnd = random.Random(3)
    ids = rnd.sample(range(1000), 80)
    rows = [(i, "".join(rnd.choice("ab é日 \n") for _ in range(rnd.choice([0, 1, 3, 4, 50, 900])))) for i in ids] + [(5000, None), (5001, "x" * 30_000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r["doc_id"]: r for r in fingerprints.fingerprints_with_next(frame(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for (i, t), (_, follow) in zip(order, order[1:] + order[:1], strict=True):
        q = len(t) // 4
        want = t[: len(t) - q] + follow[:q]
        assert got[i]["edited_text"] == want and got[i]["n_chars"] == len(t)
        code, some = fingerprints.codes(pa.array([t, want, follow]))
        assert [got[i]["fingerprint"], got[i]["edited_fingerprint"]] == fingerprints.packed(code, some)[:2]
        assert got[i]["near_edited"] == fingerprints.likeness(code[:1], some[:1], code[1:2], some[1:2])[0]
        assert got[i]["near_next"] == fingerprints.likeness(code[:1], some[:1], code[2:], some[2:])[0]


def test_fingerprints_of_odd_tables(spark):
    many = [(7, f"text {i} of one id") for i in range(300)] + [(7, "the same text")] * 200
    got = fingerprints.fingerprints_with_next(frame(spark, many))
    assert got.count() == 500 and got.filter("near_next = 1 and edited_text like 'the same%'").count() >= 199
    rows = [(None, "a"), (None, None), (3, "b"), (3, "b"), (3, "c")]
    assert fingerprints.fingerprints_with_next(frame(spark, rows)).count() == 5
    assert fingerprints.fingerprints_with_next(frame(spark, [])).count() == 0
    alone = fingerprints.fingerprints_with_next(frame(spark, [(1, "abcdefgh")])).first()
    assert alone["edited_text"] == "abcdefab" and alone["near_next"] == 1
    assert fingerprints.fingerprints(frame(spark, rows)).count() == 5


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op6_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert sum(clean) <= 0.02 * len(clean)
    assert sum(toxic) >= 0.6 * len(toxic)


def plain_ftrl(examples, alpha, beta, l1, passes):
    """(label, features) to weights by name, one coordinate at a time."""
    z, n = {}, {}

    def weight(f):
        own = z.get(f, 0.0)
        return 0.0 if abs(own) <= l1 else ((l1 if own > 0 else -l1) - own) / ((beta + n.get(f, 0.0) ** 0.5) / alpha)

    for _ in range(passes):
        for label, features in examples:
            own = {f: weight(f) for f in [*features, "bias"]}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(own.values()))))) - label
            if abs(g) < 1e-4:
                continue
            for f, w in own.items():
                before = n.get(f, 0.0)
                n[f] = before + g * g
                z[f] = z.get(f, 0.0) + g - (n[f] ** 0.5 - before**0.5) / alpha * w
    return weight


def plain_features(text):
    w = [x.lower() for x in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]
    out = {("w", x) for x in w} | {("p", *x) for x in zip(w, w[1:], strict=False)} | {("s", *x) for x in zip(w, w[2:], strict=False)}
    return out | {(n, x[:n]) for x in w for n in toxicity.STEMS if len(x) > n}


def test_scores_equal_plain_ftrl(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(120).collect()]
    labels = [int(i % 3 == 0) for i in range(len(rows))]
    hashed = []
    for _, t in rows:
        hashed += [np.unique(index).astype(np.int32) for _, _, _, index in toxicity.hashed_grams(pa.array([t], pa.string()), toxicity.BITS, True, toxicity.STEMS)]
    bias, at, weight = toxicity.ftrl(list(zip(labels, hashed, strict=True)))
    dense = toxicity._dense(at, weight)
    got = toxicity._scores(pa.array([t for _, t in rows], pa.string()), bias, dense)
    own = plain_ftrl([(y, plain_features(t)) for y, (_, t) in zip(labels, rows, strict=True)], toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.PASSES)
    want = [1 / (1 + math.exp(-max(-35.0, min(35.0, own("bias") + sum(map(own, plain_features(t))))))) for _, t in rows]
    # a few features share an index
    assert np.mean(np.abs(got - want)) < 0.02


def test_one_text_an_id_is_learnt_from(spark):
    rows = [(i, "bad" if i % 2 else "good") for i in range(60)] + [(1, "good")] * 500
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, rows), labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame(spark, [(100, "bad"), (101, "good")]), model).collect()}
    assert got[100] > 0.5 > got[101]


def test_toxic_words_are_learnt(spark):
    rnd = random.Random(1)
    plainly = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        w = [rnd.choice(plainly) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            w[rnd.randrange(40)] = "Badword!"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    labels += [(None, 1), (3, None), (10_000, 1)]
    docs, marks = frame(spark, [*rows, (901, None), (902, ""), (None, "badword")]), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, marks)).collect()
    assert len(got) == 903
    assert all((r["predicted"] == 1) == (r["doc_id"] is None or (r["doc_id"] < 900 and r["doc_id"] % 5 == 0)) for r in got)
    import zlib

    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    kept = toxicity.clean_documents(docs, marks)
    assert kept.columns == docs.columns and kept.count() == 903 - 181
    nothing = toxicity.fit(docs.limit(0), marks.limit(0))
    assert {r["score"] for r in toxicity.score(docs, nothing).collect()} == {0.5}


def test_resampling_keeps_the_greatest_keys(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op9_quality_classifier"](spark, folder).collect()
    kept = [r["sort_key"] for r in rows if r["kept"]]
    assert len(kept) == 800 and min(kept) >= max(r["sort_key"] for r in rows if not r["kept"])
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rate = lambda q: np.mean([r["kept"] for r in rows if marks.get(r["doc_id"]) == q])
    assert rate(1) > rate(0) + 0.3


def test_importance_equals_plain_counts(spark):
    rows = [(1, "good words here"), (2, "bad junk"), (3, "good good"), (4, None), (5, ""), (None, "junk"), (3, "good good")]
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    docs = frame(spark, rows)
    ratio = quality.fit(docs, marks)
    count = lambda texts: sum((np.bincount(index, minlength=1 << quality.BITS) for _, _, _, index in quality.hashed_grams(pa.array(texts, pa.string()), quality.BITS, skips=False)), np.ones(1 << quality.BITS))
    raw, good = count([t for _, t in rows]), count([t for d, t in rows if d in (1, 3)])
    assert np.allclose(ratio, np.log(good / good.sum()) - np.log(raw / raw.sum()))
    got = quality.resample(docs, marks, share=0.5)
    assert got.count() == len(rows)
    assert quality.resample(docs.limit(0), marks).count() == 0


@pytest.fixture(scope="module")
def model():
    if not os.path.exists(MODEL_FILE):
        pytest.skip("no model file")
    return sentencepiece.load(MODEL_FILE)


ODD = ["Hello  world\n\tthe é 你\U0001f600 ", None, "", " ", "   a", "▁a x", "日本語のテキスト", "a" * 300, "\x00\x7f", "é", "=" * 40 + "-" * 33, "the the the"]


def test_bpe_ids_equal_the_library(model, spark, small):
    import sentencepiece as library

    m = library.SentencePieceProcessor(model_file=MODEL_FILE)
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    texts += [t for t in ODD if t and "▁" not in t]
    rnd = random.Random(6)
    texts += ["".join(rnd.choice("abcdehilnorst  ") for _ in range(200)) for _ in range(50)]
    assert sentencepiece.Encoder(model).encode(pa.array(texts)).to_pylist() == m.encode(texts)


def test_models_with_other_settings_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    if not os.path.exists(MODEL_FILE):
        pytest.skip("no model file")
    m = proto.ModelProto()
    with open(MODEL_FILE, "rb") as f:
        m.ParseFromString(f.read())
    for change in (lambda x: setattr(x.normalizer_spec, "add_dummy_prefix", False), lambda x: setattr(x.normalizer_spec, "remove_extra_whitespaces", True), lambda x: setattr(x.pieces[300], "type", 4), lambda x: setattr(x.normalizer_spec, "name", "nmt_nfkc")):
        other = proto.ModelProto()
        other.CopyFrom(m)
        change(other)
        file = tmp_path / "m"
        file.write_bytes(other.SerializeToString())
        with pytest.raises(ValueError, match="this model has"):
            sentencepiece.load(str(file))


def test_regular_words_have_their_own_ids(model):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    texts = [a, a.translate(str.maketrans("ab", "ba"))]
    assert [x.decode() for x in sentencepiece.decode_lists(sentencepiece.Encoder(model).encode(pa.array(texts)), model)] == texts


LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(150_000))


def test_very_long_texts_are_read_whole(spark, model):
    rows = [(1, LONG), (2, LONG + " end"), (3, None), (4, "short")]
    docs = frame(spark, rows)
    marks = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, toxic int, quality int")
    coded = {r["doc_id"]: r for r in sentencepiece.encode_checked(docs, model).collect()}
    assert all(r["round_trip"] for r in coded.values()) and coded[2]["n_chars"] == len(LONG) + 4 and coded[2]["n_pieces"] > coded[1]["n_pieces"]
    assert toxicity.score(docs, toxicity.fit(docs, marks)).count() == 4
    grams = {r["doc_id"]: r["n_grams"] for r in quality.resample(docs, marks).collect()}
    assert grams[1] == 2 * 300_000 - 1 and grams[2] == grams[1] + 2 and grams[3] == 0
    counts = {r["doc_id"]: r["tokens"] for r in token_counts.events(docs.selectExpr("*", "'s' as source", "'l' as lang"), "insert", 0, F.col("text"), tokenizers=("words-1",)).collect()}
    assert counts == {1: 300_000, 2: 300_001, 3: 0, 4: 1}
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.line_dedup(frame(spark, [(1, LONG), (2, "x\n" + LONG)])).collect()} == {1: 0, 2: 1}


@pytest.mark.parametrize("rows", [[], [(None, None, "en", None, None)] * 3, [(1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "one text", None, None, 8), (2, "one text", None, None, 8), (None, "one text", "en", "a", 8), (3, " \n ", "en", "b", 3)]])
def test_pipeline_stages_on_odd_tables(spark, rows):
    """Null, empty, repeated and no rows pass every stage; clean texts stay."""
    import corpus_pipeline

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        kept = out.collect()
        if name != "sentencepiece":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(kept, out.schema)
    texts = {r["text"] for r in kept}
    assert texts == {t for _, t, *_ in rows}
    assert sum(r["text"] == "one text" for r in kept) <= 2


def test_unigram_ids_are_the_best_paths():
    rnd = random.Random(8)
    letters = "abc▁"
    pieces = [("<unk>", 0.0, "unknown"), ("<s>", 0.0, "control")] + [(f"<0x{i:02X}>", 0.0, "byte") for i in range(256)]
    seen = set()
    while len(seen) < 60:
        p = "".join(rnd.choice(letters[:3]) for _ in range(rnd.randrange(1, 5)))
        seen.add(rnd.choice(["", "▁"]) + p)
    pieces += [(p, -float(rnd.randrange(1, 400)), "normal") for p in sorted(seen | {"a", "b", "▁"})]
    v = sentencepiece.vocabulary(pieces)
    score = {p: s for p, s, kind in pieces if kind == "normal"}
    worst = min(score.values()) - 10
    for _ in range(100):
        text = "".join(rnd.choice("abc ") for _ in range(rnd.randrange(1, 12)))
        whole = "▁" + text.replace(" ", "▁")
        best = [0.0] + [-1e18] * len(whole)
        for end in range(1, len(whole) + 1):
            for start in range(end):
                s = score.get(whole[start:end], worst if end - start == 1 else None)
                if s is not None:
                    best[end] = max(best[end], best[start] + s)
        lists = sentencepiece.Encoder(v).encode(pa.array([text]))
        own = [pieces[i] for i in lists.to_pylist()[0]]
        total = sum(s for _, s, kind in own if kind == "normal") + worst * sum(kind == "byte" for _, _, kind in own)
        assert total == best[-1]
        assert sentencepiece.decode_lists(lists, v) == [text.encode()]


def test_round_trip(model, spark):
    rows = list(enumerate(ODD))
    docs = frame(spark, rows)
    coded = sentencepiece.encode(docs, model)
    assert coded.columns == ["doc_id", "text", "score", "ids"]
    back = sentencepiece.decode(coded, model).collect()
    assert {r["doc_id"]: r["decoded"] for r in back} == {i: t or "" for i, t in rows}
    assert all(r["round_trip"] for r in sentencepiece.encode_checked(docs, model).collect())
    assert sentencepiece.encode_checked(docs.limit(0), model).count() == 0
    odd = spark.createDataFrame([([999999, -1, 1],), (None,), ([],)], "ids array<int>")
    assert {r["decoded"] for r in sentencepiece.decode(odd, model).collect()} == {"⁇  ⁇ ", ""}


def test_memory_of_units_stays_bounded(model, monkeypatch):
    monkeypatch.setattr(sentencepiece, "MEMORY", 50)
    e = sentencepiece.Encoder(model)
    texts = [f"word{i} and {i * 7} others" for i in range(300)]
    for i in range(0, 300, 20):
        part = pa.array(texts[i : i + 20])
        assert [x.decode() for x in sentencepiece.decode_lists(e.encode(part), model)] == texts[i : i + 20]


def test_query_round_trips(spark, small):
    rows = QUERIES["op7_sentencepiece"](spark, small).collect()
    assert len(rows) == 200 and all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in rows)


def test_fingerprint_query(spark, small):
    rows = QUERIES["op5_fingerprints"](spark, small).collect()
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    want = {}
    for (i, t), (_, follow) in zip(docs, docs[1:] + docs[:1], strict=True):
        q = len(t) // 4
        want[i] = hashlib.sha256((t[: len(t) - q] + follow[:q]).encode()).hexdigest()
    assert {r["doc_id"]: r["edited_sha256"] for r in rows} == want
    # likeness against the true Jaccard similarity of all pairs
    heads, errors = {r["doc_id"]: r for r in rows}, []
    for (i, t), (_, follow) in zip(docs, docs[1:] + docs[:1], strict=True):
        q = len(t) // 4
        a, b, c = (plain.shingle_set(x, 5, fold=False) for x in (t, t[: len(t) - q] + follow[:q], follow))
        for x, name in ((b, "near_edited"), (c, "near_next")):
            errors.append(abs(heads[i][name] - (len(a & x) / len(a | x) if a | x else 1.0)))
    assert max(errors) < 0.2 and np.mean(errors) < 0.03
    by_text = {}
    texts = dict(docs)
    for r in rows:
        assert by_text.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def test_pipeline_stages(spark):
    """Each stage's rows against a plain version, on the stage's own input."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before, seen = docs.columns, docs.collect(), {}
    given = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        given[name], seen[name] = before, out.collect()
        if name != "sentencepiece":
            assert out.columns == columns
        docs, before = spark.createDataFrame(seen[name], out.schema), seen[name]
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    raw = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {r["doc_id"] for r in toxicity.score(raw, toxicity.fit(raw, marks)).collect() if r["score"] >= 0.7}
    assert {r["doc_id"] for r in seen["toxicity"]} == {r["doc_id"] for r in given["toxicity"]} - toxic
    gone = plain.line_dedup([(r["doc_id"], r["text"]) for r in given["line_dedup"]], 40)
    want = {}
    for r in given["line_dedup"]:
        text = "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in gone[r["doc_id"]])
        if not gone[r["doc_id"]] or text.strip(" "):
            want[r["doc_id"]] = (text, len(text))
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in seen["line_dedup"]} == want
    near = plain.near_duplicates([(r["doc_id"], r["text"]) for r in given["near_dedup"]], 5, 80)
    assert {r["doc_id"] for r in seen["near_dedup"]} == {d for d, _, _, kept in near if kept}
    sizes, mixed, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in given["source_mixing"]:
        sizes[r["source"]] += len(plain.words(r["text"]))
        longest[r["source"]] = max(longest[r["source"]], len(plain.words(r["text"])))
    for r in seen["source_mixing"]:
        mixed[r["source"]] += len(plain.words(r["text"]))
    for source, target in plain.targets(dict(sizes)).items():
        assert abs(mixed[source] - target) <= 2 * longest[source] + 0.1 * target, source
    assert max(Counter(r["doc_id"] for r in seen["source_mixing"]).values()) <= 2
    assert all(r["n_pieces"] == len(r["ids"]) for r in seen["sentencepiece"])
    assert Counter(r["doc_id"] for r in seen["sentencepiece"]) == Counter(r["doc_id"] for r in seen["source_mixing"])
    assert corpus_pipeline.run(spark, folder).count() == len(seen["sentencepiece"])
