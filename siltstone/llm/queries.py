"""Queries of the training-data operators over the given tables, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, fingerprints, importance, line_dedup, near_dedup, phrases, quality, sentencepiece, source_mixing, substring_dedup, token_counts, topk_search, toxicity
from siltstone.llm.workspace import fresh_path

#: The SentencePiece model that op7 and the pipeline read; a parameter, never copied here.
MODEL_FILE = os.environ.get("SILTSTONE_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.array_join(F.transform("removed_lines", lambda x: x.cast("string")), ",").alias("removed_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("repeats").alias("n_repeats"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), 20, 20)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fingerprints.fingerprints_with_next(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_checked(table(spark, sf_dir, "documents"), sentencepiece.load(MODEL_FILE))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive, those with repeated lines get revised counts, those labelled of no quality go; each batch comes twice."""
    docs = table(spark, sf_dir, "documents")
    rollup = token_counts.Rollup(spark, fresh_path(spark, "token-counts"))
    lines = F.split("text", "\n", -1)
    distinct = F.array_join(F.array_distinct(lines), "\n")
    bad = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id").distinct()
    load = token_counts.events(docs, "insert", 0, F.col("text"))
    revised = token_counts.events(docs.filter(F.size(F.array_distinct(lines)) < F.size(lines)), "revise", 1, distinct)
    removed = token_counts.events(docs.join(bad, "doc_id", "left_semi").withColumn("text", F.lit(None).cast("string")), "delete", 2, F.col("text"))
    for name, batch in (("load", load), ("load", load), ("revise", revised), ("remove", removed), ("revise", revised)):
        rollup.apply(name, batch)
    return rollup.totals()


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample_towards(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_COUNT = "len(regexp_extract_all({text}, '{pattern}'))"
_LINES = "string_split(text, chr(10))"


def _oracle_token_counts() -> str:
    versions = " UNION ALL ".join(
        f"SELECT doc_id, source, lang, '{name}' AS tokenizer, text IS NOT NULL AND len(list_distinct({_LINES})) < len({_LINES}) AS revised, "
        f"coalesce({_COUNT.format(text='text', pattern=pattern)}, 0) AS a, coalesce({_COUNT.format(text='text2', pattern=pattern)}, 0) AS b FROM d"
        for name, pattern in token_counts.TOKENIZERS.items()
    )
    return f"""
WITH l AS (SELECT doc_id, text, source, lang, unnest({_LINES}) AS line, unnest(range(len({_LINES}))) AS i FROM documents),
f AS (SELECT doc_id, line, min(i) AS i FROM l GROUP BY doc_id, line),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text2 FROM f GROUP BY doc_id),
d AS (SELECT doc_id, text, text2, source, lang FROM documents LEFT JOIN t USING (doc_id)),
v AS ({versions}),
e AS (SELECT v.*, doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS gone FROM v)
SELECT source, lang, tokenizer, CAST(sum(CASE WHEN gone THEN 0 ELSE 1 END) AS BIGINT) AS docs,
 CAST(sum(CASE WHEN gone THEN 0 WHEN revised THEN b ELSE a END) AS BIGINT) AS tokens, CAST(count(*) AS BIGINT) AS inserts,
 CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS deletes, CAST(sum(CASE WHEN revised THEN 1 ELSE 0 END) AS BIGINT) AS revisions
FROM e GROUP BY source, lang, tokenizer
"""


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, trim(unnest(a), ' ') AS x, unnest(range(len(a))) AS i FROM d),
u AS (SELECT *, length(x) AS n, CAST(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto FROM l),
e AS (SELECT doc_id, upto, min(i) AS i FROM u GROUP BY doc_id, upto),
b AS (SELECT doc_id, upto - n AS before, max(i) AS i FROM u GROUP BY doc_id, upto - n),
s AS (SELECT u.doc_id, u.i AS low, e.i AS high FROM u ASOF JOIN e ON u.doc_id = e.doc_id AND u.upto - u.n + 40 <= e.upto
 UNION SELECT u.doc_id, b.i, u.i FROM u ASOF JOIN b ON u.doc_id = b.doc_id AND u.upto - 40 >= b.before),
t AS (SELECT doc_id, list_transform(a, lambda y: trim(y, ' ')) AS x FROM d),
r AS (SELECT s.doc_id, low, high, array_to_string(x[low + 1 : high + 1], chr(10)) AS run FROM s JOIN t ON s.doc_id = t.doc_id),
f AS (SELECT run, min(doc_id) AS first FROM r GROUP BY run),
g AS (SELECT doc_id, list_sort(list(DISTINCT i)) AS gone FROM (SELECT r.doc_id, unnest(range(low, high + 1)) AS i FROM r JOIN f ON r.run = f.run WHERE r.doc_id > f.first) GROUP BY doc_id)
SELECT o.doc_id, CAST(coalesce(len(a), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
 coalesce(array_to_string(gone, ','), '') AS removed_lines,
 sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda k: NOT list_contains(coalesce(gone, []), k - 1)), lambda k: a[k]), chr(10)), '')) AS kept_sha256
FROM documents o LEFT JOIN d ON d.doc_id = o.doc_id LEFT JOIN g ON g.doc_id = o.doc_id
""",
    "op2_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(len(w) - 34)) AS i FROM d WHERE len(w) >= 35),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i + 1 : i + 35], ' ')) AS h FROM s),
r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM g JOIN r USING (h)) GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(gone, []) AS gone, w FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
e AS (SELECT doc_id, n, list_sort(gone) AS gone, w FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
 sha256(array_to_string(list_transform(list_filter(range(1, n + 1), lambda x: NOT list_contains(gone, x - 1)), lambda x: w[x]), ' ')) AS kept_sha256,
 CAST(len(list_filter(gone, lambda x: NOT list_contains(gone, x - 1))) AS INTEGER) AS n_repeats
FROM e
""",
    "op4_topk_search": """
WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM f a JOIN f b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op8_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= 85 * (a.n + b.n - m)),
c(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT c.x, l.y FROM c JOIN l ON l.x = c.y),
m AS (SELECT x, min(y) AS component_id FROM c GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN m ON m.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op10_token_counts": _oracle_token_counts(),
    "op11_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_FOLDED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
m AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
i AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, w[i : i + k - 1] AS w, count(*) AS a FROM i GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, w, a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.k, c.w, c.a, cut, x.a AS l, y.a AS r, CAST(CAST(c.a AS HUGEINT) * 2000000 // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
 FROM c JOIN f x ON x.lang = c.lang AND x.w = c.w[1 : cut] JOIN f y ON y.lang = c.lang AND y.w = c.w[cut + 1 : c.k]),
b AS (SELECT lang, k, w, a, arg_min(struct_pack(l := l, r := r, score := score), struct_pack(score := score, cut := cut)) AS o FROM s GROUP BY lang, k, w, a),
o AS (SELECT lang, k, a AS longer, w, unnest(range(2, k)) AS m FROM f WHERE k > 2),
e AS (SELECT lang, longer, m, w, unnest(range(1, k - m + 2)) AS i FROM o),
z AS (SELECT lang, w[i : i + m - 1] AS w, max(longer) AS longer FROM e GROUP BY ALL),
t AS (SELECT b.lang, array_to_string(b.w, ' ') AS phrase, a, o.l AS l, o.r AS r, o.score AS score FROM b LEFT JOIN z ON z.lang = b.lang AND z.w = b.w WHERE longer IS NULL OR CAST(longer AS HUGEINT) * 100 < CAST(a AS HUGEINT) * 80),
k AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM t)
SELECT k.lang, rank, phrase, a, l, r, n, score FROM k JOIN m USING (lang) WHERE rank <= 2000
""",
    # the CRC is the sum (xor) of what each byte adds with so many bytes after it, and that of as many zero bytes
    "op12_importance_resampling": f"""
WITH RECURSIVE g(b, v, i) AS (SELECT b, b, 0 FROM range(256) r(b) UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM g WHERE i < 8),
c AS (SELECT b, v FROM g WHERE i = 8),
p(b, v, d) AS (SELECT b, v, 0 FROM c UNION ALL SELECT p.b, xor(p.v >> 8, c.v), d + 1 FROM p JOIN c ON c.b = p.v % 256 WHERE d < 1000),
z(v, n) AS (SELECT 4294967295::BIGINT, 0 UNION ALL SELECT xor(z.v >> 8, c.v), n + 1 FROM z JOIN c ON c.b = z.v % 256 WHERE n < 1001),
o AS (SELECT true AS doc, doc_id AS id, {_LETTERS} AS w FROM documents UNION ALL SELECT false, item_id, {_LETTERS} FROM benchmark),
i AS (SELECT doc, id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM o, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
f AS (SELECT doc, id, array_to_string(w[i : i + k - 1], ' ') AS f, count(*) AS n FROM i GROUP BY ALL),
h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
e AS (SELECT f, len(h) // 2 AS n, h, unnest(range(len(h) // 2)) AS i FROM h),
x AS (SELECT f, n, bit_xor(v) AS v FROM e JOIN p ON d = n - 1 - i AND printf('%02X', b) = h[2 * i + 1 : 2 * i + 2] GROUP BY f, n),
u AS (SELECT f, xor(xor(x.v, z.v), 4294967295) % 10000 AS bucket FROM x JOIN z USING (n)),
n AS (SELECT bucket, sum(CASE WHEN doc THEN n ELSE 0 END)::DOUBLE AS s, sum(CASE WHEN doc THEN 0 ELSE n END)::DOUBLE AS t FROM f JOIN u USING (f) GROUP BY bucket),
m AS (SELECT sum(s) AS s, sum(t) AS t FROM n),
a AS (SELECT bucket, floor(1000 * ln((n.t + 1) * (m.s + 10000) / ((n.s + 1) * (m.t + 10000))))::BIGINT AS gain FROM n, m),
w AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM f JOIN u USING (f) JOIN a USING (bucket) WHERE doc GROUP BY id),
r AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len({_LETTERS}) >= 20 AS fit,
 coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN w ON id = doc_id),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE fit),
l AS (SELECT 5 * count(*) // 100 AS draw FROM r WHERE fit)
SELECT r.doc_id, n_features, weight, score, CASE WHEN rank <= draw THEN rank END AS rank FROM r LEFT JOIN k USING (doc_id), l
""",
    "op13_decontamination": f"""
WITH d AS (SELECT doc_id, {_LETTERS} AS w FROM documents),
b AS (SELECT item_id, {_LETTERS} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, win FROM (SELECT item_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [w] ELSE list_transform(range(1, len(w) - 8), lambda i: w[i : i + 9]) END AS a FROM b), unnest(a) AS x(win)),
s AS (SELECT DISTINCT len(win) AS size FROM v),
o AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, s WHERE len(w) >= size),
h AS (SELECT doc_id, i, size, item_id FROM o JOIN v ON w[i : i + size - 1] = win),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, len(coalesce(ids, []))::BIGINT AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
""",
}

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_substring_dedup, op3_source_mixing, op4_topk_search, op5_fingerprints, op6_toxicity, op7_sentencepiece, op8_near_dedup, op9_quality_classifier, op10_token_counts, op11_collocations, op12_importance_resampling, op13_decontamination)}
