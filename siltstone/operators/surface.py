"""Attack surface: shards, coverage, components, traffic and file risk."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from siltstone.functions import scores
from siltstone.functions.text import chain_id, component_of, language_of, norm_path, query_names, slug, subsystem_key, url_path
from siltstone.operators.ranking import placed
from siltstone.operators.scan import NATIVE_FILES
from siltstone.operators.spans import enclosing
from siltstone.operators.stores import written

#: Globs of files that no scan reads, as one pattern.
EXCLUDED = r"^(\.git|\.joern)/|(^|/)(node_modules|build|dist|poc|apktool_out)/|(^|/)target/(debug|release)/|^(GPATH|GTAGS|GRTAGS)$"
#: Path words of files that deal with input, and of code that guards.
INPUT_PATH = r"(?i)(pars(e|er)|lex(er)?|tokeniz|scanner|decode|decoder|deserial|unmarshal|unpack|inflate|unzip|\bvm\b|interp|bytecode|codec|reader|loader|protocol)"
GUARD_PATH = r"(?i)(auth|login|logout|session|token|password|passwd|cred|secret|crypto|cipher|hash|jwt|oauth|saml|admin|payment|billing|charge|checkout|order|invoice|upload|download|exec|command|shell|spawn|query|\bsql\b|database|\bdb\b|deserial|pickle|yaml|xml|template|render|redirect|cors|csrf|permission|role|\bacl\b|tenant|account|\buser\b|route|controller|handler|middleware|validate|sanitiz|escape|webhook|ingest|parse)"


def inventory(files: DataFrame) -> DataFrame:
    """Source files by language: ``repo, language, n_files, bytes``; excluded folders and unknown suffixes go."""
    p = norm_path(F.col("path"))
    rows = files.select("repo", p.alias("path"), language_of(p).alias("language"), "bytes").filter(~F.col("path").rlike(EXCLUDED) & (F.col("language") != "Other"))
    return rows.groupBy("repo", "language").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"))


def shard_files(files: DataFrame, most: int = 60) -> DataFrame:
    """``repo, path, dir, shard_id``: the shard of every distinct file.

    Files go by top folder, in runs of at most ``most`` by path.  A folder that fits
    keeps its name; the runs of a larger one are numbered from 1.  Places in a folder
    are found by pieces of its paths, so a folder of any size is no one task's.
    """
    p = norm_path(F.col("path"))
    top = F.when(F.instr(p, "/") > 0, F.substring_index(p, "/", 1)).otherwise("(root)")
    rows = written(files.select("repo", p.alias("path"), top.alias("dir")).distinct(), "files")
    sizes = rows.groupBy("repo", "dir").agg(F.count("*").alias("n"))
    at = placed(rows, ["repo", "dir"], [], "path", "at", prefix=24).join(sizes, ["repo", "dir"])
    part = F.ceil(F.col("at") / most).cast("string")
    name = F.when(F.col("n") > most, F.concat(slug(F.col("dir")), F.lit("__"), part)).otherwise(slug(F.col("dir")))
    return at.select("repo", "path", "dir", name.alias("shard_id"))


def shards(files: DataFrame, most: int = 60) -> DataFrame:
    """``repo, shard_id, dir, n_files, first_path, by_language``: shards with their files counted by language."""
    rows = shard_files(files, most).withColumn("language", language_of(F.col("path")))
    each = rows.groupBy("repo", "shard_id", "dir", "language").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    counts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("language", "n"))), lambda x: F.concat(x["language"], F.lit(":"), x["n"].cast("string"))), ",")
    return each.groupBy("repo", "shard_id", "dir").agg(F.sum("n").alias("n_files"), F.min("first").alias("first_path"), counts.alias("by_language"))


def coverage(shard_rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row a repo: files in shards with a job and without, the covered per cent, 100 for no files, and the producers of the whole repo."""
    done = jobs.filter("scope = 'shard'").select("repo", "shard_id").distinct().withColumn("c", F.lit(True))
    met = shard_rows.join(done, ["repo", "shard_id"], "left")
    agg = met.groupBy("repo").agg(F.sum("n_files").alias("files"), F.coalesce(F.sum(F.when(F.col("c"), F.col("n_files"))), F.lit(0)).alias("covered"))
    whole = jobs.filter("scope = 'repo'").groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("producer")), ",").alias("repo_producers"))
    pct = F.when(F.col("files") == 0, 100.0).otherwise(F.round(F.col("covered") * 100 / F.col("files"), 1))
    return agg.join(whole, "repo", "left").select("repo", "files", "covered", (F.col("files") - F.col("covered")).alias("uncovered"), pct.alias("pct"), F.coalesce("repo_producers", F.lit("")).alias("repo_producers"))


def shard_coverage(files: DataFrame, jobs: DataFrame, most: int = 60, sample: int = 5) -> DataFrame:
    """``repo, shard_id, n_files, covered, producers, sample_files``: each shard's producers, and the first files of one without any."""
    rows = shard_files(files, most)
    by = jobs.filter("scope = 'shard'").groupBy("repo", "shard_id").agg(F.array_join(F.array_sort(F.collect_set("producer")), ",").alias("producers"))
    first = F.row_number().over(Window.partitionBy("repo", "shard_id").orderBy("path"))  # a shard is small
    met = rows.withColumn("at", first).groupBy("repo", "shard_id").agg(F.count("*").alias("n_files"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("at") <= sample, F.col("path")))), lambda x: x), ",").alias("first"))
    done = F.col("producers").isNotNull()
    return met.join(by, ["repo", "shard_id"], "left").select("repo", "shard_id", "n_files", done.alias("covered"), F.coalesce("producers", F.lit("")).alias("producers"), F.when(~done, F.col("first")).otherwise("").alias("sample_files"))


def uncovered(shard_rows: DataFrame, jobs: DataFrame) -> DataFrame:
    return shard_rows.join(jobs.filter("scope = 'shard'"), ["repo", "shard_id"], "left_anti")


def partitions(entries: DataFrame, most: int = 6) -> DataFrame:
    """``repo, label, size, n_kinds``: entry points by component, the tail beyond ``most`` merged into other."""
    rows = entries.withColumn("component", component_of(F.col("path")))
    sized = rows.groupBy("repo", "component").agg(F.count("*").alias("size"))
    w = Window.partitionBy("repo")
    ordered = sized.withColumn("place", F.row_number().over(w.orderBy(F.desc("size"), "component"))).withColumn("n", F.count("*").over(w))
    label = F.when((F.col("n") > most) & (F.col("place") > most - 1), "other").otherwise(F.col("component"))
    named = rows.join(ordered.select("repo", "component", label.alias("label")), ["repo", "component"])
    return named.groupBy("repo", "label").agg(F.count("*").alias("size"), F.countDistinct("kind").alias("n_kinds"))


#: Suffixes of native sources.
NATIVE_SOURCES = r"(?i)\.(c|h|cc|cpp|cxx|hpp|hh|m|rs)$"


def subsystems(file_scores: DataFrame, limit: int = 15, most: int = 60, native: bool = False) -> DataFrame:
    """Each repo's ``limit`` subsystems of the greatest score, of files that can be reached.

    ``file_scores(repo, path, score, reachable, reason)``, one row a reason.  A
    subsystem has its distinct reasons, its number of files and the first ``most`` paths;
    ``tail`` is the number of the repo's subsystems beyond the limit.  With ``native``
    the same subsystems keep their native sources only, and those without any go.
    """
    rows = written(file_scores.filter("reachable").withColumn("subsystem", subsystem_key(F.col("path"))), "reachable")
    agg = rows.groupBy("repo", "subsystem").agg(F.sum("score").alias("score"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    ranked = written(placed(agg, ["repo"], [("score", True)], "subsystem", prefix=8), "subsystems")
    tail = ranked.groupBy("repo").agg(F.greatest(F.lit(0), F.count("*") - limit).alias("tail"))
    first = ranked.filter(F.col("place") <= limit)
    files = placed(rows.join(first.select("repo", "subsystem"), ["repo", "subsystem"], "left_semi").select("repo", "subsystem", "path").distinct(), ["repo", "subsystem"], [], "path", "k", prefix=24)
    shown = F.col("k") <= most
    if native:
        files, shown = files.filter(shown & F.col("path").rlike(NATIVE_SOURCES)), F.lit(True)
    paths = files.groupBy("repo", "subsystem").agg(F.count("*").alias("n_files"), F.array_join(F.array_sort(F.collect_list(F.when(shown, F.col("path")))), ",").alias("paths"))
    return first.join(paths, ["repo", "subsystem"]).join(tail, "repo").select("repo", "subsystem", "score", "reasons", "n_files", "paths", "place", "tail")


def endpoints(requests: DataFrame) -> DataFrame:
    """``repo, method, path, n, params, has_cookies``: requests by method and path."""
    rows = requests.select("repo", F.upper("method").alias("method"), url_path(F.col("url")).alias("path"), query_names(F.col("url")).alias("q"), "has_cookies")
    return rows.groupBy("repo", "method", "path").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("q")))), ",").alias("params"), F.bool_or("has_cookies").alias("has_cookies"))


def file_risk(files: DataFrame, features: DataFrame, limit: int | None = None) -> DataFrame:
    """``repo, path, score, reasons, place``: files by an additive score.

    ``features(repo, path, entry_defs, calls, entry, route, dispatch, boundary, dataflow,
    churn)`` has one row a file at most.
    """
    f = files.join(features, ["repo", "path"], "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    defs = F.when(F.coalesce("entry_defs", F.lit(0)) > 0, F.least(F.lit(7), F.col("entry_defs") + 3)).otherwise(0)
    parts = [
        ("entry-defs", defs),
        ("reach", scores.reach_score(F.col("calls"))),
        ("entry-point", F.when(has("entry"), 4).otherwise(0)),
        ("route", F.when(has("route"), 4).otherwise(0)),
        ("dispatch-entry", F.when(has("dispatch"), 6).otherwise(0)),
        ("trust-boundary", F.when(has("boundary"), 3).otherwise(0)),
        ("dataflow-reach", F.when(has("dataflow"), 5).otherwise(0)),
        ("churn", F.when(has("churn"), 2).otherwise(0)),
        ("input", F.when(F.col("path").rlike(INPUT_PATH), 5).otherwise(0)),
        ("guard", F.when(F.col("path").rlike(GUARD_PATH), 1).otherwise(0)),
    ]
    total = parts[0][1]
    for _, p in parts[1:]:
        total = total + p
    reasons = F.array_join(F.array_compact(F.array(*[F.when(p > 0, F.lit(n)) for n, p in parts])), ",")
    rows = f.select("repo", "path", total.cast("int").alias("score"), reasons.alias("reasons"))
    if not limit:
        return placed(rows, ["repo"], [("score", True)], "path", prefix=8)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("score"), "path"))).filter(F.col("place") <= limit)


#: Weight of an obligation's class; 5 for others.
CLASS_WEIGHTS = {
    "lifetime-free": 10, "int-overflow-size": 10, "command-exec": 10, "deserialization": 9, "dynamic-eval": 9, "raw-copy": 8, "gc-rooting": 8, "sql-sink": 8,
    "object-authz": 7, "fixed-size-buffer": 6, "alloc-arith": 6, "path-fs": 6, "ssrf": 6, "template-xss": 6, "authz-decision": 6, "open-redirect": 2,
}


def obligations_ranked(obligations: DataFrame, file_scores: DataFrame, budget: int = 120) -> DataFrame:
    """``repo, path, line, kind, priority, place``: each repo's ``budget`` most pressing obligations."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in CLASS_WEIGHTS.items() for x in p]), F.col("kind")), F.lit(5))
    rows = obligations.join(file_scores.select("repo", "path", "score"), ["repo", "path"], "left")
    rows = rows.select("repo", "path", "line", "kind", (weight + scores.reach_boost(F.col("score"))).cast("int").alias("priority"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("priority"), "path", "line", "kind"))).filter(F.col("place") <= budget)


def chains(members: DataFrame, findings: DataFrame, claimed: DataFrame) -> DataFrame:
    """``chain, repo, chain_id, n_members, kind, severity``: each group of at least two distinct members.

    ``members(chain, fingerprint)``, ``claimed(chain, claimed, kind, entry_point, asset)``: a
    severity, high by default, and what the chain is.  A chain is as severe as claimed or
    as its worst member; without a kind it is an attack path if it names an entry point
    or an asset, else a composition.  A chain with a member that isn't a finding is left
    out.  A chain is named by a digest of all its members, so their fingerprints are held
    together: it is the work of one review.
    """
    known = findings.groupBy("fingerprint").agg(F.min("repo").alias("repo"), F.max(F.coalesce(scores.level(F.col("severity")), F.lit(0))).alias("level"))
    met = members.distinct().join(known, "fingerprint", "left")
    agg = met.groupBy("chain").agg(F.min("repo").alias("repo"), F.collect_set("fingerprint").alias("m"), F.max("level").alias("worst"), F.bool_and(F.col("level").isNotNull()).alias("sound"))
    full = agg.filter(F.col("sound") & (F.size("m") >= 2)).join(claimed, "chain", "left")
    level = F.greatest(F.col("worst"), F.coalesce(scores.level(F.col("claimed")), scores.level(F.lit("high"))))
    some = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    kind = F.coalesce("kind", F.when(some("entry_point") | some("asset"), "attack-path").otherwise("composition"))
    return full.select("chain", "repo", chain_id(F.col("m")).alias("chain_id"), F.size("m").alias("n_members"), kind.alias("kind"), scores.level_name(level).alias("severity"))


def chain_labels(built: DataFrame, members: DataFrame) -> DataFrame:
    """``repo, fingerprint, labels``: each finding's chains, as C-1, C-2 and so on by severity, then id, in each repo."""
    ranked = placed(built.withColumn("level", scores.level(F.col("severity"))), ["repo"], [("level", True)], "chain_id", prefix=8)
    label = F.concat(F.lit("C-"), F.col("place").cast("string"))
    met = members.distinct().join(ranked.select("chain", "repo", "place", label.alias("label")), "chain")
    return met.groupBy("repo", "fingerprint").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]), ",").alias("labels"))


#: Pattern, weight and tag of what a change touches.
TOUCHED = (
    (r"(auth|login|session|token|passwd|password|jwt|oauth|saml)", 5, "auth"),
    (r"(crypto|cipher|encrypt|decrypt|hash|hmac|signature|tls|ssl)", 5, "crypto"),
    (r"(payment|billing|charge|refund|wallet|transfer|balance|ledger)", 5, "value-transfer"),
    (r"(exec|spawn|shell|subprocess|eval|deserialize|pickle|unmarshal|yaml\.load)", 4, "exec/deser"),
    (r"(sql|query|db|database|orm)", 3, "data-access"),
    (r"(upload|file|path|fs\.|os\.)", 2, "fs"),
    (r"(cors|csrf|origin|header|cookie|middleware)", 3, "web-guard"),
)


@F.arrow_udf(IntegerType())
def _touched(hay: pa.Array) -> pa.Array:
    """The patterns of TOUCHED that each text matches in any case, as bits; all of them in time that grows with the text only."""
    bits = np.zeros(len(hay), dtype=np.int32)
    for i, (pattern, _, _) in enumerate(TOUCHED):
        bits |= pc.fill_null(pc.match_substring_regex(hay, pattern, ignore_case=True), False).to_numpy(zero_copy_only=False).astype(np.int32) << i
    return pa.array(bits)


def diff_risk(path: Column, text: Column) -> Column:
    """struct(score, tags) of a change by the words of its path and text."""
    bits = _touched(F.concat_ws("\n", path, text))
    hits = [(bits.bitwiseAND(1 << i) != 0, w, t) for i, (_, w, t) in enumerate(TOUCHED)]
    score = F.lit(0)
    for h, w, _ in hits:
        score = score + F.when(h, w).otherwise(0)
    return F.struct(score.alias("score"), F.array_join(F.array_compact(F.array(*[F.when(h, F.lit(t)) for h, _, t in hits])), ",").alias("tags"))


#: Files that tell what a folder is built with.
MARKERS = (("package.json", "node"), ("go.mod", "go"), ("Cargo.toml", "rust"), ("pom.xml", "java"), ("requirements.txt", "python"), ("CMakeLists.txt", "native"), ("Dockerfile", "container"))


def component_markers(files: DataFrame) -> DataFrame:
    """``repo, marker, role, n, first_paths``: marker files, how many and the first five paths."""
    p = norm_path(F.col("path"))
    base = F.substring_index(p, "/", -1)
    role = F.lit(None).cast("string")
    for name, kind in MARKERS:
        role = F.when(base == name, F.lit(kind)).otherwise(role)
    rows = files.select("repo", p.alias("path"), base.alias("marker"), role.alias("role")).filter("role is not null").distinct()
    n = F.row_number().over(Window.partitionBy("repo", "marker").orderBy("path"))
    few = rows.withColumn("k", n)
    return few.groupBy("repo", "marker", "role").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.col("path")))), ",").alias("first_paths"))


def memory_dirs(scored: DataFrame, budget: int = 25, most: int = 10, largest: int = 150) -> DataFrame:
    """``repo, dir, input, native, place``: folders whose files a budget leaves unread, by how many deal with input, then how many are native.

    ``scored(repo, path, score)``; folders of more than ``largest`` files are left out.
    """
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    below, reads = F.col("rn") > budget, F.col("path").rlike(INPUT_PATH)
    ranked = placed(written(scored, "scored"), ["repo"], [("score", True)], "path", "rn", prefix=12)
    agg = ranked.groupBy("repo", folder.alias("dir")).agg(F.count("*").alias("files"), F.count_if(below & reads).alias("input"), F.count_if(below & ~reads & F.col("path").rlike(NATIVE_FILES)).alias("native"))
    left = written(agg.filter((F.col("files") <= largest) & (F.col("input") + F.col("native") > 0)), "folders")
    return placed(left, ["repo"], [("input", True), ("native", True)], "dir", prefix=12).filter(F.col("place") <= most).select("repo", "dir", "input", "native", "place")


def slices(lines: DataFrame, obligations: DataFrame, most: int = 80) -> DataFrame:
    """``repo, path, line, kind, first, last, truncated``: each obligation's excerpt, as places in its file.

    It is the enclosing block or, without one, what lies around the line; of more
    than ``most`` lines those about the obligation.
    """
    counted = lines.withColumn("k", F.row_number().over(Window.partitionBy("repo", "path").orderBy("line")))
    at = obligations.groupBy("repo", "path", "line").agg(F.min("kind").alias("kind"))
    # blocks are looked for in the obligations' files only
    counted = written(counted.join(at.select("repo", "path").distinct(), ["repo", "path"], "left_semi"), "numbered")
    points = at.join(counted.select("repo", "path", "line", "k"), ["repo", "path", "line"]).select("repo", "path", F.col("k").alias("line"), F.col("line").alias("own"), "kind")
    met = enclosing(points, counted.select("repo", "path", F.col("k").alias("line"), "text"))
    long = F.col("last") - F.col("first") + 1 > most
    first = F.when(long, F.least(F.greatest(F.col("first"), F.col("line") - most // 2), F.col("last") - (most - 1))).otherwise(F.col("first"))
    last = F.when(long, first + (most - 1)).otherwise(F.col("last"))
    return met.select("repo", "path", F.col("own").alias("line"), "kind", first.cast("int").alias("first"), last.cast("int").alias("last"), long.alias("truncated"))
