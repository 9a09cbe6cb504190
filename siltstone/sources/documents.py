"""JSON documents of scanners, browsers and models as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import query_names, url_path

_SCAN = "results array<struct<check_id:string,path:string,start:struct<line:long>,end:struct<line:long>,extra:struct<severity:string,message:string,lines:string>>>"
_HAR = "log struct<entries:array<struct<request:struct<method:string,url:string,headers:array<struct<name:string,value:string>>,postData:struct<text:string>>>>>"
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def scanner_results(docs: DataFrame, column: str = "json") -> DataFrame:
    """``rule_id, severity, message, file_path, start_line, end_line`` of a scanner's documents; the default severity is INFO."""
    r = docs.select(F.explode(F.from_json(column, _SCAN)["results"]).alias("r"))
    return r.select(F.col("r.check_id").alias("rule_id"), F.coalesce("r.extra.severity", F.lit("INFO")).alias("severity"), F.coalesce("r.extra.message", F.lit("")).alias("message"), F.col("r.path").alias("file_path"), F.col("r.start.line").alias("start_line"), F.coalesce("r.end.line", "r.start.line").alias("end_line"))


def http_archive(docs: DataFrame, column: str = "json") -> DataFrame:
    """``method, path, params, body_params, has_cookies`` of the requests in HTTP archives; JSON bodies have no parameters."""
    e = docs.select(F.explode(F.from_json(column, _HAR)["log"]["entries"]).alias("e")).select("e.request.*")
    body = F.coalesce("postData.text", F.lit(""))
    pairs = F.when(F.ltrim(body).startswith("{") | (body == ""), F.array().cast("array<string>")).otherwise(F.transform(F.split(body, "&"), lambda x: F.substring_index(x, "=", 1)))
    return e.select(
        F.upper(F.coalesce("method", F.lit("GET"))).alias("method"), url_path(F.col("url")).alias("path"), F.array_join(query_names(F.col("url")), ",").alias("params"), F.array_join(F.array_sort(F.array_distinct(pairs)), ",").alias("body_params"),
        F.coalesce(F.exists("headers", lambda h: F.lower(h["name"]) == "cookie"), F.lit(False)).alias("has_cookies"),
    )


def openapi_routes(docs: DataFrame, key: str, column: str = "json") -> DataFrame:
    """``key, method, path`` of OpenAPI documents; members of a path that aren't methods are left out."""
    paths = docs.select(key, F.explode(F.from_json(column, "paths map<string,map<string,string>>")["paths"]).alias("path", "ops"))
    ops = paths.select(key, "path", F.explode(F.map_keys("ops")).alias("m"))
    return ops.filter(F.lower("m").isin(*METHODS)).select(key, F.upper("m").alias("method"), "path")


def tolerant_records(lines: DataFrame, schema: str, column: str = "line") -> DataFrame:
    """Records of a JSON log, one a line; torn lines and those that aren't objects are skipped."""
    r = lines.select(F.from_json(column, schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return r.filter("r is not null and r._bad is null").select("r.*").drop("_bad")


def model_json(text: Column) -> Column:
    """The JSON object in a model's answer: that in a fence, else from the first brace to the last; null without one."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(bare, F.lit("")))


_FINDINGS = "findings array<struct<fingerprint:string,source:string,title:string,severity:string,status:string>>"
_ITEM = "item struct<url:string,method:string,request:struct<_VALUE:string,_base64:string>>"
_VOTES = "lens string, candidates array<struct<fingerprint:string,verdict:string,rationale:string,confidence:double>>"
#: Verdicts of a vote.
VOTES = ("confirmed-exploitable", "not-exploitable", "inconclusive")
#: The first four bytes of programs, in hexadecimal; PE files need but two.
MACH = ("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE", "BEBAFECA")
#: Keys whose lists of strings name files.
FILE_LISTS = ("candidateFiles", "files", "sinks", "sources")


def findings_document(docs: DataFrame, column: str = "json") -> DataFrame:
    """Rows of findings documents; a document that can't be read, or without findings, has none."""
    r = docs.select(F.explode(F.from_json(column, _FINDINGS)["findings"]).alias("f"))
    return r.select("f.*").filter("fingerprint is not null")


def proxy_export(docs: DataFrame, column: str = "xml") -> DataFrame:
    """``method, path, params, body_params, has_cookies`` of the items in a proxy's export, one item a row.

    A request that is marked as base64 is decoded; its body is what follows the empty
    line, and a body that is JSON or has no equals sign has no parameters.
    """
    r = docs.select(F.from_xml(F.concat(F.lit("<r>"), column, F.lit("</r>")), _ITEM)["item"].alias("i")).select("i.*").filter("url is not null")
    raw = F.when(F.col("request._base64") == "true", F.try_to_binary(F.trim("request._VALUE"), F.lit("base64")).cast("string")).otherwise(F.col("request._VALUE"))
    body = F.coalesce(F.get(F.split(raw, "\r?\n\r?\n", 2), 1), F.lit(""))
    names = F.filter(F.transform(F.split(body, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: (x != "") & (F.length(x) < 60))
    has = F.contains(body, F.lit("=")) & ~F.startswith(F.ltrim(body), F.lit("{"))
    return r.select(
        F.coalesce(F.upper("method"), F.lit("GET")).alias("method"), url_path(F.col("url")).alias("path"), F.array_join(query_names(F.col("url")), ",").alias("params"),
        F.when(has, F.array_join(names, ",")).otherwise("").alias("body_params"), F.coalesce(raw.rlike(r"(?i)(^|\n)cookie:"), F.lit(False)).alias("has_cookies"),
    )


def yaml_routes(lines: DataFrame, key: str) -> DataFrame:
    """``key, method, path`` of OpenAPI documents in YAML, from their numbered lines, by indent.

    A path opens in the block under ``paths:`` on the indent of its first line; a
    method counts under it on a deeper one.  A line on the margin ends the block.
    """
    from pyspark.sql import Window

    bare = F.regexp_replace("text", r"#.*$", "")
    rows = lines.select(key, "line", F.trim(bare).alias("t"), (F.length(bare) - F.length(F.ltrim(bare))).alias("indent")).filter("t <> ''")
    upto = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.last(F.when(F.col("indent") == 0, F.col("t").rlike(r"^paths\s*:")), ignorenulls=True).over(upto)).filter("inside and indent > 0")
    opened = F.nullif(F.regexp_extract("t", r"^(/\S*)\s*:", 1), F.lit(""))
    rows = rows.withColumn("opened", opened).withColumn("level", F.first(F.when(F.col("opened").isNotNull(), F.col("indent")), ignorenulls=True).over(upto))
    path = F.last(F.when(F.col("indent") <= F.col("level"), F.col("opened")), ignorenulls=True).over(upto)
    method = F.regexp_extract("t", r"^([a-z]+)\s*:", 1)
    met = rows.withColumn("path", path).withColumn("m", method)
    return met.filter(F.col("path").isNotNull() & F.col("m").isin(*METHODS) & (F.col("indent") > F.col("level"))).select(key, F.upper("m").alias("method"), "path")


def binaries(files: DataFrame, most: int = 200) -> DataFrame:
    """``repo, path, format, bytes``: the first programs by path of each repo, told by their first bytes; ``content`` is binary."""
    from pyspark.sql import Window

    head = F.hex(F.substring("content", 1, 4))
    kind = F.when(head == "7F454C46", "elf").when(F.startswith(head, F.lit("4D5A")), "pe").when(head.isin(*MACH), "macho")
    hit = files.select("repo", "path", kind.alias("format"), F.octet_length("content").cast("long").alias("bytes")).filter("format is not null and bytes >= 4")
    return hit.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy("path"))).filter(F.col("n") <= most).drop("n")


def votes(docs: DataFrame, name: str = "file", column: str = "json", least: int = 20) -> DataFrame:
    """``fingerprint, lens, verdict, confidence`` of drafts, one a lens; the lens defaults to the draft's name.

    Votes with an unknown verdict or a rationale under ``least`` characters are refused.
    """
    r = docs.select(name, F.from_json(column, _VOTES).alias("d"))
    v = r.select(F.coalesce(F.nullif(F.trim("d.lens"), F.lit("")), name).alias("lens"), F.explode("d.candidates").alias("c"))
    return v.filter(F.col("c.verdict").isin(*VOTES) & (F.length("c.rationale") >= least)).select("c.fingerprint", "lens", "c.verdict", "c.confidence")


def harvested(docs: DataFrame, key: str, column: str = "json", deepest: int = 16) -> DataFrame:
    """``key, path, line``: every file that a JSON document names at any depth, with its line if it has one.

    Objects with a ``filePath`` name one, with their ``line`` or ``startLine``; lists
    of strings under a few keys name files.  The tree is walked level by level with
    variant_explode; a document nested deeper than ``deepest`` levels is an error.
    """
    nodes = docs.select(key, F.lit("").alias("under"), F.try_parse_json(column).alias("v")).filter("v is not null")
    out = None
    for _ in range(deepest):
        get = lambda f, kind: F.try_variant_get("v", f, kind)
        here = nodes.filter(F.schema_of_variant("v").startswith("OBJECT")).select(key, get("$.filePath", "string").alias("path"), F.coalesce(get("$.line", "double"), get("$.startLine", "double")).cast("long").alias("line")).filter("path is not null")
        out = here if out is None else out.union(here)
        inner = nodes.sparkSession.sql(f"SELECT n.{key}, n.under, c.key AS name, c.value AS v FROM {{nodes}} n, LATERAL variant_explode(n.v) c WHERE schema_of_variant(n.v) LIKE 'OBJECT%' OR schema_of_variant(n.v) LIKE 'ARRAY%'", nodes=nodes)
        files = inner.filter(F.col("name").isNull() & F.col("under").isin(*FILE_LISTS) & (F.schema_of_variant("v") == "STRING"))
        out = out.union(files.select(key, F.try_variant_get("v", "$", "string"), F.lit(None).cast("long")))
        nodes = inner.filter("schema_of_variant(v) LIKE 'OBJECT%' OR schema_of_variant(v) LIKE 'ARRAY%'").select(key, F.coalesce("name", F.lit("")).alias("under"), "v")
    left = F.assert_true(F.schema_of_variant("v").isNull(), "documents are nested too deep")
    # a row that is left raises where it is projected
    return out.union(nodes.select(key, left.cast("string"), F.lit(None).cast("long"))).select(key, F.regexp_replace("path", r"^(\./)+", "").alias("path"), "line")


_TRUTH = "struct<id:string,kind:string,cwe:string,file:string,line:long>"


def ground_truth(docs: DataFrame, key: str, column: str = "json") -> DataFrame:
    """``key, id, kind, cwe, file_path, line`` of manifests of two shapes: ``expected`` are all vulnerable, ``expectations`` name their kind."""
    r = docs.select(key, F.from_json(column, f"expected array<{_TRUTH}>, expectations array<{_TRUTH}>").alias("d"))
    all_vulnerable = r.select(key, F.explode("d.expected").alias("e")).select(key, "e.id", F.lit("vuln").alias("kind"), "e.cwe", F.col("e.file").alias("file_path"), "e.line")
    named = r.select(key, F.explode("d.expectations").alias("e")).filter("e.kind in ('vuln', 'safe')").select(key, "e.id", "e.kind", "e.cwe", F.col("e.file").alias("file_path"), "e.line")
    return all_vulnerable.unionByName(named)
