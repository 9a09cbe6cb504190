"""Dependencies and routes declared in source lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import basename


#: Manifests by file name, and their ecosystem.
MANIFESTS = ((r"^package\.json$", "npm"), (r"^requirements[\w.-]*\.txt$", "pypi"), (r"^go\.mod$", "go"), (r"^Cargo\.toml$", "crates"), (r"^Gemfile$", "rubygems"), (r"^pom\.xml$", "maven"))


def dependencies(lines: DataFrame, manifests: int = 12, per_manifest: int = 120, most: int = 40) -> DataFrame:
    """``repo, ecosystem, name, path, line, dev``: the first declaration of each dependency.

    Files of one declaration a line are read by pattern; package.json, go.mod and
    Cargo.toml have blocks, whose state is the last header above a line.  Of a repo
    the first manifests by path count, of each the first declarations, and ``most``
    dependencies stay, by path and line.
    """
    base, text = basename(F.col("path")), F.trim("text")
    kind = F.lit(None).cast("string")
    for pattern, ecosystem in reversed(MANIFESTS):
        kind = F.when(base.rlike(pattern), F.lit(ecosystem)).otherwise(kind)
    rows = lines.withColumn("ecosystem", kind).filter("ecosystem is not null")
    files = rows.select("repo", "path").distinct().withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy("path"))).filter(F.col("n") <= manifests).drop("n")
    rows = rows.join(files, ["repo", "path"])
    of = lambda name: F.col("ecosystem") == name
    header = (
        F.when(of("npm"), F.when(text.rlike(r'^"dependencies"\s*:\s*\{'), "on").when(text.rlike(r'^"(dev|optional|peer)Dependencies"\s*:\s*\{'), "dev").when(text.startswith("}"), "off"))
        .when(of("go"), F.when(text.rlike(r"^require\s*\("), "on").when(text == ")", "off"))
        .when(of("crates"), F.when(text.rlike(r"^\[(.*\.)?(dev-)?dependencies\]$"), "on").when(text.startswith("["), "off"))
    )
    state = F.last(header, ignorenulls=True).over(Window.partitionBy("repo", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("state", state).withColumn("inside", F.col("state").isin("on", "dev") & header.isNull())
    name = (
        F.when(of("npm"), F.when(F.col("inside"), F.regexp_extract(text, r'^"([^"]+)"\s*:', 1)))
        .when(of("pypi"), F.when(~text.startswith("#") & ~text.startswith("-"), F.regexp_extract(text, r"^([^<>=!~;\[\s]+)", 1)))
        .when(of("go"), F.when(text.rlike(r"^require\s+[^(\s]"), F.regexp_extract(text, r"^require\s+([\w.\-/]+)\s+v[\w.\-+]", 1)).when(F.col("inside"), F.regexp_extract(text, r"^([\w.\-/]+)\s+v[\w.\-+]", 1)))
        .when(of("crates"), F.when(F.col("inside"), F.regexp_extract(text, r"^([A-Za-z0-9_-]+)\s*=", 1)))
        .when(of("rubygems"), F.regexp_extract(text, r"""^gem\s+['"]([^'"]+)['"]""", 1))
        .otherwise(F.regexp_extract(text, r"<artifactId>([^<]+)</artifactId>", 1))
    )
    found = rows.withColumn("name", name).filter("name <> ''").withColumn("k", F.row_number().over(Window.partitionBy("repo", "path").orderBy("line"))).filter(F.col("k") <= per_manifest)
    first = F.row_number().over(Window.partitionBy("repo", "ecosystem", "name").orderBy("path", "line"))
    one = found.withColumn("n", first).filter("n = 1").withColumn("m", F.row_number().over(Window.partitionBy("repo").orderBy("path", "line"))).filter(F.col("m") <= most)
    return one.select("repo", "ecosystem", "name", "path", "line", F.coalesce(F.col("state") == "dev", F.lit(False)).alias("dev"))


#: Framework, pattern of a declaration, group of the method (0: none), group of the path.
ROUTES = (
    ("spring", r"""@(Get|Post|Put|Delete|Patch|Request)Mapping\s*\(\s*(?:value\s*=\s*)?["']([^"']+)""", 1, 2),
    ("flask", r"""@\s*[\w.]+\.route\s*\(\s*["']([^"']+)["'](?:[^)]*methods\s*=\s*\[([^\]]*)\])?""", 2, 1),
    ("http", r"""\b(?:app|router|api|server|bp|blueprint|fastify|r|mux|e|g|srv|svc)\s*\.\s*(get|post|put|delete|patch|options|head|all|use|GET|POST|PUT|DELETE|PATCH|Any)\s*\(\s*["'`]([^"'`]+)""", 1, 2),
    ("django", r"""\b(?:path|re_path|url)\s*\(\s*r?["']([^"']*)""", 0, 1),
    ("rails", r"""\b(get|post|put|patch|delete)\s+["']([^"']+)["']""", 1, 2),
    ("go-http", r"""\.(?:HandleFunc|Handle)\s*\(\s*["']([^"']+)""", 0, 1),
)


def routes(lines: DataFrame, limit: int = 300) -> DataFrame:
    """``repo, framework, method, route, path, line``: declared routes by the first framework that matches a line.

    ``use``, ``all``, ``any`` and ``Request`` mean any method, and a decorated
    route without methods GET.  A repeated declaration counts once; each repo keeps
    ``limit``.
    """
    found = F.lit(None).cast("struct<framework:string,method:string,route:string>")
    for name, pattern, verb_at, route_at in reversed(ROUTES):
        verb = F.upper(F.regexp_replace(F.regexp_extract("text", pattern, verb_at), "[\"'\\s]", "")) if verb_at else F.lit("ANY")
        method = F.when(verb.isin("USE", "ALL", "ANY", "REQUEST"), "ANY").when(verb == "", "GET").otherwise(verb)
        route = F.regexp_extract("text", pattern, route_at)
        route = F.when(route == "", "/").otherwise(route)
        found = F.when(F.col("text").rlike(pattern), F.struct(F.lit(name).alias("framework"), method.alias("method"), route.alias("route"))).otherwise(found)
    rows = lines.select("repo", "path", "line", found.alias("r")).filter("r is not null").select("repo", "r.*", "path", "line").distinct()
    order = Window.partitionBy("repo").orderBy("path", "line", "method", "route")
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).drop("n")
