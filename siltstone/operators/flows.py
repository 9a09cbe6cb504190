"""Links of untrusted sources and dangerous sinks in the text of a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.literals import candidates, matches, once
from siltstone.operators.spans import all_spans, innermost
from siltstone.operators.stores import written

_WEB = r"(?i)(req\.|request\.|getParameter|\.body\b|\.params\b|\.query\b|\.headers\b|\.cookies\b)"
_FREE = r"(?i)\b(free|kfree|vfree|g_free|xfree|zfree|sdsfree|delete|release)\s*\("
#: CWE, pattern of sources, pattern of sinks.  The two of freed memory are looked for in the text, as any use after a release.
RULES = (
    ("CWE-78", r"(?i)(req\.|request\.|getParameter|getenv|process\.argv|\bargv\b|\.body\b|\.params\b|\.query\b|\.headers\b|\.cookies\b|read[lL]ine|getInputStream)", r"(?i)(\bexec\b|execSync|execFile|\bsystem\(|popen|\bspawn|Runtime\.exec|os\.system|subprocess\.|ProcessBuilder|sh -c)"),
    ("CWE-89", r"(?i)(req\.|request\.|getParameter|process\.argv|\.body\b|\.params\b|\.query\b|\.headers\b|\.cookies\b)", r"(?i)(\.query\(|\.execute\(|executeQuery|executeUpdate|rawQuery|createQuery|prepareStatement|cursor\.execute|knex\.raw|sequelize\.query|db\.exec)"),
    ("CWE-90", _WEB, r"(?i)(\.search\(|ldap.*search|InitialDirContext|DirContext|NamingEnumeration|ldapsearch|searchFilter|ldap_search)"),
    ("CWE-94", r"(?i)(req\.|request\.|getParameter|process\.argv|\.body\b|\.params\b|\.query\b|\.headers\b|\.cookies\b)", r"""(?i)(\beval\(|new Function\(|Function\(|vm\.runIn|setTimeout\(\s*['"]|exec\(\s*compile|\bexec\(|\bcompile\(|globalEval|require\(.*\+)"""),
    ("CWE-190", r"(?i)(recv|recvfrom|read\(|fread|fgets|getline|scanf|ntohl|ntohs|ntohll|be32toh|be64toh|strtol|strtoul|atoi|atol|getParameter|\.body\b|\.params\b|\.query\b|\.headers\b|luaL_(check|opt)(int|long|integer|number|unsigned)|lua_to(integer|number|unsigned)|PyArg_Parse|PyLong_As)", r"(?i)(malloc|calloc|realloc|alloca|zmalloc|zrealloc|xmalloc|kmalloc|memcpy|memmove|memset|strncpy|strncat|snprintf|lua_checkstack|luaL_checkstack|lua_createtable|luaM_(new|realloc|malloc)\w*)"),
    ("CWE-415", _FREE, _FREE),
    ("CWE-416", _FREE, r"->|\b\w+\s*\[|\*\s*\w+\s*="),
    ("CWE-502", r"(?i)(req\.|request\.|getParameter|\.body\b|\.params\b|\.query\b|\.headers\b|\.cookies\b|getInputStream)", r"(?i)(unserialize|readObject|ObjectInputStream|pickle\.loads|cPickle\.loads|yaml\.load\b|Marshal\.load|deserialize|fromXML|readValue)"),
    ("CWE-601", _WEB, r"""(?i)(redirect|sendRedirect|\.location\b|Location:|res\.writeHead|setHeader\(\s*['"]Location|HttpResponseRedirect|url_for)"""),
    ("CWE-611", r"(?i)(req\.|request\.|getParameter|\.body\b|\.params\b|\.query\b|getInputStream|readBody)", r"(?i)(DocumentBuilder|SAXParser|XMLReader|XMLInputFactory|parseXML|etree\.parse|etree\.fromstring|lxml|libxml|Nokogiri|SimpleXML|XmlDocument\.Load)"),
    ("CWE-918", _WEB, r"(?i)(\bfetch\(|axios|http\.get|http\.request|https\.request|urlopen|requests\.(get|post|put|request)|HttpClient|WebClient|openConnection|URLConnection|\bcurl|got\(|superagent)"),
    ("CWE-943", _WEB, r"(?i)(\.find\(|\.findOne\(|\.aggregate\(|\.update\(|\.deleteOne\(|\.where\(|\$where|collection\.|mongo|getCollection)"),
    ("CWE-1336", _WEB, r"(?i)(render_template_string|from_string|Template\(|\.render\(|compile\(.*template|Handlebars\.compile|ejs\.render|pug\.compile|Velocity|Freemarker)"),
)


def rule_hits(lines: DataFrame, rules=RULES) -> DataFrame:
    """``repo, path, line, cwe, kind``: the lines that a rule takes for a source or a sink.

    A pattern that several rules share is tried once, and only on lines that hold one of its literals.
    """
    used: dict[str, list[Column]] = {}
    for cwe, source, sink in rules:
        for kind, pattern in (("source", source), ("sink", sink)):
            used.setdefault(pattern, []).append(F.struct(F.lit(cwe).alias("cwe"), F.lit(kind).alias("kind")))
    tags = [F.when(matches(pattern), F.array(*uses)) for pattern, uses in used.items()]
    tagged = once(candidates(lines, used), "tags", F.array_compact(F.array(*tags)))
    found = tagged.filter(F.size("tags") > 0).select("repo", "path", "line", F.explode(F.flatten("tags")).alias("h"))
    return found.select("repo", "path", "line", "h.cwe", "h.kind")


def linked(hits: DataFrame, lines: DataFrame, ends: int = 200, most: int = 25) -> DataFrame:
    """``repo, cwe, path, block_start, block, source_line, sink_line, place``: sinks after the nearest source of their CWE in the same block.

    A hit belongs to the innermost block around its line, or to the top level of its
    file; so a source in a nested function isn't one of what encloses it.  Of
    each repo and CWE the first ``ends`` sources and sinks count, and ``most`` links
    stay, by path and line.  A link is one in the text, not a dataflow.
    """
    place = Window.partitionBy("repo", "cwe", "kind").orderBy("path", "line")
    few = written(hits.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= ends).drop("n"), "ends")
    # only files with a source and a sink of one CWE can have a link
    both = few.groupBy("repo", "path", "cwe").agg(F.countDistinct("kind").alias("kinds")).filter("kinds = 2").select("repo", "path").distinct()
    around = written(lines.join(both, ["repo", "path"], "left_semi").select("repo", "path", "line", "text"), "files")
    placed = innermost(few.join(both, ["repo", "path"], "left_semi"), all_spans(around))
    placed = placed.withColumn("span", F.when(F.col("span.end").isNotNull(), F.col("span")))
    order = Window.partitionBy("repo", "cwe", "path", "span.start").orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    near = F.max(F.when(F.col("kind") == "source", F.col("line"))).over(order)
    met = placed.withColumn("source_line", near).filter("kind = 'sink' and source_line is not null")
    n = F.row_number().over(Window.partitionBy("repo", "cwe").orderBy("path", "line"))
    return met.withColumn("place", n).filter(F.col("place") <= most).select("repo", "cwe", "path", F.col("span.start").alias("block_start"), F.col("span.block").alias("block"), "source_line", F.col("line").alias("sink_line"), "place")
