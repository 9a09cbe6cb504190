"""A catalog of weakness classes, and what is looked up in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.text import cwe_number

_WEB8 = "javascript typescript python ruby php java go csharp"
#: A short catalog: CWE, class, languages and some signals of a sink.  A whole one, with all four kinds of signals, is read by :func:`read_catalog`.
CATALOG = (
    (22, "path-traversal", "any", "open|readFile|writeFile"), (73, "externally-controlled-path", "any", "open|create|rename"), (77, "command-injection", "any", "exec|spawn|system"),
    (78, "os-command-injection", "any", "child_process.exec|os.system|Runtime.exec"), (79, "xss", _WEB8, "render|send|html"), (89, "sql-injection", "any", "query|execute|exec"),
    (90, "ldap-injection", _WEB8, "ldap search|LDAP filter|DirContext.search"), (94, "code-injection", "javascript typescript python ruby php java", "eval|Function|exec"), (95, "eval-injection", "javascript typescript python ruby php", "eval|Function|exec"),
    (113, "header-injection", _WEB8, "setHeader|header|headers["), (117, "log-injection", "any", "logger|log.info|puts"), (190, "integer-overflow", "c cpp go rust", "allocation|copy|slice"),
    (200, "info-exposure", "any", "response body|log|error message"), (287, "authentication-bypass", _WEB8, "session creation|current_user|authenticate"), (326, "weak-crypto", "any", "createCipher|Cipher.getInstance|OpenSSL::Cipher"),
    (327, "weak-crypto", "any", "crypto.createHash|MessageDigest|OpenSSL::Digest"), (346, "origin-validation", _WEB8, "CORS allow|redirect|webhook trust"), (352, "csrf", _WEB8, "state change|delete|transfer"),
    (362, "race-condition", "any", "balance update|state transition|file write"), (367, "toctou", "any", "exists then open|check then write|stat then use"), (400, "resource-exhaustion", "any", "allocation|loop|regex"),
    (434, "file-upload", _WEB8, "save upload|write file|public path"), (502, "deserialization", "javascript typescript python ruby php java csharp", "deserialize|pickle.loads|Marshal.load"), (601, "open-redirect", _WEB8, "redirect|RedirectResponse|sendRedirect"),
    (611, "xxe", "java python ruby php go csharp", "XML parser|DocumentBuilder|SAXParser"), (639, "idor", _WEB8, "find by id|load record|update owner resource"), (776, "xml-entity-expansion", "java python ruby php go csharp", "XML parser|DTD|entity resolver"),
    (798, "hardcoded-credentials", "any", "auth header|database password|cloud credential"), (829, "supply-chain", "any", "install script|dynamic import|plugin load"), (862, "missing-authorization", _WEB8, "sensitive object|admin action|tenant data"),
    (863, "incorrect-authorization", _WEB8, "privileged action|record mutation|admin API"), (915, "mass-assignment", _WEB8, "update attributes|assign|create"), (918, "ssrf", "any", "fetch|request|http.Get"),
    (943, "nosql-injection", "javascript typescript python ruby java csharp", "find|findOne|aggregate"), (1321, "prototype-pollution", "javascript typescript", "merge|assign|set"), (1333, "regex-injection", "javascript typescript python ruby php java", "RegExp|re.compile|Pattern.compile"),
    (1336, "ssti", "javascript typescript python ruby php java", "render_template_string|Template.new|Handlebars.compile"),
)
#: Classes of web code, and those that come first in Python code of which little is known.
WEB = ("xss", "sql-injection", "ldap-injection", "header-injection", "origin-validation", "csrf", "file-upload", "open-redirect", "idor", "missing-authorization", "incorrect-authorization", "mass-assignment", "ssrf", "nosql-injection", "prototype-pollution", "regex-injection", "ssti")
SPARSE_PYTHON = ("command-injection", "os-command-injection", "sql-injection", "path-traversal", "ssrf", "xss", "deserialization", "xxe", "log-injection", "info-exposure", "missing-authorization", "incorrect-authorization", "hardcoded-credentials")
#: Families of oracles in order, with their CWEs.
ORACLES = (
    ("path-traversal", (22, 23, 36, 73)),
    ("ssrf", (918,)),
    ("sql-injection", (89,)),
    ("xss", (79, 80, 83, 116)),
    ("authz", (284, 285, 639, 862, 863)),
    ("deserialization", (502,)),
    ("memory-safety", (119, 120, 121, 122, 124, 125, 126, 127, 131, 190, 191, 415, 416, 476, 787, 824)),
)
#: What to do about a class of weakness, by CWE, and about any other.
REMEDIES = {
    22: "Resolve the path and require that it stays under the base folder.", 73: "Map input to an id of a known file.", 77: "Pass arguments as a list, without a shell.", 78: "Pass arguments as a list, without a shell.", 79: "Encode output for its context.",
    89: "Bind values as parameters.", 90: "Escape the filter's special characters.", 94: "Dispatch on data instead of evaluating code.", 95: "Dispatch on data instead of evaluating code.", 113: "Refuse control characters in headers.", 117: "Log structured records.",
    190: "Check arithmetic before sizes and indices are used.", 287: "Authenticate every protected path.", 326: "Use a current algorithm and key size.", 327: "Use a current algorithm and key size.", 346: "Check the origin against a list.", 352: "Require a token on changes of state.",
    362: "Lock, or compare and swap.", 367: "Check and use one handle.", 400: "Bound sizes, rates and depths.", 434: "Check uploads by content and store them outside the web root.", 502: "Read data formats with a schema only.", 601: "Redirect to listed targets only.",
    611: "Switch off external entities.", 639: "Check that the caller owns the object.", 776: "Switch off document types.", 798: "Load secrets from a store and rotate them.", 829: "Pin dependencies and check their digests.", 862: "Check the caller's right on the server.", 863: "Check the right subject, role and object.",
    915: "Bind listed fields only.", 918: "Check host and address against a list.", 943: "Refuse operators in input.", 1321: "Refuse keys of prototypes.", 1333: "Bound patterns that users give.", 1336: "Pass input as data to templates.",
}
GENERAL_REMEDY = "Check input where it enters, neutralise it where it is used, and test the trigger."


#: Kinds of signals in their order, and the column that holds them.
ROLES = (("source", "sources"), ("sink", "signals"), ("sanitizer", "sanitizers"), ("structural", "structural"))
_SCHEMA = "cwe long, class string, languages array<string>, sources array<string>, signals array<string>, sanitizers array<string>, structural array<string>"


def catalog(spark: SparkSession) -> DataFrame:
    """``cwe, class, languages, sources, signals, sanitizers, structural`` of the built-in catalog, which has signals of sinks only."""
    rows = [(c, k, langs.split(), [], signals.split("|"), [], []) for c, k, langs, signals in CATALOG]
    return spark.createDataFrame(rows, _SCHEMA)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The same columns of catalog documents: JSON objects with ``entries``, of which missing lists are empty and those without a CWE are left out."""
    names = {"sources": "sourceSignals", "signals": "sinkSignals", "sanitizers": "sanitizerSignals", "structural": "structuralQueries"}
    entry = "struct<cwe:string,taintClass:string,languages:array<string>," + ",".join(f"{n}:array<string>" for n in names.values()) + ">"
    e = spark.read.schema(f"entries array<{entry}>").option("multiLine", True).json(path).select(F.explode("entries").alias("e"))
    some = lambda c: F.coalesce(F.col(f"e.{c}"), F.array().cast("array<string>"))
    rows = e.select(cwe_number(F.col("e.cwe")).alias("cwe"), F.col("e.taintClass").alias("class"), some("languages").alias("languages"), *[some(n).alias(c) for c, n in names.items()])
    return rows.filter("cwe is not null")


def with_signals(entries: DataFrame, own: DataFrame) -> DataFrame:
    """``entries`` with signals of one's own, ``own(cwe, role, pattern)``, after theirs, by pattern."""
    added = own.groupBy("cwe").agg(*[F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col("pattern")))).alias(f"_{c}") for role, c in ROLES])
    met = entries.join(added, "cwe", "left")
    both = [F.concat(c, F.coalesce(f"_{c}", F.array().cast("array<string>"))).alias(c) for _, c in ROLES]
    return met.select("cwe", "class", "languages", *both)


def remedy(cwe: Column, own: Column) -> Column:
    """The given advice unless it is blank, else that of the CWE, else the general one."""
    table = F.create_map(*[F.lit(x) for pair in REMEDIES.items() for x in pair])
    return F.coalesce(F.nullif(F.trim(own), F.lit("")), F.try_element_at(table, cwe_number(cwe).cast("int")), F.lit(GENERAL_REMEDY))


def oracle(cwe: Column) -> Column:
    """The first family whose list holds the CWE, else null."""
    out = F.lit(None).cast("string")
    for name, numbers in reversed(ORACLES):
        out = F.when(cwe_number(cwe).isin(*numbers), F.lit(name)).otherwise(out)
    return out


def looked_up(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """``fingerprint, cwe, class``: each finding beside the catalog's entry of its CWE, if any; the catalog has one entry a CWE.

    The catalog is a small dimension, so findings stay where they are: a few CWEs hold most of them.
    """
    return findings.select("fingerprint", cwe_number(F.col("cwe")).alias("cwe")).join(F.broadcast(entries.select("cwe", "class")), "cwe", "left").select("fingerprint", "cwe", "class")


def seeds(entries: DataFrame) -> DataFrame:
    """``cwe, role, pattern, n``: the entries' signals by role and place, blank ones left out, the first of those that differ in case only."""
    rows = None
    for at, (role, column) in enumerate(ROLES):
        own = entries.select("cwe", F.lit(at).alias("at"), F.lit(role).alias("role"), F.posexplode(column).alias("pos", "pattern"))
        rows = own if rows is None else rows.union(own)
    rows = rows.withColumn("pattern", F.trim("pattern")).filter("pattern <> ''")
    first = F.row_number().over(Window.partitionBy("cwe", "role", F.lower("pattern")).orderBy("pos"))
    kept = rows.withColumn("first", first).filter("first = 1")
    return kept.select("cwe", "role", "pattern", F.row_number().over(Window.partitionBy("cwe").orderBy("at", "pos")).alias("n"))


def ranked(contexts: DataFrame, entries: DataFrame, most: int = 20) -> DataFrame:
    """``repo, cwe, score, place``: the entries that fit a repository's context best.

    A context has ``repo``, arrays ``languages, frameworks, databases, entry_points,
    threat_cwes, intel_cwes`` (none null) and ``corpus``, lower-cased words about it.
    The catalog is a small dimension, so each context meets all of its entries.
    """
    lang = F.exists("languages", lambda x: F.array_contains("entry_languages", x))
    any_ = F.array_contains("entry_languages", "any")
    few = F.size("frameworks") + F.size("databases") + F.size("entry_points") < 2
    tokens = F.concat(F.array("class"), "sources", "signals", "structural")
    hits = F.size(F.filter(tokens, lambda t: (F.length(t) >= 3) & F.contains(F.col("corpus"), F.lower(t))))
    when = lambda c, w: F.when(c, w).otherwise(0)
    score = (
        when(F.array_contains("threat_cwes", F.col("cwe")), 100)
        + when(F.array_contains("intel_cwes", F.col("cwe")), 60)
        + when(lang | (any_ & (F.size("languages") > 0)), 25)
        + when(any_, 5)
        + when(F.exists("databases", lambda d: d.rlike("(?i)sql|postgres|mysql|sqlite|oracle")) & F.col("class").rlike("(?i)sql|nosql|second-order"), 35)
        + when(((F.size("frameworks") > 0) | (F.size("entry_points") > 0)) & F.col("class").isin(*WEB), 20)
        + when(F.array_contains("languages", "python") & few & F.col("class").isin(*SPARSE_PYTHON), 18)
        + F.least(F.lit(30), hits * 5)
    )
    met = contexts.crossJoin(F.broadcast(entries.withColumnRenamed("languages", "entry_languages"))).select("repo", "cwe", score.alias("score"))
    place = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("score"), "cwe"))
    return met.withColumn("place", place).filter(F.col("place") <= most)
