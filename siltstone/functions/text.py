"""Normalisers of paths, identifiers and short texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading path parts that don't tell subsystems apart.
PLAIN_ROOTS = ("src", "lib", "app", "pkg", "internal", "cmd", "pkgs", "packages", "source", "main", "java", "ts", "js", "python", "go")

#: Language by file suffix, the first match counts.
LANGUAGES = (
    (r"\.java$", "Java"),
    (r"\.(kt|kts)$", "Kotlin"),
    (r"\.scala$", "Scala"),
    (r"\.tsx?$", "TypeScript"),
    (r"\.(jsx?|mjs|cjs)$", "JavaScript"),
    (r"\.(c|h)$", "C"),
    (r"\.(cc|cpp|hpp|cxx)$", "C++"),
    (r"\.(m|mm)$", "Objective-C"),
    (r"\.rs$", "Rust"),
    (r"\.go$", "Go"),
    (r"\.(rb|erb)$", "Ruby"),
    (r"\.py$", "Python"),
    (r"\.php$", "PHP"),
)


def ordered_case(value: Column, table, default: str | None = None) -> Column:
    """The result of the first pattern of ``table`` that matches ``value``."""
    out = F.lit(default)
    for pattern, result in reversed(list(table)):
        out = F.when(value.rlike(pattern), F.lit(result)).otherwise(out)
    return out


def norm_path(path: Column, root: str | None = None) -> Column:
    """Slashes forward, a leading ./ stripped, and made relative where it lies under ``root``."""
    p = F.regexp_replace(path, r"\\", "/")
    if root:
        base = root.rstrip("/") + "/"
        p = F.when(p.startswith(base), F.substring(p, len(base) + 1, 1 << 30)).otherwise(p)
    return F.regexp_replace(p, r"^(\./)+", "")


def same_path(a: Column, b: Column) -> Column:
    """Equal, or the longer ends with a slash and the shorter; false where one is null or empty."""
    a, b = norm_path(a), norm_path(b)
    ends = (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))
    return F.coalesce((F.length(a) > 0) & (F.length(b) > 0) & ends, F.lit(False))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def cwe_number(cwe: Column) -> Column:
    """The first run of digits as a number; null without one."""
    return F.nullif(F.regexp_extract(cwe, r"\d+", 0), F.lit("")).try_cast("bigint")


def norm_cwe(cwe: Column) -> Column:
    """``CWE-n``, or null."""
    n = cwe_number(cwe)
    return F.when(n.isNotNull(), F.concat(F.lit("CWE-"), n.cast("string")))


def language_of(path: Column) -> Column:
    return ordered_case(path, LANGUAGES, "Other")


def norm_language(language: Column) -> Column:
    """Catalog name of a language; null for Other and blank."""
    low = F.lower(F.trim(language))
    return F.when(low.isin("js", "node", "node.js", "javascript"), "javascript").when(low.isin("ts", "typescript"), "typescript").when(low.isin("c++", "cpp"), "cpp").when(low.isin("c#", "csharp"), "csharp").when(low.isin("", "other"), None).otherwise(low)


def component_of(path: Column) -> Column:
    """The first part of the path, its name apart, that isn't a plain root; else (root)."""
    parts = F.filter(F.split(norm_path(path), "/"), lambda x: x != "")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    telling = F.filter(folders, lambda x: ~F.lower(x).isin(*PLAIN_ROOTS))
    return F.coalesce(F.get(telling, F.lit(0)), F.lit("(root)"))


def subsystem_key(path: Column) -> Column:
    """Top folder, slash, and the file's name up to its first dot."""
    p = norm_path(path)
    top = F.when(F.instr(p, "/") > 0, F.substring_index(p, "/", 1)).otherwise(".")
    return F.concat(top, F.lit("/"), F.substring_index(basename(p), ".", 1))


def one_line(text: Column, width: int = 200) -> Column:
    """White space collapsed and trimmed, cut to ``width`` with an ellipsis."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width - 1), F.lit("…"))).otherwise(t)


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "root").otherwise(s)


def url_path(url: Column) -> Column:
    """The path of a URL or of a bare path; null stays null."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_extract(rest, r"^[^?#]*", 0)
    return F.when(path == "", "/").otherwise(path)


def query_names(url: Column) -> Column:
    """Distinct names of the query's parameters, sorted."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: x != "")))


def fingerprint(source: Column, ref_id: Column, file_path: Column, line: Column) -> Column:
    """16 hexadecimal digits that name a finding by source, reference and first anchor."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (source, ref_id, file_path, line)])
    return F.left(F.sha2(text, 256), F.lit(16))


def chain_id(members: Column) -> Column:
    return F.concat(F.lit("chain-"), F.left(F.sha2(F.array_join(F.array_sort(F.array_distinct(members)), "|"), 256), F.lit(12)))


def obligation_id(prefix: str, index: Column, file_path: Column, line: Column, kind: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), F.lpad(index.cast("string"), 4, "0"), file_path, line.cast("string"), F.regexp_replace(kind, "[^A-Za-z0-9_-]+", "-"))


def clamp_confidence(value: Column) -> Column:
    """Between 0 and 1; 0 for null, text and what isn't finite."""
    v = value.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)))


def command_name(symbol: Column) -> Column:
    """A handler's command: its name in lower case without the words that mark handlers."""
    bare = F.regexp_replace(F.regexp_replace(symbol, r"(?i)(_?command|_?cmd|_?handler|_?proc)$", ""), r"(?i)^(cmd_?|do_|handle_?|on_?(?=[A-Z_]))", "")
    return F.lower(F.regexp_replace(bare, "^_+|_+$", ""))
