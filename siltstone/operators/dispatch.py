"""Handlers that are dispatched by name: tables, registrations and naming conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.literals import candidates, matches, once
from siltstone.functions.text import command_name
from siltstone.operators.stores import written

#: Names of handlers, of handlers by convention of their definition, and words that are no symbols.
HANDLER = r"^[A-Za-z_]\w*(?:Command|Handler|Cmd|Callback|Cb|Proc|Fn|Func|Op|Hook|Action|Dispatch|Exec)$"
BY_CONVENTION = r"^(?:[a-z]\w*(?:Command|Handler)|on_[a-z]\w+|handle_[a-z]\w+|cmd_[a-z]\w+|[a-z]\w*_(?:handler|cmd|command|callback))$"
KEYWORDS = (
    "if", "for", "while", "switch", "return", "sizeof", "case", "do", "else", "struct", "union", "enum", "const", "static", "void", "int", "char", "long", "short", "unsigned", "signed", "float", "double",
    "NULL", "null", "true", "false", "nullptr", "typedef", "extern", "inline",
)
#: Declarations of handler tables, definitions of functions, and lines that may register a handler.
TABLE = r"\b(luaL_Reg|luaL_reg|PyMethodDef|PyGetSetDef|JSCFunctionListEntry|JSFunctionSpec|napi_property_descriptor)\b\s+\*?\s*\w+\s*\["
DEFINITION = r"^[A-Za-z_][\w\s\*]*?\b[A-Za-z_]\w*\s*\(|\bfunction\s+[A-Za-z_]\w*|\bdef\s+[A-Za-z_]\w*|\bfunc\s+[A-Za-z_]\w*|\bfn\s+[A-Za-z_]\w*"
ENTRY = r"""\{\s*["'][^"']*["']\s*,|\b[A-Z][A-Z0-9_]{2,}\s*\(\s*["']|\b\w*(?:[Rr]egister|[Ss]ubscribe|add_?(?:command|method|handler|route|listener)|define_?method|set_?(?:handler|callback))\w*\s*\("""
KEYWORD_DEF, CALL = r"\b(?:function|def|func|fn)\s+([A-Za-z_]\w*)", r"\b([A-Za-z_]\w*)\s*\("
SYMBOL, CONSTANT = r"(?:^|[^\w.>:&])&?\s*([A-Za-z_]\w*)\b", r"^[A-Z][A-Z0-9_]{2,}$"
BESIDE_NAME = r"""[{,(]\s*["'][^"']*["']\s*,\s*&?\s*([A-Za-z_]\w*)\b"""
HEADER, TOKEN = r"\.(h|hpp|hh|pyi|d\.ts)$", r"^[A-Za-z][\w.\-]*$"


def _some(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def definitions(lines: DataFrame) -> DataFrame:
    """``repo, name, path, line``: where each function that these lines define is defined; a body comes before a header, then the first by path and line."""
    plain = F.when(~F.col("text").rlike(r";\s*$"), _some(F.regexp_extract("text", CALL, 1)))
    named = lines.select("repo", "path", "line", F.coalesce(_some(F.regexp_extract("text", KEYWORD_DEF, 1)), plain).alias("name"))
    named = named.filter(F.col("name").isNotNull() & ~F.col("name").isin(*KEYWORDS))
    first = named.groupBy("repo", "name").agg(F.min(F.struct(F.col("path").rlike(HEADER).alias("header"), "path", "line")).alias("d"))
    return first.select("repo", "name", "d.path", "d.line")


def handlers(lines: DataFrame, most: int = 400) -> DataFrame:
    """``repo, kind, name, handler, path, line, def_path, def_line, place``: what is dispatched by name in each repo.

    Declarations of tables come first, then functions named by convention, then rows
    of tables and registrations, each by path and line; a handler defined in one file
    counts once.  A symbol of a row counts if its name is a handler's, the last one of
    the row, or if it follows the row's name and is defined.
    """
    # the lines are read once; what may matter is little, and written, as each part reads it again
    kinds = F.array_compact(F.array(*[F.when(matches(p), i) for i, p in enumerate((TABLE, DEFINITION, ENTRY))]))
    tagged = once(candidates(lines, [TABLE, DEFINITION, ENTRY]), "kinds", kinds).select("repo", "path", "line", "text", "kinds")
    lines = written(tagged.filter(F.size("kinds") > 0), "handlers")
    tables, defining, rows = (lines.filter(F.array_contains("kinds", i)) for i in range(3))
    defs = written(definitions(defining), "definitions")
    hit = tables.select("repo", F.lit(1).alias("part"), F.lit("handler-table-decl").alias("kind"), F.lit(None).cast("string").alias("name"), F.concat(F.lit("table@"), "path", F.lit(":"), F.col("line").cast("string")).alias("handler"), "path", "line", F.col("path").alias("def_path"), F.col("line").alias("def_line"))
    usual = defs.filter(F.col("name").rlike(BY_CONVENTION)).select("repo", F.lit(2).alias("part"), F.lit("convention-def").alias("kind"), command_name(F.col("name")).alias("name"), F.col("name").alias("handler"), "path", "line", F.col("path").alias("def_path"), F.col("line").alias("def_line"))
    # names that are called are no symbols of the row
    bare = F.regexp_replace("text", CALL, "(")
    symbols = F.filter(F.regexp_extract_all(bare, F.lit(SYMBOL), F.lit(1)), lambda x: ~x.isin(*KEYWORDS) & ~x.rlike(CONSTANT))
    kind = F.when(F.col("text").rlike(r"""\{\s*["']"""), "pointer-table").when(F.col("text").rlike(r"\b[A-Z][A-Z0-9_]{2,}\s*\("), "macro-table").otherwise("registration-call")
    rows = rows.select("repo", "path", "line", _some(F.regexp_extract("text", r"""["']([^"']{1,64})["']""", 1)).alias("name"), kind.alias("kind"), symbols.alias("symbols"), _some(F.regexp_extract("text", BESIDE_NAME, 1)).alias("beside"))
    by_name = F.try_element_at(F.filter("symbols", lambda x: x.rlike(HANDLER)), F.lit(-1))
    rows = rows.filter(F.size("symbols") > 0).withColumn("handler", F.coalesce(by_name, "beside")).filter("handler is not null")
    known = rows.join(defs.select("repo", F.col("name").alias("handler"), F.col("path").alias("d_path"), F.col("line").alias("d_line")), ["repo", "handler"], "left")
    listed = known.filter(F.col("d_path").isNotNull() | F.col("handler").rlike(HANDLER)).select("repo", F.lit(3).alias("part"), "kind", "name", "handler", "path", "line", F.coalesce("d_path", "path").alias("def_path"), F.coalesce("d_line", "line").alias("def_line"))
    every = hit.union(usual).union(listed)
    one = every.groupBy("repo", "def_path", "handler").agg(F.min(F.struct("part", "path", "line", "kind", "name", "def_line")).alias("e"))
    place = F.row_number().over(Window.partitionBy("repo").orderBy("e.part", "e.path", "e.line", "handler"))
    return one.withColumn("place", place).filter(F.col("place") <= most).select("repo", "e.kind", "e.name", "handler", "e.path", "e.line", "def_path", "e.def_line", "place")


def vocabulary(found: DataFrame, most: int = 200) -> DataFrame:
    """``repo, name, handler, place``: the distinct names of handlers, each with its first one."""
    named = found.filter(F.col("name").rlike(TOKEN)).groupBy("repo", "name").agg(F.min(F.struct("place", "handler")).alias("m"))
    n = F.row_number().over(Window.partitionBy("repo").orderBy("m.place"))
    return named.withColumn("n", n).filter(F.col("n") <= most).select("repo", "name", "m.handler", F.col("n").alias("place"))
