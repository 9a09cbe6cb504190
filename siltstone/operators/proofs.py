"""Proof runs and crash logs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signals and texts that mark a crash, texts of a failed build.
CRASH_SIGNALS = ("SIGABRT", "SIGSEGV", "SIGBUS", "SIGILL", "SIGFPE")
CRASH_TEXT = r"(?i)panic|AddressSanitizer|UndefinedBehaviorSanitizer|LeakSanitizer|assertion failed|Segmentation fault|stack overflow|heap-buffer-overflow|core dumped|RUST_BACKTRACE|Traceback \(most recent call last\)"
BUILD_TEXT = r"(?i)error\[E\d+\]|cannot find|undefined reference|SyntaxError|ModuleNotFoundError|No such file|compilation terminated|command not found|cargo: not found|could not compile"

#: Error classes and CWEs of address-sanitizer reports, the first match counts.
ASAN = (
    (r"heap-use-after-free|use-after-poison", "heap-use-after-free", "CWE-416"),
    (r"stack-use-after-return", "stack-use-after-return", "CWE-562"),
    (r"stack-use-after-scope", "stack-use-after-scope", "CWE-562"),
    (r"attempting double-free|double-free", "double-free", "CWE-415"),
    (r"heap-buffer-overflow", "heap-buffer-overflow", "CWE-122"),
    (r"stack-buffer-overflow|stack-buffer-underflow", "stack-buffer-overflow", "CWE-121"),
    (r"global-buffer-overflow", "global-buffer-overflow", "CWE-787"),
    (r"dynamic-stack-buffer-overflow", "dynamic-stack-buffer-overflow", "CWE-787"),
    (r"stack-overflow", "stack-overflow", "CWE-674"),
    (r"SEGV on unknown address|SEGV", "segv", "CWE-476"),
    (r"memory leak|LeakSanitizer", "memory-leak", "CWE-401"),
    (r"alloc-dealloc-mismatch", "alloc-dealloc-mismatch", "CWE-762"),
)
#: The same of undefined-behaviour reports.
UBSAN = (
    (r"out of bounds|index .* out of bounds", "out-of-bounds", "CWE-125"),
    (r"signed integer overflow|unsigned integer overflow", "integer-overflow", "CWE-190"),
    (r"shift exponent|shift of negative", "bad-shift", "CWE-190"),
    (r"null pointer|member access within null", "null-deref", "CWE-476"),
    (r"load of misaligned|misaligned address", "misaligned-access", "CWE-1319"),
    (r"division by zero", "div-by-zero", "CWE-369"),
)
#: The same of deadly signals.
SIGNALS = {"SEGV": ("segv", "CWE-476"), "BUS": ("bus-error", "CWE-119"), "ABRT": ("abort", "CWE-617"), "ILL": ("illegal-instruction", "CWE-119"), "FPE": ("fp-exception", "CWE-369")}


def classify_run(expected: str = "crash") -> Column:
    """struct(level, verdict) of columns skipped, timed_out, signal, exit_code and output."""
    level = lambda n, v: F.struct(F.lit(n).alias("level"), F.lit(v).alias("verdict"))
    out = F.coalesce("output", F.lit(""))
    return (
        F.when(F.col("skipped"), level(1, "error"))
        .when(F.col("timed_out"), level(1, "timeout"))
        .when(F.col("signal").isin(*CRASH_SIGNALS), level(4, "exploited"))
        .when(F.col("exit_code") > 128, level(4, "exploited"))
        .when(out.rlike(BUILD_TEXT), level(1, "harness-failed-build"))
        .when(out.rlike(CRASH_TEXT), level(3, "exploited"))
        .when(F.lit(expected == "nonzero") & (F.col("exit_code") != 0), level(3, "exploited"))
        .otherwise(level(2, "not-reproduced"))
    )


def classified(runs: DataFrame, expected: str = "crash") -> DataFrame:
    return runs.withColumn("c", classify_run(expected)).select("finding", "role", "run_no", F.col("c.level").alias("level"), F.col("c.verdict").alias("verdict"))


def differential(runs: DataFrame, expected: str = "crash") -> DataFrame:
    """``finding, level, verdict``: the first attack run held against the first benign one."""
    first = classified(runs, expected).groupBy("finding", "role").agg(F.min(F.struct("run_no", "level", "verdict")).alias("r"))
    wide = first.groupBy("finding").agg(F.max(F.when(F.col("role") == "attack", F.col("r"))).alias("a"), F.max(F.when(F.col("role") == "benign", F.col("r"))).alias("b"))
    fired = F.col("a.verdict") == "exploited"
    both = fired & (F.col("b.verdict") == "exploited")
    clean = fired & (F.col("b.verdict") == "not-reproduced")
    return wide.filter("a is not null").select(
        "finding",
        F.when(both, 2).when(clean, 5).otherwise(F.col("a.level")).alias("level"),
        F.when(both, "non-discriminating").otherwise(F.col("a.verdict")).alias("verdict"),
    )


def reproducibility(runs: DataFrame, expected: str = "crash") -> DataFrame:
    """``finding, level, verdict, fired, total, rate`` over all attack runs and the benign ones.

    Level 5 needs every attack run to fire and a clean control; flaky ones stay at
    4, or 3 where the best run did.  If none fires, the strongest single run counts.
    """
    rows = classified(runs, expected)
    attack = F.col("role") == "attack"
    fired = F.count_if(attack & (F.col("verdict") == "exploited"))
    total = F.count_if(attack)
    clean = (F.count_if(~attack) > 0) & (F.count_if(~attack & (F.col("verdict") != "not-reproduced")) == 0)
    best = F.max(F.when(attack, F.struct("level", "run_no", "verdict")))
    top = F.max(F.when(attack & (F.col("verdict") == "exploited"), F.col("level")))
    agg = rows.groupBy("finding").agg(fired.alias("fired"), total.alias("total"), clean.alias("clean"), best.alias("best"), top.alias("top")).filter("total > 0")
    level = F.when(F.col("fired") == 0, F.col("best.level")).when((F.col("fired") == F.col("total")) & F.col("clean"), 5).otherwise(F.least(F.lit(4), "top"))
    verdict = F.when(F.col("fired") == 0, F.col("best.verdict")).otherwise("exploited")
    return agg.select("finding", level.alias("level"), verdict.alias("verdict"), "fired", "total", F.round(F.col("fired") / F.col("total"), 3).alias("rate"))


def _table(text: Column, rows, other: tuple[str, str]) -> Column:
    out = F.struct(F.lit(other[0]).alias("error_class"), F.lit(other[1]).alias("cwe"))
    for pattern, name, cwe in reversed(rows):
        out = F.when(text.rlike(pattern), F.struct(F.lit(name).alias("error_class"), F.lit(cwe).alias("cwe"))).otherwise(out)
    return out


def classify_log(text: Column) -> Column:
    """struct(tool, error_class, cwe) of a crash log; null without a sanitizer's marks."""
    at = F.regexp_instr(text, F.lit(r"(?i)ERROR:\s*AddressSanitizer|LeakSanitizer:"))
    blob = F.substring(text, F.greatest(F.lit(1), at - 40), F.lit(441))
    ub = F.regexp_extract(text, r"(?i)runtime error:\s*([^\n]+)", 1)
    signal = F.coalesce(F.nullif(F.upper(F.regexp_extract(text, r"(?i)SUMMARY:\s*\w*Sanitizer:\s*(SEGV|BUS|ABRT|ILL|FPE)\b", 1)), F.lit("")), F.nullif(F.regexp_extract(text, r"\b(SEGV|BUS|ABRT|ILL|FPE)\b", 1), F.lit("")), F.lit("SEGV"))
    near_null = text.rlike(r"(?i)address 0x0{6,}\b|unknown address 0x0{6,}")
    pair = lambda e, c: F.struct(F.lit(e).alias("error_class"), F.lit(c).alias("cwe"))
    dead = F.when(~near_null & text.rlike(r"(?i)caused by a WRITE memory access|\bWRITE of size\b"), pair("oob-write", "CWE-787")).when(~near_null & text.rlike(r"(?i)caused by a READ memory access|\bREAD of size\b"), pair("oob-read", "CWE-125"))
    for name, (error, cwe) in SIGNALS.items():
        dead = dead.when(signal == name, pair(error, cwe))
    tool = F.when(text.rlike(r"(?i)Address\w*Sanitizer:"), "AddressSanitizer").when(text.rlike(r"(?i)Undefined\w*Sanitizer:"), "UndefinedBehaviorSanitizer").otherwise("Sanitizer")
    with_tool = lambda t, c: F.struct(t.alias("tool"), c["error_class"].alias("error_class"), c["cwe"].alias("cwe"))
    return (
        F.when(at > 0, with_tool(F.lit("AddressSanitizer"), _table(blob, ASAN, ("unknown", "CWE-119"))))
        .when(ub != "", with_tool(F.lit("UndefinedBehaviorSanitizer"), _table(ub, UBSAN, ("undefined-behavior", "CWE-758"))))
        .when(text.rlike(r"(?i)SUMMARY:\s*\w*Sanitizer:\s*(SEGV|BUS|ABRT|ILL|FPE)\b|\w*Sanitizer:\s*DEADLYSIGNAL"), with_tool(tool, dead))
    )


def triaged(crashes: DataFrame) -> DataFrame:
    """``crash_key, n, first_fingerprint, last_at`` of crash records."""
    return crashes.groupBy("crash_key").agg(F.count("*").alias("n"), F.min("fingerprint").alias("first_fingerprint"), F.countDistinct("cwe").alias("n_cwes"))


def crash_key(error_class: Column, path: Column, line: Column, symbol: Column, label: Column) -> Column:
    """What makes two crashes one: class and place, else class and symbol, else class and label; none and the label without a class."""
    at = F.concat(path, F.lit(":"), line.cast("string"))
    return F.when(error_class.isNull(), F.concat(F.lit("none:"), label)).otherwise(F.concat(error_class, F.lit(":"), F.coalesce(at, symbol, label)))
