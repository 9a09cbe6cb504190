"""Literals that a pattern can't match without, so that most lines never meet the pattern.

A pattern's required literals are found once, from its parsed form: any text that
matches holds one of them, in lower case if the text is lowered.  A pack's lines
are lowered once and searched for all literals at once, batch by batch in Arrow, in
time that grows with the text and not with the number of literals.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import re._constants as op
import re._parser as parser
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: A literal set of more members than this is no cheaper than the pattern.
_MOST = 80
#: Branches of more combinations of sets than this are left to the one set.
_COMBINED = 64


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """The set whose shortest literal is longer; of equals the smaller one."""
    if a is None or b is None:
        return a or b
    return max((a, b), key=lambda s: (min(map(len, s)), -len(s)))


def _of(items) -> frozenset[str] | None:
    best, run = None, ""
    for kind, value in [*items, (None, None)]:
        if kind is op.LITERAL:
            run += chr(value).lower()
            continue
        if run:
            best, run = _better(best, frozenset([run])), ""
        if kind is op.SUBPATTERN:
            best = _better(best, _of(value[3]))
        elif kind is op.BRANCH:
            parts = [_of(x) for x in value[1]]
            if all(parts):
                best = _better(best, frozenset().union(*parts))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            best = _better(best, _of(value[2]))
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
            best = _better(best, frozenset(chr(v).lower() for _, v in value))
    return best


def _all(items) -> list[frozenset[str]]:
    """Sets of literals of each of which every match holds one."""
    out, run = [], ""
    for kind, value in [*items, (None, None)]:
        if kind is op.LITERAL:
            run += chr(value).lower()
            continue
        if run:
            out, run = [*out, frozenset([run])], ""
        if kind is op.SUBPATTERN:
            out += _all(value[3])
        elif kind is op.BRANCH:
            parts = [_all(x) for x in value[1]]
            # one set of each branch, in all combinations
            if all(parts) and math.prod(map(len, parts)) <= _COMBINED:
                out += [frozenset().union(*x) for x in itertools.product(*parts)]
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            out += _all(value[2])
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
            out.append(frozenset(chr(v).lower() for _, v in value))
    return out


@functools.cache
def needed(pattern: str) -> tuple[tuple[str, ...], ...]:
    """:func:`required`, and the two smallest other sets of which every match holds one as well."""
    first = required(pattern)
    other = {tuple(_shortest(x)) for x in _all(parser.parse(pattern)) if all(y.isascii() for y in x)}
    other = sorted((x for x in other if x != first and not set(first) <= set(x)), key=lambda x: (len(x), x))
    return (first, *other[:2]) if first else ()


@functools.cache
def required(pattern: str) -> tuple[str, ...]:
    """Literals, in lower case, of which every match holds one; none if there is no such set of use."""
    found = _of(parser.parse(pattern))
    if not found or len(found) > _MOST or not all(x.isascii() for x in found):
        return ()
    return tuple(_shortest(found))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is made once a row.

    It comes by an explode of one element: a plain column, or an explode of the value
    itself, would be put in again wherever it is used or filtered on.
    """
    return rows.withColumn(name, F.explode(F.array(value)))


def _shortest(literals) -> list[str]:
    """The literals without those that hold another one."""
    return sorted(x for x in literals if not any(y != x and y in x for y in literals))


def _id(pattern: str) -> int:
    return zlib.crc32(pattern.encode()) >> 1


def _search(low: pa.Array, literals) -> np.ndarray:
    """Whether each text holds one of the literals."""
    found = pc.match_substring_regex(low, "|".join(map(re.escape, literals)))
    return pc.fill_null(found, False).to_numpy(zero_copy_only=False).copy()


def _holds(low: pa.Array, sets) -> np.ndarray:
    """Whether each text holds a literal of each of the sets; a set is looked for where those before it were found."""
    out = _search(low, sets[0])
    for literals in sets[1:]:
        at = np.nonzero(out)[0]
        out[at] = _search(low.take(pa.array(at)), literals)
    return out


def _tag(batches, sets: list[tuple[int, tuple[tuple[str, ...], ...]]], every: list[str] | None):
    """Batches without their last column, the lowered text, beside the patterns whose literals are held."""
    for batch in batches:
        if every is not None:
            batch = batch.filter(pa.array(_search(batch.column(batch.num_columns - 1), every)))
        low = batch.column(batch.num_columns - 1)
        held = np.array([_holds(low, all_) for _, all_ in sets], dtype=bool).reshape(len(sets), batch.num_rows).T
        ids = np.array([i for i, _ in sets], dtype=np.int32)[np.nonzero(held)[1]]
        ends = np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))], names=[*batch.schema.names[:-1], "held"])


def candidates(lines: DataFrame, patterns) -> DataFrame:
    """``lines`` with ``held``, the patterns whose required literals they hold, without those that hold none of any pattern.

    All stay if some pattern has none.
    """
    patterns = list(patterns)
    sets = [(_id(p), needed(p)) for p in patterns if required(p)]
    if len({i for i, _ in sets}) < len({p for p in patterns if required(p)}):
        raise ValueError("two patterns have one number")
    every = _shortest(set().union(*[x[0] for _, x in sets])) if sets and all(map(required, patterns)) else None
    schema = StructType([*lines.schema.fields, StructField("held", ArrayType(IntegerType()))])
    return lines.withColumn("_low", F.lower("text")).mapInArrow(functools.partial(_tag, sets=sets, every=every), schema)


def matches(pattern: str, text: str = "text") -> Column:
    """A candidate's text matches the pattern; it is tried only where the line holds its required literals."""
    found = F.col(text).rlike(pattern)
    return F.array_contains("held", F.lit(_id(pattern))) & found if required(pattern) else found


def count(pattern: str, text: str, low: str) -> Column:
    """How often the pattern matches; it is tried only on texts whose lowered form, in ``low``, holds one of its required literals."""
    n = F.regexp_count(text, F.lit(pattern))
    some = [F.contains(F.col(low), F.lit(x)) for x in required(pattern)]
    return F.when(functools.reduce(lambda a, b: a | b, some), n).when(F.col(low).isNotNull(), 0) if some else n
