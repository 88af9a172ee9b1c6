"""CIGAR strings: runs of = (match), X (substitution), I (text character only), D (pattern character only), a count of 1
left out, in pattern direction."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_RUN = re.compile(r"(\d*)([=XID])")


def runs(cigar: str) -> list[tuple[str, int]]:
    return [(op, int(n or 1)) for n, op in _RUN.findall(cigar)]


def packed(ops: str) -> str:
    """The CIGAR of one operation for each character."""
    out, at = [], 0
    for m in re.finditer(r"(.)\1*", ops):
        n = m.end() - m.start()
        out.append(f"{n if n > 1 else ''}{m[1]}")
        at = m.end()
    assert at == len(ops)
    return "".join(out)


def path(cigar: str, pattern_start: int, text_start: int) -> list[tuple[int, int]]:
    """(pattern, text) positions at which each operation begins."""
    out, j, i = [], pattern_start, text_start
    for op, n in runs(cigar):
        for _ in range(n):
            out.append((j, i))
            j += op != "I"
            i += op != "D"
    return out


def cost(cigar: str) -> int:
    """Edits in a CIGAR; overhang is not part of it."""
    return sum(n for op, n in runs(cigar) if op != "=")


def _ops(cigar: Column) -> Column:
    """One array element for each operation."""
    found = F.regexp_extract_all(cigar, F.lit(r"(\d*)([=XID])"), F.lit(0))
    one = lambda x: F.array_repeat(F.right(x, F.lit(1)), F.when(F.length(x) > 1, F.substring(x, F.lit(1), F.length(x) - 1).cast("int")).otherwise(1))
    return F.flatten(F.transform(found, one))


def cigar_ops_col(cigar: Column) -> Column:
    """array<struct<op, cnt>> of the runs."""
    found = F.regexp_extract_all(cigar, F.lit(r"(\d*)([=XID])"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.when(F.length(x) > 1, F.substring(x, F.lit(1), F.length(x) - 1).cast("int")).otherwise(1).alias("cnt")))


def cigar_cost_col(cigar: Column) -> Column:
    return F.aggregate(cigar_ops_col(cigar), F.lit(0), lambda acc, x: acc + F.when(x["op"] != "=", x["cnt"]).otherwise(0))


def path_col(cigar: Column, pattern_start: Column, text_start: Column) -> Column:
    """array<struct<pattern_pos, text_pos>>: where each operation begins."""
    ops = _ops(cigar)
    empty = F.array().cast("array<struct<pattern_pos:int,text_pos:long>>")
    begin = F.struct(pattern_start.cast("int").alias("j"), text_start.cast("long").alias("i"), empty.alias("p"))
    return F.aggregate(
        ops, begin,
        lambda acc, op: F.struct(
            (acc["j"] + F.when(op != "I", 1).otherwise(0)).cast("int").alias("j"),
            (acc["i"] + F.when(op != "D", 1).otherwise(0)).cast("long").alias("i"),
            F.array_append(acc["p"], F.struct(acc["j"].alias("pattern_pos"), acc["i"].alias("text_pos"))).alias("p"),
        ),
        lambda acc: acc["p"],
    )
