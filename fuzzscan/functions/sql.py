"""The search as SQL functions: a table function for lateral joins, and scalar functions."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.search import Options, ends_of, matches
from ..operators.trace import region
from . import alphabets



@lru_cache(maxsize=256)
def _options(*how) -> Options:
    return Options(*how)


class _FuzzySearch:
    """Rows of matches of one pattern in one text."""

    def eval(self, text: str, pattern: str, k: int, alphabet: str, mode: str, rc: bool, alpha: float | None = None) -> Iterator[tuple]:
        if text is None or pattern is None:
            return
        raw, options = text.encode(), _options(k, alphabet, mode, rc, None if alpha is None else float(alpha))
        if not pattern:
            raise ValueError("a pattern is empty")
        for _, _, m in matches([raw], [pattern.encode()], options):
            yield m.cost, m.strand, m.text_start, m.text_end, m.pattern_start, m.pattern_end, region(raw, m, options.alphabet).decode("utf-8", "replace"), m.cigar


_COLUMNS = "cost int, strand string, text_start long, text_end long, pattern_start int, pattern_end int, match_region string, cigar string"


def _each(mode: str, told: Callable[[list[int]], int | None]) -> Callable[[pd.Series, pd.Series, pd.Series, pd.Series], pd.Series]:
    """A function of columns: what is told of the costs at the ends of each row's pattern in its text. The rows of a batch
    that share pattern, k and alphabet are searched together."""

    def run(text: pd.Series, pattern: pd.Series, k: pd.Series, alphabet: pd.Series) -> pd.Series:
        out: list[int | None] = [None] * len(text)
        groups: dict[tuple, list[int]] = defaultdict(list)
        for i, (t, p, n, a) in enumerate(zip(text, pattern, k, alphabet)):
            if t is not None and p:
                groups[p, int(n), a].append(i)
        for (p, n, a), rows in groups.items():
            (found,) = ends_of([text.iloc[i].encode() for i in rows], [p.encode()], _options(n, a, mode, False))
            costs: dict[int, list[int]] = defaultdict(list)
            for t, c in zip(found.text.tolist(), found.cost.tolist()):
                costs[t].append(c)
            for t, i in enumerate(rows):
                out[i] = told(costs[t])
        return pd.Series(out, dtype="Int64")

    # Spark reads the kinds of the columns from the function it is given
    run.__annotations__ = {"text": pd.Series, "pattern": pd.Series, "k": pd.Series, "alphabet": pd.Series, "return": pd.Series}
    return run


def register(spark: SparkSession) -> None:
    """fuzzy_search(text, pattern, k, alphabet, mode, rc [, alpha]) for LATERAL; fuzzy_count (local minima) and
    fuzzy_best_cost(text, pattern, k, alphabet) on the forward strand; and of built-ins reverse_complement_dna/_iupac(seq),
    iupac_match(a, b) of two characters, and cigar_path(cigar, pattern_start, text_start), where each operation begins."""
    spark.udtf.register("fuzzy_search", F.udtf(_FuzzySearch, returnType=_COLUMNS))
    spark.udf.register("fuzzy_count", F.pandas_udf(_each("local", len), "long"))
    spark.udf.register("fuzzy_best_cost", F.pandas_udf(_each("all", lambda costs: min(costs, default=None)), "long"))
    for name, pairs in (("dna", alphabets.DNA_COMPLEMENT), ("iupac", alphabets.IUPAC_COMPLEMENT)):
        a, b = "".join(pairs), "".join(pairs.values())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION reverse_complement_{name}(s STRING) RETURNS STRING RETURN reverse(translate(s, '{a + a.lower()}', '{b + b.lower()}'))")
    # two characters match if some base is in the sets of both
    bases = {b: "".join(sorted(x + x.lower() for x, y in alphabets.IUPAC_CODES.items() if y & b)) for b in (1, 2, 4, 8)}
    both = " OR ".join(f"(contains('{chars}', a) AND contains('{chars}', b))" for chars in map("".join, bases.values()))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION iupac_match(a STRING, b STRING) RETURNS BOOLEAN RETURN length(a) = 1 AND length(b) = 1 AND ({both})")
    ops = "flatten(transform(regexp_extract_all(c, '(\\\\d*)([=XID])', 0), x -> array_repeat(right(x, 1), coalesce(try_cast(left(x, length(x) - 1) AS INT), 1))))"
    steps = f"""transform(sequence(1, size({ops})), n -> named_struct(
        'pattern_pos', p + n - 1 - size(filter(slice({ops}, 1, n - 1), o -> o = 'I')), 'text_pos', t + n - 1 - size(filter(slice({ops}, 1, n - 1), o -> o = 'D'))))"""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cigar_path(c STRING, p INT, t BIGINT) RETURNS ARRAY<STRUCT<pattern_pos: INT, text_pos: BIGINT>> RETURN CASE WHEN c = '' THEN array() ELSE {steps} END")
