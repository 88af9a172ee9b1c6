"""Quality rules as a short-circuit cascade: each rule's cost and selectivity are estimated on a sample, then the rules
run in order of rejections per unit of cost."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Documents from which the order of the rules is estimated; it never changes which documents are kept.
SAMPLE = 256
#: Words above which repeated windows are found by sorting hashes instead of a set of tuples.
LONG = 1 << 20
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long"
_LETTER = regex.compile(r"\p{L}")


class Features:
    """What rules look at. Each part is made when a rule first asks for it, and then shared."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, common.SPACE)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(common.SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def strings(self) -> list[str]:
        """The words as strings, for the rules that look at letters."""
        return b"\n".join(self.words).decode().split("\n") if self.words else []

    @property
    def base_failed(self) -> bool:
        return any(rule.fails(self) for rule in BASE)


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a window of five words which the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    if len(words) > LONG:
        again = _repeats_of_long(words, window)
    else:
        grams = list(zip(*(words[i:] for i in range(window))))
        if len(set(grams)) == n:
            return 0
        counts = Counter(grams)
        again = np.fromiter((counts[g] > 1 for g in grams), bool, n)
    covered = np.zeros(n + window, np.int32)
    at = np.flatnonzero(again)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    return int((np.cumsum(covered)[: n + window - 1] > 0).sum())


def _repeats_of_long(words: list[bytes], window: int) -> np.ndarray:
    """Exact: windows are numbered by joining the ranks of a prefix and the next word, one word at a time."""
    ids = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    n, most, rank = len(ids) - window + 1, int(ids.max()) + 1, ids[: len(ids) - window + 1].copy()
    for i in range(1, window):
        rank = np.unique(rank * most + ids[i : i + n], return_inverse=True)[1]
    return np.bincount(rank)[rank] > 1


@dataclass(frozen=True)
class Rule:
    """fails(features) is true for a document to reject."""

    name: str
    fails: Callable[[Features], bool]


def _letters(f: Features) -> bool:
    """Fewer than 7 of 10 words have a letter."""
    return 10 * sum(_LETTER.search(w) is not None for w in f.strings) < 7 * f.n_words


def _shouting(f: Features) -> bool:
    """Over half of the words with a letter have no lower-case letter but two upper-case ones."""
    loud = sum(w.isupper() and len(w) > 1 for w in f.strings)
    return 2 * loud > f.n_words


BASE = (
    Rule("few_words", lambda f: f.n_words < 10),
    Rule("repeats", lambda f: 100 * f.n_repeat_words > 20 * f.n_words),
)
RULES = (
    *BASE,
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 20 * f.n_words),
    Rule("duplicate_lines", lambda f: 10 * f.n_dup_lines > 3 * len(f.lines)),
    Rule("exclamations", lambda f: 10 * f.raw.count(b"!") > 3 * f.n_words),
    Rule("few_letters", _letters),
    Rule("shouting", _shouting),
)


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> list[Rule]:
    """The rules by rejections per second on the first `sample` texts that Spark returns, best first; rules that reject
    nothing come last, cheapest first. A rule's cost is that of all it asks for, on a text of which nothing is known yet.
    The sample is measured by one task, of which the driver gets a row for each rule; it sets the order alone: the verdict
    of a cascade of independent rules is the same in any order."""
    ddl = "rule int, cost double, hits long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, hits = [1e-9] * len(rules), [0] * len(rules)
        for batch in batches:
            for part in common.slices(batch, "text"):
                for text in common.texts(part):
                    for i, rule in enumerate(rules):
                        began, f = time.perf_counter(), Features(text)
                        hits[i] += bool(rule.fails(f))
                        cost[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(cost), pa.array(hits, pa.int64())], schema=common.arrow_schema(ddl))

    cost, hits = [1e-9] * len(rules), [0] * len(rules)
    for r in docs.select("text").limit(sample).mapInArrow(run, ddl).collect():
        cost[r.rule] += r.cost
        hits[r.rule] += r.hits
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-hits[i] / cost[i], cost[i]))]


def verdict(f: Features, order: list[Rule]) -> bool:
    return not any(rule.fails(f) for rule in order)


def judge(docs: DataFrame, order: list[Rule] | None = None) -> DataFrame:
    """The measures and the verdict of every document, in one pass without a shuffle.

    Null and empty texts have no words and fail. A text just at a limit passes. Very long texts are measured whole, with
    windows found by sorting numbers instead of tuples. Repeated rows each get a row; ids may be null; an empty table
    gives none; other columns are ignored. Lines are equal if all their bytes are; lines without a word do not count."""
    order = order or ordered_rules(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = common.arrow_schema(RESULT)
        for batch in batches:
            for part in common.slices(batch, "text"):
                fs = [(f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed, verdict(f, order), len(f.lines)) for f in map(Features, common.texts(part))]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k.type) for c, k in zip(zip(*fs), list(schema)[1:]))], schema=schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, RESULT)


def keep(docs: DataFrame, order: list[Rule] | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that pass; a text is measured only as far as its first failing rule asks."""
    order = order or ordered_rules(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.freed(batches):
            for part in common.slices(batch, "text"):
                yield part.filter(pa.array([verdict(Features(t), order) for t in common.texts(part)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of all documents."""
    return judge(common.table(spark, sf_dir, "documents"))


#: The same rows in DuckDB's SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
    g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
    c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS again FROM g) WHERE again > 1) GROUP BY doc_id),
    m AS (SELECT doc_id, t, w, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
        coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines, length(t) - length(replace(t, '!', '')) AS calls,
        len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS lettered, len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x AND length(x) > 1)) AS loud
        FROM d LEFT JOIN c USING (doc_id)),
    b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > n_words OR word_chars NOT BETWEEN 2 * n_words AND 20 * n_words OR 10 * n_dup_lines > 3 * n_lines
        OR 10 * calls > 3 * n_words OR 10 * lettered < 7 * n_words OR 2 * loud > n_words) AS kept, n_lines FROM b
"""
