"""Queries of the search engine over the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .functions import alphabets, cigar, sql
from .operators import relational
from .operators.guides import search_guides
from .operators.search import search
from .plans.rewrite import search_long

Query = Callable[[SparkSession, str], DataFrame]

# ---------------------------------------------------------------- texts, the same in Spark and in SQL
#: Text with one byte for each character, so that positions are equal on both sides.
PLAIN = ("regexp_replace(text, '[^ -~\\\\n]', '?')", "regexp_replace(text, '[^ -~\\n]', '?', 'g')")
# Spark's upper gives some characters two capitals (ß: SS), DuckDB's gives each one; so capitals are made of what is kept.
#: The bases of a text.
BASES = ("upper(regexp_replace(text, '[^ACGTacgt]', ''))", "regexp_replace(upper(text), '[^ACGT]', '', 'g')")
#: The IUPAC codes of a text; documents in capitals, or with few letters, can hold bases alone or nothing. The long s is an S.
CODES = ("upper(regexp_replace(text, '[^ACGTURYKMBVDHSWNXacgturykmbvdhswnx\u017f]', ''))", "regexp_replace(upper(text), '[^ACGTURYKMBVDHSWNX]', '', 'g')")


def _docs(spark: SparkSession, sf: str, text: tuple[str, str], table: str = "documents", key: str = "doc_id") -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet").select(F.col(key).cast("string").alias("text_id"), F.expr(text[0]).alias("text"))


def _where(df: DataFrame) -> DataFrame:
    """doc_id, strand, pos, cost: pos is the searched strand's end, text_end on + and text_start on -."""
    pos = F.when(F.col("strand") == "+", F.col("text_end")).otherwise(F.col("text_start"))
    return df.select(F.col("text_id").cast("long").alias("doc_id"), "strand", pos.alias("pos"), "cost")


# ---------------------------------------------------------------- SQL of the search


def _ends_sql(pattern: str, k: int, text: str, extra: str = "", table: str = "documents", key: str = "doc_id") -> str:
    """doc_id, e, c, n and tail (the text before e): all ends with at most k edits, by comparing the pattern with every
    substring whose length is within k of its own. Texts are cut into overlapping pieces, so that no substring is taken
    far inside a long string."""
    m = len(pattern)
    quoted, reach = pattern.replace("'", "''"), m + k
    lengths = list(range(max(0, m - k), m + k + 1))
    costs = ", ".join(f"levenshtein('{quoted}', right(tail, {n}))" for n in lengths)
    cut = f"SELECT doc_id, n, b, substring(s, greatest(b - {reach}, 0) + 1, b + 64 - greatest(b - {reach}, 0)) AS piece, b - greatest(b - {reach}, 0) AS lead FROM (SELECT doc_id, s, length(s) AS n, unnest(range(0, length(s), 64)) AS b FROM (SELECT {key} AS doc_id, {text} AS s FROM {table}))"
    ends = f"SELECT doc_id, n, b + i AS e, substring(piece, greatest(lead + i - {reach}, 0) + 1, least(lead + i, {reach})) AS tail FROM (SELECT *, unnest(range(1, length(piece) - lead + 1)) AS i FROM ({cut}))"
    return f"SELECT * FROM (SELECT doc_id, e, n, tail, least({costs}) AS c FROM ({ends})) WHERE c <= {k} {extra}"


def _local_sql(ends: str) -> str:
    """Of the ends, the last of each run of equal cost that is lower than both sides."""
    return f"""SELECT doc_id, max(e) AS e, any_value(n) AS n, any_value(c) AS c FROM (
        SELECT *, sum(CASE WHEN pe = e - 1 AND pc = c THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY e) AS run FROM (
            SELECT doc_id, e, n, c, lag(e) OVER w AS pe, lag(c) OVER w AS pc, lead(e) OVER w AS ne, lead(c) OVER w AS nc FROM ({ends}) WINDOW w AS (PARTITION BY doc_id ORDER BY e)))
        GROUP BY doc_id, run
        HAVING NOT coalesce(bool_or(pe = e - 1 AND pc < c), false) AND NOT coalesce(bool_or(ne = e + 1 AND nc < c), false)"""


def _placed_sql(ends: str, strand: str) -> str:
    pos = "e" if strand == "+" else "n - e"
    return f"SELECT doc_id, '{strand}' AS strand, CAST({pos} AS BIGINT) AS pos, CAST(c AS INTEGER) AS cost FROM ({ends})"


def _search_sql(pattern: str, k: int, text: str, mode: str, rc: bool = False) -> str:
    pick = _local_sql if mode == "local" else lambda x: x
    made = _placed_sql(pick(_ends_sql(pattern, k, text)), "+")
    if rc:
        turned = alphabets.complement(pattern.encode(), "dna").decode()
        made += " UNION ALL " + _placed_sql(pick(_ends_sql(turned, k, f"reverse({text})")), "-")
    return made


# ---------------------------------------------------------------- queries

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLE_SQL[name] = oracle


def _search_query(name: str, pattern: str, k: int, text: tuple[str, str], alphabet: str, mode: str, rc: bool = False, sql_text: str | None = None, sql_pattern: str | None = None, **how) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _where(search(_docs(spark, sf, text), [("p", pattern.encode())], k, alphabet=alphabet, mode=mode, rc=rc, **how))

    _add(name, run, _search_sql(sql_pattern or pattern, k, sql_text or text[1], mode, rc))


_search_query("ascii_exact_all", "the", 0, PLAIN, "ascii", "all")
_search_query("ascii_local_k0", "anan", 0, PLAIN, "ascii", "local")
_search_query("ascii_all_k1", "of the", 1, PLAIN, "ascii", "all")
_search_query("ascii_all_k2", "license", 2, PLAIN, "ascii", "all")
_search_query("ascii_local_k1", "of the", 1, PLAIN, "ascii", "local")
_search_query("ascii_local_k2", "pathetic", 2, PLAIN, "ascii", "local")
_search_query("ascii_local_k1_unfiltered", "of the", 1, PLAIN, "ascii", "local", prefilter=False, seeded=False)
_search_query("ascii_ci_local_k1", "Licensed", 1, PLAIN, "ascii_ci", "local", sql_text=f"lower({PLAIN[1]})", sql_pattern="licensed")
_search_query("dna_fwd_k1", "ACGTTA", 1, BASES, "dna", "local")
_search_query("dna_rc_k1", "GATTACA", 1, BASES, "dna", "local", rc=True)
_search_query("dna_rc_k2", "TACACAGTCAAG", 2, BASES, "dna", "local", rc=True)
_search_query("dna_all_rc_k2", "ATCATGCTAGC", 2, BASES, "dna", "all", rc=True)


def iupac_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _where(search(_docs(spark, sf, BASES), [("p", b"ANRYT")], 0, alphabet="iupac", mode="all", rc=False))


_add("iupac_exact", iupac_exact, f"""SELECT doc_id, '+' AS strand, CAST(e AS BIGINT) AS pos, CAST(0 AS INTEGER) AS cost FROM (
    SELECT doc_id, s, unnest(range(5, length(s) + 1)) AS e FROM (SELECT doc_id, {BASES[1]} AS s FROM documents) WHERE length(s) >= 5)
    WHERE regexp_full_match(substring(s, e - 4, 5), 'A[ACGT][AG][CT]T')""")


def iupac_rc_k2(spark: SparkSession, sf: str) -> DataFrame:
    return _where(search(_docs(spark, sf, BASES), [("p", b"GATNRYCAGTA")], 2, alphabet="iupac"))


def _ends_rc_sql(pattern: str, k: int, text: str, alphabet: str) -> str:
    """doc_id, strand, pos and cost of local minima on both strands, by dynamic programming over lists."""
    parts = []
    for strand, needle, own in (("+", pattern, text), ("-", alphabets.complement(pattern.encode(), alphabet).decode(), f"reverse({text})")):
        parts.append(_placed_sql(_local_sql(oracles.ends_sql(oracles.source_sql(needle, own, alphabet), k)), strand))
    return " UNION ALL ".join(parts)


_add("iupac_rc_k2", iupac_rc_k2, _ends_rc_sql("GATNRYCAGTA", 2, BASES[1], "iupac"))

#: Columns of a whole match but the pattern's and the text's id.
_ROW = ("strand", "cost", "text_start", "text_end", "pattern_start", "pattern_end", "match_region", "cigar")


def _rows(found: DataFrame) -> DataFrame:
    return found.select(F.col("text_id").cast("long").alias("doc_id"), *_ROW)


def _rows_sql(*args, **how) -> str:
    return f"SELECT doc_id, {', '.join(_ROW)} FROM ({oracles.rows_sql(*args, **how)})"


_OVER = "GATTACAG"


def overhang(spark: SparkSession, sf: str) -> DataFrame:
    """A pattern that may hang over either end of a text at half a cost for each character."""
    return _rows(search(_docs(spark, sf, BASES), [("p", _OVER.encode())], 1, alphabet="iupac", rc=True, alpha=0.5))


_add("overhang_alpha05", overhang, _rows_sql(_OVER, 1, BASES[1], "iupac", _local_sql, rc=True, alpha=0.5))
_LONGER = "TACACAGTCAAG"
_add("dna_rows_rc_k3", lambda spark, sf: _rows(search(_docs(spark, sf, BASES), [("p", _LONGER.encode())], 3, alphabet="dna")), _rows_sql(_LONGER, 3, BASES[1], "dna", _local_sql, rc=True))
_add("long_rows_rc_k3", lambda spark, sf: _rows(search_long(_docs(spark, sf, BASES), [("p", _LONGER.encode())], 3, chunk=1024, alphabet="dna")), ORACLE_SQL["dna_rows_rc_k3"])

GUIDES = ["GATTACAGGTNGG", "CCGATTAGCANGG"]
_PLAIN_GUIDE = "ACATTACGTGG"


def guides(spark: SparkSession, sf: str, allow: bool = False, text: tuple[str, str] = BASES, guides_: list[str] | None = None, frac: float = 1.0, k: int = 2) -> DataFrame:
    found = search_guides(_docs(spark, sf, text), guides_ or [_PLAIN_GUIDE], k, allow_pam_edits=allow, max_n_frac=frac)
    pos = F.when(F.col("strand") == "+", F.col("end")).otherwise(F.col("start"))
    return found.select(F.col("text_id").cast("long").alias("doc_id"), "guide_id", "strand", pos.alias("pos"), "cost")


def _guides_sql(pam: bool) -> str:
    turned = alphabets.complement(_PLAIN_GUIDE.encode(), "dna").decode()
    parts = []
    for strand, pattern, text in (("+", _PLAIN_GUIDE, BASES[1]), ("-", turned, f"reverse({BASES[1]})")):
        extra = f"AND right(tail, 3) = '{pattern[-3:]}'" if pam else ""
        parts.append(_placed_sql(_ends_sql(pattern, 2, text, extra), strand))
    return f"SELECT doc_id, 'guide_1' AS guide_id, strand, pos, cost FROM ({' UNION ALL '.join(parts)})"


_add("guides_pam", guides, _guides_sql(True))
_add("guides_pam_edits", lambda spark, sf: guides(spark, sf, True), _guides_sql(False))
#: The bases of a text, with N for its digits.
WITH_N = ("translate(upper(regexp_replace(text, '[^ACGTacgt0-9]', '')), '0123456789', 'NNNNNNNNNN')", "translate(regexp_replace(upper(text), '[^ACGT0-9]', '', 'g'), '0123456789', 'NNNNNNNNNN')")


def _guides_nfrac_sql(k: int, frac: float) -> str:
    """All ends whose last characters match the PAM, by their alignments."""
    codes = lambda c: oracles.equal_to(c, "iupac")
    parts = []
    for number, guide in enumerate(GUIDES, 1):
        pams = {strand: [codes(c) for c in (guide if strand == "+" else alphabets.complement(guide.encode(), "iupac").decode())[-3:]] for strand in "+-"}
        rows = []
        for strand in "+-":
            near = " AND ".join(f"contains('{pams[strand][i]}', substring(s, e - {2 - i}, 1))" for i in range(3))
            whole = oracles.rows_sql(guide, k, WITH_N[1], "iupac", lambda x: f"SELECT * FROM ({x}) WHERE e > 0", rc=True, keep=f"e >= 3 AND {near}")
            rows.append(f"SELECT * FROM ({whole}) WHERE strand = '{strand}'")
        parts.append(f"SELECT doc_id, 'guide_{number}' AS guide_id, strand, CASE WHEN strand = '+' THEN text_end ELSE text_start END AS pos, cost, match_region FROM ({' UNION ALL '.join(rows)})")
    return f"SELECT doc_id, guide_id, strand, pos, cost FROM ({' UNION ALL '.join(parts)}) WHERE (length(match_region) - length(replace(match_region, 'N', ''))) / length(match_region) <= {frac}"


_add("guides_nfrac", lambda spark, sf: guides(spark, sf, text=WITH_N, guides_=GUIDES, frac=0.1, k=3), _guides_nfrac_sql(3, 0.1))


def long_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Each text in parts of 2 KB, as few very long texts would be searched; minima by windows."""
    return _where(search_long(_docs(spark, sf, BASES), [("p", b"GATTACA")], 1, chunk=2048, alphabet="dna"))


_add("long_texts_rc_k1", long_texts, ORACLE_SQL["dna_rc_k1"])


def udtf(spark: SparkSession, sf: str) -> DataFrame:
    """The table function in a lateral join."""
    sql.register(spark)
    _docs(spark, sf, PLAIN).createOrReplaceTempView("fuzzscan_docs")
    found = spark.sql("SELECT d.text_id, m.* FROM fuzzscan_docs d, LATERAL fuzzy_search(d.text, 'pathetic', 2, 'ascii', 'local', false) m")
    return _where(found)


_add("udtf_lateral", udtf, ORACLE_SQL["ascii_local_k2"])

# -------------------------------------------------- benchmark items in documents


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").cast("string").alias("pattern_id"), F.col("text").cast("binary").alias("pattern"))


def contamination(spark: SparkSession, sf: str) -> DataFrame:
    """Whole benchmark items in documents with at most 8 edits: the best hit of each item in each document."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("text_id"), "text")
    best = relational.best_hits(search(docs, _items(spark, sf), 8))
    return best.select(F.col("pattern_id").cast("long").alias("item_id"), F.col("text_id").cast("long").alias("doc_id"), "cost", "text_start", "text_end", "cigar")


def contamination_exact(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("text_id"), "text")
    found = search(docs, _items(spark, sf), 0, mode="all").groupBy("pattern_id", "text_id").agg(F.count("*").alias("hits"))
    return found.select(F.col("pattern_id").cast("long").alias("item_id"), F.col("text_id").cast("long").alias("doc_id"), "hits")


def contamination_sql(k: int) -> str:
    """Items and documents that share one of k + 1 pieces of the item, and in those pairs all ends, byte by byte. Too slow
    for whole tables, where lists of a long document are gone through for each place of an item; for small ones."""
    piece = "substring(text, 1 + length(text) * i // {n}, length(text) * (i + 1) // {n} - length(text) * i // {n})".format(n=k + 1)
    pairs = f"SELECT DISTINCT d.doc_id, b.item_id, d.text AS s, b.text AS t FROM documents d JOIN (SELECT item_id, text, {piece} AS piece FROM benchmark, range({k + 1}) AS r(i)) b ON contains(d.text, b.piece)"
    source = f"SELECT doc_id * 1000000 + item_id AS doc_id, {oracles.utf8('s')} AS chars, {oracles.utf8('t')} AS p FROM ({pairs})"
    best = f"SELECT * FROM ({_local_sql(oracles.ends_sql(source, k, oracles.SAME))}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c, e) = 1"
    return f"SELECT CAST(doc_id % 1000000 AS BIGINT) AS item_id, CAST(doc_id // 1000000 AS BIGINT) AS doc_id, c AS cost, text_start, text_end, cigar FROM {oracles.aligned_sql(source, best, k, oracles.SAME)}"


_add("benchmark_contamination", contamination)
_add("benchmark_exact", contamination_exact, """SELECT b.item_id, d.doc_id, CAST((length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text) AS BIGINT) AS hits
    FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")

# -------------------------------------------------- what is asked of matches

_PATH = "worthless"
_HITS = " UNION ALL ".join(f"SELECT '{n}' AS pattern_id, * FROM ({_search_sql(p, 2, PLAIN[1], 'local')})" for n, p in (("a", _PATH), ("b", "licensed under")))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return search(_docs(spark, sf, PLAIN), [("a", _PATH.encode()), ("b", b"licensed under")], 2)


def best_hit(spark: SparkSession, sf: str) -> DataFrame:
    return relational.best_hits(_hits(spark, sf)).select("pattern_id", F.col("text_id").cast("long").alias("doc_id"), "cost", F.col("text_end").alias("pos"))


_add("best_hit", best_hit, f"SELECT pattern_id, doc_id, cost, pos FROM ({_HITS}) QUALIFY row_number() OVER (PARTITION BY pattern_id, doc_id ORDER BY cost, pos) = 1")
_add("hits_per_pattern", lambda spark, sf: relational.hits_per_pattern(_hits(spark, sf)), f"SELECT pattern_id, count(*) AS hits, count(DISTINCT doc_id) AS texts, min(cost) AS best_cost FROM ({_HITS}) GROUP BY pattern_id")
_add("strand_counts", lambda spark, sf: relational.strand_counts(search(_docs(spark, sf, BASES), [("p", b"GATTACA")], 1, alphabet="dna")), f"SELECT 'p' AS pattern_id, strand, count(*) AS hits FROM ({ORACLE_SQL['dna_rc_k1']}) GROUP BY strand")


def semi(spark: SparkSession, sf: str, keep: bool = True) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return (relational.with_hit if keep else relational.without_hit)(docs, _hits(spark, sf), "doc_id").select("doc_id", "lang", "source")


_add("semi_any_hit", semi, f"SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM ({_HITS}))")
_add("anti_no_hit", lambda spark, sf: semi(spark, sf, False), f"SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_HITS}))")


def topk(spark: SparkSession, sf: str) -> DataFrame:
    found = _hits(spark, sf).groupBy(F.col("text_id").cast("long").alias("doc_id")).agg(F.count("*").alias("hits"))
    return found.orderBy(F.desc("hits"), "doc_id").limit(10)


_add("topk_docs", topk, f"SELECT doc_id, count(*) AS hits FROM ({_HITS}) GROUP BY doc_id ORDER BY hits DESC, doc_id LIMIT 10")


def by_label(spark: SparkSession, sf: str) -> DataFrame:
    """Matches by the label of their document."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumn("text_id", F.col("doc_id").cast("string"))
    return _hits(spark, sf).join(labels, "text_id").groupBy("pattern_id", "toxic").agg(F.count("*").alias("hits"))


_add("hits_by_label", by_label, f"SELECT pattern_id, toxic, count(*) AS hits FROM ({_HITS}) JOIN labels USING (doc_id) GROUP BY pattern_id, toxic")
_add("summary", lambda spark, sf: relational.summary(_hits(spark, sf)), f"SELECT count(*) AS total_found FROM ({_HITS})")


def region_check(spark: SparkSession, sf: str) -> DataFrame:
    """Edit distance of pattern and matched region, by Spark's own function, and edits in the CIGAR."""
    found = search(_docs(spark, sf, PLAIN), [("p", _PATH.encode())], 2, mode="all")
    return found.select(F.col("text_id").cast("long").alias("doc_id"), F.col("text_end").alias("pos"), F.levenshtein(F.lit(_PATH), F.col("match_region")).alias("distance"), cigar.cigar_cost_col(F.col("cigar")).alias("edits"))


_add("match_region_distance", region_check, f"SELECT doc_id, CAST(e AS BIGINT) AS pos, CAST(c AS INTEGER) AS distance, CAST(c AS INTEGER) AS edits FROM ({_ends_sql(_PATH, 2, PLAIN[1])})")


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """Where each operation of an alignment stands in text and pattern."""
    found = search(_docs(spark, sf, PLAIN), [("p", _PATH.encode())], 2)
    steps = F.posexplode(cigar.path_col(F.col("cigar"), F.col("pattern_start"), F.col("text_start"))).alias("step", "at")
    return found.select(F.col("text_id").cast("long").alias("doc_id"), "text_end", steps).select("doc_id", "text_end", "step", "at.pattern_pos", "at.text_pos")


_STEPS = "length(left(ops, step)) - length(replace(left(ops, step), '{op}', ''))"
_add("alignment_paths", paths, f"""SELECT doc_id, text_end, CAST(step AS INTEGER) AS step, CAST(pattern_start + step - ({_STEPS.format(op='I')}) AS INTEGER) AS pattern_pos, CAST(text_start + step - ({_STEPS.format(op='D')}) AS BIGINT) AS text_pos
    FROM (SELECT *, unnest(range(0, length(ops))) AS step FROM ({oracles.rows_sql(_PATH, 2, PLAIN[1], 'ascii', _local_sql)}))""")


def names(spark: SparkSession, sf: str) -> DataFrame:
    """Part names that hold a name with at most two edits."""
    parts = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").cast("string").alias("text_id"), F.lower("p_name").alias("text"))
    return _where(search(parts, [("p", _JOINED.encode())], 2)).withColumnRenamed("doc_id", "p_partkey")


_JOINED = "red widget"
_add("fuzzy_join_names", names, f"SELECT doc_id AS p_partkey, strand, pos, cost FROM ({_placed_sql(_local_sql(_ends_sql(_JOINED, 2, 'lower(p_name)', table='part', key='p_partkey')), '+')})")
_add("batch_plan", lambda spark, sf: relational.batch_plan(spark.read.parquet(f"{sf}/documents.parquet"), text_id="doc_id").select(F.col("text_id").alias("doc_id"), "batch_id"),
     "SELECT doc_id, CAST(floor(sum(strlen(text)) OVER (ORDER BY doc_id) / 262144) AS BIGINT) AS batch_id FROM documents")

# -------------------------------------------------- scalar functions


def _scalar(name: str, columns: Callable[[Column], dict[str, Column]], text: tuple[str, str], sql_columns: dict[str, str]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.expr(text[0]).alias("s"))
        return docs.select("doc_id", *[c.alias(n) for n, c in columns(F.col("s")).items()])

    _add(name, run, f"SELECT doc_id, {', '.join(f'{c} AS {n}' for n, c in sql_columns.items())} FROM (SELECT doc_id, {text[1]} AS s FROM documents)")


_DNA = "'ACGTacgt', 'TGCAtgca'"
_scalar("complement", lambda s: {"dna": alphabets.complement_col(s), "iupac": alphabets.complement_col(s, "iupac")}, PLAIN, {"dna": f"translate(s, {_DNA})", "iupac": "translate(s, 'ACGTURYKMBVDHSWNXacgturykmbvdhswnx', 'TGCAAYRMKVBHDSWNXtgcaayrmkvbhdswnx')"})
_scalar("reverse_complement", lambda s: {"rc": alphabets.reverse_complement_col(s)}, BASES, {"rc": f"reverse(translate(s, {_DNA}))"})
_scalar("valid_seq", lambda s: {"dna": alphabets.valid_seq_col(s, "dna"), "iupac": alphabets.valid_seq_col(s, "iupac"), "ascii": alphabets.valid_seq_col(s, "ascii")}, WITH_N, {"dna": "regexp_full_match(s, '[ACGTacgt]*')", "iupac": "regexp_full_match(s, '[ACTUGNRYSWKMBDHVXactugnryswkmbdhvx]*')", "ascii": "true"})
_scalar("n_fraction", lambda s: {"frac": alphabets.n_fraction_col(s)}, WITH_N, {"frac": "CAST(length(s) - length(replace(upper(s), 'N', '')) AS DOUBLE) / nullif(length(s), 0)"})
_CASES = " ".join(f"WHEN '{c}' THEN {v}" for c, v in alphabets.IUPAC_CODES.items())
def _code_sql(char: str) -> str:
    return f"CASE {char} {_CASES} ELSE 0 END"


_scalar("iupac_code", lambda s: {"code": alphabets.iupac_code_col(F.substring(s, 1, 1)), "meets": alphabets.is_match_col(F.substring(s, 1, 1), F.right(s, F.lit(1)), "iupac")}, CODES,
        {"code": f"CAST({_code_sql('substring(s, 1, 1)')} AS INTEGER)", "meets": f"(({_code_sql('substring(s, 1, 1)')}) & ({_code_sql('right(s, 1)')})) <> 0"})
# a whole text and itself backwards
_scalar("matching_seq", lambda s: {"ok": alphabets.matching_seq_col(s, F.reverse(s))}, WITH_N,
        {"ok": f"length(s) = 0 OR list_bool_and(list_transform(list_zip(string_split(s, ''), string_split(reverse(s), '')), lambda x: (({_code_sql('x[1]')}) & ({_code_sql('x[2]')})) <> 0))"})


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship query."""
    return contamination(spark, sf)
