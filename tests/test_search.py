"""The DataFrame side: search, rewrites, guides, readers, SQL functions, streams, command line."""

import gzip

import pytest
from pyspark.sql import functions as F

from fuzzscan import cli, search, search_guides
from fuzzscan.functions import alphabets, cigar, sql
from fuzzscan.operators import relational
from fuzzscan.operators.search import Options, matches
from fuzzscan.plans.ordered import running_before
from fuzzscan.operators.guides import pam_filter
from fuzzscan.plans.rewrite import search_long
from fuzzscan.sources import readers, writers
from fuzzscan.streaming import search_stream, write_stream

TEXTS = [("a", "xxof thexx off the"), ("b", "nothing"), ("c", None), ("d", ""), ("e", "ôf the Of the")]


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "text_id string, text string")


def expected(k, pairs, **how):
    out = []
    for t, text in TEXTS:
        if text is not None:
            out += [(p, t, m.cost, m.strand, m.text_start, m.text_end, m.cigar) for p, s in pairs for _, _, m in matches([text.encode()], [s], Options(k, **how))]
    return sorted(out, key=str)


@pytest.mark.parametrize("prefilter", [True, False])
@pytest.mark.parametrize("mode", ["local", "all"])
def test_search(texts, mode, prefilter):
    pairs = [("p", b"of the"), ("q", b"nothing")]
    for k in (0, 1):
        got = rows(search(texts, pairs, k, mode=mode, prefilter=prefilter), "pattern_id", "text_id", "cost", "strand", "text_start", "text_end", "cigar")
        assert got == expected(k, pairs, mode=mode) and got


def test_patterns_from_a_table_in_blocks(spark, texts, monkeypatch):
    from fuzzscan.operators import search as module

    patterns = spark.createDataFrame([("p", b"of the"), ("q", b"nothing"), ("n", None)], "pattern_id string, pattern binary")
    monkeypatch.setattr(module.pattern_blocks, "__defaults__", (3,))
    assert rows(search(texts, patterns, 1), "pattern_id", "text_id", "text_end") == rows(search(texts, [("p", b"of the"), ("q", b"nothing")], 1), "pattern_id", "text_id", "text_end")
    with pytest.raises(ValueError):
        search(texts, [], 1)
    with pytest.raises(ValueError):
        search(texts, [("x", b"")], 1)


def test_validation(spark):
    seqs = spark.createDataFrame([("a", "ACGTACGT"), ("b", "ACGT!")], "text_id string, text string")
    assert rows(search(seqs, [("p", b"ACGT")], 0, alphabet="dna", rc=False, validate="filter"), "text_id") == [("a",), ("a",)]
    with pytest.raises(Exception, match="is not dna"):
        search(seqs, [("p", b"ACGT")], 0, alphabet="dna", validate="error").collect()


@pytest.mark.parametrize("chunk", [37, 100, 5000])
def test_long_texts(spark, chunk):
    """Texts in parts give the rows of the whole texts: repeated and null ids, runs across parts, filters, options."""
    import random

    rng = random.Random(2)
    seqs = [(str(i % 3), "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate((0, 5, 700, 900, 36, 37, 38))] + [("n", None), (None, "ACGGATTACATT" * 20), ("r", "A" * 300), (None, "GATTACA")]
    df = spark.createDataFrame(seqs, "text_id string, text string").repartition(2)
    for how in ({"mode": "local"}, {"mode": "all"}, {"mode": "local", "with_alignment": False, "seeded": False}, {"mode": "all", "rc": False, "end_filter": pam_filter(b"AGG")}):
        plain = search(df, [("p", b"GATTACA"), ("p", b"AAAAAA"), ("q", b"CG")], 2, alphabet="dna", **how)
        assert rows(search_long(df, [("p", b"GATTACA"), ("p", b"AAAAAA"), ("q", b"CG")], 2, chunk=chunk, alphabet="dna", **how), *plain.columns) == rows(plain, *plain.columns)
    guides = (["GATTANNGG", "CCATANNGG"], 2)
    assert rows(search_guides(df, *guides, chunk=chunk), "guide_id", "text_id", "strand", "start", "end", "cigar") == rows(search_guides(df, *guides), "guide_id", "text_id", "strand", "start", "end", "cigar")


def test_long_texts_are_validated(spark):
    df = spark.createDataFrame([("a", "ACGT" * 30), ("b", "ACGT" * 30 + "!")], "text_id string, text string")
    how = {"chunk": 50, "alphabet": "dna", "rc": False}
    assert {r.text_id for r in search_long(df, [("p", b"ACGT")], 0, validate="filter", **how).collect()} == {"a"}
    with pytest.raises(Exception, match="not dna"):
        search_long(df, [("p", b"ACGT")], 0, validate="error", **how).collect()
    with pytest.raises(ValueError):
        search_long(df, [("p", b"ACGT")], 0, end_filter=lambda *_: True, **how)


def test_part_minima():
    """Parts of random ends, and how runs at their edges were entered, against the whole."""
    import random

    import numpy as np

    from fuzzscan.operators.kernel import Ends, local_minima
    from fuzzscan.plans.rewrite import part_minima

    rng = random.Random(4)
    for _ in range(300):
        n, size = rng.randrange(1, 40), rng.randrange(1, 9)
        e = [(i, rng.randint(0, 1)) for i in range(n + 1) if rng.random() < 0.9]
        whole = Ends(np.zeros(len(e), np.int64), *(np.array([x[j] for x in e], np.int64) for j in (0, 1)))
        got, was = [], None
        for low in range(0, n, size):
            high = min(low + size, n)
            part = whole.where((whole.end >= low) & (whole.end <= high + 1))
            minima, open_, edges = part_minima(part, np.array([low]), np.array([high]))
            got += [x for x, m, o in zip(part.end.tolist(), minima.tolist(), open_.tolist()) if m and (not o or was)]
            through, entered = edges.get(0, (False, None))
            was = was if through else entered
        assert got == local_minima(whole).end.tolist()


def test_guides(spark):
    seqs = spark.createDataFrame([("a", "TTGATTACAGGTAGGTT"), ("b", "TTGATTACAGGTACGTT"), ("c", "CCTACCTGTAATC"), ("d", "NNNNNNNNNNNNN")], "text_id string, text string")
    guide = ["GATTACAGGTNGG", ""]
    strict = rows(search_guides(seqs, guide, 1, max_n_frac=0.1), "guide_id", "text_id", "strand", "cost")
    assert ("guide_1", "a", "+", 0) in strict and ("guide_1", "c", "-", 0) in strict and not any(r[1] in "bd" for r in strict)
    assert any(r[1] == "b" for r in rows(search_guides(seqs, guide, 1, allow_pam_edits=True), "guide_id", "text_id"))
    assert not any(r[2] == "-" for r in rows(search_guides(seqs, guide, 1, rc=False), "guide_id", "text_id", "strand"))
    assert any(r[0] == "d" for r in rows(search_guides(seqs, guide, 0), "text_id"))
    assert search_guides(seqs, [" "], 1).count() == 0
    with pytest.raises(ValueError):
        search_guides(seqs, ["ACGTGG", "ACGTGA"], 1)
    with pytest.raises(ValueError):
        search_guides(seqs, guide, 1, max_n_frac=2)


def test_relational(texts, spark):
    found = search(texts, [("p", b"of the")], 1)
    best = {r.text_id: r for r in relational.best_hits(found).collect()}
    assert best["a"].cost == 0 and best["a"].text_end == 8 and set(best) == {"a", "e"}
    assert rows(relational.with_hit(texts, found), "text_id") == [("a",), ("e",)]
    assert rows(relational.without_hit(texts, found), "text_id") == [("b",), ("c",), ("d",)]
    assert relational.summary(found).first()[0] == found.count()
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = {r.id: r.before for r in running_before(df, "id", "v", 16).collect()}
    total = 0
    for i in range(1000):
        assert got[i] == total
        total += i % 7
    names = df.select(F.format_string("k%05d", F.col("id") * F.col("id") * F.col("id") % 99991).alias("id"), "v").dropDuplicates(["id"])  # strings, unevenly spread
    got = {r.id: (r.before, r.v) for r in running_before(names, "id", "v", 16).collect()}
    total = 0
    for key in sorted(got):
        assert got[key][0] == total
        total += got[key][1]


def test_columns(spark):
    df = spark.createDataFrame([("ACGTNRYX", "ACGTACGT"), ("acgt", "NNNN"), ("A", "XX")], "a string, b string")
    got = df.select(alphabets.reverse_complement_col(F.col("a"), "iupac"), alphabets.valid_seq_col(F.col("b"), "dna"), alphabets.matching_seq_col(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("XRYNACGT", True, False), ("acgt", False, True), ("T", False, False)]


def test_readers_and_writers(spark, tmp_path):
    fasta = tmp_path / "x.fasta"
    fasta.write_text(">one > first\nACGT\nTTGA\n>two\r\nGG\r\n\n>empty\n")
    want = [("empty", b""), ("one > first", b"ACGTTTGA"), ("two", b"GG")]
    assert sorted((r.text_id, bytes(r.text)) for r in readers.read_fasta(spark, str(fasta)).collect()) == want
    zipped = tmp_path / "x.fa.gz"
    zipped.write_bytes(gzip.compress(fasta.read_bytes()))
    assert sorted((r.text_id, bytes(r.text)) for r in readers.read_fasta(spark, str(zipped)).collect()) == want
    assert sorted((r.text_id, bytes(r.text)) for r in readers.read_fastx(spark, str(zipped)).collect()) == want
    assert {r.text_id for r in readers.read_fasta(spark, str(fasta), "first_token").collect()} == {"one", "two", "empty"}
    (tmp_path / "x.fastq").write_text("@r1 x\nACGT\n+\n@@@@\n@r2\nGG\nTT\n+r2\n!!\n@!\n")
    assert sorted((r.text_id, bytes(r.text)) for r in readers.read_fastx(spark, str(tmp_path / "x.fastq")).collect()) == [("r1 x", b"ACGT"), ("r2", b"GGTT")]
    found = search(readers.read_fasta(spark, str(fasta)), readers.inline_pattern("ACGT"), 0, alphabet="dna", rc=False)
    writers.write_tsv(writers.search_table(found), str(tmp_path / "out"))
    lines = [x for f in (tmp_path / "out").glob("part*") for x in f.read_text().splitlines()]
    assert "pattern\tone > first\t0\t+\t0\t4\tACGT\t4=" in lines and "\t".join(writers.SEARCH_COLUMNS) in lines


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "t.fasta").write_text(">t\nGGGGTAGCTAGACGGGGTCTAGCTAGGG\n")
    assert cli.main(["search", "-p", "TAGCTAGAC", "-k", "0", "-a", "dna", str(tmp_path / "t.fasta")], spark) == 0
    assert "pattern\tt\t0\t+\t4\t13\tTAGCTAGAC\t9=" in capsys.readouterr().out
    (tmp_path / "g.txt").write_text("GTAGCTAGACGGG\n\n")
    assert cli.main(["guides", "-g", str(tmp_path / "g.txt"), "-k", "1", "-o", str(tmp_path / "o"), str(tmp_path / "t.fasta")], spark) == 0
    assert list((tmp_path / "o").glob("part*"))
    assert cli.main(["selftest"]) == 0


def test_sql_functions(spark, texts):
    sql.register(spark)
    texts.createOrReplaceTempView("t")
    got = spark.sql("SELECT t.text_id, m.text_end, m.cost FROM t, LATERAL fuzzy_search(t.text, 'of the', 1, 'ascii', 'local', false) m")
    assert rows(got, "text_id", "text_end", "cost") == rows(search(texts, [("p", b"of the")], 1), "text_id", "text_end", "cost")
    one = spark.sql("SELECT fuzzy_count(text, 'of the', 1, 'ascii') n, fuzzy_best_cost(text, 'of the', 1, 'ascii') c FROM t WHERE text_id = 'a'").first()
    assert one.n == 2 and one.c == 0
    assert spark.sql("SELECT reverse_complement_dna('ACGTT')").first()[0] == "AACGT"
    over = spark.sql("SELECT m.cost, m.text_start, m.text_end, m.cigar, m.pattern_start FROM fuzzy_search('GTXXXNNN', 'ACGT', 1, 'iupac', 'local', false, CAST(0.5 AS DOUBLE)) m ORDER BY text_start")
    assert [tuple(r) for r in over.collect()][0] == (1, 0, 2, "2=", 2)
    for a, b, want in (("a", "N", True), ("C", "y", True), ("A", "C", False), ("X", "X", False), ("!", "!", False), ("AC", "A", False)):
        assert spark.sql(f"SELECT iupac_match('{a}', '{b}')").first()[0] is want
    for c in ("2=X3=", "12=I2D", "", "I", "D="):
        assert [tuple(x) for x in spark.sql(f"SELECT cigar_path('{c}', 1, 4L)").first()[0]] == cigar.path(c, 1, 4)


def test_stream(spark, texts, tmp_path):
    texts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(texts.schema).parquet(str(tmp_path / "in"))
    query = write_stream(search_stream(stream, [("p", b"of the")], 1), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    plain = search(texts, [("p", b"of the")], 1)
    assert rows(spark.read.parquet(str(tmp_path / "out")), *plain.columns) == rows(plain, *plain.columns)
    with pytest.raises(ValueError):
        search_stream(texts, [("p", b"x")], 1)
