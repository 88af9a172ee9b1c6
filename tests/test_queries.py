"""Every query of the engine runs, and gives the rows of its SQL."""

import os
import subprocess
import sys

import pytest

from fuzzscan import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def table(df):
    df = df[sorted(df.columns)].astype(str)
    return df.columns.tolist(), sorted(map(tuple, df.to_numpy().tolist()))


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLE_SQL:
        assert table(got) == table(duck.execute(queries.ORACLE_SQL[name]).df())
    else:
        assert len(got)


@pytest.mark.parametrize("name", ["iupac_code", "matching_seq", "reverse_complement", "valid_seq", "n_fraction", "iupac_exact", "dna_rc_k1"])
def test_letters_with_several_capitals(spark, tmp_path, name):
    """Letters whose capitals are two letters add no code and no base, first, last or inside."""
    import duckdb

    letters = "ß\u1e9e\u0149\u01f0\u0390\u0131\u0130\u017f\u212a\u1e96\u1e97\u1e98\u1e99\u1e9a\ufb00\ufb01\ufb02\ufb03\ufb04\ufb05\ufb06\U00010428"
    texts = [x for c in letters for x in (c, f"{c}Acht\n", f"Nur y{c}.", f"gat{c}taca", f"1aNc{c}act{c}")]
    docs = list(enumerate(["", "Stchß.", "Öß in", *texts]))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = table(queries.QUERIES[name](spark, str(tmp_path)).toPandas())
    assert got == table(con.execute(queries.ORACLE_SQL[name]).df()) and got[1]


def test_contamination(spark, tmp_path):
    """The query without SQL on whole tables, on a small one: items with edits, in the middle and at the ends."""
    import random

    import duckdb

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(10))) for i in range(4)]
    docs = []
    for i in range(24):
        text = list(items[i % 4][1])
        for _ in range(rng.choice([0, 2, 4, 6, 9])):
            text[rng.randrange(len(text))] = rng.choice(["", "x", "é", "ab"])
        docs.append((i, " ".join([word() for _ in range(i % 3)] + ["".join(text)] + [word() for _ in range(i % 4)])))
    docs += [(30, None), (31, ""), (32, items[0][1] + " " + items[1][1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = table(queries.contamination(spark, str(tmp_path)).toPandas())
    assert got == table(con.execute(queries.contamination_sql(8)).df()) and len(got[1]) > 6


def test_entry_without_the_pipeline_operators():
    code = "import sys; sys.modules['fuzzscan.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not any(n.startswith('op') for n in e.queries()) and e.oracle_sql()"
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=here, env=os.environ | {"PYTHONPATH": here}, capture_output=True).returncode == 0
