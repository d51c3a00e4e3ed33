import re

import __spark_entry__ as E
from carelens.llm.queries import registry
from tests.conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def test_one_query_for_each_operator():
    names = [n for n in E.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries() and set(registry()[1]) <= set(E.oracle_sql())


def test_queries_give_a_row_per_document(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").count()
    for name, query in registry()[0].items():
        n = query(spark, SF001).count()
        if name.startswith(("op1_", "op2_", "op3_", "op4_", "op5_", "op6_", "op9_")):
            assert n == docs, name


def test_queries_on_empty_tables(spark, tmp_path):
    for t in TABLES:
        spark.read.parquet(f"{SF001}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in registry()[0].items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_oracles_of_native_and_exact_operators(spark):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    for name, sql in registry()[1].items():
        got = registry()[0][name](spark, SF001)
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        columns = sorted(names)
        assert sorted(got.columns) == columns
        place = [names.index(c) for c in columns]
        assert (sorted(map(tuple, got.select(*columns).collect()), key=str)
                == sorted((tuple(row[i] for i in place) for row in want.fetchall()), key=str)), name
