"""Driver contract: entry runs, every query has a callable, oracle keys are queries."""

import __spark_entry__ as E
from carelens.plans.queries import registry


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"concept", "code", "mentions", "texts"}


def test_registry_shape():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 60
    assert set(registry()[0]) <= set(qs)


def test_all_queries_run_small(spark):
    from tests.conftest import SF001
    for name, fn in registry()[0].items():
        df = fn(spark, SF001)
        df.limit(1).collect()


def test_all_queries_on_empty_tables(spark, tmp_path):
    """Every registered query runs (and aggregates give their empty answers) when all
    driver tables are empty."""
    from tests.conftest import SF001
    tables = ("region nation customer supplier part orders lineitem events documents embeddings "
              "pages benchmark labels conversations").split()
    for t in tables:
        spark.read.parquet(f"{SF001}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    for name, fn in registry()[0].items():
        fn(spark, str(tmp_path)).count()
