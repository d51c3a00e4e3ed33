import os
import shutil

import pytest
from pyspark.sql import functions as F

from carelens.operators.cube import MonthCube
from carelens.plans.queries import registry
from carelens.session import list_committed
from tests.conftest import SF001

REPORTS = ("concept_share", "concept_share_over1", "category_share", "uncategorized_top", "country_share",
           "country_share_file", "country_coverage", "category_country", "category_country_matrix", "month_trend",
           "top_concepts_per_country")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


class Calls:
    """A cube over a folder of (id, month, n) files, with a record of what was counted."""

    def __init__(self, spark, path, facts, others=()):
        self.read_files = []

        def build(df):
            self.read_files = sorted(os.path.basename(f) for f in df.inputFiles())
            return df.groupBy("month", "kind").agg(F.sum("n").alias("n"))
        self.cube = MonthCube(spark, path, facts, list(others), lambda df: df.select("file", "month"), build)


def put(spark, folder, name, *values):
    """One fact file: its rows are (month, kind, n)."""
    spark.createDataFrame(list(values), "month string, kind string, n long").coalesce(1).write.mode("overwrite") \
        .parquet(f"{folder}/.tmp")
    part = next(f for f in os.listdir(f"{folder}/.tmp") if f.endswith(".parquet"))
    os.replace(f"{folder}/.tmp/{part}", f"{folder}/{name}.parquet")


def whole(spark, folder):
    return rows(spark.read.parquet(f"{folder}/*.parquet").groupBy("month", "kind").agg(F.sum("n")))


def test_only_touched_months_are_counted_again(spark, tmp_path):
    facts, path = f"{tmp_path}/facts", f"{tmp_path}/cube"
    os.makedirs(facts)
    put(spark, facts, "a", ("2020-01", "x", 1), ("2020-02", "x", 2))
    put(spark, facts, "b", ("2020-02", "x", 5), ("2020-03", "y", 7))
    put(spark, facts, "c", ("2020-04", "z", 1), (None, "z", 4))
    calls = Calls(spark, path, facts)
    cube = calls.cube
    assert cube.refresh() == ["2020-01", "2020-02", "2020-03", "2020-04", "none"]
    assert rows(cube.read()) == whole(spark, facts)

    calls.read_files = None
    assert cube.refresh() == [] and calls.read_files is None           # nothing is read but the manifest

    put(spark, facts, "b", ("2020-03", "y", 8))                        # leaves February, stays in March
    assert cube.refresh() == ["2020-02", "2020-03"] and calls.read_files == ["a.parquet", "b.parquet"]
    assert rows(cube.read()) == whole(spark, facts)
    put(spark, facts, "d", ("2020-04", "z", 1), ("2020-05", "z", 1))
    assert cube.refresh() == ["2020-04", "2020-05"] and calls.read_files == ["c.parquet", "d.parquet"]
    assert rows(cube.read()) == whole(spark, facts)
    os.remove(f"{facts}/a.parquet")
    assert cube.refresh() == ["2020-01", "2020-02"]                    # both are gone
    assert rows(cube.read()) == whole(spark, facts)
    assert len(list_committed(spark, f"{path}/manifest", "version")) == 2
    # another writer's half-done version has no manifest and does not count
    shutil.copytree(f"{path}/data/version=1", f"{path}/data/version=9")
    assert rows(MonthCube(spark, path, facts, [], None, None).read()) == whole(spark, facts)


def test_a_changed_dimension_counts_all_months_again(spark, tmp_path):
    facts, dim = f"{tmp_path}/facts", f"{tmp_path}/dim"
    os.makedirs(facts)
    put(spark, facts, "a", ("2020-01", "x", 1))
    put(spark, facts, "b", ("2020-02", "x", 1))
    spark.range(3).write.parquet(dim)
    calls = Calls(spark, f"{tmp_path}/cube", facts, [dim])
    assert calls.cube.refresh() == ["2020-01", "2020-02"] and calls.cube.refresh() == []
    spark.range(4).write.mode("overwrite").parquet(dim)
    assert calls.cube.refresh() == ["2020-01", "2020-02"] and calls.read_files == ["a.parquet", "b.parquet"]


def test_empty_facts_and_an_unrefreshed_cube(spark, tmp_path):
    facts = f"{tmp_path}/facts"
    spark.createDataFrame([], "month string, kind string, n long").write.parquet(facts)
    cube = Calls(spark, f"{tmp_path}/cube", facts).cube
    with pytest.raises(ValueError):
        cube.read()
    assert cube.refresh() == [] and cube.read().count() == 0 and cube.read().columns == ["month", "kind", "n"]


def test_reports_follow_their_tables(spark, tmp_path):
    sf = f"{tmp_path}/sf"
    shutil.copytree(SF001, sf)
    queries = registry()[0]
    first = {r: rows(queries[r](spark, sf)) for r in REPORTS}
    assert {r: rows(queries[r](spark, sf)) for r in REPORTS} == first
    # an unchanged call reads the cube and the dictionary only
    read = queries["month_trend"](spark, sf).inputFiles()
    assert read and all("mention-cube" in f for f in read)
    some = spark.read.parquet(f"{sf}/lineitem.parquet").filter("l_linenumber < 3")
    some.coalesce(1).write.parquet(f"{tmp_path}/new")
    part = next(f for f in os.listdir(f"{tmp_path}/new") if f.endswith(".parquet"))
    os.replace(f"{tmp_path}/new/{part}", f"{sf}/lineitem.parquet")
    second = {r: rows(queries[r](spark, sf)) for r in REPORTS}
    fresh = f"{tmp_path}/sf2"
    shutil.copytree(sf, fresh)
    assert second == {r: rows(queries[r](spark, fresh)) for r in REPORTS}
    assert second["country_share"] != first["country_share"] and second["month_trend"] != first["month_trend"]
