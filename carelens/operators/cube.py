"""An incremental month cube (A4-A8, E1): counts by month, kept up to date with their files.

The cube is stored by month.  Beside it lies a manifest of the input files that it was
counted from (path, length, modification time) and of the months each file holds rows of.
``refresh`` compares the manifest with the files that are there now: a file that is new,
changed or gone touches the months that it holds and held, and these months alone are
counted again, from the files that hold them; all others are read as they are.  If another
table that every month depends on has changed, all months are counted again.

Every refresh writes a new version and commits it by writing its manifest last, so a
refresh that dies leaves the old version in force, and readers never see half of one.
One writer at a time is assumed; a file replaced by one of equal length within the clock's
resolution is not noticed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import drop_path, list_committed, list_files, list_parts

_MANIFEST = "kind string, name string, length long, modified long, version int"
_PAIRS = "file string, part string"
#: The part of rows without a month.
_NONE = "none"


class MonthCube:
    """Counts of a fact table by month, stored under ``path``.

    ``facts`` is the path of the fact table (Parquet), ``others`` those of the tables that
    its counts depend on beside it.  ``dated(rows)`` turns fact rows with their ``file``
    into (file, month) rows; ``build(rows)`` counts fact rows, each month by itself, into rows
    with a ``month``.
    """

    def __init__(self, spark: SparkSession, path: str, facts: str, others: list[str],
                 dated: Callable[[DataFrame], DataFrame], build: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.facts, self.others = spark, path.rstrip("/"), facts, others
        self.dated, self.build = dated, build

    def _manifest(self) -> tuple[int, list]:
        versions = list_committed(self.spark, f"{self.path}/manifest", "version")
        if not versions:
            return 0, []
        found = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/version={versions[-1]}")
        return versions[-1], found.collect()            # a row for each file and each month

    def _read_facts(self, files: list[str] | None = None) -> DataFrame:
        return self.spark.read.parquet(*(files if files is not None else [self.facts]))

    def _months_of(self, files: list[str] | None) -> DataFrame:
        rows = self._read_facts(files)
        # as the file system names it
        name = F.regexp_replace(F.col("_metadata.file_path"), "^([a-z0-9]+):///", "$1:/")
        return self.dated(rows.select("*", name.alias("file"))).select(
            "file", F.coalesce("month", F.lit(_NONE)).alias("part")).distinct()

    def refresh(self) -> list[str]:
        """Bring the cube up to date; the months counted again, sorted (``none``: no month)."""
        spark = self.spark
        version, rows = self._manifest()
        facts = list_files(spark, self.facts)
        others = sorted(f for t in self.others for f in list_files(spark, t))
        was = {r.name: (r.name, r.length, r.modified) for r in rows if r.kind == "fact"}
        places = {r.name: r.version for r in rows if r.kind == "month"}
        new = version + 1
        if not rows or others != sorted((r.name, r.length, r.modified) for r in rows if r.kind == "other"):
            wanted, data = None, self.build(self._read_facts())
            pairs = self._months_of(None)
            pairs.write.mode("overwrite").parquet(f"{self.path}/pairs/version={new}")
            touched = set(places)
        else:
            changed = [f for f in facts if was.get(f[0]) != f]
            gone = set(was) - {f[0] for f in facts}
            if not changed and not gone:
                return []
            stale = spark.createDataFrame([(f,) for f in [*gone, *(f[0] for f in changed)]], "file string")
            old = spark.read.schema(_PAIRS).parquet(f"{self.path}/pairs/version={version}")
            fresh = self._months_of([f[0] for f in changed]) if changed else spark.createDataFrame([], _PAIRS)
            pairs = old.join(stale, "file", "left_anti").unionByName(fresh)
            pairs.write.mode("overwrite").parquet(f"{self.path}/pairs/version={new}")
            pairs = spark.read.schema(_PAIRS).parquet(f"{self.path}/pairs/version={new}")
            now = pairs.join(stale.filter(~F.col("file").isin(*gone)) if gone else stale, "file", "left_semi")
            wanted = old.join(stale, "file", "left_semi").unionByName(now).select("part").distinct()
            touched = {r.part for r in wanted.collect()}
            held = [r.file for r in pairs.filter(F.col("part").isin(*touched)).select("file").distinct().collect()]
            part = F.coalesce("month", F.lit(_NONE))
            data = self.build(self._read_facts(held)).filter(part.isin(*touched)) if held else None
        place = f"{self.path}/data/version={new}"
        counted = []
        if data is not None:
            data.withColumn("part", F.coalesce("month", F.lit(_NONE))).write.mode("overwrite") \
                .partitionBy("part").parquet(place)
            counted = list_parts(spark, place, "part")
        schema = data.schema.json() if data is not None else next(r.name for r in rows if r.kind == "schema")
        places = {m: v for m, v in places.items() if m not in touched} | {m: new for m in counted}
        manifest = ([("fact", *f, None) for f in facts] + [("other", *f, None) for f in others]
                    + [("month", m, None, None, v) for m, v in places.items()] + [("schema", schema, None, None, None)])
        spark.createDataFrame(manifest, _MANIFEST).write.mode("overwrite").parquet(
            f"{self.path}/manifest/version={new}")
        self._drop_old(new, set(places.values()) | {r.version for r in rows if r.kind == "month"})
        return sorted(touched | set(counted))

    def _drop_old(self, new: int, used: set[int]) -> None:
        """Versions before the last one go, with the data that neither of the two uses."""
        for folder, keep in (("manifest", {new, new - 1}), ("pairs", {new, new - 1}), ("data", used)):
            for v in list_committed(self.spark, f"{self.path}/{folder}", "version"):
                if v < new and v not in keep:
                    drop_path(self.spark, f"{self.path}/{folder}/version={v}")

    def read(self) -> DataFrame:
        """The counts of all months, as ``build`` gives them, from the stored files alone."""
        _, rows = self._manifest()
        if not rows:
            raise ValueError("refresh the cube first")
        schema = StructType.fromJson(json.loads(next(r.name for r in rows if r.kind == "schema")))
        paths = [f"{self.path}/data/version={r.version}/part={r.name}" for r in rows if r.kind == "month"]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)
