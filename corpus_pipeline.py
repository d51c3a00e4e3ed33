"""The corpus pipeline: five filtering and packing stages over ``documents``.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which ``run`` writes as Parquet and reads again for the next one.  All but the
last return the columns of ``docs``, whatever else these are named.

Every stage takes null ids and texts, repeated rows and ids, ties, texts of any length and an
empty table: a null or empty text is rejected by the first stage; later stages keep rows
without an id or a text as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from carelens.llm.decontaminate import decontaminate
from carelens.llm.line_templates import line_dedup
from carelens.llm.order_minhash import text_classes
from carelens.llm.packing import best_fit_pack, document_items
from carelens.llm.quality_rules import quality_rules
from carelens.llm.slots import parted, slot_words
from carelens.session import scratch_path, ship_package

CAPACITY = 2048


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ...: no name clashes with an operator's own."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _restored(rows: DataFrame, docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of ``docs``, with kept_text as text and n_chars to match."""
    text = F.col(names["text"])
    changed = ~F.col("kept_text").eqNullSafe(text)
    new = {"text": F.col("kept_text")}
    if "n_chars" in names:
        chars = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(changed, chars).otherwise(F.col(names["n_chars"]))
    return rows.select(*(new.get(c, F.col(n)).alias(c) for c, n in names.items()))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; kept ones lose the lines that are boilerplate of their source."""
    rows, names = _numbered(docs)
    judged = quality_rules(rows, names["doc_id"], names["text"], names["source"])
    return _restored(judged.filter("kept"), docs, names)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; so do documents that have no word left through it."""
    rows, names = _numbered(docs)
    kept = line_dedup(rows, names["doc_id"], names["text"])
    emptied = (F.col("n_dropped") > 0) & ~F.col("kept_text").rlike(r"[^ \x09-\x0D]")
    return _restored(kept.filter(~emptied), docs, names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the least id (then the least digest of
    its text); rows without an id or a text stay.

    Rows that share an id are told apart by their texts; of equal rows one stays.  Only texts
    that may go are moved.
    """
    rows, names = _numbered(docs)
    id_, text = F.col(names["doc_id"]).cast("long"), F.col(names["text"])
    known = id_.isNotNull() & text.isNotNull()
    keyed = rows.filter(known).select(id_.alias("doc_id"), F.md5(text).alias("digest"), text.alias("text"))
    classes = text_classes(keyed)
    stay = classes.groupBy("class_id").agg(F.min(F.struct("first_id", "digest")).alias("one")) \
        .select(F.col("one.first_id").alias("doc_id"), F.col("one.digest").alias("digest"))
    copies = keyed.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "duplicates")
    (copies.join(stay.withColumn("stays", F.lit(True)), ["doc_id", "digest"], "left")
     .filter("stays IS NULL OR n > 1").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"),
                                              F.col("stays").isNull().alias("__goes")).write.parquet(path))
    touched = spark.read.parquet(path)
    key = F.when(known, F.xxhash64(id_, F.md5(text)))
    rest, some = parted(rows, key, slot_words(touched, F.xxhash64("__id", "__digest")))
    some = some.join(touched.hint("merge"), (id_ == touched["__id"]) & (F.md5(text) == touched["__digest"]), "left")
    once = (some.filter("NOT __goes").dropDuplicates(["__id", "__digest"]).unionByName(some.filter("__goes IS NULL")))
    return rest.unionByName(once.select(*rows.columns)).toDF(*names)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go; rows without an id or a text stay."""
    rows, names = _numbered(docs)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(rows, bench, id_col=names["doc_id"], text_col=names["text"]).toDF(*names)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of CAPACITY words; no two documents of one source or of equal text share a bin.
    Null texts are empty ones: one row without a bin."""
    return best_fit_pack(document_items(docs.select("doc_id", "text", "source")), CAPACITY)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near_dedup),
          ("decontamination", decontaminated), ("packing", packed)]

#: SQL cannot express the line templates, the Order MinHash classes or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
