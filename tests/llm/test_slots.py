from pyspark.sql import functions as F

from carelens.llm.slots import SLOTS, parted, slot_bits, slot_words


def test_rows_are_parted_by_the_bitmap(spark):
    keys = spark.range(0, 5000, 7).select(F.xxhash64("id").alias("k")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k"))
    words = slot_words(keys, F.col("k"))
    rows = spark.range(5000).select(F.when(F.col("id") < 4990, F.col("id")).alias("id"), F.lit(1).alias("word"),
                                    F.lit(2).alias("__bits"))
    out, inside = parted(rows, F.when(F.col("id").isNotNull(), F.xxhash64("id")), words)
    maybe = {r.id for r in inside.collect()}
    assert out.columns == inside.columns == rows.columns
    assert {i for i in range(0, 4990, 7)} <= maybe and len(maybe) < 730 and None not in maybe
    assert out.count() + len(maybe) == 5000
    bits = slot_bits(words)
    assert len(bits) == SLOTS and bits.sum() == words.select(F.sum(F.bit_count("bits"))).collect()[0][0]
    hashes = [r.k & (SLOTS - 1) for r in keys.collect() if r.k is not None]
    assert all(bits[h] for h in hashes)
    none, nothing = parted(rows, F.xxhash64("id"), slot_words(keys.limit(0), F.col("k")))
    assert none.count() == 5000 and nothing.count() == 0
