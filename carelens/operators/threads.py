"""Forum threads: submission/comment merge and append, reply depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import link_parent_id


def merge_threads(subs: DataFrame, comments: DataFrame, check_unique: bool = False) -> DataFrame:
    """Prefix columns ``sub_`` / ``comm_``, take the submission id from the comment's
    link id (drop ``t3_``) and left join: every submission, with each of its comments.

    ``check_unique`` runs Q2 and raises on a duplicate (sub_id, comm_id).

    Written as (submissions JOIN comments) UNION ALL (submissions without comments) rather
    than one left join: a submission holding a large share of all comments is a hot key
    on the comment side, and adaptive skew handling can split both sides of an inner join
    but only the preserved side of a left join.  The anti join reads only the distinct
    comment keys (partially aggregated before the shuffle), so the hot key shrinks to one row.
    """
    s = subs.select(*[F.col(c).alias("sub_" + c) for c in subs.columns])
    c = comments.select(*[F.col(x).alias("comm_" + x) for x in comments.columns])
    c = c.withColumn("comm_sub_id", link_parent_id("comm_link_id"))
    matched = s.join(c, F.col("sub_id") == F.col("comm_sub_id"), "inner")
    keys = c.select(F.col("comm_sub_id").alias("__k")).filter(F.col("__k").isNotNull()).distinct()
    lonely = s.join(keys, F.col("sub_id") == F.col("__k"), "left_anti")
    lonely = lonely.select(*s.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in c.schema.fields])
    out = matched.unionByName(lonely)
    if check_unique:
        from .quality import duplicate_keys
        if duplicate_keys(out, ["sub_id", "comm_id"]).limit(1).count():
            raise AssertionError("duplicate (sub_id, comm_id) rows")
    return out


THREAD_COLUMNS = ["id", "author", "created_utc", "created_utc_date", "text", "type"]


def concat_threads(subs: DataFrame, comments: DataFrame, body: str = "body") -> DataFrame:
    """UNION ALL of submissions (``type='sub'``) and comments (``type='comm'``, body as
    text) on the five common columns."""
    s = subs.withColumn("type", F.lit("sub"))
    c = comments.withColumnRenamed(body, "text").withColumn("type", F.lit("comm"))
    return s.select(*THREAD_COLUMNS).unionByName(c.select(*THREAD_COLUMNS))


def accumulate(batches: list[DataFrame]) -> DataFrame:
    """Batches of records as one table, columns matched by name; the rows keep their
    batch's order of arrival in nothing but their own columns."""
    if not batches:
        raise ValueError("no batch to accumulate")
    out = batches[0]
    for batch in batches[1:]:
        out = out.unionByName(batch)
    return out


def reply_depth(comments: DataFrame, id_col: str = "id", parent_col: str = "parent") -> DataFrame:
    """Depth of each reply from parent links: top-level replies (no parent) have
    depth 0, a reply to a depth-d reply has depth d + 1.

    Pointer jumping: every unresolved reply keeps (ancestor, distance) and each round
    replaces its ancestor by the ancestor's ancestor, adding the distances, so the
    jump length doubles.  A thread of depth d resolves in about log2(d) rounds; each round
    is one join (the hot key of a large thread sits on one side only, so adaptive skew
    handling can split it) plus a reliable checkpoint that cuts the lineage.  The loop on
    the driver runs over rounds, not over data.  Replies whose parent chain leaves the
    table (or loops) get no depth.  A recursive CTE would hit Spark's recursion row limit
    on a real comment table.
    """
    from ..session import cut_lineage
    st = comments.select(F.col(id_col).alias("cid"), F.col(parent_col).alias("anc"))
    st = st.withColumn("dist", F.when(F.col("anc").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long"))
    st = cut_lineage(st.withColumn("ok", F.col("anc").isNull()))
    n = st.count()                       # a real chain is never longer than the table
    parts = max(st.rdd.getNumPartitions(), st.sparkSession.sparkContext.defaultParallelism)
    while True:                          # a jump beyond n ends a chain, so log2(n) rounds suffice
        pending = st.filter(F.col("anc").isNotNull())
        if pending.isEmpty():
            break
        b = st.select(F.col("cid").alias("bid"), F.col("anc").alias("banc"),
                      F.col("dist").alias("bdist"), F.col("ok").alias("bok"))
        j = pending.join(b, F.col("anc") == F.col("bid"), "left")
        # parent missing from the table, or a loop (distance beyond the table size): no depth
        dead = F.col("bid").isNull() | (F.col("dist") + F.col("bdist") > n)
        step = j.select(
            "cid",
            F.when(dead, F.lit(None)).otherwise(F.col("banc")).alias("anc"),
            F.when(dead, F.lit(None)).otherwise(F.col("dist") + F.col("bdist")).alias("dist"),
            F.when(dead, F.lit(False)).otherwise(F.col("bok")).alias("ok"))
        # the union would add the join's partitions every round: coalesce back (no shuffle)
        st = cut_lineage(st.filter(F.col("anc").isNull()).unionByName(step).coalesce(parts))
    done = st.filter(F.col("anc").isNull() & F.col("ok") & F.col("dist").isNotNull())
    return done.select(F.col("cid").alias(id_col), F.col("dist").cast("int").alias("depth"))
