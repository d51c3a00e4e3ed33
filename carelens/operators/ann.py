"""Approximate nearest concepts by an inverted-file index (M7 beyond exact products).

The dictionary's vectors are dealt to lists by their nearest of ``lists`` centroids; a term
is compared with the entries of the ``probes`` lists whose centroids are nearest to it, not
with all.  Centroids come from spherical k-means over a bounded sample of the dictionary
(the ``sample_rows`` entries of least hash); every entry is in the index.

At scale the index is cut into parts of equal size, whole lists one after another and a list
over several parts where it is large, so a list that holds a third of all entries is spread
like the others.  A term goes once to each part that holds lists it probes, with a bit for each
of them, and not once to each list; every (part of entries, part of terms) is one partition
that holds its entries and reads its terms, with a matrix product for each list.  Vectors are
shuffled as they come (floats stay floats).  Few terms are broadcast instead and the index stays
where it is.  Only the best k per term and part are shuffled to be merged.

The search is approximate in the lists it leaves out and exact within those it reads.
``recall`` measures it against the exact product.  The exact operators are in ``semantic``.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .semantic import OUT_SCHEMA

#: Centroids that are broadcast, at most.
MAX_LISTS = 4096
#: Bytes of the entries that a task holds, as float64.
PART_BYTES = 64 * 1024 * 1024
#: Bytes that the scores of one step may take, few enough for the CPU's cache.
STEP_BYTES = 2 * 1024 * 1024
#: Terms that are broadcast, at most.
FEW_TERMS = 2000
#: Entries or terms for which a further part pays, at least.
LEAST_ROWS = 4096
#: Steps in the order of the entries of a list.
PLACES = 1 << 20

FOUND_SCHEMA = "term string, concept string, score double"


def _unit(vectors) -> np.ndarray:
    """Rows of length 1; a zero vector stays."""
    m = np.array([np.asarray(v, np.float64) for v in vectors], np.float64)
    size = np.linalg.norm(m, axis=1, keepdims=True) if len(m) else np.ones((0, 1))
    return m / np.where(size > 0, size, 1)


def train_centroids(vectors: np.ndarray, lists: int, rounds: int = 10, seed: int = 17) -> np.ndarray:
    """Spherical k-means of unit vectors; fewer centroids if there are fewer different ones."""
    different = np.unique(vectors, axis=0)
    rng = np.random.default_rng(seed)
    centre = different[rng.permutation(len(different))[:lists]]
    for _ in range(rounds):
        home = (vectors @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, home, vectors)
        size = np.linalg.norm(total, axis=1)
        centre = np.where(size[:, None] > 0, total / np.where(size > 0, size, 1)[:, None], centre)
    return centre


def _nearest(unit: np.ndarray, centre: np.ndarray, probes: int) -> np.ndarray:
    """The numbers of the ``probes`` nearest centroids of each row, in no order."""
    take = min(probes, len(centre))
    best = np.empty((len(unit), take), np.int32)
    step = max(1, PART_BYTES // (8 * len(centre)))
    for i in range(0, len(unit), step):
        near = -(unit[i:i + step] @ centre.T)
        best[i:i + step] = np.argpartition(near, take - 1, axis=1)[:, :take] if take < len(centre) else np.arange(take)
    return best


def _asked(unit: np.ndarray, centre: np.ndarray, probes: int) -> np.ndarray:
    """For each row and list, whether the row probes it."""
    asked = np.zeros((len(unit), len(centre)), bool)
    np.put_along_axis(asked, _nearest(unit, centre, probes), True, axis=1)
    return asked


class _Entries:
    """Some entries of the index, by list and within a list by concept (nulls last)."""

    def __init__(self, name: np.ndarray, lists: np.ndarray, unit: np.ndarray):
        by_name = pd.Series(name, dtype=object).sort_values(kind="stable").index.to_numpy()
        rank = np.empty(len(name), np.int64)
        rank[by_name] = np.arange(len(name))
        rank[pd.isna(name)] = -1                             # across lists nulls are first, as Spark sorts them
        order = by_name[np.argsort(lists[by_name], kind="stable")]
        self.name, self.rank, self.unit = name[order], rank[order], unit[order]
        self.lists, self.start = np.unique(lists[order], return_index=True)
        self.odd = bool(np.isnan(self.unit).any())

    def best(self, unit: np.ndarray, asked: np.ndarray, column: np.ndarray, k: int):
        """(row of ``unit``, place, score): its best ``k`` entries of the lists it probes; list x is ``column[x]`` of ``asked``."""
        score = np.full((len(unit), k), -np.inf)
        at = np.full((len(unit), k), -1)
        odd = self.odd or bool(np.isnan(unit).any())
        for number, low, high in zip(self.lists, self.start, [*self.start[1:], len(self.name)], strict=True):
            rows = np.flatnonzero(asked[:, column[number]])
            entries, take, step = self.unit[low:high].T, min(k, high - low), max(1, STEP_BYTES // (8 * (high - low)))
            for i in range(0, len(rows), step):
                some = rows[i:i + step]
                s = unit[some] @ entries
                if not odd:                                  # most lists change few of the best
                    good = s.max(axis=1) >= score[some, -1]
                    some, s = some[good], s[good]
                if len(some):
                    self._merge(score, at, some, s, low, take, odd)
        row, j = np.nonzero(at >= 0)
        return row, at[row, j], score[row, j]

    def _merge(self, score: np.ndarray, at: np.ndarray, some: np.ndarray, s: np.ndarray, low: int, take: int, odd: bool) -> None:
        """The best of the scores ``s`` into ``score`` and ``at`` of the rows ``some``; NaN is last (pandas hands it on as null)."""
        if odd:
            new = np.argsort(-s, axis=1, kind="stable")[:, :take]
            value = np.take_along_axis(s, new, axis=1)
        else:
            new, value, line = np.empty((len(s), take), np.int64), np.empty((len(s), take)), np.arange(len(s))
            for j in range(take):
                new[:, j] = s.argmax(axis=1)
                value[:, j] = s[line, new[:, j]]
                s[line, new[:, j]] = -np.inf
        value, new = np.concatenate([score[some], value], axis=1), np.concatenate([at[some], new + low], axis=1)
        rank = np.where(new >= 0, self.rank[new], len(self.name))
        order = np.lexsort((rank, -np.where(np.isnan(value), -np.inf, value)), axis=-1)[:, :score.shape[1]]
        score[some], at[some] = np.take_along_axis(value, order, axis=1), np.take_along_axis(new, order, axis=1)


class ConceptIndex:
    """An inverted-file index over a dictionary of (concept, vector), written to scratch.

    Null vectors are left out.  ``lists`` defaults to the square root of the entries, 4096 at
    most; ``part_rows`` bounds the entries that a task holds (``PART_BYTES`` by default) and, with
    four for one, the terms that it reads.
    """

    def __init__(self, dictionary: DataFrame, concept: str = "concept", vector: str = "vector",
                 lists: int | None = None, sample_rows: int = 20_000, part_rows: int | None = None, seed: int = 17):
        spark = self.spark = dictionary.sparkSession
        entries = dictionary.select(F.col(concept).alias("concept"), F.col(vector).alias("v")).filter("v IS NOT NULL")
        self.entries = entries
        n = entries.count()
        # ordered and cut by tasks: a collect would send every partition's first rows to the driver
        least = entries.orderBy(F.xxhash64("concept"), "concept").limit(sample_rows)
        if n > 2 * sample_rows:                              # far fewer rows meet in the last task
            few = entries.filter(F.xxhash64("concept") < int(-2 ** 63 + 2 ** 64 * (2 * sample_rows / n)))
            if few.count() >= sample_rows:
                least = few.orderBy(F.xxhash64("concept"), "concept").limit(sample_rows)
        path = scratch_path(spark, "centroid-sample")
        least.select("v").write.parquet(path)
        sample = spark.read.parquet(path).collect()
        wanted = min(lists or max(1, round(n ** 0.5)), MAX_LISTS)
        self.centroids = (train_centroids(_unit([r["v"] for r in sample]), wanted, seed=seed) if sample
                          else np.zeros((0, 0)))
        path = scratch_path(spark, "concept-index")
        listed = self._listed(entries) if sample else entries.withColumn("list", F.lit(0))
        place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PLACES)).cast("int")
        listed.withColumn("place", place).write.parquet(path)
        self.listed = spark.read.parquet(path)
        self.part_rows = part_rows or max(1, PART_BYTES // (8 * max(1, self.centroids.shape[1])))
        self._cut()

    def _listed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``list``: the number of the nearest centroid."""
        shared = self.spark.sparkContext.broadcast(self.centroids)

        def run(batches):
            for b in batches:
                if len(b):
                    yield b.assign(list=_nearest(_unit(b["v"]), shared.value, 1)[:, 0])
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInPandas(run, f"{fields}, list int")

    def _cut(self) -> None:
        """Cuts the entries, list after list, into ``parts`` of equal size; ``held``: the lists in each."""
        size = np.zeros(len(self.centroids), np.int64)
        if len(size):
            for r in self.listed.groupBy("list").count().collect():      # MAX_LISTS at most
                size[r["list"]] = r["count"]
        total, start = int(size.sum()), np.cumsum(size) - size
        cores = self.spark.sparkContext.defaultParallelism
        self.parts = max(1, -(-total // self.part_rows), min(int(np.ceil((2 * cores) ** 0.5)), -(-total // LEAST_ROWS)))
        first, last = start * self.parts // max(1, total), (start + size - 1) * self.parts // max(1, total)
        self.held = [np.flatnonzero((size > 0) & (first <= p) & (p <= last)) for p in range(self.parts)]
        self.lists_from = [(i, int(start[i]), int(n)) for i, n in enumerate(size) if n]
        self.total = total

    def search(self, terms: DataFrame, k: int = 1, probes: int = 8, term: str = "term",
               vector: str = "vector") -> DataFrame:
        """(term, rank, concept, score): the best ``k`` entries of the probed lists by cosine.

        Equal scores rank by concept.  Terms should be distinct; null vectors have no rows; an
        empty index or table gives none.  A term is compared with ``probes`` lists.
        """
        spark = self.spark
        if not len(self.centroids):
            return spark.createDataFrame([], OUT_SCHEMA)
        path = scratch_path(spark, "terms")
        terms.select(F.col(term).alias("term"), F.col(vector).alias("v")).filter("v IS NOT NULL").write.parquet(path)
        t = spark.read.parquet(path)
        n = t.count()
        if not n:
            return spark.createDataFrame([], OUT_SCHEMA)
        found = self._search_few(t, k, probes) if n <= FEW_TERMS else self._search_many(t, n, k, probes)
        order = Window.partitionBy("term").orderBy(F.col("score").desc(), F.col("concept"))
        return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
                .select("term", F.col("rank").cast("int"), "concept", "score"))

    def _search_few(self, t: DataFrame, k: int, probes: int) -> DataFrame:
        """(term, concept, score): the terms are broadcast and the entries stay where they are."""
        rows = t.collect()                                   # FEW_TERMS at most
        unit = _unit([r["v"] for r in rows])
        shared = self.spark.sparkContext.broadcast(
            (np.array([r["term"] for r in rows], dtype=object), unit, _asked(unit, self.centroids, probes)))
        most = self.part_rows

        def run(batches):
            names, unit, asked = shared.value
            column, kept, n = np.arange(asked.shape[1]), [], 0
            for b in chain(batches, [None]):
                if b is not None and len(b):
                    kept.append((b["concept"].to_numpy(), b["list"].to_numpy(), _unit(b["v"])))
                    n += len(b)
                if kept and (b is None or n >= most):
                    entries = _Entries(*map(np.concatenate, zip(*kept, strict=True)))
                    kept, n = [], 0
                    row, at, score = entries.best(unit, asked, column, k)
                    yield pd.DataFrame({"term": names[row], "concept": entries.name[at], "score": score})
        return self.listed.select("concept", "list", "v").mapInPandas(run, FOUND_SCHEMA)

    def _search_many(self, t: DataFrame, n: int, k: int, probes: int) -> DataFrame:
        """(term, concept, score): a term goes to the parts that hold lists it probes, an entry to each part of the terms."""
        spark, parts = self.spark, self.parts
        cores = spark.sparkContext.defaultParallelism
        term_parts = max(-(-n // (4 * self.part_rows)), min(-(-2 * cores // parts), -(-n // LEAST_ROWS)))
        shared, most = spark.sparkContext.broadcast((self.centroids, self.held)), len(self.centroids)

        def probe(batches):
            centre, held = shared.value
            for b in batches:
                if len(b):
                    asked = _asked(_unit(b["v"]), centre, probes)
                    bits = [[x.tobytes() if any_ else None for x, any_ in zip(np.packbits(a, axis=1), a.any(axis=1), strict=True)]
                            for a in (asked[:, h] for h in held)]
                    yield b.assign(probed=[[*x] for x in zip(*bits, strict=True)])
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema)
        asked = (t.mapInPandas(probe, f"{fields}, probed array<binary>")
                 .select("term", "v", F.posexplode("probed").alias("part", "bits")).filter("bits IS NOT NULL")
                 .select(F.col("part"), F.pmod(F.xxhash64("term", "v"), F.lit(term_parts)).cast("int").alias("term_part"), F.lit(1).alias("kind"),
                         F.col("term").cast("string").alias("name"), "v", F.lit(None).cast("int").alias("list"), "bits"))
        begin = F.broadcast(spark.createDataFrame(self.lists_from, "list int, start long, size long"))
        entries = (self.listed.join(begin, "list")
                   .selectExpr(f"CAST(((start + (place * size) div {PLACES}) * {parts}L) div {self.total}L AS int) AS part",
                               f"explode(sequence(0, {term_parts - 1})) AS term_part", "0 AS kind", "CAST(concept AS string) AS name", "v",
                               "list", "CAST(NULL AS binary) AS bits"))
        dealt = (entries.unionByName(asked).repartitionById(parts * term_parts, F.expr(f"part * {term_parts} + term_part"))
                 .sortWithinPartitions("kind"))

        def match(batches):
            held, kept, entries = shared.value[1], [], None
            for b in batches:
                is_term = b["kind"].to_numpy() == 1
                if not is_term.all():
                    if entries is not None:
                        raise ValueError("an entry came after the terms of its part")
                    e = b[~is_term]
                    kept.append((e["name"].to_numpy(), e["list"].to_numpy().astype(np.int64), _unit(e["v"])))
                if is_term.any() and (kept or entries is not None):
                    if entries is None:
                        entries, kept = _Entries(*map(np.concatenate, zip(*kept, strict=True))), []
                    q = b[is_term]
                    lists = held[int(q["part"].iloc[0])]
                    column = np.full(most, -1)
                    column[lists] = np.arange(len(lists))
                    bits = np.frombuffer(b"".join(q["bits"]), np.uint8).reshape(len(q), -1)
                    asked = np.unpackbits(bits, axis=1, count=len(lists)).astype(bool)
                    row, at, score = entries.best(_unit(q["v"]), asked, column, k)
                    yield pd.DataFrame({"term": q["name"].to_numpy()[row], "concept": entries.name[at], "score": score})
        return dealt.drop("term_part").mapInPandas(match, FOUND_SCHEMA)

    def probes_for(self, terms: DataFrame, target: float = 0.97, k: int = 1, **options) -> int:
        """The least power of two of probes, 4 or more, whose measured ``recall`` is ``target`` or more (all
        lists, if none is): vectors without clusters need more than clustered ones."""
        probes = 4
        exact = None
        while probes < len(self.centroids):
            exact = exact or self._exact(terms, k, **options)
            found = self._found(*exact, k, probes).collect()[0]["recall"]
            if found is None or found >= target:
                break
            probes *= 2
        return min(probes, max(1, len(self.centroids)))

    def recall(self, terms: DataFrame, k: int = 1, probes: int = 8, sample_rows: int = 1000, term: str = "term",
               vector: str = "vector", salt: int = 0) -> DataFrame:
        """One row (terms, recall): the share of the exact best ``k`` that the search finds.

        Measured on the ``sample_rows`` terms of least hash (another sample for each ``salt``)
        against the whole dictionary; an entry that scores as high as the exact k-th counts as
        found.
        """
        return self._found(*self._exact(terms, k, sample_rows, term, vector, salt), k, probes)

    def _exact(self, terms: DataFrame, k: int = 1, sample_rows: int = 1000, term: str = "term", vector: str = "vector",
               salt: int = 0) -> tuple[DataFrame, DataFrame]:
        """The sampled terms, and (term, least, n): their exact k-th score and number of entries.

        The sample is broadcast and the dictionary stays where it is: each task keeps the best
        ``k`` scores of its entries per sampled row.
        """
        t = terms.select(F.col(term).alias("term"), F.col(vector).alias("vector")).filter("vector IS NOT NULL")
        t = t.orderBy(F.xxhash64("term", F.lit(salt)), "term").limit(sample_rows)
        path = scratch_path(self.spark, "recall-terms")
        t.write.parquet(path)
        t = self.spark.read.parquet(path)
        rows = t.collect()                                   # sample_rows at most
        names = np.array([r["term"] for r in rows], dtype=object)
        shared = self.spark.sparkContext.broadcast(_unit([r["vector"] for r in rows]) if rows else np.zeros((0, 0)))

        def run(batches):
            asked = shared.value
            best = np.zeros((len(asked), 0))
            for b in batches:
                for i in range(0, len(b) if len(asked) else 0, 2000):
                    best = np.concatenate([best, asked @ _unit(b["v"].iloc[i:i + 2000]).T], axis=1)
                    best = -np.partition(-best, k - 1, axis=1)[:, :k] if best.shape[1] > k else best
            yield pd.DataFrame({"i": np.repeat(np.arange(len(best)), best.shape[1]), "score": best.ravel()})
        found = self.entries.select("v").mapInPandas(run, "i long, score double")
        order = Window.partitionBy("i").orderBy(F.col("score").desc())
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        named = self.spark.createDataFrame([*enumerate(names.tolist())], "i long, term string")
        least = found.join(F.broadcast(named), "i").groupBy("term").agg(
            F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        path = scratch_path(self.spark, "exact-scores")
        least.write.parquet(path)
        return t, self.spark.read.parquet(path)

    def _found(self, t: DataFrame, least: DataFrame, k: int, probes: int) -> DataFrame:
        """(terms, recall) of the search for ``t``, measured by their exact scores."""
        hit = (self.search(t, k, probes).join(least, "term").filter(F.col("score") >= F.col("least") - 1e-9)
               .groupBy("term").agg(F.count(F.lit(1)).alias("hits")))
        return least.join(hit, "term", "left").agg(
            F.count(F.lit(1)).alias("terms"), (F.sum(F.coalesce("hits", F.lit(0))) / F.sum("n")).alias("recall"))
