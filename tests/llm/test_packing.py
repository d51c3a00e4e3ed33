import random
from collections import defaultdict

from carelens.llm.packing import best_fit_pack, document_items, pack_pool

SCHEMA = "doc_id long, n_tokens int, source string, cluster string"


def plain(items, capacity):
    """Best fit by trying every open bin."""
    n, rest, out = 0, [], []
    for key, size, source, cluster in items:
        full, left = divmod(size or 0, capacity)
        for piece in range(full):
            out.append((key, piece, n, 0, capacity))
            n += 1
        if left:
            rest.append((left, key, full, source, cluster))
        elif not full:
            out.append((key, 0, None, 0, 0))
    rest.sort(key=lambda r: (-r[0], r[1]))
    bins = []                                # [residual, number, sources, clusters]
    for size, key, piece, source, cluster in rest:
        fit = [b for b in bins if b[0] >= size and (source is None or source not in b[2])
               and (cluster is None or cluster not in b[3])]
        if fit:
            b = min(fit, key=lambda b: b[:2])
        else:
            b = [capacity, n, set(), set()]
            bins.append(b)
            n += 1
        out.append((key, piece, b[1], capacity - b[0], size))
        b[0] -= size
        b[2].add(source)
        b[3].add(cluster)
    return out


def items(rng, n):
    return [(i, rng.choice([0, None, 1, 5, 20, 33, 60, 99, 100, 101, 250, rng.randint(1, 99)]),
             rng.choice(["hot", "hot", None, *"abcdefgh"]), rng.choice([None, *"klmnopqrst"])) for i in range(n)]


def test_pool_is_best_fit():
    for seed in range(8):
        rows = items(random.Random(seed), 300)
        assert sorted(pack_pool(rows, 100), key=str) == sorted(plain(rows, 100), key=str)


def test_pools_of_a_table(spark):
    rows = items(random.Random(9), 900) + [(None, 10, "hot", "x"), (5, 40, "hot", "x"), (5, 40, "hot", "x")]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", bin int")
    out = best_fit_pack(df, 100, pool_items=200).collect()
    total, used, pieces = defaultdict(int), defaultdict(list), defaultdict(list)
    for r in out:
        total[r.doc_id] += r.n_tokens
        if r.bin is not None:
            used[r.bin].append(r)
        else:
            assert r.n_tokens == 0
    want = defaultdict(int)
    for d, size, _, _ in rows:
        want[d] += size or 0
    assert total == want
    tags = defaultdict(set)
    for d, _, s, c in rows:
        tags[d] |= {("s", s), ("c", c)} if d != 5 else set()
    for content in used.values():
        content.sort(key=lambda r: r.start)
        at = 0
        for r in content:
            assert r.start == at
            at += r.n_tokens
        assert at <= 100
        held = [t for r in content for t in tags[r.doc_id] if t[1] is not None]
        assert len(held) == len(set(held))
    assert best_fit_pack(df.limit(0), 100).count() == 0


def test_items_of_documents(spark):
    docs = spark.createDataFrame([(1, "a b\tc", "s"), (2, "", "s"), (3, None, None), (4, "a b\tc", "t")],
                                 "doc_id long, text string, source string")
    got = {r.doc_id: r for r in document_items(docs).collect()}
    assert got[1].n_tokens == 3 and got[1].cluster == got[4].cluster and got[2].n_tokens == 0
    assert best_fit_pack(document_items(docs), 10).count() == 4


def test_a_null_text_has_no_words_in_either_mode(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "one two", "a"), (3, "", "b")], "doc_id long, text string, source string")
    old = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            items = document_items(docs)
            assert {r.doc_id: r.n_tokens for r in items.collect()} == {1: 0, 2: 2, 3: 0}
            got = {r.doc_id: (r.piece, r.bin, r.n_tokens) for r in best_fit_pack(items, 10).collect()}
            assert got[1] == got[3] == (0, None, 0) and got[2][2] == 2
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)
