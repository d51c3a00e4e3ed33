import math
import random
import re

import numpy as np
import pytest

from carelens.llm import lexical_search as L
from carelens.llm.lexical_search import ranked_search


def terms(text):
    return ["".join(c.lower() if c.isascii() else c for c in t)
            for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain(docs, items, k):
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, t) for i, t in bags if t]
    n_docs, length = len(bags), sum(len(t) for _, t in bags)
    out = []
    for item, text in items:
        asked, found = terms(text), []
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in b for _, b in bags) + 1)))
             for t in set(asked)} if n_docs else {}
        for i, bag in bags:
            m = 25 + 75 * len(bag) * n_docs // length
            score = sum(w[t] * (1_000_000_000 * bag.count(t) // (1000 * bag.count(t) + 8 * m)) for t in asked)
            if score:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def answers(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(rng, n):
    words = [f"w{i}" for i in range(40)] + ["Éte", "été", "ABC", "日本", "x1"]
    weight = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weight, k=rng.randint(0, 60))) for _ in range(n)]
    texts[n // 2:n // 2 + n // 3] = [texts[0]] * (n // 3)           # a third are copies
    return texts


@pytest.mark.parametrize("leaf,tree,k", [(32, 8192, 10), (2, 50, 3), (1, 7, 1)])
def test_against_all_documents(spark, monkeypatch, leaf, tree, k):
    rng = random.Random(leaf)
    docs = [(i, t) for i, t in enumerate(corpus(rng, 240))]
    docs += [(3, "w30 w31 repeated id"), (None, docs[0][1]), (900, None), (901, ""), (902, "!!! ...")]
    items = [(i, " ".join(rng.choices([f"w{j}" for j in range(45)] + ["été", "abc", "日本"], k=rng.randint(1, 12))))
             for i in range(25)] + [(25, None), (26, "..."), (27, "nowhere at all"), (2, "w1 w2 w2 w2")]
    monkeypatch.setattr(L, "_LEAF_DOCS", leaf)
    monkeypatch.setattr(L, "_TREE_DOCS", tree)
    # one process, so that the small trees hold: the task's functions are called directly
    import pyarrow as pa
    table = pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": [t for _, t in docs]})
    dictionary = L.Dictionary(L.terms_of(*L.text_buffers(pa.array([t for _, t in items], pa.string()))))

    class Shared:
        value = dictionary
    vectors = list(L._vector_task(Shared)(table.to_batches(max_chunksize=31)))
    n = np.concatenate([v.column("n").to_numpy() for v in vectors])
    df = np.bincount(np.concatenate([v.column("terms").flatten().to_numpy() for v in vectors]),
                     minlength=len(dictionary.names))
    weight = np.array([math.floor(1000 * math.log((2 * len(n) + 2) / (2 * x + 1))) for x in df])
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))

    class Query:
        value = ([(t, weight[t] * c) for t, c in dictionary.items], [i for i, _ in items], rank, len(n), int(n.sum()))
    got = []
    for batch in L._search_task(Query, k)(vectors):
        number = {}
        for row in batch.to_pylist():
            number[row["item"]] = number.get(row["item"], 0) + 1
            got.append((row["item_id"], number[row["item"]], row["doc_id"], row["score"]))
    assert sorted(got, key=repr) == plain(docs, items, k)


def test_bounds_leave_out_most_documents():
    """Documents of other subjects than the item are not scored."""
    rng = random.Random(1)
    texts = []
    for i in range(4000):
        texts.append(" ".join(rng.choices([f"s{i % 40}x{j}" for j in range(30)], k=40)))
    import pyarrow as pa
    dictionary = L.Dictionary(L.terms_of(*L.text_buffers(pa.array([" ".join(texts[:40])]))))
    words = L.terms_of(*L.text_buffers(pa.array(texts)))
    text, term, tf = dictionary.vectors(words)
    ptr = np.searchsorted(text, np.arange(len(texts) + 1))
    tree = L.FPTree(np.arange(len(texts)), np.full(len(texts), 100), ptr, term, tf)
    weight = np.zeros(len(dictionary.names), np.int64)
    weight[np.unique(dictionary.vectors(L.terms_of(*L.text_buffers(pa.array([texts[7]]))))[1])] = 1000
    scored, plain_scores = [], L.Entries.scores
    try:
        L.Entries.scores = lambda self, w, lo, hi: (scored.append(hi - lo) if self is tree.docs else None,
                                                    plain_scores(self, w, lo, hi))[1]
        scores, ids = tree.search(weight, (np.zeros(0, np.int64),) * 2, 10)
    finally:
        L.Entries.scores = plain_scores
    whole = tree.docs.scores(weight, 0, len(texts))
    assert scores.tolist() == sorted(whole.tolist(), reverse=True)[:10]
    assert sum(scored) < len(texts) / 4


def test_query_with_blocks_and_clashing_columns(spark):
    rng = random.Random(3)
    docs = [(i, t) for i, t in enumerate(corpus(rng, 60))] + [(4, "w44 w43"), (None, "w44")]
    items = [(i, f"w{i} w{i + 3} été w{i}") for i in range(30)] + [(5, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS rank", "3 AS n")
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "2 AS score")
    assert answers(ranked_search(d, q, k=4)) == plain(docs, items, 4)
    assert answers(ranked_search(d, q, k=4, block_terms=30)) == plain(docs, items, 4)
    assert ranked_search(d.limit(0), q).count() == 0 and ranked_search(d, q.limit(0)).count() == 0
