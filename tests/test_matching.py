"""Keyword spans (M1) and lexicon extraction (M2) against brute-force Python models."""

import random
import re

from pyspark.sql import functions as F

from carelens.operators import keywords, lexicon

NONWORD = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def model_keywords(text, kws):
    """Leftmost, longest, non-overlapping, case-insensitive, ASCII word boundaries."""
    low = text.lower()
    canon = {}
    for k in kws:
        canon[k.lower()] = k
    out, i = [], 0
    while i < len(low):
        if i > 0 and low[i - 1] in NONWORD:
            i += 1
            continue
        best = None
        for k in canon:
            if low.startswith(k, i):
                e = i + len(k)
                if e == len(low) or low[e] not in NONWORD:
                    if best is None or len(k) > len(best):
                        best = k
        if best:
            out.append((canon[best], i, i + len(best)))
            i += len(best)
        else:
            i += 1
    return out


def test_keyword_spans_model(spark):
    kws = ["long covid", "long", "covid", "Long Haul", "brain fog", "fog", "x-ray", "c++"]
    texts = ["Long covid and LONG haul, brain fog; fogs foggy fog", "longcovid long-covid covid19 covid",
             "x-ray x-rays (x-ray) c++ c+++", "", "brain  fog brain fog", "é long é", "longlong long"]
    rnd = random.Random(7)
    alphabet = ["long", "covid", " ", " ", ",", "fog", "brain", "haul", "x-ray", "é", "_", "9"]
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = keywords.keyword_search(df, "text", kws).orderBy("i").collect()
    for r in out:
        got = [(s["keyword"], s["start"], s["end"]) for s in r["keywords_text"]]
        assert got == model_keywords(r["text"], kws), r["text"]
        for k, s, e in got:
            assert r["text"].lower()[s:e] == k.lower()


def model_lexicon(text, exprs):
    toks = re.findall(r"[^\W]+", text.lower())
    hits = []
    for (concept, code, expr) in exprs:
        et = re.findall(r"[^\W]+", expr.replace("﻿", "").strip().lower())
        if not et:
            continue
        w = len(et)
        for i in range(len(toks) - w + 1):
            if toks[i:i + w] == et:
                hits.append((i, w, " ".join(et), concept))
    return hits


def greedy(hits):
    spans = sorted({(s, w) for s, w, _, _ in hits}, key=lambda x: (x[0], -x[1]))
    keep, end = [], -1
    for s, w in spans:
        if s >= end:
            keep.append((s, w))
            end = s + w
    return set(keep)


LEX = [("﻿Fatigue", "C1", "tired"), ("Fatigue", "C1", "very tired"), ("Fatigue", "C1", "  Very Tired "),
       ("Breath", "C2", "short of breath"), ("Breath", "C2", "shortness of breath"), ("Breath", "C2", "breath"),
       ("Fog", "C3", "brain fog"), ("Fog", "C3", "fog"), ("Both", "C4", "of breath"), ("Pain", "C5", "pain"),
       ("Pain", "C5", "chest pain"), ("Pain2", "C6", "chest pain")]


def test_lexicon_hits_and_matches(spark):
    rnd = random.Random(3)
    words = ["very", "tired", "short", "of", "breath", "shortness", "brain", "fog", "chest", "pain", "x"]
    texts = ["I am Very tired, short of breath and have brain fog", "chest pain chest pain", "",
             "shortness of breath of breath", "tired tired very very tired"]
    texts += [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    lex = spark.createDataFrame(LEX, "Symptom string, CUI string, LexicalExpression string")
    hits = lexicon.lexicon_hits(docs, lex).collect()
    matches = lexicon.lexicon_matches(docs, lex).collect()
    norm_lex = [(c.replace("﻿", "").strip(), k, e) for c, k, e in LEX]
    for i, t in enumerate(texts):
        exp = model_lexicon(t, norm_lex)
        got = {(r["start"], r["width"], r["expression"], r["concept"]) for r in hits if r["doc_id"] == i}
        assert got == set(exp), t
        kept = greedy(exp)
        gotm = {(r["start"], r["width"]) for r in matches if r["doc_id"] == i}
        assert gotm == kept, t
        # every concept of a kept span is reported
        gotc = {(r["start"], r["width"], r["concept"]) for r in matches if r["doc_id"] == i}
        assert gotc == {(s, w, c) for s, w, _, c in exp if (s, w) in kept}


def test_lexicon_normalization(spark):
    lex = spark.createDataFrame(LEX, "Symptom string, CUI string, LexicalExpression string")
    n = lexicon.normalize_lexicon(lex).collect()
    assert all("﻿" not in r["concept"] for r in n)
    assert len([r for r in n if r["expression"] == "very tired"]) == 1


def test_overlap_removal_large_cluster_path(spark):
    """A repeated phrase whose expressions chain-overlap makes one big cluster: the pandas
    walk (fold_limit=4 forces it) must agree with the brute-force greedy model."""
    from carelens.operators.lexicon import _raw_hits, normalize_lexicon, resolve_overlaps
    texts = ["the cat sat " * 40, "the cat the cat sat sat the", "x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    lex = [("A", "1", "the"), ("B", "2", "the cat"), ("C", "3", "cat sat the"), ("D", "4", "sat")]
    norm = normalize_lexicon(spark.createDataFrame(lex, "Symptom string, CUI string, LexicalExpression string"))
    hits = _raw_hits(docs, norm, "doc_id", "text", True)
    for limit in (4, 256):
        kept = resolve_overlaps(hits, "doc_id", fold_limit=limit).collect()
        for i, t in enumerate(texts):
            exp = greedy(model_lexicon(t, lex))
            assert {(r["start"], r["width"]) for r in kept if r["doc_id"] == i} == exp


def test_lexicon_shuffle_join_path(spark):
    """broadcast_rows=1 fails the size check, so the anchor join is a shuffle join."""
    texts = ["I am Very tired, short of breath and have brain fog", "chest pain chest pain", "tired tired"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    lex = spark.createDataFrame(LEX, "Symptom string, CUI string, LexicalExpression string")
    norm_lex = [(c.replace("﻿", "").strip(), k, e) for c, k, e in LEX]
    got = lexicon.lexicon_matches(docs, lex, broadcast_rows=1).collect()
    for i, t in enumerate(texts):
        exp = model_lexicon(t, norm_lex)
        assert {(r["start"], r["width"]) for r in got if r["doc_id"] == i} == greedy(exp)


def test_overlap_walk_across_batches(spark):
    """A text whose spans fill many Arrow batches, a text of null id, spans that repeat."""
    from carelens.operators.lexicon import resolve_overlaps
    rnd = random.Random(11)
    spans = {i: {(rnd.randint(0, 60), rnd.randint(1, 5)) for _ in range(25)} for i in (*range(40), None)}
    spans[40] = {(s, w) for s in range(0, 900, 2) for w in (1, 3, 4)}
    rows = [(i, s, w, 10 * s + w) for i, found in spans.items() for s, w in found]
    hits = spark.createDataFrame(rows + rows[:50], "doc_id int, start int, width int, eid long")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for n in (1, 7, 10_000):
            spark.conf.set(size, n)
            kept = resolve_overlaps(hits).collect()
            for i, found in spans.items():
                assert sorted((r["start"], r["width"]) for r in kept if r["doc_id"] == i) == sorted(
                    greedy({(s, w, "", "") for s, w in found})), (n, i)
    finally:
        spark.conf.set(size, before)


def test_overlap_removal_is_one_shuffle(spark):
    """One shuffle and one sort by text; no window, and no list of a text's spans."""
    from carelens.operators.lexicon import resolve_overlaps
    hits = spark.createDataFrame([("a", 0, 1, 5)], "id string, start int, width int, eid long")
    plan = resolve_overlaps(hits, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "collect_list" not in plan
