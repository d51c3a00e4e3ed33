import random

import pytest

from carelens.llm import quality_classifier as Q, toxicity as T


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    syllables = ["ba", "de", "fi", "go", "hu", "ka", "lo", "mi", "ne", "pu"]
    docs, labels = [], []
    for i in range(600):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 90))]
        toxic, bad = i % 5 == 0, i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["zarg", "zarg", "vrex" + rng.choice(syllables)])
        elif i % 41 == 0:
            words[5:7] = ["mild", "zarg"]                    # a harmless phrase
        if bad:
            words = [w + "$$$" for w in words]
        docs.append((i, " ".join(words), "h%d" % (i % 3), rng.choice(["en", "de"])))
        labels.append((i, int(not bad), int(toxic)))
    return (spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_folding():
    assert T.fold("IDІОT") == "idiot"                       # Cyrillic letters
    assert T.fold("1d10t and l0s3r") == "idiot and loser"
    assert T.fold("$tup1d") == "stupid"
    assert T.fold("ｓｃｕｍ") == "scum" and T.fold("s\u200bcum") == "scum"
    assert T.fold("in 2010, 37 items!") == "in 2010, 37 items!"
    assert T.fold("idiot! s!ly m@ss") == "idiot! sily mass"
    assert T.fold("Ñandú größe") == "ñandú größe"
    assert T.fold("ıdıot") == T.fold("idi\u00adot") == "idiot"    # within Latin text


def test_hits_and_exceptions():
    model = T.Model({"scum": 2.0, "vrex*": 3.0, "vrexa": 4.0}, ["pond scum"], (0, 1, 1))
    a = model.automaton()
    found = T.hits(a, "scum pond scum scums vrexo vrexa avrex")
    assert sorted(found) == [(0, 2.0), (21, 3.0), (27, 4.0)]
    assert T.hits(T.Model({}, [], (0, 0, 0)).automaton(), "scum") == []


def test_toxicity_held_out(spark, labelled):
    docs, labels = labelled
    model = T.learn(docs, labels.filter("doc_id % 2 = 0"))
    assert "zarg" in model.terms and any(t.startswith("vrex") for t in model.terms)
    assert "mild zarg" in model.exceptions
    rows = T.score(docs, model).join(labels, "doc_id").filter("doc_id % 2 = 1").collect()
    right = sum((r.score >= 0.3) == (r.toxic == 1) for r in rows)
    assert right >= 0.97 * len(rows)


def test_toxicity_odd_rows(spark, labelled):
    docs, labels = labelled
    model = T.learn(docs, labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None), (9, 1, 7)], labels.schema)))
    odd = spark.createDataFrame([(1, None, 2), (2, "", 2), (None, "zarg", 2), (3, "x " * 100_000 + "zarg zarg", 2), (3, "zarg", 2)],
                                "doc_id long, text string, score int")
    out = T.score(odd, model).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    assert T.score(odd.limit(0), model).count() == 0
    empty = T.learn(docs, labels.limit(0))
    assert all(r.score == 0 for r in T.score(odd, empty).collect())


def test_quality_held_out(spark, labelled):
    docs, labels = labelled
    model = Q.fit_evidence(docs, labels.filter("doc_id % 2 = 0"))
    rows = Q.quality_scores(docs, model).join(labels, "doc_id").filter("doc_id % 2 = 1").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.97 * len(rows)


def test_sites_shrink_toward_their_parents(spark):
    # evidence by a fixed model: the share of symbols decides
    n = len(Q.FIGURES)
    weights = [0.0] * (2 * n + 1)
    weights[1] = -8.0
    import numpy as np
    mean, spread = np.zeros(n), np.ones(n)
    mean[0], spread[0] = 0.2, 0.1
    model = Q.Evidence(mean, spread, np.array(weights))
    good, bad = "plain words " * 10, "a$$$$ b#### " * 10
    rows = [(i, good if i % 10 else bad, "big", "a") for i in range(400)]
    rows += [(1000 + i, bad, "bad", "a") for i in range(300)] + [(2000, bad, "small", "a"), (2001, good, "big", "new")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {(r.host, r.path): r.prior for r in Q.quality_scores(df, model).collect()}
    overall = (360 + 1) / 702
    assert got["bad", "a"] < 0.05 < got["small", "a"] < overall < got["big", "a"] < 0.95
    assert abs(got["big", "new"] - got["big", "a"]) < 0.1       # one document moves its path little


def test_quality_odd_rows(spark, labelled):
    docs, labels = labelled
    model = Q.fit_evidence(docs, labels)
    odd = spark.createDataFrame([(1, None, None, None, "k"), (2, "", "", None, "k"), (None, "x", "h", "p", "k"), (3, "w " * 100_000, "h", "p", "k"),
                                 (3, "w", "h", "p", "k")], "doc_id long, text string, source string, lang string, kept string")
    out = Q.quality_scores(odd, model).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert {(r.host, r.path) for r in out if r.doc_id in (1, 2)} == {(None, None), ("", None)}
    assert Q.quality_scores(odd.limit(0), model).count() == 0
    flat = Q.fit_evidence(docs, labels.limit(0))
    assert all(r.evidence == 0.5 for r in Q.quality_scores(odd, flat).collect())


def plain_toxicity(model, text):
    """The score of a text, pattern by pattern at every position."""
    import math
    folded = T.fold(text or "")
    begins = [i for i, c in enumerate(folded) if not (i and folded[i - 1].isalpha())]

    def whole(at, size):
        return at + size == len(folded) or not folded[at + size].isalpha()
    spared = {i for i in range(len(folded)) for a in begins for x in model.exceptions
              if folded.startswith(x, a) and whole(a, len(x)) and a <= i < a + len(x)}
    total = 0
    for a in begins:
        fits = [w for t, w in model.terms.items() if folded.startswith(t.rstrip("*"), a)
                and (t.endswith("*") or whole(a, len(t)))]
        if fits and a not in spared:
            total += max(fits)
    x = (math.log1p(total), math.log1p(100 * total / max(1, len(folded.split())))) if total > 0 else (0, 0)
    z = model.curve[0] + model.curve[1] * x[0] + model.curve[2] * x[1]
    return 1 / (1 + math.exp(-z))


def test_toxicity_against_every_pattern_at_every_position(spark, labelled):
    rng = random.Random(8)
    docs, labels = labelled
    model = T.learn(docs, labels)
    model.exceptions += ["zarg mild", "vrex"]
    bits = ["zarg", "mild", "vrex", "vrexba", "zar", "xzarg", " ", " ", "Z4RG", "\u0437arg", ".", "ba", "kalo", "\n"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(150)] + [None, "", "zarg " * 40]
    got = T.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert len(got) == len(texts)
    for r in got:
        assert abs(r.score - plain_toxicity(model, texts[r.doc_id])) < 1e-9, texts[r.doc_id]
    assert 20 < sum(r.matched for r in got) < 150


def plain_quality(rows):
    """Scores of (host, path, evidence) rows: method-of-moments strengths, two levels of shrinking."""
    import math
    def strength(groups):
        n = sum(g[0] for g in groups)
        mean = sum(g[0] * g[2] for g in groups) / n
        spread = sum(g[0] * (g[1] - g[2]) ** 2 for g in groups) / n
        chance = sum(g[2] * (1 - g[2]) for g in groups) / n
        return min(max(mean * (1 - mean) / max(spread - chance, 1e-9) - 1, 1), 1e6)

    def sums(key):
        out = {}
        for r in rows:
            n, s = out.get(key(r), (0, 0))
            out[key(r)] = n + 1, s + r[2]
        return out
    clip = lambda p: min(max(p, Q._LEAST), 1 - Q._LEAST)
    overall = clip(sum(r[2] for r in rows) / len(rows))
    hosts, paths = sums(lambda r: r[0]), sums(lambda r: r[:2])
    k = strength([(n, s / n, overall) for n, s in hosts.values()])
    rate = {h: (s + k * overall) / (n + k) for h, (n, s) in hosts.items()}
    k = strength([(n, s / n, rate[h]) for (h, _), (n, s) in paths.items()])
    prior = {p: clip((s + k * rate[p[0]]) / (n + k)) for p, (n, s) in paths.items()}
    logit = lambda p: math.log(p / (1 - p))
    return [1 / (1 + math.exp(-(logit(r[2]) - logit(overall) + logit(prior[r[:2]])))) for r in rows]


def test_quality_against_a_plain_computation(spark, labelled):
    docs, labels = labelled
    odd = spark.createDataFrame([(9000, "lonely words here", None, "en"), (9001, None, "h1", None)], docs.schema)
    docs = docs.unionByName(odd)
    out = Q.quality_scores(docs, Q.fit_evidence(docs, labels)).collect()
    want = plain_quality([(r.host, r.path, r.evidence) for r in out])
    assert len(out) == 602 and all(abs(r.score - w) < 1e-5 for r, w in zip(out, want))
    assert all(r.kept == (r.score >= 0.5) for r in out)
