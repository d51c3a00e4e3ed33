"""
evaluated in one Spark job."""

import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carelens.functions import privacy as P
from carelens.operators import entities, keywords, select

FAST = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

piece = st.sampled_from(["a", "b", "##c", "##", "d##e", "##f##", "g"])
word = st.text(alphabet="abcé_ 1@.-", min_size=0, max_size=12)


@FAST
@given(st.lists(st.lists(piece, max_size=10), min_size=1, max_size=30))
def test_subword_merge_keeps_text(spark, lists):
    """The words concatenate to the tokens with the ## of glued pieces removed, and there
    is one word per word start (first token or a token without a leading ##)."""
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lists)], "i int, t array<string>")
    got = {r["i"]: r["m"] for r in df.select("i", entities.merge_subwords("t").alias("m")).collect()}
    for i, l in enumerate(lists):
        if not l:
            assert got[i] is None
            continue
        starts = [k for k, x in enumerate(l) if k == 0 or not x.startswith("##")]
        joined = "".join(x if k in starts else x.replace("##", "") for k, x in enumerate(l))
        assert "".join(got[i]) == joined
        assert len(got[i]) == len(starts)


@FAST
@given(st.lists(word, min_size=1, max_size=30))
def test_mention_hash_removes_names(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", P.hash_mentions("t").alias("h"), P.hash_mentions(P.hash_mentions("t")).alias("hh")).collect()
    for r in rows:
        t, h = r["t"], r["h"]
        # every mention left in the output is @ + a 56-character SHA-224 hex digest, one per input mention
        out = re.findall(r"@(\w*)", h)
        assert all(re.fullmatch(r"[0-9a-f]{56}", m) for m in out)
        assert sorted(out) == sorted(hashlib.sha224(m.encode()).hexdigest() for m in re.findall(r"@(\w*)", t))
        assert len(r["hh"]) == len(h)          # a second pass keeps the length


@FAST
@given(st.lists(st.tuples(st.integers(0, 10_000), st.sampled_from(["x", "y", "z", "", None])),
                min_size=1, max_size=40, unique_by=lambda t: t[0]))
def test_unique_first_smallest_key(spark, rows):
    df = spark.createDataFrame(rows, "k int, text string")
    got = {(r["text"], r["k"]) for r in select.unique_first(df, "text", "k").collect()}
    best = {}
    for k, t in rows:
        if t not in best or k < best[t]:
            best[t] = k
    assert got == {(t, k) for t, k in best.items()}


@FAST
@given(st.lists(st.text(alphabet="ab -_.", max_size=20), min_size=1, max_size=30))
def test_keyword_spans_cut_keyword(spark, texts):
    kws = ["ab", "a b", "b", "a-b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in keywords.keyword_search(df, "text", kws).collect():
        last_end = -1
        for s in r["keywords_text"]:
            assert r["text"][s["start"]:s["end"]].lower() == s["keyword"].lower()
            assert s["start"] >= last_end
            last_end = s["end"]
