"""Text and hashing builders on own example texts with the results they must have."""

import hashlib

import pytest
import regex
from pyspark.sql import functions as F

from carelens.functions import privacy as P
from carelens.functions import text as T
from carelens.functions.constants import BANNED_TERMS


def sha(name, bits=224):
    return hashlib.new(f"sha{bits}", name.encode()).hexdigest()


POST = "  Day 12: still coughing #flu @Nurse.Joy ok "
LINK = "Read http://h.example/x?y=1 now\nthen rest &amp; tea"
UMLAUT = "wörter @ünal_3 bleiben"
FORUM = "thanks /u/Kim_7, and @ or @@b"


@pytest.fixture(scope="module")
def out(spark):
    df = spark.createDataFrame([(r,) for r in (POST, LINK, UMLAUT, FORUM, "", None)], "t string")
    rows = df.select(
        "t", T.clean_post_text("t").alias("clean"), T.clean_term("t").alias("term"),
        P.hash_mentions("t").alias("h224"), P.hash_mentions("t", "/u/").alias("hu"),
        P.hash_mentions("t", "@", 256).alias("h256"), P.hash_value("t").alias("hv"),
        T.remove_urls("t").alias("urls"), T.lowercase("t").alias("lower"),
        T.strip_ws("t").alias("strip"), T.underscore_blanks("t").alias("us")).collect()
    return {r["t"]: r for r in rows}


def test_cleaning(out):
    assert out[POST]["clean"] == "Day 12: still coughing #flu  ok"
    assert out[LINK]["clean"] == "Read  now then rest & tea"
    assert out[UMLAUT]["clean"] == "wörter  bleiben"
    assert out[POST]["term"] == "day 12 still coughing flu joy ok"
    assert out[LINK]["term"] == "read now then rest amp tea"
    assert out[UMLAUT]["term"] == "w rter nal 3 bleiben"
    assert out[LINK]["urls"] == "Read  now\nthen rest &amp; tea"
    assert out[POST]["lower"] == "  day 12: still coughing #flu @nurse.joy ok "
    assert out[POST]["strip"] == POST.strip() and out[UMLAUT]["us"] == "wörter_@ünal_3_bleiben"


def test_hashing(out):
    assert out[POST]["h224"] == f"  Day 12: still coughing #flu @{sha('Nurse')}.Joy ok "
    assert out[UMLAUT]["h256"] == f"wörter @{sha('ünal_3', 256)} bleiben"
    assert out[FORUM]["h224"] == f"thanks /u/Kim_7, and @{sha('')} or @{sha('')}@{sha('b')}"
    assert out[FORUM]["hu"] == f"thanks /u/{sha('Kim_7')}, and @ or @@b"
    assert out[LINK]["hv"] == sha(LINK) and out[""]["hv"] == sha("")


def test_null_and_empty(out):
    assert all(v is None for v in out[None].asDict().values())
    assert all(out[""][c] == "" for c in ("clean", "term", "h224", "hu", "urls", "lower", "strip", "us"))


def test_stop_words_and_punctuation(spark):
    df = spark.createDataFrame([("I am not the  one, ever",), ("a,b! (c) d_e 'f'",)], "t string")
    got = df.select(T.remove_stopwords("t").alias("s"), T.remove_punctuation("t").alias("p")).collect()
    assert got[0]["s"] == "I one, ever" and got[1]["p"] == "ab c de f"


def test_mention_hash_properties(spark):
    df = spark.createDataFrame([("hi @alice and @bob_2, bare @ end",)], "t string")
    h = df.select(P.hash_mentions("t").alias("h")).first()["h"]
    assert "alice" not in h and "bob_2" not in h
    again = df.select(P.hash_mentions(P.hash_mentions("t")).alias("h")).first()["h"]
    assert len(again) == len(h)


def test_contractions(spark):
    cases = {
        "I'm sure you're right, it's fine and they can't, won't.":
            "I am sure you are right, it is fine and they cannot, will not.",
        "It's That's Can't DON'T gonna": "It is That is Cannot DO NOT going to",
        "Gonna say: the nurse'd know, y'all": "Going to say: the nurse would know, you all",
        "I’ve MIGHTN'T we'll": "I have MIGHT NOT we will",
        "Kim's rock'n'roll 'quoted' o'neil gonnas": "Kim's rock'n'roll 'quoted' o'neil gonnas",
        "don't\tdon't,don't": "do not\tdo not,do not",
        "plain": "plain",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: r["x"] for r in df.select("t", T.expand_contractions("t").alias("x")).collect()}
    assert got == cases


def test_epoch_dates(spark):
    df = spark.createDataFrame([(0,), (86399,), (86400,), (1609459200,), (-1,)], "e long")
    got = [r[0] for r in df.select(T.epoch_to_utc_date("e")).collect()]
    assert got == ["1970-01-01", "1970-01-01", "1970-01-02", "2021-01-01", "1969-12-31"]


def test_link_and_truncate(spark):
    df = spark.createDataFrame([("t3_abc", "x" * 600)], "l string, t string")
    r = df.select(T.link_parent_id("l").alias("p"), F.length(T.truncate_chars("t")).alias("n")).first()
    assert r["p"] == "abc" and r["n"] == 511


def test_banned_list_shape():
    assert len(BANNED_TERMS) == 142
    assert len(set(BANNED_TERMS)) == 135


def test_fast_term_pattern_equals_the_plain_one(spark):
    import random
    rnd = random.Random(11)
    alphabet = ["a", "é", "_", "@", ":", "/", " ", "h", "t", "p", "1", "://", "http://", "\t", "\n", "Ü", "x",
                "@@", ".", "@a", "é://", "a.b"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(T.clean_term("t")).collect()]
    assert got == [" ".join(regex.sub(T.TERM_NOISE, " ", t).split()).lower() for t in texts]


def test_prefix_sum_blocks(spark):
    import itertools
    from carelens.functions.arrays import prefix_sum
    arrs = [[], [5], list(range(1, 300)), [1] * 129, [3, 0, 2] * 50]
    df = spark.createDataFrame([(a,) for a in arrs], "a array<int>")
    got = [r[0] for r in df.select(prefix_sum("a", block=16)).collect()]
    assert got == [list(itertools.accumulate(a)) for a in arrs]
