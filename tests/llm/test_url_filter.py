import math
import re

from carelens.llm import url_filter as U


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def rule_of(host, path):
    best = None
    for kind, rule in U.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            if best is None or len(rule) > len(best[1]):
                best = (kind, rule)
    return best


URLS = [None, "", "no scheme", "http://", "HTTP://Blog.Example.NET/en/5?x=1#y", "https://example.net/en", "http://a.example.net/en/",
        "http://notexample.net/de/1", "http://x.net", "http://x.net?q=/a", "http://net/", "http://a.example.com/de/9", "http://a.example.com/DE/9",
        "http://a.org/fr/1", "http://a.org/en/1", "org://b.org/fr/", "http://É.org/fr/x", "a://b://c.net/d", "http://casino-slots.test/play",
        "http://casino-slots.test/play", "http://line\nbreak.net/\nx", "http://h.test/" + "p" * 20_000]


def test_parts_and_rules(spark):
    rows = list(enumerate(URLS))
    df = spark.createDataFrame([(i, u, "mine") for i, u in rows], "page_id long, url string, host string")
    out = {r.page_id: r for r in U.filter_urls(df).collect()}
    assert len(out) == len(rows)
    for i, u in rows:
        host, path = parts(u)
        assert (out[i].host, out[i].path) == (host, path), u
        want = rule_of(host, path)
        assert out[i].rule == (want[1] if want else None), u
        if want:
            assert out[i].verdict == want[0]
        else:
            assert out[i].verdict == ("block" if out[i].score >= 0.5 else "allow")
        assert 0 <= out[i].score <= 1
    assert U.filter_urls(df.limit(0)).count() == 0


def test_the_fit_is_gradient_descent(spark):
    labelled = [("http://bad-casino.test/a", 1), ("http://good.test/b", 0), ("http://bad-bets.test/c", 1), ("http://fine.test/d", 0)]
    df = spark.createDataFrame(labelled + [(None, 1), ("http://x.test", None)], "url string, label int")
    buckets, steps, rate, ridge = 16, 20, 4.0, 1e-4
    got = U.fit(df, (3,), buckets, steps, rate, ridge)
    rows = U.features(df.filter("url IS NOT NULL AND label IS NOT NULL").select(
        "label", U.host_of(df.url).alias("host"), U.path_of(df.url).alias("path")), (3,), buckets).collect()
    xs = []
    for r in rows:
        x = [0.0] * buckets + [1.0]
        for g in r.grams:
            x[g] += 1 / math.sqrt(len(r.grams))
        xs.append((x, r.label))
    w = [0.0] * (buckets + 1)
    for _ in range(steps):
        g = [0.0] * len(w)
        for x, y in xs:
            e = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x)))) - y
            g = [a + e * b for a, b in zip(g, x)]
        w = [a - rate * (b / len(xs) + ridge * a) for a, b in zip(w, g)]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, w))
    assert U.fit(df.limit(0), (3,), 4, 3) == [0.0] * 5


def test_unseen_hosts(spark):
    bad = ["http://lucky-casino.test/en/1", "http://free-bets.test/x", "http://spam-farm.test/y", "https://cheap-pills.test/z"]
    good = ["http://weather.test/en/3", "http://gardening.test/de/8", "https://archive.test/fr/1", "http://others.test/en/77"]
    df = spark.createDataFrame([(u,) for u in bad + good], "url string")
    got = {r.url: r.verdict for r in U.filter_urls(df).collect()}
    assert [got[u] for u in bad + good] == ["block"] * 4 + ["allow"] * 4


def test_no_python_in_the_plan(spark):
    df = U.filter_urls(spark.createDataFrame([(u,) for u in URLS], "url string"))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
