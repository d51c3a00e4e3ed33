"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

DataFrame functions only, training included.  A URL's text is its host between ``^`` and
``$`` and its path with digits as 0; the n-grams of both are hashed into ``buckets``
counts, scaled to unit length.  The labelled table is small: its vectors are collected
into one row and fitted there by gradient descent, an ``aggregate`` over the steps.  The
weights (``buckets`` + 1 numbers) then stand as a constant array in the scoring expression,
so scoring is one scan without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: (verdict, rule): the rule's host stands for all its subdomains.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: A small labelled table: URLs of unwanted sites (1) and of wanted ones (0).
LABELLED = (
    ("http://casino-royal.test/en/1", 1), ("https://www.best-casino.test/play/99", 1),
    ("http://online-casino.test/slots", 1), ("http://bets-today.test/en/7", 1),
    ("https://sports-bets.test/live/3", 1), ("http://freebets.test/", 1),
    ("http://poker-win.test/en/12", 1), ("https://win-prizes.test/claim", 1),
    ("http://big-win.test/spin", 1), ("http://cheap-meds.test/order", 1),
    ("https://cheap-deals.test/buy", 1), ("http://diet-pills.test/en/5", 1),
    ("http://blue-pills.test/shop", 1), ("https://pills-online.test/", 1),
    ("http://adult-chat.test/x", 1), ("https://www.adult-video.test/en/8", 1),
    ("http://xxx-tube.test/v/1", 1), ("http://ads-server.test/click", 1),
    ("https://track-click.test/p?id=1", 1), ("http://ad-track.test/pixel", 1),
    ("http://banner-ads.test/en/4", 1), ("http://link-farm.test/", 1),
    ("https://seo-spam.test/en/3", 1), ("http://spam-links.test/a", 1),
    ("http://content-farm.test/en/77", 1), ("http://free-money.test/now", 1),
    ("https://free-gifts.test/win", 1), ("http://cheap-loans.test/apply", 1),
    ("http://hot-dates.test/en/6", 1), ("http://payday-loans.test/en/2", 1),
    ("https://news.daily.test/en/2024", 0), ("http://library.town.test/catalog/18", 0),
    ("https://www.university.test/en/research", 0), ("http://blog.garden.test/en/412", 0),
    ("https://museum.test/fr/9", 0), ("http://m.weather.test/de/33", 0),
    ("https://docs.project.test/en/guide.html", 0), ("http://history.test/es/87", 0),
    ("https://www.kitchen.test/en/recipes/5", 0), ("http://school.test/de/112", 0),
    ("https://m.thonet.test/en/3665", 0), ("http://blog.another.test/fr/1258", 0),
    ("https://theory.test/en/2599", 0), ("http://reading.test/en/4897", 0),
    ("http://www.station.test/en/4229", 0), ("https://thread.test/de/4519.html", 0),
    ("http://mention.test/es/24149", 0), ("https://bletchley.test/en/5", 0),
    ("https://m.others.test/en/31", 0), ("http://ingham.test/en/68", 0),
    ("http://www.nation.test/fr/8516", 0), ("https://edition.test/en/7", 0),
    ("https://blog.thorn.test/en/25", 0), ("http://m.theatre.test/de/71", 0),
    ("https://hearth.test/en/940", 0), ("http://wherever.test/es/55", 0),
    ("https://www.anthem.test/en/271", 0), ("http://northern.test/fr/64", 0),
    ("https://m.inner.test/en/880", 0), ("http://blog.rather.test/en/9129", 0),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else ''."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else ''."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule = verdict = None
    # tried from the longest to the shortest; equally long ones in the order given
    for kind, text in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _ngrams(text: Column, sizes, buckets: int) -> Column:
    """Hash buckets of the n-grams of ``text``, one entry per occurrence."""
    parts = []
    for n in sizes:
        last = F.char_length(text) - n
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(at, lambda i: F.pmod(
            F.xxhash64(F.substring(text, i + 1, F.lit(n))), F.lit(buckets)).cast("int")))
    return F.flatten(F.array(*parts))


def features(df: DataFrame, sizes, buckets: int) -> DataFrame:
    """Adds ``grams``, the hash buckets of the n-grams of ``host`` and ``path``."""
    text = F.concat(F.lit("^"), F.col("host"), F.lit("$"),
                    F.regexp_replace(F.col("path"), "[0-9]", "0"))
    df = df.withColumn("__t", text)
    return df.withColumn("grams", _ngrams(F.col("__t"), sizes, buckets)).drop("__t")


def fit(labelled: DataFrame, sizes=(3, 4), buckets: int = 512, steps: int = 200, rate: float = 4.0,
        ridge: float = 1e-4, max_rows: int = 500) -> list[float]:
    """Weights (``buckets`` of them, then the intercept) from (url, label) rows.

    At most ``max_rows`` rows are used, the first by the hash of their URL; rows without a
    URL or label are left out.  Without rows all weights are 0.
    """
    rows = (labelled.filter("url IS NOT NULL AND label IS NOT NULL").select("url", F.col("label").cast("double"))
            .orderBy(F.xxhash64("url"), "url", "label").limit(max_rows)
            .select("label", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    rows = features(rows, sizes, buckets)
    norm = F.sqrt(F.greatest(F.size("grams"), F.lit(1)).cast("double"))
    # a dense vector per row, with a last entry of 1 for the intercept
    vector = F.concat(F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda j: F.size(
        F.filter("grams", lambda g: g == j)) / norm), F.array(F.lit(1.0)))
    rows = rows.select("label", vector.alias("x"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("label", "x"))).alias("rows"))
    zeros = F.array_repeat(F.lit(0.0), buckets + 1)

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    def share(w, r):
        error = F.array(1 / (1 + F.exp(-dot(w, r["x"]))) - r["label"])
        # the error is the one element of an array that is mapped, so it is computed once
        return F.flatten(F.transform(error, lambda e: F.transform(r["x"], lambda v: v * e)))

    def step(w, _):
        gradient = F.aggregate("rows", zeros, lambda g, r: F.zip_with(
            g, share(w, r), lambda p, q: p + q))
        return F.zip_with(w, gradient, lambda p, q: p - rate * (q / F.greatest(F.size("rows"), F.lit(1)) + ridge * p))

    fitted = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zeros, step).alias("w"))
    return [float(v) for v in fitted.collect()[0]["w"]]


def probability(weights: list[float]) -> Column:
    """P(label 1) from ``grams``."""
    w = F.lit(weights[:-1])
    norm = F.sqrt(F.greatest(F.size("grams"), F.lit(1)).cast("double"))
    total = F.aggregate("grams", F.lit(0.0), lambda s, g: s + F.get(w, g))
    return 1 / (1 + F.exp(-(total / norm + weights[-1])))


def _default_labelled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELLED), "url string, label int")


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, url_col: str = "url", rules=RULES,
                threshold: float = 0.5, sizes=(3, 4), buckets: int = 512, **fitting) -> DataFrame:
    """Adds host, path, rule, score and verdict (allow or block) to every row.

    The longest rule that fits decides; else ``block`` if the model's probability reaches
    ``threshold``.  A null URL, or one without ``://``, has an empty host and path, no rule
    and the model's verdict on those.  Columns of these names in the input are replaced.
    """
    labelled = labelled if labelled is not None else _default_labelled(pages.sparkSession)
    weights = fit(labelled, sizes, buckets, **fitting)
    made = ("host", "path", "rule", "score", "verdict")
    url = F.col(url_col)
    kept = [c for c in pages.columns if c not in made]
    rows = pages.select(*kept, host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = features(rows.withColumns({"rule": rule, "__said": verdict}), sizes, buckets)
    rows = rows.withColumn("score", probability(weights))
    verdict = F.coalesce("__said", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return rows.withColumn("verdict", verdict).select(*kept, *made)
