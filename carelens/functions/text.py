"""Text scalar functions as Column builders.

All of them are built-in Catalyst expressions (``regexp_replace``, ``translate``,
``lower``, higher-order array functions), so they run inside whole-stage codegen or the
JVM expression evaluator; nothing here calls back into Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import (CONTRACTIONS, CONTRACTION_ENDINGS, PUNCTUATION, SHORT_FORMS, STOPWORDS_EN)
from .patterns import NON_SPACE, SPACE, SPACES, WORD

ColumnOrName = Column | str

URL = r"https?://" + NON_SPACE + "+"


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: ColumnOrName) -> Column:
    """Python ``str.strip()``: remove Unicode white space at both ends (``trim`` only cuts blanks;
    a pattern would be tried at every white space inside the text)."""
    return F.btrim(_c(c), F.lit(SPACES))


def collapse_ws(c: ColumnOrName) -> Column:
    """Python ``' '.join(s.split())``: white-space runs to one blank, ends stripped."""
    return strip_ws(F.regexp_replace(_c(c), f"{SPACE}+", " "))


def remove_urls(c: ColumnOrName) -> Column:
    """Delete ``https?://\\S+``."""
    return F.regexp_replace(_c(c), URL, "")


def remove_special_characters(c: ColumnOrName) -> Column:
    """Delete ``@\\S*`` mentions, newline to blank, ``&amp;`` to ``&``, strip."""
    x = F.regexp_replace(_c(c), "@" + NON_SPACE + "*", "")
    x = F.replace(x, F.lit("\n"), F.lit(" "))
    x = F.replace(x, F.lit("&amp;"), F.lit("&"))
    return strip_ws(x)


def clean_post_text(c: ColumnOrName) -> Column:
    """The post cleaner, T1 then T2."""
    return remove_special_characters(remove_urls(c))


def lowercase(c: ColumnOrName) -> Column:
    """T4."""
    return F.lower(_c(c))


def remove_punctuation(c: ColumnOrName) -> Column:
    """T5: delete the 32 ASCII punctuation characters."""
    return F.translate(_c(c), PUNCTUATION, "")


def split_ws(c: ColumnOrName) -> Column:
    """Python ``str.split()``: split on white-space runs, no empty pieces."""
    return F.filter(F.split(strip_ws(c), SPACE + "+"), lambda w: w != "")


def remove_stopwords(c: ColumnOrName, stopwords: list[str] | None = None) -> Column:
    """Drop words found in the stop list; case sensitive; words re-joined by one blank.

    ``isin`` with many literals becomes a hash-set lookup (``InSet``) in the optimizer.
    """
    stop = list(STOPWORDS_EN if stopwords is None else stopwords)
    words = split_ws(c)
    kept = F.filter(words, lambda w: ~w.isin(*stop)) if stop else words
    return F.when(_c(c).isNull(), F.lit(None)).otherwise(F.array_join(kept, " "))


_WORD_EDGE = "(?<![A-Za-z0-9_'])(?=[A-Za-z0-9_'])|(?<=[A-Za-z0-9_'])(?![A-Za-z0-9_'])"
_SHORT_FORM = "(?i)(^|[^A-Za-z0-9_'])(" + "|".join(SHORT_FORMS) + ")([^A-Za-z0-9_']|$)"


def _cased(word: Column, full: Column) -> Column:
    """``full`` in capitals if ``word`` is, with a capital if ``word`` has one."""
    capitals = (word == F.upper(word)) & (F.length(word) > 1)
    capital = F.substring(word, 1, 1).rlike("[A-Z]")
    return (F.when(capitals, F.upper(full))
            .when(capital, F.concat(F.upper(F.substring(full, 1, 1)), F.substring(full, 2, 1 << 30)))
            .otherwise(full))


def expand_contractions(c: ColumnOrName) -> Column:
    """Expand English contractions and short forms (``constants.CONTRACTIONS``,
    ``SHORT_FORMS``, and the endings of other words); a capital, or capitals, are kept.

    One pass: the text is cut where words begin and end, every word is looked up once, and
    the pieces are joined.  Rows without an apostrophe or short form pass through after two
    tests.
    """
    src = _c(c)
    known = F.create_map(*[F.lit(x) for pair in (CONTRACTIONS | SHORT_FORMS).items() for x in pair])

    def expand(word: Column) -> Column:
        key = F.lower(word)
        out = F.when(key.isin(*CONTRACTIONS, *SHORT_FORMS), _cased(word, F.element_at(known, key)))
        for end, full in CONTRACTION_ENDINGS.items():
            stem = F.substring(word, F.lit(1), F.length(word) - len(end))
            capitals = (word == F.upper(word)) & (F.length(word) > len(end) + 1)
            out = out.when(key.endswith(end) & stem.rlike("^[A-Za-z]+$"),
                           F.concat(stem, F.when(capitals, F.lit(full.upper())).otherwise(F.lit(full))))
        return out.otherwise(word)

    pieces = F.split(F.replace(src, F.lit("’"), F.lit("'")), _WORD_EDGE)
    worth = src.contains("'") | src.contains("’") | src.rlike(_SHORT_FORM)
    whole = F.array_join(F.transform(pieces, lambda w: F.when(
        F.length(w) > 2, expand(w)).otherwise(w)), "")
    return F.when(worth, whole).otherwise(src)


# T8 pattern: a mention of ASCII letters/digits, any character that is not an ASCII
# letter, digit, blank or tab, or a URL-like token; each becomes a blank.  This is the
# reference form (used by the SQL oracle, whose engine is linear-time).
TERM_NOISE = r"(@[A-Za-z0-9]+)|([^0-9A-Za-z \t])|(" + WORD + r"+://" + NON_SPACE + "+)"
# Same matches for a backtracking engine: a URL token can only begin where no word
# character precedes it or right where the previous match ended (``\G``): at any other
# position inside a word the scan already tried the URL from the word's first
# unconsumed character.  Without the anchor every suffix of every word is rescanned.
# Runs of noise characters are replaced at once (the blanks are collapsed afterwards
# anyway); ``@`` stays out of the run so the mention branch keeps its turn at every ``@``.
# The run class is written as the explicit complement of [0-9A-Za-z blank tab @]: the
# JVM engine evaluates this positive form about 20x faster than the negated one.
NOISE_RUN = r"[\x00-\x08\x0a-\x1f!-/:-?\[-`{-\x{10FFFF}]+"
TERM_NOISE_FAST = (r"(@[A-Za-z0-9]+)|(" + NOISE_RUN + r")|(@)|((?:(?<!" + WORD + r")|\G)" + WORD
                   + r"++://" + NON_SPACE + "+)")
TERM_NOISE_NO_URL = r"(@[A-Za-z0-9]+)|(" + NOISE_RUN + r")|(@)"


def clean_term(c: ColumnOrName) -> Column:
    """Term cleaner: noise to blank, white space collapsed, lower case.

    Texts without ``://`` cannot hold the URL alternative, so they use the two-branch
    pattern; the others use the anchored form.
    """
    x = _c(c)
    noise = F.when(x.contains("://"), F.regexp_replace(x, TERM_NOISE_FAST, " ")).otherwise(
        F.regexp_replace(x, TERM_NOISE_NO_URL, " "))
    return F.lower(collapse_ws(noise))


def epoch_to_utc_date(c: ColumnOrName) -> Column:
    """Epoch seconds -> ``yyyy-MM-dd`` of the UTC day; independent of the session time zone."""
    days = F.floor(_c(c).cast("double") / 86400).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")


def truncate_chars(c: ColumnOrName, n: int = 511) -> Column:
    """First ``n`` characters (the classifier's input limit)."""
    return F.substring(_c(c), 1, n)


def link_parent_id(c: ColumnOrName) -> Column:
    """``t3_abc`` -> ``abc`` (drop the 3-character kind prefix)."""
    return F.substring(_c(c), 4, 1 << 30)


def underscore_blanks(c: ColumnOrName) -> Column:
    """Blanks to underscores."""
    return F.replace(_c(c), F.lit(" "), F.lit("_"))


# T9 pieces: the tweet pre-processor's URL, emoji and escape-character classes, our form.
EMOJI = (r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}"
         r"\x{1F1E6}-\x{1F1FF}]")
ESCAPES = r"[\n\r\t\f\x0b]"
WWW_URL = r"(?:https?://|www\.)" + NON_SPACE + "+"


def strip_unwanted_chars(c: ColumnOrName) -> Column:
    """T9 leaf rule: drop URLs, emoji and escape characters, punctuation to blank,
    then drop every non-ASCII character."""
    x = F.regexp_replace(_c(c), WWW_URL, "")
    x = F.regexp_replace(x, EMOJI, "")
    x = F.regexp_replace(x, ESCAPES, "")
    x = F.translate(x, PUNCTUATION, " " * len(PUNCTUATION))
    return F.regexp_replace(x, r"[^\x00-\x7F]", "")


def default_clean(c: ColumnOrName, urls: bool = False, punctuation: bool = False,
                  lower: bool = False, contractions: bool = True) -> Column:
    """Default order: contractions, special characters; optional URLs, punctuation, lower case."""
    x = _c(c)
    if contractions:
        x = expand_contractions(x)
    x = remove_special_characters(x)
    if urls:
        x = remove_urls(x)
    if punctuation:
        x = remove_punctuation(x)
    if lower:
        x = lowercase(x)
    return x

