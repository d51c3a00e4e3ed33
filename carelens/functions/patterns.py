"""Regular-expression building blocks shared by Spark (Java regex) and DuckDB (RE2).

Python's ``re`` treats ``\\w``, ``\\W``, ``\\s`` and ``\\S`` as Unicode classes; Java's
are ASCII unless ``(?U)`` is given, and RE2's are always ASCII.  The classes below are
written out with Unicode properties so that the same pattern text gives the same
answer in all three engines (Python semantics), and so an oracle query in DuckDB can
reuse the pattern unchanged.  ``\\b`` is never used: Java and RE2 disagree on it.
"""

from __future__ import annotations

import re

# Python str.isalnum() or "_"  ==  \w for str patterns
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
# Python str.isspace()  ==  \s for str patterns
SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
# the characters of SPACE
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                           0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
NON_SPACE = r"[^\t-\r\x1c-\x1f\x85\p{Z}]"
# word characters of the keyword matcher: ASCII letters, digits and underscore only
ASCII_WORD = r"[A-Za-z0-9_]"
ASCII_NON_WORD = r"[^A-Za-z0-9_]"

_TRANSLATE = {
    r"\w": WORD, r"\W": NON_WORD, r"\s": SPACE, r"\S": NON_SPACE,
}


def py_classes(pattern: str) -> str:
    """Rewrite ``\\w \\W \\s \\S`` outside character classes into the portable classes.

    Only handles the shorthand escapes at top level (not inside ``[...]``), which is
    all the fixed patterns of this library use.
    """
    out = []
    i = 0
    in_class = False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            pair = pattern[i:i + 2]
            if not in_class and pair in _TRANSLATE:
                out.append(_TRANSLATE[pair])
            else:
                out.append(pair)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def escape_literal(term: str) -> str:
    """Escape a literal for Java regex and RE2 alike (both accept backslash-escaped punctuation)."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)


def trie_alternation(terms: list[str], escape: bool = True) -> str:
    """Non-capturing alternation of ``terms`` factored as a prefix trie.

    Within every trie node longer continuations come before the end-of-term option, so
    the regex engine tries the longest term first at each start and backtracks to a
    shorter one only if what follows fails.  The regex costs O(text x depth) instead of
    O(text x number of terms) for a flat alternation.
    """
    uniq = sorted(set(t for t in terms if t != ""))
    if not uniq:
        raise ValueError("need at least one non-empty term")
    root: dict = {}
    END = ""
    for t in uniq:
        node = root
        for ch in t:
            node = node.setdefault(ch, {})
        node[END] = True

    def lit(ch: str) -> str:
        return escape_literal(ch) if escape else ch

    def render(node: dict) -> str:
        branches = []
        for ch in sorted(k for k in node if k != END):
            child = node[ch]
            # collapse single-child chains into one literal run
            run = lit(ch)
            while len(child) == 1 and END not in child:
                (nxt, child), = child.items()
                run += lit(nxt)
            branches.append(run + render(child) if child else run)
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        if END in node:
            return "(?:" + body + ")?"
        return body

    pattern = render(root)
    return "(?:" + pattern + ")"
