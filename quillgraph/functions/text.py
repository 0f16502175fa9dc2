"""Text operators as Column functions: all stay inside code generation, none is a Python UDF."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon


def unicode(pattern: str) -> str:
    """A lexicon's pattern for Java: case-insensitive, with \\b, \\w and \\s over Unicode."""
    return f"(?iU){pattern}"


def words_pattern(words) -> str:
    """Case-insensitive pattern of whole words."""
    body = words if isinstance(words, str) else "|".join(words)
    return unicode(rf"\b(?:{body})\b")


def alternatives(words) -> list[str]:
    """Top-level alternatives of a pattern's body."""
    if not isinstance(words, str):
        return list(words)
    out, depth = [""], 0
    for c in words:
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


def heads(words) -> list[str]:
    """The plain letters that each alternative starts with; empty texts where there are none."""
    found = []
    for a in alternatives(words):
        head = re.match(r"[a-z' ]*", a.lower())[0]
        found.append(head[:-1] if a[len(head) : len(head) + 1] in ("?", "*", "{") else head)
    return found


def body_of(pattern: str) -> str:
    """What stands between the word boundaries of a lexicon's pattern; the pattern itself if it isn't of that form."""
    whole = re.fullmatch(r"\\b\(\?:(.*)\)\\b", pattern)
    return whole[1] if whole else pattern


def holds(text, lowered, words) -> Column:
    """Whether a text has one of the words. Plain substring tests of the lower-cased text go before
    the pattern: few texts reach it."""
    found = text.rlike(words_pattern(words))
    starts = heads(words)
    if not all(starts):
        return found
    near = F.lit(False)
    for head in sorted(set(starts)):
        near = near | F.contains(lowered, F.lit(head))
    return near & found


def holds_any(text, lowered, patterns) -> Column:
    """Whether a text has one of a lexicon's patterns."""
    out = F.lit(False)
    for p in patterns:
        body = body_of(p)
        out = out | (holds(text, lowered, body) if body != p else text.rlike(unicode(p)))
    return out


def any_head(patterns) -> str | None:
    """A pattern that every (lower-cased) text matches which one of the patterns may match: beginnings
    of words, by their first letter. None where a pattern has no plain beginning."""
    starts = sorted({h for p in patterns for h in heads(body_of(p))})
    if not all(starts) or any(body_of(p) == p for p in patterns):
        return None
    letters: dict[str, list[str]] = {}
    for h in starts:
        letters.setdefault(h[0], []).append(h[1:])
    return r"(?U)\b(?:" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in letters.items()) + ")"


def tokens(text) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def word_count(text) -> Column:
    return F.size(tokens(text))


def page_clean(text, headers=("BOOK OF",), unless: str = "PARVA") -> Column:
    """Lines without page numbers and running headers; at most one blank line in a row."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: ~x.rlike(r"^\d+$"))
    header = F.array(*[F.lit(h) for h in headers])
    kept = F.filter(kept, lambda x: ~F.exists(header, lambda h: F.startswith(F.upper(x), h)) | F.upper(x).contains(unless))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), r"\A\s+|\s+\z", "")


def strip_tags(html) -> Column:
    """Text of a web page: scripts, styles, then tags go."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def remove_noise(text) -> Column:
    bare = F.regexp_replace(text, r"(?i)table of contents\s+index[^\n]*", "")
    return F.regexp_replace(bare, r"(?i)downloaded from:[^\n]*\n", "")


def paragraph_normalize(text) -> Column:
    """One line, single spaces; null for boilerplate paragraphs."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, "\r", ""), r"\s+", " "))
    return F.when(~flat.rlike(r"(?i)^(table of contents|index|downloaded|file:///)"), flat)


def sentences(text) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")


def sentence_clean(sentence) -> Column:
    out = sentence
    for pattern in (r"https?://\S+", r"file://\S+", r"(?i)\bm\d+\w*\.htm", r"\bwww\.\S+", r"(?i)\b(?:said|spoke|replied|answered|continued),?--"):
        out = F.regexp_replace(out, pattern, "")
    # few sentences have a mark of what goes; the others skip the patterns
    marked = F.contains(F.lower(sentence), F.lit(".htm"))
    for mark in ("http", "file://", "www.", "--"):
        marked = marked | F.contains(sentence, F.lit(mark))
    return F.trim(F.regexp_replace(F.when(marked, out).otherwise(sentence), r"\s+", " "))


def name_normalize(name) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", ""), r"\s+", " "))


def key_terms(text, stopwords=lexicon.STOPWORDS) -> Column:
    """Distinct words of over three letters that are no stop words, sorted."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-zA-Z']+)"), 1)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (F.length(x) > 3) & ~x.isin(*stopwords))))


def entity_clean(text) -> Column:
    lead = "the|a|an|and|or|but|with|of|from|to|for|in|by|at"
    out = F.regexp_replace(text, r"(?U)^[^\w]+|[^\w]+$", "")
    out = F.regexp_replace(F.regexp_replace(out, rf"(?i)^(?:{lead})\s+", ""), rf"(?i)\s+(?:{lead})$", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def snippet(text, size: int = 600) -> Column:
    """At most ``size`` characters, cut at the last space, with an ellipsis if cut."""
    cut = F.regexp_replace(F.substring(text, 1, size), r"\s\S*\z", "")
    return F.when(F.length(text) <= size, text).otherwise(F.concat(cut, F.lit("...")))


def contains_any(text, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def count_contained(text, words) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
