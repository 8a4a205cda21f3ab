"""Vector similarity and full-text matching as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = r"[^a-z0-9_]+"


def dot(a: Column, b: Column) -> Column:
    terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def words(c: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores (this engine's tokenizer)."""
    return F.filter(F.split(F.lower(c), WORD_BREAK), lambda w: w != "")


def prefix_pattern(token: str) -> str | None:
    """Pattern of a word of lower-cased text that starts with ``token``; none if no word can."""
    token = token.lower()
    return rf"(?<![a-z0-9_]){token}" if re.fullmatch(r"[a-z0-9_]+", token) else None


def matches_all(low: Column, query: str) -> Column:
    """Every word of the query is a prefix of some word of the lower-cased text; a blank query matches nothing."""
    patterns = [prefix_pattern(t) for t in query.lower().split()]
    if not patterns or None in patterns:
        return F.lit(False)
    return reduce(lambda a, b: a & b, [low.rlike(p) for p in patterns])


def prefix_frequency(low: Column, token: str) -> Column:
    """Number of words of the lower-cased text that start with ``token``."""
    pattern = prefix_pattern(token)
    return F.regexp_count(low, F.lit(pattern)) if pattern else F.lit(0)


def cover_density(doc_words: Column, terms: list[str], weight: float = 0.1) -> Column:
    """Sum over the shortest runs of words that hold a match of every term: ``weight`` over one plus the other words in the run.

    A run ends at a match; it starts at the earliest of the terms' last matches before that, and counts if this
    start is later than that of every run before.
    """
    on = lambda w: F.array(*[w.startswith(t) for t in terms])
    marks = F.filter(F.transform(doc_words, lambda w, i: F.struct(i.alias("at"), on(w).alias("on"))), lambda m: F.array_contains(m["on"], True))
    return cover_of_marks(marks, len(terms), weight)


def cover_of_marks(marks: Column, n: int, weight: float = 0.1) -> Column:
    """The same of marks (at, on) in order of their places: where a match is, and of which of ``n`` terms."""
    marks = F.transform(marks, lambda m, k: F.struct(m["at"].alias("at"), m["on"].alias("on"), k.alias("k")))
    none = F.array(*[F.lit(-1) for _ in range(n)])
    start = F.struct(none.alias("at"), none.alias("k"), F.lit(-1).alias("low"), F.lit(0.0).alias("score"))

    def step(s: Column, m: Column) -> Column:
        at = F.zip_with(s["at"], m["on"], lambda old, hit: F.when(hit, m["at"]).otherwise(old))
        k = F.zip_with(s["k"], m["on"], lambda old, hit: F.when(hit, m["k"]).otherwise(old))
        low, others = F.array_min(at), (m["at"] - F.array_min(at)) - (m["k"] - F.array_min(k))
        score = s["score"] + F.when(low > s["low"], F.lit(weight) / (1 + others)).otherwise(F.lit(0.0))
        return F.struct(at.alias("at"), k.alias("k"), F.greatest(low, s["low"]).alias("low"), score.alias("score"))

    return F.aggregate(marks, start, step, lambda s: s["score"])


def rank(low: Column, query: str) -> Column:
    """Rank of matching lower-cased text: a tenth per match of a single word, cover density of several."""
    terms = list(dict.fromkeys(query.lower().split()))
    if len(terms) < 2:
        return prefix_frequency(low, "".join(terms)) * 0.1
    return cover_density(words(low), terms)
