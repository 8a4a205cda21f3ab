"""Classifiers of statements behind one interface.

A backend maps a batch of texts to (label, confidence, error) rows; it may call
a model. The default backends are rules, so results are the same everywhere. Texts are
cut as the callers of a model would cut them, since models bill by length.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.literals import spelled

VERDICT = "struct<label:string,confidence:double,error:string>"
CORRECTION_LIMIT, PROJECT_LIMIT, STATEMENT_LIMIT, MEMORY_LIMIT = 1500, 1000, 800, 300
Backend = Callable[[list[str]], list[tuple[str | None, float, str | None]]]


def classify(c: Column, backend: Backend, limit: int = PROJECT_LIMIT, attempts: int = 3) -> Column:
    """label, confidence and error of each text's first ``limit`` characters. A batch that keeps failing has the error in all its rows."""

    @F.pandas_udf(VERDICT)
    def run(s: pd.Series) -> pd.DataFrame:
        texts = [(t or "")[:limit] for t in s]
        for k in range(attempts):
            try:
                rows = backend(texts)
                break
            except Exception as e:  # a backend may fail in any way; the row says how
                rows = [(None, 0.0, str(e))] * len(texts)
        return pd.DataFrame(rows, columns=["label", "confidence", "error"])

    return run(c)


def keyword_backend(labels: dict[str, list[str]]) -> Backend:
    """The label with most of its keywords in the text, and their share as confidence."""

    def run(texts: list[str]) -> list[tuple[str | None, float, str | None]]:
        out = []
        for t in texts:
            low = t.lower()
            best = max(((sum(k in low for k in ks) / len(ks), name) for name, ks in labels.items()), key=lambda x: x[0], default=(0.0, None))
            out.append((best[1] if best[0] > 0 else None, best[0], None))
        return out

    return run


def pattern_backend(labels: dict[str, list[str]]) -> Backend:
    """The first label that has a pattern (case ignored) in the text, for sure."""
    compiled = {name: [re.compile(spelled(p, lines=True), re.IGNORECASE | re.ASCII) for p in patterns] for name, patterns in labels.items()}

    def run(texts: list[str]) -> list[tuple[str | None, float, str | None]]:
        found = (next((name for name, ps in compiled.items() if any(p.search(t) for p in ps)), None) for t in texts)
        return [(name, 1.0 if name else 0.0, None) for name in found]

    return run


def contradiction(statement: Column, memories: Column) -> Column:
    """struct(contradicts, idx, confidence): the first stored statement that says the opposite by one negation.

    A rule, standing in for a model: the texts are equal but for the word "not". Without memories there is no contradiction, for sure.
    """
    bare = lambda t: F.regexp_replace(F.lower(t), r"\bnot ", "")
    new = F.substring(statement, 1, STATEMENT_LIMIT)
    negated = lambda t: F.lower(t).rlike(r"\bnot ")
    hits = F.transform(memories, lambda m: (bare(F.substring(m, 1, MEMORY_LIMIT)) == bare(new)) & (negated(m) != negated(new)))
    at = F.array_position(hits, True)
    return F.struct((F.coalesce(at, F.lit(0)) > 0).alias("contradicts"), F.when(at > 0, at - 1).alias("idx"), F.lit(1.0).alias("confidence"))
