"""Language identification by error-correcting output codes.

Every language has a codeword of +1/-1 bits; one linear classifier over hashed
n-grams predicts each bit. A text takes the language whose codeword has the
smallest loss summed over the bits, each bit weighted by how well its
classifier does on rows left out of its fit. ``score`` is the share of the
winner in exp(-loss); ``ambiguous`` marks texts whose runner-up is close.

Up to 6 languages get the exhaustive code (every split of the languages but
complements); more get seeded random columns, redrawn for distance.

Only a bounded sample is fitted: about ``sample`` texts in all, shared equally by the languages, but up to ``least`` of
each language, however many there are, chosen by a hash of the id; and of each language ``sample_bytes`` of text
over the number of languages at most. Long texts come last in that order and what no longer fits is passed over, so
no text displaces the others of its language; a language with longer texts only gives the beginning of its smallest.
Every language with a text can be predicted. Every text is read whole. Null texts and texts without a letter are
``und`` with score 0 and not ambiguous. A null id is kept; repeated rows repeat.
Without training rows everything with letters is ``und`` with score 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import small_batches
from .common import session
from .linear_bag import WORD, Vocabulary, bounded_sample, groups, has_letter, word_lists

UNKNOWN = "und"


@dataclass(frozen=True)
class Config:
    lo: int = 2
    hi: int = 4
    buckets: int = 1 << 13
    sample: int = 2800
    least: int = 8
    sample_bytes: int = 1 << 26
    epochs: int = 30
    patience: int = 3
    rate: float = 0.5
    margin: float = 0.2
    seed: int = 11


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1/-1
    u: np.ndarray  # buckets x bits
    bias: np.ndarray
    weight: np.ndarray  # of each bit's loss
    config: Config

    def decode(self, margins: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each row of bit margins."""
        loss = np.logaddexp(0, -self.code[None] * margins[:, None, :]) @ self.weight
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        top = np.sort(p, axis=1)
        close = top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0) < self.config.margin
        return [self.languages[k] for k in best], p[np.arange(len(p)), best], close


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """Codes of ``k`` classes as rows of +1/-1."""
    if k == 1:
        return np.ones((1, 1))
    if k <= 6:
        cols = [[1 if i == 0 or (m >> (i - 1)) & 1 else -1 for i in range(k)] for m in range(2 ** (k - 1) - 1)]
        return np.array(cols, float).T
    bits, rng, best = int(np.ceil(10 * np.log2(k))), np.random.default_rng(seed), None
    for _ in range(50):
        c = rng.choice([-1.0, 1.0], (k, bits))
        gap = (bits - np.abs(c @ c.T - bits * 2 * np.eye(k)).max()) / 2
        if best is None or gap > best[0]:
            best = (gap, c)
    return best[1]


def fit(texts: list[str], languages: list[str], c: Config = Config()) -> Model | None:
    """Fit every bit on the given rows; None without rows."""
    names = sorted(set(languages))
    if not names:
        return None
    code = codewords(len(names), c.seed)
    rng = np.random.default_rng(c.seed)
    index: dict[str, int] = {}
    rows, lang = [], []
    for t, g in zip(texts, languages, strict=True):
        w = WORD.findall((t or "").lower())
        if not w or not has_letter(t):
            continue
        # a fit on the whole text and on a piece of it, so short texts are known too
        cut = int(rng.integers(0, len(w)))
        for part in (w, w[cut : cut + int(rng.integers(1, 16))]):
            rows.append(np.fromiter((index.setdefault(x, len(index)) for x in part), np.int64, len(part)))
            lang.append(names.index(g))
    if not rows:
        return None
    where, first = word_lists(list(index), c.lo, c.hi, c.buckets)
    n = np.diff(first)
    # features of a row: mean over words of the word's mean bag, as (bucket, value) pairs over the used buckets
    used, pos = np.unique(where, return_inverse=True)
    pos = pos.astype(np.int32)
    col, val = [], []
    for r in rows:
        u, m = np.unique(r, return_counts=True)
        at = np.concatenate([pos[first[k] : first[k + 1]] for k in u])
        x = np.bincount(at, weights=np.repeat(m / n[u] / len(r), n[u]), minlength=len(used))
        col.append(np.flatnonzero(x).astype(np.int32)), val.append(x[col[-1]].astype(np.float32))
    total, square = np.zeros(len(used)), np.zeros(len(used))
    for k, v in zip(col, val, strict=True):
        total[k] += v
        square[k] += v**2
    scale = (1 / (np.sqrt(np.maximum(square / len(rows) - (total / len(rows)) ** 2, 0)) + 1e-3)).astype(np.float32)
    val = [v * scale[k] for k, v in zip(col, val, strict=True)]
    y = code[np.array(lang)].astype(np.float32)
    held = np.arange(len(rows)) // 2 % 8 == 7 if len(rows) >= 160 else np.zeros(len(rows), bool)
    train = np.flatnonzero(~held)
    share = np.bincount(np.array(lang)[train], minlength=len(names))
    wt = (len(train) / (len(names) * np.maximum(share, 1)))[np.array(lang)].astype(np.float32)
    w, b = np.zeros((len(used), code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    gw, gb = np.full(w.shape, 1e-4, np.float32), np.full(b.shape, 1e-4, np.float32)
    block = np.zeros((256, len(used)), np.float32)

    def dense(at: np.ndarray) -> np.ndarray:
        """Rows of one batch, in a buffer that is used again."""
        out = block[: len(at)]
        out[:] = 0
        for i, k in enumerate(at.tolist()):
            out[i, col[k]] = val[k]
        return out

    test, best, waited = np.flatnonzero(held) if held.any() else train, np.inf, 0
    for _ in range(c.epochs):
        rng.shuffle(train)
        for k in range(0, len(train), 256):
            at = train[k : k + 256]
            xb = dense(at)
            g = -y[at] / (1 + np.exp(np.clip(y[at] * (xb @ w + b), -30, 30))) * wt[at, None] / len(at)
            dw, db = xb.T @ g + 1e-4 * w, g.sum(axis=0)
            gw += dw**2
            gb += db**2
            w -= c.rate * 0.1 * dw / np.sqrt(gw)
            b -= c.rate * 0.1 * db / np.sqrt(gb)
        margin = np.concatenate([y[test[k : k + 256]] * (dense(test[k : k + 256]) @ w + b) for k in range(0, len(test), 256)])
        loss = float(np.logaddexp(0, -margin).mean())
        best, waited = (loss, 0) if loss < 0.99 * best else (best, waited + 1)
        if held.any() and waited >= c.patience:
            break
    right = (margin > 0).mean(axis=0)
    right = np.clip(right, 0.51, 0.999)
    weight = np.log(right / (1 - right))
    u = np.zeros((c.buckets, code.shape[1]))
    u[used] = w * scale[:, None]
    return Model(names, code, u, b.astype(float), weight / weight.sum() * code.shape[1], c)


def language_sample(docs: DataFrame, usable: Column, c: Config = Config(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], list[str]]:
    """About ``sample`` texts, as many of each language where there are enough, with a non-null label, by a hash of the id."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & usable)
    counts = rows.groupBy(lang).count().collect()  # one row per language
    if not counts:
        return [], []
    each = max(c.least, c.sample // len(counts))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[lang], min(1.0, 1.5 * each / r["count"]))])
    ticket = F.pmod(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("lang")), F.lit(1 << 20)) / float(1 << 20)
    # the shares keep the ranking small
    part = bounded_sample(rows.where(ticket < F.try_element_at(share, F.col(lang))), lang, text, doc_id, ticket, each, c.sample_bytes // len(counts))
    return part[text].tolist(), part[lang].tolist()


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of each row, whole texts."""
    spark = session(docs)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        vocab = m and Vocabulary(m.u, m.config.lo, m.config.hi)
        for b in batches:
            names, scores, close = [], [], []
            for part in groups(b.column(1).to_pylist(), lambda t: len(t or ""), 2_000_000):
                ok = [bool(m and has_letter(t)) for t in part]
                words = [WORD.findall(t.lower()) for t, k in zip(part, ok, strict=True) if k]
                found = iter(())
                if words:
                    margins = np.stack([r.mean(axis=0) for r in vocab.rows(words)]) + m.bias
                    found = zip(*m.decode(margins), strict=True)
                for k in ok:
                    g, s, a = next(found) if k else (UNKNOWN, 0.0, False)
                    names.append(g), scores.append(float(s)), close.append(bool(a))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(close, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
