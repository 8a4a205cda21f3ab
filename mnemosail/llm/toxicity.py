"""Toxicity scores from sub-word bag embeddings under a linear softmax.

A word is the mean of the embeddings of its n-grams, a passage of ``span``
words the mean of its words, and a softmax layer over two classes reads the
passage. Embeddings and softmax are trained together in numpy. Misspellings
that were never seen share n-grams, and so vectors, with words that were.

A text is as toxic as its worst passage, so one bad sentence counts the same
in a short text and in a very long one. Labels are given per text: training
alternates between choosing each toxic text's worst passages under the current
model and fitting those against passages of clean texts. A final logistic
curve, fitted on texts left out of training, turns worst-passage logits into
probabilities.

Only a bounded sample of the labelled rows is fitted (about ``sample_toxic`` +
``sample_clean`` texts, chosen by a hash of the id, never twice that, and ``sample_bytes`` of
text of either label at most; long texts come last, and what no longer fits is passed over); every text is scored whole.
The queries fit it in one task (``fit_rows``), so that the driver holds the model only.

Null and empty texts score like a text without words (the lowest passage logit
that the curve was fitted on); rows with a null id are scored too, and their
``held_out`` is false. Repeated rows give repeated results. Without labels of both
classes every score is 0.5 * share of toxic labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import small_batches
from .common import session
from .linear_bag import WORD, Vocabulary, bounded_rows, groups, in_order, word_lists


@dataclass(frozen=True)
class Config:
    lo: int = 3
    hi: int = 6
    buckets: int = 1 << 17
    dim: int = 8
    span: int = 2
    sample_toxic: int = 1500
    sample_clean: int = 2500
    sample_bytes: int = 1 << 25
    rounds: int = 4
    epochs: int = 2
    batch: int = 512
    rate: float = 0.15
    keep: float = 0.6
    seed: int = 7


@dataclass(frozen=True)
class Model:
    u: np.ndarray  # buckets x 1: softmax margin of each bucket's embedding
    bias: float
    slope: float
    shift: float
    empty: float
    config: Config

    def worst(self, scores: np.ndarray) -> float:
        """Largest passage margin of one text, from its words' margins."""
        n, s = len(scores), self.config.span
        if n == 0:
            return self.empty
        if n <= s:
            return float(scores.mean()) * min(1.0, n / 2) + self.bias
        c = np.concatenate([[0.0], np.cumsum(scores)])
        return float((c[s:] - c[:-s]).max()) / s + self.bias

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -40, 40)))


#: Products whose sums do not depend on the number of threads, as those of BLAS do.
times = np.einsum


def fit(texts: list[str], labels: list[int], c: Config = Config()) -> Model:
    """Train on the given texts; deterministic for the same rows in the same order."""
    y = np.asarray(labels, int)
    if len(set(labels)) < 2:
        p = np.clip(0.5 * (y.mean() if len(y) else 0.0), 1e-3, 1 - 1e-3)
        return Model(np.zeros((c.buckets, 1), np.float32), 0.0, 0.0, float(np.log(p / (1 - p))), 0.0, c)
    rng = np.random.default_rng(c.seed)
    index: dict[str, int] = {}
    docs = []
    for t in texts:
        w = WORD.findall((t or "").lower())
        docs.append(np.fromiter((index.setdefault(x, len(index)) for x in w), np.int64, len(w)))
    where, first = word_lists(list(index), c.lo, c.hi, c.buckets)
    count = np.diff(first)
    # every fifth text only shapes the curve, unless there are too few
    held = np.zeros(len(y), bool)
    for k in (0, 1):
        at = np.flatnonzero(y == k)
        if len(at) >= 25:
            held[at[::5]] = True
    # passages: start word of each, per document
    step = max(1, c.span // 2)
    starts = [np.arange(0, max(1, len(d) - c.span + 1), step) if len(d) else np.empty(0, np.int64) for d in docs]
    emb = rng.normal(0, 0.1, (c.buckets, c.dim)).astype(np.float32)
    w = rng.normal(0, 0.1, (c.dim, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    ge, gw, gb = np.full(c.buckets, 1e-6, np.float32), np.full(w.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)

    def word_margins() -> np.ndarray:
        u = times("ij,j->i", emb, w[:, 1] - w[:, 0])
        return np.add.reduceat(u[where], first[:-1]) / count

    def passage_margins(d: np.ndarray, s: np.ndarray, m: np.ndarray) -> np.ndarray:
        cum = np.concatenate([[0.0], np.cumsum(m[d])])
        end = np.minimum(s + c.span, len(d))
        return (cum[end] - cum[s]) / (end - s)

    def step_on(batch: list[tuple[int, int]], target: np.ndarray, weight: np.ndarray) -> None:
        nonlocal w, b
        words = [docs[i][s : s + c.span] for i, s in batch]
        n = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.concatenate(words)
        grams = count[flat]
        at = np.repeat(first[flat] - np.concatenate([[0], np.cumsum(grams)[:-1]]), grams) + np.arange(grams.sum())
        bucket = where[at]
        seg = np.repeat(np.repeat(np.arange(len(batch)), n), grams)
        coef = np.repeat(1 / (grams * np.repeat(n, n)), grams).astype(np.float32)
        # left-out n-grams teach the others to do without them, as in words never seen
        coef *= (rng.random(len(coef)) < c.keep) / np.float32(c.keep)
        edges = np.searchsorted(seg, np.arange(len(batch)))
        x = np.add.reduceat(emb[bucket] * coef[:, None], edges, axis=0)
        z = times("ij,jk->ik", x, w) + b
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(batch)), target] -= 1
        p *= (weight / weight.sum())[:, None] * len(batch) ** 0.5
        dw, db, dx = times("ij,ik->jk", x, p), p.sum(axis=0), times("ij,kj->ik", p, w)
        gw[...] += dw**2
        gb[...] += db**2
        uniq, inv = np.unique(bucket, return_inverse=True)
        de = np.stack([np.bincount(inv, weights=coef * dx[seg, k]) for k in range(c.dim)], axis=1).astype(np.float32)
        ge[uniq] += (de**2).mean(axis=1)
        emb[uniq] -= c.rate * de / np.sqrt(ge[uniq])[:, None]
        w -= c.rate * dw / np.sqrt(gw)
        b -= c.rate * db / np.sqrt(gb)

    used = [i for i in np.flatnonzero(~held) if len(docs[i])]
    for turn in range(c.rounds):
        margins = word_margins() if turn else None
        pos, neg = [], []
        for i in used:
            s = starts[i]
            if y[i]:
                if margins is None:
                    take = rng.permutation(s)[:24]
                else:  # the worst passages: near the maximum, a few at most
                    m = passage_margins(docs[i], s, margins)
                    take = s[np.argsort(-m, kind="stable")[: 1 + (turn < 2) * 2]]
                pos += [(i, int(k)) for k in take]
            else:
                take = list(rng.permutation(s)[:16])
                if margins is not None:
                    m = passage_margins(docs[i], s, margins)
                    take += list(s[np.argsort(-m, kind="stable")[:4]])
                neg += [(i, int(k)) for k in take]
        rows = pos + neg
        if not pos or not neg:
            break
        target = np.array([1] * len(pos) + [0] * len(neg))
        weight = np.where(target == 1, len(rows) / (2 * len(pos)), len(rows) / (2 * len(neg))).astype(np.float32)
        for _ in range(c.epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(rows), c.batch):
                part = order[k : k + c.batch]
                step_on([rows[j] for j in part], target[part], weight[part])
    u = times("ij,j->i", emb, w[:, 1] - w[:, 0]).astype(np.float64)[:, None]
    model = Model(u, float(b[1] - b[0]), 1.0, 0.0, 0.0, c)
    m = np.add.reduceat(u[where, 0], first[:-1]) / count
    worst = np.array([model.worst(m[d]) if len(d) else np.nan for d in docs])
    empty = float(np.nanmin(worst))
    worst = np.where(np.isnan(worst), empty, worst)
    slope, shift = curve(worst[held], y[held]) if held.any() and len(set(y[held])) == 2 else curve(worst, y)
    return Model(u, model.bias, slope, shift, empty, c)


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve through one feature, classes weighted alike, slope bounded by a small penalty (Newton steps)."""
    mid, scale = float(np.median(x)), float(x.std()) or 1.0
    z = np.stack([(x - mid) / scale, np.ones_like(x)], axis=1)
    wt = np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
    t, pen = np.zeros(2), np.diag([0.02 * len(y) / 10, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(times("ij,j->i", z, t), -30, 30)))
        grad = times("ij,i->j", z, wt * (p - y)) + times("ij,j->i", pen, t)
        t = t - np.linalg.solve(times("ij,ik->jk", z * (wt * p * (1 - p))[:, None], z) + pen + 1e-9 * np.eye(2), grad)
    return float(t[0] / scale), float(t[1] - t[0] * mid / scale)


def labelled_rows(docs: DataFrame, labels: DataFrame, usable: Column, c: Config = Config(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Rows (doc_id, _y, text) of about ``sample_toxic`` and ``sample_clean`` labelled texts (all, if there are fewer), by a hash of their ids."""
    y = labels.select(F.col(doc_id), F.col(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & usable).distinct()
    have = {r["_y"]: r["count"] for r in y.groupBy("_y").count().collect()}
    most = {1: c.sample_toxic, 0: c.sample_clean}
    ticket = F.pmod(F.xxhash64(doc_id, F.lit("toxic")), F.lit(1 << 30)) / float(1 << 30)
    share = {k: min(1.0, n / max(1, have.get(k, 0))) for k, n in most.items()}
    # the shares make the sample; the limit bounds what is broadcast even for ids that hash alike
    chosen = y.where(ticket < F.when(F.col("_y") == 1, share[1]).otherwise(share[0])).limit(2 * sum(most.values()))
    chosen = F.broadcast(chosen)
    rows = docs.where(F.col(text).isNotNull()).select(doc_id, text).join(chosen, doc_id)
    return bounded_rows(rows, "_y", text, doc_id, ticket, 2 * max(most.values()), c.sample_bytes)


def texts_and_labels(part: pd.DataFrame) -> tuple[list[str], list[int]]:
    doc_id, label, text = part.columns
    part = in_order(part, label, text, doc_id)
    return part[text].tolist(), part[label].tolist()


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, c: Config = Config(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[list[str], list[int]]:
    """``labelled_rows`` as lists on the driver."""
    return texts_and_labels(labelled_rows(docs, labels, usable, c, doc_id, text, label).toPandas())


def fit_rows(sample: DataFrame, c: Config = Config()) -> Model:
    """``fit`` on the rows of ``labelled_rows``, in one task: only the model comes to the driver, which else keeps what the training took."""
    small_batches(session(sample))

    def run(batches):
        batches = list(batches)
        m = fit(*(texts_and_labels(pa.Table.from_batches(batches).to_pandas()) if batches else ([], [])), c)
        yield pa.RecordBatch.from_arrays([pa.array([m.u.tobytes()], pa.binary()), pa.array([str(m.u.dtype)]), *(pa.array([float(x)]) for x in (m.bias, m.slope, m.shift, m.empty))], ["u", "kind", "bias", "slope", "shift", "empty"])

    found = sample.coalesce(1).mapInArrow(run, "u binary, kind string, bias double, slope double, shift double, empty double").collect()
    if not found:  # an empty sample may have no partition
        return fit([], [], c)
    ((u, kind, *rest),) = found
    return Model(np.frombuffer(u, kind).reshape(-1, 1), *rest, c)


def scorer(shared):
    """Texts of a batch to scores, on a worker."""
    m = shared.value
    vocab = Vocabulary(m.u, m.config.lo, m.config.hi)

    def run(texts: list[str | None]) -> np.ndarray:
        worst = []
        for part in groups(texts, lambda t: len(t or ""), 2_000_000):
            words = [WORD.findall((t or "").lower()) for t in part]
            worst += [m.worst(r[:, 0]) for r in vocab.rows(words)]
        return m.probability(np.array(worst, float))

    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of each row, whole texts."""
    spark = session(docs)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        judge = scorer(shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(judge(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """Rows of ``docs``, in all their columns, whose score is below ``threshold``."""
    spark = session(docs)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        judge = scorer(shared)
        for b in batches:
            yield b.filter(pa.array(judge(b.column(text).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
