"""Main text of web pages, by a recurrent labeller of blocks.

A page is a sequence of leaf blocks. Each block is a vector of the hashed names on its
tag path (elements, classes, ids, roles), its hashed words and a few figures; a bidirectional LSTM in numpy
reads the sequence, so every block is labelled with the whole page in view, and the blocks labelled as
article are the text.

Pages carry no labels, so the LSTM is trained on pages composed by rule (``html_layouts``) from sentences of
``sample_pages`` pages at most, the first by a hash of their id, of ``sample_bytes`` bytes each at most and
``sample_bytes`` * 100 in all (longer pages give no sentences). Every page is read whole.

Null and empty pages, and pages without an article, have text '' and 0 characters. Repeated rows repeat; a null id or url is
kept. Markup that is cut off ends a page, as in a browser. Without pages, or without text in them, training takes stock sentences.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html_layouts
from ..functions.batches import small_batches
from .common import Memo, session
from .html_blocks import LEAF, PATH, Block, Places, blocks, bucket

WORDS, FIGURES = 128, 16
INPUTS = PATH + LEAF + WORDS + FIGURES
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")


@dataclass(frozen=True)
class Config:
    hidden: int = 24
    composed: int = 900
    epochs: int = 7
    batch: int = 24
    rate: float = 0.01
    leave_out: float = 0.15  # of the names and words while training
    wordless: float = 0.3  # share of the pages that are trained on without their words
    threshold: float = 0.5
    sample_pages: int = 300
    sample_bytes: int = 1 << 17
    seed: int = 5


def word_buckets() -> Memo:
    return Memo(lambda w: bucket(w, WORDS))


def content_vectors(found: list[Block], title: str, memo: Memo) -> np.ndarray:
    """Hashed words and figures of each block."""
    out = np.zeros((len(found), WORDS + FIGURES), np.float32)
    n_all, title = len(found), title.lower()
    for k, b in enumerate(found):
        t, low = b.text, b.text.lower()
        ws = WORD.findall(low)
        n, m = len(ws), len(t)
        if n:
            counts = np.bincount(np.fromiter(map(memo.__getitem__, ws), np.int64, n), minlength=WORDS)
            out[k, :WORDS] = counts / np.sqrt((counts**2).sum())
        ends = t.count(".") + t.count("!") + t.count("?")
        out[k, WORDS:] = (
            np.log1p(m) / 8, np.log1p(n) / 6, min(1.0, b.linked / m), t[-1] in ".!?\"”»", ends / (n + 1), t.count(",") / (n + 1), "©" in t,
            "|" in t or "·" in t, sum(map(t.count, "0123456789")) / m, m / (n + 1) / 10, k / n_all, (k + 1) == n_all, np.log1p(n_all) / 6,
            len(low) > 5 and low in title, n <= 3, t[0].isupper(),
        )
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences sorted by length, longest first: row of (time, sequence) read forwards and backwards, and how many run at each time."""
    order = np.argsort(-sizes, kind="stable")
    start, longest = np.concatenate([[0], np.cumsum(sizes)])[order], int(sizes.max())
    time = np.arange(longest)[:, None]
    ahead = start[None] + time
    back = start[None] + sizes[order][None] - 1 - time
    return ahead, back, (sizes[None] > time).sum(axis=1)


class Direction:
    """One LSTM over sequences that end one after the other."""

    def __init__(self, u: np.ndarray):
        self.u, self.h = u, u.shape[0]

    def run(self, z: np.ndarray, rows: np.ndarray, running: np.ndarray, keep: bool = False) -> np.ndarray:
        """Outputs by row; ``z`` holds the inputs' part of the gates."""
        n, d = rows.shape[1], self.h
        h, c = np.zeros((n, d), np.float32), np.zeros((n, d), np.float32)
        out, self.kept = np.zeros((len(z), d), np.float32), []
        for t, k in enumerate(running):
            g = z[rows[t, :k]] + h[:k] @ self.u
            gates, new = sigmoid(g[:, : 3 * d]), np.tanh(g[:, 3 * d :])
            before, last = c[:k].copy() if keep else None, h[:k].copy() if keep else None
            c[:k] = gates[:, d : 2 * d] * c[:k] + gates[:, :d] * new
            squashed = np.tanh(c[:k])
            h[:k] = gates[:, 2 * d :] * squashed
            out[rows[t, :k]] = h[:k]
            if keep:
                self.kept.append((gates, new, before, last, squashed))
        return out

    def back(self, dout: np.ndarray, rows: np.ndarray, running: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the inputs' part and of the recurrent weights."""
        n, d = rows.shape[1], self.h
        dh, dc = np.zeros((n, d), np.float32), np.zeros((n, d), np.float32)
        dz, du = np.zeros((len(dout), 4 * d), np.float32), np.zeros_like(self.u)
        for t in range(len(running) - 1, -1, -1):
            k = running[t]
            gates, new, before, last, squashed = self.kept[t]
            i, f, o = gates[:, :d], gates[:, d : 2 * d], gates[:, 2 * d :]
            dh[:k] += dout[rows[t, :k]]
            dc[:k] += dh[:k] * o * (1 - squashed**2)
            g = np.concatenate([dc[:k] * new * i * (1 - i), dc[:k] * before * f * (1 - f), dh[:k] * squashed * o * (1 - o), dc[:k] * i * (1 - new**2)], axis=1)
            dz[rows[t, :k]] = g
            du += last.T @ g
            dh[:k] = g @ self.u.T
            dc[:k] *= f
        return dz, du


@dataclass
class Labeller:
    """Weights: inputs to the gates of both directions and (last column) to the label, recurrences, and both outputs to the label."""

    weights: dict[str, np.ndarray]
    threshold: float = 0.5

    def label(self, path: np.ndarray, content: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probability that each block is article, for pages of the given numbers of blocks; ``path`` has the tag paths' part of the gates."""
        w = self.weights
        z = path + content @ w["x"][PATH + LEAF :] + w["bias"]
        ahead, back, running = layout(sizes)
        d = w["forth"].shape[0]
        h = np.concatenate([Direction(w["forth"]).run(z[:, : 4 * d], ahead, running), Direction(w["back"]).run(z[:, 4 * d : 8 * d], back, running)], axis=1)
        return sigmoid((h @ w["out"])[:, 0] + z[:, -1])


def train(pages: list[str], c: Config = Config()) -> Labeller:
    """Fit on composed pages; deterministic for the same pages."""
    rng, places, memo = np.random.default_rng(c.seed), Places(1 << 30), word_buckets()
    xs, ys = [], []
    for page in pages:
        found, title = blocks(page, places, html_layouts.MARKS)
        if found:
            xs.append(np.concatenate([np.stack([b.place.vector for b in found]), content_vectors(found, title, memo)], axis=1))
            ys.append(np.array([b.first for b in found], np.float32))
    d = c.hidden
    w = {
        "x": rng.normal(0, 0.08, (INPUTS, 8 * d + 1)), "bias": np.zeros(8 * d + 1), "forth": rng.normal(0, 0.15, (d, 4 * d)), "back": rng.normal(0, 0.15, (d, 4 * d)),
        "out": rng.normal(0, 0.2, (2 * d, 1)),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    w["bias"][d : 2 * d] = w["bias"][5 * d : 6 * d] = 1  # remember, to begin with
    mean, square, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    total = c.epochs * -(-len(xs) // c.batch)
    for _ in range(c.epochs):
        order = rng.permutation(len(xs))
        for k in range(0, len(xs), c.batch):
            at = order[k : k + c.batch]
            x, y, sizes = np.concatenate([xs[i] for i in at]), np.concatenate([ys[i] for i in at]), np.array([len(xs[i]) for i in at])
            # names and words that a page does not have teach the others to do without them
            x[:, : PATH + LEAF + WORDS] *= rng.random((len(x), PATH + LEAF + WORDS), np.float32) >= c.leave_out
            # nor do some pages have words that say anything
            x[:, PATH + LEAF : PATH + LEAF + WORDS] *= np.repeat(rng.random(len(sizes)) >= c.wordless, sizes)[:, None]
            ahead, back, running = layout(sizes)
            z = x @ w["x"] + w["bias"]
            forth_, back_ = Direction(w["forth"]), Direction(w["back"])
            h = np.concatenate([forth_.run(z[:, : 4 * d], ahead, running, True), back_.run(z[:, 4 * d : 8 * d], back, running, True)], axis=1)
            dy = (sigmoid((h @ w["out"])[:, 0] + z[:, -1]) - y)[:, None] / len(y)
            dh = dy @ w["out"].T
            dz_f, du_f = forth_.back(dh[:, :d], ahead, running)
            dz_b, du_b = back_.back(dh[:, d:], back, running)
            dz = np.concatenate([dz_f, dz_b, dy.astype(np.float32)], axis=1)
            grad = {"x": x.T @ dz, "bias": dz.sum(axis=0), "forth": du_f, "back": du_b, "out": h.T @ dy}
            norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            step += 1
            rate = c.rate * (1 - 0.9 * step / total)
            for name, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                mean[name] += 0.1 * (g - mean[name])
                square[name] += 0.001 * (g**2 - square[name])
                w[name] -= rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8)
    return Labeller(w, c.threshold)


def sample_sentences(pages: DataFrame, c: Config = Config(), page_id: str = "page_id", html: str = "html") -> list[str]:
    """Sentences of a bounded sample of pages, in the order of their ids' hashes."""
    size = F.octet_length(html)
    ticket = F.xxhash64(F.col(page_id).cast("string"), F.lit("pages"))
    rows = pages.where((size > 0) & (size <= c.sample_bytes)).select(F.col(html).alias("_html"), ticket.alias("_ticket"))
    # many more pages than are taken are left out before the sort
    n = rows.count()
    if n > 4 * c.sample_pages:
        rows = rows.where(F.pmod("_ticket", F.lit(1 << 20)) < int((1 << 20) * 3 * c.sample_pages / n) + 1)
    places, out, room = Places(), [], c.sample_bytes * 100
    for r in rows.orderBy("_ticket", F.xxhash64("_html")).limit(c.sample_pages).collect():
        room -= len(r["_html"])
        if room < 0:
            break
        out += [s for b in blocks(r["_html"], places)[0] for s in SENTENCE.split(b.text)]
        places.trim()
    return sorted(set(out))


def fit(sentences: list[str], c: Config = Config()) -> Labeller:
    composer = html_layouts.Composer(sentences, c.seed)
    return train([composer.page() for _ in range(c.composed)], c)


class Reader:
    """Main text of pages, on a worker."""

    def __init__(self, model: Labeller, most_blocks: int = 4000):
        self.model, self.most, self.places, self.memo = model, most_blocks, Places(), word_buckets()
        self.gates: dict[int, tuple] = {}

    def path_gates(self, found: list[Block]) -> np.ndarray:
        """The tag paths' part of the gates, once for each place."""
        x = self.model.weights["x"][: PATH + LEAF]
        new = {id(b.place): b.place for b in found if id(b.place) not in self.gates}
        if new:
            # the place itself is kept too, so its id stays its own
            for p, z in zip(new.values(), np.stack([p.vector for p in new.values()]) @ x, strict=True):
                self.gates[id(p)] = (p, z)
        return np.stack([self.gates[id(b.place)][1] for b in found])

    def probabilities(self, pages: list[str]) -> list[tuple[list[Block], np.ndarray]]:
        """Blocks and their probabilities; pages of similar length are read together, about ``most_blocks`` blocks at a time."""
        parsed = []
        for page in pages:
            found, title = blocks(page, self.places)
            if found:
                parsed.append((found, self.path_gates(found), content_vectors(found, title, self.memo)))
            else:
                parsed.append(([], None, None))
            self.memo.trim()
            if len(self.places.known) > self.places.limit:
                self.places.clear()
                self.gates.clear()
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if parsed[k][0]), key=lambda k: len(parsed[k][0]))
        while order:
            take, n = [], 0
            while order and (not take or n + len(parsed[order[-1]][0]) <= self.most):
                take.append(order.pop())
                n += len(parsed[take[-1]][0])
            sizes = np.array([len(parsed[k][0]) for k in take])
            p = self.model.label(np.concatenate([parsed[k][1] for k in take]), np.concatenate([parsed[k][2] for k in take]), sizes)
            for k, part in zip(take, np.split(p, np.cumsum(sizes)[:-1]), strict=True):
                out[k] = part
        return [(parsed[k][0], out[k]) for k in range(len(pages))]

    def texts(self, pages: list[str | None]) -> list[str]:
        found = self.probabilities([p or "" for p in pages])
        return ["\n\n".join(b.text for b, p in zip(bs, ps, strict=True) if p >= self.model.threshold) for bs, ps in found]


def extract(pages: DataFrame, model: Labeller, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row: the article's blocks in page order, joined by blank lines."""
    spark = session(pages)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        reader = Reader(shared.value)
        for b in batches:
            texts = reader.texts(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(page_id).cast("long").alias("_id"), F.col(url).cast("string").alias("_url"), F.col(html).alias("_html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
