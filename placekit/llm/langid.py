"""Language identification by a small convolutional network over bytes.

Bytes are embedded, filters of several widths run over them, each filter's largest answer inside a window of fixed
length is kept, and a softmax layer reads those. Training is plain numpy on a bounded sample of labelled rows;
prediction runs in Arrow batches over every window of every whole text, and a text's class has the largest mean
log probability over its windows, weighted by their letters' bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placekit.llm.common import keep_rows, slices

UNKNOWN = "und"
WIDTHS = (2, 3, 4)


@dataclass(frozen=True)
class Settings:
    """``rows_per_language`` bounds the training sample, with at most ``windows_per_row`` windows of each text."""

    window: int = 256
    depth: int = 8
    filters: int = 8
    rows_per_language: int = 400
    windows_per_row: int = 4
    epochs: int = 8
    batch: int = 64
    rate: float = 0.01
    seed: int = 7


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def windows_of(raw: bytes, window: int) -> np.ndarray:
    """A whole text as rows of ``window`` bytes, the last one filled with zeros."""
    n = -(-len(raw) // window)
    return np.frombuffer(raw.ljust(n * window, b"\0"), np.uint8).reshape(n, window)


class Network:
    """Embedding, filters of widths 2 to 4, largest answer over a window, softmax."""

    def __init__(self, classes: list[str], settings: Settings):
        rng = np.random.default_rng(settings.seed)
        self.classes, self.settings = classes, settings
        f = settings.filters
        self.embed = rng.normal(0, 0.5, (256, settings.depth)).astype(np.float32)
        self.embed[0] = 0
        self.filters = [rng.normal(0, (2 / (w * settings.depth)) ** 0.5, (w * settings.depth, f)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(f, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (f * len(WIDTHS), len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def step(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross entropy, in the order of params()."""
        n, d = len(x), self.settings.depth
        x = self.padded(x)
        e = self.embed[x]
        pooled, where, views = [], [], []
        for w, k, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            view = np.lib.stride_tricks.sliding_window_view(e, w, axis=1)[:, :self.settings.window].transpose(0, 1, 3, 2).reshape(n, -1, w * d)
            answer = view @ k + b
            at = answer.argmax(axis=1)
            pooled.append(np.maximum(np.take_along_axis(answer, at[:, None], 1)[:, 0], 0))
            where.append(at)
            views.append(view)
        h = np.concatenate(pooled, axis=1)
        logits = h @ self.out + self.out_bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        g_out, g_out_bias, g_h = h.T @ p, p.sum(axis=0), (p @ self.out.T) * (h > 0)
        g_embed, g_filters, g_bias = np.zeros_like(self.embed), [], []
        f = self.settings.filters
        rows = np.arange(n)
        for i, w in enumerate(WIDTHS):
            g = g_h[:, i * f:(i + 1) * f]
            g_k = np.zeros_like(self.filters[i])
            for j in range(f):
                at = where[i][:, j]
                g_k[:, j] = g[:, j] @ views[i][rows, at]
                back = (g[:, j, None] * self.filters[i][:, j]).reshape(n, w, d)
                for o in range(w):
                    np.add.at(g_embed, x[rows, at + o], back[:, o])
            g_filters.append(g_k)
            g_bias.append(g.sum(axis=0))
        g_embed[0] = 0
        return [g_embed, *g_filters, *g_bias, g_out, g_out_bias]

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        """Adam over shuffled batches."""
        s, rng = self.settings, np.random.default_rng(self.settings.seed)
        m = [np.zeros_like(p) for p in self.params()]
        v = [np.zeros_like(p) for p in self.params()]
        t = 0
        for _ in range(s.epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), s.batch):
                t += 1
                pick = order[i:i + s.batch]
                for p, g, a, b in zip(self.params(), self.step(x[pick], y[pick]), m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= (s.rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def log_probs(self, x: np.ndarray, block: int = 64) -> np.ndarray:
        """Log probabilities of each window; windows are taken ``block`` at a time to stay in the cache."""
        d, widest, size = self.settings.depth, max(WIDTHS), x.shape[1]
        # all filters as one matrix over the widest reach; narrower ones have zeros behind
        k = np.concatenate([np.pad(f, ((0, (widest - w) * d), (0, 0))) for w, f in zip(WIDTHS, self.filters, strict=True)], axis=1)
        bias = np.concatenate(self.bias)
        h = np.empty((len(x), len(bias)), np.float32)
        for i in range(0, len(x), block):
            e = np.take(self.embed, self.padded(x[i:i + block]), axis=0).reshape(len(x[i:i + block]), -1)
            view = np.lib.stride_tricks.as_strided(e, (len(e), size, widest * d), (e.strides[0], d * e.itemsize, e.itemsize), writeable=False)
            h[i:i + block] = (view @ k).max(axis=1)
        logits = np.maximum(h + bias, 0) @ self.out + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    @staticmethod
    def padded(x: np.ndarray) -> np.ndarray:
        """Zeros behind each window, so that every filter has a place at every byte."""
        return np.pad(x, ((0, 0), (0, max(WIDTHS) - 1)))

    def predict(self, texts: list[str | None], chunk: int = 8192) -> tuple[list[str], list[float]]:
        """Class and score of each whole text; windows of many texts are scored ``chunk`` at a time."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        which = [i for i, t in enumerate(texts) if has_letter(t)] if self.classes else []
        total, weight = np.zeros((len(texts), len(self.classes))), np.full(len(texts), 1e-9)
        held, owner, waiting = [], [], 0

        def flush() -> None:
            x, of = np.concatenate(held), np.repeat([o for o, _ in owner], [n for _, n in owner])
            w = (x > 64).sum(axis=1) + 1e-3
            np.add.at(total, of, self.log_probs(x) * w[:, None])
            np.add.at(weight, of, w)

        for i in which:
            x = windows_of(texts[i].encode("utf-8", "surrogatepass"), self.settings.window)
            for at in range(0, len(x), chunk):
                held.append(x[at:at + chunk])
                owner.append((i, len(held[-1])))
                waiting += len(held[-1])
                if waiting >= chunk:
                    flush()
                    held, owner, waiting = [], [], 0
        if waiting:
            flush()
        for i in which:
            p = total[i] / weight[i]
            p = np.exp(p - p.max())
            best = int(p.argmax())
            langs[i], scores[i] = self.classes[best], float(p[best] / p.sum())
        return langs, scores


def sample(docs: DataFrame, settings: Settings) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labelled windows to learn from: about ``rows_per_language`` rows of each language."""
    rows = docs.select(F.col("doc_id"), F.col("text"), F.col("lang")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], np.zeros((0, settings.window), np.uint8), np.zeros(0, np.int64)
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, settings.rows_per_language / n))])
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(settings.seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    size, most = settings.window, settings.windows_per_row

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if has_letter(text):
                    x = windows_of(text.encode("utf-8", "surrogatepass"), size)
                    for k in np.unique(np.linspace(0, len(x) - 1, most).astype(int)):
                        found.append(x[k].tobytes())
                        langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "window"])

    # rows_per_language * windows_per_row windows for each language, whatever the table's size
    got = rows.where(chance < share[F.col("lang")]).select("text", "lang").mapInArrow(take, "lang string, window binary").collect()
    got = sorted((r["lang"], bytes(r["window"])) for r in got)
    classes = sorted({k for k, _ in got})
    y = np.array([classes.index(k) for k, _ in got], np.int64)
    x = np.frombuffer(b"".join(w for _, w in got), np.uint8).reshape(-1, size)
    return classes, x, y


def train(docs: DataFrame, settings: Settings = Settings()) -> Network:
    classes, x, y = sample(docs, settings)
    net = Network(classes, settings)
    return net.fit(x, y) if len(classes) > 1 else net


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each document, from its whole text alone.

    A null, empty or letterless text is ``und`` with score 0; so is every text when nothing could be learned.
    One learned language is predicted with score 1. Rows that repeat each give a row; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            langs, scores = model.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, net: Network, min_score: float = 0.4) -> DataFrame:
    """The documents, all columns, whose text has a language the network knows with at least ``min_score``."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def known(texts: list[str | None]) -> list[bool]:
        return [k != UNKNOWN and s >= min_score for k, s in zip(*model.value.predict(texts), strict=True)]

    return keep_rows(docs, "text", known)


def crc_mod4(doc_id) -> int:
    """What ``held_out`` computes, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 4
