"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character n-grams (1 to 3 code points of the lower-cased
text): relative frequency in the text times inverse document frequency. The
document frequencies count all training documents. The weights are fitted on a
bounded sample (at most ``per_language`` training documents of each language,
by hash) with follow-the-regularised-leader (proximal, one learning rate per
coordinate) and elastic-net penalties; a part of the sample is kept apart to
calibrate the softmax by one temperature. Prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillage.llm.arrays import summed
from tillage.llm.tables import packed, released, shared_value
from tillage.llm.words import mix, slices, text_array

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
PER_LANGUAGE = 500
UNKNOWN = "und"
SLICE = 1 << 20
GATHER = 1 << 19


def _code_points(column) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lower-cased texts one after the other, and the offsets of the texts."""
    texts = pc.utf8_lower(text_array(column))
    off = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32), off


def _ngrams(points: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: buckets at every position, and each text's first and last position (exclusive)."""
    x = points.astype(np.uint64)
    for order in ORDERS:
        if len(x) < order:
            continue
        h = x[:len(x) - order + 1] + np.uint64(order << 32)
        for i in range(1, order):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[i:len(x) - order + 1 + i]
        yield (mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64), off[:-1], np.maximum(off[1:] - order + 1, off[:-1])


def _text_counts(column) -> Iterator[np.ndarray]:
    """Each text's n-gram counts by bucket."""
    points, off = _code_points(column)
    grams = list(_ngrams(points, off))
    for i in range(len(off) - 1):
        count = np.zeros(BUCKETS)
        for h, a, z in grams:
            if z[i] > a[i]:
                count += np.bincount(h[a[i]:z[i]], minlength=BUCKETS)
        yield count


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    df = np.zeros(BUCKETS + 1)
    for b in slices(batches, "text", SLICE):
        for count in _text_counts(b.column("text")):
            df[:BUCKETS] += count > 0
            df[BUCKETS] += 1
    return df


def _sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", SLICE):
        idx, val = [], []
        for count in _text_counts(b.column("text")):
            at = np.flatnonzero(count)
            idx.append(at.astype(np.uint32).tobytes())
            val.append((count[at] / max(count.sum(), 1)).astype(np.float32).tobytes())
        yield pa.record_batch([b.column("lang"), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], names=["lang", "idx", "val"])


@dataclass
class Model:
    """Learned languages (sorted), weights already times idf, biases, temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, size: int, epochs: int = 4, batch: int = 16,
             alpha: float = 1.0, beta: float = 1e-3, l1: float = 1e-6, l2: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (size x classes) and biases of a multinomial logistic regression, FTRL-proximal."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        w = -(np.sign(zz) * np.maximum(np.abs(zz) - l1, 0)) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return w

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
            at, col = np.unique(np.concatenate([*(rows[i][0] for i in part), [size]]), return_inverse=True)
            x = np.zeros((len(part), len(at)))
            p = 0
            for r, i in enumerate(part):
                k = len(rows[i][0])
                x[r, col[p:p + k]] = rows[i][1]
                p += k
            x[:, -1] = 1  # the bias is the last coordinate
            w = weights(at)
            g = _softmax(x @ w)
            g[np.arange(len(part)), y[part]] -= 1
            g = x.T @ g / len(part)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return w[:size], w[size]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by a grid in the logarithm."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _place() -> Column:
    """A text's place in its language, 0 to 1, by hash."""
    return (F.xxhash64("text", "lang") / F.lit(2.0 ** 64)) + 0.5


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on rows with a non-null language. Texts without n-grams teach nothing."""
    rows = labelled.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")
                           ).where("lang is not null and text is not null and text <> ''")
    counts = {r.lang: (r.texts, r.first) for r in rows.groupBy("lang").agg(F.approx_count_distinct("text").alias("texts"), F.min(_place()).alias("first")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    df = summed(rows.select("text"), _document_frequency, BUCKETS + 1)
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1
    # A share of each language by hash: about per_language distinct texts of it, whatever the table's size, and at least its first one.
    share = rows.sparkSession.createDataFrame([(k, max(min(1.0, per_language / max(n, 1)), first)) for k, (n, first) in counts.items()],
                                              "lang string, share double")
    sample = rows.join(F.broadcast(share), "lang").where(_place() <= F.col("share")).select("lang", "text").distinct()  # copies have one place
    data = sorted((r.lang, bytes(r.idx), bytes(r.val)) for r in sample.mapInArrow(_sparse_rows, "lang string, idx binary, val binary").collect())
    if not data:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    languages = sorted({d[0] for d in data})
    y = np.array([languages.index(d[0]) for d in data])
    x = []
    for _, i, v in data:
        at = np.frombuffer(i, np.uint32).astype(np.int64)
        x.append((at, np.frombuffer(v, np.float32) * idf[at]))
    apart = np.arange(len(x)) % 10 == 3
    fit = np.flatnonzero(~apart)
    w, b = fit_ftrl([x[i] for i in fit], y[fit], len(languages), BUCKETS)
    held = np.flatnonzero(apart)
    logits = np.array([x[i][1] @ w[x[i][0]] + b for i in held]) if len(held) else np.zeros((0, len(languages)))
    t = _temperature(logits, y[held])
    return Model(languages, (w * idf[:, None]).astype(np.float32), b, t)


def _sums(weights: np.ndarray, h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The sum of ``weights[h[a:z]]`` for every (ascending, disjoint) run, in pieces of about ``GATHER`` numbers."""
    out, step = np.zeros((len(start), weights.shape[1])), max(1, GATHER // weights.shape[1])
    for lo in range(int(start[0]), int(stop[-1]), step):
        hi = min(lo + step, int(stop[-1]))
        runs = np.flatnonzero((start < hi) & (stop > lo))
        if len(runs):
            edges = np.stack([np.maximum(start[runs], lo), np.minimum(stop[runs], hi)], axis=1).reshape(-1) - lo
            add = np.zeros((hi - lo + 1, weights.shape[1]), np.float32)
            np.take(weights, h[lo:hi], axis=0, out=add[:-1])
            out[runs] += np.add.reduceat(add, edges, axis=0)[::2]
    return out


def _predict_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, weights, bias, temperature = shared.value
        for b in slices(batches, "text", SLICE):
            rows = b.num_rows
            lang, score = np.full(rows, UNKNOWN, object), np.zeros(rows)
            letters = pc.match_substring_regex(text_array(b.column("text")), r"\p{L}").to_numpy(zero_copy_only=False)
            if languages:
                points, off = _code_points(b.column("text"))
                z, total = np.zeros((rows, len(languages))), np.zeros(rows)
                for h, a, e in _ngrams(points, off):
                    some = np.flatnonzero(e > a)
                    if len(some):
                        z[some] += _sums(weights, h, a[some], e[some])
                        total[some] += e[some] - a[some]
                p = _softmax((z / np.maximum(total, 1)[:, None] + bias) / temperature)
                best = p.argmax(axis=1)
                lang[letters] = np.array(languages, object)[best[letters]]
                score[letters] = p[np.arange(rows), best][letters]
            yield pa.record_batch([b.column("text"), b.column("row"), pa.array(lang, pa.string()), pa.array(score)],
                                  names=["text", "row", "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score`` (the calibrated probability of ``lang_pred``).

    ``lang_pred`` is ``und`` with score 0 for null texts, texts without a
    letter, and where nothing was learned. Input columns of these names are
    replaced. Repeated rows are predicted alike; an empty table gives none.
    """
    text, row, back = packed(docs, text_col, ("lang_pred", "score"))
    shared = shared_value(docs.sparkSession, (model.languages, model.weights, model.bias, model.temperature))
    texts = docs.select(text, row)
    schema = T.StructType([*texts.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return texts.mapInArrow(released(_predict_rows(shared)), schema).select(*back, "lang_pred", "score")
