"""Quality classifier: a generalised additive model with pairwise interactions.

Every text is described by numbers of its words, characters and lines. Each
number is cut into bins by quantiles of a bounded labelled sample, and boosting
goes round the features in turn: each step fits a shallow tree (three cuts) on
one feature's bins to the logistic loss and adds it to the feature's lookup
table. Then the pairs of features whose crossed bins explain most of what is
left are boosted in the same way with one cut on each side. A score is the sum
of the looked-up bins, so all texts are scored by vectorised table additions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillage.llm.words import slices, split_words, text_array, text_of_word

MAX_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 60
RATE = 0.2
FEATURES = (
    "words", "word_length", "longest_word", "distinct_words", "top_word", "repeated_next_word", "upper", "digits", "sentence_marks",
    "other_marks", "doubled_marks", "non_ascii", "lines", "marked_word_ends", "line_repeats")


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[ord("A"):ord("Z") + 1] = 1
    out[ord("0"):ord("9") + 1] = 2
    out[[ord(c) for c in ".,;:"]] = 3
    out[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:"]] = 4
    out[128:] = 5
    out[10] = 6
    return out


def features(column) -> np.ndarray:
    """Numbers of each text (rows x FEATURES); empty texts have zeros."""
    texts = text_array(column)
    rows = len(texts)
    raw = [t.encode() for t in texts.to_pylist()]
    data = np.frombuffer(b"".join(raw), np.uint8)
    size = np.array([len(t) for t in raw], np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    kind = _classes()[data]

    def counted(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(flags)])
        return (upto[edges[1:]] - upto[edges[:-1]]).astype(float)

    by_kind = [counted(kind == k, off) for k in range(7)]
    again = np.zeros(len(data), bool)
    again[1:] = (data[1:] == data[:-1]) & (kind[1:] == 4)
    doubled = counted(again, off)

    woff, ids, words = split_words(texts)
    n = np.diff(woff).astype(float)
    doc = text_of_word(woff)
    length = np.array([len(w) for w in words.to_pylist()], np.int64) if len(words) else np.zeros(0, np.int64)
    letters = np.zeros(rows)
    longest, distinct, most, same, ends = (np.zeros(rows) for _ in range(5))
    if len(ids):
        letters = np.bincount(doc, length[ids], rows)
        np.maximum.at(longest, doc, length[ids])
        pairs, times = np.unique(doc * len(words) + ids, return_counts=True)
        distinct = np.bincount(pairs // len(words), minlength=rows).astype(float)
        np.maximum.at(most, pairs // len(words), times)
        same = np.bincount(doc[1:], (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1]), rows)
        last = np.array([4 if w and not w[-1].isalnum() and w[-1] not in ".,;:" else 0 for w in words.to_pylist()])
        ends = np.bincount(doc, last[ids] == 4, rows)
    lines = np.array([t.count(b"\n") + 1 for t in raw], float)
    repeats = np.array([1 - len(set(p)) / len(p) if len(p := t.split(b"\n")) > 1 else 0.0 for t in raw])
    w, c = np.maximum(n, 1), np.maximum(size, 1)
    return np.stack([np.log1p(n), letters / w, np.log1p(longest), distinct / w, most / w, same / w, by_kind[1] / c, by_kind[2] / c,
                     by_kind[3] / w, by_kind[4] / w, doubled / w, by_kind[5] / c, lines / w, ends / w, repeats], axis=1)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        x = features(b.column("text"))
        yield pa.record_batch([b.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])


def _best_cuts(g: np.ndarray, h: np.ndarray, leaves: int, least: float = 1.0) -> np.ndarray:
    """A shallow tree on ordered bins: the step for each bin, by greedy cuts of largest gain."""
    edges = [0, len(g)]
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def worth(a, z):
        return (G[z] - G[a]) ** 2 / (H[z] - H[a] + least)

    while len(edges) < leaves + 1:
        best = (1e-9, None)
        for a, z in zip(edges[:-1], edges[1:]):
            mid = np.arange(a + 1, z)
            if len(mid):
                gain = worth(a, mid) + worth(mid, z) - worth(a, z)
                i = int(np.argmax(gain))
                best = max(best, (float(gain[i]), int(mid[i])), key=lambda t: t[0])
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for a, z in zip(edges[:-1], edges[1:]):
        out[a:z] = -(G[z] - G[a]) / (H[z] - H[a] + least)
    return out


def _best_cross(g: np.ndarray, h: np.ndarray, least: float = 1.0) -> tuple[np.ndarray, float]:
    """One cut on each side of a table of crossed bins: the step for each cell, and the gain."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    n, m = g.shape
    best, cut = 0.0, None
    for i in range(n - 1):
        for j in range(m - 1):
            quarter = [(G[i, j], H[i, j]), (G[i, -1] - G[i, j], H[i, -1] - H[i, j]), (G[-1, j] - G[i, j], H[-1, j] - H[i, j]),
                       (G[-1, -1] - G[i, -1] - G[-1, j] + G[i, j], H[-1, -1] - H[i, -1] - H[-1, j] + H[i, j])]
            gain = sum(a * a / (b + least) for a, b in quarter)
            if gain > best:
                best, cut = gain, (i, j, quarter)
    out = np.zeros_like(g)
    if cut:
        i, j, q = cut
        for part, (a, b) in zip((np.s_[:i + 1, :j + 1], np.s_[:i + 1, j + 1:], np.s_[i + 1:, :j + 1], np.s_[i + 1:, j + 1:]), q):
            out[part] = -a / (b + least)
    return out, best


def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)], axis=1) if len(cuts) else np.zeros((len(x), 0), int)


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Bins, lookup tables, pair tables and the constant, as arrays."""
    if not len(y):
        return {"cuts": [], "coarse": [], "tables": [], "pairs": [], "start": 0.0}
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    coarse = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for f in range(x.shape[1])]
    at, rough = _bins(x, cuts), _bins(x, coarse)
    p = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(p / (1 - p)))
    z = np.full(len(y), start)
    tables = [np.zeros(len(c) + 1) for c in cuts]

    def slope():
        q = 1 / (1 + np.exp(-z))
        return q - y, q * (1 - q)

    for _ in range(ROUNDS):
        for f, table in enumerate(tables):
            g, h = slope()
            step = RATE * _best_cuts(np.bincount(at[:, f], g, len(table)), np.bincount(at[:, f], h, len(table)), 4)
            table += step
            z += step[at[:, f]]
    g, h = slope()

    def crossed(a: int, b: int, v: np.ndarray) -> np.ndarray:
        m = len(coarse[b]) + 1
        return np.bincount(rough[:, a] * m + rough[:, b], v, (len(coarse[a]) + 1) * m).reshape(-1, m)

    both = [(a, b) for a in range(x.shape[1]) for b in range(a)]
    gains = {(a, b): _best_cross(crossed(a, b, g), crossed(a, b, h))[1] for a, b in both}
    pairs = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for a, b in sorted(gains, key=gains.get, reverse=True)[:PAIRS]]
    for _ in range(ROUNDS // 2):
        for a, b, table in pairs:
            g, h = slope()
            step = RATE * _best_cross(crossed(a, b, g), crossed(a, b, h))[0]
            table += step
            z += step[rough[:, a], rough[:, b]]
    return {"cuts": cuts, "coarse": coarse, "tables": tables, "pairs": pairs, "start": start}


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "quality") -> dict:
    """Fit on rows with label 0 or 1 (others teach nothing); of more than MAX_ROWS, as where ids repeat, those first by hash."""
    rows = labelled.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{label_col}`").cast("int").alias("label"))
    data = rows.where("label in (0, 1)").mapInArrow(_feature_rows, "label int, x array<double>")
    data = data.orderBy(F.xxhash64("x", "label"), "x", "label").limit(MAX_ROWS).collect()
    data = sorted((tuple(r.x), r.label) for r in data)  # the fit doesn't depend on the order of rows
    return fit(np.array([d[0] for d in data]).reshape(-1, len(FEATURES)), np.array([d[1] for d in data], float))


def _score_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches, "text"):
            x = features(b.column("text"))
            z = np.full(len(x), model["start"])
            at, rough = _bins(x, model["cuts"]), _bins(x, model["coarse"])
            for f, table in enumerate(model["tables"]):
                z += table[at[:, f]]
            for i, j, table in model["pairs"]:
                z += table[rough[:, i], rough[:, j]]
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.record_batch([b.column("row"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["row", "score", "predicted"])
    return run


def classify(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and ``score`` (0 to 1), ``predicted`` (1 from 0.5 on).

    Null texts score as empty ones. Nothing learned: 0.5. Repeated rows score
    alike. Input columns of these names are replaced. An empty table gives none.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted", text_col)]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(*keep).alias("row"))
    schema = T.StructType().add("row", packed.schema["row"].dataType).add("score", "double").add("predicted", "integer")
    return packed.mapInArrow(_score_rows(shared), schema).select("row.*", "score", "predicted")
