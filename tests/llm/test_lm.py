"""The recurrent model: gradients against finite differences, classes, and scores that do not depend on how texts are dealt."""

import collections
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillage.llm import lm


class Recorder:
    """Keeps the gradients that a window would move the parameters by."""

    def __init__(self, net):
        self.net, self.scale, self.most, self.grad = net, 1.0, 1, np.zeros(len(net.theta))

    def move(self, name, grad, at=slice(None)):
        self.net.get(name, self.grad)[at] += grad


def small_net(words=30, classes=5, hidden=4, seed=2):
    counts = np.sort(np.random.default_rng(seed).integers(1, 200, words))[::-1].astype(float)
    net = lm.Net(lm.class_edges(counts, classes), hidden)
    net.start(np.append(counts, 50.0), seed)
    net.theta += np.random.default_rng(seed + 1).normal(0, 0.3, len(net.theta)).astype(np.float32)
    return net


def loss(net, h, ids, live, first):
    s, _, _, _ = lm._forward(net, ids, first, h)
    at = np.flatnonzero(live.reshape(-1))
    return -float(lm._outputs(net, s.reshape(-1, net.hidden)[at], ids.reshape(-1)[at])[0].astype(np.float64).sum())


def test_gradients_match_finite_differences():
    net, rng = small_net(), np.random.default_rng(5)
    ids = rng.integers(0, 31, (6, 5))
    live = np.ones((6, 5), bool)
    live[4:, 1] = live[2:, 3] = False
    first = rng.random((6, 5)) < 0.2
    ids[~live], first[~live] = 0, False
    h = rng.normal(0, 0.5, (5, 4)).astype(np.float32)
    seen = Recorder(net)
    lm._train_window(net, seen, h, ids, live, first)
    names = list(net.views)
    assert all(np.abs(net.get(n, seen.grad)).max() > 0.05 for n in names)
    for n in names:
        a, z, _ = net.views[n]
        for at in rng.choice(np.arange(a, z), min(z - a, 25), replace=False):
            kept, ends = net.theta[at], []
            for d in (0.01, -0.01):
                net.theta[at] = kept + np.float32(d)
                ends.append(loss(net, h, ids, live, first))
            net.theta[at] = kept
            assert (ends[0] - ends[1]) / 0.02 == pytest.approx(seen.grad[at], abs=0.02, rel=0.02), n


def test_probabilities_of_all_tokens_sum_to_one():
    net = small_net()
    s = np.random.default_rng(1).normal(0, 1, (1, 4)).astype(np.float32)
    every = np.arange(31)
    assert np.exp(lm._outputs(net, np.repeat(s, 31, axis=0), every)[0]).sum() == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("words,classes", [(0, 3), (1, 1), (1, 9), (7, 7), (7, 3), (100, 10), (5000, 70)])
def test_classes_hold_every_word_once(words, classes):
    counts = 1e6 / np.arange(1, words + 1) ** 1.2
    edges = lm.class_edges(counts, classes)
    assert edges[0] == 0 and edges[-1] == words and (np.diff(edges) > 0).all()
    if words:
        assert len(edges) == min(words, classes) + 1
    if words == 5000:
        sizes = np.diff(edges)
        share = np.add.reduceat(counts, edges[:-1]) / counts.sum()
        assert (share * sizes).sum() < 0.8 * words / classes  # cheaper than classes of equal size


@pytest.mark.parametrize("classes", [4, 25])
def test_outputs_are_those_of_classes_taken_one_by_one(classes):
    """Log-probabilities, gradients and steps against one class and one token at a time, without tokens of some classes, too; no sum is called once a class."""
    net, rng = small_net(words=90, classes=classes, hidden=5), np.random.default_rng(7)
    x = np.concatenate([rng.integers(0, 91, 200), np.full(9, 90)])
    x = x[~np.isin(net.class_of(x), [1, 3])]
    s = rng.normal(0, 0.6, (len(x), 5)).astype(np.float32)
    wide = {k: net.get(k).astype(np.float64) for k in ("wc", "bc", "wo")}
    want, ds, grad = [], np.zeros(s.shape), {k: np.zeros(v.shape) for k, v in wide.items()}
    for i, (state, token) in enumerate(zip(s.astype(np.float64), x)):
        c = int(net.class_of(token))
        z = np.exp(state @ wide["wc"] + wide["bc"])
        z /= z.sum()
        want.append(np.log(z[c]))
        z[c] -= 1
        ds[i] += wide["wc"] @ z
        grad["wc"] += np.outer(state, z)
        grad["bc"] += z
        if token < 90:
            m = net.members(c)
            y = np.exp(wide["wo"][m] @ np.append(state, 1.0))
            y /= y.sum()
            want[-1] += np.log(y[token - m.start])
            y[token - m.start] -= 1
            ds[i] += y @ wide["wo"][m, :-1]
            grad["wo"][m] += np.outer(y, np.append(state, 1.0))
    seen, sums = Recorder(net), []
    sys.setprofile(lambda frame, event, arg: sums.append(1) if event == "c_call" and arg.__name__ in ("reduce", "reduceat") else None)
    try:
        got, back = lm._outputs(net, s, x, seen)
    finally:
        sys.setprofile(None)
    assert got == pytest.approx(np.array(want), abs=1e-5)
    assert lm._outputs(net, s, x)[0] == pytest.approx(np.array(want), abs=1e-5)
    assert back == pytest.approx(ds, abs=1e-5)
    for k in wide:
        assert net.get(k, seen.grad) == pytest.approx(grad[k], abs=1e-4), k
    assert len(sums) < 10  # three a class before: on short rows, calls took most of the time


def test_streams_go_on_to_the_next_end_of_a_text():
    """Lanes of equal texts are filled a window at a time, not a step at a time."""
    off = np.arange(0, 16 * 8 * 40 + 1, 40)
    looked = []
    sys.setprofile(lambda frame, event, arg: looked.append(1) if event == "c_call" and arg.__name__ == "nonzero" else None)
    try:
        windows = list(lm._streams(iter([(off, np.arange(off[-1]))]), 16, 20))
    finally:
        sys.setprofile(None)
    assert sum(int(live.sum()) for _, _, live, _ in windows) == off[-1] and len(windows) == 16
    assert len(looked) <= 4 * len(windows) + 4  # two a step before


def texts(seed, n=60, longest=400):
    rng = np.random.default_rng(seed)
    size = rng.integers(1, 30, n)
    size[n // 2] = longest
    off = np.concatenate([[0], np.cumsum(size)])
    return off, rng.integers(0, 31, off[-1])


@pytest.mark.parametrize("lanes,tokens", [(1, 1), (3, 50), (16, 7), (64, 1000), (512, 1 << 15)])
def test_scores_do_not_depend_on_lanes_and_windows(lanes, tokens):
    net, (off, x) = small_net(), texts(3)
    alone = []
    for a, z in zip(off[:-1], off[1:]):
        s, _, _, _ = lm._forward(net, x[a:z, None], np.arange(z - a)[:, None] == 0, np.zeros((1, 4), np.float32))
        alone.append(lm._outputs(net, s[:, 0], x[a:z])[0])
    assert lm._score_slice(net, off, x, lanes, tokens) == pytest.approx(np.concatenate(alone), abs=1e-4)


@pytest.mark.parametrize("lanes,window", [(1, 4), (5, 3), (16, 16), (100, 8)])
def test_streams_give_every_token_once_in_order(lanes, window):
    """Lanes carry on over slices; each text runs in one lane, from a start flag on, and windows stay full until the texts run out."""
    parts = [texts(s) for s in (1, 2, 3)]
    want = collections.Counter(tuple(x[a:z]) for off, x in parts for a, z in zip(off[:-1], off[1:]))
    now, got, full = [[] for _ in range(lanes)], collections.Counter(), []
    for used, ids, live, first in lm._streams(iter(parts), lanes, window):
        full.append(live.sum())
        for k, lane in enumerate(used):
            for t in np.flatnonzero(live[:, k]):
                if first[t, k] and now[lane]:
                    got[tuple(now[lane])] += 1
                    now[lane] = []
                now[lane].append(ids[t, k])
                assert first[t, k] or len(now[lane]) > 1
    got.update(tuple(x) for x in now if x)
    assert got == want
    assert lanes > 16 or all(f == lanes * window for f in full[:-(400 // window + 2)])  # but for the longest text, at the end


def test_scores_of_a_table(spark):
    """Base scores by brute force; null, empty, repeated and very long texts; clashing columns; slices and partitions don't matter."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 60)))), "s", "t") for i in range(120)]
    rows += [(200, None, "s", "t"), (201, "", "s", "t"), (202, " \n ", "s", "t"), (None, "W1 w1", "s", "t"), (203, "nowhere seen", "s", "t"),
             (204, "w1 " * 40_000, "s", "t"), (3, rows[3][1], "s", "t"), (3, rows[3][1], "s", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, row string")
    learns = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    got = lm.score(docs.repartition(3), learns).collect()
    again = lm.score(docs.repartition(3), learns).collect()
    assert sorted((r.doc_id or -1, round(r.score, 3)) for r in got) == sorted((r.doc_id or -1, round(r.score, 3)) for r in again)

    def tokens(text):
        return [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]
    counts = collections.Counter(t for r in rows if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 != 2 for t in tokens(r[1]))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((r[0] or -1, len(tokens(r[1])), sum(t in counts for t in tokens(r[1])), total,
                   round(sum(np.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens(r[1])), 6)) for r in rows)
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score(docs.limit(0), learns).count() == 0
