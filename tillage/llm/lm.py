"""LM scoring: a gated recurrent language model with a class-factored softmax.

Counts of all training tokens (by 64-bit fingerprint) give the vocabulary: all
tokens with at least ``share`` of the counts, and at least the ``words`` most
frequent ones, are modelled, cut by frequency into classes of equal shares of
the counts' square roots (about as many as the square root of the words'
number, so that a token costs two short softmaxes);
every other token is the unknown symbol times its share of the
unmodelled counts (plus one each, and one for everything unseen), so the model
is a distribution over tokens. The probability of a token is that of its class
times that of the token within the class, both softmaxes of the recurrent
state. The unit has an update gate; its state is carried over the windows of a
document and starts at zero for each document.

Training reads every training document once, in ``rounds``: each task trains
its documents with truncated backpropagation (numpy, adaptive step sizes) from
the common parameters, and the parameters are averaged by tokens. Scoring
runs documents side by side in lanes, one after the other within a lane.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillage.llm.arrays import summed
from tillage.llm.tables import written
from tillage.llm.words import slices, split_words, text_of_word, word_hashes

WORDS = 2047
SHARE = 2.0 ** -16
HIDDEN = 16
WINDOW = 16
LANES = 256
SCORE_LANES = 512
SCORE_TOKENS = 1 << 15
BLOCK = 1 << 12
ROUNDS = (0.125, 1.0)
KNOWN = 1 << 19
RATE = 0.5
STEP = 0.1
END = np.uint64(0x5851F42D4C957F2D)
SLICE = 8 << 20
_SCORED = "n_tokens long, known long, counts_sum double, model_sum double, rare array<struct<token:long,n:int>>"


def _tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, ids and fingerprints of tokens; every text ends with the end token."""
    off, ids, words = split_words(column, lower=True)
    h = np.concatenate([word_hashes(words), [END]])
    texts = len(off) - 1
    new = off + np.arange(texts + 1)
    out = np.full(new[-1], len(h) - 1, np.int64)
    out[np.arange(len(ids)) + text_of_word(off)] = ids
    return new, out, h


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", SLICE):
        _, ids, h = _tokens(b.column("text"))
        n = np.bincount(ids, minlength=len(h))
        yield pa.record_batch([pa.array(h[n > 0].view(np.int64)), pa.array(n[n > 0])], names=["token", "n"])


def class_edges(counts: np.ndarray, classes: int) -> np.ndarray:
    """Where the classes of words by falling counts begin and end: equal shares of the square roots of the counts, a word each at least.

    Frequent words get small classes, so a token costs fewer outputs than with classes of equal size."""
    words = len(counts)
    classes = max(1, min(classes, words))
    upto = np.cumsum(np.sqrt(np.maximum(counts, 0.5)))
    cut = np.searchsorted(upto, upto[-1] * np.arange(1, classes) / classes) if words else np.empty(0, np.int64)
    cut = np.maximum(cut, np.arange(1, len(cut) + 1))
    cut = np.minimum(np.maximum.accumulate(cut - np.arange(len(cut))) + np.arange(len(cut)), words - np.arange(len(cut), 0, -1))
    return np.concatenate([[0], cut, [words]]).astype(np.int64) if words else np.zeros(1, np.int64)


class Net:
    """The network's parameters in one vector, with named views. ``edges``: where the classes of words begin, and the words' number."""

    def __init__(self, edges: np.ndarray, hidden: int, theta: np.ndarray | None = None):
        # word ids are 0 .. words-1 by frequency, the unknown symbol is ``words`` and a class of its own
        self.edges, self.words, self.hidden = edges, int(edges[-1]), hidden
        self.classes = len(edges)
        self.group = np.repeat(np.arange(self.classes), np.append(np.diff(edges), 1))
        # the last column of "wo" holds the words' biases
        shapes = {"e": (self.words + 1, 2 * hidden), "u": (hidden, 2 * hidden), "wc": (hidden, self.classes), "bc": (self.classes,),
                  "wo": (self.words, hidden + 1)}
        n = sum(int(np.prod(s)) for s in shapes.values())
        self.theta = np.zeros(n, np.float32) if theta is None else theta.astype(np.float32)
        self.views, at = {}, 0
        for k, s in shapes.items():
            self.views[k] = (at, at + int(np.prod(s)), s)
            at += int(np.prod(s))

    def get(self, name: str, of: np.ndarray | None = None) -> np.ndarray:
        a, z, s = self.views[name]
        return (self.theta if of is None else of)[a:z].reshape(s)

    def class_of(self, x: np.ndarray) -> np.ndarray:
        return self.group[x]

    def members(self, c: int) -> slice:
        return slice(self.edges[c], self.edges[c + 1])

    def start(self, counts: np.ndarray, seed: int) -> None:
        """Small random weights; biases at the counts' probabilities (``counts``: of the ids, the unknown symbol last)."""
        rng = np.random.default_rng(seed)
        for weights in (self.get("e"), self.get("u"), self.get("wc"), self.get("wo")[:, :-1]):
            weights[:] = rng.standard_normal(weights.shape) * 0.1
        p = np.maximum(counts, 0.5)
        self.get("bc")[:] = np.log(np.bincount(self.group, p, minlength=self.classes) / p.sum())
        for c in range(self.classes - 1):
            m = self.members(c)
            self.get("wo")[m, -1] = np.log(p[m] / p[m].sum())


class Steps:
    """Adaptive steps: each number has the sum of its squared gradients. Only what a window touched is moved."""

    def __init__(self, net: Net, rate: float, start: float = STEP):
        self.net, self.rate, self.scale, self.most = net, rate, 1.0, 1
        self.squares = np.full_like(net.theta, start)

    def move(self, name: str, grad: np.ndarray, at=slice(None)) -> None:
        grad = grad * np.float32(self.scale)
        squares, theta = self.net.get(name, self.squares), self.net.get(name)
        new = grad * grad
        new += squares[at]
        squares[at] = new
        np.sqrt(new, out=new)
        new += np.float32(1e-4)
        grad *= np.float32(self.rate)
        grad /= new
        theta[at] -= grad


def _order(x: np.ndarray, kinds: int) -> np.ndarray:
    """The stable order of numbers below ``kinds`` (those of 16 bits are sorted by radix)."""
    return np.argsort(x.astype(np.uint16) if kinds <= 1 << 16 else x, kind="stable")


def _class_outputs(net: Net, s: np.ndarray) -> np.ndarray:
    """Probabilities of the classes at states ``s``."""
    z = s @ net.get("wc")
    z += net.get("bc")
    z -= np.maximum.reduceat(z.reshape(-1), np.arange(0, z.size, net.classes))[:, None]
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _outputs(net: Net, s: np.ndarray, x: np.ndarray, steps: Steps | None = None):
    """Natural log-probabilities of tokens ``x`` at states ``s``; with ``steps``, also the states' gradients of the loss, and the outputs are moved.

    Each class multiplies the states of its tokens by its words; what is done to each number is then done to all
    classes at once, in one array in which every token has a run of its class's size and a leading number that counts nothing."""
    c = net.class_of(x)
    if steps is None:
        p = np.empty(len(x), np.float32)
        for a in range(0, len(x), BLOCK):  # a block's outputs stay in the cache
            part = c[a:a + BLOCK]
            p[a:a + BLOCK] = _class_outputs(net, s[a:a + BLOCK])[np.arange(len(part)), part]
    else:
        z, row = _class_outputs(net, s), np.arange(len(x))
        p = z[row, c]
    logp = np.log(np.maximum(p, 1e-30))
    order = _order(c, net.classes)
    edges = np.searchsorted(c[order], np.arange(net.classes))
    n, size = np.diff(edges), np.diff(net.edges)
    known = int(edges[-1]) if net.words else 0  # the unknown symbol comes last, the only one of its class
    wo = net.get("wo")
    touched = np.flatnonzero(n)
    if known:
        s_by = np.ones((len(x), net.hidden + 1), np.float32)  # the last column meets the biases
        s_by[:, :-1] = np.take(s, order, axis=0)
        width = np.repeat(size + 1, n)
        run = np.cumsum(width) - width
        y = np.empty(int(run[-1] + width[-1]), np.float32)
        y[run] = -np.inf
        at = np.cumsum(n * (size + 1)) - n * (size + 1)
        parts = [(a, e, lo, hi, y[f:f + (e - a) * (hi - lo + 1)].reshape(e - a, -1)[:, 1:]) for a, e, lo, hi, f in zip(
            *(v[touched].tolist() for v in (edges[:-1], edges[1:], net.edges[:-1], net.edges[1:], at)))]
        for a, e, lo, hi, part in parts:
            np.matmul(s_by[a:e], wo[lo:hi].T, out=part)
        y -= np.repeat(np.maximum.reduceat(y, run), width)
        np.exp(y, out=y)
        total = np.add.reduceat(y, run)
        hit = run + 1 + (x[order[:known]] - np.repeat(net.edges[:-1], n))
        logp[order[:known]] += np.log(np.maximum(y[hit] / total, 1e-30))
    if steps is None:
        return logp, None
    z[row, c] -= 1
    ds = z @ net.get("wc").T
    if known:
        y /= np.repeat(total, width)
        y[hit] -= 1
        ds_by, gw = np.empty_like(s_by[:known]), np.zeros_like(wo)
        for a, e, lo, hi, part in parts:
            np.matmul(part, wo[lo:hi], out=ds_by[a:e])
            np.matmul(part.T, s_by[a:e], out=gw[lo:hi])
        ds[order[:known]] += ds_by[:, :-1]
        # All rows of a class that a token fell into are moved: mostly those of all classes.
        moved = slice(None) if 2 * len(touched) > net.classes else np.concatenate([np.arange(lo, hi) for _, _, lo, hi, _ in parts])
        steps.move("wo", gw[moved], moved)
    steps.move("wc", s.T @ z)
    steps.move("bc", z.sum(axis=0))
    return logp, ds


def _lanes(off: np.ndarray, lanes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Texts dealt to lanes, longest first to the shortest lane; longer lanes come first. Per lane: positions, starts of texts."""
    size = np.diff(off)
    # No more lanes than the longest text allows to be about as long as its own, so that none runs on alone.
    lanes = max(1, min(lanes, len(size), max(16, int(size.sum()) // max(int(size.max(initial=1)), 1))))
    fill, dealt = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
    for t in np.argsort(-size, kind="stable"):
        k = int(fill.argmin())
        dealt[k].append(int(t))
        fill[k] += size[t]
    out = []
    for k in np.argsort(-fill, kind="stable"):
        if fill[k]:
            pos = np.concatenate([np.arange(off[t], off[t + 1]) for t in dealt[k]])
            first = np.zeros(len(pos), bool)
            first[np.cumsum([0, *(size[t] for t in dealt[k][:-1])])] = True
            out.append((pos, first))
    return out


def _windows(off: np.ndarray, lanes: int, tokens: int):
    """Steps of all lanes in windows of about ``tokens`` tokens: positions (steps x lanes, -1 past a lane's end), starts of texts."""
    dealt = _lanes(off, lanes)
    steps = max((len(p) for p, _ in dealt), default=0)
    grid, first = np.full((steps, len(dealt)), -1, np.int64), np.zeros((steps, len(dealt)), bool)
    for k, (p, f) in enumerate(dealt):
        grid[:len(p), k], first[:len(p), k] = p, f
    a = 0
    while a < steps:
        live = int((grid[a] >= 0).sum())  # longer lanes come first
        z = min(steps, a + max(1, tokens // live))
        yield grid[a:z, :live], first[a:z, :live]
        a = z


def _forward(net: Net, x: np.ndarray, first: np.ndarray, h: np.ndarray):
    """States before each step (text starts at zero), gates and candidates, and the state after the window."""
    hidden, u = net.hidden, net.get("u")
    gx = np.take(net.get("e"), x, axis=0)
    s = np.empty((len(x) + 1, x.shape[1], hidden), np.float32)
    f, n = (np.empty((*x.shape, hidden), np.float32) for _ in range(2))
    s[0] = h
    some = first.any(axis=1).tolist()
    for t in range(len(x)):
        h, gate = s[t], f[t]
        if some[t]:
            h[first[t]] = 0
        g = gx[t]
        g += h @ u
        np.negative(g[:, :hidden], out=gate)
        np.exp(gate, out=gate)
        gate += 1
        np.reciprocal(gate, out=gate)
        np.tanh(g[:, hidden:], out=n[t])
        after = np.subtract(n[t], h, out=s[t + 1])
        after *= gate
        after += h
    return s[:-1], f, n, s[-1]


def _streams(slices_: Iterator[tuple[np.ndarray, np.ndarray]], lanes: int, window: int):
    """Windows (ids, live, starts of texts: steps x lanes) of lanes that live as long as the task.

    A lane takes the next text when its own ends, the longest of a slice first; the next slice is read when all its
    texts are taken, so windows stay full until the last one. ``slices_``: offsets and ids of texts."""
    x, queue = np.empty(0, np.int64), []
    pos, end = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    more = True
    while True:
        grid, live, first = np.zeros((window, lanes), np.int64), np.zeros((window, lanes), bool), np.zeros((window, lanes), bool)
        t = 0
        while t < window:
            free = np.flatnonzero(pos == end)
            while len(free) and (queue or more):
                if not queue:
                    got = next(slices_, None)
                    if got is None:
                        more = False
                        break
                    off, ids = got
                    # What the lanes still hold of earlier slices comes before the new one.
                    rest = np.flatnonzero(end > pos)
                    held = [x[pos[k]:end[k]] for k in rest]
                    size = np.array([len(h) for h in held], np.int64)
                    x = np.concatenate([*held, ids])
                    end[rest] = np.cumsum(size)
                    pos[rest] = end[rest] - size
                    base = int(size.sum())
                    idle = np.setdiff1d(np.arange(lanes), rest, assume_unique=True)
                    pos[idle] = end[idle] = 0
                    n = np.diff(off)
                    queue = [(base + int(off[i]), base + int(off[i + 1])) for i in np.argsort(n, kind="stable") if n[i]]
                take = min(len(free), len(queue))
                for k in free[:take]:
                    pos[k], end[k] = queue.pop()
                first[t, free[:take]] = True
                free = free[take:]
            now = np.flatnonzero(pos < end)
            if not len(now):
                break
            # All lanes go on to where the first of them ends.
            z = min(window, t + int((end[now] - pos[now]).min()))
            live[t:z, now] = True
            grid[t:z, now] = x[pos[now] + np.arange(z - t)[:, None]]
            pos[now] += z - t
            t = z
        used = np.flatnonzero(live.any(axis=0))
        if not len(used):
            return
        yield used, grid[:, used], live[:, used], first[:, used]


def _train_window(net: Net, steps: Steps, h: np.ndarray, ids: np.ndarray, live: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One step of truncated backpropagation over a window; the lanes' states after it."""
    s, f, n, after = _forward(net, ids, first, h)
    hidden, u = net.hidden, net.get("u")
    at = np.flatnonzero(live.reshape(-1))
    steps.most = max(steps.most, len(at))
    steps.scale = steps.most ** -0.5  # windows with few tokens left move the parameters less
    _, d = _outputs(net, s.reshape(-1, net.hidden)[at], ids.reshape(-1)[at], steps)
    ds = np.zeros((live.size, hidden), np.float32)
    ds[at] = d
    ds = ds.reshape(s.shape)
    way, keep, bend = n - s, 1 - f, 1 - n ** 2
    dg = np.empty((*ids.shape, 2 * hidden), np.float32)
    dh = np.zeros_like(s[0])
    over, some = (~live).any(axis=1).tolist(), first.any(axis=1).tolist()
    for t in range(len(ids) - 1, -1, -1):
        if over[t]:
            dh *= live[t][:, None]
        way[t] *= dh
        way[t] *= f[t]
        np.multiply(way[t], keep[t], out=dg[t, :, :hidden])
        np.multiply(np.multiply(dh, f[t], out=way[t]), bend[t], out=dg[t, :, hidden:])
        dh *= keep[t]
        dh += dg[t] @ u.T
        dh += ds[t]
        if some[t]:
            dh[first[t]] = 0
    flat = dg.reshape(-1, 2 * hidden)
    order = _order(ids.reshape(-1), net.words + 1)
    seen = ids.reshape(-1)[order]
    edge = np.flatnonzero(np.diff(seen, prepend=-1))
    grad = np.add.reduceat(np.take(flat, order, axis=0), edge, axis=0)
    steps.move("u", s.reshape(-1, hidden).T @ flat)
    steps.move("e", grad, seen[edge])
    return after


def _train(net: Net, steps: Steps, slices_: Iterator[tuple[np.ndarray, np.ndarray]], lanes: int, window: int) -> None:
    h = np.zeros((lanes, net.hidden), np.float32)
    for used, ids, live, first in _streams(slices_, lanes, window):
        h[used] = _train_window(net, steps, h[used], ids, live, first)


def _score_slice(net: Net, off: np.ndarray, x: np.ndarray, lanes: int = SCORE_LANES, tokens: int = SCORE_TOKENS) -> np.ndarray:
    """Natural log-probability of every token of a slice."""
    out = np.zeros(len(x))
    h = np.zeros((0, net.hidden), np.float32)
    for grid, first in _windows(off, lanes, tokens):
        live = grid >= 0
        ids = np.where(live, x[grid], 0)
        h = np.zeros((grid.shape[1], net.hidden), np.float32) if not len(h) else h[:grid.shape[1]]
        s, _, _, h = _forward(net, ids, first, h)
        at = np.flatnonzero(live.reshape(-1))
        out[grid.reshape(-1)[at]] = _outputs(net, s.reshape(-1, net.hidden)[at], ids.reshape(-1)[at])[0]
    return out


def _vocabulary_ids(h: np.ndarray, ids: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Model ids of tokens; ``vocabulary``: fingerprints by frequency."""
    order = np.argsort(vocabulary)
    if not len(vocabulary):
        return np.zeros(len(ids), np.int64)
    at = np.minimum(np.searchsorted(vocabulary[order], h), len(vocabulary) - 1)
    return np.where(vocabulary[order][at] == h, order[at], len(vocabulary))[ids]


def _score_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta, shape, vocabulary, tokens, counts, outside = shared.value
        net = Net(*shape, theta)
        for b in slices(batches, "text", SLICE):
            off, ids, h = _tokens(b.column("text"))
            found, c = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
                found = tokens[at] == h
                c = np.where(found, counts[at], 0)
            model = _vocabulary_ids(h, np.arange(len(h)), vocabulary)
            logp = _score_slice(net, off, model[ids]) / np.log(10)
            add = np.log10(c + 1.0)
            # A token outside the vocabulary: its share of the counts outside (those of rare tokens are joined later).
            share = np.where(model == len(vocabulary), np.where(found, add, 0) - outside, 0)
            sums = [np.add.reduceat(v, off[:-1]) for v in (found[ids].astype(np.int64), np.where(found, add, 0)[ids], logp + share[ids])]
            text = text_of_word(off)
            rare = ~found[ids]
            pairs, n = np.unique(text[rare] * len(h) + ids[rare], return_counts=True)
            ro = np.searchsorted(pairs // len(h), np.arange(b.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ro.astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array(h[pairs % len(h)].view(np.int64)), pa.array(n.astype(np.int32))], ["token", "n"]))
            yield pa.record_batch([b.column("row"), pa.array(np.diff(off)), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2]), lists],
                                  names=["row", "n_tokens", "known", "counts_sum", "model_sum", "rare"])
    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([pa.array([b.column(k).to_numpy().tobytes()], pa.binary()) for k in ("token", "c")], names=["token", "c"])


def most_frequent(counts: DataFrame, known: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and counts, most frequent first: all tokens from the least count on that gives at most ``known`` of them."""
    at_least = F.sum("tokens").over(Window.orderBy(F.col("c").desc()))
    by_count = counts.groupBy("c").agg(F.count(F.lit(1)).alias("tokens")).select("c", at_least.alias("upto"))
    least = by_count.where(F.col("upto") <= known).agg(F.min("c")).first()[0]
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = counts.where(F.col("c") >= least).select("token", "c").mapInArrow(_packed, "token binary, c binary").collect()
    token = np.concatenate([np.frombuffer(r.token, np.int64) for r in rows])
    c = np.concatenate([np.frombuffer(r.c, np.int64) for r in rows])
    order = np.lexsort((token, -c))
    return token[order].view(np.uint64), c[order]


def score(docs: DataFrame, learns, text_col: str = "text", words: int = WORDS, share: float = SHARE, classes: int | None = None,
          hidden: int = HIDDEN, window: int = WINDOW, lanes: int = LANES, known: int = KNOWN, rounds: tuple[float, ...] = ROUNDS, rate: float = RATE,
          seed: int = 5) -> DataFrame:
    """All columns of ``docs`` but the text, and ``n_tokens``, ``n_known``, ``train_tokens`` (long), ``base_score``, ``score`` (double).

    ``learns`` (a boolean column expression) marks training rows. ``score`` is
    the model's log10 probability of the whole text and its end,
    ``base_score`` that of add-one counts. Null and empty texts are the end
    token alone. Repeated rows count, train and score each time. Input
    columns of these names are replaced. Without training rows all tokens are
    unseen and the network knows only the unknown symbol. Counts of the
    ``known`` (at most) most frequent tokens are broadcast; those of others are joined. Texts of any length are read
    whole: one runs in one lane, its state carried over all its windows. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (*made, text_col)]
    base = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), learns.alias("learns"), F.struct(*keep).alias("row"))
    learning = base.where("learns").select("text")
    counts = written(learning.mapInArrow(_count_rows, "token long, n long").groupBy("token").agg(F.sum("n").alias("c")))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, c = most_frequent(counts, known)
    words = max(words, int((c >= share * total.n).sum()))
    vocabulary, modelled = tokens[:words], int(c[:words].sum())
    classes = classes or round(len(vocabulary) ** 0.5) + 1
    shape = (class_edges(c[:words], classes - 1), hidden)
    net = Net(*shape)
    net.start(np.concatenate([c[:words], [total.n - modelled + 1]]).astype(float), seed)

    done = 0.0
    for upto in rounds:
        place = F.xxhash64("text", F.lit(seed)) / F.lit(2.0 ** 64) + 0.5
        part = learning.where((place >= done) & (place < (upto if upto < 1 else 2.0))) if total.n else learning.limit(0)
        shared_start = spark.sparkContext.broadcast((net.theta, vocabulary))
        # The texts of an early round lie in all files; so many fewer tasks read them, each as much as a task of the last.
        part = part.coalesce(max(1, round(part.rdd.getNumPartitions() * (upto - done))))

        def task(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            theta, vocabulary = shared_start.value
            local, seen = Net(*shape, theta.copy()), 0

            def read() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                nonlocal seen
                for b in slices(batches, "text", SLICE):
                    off, ids, h = _tokens(b.column("text"))
                    seen += len(ids)
                    yield off, _vocabulary_ids(h, ids, vocabulary)
            _train(local, Steps(local, rate), read(), lanes, window)
            return np.concatenate([local.theta.astype(np.float64) * seen, [seen]])

        sums = summed(part, task, len(net.theta) + 1)
        if sums[-1]:
            net.theta = (sums[:-1] / sums[-1]).astype(np.float32)
        done = upto

    order = np.argsort(tokens)
    outside = float(total.n - modelled + total.v - len(vocabulary) + 1)
    shared = spark.sparkContext.broadcast((net.theta, shape, vocabulary, tokens[order], c[order], np.log10(outside)))
    row = base.schema["row"].dataType
    fields = T._parse_datatype_string(_SCORED).fields
    scored = written(base.select("row", "text").mapInArrow(_score_rows(shared), T.StructType([T.StructField("row", row), *fields]))
                     .withColumn("row_id", F.monotonically_increasing_id()))
    rare = (scored.select("row_id", F.explode("rare").alias("r")).select("row_id", "r.token", "r.n")
            .join(counts, "token").groupBy("row_id")
            .agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"), F.sum("n").alias("more_known")))
    more = F.coalesce("more", F.lit(0.0))
    told = scored.join(rare, "row_id", "left")
    return told.select("row.*", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                       F.lit(int(total.n)).cast("long").alias("train_tokens"),
                       (F.col("counts_sum") + more - F.col("n_tokens") * F.lit(float(np.log10(total.n + total.v + 1)))).alias("base_score"),
                       (F.col("model_sum") + more).alias("score"))
