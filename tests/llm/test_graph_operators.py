"""Covering LSH, inverted multi-index and prefix trie against brute force: nulls, empty and long texts, ties, repeats, clashing columns."""

import collections
import hashlib
import itertools
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tillage.llm import covering, multi_index
from tillage.llm.covering import covering_masks, links_within, simhash_components
from tillage.llm.graph import components
from tillage.llm.multi_index import cells_by_bound, hard_negatives
from tillage.llm.prefix_trie import prefix_trie, subtree_totals

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def least_of_components(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in links:
        parent[find(i)] = find(j)
    return [find(i) for i in range(n)]


# --- simhash -----------------------------------------------------------------

def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_xxh64_matches_the_library():
    rng = np.random.default_rng(1)
    size = np.concatenate([np.arange(0, 100), rng.integers(0, 100, 300)])
    data = rng.integers(0, 256, int(size.sum())).astype(np.uint8)
    start = np.cumsum(size) - size
    want = [xxhash.xxh64_intdigest(data[a:a + n].tobytes(), seed=42) for a, n in zip(start, size)]
    assert covering.xxh64(data, start, size).tolist() == want


@pytest.mark.parametrize("radius", [1, 2])
def test_every_difference_is_cleared_in_some_mask(radius):
    masks = covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for gone in itertools.combinations(range(64), radius):
        assert any(not any(m >> i & 1 for i in gone) for m in masks)


@pytest.mark.parametrize("radius,bucket", [(1, 64), (1, 2), (2, 64), (2, 2)])
def test_links_of_dense_values_match_every_pair(spark, radius, bucket):
    """Values with few differing bits fill large buckets, which go to centres when ``bucket`` is small."""
    rng = np.random.default_rng(radius)
    base = [int(x) for x in rng.integers(0, 2 ** 63, 6, dtype=np.uint64)]
    values = {0, 1, 3, 2 ** 64 - 1}
    for b in base:
        values.add(b)
        for _ in range(60):
            values.add(b ^ sum(1 << int(i) for i in rng.choice(64, int(rng.integers(1, 5)), replace=False)))
    values = sorted(values)
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= radius]
    want = least_of_components(len(values), pairs)
    rows = [(covering._signed(v),) for v in values]
    links = links_within(spark.createDataFrame(rows, "fp long"), radius, bucket).collect()
    place = {r[0]: i for i, r in enumerate(rows)}
    got = least_of_components(len(values), [(place[r.a], place[r.b]) for r in links])
    assert all((values[place[r.a]] ^ values[place[r.b]]).bit_count() <= 2 for r in links)
    groups = [collections.defaultdict(set) for _ in range(2)]
    for i, (a, b) in enumerate(zip(want, got)):
        groups[0][a].add(i)
        groups[1][b].add(i)
    assert sorted(map(sorted, groups[0].values())) == sorted(map(sorted, groups[1].values()))


def test_simhash_components_match_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t\n", "One", "one", "two Words", "A b C d", "é über straße 中文", "é über straße 中文", "x" * 200_000, "again " * 70_000]
    for _ in range(60):
        w = list(rng.choice(vocabulary, int(rng.integers(60, 400))))
        for _ in range(5):
            texts.append(" ".join(w))
            w[int(rng.integers(0, len(w)))] = "changed"
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(3, "One", "x", "y"), (None, "one", "x", "y"), (None, "nobody else says this", "x", "y")]
    marks = [fingerprint(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 2]
    assert any(0 < (marks[i] ^ marks[j]).bit_count() for i, j in links)
    find = least_of_components(len(rows), links)
    least = {c: min((r[0] for r, f in zip(rows, find) if f == c and r[0] is not None), default=None) for c in set(find)}
    want = [(r[0], f"{m:016x}", least[f]) for r, m, f in zip(rows, marks, find)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component string").repartition(3)
    got = [tuple(r) for r in simhash_components(docs).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash_components(docs.limit(0)).count() == 0


def test_hot_fingerprint_and_bucket(spark):
    """A third of the rows are one text, and one bucket holds thousands of fingerprints."""
    values = [(covering._signed(v << 37),) for v in range(3000)]
    links = links_within(spark.createDataFrame(values, "fp long"))
    got = components(links)
    assert got.select("component").distinct().count() == 1 and got.count() == 3000
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same words here").otherwise(
        F.concat_ws(" ", *[F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(i))) for i in range(9)])).alias("text"))
    out = simhash_components(docs)
    assert out.where("component_id = 0").count() == 300 and out.count() == 900


# --- hard negatives ------------------------------------------------------------

def mined(rows, positives=5, negatives=3):
    use = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        use.append((i, [int(np.floor(256 * float(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, q, label in use:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, other) for j, v, other in use if j != i)
        for s, j, other in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out.extend((i, j, rank + 1, x[1], -s, -x[0]) for rank, x in enumerate(fits))
    return sorted(out)


def query(spark, rows, **more):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"id": F.lit("x"), "key": F.lit(1), "cell": F.lit(2)})
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hard_negatives(vectors.repartition(4), label=label, **more).collect())


def test_cells_come_in_descending_order():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=9), rng.normal(size=7)
    seen = list(cells_by_bound(a, b))
    assert [x[0] for x in seen] == sorted((x + y for x in a for y in b), reverse=True)
    assert len({x[1:] for x in seen}) == 63


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "ROWS_A_CELL", 8)
    monkeypatch.setattr(multi_index, "BLOCK", 16)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=8)).tolist(), int(rng.integers(0, 10))) for i in range(900)]
    rows += [(i, [0.5] * 8, i % 4) for i in range(900, 1300)]  # a hot group of equal vectors: ties and one large cell
    rows += [(2000, None, 1), (2050, [None] + [0.1] * 7, 1), (2100, [float("nan")] * 8, 2), (2150, [float("inf")] * 8, 2), (2200, [0.0] * 8, 3),
             (2250, [0.4] * 8, None), (None, [0.4] * 8, 1), (2300, [-0.5] * 8, 1), (2350, [], 1), (2400, [0.7, 0.2], 2)]
    assert query(spark, rows) == mined(rows)


def test_searches_stop_when_certified(spark, monkeypatch):
    """Far clusters: the answers lie in the first cells, and the others are not visited."""
    monkeypatch.setattr(multi_index, "ROWS_A_CELL", 4)
    visited = []
    monkeypatch.setattr(multi_index, "FIRST_CELLS", 4)
    rng = np.random.default_rng(8)
    rows = [(i, (10 * np.eye(16)[i % 16] + 0.01 * rng.normal(size=16)).tolist(), int(i % 3)) for i in range(1600)]
    vectors = multi_index._usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", "embedding",
                                  F.col("label").cast("long"))
    index, _ = multi_index.build_index(vectors, 256, rows_a_cell=4)
    for i, v, _ in rows[::50]:
        scores = [int(np.dot(np.floor(256 * np.array(v)), np.floor(256 * np.array(w)))) for _, w, _ in rows]
        kth = sorted(scores)[-20]
        upper, _ = index.bounds(np.floor(256 * np.array(v)))
        visited.append(sum(1 for bound, a, b in cells_by_bound(*upper) if index.rows[a, b] and bound >= kth) / (index.rows > 0).sum())
    assert np.mean(visited) < 0.5
    assert query(spark, rows) == mined(rows)


def test_visits_ship_an_anchor_once_a_shard():
    """Before, every visit carried its anchor's vector, and all visits of a batch of anchors were one batch."""
    rng = np.random.default_rng(9)
    books = [rng.normal(size=(32, 32)) for _ in range(2)]
    index = multi_index.Index(64, books, [np.ones(32)] * 2, np.full((32, 32), 300))
    rows = index.rows.reshape(-1)
    cell, block, shard = multi_index._shards(rows, 20)
    assert len(cell) == 1024 and not block.any() and np.bincount(shard).max() * 300 < 1.1 * rows.sum() / 20
    in_shard = np.unique(cell * 20 + shard)
    shared = SimpleNamespace(value=(index, np.searchsorted(in_shard // 20, np.arange(1025)), in_shard % 20))
    n = 1000
    vectors = (256 * rng.normal(size=(n, 64))).astype(np.int32)
    batch = pa.record_batch({"key": np.arange(n), "id": np.arange(n), "label": np.zeros(n, np.int64), "data": pa.array([v.tobytes() for v in vectors], pa.binary()),
                             "low": [[-5, 7]] * n, "high": [[5]] * n, "seen": [0] * n, "least": pa.array([None] * n, pa.int64()), "most": pa.array([None] * n, pa.int64())})
    visits, size = [], []
    for out in multi_index._visit_rows(shared, 1024)(iter([batch])):
        size.append(out.nbytes)
        for r in out.to_pylist():
            key, at = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["members"], np.int32)
            assert np.array_equal(np.frombuffer(r["data"], np.int32).reshape(-1, 64), vectors[key])
            assert np.frombuffer(r["low"], np.int64).reshape(-1, 2).tolist() == [[-5, 7]] * len(key)
            visits.extend(zip(key[at].tolist(), np.frombuffer(r["cells"], np.int32).tolist(), [r["shard"]] * len(at)))
    assert sorted(visits) == [(k, c, s) for k in range(n) for c, s in enumerate(shard.tolist())]
    assert max(size) < 2 * multi_index.TILE_BYTES and sum(size) < 8.2 * n * 1024 + 21 * n * (64 * 4 + 3 * 8 + 4 * 8)


def test_best_rows_of_a_tile():
    """Ties go to the smaller id, ranges may overlap or be empty, and a shard's best do not depend on how often they are cut."""
    rng = np.random.default_rng(10)
    x = rng.integers(-3, 4, (200, 4))
    ids, labels = rng.permutation(200), rng.integers(0, 3, 200)
    low, high = np.array([[-9, 4, 1]] * 30), np.array([[9, 20, 0]] * 30)
    cells, members = np.repeat(np.arange(4), 30), np.tile(np.arange(30), 4)
    held = {c: [(ids[c * 50:c * 50 + 50], labels[c * 50:c * 50 + 50], x[c * 50:c * 50 + 50])] for c in range(4)}
    for same in (True, False):
        want = set()
        for q in range(30):
            s = sorted((-int(x[q] @ x[c]), int(ids[c])) for c in range(200) if ids[c] != ids[q] and (labels[c] == labels[q]) == same)
            want |= {(q, w, i, -v) for w in range(3) for v, i in [(v, i) for v, i in s if low[q, w] <= -v <= high[q, w]][:5]}
        for most in (50, 1 << 20):
            with pytest.MonkeyPatch.context() as m:
                m.setattr(multi_index, "PRODUCTS", most)
                got = multi_index._tile_best(held, cells, members, ids[:30], labels[:30], x[:30], low, high, same, 5)
            assert set(zip(*(c.tolist() for c in got[0]))) == want


def test_small_and_empty_vector_tables(spark):
    assert query(spark, []) == []
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.9, 1.8], 2), (50, [-1.0, 0.0], 5), (50, [-1.0, 0.0], 5)]
    assert query(spark, rows) == mined(rows)


# --- prefix trie ---------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def trie(rows):
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((turn is not None, turn if turn is not None else 0, role, hashlib.md5(text.encode()).hexdigest(), text))
    convs = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in by.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = convs.get(base, [])[:h] + own[h:]
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, totals = [], {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        leaves = 1 if not kids[p] else 0
        totals[p] = (leaves + sum(totals[k][0] for k in kids[p]), saved + sum(totals[k][1] for k in kids[p]))
        ends = sorted(c for c in members[p] if len(built[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), *totals[p],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for c in [*range(0, 420), 500, 617, 1033, -7, -100, -250]:
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, ["user", "assistant"][t % 2], f"say {int(rng.integers(0, 2))} é"))
    rows += [(1200, t, "user", "deep " + str(t % 3)) for t in range(700)] + [(1201, t, "user", "deep " + str(t % 3)) for t in range(500)]
    rows += [(1300, None, None, None), (1300, None, "user", None), (1300, 2, None, "x"), (1300, 2, None, "x"), (None, 1, "user", "lost"), (1301, 1, "", "")]
    rows += [(1400 + i, 0, "user", "only") for i in range(60)]
    rows.append((1500, 0, "user", "long " * 60_000))
    turns = spark.createDataFrame(rows, TURNS).withColumns({"depth": F.lit("x"), "seg": F.lit("y"), "c": F.lit(1)}).repartition(5)
    got = sorted((tuple(r) for r in prefix_trie(turns).collect()), key=str)
    assert got == trie(rows)
    assert prefix_trie(turns.limit(0)).count() == 0
    turnless = [(c, 0, "user", "x") for c in range(1, 40) if zlib.crc32(str(c).encode()) % 6]
    assert sorted((tuple(r) for r in prefix_trie(spark.createDataFrame(turnless, TURNS)).collect()), key=str) == trie(turnless)


def test_segments_of_a_hot_conversation_join_up(spark, monkeypatch):
    from tillage.llm import prefix_trie as module
    monkeypatch.setattr(module, "SEGMENT", 8)
    monkeypatch.setattr(module, "ROWS_A_PART", 40)
    rows = [(100, t // 2, "user", f"t{t % 5}") for t in range(400)] + [(c, t, "user", f"t{t % 5}") for c in range(100, 140, 3) for t in range(5) if c != 100]
    got = sorted((tuple(r) for r in prefix_trie(spark.createDataFrame(rows, TURNS).repartition(4)).collect()), key=str)
    assert got == trie(rows)


@pytest.mark.parametrize("shape", ["path", "star", "random", "caterpillar", "one"])
def test_contraction_totals(spark, shape):
    rng = np.random.default_rng(4)
    n = 1 if shape == "one" else 900
    parent = {"path": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: int(rng.integers(0, i)),
              "caterpillar": lambda i: i - 1 if i % 2 else max(i - 2, 0), "one": None}[shape]
    up = {i: parent(i) for i in range(1, n)}
    depth = {0: 0}
    for i in range(1, n):
        depth[i] = depth[up[i]] + 1
    total = {i: i + 1 for i in range(n)}
    for i in sorted(up, key=lambda x: -depth[x]):
        total[up[i]] += total[i]
    k = collections.Counter(up.values())
    rows = [(i, depth[i], up.get(i), depth[up[i]] if i else None, k[i], i + 1) for i in range(n)]
    got = subtree_totals(spark.createDataFrame(rows, "c long, d long, uc long, ud long, k long, v long"), ["v"]).collect()
    assert {(r.c, r.v) for r in got} == set(total.items())
