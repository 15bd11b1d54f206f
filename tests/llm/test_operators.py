"""Operators against brute force on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import collections
import hashlib
import string

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillage.llm import chat, langid, lm, ngram_join, quality, topk
from tillage.llm.decontam import _lcs, benchmark_matches
from tillage.llm.graph import components
from tillage.llm.html import common_lines, extract_main_text, page_lines, text_lines
from tillage.llm.mixing import fit_counts, mix
from tillage.llm.ngram_join import jaccard_components
from tillage.llm.substring import remove_repeated_passages

RNG = np.random.default_rng(3)
WORDS = ["".join(RNG.choice(list("abcdefgh"), 4)) for _ in range(400)]
DOCS = "doc_id long, text string, shard string, source string"


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


PASSAGE = prose(60, 1)
ROWS = [
    (1, prose(80, 2) + " " + PASSAGE + "\n" + prose(10, 3), "x", "a"),
    (2, prose(5, 4) + "\t" + PASSAGE.replace(" ", "  "), "x", "b"),
    (3, None, None, None),
    (4, "", "x", "a"),
    (5, "one two", "x", None),
    (6, "one two", "x", "b"),
    (7, " ".join(["again"] * 200), "x", "b"),
    (8, prose(300, 5), "x", "c"),
    (9, prose(300, 5), "x", "c"),
    (9, prose(300, 5), "x", "c"),
    (None, prose(50, 6), "x", "c"),
    (11, prose(290, 5).rsplit(" ", 3)[0] + " odd end here", "x", "a"),
    (12, " \t\n ", "x", "a"),
    (13, prose(40_000, 7), "x", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).withColumn("n_words", F.lit("old")).withColumn("size", F.lit("old"))


def words(text):
    return (text or "").encode().split()


def test_passages_match_brute_force(docs):
    count = collections.Counter(tuple(w[i:i + 35]) for r in ROWS for w in [words(r[1])] for i in range(len(w) - 34))
    want = []
    for r in ROWS:
        w, gone = words(r[1]), set()
        for i in range(len(w) - 34):
            if count[tuple(w[i:i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((r[0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    got = remove_repeated_passages(docs)
    assert got.columns.count("n_words") == 1
    rows = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert all(sum(s.stop - s.start for s in r.removed_spans) == r.n_removed for r in got.collect())


def test_components_of_shingle_sets_match_brute_force(docs):
    low = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
    sets = []
    for r in ROWS:
        w = [x.translate(low) for x in words(r[1])]
        sets.append({tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set()))
    parent = list(range(len(ROWS)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(ROWS)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(ROWS):
        least[find(i)].append(r[0])
    want = [(r[0], len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None) if sets[i] else r[0]) for i, r in enumerate(ROWS)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_hot_group_of_near_copies(spark):
    """Copies of one text with a few words changed: components by every pair."""
    base, rows = prose(120, 50).split(), []
    for i in range(400):
        rng, w = np.random.default_rng(1000 + i), list(base)
        for at in rng.choice(120, int(rng.integers(0, 5)), replace=False):
            w[at] = f"w{i}x{at}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[i:i + 3]) for i in range(118)} for _, t in rows]
    parent = list(range(400))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(400):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(400)}


def test_pairs_of_large_sets_are_sieved_before_their_sets_are_made(spark, monkeypatch):
    """Large texts that share a passage only, and two near copies: before, every set of them was made and shipped."""
    made = []

    def spied(df, free=False):
        out = written(df, free)
        if "items" in out.columns:
            made.extend(r.n for r in out.select(F.expr("length(items) div 8").alias("n")).collect())
        return out
    written = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", spied)
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(800))
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50_000, 6000 + 100 * i)) + f" {passage}") for i in range(8)]
    rows += [(8, rows[0][1] + " one more word"), (9, "a short text of a few words"), (10, None)]
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i == 8 else i for i in range(11)}
    assert len(made) == 2 and min(made) > 6000


def test_wide_bitmaps_let_every_link_pass():
    rng = np.random.default_rng(4)
    sets, wide = [], []
    for n in (600, 1025, 1500, 2000, 2048, 2049, 2300, 4000, 4097, 4500):
        base = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
        for share in (0, 0.02, 0.05, 0.1, 0.3):
            sets.append(np.concatenate([base[int(share * n):], rng.integers(0, 1 << 63, int(share * n) // 2).astype(np.uint64)]))
            wide.append(ngram_join._wide_bitmap(sets[-1]))
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))]
    batch = pa.record_batch({"a": [a for a, _ in pairs], "b": [b for _, b in pairs], "n": [0] * len(pairs), "size": [len(sets[a]) + len(sets[b]) for a, b in pairs],
                             "left": pa.array([wide[a] for a, _ in pairs], pa.binary()), "right": pa.array([wide[b] for _, b in pairs], pa.binary())})
    may = next(ngram_join._may_rows(80)(iter([batch]))).column("may").to_pylist()
    links = [100 * (both := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (len(sets[a]) + len(sets[b]) - both) for a, b in pairs]
    assert sum(links) > 50 and all(m for m, link in zip(may, links) if link)
    assert sum(m for (a, b), m, link in zip(pairs, may, links) if not link and wide[a] and wide[b]) < 0.05 * len(pairs)
    assert wide[0] is None and all(m for (a, b), m in zip(pairs, may) if wide[a] is None or wide[b] is None)


def test_graph_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


def test_mix_meets_targets(docs):
    rows = mix(docs).collect()
    assert len(rows) == len(ROWS)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    total = sum(len(words(r[1])) for r in ROWS)
    assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * total)
    for v in by.values():
        assert v[0].source_size == sum(r.size for r in v) and v[0].target <= 2 * v[0].source_size
    again = mix(docs.repartition(5)).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in rows) == sorted((r.doc_id or -1, r.taken) for r in again)


def test_fit_is_exact_where_a_subset_is():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        size, count = np.unique(rng.integers(1, 30, 5)), None
        count = rng.integers(1, 4, len(size))
        want = int(rng.integers(0, (size * count).sum() + 1))
        take = fit_counts(size, count, want)
        assert (take >= 0).all() and (take <= count).all()
        floor = (count * (want / (size * count).sum())).astype(int)
        sums = {0}
        for s, n in zip(size, count - floor):
            sums = {x + s * k for x in sums for k in range(n + 1)}
        gap = want - (floor * size).sum()
        assert abs(want - (take * size).sum()) == min(abs(x - gap) for x in sums)


def test_chat_collapse(spark):
    turns = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"),
             (4, 0, "user", None), (5, 0, "user", ""), (6, 1, None, "b"), (6, 1, None, "a"), (None, 0, "user", "lost"), (7, None, "user", "x"), (7, 3, "user", "w")]
    rows = {r.conv_id: r for r in chat.render_maximal(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert set(rows) == {2, 4, 5, 6, 7} and rows[2].n_copies == 2
    assert rows[2].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert rows[7].text.index("w<") < rows[7].text.index("x<")
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.render_maximal(empty).count() == 0


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 256]) for i in range(300)]
    rows += [(301, None), (302, [1.0, None, 0.0, 0.0]), (303, [float("nan")] * 4), (None, [0.1] * 4), (304, [0.5, 0.5]), (350, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 50 = 0"), shard_rows=64, tile_rows=2).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    q = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows[:300]}
    for i in range(0, 300, 50):
        want = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:5]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(want)]
    assert 350 not in got
    assert topk._products(np.array([[2.0 ** 40]]), np.array([[2.0 ** 40]]))[0, 0] == 2 ** 63 - 1


def test_html_lines_and_differencing(spark):
    page = ("<html><head><title>x</title><style>p{}</style></head><body><header>H</header><div class='main-menu'>m</div><p class=ad>buy<p>Real &amp; true<br>\n"
            "text<div id=comments><p>c</div><ul><li>a<li>b</ul><script>if(a<b){}</script>tail<!-- no --></body></html>")
    assert text_lines(page) == [("Real & true text", False), ("a", False), ("b", False), ("tail", False)]
    assert text_lines("<nav>n</nav><article><h1>T</h1><p>x  y</article><footer>f</footer>") == [("T", True), ("x y", True)]
    rows = [(i, f"http://h/{i}", f"<body><p>Boiler<p>own {i}<p>plate</body>") for i in range(5)]
    rows += [(10, None, None), (11, "http://solo/", "<p>alone"), (12, "http://dup/", "<p>twin"), (13, "http://dup/", "<p>twin")]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"own {i}" for i in range(5)}, 10: "", 11: "alone", 12: "twin", 13: "twin"}


def test_html_marked_articles_stay_whole(spark):
    def page(*lines):
        return "<body><nav>n</nav><article>" + "".join(f"<p>{x}" for x in lines) + "</article><footer>f</footer></body>"

    own = {i: [f"{x} of {i}" for x in "abc"] for i in range(1, 6)}
    share, more = "Share this", "Read more"
    texts = [(i, f"http://h/{i}", [share, *x, more]) for i, x in own.items()]
    texts += [(20, "http://copy/1", [share, *own[1], more]), (21, "http://copy/2", [share, *own[1], more]), (22, "http://copy/2", own[1]),
              (22, "http://copy/2", own[1]), (30, "http://near/1", [share, *own[1]]), (31, "http://near/2", [share, *own[1][:2], "new"])]
    rows = [(i, url, page(*x)) for i, url, x in texts] + [(40, "http://none/1", "<nav>n</nav>"), (41, "http://long/1", page(*["line"] * 30_000))]
    want = [(i, "\n".join(x)) for i, _, x in texts] + [(40, ""), (41, "\n".join(["line"] * 30_000))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 7):
        assert sorted((r.page_id, r.text) for r in extract_main_text(df.repartition(parts)).collect()) == sorted(want)


def test_html_differencing_outside_articles(spark):
    """Brute force over the sorted pages: cut lines take part in the alignment, shared open lines are deleted."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        lines = [f"<nav>menu {i % 3}</nav>"] + [f"<p>common {x}" for x in sorted(rng.choice(4, 2, replace=False))] + [f"<p>own {i} {x}" for x in "ab"]
        lines += [f"<p class=ad>buy {rng.integers(3)}", "<p>plate"]
        rows.append((i, f"http://h/{i // 2:03}", f"<body>{''.join(lines if i % 10 != 4 else [*lines, '<article><p>plate<p>art</article>'])}</body>"))
    rows += [(100 + i, "http://h/030", rows[-1][2]) for i in range(5)]
    assert page_lines(rows[0][2])[0] == ("menu 0", 0)
    lines = {i: page_lines(h) for i, _, h in rows}
    can = {i: [(t, r) for t, r in x if r == max(1, *(r for _, r in x))] for i, x in lines.items()}
    runs = [r for n, r in enumerate(rows) if not n or can[r[0]] != can[rows[n - 1][0]]]
    want = {}
    for n, (i, _, _) in enumerate(runs):
        texts, gone = np.array([t for t, _ in lines[i]]), set()
        for m in (n - 1, n + 1):
            if 0 <= m < len(runs):
                gone.update(common_lines(texts, np.array([t for t, _ in lines[runs[m][0]]])))
        top = max(1, *(r for _, r in lines[i]))
        want[i] = "\n".join(t for at, (t, r) in enumerate(lines[i]) if r == top and (r == 2 or at not in gone))
    want |= {100 + i: want[59] for i in range(5)}
    assert any("common" in t for t in want.values()) and want[4] == "plate\nart"
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    assert {r.page_id: r.text for r in extract_main_text(df.repartition(5)).collect()} == want
    empty = extract_main_text(df.limit(0))
    assert empty.columns == ["page_id", "url", "text", "n_chars"] and empty.count() == 0


def test_html_runs_over_many_partitions(spark):
    rows = [(i, f"http://h/{i:03}", f"<p>Boiler<p>{'same' if 20 <= i < 80 else f'own {i}'}<p>plate") for i in range(100)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert got == {i: "same" if 20 <= i < 80 else f"own {i}" for i in range(100)}


@pytest.mark.parametrize("wrap", [
    '<div style="overflow:hidden">{}</div>', '<div title="a hidden gem">{}</div>', '<div data-id="ad">{}</div>', "<div data-role=menu>{}</div>",
    '<div class="with-sidebar">{}</div>', '<div class="has-footer no-ads">{}</div>', "<form id=aspnetForm>{}</form>", '<div id="modal">{}</div>'])
def test_html_articles_are_not_skipped_by_words_in_attributes(wrap):
    article = '<article class="post category-social"><p>T <a href="/hidden-valley">hidden valley</a> <a href="/p?id=comments">said</a></article>'
    assert text_lines(f"<body>{wrap.format(article)}</body>") == [("T hidden valley said", True)]


def test_html_names_are_whole():
    assert text_lines("<form><p>text<label>l</label></form>") == [("text", False)]
    assert text_lines("<div class='x site-footer'>f</div><div id=mainMenu>m</div><p class='lead ad'>a<p HIDDEN>h<p>t") == [("t", False)]
    assert text_lines("<main><p>t</main><div id=comments><article class=comment>c</article></div>") == [("t", True)]
    assert text_lines("<main><p>t<div class=related><article>r</article></div></main>") == [("t", True)]


def test_common_lines_is_longest():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        a, b = rng.integers(0, 6, rng.integers(0, 25)), rng.integers(0, 6, rng.integers(0, 25))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
            row = new
        for cells in (4, 1 << 22):
            at = common_lines(a, b, cells)
            it = iter(b.tolist())
            assert at == sorted(set(at)) and all(any(x == y for y in it) for x in a[at].tolist())
            assert len(at) == row[-1]
        assert _lcs(a.tolist() or [9], b.tolist())[0] == row[-1]


def test_decontamination_finds_copies_and_paraphrases(spark):
    items = [(i, prose(40, 200 + i) + ".") for i in range(20)] + [(90, None), (91, "too short")]
    changed = items[3][1].split()
    changed[5], changed[17], changed[29] = "other", "words", "here"
    rows = [(1, prose(100, 300) + " " + items[2][1].upper() + " " + prose(30, 301)), (2, prose(50, 302) + " " + " ".join(changed)),
            (3, prose(400, 303)), (4, None), (5, ""), (6, items[4][1])]
    got = benchmark_matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 2), (2, 3), (6, 4)]


def test_decontamination_finds_every_copy_in_a_large_benchmark(spark):
    rng = np.random.default_rng(60)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 20_000, 40))) for i in range(1100)]
    rows, want = [], []
    for i, text in items[::11]:
        w = text.split()
        if i % 2:  # a paraphrase
            for at in (5, 17, 29):
                w[at] = "other"
        around = [f"w{x}" for x in rng.integers(0, 20_000, 60)]
        rows.append((i, " ".join(around[:30] + w + around[30:])))
        want.append((i, i))
    got = benchmark_matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == want


def test_decontamination_of_short_and_long_items(spark):
    rng = np.random.default_rng(61)

    def text(n):
        return " ".join(f"w{x}" for x in rng.integers(0, 20_000, n))
    items = [(1, "What is it?"), (2, "Yes."), (3, "?!"), (4, ""), (5, "one two three four five"), (6, "five words of a one"), (7, "five words of a one")]
    long = [(100 + i, text(n)) for i, n in enumerate((49, 59, 100, 300, 500, 500, 1200, 13_000))]
    rows = [(1, f"{text(9)} what is IT {text(9)}"), (2, "what is"), (3, "it ?! what is, it"), (4, "one two three four"), (5, "0 one two three four five"),
            (6, "five words of a one"), (7, "two three four five words of a"), (8, "five words of a")]
    want = [(1, 1), (3, 1), (5, 5), (6, 6), (6, 7)]
    for i, t in long:
        w = t.split()
        rows += [(i, f"{text(200)} {t} {text(200)}"), (1000 + i, " ".join("other" if n % 10 == 3 else x for n, x in enumerate(w))),
                 (2000 + i, " ".join(w[:len(w) // 3]))]
        want += [(i, i), (1000 + i, i)]
    got = benchmark_matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items + long, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(want)
    assert [(r.start, r.stop, r.lcs, r.item_words) for r in got if r.doc_id == 5] == [(1, 6, 5, 5)]


def test_language_model_is_a_distribution():
    net = lm.Net(lm.class_edges(np.arange(10, 0, -1.0), 3), 3)
    net.start(np.arange(1, 12).astype(float), 1)
    s = np.random.default_rng(0).standard_normal((5, 3)).astype(np.float32)
    p = np.stack([np.exp(lm._outputs(net, s, np.full(5, w))[0]) for w in range(11)])
    assert p.sum(axis=0) == pytest.approx(np.ones(5), abs=1e-5)


def test_language_model_gradient():
    net = lm.Net(lm.class_edges(np.arange(6, 0, -1.0), 2), 2)
    net.theta[:] = np.random.default_rng(1).standard_normal(len(net.theta)) * 0.5
    s, x = np.random.default_rng(2).standard_normal((7, 2)).astype(np.float32), np.arange(7) % 7
    grad, steps = np.zeros_like(net.theta), lm.Steps(net, 1.0)

    def keep(name, g, at=slice(None)):
        net.get(name, grad)[at] += g
    steps.move = keep
    lm._outputs(net, s, x, steps)
    for i in range(0, len(net.theta), 3):
        at = net.theta[i]
        net.theta[i] = at + 1e-2
        up = lm._outputs(net, s, x)[0].sum()
        net.theta[i] = at - 1e-2
        down = lm._outputs(net, s, x)[0].sum()
        net.theta[i] = at
        assert grad[i] == pytest.approx(-(up - down) / 2e-2, abs=2e-2)


def test_language_model_counts(spark):
    rows = [(1, "A b b"), (2, "b c"), (3, None), (4, "zz b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(df, F.col("doc_id") != 4, known=2).collect()}
    c = {"a": 1, "b": 3, "c": 1, None: 3}
    for i, t in rows:
        toks = [*(t or "").lower().split(), None]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(toks), sum(w in c for w in toks), 8)
        assert got[i].base_score == pytest.approx(sum(np.log10((c.get(w, 0) + 1) / (8 + 4 + 1)) for w in toks))
        assert got[i].score < 0


def test_language_model_vocabulary_follows_the_corpus(spark):
    """Words that aren't modelled and are equally frequent all score alike."""
    rows = [(i, f"w{i} w{i}") for i in range(2500)]
    probe = [(10_000 + i, f"w{i}") for i in range(2500)]
    df = spark.createDataFrame(rows + probe, "doc_id long, text string")
    got = lm.score(df, F.col("doc_id") < 10_000).where("doc_id >= 10000").select("score").collect()
    assert len({round(r.score, 9) for r in got}) > 2400


def test_language_id_learns(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["the", "and", "which"] if i % 2 else ["und", "nicht", "schön"], 30)), "en" if i % 2 else "de") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    probe = spark.createDataFrame([(1, "which and the", "x"), (2, "SCHÖN und nicht", "x"), (3, None, "x"), (4, "12 %%", "x"), (5, "", "x")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in langid.predict(probe, model).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["en", "de", "und", "und", "und"] and got[1].score > 0.5 and got[3].score == 0
    assert langid.predict(probe, langid.train(df.where("lang is null"))).where("lang_pred <> 'und'").count() == 0


def test_quality_takes_a_bounded_number_of_rows(spark, monkeypatch):
    """Rows of repeated ids and labels don't reach the driver beyond the bound; below it the fit is that of all rows."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((x, y)))
    rows = spark.createDataFrame([(prose(i % 30 + 1, i % 30), i % 2) for i in range(300)] + [("x", 2), (None, 1)], "text string, quality int")
    quality.train(rows)
    monkeypatch.setattr(quality, "MAX_ROWS", 50)
    quality.train(rows.repartition(1))
    quality.train(rows.repartition(7))
    assert [len(y) for _, y in seen] == [301, 50, 50]
    assert np.array_equal(seen[1][0], seen[2][0]) and np.array_equal(seen[1][1], seen[2][1])


def test_quality_learns(spark):
    rows = [(i, " ".join(w + ("%%%" if i % 2 else "") for w in prose(40, i).split()), 1 - i % 2) for i in range(60)]
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string, quality int"))
    probe = spark.createDataFrame([(1, prose(30, 900)), (2, prose(30, 901).replace(" ", "%%% ")), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.classify(probe, model).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0 and got[3].score == got[4].score
    assert quality.fit(np.zeros((0, 3)), np.zeros(0))["start"] == 0.0


@pytest.mark.parametrize("run", [remove_repeated_passages, jaccard_components, mix,
                                 lambda d: lm.score(d, F.lit(True)), lambda d: langid.predict(d, langid.train(d.withColumn("lang", F.lit("x")))),
                                 lambda d: quality.classify(d, quality.train(d.withColumn("quality", F.lit(1))))])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
