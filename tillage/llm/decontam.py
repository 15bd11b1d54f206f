"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all documents give the weights.
2. A distributed randomised SVD of the TF-IDF passages of the benchmark gives
   the latent space: every task multiplies its passages with the sketch and
   back, the partial products are summed, and only the small factors are
   orthogonalised on the driver.
3. Every document is cut into overlapping passages at a few lengths; an item
   of the benchmark is looked for at the longest passage that must lie whole
   inside it. Passages with at least ``weight_share`` of their squared weight
   on words of the benchmark are projected, and items whose cosine is at
   least ``cosine`` are candidates.
4. Each candidate is checked on words: the longest common subsequence of item
   and surroundings must hold ``certain`` of the item's words, or ``likely``
   of them where the item's answer (its last sentence, at most eight words)
   stands there in order, too. That catches paraphrases.

Items of more than ``PART_WORDS`` words are looked for by parts of even length
and checked as a whole. Items too short for a passage (under six words) match
where all their words stand in a row.

The benchmark is taken in blocks of ``block_items`` parts, each with its own
latent space. A block never has more parts than its space has directions, so
no part loses some of its vector, however large the benchmark is. The blocks of
about ``PASS_ITEMS`` parts are broadcast together and scored in one pass
over the documents, which bounds the size of the broadcast.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillage.llm.arrays import summed
from tillage.llm.tables import packed, released, shared_value, written
from tillage.llm.words import rolling, slices, split_words, text_of_word, word_hashes

BUCKETS = 1 << 18
LENGTHS = (4, 8, 16, 32)
RANK = 256
PART_WORDS = 48
BLOCK_ITEMS = 256
PASS_ITEMS = 2048
COSINE = 0.35
WEIGHT_SHARE = 0.25
CERTAIN = 0.7
LIKELY = 0.5
ANSWER_WORDS = 8
MARKS = string.punctuation + "“”‘’«»„…–—¿¡"
MATCH = "item_id long, lcs int, item_words int, lcs_share double, cosine double, start long, stop long, answer boolean"


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 18)).astype(np.int64)


def _coded(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, fingerprints and ids of the words, lower-cased and without punctuation at their ends."""
    off, ids, words = split_words(column)
    h = word_hashes(pc.utf8_trim(pc.utf8_lower(words), characters=MARKS))
    return off, h[ids] if len(h) else np.empty(0, np.uint64), ids


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    df = np.zeros(BUCKETS + 1)
    for b in slices(batches, "text"):
        off, h, _ = _coded(b.column("text"))
        pairs = np.unique(text_of_word(off) * BUCKETS + _bucket(h))
        df[:BUCKETS] += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
        df[BUCKETS] += b.num_rows
    return df


def level_of(words: int) -> int:
    """The longest passage that, at half-length steps, must lie whole inside an item of so many words."""
    fits = [x for x in LENGTHS if x + x // 2 <= words]
    return fits[-1] if fits else 0


def _part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's row with its parts of at most PART_WORDS words, all about equally long."""
    for b in slices(batches, "text"):
        parts = []
        for text in b.column("text").to_pylist():
            off, ids, words = split_words(pa.array([text]))
            own = words.take(pa.array(ids)).to_pylist()
            n = max(-(-len(own) // PART_WORDS), 1)
            edges = [len(own) * i // n for i in range(n + 1)]
            parts.append([" ".join(own[a:z]) for a, z in zip(edges, edges[1:])])
        yield pa.record_batch([b.column("item_id"), b.column("text"), b.column("key"), pa.array(parts, pa.list_(pa.string()))],
                              names=["item_id", "text", "key", "parts"])


def _in_a_row(off: np.ndarray, h: np.ndarray, short: dict[int, tuple[np.ndarray, list]]) -> dict[tuple[int, int], tuple]:
    """The first place of each item of ``short`` (by length: sorted fingerprints and numbers) in each text."""
    best: dict[tuple[int, int], tuple] = {}
    doc = text_of_word(off)
    for n, (keys, numbers) in short.items():
        if len(h) < n:
            continue
        runs = rolling(h, n)
        at = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
        for i in np.flatnonzero((keys[at] == runs) & (doc[:len(runs)] == doc[n - 1:])):
            d = int(doc[i])
            for number in numbers[at[i]]:
                best.setdefault((d, number), (1.0, n, 1.0, int(i - off[d]), int(i - off[d]) + n, True))
    return best


def _passage_starts(off: np.ndarray, length: int) -> np.ndarray:
    """Starts of passages every half length, and one that ends with the text (texts at least that long)."""
    size = np.diff(off)
    some = np.flatnonzero(size >= length)
    step = max(length // 2, 1)
    n = (size[some] - length) // step + 1
    starts = np.repeat(off[some], n) + step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return np.unique(np.concatenate([starts, off[some] + size[some] - length]))


def _vectors(words: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Norm of each row's TF-IDF vector (rows of word buckets)."""
    weight = idf[words]
    same = words[:, :, None] == words[:, None, :]
    return np.sqrt((same * weight[:, :, None] * weight[:, None, :]).sum(axis=(1, 2)))


def _latent(items: DataFrame, idf: np.ndarray, columns: np.ndarray, rank: int, seed: int = 11) -> np.ndarray:
    """Right singular vectors (columns x rank) of the items' TF-IDF rows, by randomised range finding."""
    place = np.full(BUCKETS, -1, np.int64)
    place[columns] = np.arange(len(columns))
    width = rank + 8
    q = np.random.default_rng(seed).standard_normal((len(columns), width))
    for _ in range(3):
        q = np.linalg.qr(q)[0]
        shared = items.sparkSession.sparkContext.broadcast(q)

        def task(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            q, out = shared.value, np.zeros((len(columns), shared.value.shape[1]))
            for b in slices(batches, "text"):
                off, h, _ = _coded(b.column("text"))
                at = place[_bucket(h)]
                weight = idf[columns][at][:, None]
                for a, z in zip(off[:-1], off[1:]):
                    if level_of(z - a):
                        x = weight[a:z]
                        norm = max(float((x * x).sum()), 1e-9)
                        np.add.at(out, at[a:z], x * ((x * q[at[a:z]]).sum(axis=0) / norm))
            return out.reshape(-1)

        q = summed(items, task, len(columns) * q.shape[1]).reshape(len(columns), -1)
        shared.destroy()
    u, s, _ = np.linalg.svd(q, full_matrices=False)
    return u[:, :min(rank, int((s > 1e-9 * max(s[0], 1e-30)).sum()))].astype(np.float32)


def _lcs(item: list[int], region: list[int]) -> tuple[int, int, int]:
    """Length of the longest common subsequence (bit-parallel), and the region's first and last matched word."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | (1 << i)
    full, v = (1 << len(item)) - 1, (1 << len(item)) - 1
    first, last, best = -1, 0, 0
    for j, w in enumerate(region):
        m = masks.get(w, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
            got = len(item) - v.bit_count()
            if got > best:
                best, last = got, j + 1
                first = j if first < 0 else first
    return best, max(first, 0), last


def _in_order(needle: list[int], region: list[int]) -> bool:
    n = len(needle)
    return n > 0 and any(region[i:i + n] == needle for i in range(len(region) - n + 1))


def _match_rows(shared, cosine: float, share: float, certain: float, likely: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, asked, spaces, short, items = shared.value
        for b in slices(batches, "text"):
            off, h, _ = _coded(b.column("text"))
            if not len(h):
                continue
            bucket = _bucket(h)
            weight = idf[bucket].astype(np.float32)
            every = np.concatenate([[0], np.cumsum(weight ** 2, dtype=np.float64)])
            some = np.concatenate([[0], np.cumsum(np.where(asked[bucket], weight ** 2, 0), dtype=np.float64)])
            may: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # passages of each length: start, squared weight
            hits: list[tuple[int, int, int, float]] = []
            for place, levels in spaces:
                at = place[bucket]
                known = np.flatnonzero(at >= 0)
                upto = np.concatenate([[0], np.cumsum(at >= 0)])
                for length, (numbers, latent) in levels.items():
                    if length not in may:
                        starts = _passage_starts(off, length)
                        total, part = every[starts + length] - every[starts], some[starts + length] - some[starts]
                        enough = (part >= share * total) & (part > 0)
                        may[length] = starts[enough], total[enough]
                    starts, total = may[length]
                    here = np.flatnonzero(upto[starts + length] > upto[starts])
                    for a in range(0, len(here), 2048):
                        s, norm = starts[here[a:a + 2048]], np.sqrt(total[here[a:a + 2048]])
                        n = upto[s + length] - upto[s]
                        edge = np.cumsum(n) - n
                        pos = known[np.repeat(upto[s] - edge, n) + np.arange(n.sum())]
                        dots = np.add.reduceat(latent[at[pos]] * weight[pos, None], edge, axis=0)
                        near = np.flatnonzero((dots >= cosine * norm[:, None]).any(axis=1))
                        if len(near):  # the true norm: words that repeat within the passage weigh together
                            sims = dots[near] / np.maximum(_vectors(bucket[s[near, None] + np.arange(length)], idf), 1e-9)[:, None]
                            hits.extend((int(numbers[c]), int(s[near[r]]), length, float(sims[r, c])) for r, c in np.argwhere(sims >= cosine))
            yield from _checked(b, off, h, hits, _in_a_row(off, h, short), items, certain, likely)
    return run


def _checked(b, off, h, hits, best, items, certain, likely) -> Iterator[pa.RecordBatch]:
    """``best`` and the candidates of a slice that pass the checks, the best place for each document and item."""
    by_item: dict[tuple[int, int], list] = {}
    for number, start, length, sim in hits:
        doc = int(np.searchsorted(off, start, side="right")) - 1
        by_item.setdefault((doc, number), []).append((start, length, sim))
    for (doc, number), places in by_item.items():
        item_id, item, answer = items[number]
        places.sort()
        words = set(item)
        regions: list[list] = []
        reach = len(item) + len(item) // 4
        for start, length, sim in places:
            a, z = max(int(off[doc]), start + length - reach), min(int(off[doc + 1]), start + reach)
            if regions and a < regions[-1][1]:
                regions[-1][1] = max(regions[-1][1], z)
                regions[-1][2] = max(regions[-1][2], sim)
            else:
                regions.append([a, z, sim])
        for a, z, sim in regions:
            # Windows of 1.5 times the item, so that a long region doesn't collect its words from afar.
            wide = len(item) + len(item) // 2
            for s in range(a, max(a + 1, z - wide + len(item) // 4 + 1), max(len(item) // 4, 1)):
                region = h[s:min(s + wide, z)].tolist()
                if sum(w in words for w in region) < likely * len(item):
                    continue
                n, first, last = _lcs(item, region)
                share = n / len(item)
                if share < likely or share <= best.get((doc, number), (0.0,))[0]:
                    continue
                has = _in_order(answer, region)
                if share >= certain or has:
                    best[(doc, number)] = (share, n, sim, s + first - int(off[doc]), s + last - int(off[doc]), has)
    if best:
        docs = pa.array([d for d, _ in best], pa.int64())
        rows = [(items[i][0], x[1], len(items[i][1]), x[0], x[2], x[3], x[4], x[5]) for (_, i), x in best.items()]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_())
        names = [c.split()[0] for c in MATCH.split(", ")]
        yield pa.record_batch([b.column("text").take(docs), b.column("row").take(docs), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]],
                              names=["text", "row", *names])


def _item(text: str) -> tuple[list[int], list[int]]:
    """Word fingerprints of an item and of its answer: the last sentence of at most ANSWER_WORDS words, at least 3."""
    _, h, _ = _coded(pa.array([text]))
    sentences = [s for s in re.split(r"(?<=[.?!])\s+", text.strip()) if s]
    last = len(sentences[-1].split()) if sentences else 0
    n = min(max(last, 3), ANSWER_WORDS, len(h))
    return h.tolist(), h[len(h) - n:].tolist()


def _space(lines: DataFrame, parts: list[tuple[int, list[int]]], idf: np.ndarray) -> tuple[np.ndarray, dict]:
    """The latent space of a block of parts (item number, words): each bucket's row in it, and by passage length the numbers and products."""
    buckets = [_bucket(np.array(words, np.uint64)) for _, words in parts]
    columns = np.unique(np.concatenate(buckets))
    v = _latent(lines, idf, columns, len(parts))
    place = np.full(BUCKETS, -1, np.int32)
    place[columns] = np.arange(len(columns))
    levels = {}
    for length in LENGTHS:
        some = [i for i, (_, words) in enumerate(parts) if level_of(len(words)) == length]
        if some:
            latent = np.stack([(v[place[buckets[i]]] * idf[buckets[i]][:, None]).sum(axis=0) for i in some])
            norm = np.array([_vectors(buckets[i][None, :], idf)[0] for i in some])
            # What one occurrence of a word adds to a passage's product with each part in the latent space.
            levels[length] = (np.array([parts[i][0] for i in some]), (v @ (latent / np.maximum(norm, 1e-9)[:, None]).T).astype(np.float32))
    return place, levels


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                      item_text_col: str = "text", cosine: float = COSINE, certain: float = CERTAIN, likely: float = LIKELY,
                      weight_share: float = WEIGHT_SHARE, rank: int = RANK, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row per (row of ``docs``, benchmark item) that the document leaks.

    All columns of ``docs`` and: ``item_id``, ``lcs`` (common words in order),
    ``item_words``, ``lcs_share``, ``cosine``, ``start``/``stop`` (word
    positions of the match) and ``answer`` (the item's answer stands there).
    Input columns of these names are replaced. Words are lower-cased and lose
    punctuation at their ends. Null and empty texts match nothing, nor do items without a letter, digit or other
    sign than punctuation. Items of fewer than six words match only word for word. Items with the same text match alike;
    repeated document rows match as often as they stand there; empty tables
    give an empty result.
    """
    names = [c.split()[0] for c in MATCH.split(", ")]
    text, row, back = packed(docs, text_col, tuple(names))
    texts = docs.select(text, row)
    schema = T.StructType([*texts.schema.fields, *T._parse_datatype_string(MATCH).fields])
    spark = docs.sparkSession
    lines = benchmark.select(F.col(f"`{item_id_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text")).where(
        "text is not null")
    out = spark.createDataFrame([], schema)
    cut = lines.withColumn("key", F.monotonically_increasing_id())
    cut = written(cut.mapInArrow(_part_rows, T.StructType([*cut.schema.fields, T.StructField("parts", T.ArrayType(T.StringType()))])))
    passes = -(-(cut.agg(F.sum(F.size("parts"))).first()[0] or 0) // PASS_ITEMS)
    if not passes:
        return out.select(*back, *names)
    df = summed(texts.select("text"), _document_frequency, BUCKETS + 1)
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 0.05
    asked = summed(lines.select("text"), _document_frequency, BUCKETS + 1)[:BUCKETS] > 0
    # All parts of an item are in one pass, so that it is checked once.
    dealt = cut.withColumn("pass", F.pmod(F.xxhash64("item_id", "text", "key"), F.lit(passes)))
    nth = F.row_number().over(Window.partitionBy("pass").orderBy("item_id", "key", "place")) - 1
    parts = written(dealt.select("pass", "item_id", "key", F.posexplode("parts").alias("place", "text"))
                    .withColumn("block", F.floor(nth / F.lit(min(block_items, rank)))))
    for number in range(passes):
        rows = dealt.where(F.col("pass") == number).select("key", "item_id", "text").orderBy("item_id", "key").collect()
        held = [(r.item_id, *_item(r.text)) for r in rows]
        number_of = {r.key: i for i, r in enumerate(rows)}
        part = parts.where(F.col("pass") == number)
        spaces, blocks = [], {}
        for r in part.select("block", "key", "text").orderBy("block", "item_id", "key", "place").collect():
            words = _item(r.text)[0]
            if level_of(len(words)):
                blocks.setdefault(r.block, []).append((number_of[r.key], words))
        for block, own in blocks.items():
            spaces.append(_space(part.where(F.col("block") == block).select("text"), own, idf))
        short: dict[int, dict] = {}
        for i, (_, words, _) in enumerate(held):
            if any(words) and not level_of(len(words)):  # 0 is the word of which only punctuation was there
                short.setdefault(len(words), {}).setdefault(rolling(np.array(words, np.uint64), len(words))[0], []).append(i)
        short = {n: (np.array(sorted(x), np.uint64), [x[key] for key in sorted(x)]) for n, x in short.items()}
        if spaces or short:
            shared = shared_value(spark, (idf, asked, spaces, short, held))
            out = out.unionByName(texts.mapInArrow(released(_match_rows(shared, cosine, weight_share, certain, likely)), schema))
    return out.select(*back, *names)
