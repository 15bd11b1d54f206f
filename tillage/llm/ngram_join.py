"""N-gram Jaccard join: size-aware heavy-light join on word-shingle sets.

Sets are ordered by (estimated corpus frequency, fingerprint), one order for
all sets, rare first. Two sets with Jaccard >= t share at least ``l`` of their
first ``n - ceil(t * n) + l`` shingles. *Light* sets (fewer shingles than the
boundary) therefore meet in a common 2-subset of that prefix (``l = 2``); the
subsets are enumerated. *Heavy* sets, and light sets that may link with a heavy
one, meet in the inverted list of one prefix shingle (``l = 1``). The boundary
is the size at which enumerating stops being cheaper than scanning, by a cost
model over the measured sizes and list lengths.

Equal sets are one node, so copies cost nothing. Members of a list are
compared by a bitmap of the parities of their shingles, whose difference bounds
the overlap from above, so no link is lost. Large lists are dealt as pairs of
blocks. A block pair does not emit its pairs: it emits a spanning forest of
the possible links, which is verified on the whole sets. Where a forest link
proves false, the possible links between what is still apart are all verified.
So every link between different texts is either verified or implied by
verified ones. The bitmap of a large set is nearly full and bounds little, so
before the sets are shipped, pairs of large sets pass a second bitmap whose
size follows the set. Components follow by star contraction.

The frequency estimate is a counting sketch of fixed size; it only sets the
order, and any order gives the same result. Shingles and sets are compared by
64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillage.llm.graph import components
from tillage.llm.tables import dropped, parts_for, recorded, released, shared_value, written
from tillage.llm.words import mix, rolling, slices, split_words, text_of_word, word_hashes

SKETCH_BITS = 19
SKETCH_BLOCKS = 64
BITMAP = 2048
WIDE = 2
BLOCK = 256
SCAN_COST = 0.005
_LIGHT = "row_key long, node long, n long, prefix array<long>, scan double, bitmap binary, wide binary"


def shingles(column, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, fingerprint) of each text's k-word shingles, repeats included; a shorter text is one shingle."""
    off, ids, words = split_words(column, lower=True)
    h = word_hashes(words)[ids]
    doc = text_of_word(off)
    r = rolling(h, k)
    inside = doc[:len(r)] == doc[k - 1:] if len(r) else np.empty(0, bool)
    docs, values = [doc[:len(r)][inside]], [r[inside]]
    size = np.diff(off)
    for length in range(1, k):
        short = np.flatnonzero(size == length)
        if len(short):
            docs.append(short)
            values.append(mix(rolling(h, length)[off[short]] + np.uint64(length)))
    return np.concatenate(docs), np.concatenate(values)


def distinct_shingles(column, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`shingles`, each once per text, ordered by text and value."""
    doc, value = shingles(column, k)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    if len(doc):
        keep = np.concatenate([[True], (np.diff(doc) != 0) | (value[1:] != value[:-1])])
        doc, value = doc[keep], value[keep]
    return doc, value


def _sketch_rows(k: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << bits, np.int64)
        for b in slices(batches, "text"):
            value = shingles(b.column("text"), k)[1]
            count += np.bincount((value >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if count.any():
            parts = count.astype(np.uint32).reshape(SKETCH_BLOCKS, -1)
            yield pa.record_batch([pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                                  names=["block", "counts"])
    return run


def _sketch_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for block, raw in zip(b.column("block").to_pylist(), b.column("counts")):
            x = np.frombuffer(raw.as_buffer(), np.uint32).astype(np.int64)
            total[block] = total[block] + x if block in total else x
    if total:
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(
            [np.minimum(x, (1 << 32) - 1).astype(np.uint32).tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])


def frequency_sketch(docs: DataFrame, k: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Counts of shingles by the leading ``bits`` of their fingerprint: 2**bits numbers, whatever the corpus."""
    rows = docs.mapInArrow(released(_sketch_rows(k, bits)), "block int, counts binary")
    sums = rows.repartition(SKETCH_BLOCKS, "block").mapInArrow(_sketch_sums, "block int, counts binary").collect()
    out = np.zeros((SKETCH_BLOCKS, (1 << bits) // SKETCH_BLOCKS), np.uint32)
    for r in sums:
        out[r.block] = np.frombuffer(r.counts, np.uint32)
    return out.reshape(-1)


def _wide_bitmap(value: np.ndarray) -> bytes | None:
    """Parities of a large set's shingles in ``WIDE`` bits a shingle or more; half of it, folded, is the bitmap of half the size."""
    if WIDE * len(value) <= BITMAP:
        return None
    bits = 1 << (WIDE * len(value) - 1).bit_length()
    bit = (value % np.uint64(bits)).astype(np.int64)
    out = np.zeros(bits // 8, np.uint8)
    np.bitwise_xor.at(out, bit >> 3, (128 >> (bit & 7)).astype(np.uint8))
    return out.tobytes()


def _light_rows(k: int, percent: int, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sketch.value
        bits = int(len(table)).bit_length() - 1
        # A counter holds its shingle's count and the mean load of all others, give or take its spread.
        noise = float(table.mean())
        clear = noise + 4 * noise ** 0.5
        for b in slices(batches, "text"):
            rows = b.num_rows
            doc, value = distinct_shingles(b.column("text"), k)
            n = np.bincount(doc, minlength=rows)
            off = np.concatenate([[0], np.cumsum(n)])
            freq = table[(value >> np.uint64(64 - bits)).astype(np.int64)]
            order = np.lexsort((freq, doc))  # stable: equal frequencies stay in fingerprint order
            ranked, cost = value[order], np.where(freq[order] > clear, freq[order] - noise, 0)
            need = -(-percent * n // 100)
            take = np.where(n > 0, np.minimum(n - need + 2, n), 0)  # one more than a single shared shingle asks for
            at = np.repeat(off[:-1], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
            po = np.concatenate([[0], np.cumsum(take)])
            scan = np.concatenate([[0], np.cumsum(cost[at])])
            node = np.zeros(rows, np.uint64)
            np.add.at(node, doc, mix(value))
            node = mix(node + n.astype(np.uint64))
            bit = (value % np.uint64(BITMAP)).astype(np.int64)
            bitmap = np.zeros((rows, BITMAP // 8), np.uint8)
            np.bitwise_xor.at(bitmap.reshape(-1), doc * (BITMAP // 8) + (bit >> 3), (128 >> (bit & 7)).astype(np.uint8))
            yield pa.record_batch([
                b.column("row_key"), pa.array(node.view(np.int64)), pa.array(n),
                pa.ListArray.from_arrays(pa.array(po.astype(np.int32)), pa.array(ranked[at].view(np.int64))),
                pa.array(scan[po[1:]] - scan[po[:-1]]),
                pa.array([x.tobytes() for x in bitmap], pa.binary()),
                pa.array([_wide_bitmap(value[a:z]) for a, z in zip(off[:-1], off[1:])], pa.binary())],
                names=["row_key", "node", "n", "prefix", "scan", "bitmap", "wide"])
    return run


def boundary(light: DataFrame, percent: int) -> int:
    """Size below which enumerating 2-subsets costs less than scanning inverted lists.

    Cost of a set: the rows it makes and the list entries it meets. With
    2-subsets it makes C(p + 1, 2) rows and meets few others; with lists it
    makes p rows and meets the estimated frequency of each prefix shingle, a
    vectorised comparison each (``SCAN_COST``, in rows).
    """
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.05)))
    p = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    rows = (light.where("n > 0").groupBy(step.alias("step"))
            .agg(F.min("n").alias("low"), F.sum(p * (p + 1) / 2).alias("subsets"), F.sum(p + F.lit(SCAN_COST) * F.col("scan")).alias("lists"))
            .orderBy("step").collect())
    best, cost = 1, sum(r.lists for r in rows)
    least = cost
    for i, r in enumerate(rows):
        cost += float(r.subsets) - float(r.lists)
        if cost < least:
            least, best = cost, int(rows[i + 1].low) if i + 1 < len(rows) else int(r.low * 2 + 2)
    return best


def _keys(light: DataFrame, percent: int, x: int) -> DataFrame:
    """(key, node): 2-subsets of light sets; prefix shingles of sets that are heavy or may link with a heavy one."""
    p = (F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1).cast("int")
    pairs = F.expr("flatten(transform(prefix, (u, i) -> transform(slice(prefix, i + 2, size(prefix)), v -> xxhash64(u, v))))")
    one = F.transform(F.slice("prefix", F.lit(1), p), lambda u: F.xxhash64(u))
    # A set of one shingle has no 2-subset; equal sets are one node already.
    light_keys = F.when((F.col("n") < x) & (F.col("n") > 1), pairs).otherwise(F.array().cast("array<long>"))
    heavy_keys = F.when(F.col("n") * 100 >= F.lit(x * percent), one).otherwise(F.array().cast("array<long>"))
    return light.where("n > 1").select("node", F.explode(F.concat(light_keys, heavy_keys)).alias("key"))


def _possible(n: np.ndarray, bits: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Matrix of the pairs of members a x b that may link: sizes and the bitmap's bound on the overlap."""
    out = np.zeros((len(a), len(b)), bool)
    for i, u in enumerate(a):
        size = n[u] + n[b]
        apart = np.bitwise_count(bits[u] ^ bits[b]).sum(axis=1, dtype=np.int64)
        overlap = (size - apart) // 2
        out[i] = (100 + percent) * overlap >= percent * size
    return out


def _forest(may: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix of possible links."""
    edges, fresh = [], np.ones(len(may), bool)
    for root in range(len(may)):
        if not fresh[root]:
            continue
        fresh[root] = False
        queue = [root]
        while queue:
            u = queue.pop()
            new = np.flatnonzero(may[u] & fresh)
            fresh[new] = False
            edges.extend((u, int(v)) for v in new)
            queue.extend(new.tolist())
    return edges


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal ``by`` columns, whole, from sorted batches."""
    rest: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        cols = [t.column(c).to_numpy() for c in by]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for a, z in zip([0, *cut[:-1]], cut):
            yield t.slice(int(a), int(z - a))
        rest = t.slice(int(cut[-1])) if len(cut) else t
    if rest is not None:
        yield rest


def _link_rows(percent: int, all_apart: bool):
    """Possible links of each block pair: a spanning forest, or all between nodes of different labels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for g in _groups(batches, ["key", "i", "j"]):
            if g.num_rows < 2:
                continue
            key, i, j = (g.column(c)[0].as_py() for c in ("key", "i", "j"))
            node, first = np.unique(g.column("node").to_numpy(), return_index=True)
            if len(node) < 2:
                continue
            n, own = g.column("n").to_numpy()[first], g.column("own").to_numpy()[first]
            raw = g.column("bitmap").combine_chunks()
            bits = np.stack([np.frombuffer(raw[int(f)].as_buffer(), np.uint64) for f in first])
            every = np.arange(len(node))
            may = _possible(n, bits, every, every, percent)
            np.fill_diagonal(may, False)
            if i != j:
                may &= own[:, None] != own[None, :]
            if all_apart:
                label = g.column("label").to_numpy()[first]
                may &= label[:, None] != label[None, :]
                links = np.argwhere(np.triu(may)).tolist()
            else:
                links = _forest(may)
            out.extend((key, i, j, min(int(node[u]), int(node[v])), max(int(node[u]), int(node[v]))) for u, v in links)
            if len(out) > 50_000:
                yield _link_batch(out)
                out = []
        if out:
            yield _link_batch(out)
    return run


def _link_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "i", "j", "a", "b"])


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            doc, value = distinct_shingles(b.column("text"), k)
            off = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b.num_rows))])
            yield pa.record_batch([b.column("node"), pa.array(np.diff(off)), pa.array([value[a:z].tobytes() for a, z in zip(off[:-1], off[1:])], pa.binary())],
                                  names=["node", "n", "items"])
    return run


def _may_rows(percent: int):
    """Whether a pair may link by its sets' wide bitmaps, the larger folded to the size of the other; a pair without both may."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            may = []
            for x, y, size in zip(b.column("left"), b.column("right"), b.column("size").to_pylist()):
                if not (x.is_valid and y.is_valid):
                    may.append(True)
                    continue
                u, v = sorted((np.frombuffer(c.as_buffer(), np.uint64) for c in (x, y)), key=len)
                while len(v) > len(u):
                    v = v[:len(v) // 2] ^ v[len(v) // 2:]
                overlap = (size - int(np.bitwise_count(u ^ v).sum(dtype=np.int64))) // 2
                may.append((100 + percent) * overlap >= percent * size)
            yield pa.record_batch([b.column("a"), b.column("b"), b.column("n"), pa.array(may, pa.bool_())], names=["a", "b", "n", "may"])
    return run


def _verify_rows(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("left"), b.column("right")):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.record_batch([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])
    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs``: all its columns, ``n_shingles``, ``component`` and ``component_id``.

    ``component_id`` is the least id among the rows reachable by links;
    ``component`` is an internal key of the same classes (null for rows
    without shingles, which link with nothing and have their own id).
    Texts are lower-cased (A-Z) and cut into k-word shingles; a text of
    fewer words is one shingle; null, empty and blank texts have none.
    Input columns with these names are replaced. Equal texts, and different
    texts with equal sets, are one class. Repeated rows and repeated ids are
    kept as rows. Null ids count as larger than all others. An empty table
    gives an empty result. ``percent`` is the least Jaccard similarity.
    """
    spark = docs.sparkSession
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    keep = [c for c in docs.columns if c not in ("n_shingles", "component", "component_id")]
    cols = [F.col(f"`{c}`") for c in keep]
    row_key = F.xxhash64(*[c for c, name in zip(cols, keep) if not isinstance(docs.schema[name].dataType, T.MapType)])
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    texts = docs.select(row_key.alias("row_key"), text)

    with recorded() as tables:
        sketch = shared_value(spark, frequency_sketch(texts.select("text"), k))
        light = written(texts.mapInArrow(released(_light_rows(k, percent, sketch)), _LIGHT))
        fat = tables[-1]
        nodes = written(light.select("node", "n", "prefix", "scan", "bitmap", "wide").dropDuplicates(["node"]), free=True)
        light = written(light.select("row_key", "node", "n"))
        dropped(spark, [fat])
        x = boundary(nodes, percent)
        keys = _keys(nodes, percent, x)
        shared = (keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("size"))
                  .where("lo <> hi").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
        fat = tables[-2]
        bitmaps = written(nodes.select("node", "n", "bitmap", "wide"))
        own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
        members = (keys.join(shared, "key").select("key", "node", own.alias("own"), "blocks").distinct()  # a set may hold a key twice
                   .select("key", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
                   .select("key", "node", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
        members = written(members, free=True)
        rows = members.count()
        dropped(spark, [fat])  # the prefixes are read no more
        parts = parts_for(spark, rows, 200_000)

        def links(found: DataFrame, all_apart: bool) -> DataFrame:
            dealt = found.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
            return dealt.mapInArrow(released(_link_rows(percent, all_apart)), "key long, i int, j int, a long, b long")

        slim = bitmaps.drop("wide")
        forest = written(links(members.join(slim, "node"), False), free=True)

        def verified(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
            with_left = pairs.join(left.select(F.col("node").alias("a"), F.col("items").alias("left")), "a")
            with_both = with_left.join(right.select(F.col("node").alias("b"), F.col("items").alias("right")), "b")
            return with_both.select("a", "b", "left", "right").mapInArrow(released(_verify_rows(percent)), "a long, b long, ok boolean")

        def checked(pairs: DataFrame) -> DataFrame:
            """(a, b, ok) of distinct pairs; only the sets of pairs that their wide bitmaps let pass are made."""
            one, two = ([F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(side)] for c, side in (("a", "left"), ("b", "right")))
            with_wide = pairs.join(bitmaps.select(*one), "a").join(bitmaps.select(*two), "b")
            sieved = written(with_wide.select("a", "b", F.col("n_a").alias("n"), (F.col("n_a") + F.col("n_b")).alias("size"), "left", "right").mapInArrow(
                released(_may_rows(percent)), "a long, b long, n long, may boolean"), free=True)
            may = sieved.where("may").drop("may")
            involved = may.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            chosen = light.groupBy("node").agg(F.min("row_key").alias("row_key")).join(involved, "node", "left_semi")
            # A node's row key is that of its text, so copies go where the join has put them.
            sets = written(texts.join(chosen, "row_key").dropDuplicates(["row_key"]).select("node", "text").mapInArrow(
                released(_set_rows(k)), "node long, n long, items binary"), free=True)
            made = tables[-1]
            # A pair ships a set, so pairs are verified by pieces (i, j) of both sides: on disk are two pieces of the sets
            # and with the pairs no more shingles than half of what the sets hold.
            shipped, held = (x.agg(F.sum("n")).first()[0] or 0 for x in (may, sets))
            side = max(1, ceil((2 * shipped / max(1, held)) ** 0.5))
            piece = {c: F.pmod(F.xxhash64(c, F.lit(3)), F.lit(side)) for c in ("a", "b", "node")}
            told = [written(verified(may.where((piece["a"] == i) & (piece["b"] == j)).select("a", "b"), sets.where(piece["node"] == i),
                                     sets.where(piece["node"] == j)), free=True) for i in range(side) for j in range(side)]
            dropped(spark, [made])
            return reduce(DataFrame.unionByName, told, sieved.where("not may").select("a", "b", F.lit(False).alias("ok")))

        known = checked(written(forest.select("a", "b").distinct(), free=True))
        true_links = known.where("ok").select("a", "b")
        broken = forest.join(known.where("not ok"), ["a", "b"], "left_semi").select("key", "i", "j").distinct()
        if known.where("not ok").limit(1).count():
            label = components(true_links)
            again = (members.join(broken, ["key", "i", "j"], "left_semi").join(slim, "node")
                     .join(label, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"))
            more = written(links(again, True).select("a", "b").distinct().join(known, ["a", "b"], "left_anti"), free=True)
            true_links = true_links.union(checked(more).where("ok").select("a", "b"))
        reach = components(true_links)

        classes = light.select("row_key", "node", "n").distinct().join(reach, "node", "left").select(
            "row_key", F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("component"))
        classes = written(classes)
    dropped(spark, tables[:-1])  # the result is read from the last one, the classes
    keyed = docs.select(*cols, row_key.alias("__row_key"))
    ids = (docs.select(row_key.alias("row_key"), F.col(f"`{id_col}`").alias("id")).distinct().join(classes, "row_key")
           .where("component is not null").groupBy("component").agg(F.min("id").alias("least")))
    told = classes.join(ids, "component", "left").select("row_key", "n_shingles", "component", "least")
    return (keyed.join(told, keyed["__row_key"] == told["row_key"])
            .select(*cols, "n_shingles", "component",
                    F.when(F.col("component").isNull(), F.col(f"`{id_col}`")).otherwise(F.col("least")).alias("component_id")))
