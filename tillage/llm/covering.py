"""SimHash near-duplicates by covering locality-sensitive hashing.

Every one of the 64 bit positions gets a non-zero label of ``radius + 1``
bits. A table's mask, one for each non-zero vector v, keeps the positions
whose label has an odd product with v. The labels of at most ``radius``
differing positions cannot span all vectors, so some v is orthogonal to all of
them: its mask keeps none of the differing positions, and the pair collides in
that table. Every pair within the radius meets; no other parameter matters.

Equal fingerprints are one node, so copies cost nothing. A bucket's members
agree on the bits its mask keeps. A bucket of up to ``BUCKET`` nodes is
compared whole and gives a spanning forest of its links. In a larger one every
node goes to its centres, for radius 2 itself and the values one free bit
away: two members within the radius share a centre, and the at most
1 + 64 members of a centre are all within the radius of each other, so a chain
of links through a centre is exact. Components follow by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.llm.graph import components
from tillage.llm.tables import joined_evenly, written
from tillage.llm.words import slices

BITS = 64
BUCKET = 64
CHUNK = 1 << 16
# The fixed primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _xxh64_rows(rows: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of every row of a byte matrix."""
    n, size = rows.shape
    seed, at = np.uint64(seed), 0

    def lane(at: int, width: int, kind: type) -> np.ndarray:
        return np.ascontiguousarray(rows[:, at:at + width]).view(kind)[:, 0].astype(np.uint64)

    def step(acc: np.ndarray, value: np.ndarray) -> np.ndarray:
        return _rotl(acc + value * P2, 31) * P1
    with np.errstate(over="ignore"):
        if size >= 32:
            acc = [np.full(n, s) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            while at + 32 <= size:
                acc = [step(a, lane(at + 8 * i, 8, np.uint64)) for i, a in enumerate(acc)]
                at += 32
            h = sum((_rotl(a, r) for a, r in zip(acc, (1, 7, 12, 18))), np.zeros(n, np.uint64))
            for a in acc:
                h = (h ^ step(np.zeros(n, np.uint64), a)) * P1 + P4
        else:
            h = np.full(n, seed + P5)
        h = h + np.uint64(size)
        while at + 8 <= size:
            h = _rotl(h ^ step(np.zeros(n, np.uint64), lane(at, 8, np.uint64)), 27) * P1 + P4
            at += 8
        if at + 4 <= size:
            h = _rotl(h ^ (lane(at, 4, np.uint32) * P1), 23) * P2 + P3
            at += 4
        while at < size:
            h = _rotl(h ^ (rows[:, at].astype(np.uint64) * P5), 11) * P1
            at += 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of the byte runs ``data[start:start + size]``, those of one length together."""
    out = np.empty(len(start), np.uint64)
    order = np.argsort(size, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(size[order])) + 1, [len(order)]])
    for a, z in zip(cuts[:-1], cuts[1:]):
        if z > a:
            n = int(size[order[a]])
            most = max(1, (8 << 20) // max(n, 1))  # rows of at most 8 MB at once
            for lo in range(a, z, most):
                which = order[lo:min(z, lo + most)]
                out[which] = _xxh64_rows(data[start[which][:, None] + np.arange(n)], seed) if n else _xxh64_rows(np.empty((len(which), 0), np.uint8), seed)
    return out


def _shingle_runs(column, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, text, start, size) of the shingles of all texts in order: lower-cased words, joined by one space."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(column))
    off = words.offsets.to_numpy().astype(np.int64)
    off, flat = off - off[0], words.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    seen = np.concatenate([[0], np.cumsum(full)])
    off, flat = seen[off], flat.filter(pa.array(full))
    size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat.cast(pa.large_string())), pa.scalar(" ", pa.large_string()))
    raw = line.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and len(raw) else np.empty(0, np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    words_of = np.diff(off)
    n = np.where(words_of == 0, 0, np.maximum(words_of - k + 1, 1))
    text = np.repeat(np.arange(len(n)), n)
    first = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + off[text]
    last = np.minimum(first + k, off[text + 1]) - 1
    return data, text, begin[first], begin[last] + size[last] - begin[first]


def _fingerprint_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            data, text, start, size = _shingle_runs(pc.fill_null(b.column("text"), ""), k)
            ones, n = np.zeros((b.num_rows, BITS), np.int64), np.bincount(text, minlength=b.num_rows)
            for lo in range(0, len(text), CHUNK):  # a very long text is counted in pieces
                part = text[lo:lo + CHUNK]
                h = xxh64(data, start[lo:lo + CHUNK], size[lo:lo + CHUNK])
                bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                heads = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1])
                ones[part[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
            packed = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.int64)[:, 0]
            yield pa.record_batch([b.column("id"), pa.array(packed)], names=["id", "fp"])
    return run


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """One mask for each non-zero vector of ``radius + 1`` bits; any ``radius`` positions are all cleared in some mask."""
    labels = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((i % labels + 1) & v).bit_count() & 1) for v in range(1, labels + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest_rows(radius: int):
    """Links of a spanning forest of each bucket's nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            members, a, z = b.column("members"), [], []
            off, flat = members.offsets.to_numpy(), members.values.to_numpy()
            for lo, hi in zip(off[:-1], off[1:]):
                x = flat[lo:hi]
                todo, reached = np.arange(1, len(x)), [0]
                while len(todo):
                    if not reached:
                        reached, todo = [int(todo[0])], todo[1:]
                        continue
                    at = reached.pop()
                    near = np.bitwise_count((x[todo] ^ x[at]).view(np.uint64)) <= radius
                    new, todo = todo[near], todo[~near]
                    reached.extend(new.tolist())
                    a.extend([int(x[at])] * len(new))
                    z.extend(x[new].tolist())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])
    return run


def links_within(nodes: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between the distinct long values ``fp`` whose components are those of all pairs at ``radius`` or fewer differing bits."""
    if not 1 <= radius <= 2:
        raise ValueError("radius must be 1 or 2")
    masks = [_signed(m) for m in covering_masks(radius)]
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    placed = nodes.select("fp", F.inline(tables))
    sizes = placed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size"), F.min("fp").alias("lo")).where("size > 1")
    held = written(placed.join(sizes, ["t", "key"]))
    small = held.where(F.col("size") <= bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("members"))
    found = small.select("members").mapInArrow(_forest_rows(radius), "a long, b long")
    # Centres: the value itself and, for radius 2, every value that differs in one bit the mask leaves free.
    free = F.array(*[F.array(*[F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]]) for m in covering_masks(radius)])
    centred = held.where(F.col("size") > bucket).select("t", "fp", F.explode(free[F.col("t")]).alias("flip"))
    centred = centred.select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
    star = centred.groupBy("t", "centre").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("members"))
    if radius == 1:  # around a centre two values may differ in two bits: only those with the centre itself link
        star = star.where(F.array_contains("members", F.col("centre"))).withColumn("a", F.col("centre"))
    return found.union(star.select("a", F.explode("members").alias("b")).where("a <> b")).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 2) -> DataFrame:
    """(id, fingerprint, component_id, fp) of every row of ``docs``; other columns are ignored.

    A bit of a text's fingerprint is 1 if it is set in over half of the XXH64
    (seed 42) of its k-word shingles, repeats included, A-Z lower-cased, words
    joined by one space; with fewer words the whole sequence is one shingle.
    Null, empty and blank texts have the fingerprint zero and link like any
    other. Rows link at ``radius`` (1 or 2) or fewer differing bits;
    ``component_id`` is the least id reachable. Repeated rows and ids are
    kept as rows; a null id is no least id unless all of a component are
    null. Texts of any length are read whole, in pieces. An empty table gives
    an empty result. ``fp`` is the fingerprint as a long.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    marks = written(texts.mapInArrow(_fingerprint_rows(k), f"id {kind}, fp long"))
    nodes = written(marks.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n_rows")))
    reach = components(links_within(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    known = written(nodes.join(reach, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n_rows"))
    classes = joined_evenly(known.select("fp", "component", F.col("n_rows").alias("rows")), least, ["component"], known.count())
    lookup = written(classes.select("fp", F.col("rows").alias("n_rows"), "component_id"))
    out = joined_evenly(marks, lookup, ["fp"], marks.count())
    return out.select(F.col("id").alias(id_col), _hex(F.col("fp")).alias("fingerprint"), "component_id", "fp")


def _hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
