"""Substring dedup by repeated-phrase automata.

1. *Confirm* the recurring windows of ``window`` words. Each window is
   represented by one of its ``seed``-word phrases, the one of least
   fingerprint (so equal windows have equal representatives, at equal
   places); only windows whose representative occurs twice or more in the
   corpus can recur, and only their fingerprints are counted. Both censuses
   are aggregations keyed by fingerprint, so a passage shared by a third of
   all documents is a few counted rows, not a group.
2. *Compile*: documents are dealt to shards by a hash of the row (not of the
   text, so copies spread). The recurring windows that occur in a shard are
   merged into passages, and seed phrases at every ``window - seed + 1``-th
   word of each passage go into the shard's Aho-Corasick automaton: every
   window of a passage holds one of these seeds whole.
3. *Stream* every document of the shard through its automaton. Of the windows
   that hold a found seed whole, those that recur are removed.

Phrases are compared as text by the automaton; the equality of windows rests
on 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillage.llm.tables import packed, parts_for, released, written
from tillage.llm.words import mix, rolling, run_starts, slices, sliding_min, split_words, text_array, word_hashes

SHARD_BYTES = 16 << 20
WINDOW = 35
SEED = 8
OUTPUT = ("n_words", "n_removed", "removed_spans", "kept_text")
_ROWS = "shard int, value long, n int"
_PLACE = np.uint64((1 << 24) - 1)


def _hashed(column) -> tuple[np.ndarray, np.ndarray]:
    off, ids, words = split_words(column)
    return off, word_hashes(words)[ids]


def _representatives(off: np.ndarray, h: np.ndarray, window: int, seed: int):
    """Starts of all windows, and for each the place and value of its representative phrase."""
    starts = run_starts(off, window)
    phrases = rolling(h, seed)
    if not len(starts):
        return starts, starts, phrases
    # The place breaks ties to the left and is read back from the low bits. A slice with more
    # words than 24 bits can number holds one very long text; it takes the direct path.
    if len(phrases) <= int(_PLACE):
        tagged = (phrases & ~_PLACE) | np.arange(len(phrases), dtype=np.uint64)
        place = (sliding_min(tagged, window - seed + 1)[starts] & _PLACE).astype(np.int64)
    else:
        high = phrases & ~_PLACE
        place = np.empty(len(starts), np.int64)
        view = np.lib.stride_tricks.sliding_window_view(high, window - seed + 1)
        for a in range(0, len(starts), 1 << 16):
            part = starts[a:a + (1 << 16)]
            place[a:a + (1 << 16)] = part + view[part].argmin(axis=1)
    return starts, place, phrases


def _distinct_rows(shard: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((value, shard))
    shard, value = shard[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(shard) != 0) | (value[1:] != value[:-1])])) if len(value) else order
    n = np.diff(np.concatenate([first, [len(value)]]))
    return pa.record_batch([pa.array(shard[first].astype(np.int32)), pa.array(value[first].view(np.int64)),
                            pa.array(np.minimum(n, 2).astype(np.int32))], names=["shard", "value", "n"])


def _phrase_rows(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            off, h = _hashed(b.column("text"))
            starts, place, phrases = _representatives(off, h, window, seed)
            if len(starts):
                used = np.unique(place)
                text = np.searchsorted(off, used, side="right") - 1
                yield _distinct_rows(b.column("shard").to_numpy()[text].astype(np.int64), phrases[used])
    return run


def _collect(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, list[pa.RecordBatch]]:
    """The known values (packed, in rows without a document) and the documents of one shard."""
    known, docs = [], []
    for b in batches:
        is_doc = b.column("row").is_valid()
        known.extend(np.frombuffer(x.as_buffer(), np.int64) for x in b.column("known").filter(pc.invert(is_doc)))
        if pc.any(is_doc).as_py():
            docs.append(b.filter(is_doc))
    return np.unique(np.concatenate(known)) if known else np.empty(0, np.int64), docs


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values of a batch, packed by shard: a row of eight-byte numbers costs less in a shuffle than a row for each."""
    for b in batches:
        if b.num_rows:
            yield _by_shard(b.column("shard").to_numpy(), b.column("value").to_numpy())


def _by_shard(shard: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(shard, kind="stable")
    shard, value = shard[order], value[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
    return pa.record_batch([pa.array(shard[cut[:-1]].astype(np.int32)), pa.array([value[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])], pa.binary())],
                           names=["shard", "known"])


def _is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted ``known``; a table of their low bits spares most searches."""
    found = np.zeros(len(values), bool)
    if len(known) and len(values):
        low = (1 << (8 * len(known)).bit_length()) - 1
        table = np.zeros(low + 1, bool)
        table[known & low] = True
        may = np.flatnonzero(table[values & low])
        at = np.searchsorted(known, values[may])
        at[at == len(known)] = 0
        found[may] = known[at] == values[may]
    return found


def _window_rows(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs = _collect(batches)
        shards, values = [], []
        for b in slices(iter(docs), "text"):
            off, h = _hashed(b.column("text"))
            starts, place, phrases = _representatives(off, h, window, seed)
            if not len(starts):
                continue
            starts = starts[_is_in(phrases[place].view(np.int64), known)]
            text = np.searchsorted(off, starts, side="right") - 1
            shards.append(b.column("shard").to_numpy()[text].astype(np.int32))
            values.append(rolling(h, window)[starts])
        if shards:
            yield _distinct_rows(np.concatenate(shards), np.concatenate(values))
    return run


def _keep_recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the values that occur twice or more; a partition holds all rows of its values."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    shard, value, n = (np.concatenate([b.column(c).to_numpy() for b in rows]) for c in ("shard", "value", "n"))
    order = np.argsort(value, kind="stable")
    shard, value, n = shard[order], value[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    total = np.add.reduceat(n.astype(np.int64), first)
    keep = np.repeat(total >= 2, np.diff(np.concatenate([first, [len(value)]])))
    if keep.any():
        yield _by_shard(shard[keep], value[keep])


def _seeds(batches: list[pa.RecordBatch], known: np.ndarray, window: int, seed: int) -> ahocorasick.Automaton:
    """The automaton of the seed phrases of a shard's passages.

    Passages: the first occurrence in the shard of each recurring window, merged where they follow each other."""
    automaton, met, stride = ahocorasick.Automaton(), np.zeros(len(known), bool), window - seed + 1
    for b in batches:
        off, ids, words = split_words(b.column("text"))
        starts = run_starts(off, window)
        if not len(starts):
            continue
        value = rolling(word_hashes(words)[ids], window)[starts].view(np.int64)
        hit = _is_in(value, known)
        starts, at = starts[hit], np.searchsorted(known, value[hit])
        at, first = np.unique(at, return_index=True)
        fresh = ~met[at]
        met[at] = True
        new = np.sort(starts[first[fresh]])
        if not len(new):
            continue
        text = np.searchsorted(off, new, side="right")
        cut = np.flatnonzero((np.diff(new) != 1) | (np.diff(text) != 0)) + 1
        places = np.concatenate([np.arange(s[0], s[-1] + window - seed + 1, stride) for s in np.split(new, cut)])
        flat = words.take(pa.array(ids[(places[:, None] + np.arange(seed)).reshape(-1)]))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, seed), pa.int32()), flat)
        for phrase in pc.unique(pc.binary_join(lists, " ")).to_pylist():
            automaton.add_word(f" {phrase} ", len(phrase) + 2)
    automaton.make_automaton()
    return automaton


def _covered(automaton: ahocorasick.Automaton, known: np.ndarray, column, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of the texts' words, starts, stops): the maximal runs of words, counted through all texts, that recurring windows cover.

    The automaton finds the seeds; of the windows that hold a seed whole, those that recur cover their words."""
    off, ids, words = split_words(column)
    n, none = int(off[-1]), np.empty(0, np.int64)
    if not len(automaton) or n < window:
        return off, none, none
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(off, pa.int32()), words.take(pa.array(ids))), " ")
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)[ids] + 1
    begin = np.cumsum(size) - size
    seen = []
    for i in np.flatnonzero(np.diff(off) >= window):
        base = int(begin[off[i]]) + 1
        seen.extend([base + end - length for end, length in automaton.iter(f" {lines[i].as_py()} ")])
    if not seen:
        return off, none, none
    at = np.searchsorted(begin, np.array(seen, np.int64))
    text = np.searchsorted(off, at, side="right") - 1
    first, last = np.maximum(at - (window - seed), off[text]), np.minimum(at, off[text + 1] - window)
    near = np.zeros(n + 1, np.int64)
    some = last >= first
    np.add.at(near, first[some], 1)
    np.add.at(near, last[some] + 1, -1)
    starts = np.flatnonzero(np.cumsum(near)[:n] > 0)
    value = rolling(word_hashes(words)[ids], window)[starts].view(np.int64)
    starts = starts[_is_in(value, known)]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    inside = (np.cumsum(edge)[:n] > 0).astype(np.int8)
    text_start = np.zeros(n, bool)
    text_start[off[:-1][off[:-1] < n]] = True
    before = np.concatenate([[0], inside[:-1]])
    begins = np.flatnonzero((inside == 1) & ((before == 0) | text_start))
    after = np.concatenate([inside[1:], [0]])
    stops = np.flatnonzero((inside == 1) & ((after == 0) | np.concatenate([text_start[1:], [True]]))) + 1
    return off, begins, stops


def _locate(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs = _collect(batches)
        docs = list(slices(iter(docs), "text"))
        automaton = _seeds(docs if len(known) else [], known, window, seed)
        for b in docs:
            off, start, stop = _covered(automaton, known, b.column("text"), window, seed)
            text = np.searchsorted(off, start, side="right") - 1
            lists = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=b.num_rows))])
            gone = np.concatenate([[0], np.cumsum(stop - start)])
            spans = pa.StructArray.from_arrays([pa.array(start - off[text]), pa.array(stop - off[text])], ["start", "stop"])
            yield pa.record_batch([b.column("text"), b.column("row"), pa.array(np.diff(off)), pa.array(gone[lists[1:]] - gone[lists[:-1]]),
                                   pa.ListArray.from_arrays(pa.array(lists, pa.int32()), spans)], names=["text", "row", *OUTPUT[:3]])
    return run


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kept words of each text, joined by one space."""
    for b in slices(batches, "text"):
        kept = []
        for text, spans in zip(text_array(b.column("text")).to_pylist(), b.column("removed_spans").to_pylist()):
            raw = text.encode().split()
            if spans:
                edges = [0, *(x for s in spans for x in (s["start"], s["stop"])), len(raw)]
                raw = [w for a, z in zip(edges[::2], edges[1::2]) for w in raw[a:z]]
            kept.append(b" ".join(raw).decode())
        yield pa.record_batch([*b.columns, pa.array(kept, pa.string())], names=[*b.schema.names, "kept_text"])


def remove_repeated_passages(docs: DataFrame, text_col: str = "text", window: int = WINDOW, seed: int = SEED,
                             shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that starts anywhere else, too.

    Returns all columns of ``docs`` and ``n_words``, ``n_removed`` (long),
    ``removed_spans`` (arrays of word positions ``start``, ``stop``) and
    ``kept_text`` (kept words joined by one space). Input columns of these
    names are replaced. Null and empty texts have no words; texts shorter
    than a window keep all; repeated rows are copies and lose what they
    share; an empty table gives an empty result. Nothing is capped: a text of
    any length is read whole.
    """
    spark = docs.sparkSession
    if not 0 < seed < window:
        raise ValueError("seed must be shorter than window")
    keep = [c for c in docs.columns if c not in OUTPUT]
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`"))).alias("b")).first()["b"] or 0
    shards = parts_for(spark, size, shard_bytes)
    text, row, back = packed(docs, text_col, OUTPUT)
    # The place of a row: by all its columns, so that copies of a text spread.
    shard = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in keep if not isinstance(docs.schema[c].dataType, T.MapType)]), F.lit(shards)).cast("int")
    base = docs.select(shard.alias("shard"), text, row)

    phrases = base.select("shard", "text").mapInArrow(released(_phrase_rows(window, seed)), _ROWS)
    twice = phrases.groupBy("value").agg(F.sum("n").alias("total")).where("total >= 2").select("value")
    known = phrases.select("shard", "value").join(twice, "value", "left_semi")

    def dealt(rows: DataFrame, values: DataFrame) -> DataFrame:
        """Every shard is a partition of its own: a task holds one shard's texts."""
        marks = values.select("shard", "known", F.lit(None).cast("string").alias("text"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"))
        texts = rows.select("shard", F.lit(None).cast("binary").alias("known"), "text", "row")
        return texts.unionByName(marks).repartitionById(shards, "shard")

    pack = "shard int, known binary"
    light = base.select("shard", "text", F.struct(F.lit(0).alias("none")).alias("row"))
    windows = dealt(light, known.mapInArrow(_packed_rows, pack)).mapInArrow(released(_window_rows(window, seed)), _ROWS)
    # Each shard gives a value once, so no value has more rows than there are shards.
    recurring = written(windows.repartition(shards, "value").mapInArrow(released(_keep_recurring), pack))

    span = T.ArrayType(T.StructType().add("start", "long").add("stop", "long"))
    full = (T.StructType().add("text", "string").add("row", base.schema["row"].dataType).add("n_words", "long").add("n_removed", "long")
            .add("removed_spans", span))
    found = dealt(base, recurring).mapInArrow(released(_locate(window, seed)), full)
    cut = found.mapInArrow(_cut_rows, T.StructType([*full.fields, T.StructField("kept_text", T.StringType())]))
    return cut.select(*back, *OUTPUT)
