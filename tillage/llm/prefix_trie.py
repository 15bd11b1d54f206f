"""Conversation prefix trie by parallel tree contraction.

A node is a distinct sequence of first turns. Every turn gets the hash of the
turns up to it: the exclusive-or of two 64-bit hashes of (position, role,
text), so nodes are groups of equal hashes, aggregated map-side. Positions and
prefix hashes are running sums over segments of bounded size with a carry per
segment, so one conversation with a third of all turns is spread over tasks.

Subtree totals come from tree contraction in join rounds. *Rake*: all
childless nodes add their values to their parents and go. *Compress*: of each
chain of nodes with one child, those with locally least priority add their
values to their parents, hand them their child and go; the priority starts
with the trailing zero bits of the depth, so a plain chain halves in every
round. What a node holds when it is raked is its subtree's total; a compressed
node's total is what it holds then plus its child's total, so the rounds are
re-expanded backwards. Every round is written and the sizes shrink
geometrically, forwards and backwards. Messages go to unique keys or are
aggregated, so a node with very many children is never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillage.llm.tables import joined_evenly, parts_for, written

SEGMENT = 4096
ROWS_A_PART = 500_000
_NODE = ["depth", "p1", "p2"]


def opening_length(conv_id: Column) -> Column:
    """How many turns of its opening a conversation takes from the first one of its hundred: crc32 of its id as text, modulo 6."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 6).cast("long")


def _rebuilt(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, t1, t2, chars) of the rebuilt turns and (conv_id, len) of all conversations."""
    spark = turns.sparkSession
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    base = turns.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), F.md5(text.cast("binary")).alias("digest"),
        F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), role, text).alias("t2"), F.length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("source_row"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("source_row")]
    parts = parts_for(spark, turns.count(), ROWS_A_PART)
    # In a sorted range the running id is the partition, then the row's place in it: the segment and the position.
    rows = written(base.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                   .select("conv_id", "t1", "t2", "chars", F.monotonically_increasing_id().alias("at")).withColumn("seg", F.shiftright("at", 33)))
    earlier = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    segs = written(rows.groupBy("conv_id", "seg").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
                   .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
                   .withColumn("total", F.sum("n").over(Window.partitionBy("conv_id"))))
    own = segs.where("before = 0").select("conv_id", F.col("total").alias("n"), opening_length(F.col("conv_id")).alias("h"),
                                          (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    firsts = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = written(own.join(firsts, "base", "left").withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0))))
                    .select("conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    pos = (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos")
    rest = (rows.join(segs.join(convs, "conv_id").select("conv_id", "seg", "first", "before", "h", "m"), ["conv_id", "seg"])
            .select("conv_id", pos, "h", "m", "t1", "t2", "chars").where("pos > h")
            .select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "t1", "t2", "chars"))
    start = (rows.where("conv_id % 100 = 0").join(segs.where("before < 5").select("conv_id", "seg", "first", "before"), ["conv_id", "seg"])
             .select(F.col("conv_id").alias("base"), pos, "t1", "t2", "chars").where("pos <= 5"))
    opening = start.join(convs, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "t1", "t2", "chars")
    return written(rest.unionByName(opening)), convs.select("conv_id", "len")


def _prefixes(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, chars): hashes of the turns up to a turn and of those before it."""
    cut = rebuilt.select("conv_id", "depth", "chars", *[F.xxhash64(F.lit(s), "depth", "t1", "t2").alias(f"e{s}") for s in (1, 2)],
                         F.expr(f"(depth - 1) div {SEGMENT}").alias("seg"))
    upto = Window.partitionBy("conv_id", "seg").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = (cut.groupBy("conv_id", "seg").agg(*[F.bit_xor(f"e{s}").alias(f"x{s}") for s in (1, 2)])
             .select("conv_id", "seg", *[F.coalesce(F.bit_xor(f"x{s}").over(earlier), F.lit(0)).alias(f"c{s}") for s in (1, 2)]))
    run = cut.select("*", *[F.bit_xor(f"e{s}").over(upto).alias(f"r{s}") for s in (1, 2)]).join(carry, ["conv_id", "seg"])
    run = run.select("conv_id", "depth", "chars", "e1", "e2", *[F.col(f"r{s}").bitwiseXOR(F.col(f"c{s}")).alias(f"p{s}") for s in (1, 2)])
    return written(run.select("conv_id", "depth", "p1", "p2", *[F.col(f"p{s}").bitwiseXOR(F.col(f"e{s}")).alias(f"q{s}") for s in (1, 2)], "chars"))


def _ends(prefixes: DataFrame, convs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(c, d, ends_sha256) of the nodes at which a conversation ends."""
    spark = prefixes.sparkSession
    last = prefixes.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.max_by("p1", "depth").alias("p1"), F.max_by("p2", "depth").alias("p2"))
    zero = F.lit(0).cast("long")
    ends = written(last.withColumnRenamed("conv_id", "member").unionByName(
        convs.where("len = 0").select(F.col("conv_id").alias("member"), zero.alias("depth"), zero.alias("p1"), zero.alias("p2"))))
    total = ends.count()
    lookup = ends.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("n_rows")).join(nodes.select(*_NODE, F.col("conv_id").alias("c")), _NODE)
    parts = parts_for(spark, total, ROWS_A_PART)
    told = joined_evenly(ends, lookup, _NODE, total).select("c", F.col("depth").alias("d"), "member")
    chunks = told.repartitionByRange(parts, "c", "d", "member").sortWithinPartitions("c", "d", "member").mapInArrow(
        _joined_ids, "c long, d long, first long, ids string")
    return chunks.repartition(parts, "c", "d").sortWithinPartitions("c", "d", "first").mapInArrow(_digests, "c long, d long, ends_sha256 string")


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of equal (c, d) in a batch: its first member and all, joined by commas."""
    for b in batches:
        if b.num_rows == 0:
            continue
        c, d = (b.column(x).to_numpy() for x in ("c", "d"))
        cut = np.concatenate([[0], np.flatnonzero((np.diff(c) != 0) | (np.diff(d) != 0)) + 1, [b.num_rows]])
        lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), b.column("member").cast(pa.string()))
        at = cut[:-1]
        yield pa.record_batch([pa.array(c[at]), pa.array(d[at]), b.column("member").take(pa.array(at)), pc.binary_join(lists, ",")],
                              names=["c", "d", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks, read in order: one hash at a time is held, whatever the node's size."""
    now, state, done = None, None, []

    def out():
        rows = pa.record_batch(list(map(pa.array, zip(*done))), names=["c", "d", "ends_sha256"])
        done.clear()
        return rows
    for b in batches:
        for c, d, ids in zip(*(b.column(x).to_pylist() for x in ("c", "d", "ids"))):
            if now == (c, d):
                state.update(b",")
            else:
                if state is not None:
                    done.append((*now, state.hexdigest()))
                now, state = (c, d), hashlib.sha256()
            state.update(ids.encode())
        if len(done) > 8192:
            yield out()
    if state is not None:
        done.append((*now, state.hexdigest()))
        yield out()


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """(c, d, and each of ``values`` summed over the node's subtree, itself included) by rake and compress.

    ``tree``: a node's id (c, d) and its parent's (uc, ud; null at the root),
    all long, ``k``, the number of its children, and the value columns. One
    root, no cycles.
    """
    now = written(tree.select("c", "d", "uc", "ud", "k", *values))
    rounds = []
    while now.where("uc is not null").limit(1).count():
        leaf = F.col("k") == 0
        gone = now.where("uc is not null").groupBy(F.col("uc").alias("c"), F.col("ud").alias("d")).agg(
            F.count_if(leaf).alias("gone"), *[F.sum(F.when(leaf, F.col(v)).otherwise(0)).alias(f"add_{v}") for v in values],
            F.min(F.when(~leaf, F.col("c"))).alias("cc"), F.min(F.when(~leaf, F.col("d"))).alias("cd"))
        raked = now.where("k > 0 or uc is null").join(gone, ["c", "d"], "left").select(
            "c", "d", "uc", "ud", (F.col("k") - F.coalesce("gone", F.lit(0))).alias("k"), "cc", "cd",
            *[(F.col(v) + F.coalesce(f"add_{v}", F.lit(0))).alias(v) for v in values])
        unary = F.coalesce((F.col("k") == 1) & F.col("uc").isNotNull(), F.lit(False))
        zeros = F.when(F.col("d") == 0, 63).otherwise(F.length(F.regexp_extract(F.bin("d"), "0*$", 0)))
        priority = zeros.cast("long") * (1 << 40) + F.pmod(F.xxhash64("c", "d", F.lit(len(rounds))), F.lit(1 << 40))
        raked = raked.withColumn("priority", F.when(unary, priority))
        told = raked.where("priority is not null")
        near = told.select(F.col("cc").alias("c"), F.col("cd").alias("d"), "priority").union(told.select("uc", "ud", "priority")).groupBy("c", "d").agg(
            F.min("priority").alias("near"))
        mid = written(raked.join(near, ["c", "d"], "left").withColumn(
            "out", F.coalesce((F.col("priority") < F.coalesce("near", F.lit(1 << 62))), F.lit(False))).drop("priority", "near"))
        out, null = mid.where("out"), F.lit(None).cast("long")
        moves = out.select(F.col("cc").alias("c"), F.col("cd").alias("d"), F.col("uc").alias("nc"), F.col("ud").alias("nd"),
                           *[F.lit(0).cast("long").alias(f"add_{v}") for v in values]).union(
            out.select("uc", "ud", null, null, *values)).groupBy("c", "d").agg(
            F.max("nc").alias("nc"), F.max("nd").alias("nd"), *[F.sum(f"add_{v}").alias(f"add_{v}") for v in values])
        after = written(mid.where("not out").join(moves, ["c", "d"], "left").select(
            "c", "d", F.coalesce("nc", "uc").alias("uc"), F.coalesce("nd", "ud").alias("ud"), "k",
            *[(F.col(v) + F.coalesce(f"add_{v}", F.lit(0))).alias(v) for v in values]))
        rounds.append((now, out))
        now = after
    known = now.select("c", "d", *values)
    for before, out in reversed(rounds):
        ended = before.where("k = 0 and uc is not null").select("c", "d", *values)
        child = known.select(F.col("c").alias("cc"), F.col("d").alias("cd"), *[F.col(v).alias(f"of_{v}") for v in values])
        opened = out.join(child, ["cc", "cd"]).select("c", "d", *[(F.col(v) + F.col(f"of_{v}")).alias(v) for v in values])
        known = written(known.unionByName(ended).unionByName(opened))
    return known


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by number (null first), ties by role and by the md5 of
    the text; repeated rows are turns of their own; a null role or text is
    empty. A conversation c is rebuilt from the first h turns of c - c % 100
    (h = crc32 of its id as text, modulo 6; fewer if there are fewer) and its
    own turns after the first h. Rows without a conversation id belong to none
    and take no part. Other columns are ignored. An empty table has no nodes,
    not even a root. Texts are only hashed and measured, whole, so their
    length does not matter. Node identity rests on 128 hash bits a prefix.
    The SHA-256 of a node's ending conversations is by its nature computed in
    one task, in a stream of sorted id chunks.
    """
    rebuilt, convs = _rebuilt(turns, conv_col, turn_col, role_col, text_col)
    prefixes = _prefixes(rebuilt)
    below = prefixes.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                                         F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("chars").alias("chars"))
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id", "n_convs", null.alias("q1"), null.alias("q2"), zero.alias("chars"))
    nodes = written(below.unionByName(root))
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    counted = written(nodes.join(kids, _NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)))
    up = counted.where("n_children > 0").select(F.col("depth").alias("ud"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
                                                F.col("conv_id").alias("uc"), F.col("n_children").alias("n_rows"))
    lower = counted.where("depth > 0").select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), (F.col("depth") - 1).alias("ud"), "q1", "q2",
                                              "n_convs", F.col("n_children").alias("k"), "chars")
    linked = joined_evenly(lower, up, ["ud", "q1", "q2"], counted.count()).drop("q1", "q2")
    top = counted.where("depth = 0").select(F.col("conv_id").alias("c"), zero.alias("d"), null.alias("ud"), "n_convs", F.col("n_children").alias("k"),
                                            zero.alias("chars"), null.alias("uc"))
    tree = written(linked.unionByName(top).withColumn("leaves", F.when(F.col("k") == 0, 1).otherwise(0).cast("long"))
                   .withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")).drop("chars"))
    totals = subtree_totals(tree, ["leaves", "saved"])
    shas = _ends(prefixes, convs, nodes)
    return (tree.drop("leaves", "saved").join(totals, ["c", "d"]).join(shas, ["c", "d"], "left")
            .select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("uc").alias("parent_conv_id"), "n_convs",
                    F.col("k").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))


ORACLE_SQL = """
WITH placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, count(*) AS n,
         xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda crc, b:
           list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END), 4294967295), 4294967295) % 6 AS h
  FROM placed GROUP BY conv_id),
built AS (
  SELECT c.conv_id, p.pos AS depth, p.role, p.text FROM convs c JOIN placed p ON p.conv_id = c.base AND p.pos <= c.h
  UNION ALL
  SELECT c.conv_id, p.pos - c.h + least(c.h, coalesce(b.n, 0)), p.role, p.text
  FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.pos > c.h LEFT JOIN convs b ON b.conv_id = c.base),
paths AS (
  SELECT conv_id, 0 AS depth, NULL AS text, '' AS path FROM convs
  UNION ALL
  SELECT conv_id, depth, text, string_agg(md5(md5(role) || md5(text)), ',') OVER (PARTITION BY conv_id ORDER BY depth) FROM built),
placed_nodes AS (
  SELECT conv_id, depth, text, min(conv_id) OVER (PARTITION BY depth, path) AS node,
         count(*) OVER (PARTITION BY depth, path) AS n_convs, depth = max(depth) OVER (PARTITION BY conv_id) AS ends
  FROM paths),
nodes AS (
  SELECT a.node, a.depth, max(u.node) AS parent, max(a.n_convs) AS n_convs, max((a.n_convs - 1) * coalesce(length(a.text), 0)) AS saved,
         sha256(coalesce(string_agg(CAST(a.conv_id AS VARCHAR), ',' ORDER BY a.conv_id) FILTER (a.ends), '')) AS ends_sha256
  FROM placed_nodes a LEFT JOIN placed_nodes u ON u.conv_id = a.conv_id AND u.depth = a.depth - 1
  GROUP BY a.node, a.depth),
kids AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.parent = n.node AND k.depth = n.depth),
totals AS (
  SELECT a.node, a.depth, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum(b.saved) AS saved
  FROM full_nodes b JOIN placed_nodes a ON a.conv_id = b.node AND a.depth <= b.depth
  GROUP BY a.node, a.depth)
SELECT n.node AS conv_id, CAST(n.depth AS BIGINT) AS depth, n.parent AS parent_conv_id, n.n_convs, n.n_children,
       CAST(t.leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN totals t ON t.node = n.node AND t.depth = n.depth
"""
