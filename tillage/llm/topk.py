"""Exact top-k search by tiled matrix products.

Vectors are turned into integers. Candidates are dealt to shards and queries
to tiles of bounded size; every query tile meets every shard of its length in
one row of an equi-join on (length, shard), so the work is dealt evenly
whatever the data. A task multiplies tile and shard and keeps each query's
best k of the shard; the lists are merged first within groups of shards, then
by query. Products are exact: in doubles while sums stay below 2**53, in
64-bit integers below 2**63, else in Python integers limited to the range of long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8192
TILE_ROWS = 512
MERGE = 32
SCALE = 256
_TILE = "dim int, part long, ids binary, data binary, whole boolean"


def _numbers(data: bytes, whole: bool, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int32 if whole else np.float64).reshape(rows, dim)


def _tile_rows(scale: int):
    """One row per run of equal (dim, part): ids ascending, and the scaled vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows = None, [], []

        def tile():
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            x = np.stack(rows)[order] if now[0] else np.zeros((len(ids), 0))
            whole = bool(x.size == 0 or np.abs(x).max() < 2 ** 31)
            raw = (x.astype(np.int32) if whole else x).tobytes()
            return pa.record_batch([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()),
                                    pa.array([np.array(ids, np.int64)[order].tobytes()], pa.binary()), pa.array([raw], pa.binary()),
                                    pa.array([whole])], names=["dim", "part", "ids", "data", "whole"])
        for b in batches:
            vectors = b.column("vector")
            off = vectors.offsets.to_numpy()
            flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
            flat = np.floor(scale * flat)
            for i, (dim, part, vec_id) in enumerate(zip(b.column("dim").to_pylist(), b.column("part").to_pylist(), b.column("vec_id").to_pylist())):
                if now != (dim, part):
                    if ids:
                        yield tile()
                    now, ids, rows = (dim, part), [], []
                ids.append(vec_id)
                rows.append(flat[off[i]:off[i + 1]])
        if ids:
            yield tile()
    return run


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    most = (float(np.abs(q).max()) if q.size else 0.0) * (float(np.abs(c).max()) if c.size else 0.0) * max(q.shape[1], 1)
    if most < 2 ** 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 2 ** 62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    exact = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in c], object).T
    return np.clip(exact, -(2 ** 63), 2 ** 63 - 1).astype(np.int64)


def _best_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                qid, cid = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                s = _products(_numbers(r["q_data"], r["q_whole"], len(qid), r["dim"]), _numbers(r["data"], r["whole"], len(cid), r["dim"]))
                own = qid[:, None] == cid[None, :]
                out_q, out_c = [], []
                for i in range(len(qid)):
                    may = np.flatnonzero(~own[i])
                    row = s[i, may]
                    if len(row) > k:
                        # all above the k-th score, and of its ties the first (ids ascend)
                        edge = np.partition(row, len(row) - k)[len(row) - k]
                        above = np.flatnonzero(row > edge)
                        pick = np.concatenate([above, np.flatnonzero(row == edge)[:k - len(above)]])
                    else:
                        pick = np.arange(len(row))
                    out_q.append(np.full(len(pick), i))
                    out_c.append(may[pick])
                q, c = np.concatenate(out_q), np.concatenate(out_c)
                yield pa.record_batch([pa.array(r["q_part"] * (1 << 20) + q), pa.array(qid[q]), pa.array(np.full(len(q), r["part"])),
                                       pa.array(cid[c]), pa.array(s[q, c])], names=["q_row", "query_id", "part", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
          shard_rows: int = SHARD_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k best candidates by integer inner product.

    Components are floor(scale * x). Candidates are all rows of ``vectors``
    but those with the query's own id; ties go to the smaller id. Vectors
    that are null or hold null or non-finite components, and rows without an
    id, take no part; vectors are compared with those of their length (the
    empty ones score 0). A repeated candidate row counts each time, a
    repeated query row is answered each time. No vectors: no rows.
    """
    def usable(df: DataFrame) -> DataFrame:
        fine = F.forall(F.col("vector"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return (df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
                .where("vec_id is not null and vector is not null").where(fine).withColumn("dim", F.size("vector")))

    def tiles(df: DataFrame, rows: int) -> tuple[DataFrame, int]:
        parts = max(1, -(-df.count() // rows))
        # Dealt by row, so repeated ids and vectors spread, too.
        part = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(parts))
        dealt = df.withColumn("part", part).repartition("dim", "part").sortWithinPartitions("dim", "part")
        return dealt.select("dim", "part", "vec_id", "vector").mapInArrow(_tile_rows(scale), _TILE), parts

    shards, n = tiles(usable(vectors), shard_rows)
    asked, _ = tiles(usable(queries), tile_rows)
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("part"), F.col("part").alias("q_part"),
                         F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("whole").alias("q_whole"))
    lists = asked.join(shards, ["dim", "part"]).select("dim", "part", "ids", "data", "whole", "q_part", "q_ids", "q_data", "q_whole").mapInArrow(
        _best_rows(k), "q_row long, query_id long, part long, vec_id long, score long")

    def merged(df: DataFrame, *by: str) -> DataFrame:
        best = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
        return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    some = merged(lists.withColumn("group", F.floor(F.col("part") / MERGE)), "q_row", "query_id", "group")
    return merged(some.drop("rank", "group"), "q_row", "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
