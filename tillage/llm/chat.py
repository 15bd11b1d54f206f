"""Chat formatting with cumulative-snapshot collapse (DataFrame functions only).

A log holds a conversation again each time it grows. Every turn gets the hash
of the turns up to it: the exclusive-or of two 64-bit hashes of (position,
role, text), a running aggregate over the conversation. A conversation whose
whole hash is the prefix hash of a longer one is a snapshot and goes, by an
anti-join of two deduplicated key sets, so an opening that a third of all
conversations share is one key. Only hashes are shuffled until the maximal
conversations are known; then their texts are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _turn_hash(salt: int) -> Column:
    # The flags keep null apart from the empty text.
    return F.xxhash64(F.lit(salt), "pos", F.col("role").isNull(), "role", F.col("digest").isNull(), "digest")


def render_maximal(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                   before: str = "<|im_start|>", after_role: str = "\n", after: str = "<|im_end|>\n") -> DataFrame:
    """(conv_id, n_turns, n_copies, text) of every maximal conversation.

    A conversation that is a proper prefix of another one is left out; of
    equal ones the least id stands for all ``n_copies``. Turns are ordered by
    number (null last), ties by role and by the md5 of the text (null first);
    repeated rows are turns of their own. Null roles and texts render as
    empty, but differ from empty ones when conversations are compared. Rows
    without a conversation id belong to none and take no part. Other columns
    are ignored. An empty table gives none.
    """
    base = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"),
                        F.col(f"`{text_col}`").alias("text"), F.md5(F.col(f"`{text_col}`").cast("binary")).alias("digest")).where("conv_id is not null")
    order = [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("digest").asc_nulls_first()]
    walk = Window.partitionBy("conv_id").orderBy(*order)
    placed = base.drop("text").select("conv_id", "role", "digest", F.row_number().over(walk).alias("pos"),
                                      F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n"), "turn")
    upto = walk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = (placed.withColumn("h1", _turn_hash(1)).withColumn("h2", _turn_hash(2))
              .withColumn("h1", F.bit_xor("h1").over(upto)).withColumn("h2", F.bit_xor("h2").over(upto)))
    prefixes = hashed.where("pos < n").select("h1", "h2", F.col("pos").cast("long").alias("n")).distinct()
    wholes = hashed.where("pos = n").groupBy("h1", "h2", "n").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    kept = wholes.join(prefixes, ["h1", "h2", "n"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")
    piece = F.concat(F.lit(before), F.coalesce("role", F.lit("")), F.lit(after_role), F.coalesce("text", F.lit("")), F.lit(after))
    rendered = base.join(kept, "conv_id").groupBy("conv_id", "n_turns", "n_copies").agg(
        F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "digest", piece.alias("piece")))).alias("all"))
    return rendered.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("text"))


ORACLE_SQL = """
WITH placed AS (
  SELECT conv_id, role, text, row_number() OVER (
           PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, md5(text) NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
told AS (
  SELECT conv_id, count(*) AS n, list(struct_pack(r := role, t := text) ORDER BY pos) AS turns,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS txt
  FROM placed GROUP BY conv_id),
starts AS (
  SELECT DISTINCT list_slice(turns, 1, k) AS part FROM told, unnest(range(1, n)) AS u(k)),
firsts AS (
  SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM told GROUP BY turns)
SELECT f.conv_id, t.n AS n_turns, f.n_copies, t.txt AS text
FROM firsts f JOIN told t ON t.conv_id = f.conv_id
WHERE NOT EXISTS (SELECT 1 FROM starts s WHERE s.part = f.turns)
"""
