"""Chat formatting: cumulative-snapshot collapse with rolling turn-prefix hashes, then rendering.

Logged conversations are often snapshots of a growing one. Each turn gets a 128-bit hash of all turns up to it
(the exclusive or of position-bound turn hashes, a running window); a conversation whose full hash is an inner
prefix hash of another is a prefix of it and goes in an anti-join; equal conversations leave the one with the
smallest conv_id. DataFrame functions only.

Defined results: turns are ordered by turn, then role, then text (ties and repeated rows have a fixed order,
and count as turns); null roles and texts differ from empty ones and are rendered as empty; rows with a null
conv_id are one conversation; an empty table gives an empty table; extra columns are ignored. A conversation's
turns meet in one sorted window and one output text, which is its own size; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, n_turns, role, text, h1, h2: the hash pair of the first pos turns."""
    t = conversations.select("conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("pos", F.row_number().over(order))
    piece = ["pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    t = t.withColumns({"x1": F.xxhash64(*piece), "x2": F.xxhash64(F.lit(11), *piece)})
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv_id")
    return t.withColumns({"h1": F.bit_xor("x1").over(upto), "h2": F.bit_xor("x2").over(upto), "n_turns": F.count(F.lit(1)).over(whole)}).drop("x1", "x2", "turn")


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that no longer one starts with."""
    full = hashed.where("pos = n_turns").groupBy("h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.max(F.col("conv_id").isNull()).alias("any_null"), F.first("n_turns").alias("n_turns"), F.count(F.lit(1)).alias("n_copies"))
    inner = hashed.where("pos < n_turns").select("h1", "h2").distinct()
    return full.join(inner, ["h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_copies")


def rendered(hashed: DataFrame, kept: DataFrame) -> DataFrame:
    """kept with the rendered text: <|role|>, line break, text, <|end|>, line break for each turn."""
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    turns = hashed.select(F.col("conv_id").alias("c"), "pos", line.alias("line"))
    met = kept.join(turns, F.col("conv_id").eqNullSafe(F.col("c")))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return met.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_join(lines, "").alias("rendered"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = prefix_hashes(table(spark, sf_dir, "conversations"))
    return rendered(hashed, maximal_conversations(hashed))


SQL = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations),
p AS (SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n_turns,
        string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM t),
f AS (SELECT prefix AS rendered, min(conv_id) AS conv_id, CAST(max(n_turns) AS BIGINT) AS n_turns, CAST(count(*) AS BIGINT) AS n_copies FROM p WHERE pos = n_turns GROUP BY prefix)
SELECT conv_id, n_turns, n_copies, rendered FROM f WHERE rendered NOT IN (SELECT prefix FROM p WHERE pos < n_turns)
"""
