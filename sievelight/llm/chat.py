"""Chat formatting with cumulative-snapshot collapse: conversations that are the beginning of longer ones go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sievelight.llm.common import checkpoint

SPAN = 256


def _contents(turns: DataFrame) -> DataFrame:
    """``turns`` with ``c1`` and ``c2``, two 64-bit hashes of role and text."""
    return turns.select(
        "conv_id",
        "turn",
        "role",
        "text",
        *[F.xxhash64(F.lit(i), F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias(f"c{i}") for i in (1, 2)],
    )


def _numbered(turns: DataFrame) -> DataFrame:
    """Each conversation's turns, numbered from 1 (``pos``), with running hashes of all turns up to it (``h1``, ``h2``).

    Returns conv_id, pos, c1, c2, h1 and h2; no text is shuffled.  The turns are dealt to ranges of (conversation, turn,
    content, a random number), so that a conversation that holds most rows is spread, also where its turns' numbers or
    its contents are all the same.  Numbers and hashes run inside a range; what the ranges before hold of a conversation
    is carried over.  Only a conversation that crosses a range's end has anything to carry, so these tables have at most
    a row for each range.  The running hash is the exclusive-or of the hashes of (position, content).
    """
    t = _contents(turns).select("conv_id", "turn", "c1", "c2", F.rand(5).alias("_r"))
    t = t.repartitionByRange("conv_id", "turn", "c1", "c2", "_r").drop("_r")
    t = checkpoint(t.withColumn("_part", F.spark_partition_id()))
    before = W.partitionBy("conv_id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)

    def carried(df: DataFrame, offsets: DataFrame) -> DataFrame:
        offsets = F.broadcast(offsets.withColumnsRenamed({"conv_id": "_c", "_part": "_p"}))  # a row a range at most
        return df.join(offsets, df["conv_id"].eqNullSafe(F.col("_c")) & (df["_part"] == F.col("_p")), "left").drop("_c", "_p")

    rows = t.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("_n"))
    skips = rows.withColumn("_skip", F.sum("_n").over(before)).where("_skip > 0").drop("_n")
    inside = W.partitionBy("conv_id", "_part").orderBy("turn", "c1", "c2")
    t = carried(t, skips).withColumn("pos", F.row_number().over(inside) + F.coalesce("_skip", F.lit(0).cast("long")))
    running = W.partitionBy("conv_id", "_part").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumns({f"_x{i}": F.bit_xor(F.xxhash64(F.lit(i), "pos", "c1", "c2")).over(running) for i in (1, 2)})
    t = checkpoint(t.select("conv_id", "_part", "pos", "c1", "c2", "_x1", "_x2"))
    last = t.groupBy("conv_id", "_part").agg(F.max(F.struct("pos", "_x1", "_x2")).alias("_l"), F.min("pos").alias("_first"))
    sums = last.select("conv_id", "_part", "_first", *[F.bit_xor(f"_l._x{i}").over(before).alias(f"_o{i}") for i in (1, 2)])
    t = carried(t, sums.where("_first > 1").drop("_first"))
    hashes = [F.col(f"_x{i}").bitwiseXOR(F.coalesce(f"_o{i}", F.lit(0).cast("long"))).alias(f"h{i}") for i in (1, 2)]
    return t.select("conv_id", "pos", "c1", "c2", *hashes)


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def format_chats(turns: DataFrame, *, turns_per_row: int = SPAN) -> DataFrame:
    """Collapse snapshots of growing conversations and render those that stay.

    Returns conv_id, part, n_turns, n_copies and rendered: a row for each ``turns_per_row`` turns (``part`` counts from
    0, nearly always one part), with conv_id the least id of n_copies conversations that are equal turn by turn in role
    and text.  A conversation whose turns are the first turns of a longer one is left out.

    Prefixes are compared by position and two running 64-bit hashes: a prefix that more conversations reach than end at
    it is a proper one, and the conversations that equal one go by an anti-join.  Texts are fetched for what stays only,
    each distinct turn once.

    The order of turns is that of ``turn``, null first; rows with equal numbers stand in the order of a hash of role and
    text, so that equal conversations get equal orders.  Null roles or texts count as values of their own in comparisons
    and are rendered as empty.  Rows with a null conv_id make one conversation.  Other columns are ignored; an empty
    table gives an empty result.
    """
    t = _numbered(turns)
    prefix = ["n_turns", "h1", "h2"]
    ends = t.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("e"))
    ends = checkpoint(ends.select("conv_id", F.col("e.pos").alias("n_turns"), F.col("e.h1").alias("h1"), F.col("e.h2").alias("h2")))
    kinds = ends.groupBy(*prefix).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    reached = t.select(F.col("pos").alias("n_turns"), "h1", "h2", F.lit(1).alias("more"))
    both = reached.unionByName(ends.select(*prefix, F.lit(-1).alias("more")))
    proper = both.groupBy(*prefix).agg(F.sum("more").alias("more")).where("more > 0").select(*prefix)
    maximal = kinds.join(proper, prefix, "left_anti").select(F.col("conv_id").alias("_c"), "n_turns", "n_copies")
    kept = t.join(maximal, t["conv_id"].eqNullSafe(maximal["_c"])).select("conv_id", "pos", "c1", "c2", "n_turns", "n_copies")
    spoken = _contents(turns).groupBy("c1", "c2").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    part = F.floor((F.col("pos") - 1) / turns_per_row).cast("long").alias("part")
    pieces = F.array_sort(F.collect_list(F.struct("pos", _render(F.col("role"), F.col("text")).alias("piece"))))
    rows = kept.join(spoken, ["c1", "c2"]).groupBy("conv_id", part, "n_turns", "n_copies").agg(pieces.alias("_p"))
    return rows.withColumn("rendered", F.array_join(F.col("_p.piece"), "")).drop("_p")


def op5_chat_formatting(turns: DataFrame) -> DataFrame:
    return format_chats(turns)


ORACLE = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations),
p AS (
  SELECT conv_id, pos, string_agg(coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n'), chr(2))
           OVER (PARTITION BY conv_id ORDER BY pos) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
kinds AS (SELECT prefix, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE pos = n_turns GROUP BY ALL),
keep AS (SELECT * FROM kinds WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos < n_turns))
SELECT k.conv_id, 0::bigint AS part, k.n_turns, k.n_copies,
       string_agg('<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10), '' ORDER BY t.pos) AS rendered
FROM keep k JOIN t ON t.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY ALL
"""
