"""Mixing sources to target weights: hash-random order, distributed prefix sums, an exact cut at each source's budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sievelight.llm.common import WORD, checkpoint


def targets(sizes: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """Water-filling: from (source, source_size), each source's ``target``.

    The sources stand by code point, null last, and take ``weights`` in turn.  Targets are in proportion to the weights
    and sum to the total size, but none exceeds ``max_epochs`` times its source; what is above goes to the others by
    weight until none is above.  In order of cap / weight the capped sources come first: a source is capped if its cap
    is under its weight's share of what the sources before it leave.  The table has one row for each source.
    """
    seat = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.lit([float(x) for x in weights]), (F.pmod(seat, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("_w", weight).withColumn("_cap", (max_epochs * F.col("source_size")).cast("double"))
    by_ratio = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    total = F.sum("source_size").over(everything).cast("double")
    left = total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    open_weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    t = t.withColumn("_level", left / open_weight)
    t = t.withColumn("_capped", F.col("_cap") <= F.col("_level") * F.col("_w"))
    level = F.min(F.when(~F.col("_capped"), F.struct(F.col("_cap") / F.col("_w"), "source", "_level"))).over(everything)["_level"]
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(level * F.col("_w"))
    return t.withColumn("target", target).select("source", "source_size", "target")


def mix_sources(
    docs: DataFrame,
    *,
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (1.0, 2.0, 3.0),
    max_epochs: int = 3,
    seed: int = 7,
    buckets: int = 4096,
) -> DataFrame:
    """Say how many words of each document a mix of the sources takes: ``docs`` with four columns more.

    Added: size (words of the text), source_size, target (its source's words in the mix) and taken (long).  A source
    that has to give more than it holds is taken whole as often as that goes, at most ``max_epochs`` times; the rest is
    cut from its documents in hash-random order, in the last of them inside the document.  So the words taken from a
    source are its target, rounded down.  Reruns agree: the order is a hash of the seed, the id and the text.

    The order of a source is sorted in ``buckets`` ranges of the random key, each a group of its own, so that no task
    sees a whole source.  A first pass sums the sizes by source and range; what stands before a range in its source is a
    running sum over these sums, at most ``buckets`` rows a source.  A second pass adds what stands before a document in
    its range.  A null text has size 0 and gives nothing; a null source is a source of its own, the last.  Equal rows
    have equal keys and share what their places give in any order.  Columns named like the added ones are replaced;
    empty input gives empty output.
    """
    base = docs.drop("size", "source_size", "target", "taken")
    body = F.coalesce(F.col(text), F.lit(""))
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(body)))
    sized = base.withColumns({"size": F.regexp_count(body, F.lit(WORD)).cast("long"), "_u": place})
    sized = sized.withColumn("_b", F.floor(F.conv(F.substring("_u", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("long"))
    sized = sized.withColumn("_k", F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("")))
    sums = sized.groupBy("_k", "_b", F.col(source).alias("_s")).agg(F.sum("size").alias("_sum"))
    sums = checkpoint(sums)
    plan = targets(sums.groupBy(F.col("_s").alias("source")).agg(F.sum("_sum").alias("source_size")), weights, max_epochs)
    plan = plan.withColumn("_k", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))).drop("source")
    zero = F.lit(0).cast("long")
    ahead = W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    ranges = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(ahead), zero)).select("_k", "_b", "_offset").join(plan, "_k")
    inside = W.partitionBy("_k", "_b").orderBy("_u").rowsBetween(W.unboundedPreceding, -1)
    rows = sized.withColumn("_in", F.coalesce(F.sum("size").over(inside), zero)).join(ranges, ["_k", "_b"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(zero).cast("long")
    rest = F.floor("target").cast("long") - whole * F.col("source_size")
    rest = rest - F.col("_offset") - F.col("_in")
    taken = whole * F.col("size") + F.least(F.col("size"), F.greatest(zero, rest))
    return rows.withColumn("taken", taken).drop("_u", "_b", "_k", "_in", "_offset")


def op8_mixing(docs: DataFrame) -> DataFrame:
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS size,
         md5('7|' || coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))) AS u FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::double AS w FROM d GROUP BY source),
a AS (SELECT *, 3.0::double * source_size AS cap FROM s),
f AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM a),
l AS (SELECT arg_min(level, cap / w) AS level FROM f WHERE cap > level * w),
t AS (SELECT source, source_size, CASE WHEN cap <= f.level * w THEN cap ELSE l.level * w END AS target FROM f, (SELECT max(level) AS level FROM l) l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size) ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (whole * size + least(size, greatest(0, floor(target) - whole * source_size - before)))::bigint AS taken FROM p
"""
