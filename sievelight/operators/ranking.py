"""Ranks, running sums and ranking metrics with tie rules, laid out so that no step needs all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sievelight.functions.scalars import budget_count

#: Ranges that a global order is cut into.
RANGES = 64


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def running(
    df: DataFrame,
    sums: dict[str, Column],
    order: str,
    *,
    by: Sequence[str] = (),
    then: Sequence[str] = (),
    descending: bool = True,
) -> DataFrame:
    """Add, for each name in ``sums``, the running sum of its column up to and including this row.

    The order is that of the numeric column ``order`` and then the columns ``then`` ascending.  With ``by`` the sums run
    in each group.  Without, the order is cut into ranges at quantiles, so that each range is a window of its own; what
    the ranges before it hold is added from a table with one row a range.
    """
    direction = F.col(order).desc() if descending else F.col(order).asc()
    keys = [direction, *[F.col(c).asc() for c in then]]
    values = {f"_v_{k}": v for k, v in sums.items()}
    df = df.withColumns(values)
    if by:
        w = W.partitionBy(*by).orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({k: F.sum(f"_v_{k}").over(w) for k in sums}).drop(*values)
    splits = sorted(set(df.approxQuantile(order, [i / RANGES for i in range(1, RANGES)], 0.005)))
    edges = F.lit(splits) if splits else F.array().cast("array<double>")
    at = F.size(F.filter(edges, lambda e: e < F.col(order).cast("double")))
    df = df.withColumn("_range", -at if descending else at)
    inner = W.partitionBy("_range").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    local = df.withColumns({k: F.sum(f"_v_{k}").over(inner) for k in sums})
    totals = df.groupBy("_range").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums])
    out = local.join(F.broadcast(totals), "_range")  # a row for each range
    out = out.withColumns({k: F.col(k) + F.col(f"_o_{k}") for k in sums})
    return out.drop("_range", *values, *[f"_o_{k}" for k in sums])


def rank_rows(df: DataFrame, score: str, row_id: str, *, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Ranks from 1 by descending score, ties by ascending id, over all rows or in each group."""
    if by:
        order = W.partitionBy(*by).orderBy(F.col(score).desc(), F.col(row_id).asc())
        return df.withColumn(name, F.row_number().over(order).cast("long"))
    return running(df, {name: F.lit(1).cast("long")}, score, then=[row_id])


def top_n(df: DataFrame, score: str, row_id: str, n: int, *, by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows by rank, over all or in each group."""
    if by:
        return rank_rows(df, score, row_id, by=by).where(F.col("rank") <= n)
    return df.orderBy(F.col(score).desc(), F.col(row_id).asc()).limit(n)


def percentile_table(df: DataFrame, value: str, *, by: Sequence[str] = (), name: str = "percentile") -> DataFrame:
    """(group, value ``_x``, percentile): the average-tie percentile of each distinct value over n - 1, ascending."""
    groups = df.groupBy(*by, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_peers"))
    cumulated = running(groups, {"_upto": F.col("_peers")}, "_x", by=by, descending=False)
    total = groups.groupBy(*by).agg(F.sum("_peers").alias("_n"))
    cumulated = cumulated.join(total, _same(cumulated, total, by)).select(cumulated["*"], total["_n"]) if by else cumulated.crossJoin(F.broadcast(total))
    place = F.col("_upto") - F.col("_peers") + (F.col("_peers") - 1) / 2.0
    return cumulated.select(*by, "_x", F.when(F.col("_n") == 1, F.lit(0.5)).otherwise(place / (F.col("_n") - 1)).alias(name))


def percentile_normalise(df: DataFrame, *values: str, by: Sequence[str] = (), names: Sequence[str] = ("percentile",)) -> DataFrame:
    """Add the average-tie percentile of each of ``values`` over n - 1, ascending, by ``names``; a single row gets 0.5.

    All tables of percentiles come from ``df`` itself, so several values don't multiply the work before them.
    """
    out = df
    for value, name in zip(values, names, strict=True):
        table = percentile_table(df, value, by=by, name=name)
        table = table.withColumnsRenamed({c: f"_k_{c}" for c in by})
        on = F.col(value).eqNullSafe(F.col("_x"))
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        out = out.join(table, on).drop("_x", *[f"_k_{c}" for c in by])
    return out


def _curve(df: DataFrame, event: Column, score: str, by: Sequence[str], weight: Column) -> DataFrame:
    """For each distinct score, descending: rows and events here and down to here."""
    points = df.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.sum(weight).alias("n"), F.sum(F.when(event, weight).otherwise(0)).alias("tp")
    )
    return running(points, {"cum_n": F.col("n"), "cum_tp": F.col("tp")}, "threshold", by=by)


def average_precision(df: DataFrame, event: Column, score: str, *, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Tie-aware average precision, one row for each group: equal scores are one threshold; null without events."""
    curve = _curve(df, event, score, by, F.lit(1).cast("long") if weight is None else weight)
    ap = F.sum(F.when(F.col("cum_n") > 0, F.col("tp") * F.col("cum_tp") / F.col("cum_n"))) / F.nullif(F.sum("tp"), F.lit(0))
    return curve.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.sum("tp").alias("n_events"), ap.alias("average_precision"))


def precision_recall_curve(df: DataFrame, event: Column, score: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at each distinct score."""
    curve = _curve(df, event, score, by, F.lit(1).cast("long"))
    total = df.groupBy(*by).agg(F.sum(event.cast("long")).alias("_p"))
    joined = curve.join(total, _same(curve, total, by)).select(curve["*"], total["_p"]) if by else curve.crossJoin(F.broadcast(total))
    return joined.select(
        *by, "threshold", "cum_n", "cum_tp", (F.col("cum_tp") / F.col("cum_n")).alias("precision"), F.try_divide("cum_tp", "_p").alias("recall")
    )


def auroc(df: DataFrame, event: Column, score: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by average ranks; null if events or non-events are missing."""
    points = df.groupBy(*by, F.col(score).alias("_x")).agg(F.count(F.lit(1)).alias("n"), F.sum(event.cast("long")).alias("tp"))
    points = running(points, {"cum": F.col("n")}, "_x", by=by, descending=False)
    ranks = F.sum(F.col("tp") * (F.col("cum") - F.col("n") + (F.col("n") + 1) / 2.0))
    out = points.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.sum("tp").alias("n_events"), ranks.alias("_r"))
    p = F.col("n_events").cast("double")
    area = (F.col("_r") - p * (p + 1) / 2.0) / F.nullif(p * (F.col("n_rows") - p), F.lit(0.0))
    return out.withColumn("auroc", area).drop("_r")


def review_budgets(df: DataFrame, event: Column, score: str, row_id: str, budgets: Sequence[float]) -> DataFrame:
    """What reviewing the first share of the ranking finds, a row for each budget."""
    ranked = rank_rows(df.withColumn("_event", event.cast("long")), score, row_id)
    totals = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(event.cast("long")).alias("n_events"))
    spark = df.sparkSession
    wanted = spark.createDataFrame([(float(b),) for b in budgets], "budget double").crossJoin(totals)
    count = F.expr("least(n_rows, cast(ceil(n_rows * budget) as bigint))")
    wanted = wanted.withColumn("reviewed", F.when(F.col("budget") == 0, F.lit(0).cast("long")).otherwise(count))
    # Each row counts for all budgets that reach it, so one pass over the ranking serves them all.
    reach = [F.sum(F.when(F.col("rank") <= F.col("_k")[i], F.col("_event"))).alias(f"_f{i}") for i in range(len(budgets))]
    ks = wanted.agg(F.array_sort(F.collect_list(F.struct("budget", "reviewed"))).alias("_b")).select(F.col("_b.reviewed").alias("_k"), F.col("_b.budget").alias("_s"))
    found = ranked.crossJoin(F.broadcast(ks)).groupBy().agg(*reach, F.first("_s").alias("_s"))
    pairs = F.arrays_zip(F.col("_s"), F.array(*[F.coalesce(F.col(f"_f{i}"), F.lit(0).cast("long")) for i in range(len(budgets))]).alias("found"))
    found = found.select(F.explode(pairs).alias("x")).select(F.col("x._s").alias("budget"), F.col("x.found").alias("found"))
    out = wanted.join(found, "budget")
    recall = F.try_divide("found", "n_events")
    chance = F.try_divide("reviewed", "n_rows")
    return out.select(
        "budget",
        "reviewed",
        "found",
        F.coalesce(F.try_divide("found", "reviewed"), F.lit(0.0)).alias("precision"),
        recall.alias("recall"),
        chance.alias("expected_random_recall"),
        F.try_divide(recall, chance).alias("lift"),
    )


def subgroup_average_precision(
    df: DataFrame, event: Column, score: str, by: Sequence[str], *, min_rows: int = 100, min_events: int = 10
) -> DataFrame:
    """Average precision by group where the support allows it, with a status."""
    out = average_precision(df, event, score, by=by)
    enough = (F.col("n_rows") >= min_rows) & (F.col("n_events") >= min_events)
    return out.select(
        *by,
        "n_rows",
        "n_events",
        F.when(enough, F.lit("reported")).otherwise(F.lit("insufficient_support")).alias("status"),
        F.when(enough, F.col("average_precision")).alias("average_precision"),
    )


def subgroups_by_dimension(
    df: DataFrame, event: Column, score: str, dimensions: Sequence[str], *, min_rows: int = 100, min_events: int = 10
) -> DataFrame:
    """Subgroup figures over several dimensions at once, each row counted once in each; three statuses."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    long = df.select(event.alias("_event"), F.col(score).alias("_score"), F.explode(pairs).alias("p"))
    long = long.select("_event", "_score", "p.dimension", "p.value")
    out = average_precision(long, F.col("_event"), "_score", by=["dimension", "value"])
    enough = (F.col("n_rows") >= min_rows) & (F.col("n_events") >= min_events)
    status = F.when(F.col("n_events") == 0, "not_applicable_zero_corruption").when(enough, "reported").otherwise("suppressed_insufficient_support")
    return out.select(
        "dimension", "value", "n_rows", "n_events", status.alias("status"), F.when(enough, F.col("average_precision")).alias("average_precision")
    )


def random_baseline(df: DataFrame, event: Column, row_id: str, budget: float, repeats: int, seed: int) -> DataFrame:
    """Mean and 95 % range of precision and recall of ``repeats`` hash-random reviews of the budget's size."""
    from sievelight.functions.scalars import unit_hash

    totals = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(event.cast("long")).alias("n_events"))
    runs = df.sparkSession.range(repeats).select(F.col("id").cast("int").alias("run"))
    rows = df.select(F.col(row_id).alias("_id"), event.cast("long").alias("_event")).crossJoin(F.broadcast(runs))
    rows = rows.withColumn("_u", unit_hash(seed, "run", "_id"))
    # The runs stand one after another in one order, which is cut into ranges, so no task holds a whole run.
    placed = running(rows.withColumn("_o", F.col("run") + F.col("_u")), {"_g": F.lit(1).cast("long")}, "_o", then=["_id"], descending=False)
    picked = placed.crossJoin(F.broadcast(totals)).withColumn("_r", F.col("_g") - F.col("run") * F.col("n_rows"))
    picked = picked.where(F.col("_r") <= budget_count(F.col("n_rows"), budget))
    per_run = picked.groupBy("run", "n_rows", "n_events").agg(F.avg("_event").alias("precision"), (F.sum("_event") / F.nullif(F.first("n_events"), F.lit(0))).alias("recall"))
    q = lambda c, p: F.percentile(c, F.lit(p))
    return per_run.agg(
        F.avg("precision").alias("mean_precision"),
        q("precision", 0.025).alias("precision_low"),
        q("precision", 0.975).alias("precision_high"),
        F.avg("recall").alias("mean_recall"),
        q("recall", 0.025).alias("recall_low"),
        q("recall", 0.975).alias("recall_high"),
    )


def holm(df: DataFrame, p: str, row_id: str, *, family: Sequence[str] = ()) -> DataFrame:
    """Add ``adjusted``: Holm step-down values in each family, null p-values left out."""
    valid = df.where(F.col(p).isNotNull())
    order = W.partitionBy(*family).orderBy(F.col(p).asc(), F.col(row_id).asc())
    m = F.count(F.lit(1)).over(W.partitionBy(*family))
    step = (m - F.row_number().over(order) + 1) * F.col(p)
    valid = valid.withColumn("_step", step)
    raised = F.max("_step").over(order.rowsBetween(W.unboundedPreceding, 0))
    return valid.withColumn("adjusted", F.least(F.lit(1.0), raised)).drop("_step")
