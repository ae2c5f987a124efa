"""Review queues under quotas, matched random comparators, and hybrid risk scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sievelight.functions.scalars import unit_hash
from sievelight.functions.shipping import ship
from sievelight.operators.ranking import percentile_normalise


def hybrid_score(df: DataFrame, components: dict[str, float], name: str = "hybrid") -> DataFrame:
    """Weighted mean of the components' percentiles; the weights are made to sum to 1."""
    if not components or any(not w > 0 for w in components.values()):
        raise ValueError("components need positive weights")
    total = sum(components.values())
    df = percentile_normalise(df, *components, names=[f"_p_{c}" for c in components])
    score = sum((F.col(f"_p_{c}") * (w / total) for c, w in components.items()), F.lit(0.0))
    return df.withColumn(name, score).drop(*[f"_p_{c}" for c in components])


def hybrid_drop_one(df: DataFrame, components: dict[str, float]) -> DataFrame:
    """The hybrid without each component in turn, as columns ``without_<component>``; the others keep their ratios."""
    if len(components) < 2:
        raise ValueError("a drop-one ablation needs two components")
    df = percentile_normalise(df, *components, names=[f"_p_{c}" for c in components])
    for left_out in components:
        rest = {c: w for c, w in components.items() if c != left_out}
        total = sum(rest.values())
        df = df.withColumn(f"without_{left_out}", sum((F.col(f"_p_{c}") * (w / total) for c, w in rest.items()), F.lit(0.0)))
    return df.drop(*[f"_p_{c}" for c in components])


def group_quota_queue(df: DataFrame, priority: str, row_id: str, group: str, cap: int, n: int) -> DataFrame:
    """The first ``n`` rows by priority with at most ``cap`` of a group: what a greedy walk with one quota selects."""
    order = W.partitionBy(group).orderBy(F.col(priority).desc(), F.col(row_id).asc())
    capped = df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= cap).drop("_r")
    return capped.orderBy(F.col(priority).desc(), F.col(row_id).asc()).limit(n)


@dataclass(frozen=True)
class Quotas:
    """Caps of a queue: null is no cap.  min_cosine is the least cosine distance to every row selected before."""

    group: int | None = None
    label: int | None = None
    tissue: int | None = None
    transition: int | None = None
    min_cosine: float | None = None


def balanced_queue(df: DataFrame, priority: str, n: int, quotas: Quotas) -> tuple[DataFrame, DataFrame]:
    """Greedy queue under several quotas and a diversity rule: (selected rows with their rank, counts of rejections).

    The walk goes by descending priority, then id, until ``n`` rows are selected.  A row is rejected by the first rule
    that it breaks, in the order group, class, tissue, transition, similarity; only rows that the walk reaches count.
    Each step depends on all before it, so the walk is one task over narrow rows (id, priority, four keys, the vector
    if diversity is asked for); eligibility filters belong before it.
    """
    ship(df.sparkSession)
    checks = [("group_id", quotas.group), ("observed_label", quotas.label), ("tissue", quotas.tissue), ("transition", quotas.transition)]
    diverse = quotas.min_cosine is not None
    narrow = df.select("sample_id", F.col(priority).alias("priority"), "group_id", F.col("observed_label").cast("string").alias("observed_label"), "tissue", "transition", *([F.col("features")] if diverse else []))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["priority", "sample_id"], ascending=[False, True], kind="stable")
        taken: dict[tuple[str, str], int] = {}
        vectors: list[np.ndarray] = []
        out, names = [], ("group_quota", "class_quota", "tissue_quota", "transition_quota")
        chosen = 0
        for row in pdf.to_dict("records"):
            if chosen >= n:
                break
            why = next((name for name, (c, cap) in zip(names, checks) if cap is not None and taken.get((c, row[c]), 0) >= cap), None)
            if why is None and diverse:
                v = np.asarray(row["features"], float)
                v = v / max(float(np.linalg.norm(v)), 1e-12)
                if vectors and float((1.0 - np.stack(vectors) @ v).min()) < quotas.min_cosine:
                    why = "similarity"
            if why is None:
                chosen += 1
                for c, _ in checks:
                    taken[c, row[c]] = taken.get((c, row[c]), 0) + 1
                if diverse:
                    vectors.append(v)
            out.append((row["sample_id"], chosen if why is None else 0, why))
        return pd.DataFrame(out, columns=["sample_id", "queue_rank", "rejected_by"])

    walked = narrow.groupBy(F.lit(1).alias("one")).applyInPandas(walk, "sample_id string, queue_rank int, rejected_by string")
    selected = df.join(walked.where("rejected_by is null").drop("rejected_by"), "sample_id")
    rejected = walked.where("rejected_by is not null").groupBy("rejected_by").agg(F.count(F.lit(1)).alias("n"))
    return selected, rejected


def quality_queue_priority(df: DataFrame, risk: str, minimum: float) -> DataFrame:
    """Priority of the annotation queue: the percentile of the risk; rows under the least risk leave."""
    return percentile_normalise(df, risk, names=["priority"]).where(F.col(risk) >= minimum)


def model_queue_priority(df: DataFrame, risk: str, lower: str, minimum_gain: float, evidence_role: str) -> DataFrame:
    """Priority of the model-improvement queue: half the risk's percentile and half the gain bound's.

    Rows need a bound above the least gain.  Without cross-fitted evidence the queue is unavailable: it has no rows.
    """
    both = percentile_normalise(df, risk, lower, names=["_a", "_b"])
    both = both.withColumn("priority", 0.5 * F.col("_a") + 0.5 * F.col("_b")).drop("_a", "_b").where(F.col(lower) > minimum_gain)
    return both if evidence_role == "cross_fitted" else both.where(F.lit(False))


def utility_priority(df: DataFrame, risk: str, lower: str) -> DataFrame:
    """Priority by measured utility: the risk's percentile times the gain bound where that is positive."""
    both = percentile_normalise(df, risk, names=["_a"])
    return both.withColumn("priority", F.col("_a") * F.greatest(F.col(lower), F.lit(0.0))).drop("_a")


def _same_stratum(left: DataFrame, right: DataFrame, strata: Sequence[str], how: str) -> DataFrame:
    """``left`` with the other columns of ``right`` by equal strata; nulls are a stratum."""
    right = right.withColumnsRenamed({c: f"_s_{c}" for c in strata})
    on = F.lit(True)
    for c in strata:
        on = on & left[c].eqNullSafe(F.col(f"_s_{c}"))
    return left.join(right, on, how).drop(*[f"_s_{c}" for c in strata])


def comparator_shortfall(top: DataFrame, eligible: DataFrame, strata: Sequence[str], row_id: str = "sample_id") -> DataFrame:
    """Rows that each stratum of the selection needs and has for a disjoint matched comparator."""
    need = top.groupBy(*strata).agg(F.count(F.lit(1)).alias("needed"))
    pool = eligible.join(top.select(row_id), row_id, "left_anti").groupBy(*strata).agg(F.count(F.lit(1)).alias("available"))
    joined = _same_stratum(need, pool, strata, "left").withColumn("available", F.coalesce("available", F.lit(0).cast("long")))
    return joined.withColumn("shortfall", F.greatest(F.lit(0).cast("long"), F.col("needed") - F.col("available")))


def matched_random(top: DataFrame, eligible: DataFrame, strata: Sequence[str], seed: int, row_id: str = "sample_id") -> DataFrame:
    """As many random eligible rows of each stratum as the selection has there, disjoint from it; all strata or nothing."""
    short = comparator_shortfall(top, eligible, strata, row_id)
    ok = short.agg(F.coalesce(F.max("shortfall"), F.lit(0)).alias("_worst"))
    pool = eligible.join(top.select(row_id), row_id, "left_anti").withColumn("_u", unit_hash(seed, row_id))
    ranked = pool.withColumn("_r", F.row_number().over(W.partitionBy(*strata).orderBy("_u", row_id)))
    picked = _same_stratum(ranked, short.select(*strata, "needed"), strata, "inner").where(F.col("_r") <= F.col("needed"))
    return picked.crossJoin(F.broadcast(ok)).where(F.col("_worst") == 0).drop("_u", "_r", "needed", "_worst")


def capacity_selection(df: DataFrame, risk: str, row_id: str, strata: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows by risk with at most half of each stratum, so that a disjoint exact match exists."""
    w = W.partitionBy(*strata)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(F.col(risk).desc(), F.col(row_id).asc()))).withColumn("_m", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("_r") <= F.floor(F.col("_m") / 2)).drop("_r", "_m").orderBy(F.col(risk).desc(), F.col(row_id).asc()).limit(n)


def interventions(df: DataFrame, selected: Column, policy: str) -> DataFrame:
    """Add training_label and training_weight after an intervention on the selected rows."""
    corrupted = selected & F.col("is_corrupted")
    restored = F.when(corrupted, F.col("pre_corruption_label")).otherwise(F.col("observed_label"))
    one = F.lit(1.0)
    rules = {
        "unchanged": (F.col("observed_label"), one),
        "controlled_restore": (restored, one),
        "restore_weight_0_5": (restored, F.when(selected, F.lit(0.5)).otherwise(one)),
        "restore_weight_2": (restored, F.when(selected, F.lit(2.0)).otherwise(one)),
        "restore_weight_4": (restored, F.when(selected, F.lit(4.0)).otherwise(one)),
        "flag_downweight_0_5": (F.col("observed_label"), F.when(selected, F.lit(0.5)).otherwise(one)),
        "flag_exclude": (F.col("observed_label"), F.when(selected, F.lit(0.0)).otherwise(one)),
    }
    label, weight = rules[policy]
    return df.withColumn("training_label", label).withColumn("training_weight", weight)
