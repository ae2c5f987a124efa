"""Votes of reviewers, ensembles of models, risks over checkpoints, and blinded review packages."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sievelight.functions.scalars import predicted_class, probability_of, unit_hash
from sievelight.operators.ranking import percentile_normalise

LN2 = math.log(2.0)


def vote_distribution(votes: DataFrame) -> DataFrame:
    """(sample_id, vote, n, n_votes, share) of long votes; a missing vote is a row that isn't there, or null."""
    counted = votes.where("vote is not null").groupBy("sample_id", "vote").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("sample_id"))
    return counted.withColumn("n_votes", total).withColumn("share", F.col("n") / total)


def resolve_votes(samples: DataFrame, votes: DataFrame, flags: Sequence[str] = ("reviewed", "ambiguous", "insufficient", "technical")) -> DataFrame:
    """Action, hard label and weight of each sample.

    A sample that wasn't reviewed is kept.  Then, in this order: a technical failure or insufficient evidence is excluded
    (weight 0); an ambiguous case, one without votes, or one without unanimity is soft-labelled by the shares of votes
    (weight 0.5; without votes it is down-weighted); a unanimous vote for another class is a hard change, and one for the
    observed class keeps it.
    """
    d = vote_distribution(votes)
    best = d.groupBy("sample_id").agg(
        F.max("n_votes").alias("n_votes"),
        F.max(F.struct("n", (-F.col("vote")).alias("v"))).alias("_b"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("vote", "share")))).alias("soft_label"),
    )
    s = samples.join(best, "sample_id", "left")
    reviewed, ambiguous, insufficient, technical = (F.coalesce(F.col(c), F.lit(False)) for c in flags)
    majority, agreed = -F.col("_b.v"), F.col("_b.n") == F.col("n_votes")
    none = F.col("n_votes").isNull()
    action = (
        F.when(~reviewed, "keep")
        .when(technical | insufficient, "exclude")
        .when(none, "downweight")
        .when(ambiguous | ~agreed, "soft_label")
        .when(majority != F.col("observed_label"), "hard_change")
        .otherwise("keep")
    )
    s = s.withColumn("action", action)
    hard = F.when(F.col("action") == "hard_change", majority).otherwise(F.col("observed_label")).cast("int")
    weight = F.when(F.col("action") == "exclude", 0.0).when(F.col("action").isin("soft_label", "downweight"), 0.5).otherwise(1.0)
    soft = F.when(F.col("action") == "soft_label", F.col("soft_label"))
    return s.select("sample_id", "observed_label", "action", hard.alias("hard_label"), weight.alias("weight"), F.coalesce("n_votes", F.lit(0).cast("long")).alias("n_votes"), soft.alias("soft_label"))


def _entropy(probs: Column) -> Column:
    return -F.aggregate(probs, F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log(p)).otherwise(0.0))


def _kl(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


def jensen_shannon(p: Column, q: Column) -> Column:
    m = F.zip_with(p, q, lambda x, y: (x + y) / 2.0)
    return F.least(F.lit(LN2), F.greatest(F.lit(0.0), (_kl(p, m) + _kl(q, m)) / 2.0))


def ensemble_disagreement(long: DataFrame, classes: Sequence[int]) -> DataFrame:
    """From (sample_id, model_id, observed_label, probs): figures of disagreement of two or more models by sample.

    A sample's models are gathered in one row: as many vectors as there are models.
    """
    g = long.groupBy("sample_id", "observed_label").agg(F.array_sort(F.collect_list(F.struct("model_id", "probs"))).alias("_m"))
    models = F.transform("_m", lambda m: m["probs"])
    k = len(classes)
    g = g.withColumn("_p", models).withColumn("n_models", F.size("_m"))
    mean = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.aggregate("_p", F.lit(0.0), lambda a, p: a + F.get(p, j)) / F.col("n_models"))
    g = g.withColumn("mean_probs", mean)
    votes = F.transform("_p", lambda p: predicted_class(p, classes))
    g = g.withColumn("_v", votes)
    most = F.array_max(F.transform(F.array_distinct("_v"), lambda v: F.size(F.filter("_v", lambda x: x == v))))
    n = F.col("n_models")
    pairs = F.flatten(F.transform("_m", lambda a, i: F.transform(F.filter("_m", lambda b, j: j > i), lambda b: F.struct(a["probs"].alias("p"), b["probs"].alias("q")))))
    differs = lambda x: (predicted_class(x["p"], classes) != predicted_class(x["q"], classes)).cast("double")
    g = g.withColumn("_q", pairs)
    n_pairs = F.size("_q")
    own = F.transform("_p", lambda p: probability_of(p, F.col("observed_label"), classes))
    g = g.withColumn("_o", own)
    centre = F.aggregate("_o", F.lit(0.0), lambda a, x: a + x) / n
    g = g.withColumn("_c", centre)
    return g.select(
        "sample_id",
        "observed_label",
        "n_models",
        predicted_class(F.col("mean_probs"), classes).alias("mean_class"),
        _entropy(F.col("mean_probs")).alias("mean_entropy"),
        (1.0 - most / n).alias("variation_ratio"),
        (F.aggregate("_q", F.lit(0.0), lambda a, x: a + differs(x)) / n_pairs).alias("pairwise_disagreement"),
        (F.aggregate("_o", F.lit(0.0), lambda a, x: a + (x - F.col("_c")) * (x - F.col("_c"))) / n).alias("own_probability_variance"),
        (F.aggregate("_q", F.lit(0.0), lambda a, x: a + jensen_shannon(x["p"], x["q"])) / n_pairs).alias("mean_js_divergence"),
    )


def persistent_risk(history: DataFrame, *, threshold: float, checkpoint_share: float, model_share: float) -> DataFrame:
    """From (model_id, checkpoint, sample_id, risk): samples whose risk lasts, and their priority.

    A model is stable on a sample if its risk reaches the threshold at ``checkpoint_share`` of the checkpoints at least;
    the sample is persistent if ``model_share`` of the models are.  The priority is the percentile of the mean risk, 0 if
    not persistent.
    """
    per_model = history.groupBy("sample_id", "model_id").agg(
        F.avg((F.col("risk") >= threshold).cast("double")).alias("persistence"), F.sum("risk").alias("s"), F.sum(F.col("risk") * F.col("risk")).alias("q"), F.count(F.lit(1)).alias("n")
    )
    n = F.sum("n")
    samples = per_model.groupBy("sample_id").agg(
        F.avg("persistence").alias("checkpoint_persistence"),
        F.avg((F.col("persistence") >= checkpoint_share - 1e-12).cast("double")).alias("stable_fraction"),
        (F.sum("s") / n).alias("mean_risk"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum("q") / n - (F.sum("s") / n) * (F.sum("s") / n))).alias("std_risk"),
    )
    samples = samples.withColumn("persistent", F.col("stable_fraction") >= model_share - 1e-12).withColumn("mean_risk", F.round("mean_risk", 12))
    samples = percentile_normalise(samples, "mean_risk", names=["_p"])
    return samples.withColumn("priority", F.when(F.col("persistent"), F.col("_p")).otherwise(0.0)).drop("_p")


def predeclared_ensemble_risk(disagreement: DataFrame, primary: str) -> DataFrame:
    """The measure that was declared before as ``risk``."""
    if primary not in ("mean_entropy", "variation_ratio", "pairwise_disagreement", "own_probability_variance", "mean_js_divergence"):
        raise ValueError(f"unknown measure: {primary}")
    return disagreement.withColumn("risk", F.col(primary))


def blinded_package(manifest: DataFrame, ranking: DataFrame, n_top: int, n_random: int, seed: int, assets: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(public items, private key) of a review: the top of the ranking and uniform others under shuffled anonymous ids.

    The items hold an id and the assets' paths; labels, scores and where a sample came from are in the key alone.
    """
    one = ranking.join(manifest, "sample_id")
    top = one.orderBy(F.col("risk").desc(), F.col("sample_id").asc()).limit(n_top).withColumn("selection_source", F.lit("top"))
    rest = one.join(top.select("sample_id"), "sample_id", "left_anti")
    random = rest.withColumn("_u", unit_hash(seed, F.lit("cohort"), "sample_id")).orderBy("_u", "sample_id").limit(n_random).drop("_u")
    both = top.unionByName(random.withColumn("selection_source", F.lit("random")))
    order = W.orderBy(unit_hash(seed, F.lit("order"), "sample_id"), "sample_id")  # as many rows as reviewers read
    both = both.withColumn("review_id", F.concat(F.lit("review-"), F.lpad(F.row_number().over(order).cast("string"), 4, "0")))
    key = both.select("review_id", "sample_id", "observed_label", "risk", "selection_source")
    return both.select("review_id", *assets), key


def blinding_violations(items: DataFrame, key: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """What breaks the blinding: columns that tell too much, and ids that don't match one to one."""
    spark = items.sparkSession
    columns = spark.createDataFrame([("forbidden_column", c) for c in items.columns if c in set(forbidden)] or [], "rule string, detail string")
    lost = items.join(key, "review_id", "left_anti").select(F.lit("item_without_key").alias("rule"), F.col("review_id").alias("detail"))
    spare = key.join(items, "review_id", "left_anti").select(F.lit("key_without_item").alias("rule"), F.col("review_id").alias("detail"))
    twice = items.groupBy("review_id").count().where("count > 1").select(F.lit("repeated_item").alias("rule"), F.col("review_id").alias("detail"))
    return columns.unionByName(lost).unionByName(spare).unionByName(twice)
