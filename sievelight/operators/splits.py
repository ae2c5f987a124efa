"""Group-safe splits, folds and controlled label noise, all by hashes so that every run and engine agrees."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sievelight.functions.scalars import class_list, exact_corruption_count, l2_distance, normalise_rate, salted, unit_hash


def stratified_case_split(df: DataFrame, case: str, stratum: str, per_stratum: int, salt: str) -> DataFrame:
    """Add ``part``: the first ``per_stratum`` cases of each stratum by salted hash are 'final', the others 'development'."""
    order = W.partitionBy(stratum).orderBy(salted(salt, F.col(case)), F.col(case))
    part = F.when(F.row_number().over(order) <= per_stratum, F.lit("final")).otherwise(F.lit("development"))
    return df.withColumn("part", part)


def spanning_groups(df: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups that stand in several folds: leakage, which has to be empty."""
    return df.groupBy(group).agg(F.countDistinct(fold).alias("n_folds")).where("n_folds > 1")


def _shares(groups: DataFrame, group: str, seed: int, label: str) -> DataFrame:
    order = W.orderBy(unit_hash(seed, F.lit(label), group), F.col(group))
    return groups.withColumn("_r", F.row_number().over(order)).withColumn("_g", F.count(F.lit(1)).over(W.partitionBy()))


def outer_split(df: DataFrame, group: str, fold: str, final_fold: int, validation_fraction: float, seed: int) -> DataFrame:
    """Add ``partition``: the official final fold is 'final'; of the other groups, the fraction rounded up validates.

    Raises if a group spans folds.  The groups' table is a small dimension.
    """
    if spanning_groups(df, group, fold).limit(1).count():
        raise ValueError("a group spans several folds")
    groups = _shares(df.where(F.col(fold) != final_fold).select(group).distinct(), group, seed, "outer")
    wanted = F.least(F.col("_g") - 1, F.ceil(F.col("_g") * F.lit(float(validation_fraction))))
    groups = groups.select(group, F.when(F.col("_r") <= wanted, "validation").otherwise("development").alias("_p"))
    return df.join(groups, group, "left").withColumn("partition", F.when(F.col(fold) == final_fold, "final").otherwise(F.col("_p"))).drop("_p")


def fractional_split(df: DataFrame, group: str, final_fraction: float, validation_fraction: float, seed: int) -> DataFrame:
    """Add ``partition`` by fractions of the groups: at least one final group and one of the others left on each side."""
    groups = _shares(df.select(group).distinct(), group, seed, "fractional")
    final = F.greatest(F.lit(1), F.least(F.col("_g") - 2, F.ceil(F.col("_g") * F.lit(float(final_fraction)))))
    rest = F.col("_g") - final
    validation = F.greatest(F.lit(1), F.least(rest - 1, F.ceil(rest * F.lit(float(validation_fraction)))))
    part = F.when(F.col("_r") <= final, "final").when(F.col("_r") <= final + validation, "validation").otherwise("development")
    return df.join(groups.select(group, part.alias("partition")), group)


def coverage_violations(df: DataFrame, row_id: str) -> DataFrame:
    """Ids that don't occur exactly once."""
    return df.groupBy(row_id).agg(F.count(F.lit(1)).alias("n")).where("n <> 1")


def group_overlap(df: DataFrame, group: str, partition: str) -> DataFrame:
    """Groups that stand in several partitions."""
    return df.groupBy(group).agg(F.countDistinct(partition).alias("n_partitions")).where("n_partitions > 1")


def group_fold_plan(df: DataFrame, group: str, label: str, n_splits: int, seed: int) -> pd.DataFrame:
    """Folds for whole groups with class shares alike (group, fold), by greedy assignment.

    Only the groups' class counts come to the driver.  Groups with the most uneven counts go first, each to the fold
    that leaves the class counts over the folds most even, then to the smaller fold.  If a class stands in one group
    only, or a training side would lack a class, the groups are dealt by size alone.
    """
    counts = df.groupBy(group, label).count().toPandas().pivot(index=group, columns=label, values="count").fillna(0.0).sort_index()
    if len(counts) < n_splits:
        raise ValueError("fewer groups than folds")
    table, names = counts.to_numpy(float), list(counts.index)
    shuffled = np.random.default_rng(seed).permutation(len(names))
    order = sorted(shuffled, key=lambda i: -table[i].std())
    folds, fold_of = np.zeros((n_splits, table.shape[1])), {}
    for i in order:
        best = min(range(n_splits), key=lambda f: (_unevenness(folds, f, table[i], table.sum(0)), folds[f].sum()))
        folds[best] += table[i]
        fold_of[names[i]] = best
    lacking = any(((folds.sum(0) - folds[f]) <= 0).any() for f in range(n_splits))
    if lacking or len(set(fold_of.values())) < n_splits:
        folds, fold_of = np.zeros(n_splits), {}
        for i in sorted(shuffled, key=lambda i: -table[i].sum()):
            best = int(folds.argmin())
            folds[best] += table[i].sum()
            fold_of[names[i]] = best
    return pd.DataFrame({group: list(fold_of), "fold": list(fold_of.values())}).sort_values(group, ignore_index=True)


def _unevenness(folds: np.ndarray, at: int, add: np.ndarray, total: np.ndarray) -> float:
    trial = folds.copy()
    trial[at] += add
    return float(np.mean(np.std(trial / np.maximum(total, 1.0), axis=0)))


def reference_groups(df: DataFrame, group: str, label: str, fraction: float, seed: int) -> list:
    """Groups for a clean reference set whose class shares are closest to the whole, taken one at a time.

    Greedy on the driver over the groups' class counts: each step takes the group that leaves the least L1 distance of
    class shares, then the least error of the size, then by seeded order and name; both sides keep every class.
    """
    counts = df.groupBy(group, label).count().toPandas().pivot(index=group, columns=label, values="count").fillna(0.0).sort_index()
    table, names = counts.to_numpy(float), list(counts.index)
    wanted = max(1, int(np.ceil(len(names) * fraction)))
    place = {int(g): r for r, g in enumerate(np.random.default_rng(seed).permutation(len(names)))}
    total, chosen = table.sum(0), []
    while len(chosen) < wanted:
        now = table[chosen].sum(0)

        def cost(i: int) -> tuple:
            after = now + table[i]
            lack = int((after <= 0).sum()) if len(chosen) + 1 == wanted else 0
            gone = int(((total - after) <= 0).sum())
            goal = total.sum() * (len(chosen) + 1) / len(names)
            return gone, lack, round(float(np.abs(after / after.sum() - total / total.sum()).sum()), 12), abs(after.sum() - goal), place[i], names[i]

        chosen.append(min((i for i in range(len(names)) if i not in chosen), key=cost))
    return sorted(names[i] for i in chosen)


def _chosen(df: DataFrame, rate: float, keys: Sequence[Column]) -> DataFrame:
    """Mark the first rows by ``keys``, as many as the rate asks for, as ``is_corrupted``."""
    from sievelight.operators.ranking import running

    total = df.agg(F.count(F.lit(1)).alias("_n"))
    df = df.withColumn("_key", keys[0])
    ranked = running(df, {"_rank": F.lit(1).cast("long")}, "_key", then=["sample_id"], descending=False).crossJoin(F.broadcast(total))
    return ranked.withColumn("is_corrupted", F.col("_rank") <= exact_corruption_count(F.col("_n"), normalise_rate(rate))).drop("_key", "_rank", "_n")


def _finish(df: DataFrame, replacement: Column, label: str) -> DataFrame:
    observed = F.coalesce(F.when(F.col("is_corrupted"), replacement), F.col(label)).cast("int")
    return df.withColumn("pre_corruption_label", F.col(label)).withColumn("observed_label", observed)


def corrupt_symmetric(df: DataFrame, rate: float, classes: Sequence[int], seed: int, label: str = "observed_label") -> DataFrame:
    """Uniform rows get a uniform other class.  Adds is_corrupted and pre_corruption_label, replaces observed_label."""
    k = len(classes)
    chosen = _chosen(df, rate, [unit_hash(seed, F.lit("row"), "sample_id")])
    at = F.array_position(class_list(classes), F.col(label)) - 1
    draw = F.floor(unit_hash(seed, F.lit("class"), "sample_id") * (k - 1))
    return _finish(chosen, F.element_at(class_list(classes), (draw + (draw >= at).cast("int") + 1).cast("int")), label)


def corrupt_targeted(df: DataFrame, rate: float, matrix: Sequence[Sequence[float]], classes: Sequence[int], seed: int, label: str = "observed_label") -> DataFrame:
    """Uniform rows get a class drawn from their class's row of a matrix of confusions.

    Rows of the matrix are made to sum to 1 off the diagonal; an empty row is uniform over the other classes.
    """
    rows = []
    for i, row in enumerate(matrix):
        r = [0.0 if j == i else float(x) for j, x in enumerate(row)]
        total = sum(r)
        r = [x / total for x in r] if total > 0 else [0.0 if j == i else 1.0 / (len(r) - 1) for j in range(len(r))]
        rows.append([float(x) for x in np.cumsum(r)])
    chosen = _chosen(df, rate, [unit_hash(seed, F.lit("row"), "sample_id")])
    own = F.element_at(F.lit(rows), F.array_position(class_list(classes), F.col(label)).cast("int"))
    u = unit_hash(seed, F.lit("class"), "sample_id")
    at = F.least(F.size(F.filter(own, lambda c: c <= u)), F.lit(len(classes) - 1))
    return _finish(chosen, F.element_at(class_list(classes), at + 1), label)


def next_class_matrix(k: int, weight: float = 4.0) -> list[list[float]]:
    """Confusions with the next class that weigh ``weight`` times those with the others."""
    return [[0.0 if i == j else weight if j == (i + 1) % k else 1.0 for j in range(k)] for i in range(k)]


def corrupt_by_group(df: DataFrame, rate: float, classes: Sequence[int], seed: int, group: str, weights: Sequence[float] = (2.0, 1.0, 0.5), label: str = "observed_label") -> DataFrame:
    """Rows are drawn without replacement by their group's weight (exponential keys), and get a uniform other class.

    Groups take the weights in turn, by name.
    """
    place = df.select(group).distinct().withColumn("_w", F.element_at(F.lit(list(map(float, weights))), (F.row_number().over(W.orderBy(group)) - 1) % len(weights) + 1))
    weighted = df.join(place, group)
    u = F.greatest(unit_hash(seed, F.lit("row"), "sample_id"), F.lit(2.0**-53))
    chosen = _chosen(weighted, rate, [-F.log(u) / F.col("_w")]).drop("_w")
    k = len(classes)
    at = F.array_position(class_list(classes), F.col(label)) - 1
    draw = F.floor(unit_hash(seed, F.lit("class"), "sample_id") * (k - 1))
    return _finish(chosen, F.element_at(class_list(classes), (draw + (draw >= at).cast("int") + 1).cast("int")), label)


def standardisation(df: DataFrame, features: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation of each feature as arrays (n, mean, std); stds under 1e-12 count as 1."""
    long = df.select(*by, F.posexplode(features).alias("pos", "x"))
    stats = long.groupBy(*by, "pos").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    gather = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c])
    out = stats.groupBy(*by).agg(F.max("n").alias("n"), gather("m").alias("mean"), gather("s").alias("std"))
    return out.withColumn("std", F.transform("std", lambda s: F.when(s < 1e-12, F.lit(1.0)).otherwise(s)))


def centroids(df: DataFrame, features: str, label: str) -> DataFrame:
    """Mean feature vector of each class."""
    long = df.select(F.col(label).alias("class"), F.posexplode(features).alias("pos", "x"))
    means = long.groupBy("class", "pos").agg(F.avg("x").alias("m"))
    return means.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centroid"))


def corrupt_instances(df: DataFrame, rate: float, features: str = "features", label: str = "observed_label") -> DataFrame:
    """Rows whose standardised features are nearest to another class's centroid, relative to their own, get that class.

    The margin is the distance to the nearest other centroid minus that to the own; the least margins go first, ties by
    id.  The centroids are a row a class.
    """
    stats = standardisation(df, features).select(F.col("mean").alias("_m"), F.col("std").alias("_s"))
    scaled = df.crossJoin(F.broadcast(stats))
    scaled = scaled.withColumn("_z", F.transform(F.arrays_zip(F.col(features).alias("x"), F.col("_m").alias("m"), F.col("_s").alias("s")), lambda q: (q["x"] - q["m"]) / q["s"])).drop("_m", "_s")
    table = centroids(scaled, "_z", label).agg(F.array_sort(F.collect_list(F.struct("class", "centroid"))).alias("_c"))
    near = scaled.crossJoin(F.broadcast(table))
    distances = F.transform("_c", lambda c: F.struct(F.round(l2_distance(F.col("_z"), c["centroid"]), 9).alias("d"), c["class"].alias("class")))
    near = near.withColumn("_d", distances)
    near = near.withColumn("_other", F.array_min(F.filter("_d", lambda d: d["class"] != F.col(label))))
    own = F.element_at(F.filter("_d", lambda d: d["class"] == F.col(label)), 1)["d"]
    near = near.withColumn("ambiguity_margin", F.round(F.col("_other.d") - own, 9))
    chosen = _chosen(near.drop("_z", "_c", "_d"), rate, [F.col("ambiguity_margin")])
    return _finish(chosen, F.col("_other.class"), label).drop("_other")


def corruption_manifest(df: DataFrame) -> DataFrame:
    """Rows by class before and after, and whether the flag agrees with the labels."""
    agrees = F.col("is_corrupted") == (F.col("pre_corruption_label") != F.col("observed_label"))
    return df.groupBy("pre_corruption_label", "observed_label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_corrupted").cast("long")).alias("n_corrupted"), F.sum((~agrees).cast("long")).alias("n_inconsistent")
    )


def restore_labels(df: DataFrame, reviewed: Column) -> DataFrame:
    """Add ``restored_label``: the label before corruption where a corrupted row was reviewed, else the observed one."""
    restored = F.when(reviewed & F.col("is_corrupted"), F.col("pre_corruption_label")).otherwise(F.col("observed_label"))
    return df.withColumn("restored_label", restored)


def study_cells(spark, mechanisms: Sequence[str], rates: Sequence[float], seeds: Sequence[int], representations: Sequence[str], classifiers: Sequence[str]) -> DataFrame:
    """Every scenario (mechanism, rate, seed, besides the clean one) with every representation and classifier."""
    each = lambda xs: F.explode(F.lit(list(xs)))
    scenarios = spark.range(1).select(each(mechanisms).alias("mechanism")).select("*", each([float(r) for r in rates]).alias("rate")).select("*", each(seeds).alias("seed"))
    clean = spark.range(1).select(F.lit("clean").alias("mechanism"), F.lit(0.0).alias("rate"), F.lit(0).alias("seed"))
    cells = scenarios.unionByName(clean).select("*", each(representations).alias("representation")).select("*", each(classifiers).alias("classifier"))
    parts = [F.col("mechanism"), F.format_string("%.4f", "rate"), F.col("seed").cast("string"), F.col("representation"), F.col("classifier")]
    return cells.withColumn("cell_id", F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))
