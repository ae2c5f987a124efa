"""Quality control of label rasters and tables: roll-ups, geometry, overlaps, and violations of rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sievelight.operators.ranking import running


def mask_qc(pixels: DataFrame, class_channels: Sequence[int], background: int) -> DataFrame:
    """Figures of each patch of a long pixel table (fold, patch_id, y, x, channel, value).

    A pixel is void if neither a class nor the background covers it, and an overlap if several classes do; each pixel is
    background only, one class, several, or void, and the four sum to all pixels.
    """
    is_class = F.col("channel").isin(list(class_channels)) & (F.col("value") > 0)
    at = pixels.groupBy("fold", "patch_id", "y", "x").agg(
        F.sum(is_class.cast("int")).alias("c"), F.max(((F.col("channel") == background) & (F.col("value") > 0)).cast("int")).alias("b")
    )
    count = lambda c: F.sum(c.cast("long"))
    patches = at.groupBy("fold", "patch_id").agg(
        F.count(F.lit(1)).alias("n_pixels"),
        count((F.col("c") == 0) & (F.col("b") == 1)).alias("background_pixels"),
        count(F.col("c") == 1).alias("class_pixels"),
        count(F.col("c") > 1).alias("overlap_pixels"),
        count((F.col("c") == 0) & (F.col("b") == 0)).alias("void_pixels"),
        count((F.col("c") > 0) & (F.col("b") == 1)).alias("conflict_pixels"),
    )
    whole = F.col("background_pixels") + F.col("class_pixels") + F.col("overlap_pixels") + F.col("void_pixels")
    return patches.withColumn("partition_holds", whole == F.col("n_pixels"))


def qc_rollup(patches: DataFrame) -> DataFrame:
    """Patch figures summed by fold and, with a null fold, over all."""
    sums = ("n_pixels", "background_pixels", "class_pixels", "overlap_pixels", "void_pixels", "conflict_pixels")
    out = patches.rollup("fold").agg(F.count(F.lit(1)).alias("n_patches"), *[F.sum(c).alias(c) for c in sums], F.bool_and("partition_holds").alias("partition_holds"))
    return out.withColumn("overlap_rate", F.try_divide("overlap_pixels", "n_pixels")).withColumn("void_rate", F.try_divide("void_pixels", "n_pixels"))


def instance_geometry(pixels: DataFrame, class_channels: Sequence[int]) -> DataFrame:
    """Box, centroid, area, extent and 4-connected perimeter edges of each instance of a long pixel table."""
    p = pixels.where(F.col("channel").isin(list(class_channels)) & (F.col("value") > 0)).select("patch_id", "channel", F.col("value").alias("instance_id"), "y", "x")
    keys = ["patch_id", "channel", "instance_id"]
    # Neighbours in the row and in the column are the rows next in order if their coordinate is one more.
    right = F.lead("x").over(W.partitionBy(*keys, "y").orderBy("x")) == F.col("x") + 1
    below = F.lead("y").over(W.partitionBy(*keys, "x").orderBy("y")) == F.col("y") + 1
    inner = F.coalesce(right, F.lit(False)).cast("int") + F.coalesce(below, F.lit(False)).cast("int")
    p = p.withColumn("_inner", inner)
    out = p.groupBy(*keys).agg(
        F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"),
        F.avg("y").alias("centroid_y"), F.avg("x").alias("centroid_x"), F.count(F.lit(1)).alias("area"), (4 * F.count(F.lit(1)) - 2 * F.sum("_inner")).alias("perimeter"),
        F.var_pop("y").alias("_vy"), F.var_pop("x").alias("_vx"), F.covar_pop("y", "x").alias("_c"),
    )
    spread = F.sqrt(4 * F.col("_c") * F.col("_c") + (F.col("_vy") - F.col("_vx")) * (F.col("_vy") - F.col("_vx")))
    major, minor = (F.col("_vy") + F.col("_vx") + spread) / 2, (F.col("_vy") + F.col("_vx") - spread) / 2
    eccentricity = F.when(major > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - minor / major))).otherwise(0.0)
    box = (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    return out.withColumn("extent", F.col("area") / box).withColumn("eccentricity", eccentricity).drop("_vy", "_vx", "_c")


def class_pair_overlap(pixels: DataFrame, class_channels: Sequence[int]) -> DataFrame:
    """Pixels that each pair of classes shares."""
    p = pixels.where(F.col("channel").isin(list(class_channels)) & (F.col("value") > 0))
    at = p.groupBy("patch_id", "y", "x").agg(F.array_sort(F.collect_set("channel")).alias("c")).where(F.size("c") > 1)
    pairs = F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: b > a), lambda b: F.struct(a.alias("first_class"), b.alias("second_class")))))
    return at.select(F.explode(pairs).alias("p")).groupBy("p.first_class", "p.second_class").agg(F.count(F.lit(1)).alias("n_pixels"))


def reused_instance_ids(pixels: DataFrame, class_channels: Sequence[int]) -> DataFrame:
    """Instance ids that stand in several class channels of a patch."""
    p = pixels.where(F.col("channel").isin(list(class_channels)) & (F.col("value") > 0))
    return p.groupBy("patch_id", F.col("value").alias("instance_id")).agg(F.countDistinct("channel").alias("n_classes")).where("n_classes > 1")


def overlap_evidence(pixels: DataFrame, class_channels: Sequence[int]) -> DataFrame:
    """For each instance the sorted list of (channel, instance, shared pixels) of others that it overlaps."""
    p = pixels.where(F.col("channel").isin(list(class_channels)) & (F.col("value") > 0)).select("patch_id", "y", "x", "channel", F.col("value").alias("instance_id"))
    o = p.select("patch_id", "y", "x", F.col("channel").alias("c2"), F.col("instance_id").alias("i2"))
    met = p.join(o, ["patch_id", "y", "x"]).where((F.col("channel") != F.col("c2")) | (F.col("instance_id") != F.col("i2")))
    n = met.groupBy("patch_id", "channel", "instance_id", "c2", "i2").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("patch_id", "channel", "instance_id").agg(F.array_sort(F.collect_list(F.struct(F.col("c2").alias("channel"), F.col("i2").alias("instance_id"), "n"))).alias("overlaps"))


def colour_statistics(pixels: DataFrame, by: Sequence[str], channels: Sequence[str] = ("red", "green", "blue")) -> DataFrame:
    """Mean, population std and range of each colour over the pixels of a group: nine columns."""
    aggs = []
    for c in channels:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), (F.max(c) - F.min(c)).alias(f"{c}_range")]
    return pixels.groupBy(*by).agg(*aggs)


def interleave(df: DataFrame, category: str, fold: str, index: str) -> DataFrame:
    """Order rows round robin: the first of every category and fold, then the second, and so on; ``position`` from 0."""
    place = F.row_number().over(W.partitionBy(category, fold).orderBy(index))
    placed = running(df.withColumn("_offset", place), {"position": F.lit(1)}, "_offset", then=[category, fold, index], descending=False)
    return placed.withColumn("position", (F.col("position") - 1).cast("int")).drop("_offset")


def balanced_subset(df: DataFrame, fold: str, order: str, total: int) -> DataFrame:
    """``total`` rows, as many of each fold as of the others; what is left over goes to the lowest folds."""
    folds = df.select(fold).distinct()
    n = folds.agg(F.count(F.lit(1)).alias("_n"))
    folds = folds.withColumn("_f", F.row_number().over(W.orderBy(fold)) - 1).crossJoin(F.broadcast(n))
    quota = F.floor(F.lit(total) / F.col("_n")) + (F.col("_f") < F.lit(total) % F.col("_n")).cast("int")
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(fold).orderBy(order)))
    return ranked.join(folds.select(fold, quota.alias("_q")), fold).where(F.col("_r") <= F.col("_q")).drop("_r", "_q")


def rule_violations(df: DataFrame, row_id: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, row id) for each row that breaks a rule: one pass.  A rule is the condition of a violation; null is none."""
    broken = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.col(row_id), F.explode(broken).alias("rule"))


def manifest_violations(df: DataFrame, n_classes: int) -> DataFrame:
    """Violations of a sample table's rules, besides repeated ids and positions that aren't 0 .. n-1 in their patch."""
    label = F.col("observed_label")
    rules = {
        "missing_sample_id": F.col("sample_id").isNull(),
        "missing_group": F.col("group_id").isNull(),
        "label_out_of_range": label.isNull() | (label < 0) | (label >= n_classes),
        "flag_disagrees": F.col("is_corrupted") != (F.col("pre_corruption_label") != label),
        "features_not_finite": F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))),
    }
    rows = rule_violations(df, "sample_id", {k: F.coalesce(v, F.lit(True)) for k, v in rules.items()})
    twice = df.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sample_id", F.lit("repeated_sample_id").alias("rule"))
    return rows.unionByName(twice)


def not_constant(df: DataFrame, group: str, value: str) -> DataFrame:
    """Groups in which a value isn't the same in all rows; null counts as a value."""
    out = df.groupBy(group).agg(F.countDistinct(value).alias("_d"), F.max(F.col(value).isNull().cast("int")).alias("_n"))
    return out.select(group, (F.col("_d") + F.col("_n")).alias("n_values")).where("n_values > 1")


def require_empty(violations: DataFrame, what: str) -> None:
    """Fail closed: raise if the table has a row."""
    first = violations.limit(1).collect()
    if first:
        raise ValueError(f"{what}: {first[0].asDict()}")


def value_scan(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Least and greatest value, distinct values, and whether all are finite, not negative and whole."""
    v = F.col(value)
    finite = v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v) != float("inf"))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.countDistinct(v).alias("n_distinct"),
        F.bool_and(finite).alias("all_finite"), F.bool_and(F.coalesce(v >= 0, F.lit(False))).alias("all_nonnegative"), F.bool_and(F.coalesce(v == F.floor(v), F.lit(False))).alias("all_whole"),
    )


def reconcile(saved: DataFrame, computed: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows of saved and recomputed figures that differ, or that one side lacks; nothing if all agree."""
    s = saved.select(*keys, *[F.col(v).alias(f"saved_{v}") for v in values], F.lit(True).alias("_s"))
    c = computed.select(*keys, *[F.col(v).alias(f"computed_{v}") for v in values], F.lit(True).alias("_c"))
    both = s.join(c, list(keys), "full")
    differs = F.col("_s").isNull() | F.col("_c").isNull()
    for v in values:
        a, b = F.col(f"saved_{v}"), F.col(f"computed_{v}")
        differs = differs | ~F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())
    return both.where(differs).drop("_s", "_c")


def collapse_to_parent(df: DataFrame, parent: str, constant: Sequence[str]) -> DataFrame:
    """One row of each parent with the columns that have to be the same in all its rows; raises if one isn't."""
    for c in constant:
        require_empty(not_constant(df, parent, c), f"{c} isn't constant in {parent}")
    return df.groupBy(parent).agg(*[F.first(c).alias(c) for c in constant], F.count(F.lit(1)).alias("n_rows"))


def set_differences(before: DataFrame, after: DataFrame, path: str = "path", content: str = "sha256") -> DataFrame:
    """Files that are missing, added or changed between two inventories."""
    b = before.select(path, F.col(content).alias("_b"))
    a = after.select(path, F.col(content).alias("_a"))
    change = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "added").when(F.col("_a") != F.col("_b"), "changed")
    return b.join(a, path, "full").select(path, change.alias("change")).where("change is not null")


def lookup_in_order(df: DataFrame, wanted: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Rows of ``df`` for the wanted keys with their ordinals; raises if a key is missing or ``df`` has one twice."""
    require_empty(wanted.join(df.select(key), key, "left_anti"), "missing ids")
    require_empty(df.join(wanted.select(key), key, "left_semi").groupBy(key).count().where("count > 1"), "repeated ids")
    return wanted.select(key, ordinal).join(df, key)


def join_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of two tables with unique keys; raises on a repeated key or an empty result."""
    for side, name in ((left, "left"), (right, "right")):
        require_empty(side.groupBy(key).count().where("count > 1"), f"repeated key, {name}")
    joined = left.join(right, key)
    if not joined.limit(1).count():
        raise ValueError("the join is empty")
    return joined


def paired_alignment(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one of two tables has: nothing if they align."""
    a, b = first.select(*keys).withColumn("_a", F.lit(1)), second.select(*keys).withColumn("_b", F.lit(1))
    both = a.join(b, list(keys), "full")
    return both.where("_a is null or _b is null").select(*keys, F.when(F.col("_a").isNull(), "second").otherwise("first").alias("only_in"))


def exclusion_reasons(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Add ``exclusion_reason``: the first reason that holds, null for rows that stay."""
    reason = F.lit(None).cast("string")
    for name, condition in reversed(list(reasons.items())):
        reason = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(reason)
    return df.withColumn("exclusion_reason", reason)


def map_labels(df: DataFrame, raw: str, mapping: dict[str, str | None]) -> DataFrame:
    """Add ``mapped_label`` by a fixed table; a label that the table lacks raises.  A null target excludes the label."""
    table = df.sparkSession.createDataFrame(list(mapping.items()), "_raw string, mapped_label string")
    joined = df.join(F.broadcast(table), F.col(raw) == F.col("_raw"), "left")  # as many rows as the mapping
    require_empty(joined.where(F.col("_raw").isNull() & F.col(raw).isNotNull()).select(raw), "unknown labels")
    return joined.drop("_raw")
