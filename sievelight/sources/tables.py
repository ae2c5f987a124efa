"""Input tables of the registered queries, made from the Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions.scalars import l2_distance, softmax, unit_hash
from sievelight.operators.splits import centroids

CLASSES = tuple(range(10))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    group = F.pmod("vec_id", F.lit(25))
    return e.select(
        F.concat(F.lit("s"), F.lpad(F.col("vec_id").cast("string"), 8, "0")).alias("sample_id"),
        F.concat(F.lit("g"), group.cast("string")).alias("group_id"),
        F.pmod(group, F.lit(5)).cast("int").alias("fold_id"),
        F.concat(F.lit("t"), F.pmod("vec_id", F.lit(4)).cast("string")).alias("tissue"),
        F.col("label").cast("int").alias("observed_label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"),
    )


def with_probs(s: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Samples with ``probs``: the softmax of the negative distances to the class means (a row a class)."""
    means = centroids(s, "features", "observed_label").withColumn("centroid", F.transform("centroid", lambda x: F.round(x, 9)))
    table = means.agg(F.array_sort(F.collect_list(F.struct("class", "centroid"))).alias("_c"))
    near = s.crossJoin(F.broadcast(table))
    distances = F.transform("_c", lambda c: -F.round(l2_distance(F.col("features"), c["centroid"]), 9) / temperature)
    return near.withColumn("probs", F.transform(softmax(distances), lambda p: F.round(p, 9))).drop("_c")


def probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_probs(samples(spark, sf_dir), 0.1)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: event (toxic), score (characters), subgroup (language), grp (source)."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    l = spark.read.parquet(f"{sf_dir}/labels.parquet")  # noqa: E741
    return l.join(d, "doc_id").select(
        "doc_id", (F.col("toxic") == 1).alias("event"), F.col("n_chars").cast("double").alias("score"), F.col("lang").alias("subgroup"), F.col("source").alias("grp"), "quality"
    )


def ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines: event (returned), score (discount, few values), grp (supplier)."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.col("l_returnflag") == "R").alias("event"), F.col("l_discount").cast("double").alias("score"), F.col("l_suppkey").alias("grp")
    )


def votes(s: DataFrame) -> DataFrame:
    """Three reviewers' votes; some are missing, some for the next classes."""
    long = s.select("sample_id", "observed_label", F.explode(F.array(*[F.lit(r) for r in range(3)])).alias("reviewer_id"))
    u = unit_hash("vote", "sample_id", "reviewer_id")
    vote = F.when(u < 0.1, F.lit(None)).when(u < 0.7, F.col("observed_label")).when(u < 0.9, F.pmod(F.col("observed_label") + 1, F.lit(10))).otherwise(F.pmod(F.col("observed_label") + 2, F.lit(10)))
    return long.select("sample_id", "reviewer_id", vote.cast("int").alias("vote"))


def ensemble(s: DataFrame) -> DataFrame:
    out = None
    for m, t in enumerate((0.1, 0.25, 0.5)):
        shifted = s.withColumn("features", F.transform("features", lambda x, i: x + F.when(F.pmod(i, F.lit(3)) == m, 0.05).otherwise(0.0)))
        one = with_probs(s, t).select("sample_id", "observed_label", "probs") if m == 0 else with_probs(shifted, t).select("sample_id", "observed_label", "probs")
        one = one.withColumn("model_id", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


def risk_history(s: DataFrame) -> DataFrame:
    """Risks of three models at three checkpoints."""
    grid = F.array(*[F.struct(F.lit(m).alias("model_id"), F.lit(c).alias("checkpoint")) for m in range(3) for c in range(3)])
    long = s.select("sample_id", F.explode(grid).alias("g")).select("sample_id", "g.model_id", "g.checkpoint")
    return long.withColumn("risk", F.round(0.4 + 0.6 * unit_hash("risk", "sample_id") * 0.7 + 0.18 * unit_hash("step", "sample_id", "model_id", "checkpoint"), 9))


def pixels(spark: SparkSession, n_patches: int = 12, height: int = 13, width: int = 11) -> DataFrame:
    """A long raster: two instances in channels 0 and 1 that overlap in odd patches, background elsewhere, some void."""
    size = height * width
    p = spark.range(n_patches * size * 3).select(
        F.floor(F.col("id") / (size * 3)).cast("int").alias("patch_id"), F.floor(F.col("id") % (size * 3) / 3).cast("int").alias("_p"), (F.col("id") % 3).cast("int").alias("channel")
    )
    p = p.select("patch_id", F.floor(F.col("_p") / width).cast("int").alias("y"), (F.col("_p") % width).cast("int").alias("x"), "channel")
    odd = F.col("patch_id") % 2
    first = (F.col("y").between(2, 6)) & F.col("x").between(1, 5)
    second = F.col("y").between(6 - odd, 9) & F.col("x").between(4, 8)
    second = second & ((odd == 1) | (F.col("y") > 6))
    void = (F.col("y") == 0) & (F.col("x") < odd)
    value = (
        F.when((F.col("channel") == 0) & first, 1 + F.col("patch_id") % 3)
        .when((F.col("channel") == 1) & second, 2)
        .when((F.col("channel") == 2) & ~first & ~second & ~void, 1)
        .otherwise(0)
    )
    return p.select((F.col("patch_id") % 3).alias("fold"), "patch_id", "y", "x", "channel", value.cast("int").alias("value"))


def crops(spark: SparkSession, n: int = 8, size: int = 12) -> DataFrame:
    """Small colour images with a target in each, as a pixel table; sample i has a larger target for larger i."""
    p = spark.range(n * size * size).select(
        F.floor(F.col("id") / (size * size)).cast("int").alias("sample_id"), F.floor(F.col("id") % (size * size) / size).cast("int").alias("y"), (F.col("id") % size).cast("int").alias("x")
    )
    colour = lambda a, b, c: ((F.col("sample_id") * a + F.col("y") * b + F.col("x") * c + F.col("y") * F.col("x")) % 256).cast("int")
    target = F.col("y").between(3, 4 + F.col("sample_id") % 5) & F.col("x").between(2, 3 + F.col("sample_id") % 7)
    return p.select("sample_id", F.col("sample_id").alias("image_id"), "y", "x", colour(31, 17, 11).alias("red"), colour(7, 29, 5).alias("green"), colour(13, 3, 23).alias("blue"), target.alias("target"))


def crop_boxes(spark: SparkSession, n: int = 8) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("sample_id"), F.lit(2).alias("xmin"), F.lit(3).alias("ymin"), (4 + F.col("id") % 7).cast("int").alias("xmax"), (5 + F.col("id") % 5).cast("int").alias("ymax"))
