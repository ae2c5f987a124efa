"""Features of image crops over long pixel tables: crops, highlights, histograms, intensities, texture, statistics.

A pixel table has one row for each pixel of a sample: sample_id, y, x, red, green, blue (0 to 255) and target (whether
the pixel is the target's).  All features are joins and aggregations; a sample's pixels are never gathered in one row.
Gradient histograms and convex hulls are left to producers of features outside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the channels in a grey value, and the four directions of texture.
GREY = (0.2989, 0.5870, 0.1140)
OFFSETS = ((0, 1), (1, 0), (1, 1), (1, -1))


def _edge(v: Column, n: Column) -> Column:
    return F.least(n - 1, F.greatest(F.lit(0), v))


def _reflect(v: Column, n: Column) -> Column:
    period = F.greatest(F.lit(1), 2 * (n - 1))
    r = F.pmod(v, period)
    return F.when(r > n - 1, period - r).otherwise(r)


def fixed_crop(pixels: DataFrame, centres: DataFrame, size: int, *, padding: str = "edge") -> DataFrame:
    """Square crops around (sample_id, image_id, centre_y, centre_x, height, width): pixels with crop coordinates.

    Places outside the image take the nearest pixel ('edge') or its mirror image ('reflect').  The size is even.
    """
    if size <= 0 or size % 2:
        raise ValueError("the size has to be a positive even number")
    index = {"edge": _edge, "reflect": _reflect}[padding]
    axis = F.sequence(F.lit(0), F.lit(size - 1))
    places = centres.select("sample_id", "image_id", "centre_y", "centre_x", "height", "width", F.explode(axis).alias("crop_y"))
    places = places.select("*", F.explode(axis).alias("crop_x"))
    places = places.select(
        "sample_id",
        "image_id",
        "crop_y",
        "crop_x",
        index(F.col("centre_y") - size // 2 + F.col("crop_y"), F.col("height")).cast("int").alias("y"),
        index(F.col("centre_x") - size // 2 + F.col("crop_x"), F.col("width")).cast("int").alias("x"),
    )
    return places.join(pixels, ["image_id", "y", "x"]).drop("y", "x").withColumnsRenamed({"crop_y": "y", "crop_x": "x"})


def target_box(pixels: DataFrame, *, padding: int = 6) -> DataFrame:
    """Square box around each target with padding, moved into the image: what a target crop is cut from."""
    size = pixels.groupBy("sample_id").agg(
        (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"),
        *[f(F.when(F.col("target"), F.col(c))).alias(c + n) for c in "xy" for f, n in ((F.min, "0"), (F.max, "1"))],
    )
    side = F.greatest(F.col("x1") + 1 - F.col("x0"), F.col("y1") + 1 - F.col("y0")) + 2 * padding

    def low_high(c: str, n: str) -> tuple[Column, Column]:
        start = F.greatest(F.lit(0), F.floor((F.col(f"{c}0") + F.col(f"{c}1") + 1) / 2.0 - side / 2.0))
        end = F.least(F.col(n), start + side)
        return F.greatest(F.lit(0), end - side), end

    (x0, x1), (y0, y1) = low_high("x", "width"), low_high("y", "height")
    return size.select("sample_id", *[v.cast("int").alias(k) for k, v in (("crop_x0", x0), ("crop_y0", y0), ("crop_x1", x1), ("crop_y1", y1))])


def highlight(pixels: DataFrame, brightness: float = 0.45) -> DataFrame:
    """Pixels outside the target dimmed, rounded half to even."""
    if not 0.0 <= brightness <= 1.0:
        raise ValueError("brightness has to be in [0, 1]")
    dim = lambda c: F.when(F.col("target"), F.col(c)).otherwise(F.rint(F.col(c) * brightness).cast("int"))
    return pixels.withColumns({c: dim(c) for c in ("red", "green", "blue")})


def grey(pixels: DataFrame) -> DataFrame:
    value = sum((F.col(c) / 255.0 * w for c, w in zip(("red", "green", "blue"), GREY)), F.lit(0.0))
    return pixels.withColumn("grey", value)


def colour_histogram(pixels: DataFrame, bins: int = 8) -> DataFrame:
    """Share of the target's pixels in each of ``bins`` equal bins of each channel, bins * 3 columns."""
    at = lambda c: F.least(F.lit(bins - 1), F.floor(F.col(c) / 255.0 * bins))
    shares = [F.avg((at(c) == i).cast("double")).alias(f"{c}_{i:02d}") for c in ("red", "green", "blue") for i in range(bins)]
    return pixels.where("target").groupBy("sample_id").agg(*shares)


def _boundary(pixels: DataFrame) -> DataFrame:
    """Add ``boundary``: target pixels that have one of eight neighbours outside the target or the image."""
    t = pixels.where("target").select("sample_id", "y", "x")
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    near = t.select("sample_id", "y", "x", steps.alias("s")).select("sample_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    full = near.groupBy("sample_id", "y", "x").agg(F.count(F.lit(1)).alias("_n"))
    out = pixels.join(full, ["sample_id", "y", "x"], "left")
    return out.withColumn("boundary", F.col("target") & (F.coalesce("_n", F.lit(0)) < 9)).drop("_n")


def intensity_features(pixels: DataFrame) -> DataFrame:
    """18 figures of grey values: of the target, its context, its boundary, and their differences.

    A target without context or interior stands in for it.
    """
    p = _boundary(grey(pixels))
    of = lambda c: F.when(c, F.col("grey"))
    target, context, edge, inner = of(F.col("target")), of(~F.col("target")), of(F.col("boundary")), of(F.col("target") & ~F.col("boundary"))
    q = lambda x: F.percentile(target, F.lit(x))
    s = p.groupBy("sample_id").agg(
        F.avg(target).alias("target_mean"), F.stddev_pop(target).alias("target_std"), F.min(target).alias("target_min"), F.max(target).alias("target_max"),
        *[q(x).alias(f"target_q{int(100 * x):02d}") for x in (0.1, 0.25, 0.5, 0.75, 0.9)],
        F.coalesce(F.avg(context), F.avg(target)).alias("context_mean"), F.coalesce(F.stddev_pop(context), F.stddev_pop(target)).alias("context_std"),
        F.avg(edge).alias("boundary_mean"), F.stddev_pop(edge).alias("boundary_std"), F.min(edge).alias("boundary_min"), F.max(edge).alias("boundary_max"),
        F.coalesce(F.avg(inner), F.avg(target)).alias("_inner"),
    )
    return s.withColumns(
        {
            "target_minus_context": F.col("target_mean") - F.col("context_mean"),
            "boundary_minus_interior": F.col("boundary_mean") - F.col("_inner"),
            "boundary_minus_context": F.col("boundary_mean") - F.col("context_mean"),
        }
    ).drop("_inner")


def texture(pixels: DataFrame, levels: int = 16) -> DataFrame:
    """Mean and population std over four directions of seven figures of the target's grey-level co-occurrences.

    Pairs of neighbouring target pixels count both ways; a target without a pair in a direction counts as one level
    with itself there, so the texture is neutral.
    """
    p = grey(pixels.where("target")).withColumn("v", F.least(F.lit(levels - 1), F.floor(F.col("grey") * levels)).cast("int")).select("sample_id", "y", "x", "v")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("d"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for i, (dy, dx) in enumerate(OFFSETS)]))
    a = p.select("sample_id", F.col("v").alias("i"), "y", "x", steps.alias("s"))
    a = a.select("sample_id", "i", F.col("s.d").alias("d"), (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    pairs = a.join(p.withColumnRenamed("v", "j"), ["sample_id", "y", "x"]).select("sample_id", "d", "i", "j")
    both = pairs.unionByName(pairs.select("sample_id", "d", F.col("j").alias("i"), F.col("i").alias("j")))
    n = both.groupBy("sample_id", "d", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("sample_id", "d").agg(
        F.sum("n").alias("t"), (F.sum(F.col("n") * F.col("i")) / F.sum("n")).alias("mi"), (F.sum(F.col("n") * F.col("j")) / F.sum("n")).alias("mj")
    )
    w = n.join(total, ["sample_id", "d"]).withColumn("p", F.col("n") / F.col("t"))
    delta = F.abs(F.col("i") - F.col("j")).cast("double")
    u, v = F.col("i") - F.col("mi"), F.col("j") - F.col("mj")
    spread = F.sqrt(F.sum(F.col("p") * u * u)) * F.sqrt(F.sum(F.col("p") * v * v))
    g = w.groupBy("sample_id", "d").agg(
        F.sum(F.col("p") * delta * delta).alias("contrast"),
        F.sum(F.col("p") * delta).alias("dissimilarity"),
        F.sum(F.col("p") / (1.0 + delta * delta)).alias("homogeneity"),
        F.sum(F.col("p") * F.col("p")).alias("angular_second_moment"),
        F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("energy"),
        F.when(spread > 2.220446049250313e-16, F.try_divide(F.sum(F.col("p") * u * v), spread)).otherwise(1.0).alias("correlation"),
        (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"),
    )
    neutral = {"contrast": 0.0, "dissimilarity": 0.0, "homogeneity": 1.0, "angular_second_moment": 1.0, "energy": 1.0, "correlation": 1.0, "entropy": 0.0}
    every = p.select("sample_id").distinct().select("sample_id", F.explode(F.lit(list(range(len(OFFSETS))))).alias("d"))
    g = every.join(g, ["sample_id", "d"], "left").fillna(neutral)
    return g.groupBy("sample_id").agg(*[f(c).alias(f"{c}_{name}") for name, f in (("mean", F.avg), ("std", F.stddev_pop)) for c in neutral])


def crop_statistics(pixels: DataFrame, boxes: DataFrame, size: int) -> DataFrame:
    """20 label-independent figures of square crops: colours over all and over the centre half, contrast, and the box.

    boxes: sample_id, xmin, ymin, xmax, ymax.
    """
    half, quarter = size // 2, size // 4
    centre = F.col("y").between(half - quarter, half + quarter - 1) & F.col("x").between(half - quarter, half + quarter - 1)
    aggs = []
    for c in ("red", "green", "blue"):
        v, m = F.col(c) / 255.0, F.when(centre, F.col(c) / 255.0)
        aggs += [F.avg(v).alias(f"{c}_mean"), F.stddev_pop(v).alias(f"{c}_std"), F.avg(m).alias(f"{c}_centre_mean"), F.stddev_pop(m).alias(f"{c}_centre_std")]
    s = pixels.groupBy("sample_id").agg(*aggs)
    s = s.withColumns({f"{c}_contrast": F.col(f"{c}_centre_mean") - F.col(f"{c}_mean") for c in ("red", "green", "blue")})
    w, h = (F.col("xmax") - F.col("xmin")).cast("double"), (F.col("ymax") - F.col("ymin")).cast("double")
    aspect = w / F.greatest(h, F.lit(1e-6))
    box = boxes.select(
        "sample_id",
        F.log1p(F.greatest(w, F.lit(0.0))).alias("log_width"),
        F.log1p(F.greatest(h, F.lit(0.0))).alias("log_height"),
        F.log1p(F.greatest(w * h, F.lit(0.0))).alias("log_area"),
        aspect.alias("aspect"),
        F.log(F.greatest(aspect, F.lit(1e-6))).alias("log_aspect"),
    )
    return s.join(box, "sample_id")
