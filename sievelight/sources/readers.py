"""Sources: manifests, tables, unions of CSV files, GeoJSON, XML polygons, arrays, inventories, a generator.

Paths are opened by Spark, so any store that Spark reads will do; only ``load_config`` reads a driver's file.
"""

from __future__ import annotations

import io
import json
import sqlite3
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.functions.scalars import box_centre, unit_hash
from sievelight.operators.qc import require_empty

#: Schema of a sample table: what the operators of this library expect.
SAMPLES = T.StructType(
    [
        T.StructField("sample_id", T.StringType(), False),
        T.StructField("group_id", T.StringType(), False),
        T.StructField("fold_id", T.IntegerType(), True),
        T.StructField("tissue", T.StringType(), True),
        T.StructField("observed_label", T.IntegerType(), False),
        T.StructField("pre_corruption_label", T.IntegerType(), True),
        T.StructField("is_corrupted", T.BooleanType(), True),
        T.StructField("features", T.ArrayType(T.DoubleType()), True),
    ]
)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_manifest(spark: SparkSession, path: str, *, schema: T.StructType | str | None = None, required: Sequence[str] = ()) -> DataFrame:
    """A table by its suffix: .csv (with a header), .parquet or .json (lines); adds nothing, checks required columns."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        df = reader.option("header", True).option("inferSchema", schema is None).csv(path)
    elif kind in ("parquet", "pq"):
        df = reader.parquet(path)
    elif kind in ("json", "jsonl"):
        df = reader.json(path)
    else:
        raise ValueError(f"unknown suffix: {path}")
    return require_columns(df, required)


def read_table(spark: SparkSession, table: str | DataFrame | Sequence[Mapping], *, schema: T.StructType | str | None = None, required: Sequence[str] = ()) -> DataFrame:
    """A path, a DataFrame or rows given as mappings."""
    if isinstance(table, DataFrame):
        return require_columns(table, required)
    if isinstance(table, str):
        return read_manifest(spark, table, schema=schema, required=required)
    return require_columns(spark.createDataFrame([dict(r) for r in table], schema), required)


def read_csv_union(spark: SparkSession, pattern: str, *, required: Sequence[str], anchor: Sequence[str]) -> DataFrame:
    """All CSV files of a pattern with the file's name and stem; unnamed columns go, a repeated anchor raises."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(pattern)
    df = df.drop(*[c for c in df.columns if c.startswith(("Unnamed:", "_c"))])
    df = require_columns(df, required).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    df = df.withColumn("source_stem", F.regexp_replace("source_file", r"\.[^.]*$", ""))
    require_empty(df.groupBy(*anchor).count().where("count > 1"), "repeated anchors")
    return df


def read_geojson(spark: SparkSession, path: str, *, label: str = "properties.classification.name") -> DataFrame:
    """Features of GeoJSON files: file, position, raw label, box of all coordinates and its centre (half to even)."""
    raw = spark.read.text(path, wholetext=True).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    features = F.from_json(F.get_json_object("value", "$.features"), "array<string>")
    one = raw.select("source_file", F.posexplode(features).alias("feature_index", "feature"))
    numbers = F.regexp_extract_all(F.get_json_object("feature", "$.geometry.coordinates"), F.lit(r"\[(-?[0-9.eE+-]+),(-?[0-9.eE+-]+)"), F.lit(0))
    axis = lambda i: F.transform(numbers, lambda p: F.regexp_extract(p, r"\[(-?[0-9.eE+-]+),(-?[0-9.eE+-]+)", i).cast("double"))
    out = one.withColumn("raw_label", F.get_json_object("feature", f"$.{label}")).withColumn("_x", axis(1)).withColumn("_y", axis(2))
    out = out.select("source_file", "feature_index", "raw_label", *[f("_" + a).alias(a + n) for a in "xy" for f, n in ((F.array_min, "0"), (F.array_max, "1"))])
    return out.withColumn("centre_x", box_centre(F.col("x0"), F.col("x1"), half_even=True)).withColumn("centre_y", box_centre(F.col("y0"), F.col("y1"), half_even=True))


def read_xml_regions(spark: SparkSession, path: str, *, row_tag: str = "Region") -> DataFrame:
    """Polygons of XML annotation files: file, region id, vertices; regions of under three vertices are dropped."""
    schema = "_Id string, Vertices struct<Vertex: array<struct<_X: double, _Y: double>>>"
    df = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    df = df.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), F.col("_Id").alias("region_id"), F.col("Vertices.Vertex").alias("_v"))
    points = F.transform("_v", lambda v: F.struct(v["_X"].alias("x"), v["_Y"].alias("y")))
    return df.where(F.size("_v") >= 3).select("source_file", "region_id", points.alias("vertices"))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """Rows of .npy arrays: (path, row, values), the first axis as rows and the others flattened; no pickled objects."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a.reshape(a.shape[0], -1) if a.ndim > 1 else a.reshape(-1, 1)
                for s in range(0, len(a), 4096):
                    part = a[s : s + 4096].astype(float)
                    yield pd.DataFrame({"path": name, "row": range(s, s + len(part)), "values": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, values array<double>")


def read_npz(spark: SparkSession, path: str, member: str) -> DataFrame:
    """Rows of one member of .npz files, to be written to Parquet once and read from there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    a = z[member]
                a = a.reshape(a.shape[0], -1).astype(float)
                yield pd.DataFrame({"path": name, "row": range(len(a)), "values": list(a)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, values array<double>")


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of Parquet files, from their footers."""
    return spark.read.parquet(path).count()


def inventory(spark: SparkSession, path: str, *, recursive: bool = True) -> DataFrame:
    """Path, size and SHA-256 of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def infer_fold(path_column: str = "path"):
    """The number after 'fold' in a path, null without one."""
    return F.nullif(F.regexp_extract(F.lower(path_column), r"fold[ _-]?([0-9]+)", 1), F.lit("")).cast("int")


# File stems of a release's arrays and the role of each.
ROLES = {"images": "image", "masks": "mask", "types": "tissue"}


def release_roles(files: DataFrame, path: str = "path") -> DataFrame:
    """(fold_id, role, path) of a release's arrays: exactly one image, mask and tissue array for each fold.

    Raises for an array without a fold or a known role, and for a fold that lacks a role or has it twice.
    """
    stem = F.regexp_extract(path, r"([^/]+)\.npy$", 1)
    table = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    found = files.where(F.lower(path).endswith(".npy")).select(infer_fold(path).alias("fold_id"), F.try_element_at(table, F.lower(stem)).alias("role"), F.col(path).alias("path"))
    require_empty(found.where("fold_id is null or role is null"), "arrays without a fold or a role")
    uneven = found.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("role").alias("k")).where(f"n <> {len(ROLES)} or k <> {len(ROLES)}")
    require_empty(uneven, "folds whose arrays don't have one role each")
    return found


def read_sqlite(spark: SparkSession, path: str, query: str, schema: T.StructType | str) -> DataFrame:
    """What a query of a driver's SQLite file returns.  For small authority tables: the rows pass through the driver."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        return spark.createDataFrame(con.execute(query).fetchall(), schema)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of a JSON-lines ledger; a line that isn't a record raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def load_config(path: str) -> dict:
    """A small JSON configuration of the driver; repeated keys and numbers that aren't finite raise."""

    def pairs(items: list[tuple]) -> dict:
        if len({k for k, _ in items}) < len(items):
            raise ValueError("repeated key")
        return dict(items)

    def reject(value: str):
        raise ValueError(f"not finite: {value}")

    with open(path, encoding="utf-8") as f:
        return json.load(f, object_pairs_hook=pairs, parse_constant=reject)


# Shares of the five classes of generated samples.
CLASS_SHARES = (0.39, 0.25, 0.17, 0.11, 0.08)


def synthetic_samples(spark: SparkSession, n_groups: int = 30, per_group: int = 7, n_features: int = 9, n_folds: int = 3, seed: int = 2027) -> DataFrame:
    """Grouped samples with class-dependent features, made by hashes; the first rows of each fold cover all classes."""
    rows = spark.range(n_groups * per_group).select("id", F.floor(F.col("id") / per_group).cast("int").alias("g"), (F.col("id") % per_group).cast("int").alias("i"))
    u = unit_hash(seed, F.lit("class"), "id")
    label = F.lit(len(CLASS_SHARES) - 1)
    for c in reversed(range(len(CLASS_SHARES) - 1)):
        label = F.when(u < sum(CLASS_SHARES[: c + 1]), F.lit(c)).otherwise(label)
    covers = (F.col("g") < n_folds) & (F.col("i") < len(CLASS_SHARES))
    rows = rows.withColumn("observed_label", F.when(covers, F.col("i")).otherwise(label).cast("int"))
    noise = lambda j: unit_hash(seed, F.lit(f"f{j}"), "id") + unit_hash(seed, F.lit(f"h{j}"), "id") - 1.0
    features = F.array(*[noise(j) + F.when(F.col("observed_label") == j % len(CLASS_SHARES), 1.0).otherwise(0.0) for j in range(n_features)])
    return rows.select(
        F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("sample_id"),
        F.concat(F.lit("g"), F.lpad(F.col("g").cast("string"), 5, "0")).alias("group_id"),
        (F.col("g") % n_folds).cast("int").alias("fold_id"),
        F.concat(F.lit("t"), (F.col("g") % 4).cast("string")).alias("tissue"),
        "observed_label",
        features.alias("features"),
    )
