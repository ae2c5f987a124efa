"""Helpers that several operators share: word arrays, checkpoints, one-pass lookups."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The reliable checkpoint folder: what the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset on one machine (a local master) a local folder takes its place; on a cluster that raises, as
    executors would each write to their own disk.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of plans that are made and run inside go at their end, not when the driver happens to collect its garbage.

    For loops and chains of many small steps, whose files would add up.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def settled(df: DataFrame) -> DataFrame:
    """``checkpoint`` with the plan's shuffle files ``released``."""
    with released(df.sparkSession):
        return checkpoint(df.select("*"))  # a plan of its own, made inside


def words(text: Column) -> Column:
    """Array of the words of ``text``; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also when ``body`` uses it inside lambda functions."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(w: Column, size: int) -> Column:
    """64-bit hashes of all ``size``-word shingles of the word array ``w``, in order and with repeats.

    Fewer words than ``size`` make one shingle of the whole sequence; no words make none.
    """

    def build(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(v) - (size - 1)))
        hashed = F.transform(starts, lambda i: F.xxhash64(F.slice(v, i, F.lit(size))))
        return F.when(F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(hashed)

    return let(w, build)
