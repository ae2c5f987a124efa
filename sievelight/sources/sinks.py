"""Sinks: Parquet, ranking CSVs, append-only ledgers.  Nothing is overwritten."""

from __future__ import annotations

import fcntl
import hashlib
import io
import json
import os
import tempfile
from collections.abc import Mapping
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.operators.qc import require_empty
from sievelight.operators.ranking import rank_rows, top_n


def write_validated(df: DataFrame, path: str, violations: DataFrame | None = None) -> None:
    """Write Parquet (zstd) once the table of violations is empty; an existing path raises."""
    if violations is not None:
        require_empty(violations, "violations")
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def summary(df: DataFrame, patch: str = "group_id") -> DataFrame:
    """Samples and distinct patches by fold, class and tissue."""
    return df.groupBy("fold_id", "observed_label", "tissue").agg(F.count(F.lit(1)).alias("n_samples"), F.countDistinct(patch).alias("n_patches"))


def write_rankings(df: DataFrame, path: str, risk: str, n: int, queue: DataFrame | None = None) -> None:
    """The ranking and its tops, overall, by class and by tissue, and a balanced queue if given, as CSV folders."""
    ranked = rank_rows(df, risk, "sample_id")
    ranked = ranked.select([c for c, t in ranked.dtypes if not t.startswith(("array", "map", "struct"))])
    tables = {
        "all": ranked,
        "top_overall": top_n(ranked, risk, "sample_id", n),
        "top_per_class": top_n(ranked.drop("rank"), risk, "sample_id", n, by=["observed_label"]),
        "top_per_tissue": top_n(ranked.drop("rank"), risk, "sample_id", n, by=["tissue"]),
    }
    if queue is not None:
        tables["balanced_queue"] = queue.select([c for c, t in queue.dtypes if not t.startswith(("array", "map", "struct"))])
    for name, table in tables.items():
        table.write.mode("errorifexists").option("header", True).csv(f"{path}/{name}")


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def chain_records(records: list[dict], head: str = "0" * 64) -> list[dict]:
    """Records with the hash of each and of what stands before it: a change anywhere changes the last hash."""
    out = []
    for r in records:
        body = json.dumps(r, sort_keys=True, separators=(",", ":"), allow_nan=False)
        head = hashlib.sha256((head + body).encode()).hexdigest()
        out.append(r | {"chain": head})
    return out


def verify_chain(records: list[dict], head: str = "0" * 64) -> bool:
    return chain_records([{k: v for k, v in r.items() if k != "chain"} for r in records], head) == records


def write_bytes(path: str | Path, content: bytes) -> None:
    """A driver's file, whole or not at all: written aside, synchronised and moved; an existing file raises."""
    path = Path(path)
    handle, aside = tempfile.mkstemp(prefix=f"{path.name}.part-", dir=path.parent)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.link(aside, path)  # fails where the path exists
    finally:
        os.unlink(aside)


def _json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, indent=1, allow_nan=False)


def write_json(path: str | Path, value: Any) -> None:
    """JSON with sorted keys; numbers that aren't finite raise."""
    write_bytes(path, _json(value).encode())


def _beside(path: str | Path) -> Path:
    return Path(path).with_suffix(".json")


def write_arrays(path: str | Path, arrays: Mapping[str, np.ndarray], about: Mapping[str, Any]) -> None:
    """An .npz file and beside it a .json with ``about`` and the array file's SHA-256; neither may exist."""
    if _beside(path).exists():
        raise FileExistsError(_beside(path))
    content = io.BytesIO()
    np.savez(content, **arrays)
    raw = content.getvalue()
    write_bytes(path, raw)
    write_json(_beside(path), dict(about) | {"sha256": hashlib.sha256(raw).hexdigest()})


def read_arrays(path: str | Path) -> tuple[dict[str, np.ndarray], dict]:
    """Arrays (no pickled objects) and what is said of them; raises if the array file isn't the one that was written."""
    raw, about = Path(path).read_bytes(), json.loads(_beside(path).read_text())
    if hashlib.sha256(raw).hexdigest() != about.pop("sha256"):
        raise ValueError(f"changed since it was written: {path}")
    with np.load(io.BytesIO(raw), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}, about


def append_record(path: str | Path, record: dict) -> None:
    """Append one record to a driver's JSON-lines ledger, chained to the last, under a lock that other writers wait for."""
    with open(path, "a+", encoding="utf-8") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        f.seek(0)
        last = None
        for line in f:
            last = line
        head = json.loads(last)["chain"] if last else "0" * 64
        f.write(json.dumps(chain_records([record], head)[0], sort_keys=True, allow_nan=False) + "\n")
        f.flush()
        os.fsync(f.fileno())


def padded_evidence(evidence: DataFrame) -> DataFrame:
    """Neighbour evidence with a row for each sample: ids and distances in the order of rank."""
    g = evidence.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour_id", "distance"))).alias("n"))
    return g.select("sample_id", F.col("n.neighbour_id").alias("neighbour_ids"), F.col("n.distance").alias("distances"))
