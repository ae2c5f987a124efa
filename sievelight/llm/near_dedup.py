"""SimHash near-duplicates by deletion-variant signatures, and connected components of the links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.shipping import ship
from sievelight.llm.common import checkpoint, released, settled

RADIUS = 3
SEGMENTS, SEGMENT_BITS = 2, 32  # of two segments one differs in one bit at most, if three bits differ in all


def fingerprint(text: str | None, size: int = 3) -> int:
    """64-bit SimHash of the ``size``-word shingles of ``text``, A-Z in lower case, as a signed number; 0 without words."""
    w = (text or "").encode().lower().split()  # bytes: white space and case are ASCII's only
    if not w:
        return 0
    whole = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = ends - [len(x) + 1 for x in w]
    n = max(1, len(w) - size + 1)
    last = ends[size - 1 :] if len(w) >= size else ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(whole[a : b - 1], 42) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):  # bounded memory for long texts
        part = h[at : at + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            fps = pa.array((fingerprint(t.as_py(), size) for t in texts), pa.int64(), size=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps], ["doc_id", "fp"])

    return run


def _tree(fps: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of a spanning forest of the fingerprints: those within ``radius`` bits are in one tree.

    From each fingerprint reached, all that aren't reached yet are compared with it; what is reached leaves the list.  So
    the links number less than the fingerprints, and a dense group takes one comparison for most of its members.
    """
    fps = fps.view(np.uint64)  # bits of signed numbers would be counted without their sign
    left, right = [], []
    rest, todo = fps, []
    while len(rest) or todo:
        if not todo:
            todo, rest = [rest[0]], rest[1:]
        at = todo.pop()
        near = np.bitwise_count(rest ^ at) <= radius
        if near.any():
            found = rest[near]
            left.append(np.full(len(found), at))
            right.append(found)
            todo.extend(found)
            rest = rest[~near]
        if not len(rest):
            break
    return left, right


def _links(radius: int):
    """From (key, fp), sorted by key: links (a, b) between fingerprints that share a key, a forest for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []

        def out(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if left:
                a, b = (np.concatenate([x.view(np.int64) for x in side]) for side in (left, right))
                a, b = np.minimum(a, b), np.maximum(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, fps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            left, right = [], []
            if held_key is not None and keys[0] != held_key:
                a, b = _tree(np.concatenate(held), radius)
                left, right, held, held_key = left + a, right + b, [], None
            if len(starts) == 1:  # the whole batch has one key
                held_key = keys[0]
                held.append(fps.copy())
                yield from out(left, right)
                continue
            first = 0
            if held_key is not None:
                a, b = _tree(np.concatenate([*held, fps[: sizes[0]]]), radius)
                left, right, first = left + a, right + b, 1
            held_key, held = keys[-1], [fps[starts[-1] :].copy()]
            starts, sizes = starts[first:-1], sizes[first:-1]
            two = starts[sizes == 2]
            near = np.bitwise_count((fps[two] ^ fps[two + 1]).view(np.uint64)) <= radius
            left.append(fps[two][near])
            right.append(fps[two + 1][near])
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                a, b = _tree(fps[s : s + n], radius)
                left, right = left + a, right + b
            yield from out(left, right)
        if held_key is not None:
            yield from out(*_tree(np.concatenate(held), radius))

    return run


def _keys(fp: Column) -> Column:
    """Keys of the one-wildcard variants of both segments: segment and place of the deleted bit, then the other bits."""
    j = F.col("j").cast("int")
    segment = F.when(j >= SEGMENT_BITS, F.shiftrightunsigned(fp, SEGMENT_BITS)).otherwise(fp).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    kept = segment.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(j, F.lit(SEGMENT_BITS)))))
    return kept.bitwiseOR(F.shiftleft(j.cast("long"), SEGMENT_BITS))


def components(links: DataFrame, *, max_rounds: int = 40) -> DataFrame:
    """(node, root): the least node that each node of the links (a, b) can reach, by alternating large and small stars.

    Each round links every node's greater neighbours, then its lesser ones, to the least neighbour.  Only minima are
    aggregated, in parts; the links of a node with very many neighbours meet its minimum in a join, which splits them as
    a skewed key.  Rounds end when the links are stars, which another round would leave as they are; a graph that needs
    over ``max_rounds`` rounds, which grow with the logarithm of the nodes, is an error.
    """

    def large_star(e: DataFrame) -> DataFrame:
        ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x"))
        least = ends.groupBy(F.col("x.u").alias("a")).agg(F.least(F.min("x.v"), F.first("x.u")).alias("m"))
        return e.join(least, "a").select(F.col("m").alias("a"), "b").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        moved = e.join(e.groupBy("b").agg(F.min("a").alias("m")), "b")
        moved = moved.select("m", F.explode(F.array("a", "b")).alias("b"))
        return moved.where("m <> b").select(F.col("m").alias("a"), "b").distinct()

    def stars(e: DataFrame) -> bool:
        """Whether each node is either a root or the leaf of one."""
        ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.lit(0).alias("leaf")), F.struct(F.col("b").alias("u"), F.lit(1).alias("leaf")))).alias("x"))
        leaves = ends.groupBy("x.u").agg(F.sum("x.leaf").alias("leaves"), F.min("x.leaf").alias("least"))
        with released(e.sparkSession):
            return leaves.where("leaves > 1 or leaves > least").agg(F.count(F.lit(1))).first()[0] == 0

    e = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    for _ in range(max_rounds):
        e = settled(small_star(settled(large_star(e))))
        if stars(e):
            return e.select(F.col("b").alias("node"), F.col("a").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def fingerprint_links(kinds: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """(a, b) of distinct fingerprints ``fp``: links that connect all those within ``radius`` (3 at most) bits.

    Each fingerprint is cut into two segments of 32 bits; a link leaves one of them with one differing bit at most, so
    both fingerprints share a variant of that segment with one bit deleted.  Equal variants meet in an equality shuffle,
    sorted, and each is verified on the whole fingerprints: for a variant that many share, a spanning forest of its links,
    not all pairs.
    """
    if radius > 2 * SEGMENTS - 1:
        raise ValueError("two segments with one wildcard each find up to three differing bits")
    ship(kinds.sparkSession)
    spread = kinds.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS * SEGMENT_BITS - 1))).alias("j"))
    keyed = spread.select(_keys(F.col("fp")).alias("key"), "fp")
    keyed = keyed.repartition("key").sortWithinPartitions("key", "fp")
    return settled(keyed.mapInArrow(_links(radius), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, *, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``: component_id is the least doc_id that its links reach.

    Fingerprints link if they differ in at most ``radius`` (3 at most) bits: ``fingerprint_links`` finds them, so the
    components are those of all links.  Exact copies are one fingerprint from the start.

    Null and empty texts have fingerprint 0 and link like others.  Rows with a null doc_id count, but the least id of
    a component ignores nulls (null if it has no other).  Repeated rows are returned as often as they come; empty input
    gives empty output; other columns are ignored.
    """
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    prints = docs.select("doc_id", "text").mapInArrow(_fingerprints(shingle), f"doc_id {id_type}, fp long")
    prints = checkpoint(prints)
    kinds = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(fingerprint_links(kinds, radius=radius))
    # Least id by component, over the linked fingerprints only; the others are components of their own.
    linked = kinds.join(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), F.col("fp") == F.col("node"))
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(ids, "root").select(F.col("fp"), F.col("component_id").alias("_linked"))
    table = kinds.join(named, "fp", "left").select("fp", F.coalesce("_linked", "least").alias("component_id"))
    # Written first, so that the join stands right on two shuffles and a fingerprint of very many copies can be split.
    return prints.join(checkpoint(table), "fp").select("doc_id", "fp", "component_id")


def op10_near_dedup(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
