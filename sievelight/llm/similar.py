"""Near copies by the exact similarity of five-word shingles: SimHash fingerprints and MinHash bands propose, shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions.shipping import ship
from sievelight.llm.common import settled
from sievelight.llm.near_dedup import components, fingerprint, fingerprint_links

#: A pair of similarity s shares no band with probability (1 - s**ROWS)**BANDS: 1.3e-7 at 0.8, 1e-10 at 0.85.
BANDS, ROWS = 40, 5
#: Longs of a set's parities: 1,024 bits tell sets of up to some 2,000 shingles apart without a look at them.
LANES = 16
#: Rounds that compare each member of a band's group with one leader, before the pairs that are left.
STAR_ROUNDS = 2

_RNG = np.random.default_rng(20)
_MUL = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)
_WORD = _RNG.integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles, A-Z in lower case; fewer words are one shingle."""
    w = (text or "").encode().lower().split()  # bytes: white space and case are ASCII's only
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    k = min(size, len(w))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out += h[i : i + len(out)] * _WORD[i]
    return np.unique(_mix(out))


def band_keys(s: np.ndarray) -> np.ndarray:
    """A key for each band of the MinHash signature of the shingle hashes; none for no shingles."""
    if not len(s):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(s), 1024):  # bounded memory for long texts
        least = np.minimum(least, (s[at : at + 1024] * _MUL + _ADD).min(axis=1))
    rows = _mix(least).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = _mix(out * _WORD[i] + rows[:, i])
    return out.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *(a.view(np.int64) for a in arrays)])))


def _described(size: int):
    """For each row its name, its shingle set's hash, size and band keys, and its text's SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys, prints = [], [], [], []
            for t in batch.column("text"):
                s = shingles(text := t.as_py(), size)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes()))
                sizes.append(len(s))
                keys.append(band_keys(s))
                prints.append(fingerprint(text))
            more = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), _lists(keys), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "_row"]).columns, *more], ["doc_id", "_row", "_node", "_n", "_keys", "_fp"])

    return run


def parities(s: np.ndarray) -> np.ndarray:
    """64 * ``LANES`` bits: how many of the shingle hashes fall to each, modulo 2.

    A shingle that only one of two sets has changes one bit, so sets differ in at least as many shingles as bits.
    """
    bits = np.bincount((s % np.uint64(64 * LANES)).astype(np.int64), minlength=64 * LANES) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _sets(size: int):
    """For each row its node, shingle set and parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), size) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("_node"), _lists(found), _lists([parities(s) for s in found])], ["node", "s", "q"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a name for each row: rows share it if doc_id and text are equal.  It takes no texts to disk."""
    return docs.withColumn("_row", F.xxhash64("doc_id", "text"))


def _crowded(bands: DataFrame) -> DataFrame:
    """The rows of bands that two nodes or more share."""
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    return bands.join(shared, "key", "left_semi")


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _proposed(rows: DataFrame) -> DataFrame:
    """(a, b), a < b: nodes whose fingerprints are equal or link, by the deletion variants of ``near_dedup``.

    The least node of a fingerprint stands for it: the others are held against that one.
    """
    prints = rows.where("_n > 0").select(F.col("_fp").alias("fp"), F.col("_node").alias("node"))
    least = settled(prints.groupBy("fp").agg(F.min("node").alias("least"), F.max("node").alias("most")))
    equal = prints.join(least.where("least < most"), "fp").select(*_pair("node", "least"))
    least = least.drop("most")
    near = fingerprint_links(least)
    for end in "ab":
        near = near.join(least.withColumnsRenamed({"fp": end, "least": f"of_{end}"}), end)
    return settled(equal.unionByName(near.select(*_pair("of_a", "of_b"))).where("a < b").distinct())


def similar_rows(docs: DataFrame, *, shingle: int = 5, min_similarity: float = 0.8) -> DataFrame:
    """(doc_id, _row, _root) for each row of ``docs``: _root is equal for rows that links reach, _row is of ``_rows``.

    A link is a similarity of ``min_similarity`` or more.

    The similarity is that of the sets of ``shingle``-word shingles (shared over all). Rows with equal sets are one node
    from the start. Nodes whose SimHash fingerprints link (3 bits, ``near_dedup.fingerprint_links``) are compared in the
    first round. For what lies further apart, nodes that share a band of the MinHash signature are candidates. Of both
    only the exact similarity of the sets links, and what a round has joined is not compared again. Shingles that no
    other candidate has (``u`` of a node's ``n``) can't be shared: a node with too many of them to reach the similarity
    with any other leaves the search, and so do pairs whose bound by them is too low. Of a band's group, members are
    first compared with one leader each round, the one with the fewest shingles of its own first, as most large groups
    are copies of one text. After ``STAR_ROUNDS`` the members that are still in different components are held against
    each other by these bounds and by ``parities``, which say how many shingles two sets differ in at least; only pairs
    that may link leave that join, each once, and are compared. So the components are those of all links that share a
    band, and of those that the fingerprints find besides. Texts without words are one node; doc_id plays no part.
    """
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    described = _rows(docs).select("doc_id", "_row", "text").mapInArrow(_described(shingle), f"doc_id {id_type}, _row long, _node long, _n int, _keys array<long>, _fp long")
    rows = settled(described)
    proposed = _proposed(rows)
    kinds = rows.groupBy("_node").agg(F.first("_n").alias("n"), F.first("_keys").alias("keys"))
    bands = kinds.select(F.explode("keys").alias("key"), F.col("_node").alias("node"), "n")
    bands = settled(_crowded(bands))
    candidates = bands.select("node").unionByName(proposed.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    wanted = rows.join(candidates.withColumnRenamed("node", "_node"), "_node", "left_semi").groupBy("_node").agg(F.min("_row").alias("_row"))
    texts = _rows(docs).select("_row", "text").join(wanted, "_row").dropDuplicates(["_row"])
    sets = settled(texts.mapInArrow(_sets(shingle), "node long, s array<long>, q array<long>"))
    own = sets.select("node", F.explode("s").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.first("node").alias("node"))
    own = own.where("c = 1").groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("u"))
    bands = bands.join(own, "node", "left").withColumn("u", F.coalesce("u", F.lit(0))).where(F.col("n") - F.col("u") >= min_similarity * F.col("n") - 1e-9)
    bands = settled(_crowded(bands))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        return both.where(shared >= min_similarity * (F.size("sa") + F.size("sb") - shared)).select("a", "b")

    def named(b: DataFrame, roots: DataFrame) -> DataFrame:
        return b.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    # What two sets share is in neither's own shingles, so this holds for all pairs that reach the similarity.
    possible = F.least(F.col("n") - F.col("u"), F.col("m") - F.col("v")) >= min_similarity / (1 + min_similarity) * (F.col("n") + F.col("m")) - 1e-9

    tested = docs.sparkSession.createDataFrame([], "a long, b long")
    roots = docs.sparkSession.createDataFrame([], "node long, root long")
    for k in range(STAR_ROUNDS + 1):
        now = named(bands, roots)
        first = F.struct(F.col("u") / F.col("n") if k == 0 else F.lit(0.0), F.xxhash64("node", F.lit(k)), "node", "root", "n", "u")
        mixed = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(first).alias("l")).where("low <> high")
        if k < STAR_ROUNDS:
            leaders = mixed.select("key", *[F.col(f"l.{x}").alias(y) for x, y in (("node", "other"), ("root", "to"), ("n", "m"), ("u", "v"))])
            pairs = now.join(leaders, "key").where((F.col("root") != F.col("to")) & possible)
        else:
            left = settled(now.join(mixed.select("key"), "key", "left_semi"))
            left = left.join(left.groupBy("node").agg(F.collect_set("key").alias("keys")), "node").join(sets.select("node", "q"), "node")
            right = left.select("key", *[F.col(x).alias(y) for x, y in (("node", "other"), ("root", "to"), ("n", "m"), ("u", "v"), ("keys", "others"), ("q", "r"))])
            once = F.array_min(F.array_intersect("keys", "others")) == F.col("key")  # of several shared bands one proposes
            bits = sum((F.bit_count(F.col("q")[i].bitwiseXOR(F.col("r")[i])) for i in range(1, LANES)), F.bit_count(F.col("q")[0].bitwiseXOR(F.col("r")[0])))
            close = bits <= (1 - min_similarity) / (1 + min_similarity) * (F.col("n") + F.col("m")) + 1e-9
            pairs = left.join(right, "key").where((F.col("root") < F.col("to")) & possible & close & once)
        pairs = pairs.select(*_pair("node", "other"))
        pairs = pairs.unionByName(proposed) if k == 0 else pairs
        pairs = settled(pairs.distinct().join(tested, ["a", "b"], "left_anti"))
        tested = tested.unionByName(pairs)
        links = roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(verified(pairs))  # stars stand for all links before
        roots = components(settled(links))
    return rows.drop("_n", "_keys", "_fp").join(roots.withColumnsRenamed({"node": "_node", "root": "_root"}), "_node", "left").withColumn("_root", F.coalesce("_root", "_node")).drop("_node")


def drop_similar(docs: DataFrame, *, shingle: int = 5, min_similarity: float = 0.8) -> DataFrame:
    """Exactly one row of each component of ``similar_rows``: the least doc_id (nulls last), then the hash of the row.

    Ids play no part in what is a copy.  Minima are aggregated in parts, so a component with very many rows is no heavy
    group; of rows with equal doc_id and text any one is kept.
    """
    found = similar_rows(docs, shingle=shingle, min_similarity=min_similarity)
    least = found.groupBy("_root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("l"))
    return _rows(docs).join(settled(least.select("l._row")), "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")
