"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact shingle similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import checkpoint, let, shingle_hashes, words

#: 64 bits in blocks of 8: fingerprints within 15 bits have a block that differs in one bit at most, as 15 < 2 * 8.
BITS, BLOCK = 64, 8
RADIUS = 2 * (BITS // BLOCK) - 1


def simhash(hashes: Column) -> Column:
    """Fingerprint of an array of hashes: a bit is 1 if it is set in over half of them.

    The counts of four bits at a time are added up in 16-bit lanes of one long, by runs of 32,767 hashes at most.
    """

    def whole(h: Column) -> Column:
        lane = F.lit(0x0001000100010001)
        runs = F.transform(F.sequence(F.lit(1), F.size(h), F.lit(32_767)), lambda i: F.slice(h, i, F.lit(32_767)))

        def column(b: int) -> Column:
            add = lambda acc, x: acc + F.shiftrightunsigned(x, b).bitwiseAND(lane)
            packed = F.transform(runs, lambda r: F.aggregate(r, F.lit(0).cast("long"), add))

            def bits(p: Column) -> Column:
                def bit(lane_at: int) -> Column:
                    part = lambda acc, x: acc + F.shiftrightunsigned(x, 16 * lane_at).bitwiseAND(F.lit(0xFFFF))
                    n = F.aggregate(p, F.lit(0).cast("long"), part)
                    return F.when(2 * n > F.size(h), F.shiftleft(F.lit(1).cast("long"), b + 16 * lane_at)).otherwise(F.lit(0).cast("long"))

                return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))

            return let(packed, bits)

        out = column(0)
        for b in range(1, 16):
            out = out.bitwiseOR(column(b))
        return out

    return let(hashes, lambda h: F.when(F.size(h) == 0, F.lit(0).cast("long")).otherwise(whole(h)))


def occurrences(hashes: Column) -> Column:
    """The multiset as a set: the k-th of equal hashes becomes a hash of its own (the first stays as it is)."""

    def numbered(h: Column) -> Column:
        def from_sorted(s: Column) -> Column:
            first = lambda x: F.array_position(s, x)
            return F.transform(s, lambda x, i: F.when(i + 1 == first(x), x).otherwise(F.xxhash64(x, i + 1 - first(x))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), h).otherwise(let(F.array_sort(h), from_sorted))

    return let(hashes, numbered)


def _block(fp: str, b: int) -> Column:
    return F.shiftrightunsigned(fp, BLOCK * b).bitwiseAND(F.lit(0xFF)).cast("int")


def _variants(fp: str, flips: list[int]) -> Column:
    """(block, value) of every block of the fingerprint in column ``fp``, as it is changed by each of ``flips``."""
    changed = lambda b: F.transform(F.lit(flips), lambda x: F.struct(F.lit(b).alias("block"), _block(fp, b).bitwiseXOR(x).alias("value")))
    return F.concat(*[changed(b) for b in range(BITS // BLOCK)])


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    shingle: int = 5,
    min_similarity: float = 0.8,
    broadcast_shingles: int = 2_000_000,
) -> DataFrame:
    """Passages of ``docs`` that equal or nearly equal an item of ``benchmark``.

    Returns doc_id, item_id, start_word (from 0), n_words, differing_bits and similarity: for each document and item the
    best window.  Windows are as long as the item.  The similarity is that of the multisets of ``shingle``-word
    shingles: the sum of the lesser weights over the sum of the greater, a shingle's weight being how often it occurs.

    Way: (1) a window that can reach the similarity holds shingles of an item, so windows are laid where a run of an
    item's shingles begins in the document, each in line with that run; a join of the documents' rolling shingle
    hashes with the items' finds them.  It is a broadcast join while the items have at most ``broadcast_shingles``
    shingles in all, which is counted first, and a shuffled one of numbers alone beyond, after which the texts that were
    hit are joined again.  (2) Each window gets a 64-bit SimHash.
    (3) The items' fingerprints are indexed by 8-bit blocks with one-bit variants and the windows' blocks probe them
    among the items of their size: all fingerprints within ``RADIUS`` bits are found.  Distinct fingerprints alone meet
    there.  (4) Those within the radius fetch their shingles and are verified by the exact similarity.

    Words are runs without ASCII white space, in lower case.  Null or empty texts have no words and match nothing, and
    neither does an item without words; texts of fewer words than ``shingle`` are one shingle, and such an item is found
    wherever a document holds it word by word.  Equal rows, or rows
    with equal ids, count as one document with several texts; a null id is an id.  Empty tables give an empty result.
    """
    items = benchmark.select("item_id", F.lower("text").alias("t")).withColumn("w", words(F.col("t")))
    items = items.select("item_id", F.size("w").alias("m"), shingle_hashes(F.col("w"), shingle).alias("s")).where("m > 0")
    kinds = items.select("m", F.posexplode("s").alias("o", "h"), F.col("s").alias("all"))
    kinds = kinds.select("m", "o", "h", F.get("all", F.col("o") - 1).alias("prev")).distinct()
    m = F.size(words(F.col("text")))
    few, lengths = benchmark.select(F.sum(m.cast("long")), F.collect_set(F.when(m.between(1, shingle - 1), m))).first()
    few = few or 0
    if few <= broadcast_shingles:
        kinds = F.broadcast(kinds)

    # Rows with equal id and text are one text, so (doc_id, row) tells texts apart.
    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), words(F.lower("text")).alias("w"))
    d = texts.select("doc_id", "row", F.size("w").alias("n"), shingle_hashes(F.col("w"), shingle).alias("s"))
    # A run begins where the shingle before is not the item's shingle before.
    begins = F.col("prev").isNull() | (F.col("p") == 0) | (F.col("before") != F.col("prev"))
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("o"), F.col("n") - F.col("m")))
    window = F.slice("s", F.col("start") + 1, F.greatest(F.lit(1), F.col("m") - (shingle - 1)))
    if few <= broadcast_shingles:
        hits = d.select("doc_id", "n", "s", F.posexplode("s").alias("p", "h")).join(kinds, "h").withColumn("before", F.get("s", F.col("p") - 1))
        laid = hits.where(begins).select("doc_id", "m", "s", start.alias("start")).select("doc_id", "m", "start", window.alias("win"))
    else:  # only numbers are dealt by shingle; the windows found fetch their text
        pairs = F.zip_with(F.col("s"), F.concat(F.array(F.lit(None).cast("long")), F.col("s")), lambda h, b: F.struct(h.alias("h"), b.alias("before")))
        slim = d.select("doc_id", "row", "n", F.posexplode(F.slice(pairs, 1, F.size("s"))).alias("p", "x")).where("x.h is not null")
        hits = slim.select("doc_id", "row", "n", "p", "x.h", "x.before").join(kinds, "h")
        found = hits.where(begins).select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), "m", start.alias("start")).distinct()
        same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row"))
        laid = d.join(found, same).select("doc_id", "m", "start", window.alias("win"))
    windows = laid.groupBy("doc_id", "m", "start", F.xxhash64("win").alias("wid")).agg(F.first("win").alias("win"))
    windows = checkpoint(windows.withColumn("fp", simhash(F.col("win"))))  # few beside the texts, and read twice

    # Fingerprints alone meet in the index, equal ones once; the texts of the few that are near are fetched afterwards.
    items = checkpoint(items.withColumn("item_fp", simhash(F.col("s"))))
    index = items.select("m", "item_fp").distinct().select("m", "item_fp", F.explode(_variants("item_fp", [0, *[1 << i for i in range(BLOCK)]])).alias("v"))
    probe = windows.select("m", "fp").distinct().select("m", "fp", F.explode(_variants("fp", [0])).alias("v"))
    index, probe = (x.select("m", x.columns[1], "v.block", "v.value") for x in (index, probe))
    bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).cast("int").alias("differing_bits")
    near = probe.join(index, ["m", "block", "value"]).select("m", "fp", "item_fp", bits).where(F.col("differing_bits") <= RADIUS).distinct()
    distinct = windows.groupBy("m", "fp", "wid").agg(F.first("win").alias("win"))  # equal windows are compared once
    both = near.join(distinct, ["m", "fp"]).join(items.select("m", "item_fp", "item_id", "s"), ["m", "item_fp"])
    shared = F.size(F.array_intersect(occurrences(F.col("win")), occurrences(F.col("s"))))
    both = both.withColumn("similarity", shared / (F.size("win") + F.size("s") - shared)).where(F.col("similarity") >= min_similarity)
    pairs = windows.drop("win").join(both.select("m", "fp", "wid", "item_id", "differing_bits", "similarity"), ["m", "fp", "wid"])
    if lengths:  # shorter items are one shingle, which is in a longer text where the text's shingles of that length hold it
        of_length = lambda k: F.when(F.size("w") > k, F.transform(shingle_hashes(F.col("w"), k), lambda h: F.struct(F.lit(k).alias("m"), h.alias("h"))))
        own = [F.posexplode(of_length(k)).alias("start", "g") for k in sorted(lengths)]
        short = items.where(F.col("m") < shingle).select("m", F.col("s")[0].alias("h"), "item_id").distinct()
        short = F.broadcast(short) if few <= broadcast_shingles else short
        for grams in own:
            held = texts.select("doc_id", grams).select("doc_id", "start", "g.m", "g.h").join(short, ["m", "h"])
            held = held.groupBy("doc_id", "m", "item_id").agg(F.min("start").alias("start"))
            pairs = pairs.unionByName(held.withColumns({"differing_bits": F.lit(0), "similarity": F.lit(1.0)}), allowMissingColumns=True)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("at"), F.col("m"), F.col("differing_bits"))).alias("b")
    found = pairs.groupBy("doc_id", "item_id").agg(best)
    return found.select(
        "doc_id",
        "item_id",
        (-F.col("b.at")).cast("long").alias("start_word"),
        F.col("b.m").cast("long").alias("n_words"),
        F.col("b.differing_bits").alias("differing_bits"),
        F.col("b.similarity").alias("similarity"),
    )


def op3_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_leaks(docs, benchmark)
