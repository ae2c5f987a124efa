import random
import time

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from sievelight.llm import near_dedup, similar
from tests.llm.fixtures import documents, frame, prose


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or a and b and 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def edited(rng, text, share):
    w = text.split(" ")
    for i in rng.sample(range(len(w)), max(1, int(share * len(w)))):
        w[i] = f"edit{rng.random()}"
    return " ".join(w)


def test_similar_rows_against_brute_force(spark):
    rng = random.Random(6)
    rows = [r for r in documents() if len(r[1] or "") < 10_000]
    for k in range(40):
        base = prose(rng, rng.choice([5, 30, 90, 400]))
        rows += [(1000 + k, base, "en", "s", 0), (2000 + k, edited(rng, base, 0.02), "en", "s", 0), (3000 + k, edited(rng, base, 0.04), "en", "s", 0)]
    base = prose(rng, 150)
    rows += [(4000 + k, edited(rng, base, 0.015), "en", "s", 0) for k in range(60)]  # a crowded band, not all within 0.8
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    expected = groups(rows)
    found = {r["doc_id"]: r["_root"] for r in similar.similar_rows(frame(spark, rows)).select("doc_id", "_root").collect()}
    assert len(found) == len(rows)
    assert len({(expected[i], found[i]) for i in found}) == len(set(expected)) == len(set(found.values()))


def test_signatures_of_similar_sets_share_a_band():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(9, 400)) // 9 * 9
        h = rng.integers(0, 2**64, n + n // 9, np.uint64)
        a, b = np.unique(h[:n]), np.unique(h[n // 9 :])  # 8 of 10 parts are shared
        assert set(similar.band_keys(a).tolist()) & set(similar.band_keys(b).tolist())


def test_the_stage_drops_near_copies_beyond_three_bits(spark):
    rng = random.Random(3)
    text = prose(rng, 200)
    rows = [(1, text, "en", "s", 0), (2, edited(rng, text, 0.01), "en", "s", 0), (3, edited(rng, text, 0.015), "en", "s", 0), (4, prose(rng, 200), "en", "s", 0)]
    kept = corpus_pipeline.deduplicate(spark, frame(spark, rows), "").where(F.col("doc_id") < 4)
    assert kept.count() == 1
    assert corpus_pipeline.deduplicate(spark, frame(spark, rows), "").count() == 2


def test_the_stage_keeps_one_row_of_each_component_whatever_the_ids(spark):
    rng = random.Random(12)
    texts = [prose(rng, 80) for _ in range(6)]
    rows = [(None, t, "en", "s", 0) for t in texts[:3]]  # clean texts without an id
    rows += [(7, texts[3], "en", "s", 0), (7, texts[4], "en", "s", 0)]  # and with one id
    rows += [(9, texts[5], "en", "a", 0), (8, texts[5], "en", "b", 0), (None, texts[5], "en", "c", 0), (7, texts[0], "en", "s", 0)]
    rows += [(20, None, None, None, None), (None, "", "", "", 0)] * 2
    kept = corpus_pipeline.deduplicate(spark, frame(spark, rows), "").collect()
    assert sorted(r["text"] or "" for r in kept) == sorted([*texts, ""])
    assert {r["text"]: r["doc_id"] for r in kept}[texts[5]] == 8 and {r["text"]: r["doc_id"] for r in kept}[texts[0]] == 7


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(200):
        both = rng.integers(0, 2**64, int(rng.integers(1, 3000)), np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**64, int(rng.integers(0, 200)), np.uint64)])) for _ in range(2))
        bits = np.bitwise_count((similar.parities(a) ^ similar.parities(b)).view(np.uint64)).sum()
        assert bits <= len(np.setxor1d(a, b))


def test_fingerprints_propose_before_bands(spark, monkeypatch):
    rng = random.Random(31)
    rows = []
    for k in range(12):
        base = prose(rng, rng.choice([40, 200, 600]))
        rows += [(10 * k + i, t, "en", "s", 0) for i, t in enumerate([base, base + " end", edited(rng, base, 0.01), edited(rng, base, 0.2)])]
    rows += [(200 + i, " ".join(f"{w}{i}" for w in "a b c d e f g h".split()), "en", "s", 0) for i in range(5)] + [(300, None, "en", "s", 0), (301, " ", "en", "s", 0)]
    prints = {r[0]: near_dedup.fingerprint(r[1]) for r in rows}
    root = {i: i for i in prints}
    for i in prints:  # links that brute force finds within 3 bits, verified
        for j in prints:
            a, b = (shingles(rows[[r[0] for r in rows].index(x)][1]) for x in (i, j))
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3 and 5 * len(a & b) >= 4 * len(a | b):
                old, new = root[j], root[i]
                root = {x: new if r == old else r for x, r in root.items()}
    monkeypatch.setattr(similar, "_crowded", lambda bands: bands.where("false"))
    found = {r["doc_id"]: r["_root"] for r in similar.similar_rows(frame(spark, rows)).collect()}
    assert len({(root[i], found[i]) for i in found}) == len(set(root.values())) == len(set(found.values())) < len(rows) - 8


def test_a_fingerprint_alone_is_no_copy(spark):
    words = "a b c d e f".split()
    rows = [(i, " ".join(words[i:] + words[:i]) + " x" * 40, "en", "s", 0) for i in range(2)]
    turned = "p q r s t u v w " * 20
    rows += [(5, turned, "en", "s", 0), (6, turned * 2, "en", "s", 0)]
    expected = groups(rows)
    found = [r["_root"] for r in similar.similar_rows(frame(spark, rows)).orderBy("doc_id").collect()]
    assert len(set(zip(expected, found))) == len(set(expected)) == len(set(found))


def test_no_step_leaves_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    rng = random.Random(8)
    base = prose(rng, 100)
    docs = frame(spark, [(k, edited(rng, base, 0.02), "en", "s", 0) for k in range(20)])
    old, key = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_before = spark.conf.get(key, None)
    similar.similar_rows(docs)
    assert spark.conf.get(key, None) == set_before
    end = time.time() + 20
    while files() - old and time.time() < end:  # they go in the background
        time.sleep(0.2)
    assert not files() - old


def test_components_of_a_path_and_loops_and_of_their_own_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1003), (1005, 1004), (1004, 1005)]
    roots = near_dedup.components(spark.createDataFrame(edges, "a long, b long").repartition(4))
    assert sorted(map(tuple, roots.collect())) == sorted([*((i, 0) for i in range(1, 301)), (1001, 1000), (1002, 1000), (1005, 1004)])
    again = near_dedup.components(roots.selectExpr("root a", "node b"))  # similar_rows goes on from stars
    assert sorted(again.collect()) == sorted(roots.collect())
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0
