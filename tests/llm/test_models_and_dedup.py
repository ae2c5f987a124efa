import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sievelight.llm import blocks, decontaminate, lm_scoring, near_dedup, quality_classifier, substring_dedup
from tests.llm.fixtures import crowded, documents, frame, prose


def key(r):
    return tuple((x is None, str(x)) for x in r)


def simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_against_brute_force(spark):
    rows = documents()
    fps = [simhash(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    expected = sorted(((r[0], f"{fps[i]:016x}", least.get(find(i))) for i, r in enumerate(rows)), key=key)
    got = sorted((tuple(r) for r in near_dedup.op10_near_dedup(crowded(spark, ["fp", "component_id"])).collect()), key=key)
    assert got == expected


def test_near_duplicates_edges(spark):
    assert near_dedup.op10_near_dedup(frame(spark, [])).count() == 0


def test_links_of_a_crowded_key_hold_its_components():
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, 5)
    fps = np.unique(np.concatenate([[b ^ (1 << int(i)) ^ (1 << int(j)) for i in range(12) for j in range(12)] for b in base]))
    left, right = near_dedup._tree(fps, 3)
    links = list(zip(np.concatenate(left).tolist(), np.concatenate(right).tolist()))
    assert len(links) == len(fps) - 5 and all((a ^ b).bit_count() <= 3 for a, b in links)
    sign = np.array([5, 5 | -(1 << 63), 5 | -(1 << 63) | 3 << 40], np.int64)
    assert sum(map(len, near_dedup._tree(sign, 3)[0])) == 2


def test_links_that_differ_in_any_bits(spark):
    """Every way to differ in up to three bits of a few positions, the sign's among them, links in the whole chain of keys."""
    rng = np.random.default_rng(9)
    rows, pairs = [], 200
    for i in range(pairs):
        a = int(rng.integers(0, 2**64, dtype=np.uint64))
        flips = rng.choice([0, 1, 15, 31, 32, 33, 47, 62, 63], size=rng.integers(1, 4), replace=False)
        b = a
        for f in flips:
            b ^= 1 << int(f)
        rows += [(x - (1 << 64) if x >> 63 else x,) for x in (a, b)]
    fps = spark.createDataFrame(rows, "fp long").distinct()
    spread = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("j"))
    keyed = spread.select(near_dedup._keys(F.col("fp")).alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp")
    found = {(r["a"], r["b"]) for r in keyed.mapInArrow(near_dedup._links(3), "a long, b long").distinct().collect()}
    assert all((min(x, y), max(x, y)) in found for (x,), (y,) in zip(rows[::2], rows[1::2]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)] + [(200, x) for x in range(201, 260)]
    found = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(1, 41)) and found[100] == found[95] == 90 and all(found[x] == 200 for x in range(201, 260))


def windows(rows):
    first = {}
    for doc_id, w in rows:
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            place = (-(1 << 63) if doc_id is None else doc_id, i)
            first[k] = min(first.get(k, place), place)
    return first


def test_repeats_against_brute_force(spark):
    rows = [(r[0], (r[1] or "").encode().split()) for r in documents()]
    first = windows(rows)
    expected = []
    for doc_id, w in rows:
        gone = set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] != (-(1 << 63) if doc_id is None else doc_id, i):
                gone |= set(range(i, i + 20))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        expected.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    for block_bytes, fan in ((1 << 12, blocks.FAN), (1 << 24, blocks.FAN), (1 << 6, 16)):  # the last with relays, two groups of blocks
        got = substring_dedup.remove_repeats(crowded(spark, ["kept_sha256"]), block_bytes=block_bytes, fan=fan, digest=True)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)
    assert blocks.count(blocks.pack(frame(spark), block_bytes=1 << 6)) > 4 * blocks.first_level(blocks.bucket_count(1, 1), 16)
    text = substring_dedup.remove_repeats(frame(spark)).where("doc_id = 61").first()
    assert text["kept_text"] == "" and text["n_removed"] == text["n_words"]
    assert substring_dedup.op7_substring_dedup(frame(spark, [])).count() == 0


def trie(texts):
    """Counts by context and symbol of all orders, one dictionary each."""
    tables = [Counter() for _ in range(lm_scoring.ORDER + 1)]
    for t in texts:
        s = lm_scoring.LEAD + b" ".join(t.lower().split()) + b"\n"
        for i in range(lm_scoring.ORDER, len(s)):
            for k in range(lm_scoring.ORDER + 1):
                tables[k][s[i - k : i], s[i]] += 1
    kids = [{} for _ in tables]
    for k, table in enumerate(tables):
        for (c, x), n in table.items():
            kids[k].setdefault(c, {})[x] = n
    return kids


def cost(kids, text):
    s = lm_scoring.LEAD + b" ".join(text.lower().split()) + b"\n"
    total = 0.0
    for i in range(lm_scoring.ORDER, len(s)):
        excluded = set()
        for k in range(lm_scoring.ORDER, -1, -1):
            seen = {x: n for x, n in kids[k].get(s[i - k : i], {}).items() if x not in excluded}
            t, d = sum(seen.values()), len(seen)
            if s[i] in seen:
                total += math.log10((2 * seen[s[i]] - 1) / (2 * t))
                break
            if t:
                total += math.log10(d / (2 * t))
                excluded |= set(seen)
        else:
            total -= math.log10(256 - len(excluded))
    return total


def test_lm_scores_against_a_trie(spark):
    rows = [r for r in documents() if r[0] is not None and r[0] != 85]
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows}
    training = [(r[1] or "").encode() for r in rows if not held[r[0]]]
    kids = trie(training)
    c = Counter(w for t in training for w in t.lower().split())
    ends = len(training)
    n, v = sum(c.values()) + ends, len(c) + 1
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    for block_bytes, fan in ((1 << 12, blocks.FAN), (1 << 24, blocks.FAN), (1 << 6, 16)):  # the last with relays, two groups of blocks
        got = lm_scoring.score_texts(crowded(spark, ["score"], rows), held_out, block_bytes=block_bytes, fan=fan).collect()
        assert len(got) == len(rows)
        texts = {r[0]: (r[1] or "").encode() for r in rows}
        for r in got:
            w = texts[r["doc_id"]].lower().split()
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
            base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
            assert math.isclose(r["base_score"], base, rel_tol=1e-9)
            assert math.isclose(r["score"], cost(kids, texts[r["doc_id"]]), rel_tol=1e-5)
    assert lm_scoring.op2_lm_scoring(frame(spark, [])).count() == 0


def test_probabilities_after_a_context_sum_to_one():
    kids = trie([b"abracadabra", b"abandon the banana"])
    texts = [bytes([x]) for x in range(256)]
    grams = {}
    for k in (lm_scoring.ORDER,):
        for c, seen in kids[k].items():
            for x, n in seen.items():
                grams[int.from_bytes(c + bytes([x]), "big")] = n
    for context in (b"\nabra", b"zzzzz", b"the b"):
        wanted = {int.from_bytes(context + t, "big") for t in texts}
        near = sorted(wanted | {g for g in grams if (g >> 8 & 0xFFFFFF) == int.from_bytes(context[-3:], "big")})
        low = Counter()
        for g, n in grams.items():
            low[g & 0xFFFFFF] += n
        lows = np.array(sorted(low), np.uint64)
        model = lm_scoring.Trie(lows, np.array([low[int(x)] for x in lows], np.int64))
        logs = model.log10(np.array(near, np.uint64), np.array([grams.get(g, 0) for g in near], np.int64))
        assert math.isclose(sum(10**x for g, x in zip(near, logs) if g in wanted), 1.0, rel_tol=1e-9)


def test_quality_model_learns_and_stands_edges(spark):
    rng = __import__("random").Random(1)
    rows, labels = [], []
    for i in range(240):
        t = prose(rng, 40)
        bad = i % 4 == 0
        rows.append((i, " ".join(x.upper() + "!!" for x in t.split()) if bad else t, "en", "s", 0))
        labels.append((i, 0 if bad else 1, 0))
    table = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (10**6, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.op9_quality_classifier(crowded(spark, ["score", "predicted"], [*rows, (500, None, None, None, None), (501, "", "", "", 0), (None, "x", "", "", 0)]), table)
    r = {x["doc_id"]: x for x in got.collect()}
    truth = {i: q for i, q, _ in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r[i]["held_out"] for i in held) and np.mean([r[i]["predicted"] == truth[i] for i in held]) >= 0.95
    assert r[500]["score"] == r[501]["score"] and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in r.values())
    none = quality_classifier.op9_quality_classifier(frame(spark, rows[:3]), table.where("false")).collect()
    assert {x["score"] for x in none} == {0.5}
    assert quality_classifier.op9_quality_classifier(frame(spark, []), table).count() == 0


ITEM = " ".join(f"item{i} word{i % 7}" for i in range(16))


def test_leaks(spark):
    rng = __import__("random").Random(2)
    near = ITEM.split()
    near[2] = "other"
    far = [x if i % 4 else "gap" for i, x in enumerate(ITEM.split())]
    rows = [
        (1, prose(rng, 50) + " " + ITEM + " " + prose(rng, 9), "en", "s", 0),
        (2, prose(rng, 10) + " " + " ".join(near), "en", "s", 0),
        (3, " ".join(far), "en", "s", 0),
        (4, ITEM.upper() + " tail", "en", "s", 0),
        (5, prose(rng, 300), "en", "s", 0),
        (6, None, None, None, None),
        (7, "", "", "", 0),
        (8, "short item here", "", "", 0),
        (None, ITEM, "", "", 0),
        (1, "twice", "", "", 0),
    ]
    benchmark = spark.createDataFrame([(10, ITEM), (11, None), (12, ""), (13, "short item here"), (14, prose(rng, 30))], "item_id long, text string")
    for broadcast in (2_000_000, 0):
        got = decontaminate.find_leaks(crowded(spark, ["similarity", "s", "n", "h"], rows), benchmark.withColumn("s", F.lit(1)), broadcast_shingles=broadcast).collect()
        found = {(r["doc_id"], r["item_id"]): r for r in got}
        assert set(found) == {(1, 10), (2, 10), (4, 10), (8, 13), (None, 10)} or set(found) == {(1, 10), (4, 10), (8, 13), (None, 10)}
        assert found[1, 10]["similarity"] == 1.0 and found[1, 10]["differing_bits"] == 0 and found[1, 10]["start_word"] == len(rows[0][1].split(" " + ITEM)[0].split())
    assert decontaminate.find_leaks(frame(spark, []), benchmark).count() == 0
    assert decontaminate.find_leaks(frame(spark, rows), benchmark.where("false")).count() == 0


def test_short_items_inside_longer_documents(spark):
    rng = __import__("random").Random(4)
    rows = [
        (1, prose(rng, 30) + " Four short Words here " + prose(rng, 9) + " four short words here", "en", "s", 0),
        (2, "x word_one", "en", "s", 0),
        (3, "four short words there", "en", "s", 0),
        (4, "word_one", "en", "s", 0),
        (None, "a b c d e f two parts", "en", "s", 0),
        (5, None, None, None, None),
    ]
    benchmark = spark.createDataFrame([(10, "four short words here"), (11, "word_one"), (12, "two parts"), (13, "two parts"), (14, ITEM)], "item_id long, text string")
    for broadcast in (2_000_000, 0):
        got = decontaminate.find_leaks(frame(spark, rows), benchmark, broadcast_shingles=broadcast).collect()
        assert {(r["doc_id"], r["item_id"]): (r["start_word"], r["n_words"], r["similarity"]) for r in got} == {
            (1, 10): (30, 4, 1.0),
            (2, 11): (1, 1, 1.0),
            (4, 11): (0, 1, 1.0),
            (None, 12): (6, 2, 1.0),
            (None, 13): (6, 2, 1.0),
        }
        assert len(got) == 5


def test_leaks_against_brute_force(spark):
    """All windows by exact similarity: what the search finds is right, and it finds all but what the radius loses."""
    rng = __import__("random").Random(8)
    items = [(i, prose(rng, rng.randint(15, 60))) for i in range(12)]
    rows = []
    for i in range(120):
        w = items[i % 12][1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = "edited"
        rows.append((i, prose(rng, 20) + " " + " ".join(w) + " " + prose(rng, 20), "en", "s", 0))

    def shingles(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    expected = {}
    for doc_id, text, *_ in rows:
        d = text.lower().split()
        for item_id, item in items:
            w = item.lower().split()
            s = shingles(w)
            best = 0.0
            for at in range(max(1, len(d) - len(w) + 1)):
                x = shingles(d[at : at + len(w)])
                best = max(best, sum((x & s).values()) / sum((x | s).values()))
            if best >= 0.8:
                expected[doc_id, item_id] = best
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) <= set(expected) and len(got) >= 0.97 * len(expected)
    assert all(math.isclose(got[k], expected[k]) for k in got)


def test_blocks_round_trip():
    for values in (np.array([], np.int64), np.array([5, 5, 2**63 - 1, -(2**63)]), np.arange(10_000)):
        for delta in (False, True):
            assert (blocks.get(blocks.put(values, delta), np.int64, delta) == values).all()
    assert blocks.cuts(np.array([0, 1 << 62, 3 << 62], np.uint64), 4) == [0, 1, 2, 2, 3]


def test_a_large_benchmark_finds_the_same_by_both_ways(spark):
    """10,000 items and a text of 20,000 words: broadcast and shuffled shingles give the same rows, and few pairs of
    fingerprints are compared."""
    rng = __import__("random").Random(12)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(15, 40)))) for i in range(10_000)]
    long = [rng.choice(words) for _ in range(20_000)]
    for k in range(40):
        item = items[k * 200][1].split()
        if k % 2:
            item[0] = "changed"
        long[k * 450 : k * 450] = item
    rows = [(1, " ".join(long), "en", "s", 0), (2, items[77][1], "en", "s", 0), (None, "x " + items[78][1].upper(), "en", "s", 0), (None, items[79][1], "en", "s", 0)]
    benchmark = spark.createDataFrame(items, "item_id long, text string").repartition(4)
    got = [sorted(map(tuple, decontaminate.find_leaks(frame(spark, rows), benchmark, broadcast_shingles=b).collect()), key=key) for b in (2_000_000, 0)]
    assert got[0] == got[1] and len(got[0]) >= 40 + 3 - 2
    assert {(r[0], r[1]) for r in got[0]} >= {(1, k * 200) for k in range(0, 40, 2)} | {(2, 77), (None, 78), (None, 79)}


def test_descent_reaches_the_optimum_of_an_exact_solver():
    """Hinge loss over scaled indicators: the dual by projected gradient in many small steps, on a small problem."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, 8)).astype(np.int32) for _ in range(60)]
    labels = np.array([int(r.min() < 3) for r in rows])
    cost = 0.5
    model = quality_classifier._descend(rows, labels, cost, 3000, 1)
    yes, no = np.ones(quality_classifier.PLACES), np.ones(quality_classifier.PLACES)
    for r, y in zip(rows, labels):
        (yes if y else no)[r] += 1
    ratio = np.log(yes / yes.sum()) - np.log(no / no.sum())
    ratio[(yes == 1) & (no == 1)] = 0
    x = np.zeros((60, 41))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
    x[:, 40] = 1.0
    sign = np.where(labels == 1, 1.0, -1.0)
    top = cost * 60 / (2 * np.where(labels == 1, (labels == 1).sum(), (labels == 0).sum()))
    q = (x * sign[:, None]) @ (x * sign[:, None]).T
    alpha = np.zeros(60)
    for _ in range(200_000):
        alpha = np.clip(alpha - 0.9 / np.linalg.norm(q, 2) * (q @ alpha - 1), 0, top)
    w = (alpha * sign) @ x
    got = np.r_[np.where(ratio[:40] != 0, model.weights[:40] / np.where(ratio[:40] != 0, ratio[:40], 1), 0), model.bias]
    loss = lambda v: 0.5 * v @ v + (top * np.maximum(0, 1 - sign * (x @ v))).sum()
    assert np.allclose(got, w, atol=2e-2) and loss(got) <= loss(w) * 1.001


def test_the_sample_is_bounded_by_rows_and_bytes(spark, monkeypatch):
    rows = [(1, f"text number {i} of one id", "en", "s", 0) for i in range(300)] + [(2, "the same text", "en", "s", 0)] * 300
    rows += [(i, "word " * 400 + str(i), "en", "s", 0) for i in range(3, 40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    seen = {}
    monkeypatch.setattr(quality_classifier, "fit_rows", lambda r, y, **k: seen.update(rows=r))
    quality_classifier.fit_quality(frame(spark, rows), labels, max_rows=25)
    assert len(seen["rows"]) == 25
    quality_classifier.fit_quality(frame(spark, rows), labels, max_rows=500, max_bytes=20_000)
    assert 0 < sum(r.nbytes for r in seen["rows"]) <= 20_000
    quality_classifier.fit_quality(frame(spark, rows), labels.where("doc_id = 2"), max_rows=500)
    assert len(seen["rows"]) == 1
    quality_classifier.fit_quality(frame(spark, rows), labels, max_bytes=1)
    assert not seen["rows"]


def test_scores_of_very_long_texts_and_null_ids(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = [(i, ("good words here " if i % 2 else "### $$$ ") * 9 + str(i), "en", "s", 0) for i in range(40)]
    rows += [(100, "good words here " * 60_000, "en", "s", 0), (None, "x" * 500_000, "en", "s", 0), (None, None, None, None, None)]
    got = quality_classifier.op9_quality_classifier(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(r["held_out"] is not None and 0 <= r["score"] <= 1 for r in got)
