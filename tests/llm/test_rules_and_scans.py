import hashlib
import math
import random
import re
import string
from collections import Counter

from pyspark.sql import functions as F

from sievelight.llm import chat, licenses, mixing, quality_rules, secrets
from tests.llm.fixtures import DOCS, crowded, documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(r):
    return tuple((x is None, str(x)) for x in r)


def test_quality_rules_base_figures(spark):
    got = quality_rules.op1_quality_rules(frame(spark)).collect()
    expected = []
    for doc_id, text, *_ in documents():
        t = text or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        expected.append((doc_id, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed))
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(expected, key=key)


def test_quality_rules_verdicts(spark):
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.op1_quality_rules(frame(spark)).collect() if r["doc_id"] not in (85, 83, None)}
    assert kept[85 - 1] is False and kept[86] is False and kept[87] is False and kept[80] is False and kept[81] is False
    clean = [r for r in documents()[:60] if len((r[1] or "").split()) >= 60]
    assert all(kept[r[0]] for r in clean)


def test_lines_without_a_sentence_and_menus_of_four_languages_go(spark):
    sentence = "Ein Satz mit vielen Wörtern, der hier endet und dann noch einen zweiten Teil hat, wie es sich gehört."
    other = "Danach folgt etwas ganz anderes, das man noch nie gelesen hat, und auch dies endet hier mit einem Punkt."
    rows = [
        (1, f"{sentence}\n" + "wort " * 60, "de", "s", 0),
        (2, f"{sentence}\nZurück\nÜber uns\nWeiterlesen >\n{other} Und mehr.", "de", "s", 0),
        (3, f"{sentence} {other} " + "unvollendet " * 8, "de", "s", 0),
        (4, f"Tous droits réservés\nLire la suite\n{sentence} {other}", "fr", "s", 0),
        (5, f"Cookie-Richtlinie\nPOLÍTICA DE PRIVACIDAD de esta página\n{sentence} {other}", "es", "s", 0),
    ]
    got = {r["doc_id"]: r for r in quality_rules.clean_lines(frame(spark, rows)).collect()}
    assert got[1]["clean_text"] == sentence and not got[1]["kept"]
    assert got[2]["clean_text"] == f"{sentence}\n{other} Und mehr." and got[2]["kept"]
    assert got[3]["clean_text"] == rows[2][1] and got[3]["kept"]
    assert got[4]["clean_text"] == got[5]["clean_text"] == f"{sentence} {other}"


def test_quality_rules_clashing_names_and_empty_table(spark):
    out = quality_rules.clean_lines(crowded(spark, ["kept", "n_words", "clean_text"]))
    assert out.columns.count("kept") == 1 and dict(out.dtypes)["kept"] == "boolean" and out.count() == len(documents())
    assert quality_rules.clean_lines(frame(spark, [])).count() == 0


PATTERNS = {
    "assign": re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in p.finditer(text or ""):
            if (kind == "assign" and len(m[1]) >= 12) or (kind == "access" and len(m[0]) >= 18) or (kind == "hex" and len(m[0]) >= 16):
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_secret_base_spans(spark):
    got = secrets.op6_secret_scans(frame(spark)).collect()
    expected = []
    for doc_id, text, *_ in documents():
        s = base_spans(text)
        expected.append((doc_id, *(sum(x.startswith(k) for x in s) for k in PATTERNS), hashlib.sha256(",".join(s).encode()).hexdigest()))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expected, key=key)
    for r in got:  # base spans stay among all
        if r["doc_id"] == 91:
            assert set(base_spans(dict((d[0], d[1]) for d in documents())[91])) <= set(r["spans"].split(","))


def test_random_tokens_are_found_and_others_are_not(spark):
    rng = random.Random(4)
    tokens = ["".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(32)) for _ in range(60)]
    plain = ["a" * 40 + "11", "version_2024_of_the_internationalisation_tables_1", "0123456789abcdefghijklmnopqrstuvwxyz", "ab12" * 10]
    rows = [(i, f"key {t} end", "en", "s", 0) for i, t in enumerate([*tokens, *plain])]
    spans = {r["doc_id"]: r["spans"] for r in secrets.op6_secret_scans(frame(spark, rows)).collect()}
    assert sum(spans[i] == "random:4:36" for i in range(60)) >= 54
    assert not any("random" in spans[60 + i] for i in range(len(plain)))


def test_tokens_joined_to_their_names(spark):
    rng = random.Random(14)
    made = ["".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(40)) for _ in range(400)]
    tokens = [t for t in made if len(re.findall("[0-9]", t)) > 1][:60]
    forms = ["AWS_SECRET_ACCESS_KEY={}", "https://host.org/get?a=1&sig={}&x=2", "k={}==", "KEY_OF_MORE_THAN_20_LETTERS={}", "{}"]
    rows = [(i, f"é {forms[i % 5].format(t)} end", "en", "s", 0) for i, t in enumerate(tokens)]
    rows += [(100, "short K8bZ2xQ9vL4mT7wR1p== end", "en", "s", 0)]  # 18 symbols, 20 with the padding
    found = secrets.scan_secrets(frame(spark, rows)).collect()
    random_ = {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == 3] for r in found}
    for k in range(5):
        of_form = [i for i in range(60) if i % 5 == k]
        hits = [i for i in of_form if (tokens[i] + "==" * (k == 2)) in random_[i]]
        assert len(hits) >= 0.75 * len(of_form), forms[k]
    assert not any("=" in t.rstrip("=") for spans in random_.values() for t in spans)
    assert random_[100] == ["K8bZ2xQ9vL4mT7wR1p=="]


def test_copies_of_one_random_token_hide_no_plain_token(spark):
    rng = random.Random(2)
    token = "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(48))
    rows = [(i, f"key {token} end", "en", "s", 0) for i in range(1500)]
    rows.append((2000, "plain " + "ab12" * 12 + " end", "en", "s", 0))
    found = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.scan_secrets(frame(spark, rows)).collect()}
    assert all(3 in found[i] for i in range(1500)) and 3 not in found[2000]


def test_redaction_and_edges(spark):
    out = {r["doc_id"]: r for r in secrets.redact(crowded(spark, ["spans"])).collect() if r["doc_id"] in (80, 81, 91)}
    assert "hunter2" not in out[91]["text"] and "deadbeef" not in out[91]["text"] and " é " in out[91]["text"]
    assert out[80]["text"] is None and out[81]["text"] == ""
    assert secrets.op6_secret_scans(frame(spark, [])).count() == 0


def license_words(text):
    return re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def phrase_figures(doc_id, text):
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    w = license_words(text)
    places = sorted((i, k) for k, p in phrases.items() for i in range(len(w)) if w[i : i + len(p)] == p)
    ends = (places[0][0], places[-1][0]) if places else (None, None)
    return (doc_id, len(w), len(places), *ends, ",".join(sorted({k for _, k in places})))


def test_license_places(spark):
    rows = documents()
    rows += [(1, "the MIT License here", "en", "s", 0)] * 2  # equal rows
    rows += [(2, "a general public thing", "en", "s", 0), (2, "x y public license", "en", "s", 0)]  # one id, no place
    rows += [(None, "mit license", "en", "s", 0), (None, "so mit license", "en", "s", 0)]
    got = licenses.op4_license_scans(crowded(spark, ["row", "n", "template", "labels"], rows)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((phrase_figures(*r[:2]) for r in rows), key=key)
    for r in got:
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert r["doc_id"] != 2 or (r["labels"], r["score"]) == ("", 0.0)


def template_spans(text, gap=2, k=2, min_share=0.7):
    """Labels of the templates' spans, by the docstring."""
    w, spans = license_words(text), []
    for template, (label, body) in enumerate(licenses.TEMPLATES):
        t = body.split()
        drift = math.ceil((1 - min_share) * len(t))
        votes = {}
        for at in range(len(t) - k + 1):
            for p in range(len(w) - k + 1):
                if w[p : p + k] == t[at : at + k]:
                    votes.setdefault(p - at, set()).add(at)
        for first in votes:
            reached = [first]
            for d in sorted(x for x in votes if first < x <= first + drift):
                if d - reached[-1] <= gap:
                    reached.append(d)
            share = len(set().union(*(votes[d] for d in reached))) / (len(t) - k + 1)
            if share >= min_share:
                start, end = min(d + min(votes[d]) for d in reached), max(d + max(votes[d]) + k for d in reached)
                assert end - start <= len(t) + drift
                spans.append((start, end, share, template, label))
    worse = lambda x, o: o[0] < x[1] and o[1] > x[0] and (o[2] > x[2] or (o[2] == x[2] and o[3] == x[3] and o[:2] < x[:2]))
    return sorted((x[4], x[0], x[1]) for x in spans if not any(worse(x, o) for o in spans))


def test_license_templates_against_brute_force(spark):
    rng, texts = random.Random(8), []
    for i in range(120):
        parts = []
        for _ in range(rng.choice([0, 1, 1, 2])):
            t = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                at = rng.randrange(len(t))
                t = rng.choice([t[:at] + ["word"] + t[at:], t[:at] + t[at + 1 :], t[:at] + ["other"] + t[at + 1 :]])
            parts += [*t, *["plain"] * rng.choice([0, 1, 5])]
        texts.append(" ".join(parts))
    texts.append(" ".join(["permission is hereby granted"] * 300))  # a chain of diagonals without the whole
    _, spans = licenses.scan_licenses(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]))
    got = {}
    for r in spans.where("not is_phrase").collect():
        got.setdefault(r["doc_id"], []).append((r["label"], r["start"], r["end"]))
    expected = {i: x for i, t in enumerate(texts) if (x := template_spans(t))}
    assert {i: sorted(x) for i, x in got.items()} == expected and len(expected) > 50


def test_license_text_with_a_word_put_in(spark):
    text = "x y permission is hereby granted free of charge to any person obtaining one copy of this software and associated new documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software z"
    documents_, spans = licenses.scan_licenses(frame(spark, [(1, text, "en", "s", 0)]))
    r = documents_.first()
    assert r["labels"] == "mit" and r["n_base"] == 0 and r["score"] > 0.7
    assert spans.where("not is_phrase").count() == 1
    assert licenses.op4_license_scans(frame(spark, [])).count() == 0


def test_the_closest_notice_wins(spark):
    rows = [
        (1, "This work is licensed under the GNU General Public License, version 3.", "en", "s", 0),
        (2, "x Licensed under CC BY-NC 4.0. y", "en", "s", 0),
        (3, "Licensed under the GNU Lesser General Public License and released under the MIT License", "en", "s", 0),
    ]
    got = {r["doc_id"]: r["labels"] for r in licenses.op4_license_scans(frame(spark, rows)).collect()}
    assert got == {1: "gpl", 2: "cc-by-nc", 3: "gpl,lgpl,mit"}


def test_mixing_targets_and_cuts(spark):
    rows = [(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.op8_mixing(frame(spark)).collect()]
    sizes = Counter()
    for _, text, _, source, _ in documents():
        sizes[source] += len(WORD.findall(text or ""))
    total = sum(sizes.values())
    weight = {s: (1.0, 2.0, 3.0)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, free, left = {}, set(sizes), float(total)
    while True:
        level = left / sum(weight[s] for s in free) if free else 0.0
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    by_target = Counter()
    for _, size, _, t, taken in rows:
        by_target[round(t, 6)] += taken
        assert 0 <= taken <= 3 * size
    expected = Counter()
    for s in target:
        expected[round(target[s], 6)] += int(target[s] + 1e-9)
    assert all(abs(by_target[t] - n) <= len(sizes) for t, n in expected.items())
    again = [(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.op8_mixing(frame(spark).repartition(7)).collect()]
    assert sorted(rows, key=key) == sorted(again, key=key)


def test_mixing_edges(spark):
    assert mixing.op8_mixing(frame(spark, [])).count() == 0
    out = mixing.mix_sources(crowded(spark, ["size", "target", "taken"]))
    assert out.columns.count("size") == 1 and out.count() == len(documents())


TURNS = "conv_id long, turn long, role string, text string"


def test_chat_collapse(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    rows += [(2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", None)]
    rows += [(3, 5, "user", "a"), (3, 9, "assistant", "b"), (3, 11, "user", None)]  # the same, other numbers
    rows += [(4, 0, "user", "a"), (4, 1, "assistant", "c")]
    rows += [(None, None, "user", ""), (5, 0, None, None)]
    out = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, TURNS).withColumn("rendered", F.lit(1))).collect()}
    assert set(out) == {2, 4, 5, None}
    assert out[2]["n_copies"] == 2 and out[2]["n_turns"] == 3
    assert out[4]["rendered"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_long_conversation_is_cut_in_parts(spark):
    rows = [(1, i, "user", str(i)) for i in range(600)] + [(2, i, "user", str(i)) for i in range(500)]
    out = chat.format_chats(spark.createDataFrame(rows, TURNS)).orderBy("part").collect()
    assert [(r["conv_id"], r["part"]) for r in out] == [(1, 0), (1, 1), (1, 2)]
    assert "".join(r["rendered"] for r in out) == "".join(f"<|im_start|>user\n{i}<|im_end|>\n" for i in range(600))
