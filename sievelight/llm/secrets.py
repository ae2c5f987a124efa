"""Secret scans: fixed patterns, and a randomness test battery with length-aware false-discovery control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sievelight.llm.common import checkpoint, let

# The patterns of the kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

#: Encodings by alphabet, in the order in which they are tried.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("hex_upper", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
# What the tests see in ordinary tokens (names, paths, compounds) of 24 symbols in each encoding, fitted on
# 40,000 tokens of public source code and manuals.  The share of equal symbols among all pairs, its deviation, the share of
# neighbours of unlike class (capitals, small letters, digits, signs), and its deviation.
ORDINARY = (
    (0.14, 0.07, 0.15, 0.11),
    (0.14, 0.07, 0.15, 0.11),
    (0.08, 0.035, 0.05, 0.09),
    (0.08, 0.035, 0.08, 0.09),
    (0.055, 0.028, 0.27, 0.085),
    (0.055, 0.028, 0.27, 0.085),
)
#: Weights of the two figures in the score; a quarter of their variance is between tokens and does not fall with the length.
PAIRS_WEIGHT, CHANGES_WEIGHT, BETWEEN, LENGTH = 1.0, 3.0, 0.25, 24.0
#: A token that one of the tests finds unlike uniform draws at this level is not random.
UNIFORM_LEVEL = 1e-3
#: p-values are kept as their decimal logarithm in whole steps, this many to a factor of ten, so that a table of them is
#: bounded and small ones stay apart; the least is 10**-300.
GRID = 100


def _running(values: Column, combine) -> Column:
    """Running totals of an array of whole numbers from 0 on; in runs of 256, so that the cost is linear."""

    def scan(part: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return let(combine(acc["at"], x), lambda y: F.struct(y.alias("at"), F.concat(acc["out"], F.array(y)).alias("out")))

        return F.aggregate(part, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step)["out"]

    def carried(inner: Column) -> Column:
        ends = scan(F.transform(inner, lambda a: F.element_at(a, -1)))
        on = lambda e: F.transform(inner, lambda a, i: F.transform(a, lambda y: combine(y, F.coalesce(F.get(e, i - 1), F.lit(0)))))
        return F.flatten(let(ends, on))

    def whole(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 256).cast("int")), lambda i: scan(F.slice(v, i * 256 + 1, F.lit(256))))
        return F.when(F.size(v) == 0, v).otherwise(let(runs, carried))

    return let(values, whole)


def _found(t: Column, pattern: str) -> Column:
    """(start, end, text) of the leftmost non-overlapping matches, from the lengths of the matches and of what is between."""

    def place(pieces: Column) -> Column:
        ends = _running(F.transform(pieces, lambda p: p["gap"] + F.length(p["m"])), lambda a, b: a + b)
        return F.zip_with(pieces, ends, lambda p, e: F.struct((e - F.length(p["m"])).alias("start"), e.alias("end"), p["m"].alias("m")))

    gaps = F.transform(F.split(t, pattern, -1), lambda x: F.length(x))
    pieces = F.zip_with(gaps, F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    return let(F.filter(pieces, lambda p: p["m"].isNotNull()), place)


def _phi(z: Column) -> Column:
    """Upper tail of the normal distribution, by the rational approximation 7.1.26 of Abramowitz and Stegun."""
    x = F.abs(z) / float(2**0.5)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def _symbol_class(c: str) -> int:
    return 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3


def _of(values: list[float], k: Column) -> Column:
    """The value of encoding ``k``."""
    return F.element_at(F.lit([float(v) for v in values]), k + 1)


def _battery(core: Column, k: Column) -> Column:
    """(p, uniform) of a token of two symbols or more in encoding ``k``, in time linear in its length.

    p: how likely an ordinary token looks as random as this.  uniform: the least p-value of the three tests of uniform
    draws from the alphabet, times three.
    """
    tables = F.array(*[F.lit([_symbol_class(chr(c)) * 256 + a.find(chr(c)) if chr(c) in a else 0 for c in range(128)]) for _, a in ENCODINGS])
    shares = [[sum(_symbol_class(c) == j for c in a) / len(a) for j in range(4)] for _, a in ENCODINGS]
    second, third = ([sum(x**e for x in s) for s in shares] for e in (2, 3))

    def tests(v: Column) -> Column:
        whole, none = F.lit(0.0), F.lit(None).cast("int")
        code = lambda x: x.bitwiseAND(F.lit(255)).cast("double")
        unlike = lambda x, y: (F.shiftright(x, 8) != F.shiftright(y, 8)).cast("double")
        in_order = F.aggregate(
            v,
            F.struct(none.alias("last"), *[whole.alias(c) for c in ("changes", "x", "xx", "xy")]),
            lambda acc, x: F.struct(
                x.alias("last"),
                (acc["changes"] + F.coalesce(unlike(acc["last"], x), whole)).alias("changes"),
                (acc["x"] + code(x)).alias("x"),
                (acc["xx"] + code(x) * code(x)).alias("xx"),
                (acc["xy"] + F.coalesce(code(acc["last"]) * code(x), whole)).alias("xy"),
            ),
        )
        equal = F.aggregate(
            F.array_sort(v),
            F.struct(none.alias("last"), whole.alias("run"), whole.alias("pairs")),
            lambda acc, x: let(
                F.when(x == acc["last"], acc["run"] + 1.0).otherwise(0.0),
                lambda run: F.struct(x.alias("last"), run.alias("run"), (acc["pairs"] + run).alias("pairs")),
            ),
        )["pairs"]

        def judged(s: Column) -> Column:
            n, changes, pairs = F.size(v).cast("double"), s["o"]["changes"], s["pairs"]
            # How far from ordinary tokens, in deviations.
            spread = F.sqrt(BETWEEN + (1.0 - BETWEEN) * LENGTH / n)
            few_pairs = (_of([o[0] for o in ORDINARY], k) - pairs / (n * (n - 1.0) / 2.0)) / (_of([o[1] for o in ORDINARY], k) * spread)
            many_changes = (changes / (n - 1.0) - _of([o[2] for o in ORDINARY], k)) / (_of([o[3] for o in ORDINARY], k) * spread)
            norm = (PAIRS_WEIGHT**2 + CHANGES_WEIGHT**2) ** 0.5
            p = _phi((PAIRS_WEIGHT * few_pairs + CHANGES_WEIGHT * many_changes) / norm)
            # Chi-squared uniformity, by the cube root of Wilson and Hilferty.
            size = _of([len(a) for _, a in ENCODINGS], k)
            chi, df = (2.0 * pairs + n) * size / n - n, size - 1.0
            chi_p = _phi((F.pow(F.greatest(chi / df, F.lit(1e-9)), F.lit(1 / 3)) - (1.0 - 2.0 / (9.0 * df))) / F.sqrt(2.0 / (9.0 * df)))
            # Runs of classes: changes between independent neighbours.
            s2, s3 = _of(second, k), _of(third, k)
            variance = (n - 1.0) * s2 * (1.0 - s2) + 2.0 * (n - 2.0) * (s3 - s2 * s2)
            runs_p = 2.0 * _phi(F.abs(changes - (n - 1.0) * (1.0 - s2)) / F.sqrt(F.greatest(variance, F.lit(1e-9))))
            # Serial correlation at lag 1.
            mean = s["o"]["x"] / n
            around = s["o"]["xx"] - n * mean * mean
            ends = code(F.element_at(v, 1)) + code(F.element_at(v, -1))
            lagged = s["o"]["xy"] - mean * (2.0 * s["o"]["x"] - ends) + (n - 1.0) * mean * mean
            serial_p = F.when(around <= 1e-9, F.lit(0.0)).otherwise(2.0 * _phi(F.abs(lagged / F.greatest(around, F.lit(1e-9)) + 1.0 / n) * F.sqrt(n)))
            return F.struct(p.alias("p"), F.least(F.lit(1.0), 3.0 * F.least(chi_p, runs_p, serial_p)).alias("uniform"))

        return let(F.struct(in_order.alias("o"), equal.alias("pairs")), judged)

    return let(F.element_at(tables, k + 1), lambda t: let(F.transform(F.split(core, ""), lambda c: F.get(t, F.ascii(c))), tests))


def _candidates(t: Column, min_length: int) -> Column:
    """(start, end, class, p, random): tokens in a known encoding, with their length class and log p in steps of ``GRID``."""
    # '=' only pads the end, so that a name and its value are two tokens; with its padding a token may have min_length.
    letter, end = "[A-Za-z0-9+/_-]", "(?![A-Za-z0-9+/_=-])"
    pattern = rf"{letter}{{{min_length},}}(?:={{1,2}}{end})?|{letter}{{{min_length - 2},}}=={end}|{letter}{{{min_length - 1},}}={end}"

    def judged(s: Column) -> Column:
        core = F.rtrim(s["m"], F.lit("="))
        kind = F.lit(None).cast("int")
        for i, (_, letters) in reversed(list(enumerate(ENCODINGS))):
            kind = F.when(F.translate(core, letters, "") == "", F.lit(i)).otherwise(kind)

        def span(x: Column) -> Column:
            p = F.ceil(F.log10(F.greatest(x["b"]["p"], F.lit(1e-300))) * GRID).cast("int")
            return F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.floor(F.log2(F.length(core))).cast("int").alias("class"),
                p.alias("p"),
                (x["b"]["uniform"] > UNIFORM_LEVEL).alias("random"),
            )

        return let(kind, lambda k: F.when(k.isNotNull(), let(F.struct(_battery(core, k).alias("b")), span)))

    spans = F.filter(F.transform(_found(t, pattern), judged), lambda x: x.isNotNull())
    none = F.array().cast("array<struct<start:int,end:int,class:int,p:int,random:boolean>>")
    return F.when(F.rlike(t, F.lit(pattern)), spans).otherwise(none)


def _base(t: Column) -> Column:
    """The spans of the fixed patterns, by start and kind."""

    def kind(at: int, found: Column, may: Column) -> Column:
        spans = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(at).alias("kind"), s["end"].alias("end")))
        return F.when(may, spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))

    low = F.lower(t)
    key = low.contains("pass") | low.contains("secret") | low.contains("token") | low.contains("api")
    value = F.filter(_found(t, ASSIGN), lambda s: F.length(F.regexp_extract(s["m"], ASSIGN, 1)) >= 12)
    found = F.concat(kind(0, value, key), kind(1, _found(t, ACCESS), t.contains("AKIA")), kind(2, _found(t, HEX), F.rlike(t, F.lit(HEX))))
    return F.array_sort(found)


def scan_secrets(docs: DataFrame, *, text: str = "text", min_length: int = 20, level: float = 0.01, keep_text: bool = True) -> DataFrame:
    """Add ``spans`` to ``docs``: array of (start, kind, end), by start and kind, in code points, the end exclusive.

    Kinds 0 to 2 are the fixed patterns ASSIGN, ACCESS and HEX; kind 3 is what the battery adds: tokens of
    ``min_length`` (4 at least) characters or more whose alphabet is inferred from the symbols used, which look like
    uniform draws from it and not like ordinary tokens.

    Three tests look at the symbols: chi-squared uniformity, runs of symbol classes, and serial correlation.  A token is
    no uniform draw if the least p-value, times three, is ``UNIFORM_LEVEL`` at most.  For the others the null hypothesis
    is an ordinary token, a name or a compound, in which symbols repeat and runs are long; ``ORDINARY`` says how much.
    The p-value of a token is the chance that an ordinary one has as few repeats and as short runs.  Tokens are put in
    classes by the binary logarithm of the length, and in each class, over all documents, the Benjamini-Hochberg rule
    finds the tokens that are not ordinary, so that of those at most ``level`` are expected to be ordinary.  Tokens that
    are in both sets are reported.  p-values count in steps of their logarithm, so the table that the rule sorts has at
    most 30,001 rows a class and one class for each doubling of the length.

    The texts are scanned once, to a checkpoint, when the rows must be read twice; with ``keep_text`` false the text is
    left out of it.  The time is linear in the texts, however long a token is.  Null and empty texts have no spans.
    Rows are treated one by one, so repeated rows and null ids are harmless; a column named spans is replaced; empty
    input gives empty output.
    """
    if min_length < 4:
        raise ValueError("tokens of under four symbols say nothing")
    t = F.coalesce(F.col(text), F.lit(""))
    scanned = docs.drop("spans").withColumns({"_base": _base(t), "_more": _candidates(t, min_length)})
    scanned = checkpoint(scanned if keep_text else scanned.drop(text))
    tokens = scanned.select(F.explode("_more").alias("c")).select("c.class", "c.p")
    steps = tokens.groupBy("class", "p").agg(F.count(F.lit(1)).alias("n"))
    up = W.partitionBy("class").orderBy("p")
    rank = F.sum("n").over(up.rowsBetween(W.unboundedPreceding, 0))
    everything = F.sum("n").over(W.partitionBy("class"))
    # p counts as the upper end of its step, so that rounding reports no token that the rule would not.
    steps = steps.withColumn("below", F.pow(F.lit(10.0), F.col("p") / float(GRID)) <= rank / everything * level)
    cuts = steps.groupBy("class").agg(F.coalesce(F.max(F.when(F.col("below"), F.col("p"))), F.lit(-300 * GRID - 1)).alias("cut"))
    table = cuts.agg(F.map_from_entries(F.collect_list(F.struct("class", "cut"))).alias("_cuts"))  # 32 classes at most
    passed = F.filter("_more", lambda c: c["random"] & (c["p"] <= F.element_at(F.col("_cuts"), c["class"])))
    more = F.transform(passed, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    spans = F.array_sort(F.concat("_base", more))
    return scanned.crossJoin(F.broadcast(table)).withColumn("spans", spans).drop("_base", "_more", "_cuts")


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span that ``scan_secrets`` finds replaced by ``mark``; overlapping spans give one mark.

    Null and empty texts stay as they are; every row stays; the time is linear in the texts and their spans.
    """

    def cut(s: Column) -> Column:
        def joined(both: Column) -> Column:
            letters, ends = both["letters"], both["ends"]
            between = lambda a, b: F.array_join(F.slice(letters, a + 1, b - a), "")

            def piece(x: Column, i: Column) -> Column:
                before = F.coalesce(F.get(ends, i - 1), F.lit(0))
                return F.when(x["start"] >= before, F.concat(between(before, x["start"]), F.lit(mark))).otherwise("")

            return F.concat(F.array_join(F.transform(s, piece), ""), between(F.element_at(ends, -1), F.size(letters)))

        ends = _running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        return let(F.struct(F.split(F.col(text), "").alias("letters"), ends.alias("ends")), joined)

    scanned = scan_secrets(docs, text=text)
    return scanned.withColumn(text, F.when(F.size("spans") > 0, cut(F.col("spans"))).otherwise(F.col(text))).drop("spans")


def _joined(spans: Column) -> Column:
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op6_secret_scans(docs: DataFrame) -> DataFrame:
    found = scan_secrets(docs.select("doc_id", "text"), keep_text=False)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
