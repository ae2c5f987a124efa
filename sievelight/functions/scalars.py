"""Column functions: risks from class probabilities, rounding rules, hashes, labels, boxes, distances.

All are expressions for Catalyst; none needs Python at run time.  Class probabilities are an ``array<double>`` whose
entries stand in the order of a literal list of class ids.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def unit_hash(seed: int | str, *ids: Column | str) -> Column:
    """A number in [0, 1) from SHA-256 of the seed and the ids: the same on every run, cluster and engine."""
    parts = [F.col(c) if isinstance(c, str) else c for c in ids]
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def class_list(classes: Sequence[int]) -> Column:
    return F.lit(list(classes))


def probability_of(probs: Column, label: Column, classes: Sequence[int]) -> Column:
    """The probability of class ``label``; null for a label that isn't in the class order."""
    return F.get(probs, F.nullif(F.array_position(class_list(classes), label), F.lit(0).cast("long")).cast("int") - 1)


def _clip(p: Column, epsilon: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(epsilon), p))


def self_confidence(probs: Column, label: Column, classes: Sequence[int]) -> Column:
    return 1.0 - probability_of(probs, label, classes)


def negative_log_likelihood(probs: Column, label: Column, classes: Sequence[int], epsilon: float = EPSILON) -> Column:
    return -F.log(_clip(probability_of(probs, label, classes), epsilon))


def prediction_margin(probs: Column, label: Column, classes: Sequence[int]) -> Column:
    """Greatest probability of another class minus the label's, from -1 to 1."""
    at = F.array_position(class_list(classes), label)
    others = F.filter(probs, lambda x, i: i + 1 != at)
    return F.array_max(others) - probability_of(probs, label, classes)


def predictive_entropy(probs: Column, epsilon: float = EPSILON) -> Column:
    """Entropy of the clipped probabilities, which aren't normalised again."""
    return -F.aggregate(F.transform(probs, lambda p: _clip(p, epsilon) * F.log(_clip(p, epsilon))), F.lit(0.0), lambda a, x: a + x)


RISKS = {
    "self_confidence": self_confidence,
    "negative_log_likelihood": negative_log_likelihood,
    "prediction_margin": prediction_margin,
    "predictive_entropy": lambda probs, label, classes: predictive_entropy(probs),
}
ALIASES = {
    "nll": "negative_log_likelihood",
    "cross_entropy": "negative_log_likelihood",
    "margin": "prediction_margin",
    "entropy": "predictive_entropy",
    "confidence": "self_confidence",
}


def risk(method: str, probs: Column, label: Column, classes: Sequence[int]) -> Column:
    name = ALIASES.get(method, method)
    if name not in RISKS:
        raise ValueError(f"unknown risk method: {method}")
    return RISKS[name](probs, label, classes)


def predicted_class(probs: Column, classes: Sequence[int]) -> Column:
    """The class with the greatest probability, the first one on ties."""
    return F.element_at(class_list(classes), F.array_position(probs, F.array_max(probs)).cast("int"))


def valid_probabilities(probs: Column, n_classes: int, *, atol: float = 1e-7, rtol: float = 1e-5, slack: float = 1e-12) -> Column:
    """True if there are ``n_classes`` finite entries in [0, 1] that sum to 1."""
    total = array_sum(probs)
    inside = F.forall(probs, lambda p: p.isNotNull() & ~F.isnan(p) & (p >= -slack) & (p <= 1.0 + slack))
    return F.coalesce((F.size(probs) == n_classes) & inside & (F.abs(total - 1.0) <= atol + rtol), F.lit(False))


def normalise_rate(rate: float) -> float:
    """A rate over 1 is a percentage: 1 is all and 1.5 is 1.5 %."""
    value = rate / 100.0 if rate > 1 else float(rate)
    if not (math.isfinite(value) and 0.0 <= value <= 1.0):
        raise ValueError(f"not a rate: {rate}")
    return value


def exact_corruption_count(n: Column, rate: float) -> Column:
    """How many of ``n`` rows to corrupt, rounded half up."""
    return F.least(n.cast("long"), F.floor(n * F.lit(float(rate)) + F.lit(0.5)).cast("long"))


def budget_count(n: Column, budget: float) -> Column:
    """How many of ``n`` rows a review budget pays for, rounded up in double arithmetic."""
    return F.least(n.cast("long"), F.ceil(n.cast("double") * F.lit(float(budget))).cast("long"))


def hashed_id(*parts: Column, length: int = 24) -> Column:
    """The first digits of SHA-256 of the parts with a NUL between them."""
    joined = F.concat(*[x for i, p in enumerate(parts) for x in ((F.lit("\0"), p) if i else (p,))])
    return F.substring(F.sha2(joined, 256), 1, length)


def salted(salt: str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(salt), F.lit("|"), value), 256)


def salted_weight(salt: str, value: Column, threshold: int, low: float, high: float) -> Column:
    """``low`` if the first byte of the salted hash is under ``threshold``, else ``high``."""
    return F.when(F.conv(F.substring(salted(salt, value), 1, 2), 16, 10).cast("int") < threshold, F.lit(low)).otherwise(F.lit(high))


def normalise_label(value: Column) -> Column:
    """Trimmed, in lower case, without the prefix ``correction_``; blank is null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(value)), "^correction_", ""), F.lit(""))


def box_centre(low: Column, high: Column, *, half_even: bool = False) -> Column:
    mid = (low + high) / 2.0
    return (F.bround(mid) if half_even else F.floor(mid)).cast("long")


def box_stats(x0: Column, y0: Column, x1: Column, y1: Column) -> dict[str, Column]:
    """Width, height, log area and log aspect of a box; sides count as 1 at least."""
    width, height = F.greatest(x1 - x0, F.lit(1)).cast("double"), F.greatest(y1 - y0, F.lit(1)).cast("double")
    return {"width": width, "height": height, "log_area": F.log(width * height), "log_aspect": F.log(width / height)}


def transition(observed: Column, proposed: Column) -> Column:
    return F.concat(observed.cast("string"), F.lit("->"), proposed.cast("string"))


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hexadecimal hashes of at most 16 digits and equal width; null if the widths differ."""
    bits = lambda x: F.conv(x, 16, -10).cast("long")
    return F.when(F.length(a) == F.length(b), F.bit_count(bits(a).bitwiseXOR(bits(b))).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine, with norms of 1e-12 at least, from 0 to 2."""
    norm = lambda v: F.greatest(F.lit(1e-12), F.sqrt(dot(v, v)))
    return F.least(F.lit(2.0), F.greatest(F.lit(0.0), 1.0 - dot(a, b) / (norm(a) * norm(b))))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also when ``body`` uses it inside lambda functions."""
    return F.transform(F.array(value), body)[0]


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(values: Column) -> Column:
    exps = lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    shares = lambda e: let(array_sum(e), lambda total: F.transform(e, lambda x: x / total))
    return let(values, lambda v: let(exps(v), shares))


def temperature_transform(probs: Column, temperature: float | Column) -> Column:
    """Probabilities after dividing their logarithms by a temperature."""
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    return softmax(F.transform(probs, lambda p: F.log(_clip(p, 1e-15)) / t))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null on a zero or null denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def canonical_sha256(columns: Sequence[str]) -> Column:
    """Hash of the columns as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def spread_indices(n: Column, m: Column) -> Column:
    """``m`` positions spread evenly over 0 .. n-1, both ends included; all positions if m >= n."""
    several = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.floor(i * (n - 1) / (m - 1)).cast("long"))
    everything = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("long"))
    none = F.array().cast("array<bigint>")
    return F.when((n <= 0) | (m <= 0), none).when(m >= n, everything).when(m == 1, F.array(F.lit(0).cast("long"))).otherwise(several)
