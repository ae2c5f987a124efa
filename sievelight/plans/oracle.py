"""What the registered queries say, in the SQL of DuckDB over the same tables.  Doubles are rounded to 6 digits."""

from __future__ import annotations


def u(seed: int | str, *ids: str) -> str:
    """SQL of ``unit_hash``."""
    text = " || '|' || ".join([f"'{seed}'", *[f"({i})::varchar" for i in ids]])
    return f"(('0x' || substr(sha256({text}), 1, 13))::bigint / 4503599627370496.0::double)"


SAMPLES = """samples AS (
  SELECT 's' || lpad(vec_id::varchar, 8, '0') AS sample_id, 'g' || (vec_id % 25)::varchar AS group_id, ((vec_id % 25) % 5)::int AS fold_id,
         't' || (vec_id % 4)::varchar AS tissue, label::int AS observed_label, list_transform(embedding, lambda x: x::double) AS features FROM embeddings)"""


def _probs(name: str, temperature: str, features: str = "features") -> str:
    return f"""{name}_cent AS (
  SELECT c, list(m ORDER BY pos) AS v FROM (
    SELECT observed_label AS c, pos, round(avg(x), 9) AS m FROM (
      SELECT observed_label, unnest({features}) AS x, generate_subscripts({features}, 1) AS pos FROM samples) GROUP BY 1, 2) GROUP BY c),
{name}_dist AS (
  SELECT sample_id, list(-round(list_distance({features}, v), 9) / {temperature} ORDER BY c) AS nd FROM samples, {name}_cent GROUP BY 1),
{name}_exp AS (SELECT sample_id, list_transform(nd, lambda d: exp(d - list_max(nd))) AS e FROM {name}_dist),
{name} AS (SELECT s.*, list_transform(e, lambda x: round(x / list_sum(e), 9)) AS p FROM samples s JOIN {name}_exp USING (sample_id))"""


PROBS = SAMPLES + ",\n" + _probs("probs", "0.1::double")
RISKS = (
    PROBS
    + """,
risks AS (
  SELECT *, round(1.0 - p[observed_label + 1], 9) AS self_confidence,
         round(-ln(least(1.0, greatest(1e-12, p[observed_label + 1]))), 9) AS negative_log_likelihood,
         round(list_max(list_filter(p, lambda x, i: i <> observed_label + 1)) - p[observed_label + 1], 9) AS prediction_margin,
         round(-list_sum(list_transform(p, lambda x: least(1.0, greatest(1e-12, x)) * ln(least(1.0, greatest(1e-12, x))))), 9) AS predictive_entropy,
         (list_position(p, list_max(p)) - 1)::int AS predicted
  FROM probs)"""
)
PRED = RISKS + f""",
pred AS (SELECT *, CASE WHEN {u("better", "sample_id")} < 0.5 THEN observed_label ELSE predicted END AS candidate FROM risks)"""
EVENTS = """ev AS (
  SELECT l.doc_id, l.toxic = 1 AS event, d.n_chars::double AS score, d.lang AS subgroup, d.source AS grp, l.quality FROM labels l JOIN documents d USING (doc_id))"""
TIES = """ti AS (SELECT l_returnflag = 'R' AS event, l_discount AS score, l_suppkey AS grp FROM lineitem)"""


def pct(value: str, table: str, key: str) -> str:
    """Average-tie percentile of a column by row key."""
    return f"""(SELECT {key}, CASE WHEN count(*) OVER () = 1 THEN 0.5 ELSE (rank() OVER (ORDER BY {value}) - 1 + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0) / (count(*) OVER () - 1) END AS pc FROM {table})"""


def ap(table: str, by: str = "", event: str = "event", score: str = "score") -> str:
    """Average precision with its rows and events."""
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""(SELECT {g}sum(n)::bigint AS n_rows, sum(tp)::bigint AS n_events, sum(tp * ct / cn) / nullif(sum(tp), 0) AS average_precision FROM (
    SELECT *, sum(tp) OVER ({part}ORDER BY s DESC) AS ct, sum(n) OVER ({part}ORDER BY s DESC) AS cn FROM (
      SELECT {g}{score} AS s, count(*) AS n, sum(({event})::int) AS tp FROM {table} GROUP BY ALL)) {"GROUP BY " + by if by else ""})"""


def auc(table: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {g}count(*) AS n_rows, sum(event::int)::bigint AS n_events,
       round((sum(CASE WHEN event THEN r END) - sum(event::int) * (sum(event::int) + 1) / 2.0) / nullif(sum(event::int) * (count(*) - sum(event::int)), 0), 6) AS auroc
  FROM (SELECT {g}event, rank() OVER ({part}ORDER BY score) + (count(*) OVER (PARTITION BY {g}score) - 1) / 2.0 AS r FROM {table}) {"GROUP BY " + by if by else ""}"""


GRID = "grid AS (SELECT t::int AS truth, q::int AS predicted FROM range(10) a(t), range(10) b(q))"
CONF = PRED + ",\n" + GRID + """,
conf AS (SELECT g.truth, g.predicted, count(x.sample_id) AS n FROM grid g LEFT JOIN pred x ON x.observed_label = g.truth AND x.predicted = g.predicted GROUP BY ALL)"""


def prf(conf: str, classes: int, by: str = "") -> str:
    """Per-class figures of confusion counts (truth, predicted, n) in groups."""
    g = f"{by}, " if by else ""
    src = f"(SELECT DISTINCT {by} FROM {conf}) g, " if by else ""
    on = f"x.{by} = g.{by} AND " if by else ""
    gb = f"g.{by}, " if by else ""
    return f"""(SELECT {gb}c::int AS class, coalesce(sum(CASE WHEN truth = c THEN n END), 0)::bigint AS support,
      coalesce(coalesce(sum(CASE WHEN truth = c AND predicted = c THEN n END), 0)::double / nullif(sum(CASE WHEN predicted = c THEN n END), 0), 0.0) AS "precision",
      coalesce(coalesce(sum(CASE WHEN truth = c AND predicted = c THEN n END), 0)::double / nullif(sum(CASE WHEN truth = c THEN n END), 0), 0.0) AS recall,
      coalesce(2.0 * coalesce(sum(CASE WHEN truth = c AND predicted = c THEN n END), 0)::double / nullif(coalesce(sum(CASE WHEN truth = c THEN n END), 0) + coalesce(sum(CASE WHEN predicted = c THEN n END), 0), 0), 0.0) AS f1,
      coalesce(sum(CASE WHEN truth = c AND predicted = c THEN n END), 0)::double / nullif(sum(CASE WHEN truth = c THEN n END), 0) AS recall_or_null
    FROM {src}range({classes}) k(c) LEFT JOIN {conf} x ON {on}(x.truth = c OR x.predicted = c) GROUP BY ALL)"""


def draws(table: str, group: str, n: int, seed: int) -> str:
    return f"""gr AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS o, count(*) OVER () AS size FROM (SELECT DISTINCT {group} AS g FROM {table})),
dr AS (SELECT draw, g AS {group}, count(*) AS multiplicity FROM (
    SELECT d::int AS draw, floor({u(seed, "d", "j")} * size)::bigint AS o FROM range({n}) a(d), (SELECT max(size) AS size FROM gr), range((SELECT max(size) FROM gr)) b(j)) x
  JOIN gr USING (o) GROUP BY ALL)"""


def draw_ap(table: str, group: str, score: str) -> str:
    return f"""(SELECT draw, sum(tp * ct / cn) / nullif(sum(tp), 0) AS ap FROM (
    SELECT *, sum(tp) OVER (PARTITION BY draw ORDER BY s DESC) AS ct, sum(n) OVER (PARTITION BY draw ORDER BY s DESC) AS cn FROM (
      SELECT draw, {score} AS s, sum(multiplicity) AS n, sum(multiplicity * event::int) AS tp FROM {table} JOIN dr USING ({group}) GROUP BY ALL)) GROUP BY draw)"""


def differences(source: str) -> str:
    return f"""SELECT count(d) AS valid_draws, round(avg(d), 6) AS mean_difference, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high,
  round(avg((d > 0)::int) + 0.5 * avg((d = 0)::int), 6) AS probability_better, round((1 + sum((d <= 0)::int)) / (1 + count(d)), 6) AS p_one_sided,
  round(least(1.0, 2 * least(avg((d <= 0)::int), avg((d >= 0)::int))), 6) AS p_two_sided FROM {source}"""


def draw_f1(predicted: str, name: str) -> str:
    return f"""{name}_c AS (SELECT draw, observed_label AS truth, {predicted} AS predicted, sum(multiplicity)::bigint AS n FROM pred JOIN dr USING (group_id) GROUP BY ALL),
{name} AS (SELECT draw, avg(f1) AS macro_f1, avg(recall_or_null) AS balanced_accuracy FROM {prf(name + "_c", 10, "draw")} GROUP BY draw)"""


def ranked(order: str, rate: str, table: str = "samples") -> str:
    return f"""chosen AS (SELECT *, row_number() OVER (ORDER BY {order}, sample_id) <= least(count(*) OVER (), floor(count(*) OVER () * {rate}::double + 0.5)) AS is_corrupted FROM {table})"""


def shifted(seed: int) -> str:
    """A uniform other class."""
    d = f"floor({u(seed, chr(39) + 'class' + chr(39), 'sample_id')} * 9)"
    return f"({d} + ({d} >= observed_label)::int)::int"


SYM = SAMPLES + ",\n" + ranked(u(21, "'row'", "sample_id"), "0.1") + f""",
noisy AS (SELECT sample_id, group_id, fold_id, tissue, features, observed_label AS pre_corruption_label, CASE WHEN is_corrupted THEN {shifted(21)} ELSE observed_label END AS observed_label, is_corrupted FROM chosen)"""

PIXELS = """px AS (
  SELECT patch % 3 AS fold, patch::int AS patch_id, y::int AS y, x::int AS x, c::int AS channel,
    (CASE WHEN c = 0 AND one THEN 1 + patch % 3 WHEN c = 1 AND two THEN 2 WHEN c = 2 AND NOT one AND NOT two AND NOT (y = 0 AND x < patch % 2) THEN 1 ELSE 0 END)::int AS value
  FROM (SELECT *, y BETWEEN 2 AND 6 AND x BETWEEN 1 AND 5 AS one, y BETWEEN 6 - patch % 2 AND 9 AND x BETWEEN 4 AND 8 AND (patch % 2 = 1 OR y > 6) AS two
        FROM range(12) a(patch), range(13) b(y), range(11) d(x), range(3) e(c)))"""
QC = PIXELS + """,
pt AS (SELECT fold, patch_id, y, x, sum((channel < 2 AND value > 0)::int) AS c, max((channel = 2 AND value > 0)::int) AS b FROM px GROUP BY ALL),
pq AS (SELECT fold::int AS fold, patch_id, count(*) AS n_pixels, sum((c = 0 AND b = 1)::int)::bigint AS background_pixels, sum((c = 1)::int)::bigint AS class_pixels,
  sum((c > 1)::int)::bigint AS overlap_pixels, sum((c = 0 AND b = 0)::int)::bigint AS void_pixels, sum((c > 0 AND b = 1)::int)::bigint AS conflict_pixels FROM pt GROUP BY ALL)"""

VOTES = f"""rv AS (
  SELECT sample_id, observed_label, r::int AS reviewer_id, {u("vote", "sample_id", "r")} AS q FROM samples, range(3) t(r)),
vt AS (SELECT sample_id, CASE WHEN q < 0.1 THEN NULL WHEN q < 0.7 THEN observed_label WHEN q < 0.9 THEN (observed_label + 1) % 10 ELSE (observed_label + 2) % 10 END::int AS vote FROM rv),
vc AS (SELECT *, sum(n) OVER (PARTITION BY sample_id)::bigint AS n_votes FROM (SELECT sample_id, vote, count(*) AS n FROM vt WHERE vote IS NOT NULL GROUP BY ALL))"""

ENSEMBLE = (
    SAMPLES.replace(
        "list_transform(embedding, lambda x: x::double) AS features",
        "list_transform(embedding, lambda x: x::double) AS features, "
        + ", ".join(f"list_transform(embedding, lambda x, i: x::double + CASE WHEN (i - 1) % 3 = {m} THEN 0.05::double ELSE 0.0::double END) AS f{m}" for m in (1, 2)),
    )
    + ",\n"
    + ",\n".join(_probs(f"e{m}", t, f) for m, t, f in ((0, "0.1::double", "features"), (1, "0.25::double", "f1"), (2, "0.5::double", "f2")))
    + """,
en AS (SELECT a.sample_id, a.observed_label, a.p AS p0, b.p AS p1, c.p AS p2 FROM e0 a JOIN e1 b USING (sample_id) JOIN e2 c USING (sample_id)),
em AS (SELECT *, list_transform(p0, lambda x, i: (x + p1[i] + p2[i]) / 3) AS mp, list_position(p0, list_max(p0)) AS v0, list_position(p1, list_max(p1)) AS v1,
  list_position(p2, list_max(p2)) AS v2, [p0[observed_label + 1], p1[observed_label + 1], p2[observed_label + 1]] AS o FROM en)"""
)


def js(p: str, q: str) -> str:
    side = lambda a, b: f"list_sum(list_transform({a}, lambda x, i: CASE WHEN x > 0 THEN x * ln(x / ((x + {b}[i]) / 2)) ELSE 0.0 END))"
    return f"least(ln(2.0), greatest(0.0, ({side(p, q)} + {side(q, p)}) / 2))"


KNN = SAMPLES + """,
lg AS (SELECT fold_id, unnest(features) AS x, generate_subscripts(features, 1) AS pos FROM samples),
st AS (SELECT f AS fold_id, list(m ORDER BY pos) AS m, list(CASE WHEN s < 1e-12 THEN 1.0 ELSE s END ORDER BY pos) AS s FROM (
  SELECT f, pos, avg(x) AS m, stddev_pop(x) AS s FROM lg, (SELECT DISTINCT fold_id AS f FROM samples) WHERE fold_id <> f GROUP BY ALL) GROUP BY f),
qz AS (SELECT q.sample_id, q.group_id, q.fold_id, q.observed_label, list_transform(q.features, lambda x, i: (x - st.m[i]) / st.s[i]) AS z FROM samples q JOIN st USING (fold_id)),
rz AS (SELECT r.sample_id, r.group_id, r.observed_label, r.fold_id AS own_fold, st.fold_id, list_transform(r.features, lambda x, i: (x - st.m[i]) / st.s[i]) AS z FROM samples r JOIN st ON r.fold_id <> st.fold_id),
"""


def knn(distance: str, k: int) -> str:
    return KNN + f"""nn AS (
  SELECT sample_id, neighbour_id, neighbour_label, d, row_number() OVER (PARTITION BY sample_id ORDER BY d, neighbour_id) AS rank FROM (
    SELECT q.sample_id, r.sample_id AS neighbour_id, r.observed_label AS neighbour_label, {distance} AS d
    FROM qz q JOIN rz r ON q.fold_id = r.fold_id AND q.group_id <> r.group_id) QUALIFY rank <= {k})"""


HASHES = SAMPLES + f""",
hs AS (SELECT sample_id, fold_id, xor(xor(('0x' || substr(sha256('h|' || (substr(sample_id, 2, 8)::int % 99)::varchar), 1, 15))::bigint, (1::bigint << floor({u("b1", "sample_id")} * 60)::int)),
  CASE WHEN fold_id < 2 THEN (1::bigint << floor({u("b2", "sample_id")} * 60)::int) ELSE 0::bigint END) AS h FROM samples),
hd AS (SELECT a.sample_id AS a_id, b.sample_id AS b_id, bit_count(xor(a.h, b.h))::int AS hamming FROM hs a JOIN hs b ON a.sample_id < b.sample_id AND a.fold_id <> b.fold_id)"""
COSINE = """cs AS (SELECT a.sample_id AS a_id, b.sample_id AS b_id, list_cosine_similarity(a.features, b.features) AS cosine FROM samples a JOIN samples b ON a.sample_id < b.sample_id AND a.fold_id <> b.fold_id)"""

W = {"self_confidence": 0.5, "prediction_margin": 0.3, "predictive_entropy": 0.2}


def hybrid(weights: dict[str, float]) -> str:
    total = sum(weights.values())
    return " + ".join(f"{c}_pc * ({w}::double / {total}::double)" for c, w in weights.items())


PCS = RISKS + ",\npcs AS (SELECT r.sample_id, " + ", ".join(f"{c}_t.pc AS {c}_pc" for c in W) + " FROM risks r " + " ".join(
    f"JOIN {pct(c, 'risks', 'sample_id')} {c}_t USING (sample_id)" for c in W
) + ")"

GAINS = RISKS + f",\ngn AS (SELECT *, round({u('gain', 'sample_id')} - 0.4, 9) AS lower FROM risks)"
TOPS = RISKS + ",\ntop AS (SELECT * FROM risks ORDER BY self_confidence DESC, sample_id LIMIT 40)"

SQL: dict[str, str] = {
    "flagship_risk_ranking": f"""WITH {RISKS}
SELECT * FROM (SELECT sample_id, group_id, observed_label, round(self_confidence, 6) AS risk, row_number() OVER (ORDER BY self_confidence DESC, sample_id) AS rank,
  row_number() OVER (PARTITION BY observed_label ORDER BY self_confidence DESC, sample_id) AS class_rank FROM risks) WHERE class_rank <= 20""",
    **{
        f"score_{short}": f"WITH {RISKS} SELECT sample_id, round({name}, 6) AS {name} FROM risks"
        for short, name in (("self_confidence", "self_confidence"), ("nll", "negative_log_likelihood"), ("margin", "prediction_margin"), ("entropy", "predictive_entropy"))
    },
    "predicted_class": f"WITH {RISKS} SELECT sample_id, predicted FROM risks",
    "probability_validation": "SELECT label IS NOT NULL AND ((vec_id % 25) % 5) <> 0 AS is_valid, count(*) AS n FROM embeddings GROUP BY ALL",
    "percentile_normalise": f"WITH {TIES}, x AS (SELECT grp, sum(event::int)::bigint AS x FROM ti GROUP BY 1) SELECT x.grp, x.x, round(t.pc, 6) AS percentile FROM x JOIN {pct('x', 'x', 'grp')} t USING (grp)",
    "hybrid_score": f"WITH {PCS} SELECT sample_id, round({hybrid(W)}, 6) AS hybrid FROM pcs",
    "hybrid_drop_one": f"WITH {PCS} SELECT sample_id, " + ", ".join(f"round({hybrid({k: v for k, v in W.items() if k != c})}, 6) AS without_{c}" for c in W) + " FROM pcs",
    "top_per_group": f"WITH {RISKS} SELECT tissue, sample_id, round(self_confidence, 6) AS self_confidence, row_number() OVER (PARTITION BY tissue ORDER BY risks.self_confidence DESC, sample_id) AS rank FROM risks QUALIFY rank <= 5",
    "top_overall": f"WITH {RISKS} SELECT sample_id, round(self_confidence, 6) AS self_confidence FROM (SELECT * FROM risks ORDER BY self_confidence DESC, sample_id LIMIT 25)",
    "order_preserving_lookup": f"WITH {SAMPLES} SELECT sample_id, group_id, observed_label, row_number() OVER (ORDER BY {u('order', 'sample_id')}, sample_id) AS ordinal FROM samples WHERE {u('wanted', 'sample_id')} < 0.2",
    "seeded_permutation": f"WITH {SAMPLES} SELECT sample_id, row_number() OVER (ORDER BY {u(17, 'sample_id')}, sample_id) AS permutation_rank FROM samples",
    "score_distribution": f"WITH {RISKS} SELECT tissue, count(*) AS n, round(min(self_confidence), 6) AS least, round(max(self_confidence), 6) AS greatest, round(avg(self_confidence), 6) AS mean, round(stddev_pop(self_confidence), 6) AS std, "
    + ", ".join(f"round(quantile_cont(self_confidence, {q}), 6) AS p{int(100 * q):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95))
    + " FROM risks GROUP BY tissue",
    "average_precision_ties": f"WITH {TIES} SELECT n_rows, n_events, round(average_precision, 6) AS average_precision FROM {ap('ti')}",
    "average_precision_by_group": f"WITH {TIES} SELECT grp, n_rows, n_events, round(average_precision, 6) AS average_precision FROM {ap('ti', 'grp')}",
    "auroc_ties": f"WITH {TIES} {auc('ti')}",
    "auroc_by_group": f"WITH {EVENTS} {auc('ev', 'grp')}",
    "pr_curve": f"""WITH {TIES}, c AS (SELECT score, count(*) AS n, sum(event::int) AS tp FROM ti GROUP BY 1), r AS (SELECT score, sum(n) OVER (ORDER BY score DESC)::bigint AS cum_n, sum(tp) OVER (ORDER BY score DESC)::bigint AS cum_tp FROM c)
SELECT round(score, 6) AS threshold, cum_n, cum_tp, round(cum_tp / cum_n, 6) AS "precision", round(cum_tp / (SELECT sum(event::int) FROM ti), 6) AS recall FROM r""",
    "review_budget": f"""WITH {EVENTS}, r AS (SELECT event, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n, sum(event::int) OVER () AS p FROM ev),
b AS (SELECT unnest([0.01, 0.05, 0.07, 0.2]::double[]) AS budget), x AS (SELECT budget, least(n, ceil(n * budget))::bigint AS reviewed, n, p, event, k FROM r, b)
SELECT budget, reviewed, sum((event AND k <= reviewed)::int)::bigint AS found, round(sum((event AND k <= reviewed)::int) / reviewed, 6) AS "precision", round(sum((event AND k <= reviewed)::int) / max(p), 6) AS recall,
  round(reviewed / max(n), 6) AS expected_random_recall, round((sum((event AND k <= reviewed)::int) / max(p)) / (reviewed / max(n)), 6) AS lift FROM x GROUP BY budget, reviewed""",
    "random_review_baseline": f"""WITH {EVENTS}, r AS (SELECT run, event, row_number() OVER (PARTITION BY run ORDER BY {u(5, 'run', 'doc_id')}, doc_id) AS k, count(*) OVER (PARTITION BY run) AS n, sum(event::int) OVER (PARTITION BY run) AS p FROM ev, range(50) t(run)),
q AS (SELECT run, avg(event::int) AS pr, sum(event::int) / max(p) AS re FROM r WHERE k <= ceil(n * 0.1::double) GROUP BY run)
SELECT round(avg(pr), 6) AS mean_precision, round(quantile_cont(pr, 0.025), 6) AS precision_low, round(quantile_cont(pr, 0.975), 6) AS precision_high, round(avg(re), 6) AS mean_recall, round(quantile_cont(re, 0.025), 6) AS recall_low, round(quantile_cont(re, 0.975), 6) AS recall_high FROM q""",
    "subgroup_ap": f"""WITH {EVENTS} SELECT subgroup, n_rows, n_events, CASE WHEN n_rows >= 100 AND n_events >= 10 THEN 'reported' ELSE 'insufficient_support' END AS status,
  CASE WHEN n_rows >= 100 AND n_events >= 10 THEN round(average_precision, 6) END AS average_precision FROM {ap('ev', 'subgroup')}""",
    "subgroup_four_dims": f"""WITH {EVENTS}, lo AS (SELECT event, score, 'subgroup:' || subgroup AS dv FROM ev UNION ALL SELECT event, score, 'grp:' || grp FROM ev UNION ALL SELECT event, score, 'band:' || floor(score / 2000)::bigint FROM ev UNION ALL SELECT event, score, 'quality_class:' || quality FROM ev)
SELECT split_part(dv, ':', 1) AS dimension, split_part(dv, ':', 2) AS value, n_rows, n_events, CASE WHEN n_events = 0 THEN 'not_applicable_zero_corruption' WHEN n_rows >= 100 AND n_events >= 10 THEN 'reported' ELSE 'suppressed_insufficient_support' END AS status,
  CASE WHEN n_rows >= 100 AND n_events >= 10 THEN round(average_precision, 6) END AS average_precision FROM {ap('lo', 'dv')}""",
    "holm_adjust": f"""WITH {EVENTS}, p AS (SELECT DISTINCT grp, substr(grp, 4, 1) AS family, round(0.05 * {u('p', 'grp')}, 9) AS p FROM ev),
s AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, grp) + 1) * p AS step FROM p)
SELECT grp, family, round(p, 6) AS p, round(least(1.0, max(step) OVER (PARTITION BY family ORDER BY s.p, grp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS adjusted FROM s""",
    "confusion_matrix": f"WITH {CONF} SELECT truth, predicted, n FROM conf",
    "per_class_prf": f"""WITH {CONF} SELECT class, support, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, round(recall_or_null, 6) AS recall_or_null FROM {prf('conf', 10)}""",
    "macro_f1": f"WITH {CONF} SELECT round(avg(f1), 6) AS macro_f1 FROM {prf('conf', 11)}",
    "balanced_accuracy": f"WITH {CONF} SELECT round(avg(recall_or_null), 6) AS balanced_accuracy FROM {prf('conf', 11)}",
    "brier": f"""WITH {RISKS} SELECT round(avg((predicted = observed_label)::int), 6) AS accuracy, round(avg(list_sum(list_transform(p, lambda x, i: (x - (i = observed_label + 1)::int) ** 2))), 6) AS brier,
  round(avg(-ln(least(1.0, greatest(1e-15, p[observed_label + 1])))), 6) AS nll FROM risks""",
    "calibration_bins": f"""WITH {RISKS} SELECT len(list_filter([0.1::double, 0.2::double, 3 * 0.1::double, 0.4::double, 0.5::double, 6 * 0.1::double, 7 * 0.1::double, 0.8::double, 0.9::double], lambda e: e <= list_max(p)))::int AS bin, count(*) AS n, round(avg((predicted = observed_label)::int), 6) AS accuracy, round(avg(list_max(p)), 6) AS confidence FROM risks GROUP BY 1""",
    "ece": f"""WITH {RISKS}, b AS (SELECT len(list_filter([0.1::double, 0.2::double, 3 * 0.1::double, 0.4::double, 0.5::double, 6 * 0.1::double, 7 * 0.1::double, 0.8::double, 0.9::double], lambda e: e <= list_max(p))) AS bin, count(*) AS n, avg((predicted = observed_label)::int) AS a, avg(list_max(p)) AS c FROM risks GROUP BY 1)
SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b""",
    "noise_matrix_derivation": f"WITH {CONF}, w AS (SELECT truth, predicted, CASE WHEN truth = predicted THEN 0.0 ELSE n + 1.0 END AS w FROM conf) SELECT truth, predicted, round(w / sum(w) OVER (PARTITION BY truth), 6) AS probability FROM w",
    "stratum_weights": f"WITH {RISKS}, r AS (SELECT tissue, fold_id, count(*) AS n, sum((observed_label <> predicted)::int)::bigint AS errors FROM risks GROUP BY ALL), q AS (SELECT *, (errors + 1) / (n + 2) AS rate FROM r) SELECT tissue, fold_id, n, errors, round(rate, 6) AS rate, round(q.rate / max(q.rate) OVER (), 6) AS weight FROM q",
    "label_issues": f"""WITH {RISKS}, lim AS (SELECT list(t ORDER BY c) AS t FROM (SELECT observed_label AS c, avg(p[observed_label + 1]) AS t FROM risks GROUP BY 1)),
o AS (SELECT observed_label, list_transform(p, lambda x, i: CASE WHEN x >= t[i] THEN x END) AS o FROM risks, lim), b AS (SELECT observed_label, CASE WHEN list_max(o) IS NOT NULL THEN list_position(o, list_max(o)) - 1 END AS best FROM o)
SELECT observed_label, sum(coalesce(best <> observed_label, false)::int)::bigint AS n_issues, count(best) AS n_confident FROM b GROUP BY 1""",
    "transition_counts": f"WITH {RISKS} SELECT observed_label || '->' || predicted AS transition, count(*) AS n FROM risks WHERE predicted <> observed_label GROUP BY 1",
    "group_split_hash": f"WITH {SAMPLES}, g AS (SELECT group_id, min(tissue) AS stratum FROM samples GROUP BY 1) SELECT group_id, stratum, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY sha256('split-2027|' || group_id), group_id) <= 3 THEN 'final' ELSE 'development' END AS part FROM g",
    "outer_split": f"""WITH {SAMPLES}, g AS (SELECT DISTINCT group_id FROM samples WHERE fold_id <> 4), r AS (SELECT group_id, row_number() OVER (ORDER BY {u(11, "'outer'", 'group_id')}, group_id) AS r, count(*) OVER () AS n FROM g)
SELECT CASE WHEN s.fold_id = 4 THEN 'final' WHEN r <= least(r.n - 1, ceil(r.n * 0.25::double)) THEN 'validation' ELSE 'development' END AS partition, s.group_id, count(*) AS n FROM samples s LEFT JOIN r USING (group_id) GROUP BY ALL""",
    "fractional_split": f"""WITH {SAMPLES}, r AS (SELECT group_id, row_number() OVER (ORDER BY {u(12, "'fractional'", 'group_id')}, group_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM samples)),
f AS (SELECT *, greatest(1, least(n - 2, ceil(n * 0.2::double))) AS fin FROM r), v AS (SELECT *, greatest(1, least(n - fin - 1, ceil((n - fin) * 0.15::double))) AS val FROM f)
SELECT CASE WHEN r <= fin THEN 'final' WHEN r <= fin + val THEN 'validation' ELSE 'development' END AS partition, s.group_id, count(*) AS n FROM samples s JOIN v USING (group_id) GROUP BY ALL""",
    "fold_coverage_check": f"WITH {SAMPLES}, a AS (SELECT sample_id FROM samples UNION ALL SELECT sample_id FROM samples WHERE fold_id = 0 AND observed_label = 1) SELECT sample_id, count(*) AS n FROM a GROUP BY 1 HAVING count(*) <> 1",
    "leakage_check": f"WITH {SAMPLES} SELECT group_id, count(DISTINCT CASE WHEN {u('leak', 'group_id', 'tissue')} < 0.3 THEN 'a' ELSE 'b' END) AS n_partitions FROM samples GROUP BY 1 HAVING n_partitions > 1",
    "corrupt_symmetric": f"WITH {SYM} SELECT sample_id, pre_corruption_label, observed_label, is_corrupted FROM noisy",
    "corrupt_targeted": f"""WITH {SAMPLES}, {ranked(u(22, "'row'", 'sample_id'), '0.15')},
mx AS (SELECT i::int AS i, list(CASE WHEN i = j THEN 0.0::double WHEN j = (i + 1) % 10 THEN 4.0::double / 12.0::double ELSE 1.0::double / 12.0::double END ORDER BY j) AS w FROM range(10) a(i), range(10) b(j) GROUP BY 1),
cu AS (SELECT i, list_transform(w, lambda x, k: list_sum(w[1:k])) AS c FROM mx)
SELECT sample_id, observed_label AS pre_corruption_label, CASE WHEN is_corrupted THEN least(9, len(list_filter(c, lambda x: x <= {u(22, "'class'", 'sample_id')})))::int ELSE observed_label END AS observed_label, is_corrupted FROM chosen JOIN cu ON i = observed_label""",
    "corrupt_group_weighted": f"""WITH {SAMPLES}, gw AS (SELECT group_id, [2.0, 1.0, 0.5][((row_number() OVER (ORDER BY group_id) - 1) % 3 + 1)::int]::double AS w FROM (SELECT DISTINCT group_id FROM samples)),
sw AS (SELECT s.*, w FROM samples s JOIN gw USING (group_id)), {ranked(f'-ln(greatest({u(23, chr(39) + "row" + chr(39), "sample_id")}, 2.0 ** -53)) / w', '0.1', 'sw')}
SELECT sample_id, observed_label AS pre_corruption_label, CASE WHEN is_corrupted THEN {shifted(23)} ELSE observed_label END AS observed_label, is_corrupted FROM chosen""",
    "corrupt_instance": f"""WITH {SAMPLES}, lg AS (SELECT sample_id, observed_label, unnest(features) AS x, generate_subscripts(features, 1) AS pos FROM samples),
z AS (SELECT sample_id, observed_label, pos, (x - m) / CASE WHEN s < 1e-12 THEN 1.0 ELSE s END AS z FROM lg JOIN (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM lg GROUP BY pos) USING (pos)),
c AS (SELECT observed_label AS c, pos, avg(z) AS m FROM z GROUP BY ALL), d AS (SELECT sample_id, observed_label, c, round(sqrt(sum((z - m) ** 2)), 9) AS d FROM z JOIN c USING (pos) GROUP BY ALL),
o AS (SELECT sample_id, observed_label, round(min(d) FILTER (c <> observed_label) - max(d) FILTER (c = observed_label), 9) AS ambiguity_margin, arg_min(c, d) FILTER (c <> observed_label) AS other FROM d GROUP BY ALL),
{ranked('ambiguity_margin', '0.1', 'o')}
SELECT sample_id, observed_label AS pre_corruption_label, CASE WHEN is_corrupted THEN other ELSE observed_label END AS observed_label, is_corrupted, round(ambiguity_margin, 6) AS ambiguity_margin FROM chosen""",
    "corruption_manifest": f"WITH {SYM} SELECT pre_corruption_label, observed_label, count(*) AS n, sum(is_corrupted::int)::bigint AS n_corrupted, sum((is_corrupted <> (pre_corruption_label <> observed_label))::int)::bigint AS n_inconsistent FROM noisy GROUP BY ALL",
    "restore_labels": f"WITH {SYM} SELECT sample_id, CASE WHEN is_corrupted AND {u('reviewed', 'sample_id')} < 0.5 THEN pre_corruption_label ELSE observed_label END AS restored_label FROM noisy",
    "intervention_weights": f"""WITH {SYM}, v AS (SELECT *, {u('reviewed', 'sample_id')} < 0.2 AS sel FROM noisy), r AS (SELECT *, CASE WHEN sel AND is_corrupted THEN pre_corruption_label ELSE observed_label END AS res FROM v),
x AS ("""
    + " UNION ALL ".join(
        f"SELECT '{p}' AS policy, {lab} <> pre_corruption_label AS wrong, {w} AS training_weight FROM r"
        for p, lab, w in (
            ("controlled_restore", "res", "1.0::double"),
            ("restore_weight_0_5", "res", "CASE WHEN sel THEN 0.5::double ELSE 1.0::double END"),
            ("restore_weight_2", "res", "CASE WHEN sel THEN 2.0::double ELSE 1.0::double END"),
            ("flag_downweight_0_5", "observed_label", "CASE WHEN sel THEN 0.5::double ELSE 1.0::double END"),
            ("flag_exclude", "observed_label", "CASE WHEN sel THEN 0.0::double ELSE 1.0::double END"),
        )
    )
    + ") SELECT policy, training_weight, count(*) AS n, sum(wrong::int)::bigint AS n_wrong FROM x GROUP BY ALL",
    "cell_matrix_expand": """WITH s AS (SELECT unnest(['symmetric', 'targeted', 'group', 'instance']) AS mechanism), r AS (SELECT unnest([0.05, 0.1, 0.2]::double[]) AS rate), k AS (SELECT unnest([1, 2, 3]) AS seed),
a AS (SELECT * FROM s, r, k UNION ALL SELECT 'clean', 0.0::double, 0), c AS (SELECT * FROM a, (SELECT unnest(['engineered', 'embedding']) AS representation), (SELECT unnest(['logistic', 'mlp']) AS classifier))
SELECT *, substr(sha256(mechanism || '|' || printf('%.4f', rate) || '|' || seed || '|' || representation || '|' || classifier), 1, 16) AS cell_id FROM c""",
    "vote_resolution": f"""WITH {SAMPLES}, {VOTES}, best AS (SELECT sample_id, max(n_votes) AS n_votes, max(n) AS top, min(vote) FILTER (n = m) AS vote FROM (SELECT *, max(n) OVER (PARTITION BY sample_id) AS m FROM vc) GROUP BY 1),
j AS (SELECT s.sample_id, observed_label, b.*, {u('reviewed', 's.sample_id')} < 0.9 AS re, {u('ambiguous', 's.sample_id')} < 0.1 AS am, {u('insufficient', 's.sample_id')} < 0.05 AS ins, {u('technical', 's.sample_id')} < 0.03 AS te FROM samples s LEFT JOIN (SELECT sample_id AS sid, n_votes, top, vote FROM best) b ON sid = s.sample_id),
a AS (SELECT *, CASE WHEN NOT re THEN 'keep' WHEN te OR ins THEN 'exclude' WHEN n_votes IS NULL THEN 'downweight' WHEN am OR top <> n_votes THEN 'soft_label' WHEN vote <> observed_label THEN 'hard_change' ELSE 'keep' END AS action FROM j)
SELECT sample_id, observed_label, action, CASE WHEN action = 'hard_change' THEN vote ELSE observed_label END::int AS hard_label, CASE action WHEN 'exclude' THEN 0.0::double WHEN 'soft_label' THEN 0.5::double WHEN 'downweight' THEN 0.5::double ELSE 1.0::double END AS weight, coalesce(n_votes, 0)::bigint AS n_votes FROM a""",
    "vote_distribution": f"WITH {SAMPLES}, {VOTES} SELECT sample_id, vote, n, n_votes, round(n / n_votes, 6) AS share FROM vc",
    "ensemble_disagreement": f"""WITH {ENSEMBLE} SELECT sample_id, observed_label, 3::int AS n_models, (list_position(mp, list_max(mp)) - 1)::int AS mean_class, round(-list_sum(list_transform(mp, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0.0 END)), 6) AS mean_entropy,
  round(1.0 - (CASE WHEN v0 = v1 AND v1 = v2 THEN 3 WHEN v0 = v1 OR v1 = v2 OR v0 = v2 THEN 2 ELSE 1 END) / 3, 6) AS variation_ratio, round(((v0 <> v1)::int + (v0 <> v2)::int + (v1 <> v2)::int) / 3, 6) AS pairwise_disagreement,
  round(list_var_pop(o), 6) AS own_probability_variance FROM em""",
    "js_divergence": f"WITH {ENSEMBLE} SELECT sample_id, round(({js('p0', 'p1')} + {js('p0', 'p2')} + {js('p1', 'p2')}) / 3, 6) AS mean_js_divergence FROM em",
    "persistent_risk": f"""WITH {SAMPLES}, h AS (SELECT sample_id, m, c, round(0.4 + 0.6 * {u('risk', 'sample_id')} * 0.7 + 0.18 * {u('step', 'sample_id', 'm', 'c')}, 9) AS risk FROM samples, range(3) a(m), range(3) b(c)),
pm AS (SELECT sample_id, m, avg((risk >= 0.7::double)::int) AS per FROM h GROUP BY ALL), s AS (SELECT sample_id, avg(per) AS cp, avg((per >= 2 / 3 - 1e-12)::int) AS sf FROM pm GROUP BY 1),
a AS (SELECT sample_id, round(avg(risk), 12) AS mr, stddev_pop(risk) AS sr FROM h GROUP BY 1), f AS (SELECT * FROM s JOIN a USING (sample_id))
SELECT f.sample_id, round(cp, 6) AS checkpoint_persistence, round(sf, 6) AS stable_fraction, round(mr, 6) AS mean_risk, round(sr, 6) AS std_risk, sf >= 2 / 3 - 1e-12 AS persistent, CASE WHEN sf >= 2 / 3 - 1e-12 THEN round(t.pc, 6) ELSE 0.0 END AS priority FROM f JOIN {pct('mr', 'f', 'sample_id')} t USING (sample_id)""",
    "blinded_package": f"""WITH {RISKS}, top AS (SELECT * FROM risks ORDER BY self_confidence DESC, sample_id LIMIT 20), rnd AS (SELECT * FROM risks WHERE sample_id NOT IN (SELECT sample_id FROM top) ORDER BY {u(9, "'cohort'", 'sample_id')}, sample_id LIMIT 10),
b AS (SELECT *, 'top' AS selection_source FROM top UNION ALL SELECT *, 'random' FROM rnd)
SELECT 'review-' || lpad(row_number() OVER (ORDER BY {u(9, "'order'", 'sample_id')}, sample_id)::varchar, 4, '0') AS review_id, 'img/' || sample_id || '.png' AS asset, sample_id, observed_label, round(self_confidence, 6) AS risk, selection_source FROM b""",
    "knn_evidence": f"WITH {knn('list_distance(q.z, r.z)', 5)} SELECT sample_id, neighbour_id, neighbour_label, round(d, 6) AS distance, rank::int AS rank FROM nn",
    "knn_cosine": f"WITH {knn('1 - list_cosine_similarity(q.z, r.z)', 3)} SELECT sample_id, neighbour_id, neighbour_label, round(d, 6) AS distance, rank::int AS rank FROM nn",
    "knn_disagreement": f"""WITH {knn('list_distance(q.z, r.z)', 5)}, w AS (SELECT sample_id, neighbour_label, sum(1.0 / greatest(d, 1e-8)) AS w FROM nn GROUP BY ALL), s AS (SELECT *, w / sum(w) OVER (PARTITION BY sample_id) AS support FROM w),
j AS (SELECT a.sample_id, a.observed_label, s.neighbour_label, s.support, row_number() OVER (PARTITION BY a.sample_id ORDER BY round(s.support, 12) DESC, s.neighbour_label) AS r FROM samples a JOIN s USING (sample_id))
SELECT sample_id, observed_label, round(1.0 - coalesce(sum(support) FILTER (neighbour_label = observed_label), 0.0), 6) AS neighbour_risk, round(coalesce(max(support) FILTER (neighbour_label <> observed_label), 0.0), 6) AS alternative_support, max(neighbour_label) FILTER (r = 1) AS suggested_class FROM j GROUP BY ALL""",
    "queue_group_quota": f"WITH {RISKS}, c AS (SELECT * FROM risks QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY self_confidence DESC, sample_id) <= 3) SELECT sample_id, group_id, round(self_confidence, 6) AS self_confidence FROM (SELECT * FROM c ORDER BY self_confidence DESC, sample_id LIMIT 50)",
    "queue_quality": f"WITH {RISKS} SELECT sample_id, round(t.pc, 6) AS priority FROM risks JOIN {pct('self_confidence', 'risks', 'sample_id')} t USING (sample_id) WHERE self_confidence >= 0.5",
    "queue_model_improvement": f"WITH {GAINS} SELECT sample_id, round(0.5 * a.pc + 0.5 * b.pc, 6) AS priority FROM gn JOIN {pct('self_confidence', 'gn', 'sample_id')} a USING (sample_id) JOIN {pct('lower', 'gn', 'sample_id')} b USING (sample_id) WHERE gn.lower > 0.1",
    "utility_product_queue": f"WITH {GAINS} SELECT sample_id, round(a.pc * greatest(gn.lower, 0.0), 6) AS priority FROM gn JOIN {pct('self_confidence', 'gn', 'sample_id')} a USING (sample_id)",
    "matched_random": f"""WITH {TOPS}, need AS (SELECT observed_label, tissue, count(*) AS needed FROM top GROUP BY ALL), pool AS (SELECT *, row_number() OVER (PARTITION BY observed_label, tissue ORDER BY {u(31, 'sample_id')}, sample_id) AS r, count(*) OVER (PARTITION BY observed_label, tissue) AS have FROM risks WHERE sample_id NOT IN (SELECT sample_id FROM top)),
ok AS (SELECT bool_and(coalesce(have, 0) >= needed) AS ok FROM need LEFT JOIN (SELECT DISTINCT observed_label, tissue, have FROM pool) USING (observed_label, tissue))
SELECT sample_id, pool.observed_label, pool.tissue FROM pool JOIN need USING (observed_label, tissue), ok WHERE r <= needed AND ok""",
    "comparator_shortfall": f"""WITH {TOPS}, need AS (SELECT observed_label, tissue, count(*) AS needed FROM top GROUP BY ALL), pool AS (SELECT observed_label, tissue, count(*) AS have FROM risks WHERE fold_id = 0 AND sample_id NOT IN (SELECT sample_id FROM top) GROUP BY ALL)
SELECT observed_label, tissue, needed, coalesce(have, 0)::bigint AS available, greatest(0, needed - coalesce(have, 0))::bigint AS shortfall FROM need LEFT JOIN pool USING (observed_label, tissue)""",
    "capacity_selection": f"WITH {RISKS}, c AS (SELECT *, row_number() OVER (PARTITION BY observed_label, tissue ORDER BY self_confidence DESC, sample_id) AS r, count(*) OVER (PARTITION BY observed_label, tissue) AS m FROM risks) SELECT sample_id, round(self_confidence, 6) AS self_confidence FROM (SELECT * FROM c WHERE r <= floor(m / 2) ORDER BY self_confidence DESC, sample_id LIMIT 60)",
    "bootstrap_draws": f"WITH {EVENTS}, {draws('ev', 'grp', 50, 41)} SELECT draw, grp, multiplicity FROM dr",
    "bootstrap_group_ap": f"WITH {EVENTS}, {draws('ev', 'grp', 100, 42)} SELECT draw, round(ap, 6) AS score FROM {draw_ap('ev', 'grp', 'score')}",
    "paired_bootstrap_ci": f"WITH {EVENTS.replace('l.quality FROM', 'l.quality, round(d.n_chars::double * ' + u('other', 'l.doc_id') + ', 3) AS other FROM')}, {draws('ev', 'grp', 200, 43)}, df AS (SELECT a.ap - b.ap AS d FROM {draw_ap('ev', 'grp', 'score')} a JOIN {draw_ap('ev', 'grp', 'other')} b USING (draw)) {differences('df')}",
    "bootstrap_macro_f1": f"WITH {PRED}, {draws('pred', 'group_id', 100, 44)}, {draw_f1('predicted', 'one')} SELECT draw, round(macro_f1, 6) AS macro_f1, round(balanced_accuracy, 6) AS balanced_accuracy FROM one",
    "guard_decision": f"WITH {PRED}, {draws('pred', 'group_id', 100, 45)}, {draw_f1('predicted', 'one')}, {draw_f1('candidate', 'two')}, df AS (SELECT two.macro_f1 - one.macro_f1 AS d FROM one JOIN two USING (draw)) SELECT 25::bigint AS n_groups, valid_draws, mean_difference, low, high, CASE WHEN low > 0 THEN 'apply_candidate' ELSE 'keep_baseline' END AS decision FROM ({differences('df')})",
    "retrieval_summary": f"""WITH {EVENTS}, {draws('ev', 'grp', 100, 46)}, c AS (SELECT draw, sum((event AND score > 5000)::int * multiplicity) / nullif(sum((score > 5000)::int * multiplicity), 0) AS c, """
    + ", ".join(f"sum((event AND {u(f'control{i}', 'doc_id')} < 0.1)::int * multiplicity) / nullif(sum(({u(f'control{i}', 'doc_id')} < 0.1)::int * multiplicity), 0) AS r{i}" for i in range(3))
    + f" FROM ev JOIN dr USING (grp) GROUP BY draw), df AS (SELECT c - (r0 + r1 + r2) / 3 AS d FROM c) {differences('df')}",
    "success_gates": f"""WITH {RISKS}, r AS (SELECT avg((predicted = observed_label)::int) > 0.05 AS a, avg(list_sum(list_transform(p, lambda x, i: (x - (i = observed_label + 1)::int) ** 2))) < 2.0 AS b, avg(-ln(p[observed_label + 1])) < 0.1 AS c FROM risks)
SELECT unnest(['accuracy', 'brier', 'nll']) AS gate, unnest([a, b, c]) AS passed, a AND b AND c AS all_passed FROM r""",
    "exact_duplicates": "SELECT sha256(text) AS content_sha256, min(doc_id) AS least_id, count(*) AS n_rows FROM documents GROUP BY 1",
    "exact_duplicate_pairs": "WITH p AS (SELECT p_partkey AS k, p_type || '|' || p_brand AS c, p_size AS f FROM part) SELECT a.k AS a_id, count(*) AS n FROM p a JOIN p b ON a.c = b.c AND a.k < b.k AND a.f <> b.f GROUP BY 1",
    "hamming_duplicates": f"WITH {HASHES} SELECT a_id, b_id, hamming FROM hd WHERE hamming <= 4",
    "cosine_duplicates": f"WITH {SAMPLES}, {COSINE} SELECT a_id, b_id, round(cosine, 6) AS cosine FROM cs WHERE cosine >= 0.35",
    "duplicate_ranking": f"""WITH {HASHES}, {COSINE}, e AS (SELECT a_id, b_id, 'exact' AS m, NULL::int AS hamming, NULL::double AS cosine FROM hd WHERE hamming = 0 UNION ALL SELECT a_id, b_id, 'perceptual', hamming, NULL FROM hd WHERE hamming <= 4 UNION ALL SELECT a_id, b_id, 'embedding', NULL, round(cosine, 9) FROM cs WHERE cosine >= 0.4),
g AS (SELECT a_id, b_id, min(hamming) AS min_hamming, max(cosine) AS c, bool_or(m = 'exact') AS ex, count(DISTINCT m) AS nm FROM e GROUP BY ALL)
SELECT a_id, b_id, min_hamming, round(c, 6) AS max_cosine, row_number() OVER (ORDER BY ex DESC, nm DESC, coalesce(c, -1) DESC, coalesce(min_hamming, 1000000000), a_id, b_id)::int AS candidate_rank, substr(sha256((a_id || chr(0) || b_id)), 1, 20) AS candidate_id FROM g""",
    "pair_coverage": f"WITH {SAMPLES}, n AS (SELECT fold_id AS f, count(*) AS n FROM samples GROUP BY 1) SELECT a.f AS a_fold, b.f AS b_fold, a.n * b.n AS n_pairs FROM n a JOIN n b ON a.f < b.f",
    "qc_patches": f"WITH {QC} SELECT *, background_pixels + class_pixels + overlap_pixels + void_pixels = n_pixels AS partition_holds FROM pq",
    "qc_rollup": f"""WITH {QC} SELECT fold, count(*) AS n_patches, {', '.join(f'sum({c})::bigint AS {c}' for c in ('n_pixels', 'background_pixels', 'class_pixels', 'overlap_pixels', 'void_pixels', 'conflict_pixels'))}, true AS partition_holds,
  round(sum(overlap_pixels) / sum(n_pixels), 6) AS overlap_rate, round(sum(void_pixels) / sum(n_pixels), 6) AS void_rate FROM pq GROUP BY ROLLUP (fold)""",
    "instance_geometry": f"""WITH {PIXELS}, i AS (SELECT * FROM px WHERE channel < 2 AND value > 0),
n AS (SELECT patch_id, channel, value, y, x, (SELECT count(*) FROM i o WHERE o.patch_id = i.patch_id AND o.channel = i.channel AND o.value = i.value AND abs(o.y - i.y) + abs(o.x - i.x) = 1) AS k FROM i),
g AS (SELECT patch_id, channel, value AS instance_id, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1, avg(y) AS cy, avg(x) AS cx, count(*) AS area, (4 * count(*) - sum(k))::bigint AS perimeter, var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(y, x) AS c FROM n GROUP BY ALL)
SELECT patch_id, channel, instance_id, y0, x0, y1, x1, round(cy, 6) AS centroid_y, round(cx, 6) AS centroid_x, area, perimeter, round(area / ((y1 - y0) * (x1 - x0)), 6) AS extent,
  round(CASE WHEN vy + vx + sqrt(4 * c * c + (vy - vx) ** 2) > 0 THEN sqrt(greatest(0.0, 1 - (vy + vx - sqrt(4 * c * c + (vy - vx) ** 2)) / (vy + vx + sqrt(4 * c * c + (vy - vx) ** 2)))) ELSE 0.0 END, 6) AS eccentricity FROM g""",
    "class_pair_overlap": f"WITH {PIXELS} SELECT a.channel AS first_class, b.channel AS second_class, count(*) AS n_pixels FROM px a JOIN px b USING (patch_id, y, x) WHERE a.channel < b.channel AND b.channel < 2 AND a.value > 0 AND b.value > 0 GROUP BY ALL",
    "reused_instance_ids": f"WITH {PIXELS} SELECT patch_id, value AS instance_id, count(DISTINCT channel) AS n_classes FROM px WHERE channel < 2 AND value > 0 GROUP BY ALL HAVING n_classes > 1",
    "manifest_violations": f"""WITH {SYM}, m AS (SELECT sample_id, CASE WHEN sample_id = 's00000007' THEN NULL ELSE group_id END AS group_id, pre_corruption_label, CASE WHEN sample_id = 's00000003' THEN 12 ELSE observed_label END AS observed_label, is_corrupted FROM noisy), a AS (SELECT * FROM m UNION ALL SELECT * FROM m WHERE sample_id = 's00000005')
SELECT sample_id, 'missing_group' AS rule FROM a WHERE group_id IS NULL UNION ALL SELECT sample_id, 'label_out_of_range' FROM a WHERE observed_label NOT BETWEEN 0 AND 9 UNION ALL SELECT sample_id, 'flag_disagrees' FROM a WHERE is_corrupted <> (pre_corruption_label <> observed_label) UNION ALL SELECT sample_id, 'repeated_sample_id' FROM a GROUP BY 1 HAVING count(*) > 1""",
    "value_scan": "SELECT l_returnflag, count(*) AS n, round(min(l_quantity), 6) AS least, round(max(l_quantity), 6) AS greatest, count(DISTINCT l_quantity) AS n_distinct, bool_and(isfinite(l_quantity)) AS all_finite, bool_and(l_quantity >= 0) AS all_nonnegative, bool_and(l_quantity = floor(l_quantity)) AS all_whole FROM lineitem GROUP BY 1",
    "constant_in_group": "SELECT l_orderkey, count(DISTINCT l_linestatus) + max((l_linestatus IS NULL)::int) AS n_values FROM lineitem GROUP BY 1 HAVING n_values > 1",
    "reconcile_diff": f"""WITH {TIES}, t2 AS (SELECT event, grp, round(score, 1) AS score FROM ti), s AS (SELECT grp, average_precision AS a FROM {ap('ti', 'grp')}), c AS (SELECT grp, average_precision AS b FROM {ap('t2', 'grp')})
SELECT grp, round(a, 6) AS saved_average_precision, round(b, 6) AS computed_average_precision FROM s JOIN c USING (grp) WHERE abs(a - b) > 0.005""",
    "summary_by_fold_class_tissue": f"WITH {SAMPLES} SELECT fold_id, observed_label, tissue, count(*) AS n_samples, count(DISTINCT group_id) AS n_patches FROM samples GROUP BY ALL",
    "exclusion_reasons": "SELECT CASE WHEN quality IS NULL THEN 'missing_truth' WHEN toxic = 1 THEN 'excluded_label' WHEN n_chars < 200 THEN 'too_short' WHEN n_chars > 8000 THEN 'too_long' END AS exclusion_reason, lang, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL",
    "label_normalise": "SELECT nullif(regexp_replace(lower(trim('  Correction_' || o_orderpriority || ' ')), '^correction_', ''), '') AS label, count(*) AS n FROM orders GROUP BY 1",
    "set_diff_inventory": """WITH b AS (SELECT 'f' || o_orderkey AS path, sha256(o_orderstatus) AS h FROM orders), a AS (SELECT 'f' || l_orderkey AS path, sha256(min(l_linestatus)) AS h FROM lineitem GROUP BY l_orderkey)
SELECT path, CASE WHEN a.h IS NULL THEN 'missing' WHEN b.h IS NULL THEN 'added' ELSE 'changed' END AS change FROM b FULL JOIN a USING (path) WHERE a.h IS NULL OR b.h IS NULL OR a.h <> b.h""",
    "having_multi_label": "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_labels, count(*) AS n FROM orders GROUP BY 1 HAVING n_labels > 1",
    "feature_concat": f"WITH {SAMPLES} SELECT sample_id, 12::int AS width, round(list_sum(features[1:8]) + list_sum(list_transform(features[9:12], lambda x: round(x * 2, 9))), 6) AS total FROM samples",
    "standardised_features": f"WITH {SAMPLES}, lg AS (SELECT fold_id, unnest(features) AS x, generate_subscripts(features, 1) - 1 AS pos FROM samples) SELECT fold_id, count(*) AS n, pos::int AS pos, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM lg GROUP BY fold_id, pos",
    "interleave": f"WITH {SAMPLES}, o AS (SELECT *, row_number() OVER (PARTITION BY tissue, fold_id ORDER BY sample_id) AS k FROM samples) SELECT sample_id, tissue, fold_id, (row_number() OVER (ORDER BY k, tissue, fold_id, sample_id) - 1)::int AS position FROM o",
    "balanced_subset": f"WITH {SAMPLES} SELECT sample_id, fold_id FROM samples QUALIFY row_number() OVER (PARTITION BY fold_id ORDER BY sample_id) <= 4 + (fold_id < 3)::int",
    "salted_weights": f"WITH {SAMPLES} SELECT sample_id, CASE WHEN ('0x' || substr(sha256('stress|' || sample_id), 1, 2))::int < 64 THEN 0.5::double ELSE 1.0::double END AS weight, substr(sha256(group_id || chr(0) || sample_id), 1, 24) AS hashed FROM samples",
    "box_statistics": """WITH p AS (SELECT p_partkey, p_partkey % 97 AS x0, p_partkey % 97 + p_partkey % 13 AS x1, greatest(p_partkey % 13, 1)::double AS w, greatest(p_partkey % 7, 1)::double AS h FROM part)
SELECT p_partkey, floor((x0 + x1) / 2)::bigint AS floor_x, round_even((x0 + x1) / 2, 0)::bigint AS even_x, w AS width, h AS height, round(ln(w * h), 6) AS log_area, round(ln(w / h), 6) AS log_aspect FROM p""",
    "temperature_scaled": f"WITH {PROBS}, l AS (SELECT sample_id, list_transform(p, lambda x: ln(least(1.0, greatest(1e-15, x))) / 0.5) AS l FROM probs), e AS (SELECT sample_id, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM l) SELECT sample_id, round(list_max(e) / list_sum(e), 6) AS top FROM e",
}

CROPS = """pxl AS (SELECT *, y BETWEEN 3 AND 4 + sample_id % 5 AND x BETWEEN 2 AND 3 + sample_id % 7 AS target,
  ((sample_id * 31 + y * 17 + x * 11 + y * x) % 256)::int AS red, ((sample_id * 7 + y * 29 + x * 5 + y * x) % 256)::int AS green, ((sample_id * 13 + y * 3 + x * 23 + y * x) % 256)::int AS blue
  FROM (SELECT i::int AS sample_id, a::int AS y, b::int AS x FROM range(8) t(i), range(12) u(a), range(12) v(b)))"""
GREY = CROPS + """,
gp AS (SELECT *, red / 255.0::double * 0.2989::double + green / 255.0::double * 0.5870::double + blue / 255.0::double * 0.1140::double AS g FROM pxl)"""


def crop(place: str) -> str:
    """Crops of 8 around each box's corner; ``place`` maps a coordinate into the image."""
    return f"""WITH {CROPS}, c AS (SELECT i::int AS sample_id, cy::int AS y, cx::int AS x, {place.format(v='(3 - 4 + cy)')} AS py, {place.format(v='(2 - 4 + cx)')} AS px FROM range(8) t(i), range(8) u(cy), range(8) v(cx))
SELECT c.sample_id, c.y, c.x, red, green, blue FROM c JOIN pxl ON pxl.sample_id = c.sample_id AND pxl.y = py AND pxl.x = px"""


RGB = ("red", "green", "blue")
FIGURES = ("contrast", "dissimilarity", "homogeneity", "angular_second_moment", "energy", "correlation", "entropy")

SQL |= {
    "crop_edge": crop("least(11, greatest(0, {v}))"),
    "crop_reflect": crop("CASE WHEN {v} < 0 THEN -({v}) WHEN {v} > 11 THEN 22 - {v} ELSE {v} END"),
    "crop_target_box": f"""WITH {CROPS}, b AS (SELECT sample_id, min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1 FROM pxl WHERE target GROUP BY 1), s AS (SELECT *, greatest(x1 - x0, y1 - y0) + 4 AS side FROM b),
l AS (SELECT *, greatest(0, floor((x0 + x1) / 2 - side / 2)) AS lx, greatest(0, floor((y0 + y1) / 2 - side / 2)) AS ly FROM s)
SELECT sample_id, greatest(0, least(12, lx + side) - side)::int AS crop_x0, greatest(0, least(12, ly + side) - side)::int AS crop_y0, least(12, lx + side)::int AS crop_x1, least(12, ly + side)::int AS crop_y1 FROM l""",
    "highlight": f"WITH {CROPS} SELECT sample_id, y, x, " + ", ".join(f"CASE WHEN target THEN {c} ELSE round_even({c} * 0.45::double, 0)::int END AS {c}" for c in RGB) + " FROM pxl",
    "colour_histogram": f"WITH {CROPS} SELECT sample_id, " + ", ".join(f"round(avg((least(7, floor({c} / 255.0::double * 8)) = {i})::int), 6) AS {c}_{i:02d}" for c in RGB for i in range(8)) + " FROM pxl WHERE target GROUP BY 1",
    "colour_statistics": f"WITH {CROPS} SELECT sample_id, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std, max({c}) - min({c}) AS {c}_range" for c in RGB) + " FROM pxl WHERE target GROUP BY 1",
    "intensity_features": f"""WITH {GREY}, k AS (SELECT *, target AND (SELECT count(*) FROM pxl o WHERE o.sample_id = gp.sample_id AND o.target AND abs(o.y - gp.y) <= 1 AND abs(o.x - gp.x) <= 1) < 9 AS edge FROM gp),
s AS (SELECT sample_id, avg(g) FILTER (target) AS target_mean, stddev_pop(g) FILTER (target) AS target_std, min(g) FILTER (target) AS target_min, max(g) FILTER (target) AS target_max,
  """
    + ", ".join(f"quantile_cont(g, {q}) FILTER (target) AS target_q{int(100 * q):02d}" for q in (0.1, 0.25, 0.5, 0.75, 0.9))
    + """, avg(g) FILTER (NOT target) AS context_mean, stddev_pop(g) FILTER (NOT target) AS context_std, avg(g) FILTER (edge) AS boundary_mean, stddev_pop(g) FILTER (edge) AS boundary_std,
  min(g) FILTER (edge) AS boundary_min, max(g) FILTER (edge) AS boundary_max, coalesce(avg(g) FILTER (target AND NOT edge), avg(g) FILTER (target)) AS inr FROM k GROUP BY 1)
SELECT sample_id, """
    + ", ".join(f"round({c}, 6) AS {c}" for c in ("target_mean", "target_std", "target_min", "target_max", "target_q10", "target_q25", "target_q50", "target_q75", "target_q90", "context_mean", "context_std", "boundary_mean", "boundary_std", "boundary_min", "boundary_max"))
    + ", round(target_mean - context_mean, 6) AS target_minus_context, round(boundary_mean - inr, 6) AS boundary_minus_interior, round(boundary_mean - context_mean, 6) AS boundary_minus_context FROM s",
    "texture_features": f"""WITH {GREY}, q AS (SELECT sample_id, y, x, least(15, floor(g * 16))::int AS v FROM gp WHERE target), o AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 0), (2, 1, 1), (3, 1, -1)) t(d, dy, dx)),
p1 AS (SELECT a.sample_id, d, a.v AS i, b.v AS j FROM q a, o, q b WHERE a.sample_id = b.sample_id AND b.y = a.y + dy AND b.x = a.x + dx), p2 AS (SELECT * FROM p1 UNION ALL SELECT sample_id, d, j, i FROM p1),
n AS (SELECT sample_id, d, i, j, count(*) AS n FROM p2 GROUP BY ALL), w AS (SELECT *, n / sum(n) OVER (PARTITION BY sample_id, d) AS p, sum(n * i) OVER (PARTITION BY sample_id, d) / sum(n) OVER (PARTITION BY sample_id, d) AS mi, sum(n * j) OVER (PARTITION BY sample_id, d) / sum(n) OVER (PARTITION BY sample_id, d) AS mj FROM n),
f AS (SELECT sample_id, d, sum(p * (i - j) ** 2) AS contrast, sum(p * abs(i - j)) AS dissimilarity, sum(p / (1.0 + (i - j) ** 2)) AS homogeneity, sum(p * p) AS angular_second_moment, sqrt(sum(p * p)) AS energy,
  CASE WHEN sqrt(sum(p * (i - mi) ** 2)) * sqrt(sum(p * (j - mj) ** 2)) > 2.2e-16 THEN sum(p * (i - mi) * (j - mj)) / (sqrt(sum(p * (i - mi) ** 2)) * sqrt(sum(p * (j - mj) ** 2))) ELSE 1.0 END AS correlation, -sum(p * log2(p)) AS entropy FROM w GROUP BY ALL)
SELECT sample_id, """
    + ", ".join(f"round({f}({c}), 6) AS {c}_{n}" for n, f in (("mean", "avg"), ("std", "stddev_pop")) for c in FIGURES)
    + " FROM f GROUP BY 1",
    "crop_statistics": f"WITH {CROPS}, s AS (SELECT sample_id, "
    + ", ".join(f"avg({c} / 255.0::double) AS {c}_mean, stddev_pop({c} / 255.0::double) AS {c}_std, avg({c} / 255.0::double) FILTER (y BETWEEN 3 AND 8 AND x BETWEEN 3 AND 8) AS {c}_centre_mean, stddev_pop({c} / 255.0::double) FILTER (y BETWEEN 3 AND 8 AND x BETWEEN 3 AND 8) AS {c}_centre_std" for c in RGB)
    + " FROM pxl GROUP BY 1), b AS (SELECT i::int AS sample_id, (2 + i % 7)::double AS w, (2 + i % 5)::double AS h FROM range(8) t(i)) SELECT sample_id, "
    + ", ".join(f"round({c}_{k}, 6) AS {c}_{k}" for c in RGB for k in ("mean", "std", "centre_mean", "centre_std"))
    + ", "
    + ", ".join(f"round({c}_centre_mean - {c}_mean, 6) AS {c}_contrast" for c in RGB)
    + ", round(ln(1 + w), 6) AS log_width, round(ln(1 + h), 6) AS log_height, round(ln(1 + w * h), 6) AS log_area, round(w / h, 6) AS aspect, round(ln(w / h), 6) AS log_aspect FROM s JOIN b USING (sample_id)",
    "comparison_statuses": f"""WITH {EVENTS}, ce AS (SELECT grp AS cell, substr(grp, 4, 2)::int % 6 = 5 AS circ, n_events, average_precision AS m FROM {ap('ev', 'grp')}), eh AS (SELECT event, score, grp || ':' || floor({u('half', 'doc_id')} * 4)::int AS gh FROM ev),
dw AS (SELECT split_part(gh, ':', 1) AS cell, split_part(gh, ':', 2) AS draw, average_precision AS m FROM {ap('eh', 'gh')}), c AS (SELECT 'c' || lpad(i::varchar, 2, '0') AS comparison_id, 'src' || i AS a, 'src' || ((i * 7 + 3) % 21) AS b, 'f' || (i % 2) AS family FROM range(24) t(i)),
j AS (SELECT c.*, x.m - y.m AS pd, CASE WHEN x.cell IS NULL OR y.cell IS NULL THEN 'not_available_frozen_optional_cell' WHEN x.circ OR y.circ THEN 'excluded_circularity_risk' WHEN x.n_events = 0 OR y.n_events = 0 THEN 'not_applicable_zero_corruption' ELSE 'reported' END AS status FROM c LEFT JOIN ce x ON x.cell = a LEFT JOIN ce y ON y.cell = b),
s AS (SELECT comparison_id, family, count(p.m - q.m) AS valid_draws, avg(p.m - q.m) AS md, quantile_cont(p.m - q.m, 0.025) AS low, quantile_cont(p.m - q.m, 0.975) AS high, (1 + coalesce(sum((p.m - q.m <= 0)::int), 0)) / (1 + count(p.m - q.m)) AS p
  FROM j JOIN dw p ON p.cell = a JOIN dw q ON q.cell = b AND q.draw = p.draw WHERE status = 'reported' GROUP BY ALL),
h AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, comparison_id) + 1) * p AS step FROM s),
k AS (SELECT *, least(1.0, max(step) OVER (PARTITION BY family ORDER BY p, comparison_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS adj FROM h)
SELECT j.comparison_id, j.family, status, CASE WHEN status = 'reported' THEN round(pd, 6) END AS point_difference, valid_draws, round(md, 6) AS mean_difference, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p, round(adj, 6) AS adjusted FROM j LEFT JOIN k USING (comparison_id)""",
    "feature_independence": """WITH s AS (SELECT * FROM (VALUES ('engineered', 'h1', 's1'), ('embedding', 'h2', 's2'), ('renamed', 'h3', 's2'), ('copied', 'h1', 's4')) t(n, h, g)), a AS (SELECT * FROM s UNION ALL SELECT 'unknown', NULL, NULL),
p AS (SELECT s.n AS generator, a.n AS auditor, CASE WHEN a.n = 'copied' THEN 'undecided' ELSE 'verified_independent' END AS decision, CASE WHEN a.h IS NULL THEN 'unverified' WHEN s.h = a.h OR s.g = a.g OR a.n = 'copied' THEN 'circularity_risk' ELSE 'verified_independent' END AS status FROM s, a)
SELECT *, status <> 'verified_independent' AS circularity_risk FROM p""",
    "oof_violations": f"""WITH {SAMPLES}, f AS (SELECT group_id, CASE WHEN sample_id = 's00000002' THEN 4 ELSE fold_id END AS fold_id FROM samples WHERE sample_id <> 's00000009')
SELECT 'predicted_twice' AS rule, 's00000004' AS detail UNION ALL SELECT 'bad_probabilities', 's00000001' UNION ALL SELECT 'not_predicted', 's00000009' UNION ALL SELECT 'group_in_several_folds', group_id FROM f GROUP BY group_id HAVING count(DISTINCT fold_id) > 1""",
    "matched_operands": f"""WITH {EVENTS}, e2 AS (SELECT * REPLACE (round(score * {u('other', 'doc_id')}, 3) AS score) FROM ev),
x AS ({auc('ev', 'subgroup').replace('round(', '(').replace(', 6) AS auroc', ') AS auroc')}), y AS ({auc('e2', 'subgroup').replace('round(', '(').replace(', 6) AS auroc', ') AS auroc')})
SELECT subgroup, round(x.auroc, 6) AS first, round(y.auroc, 6) AS second, round(x.auroc - y.auroc, 6) AS difference FROM x JOIN y USING (subgroup)""",
    "overlap_evidence": f"WITH {PIXELS} SELECT a.patch_id, a.channel, a.value AS instance_id, b.channel AS other_channel, b.value AS other_id, count(*) AS n FROM px a JOIN px b USING (patch_id, y, x) WHERE a.channel < 2 AND b.channel < 2 AND a.value > 0 AND b.value > 0 AND (a.channel <> b.channel OR a.value <> b.value) GROUP BY ALL",
    "label_mapping": "SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority IN ('3-MEDIUM', '5-LOW') THEN 'low' END AS mapped_label, count(*) AS n FROM orders GROUP BY 1",
    "collapse_to_parent": f"WITH {SAMPLES} SELECT group_id, min(fold_id) AS fold_id, count(*) AS n_rows FROM samples GROUP BY 1",
    "random_rankings": f"WITH {EVENTS}, r AS (SELECT run::int AS run, event, row_number() OVER (PARTITION BY run ORDER BY {u(51, 'run', 'doc_id')} DESC, doc_id) AS k FROM ev, range(20) t(run)) SELECT run, round(avg(event::int), 6) AS \"precision\" FROM r WHERE k <= 30 GROUP BY run",
    "first_distinct": """SELECT o_custkey, o_orderdate, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders)
WHERE r = 1 ORDER BY o_orderdate, o_orderkey, o_custkey LIMIT 50""",
    "identities": """WITH n AS (SELECT c_custkey, substr(lpad(to_base(c_custkey * 7, 36), 4, '0'), 3, 2) || '-' || lpad(to_base(c_custkey * 11, 36), 4, '0') AS p FROM customer)
SELECT c_custkey, 'TCGA-' || p AS patient_id, 'TCGA-' || p || '-01Z-00-DX1' AS slide_id, 'tcga-' || p || '-01Z-00-DX1_id-' || c_custkey::varchar AS fov_key FROM n""",
    "finalist_selection": f"""WITH h AS (SELECT sha256(p_partkey::varchar) AS candidate_sha, p_brand AS risk_method, p_size % 2 AS budget, p_size % 5 AS complexity FROM part),
c AS (SELECT *, round({u('objective', 'candidate_sha')}, 3) AS objective, round({u('effect', 'candidate_sha')}, 3) AS effect FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY risk_method, budget ORDER BY objective DESC, candidate_sha) AS r FROM c),
f AS (SELECT * FROM r ORDER BY (r > 1)::int, objective DESC, candidate_sha LIMIT 8),
w AS (SELECT *, row_number() OVER (ORDER BY objective DESC, effect DESC, complexity, candidate_sha) AS k FROM f),
x AS (SELECT *, row_number() OVER (ORDER BY objective DESC, effect DESC, complexity, candidate_sha) AS k FROM f WHERE risk_method <> 'Brand#11')
SELECT 'all' AS pool, candidate_sha, risk_method, budget, objective FROM w WHERE k = 1
UNION ALL SELECT 'without_Brand#11', candidate_sha, risk_method, budget, objective FROM x WHERE k = 1""",
}
