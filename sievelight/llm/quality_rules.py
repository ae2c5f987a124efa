"""Line-first cleaning: judge each line, remove the failing ones, then judge what is left of the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import GAP, let, words

SYMBOLS = "#*$%&|<>"

# One-entry menu lines, and phrases that site templates add around an article, in English, German, French
# and Spanish.
MENU = (
    r"(?i)^[ ]*(home|menu|login|log in|log out|sign in|sign up|register|search|next|previous|back|contact|contact us|"
    r"about|about us|faq|help|sitemap|site map|skip to content|read more|more|share|print|top|"
    r"startseite|men[üÜúÚ]|anmelden|abmelden|registrieren|suche|weiter|zur[üÜ]ck|kontakt|impressum|datenschutz|[üÜ]ber uns|"
    r"mehr lesen|weiterlesen|mehr|teilen|drucken|accueil|connexion|d[éÉ]connexion|rechercher|suivant|pr[éÉ]c[éÉ]dent|"
    r"nous contacter|[àÀ] propos|lire la suite|plan du site|mentions l[éÉ]gales|partager|imprimer|inicio|iniciar sesi[óÓ]n|"
    r"buscar|siguiente|anterior|contacto|sobre nosotros|leer m[áÁ]s|mapa del sitio|aviso legal|compartir|imprimir)[ .:>]*$"
)
BOILERPLATE = (
    r"(?i)(cookie policy|use cookies|privacy policy|terms of use|terms of service|terms and conditions|"
    r"all rights reserved|enable javascript|lorem ipsum|click here|subscribe to our|sign up for our|"
    r"share on facebook|share on twitter|follow us on|powered by wordpress|back to top|"
    r"verwendet cookies|cookie-richtlinie|datenschutzerkl[äÄ]rung|nutzungsbedingungen|alle rechte vorbehalten|hier klicken|"
    r"newsletter abonnieren|utilise des cookies|politique de confidentialit[éÉ]|conditions d.utilisation|"
    r"tous droits r[éÉ]serv[éÉ]s|cliquez ici|abonnez-vous|utiliza cookies|pol[íÍ]tica de privacidad|t[éÉ]rminos de uso|"
    r"t[éÉ]rminos y condiciones|todos los derechos reservados|haga clic aqu[íÍ]|suscr[íÍ]base)"
)
SEPARATOR = "(^|[ ])[|>»›•·][ ]"
#: What ends a sentence, with the quotes and brackets that may close after it.
TERMINAL = r"[.!?…。！？:;][\x22\x27”’»)\]]*([\x20\x09-\x0D]|\z)"


def _chars(x: Column) -> Column:
    return F.length(F.regexp_replace(x, GAP, ""))


def _count(x: Column, marks: str) -> Column:
    return F.length(x) - F.length(F.translate(x, marks, ""))


def _line_passes(x: Column, max_symbols: float, max_shouts: float, max_separators: int, boilerplate_chars: int, sentence_chars: int) -> Column:
    punctuation = (_count(x, SYMBOLS) <= max_symbols * _chars(x)) & (_count(x, "!") <= max_shouts * _chars(x))
    punctuation = punctuation & ((F.length(x) < sentence_chars) | F.rlike(x, F.lit(TERMINAL)))
    navigation = ~(F.rlike(x, F.lit(MENU)) | (F.regexp_count(x, F.lit(SEPARATOR)) > max_separators))
    boilerplate = (F.length(x) > boilerplate_chars) | ~F.rlike(x, F.lit(BOILERPLATE))
    return punctuation & navigation & boilerplate


def _repeated_words(w: Column, size: int) -> Column:
    """How many words stand in a window of ``size`` words that occurs twice or more, the first time included."""

    def covered(hashes: Column) -> Column:
        def from_sorted(s: Column) -> Column:
            twin = lambda k, h: F.coalesce(F.get(s, k)["h"] == h, F.lit(False))
            starts = F.filter(s, lambda p, k: twin(k - 1, p["h"]) | twin(k + 1, p["h"]))
            step = lambda acc, i: F.struct(
                (acc["n"] + size - F.greatest(F.lit(0), acc["end"] - i)).alias("n"), (i + size).alias("end")
            )
            zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            return F.aggregate(F.array_sort(F.transform(starts, lambda p: p["i"])), zero, step)["n"]

        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, from_sorted))

    def windows(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v) - (size - 1))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(v, i, F.lit(size))))

    hashed = lambda v: let(windows(v), covered)
    return F.when(F.size(w) <= size, F.lit(0)).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), hashed))


def clean_lines(
    docs: DataFrame,
    *,
    text: str = "text",
    min_words: int = 20,
    window: int = 8,
    max_repeat_percent: int = 30,
    max_symbols: float = 0.1,
    max_shouts: float = 0.1,
    max_separators: int = 2,
    boilerplate_chars: int = 300,
    sentence_chars: int = 120,
    max_loss: float = 0.5,
) -> DataFrame:
    """Add line-cleaning columns to ``docs``: one row out for each row in, in one pass and without a shuffle.

    A line fails if over ``max_symbols`` of its characters are markup symbols, if over ``max_shouts`` are exclamation
    marks, or if it has ``sentence_chars`` characters or more and no sentence ends in it (punctuation), if it has over
    ``max_separators`` menu separators or is a one-entry menu (navigation), if it is at most ``boilerplate_chars`` long
    and holds a template phrase, or if it equals an earlier line (boilerplate).  The
    document is rejected (``kept`` false) if it loses over ``max_loss`` of its word characters, or by its base figures:
    under ``min_words`` words, or over ``max_repeat_percent`` percent of them in ``window``-word windows that repeat.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean_chars (word characters
    of the lines that stay) and clean_text (these lines).  Columns of the input by those names are replaced.

    A null or empty text has no words: every count is 0, base_failed is true, kept is false and clean_text is empty.
    Repeated rows and null ids are treated row by row.  Empty input gives empty output.
    """
    params = (max_symbols, max_shouts, max_separators, boilerplate_chars, sentence_chars)
    t = F.coalesce(F.col(text), F.lit(""))
    lined = docs.withColumns({"_t": t, "_w": words(F.col(text)), "_l": F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))})
    counted = lined.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": _chars(F.col("_t")).cast("long"),
            "n_symbols": _count(F.col("_t"), SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": _repeated_words(F.col("_w"), window).cast("long"),
            "_k": F.array_distinct(F.filter("_l", lambda x: _line_passes(x, *params))),
        }
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    judged = counted.withColumns({"base_failed": failed, "clean_text": F.array_join("_k", "\n")})
    judged = judged.withColumn("clean_chars", _chars(F.col("clean_text")).cast("long"))
    kept = ~F.col("base_failed") & (F.col("clean_chars") >= (1 - max_loss) * F.col("word_chars"))
    return judged.withColumn("kept", kept).drop("_t", "_w", "_l", "_k")


def op1_quality_rules(docs: DataFrame) -> DataFrame:
    return clean_lines(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_chars"
    )


ORACLE = f"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
b AS (
  SELECT *, len(w) AS n_words,
         list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN list_position(l, l[i]) = i THEN l[i] END),
                     lambda x: x IS NOT NULL) AS firsts
  FROM a),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM b, unnest(range(1, len(w) - 6)) AS u(i)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, range(0, 8) AS r(k) GROUP BY doc_id),
c AS (
  SELECT b.*, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
         len(l) - len(firsts) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
         list_sum(list_transform(list_filter(firsts, lambda x:
             length(x) - length(translate(x, '{SYMBOLS}', '')) <= 0.1 * length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g'))
             AND length(x) - length(translate(x, '!', '')) <= 0.1 * length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g'))
             AND (length(x) < 120 OR regexp_matches(x, '{TERMINAL}'))
             AND NOT regexp_matches(x, '{MENU}') AND len(regexp_extract_all(x, '{SEPARATOR}')) <= 2
             AND (length(x) > 300 OR NOT regexp_matches(x, '{BOILERPLATE}'))),
           lambda x: length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g')))) AS clean
  FROM b LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols,
       n_dup_lines::bigint AS n_dup_lines, n_repeat_words::bigint AS n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 2 * coalesce(clean, 0) >= word_chars AS kept,
       coalesce(clean, 0)::bigint AS clean_chars
FROM c
"""
