"""Quality rules by distribution divergence, with built-in functions only.

A document's histogram of character classes and its histogram of common words are compared
with those of all documents of its language by the Jensen-Shannon distance (base 2,
between 0 and 1).  The references are summed over all documents.  A document that is too short
for a histogram to mean anything is not judged by it.

Everything of a document is worked out inside its row, so the texts are never
shuffled; the one aggregate is of one row of sums per language.

Defined cases: null text has no words; a null lang, or a language with fewer than
``min_reference`` documents, is compared with the sum over all languages; repeated rows get the same result each and count in the sums
as often as they occur; a very long text stays in its row; an
empty table gives an empty table; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared as S

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
# Frequent function words of English, French, German and Spanish.
COMMON = [
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "with",
    "de", "la", "le", "et", "les", "des", "en", "un", "que", "pour",
    "der", "die", "und", "den", "von", "das", "mit", "nicht", "ein", "im",
    "el", "y", "los", "del", "se", "las", "por", "para", "con", "una",
]


def _let(value: Column, f) -> Column:
    """f(value), with value worked out once."""
    return F.transform(F.array(value), f)[0]


def repeated_words(words: Column, size: int = 8) -> Column:
    """How many words lie in windows of ``size`` words found twice or more (windows by 64-bit hash)."""
    last = F.size(words) - size + 1
    windows = F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, F.lit(size))))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        places = _let(order, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])))
        steps = _let(places, lambda p: F.transform(p, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(p, i + 1) - x, F.lit(size)))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms; null if one is empty."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))

    def parts(n: Column) -> Column:
        # v * log2(v / m), 0 at v = 0
        def half(v: Column, m: Column) -> Column:
            return F.when(v > 0, v * F.log2(v / m)).otherwise(0.0)

        z = F.zip_with(p, q, lambda a, b: _let(F.struct((a / n["p"]).alias("a"), (b / n["q"]).alias("b")), lambda t: 0.5 * half(t["a"], (t["a"] + t["b"]) / 2) + 0.5 * half(t["b"], (t["a"] + t["b"]) / 2)))
        return F.when((n["p"] > 0) & (n["q"] > 0), F.sqrt(F.greatest(F.lit(0.0), total(z))))

    return _let(F.struct(total(p).alias("p"), total(q).alias("q")), parts)


def measures(docs: DataFrame, common: list[str]) -> DataFrame:
    """Per document: the base counts, chars (of six classes) and commons (of each common word, and all others)."""
    t = S.texts(docs, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    t = t.withColumn("text", F.coalesce("text", F.lit("")))
    w = t.withColumn("words", F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    w = w.withColumn("found", F.filter("words", lambda x: x.isin(*common)))
    c = w.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.char_length("text").cast("long").alias("n_all"),
        *(F.regexp_count("text", F.lit(rf"\p{{{k}}}")).cast("long").alias(k) for k in ("Lu", "Ll", "Nd")),
        F.size("found").cast("long").alias("n_found"),
        *((F.size("found") - F.size(F.array_remove("found", x))).cast("long").alias(f"w{i}") for i, x in enumerate(common)),
    )
    return c.select(
        *["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        F.array("Lu", "Ll", "Nd", "n_symbols", F.col("n_all") - F.col("word_chars"), F.col("word_chars") - F.col("Lu") - F.col("Ll") - F.col("Nd") - F.col("n_symbols")).alias("chars"),
        F.array(*(f"w{i}" for i in range(len(common))), F.col("n_words") - F.col("n_found")).alias("commons"),
    )


def references(m: DataFrame, n_common: int, min_reference: int) -> DataFrame:
    """One row per lang: ref_chars and ref_commons."""
    sizes = {"chars": 6, "commons": n_common + 1}
    names = [(k, i) for k, n in sizes.items() for i in range(n)]
    own = m.groupBy("lang").agg(F.count("*").alias("docs"), *(F.sum(F.col(k)[i]).cast("double").alias(f"{k}{i}") for k, i in names))
    from pyspark.sql import Window

    everything = Window.partitionBy(F.lit(0))  # one row per language
    few = (F.col("docs") < min_reference) | (F.col("lang") == "")
    own = own.select("lang", *(F.when(few, F.sum(f"{k}{i}").over(everything)).otherwise(F.col(f"{k}{i}")).alias(f"{k}{i}") for k, i in names))
    return own.select("lang", *(F.array(*(f"{k}{i}" for i in range(n))).alias(f"ref_{k}") for k, n in sizes.items()))


def quality_rules(docs: DataFrame, common: list[str] = COMMON, max_chars: float = 0.3, max_commons: float = 0.3, min_words: int = 50, min_chars: int = 200, min_reference: int = 10) -> DataFrame:
    """The base counts with base_failed, char_distance, common_distance (null where not judged) and kept."""
    m = S.materialize(measures(docs, common), "measures")
    ref = S.materialize(references(m, len(common), min_reference), "references")
    j = m.join(ref, "lang")
    j = j.withColumn("char_distance", F.when(F.col("word_chars") >= min_chars, distance(F.col("chars"), F.col("ref_chars"))))
    j = j.withColumn("common_distance", F.when(F.col("n_words") >= min_words, distance(F.col("commons"), F.col("ref_commons"))))
    j = j.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    fits = (F.coalesce("char_distance", F.lit(0.0)) <= max_chars) & (F.coalesce("common_distance", F.lit(0.0)) <= max_commons)
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fits).alias("kept"), "char_distance", "common_distance")


def op2(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op2_sql() -> str:
    listed = ", ".join(f"'{x}'" for x in COMMON)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS s, words FROM w WHERE len(words) >= 8),
named AS (SELECT doc_id, s, array_to_string(words[s : s + 7], ' ') AS k FROM win),
again AS (SELECT doc_id, s FROM named QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
steps AS (SELECT doc_id, least(8, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s) - s, 8)) AS step FROM again),
rep AS (SELECT doc_id, sum(step) AS n FROM steps GROUP BY doc_id),
m AS (
  SELECT w.doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         length(text) AS n_all, len(regexp_extract_all(text, '\p{{Lu}}')) AS lu, len(regexp_extract_all(text, '\p{{Ll}}')) AS ll, len(regexp_extract_all(text, '\p{{Nd}}')) AS nd,
         list_transform([{listed}], lambda c: len(list_filter(words, lambda x: x = c))) AS found
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
h AS (SELECT *, [lu, ll, nd, n_symbols, n_all - word_chars, word_chars - lu - ll - nd - n_symbols] AS chars, list_append(found, n_words - list_sum(found)) AS commons FROM m),
bins AS (
  SELECT lang, 'c' AS kind, unnest(range(1, len(chars) + 1)) AS i, unnest(chars) AS v FROM h
  UNION ALL SELECT lang, 'w', unnest(range(1, len(commons) + 1)), unnest(commons) FROM h),
per AS (SELECT lang, kind, i, sum(v) AS v FROM bins GROUP BY ALL),
few AS (SELECT lang, count(*) < 10 OR lang = '' AS few FROM h GROUP BY lang),
mixed AS (SELECT lang, kind, i, CASE WHEN few THEN (SELECT sum(v) FROM per p WHERE p.kind = per.kind AND p.i = per.i) ELSE v END AS v FROM per JOIN few USING (lang)),
ref AS (SELECT lang, list(v ORDER BY i) FILTER (kind = 'c') AS rc, list(v ORDER BY i) FILTER (kind = 'w') AS rw FROM mixed GROUP BY lang),
j AS (SELECT h.*, list_zip(list_transform(chars, lambda x: x / list_sum(chars)), list_transform(rc, lambda x: x / list_sum(rc))) AS zc,
             list_zip(list_transform(commons, lambda x: x / list_sum(commons)), list_transform(rw, lambda x: x / list_sum(rw))) AS zw FROM h JOIN ref USING (lang)),
d AS (SELECT *,
  CASE WHEN word_chars >= 200 THEN sqrt(greatest(0, list_sum(list_transform(zc, lambda z: 0.5 * (CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END) + 0.5 * (CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END))))) ELSE 0 END AS dc,
  CASE WHEN n_words >= 50 THEN sqrt(greatest(0, list_sum(list_transform(zw, lambda z: 0.5 * (CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END) + 0.5 * (CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END))))) ELSE 0 END AS dw,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM j)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, (NOT base_failed AND dc <= 0.3 AND dw <= 0.3) AS kept FROM d
"""


OP2_SQL = _op2_sql()
