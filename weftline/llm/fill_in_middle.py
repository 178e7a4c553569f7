"""Fill-in-middle: documents cut in prefix, middle and suffix and written in another order, with built-in functions only.

``regexp_extract_all`` makes the array of units of a text, in blocks of ``width`` units so that a long text needs few array
elements; the first digits of a SHA-256 of the seed and doc_id give both cuts, the form and the order; ``slice`` and
``array_join`` build the parts, and splitting the output at its sentinels restores the text.

A document stays plain if it is empty, holds a sentinel or is dealt to the plain share; else it is written
suffix-prefix-middle (spm) for a share of the hashes, or prefix-suffix-middle (psm).

Defined cases: null text is empty; a null doc_id hashes as an empty one; rows with an equal doc_id and text give equal
rows, once for each; the cuts may be equal or at an end, so any part may be empty; a text of any length makes
n / width array elements and a few copies of itself; an empty table gives an empty table; other columns are
carried only if named in ``carry``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One code point.
CODE_POINT = "(?s:.)"
SENTINELS = ("<P>", "<S>", "<M>")


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)


def _checked(sentinels) -> tuple[str, str, str]:
    p, s, m = sentinels
    first = {x[:1] for x in (p, s, m)}
    if "" in first or len({p, s, m}) < 3 or any(c in x[1:] for c in first for x in (p, s, m)):
        raise ValueError("sentinels must differ, and none may hold the first character of one further in: parsing would be ambiguous")
    return p, s, m


def hashes(doc_id: Column, seed: str, how_many: int = 4) -> list[Column]:
    """The first 8-digit groups of the SHA-256 of ``seed:doc_id`` as unsigned integers."""
    h = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(how_many)]


def arranged(docs: DataFrame, seed: str = "1", plain: int = 10, spm: int = 20, sentinels=SENTINELS, unit: str = CODE_POINT, width: int = 64, carry=()) -> DataFrame:
    """doc_id, text, n (units), form, prefix, middle, suffix and output of every document, and the columns named in ``carry``.

    ``plain`` and ``spm`` are shares in percent; ``unit`` a pattern whose matches tile the text.
    """
    p, s, m = _checked(sentinels)
    d = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carry)
    d = d.withColumn("_blocks", _found(F.col("text"), f"(?:{unit}){{1,{width}}}"))
    last = F.coalesce(F.try_element_at("_blocks", F.lit(-1)), F.lit(""))
    d = d.withColumn("n", (F.greatest(F.size("_blocks") - 1, F.lit(0)) * width + F.size(_found(last, unit))).cast("long"))
    h = hashes(F.col("doc_id"), seed)
    d = d.select("*", *(x.alias(f"_h{i}") for i, x in enumerate(h)))
    a, b = F.col("_h0") % (F.col("n") + 1), F.col("_h1") % (F.col("n") + 1)
    d = d.withColumn("_lo", F.least(a, b)).withColumn("_hi", F.greatest(a, b))
    holds = F.contains("text", F.lit(p)) | F.contains("text", F.lit(s)) | F.contains("text", F.lit(m))
    stays = (F.col("text") == "") | holds | (F.col("_h2") % 100 >= 100 - plain)
    d = d.withColumn("form", F.when(stays, "plain").when(F.col("_h3") % 100 < spm, "spm").otherwise("psm"))

    # a cut at unit k lies in block k // width, after k % width of its units
    def at(cut: str) -> Column:
        return F.floor(F.col(cut) / width).cast("int")

    def units(cut: str) -> Column:
        return _found(F.coalesce(F.get("_blocks", at(cut)), F.lit("")), unit)

    d = d.withColumn("_ulo", units("_lo")).withColumn("_uhi", units("_hi"))

    def within(u: str, cut: str, before: bool) -> Column:
        k = (F.col(cut) % width).cast("int")
        return F.array_join(F.slice(u, F.lit(1), k) if before else F.slice(u, k + 1, F.size(u)), "")

    def blocks(first: Column, count: Column) -> Column:
        return F.array_join(F.slice("_blocks", first + 1, F.greatest(count, F.lit(0))), "")

    lo, hi = at("_lo"), at("_hi")
    k_lo, k_hi = (F.col("_lo") % width).cast("int"), (F.col("_hi") % width).cast("int")
    same = F.array_join(F.slice("_ulo", k_lo + 1, k_hi - k_lo), "")
    apart = F.concat(within("_ulo", "_lo", False), blocks(lo + 1, hi - lo - 1), within("_uhi", "_hi", True))
    d = d.withColumn("prefix", F.concat(blocks(F.lit(0), lo), within("_ulo", "_lo", True)))
    d = d.withColumn("middle", F.when(lo == hi, same).otherwise(apart))
    d = d.withColumn("suffix", F.concat(within("_uhi", "_hi", False), blocks(hi + 1, F.size("_blocks"))))
    psm = F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle")
    spm_ = F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")
    out = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", spm_).otherwise(psm)
    return d.select("doc_id", "text", "n", "form", "prefix", "middle", "suffix", out.alias("output"), *carry)


def restored(output: Column, form: Column, sentinels=SENTINELS) -> Column:
    """The text of an output, from it and its form alone: the sentinels split it, the parts go back in order."""
    parts = F.split(output, "|".join(re.escape(x) for x in _checked(sentinels)), -1)
    get = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "spm", F.concat(get(2), get(3), get(1))).otherwise(F.concat(get(1), get(3), get(2)))


def op13(spark, sf_dir: str) -> DataFrame:
    d = arranged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    moved = F.col("form") != "plain"
    length = lambda c: F.when(moved, F.char_length(c).cast("long"))
    return d.select(
        "doc_id", "n", "form", length("prefix").alias("prefix_chars"), length("middle").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, lo) AS prefix, substr(t, lo + 1, hi - lo) AS middle, substr(t, hi + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
