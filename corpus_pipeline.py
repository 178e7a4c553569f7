"""A training corpus from documents: quality, near copies, repeated passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import minhash_dedup, packing, pii, quality_classifier, shared, substring_dedup


OWN = ("doc_id", "text")


def _carry(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with its other columns renamed, so that no name meets one of an operator's, and their new names."""
    others = [c for c in docs.columns if c not in OWN]
    return docs.select(*OWN, *(F.col(f"`{c}`").alias(f"_carry_{c}") for c in others)), [f"_carry_{c}" for c in others]


def _columns(docs: DataFrame, out: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` again, with the text of column ``text`` and its length."""

    def column(c: str):
        if c == "n_chars":
            return F.char_length(F.col(text)).cast(docs.schema[c].dataType).alias(c)
        return F.col({"doc_id": "doc_id", "text": text}.get(c, f"`_carry_{c}`")).alias(c)

    return out.select(*map(column, docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score 0.7 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~shared.held_out(F.col("doc_id")))
    hidden, carry = _carry(docs)
    scored = quality_classifier.score(hidden, quality_classifier.fit(docs, labels), carry=["text", *carry])
    return scored.where("score >= 0.7").select(*(F.col(c if c in OWN else f"`_carry_{c}`").alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group of documents that share 0.8 of their shingles of five words."""
    gone = minhash_dedup.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out words of windows of 13 that also start in a document with a smaller doc_id."""
    hidden, carry = _carry(docs)
    return _columns(docs, substring_dedup.substring_dedup(hidden, carry=carry), "kept_text")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in place of every span of personal data."""
    hidden, carry = _carry(docs)
    return _columns(docs, pii.find_pii(hidden, pii.fit(docs), redact=True, carry=carry), "redacted_text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    out = packing.pack_documents(docs, packing.default_tokenizer())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_copies), ("substring dedup", passages), ("PII", personal_data), ("packing", pack)]

#: A trained classifier decides in the first stage and a tokenizer in the last; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
