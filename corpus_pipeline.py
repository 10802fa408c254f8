"""A training corpus from ``documents``: language, near-duplicates, personal data, mixing, packing.

Every stage takes the whole table its predecessor wrote and returns a table; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyline.llm import language_id, mixing, near_dup, packing, pii
from tallyline.llm.queries import documents, vocabulary
from tallyline.llm.text import n_words
from tallyline.staging import stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language (null texts and texts without a letter) and names that of the others where it is null."""
    plain = docs.select("doc_id", "text", "lang")
    parser = language_id.fit(plain.where(~language_id.held_out("doc_id", 4, 2)))
    found = language_id.with_language(docs, parser, name="__found").where(F.col("__found.lang_pred") != language_id.UNKNOWN)
    return found.select(*[F.coalesce("lang", "__found.lang_pred").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group, once; documents without an id are in no group.

    Of an id with several rows the least row (text first) stays.
    """
    gone = near_dup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    named = (docs.where("doc_id is not null").join(gone.hint("merge"), "doc_id", "left_anti").groupBy("doc_id")
             .agg(F.min(F.struct("text", *[F.col(f"`{c}`") for c in rest])).alias("__row")))
    columns = [F.col("doc_id") if c == "doc_id" else F.col(f"__row.`{c}`") for c in docs.columns]
    return named.select(*columns).union(docs.where("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; ``n_chars`` follows the text.  A null text stays null."""
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it.

    Rows that agree in id, source and size share their copies evenly; any share gives
    the same mix.
    """
    copies = mixing.mix(docs).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    sized = docs.withColumn("__size", n_words(F.col("text").cast("string")))
    key = sized["doc_id"].eqNullSafe(copies["doc_id"]) & sized["source"].eqNullSafe(copies["source"]) & (sized["__size"] == copies["size"])
    columns = [sized[f"`{c}`"] for c in docs.columns]
    joined = sized.join(copies.hint("merge"), key).select(*columns, "__size", "__copies", "__rows")
    nth = F.row_number().over(W.partitionBy("doc_id", "source", "__size").orderBy("text", "lang")) - 1
    own = F.floor(F.col("__copies") / F.col("__rows")) + (F.col("__nth") < F.col("__copies") % F.col("__rows")).cast("int")
    return (joined.withColumn("__nth", nth).withColumn("__own", own.cast("int")).where("__own > 0")
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__own")))).select(*[F.col(f"`{c}`") for c in docs.columns]))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
          ("mixing", mixed), ("packing", packed)]

#: Language models, boosted trees and random rounding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
