"""Corpus pipeline: language ID, near-duplicate removal, pseudonyms, source mixing, packing; each stage's rows are the next one's.

All stages read the columns of documents and ignore others, whatever their names; null columns, empty and very long
texts are rows like others unless a stage says what becomes of them; an empty table gives no rows.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.llm import langid, mixing, near_dedup, packing, pii
from rastrel.llm.common import staged

#: Setting that holds the secret of the pseudonyms; without it an application draws its own, which nobody is told.
PII_KEY = "spark.rastrel.pii.key"
_drawn: dict[str, str] = {}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts and texts without a letter (`und`); `lang` becomes the prediction. Repeated rows all stay.

    Where no row has both text and lang, nothing can be learnt and every row is rejected.
    """
    docs = docs.select(COLUMNS)
    net = langid.train(docs)
    found = langid.identify(docs, net, keep=("doc_id", "source", "n_chars"), give_text=True).where(F.col("lang_pred") != langid.UNKNOWN)
    return found.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts: five words, similarity of 0.8 or more.

    Groups are of texts, which a hash names, not of doc_ids: so repeated rows and null doc_ids count as copies, and
    another text of the same doc_id doesn't. The smallest doc_id stays (null last); a text without a word is alone,
    but of repeated rows of it, with one doc_id, one stays.
    """
    rows = docs.select(COLUMNS).withColumn("_h", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("_no", F.col("doc_id").isNull()).withColumn("_i", F.coalesce("doc_id", F.lit(0)))
    key = ["_h", "_no", "_i"]
    found = near_dedup.near_duplicates(rows.select(F.col("_h").alias("doc_id"), "text"), k=5, num=80, den=100)
    linked = staged(found.where("n_shingles > 0").select(F.col("doc_id").alias("_h"), "component_id").distinct(), "pipeline-groups")
    each = staged(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).join(linked, "_h", "left"), "pipeline-rows")
    first = each.where("component_id is not null").groupBy("component_id").agg(F.min(F.struct("_no", "_i", "_h", "_n")).alias("f")).select("f.*")
    stay = staged(first.select(*key, "_n").unionByName(each.where("component_id is null").select(*key, "_n")), "pipeline-stay")
    out = rows.join(stay.where("_n = 1"), key, "left_semi").select(COLUMNS)
    repeated = stay.where("_n > 1")
    if repeated.isEmpty():
        return out
    return out.unionByName(rows.join(repeated, key, "left_semi").dropDuplicates(key).select(COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms in every text; n_chars follows. Every row stays; null text stays null (n_chars null).

    To link pseudonyms of several runs, set PII_KEY; a key that was drawn links those of one application.
    """
    key = spark.conf.get(PII_KEY, None) or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))
    return pii.pseudonymise(docs.select(COLUMNS), key).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's documents as often as its budget asks for; the last document of a prefix stays whole.

    Null lang or source become ''; rows of equal doc_id are separate documents, in order of hashes of their texts.
    """
    return mixing.mix(docs, keep=("text", "lang", "source", "n_chars")).select("doc_id", "text", "lang", "source", "n_chars")


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 4096 tokens; a null or empty text is the end token alone."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup_stage), ("pii", pii_stage), ("mixing", mix_sources), ("packing", pack_tokens)]

#: Neither a trained network nor a tokenizer can be said in SQL; tests hold the stages against brute force, and on awkward rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's table is deleted once the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = staged(out, f"pipeline-{name}", instead_of=docs) if k + 1 < len(STAGES) else out
    return docs
