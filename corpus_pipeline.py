"""A pass over a training corpus: five stages, each on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoframe.llm import exact_dedup as exact
from kairoframe.llm import langid, near_dedup, packing, secret_scan
from kairoframe.llm.common import Scratch, table

NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go (no text, no letter, or a score under the calibrated
    least); a missing lang is filled in. Where no row has a label, all go, as nothing was learnt.
    Repeated rows and null ids are judged by their text; no rows give none."""
    model = langid.fit(docs.where(langid.learnable()))
    found = langid.identify(docs.select(F.struct("*").alias("row")), model, text_col="row.text").where("not rejected")
    new = {"lang": F.coalesce("row.lang", "lang_pred")}
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts one row stays: that with the smallest id, and of rows that
    repeat it, or that all lack an id, any one. Null texts equal empty ones; no rows give none."""
    found = exact.exact_dedup(docs)
    gone = found.where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_text")).distinct()
    text = F.sha2(exact.normalised(docs["text"]), 256)
    left = docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (text == gone["gone_text"]), "left_anti")
    again = found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").select(F.col("doc_id").alias("again_id"), F.col("text_sha256").alias("again_text"))
    again = Scratch(spark, "exact-stage").write(again, "again")
    if not again.limit(1).count():
        return left
    same = left["doc_id"].eqNullSafe(again["again_id"]) & (F.sha2(exact.normalised(left["text"]), 256) == again["again_text"])
    doubled = left.join(again, same).groupBy("again_id", "again_text").agg(F.first(F.struct(*(left[f"`{c}`"] for c in docs.columns))).alias("row"))
    return left.join(again, same, "left_anti").unionByName(doubled.select("row.*"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays, that with the smallest id. Rows go by id
    and text, so a row stays that shares only its id with one that goes. Texts without words and
    rows without an id stay; no rows give none."""
    gone = near_dedup.near_dedup(docs, percent=NEAR_PERCENT).where("not stays").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (near_dedup.text_key(docs["text"]) == gone["gone_key"]), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets replaced and n_chars as long as the new text. Null and
    empty texts have none; repeated rows and null ids are treated alike; no rows give none."""
    found = secret_scan.secret_spans(docs.select(F.struct("*").alias("row")), id_col="row.doc_id", text_col="row.text")
    text = secret_scan.redacted(F.col("row.text"), F.col("secret_spans"))
    new = {"text": text, "n_chars": F.when(F.size("secret_spans") > 0, F.length(text)).otherwise(F.col("row.n_chars"))}
    kinds = dict(docs.dtypes)
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).cast(kinds[c]).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of 1024 tokens; null and empty texts are one token."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_duplicates),
    ("secret_scan", secrets),
    ("packing", packed),
]

#: Signatures, a trained model and a solver are not to be had in SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.keep(name)  # the next stage reads no other
    return STAGES[-1][1](spark, docs, sf_dir)
