"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcore.session import cut_lineage

#: ASCII white space and a run of anything else, as Java patterns.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; all other letters stay."""
    return F.translate(c, UPPER, LOWER)


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, y``: ids of documents that have a label in {0, 1}; no text is moved.

    Labels that repeat for an id count once; where they disagree the larger one holds.
    Rows with a null id have no label.
    """
    y = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    return y.join(docs.select("doc_id"), "doc_id", "left_semi")


def bounded_sample(docs: DataFrame, ids: DataFrame, per_class: int) -> DataFrame:
    """``doc_id, text, y`` of at most ``per_class`` documents of each label, those with
    the smallest id hashes.

    Only ids are ordered and broadcast (2 x ``per_class`` of them at most), so however
    many labels there are, no more texts than the sample's are moved. Rows that repeat an
    id come along only once.
    """
    chosen = [
        ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        for y in (0, 1)
    ]
    sample = docs.select("doc_id", text_of().alias("text")).join(
        F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    return cut_lineage(sample.dropDuplicates(["doc_id"]))
