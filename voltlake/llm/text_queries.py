"""Queries over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.llm import encoding, leaks, mixing
from voltlake.runtime import materialize, read_table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and an evaluation item that it holds."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    items = read_table(spark, sf_dir, "eval_items").select("item_id", "item_text")
    return leaks.leaked_pairs(docs, items).select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked item with its documents and the largest share that one holds."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    items = read_table(spark, sf_dir, "eval_items").select("item_id", "item_text")
    pairs = leaks.leaked_pairs(docs, items)
    return pairs.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("share_found").alias("largest_share"))


def _mixture(spark: SparkSession, sf_dir: str):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = materialize(mixing.token_counts(docs, ["doc_id", "source"]), "tokens")
    return mixing.mixture(sized, read_table(spark, sf_dir, "mix_targets"))


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture, with their tokens and how often each is used."""
    return _mixture(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mixture(spark, sf_dir)[1]


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = materialize(encoding.context_counts(docs), "contexts")
    return encoding.damaged_texts(docs, counts)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage that was decoded wrongly."""
    return _damaged(spark, sf_dir).select("doc_id")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restored text of each such document, and whether nothing in it is lost."""
    return _damaged(spark, sf_dir)


QUERIES = {"p6_found": p6_found, "p6_items": p6_items, "p7_selection": p7_selection, "p7_shares": p7_shares, "p8_found": p8_found, "p8_restored": p8_restored}

SQL: dict[str, str] = {}
