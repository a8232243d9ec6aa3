"""Queries of the training-data operators, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.llm import bpe, capping, formatdup, leakage, mixing, neardup, packing, reading, syntax
from lodewright.llm.common import read


def _records(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("rec_id"), "text")
    rows = read(spark, sf, "corpus").select(F.lit("corpus").alias("tbl"), F.col("row_id").alias("rec_id"), F.col("problem").alias("text"))
    return docs.unionByName(rows)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(_records(spark, sf), read(spark, sf, "benchmark")).select("tbl", "rec_id", "item_id")


def p1_items(spark: SparkSession, sf: str) -> DataFrame:
    """Report: every test item with the number of records it leaked into, by table."""
    hits = leakage.leaks(_records(spark, sf), read(spark, sf, "benchmark"))
    n = hits.groupBy("item_id").agg(F.count_if(F.col("tbl") == "documents").alias("in_documents"), F.count_if(F.col("tbl") == "corpus").alias("in_corpus"), F.max("n_words").alias("most_words"))
    return read(spark, sf, "benchmark", "item_id", "suite").join(n, "item_id", "left").fillna(0, ["in_documents", "in_corpus", "most_words"])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "text")
    _, same = formatdup.collapse(docs)
    return neardup.near_duplicates(docs, same, 0.7)


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.groups(read(spark, sf, "documents", "doc_id", "text"), 0.7)


def _cap(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "corpus", "row_id", "problem_id", "score", "is_correct")
    who = F.lower(F.regexp_replace("problem_id", r"^\s+|\s+$", ""))
    return capping.cap(rows, who=who, score=F.col("score"), identifier=F.col("row_id"), eligible=~F.col("is_correct").eqNullSafe(False))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _cap(spark, sf).where("not kept").select(F.col("id").alias("row_id"))


def p3_contributors(spark: SparkSession, sf: str) -> DataFrame:
    """Report: rows and kept rows of every contributor."""
    return _cap(spark, sf).groupBy(F.col("who").alias("problem")).agg(F.count("*").alias("n_rows"), F.count_if("kept").alias("n_kept"))


def _rates(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.rates(read(spark, sf, "data_manifest"), read(spark, sf, "mixture_summary"))


def p4_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(read(spark, sf, "documents", "doc_id", "source", "text"), _rates(spark, sf))


def p4_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(read(spark, sf, "documents", "doc_id", "source", "text"), _rates(spark, sf), read(spark, sf, "mixture_summary"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return formatdup.copies(read(spark, sf, "documents", "doc_id", "text"))


def p5_texts(spark: SparkSession, sf: str) -> DataFrame:
    return formatdup.collapse(read(spark, sf, "documents", "doc_id", "text"))[0]


def p5_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Report: distinct texts and field lists, and how many of their hashes collide."""
    return formatdup.collisions(formatdup.canonical_keys(read(spark, sf, "documents", "doc_id", "text")))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "corpus").select(F.lit("corpus").alias("tbl"), F.col("row_id").alias("rec_id"), "repo", F.col("language_tag").alias("tag"), F.col("generated_solution").alias("file"))
    docs = read(spark, sf, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("rec_id"), "repo", F.col("language_tag").alias("tag"), F.col("solution").alias("file"))
    return rows.unionByName(docs)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.checked(_files(spark, sf)).where("not parses").select("tbl", "rec_id")


def p6_rates(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.rates(_files(spark, sf))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.token_ids(read(spark, sf, "documents", "doc_id", "text"))


def _pack(spark: SparkSession, sf: str) -> DataFrame:
    capacities = [r[0] for r in read(spark, sf, "packing_stats", "n_ctx").where("n_ctx > 0").distinct().collect()]
    return packing.pack(bpe.token_counts(read(spark, sf, "documents", "doc_id", "text")), capacities)


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return _pack(spark, sf)


def p8_waste(spark: SparkSession, sf: str) -> DataFrame:
    """Report: waste per capacity beside the mean waste of earlier runs."""
    now = packing.packing_report(_pack(spark, sf))
    old = read(spark, sf, "packing_stats").groupBy("n_ctx").agg(F.round(F.avg("waste_ratio"), 6).alias("earlier_waste_ratio"))
    return now.join(old, "n_ctx", "left")


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading.levels(read(spark, sf, "documents", "doc_id", "domain", "text"), read(spark, sf, "reading_labels", "doc_id", "rater", "reading_level"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).where((F.lower(F.trim("domain")) == "stem") & (F.col("hard") >= 0.5)).select("doc_id")


def p9_levels(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).select("doc_id", "domain", "n_words", F.round("unfamiliar", 6).alias("unfamiliar"), F.round("sentence_words", 6).alias("sentence_words"), "reading_level")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_items, p2_found, p2_groups, p3_found, p3_contributors, p4_mixture, p4_shares, p5_found, p5_texts, p5_collisions, p6_found, p6_rates, p7_ids, p8_containers, p8_waste, p9_found, p9_levels)
}
