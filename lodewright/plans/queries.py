"""Queries of the pipeline's operators over the driver tables, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.config import DEFAULT, DOCUMENT
from lodewright.functions import text as tx
from lodewright.functions.code import python_parses
from lodewright.functions.hashing import minhash, normalized_hash, raw_hash
from lodewright.operators import contamination, dedup, ingest, license, metrics, mixture, packing, quality
from lodewright.operators.base import spread
from lodewright.plans import pipeline
from lodewright.tokenizer import corpus, train
from lodewright.tokenizer import metrics as token_metrics
from lodewright.tokenizer.model import count_column, encode_column
from lodewright.tokenizer.study import frozen_vocabulary

CAPACITY = 4096


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents table in the pipeline's schema; ids become ``source:number``, hashes are those of the contract, computed anew."""
    d = spread(table(spark, sf, "documents"))  # before anything is computed
    names = {
        "doc_id": F.concat(F.coalesce("source", F.lit("")), F.lit(":"), F.lpad(F.col("doc_id").cast("string"), 8, "0")), "source_id": F.col("source"), "language": F.col("lang"), "ord": F.col("doc_id"),
        "normalized_hash": normalized_hash(F.col("text")), "raw_hash": raw_hash(F.col("text")),
    }
    return d.select(*[(names.get(f.name, F.col(f.name) if f.name in d.columns else F.lit(None))).cast(f.dataType).alias(f.name) for f in DOCUMENT.fields])


def references(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("ref_id"), F.col("item_id").alias("ref_ord"), "text")


def normalize_binary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.is_binary(F.col("text")).alias("is_binary"))


def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", raw_hash(F.col("text")).alias("raw_hash"), normalized_hash(F.col("text")).alias("normalized_hash"))


def hash_equality(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", normalized_hash(F.col("text"), "sha2").alias("h"))


def python3_tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "corpus").groupBy("language_tag").agg(F.count("*").alias("n")).withColumn("is_python3", tx.is_python3_tag(F.col("language_tag")))


def contract_missing(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "data_manifest")
    return m.select("manifest_id", F.array_join(license.missing_values(m), ";").alias("errors"))


def license_inventory(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "data_manifest").drop("contract_errors")
    return license.inventory(m.withColumn("decision", F.lit(None).cast("string"))).select("manifest_id", "status", "block_reason")


def inventory_backfill(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "data_manifest").select("source_id").where("source_id is not null").distinct()
    return license.backfill_tokens(m, table(spark, sf, "documents").select(F.col("source").alias("source_id"), "token_count"))


def manifest_shards(spark: SparkSession, sf: str) -> DataFrame:
    from lodewright.sources.sinks import manifest_shards as shards

    return shards(table(spark, sf, "data_manifest").select("source_id", "domain", "token_count", "status"))


def ingest_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "corpus").select(F.col("row_id").alias("doc_id"), F.lit("codecontests_plus").alias("source_id"), "is_correct", "language_tag").where("problem_id is not null")
    _, removed = ingest.ingest_filter(c)
    return removed.select("doc_id", F.element_at("reason_codes", 1).alias("reason"))


def expand_contests(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.expand_contest(table(spark, sf, "raw_contests")).select("raw_id", "item", "text", "problem_id", "solution")


def expand_parallel_solutions(spark: SparkSession, sf: str) -> DataFrame:
    """Contest rows in the form of two parallel arrays; Python is language code 3."""
    subs = F.col("correct_submissions")
    lang = F.transform(subs, lambda s: F.when(tx.is_python3_tag(s["language"]), 3).otherwise(2))
    r = table(spark, sf, "raw_contests").select("raw_id", F.col("title").alias("name"), "description", F.struct(lang.alias("language"), F.transform(subs, lambda s: s["code"]).alias("solution")).alias("solutions"))
    return ingest.expand_parallel(r).select("raw_id", "item", "text", "problem_id")


def expand_solution_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Contest rows with their solutions as a JSON string."""
    codes = F.to_json(F.transform("correct_submissions", lambda s: s["code"]))
    r = table(spark, sf, "raw_contests").select("raw_id", F.col("id"), F.col("description").alias("question"), codes.alias("solutions"))
    return ingest.expand_solution_list(r, "apps").select("raw_id", "item", "text", "problem_id")


def extract_math(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "corpus").where("language_tag is null and generated_solution is not null").select("row_id", "problem", "generated_solution")
    return ingest.extract(c, "openmathinstruct_2").select("row_id", "text", "solution")


def make_documents(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "corpus").where("text is not null").select("row_id", "text", "score")
    docs, _ = ingest.documents_of(c, {"source_id": "web", "domain": "stem", "license": "mit"}, "2031-01-01", row="row_id")
    return docs.select("doc_id", "source_id", "language", "domain", "quality_score", "contamination_risk", "normalized_hash", "status", "text")


def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.exact_dedup(documents(spark, sf))[0].select("ord", "normalized_hash")


def exact_dup_removed(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.exact_dedup(documents(spark, sf))[1].select("doc_id", "duplicate_of")


def minhash_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", minhash(F.col("text")).alias("signature"))


def near_edges(spark: SparkSession, sf: str) -> DataFrame:
    sigs = dedup.signatures(dedup.with_copies(documents(spark, sf)))
    return dedup.near_edges(None, sigs=sigs).select(F.col("a.doc_id").alias("later"), F.col("b.doc_id").alias("earlier"), "band", "similarity")


def near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.near_removed(dedup.with_copies(documents(spark, sf))).select("doc_id", "duplicate_of")


def problem_cap(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.problem_cap(documents(spark, sf))[1].select("doc_id", "problem_id")


def _with_contests(d: DataFrame) -> DataFrame:
    """The python rows under the contest source, whose rows ingest and the problem cap act on."""
    return d.withColumn("source_id", F.when(F.col("domain") == "python", "codecontests_plus").otherwise(F.col("source_id")))


def canonical_order(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.contest_order(_with_contests(documents(spark, sf))).select("doc_id", F.col("ord.c").alias("is_contest"), F.col("ord.p").alias("grouped"), F.col("ord.f").alias("first_ord"), F.col("ord.h").alias("hash"))


def normalize_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", ingest.normalize(F.col("text"))["reason"].alias("reason"))


def quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Quality codes but for the syntax test, which SQL does not have."""
    d = documents(spark, sf).withColumn("_parses", F.lit(True))
    return d.select("ord", F.array_join(quality.quality_reasons(), ";").alias("codes"))


def quality_removed(spark: SparkSession, sf: str) -> DataFrame:
    return quality.apply_quality(documents(spark, sf))[1].select("doc_id", "reason_codes")


def highsignal_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rubric score, codes and verdict but for the syntax test."""
    d = quality.highsignal(documents(spark, sf).withColumn("_parses", F.lit(True)))
    return d.select("ord", "highsignal_score", F.array_join("highsignal_reasons", ";").alias("codes"), F.col("_accept").alias("accept"))


def highsignal_removed(spark: SparkSession, sf: str) -> DataFrame:
    return quality.apply_highsignal(documents(spark, sf))[1].select("doc_id", "reason_codes", "score")


def syntax_check(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the files whose tag means Python parse."""
    c = table(spark, sf, "corpus").where("generated_solution is not null").where(tx.is_python3_tag(F.col("language_tag"))).select("row_id", "generated_solution")
    return spread(c).select("row_id", python_parses(F.col("generated_solution")).alias("parses"))


def token_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.ngram_counts(table(spark, sf, "documents").where("text is not null"), DEFAULT.token_ngram)


def reference_index(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.reference_index(references(spark, sf)).groupBy("kind", "ref_id").agg(F.count("*").alias("n_grams"))


def contamination_hits(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("source_id"), "text")
    return contamination.hits(d, references(spark, sf)).select("doc_id", "matched_ref")


def contamination_report(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("source_id"), "text")
    refs = references(spark, sf)
    return contamination.report(contamination.hits(d, refs), refs).drop("benchmark_refs_missing")


def line_multiset(spark: SparkSession, sf: str) -> DataFrame:
    return train.line_counts(table(spark, sf, "corpus"), "generated_solution")


def bpe_pair_counts(spark: SparkSession, sf: str) -> DataFrame:
    return train.pair_counts(train.line_counts(table(spark, sf, "corpus"), "generated_solution"))


def bpe_best_pair(spark: SparkSession, sf: str) -> DataFrame:
    return train.best_pair(bpe_pair_counts(spark, sf))


def tokenize_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_column(table(spark, sf, "documents"), frozen_vocabulary())


def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    return count_column(table(spark, sf, "documents"), frozen_vocabulary())


def vocabulary_table(spark: SparkSession, sf: str) -> DataFrame:
    return frozen_vocabulary().table(spark).groupBy("kind").agg(F.count("*").alias("n"))


def vocabulary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return token_metrics.report(spark, frozen_vocabulary())


def synthetic_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.training_table(spark, 400)


def _lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths in UTF-8 bytes stand in for tokens, so that SQL can follow."""
    n = F.coalesce(F.octet_length("text"), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", F.when(n > 0, n + 1).otherwise(0).alias("n_packed0"))


def packing_assign(spark: SparkSession, sf: str) -> DataFrame:
    return packing.assign(_lengths(spark, sf), n_ctx=CAPACITY, order=("doc_id",))


def packing_stats(spark: SparkSession, sf: str) -> DataFrame:
    return packing.stats(packing_assign(spark, sf), n_ctx=CAPACITY).withColumn("waste_ratio", F.round("waste_ratio", 6))


def packing_shards(spark: SparkSession, sf: str) -> DataFrame:
    return packing.shards(packing_assign(spark, sf), n_ctx=CAPACITY)


def holdout_split(spark: SparkSession, sf: str) -> DataFrame:
    seq = packing_assign(spark, sf).select("seq_id").distinct()
    tail = packing.holdout(seq, tail=True).withColumnRenamed("split", "tail_split")
    return packing.holdout(seq).join(tail, "seq_id").select("seq_id", "split", "tail_split")


def packed_sequences(spark: SparkSession, sf: str) -> DataFrame:
    ids = encode_column(table(spark, sf, "documents"), frozen_vocabulary())
    return packing.sequences(ids, n_ctx=CAPACITY, order=("doc_id",))


def packed_validation(spark: SparkSession, sf: str) -> DataFrame:
    return packing.validate(packed_sequences(spark, sf))


def mixture_cap(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("source_id"), "domain", F.coalesce("n_chars", F.lit(0)).alias("token_count"))
    return mixture.mixture_cap(d, {"python": 200_000, "math": 100_000, "stem": 150_000}, order=("doc_id",))[0].select("doc_id", "domain")


def domain_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.domain_tokens(table(spark, sf, "documents"))


def domain_deviation(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.domain_deviation(table(spark, sf, "documents"))


def tokens_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.tokens_per_source(documents(spark, sf))


def subsource_share(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.subsource_share(documents(spark, sf)).withColumn("share", F.round("share", 6))


def share_applicability(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.share_applicability(table(spark, sf, "data_manifest").dropDuplicates(["source_id", "domain", "status"]))


def blocked_sources(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.blocked_sources(table(spark, sf, "data_manifest")).distinct()


def solutions_per_problem(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "corpus").select(F.lit("codecontests_plus").alias("source_id"), "problem_id", "is_correct")
    return metrics.solutions_per_problem(c, c.where("is_correct"))


def reason_histogram(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).withColumn("_parses", F.lit(True))
    return metrics.reason_histogram(quality.apply_quality(d)[1])


def reason_histogram_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Like ``reason_histogram``, with the syntax test, which SQL does not have."""
    return metrics.reason_histogram(quality.apply_quality(documents(spark, sf))[1])


def math_gap(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "mixture_summary")
    e = F.col("math_raw_estimate_vs_plan")
    return m.select("run_id", "created_at", metrics.math_gap(e["raw_estimate"], e["plan_target"]).alias("gap"))


def stage_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.funnel(pipeline.run(_with_contests(documents(spark, sf)), references(spark, sf), frozen_vocabulary()))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_binary, normalize_reasons, content_hashes, hash_equality, python3_tags, contract_missing, license_inventory, inventory_backfill, manifest_shards, ingest_filter, expand_contests, expand_parallel_solutions,
        expand_solution_lists, extract_math, make_documents, exact_dedup, exact_dup_removed, minhash_signatures, near_edges, near_dedup, problem_cap, canonical_order, quality_rules, quality_removed, highsignal_rules,
        highsignal_removed, syntax_check, token_ngrams, reference_index, contamination_hits, contamination_report, line_multiset, bpe_pair_counts, bpe_best_pair, tokenize_ids, tokenize_counts, vocabulary_table,
        vocabulary_metrics, synthetic_corpus, packing_assign, packing_stats, packing_shards, holdout_split, packed_sequences, packed_validation, mixture_cap, domain_tokens, domain_deviation, tokens_per_source,
        subsource_share, share_applicability, blocked_sources, solutions_per_problem, reason_histogram, reason_histogram_whole, math_gap, stage_funnel,
    )
}
