"""Metrics of a pipeline run, each an aggregation over inputs, kept rows and removal records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewright.config import CONTEST_SOURCE, DEFAULT, DOMAINS, Thresholds
from lodewright.operators.mixture import domain_tokens


def rate(part: Column, whole: Column) -> Column:
    """Ratio that is 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def reason_histogram(removed: DataFrame) -> DataFrame:
    """``stage, code, n`` over all reason codes of the removal records."""
    return removed.select("stage", F.explode("reason_codes").alias("code")).groupBy("stage", "code").agg(F.count("*").alias("n"))


def tokens_per_source(docs: DataFrame, tokens: str = "token_count") -> DataFrame:
    return docs.groupBy("source_id").agg(F.sum(F.coalesce(F.col(tokens), F.lit(0))).cast("bigint").alias("tokens"), F.count("*").alias("n_docs"))


def stage_rates(start: int, removed: dict[str, int]) -> list[tuple[str, int, int, float]]:
    """``(stage, removed, start, rate)``; near duplicates are relative to what exact deduplication left of the start."""
    base = {s: start for s in removed} | {"near_dedup": start - removed.get("exact_dedup", 0)}
    return [(s, n, base[s], n / base[s] if base[s] else 0.0) for s, n in removed.items()]


def domain_deviation(docs: DataFrame, targets: dict[str, int] | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """``domain, tokens, target, deviation`` with a total row."""
    targets = targets or t.mixture_10m
    goal = docs.sparkSession.createDataFrame([(d, int(targets.get(d, 0))) for d in DOMAINS], "domain string, target bigint")
    rows = domain_tokens(docs).join(goal, "domain").select("domain", "tokens", "target", (F.col("tokens") - F.col("target")).alias("deviation"))
    total = rows.agg(F.lit("total").alias("domain"), F.sum("tokens").alias("tokens"), F.sum("target").alias("target"), F.sum("deviation").alias("deviation"))
    return rows.unionByName(total)


def subsource_share(docs: DataFrame, tokens: str = "token_count") -> DataFrame:
    """Share of each source in its domain's tokens, with the domain's number of sources."""
    per = docs.groupBy("domain", "source_id").agg(F.sum(F.coalesce(F.col(tokens), F.lit(0))).cast("bigint").alias("tokens"))
    w = Window.partitionBy("domain")  # one row per source
    return per.withColumn("share", rate(F.col("tokens"), F.sum("tokens").over(w))).withColumn("n_sources", F.count("*").over(w))


def share_applicability(inventory: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Per domain the number of sources that are not blocked, and whether the share rule applies."""
    n = inventory.where(F.coalesce(F.col("status"), F.lit("")) != "blocked").groupBy("domain").agg(F.count("*").alias("available_sources"))
    ok = F.col("available_sources") >= t.share_min_sources
    return n.select("domain", "available_sources", ok.alias("applicable"), F.when(ok, "applicable").otherwise("not_applicable").alias("status"))


def solutions_per_problem(before: DataFrame, after: DataFrame) -> DataFrame:
    """``problem_id, before, after``: contest documents per problem."""
    both = before.select("source_id", "problem_id", F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select("source_id", "problem_id", F.lit(0).alias("b"), F.lit(1).alias("a")))
    return both.where((F.col("source_id") == CONTEST_SOURCE) & (F.col("problem_id") != "")).groupBy("problem_id").agg(F.sum("b").alias("before"), F.sum("a").alias("after"))


def solutions_summary(per: DataFrame) -> DataFrame:
    """One row over ``solutions_per_problem``, which has a row per problem and goes to a file of its own."""
    return per.agg(
        F.count("*").alias("n_problems"), F.count_if(F.col("after") == 0).alias("n_emptied"), F.coalesce(F.sum("before"), F.lit(0)).alias("before"), F.coalesce(F.sum("after"), F.lit(0)).alias("after"),
        F.max("before").alias("most_before"), F.max("after").alias("most_after"),
    )


def blocked_sources(inventory: DataFrame) -> DataFrame:
    return inventory.where("status = 'blocked'").select("source_id").orderBy("source_id")


def math_gap(raw_estimate: Column, plan_target: Column) -> Column:
    """Estimate minus plan, nulls as 0."""
    return F.coalesce(raw_estimate, F.lit(0)) - F.coalesce(plan_target, F.lit(0))
