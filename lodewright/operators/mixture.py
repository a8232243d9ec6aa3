"""Mixture cap per domain by greedy skip-fit, and domain sums."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodewright.config import DOMAINS
from lodewright.operators.base import checkpoint, ordered_blocks


def _running(df: DataFrame, order: tuple[str, ...], rows_a_block: int) -> DataFrame:
    """Add ``cum``, the running sum of ``n`` per domain in order, in two levels: within blocks, then over block sums."""
    blocks = ordered_blocks(df, "domain", *order, rows_a_block=rows_a_block)
    sums = blocks.groupBy("domain", "_block").agg(F.sum("n").alias("s"))
    # One row per domain and block.
    before = Window.partitionBy("domain").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("domain", "_block", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("domain", "_block").orderBy(*order)
    return blocks.join(sums, ["domain", "_block"]).withColumn("cum", F.col("base") + F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0))).drop("base", "_block")


def mixture_cap(df: DataFrame, targets: dict[str, int], *, order: tuple[str, ...] = ("source_id", "doc_id"), tokens: str = "token_count", rows_a_block: int = 50_000, at_once: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """``(kept, removed)``: in order, a row is kept if its domain's tokens stay within the target; rows that do not fit are skipped, later smaller ones may fit.

    Each round takes all rows up to the first one that overflows, then goes on behind it with the rows that still
    fit in what is left. The first round is a running sum over all rows; what is left after it is less than one row's
    tokens, so few rows still fit. As soon as at most ``at_once`` do, one task per domain finishes the fold over
    them; rounds go on only while there are more. Domains without a target have target 0. Ids are unique.
    """
    taken = mixture_taken(df, targets, order=order, tokens=tokens, rows_a_block=rows_a_block, at_once=at_once)
    kept = df.join(taken, "doc_id", "left_semi")
    removed = df.join(taken, "doc_id", "left_anti").select("doc_id", "source_id", F.lit("mixture_cap").alias("stage"), F.array(F.lit("over_target")).alias("reason_codes"))
    return kept, removed


def _fold(order: tuple[str, ...]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), na_position="first")
        left, ok = int(pdf["left"].iat[0]), []
        for n in pdf["n"].tolist():
            ok.append(n <= left)
            left -= n if ok[-1] else 0
        return pdf.loc[ok, ["doc_id"]]

    return run


def mixture_taken(df: DataFrame, targets: dict[str, int], *, order: tuple[str, ...] = ("source_id", "doc_id"), tokens: str = "token_count", rows_a_block: int = 50_000, at_once: int = 500_000) -> DataFrame:
    """``doc_id`` of the rows that ``mixture_cap`` keeps; needs no text."""
    slim = df.select("doc_id", F.coalesce("domain", F.lit("")).alias("domain"), *[c for c in order if c != "doc_id"], F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("n"))
    goal = F.lit(0).cast("bigint")
    for d, v in targets.items():
        goal = F.when(F.col("domain") == d, F.lit(v).cast("bigint")).otherwise(goal)
    rest = slim.withColumn("left", goal)
    kinds = dict(slim.dtypes)
    key = F.struct(*[F.col(c) for c in order])
    taken: DataFrame | None = None
    while True:
        run = checkpoint(_running(rest.where(F.col("n") <= F.col("left")), order, rows_a_block))
        over = run.where(F.col("cum") > F.col("left")).groupBy("domain").agg(F.min(key).alias("stop"))
        run = run.join(over, "domain", "left")
        good = checkpoint(run.where(F.col("stop").isNull() | (key < F.col("stop"))).select("doc_id", "domain", "n"))
        taken = good.select("doc_id") if taken is None else taken.unionByName(good.select("doc_id"))
        used = good.groupBy("domain").agg(F.sum("n").alias("used"))
        behind = run.where(key > F.col("stop")).join(used, "domain", "left")
        rest = checkpoint(behind.select("doc_id", "domain", *[c for c in order if c != "doc_id"], "n", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left")).where(F.col("n") <= F.col("left")))
        if rest.count() <= at_once:
            # Sorted in the task by the bytes of texts, as the JVM sorts them; ids of other kinds as they are.
            raw = rest.select("domain", "doc_id", "n", "left", *[(F.encode(c, "UTF-8") if kinds[c] == "string" else F.col(c)).alias(f"_{k}") for k, c in enumerate(order)])
            last = raw.groupBy("domain").applyInPandas(_fold(tuple(f"_{k}" for k in range(len(order)))), f"doc_id {kinds['doc_id']}")
            return checkpoint(taken.unionByName(last))


def domain_tokens(df: DataFrame, tokens: str = "token_count") -> DataFrame:
    """``domain, tokens`` for the known domains, 0 where there is none."""
    known = df.sparkSession.createDataFrame([(d,) for d in DOMAINS], "domain string")
    sums = df.groupBy("domain").agg(F.sum(F.coalesce(F.col(tokens), F.lit(0))).cast("bigint").alias("tokens"))
    return known.join(sums, "domain", "left").select("domain", F.coalesce("tokens", F.lit(0)).alias("tokens"))
