"""Problem 4: mixing sources to target shares by Poisson replication.

Per run the target tokens of a domain over the tokens its sources hold give the domain's repetition
rate. Where a domain would need more than ``max_repeats`` passes, all targets of the run are scaled
down together, so the shares hold. Each document is then repeated k times, k drawn by inverting a
Poisson distribution at a uniform number hashed from seed, run and document; the distribution is cut
off at ``max_repeats`` and its mean set so that the cut-off mean is the rate wanted, hence no source
is repeated more often than allowed. The copies are shuffled globally by a range partition on a hash.
Hashes are digits of md5, so that other engines draw the same copies.

Defined results: the last record of a source (by ``recorded_at``, then ``manifest_id``) and of a run
(by ``created_at``) counts; sources that are not admitted or have no positive token count are left
out; a null target of a domain counts as none wanted; a null or non-positive ``max_repeats`` counts
as ``default_repeats``. Runs without any target give no rows. Documents of null or unknown sources
are left out; a document of null id hashes like any other value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOMAINS = ("python", "math", "stem")
MAX_RATES = 200_000  # rows of the rate table that may be broadcast


def poisson_steps(rate: float, cap: int) -> list[float]:
    """Cumulative probabilities P(k <= j), j = 0..cap-1, of a Poisson count cut off at ``cap`` whose mean is ``rate``."""
    if rate <= 0:
        return [1.0] * cap
    if rate >= cap:
        return [0.0] * cap

    def cdf(mu: float) -> list[float]:
        p, total, out = math.exp(-mu), 0.0, []
        for j in range(cap):
            total += p
            out.append(min(1.0, total))
            p *= mu / (j + 1)
        return out

    low, high = 0.0, max(1.0, rate)
    while sum(1 - c for c in cdf(high)) < rate:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(1 - c for c in cdf(mid)) < rate else (low, mid)
    return cdf(high)


def _digits(seed: int, *cols: str) -> Column:
    """A number below 2**52 from md5 of the seed and the columns, nulls as empty."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def _uniform(seed: int) -> Column:
    return _digits(seed, "run_id", "doc_id") / F.lit(float(1 << 52))


def _last(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last record of each key; inventories and run logs are small, records of one key few."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def rates(manifest: DataFrame, runs: DataFrame, *, default_repeats: int = 4) -> DataFrame:
    """``run_id, source, domain, wanted, planned, rate, max_repeats, source_tokens, steps`` per run and admitted source.

    A wanted domain without one has a row of a null source.
    """
    src = manifest.select(
        F.lower(F.trim("source_id")).alias("source"), F.lower(F.trim("domain")).alias("domain"), F.col("token_count").alias("source_tokens"),
        F.lower("status").alias("status"), "recorded_at", "manifest_id",
    ).where("source is not null")
    src = _last(src, "source", F.desc_nulls_last("recorded_at"), F.desc_nulls_last("manifest_id"))
    src = src.where((F.col("status") == "admitted") & (F.col("source_tokens") > 0)).select("source", "domain", "source_tokens")
    run = _last(runs.where("run_id is not null"), "run_id", F.desc_nulls_last("created_at"))
    repeats = F.when(F.col("max_repeats") > 0, F.col("max_repeats")).otherwise(F.lit(default_repeats)).alias("max_repeats")
    want = run.select("run_id", repeats, F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), F.col(f"target_10m.{d}").alias("wanted")) for d in DOMAINS])).alias("t"))
    want = want.select("run_id", "max_repeats", "t.domain", "t.wanted").where("wanted > 0")
    held = src.groupBy("domain").agg(F.sum("source_tokens").alias("held"))
    each = want.join(held, "domain", "left")
    per_run = Window.partitionBy("run_id")
    scale = F.least(F.lit(1.0), F.min(F.col("max_repeats") * F.col("held") / F.col("wanted")).over(per_run))
    each = each.withColumn("planned", F.when(F.col("held") > 0, F.col("wanted") * scale).otherwise(F.lit(0.0))).withColumn("rate", F.coalesce(F.col("planned") / F.col("held"), F.lit(0.0)))
    # One distribution per run and domain: a handful of rows per run, inverted on the driver.
    solved = [(r["run_id"], r["domain"], float(r["wanted"]), r["planned"], r["rate"], int(r["max_repeats"]), poisson_steps(r["rate"], int(r["max_repeats"]))) for r in each.collect()]
    spark = manifest.sparkSession
    table = spark.createDataFrame(solved, "run_id bigint, domain string, wanted double, planned double, rate double, max_repeats int, steps array<double>")
    return table.join(src, "domain", "left")


def mixture(documents: DataFrame, rate_table: DataFrame, *, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None) -> DataFrame:
    """``run_id, doc_id, source, domain, copy, size, place``: every copy, in shuffled order of ``place`` within a run."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) if size is None else size
    docs = documents.select(F.col(id_col).alias("doc_id"), F.lower(F.trim(F.col(source_col))).alias("source"), size.cast("bigint").alias("size"))
    r = rate_table.select("run_id", "source", "domain", "steps")
    drawn = docs.join(F.broadcast(r) if rate_table.count() <= MAX_RATES else r, "source")
    k = F.size(F.filter("steps", lambda c: c <= F.col("_u")))
    drawn = drawn.withColumn("_u", _uniform(seed)).withColumn("_k", k).where("_k > 0")
    out = drawn.select("run_id", "doc_id", "source", "domain", F.explode(F.sequence(F.lit(1), F.col("_k"))).alias("copy"), "size")
    return out.withColumn("place", _digits(seed + 1, "run_id", "doc_id", "copy")).repartitionByRange("run_id", "place").sortWithinPartitions("run_id", "place")


def shares(documents: DataFrame, rate_table: DataFrame, runs: DataFrame, *, seed: int = 42) -> DataFrame:
    """Per run and domain: the share wanted, the share reached by the drawn copies, and the recorded one.

    A source's reached tokens are its full count times the passes over its documents that were drawn;
    ``drawn_bytes`` are the sizes of the copies themselves.
    """
    docs = documents.select(F.lower(F.trim("source")).alias("source"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"), "doc_id")
    base = docs.groupBy("source").agg(F.sum("size").alias("base"))
    r = rate_table.select("run_id", "source", "steps")
    drawn = docs.join(F.broadcast(r) if rate_table.count() <= MAX_RATES else r, "source").withColumn("_u", _uniform(seed))
    drawn = drawn.groupBy("run_id", "source").agg(F.sum(F.size(F.filter("steps", lambda c: c <= F.col("_u"))) * F.col("size")).alias("drawn"))
    per = rate_table.join(drawn, ["run_id", "source"], "left").join(base, "source", "left")
    passes = F.when(F.col("base") > 0, F.coalesce("drawn", F.lit(0)) / F.col("base")).otherwise(F.lit(0.0))
    per = per.withColumn("passes", passes).withColumn("reached", passes * F.coalesce("source_tokens", F.lit(0)))
    dom = per.groupBy("run_id", "domain").agg(
        F.first("wanted").alias("wanted_tokens"), F.first("planned").alias("planned_tokens"), F.sum("reached").alias("reached_tokens"), F.sum(F.coalesce("drawn", F.lit(0))).alias("drawn_bytes"),
        F.first("rate").alias("rate"), F.max("passes").alias("most_passes"), F.first("max_repeats").alias("max_repeats"),
    )
    last = _last(runs.where("run_id is not null"), "run_id", F.desc_nulls_last("created_at"))
    actual = last.select("run_id", F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), F.col(f"actual.{d}").alias("actual_tokens")) for d in DOMAINS])).alias("a")).select("run_id", "a.domain", "a.actual_tokens")
    out = dom.join(actual, ["run_id", "domain"], "left")
    w = Window.partitionBy("run_id")
    share = lambda c: F.round(F.col(c) / F.nullif(F.sum(c).over(w), F.lit(0)), 6)
    return out.select(
        "run_id", "domain", "max_repeats", F.round("rate", 6).alias("rate"), F.round("most_passes", 6).alias("most_passes"), "wanted_tokens", F.round("planned_tokens", 3).alias("planned_tokens"),
        F.round("reached_tokens", 1).alias("reached_tokens"), "drawn_bytes", "actual_tokens", share("wanted_tokens").alias("wanted_share"), share("reached_tokens").alias("reached_share"),
        share("drawn_bytes").alias("drawn_share"), share("actual_tokens").alias("actual_share"),
    )
