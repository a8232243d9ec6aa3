"""License gate, source inventory and the contract check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.config import LICENSE_ALLOWLIST, REQUIRED_FIELDS
from lodewright.functions.text import reasons


def contract_errors(df: DataFrame, required: tuple[str, ...] = REQUIRED_FIELDS) -> Column:
    """``missing X`` for each required field that the table does not have (presence, not type, is checked)."""
    return F.array(*[F.lit(f"missing {f}") for f in required if f not in df.columns]).cast("array<string>")


def missing_values(df: DataFrame, required: tuple[str, ...] = REQUIRED_FIELDS) -> Column:
    """``missing X`` for each required field that is absent or null in the row."""
    return reasons(*[(f"missing {f}", F.col(f).isNull() if f in df.columns else F.lit(True)) for f in required])


def license_decision(allowlist: tuple[str, ...] = LICENSE_ALLOWLIST) -> tuple[Column, Column]:
    """``(status, reason)`` from ``decision, identity_status, license, block_reason``; the first rule that applies decides."""
    rules = (
        (F.coalesce(F.col("decision") == "reject", F.lit(False)), F.coalesce("block_reason", F.lit("rejected"))),
        (F.coalesce(F.col("identity_status"), F.lit("")) != "verified", F.lit("identity unresolved")),
        (F.coalesce(F.col("license"), F.lit("")) == "", F.lit("license unverifiable")),
        (~F.coalesce(F.col("license").isin(*allowlist), F.lit(False)), F.concat(F.lit("license not on allowlist: "), F.col("license"))),
    )
    status, reason = F.lit("admitted"), F.lit(None).cast("string")
    for cond, why in reversed(rules):
        status, reason = F.when(cond, F.lit("blocked")).otherwise(status), F.when(cond, why).otherwise(reason)
    return status, reason


def inventory(sources: DataFrame, allowlist: tuple[str, ...] = LICENSE_ALLOWLIST) -> DataFrame:
    """Source inventory: the registry with status, reason and contract errors."""
    for c in ("decision", "block_reason"):
        if c not in sources.columns:
            sources = sources.withColumn(c, F.lit(None).cast("string"))
    status, reason = license_decision(allowlist)
    out = sources.withColumn("_status", status).withColumn("_reason", reason).drop("status", "block_reason", "decision")
    return out.withColumnRenamed("_status", "status").withColumnRenamed("_reason", "block_reason").withColumn("contract_errors", missing_values(sources))


def backfill_tokens(inv: DataFrame, docs: DataFrame) -> DataFrame:
    """Set ``token_count`` of each source to the tokens of its documents, 0 if it has none, and ``fetch_rows`` to their number."""
    n = docs.groupBy("source_id").agg(F.sum(F.coalesce("token_count", F.lit(0))).alias("_t"), F.count("*").alias("_n"))
    return inv.drop("token_count", "fetch_rows").join(n, "source_id", "left").select("*", F.coalesce("_t", F.lit(0)).alias("token_count"), F.coalesce("_n", F.lit(0)).alias("fetch_rows")).drop("_t", "_n")
