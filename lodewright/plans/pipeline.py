"""The whole pipeline: one pass over the texts gives each document's facts, the stages decide on those alone.

The verdicts are one narrow table keyed by document id; texts are read again only where the kept documents
themselves are asked for. Ids are unique.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.config import CONTEST_SOURCE, DEFAULT, Thresholds
from lodewright.functions.hashing import minhash
from lodewright.operators import contamination, dedup, ingest, metrics, mixture, packing, quality
from lodewright.operators.base import checkpoint, spread
from lodewright.tokenizer.model import Vocabulary, encode_column, token_count

STAGES = ("ingest", "problem_cap", "exact_dedup", "near_dedup", "quality", "contamination", "highsignal")
_RECORD = {"doc_id": "string", "source_id": "string", "stage": "string", "reason_codes": "array<string>", "duplicate_of": "string", "problem_id": "string", "score": "double", "matched_ref": "string"}


@dataclass
class Result:
    """``start``: the documents that came in, ``kept``: those that stay, both without texts; ``removed``: all records;
    ``hits``: contamination; ``source``: the documents with their texts."""

    start: DataFrame
    kept: DataFrame
    removed: DataFrame
    hits: DataFrame
    placed: DataFrame | None
    counts: dict[str, tuple[int, int]]
    t: Thresholds
    source: DataFrame
    vocabulary: Vocabulary | None

    @property
    def docs(self) -> DataFrame:
        """The kept documents, marked clear; with ``token_ids`` if the run has a vocabulary. Texts are read, and joined with the verdicts, here and only here."""
        ids = self.kept.select("doc_id", F.col("token_count").alias("_n"))
        out = self.source.join(ids, "doc_id").withColumn("token_count", F.col("_n")).withColumn("contamination_risk", F.lit("clear")).select(*self.source.columns)
        return out if self.vocabulary is None else out.join(encode_column(out, self.vocabulary), "doc_id")


def _record(df: DataFrame) -> DataFrame:
    """A removal record with all columns; those a stage does not have are null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in _RECORD.items()])


def facts(docs: DataFrame, t: Thresholds = DEFAULT, vocabulary: Vocabulary | None = None) -> DataFrame:
    """What the stages need to know of each document, from one pass over the texts; written down once."""
    d = quality.highsignal(quality.with_syntax(ingest.with_reason(spread(docs))), t)
    n = F.coalesce(F.col("token_count"), F.lit(0)) if vocabulary is None else token_count(F.col("text"), vocabulary)
    none = F.when(F.size("highsignal_reasons") == 0, F.array(F.lit("below_threshold"))).otherwise(F.col("highsignal_reasons"))
    return checkpoint(
        d.select(
            "doc_id", "source_id", "domain", "problem_id", "normalized_hash", "ord", F.col("token_count").alias("given_count"), n.alias("n_tokens"), F.col("_why").alias("ingest"), quality.quality_reasons(t).alias("quality"),
            none.alias("highsignal"), F.col("highsignal_score").alias("score"), F.col("_accept").alias("accept"), minhash(F.col("text"), t.permutations, t.shingle).alias("sig"),
        )
    )


def run(docs: DataFrame, refs: DataFrame, vocabulary: Vocabulary | None = None, t: Thresholds = DEFAULT) -> Result:
    """Run all stages on documents (schema ``config.DOCUMENT``) against reference texts (``ref_id, ref_ord, text``).

    Stage order is fixed: it decides which rows survive. A stage's verdicts are pinned where the next one
    compares documents, so a lost executor does not send the job back to the start.
    """
    known = facts(docs, t, vocabulary)
    slim = known.drop("sig", "quality", "highsignal", "score", "accept")
    now = slim.where("ingest is null")
    # Only contest documents are capped.
    contest = F.coalesce(F.col("source_id") == CONTEST_SOURCE, F.lit(False)) & (F.col("problem_id") != "")
    capped = dedup.problem_rank(now.where(contest)).where(F.col("_rn") > t.problem_cap).select("doc_id", "problem_id")
    capped = checkpoint(capped)
    now = now.join(capped.select("doc_id"), "doc_id", "left_anti")
    exact = checkpoint(dedup.exact_removed(dedup.contest_order(now), pin=False).select("doc_id", "duplicate_of"))
    gone = capped.select("doc_id").unionByName(exact.select("doc_id"))
    sigs = known.where("ingest is null").join(gone, "doc_id", "left_anti").select(F.struct("source_id", "doc_id").alias("k"), "sig")
    near = checkpoint(dedup.near_removed(sigs, t).select("doc_id", "duplicate_of"))
    hits = checkpoint(contamination.hits(docs, refs, t))
    early = [(capped, "problem_cap"), (exact, "exact_dedup"), (near, "near_dedup")]
    marks = None
    for df, stage in early:
        one = df.select("doc_id", F.lit(stage).alias("early"), *[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in ("duplicate_of",)])
        marks = one if marks is None else marks.unionByName(one)
    found = hits.select("doc_id", "matched_ref")
    v = known.drop("sig").join(marks, "doc_id", "left").join(found, "doc_id", "left")
    stage = (
        F.when(F.col("ingest").isNotNull(), "ingest").when(F.col("early").isNotNull(), F.col("early")).when(F.size("quality") > 0, "quality")
        .when(F.col("matched_ref").isNotNull(), "contamination").when(~F.col("accept"), "highsignal")
    )
    codes = {"ingest": F.array("ingest"), "problem_cap": F.array(F.lit("problem_cap")), "exact_dedup": F.array(F.lit("exact_duplicate")), "near_dedup": F.array(F.lit("near_duplicate")), "contamination": F.array(F.lit("contaminated")), "quality": F.col("quality"), "highsignal": F.col("highsignal")}
    reason = F.lit(None).cast("array<string>")
    for name, value in codes.items():
        reason = F.when(F.col("stage") == name, value).otherwise(reason)
    only = lambda name, c: F.when(F.col("stage") == name, F.col(c))
    v = checkpoint(
        v.withColumn("stage", stage).select(
            "doc_id", "source_id", "domain", "ord", "given_count", "n_tokens", "stage", reason.alias("reason_codes"), "duplicate_of", F.col("problem_id").alias("problem"), only("problem_cap", "problem_id").alias("problem_id"),
            only("highsignal", "score").alias("score"), only("contamination", "matched_ref").alias("matched_ref"),
        )
    )
    lost = {r["stage"]: r["n"] for r in v.groupBy("stage").agg(F.count("*").alias("n")).collect()}  # one row a stage
    counts, n = {}, sum(lost.values())
    for s in STAGES:
        counts[s] = (n, lost.get(s, 0))
        n -= lost.get(s, 0)
    row = lambda df, count: df.select("doc_id", "source_id", "domain", F.col("problem").alias("problem_id"), "ord", count.alias("token_count"))
    start = row(v, F.col("n_tokens") if vocabulary is not None else F.col("given_count"))
    # Kept texts are encoded with an end mark, which even an empty one has.
    kept = row(v.where("stage is null"), F.col("n_tokens") + 1 if vocabulary is not None else F.col("given_count"))
    removed = _record(v.where("stage is not null"))
    dirty = removed.where("stage = 'contamination'").select("doc_id", "source_id", "matched_ref", F.lit("removed").alias("action"), F.lit(False).alias("unresolved"))
    return Result(start, kept, removed, dirty, _placed(kept, t) if vocabulary is not None else None, counts, t, docs, vocabulary)


def _placed(kept: DataFrame, t: Thresholds) -> DataFrame:
    return packing.assign(kept.select("source_id", "doc_id", F.col("token_count").alias("n_packed0")), n_ctx=t.n_ctx)


def funnel(r: Result) -> DataFrame:
    """``step, stage, n_in, n_removed, n_kept``: one row per stage, and one of packing if tokenised (texts without tokens are not placed)."""
    rows = [(k, s, *r.counts[s], r.counts[s][0] - r.counts[s][1]) for k, s in enumerate(STAGES)]
    if r.placed is not None:
        n, kept = r.kept.count(), r.placed.count()
        rows.append((len(rows), "packing", n, n - kept, kept))
    return r.docs.sparkSession.createDataFrame(rows, "step int, stage string, n_in bigint, n_removed bigint, n_kept bigint")


def with_ceiling(r: Result, targets: dict[str, int] | None = None) -> Result:
    """Cap the mixture and pack again, so the packing figures are those of what is kept."""
    taken = mixture.mixture_taken(r.kept, targets or r.t.mixture_ceiling)
    kept = checkpoint(r.kept.join(taken, "doc_id", "left_semi"))
    gone = r.kept.join(taken, "doc_id", "left_anti").select("doc_id", "source_id", F.lit("mixture_cap").alias("stage"), F.array(F.lit("over_target")).alias("reason_codes"))
    return replace(r, kept=kept, removed=r.removed.unionByName(_record(gone)), placed=_placed(kept, r.t) if r.placed is not None else None)


def rematerialise(docs: DataFrame, refs: DataFrame, vocabulary: Vocabulary, targets: dict[str, int], t: Thresholds = DEFAULT) -> tuple[Result, DataFrame]:
    """``(result, domains)``: the stages run anew on authorised documents and cut to training targets; ``domains`` are the tokens of each domain."""
    r = with_ceiling(run(docs, refs, vocabulary, t), targets)
    return r, mixture.domain_tokens(r.kept)


def metrics_report(r: Result, inventory: DataFrame, registry: dict | None = None) -> dict:
    """The run's metrics as one mapping (small aggregates, collected)."""
    registry = registry or {}
    pairs = lambda df: {x[0]: x[1] for x in df.collect()}
    start = r.counts["ingest"][0]
    codes: dict[str, dict[str, int]] = {}
    for x in metrics.reason_histogram(r.removed).collect():
        codes.setdefault(x["stage"], {})[x["code"]] = x["n"]
    rates = {s: {"removed": n, "start": base, "rate": q, "reason_codes": codes.get(s, {})} for s, n, base, q in metrics.stage_rates(start, {s: c[1] for s, c in r.counts.items()})}
    domains = {x["domain"]: x for x in metrics.domain_deviation(r.kept, t=r.t).collect()}
    estimate, plan = registry.get("math_raw_estimate_tokens"), registry.get("math_plan_target_tokens")
    return {
        "stages": rates,
        "raw_token_count_per_source": pairs(metrics.tokens_per_source(r.start)),
        "post_pipeline_tokens_per_source": pairs(metrics.tokens_per_source(r.kept)),
        "post_pipeline_tokens_per_domain": {d: x["tokens"] for d, x in domains.items() if d != "total"},
        "mixture": {
            "target_10m": {d: x["target"] for d, x in domains.items()}, "actual": {d: x["tokens"] for d, x in domains.items()}, "deviation_tokens": {d: x["deviation"] for d, x in domains.items() if d != "total"},
            "target_13b": r.t.mixture_ceiling, "math_raw_estimate_vs_plan": {"raw_estimate": estimate, "plan_target": plan, "gap": (estimate or 0) - (plan or 0)}, "python_raw_estimate": registry.get("python_raw_estimate_tokens"),
        },
        "contamination_hits": contamination_summary(r),
        "codecontests_solutions_per_problem": metrics.solutions_summary(metrics.solutions_per_problem(r.start, r.kept)).first().asDict(),
        "packing": packing.stats(r.placed, n_ctx=r.t.n_ctx).first().asDict() if r.placed is not None else {},
        "max_subsource_share": {x["domain"]: x.asDict() for x in metrics.share_applicability(inventory, r.t).collect()},
        "blocked_sources": [x[0] for x in metrics.blocked_sources(inventory).collect()],
    }


def contamination_summary(r: Result) -> dict:
    return {"n_hits": r.hits.count(), "n_unresolved": 0}
