"""Thresholds and schemas of the corpus pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

# Results depend on them.
DOMAINS = ("python", "math", "stem")
CONTEST_SOURCE = "codecontests_plus"
MATH_SOURCE = "openmathinstruct_2"
LICENSE_ALLOWLIST = ("apache-2.0", "mit", "bsd-2-clause", "bsd-3-clause", "cc-by-4.0", "cc-by-sa-4.0", "odc-by-1.0")
REQUIRED_FIELDS = (
    "source_id", "url", "license", "provenance", "collection_date", "language", "domain", "quality_score", "contamination_risk", "raw_hash", "normalized_hash", "token_count",
)


@dataclass(frozen=True)
class Thresholds:
    min_chars: int = 32
    max_chars: int = 200_000
    min_quality_score: float = 2.0
    openmath_min_solution_chars: int = 20
    shingle: int = 5
    permutations: int = 128
    band_size: int = 4
    near_cutoff: float = 0.8
    problem_cap: int = 8
    token_ngram: int = 12
    char_window: int = 50
    printable_ratio: float = 0.85
    score_min: float = 3.0
    trivial_max_lines: int = 4
    math_min_solution_chars: int = 20
    math_long_solution_chars: int = 40
    share_min_sources: int = 3
    n_ctx: int = 4096
    shard_target_tokens: int = 1_000_000
    seed: int = 42
    mixture_10m: dict[str, int] = field(default_factory=lambda: {"python": 7_690_000, "math": 1_540_000, "stem": 770_000})
    mixture_ceiling: dict[str, int] = field(default_factory=lambda: {"python": 10_000_000_000, "math": 2_000_000_000, "stem": 1_000_000_000})
    hash_mode: str = "parity"  # or "sha2": cheaper, same equalities, another order under the problem cap

    def with_(self, **changes: object) -> Thresholds:
        return replace(self, **changes)


DEFAULT = Thresholds()

DOCUMENT = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("doc_id", T.StringType()), ("source_id", T.StringType()), ("url", T.StringType()), ("license", T.StringType()), ("provenance", T.StringType()),
            ("collection_date", T.StringType()), ("language", T.StringType()), ("domain", T.StringType()), ("stem_bucket", T.StringType()), ("quality_score", T.DoubleType()),
            ("contamination_risk", T.StringType()), ("raw_hash", T.StringType()), ("normalized_hash", T.StringType()), ("token_count", T.IntegerType()), ("text", T.StringType()),
            ("status", T.StringType()), ("problem_id", T.StringType()), ("is_correct", T.BooleanType()), ("language_tag", T.StringType()), ("solution", T.StringType()), ("ord", T.LongType()),
        )
    ]
)
