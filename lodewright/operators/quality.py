"""Quality rules with reason codes, and the high-signal rubric.

Both are column expressions; only the syntax test needs Python, and only for rows of domain python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.config import DEFAULT, MATH_SOURCE, Thresholds
from lodewright.functions import text as tx
from lodewright.functions.code import python_parses


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _code() -> Column:
    return F.coalesce(F.when(F.col("solution") != "", F.col("solution")), _text())


def with_syntax(df: DataFrame) -> DataFrame:
    """Add ``_parses`` for rows of domain python (null for others), so both users share one test.

    The UDF gets a null argument for other domains, which it answers without parsing.
    """
    if "_parses" in df.columns:
        return df
    is_python = F.coalesce(F.col("domain") == "python", F.lit(False))
    return df.withColumn("_parses", F.when(is_python, python_parses(F.when(is_python, _code()))))


def quality_reasons(t: Thresholds = DEFAULT) -> Column:
    """All codes that apply, in their fixed order; needs ``_parses``."""
    python = F.col("domain") == "python"
    return tx.reasons(
        ("too_short", F.length(_text()) < t.min_chars),
        ("too_long", F.length(_text()) > t.max_chars),
        ("low_edu_score", F.col("quality_score") < t.min_quality_score),
        ("syntax_invalid", python & ~F.col("_parses")),
        ("openmath_trivial", (F.col("source_id") == MATH_SOURCE) & (F.length(F.coalesce("solution", F.lit(""))) < t.openmath_min_solution_chars)),
        ("incorrect_solution", ~F.col("is_correct")),
        ("not_python", python & (F.col("language_tag") != "") & ~F.lower("language_tag").isin("python", "python3", "py")),
        ("non_english", tx.non_latin(_text())),
        ("os_io_boilerplate", python & tx.matches(_text(), tx.OS_IO)),
    )


def apply_quality(df: DataFrame, t: Thresholds = DEFAULT) -> tuple[DataFrame, DataFrame]:
    scored = with_syntax(df).withColumn("_reasons", quality_reasons(t))
    kept = scored.where(F.size("_reasons") == 0).drop("_reasons")
    removed = scored.where(F.size("_reasons") > 0).select("doc_id", "source_id", F.lit("quality").alias("stage"), F.col("_reasons").alias("reason_codes"))
    return kept, removed


def highsignal(df: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Add ``highsignal_score, highsignal_reasons, _accept``. Each step of the rubric is one column."""
    text, code = _text(), _code()
    python, math, stem = (F.coalesce(F.col("domain") == d, F.lit(False)) for d in ("python", "math", "stem"))
    n_solution = F.length(F.coalesce("solution", F.lit("")))
    other = python & tx.matches(text, tx.OTHER_LANG)
    tutorial = tx.matches(text, tx.TUTORIAL)
    cp_text = tx.matches(text, tx.CP_IO)
    utility = (tx.matches(text, tx.UTILITY_IO) | tx.matches(text, tx.OPEN_FILE)) & ~cp_text
    cp_code = python & tx.matches(code, tx.CP_IO)
    named = F.coalesce(F.col("problem_id") != "", F.lit(False)) | F.lower(text).contains("problem")
    trivial = python & ~cp_code & (tx.nonempty_lines(code) <= t.trivial_max_lines) & ~code.rlike(tx.CONTROL) & ~named
    broken = python & ~F.coalesce("_parses", F.lit(True))
    thin = math & (n_solution < t.math_min_solution_chars)
    solid = math & ~thin & (tx.matches(text, tx.MATH_HINT) | (n_solution >= t.math_long_solution_chars))
    sparse = stem & ~(tx.matches(text, tx.ALGO_HINT) | tx.matches(text, tx.MATH_HINT))
    flags = {"o": other, "t": tutorial, "u": utility, "c": cp_code, "r": trivial, "b": broken, "m": thin, "s": solid, "d": sparse}
    df = with_syntax(df).withColumn("_f", F.struct(*[v.alias(k) for k, v in flags.items()]))
    f = lambda k: F.col(f"_f.{k}")
    # 4, zeroed by tutorials and utilities, lifted by contest I/O, lowered by triviality and so on, in this order.
    score = F.when(f("t") | f("u"), F.lit(0.0)).otherwise(F.lit(4.0))
    score = F.when(f("c"), F.lit(4.0)).otherwise(score)
    score = F.when(f("r") | f("b"), F.least(score, F.lit(1.0))).otherwise(score)
    score = F.when(f("m"), F.least(score, F.lit(1.0))).when(f("s"), F.lit(4.0)).otherwise(score)
    score = F.when(f("d"), F.least(score, F.lit(1.0))).otherwise(score)
    codes = tx.reasons(
        ("library_tutorial", f("t")), ("utility_io", f("u")), ("cp_stdin_stdout_keep", f("c")), ("trivial", f("r")), ("unparseable_for_signal", f("b")), ("math_thin", f("m")), ("stem_not_reasoning_dense", f("d")),
    )
    df = df.withColumn("highsignal_score", F.when(f("o"), F.lit(0.0)).otherwise(score))
    df = df.withColumn("highsignal_reasons", F.when(f("o"), F.array(F.lit("other_language"))).otherwise(codes))
    accept = (F.col("highsignal_score") + 1e-9 >= t.score_min) & ~f("o") & ~f("t") & ~f("u")
    return df.withColumn("_accept", accept).drop("_f")


def apply_highsignal(df: DataFrame, t: Thresholds = DEFAULT) -> tuple[DataFrame, DataFrame]:
    scored = highsignal(df, t)
    none = F.when(F.size("highsignal_reasons") == 0, F.array(F.lit("below_threshold"))).otherwise(F.col("highsignal_reasons"))
    removed = scored.where(~F.col("_accept")).select("doc_id", "source_id", F.lit("highsignal").alias("stage"), none.alias("reason_codes"), F.col("highsignal_score").alias("score"))
    return scored.where("_accept").drop("_accept"), removed
